"""
Spelling variant grouping with a variable-length gram index.

`vocabulary` counts the words of all texts. `variants` finds the words that
differ by exactly one inserted, deleted or replaced code point and follows
each word's most frequent near spelling to a root.

A dictionary of grams of 2 to 6 code points is pruned by frequency: it keeps a
gram that occurs more often than `FEW` times and than a share of 1 / `GRAMS` of
all places, so it has at most 5 * `GRAMS` entries however many words there
are; that proven bound is what is sent to every task. A word, with a mark at
both ends, is decomposed into one gram per place: the shortest that is not in
the dictionary, or the longest allowed. So a gram depends on the code points
that it holds and on no others, and an edit affects the grams that cover it:
at most NAG of them, which is counted per word. Two near words share all
distinct grams but NAG of either, hence the rarest that they share is among
the NAG + 1 rarest of both (an order by dictionary count, then by gram). Only
these lists are merged: the index has NAG + 1 rows a word. As words of seven
code points have eight places and no gram covers more than six, NAG never
reaches the number of places; of a shorter word, or one that repeats its
grams, all grams are listed, and a word whose grams may all be affected is
listed under each of its places' deletions as well (`_rest`), which finds it
without grams.

A shared gram that no edit touched lies at the same distance from the start or
from the end of both words. Lists are keyed by gram and length and merged by an
equi-join, inside which that place, the letters that both hold and the edit
distance are tested; what leaves it are links, not the pairs of a list.

Defined cases: null texts have no words. A null id is written as nothing
before the colon. Rows that repeat an id and a text count each. A word of any
length is one word. Ties of the most frequent near word go to the smallest in
code point order. Other columns may have any name. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 7
SHORTEST, LONGEST = 2, 6
FEW = 32
GRAMS = 1 << 16
#: Marks of a word's start and end; no letters.
START, END = "\x01", "\x02"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, times: int = 2) -> DataFrame:
    """(word, n): words of `least` code points or more that occur `times` or more. A 31st of all runs lose one code point, by their CRC-32."""
    runs = F.regexp_extract_all(text_of(text), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("run"))
    rows = rows.select("i", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("i", F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % 31 == 0, F.concat(F.left("run", at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def frequent_grams(words: DataFrame, few: int = FEW, most: int = GRAMS) -> dict[str, int]:
    """The dictionary: grams that occur at more than `few` places and more than one of `most`, with how often; at most 5 * `most`."""
    padded = F.concat(F.lit(START), F.col("word"), F.lit(END))
    rows = words.select(padded.alias("s"), (F.length("word") + 1).alias("places"))
    # one pass counts all places and all grams; a place near the end has no longer grams
    places = rows.agg(F.sum("places")).first()[0] or 0
    grams = rows.select("s", F.explode(F.sequence(F.lit(1), F.col("places"))).alias("p")).select(F.explode(F.transform(
        F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("s") - F.col("p") + 1)), lambda q: F.substr("s", F.col("p"), q))).alias("gram"))
    kept = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(few, places // most))
    return {r["gram"]: r["n"] for r in kept.collect()}


def decompose(word: str, frequent: dict[str, int]) -> tuple[list[str], int]:
    """The gram of each place of the marked word, and how many of them one edit may affect."""
    s = START + word + END
    grams, change = [], [0] * (len(s) + 1)
    for p in range(len(s) - SHORTEST + 1):
        end = p + SHORTEST
        while end < len(s) and end - p < LONGEST and s[p:end] in frequent:
            end += 1
        grams.append(s[p:end])
        change[p] += 1
        change[end] -= 1
    covered, most = 0, 0
    for i in range(len(s) - 1):
        covered += change[i]
        if i:  # marks are not edited
            most = max(most, covered)
    return grams, most


def listed(word: str, frequent: dict[str, int]) -> tuple[list[tuple[str, int]], bool]:
    """(gram, place) for every place of the word's NAG + 1 rarest distinct grams, and whether one edit may affect all its grams."""
    grams, affected = decompose(word, frequent)
    rare = sorted(set(grams), key=lambda g: (frequent.get(g, 0), g))
    rest = affected >= len(rare)
    rare = set(rare[:affected + 1])
    return [(g, p) for p, g in enumerate(grams) if g in rare], rest


def index(words: DataFrame, few: int = FEW, most: int = GRAMS) -> DataFrame:
    """(gram, place, word, letters, rest): the lists of the index. `letters` has a bit for each of 64 classes of letters in the word."""
    frequent = words.sparkSession.sparkContext.broadcast(frequent_grams(words, few, most))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                gram, place, word, letters, left = [], [], [], [], []
                for w in batch.column(0).slice(at, 4096).to_pylist():
                    places, rest = listed(w, frequent.value)
                    held = 0
                    for c in set(w):
                        held |= 1 << (ord(c) & 63)
                    held -= (held >> 63) << 64
                    for g, p in places:
                        gram.append(g)
                        place.append(p)
                    n = len(places)
                    word += [w] * n
                    letters += [held] * n
                    left += [rest] * n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram, pa.string()), pa.array(place, pa.int32()), pa.array(word, pa.string()),
                     pa.array(letters, pa.int64()), pa.array(left, pa.bool_())], ["gram", "place", "word", "letters", "rest"])

    return words.select("word").mapInArrow(rows, "gram string, place int, word string, letters long, rest boolean")


def _one_edit(a: str, b: str):
    return F.levenshtein(a, b, 1) == 1


def _rest(words: DataFrame, lists: DataFrame) -> DataFrame:
    """Links (a, b) of words whose grams one edit may all affect: near words share a word with one code point deleted, or one is the other's."""
    def holes(df, w):
        cut_out = F.transform(F.sequence(F.lit(1), F.length(w)), lambda p: F.concat(F.left(w, p - 1), F.substr(w, p + 1)))
        return df.select(w, F.explode(F.array_distinct(F.array_append(cut_out, F.col(w)))).alias("key"))
    asked = holes(lists.where("rest").select(F.col("word").alias("a")).distinct(), "a")
    return asked.join(holes(words.select(F.col("word").alias("b")), "b"), "key").where(_one_edit("a", "b")).select("a", "b")


def links(words: DataFrame, few: int = FEW, most: int = GRAMS) -> DataFrame:
    """(a, b) once for each two words of `words` (word, n) that differ by one edit, a before b."""
    lists, _ = cut(index(words, few, most), "gram-lists")
    size, n = F.length("b"), F.length("a")
    left = lists.select(F.xxhash64("gram", F.length("word")).alias("list"), F.col("word").alias("a"), F.col("letters").alias("held"), F.col("place").alias("at"))
    # A word is asked for by words of its length and by those that are shorter by one.
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1))
    right = lists.select("gram", "word", "letters", "place", lengths.alias("length")).select(
        F.xxhash64("gram", "length").alias("list"), F.col("word").alias("b"), "letters", "place")
    # A gram before the edit has one place in both words; one after it has one place from the end.
    aligned = (F.col("at") == F.col("place")) | (n - F.col("at") == size - F.col("place"))
    alike = F.bit_count(F.col("held").bitwiseXOR(F.col("letters"))) <= 2
    once = (n < size) | (F.col("a") < F.col("b"))
    found = left.join(right, "list").where(aligned & alike & once & _one_edit("a", "b")).select("a", "b")
    if lists.where("rest").limit(1).count():
        found = found.unionByName(_rest(words, lists))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def variants(words: DataFrame, ratio: int = 10, few: int = FEW, most: int = GRAMS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of `words` (word, n)."""
    words, _ = cut(words, "words")
    near = links(words, few, most)
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # A word's near words are counted and compared map-side first; the smallest (-n, word) is the best.
    best = near.join(words.withColumnRenamed("word", "b"), "b").groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("b").alias("form"))).alias("best"))
    form = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best"))
    rows = words.join(best.withColumnRenamed("a", "word"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form["form"].alias("form"), (-form["m"]).alias("form_n"))
    rows, _ = cut(rows, "forms")
    # A form is ten times as frequent as its word, so forms end; each round doubles how far a root is followed.
    ends, left = cut(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while left:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends, _ = cut(ends.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        left = ends.where("moved").limit(1).count()
        ends = ends.drop("moved")
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
