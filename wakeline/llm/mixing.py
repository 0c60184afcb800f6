"""
Mixing sources to target weights, in DataFrame operations only.

The words of every source are packed into blocks of a fixed number of words:
each document has a place in its source's stream of words. The mix is a list
of output positions, `per_shard` of them to a shard. Each source owns as many
positions as its target asks for; a pseudorandom permutation deals them over
the shards, so the source counts of a shard are a multinomial draw given the
totals (`draws`). Free draws would miss the totals and take a source that is
held at twice its size more than twice. The i-th slot of a source is mapped
through a pseudorandom permutation of its block indexes, a new one for each
pass over the source, and slots and blocks are joined by index.

Permutations are swap-or-not shuffles over exactly 0..n-1, computed from the
index alone, so no task holds or sorts a source's blocks.

Places come from running sums in two steps: inside buckets of documents, whose
number follows the number of rows, and over the buckets. A source with a third
of all rows is thus as many small windows. Only tables of sources are ever in
one task.

Defined cases: a null or blank text has no words, is never taken and has
`taken` 0. A null source is a source of its own, after all others. Rows that
repeat an id are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

ROUNDS = 14


def permuted(rows: DataFrame, index: str, n: str, out: str, key: list[Column], seed: int, rounds: int = ROUNDS) -> DataFrame:
    """`rows` with `out`: a bijection of 0..n-1 applied to `index`, another one for each value of `key`."""
    names = rows.columns
    rows = rows.withColumn("_x", F.col(index))
    for r in range(rounds):
        turned = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), *key), F.col(n)) - F.col("_x")
        rows = rows.withColumn("_y", F.when(turned < 0, turned + F.col(n)).otherwise(turned))
        coin = F.xxhash64(F.lit(seed), F.lit(r + rounds), F.greatest("_x", "_y"), *key).bitwiseAND(F.lit(1)) == 1
        rows = rows.withColumn("_x", F.when(coin, F.col("_y")).otherwise(F.col("_x")))
    return rows.select(*names, F.col("_x").alias(out))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """
    (source, source_no, source_size, target) from (source, source_size).
    Sources in code point order, null last, weigh `weights`, repeating, and
    share `share` times all words; none gets over `most` times its own words,
    and what is over goes to the others by weight until none is above: all
    stop where one common level times the weight meets the bound.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("source_no", F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1).withColumn(
        "w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("source_no", F.lit(len(weights))) + 1)).withColumn(
        "bound", most * F.col("source_size"))
    by_level = everything.orderBy(F.col("bound") / F.col("w"), "source_no")
    goal = share * F.sum("source_size").over(everything)
    held = F.coalesce(F.sum("bound").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (goal - held) / F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", level).withColumn("free", F.col("level") <= F.col("bound") / F.col("w"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("bound") / F.col("w"), "source_no", "level"))).over(everything)["level"]
    return levels.withColumn("top", first).select(
        "source", "source_no", "source_size", F.least("bound", F.coalesce(F.col("top") * F.col("w"), F.col("bound"))).alias("target"))


@dataclass
class Mix:
    """A mix of `docs`; every table is made when first asked for, and the small ones are written once."""

    docs: DataFrame
    block: int = 64
    per_shard: int = 4096
    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    most: float = 2.0
    seed: int = 17
    id_col: str = "doc_id"
    text: str = "text"
    source: str = "source"
    in_bucket: int = 4096

    @cached_property
    def _sized(self) -> tuple[DataFrame, int]:
        body = text_of(self.text)
        return cut(self.docs.select(
            F.col(self.id_col).alias("doc_id"), F.col(self.source).alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(body).alias("digest")), "mix-sizes")

    @cached_property
    def sources(self) -> DataFrame:
        """One row per source: source_no, source_size, target, blocks, slots, and the first of its output positions."""
        sizes = self._sized[0].groupBy("source").agg(F.sum("size").alias("source_size"))
        told = source_targets(sizes, self.weights, self.share, self.most)
        blocks = F.ceil(F.col("source_size") / F.lit(self.block)).cast("long")
        told = told.withColumn("blocks", blocks).withColumn("slots", F.when(F.col("blocks") > 0, F.round(
            F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long")))
        everything = Window.partitionBy(F.lit(0))
        return cut(told.withColumn("first", F.sum("slots").over(everything.orderBy("source_no")) - F.col("slots")).withColumn(
            "positions", F.sum("slots").over(everything)), "mix-sources")[0]

    @cached_property
    def placed(self) -> DataFrame:
        """The documents with `start`, their first word's place in the source's stream."""
        rows, n = self._sized
        buckets = max(1, -(-n // self.in_bucket))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)))
        inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "digest", "size").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        totals = self._sized[0].withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets))).groupBy(
            "source", "bucket").agg(F.sum("size").alias("total"))
        over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("total").over(over), F.lit(0)).alias("base"))
        base = rows.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        told = self.sources.select(F.col("source").alias("s2"), "source_no", "source_size", "target")
        placed = base.drop("s", "b").join(told, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
        return cut(placed.withColumn("start", F.col("base") + F.col("inside")).drop("bucket", "inside", "base"), "mix-places")[0]

    @cached_property
    def pieces(self) -> DataFrame:
        """(source_no, block, start, words, skip): the part of each document that lies in each block; skip counts the document's words before it."""
        n = F.lit(self.block)
        end = F.col("start") + F.col("size")
        whole = self.placed.where("size > 0").select("source_no", "start", end.alias("end"), F.explode(F.sequence(
            F.floor(F.col("start") / n), F.floor((end - 1) / n))).alias("block"))
        begin = F.greatest("start", F.col("block") * n)
        return whole.select("source_no", "block", "start", (F.least("end", (F.col("block") + 1) * n) - begin).alias("words"), (begin - F.col("start")).alias("skip"))

    @cached_property
    def slots(self) -> DataFrame:
        """(shard, position, source_no, slot, block): what stands at every output position."""
        chunk = 1 << 14
        total = self.sources.agg(F.sum("slots")).first()[0] or 0
        parts = self.sources.where("slots > 0").select("source_no", "blocks", "slots", "first", "positions", F.explode(F.sequence(
            F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.lit(chunk)))).alias("chunk")).repartition(
                max(1, -(-total // (4 * chunk))), "source_no", "chunk")
        rows = parts.select("source_no", "blocks", "first", "positions", F.explode(F.sequence(
            F.col("chunk") * chunk, F.least((F.col("chunk") + 1) * chunk, F.col("slots")) - 1)).alias("slot"))
        rows = rows.withColumn("place", F.col("first") + F.col("slot"))
        rows = permuted(rows, "place", "positions", "position", [], self.seed)
        rows = rows.withColumn("turn", F.floor(F.col("slot") / F.col("blocks"))).withColumn("index", F.pmod("slot", "blocks"))
        rows = permuted(rows, "index", "blocks", "block", [F.col("source_no"), F.col("turn")], self.seed + 1)
        return cut(rows.select(F.floor(F.col("position") / F.lit(self.per_shard)).alias("shard"), "position", "source_no", "slot", "block"), "mix-slots")[0]

    @cached_property
    def draws(self) -> DataFrame:
        """(shard, source_no, drawn): how many blocks of each source a shard takes."""
        return self.slots.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("drawn"))

    @cached_property
    def takes(self) -> DataFrame:
        """The pieces that the mix takes, with `times`."""
        times = self.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
        return self.pieces.join(times, ["source_no", "block"])

    def taken(self) -> DataFrame:
        """Every document with doc_id, source, size, source_size, target and the words that the mix takes of it, repeats counted."""
        sums = self.takes.groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        rows = self.placed.select("doc_id", "source", "size", "source_size", "target", "source_no", F.when(F.col("size") > 0, F.col("start")).alias("start"))
        return rows.join(sums, ["source_no", "start"], "left").select(
            "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def _texts(self, narrow: DataFrame) -> DataFrame:
        """`narrow` (with doc_id, source and digest) beside the row and words of its document; texts move once, keyed by all three."""
        rows = self.docs.select(F.col(f"`{self.id_col}`").alias("i"), F.col(f"`{self.source}`").alias("s"), F.xxhash64(text_of(self.text)).alias("d"), F.struct("*").alias("row"))
        rows = rows.groupBy("i", "s", "d").agg(F.first("row").alias("row"))
        on = F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("digest") == F.col("d"))
        return narrow.join(rows, on).drop("i", "s", "d").withColumn("list", F.regexp_extract_all(F.col(f"row.`{self.text}`"), F.lit(WORD), F.lit(0)))

    def _spans(self) -> DataFrame:
        """(doc_id, source, digest, source_no, start, spans) of documents that the mix takes something of."""
        spans = self.takes.groupBy("source_no", "start").agg(F.array_sort(F.collect_list(F.struct("skip", "words", "times", "block"))).alias("spans"))
        return self.placed.where("size > 0").select("doc_id", "source", "digest", "source_no", "start").join(spans, ["source_no", "start"])

    def blocks(self) -> DataFrame:
        """The mix itself: (shard, position, source_no, block, text), one row per output position."""
        parts = self._texts(self._spans()).select("source_no", "start", "list", F.explode("spans").alias("p")).select(
            "source_no", "p.block", "start", F.array_join(F.slice("list", (F.col("p.skip") + 1).cast("int"), F.col("p.words").cast("int")), " ").alias("part"))
        texts = parts.groupBy("source_no", "block").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), " ").alias("text"))
        return self.slots.join(texts, ["source_no", "block"]).select("shard", "position", "source_no", "block", "text")

    def mixed(self) -> DataFrame:
        """
        The rows of `docs` as the mix takes them: one row for each pass that
        takes something of a document, its text the words taken in that pass
        (the text as it was, where all are). Rows that repeat id, source and
        text have the other columns of any one of them.
        """
        most = int(-(-self.most // 1))
        rows = self._texts(self._spans()).withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(most))))
        rows = rows.withColumn("spans", F.filter("spans", lambda s: s["times"] >= F.col("pass"))).where(F.size("spans") > 0)
        got = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
        some = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(F.col("list"), (s["skip"] + 1).cast("int"), s["words"].cast("int")))), " ")
        whole = F.col(f"row.`{self.text}`")
        new = F.when(got == F.size("list"), whole).otherwise(some)
        return rows.withColumn("new", new).select(*(
            F.col("new").alias(c) if c == self.text else F.col(f"row.`{c}`").alias(c) for c in self.docs.columns))
