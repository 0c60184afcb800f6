"""
Document fingerprints: a Merkle tree over sections and paragraphs, in
DataFrame operations only.

A paragraph is a line, a section up to eight lines and the blank lines after
them. A paragraph's node is the first 128 bits of its SHA-256, followed by 32
bits for each of its pieces (up to 32 code points of a sentence, and what ends
it), so an edit inside a paragraph is seen beside what it left alone. A section's hash is
the MD5 of its paragraphs' hashes, the root, which is the fingerprint, the
SHA-256 of the sections' hashes. `tree` gives the nodes of a text, `root` the
fingerprint of a tree.

`likeness` goes down two trees from the top. Equal roots end it: 1. Sections
that both have count whole, by their pieces; only sections that differ are
opened into paragraphs, and only paragraphs that differ into pieces. With c
pieces in common and d that one side has alone it is 2c / (2c + d). Each step is
an intersection of sets of nodes, so it is linear in the text. `edits` goes the
same way and returns the places of the paragraphs that differ.

`neighbours` compares every document with the one that follows it by
descending id and with its own text whose end is replaced by that one's
beginning. Only ids, digests and lengths are put in order (written by ranges,
then a window per range and one over the ranges' ends). Texts move once, by id
and digest, equal rows merged before they move; a document then sends only the
code points that its predecessor takes and its tree.

Defined cases: a null text is empty; an empty text has no nodes, and the
fingerprint of none. A null id comes after all others. Rows of one id follow
each other by the SHA-256 of their text, descending; rows that repeat both are
each other's next but for the last. A single row's next is itself. Other columns may have any
name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

#: Lines and their ends: up to eight in a section, with the blank lines that follow.
SECTION = r"(?:[^\n]+\n?){1,8}\n*|\n+"
PARAGRAPH = r"[^\n]*\n|[^\n]+"
PIECE = r"[^\n.!?]{1,32}[\n.!?]*|[\n.!?]+"
#: Hexadecimal digits of a paragraph's and of a piece's hash.
WIDE, NARROW = 32, 8
#: Rows with one id and text that one task returns at a time.
COPIES = 10_000


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _paragraph(text: Column) -> Column:
    return F.concat(F.left(F.sha2(text, 256), F.lit(WIDE)), F.array_join(F.transform(_all(text, PIECE), lambda p: F.left(F.md5(p), F.lit(NARROW))), ""))


def tree(text: Column) -> Column:
    """The sections of a text, each its paragraphs' nodes joined by commas."""
    return F.transform(_all(text, SECTION), lambda s: F.array_join(F.transform(_all(s, PARAGRAPH), _paragraph), ","))


def root(nodes: Column) -> Column:
    """The fingerprint of a tree: 64 hexadecimal digits."""
    def section(s):
        return F.md5(F.array_join(F.transform(F.split(s, ","), lambda p: F.left(p, F.lit(WIDE))), ""))
    return F.sha2(F.array_join(F.transform(nodes, section), ""), 256)


def _opened(sections: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.split(s, ","))))


def _pieces_of(paragraphs: Column) -> Column:
    """The distinct hashes of pieces, read from the nodes that hold them."""
    return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: _all(F.substr(p, F.lit(WIDE + 1)), f".{{{NARROW}}}"))))


def _held(nodes: Column) -> Column:
    """How many pieces nodes hold: of a section as many as its paragraphs do."""
    def count(node):
        return F.floor((F.length(node) + 1 - F.size(F.split(node, ",")) * (WIDE + 1)) / NARROW)
    return F.aggregate(F.transform(nodes, count), F.lit(0).cast("long"), lambda a, b: a + b)


def _with_likeness(df: DataFrame, left: str, right: str, equal: Column, name: str) -> DataFrame:
    """`df` with how alike the trees in two of its columns are, level by level, or 1 where their roots are `equal`; the levels are columns only on the way."""
    own = df.columns
    for level, opened in (("section", None), ("paragraph", _opened), ("piece", _pieces_of)):
        a, b = (F.col(left), F.col(right)) if opened is None else (opened(F.col("only a")), opened(F.col("only b")))
        df = df.withColumns({"a": a, "b": b})
        same = F.array_intersect("a", "b")
        worth = F.size(same).cast("long") if level == "piece" else _held(same)
        df = df.withColumns({f"same {level}": worth, "only a": F.array_except("a", "b"), "only b": F.array_except("b", "a")})
    same = F.lit(2) * (F.col("same section") + F.col("same paragraph") + F.col("same piece"))
    apart = F.size("only a") + F.size("only b")
    return df.select(*own, F.when(equal, F.lit(1.0)).otherwise(same / (same + apart)).alias(name))


def likeness(trees: DataFrame, left: str, right: str) -> DataFrame:
    """The rows of `trees` with `likeness` (0 to 1) of the trees in columns `left` and `right`. No other column is read."""
    return _with_likeness(trees.select(F.struct("*").alias("row"), F.col(left).alias("l"), F.col(right).alias("r")), "l", "r", root(F.col("l")) == root(F.col("r")), "likeness").select("row.*", "likeness")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, tree) of every row."""
    return docs.select(F.col(id_col).alias("id"), tree(text_of(text)).alias("tree")).select("id", root(F.col("tree")).alias("fingerprint"), "tree")


def edits(before: DataFrame, after: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """
    (id, side, start, end): the paragraphs that one version of a document has
    and the other has not, as code points of the side that has them ('before'
    or 'after'). Documents whose roots are equal are not opened. Ids are
    taken to name one row on each side; null ids are left out.
    """
    both = [docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_of(text).alias("body"), F.lit(side).alias("side"))
            for docs, side in ((before, "before"), (after, "after"))]
    roots = both[0].unionByName(both[1]).select("id", "side", "body", root(tree(F.col("body"))).alias("root"))
    changed = roots.groupBy("id").agg(F.countDistinct("root").alias("roots"), F.count(F.lit(1)).alias("n")).where("roots > 1 OR n = 1").select("id")
    lines = roots.join(changed, "id").select("id", "side", F.posexplode(_all(F.col("body"), PARAGRAPH)).alias("no", "line"))
    lines = lines.select("id", "side", "no", F.length("line").alias("n"), F.sha2("line", 256).alias("hash"))
    upto = Window.partitionBy("id", "side").orderBy("no")
    placed = lines.withColumn("end", F.sum("n").over(upto))
    other = lines.select("id", F.when(F.col("side") == "before", "after").otherwise("before").alias("side"), "hash").distinct()
    return placed.join(other, ["id", "side", "hash"], "left_anti").select("id", "side", (F.col("end") - F.col("n")).alias("start"), "end")


def _in_order(rows: DataFrame) -> DataFrame:
    """(id, sha, copies, n, next id, next sha, prev id, prev sha, prev n) of every distinct (id, sha), by descending id; it goes round."""
    order = [F.col("id").desc_nulls_last(), F.col("sha").desc()]
    ids = rows.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    ids, _ = cut(ids.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "by-id")
    here = Window.partitionBy("range").orderBy(*order)
    key = F.struct("id", "sha", "n")
    near = ids.withColumns({"next": F.lead(key).over(here), "prev": F.lag(key).over(here)})
    # One row per range: as many as shuffle partitions, whatever the table's size.
    ends = ids.groupBy("range").agg(
        F.max_by(key, F.struct(F.col("id").isNotNull(), "id", "sha")).alias("first"), F.min_by(key, F.struct(F.col("id").isNotNull(), "id", "sha")).alias("last"))
    line = Window.partitionBy(F.lit(0)).orderBy("range")
    whole = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "range", F.coalesce(F.lead("first").over(line), F.first("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(line), F.last("last").over(whole)).alias("ahead"))
    return near.join(F.broadcast(ends), "range").select(
        "id", "sha", "copies", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "ahead").alias("prev"))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per row of `docs`."""
    body = text_of(text)
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(body, 256).alias("sha"), body.alias("body"))
    links = _in_order(rows.select("id", "sha", F.length("body").alias("n")))
    # Ids may be null: two columns that are not stand for the key.
    def key(i, sha):
        return F.xxhash64(i, sha).alias("key"), F.concat(F.unhex(sha), F.coalesce(i.cast("string"), F.lit("")).cast("binary")).alias("name")
    texts = rows.select(*key(F.col("id"), F.col("sha")), "body").groupBy("key", "name").agg(F.first("body").alias("body"))
    links = links.select(*key(F.col("id"), F.col("sha")), "id", "copies", "next", "prev")
    here = texts.join(links, ["key", "name"]).withColumn("tree", tree(F.col("body"))).withColumn("fingerprint", root(F.col("tree")))
    taken = here.select(
        *key(F.col("prev.id"), F.col("prev.sha")),
        F.struct(F.left("body", F.floor(F.col("prev.n") / 3).cast("int")).alias("head"), "tree", "fingerprint").alias("following"))
    third = F.floor(F.length("body") / 3).cast("int")
    # Of copies all but the last are followed by a copy.
    last = F.array(F.struct(F.lit(1).cast("long").alias("times"), "following"))
    others = F.struct((F.col("copies") - 1).alias("times"), F.struct(F.left("body", third).alias("head"), "tree", "fingerprint").alias("following"))
    both = here.join(taken, ["key", "name"]).withColumn("case", F.explode(F.when(F.col("copies") > 1, F.array_append(last, others)).otherwise(last)))
    edited = F.concat(F.left("body", F.length("body") - third), F.col("case.following.head"))
    both = both.select("id", F.length("body").cast("long").alias("n_chars"), "fingerprint", "tree", edited.alias("edited"), F.col("case.times").alias("times"),
                       F.col("case.following.tree").alias("next_tree"), F.col("case.following.fingerprint").alias("next_fingerprint"))
    both = both.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_tree": tree(F.col("edited"))}).drop("edited")
    both = both.withColumn("edited_fingerprint", root(F.col("edited_tree")))
    for name in ("edited", "next"):
        equal = F.col("fingerprint") == F.col(f"{name}_fingerprint")
        both = _with_likeness(both, "tree", f"{name}_tree", equal, f"near_{name}").drop(f"{name}_tree")
    # Copies of a hot row are written out by many tasks.
    some = F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES))
    dealt = both.withColumn("part", F.explode(some)).repartition("id", "part")
    n = F.least(F.lit(COPIES), F.col("times") - F.col("part") * COPIES).cast("int")
    return dealt.withColumn("copy", F.explode(F.sequence(F.lit(1), n))).select(
        "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
