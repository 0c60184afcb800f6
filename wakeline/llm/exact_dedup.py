"""
Exact dedup by skew-safe combining, in DataFrame operations only.

Equal texts are found in three steps, each of which groups by the whole text
beside its digest, so a digest that two texts share never merges them:

1. every task merges the copies it holds (map-side combine);
2. what is left is merged by (digest, salt), where the salt is the number of
   the task the row came from, so the copies of one text, were they a third of
   all rows, arrive at many tasks as a few rows each;
3. the winners of the salts are combined by digest.

Defined cases: a null text is the empty text. A null id is smaller than any
id. Rows that repeat both id and text are the same document: all of them name
the same `keep_id`, and `survivors` returns one. Other columns may have any
name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

SALTS = 64


def _combine(docs: DataFrame, text: str, carry: dict[str, Column], local: dict, both: dict, salts: int) -> DataFrame:
    body = text_of(text)
    rows = docs.select(
        F.xxhash64(body).alias("digest"), (F.spark_partition_id() % F.lit(salts)).alias("salt"), body.alias("body"),
        *(c.alias(k) for k, c in carry.items()))
    salted = rows.groupBy("digest", "salt", "body").agg(*(f.alias(k) for k, f in local.items()))
    return salted.groupBy("digest", "body").agg(*(f.alias(k) for k, f in both.items()))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """(body, keep_id, group_size) for each distinct text: its largest id and how many rows have it."""
    return _combine(
        docs, text, {"id": F.col(id_col)},
        {"id": F.max("id"), "n": F.count(F.lit(1))},
        {"keep_id": F.max("id"), "group_size": F.sum("n")}, salts).drop("digest")


def members(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """
    One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.
    A row finds its class by SHA-256, XXH64 and length of its whole text, so no
    text is moved for it; the join's two sides are plain shuffles, which Spark
    splits where one text is hot.
    """
    body = F.col("body")
    known = (F.sha2(body, 256).alias("text_sha256"), F.xxhash64(body).alias("xx"), F.length(body).alias("n"))
    groups = classes(docs, id_col, text, salts).select(*known, "keep_id", "group_size")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("body")).select("doc_id", *known)
    return rows.join(groups, ["text_sha256", "xx", "n"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, one per distinct text, with all their columns: the largest id; of equal ids any one row, the same in every run."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    # The text travels once, as the key; beside it only the other columns and whether it was null.
    row = F.struct(F.struct(*others).alias("others"), F.col(text).isNull().alias("blank"))
    rank = F.struct(F.col(id_col).alias("a"), F.to_json(F.struct(*others)).alias("b"), F.col(text).isNotNull().alias("c"))
    best = _combine(docs, text, {"row": row, "rank": rank},
                    {"best": F.max_by("row", "rank"), "top": F.max("rank")},
                    {"best": F.max_by("best", "top")}, salts)
    return best.select(*(
        F.when(~F.col("best.blank"), F.col("body")).alias(c) if c == text else F.col(f"best.others.`{c}`").alias(c) for c in docs.columns))
