"""What several of these operators need: whole texts as flat bytes, and components of a link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, scratch_path

__all__ = ["components", "cut", "documents", "flat", "marked", "rows_by", "scratch_path", "text_of"]

#: Runs of anything but white space of the ASCII range, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column one after the other, and where each row starts; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, where, data = column.buffers()
    ends = np.frombuffer(where, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), ends
    return np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]], ends - ends[0]


#: Bits of the map of marked keys.
MARKS = 1 << 24


def marked(rows: DataFrame, key, keys: DataFrame) -> DataFrame:
    """
    The rows whose `key` (a number) falls on a bit of a map of `MARKS` bits that the numbers `keys` (key) mark: all
    that have one of them, and few others while the marked are few beside the bits. The map has at most MARKS / 64
    rows, and is what is sent to every task, so most rows that nobody asks for never leave theirs.
    """
    def place(c):
        at = F.pmod(c, F.lit(MARKS))
        return F.call_function("div", at, F.lit(64)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    word, bit = place(F.col("key"))
    marks = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    word, bit = place(key)
    found = rows.select(F.struct("*").alias("row"), word.alias("at"), bit.alias("bit")).join(F.broadcast(marks), F.col("at") == F.col("word"))
    return found.where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("row.*")


def rows_by(docs: DataFrame, decided: DataFrame, how: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with (left_semi) or without (left_anti) their id and text's XXH64 in `decided` (id, digest); any column names."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.xxhash64(text_of(text)).alias("d"))
    on = F.col("i").eqNullSafe(F.col("id")) & (F.col("d") == F.col("digest"))
    return rows.join(decided.select("id", "digest"), on, how).select("row.*")


def _sum(df: DataFrame, *columns: str):
    """Count and order-free checksum of the rows; two numbers, whatever the size."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """
    (node, root) for every node of `edges` (u, v: the same orderable type),
    root the smallest node reachable; nodes without an edge are not listed.

    Alternating star contraction: every node hands its larger, then its
    smaller neighbours to the smallest node it knows, so rows never exceed the
    edges and the rounds grow with the logarithm of the longest path. Each
    round is a map-side combined minimum joined back to the edges (a hub's
    rows are split by the skew join) and is written to the shared folder, so
    no round depends on the one before it being recomputed.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, rows = cut(edges, label)
    before = None
    while rows:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(lowest, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, _ = cut(large.where("u <> v").distinct(), label)
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(lowest, F.col("u") == F.col("k")).select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges, rows = cut(small.where("u <> v").distinct(), label)
        now = _sum(edges, "u", "v")
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
