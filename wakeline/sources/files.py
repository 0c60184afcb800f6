"""Files on storage: hashing what has no digest yet, listings, and the sheets a run was launched from."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators.graph import NODE
from wakeline.session import grown

# Bytes of a file that are held at a time.
PIECE = 1 << 20


def opened(path: str):
    """A listed file as a stream, by the file system that its address names."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return LocalFileSystem().open_input_stream("/" + (rest if colon else path).lstrip("/"))
    system, place = FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    return system.open_input_stream(place)


def hash_files(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """
    (path, size, digest, problem) of every file under a root. Spark lists the
    files, and deals them to tasks; a task streams each of its files in pieces
    through the file system its address names (local or mounted folders, HDFS,
    S3, GCS), so one way does for all sizes. A file that cannot be read keeps
    its row and says why. Spark's listing leaves out files without any bytes.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        _below(F.col("path"), root).alias("below"), "path", "length")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for below, path, length in batch[["below", "path", "length"]].itertuples(index=False, name=None):
                seen, size = hashlib.sha256(), 0
                try:
                    with opened(path) as stream:
                        while piece := stream.read(PIECE):
                            seen.update(piece)
                            size += len(piece)
                    rows.append((below, size, f"sha256:{seen.hexdigest()}", None))
                except (OSError, ValueError) as error:
                    rows.append((below, length, None, type(error).__name__))
            yield pd.DataFrame(rows, columns=["path", "size", "digest", "problem"])

    dealt = listed.repartition(tasks, "path") if tasks else listed.repartition("path")
    return dealt.mapInPandas(digest, "path string, size bigint, digest string, problem string")


def _below(path, root: str):
    return F.regexp_replace(path, "^.*?\\Q" + root.split("://", 1)[-1].rstrip("/") + "\\E/", "")


def digest_files(outputs: DataFrame, resolved: DataFrame, hashed: DataFrame) -> DataFrame:
    """
    Outputs with the digests of hashed files (run_id, path, size, digest) under
    their task directories, and `how`: kept, hashed or missing. A digest
    already recorded stays, whatever its algorithm: it may join this run to others.
    """
    placed = outputs.join(grown(resolved.select(*NODE, "rel")), NODE, "left").withColumn("path", F.concat("rel", F.lit("/"), "file"))
    found = hashed.select("run_id", "path", F.col("size").alias("_size"), F.col("digest").alias("_digest"))
    rows = placed.join(grown(found), ["run_id", "path"], "left")
    kept = F.contains(F.coalesce("digest", F.lit("")), F.lit(":"))
    how = F.when(kept, "kept").when(F.col("_digest").isNotNull(), "hashed").otherwise("missing")
    return rows.select(*NODE, "file", F.when(how == "hashed", F.col("_size")).otherwise(F.col("size")).alias("size"),
                       F.when(how == "hashed", F.col("_digest")).otherwise(F.col("digest")).alias("digest"), how.alias("how"))


def digest_counts(digested: DataFrame) -> DataFrame:
    """Outputs hashed, kept and missing, and the bytes read."""
    done = lambda how: F.count_if(F.col("how") == how).alias(how)
    return digested.groupBy("run_id").agg(done("hashed"), done("kept"), done("missing"), F.coalesce(
        F.sum(F.when(F.col("how") == "hashed", F.col("size"))), F.lit(0)).alias("bytes"))


# ------------------------------------------------------------------- sheets

def sheet_labels(rows: DataFrame, owner: str, member: str | None = None) -> DataFrame:
    """(label, owner) of a launch sheet: every owner under itself, every member under its owner."""
    said = rows.select(F.trim(F.coalesce(owner, F.lit(""))).alias("owner"),
                       (F.trim(F.coalesce(member, F.lit(""))) if member else F.lit("")).alias("member")).where("owner <> ''")
    return said.select(F.explode(F.array("owner", "member")).alias("label"), "owner").where("label <> ''").distinct()


def read_launch_sheet(spark: SparkSession, path: str, owner: str, member: str | None = None) -> DataFrame:
    return sheet_labels(spark.read.option("header", True).csv(path), owner, member)


def refused_labels(labels: DataFrame) -> DataFrame:
    """(label, owners): ids under more than one owner, which cannot be attributed; the sheet is refused on any."""
    return labels.groupBy("label").agg(F.count_distinct("owner").alias("owners")).where("owners > 1")


def library_ids(lines: DataFrame) -> DataFrame:
    """The second word of each line (value) of a molecule library; comments and bare lines name nothing."""
    words = F.split(F.trim("value"), r"\s+")
    return lines.where(~F.startswith("value", F.lit("#")) & (F.size(words) >= 2)).select(words[1].alias("id")).distinct()
