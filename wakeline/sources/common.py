"""What every ingest job shares: the tables it fills, and reading trees of records."""

from __future__ import annotations

import json
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from wakeline.functions.text import ancestors

EXTERNAL = "EXTERNAL"


class Lineage(NamedTuple):
    """tasks, edges (consumer to producer), outputs with size and digest, coverage notes, and documents nobody could read."""
    tasks: DataFrame
    edges: DataFrame
    outputs: DataFrame
    coverage: DataFrame | None = None
    published: DataFrame | None = None
    refused: DataFrame | None = None


UNREADABLE = "not a JSON object"


def readable(documents: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """
    The documents whose `value` is a JSON object, and (run_id, path, problem)
    of the others, which are thus rows and neither lost nor half read. Without
    a column for the path the text's SHA-256 stands in.
    """
    broken = F.coalesce(~F.startswith(F.ltrim("value"), F.lit("{")) | F.try_parse_json("value").isNull(), F.lit(True))
    run = F.col("run_id") if "run_id" in documents.columns else F.lit(None).cast("string")
    where = F.col(path).cast("string") if path else F.sha2(F.coalesce("value", F.lit("")), 256)
    refused = documents.where(broken).select(run.alias("run_id"), where.alias("path"), F.lit(UNREADABLE).alias("problem"))
    return documents.where(~broken), refused


TASK_DEFAULTS = {
    "name": "string", "process": "string", "container": "string", "status": "string", "engine_status": "string",
    "script": "string", "workdir": "string", "target": "string"}
TASK_OPTIONAL = {"workpath": "string", "labels": "map<string,string>", "metrics": "map<string,double>"}
TASK_FLAGS = ("superseded", "cached", "unexpanded_subworkflow")


def task_table(df: DataFrame, **columns: Column) -> DataFrame:
    """The task table from whatever an engine records; what it does not record is empty, NULL or false."""
    picked = [columns["run_id"].alias("run_id"), columns["task"].alias("task")]
    picked += [F.coalesce(columns.get(c, F.lit("")), F.lit("")).cast(t).alias(c) for c, t in TASK_DEFAULTS.items()]
    picked += [columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in TASK_OPTIONAL.items()]
    picked += [F.coalesce(columns.get(c, F.lit(False)), F.lit(False)).alias(c) for c in TASK_FLAGS]
    return df.select(*picked)


def read_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, value): every file of a folder tree whose name fits, whole, its path relative to the root."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    below = F.regexp_replace(F.regexp_replace(F.input_file_name(), "^[a-z0-9]+:/+", "/"), "^.*?" + _quoted(root.rstrip("/")) + "/", "")
    return files.select(F.url_decode(below).alias("path"), "value")


def _quoted(text: str) -> str:
    return "\\Q" + text.split("://", 1)[-1] + "\\E"


LEAVES = ArrayType(StructType([
    StructField("ix", IntegerType()), StructField("at", StringType()), StructField("key", StringType()), StructField("value", StringType())]))


@F.pandas_udf(LEAVES)
def json_strings(documents: pd.Series) -> pd.Series:
    """
    Every string anywhere in a JSON document, in order: (ix, at, key, value),
    where `at` is the path of the object or list that holds it.
    """
    def walk(value, at, key):
        if isinstance(value, str):
            yield at, key, value
        elif isinstance(value, (dict, list)):
            pairs = value.items() if isinstance(value, dict) else enumerate(value)
            for name, inner in pairs:
                yield from walk(inner, at if key is None else f"{at}/{key}", str(name))

    def leaves(text):
        if text is None:
            return []
        return [{"ix": i, "at": at, "key": key, "value": value} for i, (at, key, value) in enumerate(walk(json.loads(text), "", None))]

    return documents.map(leaves)


def string_leaves(df: DataFrame, document: str, *keep: str) -> DataFrame:
    """One row per string inside a document column, with the columns to keep."""
    return df.where(F.col(document).isNotNull()).select(*keep, F.explode(json_strings(document)).alias("s")).select(*keep, "s.*")


def path_producers(paths: DataFrame, made: DataFrame) -> DataFrame:
    """
    (run_id, path, producer): who made each path of `paths` (run_id, path),
    from `made` (run_id, path, producer): that very path, else the longest
    folder above it. Every ancestor takes part in one equi-join; nothing is
    compared by prefix. NULL where nobody did.
    """
    wanted = paths.select("run_id", "path").distinct()
    bare = made.select("run_id", F.regexp_replace("path", "/+$", "").alias("folder"), "producer").groupBy("run_id", "folder").agg(
        F.min("producer").alias("above"))
    exact = made.groupBy("run_id", "path").agg(F.min("producer").alias("exact"))
    folders = wanted.select("run_id", "path", F.explode(ancestors(F.col("path"))).alias("a")).select("run_id", "path", "a.*")
    nearest = folders.join(bare, ["run_id", "folder"]).groupBy("run_id", "path").agg(F.max_by("above", "depth").alias("above"))
    return wanted.join(exact, ["run_id", "path"], "left").join(nearest, ["run_id", "path"], "left").select(
        "run_id", "path", F.coalesce("exact", "above").alias("producer"))
