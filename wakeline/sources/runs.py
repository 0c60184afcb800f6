"""The catalogue of runs: order, resolving what a person typed, and digests kept beside a record."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.session import cut

#: After every other character of a text.
LAST = "\U0010ffff"



def run_catalog(runs: DataFrame) -> DataFrame:
    """Runs with `by_mtime`, oldest first: recorded timestamps among themselves, the rest after them by file time."""
    rows = runs.withColumn("by_mtime", F.coalesce("timestamp", F.lit("")) == "")
    return rows.orderBy("by_mtime", F.coalesce("timestamp", F.lit("")), "mtime", "id")


def begun_by(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """
    (request, key) for every distinct `key` that begins with a `request`; both
    are not empty. Keys are sorted into ranges; a request goes to the ranges
    that its interval, from itself to the last text that begins with it, meets.
    A range is then read once in order: the requests that begin the key at hand
    lie on a stack, each beginning the next. No prefix of a key is made.
    """
    sorted_keys = keys.select("key").distinct().repartitionByRange("key").withColumn("range", F.spark_partition_id())
    sorted_keys, _ = cut(sorted_keys, "sorted-keys")
    # One row per range.
    ranges = sorted_keys.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    sent = requests.select("request").distinct().join(
        F.broadcast(ranges), (F.col("request") <= F.col("high")) & (F.concat("request", F.lit(LAST)) >= F.col("low"))).select("range", F.col("request").alias("text"), F.lit(0).alias("kind"))
    rows = sent.unionByName(sorted_keys.select("range", F.col("key").alias("text"), F.lit(1).alias("kind")))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = None, []
        for batch in batches:
            found = []
            for place, text, kind in batch[["range", "text", "kind"]].itertuples(index=False, name=None):
                if place != at:
                    at, stack = place, []
                while stack and not text.startswith(stack[-1]):
                    stack.pop()
                if kind:
                    found += [(request, text) for request in stack]
                else:
                    stack.append(text)
            yield pd.DataFrame(found, columns=["request", "key"])

    return rows.repartition("range").sortWithinPartitions("range", "text", "kind").mapInPandas(follow, "request string, key string")


def resolve_runs(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """
    (request, id, matches, problem) for requests naming a run, or the start of
    a run's or session's id. A session stands for its newest run. NULL asks
    for the newest run there is. Anything but one match is refused.
    """
    rows = runs.withColumn("place", F.struct((F.coalesce("timestamp", F.lit("")) == "").alias("by_mtime"),
                                             F.coalesce("timestamp", F.lit("")).alias("at"), F.col("mtime"), F.col("id")))
    asked = wanted.where("request IS NOT NULL").select("request").distinct()
    # A run is known by its name as it is, and by its two ids, of which the start is enough.
    ids = rows.select("id", "session", "place", F.explode(F.array_distinct(F.array("id", "session"))).alias("key")).where("key <> ''")
    begun = begun_by(ids, asked.where("request <> ''")).join(ids, "key").select("request", "id", "session", "place")
    named = rows.where("name <> ''").join(asked, F.col("name") == F.col("request")).select("request", "id", "session", "place")
    hits = asked.join(begun.unionByName(named).distinct(), "request", "left")
    found = hits.groupBy("request").agg(
        F.count("id").alias("matches"), F.max_by("id", "place").alias("newest"),
        ((F.min("session") == F.max("session")) & (F.count("session") == F.count("id"))).alias("one_session"))
    ok = (F.col("matches") == 1) | ((F.col("matches") > 1) & F.col("one_session"))
    named = found.select("request", F.when(ok, F.col("newest")).alias("id"), "matches",
                         F.when(~ok, F.concat(F.lit("matched "), F.col("matches").cast("string"), F.lit(" runs"))).alias("problem"))
    latest = rows.agg(F.max_by("id", "place").alias("id"), F.count("*").alias("matches")).withColumn("k", F.lit(0))
    unnamed = wanted.where("request IS NULL").distinct().withColumn("k", F.lit(0)).join(latest, "k").select(
        "request", "id", "matches", F.when(F.col("matches") == 0, "no runs").alias("problem"))
    return named.unionByName(unnamed)


def merge_sidecar_digests(outputs: DataFrame, sidecar: DataFrame) -> DataFrame:
    """
    Outputs with digests from a sidecar (run_id, task, file, digest): filled in
    where the engine recorded none or another algorithm's, never over a sha256;
    files the engine did not list are added.
    """
    key = ["run_id", "task", "file"]
    ours = F.startswith(F.coalesce("digest", F.lit("")), F.lit("sha256:"))
    both = outputs.withColumn("listed", F.lit(True)).join(sidecar.select(*key, F.col("digest").alias("kept")), key, "full")
    return both.withColumn("digest", F.when(ours, F.col("digest")).otherwise(F.coalesce("kept", "digest"))).drop("kept", "listed")
