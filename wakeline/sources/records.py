"""Engines that write one record per task, with digests of everything read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.instants import instant
from wakeline.functions.text import basename
from wakeline.operators.triggers import normalise_status
from wakeline.sources.common import EXTERNAL, Lineage, readable, task_table

ARTIFACT = "array<struct<id: string, path: string, size: bigint, sha256: string, labels: map<string,variant>>>"
RECORD = ("run string, task struct<id: string, definition_id: string, name: string, status: string, started_at: string, finished_at: string>, "
          "target struct<location_id: string>, working_dir string, environment struct<executor: struct<kind: string, sha256: string>>, "
          f"code array<struct<path: string>>, inputs {ARTIFACT}, outputs {ARTIFACT}")


def _words(labels):
    """Labels whose value is a string."""
    kept = F.map_filter(labels, lambda _, v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform_values(kept, lambda _, v: F.try_variant_get(v, "$", "string")), F.create_map().cast("map<string,string>"))


def ingest_run_records(records: DataFrame, declared: DataFrame, runs: DataFrame) -> Lineage:
    """
    Tables out of task records (record_ix, value). `declared` is the
    workflows' own edges (run_id, source, target, target_input), `runs`
    (run_id, run_directory).

    An input's producer is the first task in record order that wrote the same
    digest; a task that merely passed its input through did not make it, so
    that falls back to the declared edge, as does an input without a digest.
    """
    records, refused = readable(records, "record_ix")
    rows = records.select("record_ix", F.from_json("value", RECORD).alias("r")).select(
        "record_ix", F.col("r.run").alias("run_id"), F.col("r.task.id").alias("id"), F.concat_ws("/", "r.run", "r.task.id").alias("task"), "r")
    wrote = rows.select("record_ix", "run_id", "task", F.posexplode("r.outputs").alias("ix", "a"))
    made = wrote.where(F.coalesce("a.sha256", F.lit("")) != "").groupBy("run_id", F.col("a.sha256").alias("sha256")).agg(
        F.min_by("task", F.struct("record_ix", "ix")).alias("by_digest"))
    own = declared.where(~F.startswith("source", F.lit("artifact-"))).select(
        "run_id", F.col("target").alias("id"), F.col("target_input").alias("input"), F.concat_ws("/", "run_id", "source").alias("declared")).distinct()
    read = rows.select("run_id", "id", "task", F.posexplode("r.inputs").alias("ix", "a")).select(
        "run_id", "id", "task", "ix", F.col("a.id").alias("input"), F.coalesce("a.path", F.lit("")).alias("path"), "a.labels",
        F.when(F.coalesce("a.sha256", F.lit("")) != "", F.col("a.sha256")).alias("sha256"))
    joined = read.join(made, ["run_id", "sha256"], "left").join(own, ["run_id", "id", "input"], "left")
    producer = F.when(F.col("by_digest") != F.col("task"), F.col("by_digest")).otherwise(F.col("declared"))
    edges = joined.select(
        "run_id", F.col("ix").cast("bigint").alias("edge_ix"), F.col("task").alias("consumer"), F.coalesce(producer, F.lit(EXTERNAL)).alias("producer"),
        basename(F.col("path")).alias("filename"), F.col("path").alias("target"),
        F.when(F.col("sha256").isNotNull(), F.concat(F.lit("sha256:"), "sha256")).alias("digest"), _words(F.col("labels")).alias("labels"))

    # Inputs first, then outputs: where artifacts disagree the last one's word stands.
    touched = F.concat(F.coalesce("r.inputs", F.array().cast(ARTIFACT)), F.coalesce("r.outputs", F.array().cast(ARTIFACT)))
    entries = F.flatten(F.transform(touched, lambda a: F.map_entries(_words(a["labels"]))))
    empty = F.create_map().cast("map<string,string>")
    merged = F.aggregate(entries, empty, lambda m, e: F.map_concat(
        F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e))))
    executor = F.col("r.environment.executor")
    kind, digest = F.coalesce(executor["kind"], F.lit("")), F.coalesce(executor["sha256"], F.lit(""))
    took = instant(F.col("r.task.finished_at")).cast("double") - instant(F.col("r.task.started_at")).cast("double")
    placed = rows.join(runs, "run_id", "left").withColumn("root", F.concat(F.regexp_replace("run_directory", "/+$", ""), F.lit("/")))
    below = F.when(F.startswith("r.working_dir", F.col("root")) & (F.length("r.working_dir") > F.length("root")),
                   F.expr("substring(r.working_dir, length(root) + 1)"))
    tasks = task_table(
        placed, run_id=F.col("run_id"), task=F.col("task"), name=F.coalesce("r.task.name", "id"), process=F.coalesce("r.task.definition_id", "id"),
        container=F.when((kind != "") & (digest != ""), F.concat(kind, F.lit("@"), digest)).otherwise(kind),
        status=normalise_status(F.col("r.task.status")), engine_status=F.col("r.task.status"), script=F.try_element_at("r.code", F.lit(1))["path"],
        workdir=F.col("r.working_dir"), target=F.col("r.target.location_id"), workpath=below, labels=merged,
        metrics=F.when(took.isNotNull(), F.create_map(F.lit("duration_s"), took)))
    outputs = wrote.where(F.coalesce("a.path", F.lit("")) != "").select(
        "run_id", "task", basename(F.col("a.path")).alias("file"), F.col("a.size").alias("size"),
        F.when(F.coalesce("a.sha256", F.lit("")) != "", F.concat(F.lit("sha256:"), "a.sha256")).alias("digest"))
    return Lineage(tasks, edges, outputs, refused=refused)
