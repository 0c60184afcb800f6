"""Graph documents in the common schema, released facts, and what is written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.sources.common import Lineage, read_tree, readable, task_table

# The shape of a graph document.
TASK = ("hash string, name string, process string, container string, status string, engine_status string, script string, workdir string, "
        "workpath string, target string, superseded boolean, cached boolean, unexpanded_subworkflow string, "
        "labels map<string,string>, metrics map<string,double>")
EDGE = "consumer string, producer string, filename string, target string, digest string, labels map<string,string>"
GRAPH = (f"tasks map<string, struct<{TASK.replace(' string', ': string').replace(' boolean', ': boolean').replace(' map', ': map')}>>, "
         f"edges array<struct<{EDGE.replace(' string', ': string').replace(' map', ': map')}>>, outputs map<string, array<string>>, "
         "output_details map<string, array<struct<file: string, size: bigint, digest: string>>>, "
         "published map<string, struct<size: bigint, digest: string>>, coverage array<string>")


def graphs_in(spark: SparkSession, root: str, pattern: str = "*.json", around: str = r"^.*/|\.json$") -> DataFrame:
    """(run_id, value): every graph document of a folder, named by its path without what `around` matches."""
    return read_tree(spark, root, pattern).select(F.regexp_replace("path", around, "").alias("run_id"), "value")


def read_graphs(documents: DataFrame) -> Lineage:
    """Tables out of graph documents (run_id, value)."""
    documents, refused = readable(documents, "run_id")
    graphs = documents.select("run_id", F.from_json("value", GRAPH).alias("g"))
    t = graphs.select("run_id", F.explode("g.tasks").alias("task", "t"))
    held = lambda c: F.col(f"t.{c}")
    names = ("name", "process", "container", "status", "engine_status", "script", "workdir", "target", "workpath", "labels", "metrics",
             "superseded", "cached")
    tasks = task_table(t, run_id=F.col("run_id"), task=F.col("task"), unexpanded_subworkflow=held("unexpanded_subworkflow").isNotNull(),
                       **{c: held(c) for c in names})
    edges = graphs.select("run_id", F.posexplode("g.edges").alias("edge_ix", "e")).select(
        "run_id", F.col("edge_ix").cast("bigint").alias("edge_ix"), "e.*")
    listed = graphs.select("run_id", F.explode("g.outputs").alias("task", "files")).select(
        "run_id", "task", F.posexplode("files").alias("file_ix", "file"))
    details = graphs.select("run_id", F.explode("g.output_details").alias("task", "d")).select("run_id", "task", F.explode("d").alias("d")).select(
        "run_id", "task", "d.*")
    outputs = listed.join(details, ["run_id", "task", "file"], "left")
    published = graphs.select("run_id", F.explode("g.published").alias("path", "p")).select("run_id", "path", "p.*")
    coverage = graphs.select("run_id", F.posexplode("g.coverage").alias("note_ix", "note"))
    return Lineage(tasks, edges, outputs, coverage, published, refused)


def read_assertions(documents: DataFrame) -> DataFrame:
    """
    (run_id, task, what, asserted_by, date): released facts of (run_id, value);
    the last record of a task counts. What cannot be read is in
    `refused_assertions`; nothing may be proposed for removal while that has rows.
    """
    rows = readable(documents)[0].select("run_id", F.from_json(
        "value", "released array<struct<task: string, what: string, asserted_by: string, date: string, reference: string>>").alias("a"))
    return rows.select("run_id", F.posexplode("a.released").alias("ix", "r")).groupBy("run_id", "r.task").agg(
        F.max_by("r", "ix").alias("r")).select("run_id", "task", "r.what", "r.asserted_by", "r.date")


def refused_assertions(documents: DataFrame) -> DataFrame:
    """(run_id, path, problem): documents of released facts that cannot be read."""
    return readable(documents, "run_id")[1]


def write_plan(plan: DataFrame, path: str, *by: str) -> None:
    """A plan as files, one folder per value of `by`; rows in a fixed order and without a clock."""
    order = [c for c in ("trigger_id", "run_id", "task") if c in plan.columns and c not in by]
    plan.repartition(*by, "task").sortWithinPartitions(*by, *order).write.partitionBy(*by).json(path) if by else \
        plan.sortWithinPartitions(*order).write.json(path)


def write_receipt(approved: DataFrame, path: str, removal: str) -> None:
    """One line per approved removal, in a folder named after the removal: written again, it replaces itself. Refused rows are not proposed."""
    approved.where("refused IS NULL").drop("refused").sortWithinPartitions("run_id", "task").write.mode("overwrite").json(f"{path}/removal={removal}")
