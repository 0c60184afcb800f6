"""Whether tables keep the contract everything downstream rests on, and what an ingest brought in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.digests import well_formed
from wakeline.operators.graph import EXTERNAL, NODE

# What every task and every edge must say.
TASK_FIELDS = ("name", "process", "container", "status", "script", "workdir")
EDGE_FIELDS = ("consumer", "producer", "filename", "target")


def _each(df: DataFrame, table: str, key, tests: dict, fields: tuple[str, ...] = ()) -> DataFrame:
    """(run_id, source, key, problem) for every test a row fails and every field it lacks, in one pass over the table."""
    failed = [F.when(F.coalesce(bad, F.lit(False)), F.lit(problem)) for problem, bad in tests.items()]
    failed += [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in fields]
    return df.select("run_id", F.lit(table).alias("source"), key.cast("string").alias("key"), F.explode(F.array_compact(F.array(*failed))).alias("problem"))


def contract_violations(tasks: DataFrame, edges: DataFrame, outputs: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """
    (run_id, source, key, problem): one row per broken rule, none when the
    tables conform. Extra columns are allowed. Each table is read once for the
    rules about single rows; only repeats and references shuffle.
    """
    task, file = F.col("task"), F.concat_ws("/", "task", "file")
    status = F.coalesce("status", F.lit(""))
    rooted = F.startswith("workpath", F.lit("/")) | F.col("workpath").rlike(r"(^|/)\.\.(/|$)")
    negative = F.exists(F.map_values("metrics"), lambda v: v.isNull() | (v < 0))
    bad_digest = F.col("digest").isNotNull() & ~well_formed(F.col("digest"))
    known = tasks.select("run_id", "task", F.lit(True).alias("known")).distinct()
    repeated = tasks.groupBy(NODE).agg(F.count("*").alias("n")).where("n > 1")
    ends = edges.select("run_id", "edge_ix", F.explode(F.array(
        F.struct(F.lit("consumer").alias("end"), F.col("consumer").alias("task")), F.struct(F.lit("producer").alias("end"), F.col("producer").alias("task")))).alias("_side")).select(
        "run_id", "edge_ix", "_side.end", "_side.task").where((F.col("end") == "consumer") | ~F.col("task").eqNullSafe(F.lit(EXTERNAL)))
    strangers = ends.join(known, NODE, "left").where("known IS NULL")
    stray = outputs.select(*NODE, "file").join(known, NODE, "left").where("known IS NULL")
    found = lambda df, table, key, problem: df.select("run_id", F.lit(table).alias("source"), key.cast("string").alias("key"), problem.alias("problem"))
    rows = [
        _each(tasks, "tasks", task, {"workpath:escapes": rooted, "status:case": status != F.upper(status), "metrics:value": negative,
                                     "labels:value": F.exists(F.map_values("labels"), lambda v: v.isNull())}, TASK_FIELDS),
        found(repeated, "tasks", task, F.lit("task:repeated")),
        _each(edges, "edges", F.col("edge_ix"), {"edge:self": F.col("consumer").eqNullSafe(F.col("producer")), "digest:form": bad_digest}, EDGE_FIELDS),
        found(strangers, "edges", F.col("edge_ix"), F.concat("end", F.lit(":unknown"))),
        found(stray, "outputs", file, F.lit("outputs:unknown")),
        _each(outputs, "outputs", F.when(F.col("file").isNull(), task).otherwise(file), {"outputs:unnamed": F.col("file").isNull(), "digest:form": bad_digest}),
    ]
    if published is not None:
        rows.append(_each(published, "published", F.col("path"), {"digest:form": bad_digest}))
    return reduce(DataFrame.unionByName, rows)


def extract_summary(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Per run: tasks, edges, resolved to a task, external, dangling, superseded, cached."""
    counted = tasks.groupBy("run_id").agg(F.count("*").alias("tasks"), F.count_if("superseded").alias("superseded"), F.count_if("cached").alias("cached"))
    known = tasks.select("run_id", F.col("task").alias("producer"), F.lit(True).alias("known")).distinct()
    outside = F.col("producer") == EXTERNAL
    seen = edges.select("run_id", "producer").groupBy("run_id", "producer").agg(F.count("*").alias("n")).join(known, ["run_id", "producer"], "left")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    links = seen.groupBy("run_id").agg(
        F.sum("n").alias("edges"), total(F.col("known")).alias("resolved"), total(outside).alias("external"),
        total(F.col("known").isNull() & ~F.coalesce(outside, F.lit(False))).alias("dangling"))
    return counted.join(links, "run_id", "left").na.fill(0)
