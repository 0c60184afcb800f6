"""Engine events as lines of JSON, and edges from an inventory of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.triggers import normalise_status
from wakeline.sources.common import EXTERNAL, task_table

TRACE = ("trace struct<hash: string, task_id: string, name: string, process: string, container: string, status: string, "
         "workdir: string, script: string>")


def parse_events(lines: DataFrame, *keep: str) -> DataFrame:
    """Trace events out of JSON lines in `value`; malformed lines and lines about no task are skipped."""
    return lines.select(*keep, F.from_json("value", TRACE)["trace"].alias("t")).where(F.coalesce("t.hash", F.lit("")) != "")


def ingest_weblog(lines: DataFrame) -> DataFrame:
    """The task table from (run_id, line_no, value): the latest event about a task says the most."""
    latest = parse_events(lines, "run_id", "line_no").groupBy("run_id", F.col("t.hash").alias("task")).agg(F.max_by("t", "line_no").alias("t"))
    held = lambda c: F.col(f"t.{c}")
    return task_table(latest, run_id=F.col("run_id"), task=F.col("task"), status=normalise_status(held("status")), engine_status=held("status"),
                      **{c: held(c) for c in ("name", "process", "container", "workdir", "script")})


def edges_from_link_inventory(links: DataFrame, roots: DataFrame, tasks: DataFrame) -> DataFrame:
    """
    Edges from links (run_id, task, path, link_target, edge_ix) under each
    run's work root (run_id, root): the task of `tasks` (run_id, task, workdir)
    whose folder holds the target; a folder of no known task names itself.
    Staged and engine-made files and anything outside the root are EXTERNAL, a
    path too short to name a task is NULL, and a task's own links are dropped.
    """
    placed = links.join(roots, "run_id")
    under = F.startswith("link_target", F.concat("root", F.lit("/")))
    parts = F.split(F.expr("substring(link_target, length(root) + 2)"), "/")
    staged = (parts[0] == "tmp") | F.exists(parts, lambda p: p.startswith("stage-"))
    folder = F.concat_ws("/", parts[0], F.try_element_at(parts, F.lit(2)))
    placed = placed.withColumn("folder", F.when(under & ~staged & (F.size(parts) >= 2), folder)).withColumn(
        "outside", ~under | staged).withColumn("workdir", F.concat_ws("/", "root", "folder"))
    homes = tasks.where(F.coalesce("workdir", F.lit("")) != "").groupBy("run_id", F.regexp_replace("workdir", "/+$", "").alias("workdir")).agg(F.min("task").alias("home"))
    placed = placed.join(homes, ["run_id", "workdir"], "left")
    producer = F.when(F.col("outside"), EXTERNAL).when(F.col("folder").isNotNull(), F.coalesce("home", "folder"))
    edges = placed.select("run_id", "edge_ix", F.col("task").alias("consumer"), producer.alias("producer"),
                          F.col("path").alias("filename"), F.col("link_target").alias("target"))
    return edges.where(~F.col("producer").eqNullSafe(F.col("consumer")))


def missing_directories(tasks: DataFrame, links_seen: DataFrame) -> DataFrame:
    """(run_id, task): tasks whose folder the inventory never saw, so their inputs are unknown and not none."""
    return tasks.select("run_id", "task").join(links_seen.select("run_id", "task").distinct(), ["run_id", "task"], "left_anti")
