"""Hosted platforms: job and file descriptions, and execution graphs with literal maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.instants import instant
from wakeline.functions.text import basename
from wakeline.operators.triggers import normalise_status
from wakeline.session import grown
from wakeline.sources.calls import path_edges
from wakeline.sources.common import EXTERNAL, Lineage, readable, string_leaves, task_table

# How a description links to a file or to another job's output.
LINK = "$dnanexus_link"
VIEWS = ("input", "runInput", "originalInput")
JOB = ("id string, name string, executableName string, applet string, app string, executable string, state string, stage string, "
       "startedRunning double, stoppedRunning double, totalPrice double")
FILE = "id string, name string, createdBy struct<job: string>"


def file_links(strings: DataFrame) -> DataFrame:
    """The strings that name a file: a link itself, or the id inside one."""
    whole = F.col("key") == LINK
    inner = (F.col("key") == "id") & F.endswith("at", F.lit("/" + LINK))
    return strings.where((whole | inner) & F.startswith("value", F.lit("file-")))


def job_references(strings: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, ref, field) for links to another job's or stage's output instead of to a file."""
    links = strings.where(F.endswith("at", F.lit("/" + LINK)))
    part = lambda name: F.min(F.when(F.col("key") == name, F.col("value")))
    rows = links.groupBy(*keys, "at").agg(*[part(n).alias(n) for n in ("job", "stage", "field", "outputField", "inputField")])
    rows = rows.where("job IS NOT NULL OR stage IS NOT NULL")
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.select(
        *keys, F.when(F.col("job").isNotNull(), "job").otherwise("stage").alias("kind"), F.coalesce("job", "stage").alias("ref"),
        F.coalesce(F.when(F.col("job").isNotNull(), F.coalesce(blank("field"), F.lit(""))), blank("outputField"), blank("inputField"), F.lit("")).alias("field"))


def ingest_job_describes(jobs: DataFrame, files: DataFrame) -> Lineage:
    """
    Tables out of job descriptions (run_id, value) and file descriptions. A
    reference to a job or stage of this analysis is an edge to it; one that
    names nothing here goes to coverage, since what fed that input is unknown.
    """
    jobs, refused = readable(jobs)
    files, refused_files = readable(files)
    rows = jobs.select("run_id", F.from_json("value", JOB).alias("j"), *[F.get_json_object("value", f"$.{c}").alias(c) for c in (*VIEWS, "output")]).select(
        "run_id", F.col("j.id").alias("task"), "j", *VIEWS, "output")
    known = files.select("run_id", F.from_json("value", FILE).alias("f")).select(
        "run_id", F.col("f.id").alias("value"), F.when(F.col("f.name") != "", F.col("f.name")).alias("name"), F.col("f.createdBy.job").alias("by"))
    word = lambda *cs: F.coalesce(*[F.when(F.col(f"j.{c}") != "", F.col(f"j.{c}")) for c in cs], F.lit(""))
    ident = word("applet", "app", "executable")
    took = (F.col("j.stoppedRunning") - F.col("j.startedRunning")) / 1000
    metrics = F.map_filter(F.create_map(F.lit("price"), F.col("j.totalPrice"), F.lit("duration_s"), took), lambda _, v: v.isNotNull())
    tasks = task_table(
        rows, run_id=F.col("run_id"), task=F.col("task"), name=word("name", "executableName", "id"), process=word("executableName", "name", "id"),
        container=F.when(ident != "", F.concat(word("executableName", "name"), F.lit("@"), ident)).otherwise(word("executableName", "name")),
        status=normalise_status(F.col("j.state")), engine_status=F.col("j.state"), metrics=F.when(F.size(metrics) > 0, metrics))

    views = rows.select("run_id", "task", F.explode(F.array(*[F.struct(F.lit(i).alias("view"), F.col(c).alias("document")) for i, c in enumerate(VIEWS)])).alias("v")).select(
        "run_id", "task", "v.*").where("document IS NOT NULL AND document NOT IN ('', '{}', 'null', '[]')")
    strings = string_leaves(views, "document", "run_id", "task", "view")
    here = rows.select("run_id", F.col("task").alias("by"), F.lit(True).alias("here"))
    read = file_links(strings).groupBy("run_id", "task", "value").agg(F.min(F.struct("view", "ix")).alias("first"))
    from_files = read.join(grown(known), ["run_id", "value"], "left").join(grown(here), ["run_id", "by"], "left").select(
        "run_id", (F.col("first.view").cast("bigint") * 1000000000 + F.col("first.ix")).alias("edge_ix"), F.col("task").alias("consumer"),
        F.when(F.col("here") & (F.col("by") != F.col("task")), F.col("by")).otherwise(EXTERNAL).alias("producer"),
        F.coalesce("name", "value").alias("filename"), F.col("value").alias("target"))

    # The view that left the fewest references open is the one whose leftovers count.
    # Views without any are counted beside the references, so documents are walked once and what they hold is moved to its task once.
    none = [F.lit(None).cast("string").alias(c) for c in ("kind", "ref", "field")]
    refs = job_references(strings, "run_id", "task", "view").unionByName(views.select("run_id", "task", "view", *none))
    refs = refs.where("run_id IS NOT NULL AND task IS NOT NULL").repartition("run_id", "task")
    refs = refs.withColumn("n", F.count("kind").over(Window.partitionBy("run_id", "task", "view")))
    refs = refs.withColumn("best", F.min(F.struct("n", "view")).over(Window.partitionBy("run_id", "task")))
    refs = refs.where("kind IS NOT NULL AND view = best.view").select("run_id", "task", "kind", "ref", "field").distinct()
    stages = rows.where(F.col("j.stage") != "").groupBy("run_id", F.col("j.stage").alias("ref")).agg(F.max("task").alias("staged"))
    placed = refs.join(grown(stages.withColumn("kind", F.lit("stage"))), ["run_id", "kind", "ref"], "left").withColumn(
        "by", F.when(F.col("kind") == "job", F.col("ref")).otherwise(F.col("staged"))).join(grown(here), ["run_id", "by"], "left")
    good = F.coalesce(F.col("here") & (F.col("by") != F.col("task")), F.lit(False))
    from_refs = placed.where(good).select(
        "run_id", (F.row_number().over(Window.partitionBy("run_id", "task").orderBy("kind", "ref", "field")) + F.lit(3000000000)).alias("edge_ix"), F.col("task").alias("consumer"), F.col("by").alias("producer"),
        F.when(F.col("field") != "", F.col("field")).otherwise(F.col("ref")).alias("filename"),
        F.when(F.col("field") != "", F.concat_ws(":", "ref", "field")).otherwise(F.col("ref")).alias("target"))
    coverage = placed.where(~good).groupBy("run_id", "task").agg(F.count("*").alias("references")).withColumn(
        "note", F.lit("references name no job in this analysis"))
    outputs = file_links(string_leaves(rows, "output", "run_id", "task")).select("run_id", "task", "value").distinct().join(
        grown(known), ["run_id", "value"], "left").select("run_id", "task", F.coalesce("name", "value").alias("file"))
    return Lineage(tasks, from_files.unionByName(from_refs), outputs, coverage, refused=refused.unionByName(refused_files))


NODE = ("id string, status string, cost double, price double, startTime string, resolutionTime string, "
        "workflowGraphNode struct<nodeName: string, displayName: string, taskInfo: struct<displayName: string>>")
WORKFLOW = "name string, version string, commitHash string, dockerHash string"


def ingest_execution_graph(nodes: DataFrame, workflows: DataFrame, literals: DataFrame, scheme: str = "latch://") -> Lineage:
    """
    Tables out of execution nodes (run_id, value), workflows (run_id, value)
    and literal maps (run_id, task, side, value) with side inputs or outputs.
    """
    nodes, refused = readable(nodes)
    workflows, refused_workflows = readable(workflows)
    literals, refused_literals = readable(literals, "task")
    refused = refused.unionByName(refused_workflows).unionByName(refused_literals)
    shown = workflows.select("run_id", F.from_json("value", WORKFLOW).alias("w"))
    rows = nodes.select("run_id", F.from_json("value", NODE).alias("n")).join(shown, "run_id", "left")
    word = lambda *cs: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in cs])
    name = word("n.workflowGraphNode.displayName", "n.workflowGraphNode.nodeName", "n.id")
    image = F.coalesce("w.name", F.lit(""))
    took = instant(F.col("n.resolutionTime")).cast("double") - instant(F.col("n.startTime")).cast("double")
    metrics = F.map_filter(F.create_map(F.lit("price"), F.coalesce("n.cost", "n.price"), F.lit("duration_s"), took), lambda _, v: v.isNotNull())
    tasks = task_table(
        rows, run_id=F.col("run_id"), task=F.col("n.id"), name=name, process=F.coalesce(word("n.workflowGraphNode.taskInfo.displayName"), name),
        container=F.when(F.coalesce("w.dockerHash", F.lit("")) != "", F.concat(image, F.lit("@"), "w.dockerHash")).otherwise(image),
        status=normalise_status(F.col("n.status")), engine_status=F.col("n.status"), script=F.col("w.commitHash"), metrics=F.when(F.size(metrics) > 0, metrics))
    paths = string_leaves(literals, "value", "run_id", "task", "side").where(F.startswith("value", F.lit(scheme))).groupBy(
        "run_id", "task", "side", F.col("value").alias("path")).agg(F.min("ix").alias("edge_ix"))
    made = paths.where("side = 'outputs'").select("run_id", "task", "path")
    return Lineage(tasks, path_edges(paths.where("side = 'inputs'").drop("side"), made), made.select("run_id", "task", basename(F.col("path")).alias("file")),
                   refused=refused)
