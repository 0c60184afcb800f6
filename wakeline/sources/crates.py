"""Run crates: JSON-LD entities, with one action per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.text import basename
from wakeline.sources.common import EXTERNAL, Lineage, readable, task_table
from wakeline.sources.lineage_store import folder_id

# How a crate names tasks, files and parameters.
TASK_PREFIX, FILE_SCHEME, PARAMETER = "#task/", "file://", "#param"


def _ids(column: str):
    """The @id of each reference, which a crate writes as an object or as a bare string."""
    refs = F.coalesce(F.try_variant_get("e", f"$.{column}", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(refs, lambda v: F.coalesce(F.try_variant_get(v, '$["@id"]', "string"), F.try_variant_get(v, "$", "string")))


def ingest_rocrate(documents: DataFrame) -> Lineage:
    """Tables out of crates (run_id, value). An id nobody recognises is an outside input, never dropped."""
    documents, refused = readable(documents, "run_id")
    entities = documents.select("run_id", F.explode(F.try_variant_get(F.try_parse_json("value"), '$["@graph"]', "array<variant>")).alias("e"))
    text = lambda path: F.try_variant_get("e", path, "string")
    kinds = F.coalesce(F.try_variant_get("e", '$["@type"]', "array<string>"), F.array(text('$["@type"]')))
    actions = entities.where(F.array_contains(kinds, "CreateAction") & F.startswith(text('$["@id"]'), F.lit(TASK_PREFIX)))
    task = folder_id(F.substring_index(F.expr(f"substring(try_variant_get(e, '$[\"@id\"]', 'string'), {len(TASK_PREFIX) + 1})"), "/", 1))
    actions = actions.select("run_id", task.alias("task"), F.coalesce(text("$.name"), F.lit("")).alias("name"),
                             text('$.instrument["@id"]').alias("tool"), _ids("object").alias("read"), _ids("result").alias("made"))
    tools = entities.select("run_id", text('$["@id"]').alias("tool"), F.coalesce(
        F.when(text("$.containerImage") != "", text("$.containerImage")), text("$.name")).alias("container"))
    # Entities of all documents come out of texts that look small to the planner, so both sides are sorted and none is sent to every task.
    tasks = task_table(
        actions.join(tools.hint("merge"), ["run_id", "tool"], "left"), run_id=F.col("run_id"), task=F.col("task"), name=F.col("name"),
        process=F.regexp_replace("name", r" \((?!.* \().*$", ""), container=F.col("container"))

    def cut(id_column):
        rest = F.expr(f"substring({id_column}, {len(TASK_PREFIX) + 1})")
        return F.substring_index(rest, "/", 1), F.when(F.contains(rest, F.lit("/")), F.regexp_replace(rest, "^[^/]*/", "")).otherwise("")

    maker, name = cut("id")
    inside = F.startswith("id", F.lit(TASK_PREFIX))
    path = F.regexp_replace("id", "^" + FILE_SCHEME, "")
    edges = actions.select("run_id", "task", F.posexplode("read").alias("ix", "id")).where(
        inside | ((F.col("id") != "") & ~F.startswith("id", F.lit(PARAMETER)))).select(
        "run_id", F.col("ix").cast("bigint").alias("edge_ix"), F.col("task").alias("consumer"),
        F.when(inside, folder_id(maker)).otherwise(EXTERNAL).alias("producer"),
        F.when(inside, name).otherwise(basename(F.substring_index(path, "?", 1))).alias("filename"), F.when(inside, F.col("id")).otherwise(path).alias("target"))
    outputs = actions.select("run_id", "task", F.explode("made").alias("id")).where(inside & (name != "")).select("run_id", "task", name.alias("file"))
    return Lineage(tasks, edges, outputs, refused=refused)
