"""
An engine's lineage store: a tree of `.data.json` records, one folder per run
or task, file records nested under the folder that made them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.text import basename
from wakeline.session import cut
from wakeline.sources.common import EXTERNAL, Lineage, task_table

# The scheme of a record, the checksum modes over content, the
# first writer whose mode label holds, and the records' shapes.
SCHEME = "lid://"
CONTENT_MODES = ("deep", "sha256")
TRUSTED_FROM = (26, 9, 0)
CHECKSUM = "struct<value: string, algorithm: string, mode: string>"
RECORD = (f"version string, kind string, spec struct<sessionId: string, workflowRun: string, name: string, container: string, script: string, "
          f"metadata: struct<nextflow: struct<version: string>>, input: array<struct<type: string, value: variant>>, "
          f"path: string, size: bigint, checksum: {CHECKSUM}>")


def folder_id(full: Column) -> Column:
    """A store hash as the work folder spells it, whole, so that a fleet's ids stay apart."""
    return F.concat(F.substring(full, 1, 2), F.lit("/"), F.substr(full, F.lit(3)))


def parse_history(files: DataFrame) -> DataFrame:
    """(run, timestamp, name, session): one run per history file (path, value) of four tab-separated fields; dot files are not the engine's."""
    parts = F.split(F.trim(F.regexp_replace("value", r"[\r\n]+$", "")), "\t")
    rows = files.where(~basename(F.col("path")).startswith(".")).select(parts.alias("p")).where(F.size("p") == 4)
    return rows.select(F.regexp_replace(F.col("p")[3], "^" + SCHEME, "").alias("run"), F.col("p")[0].alias("timestamp"),
                       F.col("p")[1].alias("name"), F.col("p")[2].alias("session"))


def trusted_version(version: Column) -> Column:
    """Whether a content label from this writer can be believed: three numbers, at least the first fixed release."""
    head = F.substring_index(F.coalesce(version, F.lit("")), "-", 1)
    numbers = F.transform(F.split(head, r"\."), lambda p: p.cast("int"))
    return F.when(head.rlike(r"^\d{1,9}\.\d{1,9}\.\d{1,9}$"), numbers >= F.array(*map(F.lit, TRUSTED_FROM))).otherwise(F.lit(False))


def trusted_digest(mode: Column, value: Column, truthful: Column) -> Column:
    """The store's checksum as a digest, only where it hashes content and the label holds."""
    return F.when((F.coalesce(value, F.lit("")) != "") & mode.isin(*CONTENT_MODES) & truthful, F.concat(F.lit("nextflow-"), mode, F.lit(":"), value))


def mark_superseded(tasks: DataFrame, history: DataFrame, consumed: DataFrame) -> DataFrame:
    """
    (session, full) replaced by a same-named task of a later run in the resume
    chain, from tasks (session, full, name, run). Repeats within one run are
    shards; a name met in a run the history does not list cannot be placed;
    and a version still read (`consumed`, a column `full`) stays live. A run's
    place is its timestamp; ties go by its name, as the list is read.
    """
    placed = tasks.join(history.select("session", "run", F.struct("timestamp", "run").alias("place")), ["session", "run"], "left")
    names = placed.groupBy("session", "name").agg(F.max("place").alias("newest"), F.count_if(F.col("place").isNull()).alias("unplaced"))
    return (
        placed.join(names.where("unplaced = 0"), ["session", "name"]).where(F.col("place") < F.col("newest"))
        .select("session", "full").join(consumed.select("full").distinct(), "full", "left_anti"))


def ingest_lineage_store(files: DataFrame, history: DataFrame) -> Lineage:
    """The whole store (path, value), one run_id per session, from paths '<entry>/[<file>/].data.json'."""
    folder = F.regexp_replace("path", r"(^|/)\.data\.json$", "")
    records = files.where(F.endswith("path", F.lit(".data.json"))).select(
        F.substring_index(folder, "/", 1).alias("full"),
        F.when(F.contains(folder, F.lit("/")), F.regexp_replace(folder, "^[^/]*/", "")).otherwise("").alias("rel"),
        F.from_json("value", RECORD).alias("r")).select("full", "rel", "r.kind", "r.spec")
    # Written once: every table is made of them, some several times, and a text costs more to parse than its record to read.
    records, _ = cut(records, "store-records")
    runs = records.where("kind = 'WorkflowRun' AND rel = ''").select(
        F.col("full").alias("run"), trusted_version(F.col("spec.metadata.nextflow.version")).alias("truthful"))
    made = records.where("kind = 'TaskRun' AND rel = '' AND NOT contains(full, '#')").select(
        F.col("spec.sessionId").alias("session"), "full", F.regexp_replace("spec.workflowRun", "^" + SCHEME, "").alias("run"), "spec")
    made = made.join(runs, "run", "left").na.fill(False, ["truthful"])

    # A value is a list, or one bare path; val inputs are parameters and no artifacts.
    given = made.select("session", "full", "truthful", F.posexplode("spec.input").alias("slot", "i")).where("i.type = 'path'").select(
        "session", "full", "truthful", "slot",
        F.posexplode(F.coalesce(F.try_variant_get("i.value", "$", "array<variant>"), F.array("i.value"))).alias("place", "v"))
    text = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
    given = given.withColumn("lid", F.when(F.startswith(text, F.lit(SCHEME)), text)).withColumn(
        "outside", F.when(~F.startswith(F.schema_of_variant("v"), F.lit("ARRAY")), F.try_variant_get("v", "$.path", "string")))
    bare = F.expr(f"substring(lid, {len(SCHEME) + 1})")
    sum_of = lambda c: F.coalesce(F.try_variant_get("v", f"$.checksum.{c}", "string"), F.lit(""))
    inside = F.col("lid").isNotNull()
    links = given.where(inside | (F.coalesce("outside", F.lit("")) != "")).select(
        "session", "full", F.when(inside, F.substring_index(bare, "/", 1)).alias("made_by"),
        F.when(inside, F.when(F.contains(bare, F.lit("/")), F.regexp_replace(bare, "^[^/]*/", "")).otherwise("")).otherwise(
            basename(F.col("outside"))).alias("filename"),
        F.when(inside, F.col("lid")).when(sum_of("value") != "", F.concat_ws("#", "outside", sum_of("value"))).otherwise(F.col("outside")).alias("target"),
        F.when(~inside, trusted_digest(sum_of("mode"), sum_of("value"), F.col("truthful"))).alias("digest"),
        (F.col("slot").cast("bigint") * 2147483648 + F.col("place")).alias("edge_ix"))
    edges = links.select(
        F.col("session").alias("run_id"), "edge_ix", folder_id(F.col("full")).alias("consumer"),
        F.when(F.col("made_by").isNull(), EXTERNAL).otherwise(folder_id(F.col("made_by"))).alias("producer"), "filename", "target", "digest",
        F.lit(None).cast("map<string,string>").alias("labels"))

    written = records.where("kind = 'FileOutput' AND rel <> ''")
    sum_cols = [F.col("spec.checksum.mode").alias("mode"), F.col("spec.checksum.value").alias("sum")]
    by_task = written.join(made.select("session", "full", "truthful"), "full").select(
        "session", "full", F.col("rel").alias("file"), F.col("spec.size").alias("size"), "truthful", F.col("spec.path").alias("path"), *sum_cols)
    outputs = by_task.select(F.col("session").alias("run_id"), folder_id(F.col("full")).alias("task"), "file", "size",
                             trusted_digest(F.col("mode"), F.col("sum"), F.col("truthful")).alias("digest"))
    dirs = by_task.where(F.endswith("path", F.col("file"))).groupBy("session", "full").agg(F.max(
        F.regexp_replace(F.expr("substring(path, 1, length(path) - length(file))"), "/+$", "")).alias("workdir"))
    published = written.join(runs, F.col("full") == F.col("run")).join(history.select("run", "session"), "run").select(
        F.col("session").alias("run_id"), F.col("rel").alias("path"), F.col("spec.size").alias("size"),
        trusted_digest(F.col("spec.checksum.mode"), F.col("spec.checksum.value"), F.col("truthful")).alias("digest"))

    stale = mark_superseded(made.select("session", "full", F.coalesce("spec.name", F.lit("")).alias("name"), "run"), history,
                            links.where("made_by IS NOT NULL").select("session", F.col("made_by").alias("full")))
    rows = made.join(dirs, ["session", "full"], "left").join(stale.withColumn("stale", F.lit(True)), ["session", "full"], "left")
    name = F.coalesce("spec.name", F.lit(""))
    tasks = task_table(
        rows, run_id=F.col("session"), task=folder_id(F.col("full")), name=name, process=F.regexp_replace(name, r" \((?!.* \().*$", ""),
        container=F.col("spec.container"), script=F.col("spec.script"), workdir=F.col("workdir"), workpath=folder_id(F.col("full")),
        superseded=F.col("stale"))
    return Lineage(tasks, edges, outputs, published=published)
