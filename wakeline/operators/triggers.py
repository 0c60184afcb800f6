"""
Where something bad enters a graph: a batch of `kind:value` triggers resolved
to entry tasks.

A trigger table is (trigger_id, kind, value, mode). Each matcher takes needles
(trigger_id, needle) and answers (trigger_id, run_id, task, ...). All of them
are equi-joins on something exploded from the record, so a large batch of
triggers never meets every task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.text import basename, dotted_prefixes, image_parts, version_agrees
from wakeline.operators.classes import Factored, factored
from wakeline.operators.graph import EXTERNAL, NODE
from wakeline.session import cut, grown

TRACE, REMOVE = "trace", "remove"
EXACT, COMPANION, NAME_ONLY = "exact", "companion", "name-only"

# The engine's own kinds, the words of each status, the tag at
# the end of a display name, and the separators of ids in tags and paths.
ENGINE_KINDS = ("container", "script", "process", "input")
STATUS_WORDS = {
    "COMPLETED": ("COMPLETED", "DONE", "SUCCEEDED", "SUCCESS", "FINISHED"),
    "FAILED": ("FAILED", "FAILURE", "ABORTED", "TERMINATED", "INCOMPLETE", "TIMED_OUT", "RETRYABLEFAILURE", "ERROR"),
    "CACHED": ("CACHED", "SKIPPED"),
}
TRAILING_TAG = r"\(([^()]+)\)\s*$"
TAG_SEPARATORS = "[-_.]"
PATH_SEPARATORS = "[-_./]"


def normalise_status(word):
    """The engine's word in the closed vocabulary; a word nobody listed is UNKNOWN, never FAILED."""
    said = F.upper(F.trim(F.coalesce(word, F.lit(""))))
    status = F.when(said == "", "")
    for state, words in STATUS_WORDS.items():
        status = status.when(said.isin(*words), state)
    return status.otherwise("UNKNOWN")


def parse_specs(specs: DataFrame) -> DataFrame:
    """`spec` cut at its first colon; the value is NULL for a bare kind, which asks about every value."""
    colon = F.instr("spec", ":")
    kind = F.when(colon > 0, F.substring_index("spec", ":", 1)).otherwise(F.col("spec"))
    value = F.when(colon > 0, F.expr("substring(spec, instr(spec, ':') + 1)"))
    return specs.withColumn("kind", kind).withColumn("value", F.when(value != "", value))


def match_container(tasks: DataFrame, needles: DataFrame) -> DataFrame:
    """
    Tasks whose image names the tool: (trigger_id, run_id, task, how). `how`
    is name-only where the needle carries a version the image cannot confirm.
    Each distinct image is parsed once.
    """
    wanted = needles.select("trigger_id", image_parts(F.col("needle")).alias("p")).select(
        "trigger_id", F.col("p.name").alias("part"), F.col("p.version").alias("wanted")).where("part <> ''")
    images = tasks.select("container").where("container <> ''").distinct()
    parts = images.select("container", image_parts(F.col("container")).alias("p")).select(
        "container", F.col("p.version").alias("have"), F.explode("p.components").alias("part"))
    unversioned = F.coalesce(F.col("wanted"), F.lit("")) == ""
    how = (F.when(unversioned, EXACT).when(F.col("have").isNull(), NAME_ONLY)
           .when(version_agrees(F.col("wanted"), F.col("have")), EXACT))
    hits = parts.join(wanted, "part").select("trigger_id", "container", how.alias("how")).where("how IS NOT NULL")
    return tasks.select(*NODE, "container").join(hits, "container").select("trigger_id", *NODE, "how")


def _pieces(text, sizes):
    """The distinct pieces of a text that have one of `sizes` letters."""
    of_size = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(0)), F.lit(1)), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.when(F.length(text) >= n, of_size(n)).otherwise(F.array().cast("array<string>")))))


def match_field(tasks: DataFrame, needles: DataFrame, field: str) -> DataFrame:
    """
    Tasks whose field contains the needle, case and all: (trigger_id, run_id, task).

    An index lists, under a number for each distinct text, the letter pieces of
    it that any needle has too. A needle asks by the one of its pieces that
    fewest texts hold; only the texts that this leaves are fetched, and the
    whole needle is tested on them. Needles of one or two letters are a piece.
    """
    wanted = needles.where("needle <> ''")
    lead = F.least(F.length("needle"), F.lit(3))
    asked, _ = cut(wanted.select("trigger_id", "needle", F.explode(_pieces(F.col("needle"), F.array(lead))).alias("piece")), "needle-pieces")
    texts = tasks.select(F.col(field).alias("text")).where("text <> ''").distinct().withColumn("number", F.xxhash64("text"))
    all_sizes = F.array(*(F.lit(n) for n in (1, 2, 3)))
    held, _ = cut(texts.select("number", F.explode(_pieces(F.col("text"), all_sizes)).alias("piece")).join(
        asked.select("piece").distinct(), "piece", "left_semi"), "text-pieces")
    counts = held.groupBy("piece").agg(F.count("*").alias("texts"))
    # A needle with a piece that no text holds stands nowhere.
    rarest = asked.join(counts, "piece", "left").groupBy("trigger_id", "needle").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "piece")).alias("r")).where("r.texts > 0").select("trigger_id", "needle", "r.piece")
    maybe = held.join(rarest, "piece").select("number", "trigger_id", "needle")
    hits = texts.join(maybe, "number").where(F.contains("text", "needle")).select("trigger_id", "text").distinct()
    return tasks.select(*NODE, F.col(field).alias("text")).join(hits, "text").select("trigger_id", *NODE)


def match_external_input(edges: DataFrame, needles: DataFrame) -> DataFrame:
    """
    Consumers of an outside file with that name, or of a companion named
    `<file>.<ext>`: (trigger_id, run_id, task, name, companion).
    """
    read = edges.where(F.col("producer") == EXTERNAL).select(
        "run_id", F.col("consumer").alias("task"), basename(F.col("filename")).alias("name")).distinct()
    names = read.select("name").distinct().select("name", F.explode(dotted_prefixes(F.col("name"))).alias("needle"))
    hits = names.join(needles, "needle").select("trigger_id", "name", (F.col("name") != F.col("needle")).alias("companion"))
    return read.join(hits, "name").select("trigger_id", *NODE, "name", "companion")


def match_label(tasks: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tasks carrying labels[key] = value, for wanted (trigger_id, key, value)."""
    return _labelled(tasks, edges, wanted).distinct()


def _labelled(tasks: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same, a task as often as a label of it or of its edges says so."""
    asked = wanted.select("trigger_id", "key", "value")
    own = tasks.select(*NODE, F.explode("labels")).join(asked, ["key", "value"])
    touched = edges.select("run_id", "consumer", "producer", F.explode("labels")).join(asked, ["key", "value"]).select(
        "trigger_id", "run_id", F.explode(F.array("consumer", "producer")).alias("task")).where(F.col("task").isNotNull() & (F.col("task") != EXTERNAL))
    return own.select("trigger_id", *NODE).unionByName(touched)


def with_tag(tasks: DataFrame) -> DataFrame:
    """(run_id, task, tag): the trailing parenthetical of the display name, where there is one."""
    return tasks.select(*NODE, F.trim(F.regexp_extract("name", TRAILING_TAG, 1)).alias("tag")).where("tag <> ''")


def entries_by_tag(tasks: DataFrame, labels: DataFrame) -> DataFrame:
    """
    (owner, run_id, task) for labels (label, owner): the tag is the label, or
    starts with it and a separator; the longest such label decides.
    """
    tagged = with_tag(tasks)
    cuts = F.filter(F.sequence(F.lit(1), F.length("tag")),
                    lambda i: F.substring(F.col("tag"), i, F.lit(1)).rlike(TAG_SEPARATORS))
    prefixes = F.concat(F.array("tag"), F.transform(cuts, lambda i: F.substring(F.col("tag"), F.lit(1), i - 1)))
    owners = (
        tagged.select("tag").distinct().select("tag", F.explode(F.array_distinct(prefixes)).alias("label"))
        .join(grown(labels), "label").groupBy("tag").agg(F.max_by("owner", F.length("label")).alias("owner"))
    )
    return tagged.join(grown(owners), "tag").select("owner", *NODE)


def entries_by_path_mention(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """
    (id, run_id, task) for every id that stands in the tag between separators
    or its ends. A tag offers runs of as many parts as any id has, so it is
    read once for each such number.
    """
    tagged = with_tag(tasks)
    parts = lambda c: F.size(F.split(c, PATH_SEPARATORS))
    # One row: the numbers of parts that occur among the ids.
    sizes = ids.select(parts(F.col("id")).alias("n")).distinct().agg(F.collect_set("n").alias("sizes"))
    places = F.sequence(F.lit(1), F.length("tag"))
    cuts = F.filter(places, lambda i: F.substring(F.col("tag"), i, F.lit(1)).rlike(PATH_SEPARATORS))
    tags = tagged.select("tag").distinct().select("tag", cuts.alias("cuts")).select(
        "tag", F.concat(F.array(F.lit(1)), F.transform("cuts", lambda i: i + 1)).alias("starts"),
        F.concat("cuts", F.array(F.length("tag") + 1)).alias("ends"))
    run = lambda n, k: F.substring(F.col("tag"), F.get("starts", k), F.get("ends", k + n - 1) - F.get("starts", k))
    runs = F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.size("starts")), lambda n: F.transform(
        F.sequence(F.lit(0), F.size("starts") - n), lambda k: run(n, k))))
    hits = tags.crossJoin(F.broadcast(sizes)).select("tag", F.explode(F.array_distinct(runs)).alias("id")).join(ids, "id")
    return tagged.join(hits, "tag").select("id", *NODE)


def library_classes(edges: DataFrame, library: DataFrame) -> Factored:
    """Tasks that read a library file and the ids in it, per file and unexpanded: (filename, lefts, rights, pairs)."""
    read = edges.where(F.col("producer") == EXTERNAL).select(
        "filename", "run_id", F.col("consumer").alias("task")).distinct()
    return factored(read, library.select("filename", "id").distinct(), ["filename"])


def entries_by_library(edges: DataFrame, library: DataFrame) -> DataFrame:
    """(id, run_id, task): every id of a library file (filename, id) enters where the file was read."""
    return library_classes(edges, library).pairs().select("id", *NODE)


def resolve_triggers(triggers: DataFrame, tasks: DataFrame, edges: DataFrame,
                     declared: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None) -> DataFrame:
    """
    (trigger_id, run_id, task, how) for a batch of triggers. `declared` maps a
    pipeline's own kinds to functions (tasks, edges) -> (value, run_id, task);
    they come before the engine's kinds, and any other kind is a label key.
    """
    declared = declared or {}
    # Written once: every kind reads the batch, and its size tells Spark how to join.
    triggers, _ = cut(triggers.select("trigger_id", "kind", "value"), "triggers")
    found = []
    for kind, entries in declared.items():
        own = triggers.where(F.col("kind") == kind).select("trigger_id", "value")
        found.append(entries(tasks, edges).join(own, "value").select("trigger_id", *NODE, F.lit(EXACT).alias("how")))
    engine = [k for k in ENGINE_KINDS if k not in declared]
    for kind in engine:
        needles = triggers.where(F.col("kind") == kind).select("trigger_id", F.col("value").alias("needle"))
        if kind == "container":
            hits = match_container(tasks, needles)
        elif kind == "input":
            hits = match_external_input(edges, needles).select(
                "trigger_id", *NODE, F.when(F.col("companion"), COMPANION).otherwise(EXACT).alias("how"))
        else:
            hits = match_field(tasks, needles, kind).select("trigger_id", *NODE, F.lit(EXACT).alias("how"))
        found.append(hits)
    rest = triggers.where(~F.col("kind").isin(*declared, *engine)).select(
        "trigger_id", F.col("kind").alias("key"), "value")
    entries = _labelled(tasks, edges, rest).select("trigger_id", *NODE, F.lit(EXACT).alias("how"))
    for more in found:
        entries = entries.unionByName(more)
    # A task can be reached through a file and its companion; an exact match says more. Numbers are summed up in place, texts would be sorted.
    said = F.when(F.col("how") == EXACT, 0).when(F.col("how") == COMPANION, 1).otherwise(2)
    best = entries.groupBy("trigger_id", *NODE).agg(F.min(said).alias("said"))
    return best.select("trigger_id", *NODE, F.when(F.col("said") == 0, EXACT).when(F.col("said") == 1, COMPANION).otherwise(NAME_ONLY).alias("how"))


def label_keys(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Every label key any task or edge carries."""
    return tasks.select(F.explode(F.map_keys("labels")).alias("key")).unionByName(
        edges.select(F.explode(F.map_keys("labels")).alias("key"))).distinct()


def check_triggers(triggers: DataFrame, keys: DataFrame, declared=(), removable=()) -> DataFrame:
    """
    The batch with `problem`: what keeps a trigger from being asked, its kind,
    its mode or its value, and NULL where nothing does. One row's problem
    leaves the rest of the batch as it is.
    """
    known = F.col("kind").isin(*declared, *ENGINE_KINDS) | F.col("known_key")
    problem = (
        F.when(F.coalesce(F.col("kind"), F.lit("")) == "", "no kind")
        .when(F.coalesce(F.col("value"), F.lit("")) == "", "no value")
        .when(~F.coalesce(known, F.lit(False)), "unknown kind")
        .when(~F.col("mode").isin(TRACE, REMOVE), "unknown mode")
        .when((F.col("mode") == REMOVE) & ~F.col("kind").isin(*removable, ""), "kind can only be traced")
    )
    return triggers.join(keys.select(F.col("key").alias("kind"), F.lit(True).alias("known_key")), "kind", "left").select(
        "trigger_id", "kind", "value", "mode", problem.alias("problem"))


def trigger_guards(checked: DataFrame, entries: DataFrame) -> DataFrame:
    """
    One row per trigger with its number of entry tasks and `state`: ASKED,
    REFUSED with the problem, or UNATTRIBUTED where nothing carries it, which
    is a failed attribution and not a clean result.
    """
    counts = entries.groupBy("trigger_id").agg(F.count("*").alias("entries"))
    state = (F.when(F.col("problem").isNotNull(), "REFUSED")
             .when(F.col("entries") == 0, "UNATTRIBUTED").otherwise("ASKED"))
    return checked.join(counts, "trigger_id", "left").na.fill(0, ["entries"]).withColumn("state", state)


def name_only_notes(entries: DataFrame, tasks: DataFrame) -> DataFrame:
    """Entry tasks included on the image's name alone, since it carries no version."""
    return entries.where(F.col("how") == NAME_ONLY).join(tasks.select(*NODE, "container"), NODE).select(
        "trigger_id", *NODE, F.substring_index("container", "/", -1).alias("image"))


def companion_notes(matches: DataFrame) -> DataFrame:
    """Companion files an input trigger also reached, with how many tasks read each."""
    return matches.where("companion").groupBy("trigger_id", "name").agg(F.count("*").alias("tasks"))
