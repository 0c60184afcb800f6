"""
Sealed answers, many bundles at once: read, merged, checked and re-derived.

A bundle is a folder of documents under a manifest. `files` is (bundle, name,
content); every check answers (bundle, check, ok, detail), where ok NULL means
there was nothing to check.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wakeline.functions.canonical import GENESIS
from wakeline.functions.instants import in_effect
from wakeline.operators import ledger, policy
from wakeline.operators.policy import UNDETERMINED
from wakeline.session import grown

# The manifest's name, the names it never lists, and its shape.
MANIFEST = "manifest.json"
UNLISTED = (MANIFEST, "manifest.json.sig")
PLACE = "struct<seq: bigint, hash: string>"
MANIFEST_SCHEMA = (f"files map<string,string>, anchors struct<log_head: {PLACE}, since: {PLACE}, previous_bundle: string, "
                   f"previous_log_head: {PLACE}>, coverage array<string>")
ENTRY_SCHEMA = ("array<struct<seq: bigint, effective_from: string, recorded_at: string, actor: string, event_type: string, "
                "subject: string, body: string, prev_hash: string, hash: string>>")
PLAN_SCHEMA = ("trigger string, policy_version string, policy_hash string, tasks_total bigint, tasks_affected bigint, "
               "actions map<string,bigint>, plan array<struct<task: string, process: string, contribution: string, storage: string, "
               "scope: string, released: boolean, mode: string, action: string, rule: string, possible: map<string,string>>>")


def safe_name(name):
    """A plain file name inside the bundle and nowhere else."""
    return (F.coalesce(name, F.lit("")) != "") & (name != ".") & ~name.rlike(r"[/\\]|\.\.")


def manifests(files: DataFrame) -> DataFrame:
    """(bundle, m): each bundle's manifest; m NULL when it cannot be read."""
    said = F.when(F.try_parse_json("content").isNotNull(), F.from_json("content", MANIFEST_SCHEMA))
    return files.where(F.col("name") == MANIFEST).select("bundle", said.alias("m"))


def listed_files(found: DataFrame) -> DataFrame:
    """(bundle, name, recorded) from manifests."""
    return found.select("bundle", F.explode("m.files").alias("name", "recorded"))


def load_bundles(files: DataFrame) -> DataFrame:
    """
    The files of every readable bundle. One without a manifest, naming a file
    outside itself, or with a document that is missing or not JSON, is left
    out whole; it does not deny a reader the rest.
    """
    found = manifests(files)
    listed = listed_files(found)
    documents = listed.where(F.endswith("name", F.lit(".json"))).join(
        files.select("bundle", "name", F.try_parse_json("content").isNotNull().alias("readable")), ["bundle", "name"], "left")
    bad = (
        found.where("m IS NULL").select("bundle")
        .unionByName(listed.where(~safe_name(F.col("name"))).select("bundle"))
        .unionByName(documents.where(~F.coalesce("readable", F.lit(False))).select("bundle")))
    return files.join(found.select("bundle"), "bundle", "left_semi").join(bad.distinct(), "bundle", "left_anti")


def bundle_anchors(found: DataFrame) -> DataFrame:
    """(bundle, head_seq, head_hash, since_seq, since_hash, previous_bundle, previous_seq, previous_hash)."""
    at = "m.anchors"
    return found.select(
        "bundle", F.col(f"{at}.log_head.seq").alias("head_seq"), F.col(f"{at}.log_head.hash").alias("head_hash"),
        F.coalesce(f"{at}.since.seq", F.lit(0)).alias("since_seq"), F.coalesce(f"{at}.since.hash", F.lit(GENESIS)).alias("since_hash"),
        F.col(f"{at}.previous_bundle").alias("previous_bundle"), F.col(f"{at}.previous_log_head.seq").alias("previous_seq"),
        F.col(f"{at}.previous_log_head.hash").alias("previous_hash"))


def bundled_entries(files: DataFrame) -> DataFrame:
    """(bundle, seq, ...): the log entries sealed in each bundle."""
    return files.where("name = 'events.json'").select(
        "bundle", F.explode(F.from_json("content", ENTRY_SCHEMA)).alias("e")).select("bundle", "e.*")


def bundled_plans(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plan headers, plan items and the header's counts per action, one row each."""
    plans = files.where("name = 'plan.json'").select("bundle", F.from_json("content", PLAN_SCHEMA).alias("p"))
    heads = plans.select("bundle", "p.trigger", "p.policy_version", "p.policy_hash", "p.tasks_total", "p.tasks_affected")
    items = plans.select("bundle", F.explode("p.plan").alias("i")).select("bundle", "i.*")
    counts = plans.select("bundle", F.explode("p.actions").alias("verdict", "tasks"))
    return heads, items, counts


# ------------------------------------------------------------------- merging

def merge_entries(entries: DataFrame) -> DataFrame:
    """
    One log out of many bundles: an entry sealed several times counts once,
    and where two entries claim one place the first bundle by name decides.
    """
    columns = [c for c in entries.columns if c != "bundle"]
    once = entries.groupBy("hash").agg(F.min("bundle").alias("bundle"), F.min_by(F.struct(*columns), "bundle").alias("e"))
    first = once.groupBy("e.seq").agg(F.min_by(F.struct("bundle", "e"), F.struct("bundle", "hash")).alias("w"))
    return first.select("w.bundle", "w.e.*")


def log_conflicts(entries: DataFrame) -> DataFrame:
    """(seq, entries, bundles): places where bundles carry different entries, so they come from different logs."""
    places = entries.groupBy("seq").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    return entries.join(places.where("low <> high").select("seq"), "seq").groupBy("seq").agg(
        F.count_distinct("hash").alias("entries"), F.count_distinct("bundle").alias("bundles"))


def log_timeline(entries: DataFrame) -> DataFrame:
    """
    The merged log in order, both clocks, the scalar fields of each body, and
    whether the place is in conflict. Lists and objects in a body are left out.
    """
    values = F.map_filter(F.from_json("body", "map<string,variant>"),
                          lambda k, v: ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).rlike("^(OBJECT|ARRAY)"))
    shown = F.array_join(F.transform(F.array_sort(F.map_keys(values)), lambda k: F.concat(
        k, F.lit("="), F.coalesce(F.try_variant_get(F.element_at(values, k), "$", "string"), F.lit("null")))), ", ")
    conflicts = log_conflicts(entries).select("seq", F.lit(True).alias("in_conflict"))
    readable = F.try_parse_json("body").isNotNull()
    return merge_entries(entries).join(conflicts, "seq", "left").select(
        "seq", "effective_from", "recorded_at", "event_type", "subject", "actor", "hash", "bundle",
        F.when(readable, shown).otherwise("").alias("fields"), F.coalesce("in_conflict", F.lit(False)).alias("in_conflict")).orderBy("seq")


# -------------------------------------------------------------------- checks

def _check(df: DataFrame, name: str, problem, detail) -> DataFrame:
    return df.select("bundle", F.lit(name).alias("check"), problem.isNull().alias("ok"), F.coalesce(problem, detail).alias("detail"))


def verify_files(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """
    Every listed file is there and unaltered and nothing else is. The first
    failing class is told: unsafe, missing, altered, unlisted. `actual` is
    (bundle, name, sha256).
    """
    there = actual.where(~F.coalesce(F.col("name").isin(*UNLISTED), F.lit(False)))
    both = listed.withColumn("is_listed", F.lit(True)).join(there, ["bundle", "name"], "full")
    fault = (
        F.when(F.col("name").isNull() | (F.col("is_listed") & ~safe_name(F.col("name"))), 1).when(F.col("sha256").isNull(), 2)
        .when(F.col("is_listed").isNull(), 4).when(~F.col("sha256").eqNullSafe(F.col("recorded")), 3))
    rows = both.withColumn("fault", fault).groupBy("bundle").agg(
        F.min("fault").alias("fault"), F.min_by("name", F.when(F.col("fault").isNotNull(), F.struct("fault", "name"))).alias("first"),
        F.count("is_listed").alias("files"))
    said = F.element_at(F.array(*map(F.lit, ("unsafe", "absent",
                                             "altered", "extra"))), F.col("fault"))
    return _check(rows, "files", F.when(F.col("fault").isNotNull(), F.concat(said, F.lit(": "), F.coalesce("first", F.lit("?")))),
                  F.concat(F.col("files").cast("string"), F.lit(" files same")))


def verify_log_window(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """The sealed entries chain from the recorded start, genesis or the previous bundle's head, to the recorded head."""
    starts = anchors.select(F.col("bundle").alias("log_id"), (F.col("since_seq") + 1).alias("start_seq"), F.col("since_hash").alias("start_prev"))
    chain = ledger.verify_chain(entries.withColumnRenamed("bundle", "log_id"), starts).withColumnRenamed("log_id", "bundle")
    last = entries.groupBy("bundle").agg(F.max("seq").alias("last_seq"))
    rows = anchors.join(chain, "bundle", "left").join(last, "bundle", "left")
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    empty = F.col("ok").isNull()
    problem = (
        F.when(F.col("since_seq").isNull() | F.col("since_hash").isNull(), "start:unrecorded")
        .when(F.col("head_seq").isNull() | F.col("head_hash").isNull(), "head:unrecorded")
        .when((F.col("since_seq") == 0) & (F.col("since_hash") != GENESIS), "start:genesis")
        .when((F.col("since_seq") > 0) & (F.col("previous_bundle").isNull() | F.col("previous_seq").isNull()), "start:unnamed")
        .when((F.col("since_seq") > 0) & (differ("previous_seq", "since_seq") | differ("previous_hash", "since_hash")),
              "start:differs")
        .when(empty & (differ("head_seq", "since_seq") | differ("head_hash", "since_hash")), "head:no-entries")
        .when(~empty & ~F.col("ok"), F.concat_ws(":", F.lit("broken"), F.col("broken_at").cast("string"), "reason"))
        .when(~empty & differ("head", "head_hash"), "head:hash")
        .when(~empty & differ("last_seq", "head_seq"), "head:seq"))
    return _check(rows, "log", problem, F.concat(F.coalesce("entries", F.lit(0)).cast("string"), F.lit(" entries chain")))


def witness(anchors: DataFrame, live: DataFrame) -> DataFrame:
    """The head each bundle saw, held against the live log (bundle, seq, hash): truncated, rewritten, or still there."""
    heads = anchors.select("bundle", F.col("head_seq").alias("seq"), "head_hash")
    rows = heads.join(live.select("bundle", "seq", F.col("hash").alias("live")), ["bundle", "seq"], "left")
    unrecorded = F.col("seq").isNull() | F.col("head_hash").isNull()
    detail = (F.when(F.col("seq") == 0, "no head").when(unrecorded, "head unrecorded").when(F.col("live").isNull(), "live log shorter")
              .when(F.col("live") != F.col("head_hash"), "live log differs").otherwise("live log has it"))
    return rows.select("bundle", F.lit("witness").alias("check"),
                       F.when(unrecorded | (F.col("seq") != 0), F.coalesce(F.col("live") == F.col("head_hash"), F.lit(False))).alias("ok"), detail.alias("detail"))


@F.pandas_udf(StringType())
def canonical_text(document: pd.Series) -> pd.Series:
    """One small JSON document in canonical form; NULL for what is none."""
    def one(text):
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
        except (TypeError, ValueError, RecursionError):
            return None

    return document.map(one)


def verify_policy(plans: DataFrame, policies: DataFrame) -> DataFrame:
    """The table a plan cites by hash is the one sealed beside it; `policies` is (bundle, content). Each distinct text is read once."""
    texts = policies.select("content").distinct().select(F.sha2("content", 256).alias("text"), F.sha2(canonical_text("content"), 256).alias("actual"))
    actual = policies.select("bundle", F.sha2("content", 256).alias("text")).join(texts, "text").drop("text")
    rows = plans.select("bundle", "policy_hash").join(actual, "bundle", "left")
    problem = F.when(~F.coalesce(F.col("policy_hash") == F.col("actual"), F.lit(False)), "policy:differs")
    return _check(rows, "policy", problem, F.lit("policy:same"))


def _pairs_text(column: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def replay(items: DataFrame, decisions: DataFrame, by: str = "policy_hash") -> DataFrame:
    """Sealed items (bundle, task, facts, action, rule, possible, `by`) with what each recomputes to and `agrees`."""
    sealed = items.select(*[c for c in items.columns if c not in ("action", "rule", "possible")],
                          F.col("action").alias("sealed_action"), F.col("rule").alias("sealed_rule"), _pairs_text("possible").alias("sealed_possible"))
    again = policy.decide(sealed, decisions, by=by).withColumn("possible", _pairs_text("possible"))
    agrees = F.col("decided") & F.col("sealed_action").eqNullSafe(F.col("action")) & F.col("sealed_rule").eqNullSafe(
        F.col("rule")) & F.col("sealed_possible").eqNullSafe(F.col("possible"))
    return again.withColumn("agrees", agrees)


def verify_replay(plans: DataFrame, items: DataFrame, header_counts: DataFrame, decisions: DataFrame) -> DataFrame:
    """
    Every line of every plan recomputed under its own policy, and the header's
    totals too: a header that disagrees with its items is two documents.
    """
    again = replay(items.join(plans.select("bundle", "policy_hash"), "bundle"), decisions)
    lines = again.groupBy("bundle").agg(F.count("*").alias("items"), F.count_if(~F.coalesce("agrees", F.lit(False))).alias("mismatches"))
    counted = again.groupBy("bundle", F.coalesce("action", F.lit(UNDETERMINED)).alias("verdict")).agg(F.count("*").alias("n"))
    totals = header_counts.join(counted, ["bundle", "verdict"], "full").groupBy("bundle").agg(
        F.count_if(~F.col("tasks").eqNullSafe(F.col("n"))).alias("wrong_counts"))
    rows = plans.join(lines, "bundle", "left").join(totals, "bundle", "left").na.fill(0, ["items", "mismatches", "wrong_counts"])
    number = lambda c: F.col(c).cast("string")
    problem = (
        F.when(F.col("mismatches") > 0, F.concat(number("mismatches"), F.lit(" of "), number("items"), F.lit(" items differ")))
        .when(~F.col("tasks_affected").eqNullSafe(F.col("items")), F.concat(F.lit("header:"), F.coalesce(number("tasks_affected"), F.lit("?")), F.lit(" items:"), number("items")))
        .when(F.col("wrong_counts") > 0, "header:counts"))
    return _check(rows, "replay", problem, F.concat(number("items"), F.lit(" items same")))


def verify_gate(gates: DataFrame, subjects: DataFrame, types: DataFrame, entries: DataFrame) -> DataFrame:
    """
    Sealed gates (bundle, as_of, unknown_blocks, passed) with their subjects
    (bundle, subject, status) recomputed from the bundled facts, under types
    (bundle, event_type, blocks).
    """
    facts = ledger.with_instant(entries.join(types, ["bundle", "event_type"])).join(gates.select("bundle", "as_of"), "bundle").where(
        in_effect(F.col("effective_ts"), F.col("as_of")))
    again = ledger.gate_over(subjects, facts, F.col("blocks"), by=("bundle",)).withColumnRenamed("status", "again")
    lines = subjects.join(again.select("bundle", "subject", "again"), ["bundle", "subject"]).groupBy("bundle").agg(
        F.count("*").alias("subjects"), F.count_if(~F.coalesce(F.col("status") == F.col("again"), F.lit(False))).alias("differ"),
        F.count_if(F.col("again") == ledger.BLOCKED).alias("blocked"), F.count_if(F.col("again") == ledger.UNKNOWN).alias("unknown"))
    rows = gates.join(lines, "bundle", "left").na.fill(0, ["subjects", "differ", "blocked", "unknown"])
    passed = ~((F.col("blocked") > 0) | (F.coalesce("unknown_blocks", F.lit(True)) & (F.col("unknown") > 0)))
    problem = (F.when(~F.col("passed").eqNullSafe(passed), F.concat(F.lit("passed:"), passed.cast("string")))
               .when(F.col("differ") > 0, F.concat(F.col("differ").cast("string"), F.lit(" subjects differ"))))
    return _check(rows, "gate", problem, F.concat(F.col("subjects").cast("string"), F.lit(" subjects same")))


def verify_decision(decisions: DataFrame, records: DataFrame, plans: DataFrame) -> DataFrame:
    """
    A decision (bundle, decision, trigger, incident, actor, request_sha256,
    settings_hash) is about the sealed record, by a named person, and asks what
    the plan answers; without a plan it is a dismissal.
    """
    records = records.select("bundle", F.lit(True).alias("has_record"), *[F.col(c).alias(f"record_{c}") for c in ("incident", "request_sha256", "settings_hash")])
    rows = decisions.join(records, "bundle", "left").join(
        plans.select("bundle", F.col("trigger").alias("answered"), F.lit(True).alias("has_plan")), "bundle", "left")
    planned = F.col("has_plan").isNotNull()
    same = lambda c: F.coalesce(F.col(c) == F.col(f"record_{c}"), F.lit(False)) | F.col("has_record").isNull()
    problems = F.array_compact(F.array(
        F.when(F.col("has_record").isNull(), "no-record"),
        F.when(~planned & ~F.col("decision").eqNullSafe("dismiss"), "ask-without-plan"),
        F.when(planned & ~(F.col("decision").eqNullSafe("ask") & F.col("trigger").eqNullSafe(F.col("answered"))), "other-trigger"),
        F.when(~same("incident"), "other-incident"),
        F.when(F.trim(F.coalesce("actor", F.lit(""))) == "", "no-actor"),
        F.when(~same("request_sha256"), "other-request"),
        F.when(~same("settings_hash"), "other-settings")))
    return _check(rows, "decision", F.when(F.size(problems) > 0, F.array_join(problems, "; ")), F.lit("record:same"))


def bundle_integrity(*checks: DataFrame) -> DataFrame:
    """(bundle, checks, failed, all_passed): checks with nothing to check do not count against a bundle."""
    rows = checks[0]
    for more in checks[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("bundle").agg(
        F.count("*").alias("checks"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_passed"))


# ------------------------------------------------------------------- answers

def verdict_lookup(asked: DataFrame, plans: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """
    What a plan decided about each asked (bundle, task), with its citation:
    the plan's policy hash and the rule (policy_hash, rule, rule_reason). A
    task outside the plan is outside this trigger's radius, and no more.
    """
    rows = asked.join(grown(items.withColumn("in_plan", F.lit(True))), ["bundle", "task"], "left").join(
        grown(plans.select("bundle", "trigger", "policy_version", "policy_hash")), "bundle", "left")
    return rows.join(rules, ["policy_hash", "rule"], "left").withColumn("in_plan", F.coalesce("in_plan", F.lit(False)))


def was_affected(asked: DataFrame, items: DataFrame) -> DataFrame:
    """Asked (bundle, task) with whether the bundle's plan lists it."""
    listed = items.select("bundle", "task").distinct().withColumn("affected", F.lit(True))
    return asked.join(grown(listed), ["bundle", "task"], "left").withColumn("affected", F.coalesce("affected", F.lit(False)))


def plan_summary(plans: DataFrame, items: DataFrame) -> DataFrame:
    """Counts per action of every plan, with its trigger and the policy it cites."""
    return policy.plan_actions(items, "bundle").join(plans.select("bundle", "trigger", "policy_version", "policy_hash"), "bundle")


def gate_result(gates: DataFrame, subjects: DataFrame) -> DataFrame:
    """Every sealed gate with its date, whether it passed, and its subjects per status."""
    counted = ledger.gate_decision(subjects, by=("bundle",)).select("bundle", "blocked", "cleared", "unknown")
    return gates.select("bundle", "as_of", "passed").join(counted, "bundle", "left").na.fill(0, ["blocked", "cleared", "unknown"])


def bundle_listing(anchors: DataFrame, plans: DataFrame, gates: DataFrame) -> DataFrame:
    """One row per bundle: what kind of answer it seals, about what, and the log head it saw."""
    rows = anchors.select("bundle", "head_seq", "head_hash").join(plans.select("bundle", "trigger", "policy_version"), "bundle", "left").join(
        gates.select("bundle", F.lit(True).alias("is_gate")), "bundle", "left")
    kind = F.when(F.col("policy_version").isNotNull(), "plan").when(F.col("is_gate"), "gate").otherwise("unknown")
    return rows.select("bundle", kind.alias("kind"), "trigger", "policy_version", "head_seq", "head_hash")


def incident_summary(anchors: DataFrame, plans: DataFrame, gates: DataFrame, decisions: DataFrame, integrity: DataFrame) -> DataFrame:
    """One row per sealed answer: its kind, trigger, outcome, who decided, and the verifier's word on it."""
    rows = (
        anchors.select("bundle").join(plans.select("bundle", F.col("trigger").alias("asked"), "tasks_total", "tasks_affected"), "bundle", "left")
        .join(gates.select("bundle", "passed"), "bundle", "left")
        .join(decisions.select("bundle", "actor", "decision"), "bundle", "left").join(integrity.select("bundle", "all_passed"), "bundle", "left"))
    planned, decided, gated = F.col("asked").isNotNull(), F.col("decision").isNotNull(), F.col("passed").isNotNull()
    figures = F.concat(F.lit("asked, "), F.col("tasks_affected").cast("string"), F.lit(" of "), F.col("tasks_total").cast("string"), F.lit(" tasks"))
    return rows.select(
        "bundle", F.when(planned, "plan").when(decided, "decision").when(gated, "gate").otherwise("plan").alias("kind"),
        F.when(planned, F.col("asked")).when(decided, "none").alias("trigger"),
        F.when(planned, F.coalesce(figures, F.lit("asked"))).when(decided, "dismissed").when(gated, F.when(F.col("passed"), "PASS").otherwise("STOP")).alias("outcome"),
        F.when(planned & decided, F.concat("actor", F.lit(" (held before)"))).when(~planned & decided, F.col("actor")).alias("by"), "all_passed")


def unknowns_rollup(items: DataFrame, gate_subjects: DataFrame, coverage: DataFrame) -> DataFrame:
    """(note, bundles, count): no verdict, no status, and every stated limit with its number of bundles, most common first."""
    withheld = items.where("action IS NULL").groupBy("bundle").agg(F.count("*").alias("n")).select(F.lit("no verdict").alias("note"), "bundle", "n")
    unknown = gate_subjects.where(F.col("status") == ledger.UNKNOWN).groupBy("bundle").agg(F.count("*").alias("n")).select(
        F.lit("no status").alias("note"), "bundle", "n")
    limits = coverage.select("note", "bundle", F.lit(1).cast("bigint").alias("n"))
    return withheld.unionByName(unknown).unionByName(limits).groupBy("note").agg(
        F.count("*").alias("bundles"), F.sum("n").alias("count")).orderBy(F.desc("bundles"), "note")


def manifest_table(documents: DataFrame, anchors: DataFrame) -> DataFrame:
    """
    (bundle, name, sha256, head_seq, since_seq, problem): what each manifest
    lists and the log window it seals. A bundle is refused whose names are not
    safe, whose window starts past its head, or does not continue a previous one.
    """
    hashed = documents.select("bundle", "name", F.sha2("content", 256).alias("sha256"))
    problem = (
        F.when(~safe_name(F.col("name")), "name:unsafe").when(F.col("since_seq") > F.col("head_seq"), "window:past-head")
        .when((F.col("since_seq") > 0) & ~F.col("previous_seq").eqNullSafe(F.col("since_seq")), "window:gap")
        .when((F.col("since_seq") > 0) & F.col("previous_bundle").isNull(), "window:unnamed"))
    return hashed.join(anchors, "bundle").select("bundle", "name", "sha256", "head_seq", "since_seq", problem.alias("problem"))
