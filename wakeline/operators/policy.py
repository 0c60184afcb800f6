"""
Classification and the decision table.

A policy is an ordered list of rules, first match wins. Its domain is finite,
so it is compiled once into a total table of 3 classes x 4 storage x 3 scope x
3 released x 3 mode = 324 rows, unverified values included, and every task is
decided by one null-safe join with it. The table's size does not grow with the
data, which is why it may be broadcast.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.canonical import canonical_json
from wakeline.functions.text import short_process
from wakeline.operators.graph import NODE
from wakeline.session import cut, grown

# The closed vocabulary of the decision, and the shipped table's
# rules in order. An omitted dimension is a wildcard.
CLASSES = ("SEPARABLE", "REGENERABLE", "IRREDUCIBLE")
DIMENSIONS = ("contribution", "storage", "scope", "released", "mode")
VALUES = {
    "contribution": CLASSES,
    "storage": ("DESTROYED", "WORM", "WRITABLE"),
    "scope": ("exclusive", "shared"),
    "released": (False, True),
    "mode": ("remove", "trace"),
}
VERIFIABLE = ("storage", "scope", "released", "mode")
ACTIONS = ("ALREADY_GONE", "DESTROY", "NOTIFY_ONLY", "PURGE", "QUARANTINE", "REGENERATE")
UNDETERMINED = "UNDETERMINED"
FALLTHROUGH = {"id": "fallthrough", "action": "QUARANTINE", "reason": "no rule covers this; blocked until one does"}
V1 = {
    "version": "v1",
    "description": "Shipped remediation table.",
    "rules": [
        {"id": "R1", "when": {"released": True}, "action": "NOTIFY_ONLY",
         "reason": "already released; our copy is not the one others hold, so they must be told"},
        {"id": "R2", "when": {"storage": "DESTROYED"}, "action": "ALREADY_GONE",
         "reason": "no copy is left and none was released"},
        {"id": "R3", "when": {"scope": "exclusive", "storage": "WRITABLE"}, "action": "DESTROY",
         "reason": "made for this subject alone, on storage that can be changed"},
        {"id": "R4", "when": {"scope": "exclusive"}, "action": "QUARANTINE",
         "reason": "made for this subject alone, on storage that cannot be changed"},
        {"id": "R5", "when": {"contribution": "SEPARABLE", "mode": "trace"}, "action": "REGENERATE",
         "reason": "the subject's part can be taken out and was changed, so that part is computed again"},
        {"id": "R6", "when": {"contribution": "SEPARABLE", "storage": "WRITABLE"}, "action": "PURGE",
         "reason": "the subject's part can be taken out in place"},
        {"id": "R7", "when": {"contribution": "SEPARABLE"}, "action": "REGENERATE",
         "reason": "the subject's part can be taken out, but only into a fresh artifact"},
        {"id": "R8", "when": {"contribution": "REGENERABLE"}, "action": "REGENERATE",
         "reason": "the recipe is recorded, so the artifact can be computed again from what remains"},
        {"id": "R9", "when": {"contribution": "IRREDUCIBLE"}, "action": "QUARANTINE",
         "reason": "the part cannot be taken out and the artifact cannot be computed again"},
    ],
}


class InvalidPolicy(ValueError):
    """A policy that could decide by accident."""


def validate(policy) -> dict:
    """Refuse a policy with anything mistyped, unknown or unexplained; returns it."""
    def need(ok, problem):
        if not ok:
            raise InvalidPolicy(problem)

    def text(value):
        return isinstance(value, str) and value.strip() != ""

    need(isinstance(policy, dict), "answer: no object")
    need(text(policy.get("version")), "version: absent")
    need(isinstance(policy.get("rules"), list) and policy["rules"], "rules: absent")
    ids = [r.get("id") if isinstance(r, dict) else None for r in policy["rules"]]
    need(all(text(i) for i in ids), "rule without id")
    need(FALLTHROUGH["id"] not in ids, f"the id {FALLTHROUGH['id']!r} is reserved")
    need(len(set(ids)) == len(ids), "rule id used twice")
    for rule in policy["rules"]:
        where = f"rule {rule['id']!r}"
        need(rule.get("action") in ACTIONS, f"{where}: action {rule.get('action')!r} not listed")
        need(text(rule.get("reason")), f"{where}: reason absent")
        need(isinstance(rule.get("when"), dict), f"{where}: when absent")
        for field, value in rule["when"].items():
            need(field in DIMENSIONS, f"{where}: no dimension {field!r}")
            need(any(type(value) is type(v) and value == v for v in VALUES[field]),
                 f"{where}: {field} never is {value!r}")
    return policy


def load_policy(spark: SparkSession, path: str) -> dict:
    """One validated policy from a JSON file."""
    return validate(json.loads(spark.read.text(path, wholetext=True).first()[0]))


def fingerprint(policy: dict) -> str:
    """SHA-256 of the whole policy, reasons included."""
    return hashlib.sha256(canonical_json(policy).encode("ascii")).hexdigest()


def _first_match(policy, facts):
    for rule in policy["rules"]:
        if all(facts[field] == value for field, value in rule["when"].items()):
            return rule
    return FALLTHROUGH


def _any_of(words):
    return words[0] if len(words) == 1 else ", ".join(words[:-1]) + " or " + words[-1]


def _row(policy, facts):
    """The decision for one point of the domain; None stands for an unverified value."""
    open_fields = [f for f in VERIFIABLE if facts[f] is None]
    outcomes = [_first_match(policy, {**facts, **dict(zip(open_fields, values))})
                for values in product(*(VALUES[f] for f in open_fields))]
    by_action = {}
    for rule in outcomes:
        by_action.setdefault(rule["action"], rule["id"])
    if len(by_action) == 1:
        (action, rule), = by_action.items()
        reason = outcomes[0]["reason"]
        if open_fields:
            reason += f" ({_any_of(open_fields)} unverified, and every possible value decides the same)"
        return action, rule, reason, None
    reason = (f"{_any_of(open_fields)} not verified; it decides between {_any_of(sorted(by_action))}")
    return None, None, reason, dict(sorted(by_action.items()))


DECISIONS = ("policy string, policy_hash string, contribution string, storage string, scope string, "
             "released boolean, mode string, action string, rule string, reason string, possible map<string,string>")


def _rows(policy: dict) -> list[tuple]:
    domain = [VALUES["contribution"]] + [(*VALUES[f], None) for f in VERIFIABLE]
    return [(policy["version"], fingerprint(policy), *point, *_row(policy, dict(zip(DIMENSIONS, point)))) for point in product(*domain)]


def decision_table(spark: SparkSession, *policies: dict) -> DataFrame:
    """(policy, policy_hash, dimensions..., action, rule, reason, possible): 324 rows per policy."""
    return spark.createDataFrame([row for policy in map(validate, policies or (V1,)) for row in _rows(policy)], DECISIONS)


def sealed_decisions(sealed: DataFrame) -> DataFrame:
    """
    The decision table of every distinct policy among sealed texts (content),
    compiled in tasks, one text at a time. A text that is no valid policy has
    no rows, so nothing sealed under it is ever confirmed.
    """
    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(),) * 5 + (pa.bool_(),) + (pa.string(),) * 4 + (pa.map_(pa.string(), pa.string()),)
        names = [part.split()[0] for part in DECISIONS.split(", ")]
        for batch in batches:
            for text in batch.column(0).to_pylist():
                try:
                    rows = _rows(validate(json.loads(text)))
                except (TypeError, ValueError):
                    continue
                columns = [[list(x.items()) if isinstance(x, dict) else x for x in column] for column in zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return sealed.select("content").distinct().mapInArrow(compiled, DECISIONS).dropDuplicates(["policy_hash", *DIMENSIONS])


def decide(facts: DataFrame, decisions: DataFrame, by: str | None = None) -> DataFrame:
    """
    Facts with action, rule, reason and possible. Action NULL is no verdict,
    with the candidates in `possible`; a row whose value lies outside a
    dimension has no rule, no candidates and `decided` false.

    `by` names a column of both sides for facts decided under several tables.
    """
    known = facts.withColumn("_class", F.when(F.col("contribution").isin(*CLASSES), F.col("contribution")).otherwise("IRREDUCIBLE"))
    table = decisions.select(*([by] if by else []), *[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "action", "rule", "reason", "possible")
    if not by:  # one policy is 324 rows whatever the data; with several, Spark decides by their size
        table = F.broadcast(table)
    pairs = [known["_class"] == table["_contribution"]] + [known[f].eqNullSafe(table[f"_{f}"]) for f in VERIFIABLE]
    if by:
        pairs.append(known[by].eqNullSafe(table[by]))
    joined = known.join(table, reduce(lambda a, b: a & b, pairs), "left")
    return joined.select(*[known[c] for c in facts.columns], "action", "rule", "reason", "possible",
                         F.col("reason").isNotNull().alias("decided"))


# ------------------------------------------------------------------ facts

def classify(tasks: DataFrame, assertions: DataFrame) -> DataFrame:
    """
    (run_id, task, contribution, released, evidence). A task with its script
    and container recorded can be run again; an assertion says it was released.
    """
    script, container = (F.coalesce(F.col(c), F.lit("")) != "" for c in ("script", "container"))
    said = lambda c, blank: F.coalesce(F.col(c), F.lit(blank))
    evidence = (
        F.when(F.col("asserted"), F.concat(
            F.lit("released ("), said("what", "unspecified"), F.lit("), by "),
            said("asserted_by", "?"), F.lit(" on "), said("date", "?")))
        .when(script & container, "recipe known")
        .otherwise(F.concat(F.lit("unknown: "), F.concat_ws(
            " or ", F.when(~script, F.lit("script")), F.when(~container, F.lit("container")))))
    )
    return tasks.join(grown(assertions.withColumn("asserted", F.lit(True))), NODE, "left").select(
        *NODE, F.when(script & container, "REGENERABLE").otherwise("IRREDUCIBLE").alias("contribution"),
        F.col("asserted").isNotNull().alias("released"), evidence.alias("evidence"))


def assert_class(facts: DataFrame, overrides: DataFrame) -> DataFrame:
    """
    Facts with a pipeline's own class put in place of the evidence's, for
    overrides (kind, process, contribution, asserted_by) on the facts' kind
    and process. Overrides naming no class are left out; see `bad_overrides`.
    """
    theirs = overrides.where(F.col("contribution").isin(*CLASSES)).select(
        "kind", "process", F.col("contribution").alias("_class"), F.col("asserted_by").alias("class_asserted_by"))
    note = F.concat(F.lit("class "), F.col("_class"), F.lit(" asserted by "), F.col("class_asserted_by"),
                    F.lit(" (by evidence "), F.col("contribution"), F.lit("); "), F.col("evidence"))
    return facts.join(theirs, ["kind", "process"], "left").withColumn(
        "evidence", F.when(F.col("_class") != F.col("contribution"), note).otherwise(F.col("evidence"))
    ).withColumn("contribution", F.coalesce("_class", "contribution")).drop("_class")


def bad_overrides(overrides: DataFrame) -> DataFrame:
    """Overrides that name no known class; the caller refuses the run on any."""
    return overrides.where(~F.coalesce(F.col("contribution"), F.lit("")).isin(*CLASSES))


def settle_storage(facts: DataFrame, published_checked) -> DataFrame:
    """
    Storage once the published tree has been asked too, from columns
    `storage` and `has_copies`. A copy seen there settles it; a missing work
    directory alone does not, unless the published tree was looked at.
    """
    checked = published_checked if not isinstance(published_checked, bool) else F.lit(published_checked)
    open_or_gone = F.col("storage").isNull() | (F.col("storage") == "DESTROYED")
    unchecked = (F.col("storage") == "DESTROYED") & ~checked
    note = (
        F.when(open_or_gone & F.col("has_copies") & F.col("storage").isNotNull(), "; work gone, copies stand")
        .when(open_or_gone & F.col("has_copies"), "; copies stand")
        .when(unchecked, "; work gone, copies unchecked").otherwise("")
    )
    storage = F.when(open_or_gone & F.col("has_copies"), "WRITABLE").when(~unchecked | unchecked.isNull(), F.col("storage"))
    return facts.withColumn("evidence", F.concat("evidence", note)).withColumn("storage", storage)


# --------------------------------------------------------------- summaries

def verdict_of(plan: DataFrame) -> DataFrame:
    return plan.withColumn("verdict", F.coalesce("action", F.lit(UNDETERMINED)))


def plan_actions(plan: DataFrame, *by: str) -> DataFrame:
    """Tasks per verdict, the withheld ones counted as UNDETERMINED."""
    return verdict_of(plan).groupBy(*by, "verdict").agg(F.count("*").alias("tasks"))


def plan_cost(plan: DataFrame, *by: str) -> DataFrame:
    """
    Per verdict and metric that occurs under it: the sum, and how many of the
    verdict's tasks carry no such figure. Figures count to six places.
    """
    keys = [*by, "verdict"]
    # One pass: each row counts once without a metric, and once for each figure it carries.
    none = F.struct(F.lit(None).cast("string").alias("metric"), F.lit(None).cast("decimal(28,6)").alias("value"), F.lit(True).alias("task"))
    figures = F.transform(F.map_entries("metrics"), lambda e: F.struct(
        e["key"].alias("metric"), e["value"].cast("decimal(28,6)").alias("value"), F.lit(False).alias("task")))
    told = verdict_of(plan).select(*keys, F.explode(F.concat(F.array(none), F.coalesce(figures, F.filter(F.array(none), lambda f: ~f["task"])))).alias("f")).select(*keys, "f.*")
    sums, _ = cut(told.groupBy(*keys, "task", "metric").agg(F.sum("value").cast("double").alias("total"), F.count("*").alias("n")), "plan-cost")
    counts = sums.where("task").select(*keys, F.col("n").alias("tasks"))
    return sums.where("NOT task").join(counts, keys).select(*keys, "metric", "total", (F.col("tasks") - F.col("n")).alias("missing"))


def settled_or_possible():
    """One label for a task whether or not its verdict is settled."""
    return F.coalesce("action", F.array_join(F.array_sort(F.map_keys("possible")), " or "), F.lit("?"))


def rollup_by_process(plan: DataFrame, *by: str, duration: str = "duration_s") -> DataFrame:
    """Plan rows by process, class, verdict and target, with recorded seconds and how many lack them."""
    took = F.col("metrics")[duration]
    return plan.groupBy(*by, short_process(F.col("process")).alias("process"), "contribution",
                        settled_or_possible().alias("verdict"), "target").agg(
        F.count("*").alias("tasks"),
        F.coalesce(F.sum(took.cast("decimal(28,6)")), F.lit(0)).cast("double").alias("recorded"),
        F.count_if(took.isNull()).alias("unrecorded"))


def rollup_by_target(plan: DataFrame, *by: str) -> DataFrame:
    """Affected tasks per machine, for engines that record one."""
    return plan.where(F.coalesce("target", F.lit("")) != "").groupBy(*by, "target").agg(F.count("*").alias("tasks"))


def headline(plan: DataFrame, totals: DataFrame, *by: str) -> DataFrame:
    """How much of a run the plan reaches and how much of that is open; `totals` is (run_id, total)."""
    figures = plan.groupBy(*by, "run_id").agg(
        F.count("*").alias("affected"), F.count_if(F.col("action").isNull()).alias("open"),
        F.count_distinct(F.when(F.col("target") != "", F.col("target"))).alias("targets"))
    return figures.join(totals, "run_id").select(
        *by, "run_id", "affected", "total", "open", (F.col("affected") - F.col("open")).alias("settled"),
        (F.col("total") - F.col("affected")).alias("untouched"),
        F.bround(100 * F.col("affected") / F.col("total"), 0).cast("bigint").alias("percent"), "targets")


def what_if(facts: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Facts whose verdict, rule or candidates differ under two tables, with both answers."""
    first = decide(facts, before).select(
        "*", *[F.col(c).alias(f"{c}_before") for c in ("action", "rule", "possible")]).drop("action", "rule", "reason", "possible", "decided")
    both = decide(first, after)
    same = [F.col(f"{c}_before").eqNullSafe(F.col(c)) for c in ("action", "rule")]
    pairs = [F.coalesce(F.to_json(F.array_sort(F.map_entries(c))), F.lit("")) for c in ("possible_before", "possible")]
    return both.where(~(same[0] & same[1] & (pairs[0] == pairs[1]))).drop("decided", "reason")


def graph_notes(tasks: DataFrame, coverage: DataFrame) -> DataFrame:
    """
    What a run says it does not cover: (run_id, note, tasks), its coverage
    notes once each, and one line for subworkflow calls left unexpanded.
    """
    hidden = tasks.where("unexpanded_subworkflow").groupBy("run_id").agg(F.count("*").alias("tasks")).select(
        "run_id", F.lit("subworkflow calls not expanded").alias("note"), "tasks")
    return coverage.select("run_id", "note").distinct().withColumn("tasks", F.lit(None).cast("bigint")).unionByName(hidden)


def unexpanded_calls(tasks: DataFrame) -> DataFrame:
    """The calls behind that note, one row each."""
    return tasks.where("unexpanded_subworkflow").select(*NODE)
