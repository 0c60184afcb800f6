from itertools import product

import pytest
from pyspark.sql import functions as F

from wakeline.operators import policy


def first(facts, rules):
    return next((r for r in rules if all(facts[k] == v for k, v in r["when"].items())), policy.FALLTHROUGH)


def test_every_point_of_the_domain(spark):
    table = {tuple(r[d] for d in policy.DIMENSIONS): r for r in policy.decision_table(spark).collect()}
    assert len(table) == 324
    for point, row in table.items():
        facts = dict(zip(policy.DIMENSIONS, point))
        worlds = [dict(zip(policy.DIMENSIONS, w)) for w in product(*[
            policy.VALUES[d] if facts[d] is None else (facts[d],) for d in policy.DIMENSIONS])]
        actions = {}
        for world in worlds:
            rule = first(world, policy.V1["rules"])
            actions.setdefault(rule["action"], rule["id"])
        if len(actions) == 1:
            assert (row.action, row.rule, row.possible) == (*next(iter(actions.items())), None)
        else:
            assert row.action is None and row.rule is None and row.possible == actions


def test_every_rule_decides_something_and_nothing_falls_through(spark):
    known = policy.decision_table(spark).where("storage IS NOT NULL AND scope IS NOT NULL AND released IS NOT NULL AND mode IS NOT NULL")
    assert {r.rule for r in known.select("rule").collect()} == {r["id"] for r in policy.V1["rules"]}


def test_an_incomplete_policy_is_cautious(spark):
    thin = {"version": "thin", "rules": [{"id": "only", "when": {"released": True}, "action": "NOTIFY_ONLY", "reason": "x"}]}
    row = policy.decision_table(spark, thin).where("storage = 'WRITABLE' AND scope = 'shared' AND NOT released AND mode = 'trace'").first()
    assert (row.action, row.rule) == ("QUARANTINE", "fallthrough")


@pytest.mark.parametrize("broken", [
    {}, {"version": " ", "rules": [{}]}, {"version": "x", "rules": []},
    {"version": "x", "rules": [{"id": "a", "when": {"colour": "red"}, "action": "PURGE", "reason": "y"}]},
    {"version": "x", "rules": [{"id": "a", "when": {"released": 1}, "action": "PURGE", "reason": "y"}]},
    {"version": "x", "rules": [{"id": "a", "when": {}, "action": "SHRED", "reason": "y"}]},
    {"version": "x", "rules": [{"id": "a", "when": {}, "action": "PURGE", "reason": " "}]},
    {"version": "x", "rules": [{"id": "fallthrough", "when": {}, "action": "PURGE", "reason": "y"}]},
    {"version": "x", "rules": [{"id": "a", "when": {}, "action": "PURGE", "reason": "y"}] * 2},
])
def test_policies_that_could_decide_by_accident_are_refused(broken):
    with pytest.raises(policy.InvalidPolicy):
        policy.validate(broken)


def test_unknown_class_and_values_outside_a_dimension(spark):
    facts = spark.createDataFrame([("WEIRD", "WRITABLE", "shared", False, "trace"), ("REGENERABLE", "TAPE", "shared", False, "trace")],
                                  "contribution string, storage string, scope string, released boolean, mode string")
    rows = policy.decide(facts, policy.decision_table(spark)).orderBy(F.desc("contribution")).collect()
    assert [(r.rule, r.decided) for r in rows] == [("R9", True), (None, False)]


def test_gone_scratch_is_not_gone_while_the_published_tree_is_unseen(spark):
    rows = spark.createDataFrame([("a", "DESTROYED", False, ""), ("b", "DESTROYED", True, ""), ("c", None, True, ""), ("d", "WORM", True, "")],
                                 "task string, storage string, has_copies boolean, evidence string")
    said = lambda checked: {r.task: r.storage for r in policy.settle_storage(rows, checked).collect()}
    assert said(False) == {"a": None, "b": "WRITABLE", "c": "WRITABLE", "d": "WORM"}
    assert said(True)["a"] == "DESTROYED"
