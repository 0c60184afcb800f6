"""The plan over a batch of triggers: what its readers make it write, and that it says the same with and without paths."""

from wakeline.operators import graph, policy
from wakeline.plans import impact

NODE = "run_id string, task string"


def plan_of(spark, **more):
    """s -> a -> b, s -> b, lone alone; a task of the graph without a record, a recorded task twice, which its class meets twice too."""
    made = [("r", "s", "P", {"c": 1.0}), ("r", "a", "P", None), ("r", "b", "Q", {"c": 2.0, "d": None}), ("r", "lone", "Q", {}), ("r", "lone", "Q", {}), (None, "s", "P", {})]
    tasks = spark.createDataFrame(made, NODE + ", process string, metrics map<string,double>").selectExpr("*", "task AS name", "'h' AS target", "'i' AS container", "'x' AS script")
    edges = spark.createDataFrame([("r", "a", "s"), ("r", "b", "a"), ("r", "b", "s"), ("r", "gone", "a")], "run_id string, consumer string, producer string")
    entries = spark.createDataFrame([("t", "r", "s"), ("t", "r", "lone"), ("u", "r", "a"), ("u", None, "s"), (None, "r", "s")], "trigger_id string, " + NODE)
    triggers = spark.createDataFrame([("t", "k", "1", "remove"), ("u", "k", "2", "remove")], "trigger_id string, kind string, value string, mode string")
    peers = entries.join(triggers, "trigger_id").selectExpr("kind", "value AS subject", "run_id", "task")
    none = spark.createDataFrame([], NODE + ", what string, asserted_by string, date string")
    return impact.impact_plan(
        triggers, entries, tasks, edges, assertions=none, storage=spark.createDataFrame([("r", "b", "WORM")], NODE + ", storage string"),
        copies=none, decisions=policy.decision_table(spark), peers=peers, **more)


def test_a_plan_without_paths_puts_none_together(spark, monkeypatch):
    logs = []

    class Told(graph.RoundLog):
        def __init__(self, spark, label, *more):
            logs.append(label)
            super().__init__(spark, label, *more)

    monkeypatch.setattr(graph, "RoundLog", Told)
    bare = plan_of(spark, paths=False)
    short = bare.select("trigger_id", "task", "scope", "storage", "process").collect()
    assert "levels" in logs and "paths" not in logs and "evidence_path" not in bare.columns
    whole = plan_of(spark)
    assert "paths" in logs
    assert sorted(map(str, whole.select("trigger_id", "task", "scope", "storage", "process").collect())) == sorted(map(str, short))
    assert sorted((r.trigger_id, r.task, r.scope, ">".join(r.evidence_path or [])) for r in whole.collect()) == [
        ("t", "a", "shared", "s>a"), ("t", "b", "shared", "s>b"), *[("t", "lone", "exclusive", "")] * 4,
        ("t", "s", "exclusive", ""), ("u", "a", "shared", ""), ("u", "b", "shared", "a>b")]


def test_costs_read_the_plan_once(spark):
    plan = spark.createDataFrame(
        [("t", "PURGE", {"c": 1.5, "d": None}), ("t", "PURGE", {"c": 0.1}), ("t", "PURGE", None), ("t", None, {"c": 2.0}), ("u", "PURGE", {}), (None, "PURGE", {"c": 1.0})],
        "trigger_id string, action string, metrics map<string,double>")
    counted = plan.where(policy.F.udf(lambda x: True, "boolean")("trigger_id"))
    cost = policy.plan_cost(counted, "trigger_id")
    # Only what was summed up is left to read.
    assert "BatchEvalPython" not in cost._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.trigger_id, r.verdict, r.metric, r.total, r.missing) for r in cost.collect()) == [
        ("t", "PURGE", "c", 1.6, 1), ("t", "PURGE", "d", None, 2), ("t", "UNDETERMINED", "c", 2.0, 0)]
