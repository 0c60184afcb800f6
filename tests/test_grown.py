"""Joins of two tables that grow: files that look small are not sent to every executor by way of the driver."""

import re

import pytest
from pyspark.sql import functions as F

from wakeline import session
from wakeline.operators import evidence, graph, intake, policy, triggers
from wakeline.plans import impact
from wakeline.sources import files


def packed(spark, tmp_path, rows, schema):
    """Rows as a small file, of the size that Spark plans by."""
    path = str(tmp_path / str(len(list(tmp_path.iterdir()))))
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


ITEMS = [("b1", "t1", "PURGE", "R1"), ("b1", "t1", "PURGE", "R1"), ("b2", "t1", None, None), (None, "t2", "PURGE", "R1"), ("b2", None, "PURGE", "R2")]
ASKED = [("b1", "t1"), ("b1", "t1"), ("b2", "t1"), ("b2", None), (None, "t2"), ("b3", "t1")]


def test_verdicts_are_looked_up_without_sending_the_items(spark, tmp_path):
    items = packed(spark, tmp_path, ITEMS, "bundle string, task string, action string, rule string")
    plans = packed(spark, tmp_path, [("b1", "x", "v1", "h"), ("b2", "y", "v1", "h")], "bundle string, trigger string, policy_version string, policy_hash string")
    rules = spark.createDataFrame([("h", "R1", "PURGE")], "policy_hash string, rule string, rule_action string")
    found = evidence.verdict_lookup(packed(spark, tmp_path, ASKED, "bundle string, task string"), plans, items, rules)
    assert broadcasts(found) == 0
    assert sorted(map(str, ((r.bundle, r.task, r.in_plan, r.trigger, r.rule_action) for r in found.collect()))) == sorted(map(str, [
        *[("b1", "t1", True, "x", "PURGE")] * 4, ("b2", "t1", True, "y", None), ("b2", None, False, "y", None), (None, "t2", False, None, None), ("b3", "t1", False, None, None)]))


def test_whether_a_task_was_affected_is_asked_without_sending_the_items(spark, tmp_path):
    items = packed(spark, tmp_path, ITEMS, "bundle string, task string, action string, rule string")
    found = evidence.was_affected(packed(spark, tmp_path, ASKED, "bundle string, task string"), items)
    assert broadcasts(found) == 0
    assert sorted((r.bundle or "", r.task or "", r.affected) for r in found.collect()) == [
        ("", "t2", False), ("b1", "t1", True), ("b1", "t1", True), ("b2", "", False), ("b2", "t1", True), ("b3", "t1", False)]


def test_files_are_digested_without_sending_the_listings(spark, tmp_path):
    outputs = packed(spark, tmp_path, [("r", "t", "a", 1, "sha256:x"), ("r", "t", "b", 2, "bare"), ("r", "t", "c", 3, None), ("r", None, "a", 4, None), (None, "t", "b", 5, None)],
                     "run_id string, task string, file string, size bigint, digest string")
    resolved = packed(spark, tmp_path, [("r", "t", "w"), ("r", None, "w"), (None, "t", "w")], "run_id string, task string, rel string")
    hashed = packed(spark, tmp_path, [("r", "w/a", 7, "sha256:a"), ("r", "w/b", 8, "sha256:b"), ("r", "w/b", 8, "sha256:b"), (None, "w/b", 9, "sha256:n")],
                    "run_id string, path string, size bigint, digest string")
    found = files.digest_files(outputs, resolved, hashed)
    assert broadcasts(found) == 0 and broadcasts(files.digest_counts(found)) == 0
    assert sorted((r.file, r.size, r.digest or "", r.how) for r in found.collect()) == [
        ("a", 1, "sha256:x", "kept"), ("a", 4, "", "missing"), ("b", 5, "", "missing"), ("b", 8, "sha256:b", "hashed"), ("b", 8, "sha256:b", "hashed"), ("c", 3, "", "missing")]
    assert [(r.run_id, r.hashed, r.kept, r.missing, r.bytes) for r in files.digest_counts(found).orderBy("run_id").collect()] == [(None, 0, 0, 1, 0), ("r", 2, 1, 2, 16)]


def test_few_rows_are_sent_and_many_are_shuffled(spark, monkeypatch):
    rows = spark.range(5).withColumnRenamed("id", "a")
    plan = lambda n: rows.join(session.sent(rows, n), "a")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(session, "SENT", 5)
    assert "BroadcastHashJoin" in plan(5) and "SortMergeJoin" in plan(6) and "Broadcast" not in plan(6)


GRAPH = [("r", f"n{i + 1}", f"n{i}") for i in range(5)] + [("r", f"x{i}", f"e{i}") for i in range(40)] + [("r", "x3", "n4")]
ENTERED = [("s", "r", f"e{i}") for i in range(40)] + [("s", "r", "n0"), ("u", "r", "n3"), ("u", "r", "lone"), (None, "r", "n1")]


def test_rounds_meet_the_rows_so_far_without_sending_them(spark, monkeypatch):
    edges = spark.createDataFrame(GRAPH, "run_id string, consumer string, producer string")
    entries = spark.createDataFrame(ENTERED, "subject string, run_id string, task string")
    peers = entries.where("subject IS NOT NULL").withColumn("kind", F.lit("k"))
    found = lambda: [sorted(map(str, df.collect())) for df in (graph.evidence_paths(entries, edges), graph.reach(entries, edges), graph.sole_subject(peers, edges))]
    plans, add = [], graph.RoundLog.add

    def told(log, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return add(log, df)

    sent = found()
    monkeypatch.setattr(graph.RoundLog, "add", told)
    monkeypatch.setattr(session, "SENT", -1)
    assert found() == sent and len(sent[0]) == len(sent[1]) == 40 * 2 + 6 + 3 + 2
    rounds = [p for p in plans if "Join" in p]
    assert sum("LeftAnti" in p for p in rounds) >= 5
    assert not [p for p in rounds if re.search(r"BroadcastHashJoin \[(node|no|kind)#", p)]


def test_a_plan_meets_its_tasks_without_sending_them(spark, tmp_path):
    name = "run_id string, task string"
    made = [("r", f"n{i}", "P", "i", "x") for i in range(4)] + [("r", "lone", "Q", "i", ""), (None, "n0", "P", "i", "x")]
    tasks = packed(spark, tmp_path, made, name + ", process string, container string, script string").selectExpr("*", "task AS name", "'h' AS target", "map('c', 1.0D) AS metrics")
    edges = spark.createDataFrame(GRAPH[:3], "run_id string, consumer string, producer string")
    entries = spark.createDataFrame([("t", "r", "n0"), ("t", "r", "lone")], "trigger_id string, " + name)
    triggers = spark.createDataFrame([("t", "k", "1", "remove")], "trigger_id string, kind string, value string, mode string")
    peers = entries.join(triggers, "trigger_id").selectExpr("kind", "value AS subject", "run_id", "task")
    storage = packed(spark, tmp_path, [("r", "n1", "WORM"), ("r", "lone", None)], name + ", storage string")
    copies = packed(spark, tmp_path, [("r", "lone")], name)
    said = packed(spark, tmp_path, [("r", "n2", "ref", "u", "d")], name + ", what string, asserted_by string, date string")
    plans = []

    def told(df, label, cut=impact.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, label)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(impact, "cut", told)
        plan = impact.impact_plan(triggers, entries, tasks, edges, assertions=said, storage=storage, copies=copies, decisions=policy.decision_table(spark), peers=peers, paths=False)
    joins = re.compile(r"BroadcastHashJoin \[(?:run_id|task|node)#")
    assert len(plans) == 1 and not joins.search(plans[0]) and not joins.search(plan._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.task, r.storage or "", r.scope, r.released, r.evidence) for r in plan.collect()) == [
        ("lone", "WRITABLE", "exclusive", False, "unknown: script; storage unlisted; copies stand"), ("n0", "", "exclusive", False, "recipe known; storage unlisted"),
        ("n1", "WORM", "exclusive", False, "recipe known"), ("n2", "", "exclusive", True, "released (ref), by u on d; storage unlisted"),
        ("n3", "", "exclusive", False, "recipe known; storage unlisted")]


def test_answers_and_decisions_meet_what_was_offered_without_sending_it(spark, tmp_path):
    key = "incident string, run_id string"
    offered = packed(spark, tmp_path, [("i", "r", "k", "a", "a", "k:a"), ("i", "r", "k", "a", "a", "k:a"), ("j", "r", "k", "b", "b", "k:b"), (None, "r", "k", "a", "a", "k:a")],
                     key + ", kind string, value string, option string, trigger string")
    said = '{"model":"m","choice":"%s","confidence":0.9,"probabilities":{"%s":0.1}}'
    answers = packed(spark, tmp_path, [("i", "r", said % ("a", "a")), ("i", "r", "torn"), ("j", "r", said % ("a", "b")), ("l", "r", said % ("none", "z")), (None, "r", said % ("a", "a"))], key + ", value string")
    checked = intake.check_answers(answers, offered, "m")
    assert broadcasts(checked) == 0
    assert sorted((r.incident or "", r.problem or "") for r in checked.collect()) == [
        ("", "choice: unoffered"), ("i", ""), ("i", "answer: no object"), ("j", "choice: unoffered"), ("l", "weights: unoffered")]

    texts = packed(spark, tmp_path, [("i", "r", "the a-1"), ("j", "r", "b"), ("l", "r", "")], key + ", text string")
    good = packed(spark, tmp_path, [("i", "r", "a", 0.9, 0), ("j", "r", "none", 0.95, 0), ("l", "r", "none", 0.2, 0)], key + ", choice string, confidence double, named bigint")
    ids = packed(spark, tmp_path, [("j", "r", "b1"), ("j", "r", "b2")], key + ", word string")
    triaged = intake.triage_outcomes(texts, good, offered, ids, ["k"])
    assert broadcasts(triaged) == 0
    assert sorted((r.incident, r.outcome, r.reason, r.trigger) for r in triaged.collect()) == [
        *[("i", "ask", "confidence high", "k:a")] * 2, ("j", "held", "id found in text", None), ("l", "held", "none, confidence low", None)]

    held = packed(spark, tmp_path, [("i", "r", "ask", "a"), ("j", "r", "held", "none"), ("l", "r", "held", "x")], key + ", outcome string, choice string")
    decisions = packed(spark, tmp_path, [("i", "r", "p", "k:a", False), ("j", "r", " p", "k:b", False), ("l", "r", "p", "k:z", False), ("l", "r", "p", None, True)],
                       key + ", actor string, ask string, dismiss boolean")
    decided = intake.record_decisions(decisions, held, offered)
    facts, inbox = intake.facts_from_decisions(decided, ["k"]), intake.inbox_state(texts, held, decided)
    graded = intake.grade_triage(held, packed(spark, tmp_path, [("i", "r", "f", "a"), ("l", "r", "f", "none")], key + ", form string, expected string"))
    assert [broadcasts(df) for df in (decided, facts, inbox, graded)] == [0] * 4
    assert sorted((r.incident, r.decision, r.refused or "") for r in decided.collect()) == [
        ("i", "ask", "not held"), ("j", "ask", ""), ("l", "ask", "trigger: unoffered"), ("l", "dismiss", "")]
    assert [(r.subject, r.actor, r.incident) for r in facts.collect()] == [("b", "p", "j")]
    assert sorted((r.incident, r.state) for r in inbox.collect()) == [("i", "ask"), ("j", "held first: ask"), ("l", "held first: dismiss")]
    assert [(r.cases, r.right, r.held, r.acted_wrongly) for r in graded.collect()] == [(2, 1, 1, 0)]


def test_words_and_tags_are_looked_up_without_sending_them(spark, tmp_path):
    texts = packed(spark, tmp_path, [("i", "r", "bad lane-7 it is"), ("j", "r", "lane-70"), (None, "q", "lane-7")], "incident string, run_id string, text string")
    words = packed(spark, tmp_path, [("r", "lane-7"), ("r", "lane-7"), ("r", "lane"), (None, "it")], "run_id string, word string")
    found = intake.named_words(texts, words, ["run_id"])
    assert broadcasts(found) == 1  # the row of lengths
    assert sorted((r.incident, r.word) for r in found.collect()) == [("i", "lane"), ("i", "lane-7"), ("i", "lane-7"), ("j", "lane")]
    tasks = packed(spark, tmp_path, [("r", "t", "A (C1_x)"), ("r", "u", "A (C2)"), ("r", "v", "A")], "run_id string, task string, name string")
    labels = packed(spark, tmp_path, [("C1", "n"), ("C1_x", "m"), ("C3", "o")], "label string, owner string")
    owned = triggers.entries_by_tag(tasks, labels)
    assert broadcasts(owned) == 0 and [(r.owner, r.task) for r in owned.collect()] == [("m", "t")]
