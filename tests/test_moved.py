import re

from wakeline.functions.digests import short
from wakeline.operators import graph, reclaim, triggers

W = "run_id string, path string, size bigint, links bigint, inode bigint, link_target string, is_dir boolean"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_outputs_with_a_published_digest_meet_the_copies(spark, monkeypatch):
    outputs = [("r", "t", "d/a", "x"), ("r", "t", "b", "x"), ("r", "t", None, "x"), ("r", "t", "c", "y"), ("r", "u", "a", None), ("q", "t", "a", "x"), (None, "t", "a", "x")]
    outputs += [("r", f"n{i}", "a", f"nowhere {i}") for i in range(50)]
    published = [("r", "p/a", "x", 1), ("r", "o/a", "x", None), ("r", "p/z", "x", 1), ("r", "p/a", "x", 1), ("r", "p/e", "", 1), ("r", "p/n", None, 1)]
    resolved = spark.createDataFrame([("r", t, f"w/{t}") for t in "tu"], "run_id string, task string, rel string")
    rows = {}

    def counted(df, label, cut=reclaim.cut):
        made, rows[label] = cut(df, label)
        return made, rows[label]

    monkeypatch.setattr(reclaim, "cut", counted)
    found = reclaim.published_copies_by_digest(
        spark.createDataFrame(outputs, "run_id string, task string, file string, digest string"),
        spark.createDataFrame(published, "run_id string, path string, digest string, size bigint"), resolved,
        spark.createDataFrame([("r", "w/t/d/a", 1, 1, 7, None, False)], W),
        spark.createDataFrame([("r", "p/a", 1, 7, None), ("r", "p/z", 2, 8, None)], "run_id string, path string, size bigint, inode bigint, link_target string"))
    of_a = [("d/a", "o/a", "missing"), ("d/a", "p/a", "hardlink"), ("d/a", "p/a", "hardlink")]
    others = [(file, path, held) for file in ("b", None) for path, held in (("o/a", "missing"), ("p/a", "digest"), ("p/a", "digest"), ("p/z", "changed"))]
    assert sorted(map(str, ((r.file, r.path, r.held) for r in found.collect()))) == sorted(map(str, of_a + others))
    assert rows["published-outputs"] == 3
    unchecked = reclaim.published_copies_by_digest(
        spark.createDataFrame(outputs, "run_id string, task string, file string, digest string"),
        spark.createDataFrame(published, "run_id string, path string, digest string, size bigint"), resolved, None, None)
    assert unchecked.where("held = 'unverified'").count() == 11


def test_short_digests_are_sixteen_bytes(spark):
    made = spark.createDataFrame([("a",), ("b",), (None,)], "x string").select(short("x").alias("s")).collect()
    assert [r.s if r.s is None else len(r.s) for r in made] == [16, 16, None] and made[0].s != made[1].s


def test_entries_of_triggers_are_summed_up_without_a_sort(spark):
    asked = spark.createDataFrame([("i", "input", "a.bam"), ("l", "lane", "1"), ("c", "container", "bwa:1.2")], "trigger_id string, kind string, value string")
    tasks = spark.createDataFrame([("r", "t", "reg/bwa:1.2", {"lane": "1"}), ("r", "u", "reg/bwa", {"lane": "2"})],
                                  "run_id string, task string, container string, labels map<string,string>").selectExpr("*", "'P' AS process", "'s' AS script", "'n' AS name")
    edges = spark.createDataFrame([("r", "t", "EXTERNAL", "a.bam", {"lane": "1"}), ("r", "t", "EXTERNAL", "a.bam.bai", {"lane": "1"}), ("r", "u", "EXTERNAL", "x/a.bam.bai", {}),
                                   ("r", "u", "t", "o", {"lane": "1"})], "run_id string, consumer string, producer string, filename string, labels map<string,string>")
    entries = triggers.resolve_triggers(asked, tasks, edges)
    assert sorted((r.trigger_id, r.task, r.how) for r in entries.collect()) == [
        ("c", "t", "exact"), ("c", "u", "name-only"), ("i", "t", "exact"), ("i", "u", "companion"), ("l", "t", "exact"), ("l", "u", "exact")]
    assert not re.search(r"SortAggregate\(key=\[trigger_id#\d+, run_id", plan_of(entries))


def test_narrow_rounds_write_what_arrives_and_leave_the_log_in_place(spark, monkeypatch):
    """One chain of six among many tasks that enter at once: from the second round on one task moves, and it may meet what entered."""
    ends = [("r", f"e{i:02}") for i in range(60)]
    chain = ["r0", "r1", "r2", "r3", "r4", "r5"]
    edges = spark.createDataFrame(
        [("r", b, a) for a, b in zip(chain, chain[1:])] + [("r", "e07", "r3"), ("r", "r1", "r4"), ("r", f"{ends[0][1]}", "e01")], "run_id string, consumer string, producer string")
    entries = spark.createDataFrame([("s", *e) for e in ends] + [("s", "r", "r0"), ("u", "r", "r3")], "subject string, run_id string, task string")
    edges = edges.unionByName(spark.createDataFrame([("r", f"x{i:02}", f"e{i:02}") for i in range(60)], edges.schema))
    labels = []

    def counted(df, label, cut=graph.cut):
        labels.append(label)
        return cut(df, label)

    monkeypatch.setattr(graph, "cut", counted)
    paths = {(r.subject, r.task): r.path for r in graph.evidence_paths(entries, edges).collect()}
    assert "moved" in labels
    assert paths["s", "r5"] == chain and paths["s", "e07"] == ["e07"] and paths["s", "r1"] == ["r0", "r1"]
    assert paths["u", "r2"] == ["r3", "r4", "r1", "r2"] and paths["u", "x07"] == ["r3", "e07", "x07"] and len(paths) == 60 * 2 + 6 + 7
    reached = {(r.subject, r.task) for r in graph.reach(entries, edges).collect()}
    assert "arriving" in labels and reached == set(paths)
    del labels[:]
    sole = {r.task: r.subject for r in graph.sole_subject(entries.withColumn("kind", graph.F.lit("k")), edges).collect()}
    assert "arriving" in labels
    assert {t for t, s in sole.items() if s is None} == {t for s, t in paths if s == "u"} and sole["r0"] == "s" and len(sole) == 126
