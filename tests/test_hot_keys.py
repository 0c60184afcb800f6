"""One digest of a third of all outputs: rows stay linear and reach what the bridges reach."""

from pyspark.sql import functions as F

from wakeline.operators import graph, stitch


def fixture(spark, tasks=90):
    outputs = [(f"r{i % 3}", f"t{i}", "f", "sha256:same" if i % 3 == 0 or i < 4 else f"sha256:{i}") for i in range(tasks)]
    edges = [(f"r{(i + 1) % 3}", i, f"t{i + 1}", "EXTERNAL", "f", "p", "sha256:same" if i % 3 == 0 else f"sha256:{i}") for i in range(tasks - 1)]
    edges += [(f"r{i % 3}", 1000 + i, f"t{i}", f"t{i - 3}", "f", "p", None) for i in range(3, tasks)]
    return (spark.createDataFrame(edges, "run_id string, edge_ix long, consumer string, producer string, filename string, target string, digest string"),
            spark.createDataFrame(outputs, "run_id string, task string, file string, digest string"))


def test_joined_graph_reaches_what_bridges_reach(spark):
    large = fixture(spark, 300)
    assert stitch.joined_graph(*large).count() <= large[0].count() + 4 * large[1].count() < stitch.bridges(*large).count()
    edges, outputs = fixture(spark, 18)
    linear = stitch.joined_graph(edges, outputs)
    pairs = stitch.one_graph(stitch.stitch_runs(edges, stitch.bridges(edges, outputs)))
    entries = outputs.select(F.concat_ws(":", "run_id", "task").alias("subject"), F.lit("*").alias("run_id"), F.concat_ws(":", "run_id", "task").alias("task"))
    one = graph.reach(entries, linear).where(~F.startswith("task", F.lit(stitch.DIGEST_NODE)))
    two = graph.reach(entries, pairs)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}


def test_ambiguous_bridges(spark):
    edges, outputs = fixture(spark)
    found = stitch.bridges(edges, outputs).where("candidates > 1").select("digest", "producer_run", "producer").distinct()
    assert {tuple(r) for r in stitch.ambiguous_bridges(edges, outputs).collect()} == {tuple(r) for r in found.collect()}


def test_adoptions_of_one_moment_are_cut_into_ranges(spark):
    from wakeline.operators import ledger
    columns = "log_id string, seq bigint, event_type string, subject string, body string, effective_from string, recorded_at string, actor string, hash string"
    rows = [("hot", i, ledger.POLICY_ADOPTED, f"v{i}", "{}", "2024-03-01T10:00:00Z" if i < 900 else f"2024-03-{i - 898:02}", "", "", "") for i in range(1, 905)]
    rows += [(f"log{i}", 1, ledger.POLICY_ADOPTED, "w", "{}", "2024-01-01", "", "", "") for i in range(20)]
    asked = [("hot", d) for d in ("2024-02-29", "2024-03-01T10:00:00Z", "2024-03-01", "2024-03-04", "2024-12-31")] + [("log7", "2024-06-01"), ("none", "2024-06-01")]
    found = ledger.policy_in_force(spark.createDataFrame(rows, columns), spark.createDataFrame(asked, "log_id string, as_of string"))
    got = {(r.log_id, r.as_of): r.version for r in found.collect()}
    assert got == {("hot", "2024-02-29"): None, ("hot", "2024-03-01T10:00:00Z"): "v899", ("hot", "2024-03-01"): "v899", ("hot", "2024-03-04"): "v902",
                   ("hot", "2024-12-31"): "v904", ("log7", "2024-06-01"): "w", ("none", "2024-06-01"): None}


def test_a_folder_is_written_once_however_deep_its_files_lie(spark):
    import random
    from collections import Counter
    from wakeline.operators import reclaim
    rng, want = random.Random(2), Counter()
    files = [("r", "/".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) + f"/f{i}", rng.randint(1, 9)) for i in range(300)] + [("r", "top", 5), ("s", "a/f", 1)]
    for run, path, size in files:
        parts = path.split("/")[:-1]
        for n in range(1, len(parts) + 1):
            want[run, "/".join(parts[:n])] += size
    rows = reclaim.folder_bytes(spark.createDataFrame(files, "run_id string, path string, size bigint")).collect()
    assert len(rows) == len(want) and {(r.run_id, r.rel): r.bytes for r in rows} == want
    assert reclaim.folder_bytes(spark.createDataFrame([("r", "top", 5)], "run_id string, path string, size bigint")).count() == 0


def test_ids_of_several_parts_are_found_in_a_tag(spark):
    from wakeline.operators import triggers
    tasks = spark.createDataFrame([("r", "1", "ALIGN (x/S_1-b.c)"), ("r", "2", "ALIGN (S_1)"), ("r", "3", "ALIGN")], "run_id string, task string, name string")
    ids = spark.createDataFrame([("S_1",), ("S_1-b",), ("c",), ("x/S",), ("1-b.c.d",), ("x",)], "id string")
    found = {(r.id, r.task) for r in triggers.entries_by_path_mention(tasks, ids).collect()}
    assert found == {("S_1", "1"), ("S_1-b", "1"), ("c", "1"), ("x/S", "1"), ("x", "1"), ("S_1", "2")}


def test_classes_of_a_hot_key_stay_linear_and_count_exactly(spark):
    from wakeline.operators import classes
    left = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i}", i) for i in range(300)] + [(None, -1)], "key string, a int")
    right = spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(200)] + [(None, -1)], "key string, b int")
    both = classes.factored(left, right, ["key"])
    counts = {r.key: (r.lefts, r.rights, r.pairs) for r in both.classes.collect()}
    assert counts["hot"] == (100, 100, 10000) and len(counts) == 1 + sum(1 for i in range(0, 200, 2) if i % 3)
    assert both.left.count() + both.right.count() <= 500
    for part in (7, 1000):
        pairs = [tuple(r) for r in both.pairs(part).select("key", "a", "b").collect()]
        assert sorted(pairs) == sorted(tuple(r) for r in left.join(right, "key").select("key", "a", "b").collect())


def test_bridge_classes_say_what_bridges_list(spark):
    edges, outputs = fixture(spark)
    listed = stitch.bridges(edges, outputs)
    said = stitch.bridge_classes(edges, outputs)
    assert {r.digest: r.pairs for r in said.classes.collect()} == {r.digest: r["count"] for r in listed.groupBy("digest").count().collect()}
    assert said.left.count() + said.right.count() <= edges.count() + outputs.count()


def test_starts_of_sorted_ids(spark):
    import random
    from wakeline.sources import runs
    rng = random.Random(9)
    keys = {"".join(rng.choice("abé\U0001F600") for _ in range(rng.randint(1, 6))) for _ in range(400)}
    requests = {"".join(rng.choice("abé\U0001F600") for _ in range(rng.randint(1, 4))) for _ in range(60)} | {"a", "ab", "zz"}
    found = runs.begun_by(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(r,) for r in requests], "request string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((r, k) for r in requests for k in keys if k.startswith(r))
