import hashlib
import time

import pytest
from pyspark.sql import functions as F

from wakeline.operators import drift, evidence, ledger, reclaim, stitch
from wakeline.sources import crates, files, graphs
from wakeline.streaming.common import latest_state, start_upserts
from wakeline.streaming.gate import stream_gate_now

T = "run_id string, task string, name string, process string, target string, container string, script string, superseded boolean"
E = "run_id string, consumer string, producer string, filename string, digest string, edge_ix bigint"
O = "run_id string, task string, file string, file_ix int, digest string"


def runs(spark, tasks, edges, outputs):
    pairs = spark.createDataFrame([("p", "b", "a")], "pair_id string, before_run string, after_run string")
    full = [(r, t, n, "P", "", c, s, False) for r, t, n, c, s in tasks]
    items = drift.drift(pairs, spark.createDataFrame(full, T), spark.createDataFrame(edges, E), spark.createDataFrame(outputs, O))
    return items, {r.task: (r.verdict, r.cause) for r in items.items.collect()}


def test_root_downstream_unsettled_and_reproduced(spark):
    names = ["root", "down", "same", "blind", "after_blind"]
    tasks = [(r, f"{r}{n}", n, "x:1", "s" if (r, n) != ("a", "root") else "s2") for r in "ba" for n in names]
    edges = [(r, f"{r}{c}", f"{r}{p}", "o", None, 0) for r in "ba" for p, c in [("root", "down"), ("root", "same"), ("blind", "after_blind")]]
    outputs = [(r, f"{r}{n}", "o", 0, None if n == "blind" else "sha256:1" if n == "same" or r == "b" else "sha256:2") for r in "ba" for n in names]
    found, verdicts = runs(spark, tasks, edges, outputs)
    assert {k: v[0] for k, v in verdicts.items()} == {"aroot": "DRIFTED", "adown": "DOWNSTREAM", "asame": "REPRODUCED", "ablind": "UNVERIFIED", "aafter_blind": "UNSETTLED"}
    assert verdicts["aroot"][1] == "script"
    assert sorted((r.task, r.producer) for r in found.follows.collect()) == [("aafter_blind", "ablind"), ("adown", "aroot"), ("asame", "aroot")]


def test_repeated_names_pair_by_what_they_read_then_by_elimination(spark):
    tasks = [(r, f"{r}{i}", "N", "x", "s") for r in "ba" for i in (1, 2, 3)]
    reads = {"b1": "d1", "b2": "d2", "b3": None, "a1": "d2", "a2": "d1", "a3": "d9"}
    edges = [(t[0], t, "EXTERNAL", "f", d, 0) for t, d in reads.items()]
    found, _ = runs(spark, tasks, edges, [(t[0], t, "o", 0, "sha256:1") for t in reads])
    assert sorted((r.before, r.after) for r in found.items.collect()) == [("b1", "a2"), ("b2", "a1"), ("b3", "a3")]


def test_one_digest_of_several_producers_bridges_to_each_and_never_home(spark):
    outputs = spark.createDataFrame([("r1", "t1", "f", "d"), ("r1", "t2", "f", "d"), ("r2", "own", "f", "d")], "run_id string, task string, file string, digest string")
    edges = spark.createDataFrame([("r2", 0, "c", "EXTERNAL", "f", "", "d"), ("r2", 1, "c", "EXTERNAL", "g", "", None)],
                                  "run_id string, edge_ix bigint, consumer string, producer string, filename string, target string, digest string")
    found = stitch.bridges(edges, outputs)
    assert sorted((r.producer, r.candidates) for r in found.collect()) == [("t1", 2), ("t2", 2)]
    assert stitch.stitch_runs(edges, found).count() == 3


def test_a_loop_of_gone_producers_is_not_recomputable(spark):
    tasks = spark.createDataFrame([("r", t, "s", "c") for t in "xyzw"], "run_id string, task string, script string, container string")
    edges = spark.createDataFrame([("r", "x", "y", "f", "", 0), ("r", "y", "x", "f", "", 0), ("r", "z", "x", "f", "", 0), ("r", "w", "EXTERNAL", "f", "/in/f#1", 0)],
                                  "run_id string, consumer string, producer string, filename string, target string, edge_ix bigint")
    resolved = spark.createDataFrame([("r", t, t, t == "w") for t in "xyzw"], "run_id string, task string, rel string, on_disk boolean")
    present = spark.createDataFrame([("r", "/in/f")], "run_id string, target string")
    done = {r.task: (r.recomputable, r.why) for r in reclaim.recomputable(tasks, edges, resolved, present).collect()}
    assert done == {"x": (False, "loop"), "y": (False, "loop"), "z": (False, "loop"), "w": (True, "recipe-known")}


def test_nothing_found_under_a_root_says_the_root_is_wrong(spark):
    tasks = spark.createDataFrame([("r", "a", "", "d/a"), ("r", "b", "", "d/b")], "run_id string, task string, workdir string, workpath string")
    none = spark.createDataFrame([], "run_id string, path string, is_dir boolean")
    assert {r.storage for r in reclaim.storage_state(reclaim.resolve_workpaths(tasks, none)).collect()} == {None}


LOG = "log_id string, ord bigint, subject string, event_type string, actor string, effective_from string, recorded_at string, body string"


def test_a_chain_verifies_until_it_is_edited_cut_or_short(spark):
    facts = spark.createDataFrame([(f"l{n % 2}", n, "s", "T", "Zoë", "2024-01-01", "2024-01-01", '{"a":1}') for n in range(20)], LOG)
    chain = ledger.chain_events(facts)
    assert {r.log_id: (r.ok, r.entries) for r in ledger.verify_chain(chain).collect()} == {"l0": (True, 10), "l1": (True, 10)}
    cases = {"content": (chain.withColumn("body", F.when(F.col("seq") == 4, "x").otherwise(F.col("body"))), (False, 3, 4, ledger.EDITED)),
             "gap": (chain.where("seq <> 4"), (False, 3, 5, ledger.SEQUENCE)),
             "cut": (chain.withColumn("prev_hash", F.when(F.col("seq") == 4, "x").otherwise(F.col("prev_hash"))), (False, 3, 4, ledger.CUT))}
    for spoiled, want in cases.values():
        assert {(r.ok, r.entries, r.broken_at, r.reason) for r in ledger.verify_chain(spoiled).collect()} == {want}
    later = ledger.chain_events(facts, ledger.log_head(chain))
    starts = ledger.log_head(chain).select("log_id", (F.col("seq") + 1).alias("start_seq"), F.col("hash").alias("start_prev"))
    assert all(r.ok and r.entries == 10 for r in ledger.verify_chain(later, starts).collect())


def test_the_gate_goes_by_instants_then_log_order_and_unknown_is_not_clear(spark):
    rows = [(1, "x", "bad", "2024-05-01T09:00:00+05:00"), (2, "x", "good", "2024-05-01T05:00:00Z"), (3, "y", "bad", "2024-05-02"), (4, "z", "good", "2024-05-01"),
            (5, "z", "bad", "2024-05-01")]
    facts = spark.createDataFrame([(q, s, t, f, "a") for q, s, t, f in rows], "seq bigint, subject string, event_type string, effective_from string, actor string")
    subjects = spark.createDataFrame([(s,) for s in "xyzq"], "subject string")
    said = {r.subject: r.status for r in ledger.gate(subjects, facts, ["bad"], ["good"], "2024-05-01").collect()}
    assert said == {"x": "CLEARED", "y": "UNKNOWN", "z": "BLOCKED", "q": "UNKNOWN"}
    with pytest.raises(ValueError):
        ledger.gate(subjects, facts, ["bad"], ["bad"], "2024-05-01")


def test_a_waiting_fact_takes_effect_by_itself(spark, tmp_path):
    soon = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(time.time() + 12))
    rows = [(1, "x", "good", "2024-01-01", "a"), (2, "x", "bad", soon, "a")]
    schema = "seq bigint, subject string, event_type string, effective_from string, actor string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    changes = stream_gate_now(stream, ["bad"], ["good"])
    query = start_upserts(changes, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    seen, deadline = [], time.time() + 60
    while time.time() < deadline and seen[-1:] != ["BLOCKED"]:
        time.sleep(1)
        try:
            now = [r.status for r in latest_state(spark.read.parquet(str(tmp_path / "out")), "subject").collect()]
        except Exception:
            continue
        seen += [s for s in now if s not in seen]
    query.stop()
    assert seen[-1] == "BLOCKED"


def test_bundles_from_files(spark, tmp_path):
    import json
    text = json.dumps({"a": 1})
    sha = hashlib.sha256(text.encode()).hexdigest()
    rows = [("good", "a.json", text), ("good", "manifest.json", json.dumps({"files": {"a.json": sha}})),
            ("up", "manifest.json", json.dumps({"files": {"../a.json": sha}})), ("torn", "a.json", "{"), ("torn", "manifest.json", json.dumps({"files": {"a.json": "x"}})),
            ("loose", "a.json", text)]
    loaded = evidence.load_bundles(spark.createDataFrame(rows, "bundle string, name string, content string"))
    assert {r.bundle for r in loaded.collect()} == {"good"}


def test_files_of_any_size_are_hashed_in_pieces(spark, tmp_path):
    inside = {"sub dir/a é.bin": b"x" * 3_000_000, "b%20c": b"y", "d": b"z"}
    (tmp_path / "sub dir").mkdir()
    for name, value in inside.items():
        (tmp_path / name).write_bytes(value)
    want = {(name, len(v), "sha256:" + hashlib.sha256(v).hexdigest(), None) for name, v in inside.items()}
    for root in (str(tmp_path), f"file://{tmp_path}"):
        assert {tuple(r) for r in files.hash_files(spark, root, tasks=2).collect()} == want
    listed = files.hash_files(spark, str(tmp_path))
    (tmp_path / "d").chmod(0)
    (tmp_path / "d").unlink()
    (tmp_path / "d").mkdir()
    assert {r.path: r.problem is None for r in listed.collect()} == {"sub dir/a é.bin": True, "b%20c": True, "d": False}


def test_graph_documents_and_receipts_as_files(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "run1.json").write_text('{"tasks":{"a":{"hash":"a","name":"A"}},"edges":[],"outputs":{"a":["f"]}}')
    tables = graphs.read_graphs(graphs.graphs_in(spark, str(tmp_path / "g")))
    assert [(r.run_id, r.task, r.name) for r in tables.tasks.collect()] == [("run1", "a", "A")]
    approved = spark.createDataFrame([("r", "a", None), ("r", "b", "no")], "run_id string, task string, refused string")
    for _ in range(2):  # a job that runs again writes the same receipt
        graphs.write_receipt(approved, str(tmp_path / "receipt"), "first")
    assert [r.task for r in spark.read.json(str(tmp_path / "receipt")).collect()] == ["a"]


def test_a_window_follows_its_head():
    from wakeline.streaming.chain import follow
    window = [(3, "b", "c", True), (2, "a", "b", True)]
    assert follow(window, 1, "a") == (None, None, 2, "c")
    assert follow(window, 0, "0" * 64)[:3] == (2, "sequence", 0)
    assert follow([(2, "x", "b", True)], 1, "a")[:3] == (2, "link", 0)
    assert follow([*window, (4, "c", "d", False)], 1, "a")[:3] == (4, "content", 2)
    assert follow([*window, (3, "b", "c", True)], 1, "a")[:3] == (3, "sequence", 1)
    assert follow([(None, "a", "b", True)], 1, "a")[:3] == (0, "sequence", 0)
    assert follow([], 1, "a") == (None, None, 0, "a")


def test_tools_of_all_crates_are_not_sent_to_every_task(spark, capsys):
    doc = """{"@graph":[{"@id":"#task/abcd","@type":"CreateAction","name":"S","instrument":{"@id":"#t"}},{"@id":"#t","name":"one"},
        {"@id":"#t","name":"two"},{"@id":"#task/ef","@type":"CreateAction","name":"U"}]}"""
    found = crates.ingest_rocrate(spark.createDataFrame([("r", doc), (None, doc)], "run_id string, value string")).tasks
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out
    rows = [(r.run_id, r.task, r.container) for r in found.collect()]
    assert sorted(rows, key=str) == sorted([("r", "ab/cd", "one"), ("r", "ab/cd", "two"), ("r", "ef/", ""), (None, "ab/cd", ""), (None, "ef/", "")], key=str)
