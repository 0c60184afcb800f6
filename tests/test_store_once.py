import json

from wakeline.sources import lineage_store


def test_records_of_a_store_are_parsed_once(spark):
    record = lambda kind, **spec: json.dumps({"version": "v", "kind": kind, "spec": spec})
    run = record("WorkflowRun", metadata={"nextflow": {"version": "26.10.0"}})
    first = record("TaskRun", sessionId="s", workflowRun="lid://r1", name="A (x)", input=[{"type": "path", "value": ["/in/a", {"path": "/in/b"}]}])
    later = record("TaskRun", sessionId="s", workflowRun="lid://r2", name="A (x)", input=[{"type": "path", "value": "lid://cd2/o.txt"}])
    wrote = record("FileOutput", path="/work/ab1/o.txt", size=3, checksum={"value": "z", "algorithm": "n", "mode": "deep"})
    files = spark.createDataFrame([("r1/.data.json", run), ("r2/.data.json", run), ("ab1/.data.json", first), ("cd2/.data.json", later), ("ab1/o.txt/.data.json", wrote),
                                   ("ef3/.data.json", "{torn"), ("gh4/.data.json", record("Other")), ("ab1/note", first), (None, first)], "path string, value string")
    history = spark.createDataFrame([("r1", "1", "a", "s"), ("r2", "2", "b", "s")], "run string, timestamp string, name string, session string")
    lineage = lineage_store.ingest_lineage_store(files, history)
    for df in (lineage.tasks, lineage.edges, lineage.outputs, lineage.published):
        assert "from_json" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.task, r.process, r.workdir, r.superseded) for r in lineage.tasks.collect()) == [("ab/1", "A", "/work/ab1", True), ("cd/2", "A", "", False)]
    assert sorted((r.consumer, r.producer, r.filename) for r in lineage.edges.collect()) == [("ab/1", "EXTERNAL", "b"), ("cd/2", "cd/2", "o.txt")]
    assert [(r.task, r.file, r.size, r.digest) for r in lineage.outputs.collect()] == [("ab/1", "o.txt", 3, "nextflow-deep:z")]
