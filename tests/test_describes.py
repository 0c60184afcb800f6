import json

from wakeline.sources import platforms


def test_references_of_descriptions_are_walked_once(spark):
    link = lambda **what: {"$dnanexus_link": what}
    job = lambda id, **views: json.dumps({"id": id, "name": "n", "state": "done", **views})
    jobs = [
        ("r", job("j1", stage="s1", input={"a": link(job="j2", field="o"), "b": link(stage="gone", field="o")}, runInput={"a": link(job="gone", field="o")})),
        ("r", job("j2", input={"a": link(job="gone", field="o"), "b": link(job="gone", field="p")}, originalInput={"x": 1})),
        ("r", job("j3", input={"a": link(stage="s1", outputField="o"), "b": link(job="j3", field="o")})),
        ("r", job("j4", input={"a": link(job="gone")})), ("r", job("j4", input={"a": link(job="gone")})), ("q", job("j4", input={"a": link(job="j1")})),
        (None, job("j5", input={"a": link(job="gone")})), ("r", json.dumps({"name": "n", "input": {"a": link(job="gone")}})), ("r", "{torn")]
    files = spark.createDataFrame([("r", json.dumps({"id": "file-1", "name": "f", "createdBy": {"job": "j1"}}))], "run_id string, value string")
    lineage = platforms.ingest_job_describes(spark.createDataFrame(jobs, "run_id string, value string"), files)
    assert lineage.coverage._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r.run_id, r.task, r.references) for r in lineage.coverage.collect()) == [("q", "j4", 1), ("r", "j1", 1), ("r", "j3", 1), ("r", "j4", 1)]
    assert [(r.consumer, r.producer, r.filename) for r in lineage.edges.collect()] == [("j3", "j1", "o")]
