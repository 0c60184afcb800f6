"""Registered ingest jobs. Spark writes each engine's records out of the orders; the jobs read them back into tables."""

from pyspark.sql import functions as F

from catalog.policy_queries import FACTS, decided
from catalog.tables import oracle, run_sql, table
from wakeline.operators import policy
from wakeline.session import scratch_path
from wakeline.sources import calls, common, crates, files, graphs, lineage_store, platforms, records, rules, runs, workdirs

# Every order as a job that reads what an earlier one wrote, and a file of its customer.
JOBS = """SELECT o_orderkey AS k, CAST(floor(o_orderkey / 2) AS BIGINT) AS p, o_custkey AS c, substring({H}(concat('t', o_orderkey)), 1, 32) AS fid,
  substring({H}(concat('t', CAST(floor(o_orderkey / 2) AS BIGINT))), 1, 32) AS pfid FROM {orders}"""


def _jobs(spark, sf):
    return run_sql(spark, sf, JOBS)


def _doc(spark, sf, run_id, value):
    return _jobs(spark, sf).select(F.expr(run_id).alias("run_id"), F.expr(value).alias("value"))


# ---------------------------------------------------------------- documents

GRAPH_DOC = """to_json(named_struct(
  'tasks', map('a', named_struct('hash', 'a', 'name', concat('A (C', c, ')'), 'container', 'x:1', 'status', 'COMPLETED', 'superseded', k % 3 = 0, 'metrics', map('cost', k * 0.5D)),
               'b', named_struct('hash', 'b', 'name', 'B', 'container', '', 'status', '', 'superseded', false, 'metrics', map('cost', 1D))),
  'edges', array(named_struct('consumer', 'b', 'producer', 'a', 'filename', 'out.txt', 'target', '', 'digest', CAST(NULL AS STRING)),
                 named_struct('consumer', 'a', 'producer', 'EXTERNAL', 'filename', concat('c', c, '.fa'), 'target', '/in', 'digest', concat('md5:', c))),
  'outputs', map('a', array('out.txt', 'log.txt')), 'output_details', map('a', array(named_struct('file', 'out.txt', 'size', k, 'digest', concat('sha256:', fid)))),
  'coverage', array('note one', concat('note ', k % 5))))"""


def _graphs(spark, sf):
    return graphs.read_graphs(_doc(spark, sf, "concat('g', k)", GRAPH_DOC))


def read_graphs_tasks(spark, sf):
    return _graphs(spark, sf).tasks.select("run_id", "task", "name", "container", "status", "superseded", F.col("metrics")["cost"].alias("cost"))


def read_graphs_edges(spark, sf):
    return _graphs(spark, sf).edges.select("run_id", "edge_ix", "consumer", "producer", "filename", "digest")


def read_graphs_outputs(spark, sf):
    return _graphs(spark, sf).outputs.select("run_id", "task", "file", "size", "digest")


def read_assertions(spark, sf):
    docs = _doc(spark, sf, "concat('r', k)", """to_json(named_struct('released', array(
      named_struct('task', concat('o', k), 'what', 'first', 'asserted_by', 'x', 'date', '2024-01-01'),
      named_struct('task', concat('o', p), 'what', 'other', 'asserted_by', 'y', 'date', '2024-01-02'),
      named_struct('task', concat('o', k), 'what', concat('second ', c), 'asserted_by', 'z', 'date', '2024-01-03'))))""")
    return graphs.read_assertions(docs)


# Unreadable documents among good ones; what a reader says of both.

def _spoiled(spark, sf, run_id, value, *more):
    text = F.when(F.col("k") % 29 == 0, F.lit('{"broken": ')).when(F.col("k") % 31 == 0, F.lit("[1]")).when(F.col("k") % 37 == 0, F.lit(None)).otherwise(F.expr(value))
    return _jobs(spark, sf).select(*([F.expr(run_id).alias("run_id")] if run_id else []), text.alias("value"), *(F.expr(m) for m in more))


def _both(lineage):
    tasks = lineage.tasks.select("run_id", F.col("task").alias("what"), F.lit("task").alias("said"))
    return tasks.unionByName(lineage.refused.select("run_id", F.col("path").alias("what"), F.col("problem").alias("said")))


def refused_graphs(spark, sf):
    return _both(graphs.read_graphs(_spoiled(spark, sf, "concat('g', k)", """'{"tasks":{"a":{"name":"x"}}}'""")))


def graphs_from_files(spark, sf):
    """A graph document for every hundred orders, written as files by many tasks and read from their folder; some are torn."""
    root = scratch_path(spark, "graph-files")
    orders = run_sql(spark, sf, "SELECT CAST(floor(o_orderkey / 100) AS BIGINT) AS k, o_orderkey, o_orderpriority FROM {orders}")
    made = orders.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit("o"), "o_orderkey"), F.struct(F.col("o_orderpriority").alias("name"))))).alias("tasks"))
    text = F.when(F.col("k") % 7 == 3, '{"tasks":').otherwise(F.to_json(F.struct("tasks")))
    made.select("k", text.alias("value")).write.partitionBy("k").text(root)
    documents = graphs.graphs_in(spark, root, "part-*", r"^.*k=|/.*$").withColumn("run_id", F.concat(F.lit("g"), "run_id"))
    return _both(graphs.read_graphs(documents))


def refused_crates(spark, sf):
    doc = """concat('{"@graph":[{"@id":"#task/', fid, '","@type":"CreateAction","name":"S"}]}')"""
    return _both(crates.ingest_rocrate(_spoiled(spark, sf, "concat('g', k)", doc)))


def refused_rules(spark, sf):
    doc = """concat('{"rule":"r","job_hash":', k, ',"record_format_version":', CASE WHEN k % 41 = 0 THEN 99 ELSE 6 END, '}')"""
    return _both(rules.ingest_rule_metadata(_spoiled(spark, sf, "'r0'", doc, "concat('o', k) AS output")))


def refused_calls(spark, sf):
    doc = """'{"calls":{"wf.a":[{"shardIndex":-1,"attempt":1,"executionStatus":"Done"}]}}'"""
    return _both(calls.ingest_call_metadata(_spoiled(spark, sf, "concat('g', k)", doc)))


def refused_records(spark, sf):
    declared = spark.createDataFrame([], "run_id string, source string, target string, target_input string")
    runs_ = spark.createDataFrame([], "run_id string, run_directory string")
    return _both(records.ingest_run_records(_spoiled(spark, sf, None, """concat('{"run":"r0","task":{"id":"o', k, '"}}')""", "k AS record_ix"), declared, runs_))


def refused_job_describes(spark, sf):
    return _both(platforms.ingest_job_describes(_spoiled(spark, sf, "'r0'", """concat('{"id":"job-', k, '","state":"done"}')"""),
                                                _doc(spark, sf, "'r0'", """concat('{"id":"file-', k, '"}')""")))


def refused_execution_graph(spark, sf):
    none = spark.createDataFrame([], "run_id string, value string")
    literals = spark.createDataFrame([], "run_id string, task string, side string, value string")
    return _both(platforms.ingest_execution_graph(_spoiled(spark, sf, "'r0'", """concat('{"id":"n', k, '"}')"""), none, literals))


def refused_assertions(spark, sf):
    return graphs.refused_assertions(_spoiled(spark, sf, "concat('g', k)", """'{"released":[]}'"""))


# ------------------------------------------------------------- lineage store

def _history(spark, sf):
    lines = run_sql(spark, sf, "SELECT n_nationkey % 5 AS n, n_nationkey FROM {nation}").select(
        F.expr("CASE WHEN n_nationkey < 5 THEN concat('.lineage/.history/run', n) WHEN n_nationkey = 5 THEN '.lineage/.history/.DS_Store' ELSE concat('.lineage/.history/bad', n_nationkey) END").alias("path"),
        F.expr("""CASE WHEN n_nationkey <= 5 THEN concat('2024-01-0', n + 1, '\t', 'name', n, '\t', 's', CAST(n >= 3 AS INT), '\tlid://run', n, '\n') ELSE 'junk' END""").alias("value"))
    return lineage_store.parse_history(lines)


def _store(spark, sf):
    jobs = _jobs(spark, sf)
    sums = "named_struct('value', concat('v', {0}), 'algorithm', 'nextflow', 'mode', CASE WHEN {0} % 4 = 0 THEN 'standard' WHEN {0} % 4 = 1 THEN 'sha256' ELSE 'deep' END)"
    mode = lambda c: sums.replace("{0}", c)
    tasks = jobs.select(F.expr("concat(fid, '/.data.json')").alias("path"), F.expr(f"""concat('{{"version":"lineage/v1beta1","kind":"TaskRun","spec":{{"sessionId":"s', CAST(k % 5 >= 3 AS INT),
      '","workflowRun":"lid://run', k % 5, '","name":"STEP (C', c, ')","container":"x:1","script":"echo ', k, '","input":[{{"type":"path","value":["lid://', pfid, '/sub/out.txt",',
      to_json(named_struct('path', concat('/data/c', c, '.fa'), 'checksum', {mode('c')})), ']}},{{"type":"val","value":3}},{{"type":"path","value":"lid://', pfid, '/bare.txt"}}]}}}}')""").alias("value"))
    written = jobs.select(F.expr("concat(fid, '/sub/out.txt/.data.json')").alias("path"), F.expr(f"""to_json(named_struct('version', 'lineage/v1beta1', 'kind', 'FileOutput', 'spec',
      named_struct('path', concat('/work/', fid, '/sub/out.txt'), 'size', k, 'checksum', {mode('k')})))""").alias("value"))
    copies = jobs.select(F.expr("concat('run', k % 5, '/results/', k, '.txt/.data.json')").alias("path"), F.expr(f"""to_json(named_struct('kind', 'FileOutput', 'spec',
      named_struct('size', k, 'checksum', {mode('k')})))""").alias("value"))
    ran = run_sql(spark, sf, "SELECT n_nationkey AS n FROM {nation}").select(F.expr("concat('run', n, '/.data.json')").alias("path"), F.expr(
        """to_json(named_struct('kind', 'WorkflowRun', 'spec', named_struct('name', concat('name', n), 'metadata', named_struct('nextflow', named_struct('version', CASE WHEN n % 2 = 0 THEN '26.10.0-edge' ELSE '25.10.1' END)))))""").alias("value"))
    return lineage_store.ingest_lineage_store(tasks.unionByName(written).unionByName(copies).unionByName(ran), _history(spark, sf))


def parse_history(spark, sf):
    """A history file for every customer: some of another form, some not the engine's."""
    fields = "concat('2024-01-0', 1 + c_custkey % 9, '\t', c_name, '\t', 's', c_custkey % 5, '\tlid://run', c_custkey, '\n')"
    lines = run_sql(spark, sf, "SELECT c_custkey, c_name FROM {customer}").select(
        F.expr("concat('.lineage/.history/', CASE WHEN c_custkey % 13 = 0 THEN '.' ELSE '' END, 'run', c_custkey)").alias("path"),
        F.expr(f"CASE WHEN c_custkey % 11 = 0 THEN 'junk' ELSE {fields} END").alias("value"))
    return lineage_store.parse_history(lines)


def ingest_lineage_store_tasks(spark, sf):
    return _store(spark, sf).tasks.select("run_id", "task", "name", "process", "workdir", "workpath", "superseded")


def ingest_lineage_store_edges(spark, sf):
    return _store(spark, sf).edges.select("run_id", "consumer", "producer", "filename", "target", "digest")


def ingest_lineage_store_outputs(spark, sf):
    return _store(spark, sf).outputs


def ingest_lineage_store_published(spark, sf):
    return _store(spark, sf).published


def mark_superseded(spark, sf):
    tasks = _jobs(spark, sf).select(F.expr("concat('s', k % 3)").alias("session"), F.col("fid").alias("full"), F.expr("concat('STEP (C', c, ')')").alias("name"), F.expr("concat('run', k % 7)").alias("run"))
    history = run_sql(spark, sf, "SELECT concat('s', n_nationkey % 3) AS session, concat('run', n_nationkey % 6) AS run, concat('2024-01-1', n_nationkey % 6) AS timestamp FROM {nation}").distinct()
    return lineage_store.mark_superseded(tasks, history, _jobs(spark, sf).where("k % 4 = 0").select(F.col("pfid").alias("full")))


def trusted_digest(spark, sf):
    rows = run_sql(spark, sf, """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN '26.9.0' WHEN 1 THEN '26.10.1-edge' WHEN 2 THEN '26.8.99' WHEN 3 THEN '27.x' ELSE '' END AS version,
      CASE p_partkey % 3 WHEN 0 THEN 'deep' WHEN 1 THEN 'sha256' ELSE 'standard' END AS mode, p_name AS value FROM {part}""")
    return rows.select("k", lineage_store.trusted_digest(F.col("mode"), F.col("value"), lineage_store.trusted_version(F.col("version"))).alias("digest"))


# --------------------------------------------------------- events and links

WEBLOG = """SELECT concat('w', event_id % 3) AS run_id, event_id AS line_no, user_id, event_type, event_id FROM {events}"""


def weblog_lines(spark, sf):
    line = F.to_json(F.struct(F.struct(F.concat(F.lit("t"), "user_id").alias("hash"), F.concat(F.lit("STEP "), "event_id").alias("name"),
                                       F.when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "ABORTED").otherwise("RUNNING").alias("status")).alias("trace")))
    value = F.when(F.col("event_id") % 100 == 7, "{oops").when(F.col("event_id") % 100 == 8, '{"trace": {"name": "x"}}').when(F.col("event_id") % 100 == 9, "").otherwise(line)
    return run_sql(spark, sf, WEBLOG).select("run_id", "line_no", value.alias("value"))


def ingest_weblog(spark, sf):
    return workdirs.ingest_weblog(weblog_lines(spark, sf)).select("run_id", "task", "name", "status", "engine_status")


LINKS = """SELECT 'r0' AS run_id, concat('t', l_orderkey % 10, '/', lpad(CAST(l_orderkey AS {TEXT}), 6, '0')) AS task, concat('in/', l_linenumber) AS path,
  CASE l_partkey % 6 WHEN 0 THEN '/w/r0/stage-1/3e/x' WHEN 1 THEN '/w/r0/tmp/3e/x' WHEN 2 THEN '/elsewhere/x' WHEN 3 THEN '/w/r0/flat'
    WHEN 4 THEN concat('/w/r0/t', l_orderkey % 10, '/', lpad(CAST(l_orderkey AS {TEXT}), 6, '0'), 'ffff/self.txt')
    ELSE concat('/w/r0/t', l_suppkey % 10, '/', lpad(CAST(l_suppkey AS {TEXT}), 6, '0'), 'ffff/out.txt') END AS link_target,
  l_partkey AS edge_ix FROM {lineitem}"""


def edges_from_link_inventory(spark, sf):
    roots = run_sql(spark, sf, "SELECT DISTINCT 'r0' AS run_id, '/w/r0' AS root FROM {region}")
    homes = run_sql(spark, sf, """SELECT DISTINCT 'r0' AS run_id, task, concat('/w/r0/', task, 'ffff/') AS workdir FROM (
      SELECT concat('t', l_suppkey % 10, '/', lpad(CAST(l_suppkey AS {TEXT}), 6, '0')) AS task FROM {lineitem}
      UNION SELECT concat('t', l_orderkey % 10, '/', lpad(CAST(l_orderkey AS {TEXT}), 6, '0')) FROM {lineitem})""")
    return workdirs.edges_from_link_inventory(run_sql(spark, sf, LINKS), roots, homes).select("consumer", "producer", "filename", "target")


def missing_directories(spark, sf):
    return workdirs.missing_directories(table(spark, sf, "tasks"), table(spark, sf, "edges").select("run_id", F.col("consumer").alias("task")))


# -------------------------------------------------------------- other engines

CRATE_DOC = """concat('{"@graph":[{"@id":"#task/', fid, '","@type":["CreateAction"],"name":"STEP (C', c, ')","instrument":{"@id":"#tool"},"object":[{"@id":"#task/', pfid, '/sub/out.txt"},{"@id":"file:///data/c', c,
  '.fa?x=1"},"#param/3","https://h/r', c, '.gz"],"result":[{"@id":"#task/', fid, '/sub/out.txt"}]},{"@id":"#tool","@type":"SoftwareApplication","name":"tool', c % 3, '"},{"@id":"#other","@type":"CreateAction"}]}')"""


def _crates(spark, sf):
    return crates.ingest_rocrate(_doc(spark, sf, "concat('c', k)", CRATE_DOC))


def ingest_rocrate_tasks(spark, sf):
    return _crates(spark, sf).tasks.select("run_id", "task", "name", "process", "container")


def ingest_rocrate_edges(spark, sf):
    return _crates(spark, sf).edges.select("run_id", "consumer", "producer", "filename", "target")


RULE_RECORDS = """SELECT 'r0' AS run_id, concat('o', k, '/out-', i, '.dat') AS output, k, p, c, i FROM (SELECT *, {each:0, 1, 2} AS i FROM ({jobs_sql}) j) x""".replace("{jobs_sql}", JOBS)


def _rules(spark, sf):
    doc = """to_json(named_struct('rule', concat('r', k % 3), 'input', array(concat('o', p, '/out-0.dat'), concat('ext/c', c, '.fa')), 'shellcmd', concat('cmd ', k), 'job_hash', CASE WHEN k % 2 = 0 THEN k END,
      'incomplete', k % 17 = 0, 'conda_env', CASE WHEN k % 5 = 0 THEN 'env' END, 'software_stack_hash', 'abcdefabcdefabcdef', 'container_img_url', CASE WHEN k % 5 = 1 THEN 'img:1' END,
      'starttime', 10D, 'endtime', 12.5D, 'input_checksums', map(concat('o', p, '/out-0.dat'), concat('sha256:', CASE WHEN k % 7 = 0 THEN k ELSE p END))))"""
    return rules.ingest_rule_metadata(run_sql(spark, sf, RULE_RECORDS).select("run_id", "output", F.expr(doc).alias("value")))


def ingest_rule_metadata_tasks(spark, sf):
    return _rules(spark, sf).tasks.select("task", "name", "process", "container", "status", "script", F.col("metrics")["duration_s"].alias("duration"))


def ingest_rule_metadata_edges(spark, sf):
    return _rules(spark, sf).edges.select("consumer", "producer", "filename", "target", "digest")


def digests_from_consumers(spark, sf):
    return _rules(spark, sf).outputs


def decode_key(spark, sf):
    keys = run_sql(spark, sf, "SELECT doc_id, text FROM {documents}").select("doc_id", F.translate(F.regexp_replace(F.base64("text"), r"\s", ""), "+/", "-_").alias("key"))
    cut = F.concat(F.lit("@"), F.substring("key", 1, 8), F.lit("/"), F.expr("substring(key, 9)"))
    return keys.select("doc_id", rules.decode_key(cut).alias("text"))


CALL_DOC = """concat('{"workflowRoot":"/cr/o', k, '","calls":{"wf.a":[{"shardIndex":-1,"attempt":1,"executionStatus":"RetryableFailure"},{"shardIndex":-1,"attempt":2,"executionStatus":"Done","dockerImageUsed":"img@', c,
  '","commandLine":"run ', k, '","callRoot":"/cr/o', k, '/call-a","start":"2024-01-01T00:00:00.000Z","end":"2024-01-01T00:00:0', k % 10, '.500Z","callCaching":{"hit":true},"outputs":{"f":"/cr/o', k, '/a/out.txt","d":["/cr/o', k, '/a/dir"]}}],',
  '"wf.sub":[{"shardIndex":0,"subWorkflowMetadata":{"calls":{"sub.b":[{"shardIndex":1,"attempt":1,"executionStatus":"Failed","runtimeAttributes":{"docker":"d:1"},"inputs":{"x":["/cr/o', k, '/a/out.txt","/cr/o', k,
  '/a/dir/part/1.txt","/data/c', c, '.fa","plain"],"y":{"again":"/data/c', c, '.fa"}},"outputs":{}}]}}},{"shardIndex":2,"subWorkflowId":"hidden"}]}}')"""


def _calls(spark, sf):
    return calls.ingest_call_metadata(_doc(spark, sf, "concat('m', k)", CALL_DOC))


def ingest_call_metadata_tasks(spark, sf):
    return _calls(spark, sf).tasks.select("run_id", "task", "name", "container", "status", "workpath", "cached", "unexpanded_subworkflow",
                                          F.round(F.col("metrics")["duration_s"], 3).alias("duration"))


def ingest_call_metadata_edges(spark, sf):
    return _calls(spark, sf).edges.select("run_id", "consumer", "producer", "filename", "target")


RUN_RECORD = """concat('{"run":"r0","task":{"id":"o', k, '","definition_id":"step', k % 4, '","name":"N', k, '","status":"', CASE WHEN k % 9 = 0 THEN 'failed' ELSE 'completed' END, '"},"target":{"location_id":"host', c % 3, '"},"working_dir":"/runs/r0/t',
  k, '","environment":{"executor":{"kind":"docker","sha256":"0123456789abcdef"}},"code":[{"path":"main.py"}],"inputs":[{"id":"x","path":"/d/o', p, '.out"', CASE WHEN k % 6 = 0 THEN '' ELSE concat(',"sha256":"', pfid, '"') END,
  ',"labels":{"batch":"b', c % 3, '","n":5}}],"outputs":[{"id":"y","path":"/d/o', k, '.out","size":', k, ',"sha256":"', CASE WHEN k % 10 = 0 THEN pfid ELSE fid END, '","labels":{"batch":"', CASE WHEN k % 2 = 0 THEN 'late' ELSE concat('b', c % 3) END, '"}}]}')"""


def _records(spark, sf):
    rows = _jobs(spark, sf).select(F.col("k").alias("record_ix"), F.expr(RUN_RECORD).alias("value"))
    declared = _jobs(spark, sf).select(F.lit("r0").alias("run_id"), F.expr("CASE WHEN k % 8 = 0 THEN 'artifact-1' ELSE concat('o', p) END").alias("source"), F.expr("concat('o', k)").alias("target"), F.lit("x").alias("target_input"))
    return records.ingest_run_records(rows, declared, run_sql(spark, sf, "SELECT DISTINCT 'r0' AS run_id, '/runs/r0' AS run_directory FROM {region}"))


def ingest_run_records_tasks(spark, sf):
    return _records(spark, sf).tasks.select("task", "process", "container", "status", "script", "target", "workpath", F.col("labels")["batch"].alias("batch"))


def ingest_run_records_edges(spark, sf):
    return _records(spark, sf).edges.select("consumer", "producer", "filename", "digest", F.col("labels")["batch"].alias("batch"))


JOB_DOC = """concat('{"id":"job-', k, '","name":"n', k, '","executableName":"exe', k % 3, '","applet":"applet-1","state":"', CASE WHEN k % 9 = 0 THEN 'terminated' ELSE 'done' END, '","startedRunning":1000,"stoppedRunning":3500,"totalPrice":0.5',
  CASE WHEN k % 3 = 0 THEN concat(',"stage":"stage-', k, '"') ELSE '' END, ',"input":{"a":{"$dnanexus_link":"file-', p, '"},"b":[{"$dnanexus_link":{"id":"file-x', c, '","project":"p"}}],"c":{"$dnanexus_link":{"job":"job-', p,
  '","field":"out"}},"d":{"$dnanexus_link":{"stage":"stage-', p, '","outputField":"o"}}},"output":{"z":{"$dnanexus_link":"file-', k, '"}}}')"""


def _describes(spark, sf):
    described = _doc(spark, sf, "'r0'", """concat('{"id":"file-', k, '","name":"f', k, '.txt","createdBy":{"job":"job-', k, '"}}')""")
    return platforms.ingest_job_describes(_doc(spark, sf, "'r0'", JOB_DOC), described)


def ingest_job_describes_tasks(spark, sf):
    return _describes(spark, sf).tasks.select("task", "name", "process", "container", "status", F.col("metrics")["duration_s"].alias("duration"), F.col("metrics")["price"].alias("price"))


def ingest_job_describes_edges(spark, sf):
    return _describes(spark, sf).edges.select("consumer", "producer", "filename", "target")


def ingest_job_describes_coverage(spark, sf):
    return _describes(spark, sf).coverage.select("task", "references")


def _execution(spark, sf):
    nodes = _doc(spark, sf, "'r0'", """concat('{"id":"n', k, '","status":"', CASE WHEN k % 9 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END, '","cost":0.25,"startTime":"2024-01-01T00:00:00Z","resolutionTime":"2024-01-01T00:01:00Z","workflowGraphNode":{"nodeName":"step', k % 4, '"}}')""")
    workflows = run_sql(spark, sf, "SELECT DISTINCT 'r0' AS run_id, 0 AS z FROM {region}").select("run_id", F.lit('{"name":"wf","commitHash":"abc","dockerHash":"d1"}').alias("value"))
    read = _doc(spark, sf, "'r0'", """concat('{"literals":{"a":{"scalar":{"blob":{"uri":"latch://1/o', p, '/dir/x.txt"}}},"b":{"list":["latch://2/ext', c, '.fa","latch://1/o', p, '/dir/x.txt"]},"c":{"scalar":{"primitive":"text"}}}}')""")
    made = _doc(spark, sf, "'r0'", """concat('{"literals":{"o":{"scalar":{"blob":{"uri":"latch://1/o', k, '/"}}}}}')""")
    keys = lambda df, side: _jobs(spark, sf).select(F.lit("r0").alias("run_id"), F.concat(F.lit("n"), "k").alias("task"), F.lit(side).alias("side"), F.expr(df).alias("value"))
    sides = keys("""concat('{"literals":{"a":{"scalar":{"blob":{"uri":"latch://1/o', p, '/dir/x.txt"}}},"b":{"list":["latch://2/ext', c, '.fa","latch://1/o', p, '/dir/x.txt"]},"c":{"scalar":{"primitive":"text"}}}}')""", "inputs").unionByName(
        keys("""concat('{"literals":{"o":{"scalar":{"blob":{"uri":"latch://1/o', k, '/"}}}}}')""", "outputs"))
    return platforms.ingest_execution_graph(nodes, workflows, sides)


def ingest_execution_graph_tasks(spark, sf):
    return _execution(spark, sf).tasks.select("task", "name", "container", "status", "script", F.col("metrics")["duration_s"].alias("duration"))


def ingest_execution_graph_edges(spark, sf):
    return _execution(spark, sf).edges.select("consumer", "producer", "filename", "target")


def longest_parent_producer(spark, sf):
    made = _jobs(spark, sf).select(F.lit("r0").alias("run_id"), F.expr("concat('/d/', k % 100, CASE WHEN k % 3 = 0 THEN concat('/', k, '/') WHEN k % 3 = 1 THEN '' ELSE concat('/', k, '/f.txt') END)").alias("path"), F.expr("concat('o', k)").alias("producer"))
    read = _jobs(spark, sf).select(F.lit("r0").alias("run_id"), F.expr("concat('/d/', k % 130, '/', p, '/f.txt')").alias("path"))
    return common.path_producers(read, made)


# -------------------------------------------------------- catalogue and files

RUNS = """SELECT c_name AS name, {H}(c_name) AS id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('2024-01-', lpad(CAST(c_custkey % 28 + 1 AS {TEXT}), 2, '0')) END AS timestamp,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('sess', c_custkey % 40, '-', c_mktsegment) END AS session, c_custkey AS mtime FROM {customer}"""
REQUESTS = """SELECT c_name AS request FROM {customer} UNION SELECT substring({H}(c_name), 1, 3) FROM {customer} UNION SELECT substring({H}(c_name), 1, 12) FROM {customer}
UNION SELECT DISTINCT concat('sess', c_custkey % 40, '-') FROM {customer} UNION SELECT DISTINCT concat('sess', c_custkey % 40, '-', substring(c_mktsegment, 1, 3)) FROM {customer} UNION SELECT CAST(NULL AS {TEXT}) FROM {region}"""


def run_catalog(spark, sf):
    return runs.run_catalog(run_sql(spark, sf, RUNS)).select("name", "id", "timestamp", "session", "by_mtime")


def resolve_runs(spark, sf):
    return runs.resolve_runs(run_sql(spark, sf, RUNS), run_sql(spark, sf, REQUESTS))


SIDECAR = """SELECT 'r0' AS run_id, concat('o', okey) AS task, CASE WHEN okey % 9 = 0 THEN concat('extra-', k) ELSE file END AS file, concat('sha256:side', okey, k) AS digest FROM {T:outputs} o WHERE okey % 4 = 0"""
MIXED = """SELECT run_id, task, file, CASE WHEN okey % 8 = 0 THEN concat('deep:', okey) ELSE digest_before END AS digest FROM {T:outputs} o"""


def merge_sidecar_digests(spark, sf):
    return runs.merge_sidecar_digests(run_sql(spark, sf, MIXED), run_sql(spark, sf, SIDECAR))


def _digested(spark, sf):
    resolved = table(spark, sf, "tasks").select("run_id", "task", F.col("workpath").alias("rel"))
    hashed = table(spark, sf, "work").where("NOT is_dir").select("run_id", "path", "size", F.concat(F.lit("sha256:"), F.sha2("path", 256)).alias("digest"))
    given = run_sql(spark, sf, "SELECT run_id, task, file, size + 1 AS size, CASE WHEN okey % 3 = 0 THEN digest_before WHEN okey % 3 = 1 THEN 'bare' END AS digest FROM {T:outputs} o")
    return files.digest_files(given, resolved, hashed)


def digest_files(spark, sf):
    return _digested(spark, sf)


def hash_files(spark, sf):
    """A file for every twenty documents, hashed where it lies."""
    root = scratch_path(spark, "hash-files")
    texts = run_sql(spark, sf, "SELECT CAST(floor(doc_id / 20) AS BIGINT) AS k, doc_id, coalesce(text, '') AS text FROM {documents}")
    inside = texts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("d")).select("k", F.array_join("d.text", "\n").alias("value"))
    inside.write.partitionBy("k").text(root)
    found = files.hash_files(spark, root)
    return found.select(F.regexp_extract("path", r"k=(\d+)", 1).cast("bigint").alias("k"), "size", "digest", "problem")


def digest_counts(spark, sf):
    return files.digest_counts(_digested(spark, sf))


SHEET = "SELECT concat(' ', n_name) AS nation, concat('S', c_custkey % 300) AS sample FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"


def read_launch_sheet(spark, sf):
    path = scratch_path(spark, "sheet")
    run_sql(spark, sf, SHEET).write.option("header", True).csv(path)
    return files.read_launch_sheet(spark, path, "nation", "sample")


def refused_labels(spark, sf):
    return files.refused_labels(files.sheet_labels(run_sql(spark, sf, SHEET), "nation", "sample"))


def library_ids(spark, sf):
    return files.library_ids(run_sql(spark, sf, "SELECT CASE WHEN p_partkey % 7 = 0 THEN concat('# ', p_name) WHEN p_partkey % 7 = 1 THEN 'CCO' ELSE concat('CCO  m', p_partkey, ' ', p_name) END AS value FROM {part}"))


def write_receipt(spark, sf):
    """What was approved for removal, as one folder per removal; a job that runs again replaces its own."""
    plan = policy.decide(run_sql(spark, sf, FACTS), policy.decision_table(spark)).where("action IN ('DESTROY', 'PURGE')").select("run_id", "task", "action")
    odd = F.expr("CAST(substring(task, 2) AS BIGINT) % 17 = 0")
    approved = plan.withColumn("refused", F.when(odd, "copy-gone"))
    path = scratch_path(spark, "receipts")
    for action in ("DESTROY", "PURGE", "PURGE"):
        graphs.write_receipt(approved.where(F.col("action") == action), path, action.lower())
    return spark.read.schema("run_id string, task string, action string, removal string").json(path)


def write_plan(spark, sf):
    plan = policy.decide(run_sql(spark, sf, FACTS), policy.decision_table(spark)).select("run_id", "task", "action", "rule")
    path = scratch_path(spark, "plan")
    graphs.write_plan(plan, path, "run_id")
    return spark.read.schema("task string, action string, rule string, run_id string").json(path)


QUERIES = {f.__name__: f for f in (
    refused_graphs, graphs_from_files, refused_crates, refused_rules, refused_calls, refused_records, refused_job_describes, refused_execution_graph,
    refused_assertions, hash_files, read_graphs_tasks, read_graphs_edges, read_graphs_outputs, read_assertions, parse_history, ingest_lineage_store_tasks,
    ingest_lineage_store_edges, ingest_lineage_store_outputs, ingest_lineage_store_published, mark_superseded, trusted_digest, ingest_weblog,
    edges_from_link_inventory, missing_directories, ingest_rocrate_tasks, ingest_rocrate_edges, ingest_rule_metadata_tasks,
    ingest_rule_metadata_edges, digests_from_consumers, decode_key, ingest_call_metadata_tasks, ingest_call_metadata_edges,
    ingest_run_records_tasks, ingest_run_records_edges, ingest_job_describes_tasks, ingest_job_describes_edges,
    ingest_job_describes_coverage, ingest_execution_graph_tasks, ingest_execution_graph_edges, longest_parent_producer, run_catalog,
    resolve_runs, merge_sidecar_digests, digest_files, digest_counts, read_launch_sheet, refused_labels, library_ids, write_plan, write_receipt)}

# ------------------------------------------------------------------ oracles

J = "jobs AS (" + JOBS + "),"
SELF, PARENT = "concat(substring(fid, 1, 2), '/', substring(fid, 3))", "concat(substring(pfid, 1, 2), '/', substring(pfid, 3))"
SESSION = "concat('s', CAST(k % 5 >= 3 AS INT))"
# The digest a checksum of key x earns from the run that wrote it: odd runs mislabel.
SUM = "CASE WHEN k % 5 % 2 = 0 AND {x} % 4 <> 0 THEN concat('nextflow-', CASE WHEN {x} % 4 = 1 THEN 'sha256' ELSE 'deep' END, ':v', {x}) END"
# Versions of a named step: run k % 5 of its session, ordered by date.
STALE = J + f"""named AS (SELECT *, {SESSION} AS session, max(k % 5) OVER (PARTITION BY {SESSION}, c) AS newest FROM jobs),"""
VERSIONS = J + """history AS (SELECT DISTINCT concat('s', n_nationkey % 3) AS session, concat('run', n_nationkey % 6) AS run, n_nationkey % 6 AS place FROM nation),
placed AS (SELECT j.*, h.place, concat('s', k % 3) AS session FROM jobs j LEFT JOIN history h ON h.session = concat('s', k % 3) AND h.run = concat('run', k % 7)),
named AS (SELECT *, max(place) OVER (PARTITION BY session, c) AS newest, count(*) FILTER (WHERE place IS NULL) OVER (PARTITION BY session, c) AS lost FROM placed),"""
RULED = J + """outs AS (SELECT concat('r', k % 3, '/o', k, '/out-0.dat') AS task, k, p, c FROM jobs),
rule_edges AS (
  SELECT o.task AS consumer, CASE WHEN o.k = o.p THEN 'EXTERNAL' ELSE coalesce(m.task, 'EXTERNAL') END AS producer, 'out-0.dat' AS filename, concat('o', o.p, '/out-0.dat') AS target,
    concat('sha256:', CASE WHEN o.k % 7 = 0 THEN o.k ELSE o.p END) AS digest FROM outs o LEFT JOIN outs m ON m.k = o.p
  UNION ALL SELECT task, 'EXTERNAL', concat('c', c, '.fa'), concat('ext/c', c, '.fa'), NULL FROM outs),"""
REC = J + """made AS (SELECT sha, arg_min(k, k) AS k FROM (SELECT k, CASE WHEN k % 10 = 0 THEN pfid ELSE fid END AS sha FROM jobs) GROUP BY sha),"""
RESOLVED = """runs AS (""" + RUNS + """), requests AS (""" + REQUESTS + """),
keyed AS (SELECT id, session, (timestamp = '', timestamp, mtime, id) AS place, unnest(list_distinct([name, substring(id, 1, 3), substring(id, 1, 12)] ||
    CASE WHEN session IS NULL THEN [] ELSE [split_part(session, '-', 1) || '-', split_part(session, '-', 1) || '-' || substring(split_part(session, '-', 2), 1, 3)] END)) AS request FROM runs),
hits AS (SELECT q.request, count(id) AS matches, arg_max(id, place) AS newest, coalesce(min(session) = max(session) AND count(session) = count(id), false) AS one
  FROM (SELECT DISTINCT request FROM requests WHERE request IS NOT NULL) q LEFT JOIN keyed y ON y.request = q.request GROUP BY q.request),"""

_BAD = "(k % 29 = 0 OR k % 31 = 0 OR k % 37 = 0)"
# Without a name of its own a refused document is known by its text.
_TEXT = "sha256(CASE WHEN k % 29 = 0 THEN '{\"broken\": ' WHEN k % 31 = 0 THEN '[1]' ELSE '' END)"


def _refusals(run, good, bad, extra="FALSE"):
    return oracle(f"""SELECT {run} AS run_id, CASE WHEN {_BAD} OR {extra} THEN {bad} ELSE {good} END AS what,
        CASE WHEN {_BAD} THEN 'not a JSON object' WHEN {extra} THEN 'newer format' ELSE 'task' END AS said FROM ({JOBS}) jobs""")


ORACLES = {
    "refused_graphs": _refusals("concat('g', k)", "'a'", "concat('g', k)"),
    "graphs_from_files": """SELECT concat('g', o_orderkey // 100) AS run_id, concat('o', o_orderkey) AS what, 'task' AS said FROM orders WHERE o_orderkey // 100 % 7 <> 3
        UNION ALL SELECT DISTINCT concat('g', o_orderkey // 100), concat('g', o_orderkey // 100), 'not a JSON object' FROM orders WHERE o_orderkey // 100 % 7 = 3""",
    "refused_crates": _refusals("concat('g', k)", "concat(substring(fid, 1, 2), '/', substring(fid, 3))", "concat('g', k)"),
    "refused_rules": _refusals("'r0'", "concat('r/o', k)", "concat('o', k)", "k % 41 = 0"),
    "refused_calls": _refusals("concat('g', k)", "'wf.a'", "concat('g', k)"),
    "refused_records": _refusals(f"CASE WHEN NOT {_BAD} THEN 'r0' END", "concat('r0/o', k)", "CAST(k AS VARCHAR)"),
    "refused_job_describes": _refusals("'r0'", "concat('job-', k)", _TEXT),
    "refused_execution_graph": _refusals("'r0'", "concat('n', k)", _TEXT),
    "refused_assertions": oracle(f"SELECT concat('g', k) AS run_id, concat('g', k) AS path, 'not a JSON object' AS problem FROM ({JOBS}) jobs WHERE {_BAD}"),
    "hash_files": """SELECT k, octet_length(encode(v)) + 1 AS size, concat('sha256:', sha256(concat(v, chr(10)))) AS digest, NULL::VARCHAR AS problem
        FROM (SELECT (doc_id // 20)::BIGINT AS k, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS v FROM documents GROUP BY 1)""",
    "read_graphs_tasks": oracle("""SELECT concat('g', k) AS run_id, 'a' AS task, concat('A (C', c, ')') AS name, 'x:1' AS container, 'COMPLETED' AS status, k % 3 = 0 AS superseded, CAST(k * 0.5 AS DOUBLE) AS cost FROM jobs
        UNION ALL SELECT concat('g', k), 'b', 'B', '', '', false, 1.0 FROM jobs""", extra=J),
    "read_graphs_edges": oracle("""SELECT concat('g', k) AS run_id, CAST(0 AS BIGINT) AS edge_ix, 'b' AS consumer, 'a' AS producer, 'out.txt' AS filename, NULL AS digest FROM jobs
        UNION ALL SELECT concat('g', k), 1, 'a', 'EXTERNAL', concat('c', c, '.fa'), concat('md5:', c) FROM jobs""", extra=J),
    "read_graphs_outputs": oracle("""SELECT concat('g', k) AS run_id, 'a' AS task, 'out.txt' AS file, k AS size, concat('sha256:', fid) AS digest FROM jobs
        UNION ALL SELECT concat('g', k), 'a', 'log.txt', NULL, NULL FROM jobs""", extra=J),
    "read_assertions": oracle("""SELECT concat('r', k) AS run_id, concat('o', k) AS task, concat('second ', c) AS what, 'z' AS asserted_by, '2024-01-03' AS date FROM jobs
        UNION ALL SELECT concat('r', k), concat('o', p), 'other', 'y', '2024-01-02' FROM jobs WHERE p <> k""", extra=J),
    "parse_history": """SELECT concat('run', c_custkey) AS run, concat('2024-01-0', 1 + c_custkey % 9) AS timestamp, c_name AS name, concat('s', c_custkey % 5) AS session
        FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 11 <> 0""",
    "ingest_lineage_store_tasks": oracle(f"""SELECT session AS run_id, {SELF} AS task, concat('STEP (C', c, ')') AS name, 'STEP' AS process, concat('/work/', fid) AS workdir, {SELF} AS workpath,
        k % 5 < newest AND fid NOT IN (SELECT pfid FROM jobs) AS superseded FROM named""", extra=STALE),
    "ingest_lineage_store_edges": oracle(f"""SELECT {SESSION} AS run_id, {SELF} AS consumer, {PARENT} AS producer, 'sub/out.txt' AS filename, concat('lid://', pfid, '/sub/out.txt') AS target, NULL AS digest FROM jobs
        UNION ALL SELECT {SESSION}, {SELF}, {PARENT}, 'bare.txt', concat('lid://', pfid, '/bare.txt'), NULL FROM jobs
        UNION ALL SELECT {SESSION}, {SELF}, 'EXTERNAL', concat('c', c, '.fa'), concat('/data/c', c, '.fa#v', c), {SUM.replace('{x}', 'c')} FROM jobs""", extra=J),
    "ingest_lineage_store_outputs": oracle(f"SELECT {SESSION} AS run_id, {SELF} AS task, 'sub/out.txt' AS file, k AS size, {SUM.replace('{x}', 'k')} AS digest FROM jobs", extra=J),
    "ingest_lineage_store_published": oracle(f"SELECT {SESSION} AS run_id, concat('results/', k, '.txt') AS path, k AS size, {SUM.replace('{x}', 'k')} AS digest FROM jobs", extra=J),
    "mark_superseded": oracle("SELECT session, fid AS \"full\" FROM named WHERE lost = 0 AND place < newest AND fid NOT IN (SELECT pfid FROM jobs WHERE k % 4 = 0)", extra=VERSIONS),
    "trusted_digest": oracle("""SELECT p_partkey AS k, CASE WHEN p_partkey % 5 < 2 AND p_partkey % 3 < 2 THEN concat('nextflow-', CASE WHEN p_partkey % 3 = 0 THEN 'deep' ELSE 'sha256' END, ':', p_name) END AS digest FROM part"""),
    "ingest_weblog": oracle("""SELECT run_id, concat('t', user_id) AS task, concat('STEP ', max(event_id)) AS name,
        CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'UNKNOWN' END AS status,
        CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'ABORTED' ELSE 'RUNNING' END AS engine_status
        FROM w WHERE event_id % 100 NOT IN (7, 8, 9) GROUP BY run_id, user_id""", extra="w AS (" + WEBLOG + ")"),
    "edges_from_link_inventory": oracle("""SELECT task AS consumer, CASE edge_ix % 6 WHEN 3 THEN NULL WHEN 5 THEN substring(link_target, 7, 9) ELSE 'EXTERNAL' END AS producer, path AS filename, link_target AS target
        FROM l WHERE edge_ix % 6 <> 4 AND NOT (edge_ix % 6 = 5 AND substring(link_target, 7, 9) = task)""", extra="l AS (" + LINKS + ")"),
    "missing_directories": oracle("SELECT run_id, task FROM tasks WHERE task NOT IN (SELECT consumer FROM edges)", "tasks", "edges"),
    "ingest_rocrate_tasks": oracle(f"SELECT concat('c', k) AS run_id, {SELF} AS task, concat('STEP (C', c, ')') AS name, 'STEP' AS process, concat('tool', c % 3) AS container FROM jobs", extra=J),
    "ingest_rocrate_edges": oracle(f"""SELECT concat('c', k) AS run_id, {SELF} AS consumer, {PARENT} AS producer, 'sub/out.txt' AS filename, concat('#task/', pfid, '/sub/out.txt') AS target FROM jobs
        UNION ALL SELECT concat('c', k), {SELF}, 'EXTERNAL', concat('c', c, '.fa'), concat('/data/c', c, '.fa?x=1') FROM jobs
        UNION ALL SELECT concat('c', k), {SELF}, 'EXTERNAL', concat('r', c, '.gz'), concat('https://h/r', c, '.gz') FROM jobs""", extra=J),
    "ingest_rule_metadata_tasks": oracle("""SELECT task, concat('r', k % 3, ' (o', k, '/out-0.dat)') AS name, concat('r', k % 3) AS process,
        CASE k % 5 WHEN 0 THEN 'conda@abcdefabcdefabcdef' WHEN 1 THEN 'img:1' ELSE '' END AS container, CASE WHEN k % 17 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
        concat('cmd ', k) AS script, CAST(2.5 AS DOUBLE) AS duration FROM outs""", extra=RULED),
    "ingest_rule_metadata_edges": oracle("SELECT * FROM rule_edges", extra=RULED),
    "digests_from_consumers": oracle("""SELECT 'r0' AS run_id, o.task, concat('out-', i, '.dat') AS file, d.digest FROM (SELECT *, unnest([0, 1, 2]) AS i FROM outs) o
        LEFT JOIN (SELECT producer, filename, min(digest) AS digest FROM rule_edges WHERE producer <> 'EXTERNAL' GROUP BY ALL HAVING count(DISTINCT digest) = 1) d
        ON d.producer = o.task AND d.filename = concat('out-', i, '.dat')""", extra=RULED),
    "decode_key": oracle("SELECT doc_id, text FROM documents"),
    "ingest_call_metadata_tasks": oracle("""SELECT concat('m', k) AS run_id, 'wf.a' AS task, 'wf.a' AS name, concat('img@', c) AS container, 'COMPLETED' AS status, 'call-a/execution' AS workpath, true AS cached,
          false AS unexpanded_subworkflow, CAST(k % 10 + 0.5 AS DOUBLE) AS duration FROM jobs
        UNION ALL SELECT concat('m', k), 'wf.sub/shard-0/sub.b/shard-1', 'sub.b (shard 1)', 'd:1', 'FAILED', NULL, false, false, NULL FROM jobs
        UNION ALL SELECT concat('m', k), 'wf.sub/shard-2', 'wf.sub (shard 2)', '', '', NULL, false, true, NULL FROM jobs""", extra=J),
    "ingest_call_metadata_edges": oracle("""SELECT concat('m', k) AS run_id, 'wf.sub/shard-0/sub.b/shard-1' AS consumer, 'wf.a' AS producer, 'out.txt' AS filename, concat('/cr/o', k, '/a/out.txt') AS target FROM jobs
        UNION ALL SELECT concat('m', k), 'wf.sub/shard-0/sub.b/shard-1', 'wf.a', '1.txt', concat('/cr/o', k, '/a/dir/part/1.txt') FROM jobs
        UNION ALL SELECT concat('m', k), 'wf.sub/shard-0/sub.b/shard-1', 'EXTERNAL', concat('c', c, '.fa'), concat('/data/c', c, '.fa') FROM jobs""", extra=J),
    "ingest_run_records_tasks": oracle("""SELECT concat('r0/o', k) AS task, concat('step', k % 4) AS process, 'docker@0123456789abcdef' AS container, CASE WHEN k % 9 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, 'main.py' AS script,
        concat('host', c % 3) AS target, concat('t', k) AS workpath, CASE WHEN k % 2 = 0 THEN 'late' ELSE concat('b', c % 3) END AS batch FROM jobs""", extra=J),
    "ingest_run_records_edges": oracle("""SELECT concat('r0/o', j.k) AS consumer, CASE WHEN j.k % 6 <> 0 AND m.k <> j.k THEN concat('r0/o', m.k) WHEN j.k % 8 = 0 THEN 'EXTERNAL' ELSE concat('r0/o', p) END AS producer,
        concat('o', p, '.out') AS filename, CASE WHEN j.k % 6 <> 0 THEN concat('sha256:', pfid) END AS digest, concat('b', c % 3) AS batch FROM jobs j LEFT JOIN made m ON m.sha = j.pfid""", extra=REC),
    "ingest_job_describes_tasks": oracle("""SELECT concat('job-', k) AS task, concat('n', k) AS name, concat('exe', k % 3) AS process, concat('exe', k % 3, '@applet-1') AS container, CASE WHEN k % 9 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
        CAST(2.5 AS DOUBLE) AS duration, CAST(0.5 AS DOUBLE) AS price FROM jobs""", extra=J),
    "ingest_job_describes_edges": oracle("""SELECT concat('job-', k) AS consumer, CASE WHEN p = k THEN 'EXTERNAL' ELSE concat('job-', p) END AS producer, concat('f', p, '.txt') AS filename, concat('file-', p) AS target FROM jobs
        UNION ALL SELECT concat('job-', k), 'EXTERNAL', concat('file-x', c), concat('file-x', c) FROM jobs
        UNION ALL SELECT concat('job-', k), concat('job-', p), 'out', concat('job-', p, ':out') FROM jobs WHERE p <> k
        UNION ALL SELECT concat('job-', k), concat('job-', p), 'o', concat('stage-', p, ':o') FROM jobs WHERE p <> k AND p % 3 = 0""", extra=J),
    "ingest_job_describes_coverage": oracle("SELECT concat('job-', k) AS task, CAST(CASE WHEN p = k THEN 2 ELSE 1 END AS BIGINT) AS references FROM jobs WHERE p = k OR p % 3 <> 0", extra=J),
    "ingest_execution_graph_tasks": oracle("""SELECT concat('n', k) AS task, concat('step', k % 4) AS name, 'wf@d1' AS container, CASE WHEN k % 9 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, 'abc' AS script, CAST(60 AS DOUBLE) AS duration FROM jobs""", extra=J),
    "ingest_execution_graph_edges": oracle("""SELECT concat('n', k) AS consumer, CASE WHEN p = k THEN 'EXTERNAL' ELSE concat('n', p) END AS producer, 'x.txt' AS filename, concat('latch://1/o', p, '/dir/x.txt') AS target FROM jobs
        UNION ALL SELECT concat('n', k), 'EXTERNAL', concat('ext', c, '.fa'), concat('latch://2/ext', c, '.fa') FROM jobs""", extra=J),
    "longest_parent_producer": oracle("""SELECT 'r0' AS run_id, r.path, coalesce(f.by, d.by, t.by) AS producer FROM (SELECT DISTINCT concat('/d/', k % 130, '/', p, '/f.txt') AS path, k % 130 AS a, p FROM jobs) r
        LEFT JOIN (SELECT k % 100 AS a, k AS b, concat('o', k) AS by FROM jobs WHERE k % 3 = 2) f ON f.a = r.a AND f.b = r.p
        LEFT JOIN (SELECT k % 100 AS a, k AS b, concat('o', k) AS by FROM jobs WHERE k % 3 = 0) d ON d.a = r.a AND d.b = r.p
        LEFT JOIN (SELECT k % 100 AS a, min(concat('o', k)) AS by FROM jobs WHERE k % 3 = 1 GROUP BY ALL) t ON t.a = r.a""", extra=J),
    "run_catalog": oracle("SELECT name, id, timestamp, session, timestamp = '' AS by_mtime FROM runs", extra="runs AS (" + RUNS + ")"),
    "resolve_runs": oracle("""SELECT request, CASE WHEN matches = 1 OR (matches > 1 AND one) THEN newest END AS id, matches,
          CASE WHEN NOT (matches = 1 OR (matches > 1 AND one)) THEN concat('matched ', matches, ' runs') END AS problem FROM hits
        UNION ALL SELECT NULL, arg_max(id, (timestamp = '', timestamp, mtime, id)), count(*), NULL FROM runs""", extra=RESOLVED),
    "merge_sidecar_digests": oracle("""SELECT coalesce(o.run_id, s.run_id) AS run_id, coalesce(o.task, s.task) AS task, coalesce(o.file, s.file) AS file,
        CASE WHEN starts_with(o.digest, 'sha256:') THEN o.digest ELSE coalesce(s.digest, o.digest) END AS digest
        FROM m o FULL JOIN s ON o.task = s.task AND o.file = s.file""", extra="m AS (" + MIXED + "), s AS (" + SIDECAR + ")"),
    "digest_files": oracle("""SELECT o.run_id, o.task, o.file, CASE WHEN how = 'hashed' THEN o.size ELSE o.size + 1 END AS size,
        CASE how WHEN 'kept' THEN digest_before WHEN 'hashed' THEN concat('sha256:', sha256(concat('w/', okey, '/', file))) WHEN 'missing' THEN CASE WHEN okey % 3 = 1 THEN 'bare' END END AS digest, how
        FROM (SELECT *, CASE WHEN okey % 3 = 0 AND digest_before IS NOT NULL THEN 'kept' WHEN okey % 7 <> 0 AND okey % 11 <> 0 AND okey % 37 <> 0 THEN 'hashed' ELSE 'missing' END AS how FROM outputs) o""", "outputs"),
    "digest_counts": oracle("""SELECT run_id, count(*) FILTER (WHERE how = 'hashed') AS hashed, count(*) FILTER (WHERE how = 'kept') AS kept, count(*) FILTER (WHERE how = 'missing') AS missing,
        CAST(coalesce(sum(size) FILTER (WHERE how = 'hashed'), 0) AS BIGINT) AS bytes
        FROM (SELECT *, CASE WHEN okey % 3 = 0 AND digest_before IS NOT NULL THEN 'kept' WHEN okey % 7 <> 0 AND okey % 11 <> 0 AND okey % 37 <> 0 THEN 'hashed' ELSE 'missing' END AS how FROM outputs) GROUP BY run_id""", "outputs"),
    "read_launch_sheet": oracle("SELECT DISTINCT nation AS label, nation AS owner FROM s UNION SELECT sample, nation FROM s", extra="s AS (SELECT trim(nation) AS nation, sample FROM (" + SHEET + "))"),
    "refused_labels": oracle("SELECT sample AS label, count(DISTINCT nation) AS owners FROM s GROUP BY sample HAVING count(DISTINCT nation) > 1", extra="s AS (" + SHEET + ")"),
    "library_ids": oracle("SELECT DISTINCT concat('m', p_partkey) AS id FROM part WHERE p_partkey % 7 > 1"),
    "write_receipt": oracle("""SELECT 'r0' AS run_id, task, action, lower(action) AS removal FROM verdicts
        WHERE action IN ('DESTROY', 'PURGE') AND CAST(substring(task, 2) AS BIGINT) % 17 <> 0""", extra="facts AS (" + FACTS + ")," + decided("facts", "task")),
    "write_plan": oracle("SELECT 'r0' AS run_id, task, action, rule FROM verdicts", extra="facts AS (" + FACTS + ")," + decided("facts", "task")),
}
