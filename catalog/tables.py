"""
The driver's tables read as lineage. Each mapping is one SQL text that both
Spark and DuckDB run; {H} is the engine's SHA-256, {each:...} one row per listed
value, {name} a source table and {T:name} another mapped table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wakeline.operators.ledger import chain_events
from wakeline.session import COMPRESSION, scratch_path, use_utc

SOURCES = ("region nation customer supplier part orders lineitem events documents embeddings "
           "pages benchmark labels conversations").split()

_INNER = r"[^()]*"
for _ in range(4):
    _INNER = rf"(?:[^()]|\({_INNER}\))*"
HASH_CALL = re.compile(r"\{H\}\((" + _INNER + r")\)")

ISO = re.compile(r"\{ISO:([^}]*)\}")
EACH = re.compile(r"\{each:([^}]*)\}")

TABLES = {
    # One task per order.
    "tasks": """
SELECT 'r0' AS run_id, concat('o', o_orderkey) AS task, o_orderkey AS okey, o_orderpriority AS process,
  concat(o_orderpriority, ' (C', o_custkey, ')') AS name,
  concat('quay.io/org/', lower(c_mktsegment), ':1.', o_custkey % 7) AS container,
  CASE WHEN o_orderstatus = 'P' THEN 'RUNNING' WHEN o_orderkey % 17 = 0 THEN 'FAILED' ELSE 'DONE' END AS engine_status,
  CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'cmd' END AS script,
  concat('host', o_custkey % 5) AS target,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN concat('shared/', o_orderkey % 10)
       ELSE concat('w/', o_orderkey) END AS workpath,
  o_orderkey % 19 = 0 AS superseded, o_orderkey % 43 = 0 AS unexpanded_subworkflow,
  c_mktsegment AS segment, o_totalprice AS price
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # One edge per line item, from the consumer back to the producer.
    "edges": """
SELECT 'r0' AS run_id, concat('o', l_orderkey) AS consumer,
  CASE WHEN l_orderkey = 0 OR l_partkey % 4 = 0 THEN 'EXTERNAL' ELSE concat('o', l_partkey % l_orderkey) END AS producer,
  CASE WHEN l_orderkey = 0 OR l_partkey % 4 = 0 THEN concat('part-', l_partkey, '.dat')
       ELSE concat('out-', l_partkey % 3, '.dat') END AS filename,
  CASE WHEN l_orderkey <> 0 AND l_partkey % 4 <> 0 THEN ''
       WHEN l_partkey % 40 = 0 THEN concat('s3://store/part-', l_partkey, '.dat')
       WHEN l_partkey % 88 = 0 THEN ''
       ELSE concat('/data/part-', l_partkey, '.dat') END AS target,
  CASE WHEN (l_orderkey = 0 OR l_partkey % 4 = 0) AND l_partkey % 12 <> 0
       THEN concat('sha256:', {H}(concat('part-', l_partkey))) END AS digest,
  l_linenumber * 1000000000000 + l_partkey AS edge_ix, l_returnflag AS flag
FROM {lineitem}""",
    # Three files per task, with the digests of an earlier and a later run.
    "outputs": """
SELECT 'r0' AS run_id, concat('o', o_orderkey) AS task, concat('out-', k, '.dat') AS file, o_orderkey AS okey, k,
  100 + o_orderkey % 900 + k AS size,
  CASE WHEN o_orderkey % 29 = 0 AND k = 1 THEN NULL ELSE concat('sha256:', {H}(concat('o', o_orderkey, '/', k))) END AS digest_before,
  CASE WHEN o_orderkey % 31 = 0 AND k = 2 THEN NULL
       WHEN o_orderkey % 23 = 0 THEN concat('sha256:', {H}(concat('x', o_orderkey, '/', k)))
       ELSE concat('sha256:', {H}(concat('o', o_orderkey, '/', k))) END AS digest_after
FROM (SELECT o_orderkey, {each:0, 1, 2} AS k FROM {orders}) f""",
    # The same orders with image references in the spellings engines write.
    "images": """
SELECT 'r0' AS run_id, concat('o', o_orderkey) AS task,
  CASE o_orderkey % 8
    WHEN 0 THEN concat('quay.io/bio/', lower(c_mktsegment), ':1.', o_custkey % 12, '--h50ea8bc_0')
    WHEN 1 THEN concat('docker://org/aln_', lower(c_mktsegment), ':27211b8c0000aa-0')
    WHEN 2 THEN concat('depot/galaxy-', lower(c_mktsegment), '-1.', o_custkey % 12, '.sif')
    WHEN 3 THEN concat(lower(c_mktsegment), '-1.', o_custkey % 12)
    WHEN 4 THEN concat('reg:5000/org/', lower(c_mktsegment), ':latest')
    WHEN 5 THEN concat('org/', lower(c_mktsegment), '@sha256:ab', o_custkey)
    WHEN 6 THEN ''
    ELSE concat('oras://org/', lower(c_mktsegment), ':1.', o_custkey % 12) END AS container
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # The launch sheet: every customer under its nation.
    "sheet": """
SELECT concat('C', c_custkey) AS member, n_name AS owner FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # What was found on storage, in the published tree and in the release record, per task.
    "sightings": """
SELECT 'r0' AS run_id, concat('o', o_orderkey) AS task,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'DESTROYED'
       WHEN o_orderkey % 9 = 0 THEN 'WORM' ELSE 'WRITABLE' END AS storage,
  o_orderkey % 3 = 0 AS has_copies, o_orderkey % 2 = 0 AS published_checked,
  o_orderkey % 13 = 0 AS released, concat('ref-', o_custkey) AS what, concat('u', o_custkey % 5) AS asserted_by,
  '2024-01-02' AS date
FROM {orders}""",
    # Every nation is a removable subject, every segment a label that can be traced.
    "triggers": """
SELECT concat('nation:', n_name) AS trigger_id, 'nation' AS kind, n_name AS value, 'remove' AS mode FROM {nation}
UNION ALL
SELECT DISTINCT concat('segment:', c_mktsegment), 'segment', c_mktsegment, 'trace' FROM {customer}""",
    "trigger_entries": """
SELECT concat('nation:', n_name) AS trigger_id, 'r0' AS run_id, concat('o', o_orderkey) AS task
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL
SELECT concat('segment:', c_mktsegment), 'r0', concat('o', o_orderkey) FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # Two runs of the whole workflow: rb before, ra after, with tasks that came and went.
    "run_tasks": """
SELECT 'rb' AS run_id, concat('b', okey) AS task, name, process, container, script, target, superseded
FROM {T:tasks} b WHERE okey % 41 <> 0
UNION ALL
SELECT 'ra', concat('a', okey), name, process, CASE WHEN okey % 53 = 0 THEN concat(container, '-x') ELSE container END,
  CASE WHEN okey % 59 = 0 THEN 'cmd2' ELSE script END, target, superseded
FROM {T:tasks} a WHERE okey % 47 <> 0""",
    "run_edges": """
SELECT 'rb' AS run_id, concat('b', substring(consumer, 2)) AS consumer,
  CASE WHEN producer = 'EXTERNAL' THEN producer ELSE concat('b', substring(producer, 2)) END AS producer,
  filename, target, digest, edge_ix
FROM {T:edges} b
UNION ALL
SELECT 'ra', concat('a', substring(consumer, 2)),
  CASE WHEN producer = 'EXTERNAL' THEN producer ELSE concat('a', substring(producer, 2)) END,
  filename, target, CASE WHEN digest IS NOT NULL AND edge_ix % 1000000000000 % 52 = 8 THEN concat(digest, 'x') ELSE digest END, edge_ix
FROM {T:edges} a""",
    "run_outputs": """
SELECT 'rb' AS run_id, concat('b', okey) AS task, file, k AS file_ix, size, digest_before AS digest FROM {T:outputs} b
UNION ALL
SELECT 'ra', concat('a', okey), file, k, size, digest_after FROM {T:outputs} a""",
    "pairs": """
SELECT concat('p', r_regionkey) AS pair_id, CASE WHEN r_regionkey % 2 = 0 THEN 'rb' ELSE 'ra' END AS before_run,
  CASE WHEN r_regionkey % 2 = 0 THEN 'ra' ELSE 'rb' END AS after_run,
  concat('s', r_regionkey) AS before_session, concat('s', r_regionkey % 3 + r_regionkey % 2) AS after_session
FROM {region}""",
    # Documents as files: each source is a run, its documents the outputs of one task per language.
    "doc_outputs": """
SELECT source AS run_id, concat(lang, doc_id % 50) AS task, concat('doc-', doc_id, '.txt') AS file,
  concat('sha256:', {H}(text)) AS digest FROM {documents}""",
    "doc_edges": """
SELECT source AS run_id, doc_id AS edge_ix, concat('reader', doc_id % 20) AS consumer, 'EXTERNAL' AS producer,
  concat('doc-', doc_id, '.txt') AS filename, concat('/in/', doc_id) AS target,
  CASE WHEN doc_id % 10 = 0 THEN NULL ELSE concat('sha256:', {H}(text)) END AS digest FROM {documents}""",
    # A listing of a published tree: files of every third task and a folder per process.
    "inventory": """
SELECT 'r0' AS run_id, concat(task, '/', file) AS path, CASE WHEN okey % 33 = 0 THEN size + 1 ELSE size END AS size, false AS is_dir
FROM {T:outputs} f WHERE okey % 3 = 0
UNION ALL
SELECT DISTINCT 'r0', concat('dirs/', lower(c_mktsegment), '/out-2.dat'), CAST(NULL AS BIGINT), true FROM {customer}""",
    # Listings of the work tree and of the published tree, and the published digests.
    "work": """
SELECT DISTINCT 'r0' AS run_id, workpath AS path, CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS links,
  CAST(NULL AS BIGINT) AS inode, CAST(NULL AS {TEXT}) AS link_target, true AS is_dir
FROM {T:tasks} t WHERE workpath IS NOT NULL AND okey % 7 <> 0
UNION ALL
SELECT 'r0', concat('w/', okey, '/sub/', file), size, CASE WHEN okey % 8 = 0 AND k = 1 THEN 2 ELSE 1 END, okey * 10 + k,
  CASE WHEN okey % 10 = 3 AND k = 2 THEN '/data/in' END, false
FROM {T:outputs} o WHERE okey % 7 <> 0
UNION ALL
SELECT 'r0', concat('w/', okey, '/', file), size, 1, okey * 10 + k + 5, CAST(NULL AS {TEXT}), false
FROM {T:outputs} o WHERE okey % 7 <> 0""",
    "published": """
SELECT 'r0' AS run_id, concat(task, '/', file) AS path, size, digest_before AS digest, okey, k FROM {T:outputs} o WHERE okey % 3 = 0
UNION ALL
SELECT 'r0', concat('copy/', task, '.', k), size, digest_before, okey, k FROM {T:outputs} o WHERE okey % 15 = 0""",
    "results": """
SELECT run_id, path, CASE WHEN okey % 33 = 0 THEN size + 1 ELSE size END AS size,
  CASE WHEN okey % 27 = 0 THEN okey * 10 + k + 5 ELSE -1 END AS inode,
  CASE WHEN okey % 51 = 0 AND k = 0 THEN concat('w/', okey, '/out-', k, '.dat') END AS link_target
FROM {T:published} p WHERE okey % 21 <> 0""",
    "present": """
SELECT 'r0' AS run_id, concat('/data/part-', p_partkey, '.dat') AS target FROM {part} WHERE p_partkey % 9 <> 0""",
    # Facts with their times spelled as people spell them: a date, Z, another offset, no offset.
    "facts": """
SELECT 'log' AS log_id, event_id + 1 AS seq, concat('u', user_id) AS subject, event_type, concat('a', user_id % 7) AS actor,
  CASE event_id % 5 WHEN 0 THEN substring({ISO:ts}, 1, 10) WHEN 1 THEN concat(substring({ISO:ts}, 1, 19), 'Z')
    WHEN 2 THEN concat(substring({ISO:ts + INTERVAL '330' MINUTE}, 1, 19), '+05:30') WHEN 3 THEN substring({ISO:ts}, 1, 19)
    ELSE {ISO:ts} END AS effective_from,
  {ISO:ts} AS recorded_at, props AS body, concat('h', event_id) AS hash,
  CASE WHEN event_id % 5 = 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE CAST(substring({ISO:ts}, 1, 19) AS TIMESTAMP) END AS ets
FROM {events}""",
    # One log per user, to be chained in order of its events.
    "new_facts": """
SELECT concat('log', user_id) AS log_id, event_id AS ord, concat('u', user_id) AS subject, event_type, concat('a', user_id % 7) AS actor,
  {ISO:ts} AS effective_from, {ISO:ts} AS recorded_at, CASE WHEN event_id % 3 = 0 THEN concat('["é', event_id, '"]') ELSE props END AS body
FROM {events}""",
    # One entry task set per customer segment.
    "segment_entries": """
SELECT DISTINCT c_mktsegment AS subject, 'r0' AS run_id, concat('o', o_orderkey) AS task
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _expand(text: str) -> str:
    """Mapped tables named inside a mapping, put in as subqueries."""
    while "{T:" in text:
        text = re.sub(r"\{T:(\w+)\}", lambda m: f"({TABLES[m[1]]})", text)
    return text


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    use_utc(spark)
    text = _expand(text)
    used = {n: source(spark, sf_dir, n) for n in SOURCES if "{" + n + "}" in text}
    text = ISO.sub(r"concat(date_format(\1, 'yyyy-MM-dd\\'T\\'HH:mm:ss'), '+00:00')", text.replace("{TEXT}", "STRING"))
    text = HASH_CALL.sub(r"sha2(\1, 256)", EACH.sub(r"explode(array(\1))", text))
    return spark.sql(text, **used)


_STAGED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """
    A table made once per application and written to the shared folder, as the
    job that makes it would leave it; what asks for it later reads it from
    there, with its size and columns known.
    """
    use_utc(spark)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        df, path = build(), scratch_path(spark, f"table-{name}")
        df.write.parquet(path, compression=COMPRESSION)
        _STAGED[key] = (path, df.schema)
    path, schema = _STAGED[key]
    return spark.read.schema(schema).parquet(path)


_ONCE: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """What several queries of an application start from, made by the first that asks; its tables are in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ONCE:
        _ONCE[key] = build()
    return _ONCE[key]


def _mapped(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "chain":
        return chain_events(table(spark, sf_dir, "new_facts"))
    df = run_sql(spark, sf_dir, TABLES[name])
    if name == "tasks":
        df = df.withColumn("labels", F.create_map(F.lit("segment"), "segment")).withColumn(
            "metrics", F.when(F.col("okey") % 5 != 0, F.create_map(F.lit("price"), "price")))
    if name == "edges":
        df = df.withColumn("labels", F.create_map(F.lit("flag"), "flag"))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One lineage table; maps are put on in Spark, and the chained log is chained there."""
    return staged(spark, sf_dir, name, lambda: _mapped(spark, sf_dir, name))


def duck(text: str) -> str:
    """The same text as DuckDB reads it."""
    text = ISO.sub(r"strftime(\1, '%Y-%m-%dT%H:%M:%S+00:00')", _expand(text))
    text = EACH.sub(r"unnest([\1])", text).replace("{H}", "sha256").replace("{TEXT}", "VARCHAR")
    for n in SOURCES:
        text = text.replace("{" + n + "}", n)
    return text


def oracle(body: str, *names: str, extra: str = "", recursive: bool = False) -> str:
    """One DuckDB statement: the named lineage tables, any extra CTEs, then the body."""
    ctes = [f"{n} AS ({duck(TABLES[n])})" for n in names]
    if extra:
        ctes.append(duck(extra).strip().rstrip(","))
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" if ctes else ""
    return head + duck(body).strip()
