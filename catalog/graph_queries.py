"""Registered reachability queries."""

from pyspark.sql import functions as F

from catalog.tables import oracle, run_sql, table
from wakeline.operators import graph

FWD = """fwd AS (SELECT DISTINCT producer AS task, consumer AS next FROM edges
  WHERE producer IS NOT NULL AND producer <> 'EXTERNAL' AND producer <> consumer),"""
CLOSURE = FWD + """closure(subject, task) AS (SELECT subject, task FROM segment_entries
  UNION SELECT c.subject, f.next FROM closure c JOIN fwd f ON c.task = f.task),
ends AS (SELECT task, min(subject) = max(subject) AS exclusive FROM closure GROUP BY task),
radius AS (SELECT c.subject, c.task, e.exclusive FROM closure c JOIN ends e ON c.task = e.task),"""

# Entry tasks of one bad input file: its direct consumers.
INPUT_ENTRIES = """
SELECT DISTINCT 'part-40.dat' AS subject, 'r0' AS run_id, concat('o', l_orderkey) AS task
FROM {lineitem} WHERE l_partkey = 40"""

# DuckDB keeps the first (shortest, then smallest) path met per task.
PATHS = FWD + """paths(task, hops, path) USING KEY (task) AS (
  SELECT task, 0, [task] FROM (SELECT DISTINCT concat('o', l_orderkey) AS task FROM lineitem WHERE l_partkey = 40)
  UNION
  SELECT f.next, any_value(p.hops) + 1, list_append(min(p.path), f.next)
  FROM paths p JOIN fwd f ON p.task = f.task
  WHERE NOT EXISTS (SELECT 1 FROM recurring.paths r WHERE r.task = f.next)
  GROUP BY f.next),"""


def _segments(spark, sf):
    return table(spark, sf, "segment_entries"), table(spark, sf, "edges")


def _radius(spark, sf):
    entries, edges = _segments(spark, sf)
    return graph.Closure(entries, graph.numbered(edges)).radius()


def forward_edges(spark, sf):
    return graph.forward_edges(table(spark, sf, "edges"))


def reach(spark, sf):
    return graph.reach(*_segments(spark, sf))


def reach_input(spark, sf):
    return graph.reach(run_sql(spark, sf, INPUT_ENTRIES), table(spark, sf, "edges"))


def blast_radius(spark, sf):
    return _radius(spark, sf)


def sole_subject(spark, sf):
    entries, edges = _segments(spark, sf)
    return graph.sole_subject(entries.withColumn("kind", F.lit("segment")), edges)


def evidence_paths(spark, sf):
    paths = graph.evidence_paths(run_sql(spark, sf, INPUT_ENTRIES), table(spark, sf, "edges"))
    return paths.select("run_id", "task", F.col("hops").cast("bigint").alias("hops"),
                        F.array_join("path", ">").alias("path"))


def reach_summary(spark, sf):
    entries, edges = _segments(spark, sf)
    return graph.Closure(entries, graph.numbered(edges)).summary()


def untouched(spark, sf):
    reached = reach_input(spark, sf)
    return graph.untouched(table(spark, sf, "tasks"), reached).select("run_id", "task", "process")


def files_of(spark, sf):
    return graph.files_of(_radius(spark, sf), table(spark, sf, "outputs"))


def first_files(spark, sf):
    return graph.first_files(files_of(spark, sf), 20).select(
        "subject", "scope", "file", F.col("place").cast("bigint").alias("place"), "total")


QUERIES = {
    "forward_edges": forward_edges, "reach": reach, "reach_input": reach_input,
    "blast_radius": blast_radius, "sole_subject": sole_subject, "evidence_paths": evidence_paths,
    "reach_summary": reach_summary, "untouched": untouched, "files_of": files_of, "first_files": first_files,
}

_FILES = """SELECT r.subject, CASE WHEN r.exclusive THEN 'exclusive' ELSE 'shared' END AS scope,
  concat(o.task, '/', o.file) AS file FROM radius r JOIN outputs o ON r.task = o.task"""
_INPUT_CLOSURE = FWD + """hit(task) AS (SELECT concat('o', l_orderkey) FROM lineitem WHERE l_partkey = 40
  UNION SELECT f.next FROM hit h JOIN fwd f ON h.task = f.task),"""

ORACLES = {
    "forward_edges": oracle("SELECT 'r0' AS run_id, task, next FROM fwd", "edges", extra=FWD),
    "reach": oracle("SELECT subject, 'r0' AS run_id, task FROM closure", "edges", "segment_entries",
                    extra=CLOSURE, recursive=True),
    "reach_input": oracle("SELECT 'part-40.dat' AS subject, 'r0' AS run_id, task FROM hit", "edges",
                          extra=_INPUT_CLOSURE, recursive=True),
    "blast_radius": oracle("SELECT subject, 'r0' AS run_id, task, exclusive FROM radius", "edges",
                           "segment_entries", extra=CLOSURE, recursive=True),
    "sole_subject": oracle("""SELECT 'segment' AS kind, 'r0' AS run_id, task, CASE WHEN count(*) = 1 THEN min(subject) END AS subject
        FROM closure GROUP BY task""", "edges", "segment_entries", extra=CLOSURE, recursive=True),
    "evidence_paths": oracle("""SELECT 'r0' AS run_id, task, CAST(hops AS BIGINT) AS hops,
        array_to_string(path, '>') AS path FROM paths""", "edges", extra=PATHS, recursive=True),
    "reach_summary": oracle("""
        SELECT e.subject, e.entry, r.affected, r.exclusive, r.shared FROM
        (SELECT subject, count(*) AS entry FROM segment_entries GROUP BY subject) e JOIN
        (SELECT subject, count(*) AS affected, count(*) FILTER (WHERE exclusive) AS exclusive,
           count(*) FILTER (WHERE NOT exclusive) AS shared FROM radius GROUP BY subject) r ON e.subject = r.subject""",
        "edges", "segment_entries", extra=CLOSURE, recursive=True),
    "untouched": oracle("SELECT run_id, task, process FROM tasks WHERE task NOT IN (SELECT task FROM hit)",
                        "tasks", "edges", extra=_INPUT_CLOSURE, recursive=True),
    "files_of": oracle(f"SELECT subject, scope, 'r0' AS run_id, file FROM ({_FILES})", "edges", "segment_entries",
                       "outputs", extra=CLOSURE, recursive=True),
    "first_files": oracle(f"""SELECT * FROM (SELECT subject, scope, file,
        row_number() OVER (PARTITION BY subject, scope ORDER BY file) AS place, count(*) OVER (PARTITION BY subject, scope) AS total FROM ({_FILES})) WHERE place <= 20""",
        "edges", "segment_entries", "outputs", extra=CLOSURE, recursive=True),
}
