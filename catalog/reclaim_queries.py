"""Registered queries over stored task directories."""

from pyspark.sql import functions as F

from catalog.tables import oracle, staged, table
from wakeline.operators import reclaim as r


def _tasks(spark, sf):
    return table(spark, sf, "tasks").withColumn("status", F.col("engine_status")).withColumn("workdir", F.lit(""))


def _outputs(spark, sf):
    return table(spark, sf, "outputs").withColumnRenamed("digest_before", "digest")


def _resolved(spark, sf):
    return staged(spark, sf, "resolved", lambda: _resolved_made(spark, sf))


def _resolved_made(spark, sf):
    return r.resolve_workpaths(_tasks(spark, sf), table(spark, sf, "work"))


def _copies(spark, sf):
    return staged(spark, sf, "copies", lambda: _copies_made(spark, sf))


def _copies_made(spark, sf):
    return r.published_copies_by_digest(_outputs(spark, sf), table(spark, sf, "published"), _resolved(spark, sf),
                                        table(spark, sf, "work"), table(spark, sf, "results"))


def _rerun(spark, sf):
    return staged(spark, sf, "rerun", lambda: _rerun_made(spark, sf))


def _rerun_made(spark, sf):
    return r.recomputable(_tasks(spark, sf), table(spark, sf, "edges"), _resolved(spark, sf), table(spark, sf, "present"))


def _plan(spark, sf, intermediates=True, target=None):
    resolved = _resolved(spark, sf)
    return r.reclaim_plan(
        _tasks(spark, sf), table(spark, sf, "edges"), _outputs(spark, sf), resolved, r.copy_verdicts(_copies(spark, sf)),
        r.dir_bytes(resolved, table(spark, sf, "work")), _rerun(spark, sf) if intermediates else None, target=target)


def resolve_workpaths(spark, sf):
    return _resolved(spark, sf)


def placement_warnings(spark, sf):
    return r.placement_warnings(_tasks(spark, sf), _resolved(spark, sf))


def storage_state(spark, sf):
    return r.storage_state(_resolved(spark, sf))


def dir_bytes(spark, sf):
    return r.dir_bytes(_resolved(spark, sf), table(spark, sf, "work"))


def dir_bytes_object_store(spark, sf):
    return r.dir_bytes(_resolved(spark, sf), table(spark, sf, "work"), object_store=True)


def published_copies_by_digest(spark, sf):
    return _copies(spark, sf)


def published_copies_unchecked(spark, sf):
    return r.copy_verdicts(r.published_copies_by_digest(
        _outputs(spark, sf), table(spark, sf, "published"), _resolved(spark, sf), table(spark, sf, "work"), None))


def copy_verdicts(spark, sf):
    return r.copy_verdicts(_copies(spark, sf))


def consumed_outputs(spark, sf):
    return r.consumed_outputs(table(spark, sf, "edges"))


def loose_outputs(spark, sf):
    return r.loose_outputs(_outputs(spark, sf), table(spark, sf, "edges")).select("run_id", "task", "file")


def recomputable(spark, sf):
    return _rerun(spark, sf).select("run_id", "task", "recomputable", "why")


_ITEM = ["run_id", "task", "process", "target", "rel", "verdict", "cause", "files", "bytes"]


def reclaim_plan(spark, sf):
    return _plan(spark, sf).select(_ITEM)


def reclaim_plan_cautious(spark, sf):
    return _plan(spark, sf, intermediates=False, target="host3").select(_ITEM)


def reclaim_cause_files(spark, sf):
    edges, outputs, copies = table(spark, sf, "edges"), _outputs(spark, sf), r.copy_verdicts(_copies(spark, sf))
    return r.cause_files(_plan(spark, sf, intermediates=False), outputs, copies, edges)


def reclaim_summary(spark, sf):
    return r.reclaim_summary(_plan(spark, sf))


def reclaim_by_cause(spark, sf):
    return r.reclaim_by_cause(_plan(spark, sf, intermediates=False))


def recheck_before_removal(spark, sf):
    fresh = table(spark, sf, "published").where("okey % 14 <> 0").withColumn(
        "digest", F.when(F.col("okey") % 5 == 4, F.concat("digest", F.lit("0"))).otherwise(F.col("digest")))
    return r.recheck_before_removal(_plan(spark, sf, intermediates=False), _copies(spark, sf), table(spark, sf, "published"), fresh)


QUERIES = {f.__name__: f for f in (
    resolve_workpaths, placement_warnings, storage_state, dir_bytes, dir_bytes_object_store, published_copies_by_digest,
    published_copies_unchecked, copy_verdicts, consumed_outputs, loose_outputs, recomputable, reclaim_plan,
    reclaim_plan_cautious, reclaim_cause_files, reclaim_summary, reclaim_by_cause, recheck_before_removal)}

RESOLVED = """resolved AS (SELECT run_id, task, why, CASE WHEN why IS NULL THEN workpath END AS rel, why IS NULL AND found AS on_disk FROM (
  SELECT t.run_id, t.task, workpath, d.path IS NOT NULL AS found, CASE WHEN workpath IS NULL THEN 'unplaced'
    WHEN count(*) OVER (PARTITION BY workpath) > 1 THEN 'shared' END AS why
  FROM tasks t LEFT JOIN (SELECT path FROM work WHERE is_dir) d ON d.path = workpath)),"""
BYTES = """sized AS (SELECT r.task, coalesce(sum(CASE WHEN {keep} THEN w.size END), 0) AS bytes FROM resolved r
  LEFT JOIN work w ON NOT w.is_dir AND regexp_extract(w.path, '^w/[0-9]+') = r.rel WHERE r.on_disk GROUP BY r.task),"""
_LOCAL_BYTES = BYTES.replace("{keep}", "links = 1 AND link_target IS NULL")
COPIES = """found AS (SELECT o.run_id, o.task, o.file, p.path, p.size AS dsize, regexp_extract(p.path, '[^/]*$') = o.file AS named
  FROM outputs o JOIN published p ON p.digest = o.digest_before),
best AS (SELECT *, max(named) OVER (PARTITION BY task, file) AS best FROM found),
held AS (SELECT b.run_id, b.task, b.file, b.path, CASE WHEN s.path IS NULL THEN 'missing' WHEN s.link_target = concat(r.rel, '/', b.file) THEN 'symlink'
    WHEN s.link_target IS NULL AND s.inode = w.inode THEN 'hardlink' WHEN b.dsize <> s.size THEN 'changed' ELSE 'digest' END AS held
  FROM best b JOIN resolved r ON r.task = b.task LEFT JOIN results s ON s.path = b.path
  LEFT JOIN work w ON NOT w.is_dir AND w.path = concat(r.rel, '/', b.file) WHERE b.named = b.best),
copies AS (SELECT run_id, task, file, coalesce(arg_min(held, path) FILTER (WHERE held IN ('digest', 'hardlink')),
    CASE WHEN bool_or(held = 'changed') THEN 'changed' WHEN bool_or(held = 'symlink') THEN 'symlink' ELSE 'none' END) AS verdict,
  count(*) FILTER (WHERE held <> 'missing') AS copies FROM held GROUP BY ALL),"""
FED = """consumed AS (SELECT DISTINCT run_id, producer AS task, filename AS file FROM edges WHERE producer <> 'EXTERNAL' AND producer <> consumer),
"""
RERUN = """ext AS (SELECT consumer AS task, edge_ix, target, contains(target, '://') AS remote, p.target IS NOT NULL AS there
  FROM (SELECT consumer, edge_ix, target FROM edges WHERE producer = 'EXTERNAL') e LEFT JOIN present p USING (target)),
failing AS (SELECT task, edge_ix, CASE WHEN remote THEN concat('remote-input:', regexp_extract(target, '[^/]*$'))
    ELSE concat('absent-input:', coalesce(nullif(regexp_extract(target, '[^/]*$'), ''), '?')) END AS code FROM ext WHERE remote OR NOT there),
base AS (SELECT t.task, script <> '' AS recipe, script = '' OR t.task IN (SELECT task FROM failing) AS own FROM tasks t),
gone AS (SELECT e.consumer, e.producer, e.edge_ix FROM edges e JOIN resolved r ON r.task = e.producer WHERE NOT r.on_disk AND e.consumer <> e.producer),
blocked(task) AS (SELECT task FROM base WHERE own UNION SELECT g.consumer FROM blocked b JOIN gone g ON g.producer = b.task),
causes AS (SELECT task, arg_min(code, edge_ix) AS code FROM (SELECT * FROM failing
  UNION ALL SELECT consumer, edge_ix, concat('blocked-by:', producer) FROM gone WHERE producer IN (SELECT task FROM blocked)) GROUP BY task),
rerun AS (SELECT base.task, b.task IS NULL AS recomputable, CASE WHEN NOT recipe THEN 'no-recipe' WHEN b.task IS NULL THEN 'recipe-known' ELSE c.code END AS why
  FROM base LEFT JOIN blocked b USING (task) LEFT JOIN causes c USING (task)),"""
PLAN = RESOLVED + _LOCAL_BYTES + COPIES + FED + RERUN + """
flags AS (SELECT o.task, count(*) AS n, count(*) FILTER (WHERE o.digest_before IS NULL) AS nodig,
  count(*) FILTER (WHERE c.verdict = 'symlink') AS sym, count(*) FILTER (WHERE c.verdict = 'changed') AS chg,
  count(*) FILTER (WHERE c.verdict IN ('digest', 'hardlink')) AS settled,
  count(*) FILTER (WHERE coalesce(c.verdict, '') NOT IN ('digest', 'hardlink') AND u.file IS NULL) AS loose
  FROM outputs o LEFT JOIN copies c ON c.task = o.task AND c.file = o.file LEFT JOIN consumed u ON u.task = o.task AND u.file = o.file GROUP BY o.task),
facts AS (SELECT t.run_id, t.task, t.process, t.target, r.rel, r.on_disk, superseded, engine_status, t.task IN (SELECT task FROM consumed) AS fed,
  f.*, q.recomputable, q.why, coalesce(b.bytes, 0) AS bytes
  FROM tasks t JOIN resolved r ON r.task = t.task JOIN flags f ON f.task = t.task JOIN rerun q ON q.task = t.task LEFT JOIN sized b ON b.task = t.task),
ruled AS (SELECT *, CASE WHEN rel IS NULL THEN 1 WHEN NOT on_disk THEN 2 WHEN superseded AND fed THEN 3 WHEN superseded THEN 4
  WHEN engine_status = 'FAILED' AND fed THEN 5 WHEN engine_status = 'FAILED' THEN 6 WHEN engine_status = 'RUNNING' THEN 7
  WHEN nodig > 0 THEN 8 WHEN sym > 0 THEN 9 WHEN chg > 0 THEN 10 WHEN settled = n THEN 11
  WHEN {stop} THEN 12 WHEN loose > 0 THEN 13 WHEN recomputable THEN 14 ELSE 15 END AS rule FROM facts),
plan AS (SELECT run_id, task, process, target, rel, CASE rule WHEN 2 THEN 'GONE' WHEN 4 THEN 'SUPERSEDED' WHEN 6 THEN 'FAILED'
    WHEN 11 THEN 'REDUNDANT' WHEN 14 THEN 'INTERMEDIATE' ELSE 'KEEP' END AS verdict,
  CASE rule WHEN 1 THEN 'no-place' WHEN 2 THEN 'no-directory' WHEN 3 THEN 'superseded-but-read'
    WHEN 4 THEN 'superseded-mark' WHEN 5 THEN 'failed-but-read:FAILED' WHEN 6 THEN 'failed:FAILED'
    WHEN 7 THEN 'unfinished:RUNNING' WHEN 8 THEN 'no-digest' WHEN 9 THEN 'copy-is-link'
    WHEN 10 THEN 'copy-size-differs' WHEN 11 THEN 'all-published'
    WHEN 12 THEN 'unpublished' WHEN 13 THEN 'end-unpublished' ELSE why END AS cause,
  CASE rule WHEN 8 THEN nodig WHEN 9 THEN sym WHEN 10 THEN chg WHEN 12 THEN n - settled WHEN 13 THEN loose ELSE 0 END AS files,
  CAST(CASE WHEN rule = 2 THEN 0 ELSE bytes END AS BIGINT) AS bytes FROM ruled),"""
FULL, CAUTIOUS = PLAN.replace("{stop}", "false"), PLAN.replace("{stop}", "true")
_P = ("tasks", "edges", "outputs", "work", "published", "results", "present")

ORACLES = {
    "resolve_workpaths": oracle("SELECT run_id, task, rel, on_disk, why FROM resolved", "tasks", "work", extra=RESOLVED),
    "placement_warnings": oracle("""SELECT 'r0' AS run_id, 'shared' AS why, count(*) AS tasks, count(DISTINCT workpath) AS directories
        FROM resolved JOIN tasks USING (task) WHERE why = 'shared'""", "tasks", "work", extra=RESOLVED),
    "storage_state": oracle("""SELECT run_id, task, CASE WHEN rel IS NOT NULL THEN CASE WHEN on_disk THEN 'WRITABLE' ELSE 'DESTROYED' END END AS storage
        FROM resolved""", "tasks", "work", extra=RESOLVED),
    "dir_bytes": oracle("SELECT 'r0' AS run_id, task, CAST(bytes AS BIGINT) AS bytes FROM sized", "tasks", "work", extra=RESOLVED + _LOCAL_BYTES),
    "dir_bytes_object_store": oracle("SELECT 'r0' AS run_id, task, CAST(bytes AS BIGINT) AS bytes FROM sized", "tasks", "work",
                                     extra=RESOLVED + BYTES.replace("{keep}", "true")),
    "published_copies_by_digest": oracle("SELECT * FROM held", "tasks", "outputs", "work", "published", "results", extra=RESOLVED + COPIES),
    "published_copies_unchecked": oracle("""SELECT run_id, task, file, 'unverified' AS verdict, count(*) AS copies FROM best
        WHERE named = best GROUP BY ALL""", "tasks", "outputs", "work", "published", "results", extra=RESOLVED + COPIES),
    "copy_verdicts": oracle("SELECT * FROM copies", "tasks", "outputs", "work", "published", "results", extra=RESOLVED + COPIES),
    "consumed_outputs": oracle("SELECT * FROM consumed", "edges", extra=FED),
    "loose_outputs": oracle("SELECT run_id, task, file FROM outputs o WHERE NOT EXISTS (SELECT 1 FROM consumed c WHERE c.task = o.task AND c.file = o.file)",
                            "edges", "outputs", extra=FED),
    "recomputable": oracle("SELECT 'r0' AS run_id, task, recomputable, why FROM rerun", "tasks", "edges", "work", "present",
                           extra=RESOLVED + RERUN, recursive=True),
    "reclaim_plan": oracle("SELECT * FROM plan", *_P, extra=FULL, recursive=True),
    "reclaim_plan_cautious": oracle("SELECT * FROM plan WHERE target = 'host3'", *_P, extra=CAUTIOUS, recursive=True),
    "reclaim_cause_files": oracle("""SELECT p.run_id, p.task, o.file FROM plan p JOIN outputs o ON o.task = p.task
        LEFT JOIN copies c ON c.task = o.task AND c.file = o.file WHERE CASE cause WHEN 'no-digest' THEN digest_before IS NULL
          WHEN 'copy-is-link' THEN c.verdict = 'symlink'
          WHEN 'copy-size-differs' THEN c.verdict = 'changed'
          WHEN 'unpublished' THEN coalesce(c.verdict, '') NOT IN ('digest', 'hardlink') ELSE false END""", *_P, extra=CAUTIOUS, recursive=True),
    "reclaim_summary": oracle("""SELECT run_id, verdict, count(*) AS tasks, CAST(sum(bytes) AS BIGINT) AS bytes,
        verdict NOT IN ('KEEP', 'GONE') AS reclaimable FROM plan GROUP BY ALL""", *_P, extra=FULL, recursive=True),
    "reclaim_by_cause": oracle("""SELECT run_id, verdict, cause, process, count(*) AS tasks, CAST(sum(bytes) AS BIGINT) AS bytes
        FROM plan GROUP BY ALL""", *_P, extra=CAUTIOUS, recursive=True),
    "recheck_before_removal": oracle("""SELECT p.run_id, p.task, rel, verdict, bytes, b.refused FROM plan p LEFT JOIN (
          SELECT h.task, arg_min(CASE WHEN o.okey % 14 = 0 THEN concat('copy-gone: ', h.path)
              ELSE concat('copy-changed: ', h.path) END, concat(h.file, h.path)) AS refused
          FROM held h JOIN outputs o ON o.task = h.task AND o.file = h.file
          WHERE held IN ('digest', 'hardlink') AND (o.okey % 14 = 0 OR o.okey % 5 = 4) GROUP BY h.task) b ON b.task = p.task AND verdict = 'REDUNDANT'
        WHERE verdict NOT IN ('KEEP', 'GONE')""", *_P, extra=CAUTIOUS, recursive=True),
}
