"""Registered queries that compare runs and join them by content."""

from pyspark.sql import functions as F

from catalog.tables import oracle, staged, table
from wakeline.operators import drift as d
from wakeline.operators import graph, stitch


def _pairs(spark, sf):
    return table(spark, sf, "pairs")


def _asked(spark, sf):
    """All pairs but the refused ones."""
    pairs = _pairs(spark, sf)
    return pairs.join(d.refused_pairs(pairs).select("pair_id"), "pair_id", "left_anti")


def _drift(spark, sf):
    return d.drift(_asked(spark, sf), *[table(spark, sf, f"run_{n}") for n in ("tasks", "edges", "outputs")])


def _items(spark, sf):
    return staged(spark, sf, "drift-items", lambda: _drift(spark, sf).items)


def _after(spark, sf, signatures):
    """What the after run of every asked pair says of its tasks."""
    return d.sides(_asked(spark, sf), signatures)[1]


def input_signature(spark, sf):
    signed = d.input_signature(table(spark, sf, "run_edges"), table(spark, sf, "run_outputs"), table(spark, sf, "run_tasks"))
    signed = _after(spark, sf, signed)
    same = signed.groupBy("pair_id", "inputs").agg(F.count("*").alias("tasks"))
    return signed.join(same, ["pair_id", "inputs"], "left").select("pair_id", "task", "inputs", F.col("inputs").isNull().alias("unknown"), "tasks")


def output_signature(spark, sf):
    return _after(spark, sf, d.output_signature(table(spark, sf, "run_outputs"), ("out-1.*",))).select("pair_id", "task", "outputs")


def pair_tasks(spark, sf):
    paired = d.pair_tasks(_asked(spark, sf), *(table(spark, sf, f"run_{n}") for n in ("tasks", "edges", "outputs")))
    return paired.select("pair_id", "name", "before", "after", F.col("note").isNotNull().alias("unpaired"))


def drift_verdicts(spark, sf):
    return _items(spark, sf).select("pair_id", "task", "before", "after", "process", "verdict", "cause", "n_follows")


def drift_cause(spark, sf):
    return _items(spark, sf).where("verdict = 'DRIFTED'").select("pair_id", "task", "cause", "inputs_changed", "first_input")


def drift_files(spark, sf):
    return _drift(spark, sf).files.select("pair_id", "task", "file")


def drift_follows(spark, sf):
    return _drift(spark, sf).follows.select("pair_id", "task", "producer")


def drift_inputs(spark, sf):
    return _drift(spark, sf).inputs.select("pair_id", "task", "filename")


def drift_summary(spark, sf):
    return d.drift_summary(_items(spark, sf))


def drift_by_cause(spark, sf):
    return d.drift_by_cause(_items(spark, sf)).groupBy("pair_id", "verdict", "cause", "process").agg(
        F.sum("tasks").alias("tasks"), F.count("*").alias("input_sets"))


def fleet_drift(spark, sf):
    return d.drift_summary(_drift(spark, sf).items)


def refused_pairs(spark, sf):
    return d.refused_pairs(_pairs(spark, sf)).select("pair_id", "before_run", "after_run")


def coverage_of(spark, sf):
    notes = table(spark, sf, "run_tasks").select("run_id", F.concat(F.lit("ran on "), F.col("target")).alias("note"))
    return d.coverage_of(notes, _pairs(spark, sf))


def _docs(spark, sf):
    return table(spark, sf, "doc_edges"), table(spark, sf, "doc_outputs")


def digest_index(spark, sf):
    return stitch.digest_index(table(spark, sf, "run_outputs"))


def published_index(spark, sf):
    return stitch.published_index(table(spark, sf, "published"))


def bridges(spark, sf):
    return stitch.bridges(*_docs(spark, sf)).select(
        "run_id", "edge_ix", "consumer", "producer_run", "producer", "digest", "target", "candidates")


def bridge_classes(spark, sf):
    return stitch.bridge_classes(*_docs(spark, sf)).classes.withColumnsRenamed({"lefts": "readers", "rights": "producers"})


def size_classes(spark, sf):
    return stitch.size_classes(table(spark, sf, "outputs"), results_index(spark, sf)).classes.withColumnsRenamed({"lefts": "outputs", "rights": "copies"})


def stitch_runs(spark, sf):
    edges, outputs = _docs(spark, sf)
    return stitch.stitch_runs(edges, stitch.bridges(edges, outputs))


def stitched_reach(spark, sf):
    edges, outputs = _docs(spark, sf)
    whole = stitch.joined_graph(edges, outputs)
    entries = outputs.select(F.col("run_id").alias("subject"), F.lit("*").alias("run_id"), F.concat_ws(":", "run_id", "task").alias("task"))
    reached = graph.reach(entries, whole).where(~F.startswith("task", F.lit(stitch.DIGEST_NODE)))
    return reached.groupBy("subject").agg(F.count("*").alias("reached"))


def ambiguous_bridges(spark, sf):
    return stitch.ambiguous_bridges(*_docs(spark, sf))


def digest_coverage(spark, sf):
    return stitch.digest_coverage(*_docs(spark, sf))


def results_index(spark, sf):
    return stitch.results_index(table(spark, sf, "inventory"))


def published_copies_by_size(spark, sf):
    return stitch.published_copies_by_size(table(spark, sf, "outputs"), results_index(spark, sf))


QUERIES = {f.__name__: f for f in (
    input_signature, output_signature, pair_tasks, drift_verdicts, drift_cause, drift_files, drift_follows, drift_inputs,
    drift_summary, drift_by_cause, fleet_drift, refused_pairs, coverage_of, digest_index, published_index, bridges, bridge_classes, size_classes, stitch_runs,
    stitched_reach, ambiguous_bridges, digest_coverage, results_index, published_copies_by_size)}


def compared(before: str, after: str, out: str) -> str:
    """SQL of a whole comparison of run `before` with run `after`, as CTEs ending in {out}items."""
    sql = """
@sig AS (SELECT e.run_id, consumer AS task, CASE WHEN count(coalesce(e.digest, o.digest)) = count(*)
    THEN list_sort(list(coalesce(e.digest, o.digest))) END AS inputs
  FROM run_edges e LEFT JOIN run_outputs o ON o.run_id = e.run_id AND o.task = producer AND o.file = filename
  GROUP BY e.run_id, consumer),
@live AS (SELECT t.run_id, t.task, t.name, CASE WHEN s.task IS NULL THEN [] ELSE s.inputs END AS inputs
  FROM run_tasks t LEFT JOIN @sig s ON s.run_id = t.run_id AND s.task = t.task WHERE NOT superseded),
@n AS (SELECT name, count(*) FILTER (WHERE run_id = '#B') AS nb, count(*) FILTER (WHERE run_id = '#A') AS na FROM @live GROUP BY name),
@signed AS (SELECT name, min(task) FILTER (WHERE run_id = '#B') AS b, min(task) FILTER (WHERE run_id = '#A') AS a
  FROM @live JOIN @n USING (name) WHERE (nb > 1 OR na > 1) AND inputs IS NOT NULL GROUP BY name, inputs
  HAVING count(*) FILTER (WHERE run_id = '#B') = 1 AND count(*) FILTER (WHERE run_id = '#A') = 1),
@left AS (SELECT * FROM @live WHERE task NOT IN (SELECT b FROM @signed) AND task NOT IN (SELECT a FROM @signed)),
@ln AS (SELECT name, count(*) FILTER (WHERE run_id = '#B') AS lb, count(*) FILTER (WHERE run_id = '#A') AS la,
  min(task) FILTER (WHERE run_id = '#B') AS b, min(task) FILTER (WHERE run_id = '#A') AS a FROM @left GROUP BY name),
@paired AS (SELECT name, b AS before, a AS after, false AS unpaired FROM @signed
  UNION ALL SELECT name, b, a, false FROM @ln WHERE lb = 1 AND la = 1
  UNION ALL SELECT l.name, CASE WHEN run_id = '#B' THEN task END, CASE WHEN run_id = '#A' THEN task END, nb > 1 OR na > 1
    FROM @left l JOIN @ln ON l.name = @ln.name JOIN @n ON l.name = @n.name WHERE NOT (lb = 1 AND la = 1)),
@out AS (SELECT task, CASE WHEN count(digest) = count(*) THEN list(concat(file, ' ', digest) ORDER BY file) END AS sig
  FROM run_outputs GROUP BY task),
@base AS (SELECT p.*, coalesce(after, before) AS task, CASE WHEN unpaired THEN 'UNPAIRED' WHEN before IS NULL THEN 'ADDED' WHEN after IS NULL THEN 'REMOVED'
    WHEN x.sig IS NULL OR y.sig IS NULL THEN 'NODIGEST' WHEN x.sig = y.sig THEN 'SAME' ELSE 'DIFF' END AS state
  FROM @paired p LEFT JOIN @out x ON x.task = before LEFT JOIN @out y ON y.task = after),
@up AS (SELECT DISTINCT c.after, e.producer, c.state, b.state = 'DIFF' AS differs FROM run_edges e
  JOIN @base c ON c.after = e.consumer AND c.state IN ('SAME', 'DIFF')
  JOIN @base b ON b.after = e.producer AND b.state IN ('DIFF', 'NODIGEST', 'UNPAIRED') WHERE e.producer <> e.consumer),
@met AS (SELECT after, count(*) FILTER (WHERE differs) AS nd, count(*) FILTER (WHERE NOT differs) AS nu FROM @up GROUP BY after),
@ext AS (SELECT consumer AS task, filename, arg_max(coalesce(digest, ''), edge_ix) AS digest FROM run_edges WHERE producer = 'EXTERNAL' GROUP BY ALL),
@inputs AS (SELECT b.after AS task, x.filename FROM @base b JOIN @ext x ON x.task = b.after
  LEFT JOIN @ext y ON y.task = b.before AND y.filename = x.filename WHERE state = 'DIFF' AND x.digest <> coalesce(y.digest, '')),
@why AS (SELECT b.after, i.n, i.first, i.names, CASE WHEN i.n > 0 THEN 'input'
    WHEN tb.container <> ta.container THEN concat('container: ', tb.container, ' -> ', ta.container)
    WHEN tb.script <> ta.script THEN 'script' ELSE 'unexplained' END AS why
  FROM @base b JOIN run_tasks tb ON tb.task = b.before JOIN run_tasks ta ON ta.task = b.after
  LEFT JOIN (SELECT task, count(*) AS n, min(filename) AS first, list(filename ORDER BY filename) AS names FROM @inputs GROUP BY task) i ON i.task = b.after
  WHERE state = 'DIFF'),
@judged AS (SELECT b.*, coalesce(nd, 0) AS nd, coalesce(nu, 0) AS nu, CASE WHEN state IN ('UNPAIRED', 'NODIGEST') THEN 'UNVERIFIED'
    WHEN state = 'SAME' THEN 'REPRODUCED' WHEN state <> 'DIFF' THEN state WHEN nd > 0 THEN 'DOWNSTREAM' WHEN nu > 0 THEN 'UNSETTLED' ELSE 'DRIFTED' END AS verdict
  FROM @base b LEFT JOIN @met m ON m.after = b.after),
@items AS (SELECT j.task, j.before, j.after, t.process, verdict, CASE verdict WHEN 'DRIFTED' THEN why
    WHEN 'UNVERIFIED' THEN CASE WHEN unpaired THEN 'ambiguous name' ELSE 'output without digest' END
    WHEN 'DOWNSTREAM' THEN 'upstream drifted' WHEN 'UNSETTLED' THEN 'upstream unverified'
    WHEN 'REPRODUCED' THEN 'equal digests' WHEN 'ADDED' THEN 'only after'
    ELSE 'only before' END AS cause,
  CASE state WHEN 'DIFF' THEN CASE WHEN nd > 0 THEN nd ELSE nu END WHEN 'SAME' THEN nd ELSE 0 END AS n_follows,
  CASE WHEN verdict = 'DRIFTED' THEN n END AS inputs_changed, CASE WHEN verdict = 'DRIFTED' THEN first END AS first_input,
  CASE WHEN verdict = 'DRIFTED' THEN names END AS names
  FROM @judged j JOIN run_tasks t ON t.task = j.task LEFT JOIN @why w ON w.after = j.after),"""
    return sql.replace("@", out).replace("#B", before).replace("#A", after)


RUNS = ("run_tasks", "run_edges", "run_outputs")
FORTH, BACK = compared("rb", "ra", "f_"), compared("ra", "rb", "k_")
BRIDGES = """made AS (SELECT DISTINCT digest, run_id, task FROM doc_outputs),
found AS (SELECT e.run_id, e.edge_ix, e.consumer, m.run_id AS producer_run, m.task AS producer, e.digest, e.target, e.filename,
  count(*) OVER (PARTITION BY e.run_id, e.edge_ix) AS candidates
  FROM doc_edges e JOIN made m ON e.digest = m.digest AND e.run_id <> m.run_id),
stitched AS (SELECT run_id, edge_ix, consumer, producer, CAST(NULL AS VARCHAR) AS producer_run, filename, target, digest FROM doc_edges e
    WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.run_id = e.run_id AND f.edge_ix = e.edge_ix)
  UNION ALL SELECT run_id, edge_ix, consumer, producer, producer_run, filename, target, digest FROM found),"""
INDEX = """named AS (SELECT run_id, regexp_extract(path, '[^/]*$') AS name, CASE WHEN NOT is_dir THEN size END AS size, path, is_dir FROM inventory),
idx AS (SELECT *, count(*) OVER (PARTITION BY run_id, name, size, is_dir) AS candidates FROM named),"""
_D = ("doc_edges", "doc_outputs")



def both_ways(body: str, **options) -> str:
    """SQL over every asked pair; in `body` an @ stands for the comparison of the pair's runs in its order."""
    return oracle(f"""SELECT pair_id, i.* EXCLUDE (before_run) FROM pairs JOIN (SELECT 'rb' AS before_run, * FROM ({body.replace('@', 'f_')})
        UNION ALL SELECT 'ra', * FROM ({body.replace('@', 'k_')})) i USING (before_run) WHERE before_session <> after_session""",
                  *RUNS, "pairs", extra=FORTH + BACK, **options)


def _bag(text: str) -> str:
    """The count of some texts and the sums of the first four words of their SHA-256."""
    words = ", ".join(f"coalesce(sum(('0x' || substr(sha256({text}), {8 * k + 1}, 8))::BIGINT), 0)::HUGEINT::VARCHAR" for k in range(4))
    return f"concat_ws(':', count({text})::VARCHAR, {words})"


ORACLES = {
    "input_signature": oracle(f"""SELECT *, inputs IS NULL AS unknown, CASE WHEN inputs IS NOT NULL THEN count(*) OVER (PARTITION BY pair_id, inputs) END AS tasks
        FROM (SELECT pair_id, t.task, CASE WHEN s.task IS NULL THEN '0:0:0:0:0' WHEN s.whole THEN s.sig END AS inputs
        FROM pairs p JOIN run_tasks t ON t.run_id = p.after_run LEFT JOIN (
            SELECT e.run_id, consumer AS task, count(d) = count(*) AS whole, {_bag("d")} AS sig
            FROM (SELECT e.run_id, consumer, coalesce(e.digest, o.digest) AS d FROM run_edges e LEFT JOIN run_outputs o
                  ON o.run_id = e.run_id AND o.task = producer AND o.file = filename) e GROUP BY ALL) s
        ON s.run_id = t.run_id AND s.task = t.task WHERE before_session <> after_session)""", *RUNS, "pairs"),
    "output_signature": oracle(f"""SELECT pair_id, task, CASE WHEN count(digest) = count(*) THEN {_bag("concat(file, chr(10), digest)")} END AS outputs
        FROM run_outputs o JOIN pairs p ON o.run_id = p.after_run
        WHERE file <> 'out-1.dat' AND before_session <> after_session GROUP BY pair_id, task""", "run_outputs", "pairs"),
    "pair_tasks": both_ways("SELECT name, before, after, unpaired FROM @paired"),
    "drift_verdicts": both_ways("SELECT task, before, after, process, verdict, cause, n_follows FROM @items"),
    "drift_cause": both_ways("SELECT task, cause, inputs_changed, first_input FROM @items WHERE verdict = 'DRIFTED'"),
    "drift_files": both_ways("""SELECT y.task, y.file FROM @base b JOIN run_outputs y ON y.task = b.after
        LEFT JOIN run_outputs x ON x.task = b.before AND x.file = y.file
        WHERE state = 'DIFF' AND x.digest IS DISTINCT FROM y.digest"""),
    "drift_follows": both_ways("""SELECT u.after AS task, producer FROM @up u JOIN @met m ON m.after = u.after
        WHERE differs OR (state = 'DIFF' AND nd = 0)"""),
    "drift_inputs": both_ways("SELECT task, filename FROM @inputs"),
    "drift_summary": both_ways("SELECT verdict, count(*) AS tasks FROM @items GROUP BY verdict"),
    "drift_by_cause": both_ways("""SELECT verdict, cause, process, count(*) AS tasks, count(DISTINCT coalesce(names, [])) AS input_sets
        FROM @items GROUP BY ALL"""),
    "fleet_drift": oracle("""SELECT pair_id, verdict, count(*) AS tasks FROM pairs JOIN
        (SELECT 'rb' AS before_run, verdict FROM f_items UNION ALL SELECT 'ra', verdict FROM k_items) i USING (before_run)
        WHERE before_session <> after_session GROUP BY ALL""", *RUNS, "pairs", extra=FORTH + BACK),
    "refused_pairs": oracle("SELECT pair_id, before_run, after_run FROM pairs WHERE before_session = after_session", "pairs"),
    "coverage_of": oracle("""SELECT DISTINCT pair_id, concat('ran on ', target) AS note FROM pairs
        JOIN run_tasks ON run_id IN (before_run, after_run)""", "pairs", "run_tasks"),
    "digest_index": oracle("SELECT digest, run_id, task, file FROM run_outputs WHERE digest IS NOT NULL", "run_outputs"),
    "published_index": oracle("SELECT digest, run_id, path FROM published WHERE digest IS NOT NULL", "published"),
    "bridges": oracle("SELECT run_id, edge_ix, consumer, producer_run, producer, digest, target, candidates FROM found", *_D, extra=BRIDGES),
    "bridge_classes": oracle("""SELECT digest, readers, producers, pairs FROM
        (SELECT digest, count(DISTINCT (run_id, edge_ix)) AS readers, count(*) AS pairs FROM found GROUP BY digest)
        JOIN (SELECT digest, count(*) AS producers FROM made GROUP BY digest) USING (digest)""", *_D, extra=BRIDGES),
    "size_classes": oracle("""SELECT run_id, name, size, outputs, copies, outputs * copies AS pairs FROM
        (SELECT run_id, file AS name, size, count(*) AS outputs FROM outputs GROUP BY ALL)
        JOIN (SELECT run_id, name, size, count(*) AS copies FROM idx WHERE NOT is_dir GROUP BY ALL) USING (run_id, name, size)""", "outputs", "inventory", extra=INDEX),
    "stitch_runs": oracle("SELECT * FROM stitched", *_D, extra=BRIDGES),
    "stitched_reach": oracle("""SELECT subject, count(*) AS reached FROM reached GROUP BY subject""", *_D, extra=BRIDGES + """
        hop AS (SELECT DISTINCT concat(producer_run, ':', producer) AS task, concat(run_id, ':', consumer) AS next FROM found),
        reached(subject, task) AS (SELECT run_id, concat(run_id, ':', task) FROM doc_outputs
          UNION SELECT r.subject, h.next FROM reached r JOIN hop h ON r.task = h.task),""", recursive=True),
    "ambiguous_bridges": oracle("SELECT DISTINCT digest, producer_run, producer FROM found WHERE candidates > 1", *_D, extra=BRIDGES),
    "digest_coverage": oracle("""SELECT run_id, o.n AS outputs, e.n AS inputs FROM
        (SELECT run_id, count(digest) AS n FROM doc_outputs GROUP BY run_id) o JOIN
        (SELECT run_id, count(digest) AS n FROM doc_edges GROUP BY run_id) e USING (run_id)""", *_D),
    "results_index": oracle("SELECT * FROM idx", "inventory", extra=INDEX),
    "published_copies_by_size": oracle("""
        SELECT o.run_id, o.task, o.file, path, candidates > 1 AS ambiguous, 'size' AS matched FROM outputs o JOIN idx i
          ON i.name = o.file AND i.size = o.size
        UNION ALL
        SELECT o.run_id, o.task, o.file, path, true, 'directory name' FROM outputs o JOIN idx i ON i.name = o.file AND i.is_dir
          WHERE NOT EXISTS (SELECT 1 FROM idx f WHERE f.name = o.file AND f.size = o.size)""", "outputs", "inventory", extra=INDEX),
}
