"""Registered queries from incident texts to triggers, and over the tables' contract."""

from pyspark.sql import functions as F

from catalog.tables import oracle, run_sql, staged, table
from wakeline.operators import intake as t
from wakeline.operators import quality, triggers

# What people wrote (a conversation's other turns are answers, not incidents), with something of the run named in three of four.
INCIDENTS = """SELECT concat(conv_id, '-', turn) AS incident, 'r0' AS run_id, conv_id AS c, concat(text, CASE conv_id % 4
  WHEN 0 THEN concat(' We saw it in part-', conv_id * 4 % 200, '.dat, again.') WHEN 1 THEN concat(' Withdraw NATION_', conv_id % 25, ' now') WHEN 2 THEN ' The building-kit and AUTOMOBILE' ELSE '' END) AS text
FROM {conversations} WHERE role = 'user'"""
ANSWERS = """SELECT incident, run_id, c, concat('{{"model":"', CASE WHEN c % 11 = 0 THEN 'newest' WHEN c % 13 = 0 THEN 'm-2' ELSE 'm-1' END, '","choice":"',
  CASE c % 4 WHEN 0 THEN concat('part-', c * 4 % 200, '.dat') WHEN 1 THEN concat('NATION_', (c + c % 3) % 25) WHEN 2 THEN 'building' ELSE 'none' END,
  '","confidence":', CASE WHEN c % 17 = 0 THEN 'true' WHEN c % 19 = 0 THEN '1.5' ELSE concat('0.', 40 + c % 60) END, ',"probabilities":{{"none":0.1', CASE WHEN c % 23 = 0 THEN ',"stranger":0.2' ELSE '' END, '}}}}') AS value FROM ({incidents_sql}) i"""
DECISIONS = """SELECT incident, run_id, CASE WHEN c % 9 = 0 THEN ' ' ELSE concat('p', c % 5) END AS actor, CASE WHEN c % 4 = 1 THEN concat('nation:NATION_', c % 25) WHEN c % 4 = 2 THEN 'flag:Z' END AS ask,
  c % 4 IN (0, 3) OR c % 8 = 1 AS dismiss FROM ({incidents_sql}) i"""
REMOVES = ("nation",)


def _incidents(spark, sf):
    return run_sql(spark, sf, INCIDENTS)


def _tables(spark, sf):
    return table(spark, sf, "tasks"), table(spark, sf, "edges")


def _options(spark, sf):
    return staged(spark, sf, "options", lambda: _options_made(spark, sf))


def _options_made(spark, sf):
    tasks, edges = _tables(spark, sf)
    owners = triggers.entries_by_tag(tasks, table(spark, sf, "sheet").withColumnRenamed("member", "label"))
    declared = owners.select("run_id", F.lit("nation").alias("kind"), F.col("owner").alias("value"), "task")
    return t.triage_options(tasks, edges, declared, ["nation"], load_bearing=["part-4.dat"])


def _offered(spark, sf):
    return staged(spark, sf, "offered", lambda: _offered_made(spark, sf))


def _offered_made(spark, sf):
    return t.offer_options(_incidents(spark, sf), _options(spark, sf))


def _answers(spark, sf):
    # Written by hand as JSON, the way a service replies.
    return run_sql(spark, sf, ANSWERS.replace("{incidents_sql}", INCIDENTS)).select("incident", "run_id", "value")


def _checked(spark, sf):
    return t.check_answers(_answers(spark, sf), _offered(spark, sf), "m-1", ["newest"])


def _triaged(spark, sf):
    return staged(spark, sf, "triaged", lambda: _triaged_made(spark, sf))


def _triaged_made(spark, sf):
    good = _checked(spark, sf).where("problem IS NULL").select("incident", "run_id", "choice", "confidence", F.lit(0).cast("bigint").alias("named"))
    ids = t.ids_named_in_run(_incidents(spark, sf), *_tables(spark, sf))
    return t.triage_outcomes(_incidents(spark, sf), good, _offered(spark, sf), ids, REMOVES)


def _decided(spark, sf):
    return t.record_decisions(run_sql(spark, sf, DECISIONS.replace("{incidents_sql}", INCIDENTS)), _triaged(spark, sf), _offered(spark, sf))


def triage_options(spark, sf):
    return _options(spark, sf)


def offer_options(spark, sf):
    return _offered(spark, sf).select("incident", "kind", "value", "option", "trigger")


def match_by_name(spark, sf):
    return t.match_by_name(_incidents(spark, sf), _offered(spark, sf))


def ids_named_in_run(spark, sf):
    return t.ids_named_in_run(_incidents(spark, sf), *_tables(spark, sf)).select("incident", "word")


def check_answers(spark, sf):
    return _checked(spark, sf).select("incident", "choice", "confidence", "problem")


def triage_outcomes(spark, sf):
    return _triaged(spark, sf).select("incident", "choice", "outcome", "reason", "trigger")


def triage_by_name(spark, sf):
    found = t.match_by_name(_incidents(spark, sf), _offered(spark, sf)).withColumn("confidence", F.lit(None).cast("double"))
    ids = t.ids_named_in_run(_incidents(spark, sf), *_tables(spark, sf))
    return t.triage_outcomes(_incidents(spark, sf), found, _offered(spark, sf), ids, REMOVES).select("incident", "choice", "outcome", "reason", "trigger")


def record_decisions(spark, sf):
    return _decided(spark, sf).select("incident", "actor", "decision", "trigger", "refused")


def facts_from_decisions(spark, sf):
    return t.facts_from_decisions(_decided(spark, sf), REMOVES)


def inbox_state(spark, sf):
    return t.inbox_state(_incidents(spark, sf), _triaged(spark, sf), _decided(spark, sf)).select("incident", "state")


def grade_triage(spark, sf):
    expected = _incidents(spark, sf).select("incident", "run_id", F.expr("concat('form', c % 2)").alias("form"), F.expr(
        "CASE c % 4 WHEN 0 THEN concat('part-', c * 4 % 200, '.dat') WHEN 1 THEN concat('NATION_', c % 25) WHEN 2 THEN 'BUILDING' ELSE 'none' END").alias("expected"))
    return t.grade_triage(_triaged(spark, sf), expected)


SPOILED = """SELECT run_id, consumer, CASE WHEN edge_ix % 1000000000000 % 97 = 0 THEN consumer WHEN edge_ix % 1000000000000 % 89 = 0 THEN 'o-1' ELSE producer END AS producer, filename,
  CASE WHEN edge_ix % 1000000000000 % 83 = 0 THEN NULL ELSE target END AS target, CASE WHEN edge_ix % 1000000000000 % 79 = 0 THEN 'bare' ELSE digest END AS digest, edge_ix FROM {T:edges} e"""


def contract_violations(spark, sf):
    tasks = table(spark, sf, "tasks").withColumn("status", F.when(F.col("okey") % 7 == 0, F.lower("engine_status")).otherwise(F.col("engine_status"))).withColumn(
        "workdir", F.lit("")).withColumn("workpath", F.when(F.col("okey") % 50 == 1, "../x").otherwise(F.col("workpath"))).withColumn(
        "container", F.when(F.col("okey") % 60 != 1, F.col("container"))).withColumn(
        "metrics", F.when(F.col("okey") % 70 == 1, F.create_map(F.lit("price"), F.lit(-1.0))).otherwise(F.col("metrics")))
    outputs = run_sql(spark, sf, "SELECT run_id, CASE WHEN okey % 40 = 1 THEN concat('lost', okey) ELSE task END AS task, file, CASE WHEN okey % 30 = 1 THEN 'sha256:' ELSE digest_before END AS digest FROM {T:outputs} o")
    return quality.contract_violations(tasks, run_sql(spark, sf, SPOILED), outputs, table(spark, sf, "published"))


def extract_summary(spark, sf):
    tasks = table(spark, sf, "tasks").withColumn("cached", F.col("okey") % 6 == 0)
    return quality.extract_summary(tasks, run_sql(spark, sf, SPOILED))


QUERIES = {f.__name__: f for f in (
    triage_options, offer_options, match_by_name, ids_named_in_run, check_answers, triage_outcomes, triage_by_name, record_decisions,
    facts_from_decisions, inbox_state, grade_triage, contract_violations, extract_summary)}

OPTIONS = """inc AS (""" + INCIDENTS + """),
opt0 AS (SELECT 'container' AS kind, split_part(split_part(container, '/', 3), ':', 1) AS value, process AS step FROM tasks
  UNION ALL SELECT 'input', filename, process FROM edges e JOIN tasks t ON t.task = e.consumer WHERE producer = 'EXTERNAL'
  UNION ALL SELECT 'segment', segment, NULL FROM tasks UNION ALL SELECT 'flag', flag, NULL FROM edges
  UNION ALL SELECT 'nation', owner, process FROM tasks JOIN sheet ON regexp_extract(name, '\\(([^()]+)\\)', 1) = member),
opts AS (SELECT 'r0' AS run_id, kind, value, count(DISTINCT step) AS steps, kind = 'input' AND value = 'part-4.dat' AS load_bearing FROM opt0 GROUP BY kind, value),
wide AS (SELECT *, kind = 'input' AS wide FROM opts),
off0 AS (SELECT incident, text, c, kind, value FROM inc, wide WHERE NOT wide OR load_bearing
    OR regexp_matches(text, concat('(?i)(^|[^A-Za-z0-9])', replace(value, '.', '\\.'), '($|[^A-Za-z0-9])'))),
offered AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY incident, value) = 1 THEN value ELSE concat(kind, ' ', value) END AS option, concat(kind, ':', value) AS trigger FROM off0),
byname AS (SELECT i.incident, i.text, i.c, count(o.option) AS named, CASE WHEN count(o.option) = 1 THEN min(o.option) ELSE 'none' END AS choice FROM inc i LEFT JOIN offered o ON o.incident = i.incident
  AND regexp_matches(i.text, concat('(?i)(^|[^A-Za-z0-9-]|[^A-Za-z0-9]-)', replace(o.value, '.', '\\.'), '($|-$|[^A-Za-z0-9-]|-[^A-Za-z0-9])')) GROUP BY ALL),
words AS (SELECT DISTINCT incident, w AS word FROM (SELECT incident, unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_.-]*[A-Za-z0-9]')) AS w FROM inc)
  WHERE length(w) >= 3 AND regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]')),
said AS (SELECT DISTINCT s FROM (SELECT name AS s FROM tasks UNION SELECT process FROM tasks UNION SELECT segment FROM tasks UNION SELECT filename FROM edges UNION SELECT flag FROM edges)),
ids AS (SELECT incident, word FROM words w WHERE EXISTS (SELECT 1 FROM said WHERE contains(lower(s), lower(word)) AND regexp_matches(s, concat('(?i)(^|[^A-Za-z0-9])', replace(word, '.', '\\.'), '($|[^A-Za-z0-9])')))),
ans AS (SELECT incident, c, text, CASE WHEN c % 11 = 0 THEN 'newest' WHEN c % 13 = 0 THEN 'm-2' ELSE 'm-1' END AS model,
  CASE c % 4 WHEN 0 THEN concat('part-', c * 4 % 200, '.dat') WHEN 1 THEN concat('NATION_', (c + c % 3) % 25) WHEN 2 THEN 'building' ELSE 'none' END AS choice,
  CASE WHEN c % 17 = 0 THEN NULL WHEN c % 19 = 0 THEN 1.5 ELSE CAST(concat('0.', 40 + c % 60) AS DOUBLE) END AS confidence FROM inc),
checked AS (SELECT a.*, o.kind, o.value, o.trigger, CASE WHEN model = 'newest' THEN 'model: alias' WHEN model = 'm-2' THEN 'model: other'
    WHEN a.choice <> 'none' AND o.option IS NULL THEN 'choice: unoffered' WHEN a.c % 17 = 0 OR a.c % 19 = 0 THEN 'confidence: range'
    WHEN a.c % 23 = 0 THEN 'weights: unoffered' END AS problem FROM ans a LEFT JOIN offered o ON o.incident = a.incident AND o.option = a.choice),
judged AS (SELECT *, CASE WHEN choice = 'none' THEN CASE WHEN confidence < 0.9 THEN 'none, confidence low' WHEN incident IN (SELECT incident FROM ids) THEN 'id found in text' ELSE 'none, confidence high' END
    WHEN confidence < 0.6 THEN 'confidence low' WHEN kind = 'nation' AND NOT regexp_matches(text, concat('(?i)(^|[^A-Za-z0-9])', value, '($|[^A-Za-z0-9])')) THEN 'removal without its id' ELSE 'confidence high' END AS reason FROM checked WHERE problem IS NULL),
triaged AS (SELECT *, CASE reason WHEN 'confidence high' THEN 'ask' WHEN 'none, confidence high' THEN 'dismissed' ELSE 'held' END AS outcome FROM judged),
decided AS (SELECT d.incident, trim(actor) AS actor, CASE WHEN ask IS NOT NULL THEN 'ask' ELSE 'dismiss' END AS decision, ask AS trigger,
  CASE WHEN trim(actor) = '' THEN 'actor: absent' WHEN coalesce(t.outcome, '') <> 'held' THEN 'not held' WHEN (ask IS NOT NULL) = dismiss THEN 'decision: neither'
    WHEN ask IS NOT NULL AND NOT EXISTS (SELECT 1 FROM offered o WHERE o.incident = d.incident AND o.trigger = d.ask) THEN 'trigger: unoffered' END AS refused
  FROM (""" + DECISIONS.replace("{incidents_sql}", INCIDENTS) + """) d LEFT JOIN triaged t ON t.incident = d.incident),"""
_T = ("tasks", "edges", "sheet")
BROKEN = """spoiled AS (""" + SPOILED + """),"""

ORACLES = {
    "triage_options": oracle("SELECT * FROM opts", *_T, extra=OPTIONS),
    "offer_options": oracle("SELECT incident, kind, value, option, trigger FROM offered", *_T, extra=OPTIONS),
    "match_by_name": oracle("SELECT incident, 'r0' AS run_id, choice, named FROM byname", *_T, extra=OPTIONS),
    "ids_named_in_run": oracle("SELECT incident, word FROM ids", *_T, extra=OPTIONS),
    "check_answers": oracle("SELECT incident, choice, CASE WHEN c % 17 <> 0 THEN confidence WHEN c % 17 = 0 THEN 1.0 END AS confidence, problem FROM checked", *_T, extra=OPTIONS),
    "triage_outcomes": oracle("SELECT incident, choice, outcome, reason, CASE WHEN outcome = 'ask' THEN trigger END AS trigger FROM triaged", *_T, extra=OPTIONS),
    "triage_by_name": oracle("""SELECT b.incident, b.choice, CASE WHEN o.kind = 'nation' AND b.choice <> 'none' THEN 'ask' WHEN b.choice <> 'none' THEN 'ask' ELSE 'held' END AS outcome,
        CASE WHEN b.choice <> 'none' THEN 'name found' WHEN named > 0 THEN 'several names found' ELSE 'no name found' END AS reason, o.trigger
        FROM byname b LEFT JOIN offered o ON o.incident = b.incident AND o.option = b.choice""", *_T, extra=OPTIONS),
    "record_decisions": oracle("SELECT * FROM decided", *_T, extra=OPTIONS),
    "facts_from_decisions": oracle("""SELECT 'Withdrawn' AS event_type, split_part(trigger, ':', 2) AS subject, actor, incident, trigger FROM decided
        WHERE refused IS NULL AND decision = 'ask' AND trigger LIKE 'nation:%'""", *_T, extra=OPTIONS),
    "inbox_state": oracle("""SELECT i.incident, CASE WHEN t.outcome IS NULL THEN 'waiting' WHEN d.decision IS NOT NULL THEN concat('held first: ', d.decision) ELSE t.outcome END AS state
        FROM inc i LEFT JOIN triaged t ON t.incident = i.incident LEFT JOIN decided d ON d.incident = i.incident AND d.refused IS NULL""", *_T, extra=OPTIONS),
    "grade_triage": oracle("""SELECT concat('form', c % 2) AS form, count(*) AS cases, count(*) FILTER (WHERE choice = want) AS right, count(*) FILTER (WHERE outcome = 'held') AS held,
        count(*) FILTER (WHERE choice <> want AND outcome = 'ask') AS acted_wrongly, count(*) FILTER (WHERE choice <> want AND outcome = 'dismissed') AS dismissed_wrongly FROM
        (SELECT *, CASE c % 4 WHEN 0 THEN concat('part-', c * 4 % 200, '.dat') WHEN 1 THEN concat('NATION_', c % 25) WHEN 2 THEN 'BUILDING' ELSE 'none' END AS want FROM triaged) GROUP BY c % 2""", *_T, extra=OPTIONS),
    "contract_violations": oracle("""
        SELECT 'r0' AS run_id, 'tasks' AS source, task AS key, 'status:case' AS problem FROM tasks WHERE okey % 7 = 0
        UNION ALL SELECT 'r0', 'tasks', task, 'workpath:escapes' FROM tasks WHERE okey % 50 = 1
        UNION ALL SELECT 'r0', 'tasks', task, 'container is missing' FROM tasks WHERE okey % 60 = 1
        UNION ALL SELECT 'r0', 'tasks', task, 'metrics:value' FROM tasks WHERE okey % 70 = 1
        UNION ALL SELECT 'r0', 'edges', CAST(edge_ix AS VARCHAR), 'edge:self' FROM spoiled WHERE producer = consumer
        UNION ALL SELECT 'r0', 'edges', CAST(edge_ix AS VARCHAR), 'producer:unknown' FROM spoiled WHERE producer = 'o-1'
        UNION ALL SELECT 'r0', 'edges', CAST(edge_ix AS VARCHAR), 'target is missing' FROM spoiled WHERE target IS NULL
        UNION ALL SELECT 'r0', 'edges', CAST(edge_ix AS VARCHAR), 'digest:form' FROM spoiled WHERE digest = 'bare'
        UNION ALL SELECT 'r0', 'outputs', concat('lost', okey, '/', file), 'outputs:unknown' FROM outputs WHERE okey % 40 = 1
        UNION ALL SELECT 'r0', 'outputs', concat(CASE WHEN okey % 40 = 1 THEN concat('lost', okey) ELSE task END, '/', file), 'digest:form' FROM outputs WHERE okey % 30 = 1""",
        "tasks", "edges", "outputs", extra=BROKEN),
    "extract_summary": oracle("""SELECT 'r0' AS run_id, t.tasks, t.superseded, t.cached, e.edges, e.resolved, e.external, e.dangling FROM
        (SELECT count(*) AS tasks, count(*) FILTER (WHERE superseded) AS superseded, count(*) FILTER (WHERE okey % 6 = 0) AS cached FROM tasks) t,
        (SELECT count(*) AS edges, count(*) FILTER (WHERE producer IN (SELECT task FROM tasks)) AS resolved, count(*) FILTER (WHERE producer = 'EXTERNAL') AS external,
          count(*) FILTER (WHERE producer = 'o-1') AS dangling FROM spoiled) e""", "tasks", "edges", extra=BROKEN),
}
