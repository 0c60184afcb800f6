"""Registered queries over the log of facts."""

from pyspark.sql import functions as F

from catalog.tables import oracle, run_sql, table
from wakeline.functions.instants import in_effect, instant
from wakeline.operators import ledger as g

BLOCK, CLEAR = ["error"], ["purchase"]
AS_OF = "2024-01-15"
SUBJECTS = "SELECT concat('u', c_custkey) AS subject FROM {customer}"
# Every moment a sale was made is asked about, once as its day and once as itself.
DATES = """SELECT DISTINCT 'log' AS log_id, substring({ISO:ts}, 1, 10) AS as_of FROM {events}
UNION SELECT 'log', {ISO:ts} FROM {events}"""
# Tampering: logs with an entry edited, cut or gone, and logs where an entry has no link or no hash.
TAMPERED = """CASE WHEN user_no % 5 = 1 AND seq = 4 THEN 'edited' WHEN user_no % 5 = 2 AND seq = 3 THEN 'cut' WHEN user_no % 5 = 3 AND seq = 2 THEN 'gone'
  WHEN user_no % 10 = 4 AND seq = 5 THEN 'unlinked' WHEN user_no % 10 = 9 AND seq = 6 THEN 'unhashed' END"""


def _facts(spark, sf):
    return table(spark, sf, "facts").drop("ets")


def _chain(spark, sf):
    return table(spark, sf, "chain")


def _tampered(spark, sf):
    rows = _chain(spark, sf).withColumn("user_no", F.substring_index("log_id", "log", -1).cast("bigint"))
    rows = rows.withColumn("how", F.expr(TAMPERED)).where("how IS NULL OR how <> 'gone'")
    return rows.withColumn("actor", F.when(F.col("how") == "edited", "someone").otherwise(F.col("actor"))).withColumn(
        "prev_hash", F.when(F.col("how") == "cut", "0").when(F.col("how") == "unlinked", F.lit(None)).otherwise(F.col("prev_hash"))).withColumn(
        "hash", F.when(F.col("how") == "unhashed", F.lit(None)).otherwise(F.col("hash")))


def _gate(spark, sf):
    return g.gate(run_sql(spark, sf, SUBJECTS), _facts(spark, sf), BLOCK, CLEAR, AS_OF)


def read_log(spark, sf):
    return g.read_log(_facts(spark, sf), since=100, event_types=["error", "signup"]).select("log_id", "seq", "subject", "event_type")


def log_head(spark, sf):
    return g.log_head(_chain(spark, sf))


def anchors(spark, sf):
    wanted = _chain(spark, sf).groupBy("log_id").agg(F.max("seq").alias("last")).select(
        "log_id", F.explode(F.array(F.lit(0).cast("bigint"), "last", F.col("last") + 5)).alias("seq"))
    return g.anchors(_chain(spark, sf), wanted)


def chain_events(spark, sf):
    return _chain(spark, sf).select("log_id", "seq", "prev_hash", "hash")


def chain_more(spark, sf):
    more = table(spark, sf, "new_facts")
    return g.chain_events(more, g.log_head(_chain(spark, sf))).groupBy("log_id").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("prev_hash", "seq").alias("first_prev"))


def verify_chain(spark, sf):
    return g.verify_chain(_chain(spark, sf))


def verify_chain_tampered(spark, sf):
    return g.verify_chain(_tampered(spark, sf)).drop("head")


def in_effect_rows(spark, sf):
    facts = _facts(spark, sf).withColumn("at", instant(F.col("effective_from")))
    return facts.select("seq", in_effect(F.col("at"), F.lit(AS_OF)).alias("by_day"),
                        in_effect(F.col("at"), F.lit("2024-01-15T12:00:00+02:00")).alias("by_time"))


def bad_instants(spark, sf):
    spoiled = _facts(spark, sf).withColumn("effective_from", F.when(F.col("event_type") == "view", F.concat("effective_from", F.lit("?")))
                                           .otherwise(F.col("effective_from")))
    return g.bad_instants(spoiled).select("seq", "effective_from")


def gate(spark, sf):
    return _gate(spark, sf)


def gate_decision(spark, sf):
    return g.gate_decision(_gate(spark, sf))


def gate_report(spark, sf):
    return g.gate_report(_gate(spark, sf), 20).select("status", "subject", F.col("place").cast("bigint").alias("place"), "total")


def policy_history(spark, sf):
    return g.policy_history(_facts(spark, sf), "signup").select("log_id", "seq", "version", "effective_from", "actor")


def policy_in_force(spark, sf):
    return g.policy_in_force(_facts(spark, sf), run_sql(spark, sf, DATES), "signup").select("log_id", "as_of", "version", "seq")


def subject_history(spark, sf):
    return g.subject_history(_facts(spark, sf), run_sql(spark, sf, SUBJECTS)).select(
        "subject", "known", "seq", "event_type", "effective_from")


QUERIES = {f.__name__: f for f in (
    read_log, log_head, anchors, chain_events, chain_more, verify_chain, verify_chain_tampered, in_effect_rows, bad_instants,
    gate, gate_decision, gate_report, policy_history, policy_in_force, subject_history)}

PREIMAGE = """concat('{"actor":"', actor, '","body":"', replace(replace(replace(body, '\\', '\\\\'), '"', '\\"'), 'é', '\\u00e9'),
  '","effective_from":"', effective_from, '","event_type":"', event_type, '","prev_hash":"', {prev}, '","recorded_at":"', recorded_at,
  '","seq":', n.seq, ',"subject":"', subject, '"}')"""
CHAIN = """numbered AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY ord) AS seq FROM new_facts),
chain(log_id, seq, prev_hash, hash) AS (
  SELECT log_id, seq, repeat('0', 64), sha256(""" + PREIMAGE.replace("{prev}", "repeat('0', 64)") + """) FROM numbered n WHERE seq = 1
  UNION ALL
  SELECT n.log_id, n.seq, c.hash, sha256(""" + PREIMAGE.replace("{prev}", "c.hash") + """) FROM chain c JOIN numbered n ON n.log_id = c.log_id AND n.seq = c.seq + 1),"""
GATE = """decisive AS (SELECT subject, seq, event_type, effective_from, actor, ets FROM facts
  WHERE event_type IN ('error', 'purchase') AND ets < TIMESTAMP '2024-01-16 00:00:00'),
latest AS (SELECT subject, arg_max(struct_pack(seq := seq, event_type := event_type, effective_from := effective_from, actor := actor), (ets, seq)) AS f FROM decisive GROUP BY subject),
statuses AS (SELECT s.subject, CASE WHEN f IS NULL THEN 'UNKNOWN' WHEN f.event_type = 'error' THEN 'BLOCKED' ELSE 'CLEARED' END AS status,
  f.seq AS seq, f.event_type AS event_type, f.effective_from AS effective_from, f.actor AS actor
  FROM (""" + SUBJECTS + """) s LEFT JOIN latest l ON l.subject = s.subject),"""

ORACLES = {
    "read_log": oracle("SELECT log_id, seq, subject, event_type FROM facts WHERE seq > 100 AND event_type IN ('error', 'signup')", "facts"),
    "log_head": oracle("SELECT log_id, max(seq) AS seq, arg_max(hash, seq) AS hash FROM chain GROUP BY log_id", "new_facts", extra=CHAIN, recursive=True),
    "anchors": oracle("""SELECT w.log_id, w.seq, CASE WHEN w.seq = 0 THEN repeat('0', 64) ELSE c.hash END AS hash FROM
        (SELECT log_id, unnest([0, max(seq), max(seq) + 5]) AS seq FROM chain GROUP BY log_id) w LEFT JOIN chain c ON c.log_id = w.log_id AND c.seq = w.seq""",
        "new_facts", extra=CHAIN, recursive=True),
    "chain_events": oracle("SELECT log_id, seq, prev_hash, hash FROM chain", "new_facts", extra=CHAIN, recursive=True),
    "chain_more": oracle("SELECT log_id, max(seq) + 1 AS first_seq, 2 * max(seq) AS last_seq, arg_max(hash, seq) AS first_prev FROM chain GROUP BY log_id",
                         "new_facts", extra=CHAIN, recursive=True),
    "verify_chain": oracle("""SELECT log_id, true AS ok, count(*) AS entries, arg_max(hash, seq) AS head, CAST(NULL AS BIGINT) AS broken_at,
        CAST(NULL AS VARCHAR) AS reason FROM chain GROUP BY log_id""", "new_facts", extra=CHAIN, recursive=True),
    "verify_chain_tampered": oracle(f"""SELECT log_id, broken_at IS NULL AS ok, CASE WHEN how = 'gone' THEN 1 WHEN broken_at IS NULL THEN n ELSE broken_at - 1 END AS entries, broken_at,
        CASE how WHEN 'edited' THEN 'content' WHEN 'cut' THEN 'link' WHEN 'unlinked' THEN 'link' WHEN 'unhashed' THEN 'content'
          WHEN 'gone' THEN 'sequence' END AS reason FROM (
        SELECT log_id, count(*) AS n, max(how) AS how, CASE max(how) WHEN 'edited' THEN 4 WHEN 'cut' THEN 3 WHEN 'unlinked' THEN 5 WHEN 'unhashed' THEN 6 WHEN 'gone' THEN CASE WHEN count(*) > 2 THEN 3 END END::BIGINT AS broken_at
        FROM (SELECT *, {TAMPERED} AS how FROM (SELECT *, CAST(substring(log_id, 4) AS BIGINT) AS user_no FROM chain)) GROUP BY log_id)""",
        "new_facts", extra=CHAIN, recursive=True),
    "in_effect_rows": oracle("SELECT seq, ets < TIMESTAMP '2024-01-16 00:00:00' AS by_day, ets <= TIMESTAMP '2024-01-15 10:00:00' AS by_time FROM facts", "facts"),
    "bad_instants": oracle("SELECT seq, concat(effective_from, '?') AS effective_from FROM facts WHERE event_type = 'view'", "facts"),
    "gate": oracle("SELECT * FROM statuses", "facts", extra=GATE),
    "gate_decision": oracle("""SELECT count(*) FILTER (WHERE status = 'BLOCKED') AS blocked, count(*) FILTER (WHERE status = 'CLEARED') AS cleared,
        count(*) FILTER (WHERE status = 'UNKNOWN') AS unknown, bool_and(status = 'CLEARED') AS passed, bool_and(status = 'UNKNOWN') AS none_recognised FROM statuses""",
        "facts", extra=GATE),
    "gate_report": oracle("""SELECT * FROM (SELECT status, subject, row_number() OVER (PARTITION BY status ORDER BY subject) AS place, count(*) OVER (PARTITION BY status) AS total FROM statuses) WHERE place <= 20""",
                          "facts", extra=GATE),
    "policy_history": oracle("SELECT log_id, seq, subject AS version, effective_from, actor FROM facts WHERE event_type = 'signup'", "facts"),
    "policy_in_force": oracle("""SELECT d.log_id, d.as_of, a.subject AS version, a.seq FROM (
          SELECT log_id, as_of, CASE WHEN length(as_of) = 10 THEN CAST(as_of AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND
            ELSE CAST(substring(as_of, 1, 19) AS TIMESTAMP) END AS cutoff FROM dates) d
        ASOF LEFT JOIN (SELECT ets, max(seq) AS seq, arg_max(subject, seq) AS subject FROM facts WHERE event_type = 'signup' GROUP BY ets) a ON d.cutoff >= a.ets""",
        "facts", extra="dates AS (" + DATES + ")"),
    "subject_history": oracle("""SELECT s.subject, f.seq IS NOT NULL AS known, f.seq, f.event_type, f.effective_from
        FROM (""" + SUBJECTS + """) s LEFT JOIN facts f ON f.subject = s.subject""", "facts"),
}
