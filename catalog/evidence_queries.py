"""Registered queries over sealed answers."""

from pyspark.sql import functions as F

from catalog.ledger_queries import CHAIN, _tampered
from catalog.policy_queries import ACTION, FACTS, V2, decided
from catalog.tables import oracle, run_sql, staged, table
from wakeline.operators import evidence as e
from wakeline.operators import ledger, policy

# Every document is a bundle of two files; some are unreadable, altered or incomplete.
NAMES = """SELECT concat('b', doc_id) AS bundle, doc_id, lang, source, text, {each:'text.json', 'meta.json', 'extra.txt', 'manifest.json'} AS name FROM {documents}"""
WINDOW = "concat(log_id, '-', CAST(floor((seq - 1) / 20) AS INT))"
GATES = """SELECT concat('g', r_regionkey) AS bundle, concat('2024-01-1', 2 + r_regionkey) AS as_of, r_regionkey % 2 = 0 AS unknown_blocks, false AS passed FROM {region}"""
DECISIONS = """SELECT concat('c', conv_id, '-', turn) AS bundle, CASE WHEN conv_id % 3 = 0 THEN 'ask' ELSE 'dismiss' END AS decision,
  CASE WHEN conv_id % 3 = 0 THEN concat('kind:', conv_id % 9) END AS trigger, {H}(concat(text, CASE WHEN conv_id % 5 = 0 THEN 'x' ELSE '' END)) AS incident,
  CASE WHEN conv_id % 7 = 0 THEN ' ' ELSE role END AS actor, concat('q', conv_id % 4) AS request_sha256, 's1' AS settings_hash
FROM {conversations}"""
RECORDS = """SELECT concat('c', conv_id, '-', turn) AS bundle, {H}(text) AS incident, concat('q', conv_id % 6) AS request_sha256, 's1' AS settings_hash FROM {conversations}"""
DECIDED_PLANS = """SELECT concat('c', conv_id, '-', turn) AS bundle, concat('kind:', conv_id % 9 % 6) AS trigger FROM {conversations} WHERE conv_id % 4 < 2"""
# A bundle seals a run of 300 tasks, so it stays of one size and their number follows the tables.
ASKED = """SELECT concat('b', CAST(floor(CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey + 1 ELSE o_orderkey END / 300) AS BIGINT)) AS bundle, concat('o', o_orderkey) AS task FROM {orders}"""
COPIES = """SELECT concat('m', CASE WHEN twice = 0 THEN seq % 3 ELSE (seq + 1) % 3 END) AS bundle, seq, effective_from, recorded_at, actor, event_type, subject, body,
  CASE WHEN twice = 1 AND seq % 50 = 0 THEN concat(hash, 'x') ELSE hash END AS hash FROM (SELECT *, {each:0, 1} AS twice FROM {T:facts} q) f"""


def _files(spark, sf):
    rows = run_sql(spark, sf, NAMES)
    text, meta = F.to_json(F.struct("text")), F.to_json(F.struct("lang", "source"))
    key = F.col("doc_id")
    listed = F.create_map(
        F.when(key % 11 == 0, "../text.json").otherwise("text.json"), F.sha2(F.when(key % 19 == 0, F.lit("{}")).otherwise(text), 256),
        F.lit("meta.json"), F.sha2(meta, 256), F.when(key % 17 == 0, "gone.json").otherwise("meta2"), F.lit("0"))
    listed = F.map_filter(listed, lambda n, _: n != "meta2")
    content = (F.when(F.col("name") == "text.json", text).when(F.col("name") == "meta.json", F.when(key % 7 == 0, '{"lang": ').otherwise(meta))
               .when(F.col("name") == "extra.txt", "x").otherwise(F.to_json(F.struct(listed.alias("files")))))
    kept = ((F.col("name") != "extra.txt") | (key % 23 == 0)) & ((F.col("name") != "manifest.json") | (key % 13 != 0))
    return rows.where(kept).select("bundle", "name", content.alias("content"))


def load_bundles(spark, sf):
    return e.load_bundles(_files(spark, sf)).select("bundle", "name")


def verify_files(spark, sf):
    files = _files(spark, sf)
    listed = e.listed_files(e.manifests(files).where("m IS NOT NULL"))
    actual = files.join(listed.select("bundle").distinct(), "bundle", "left_semi").select("bundle", "name", F.sha2("content", 256).alias("sha256"))
    return e.verify_files(listed, actual)


def _anchors(spark, sf):
    rows = table(spark, sf, "chain").withColumn("bundle", F.expr(WINDOW))
    ends = rows.groupBy("bundle", "log_id").agg(
        F.max("seq").alias("head_seq"), F.max_by("hash", "seq").alias("head_hash"),
        (F.min("seq") - 1).alias("since_seq"), F.min_by("prev_hash", "seq").alias("since_hash"))
    later = F.col("since_seq") > 0
    return ends.withColumn("previous_bundle", F.when(later, F.expr("concat(log_id, '-', CAST(since_seq / 20 AS INT) - 1)"))).withColumn(
        "previous_seq", F.when(later, F.when(F.substring("log_id", 4, 9).cast("int") % 7 == 3, F.col("since_seq") - 1).otherwise(F.col("since_seq")))).withColumn(
        "previous_hash", F.when(later, F.col("since_hash"))).withColumn(
        "head_hash", F.when(F.substring("log_id", 4, 9).cast("int") % 13 != 12, F.col("head_hash"))).drop("log_id")


def verify_log_window(spark, sf):
    entries = _tampered(spark, sf).withColumn("bundle", F.expr(WINDOW)).drop("log_id", "user_no", "how")
    return e.verify_log_window(entries, _anchors(spark, sf))


def witness(spark, sf):
    live = table(spark, sf, "chain").withColumn("user_no", F.expr("CAST(substring(log_id, 4) AS BIGINT)")).withColumn("bundle", F.expr(WINDOW))
    live = live.where("NOT (user_no % 4 = 1 AND seq % 20 = 0)").withColumn(
        "hash", F.when((F.col("user_no") % 4 == 2) & (F.col("seq") % 20 == 0), "0").otherwise(F.col("hash")))
    return e.witness(_anchors(spark, sf), live)


def bundle_integrity(spark, sf):
    """Every check there is, one row per bundle."""
    return e.bundle_integrity(*(check(spark, sf) for check in (
        verify_files, verify_log_window, witness, verify_policy, verify_replay, verify_gate, verify_decision)))


def bundles_rechained(spark, sf):
    """The log window of every bundle from the document that seals it."""
    entries = _tampered(spark, sf).withColumn("bundle", F.expr(WINDOW))
    sealed = entries.groupBy("bundle").agg(F.to_json(F.collect_list(F.struct(
        "seq", "effective_from", "recorded_at", "actor", "event_type", "subject", "body", "prev_hash", "hash"))).alias("content"))
    return e.verify_log_window(e.bundled_entries(sealed.withColumn("name", F.lit("events.json"))), _anchors(spark, sf))


def bundles_replayed(spark, sf):
    """Every plan from the document that seals it, under the policies sealed in the bundles."""
    lines = _items(spark, sf).groupBy("bundle").agg(F.collect_list(F.struct(
        "task", "contribution", "storage", "scope", "released", "mode", "action", "rule", "possible")).alias("plan"))
    counts = _header_counts(spark, sf).groupBy("bundle").agg(F.map_from_entries(F.collect_list(F.struct("verdict", "tasks"))).alias("actions"))
    heads = _plans(spark, sf).join(lines, "bundle").join(counts, "bundle")
    sealed = heads.select("bundle", F.lit("plan.json").alias("name"), F.to_json(F.struct(*[c for c in heads.columns if c != "bundle"])).alias("content"))
    plans, items, said = e.bundled_plans(sealed)
    return e.verify_replay(plans, items, said, policy.sealed_decisions(_sealed_policies(spark, sf)))


def _items(spark, sf):
    return staged(spark, sf, "bundle-items", lambda: _items_made(spark, sf))


def _items_made(spark, sf):
    items = policy.decide(run_sql(spark, sf, FACTS), policy.decision_table(spark))
    return items.withColumn("bundle", F.expr("concat('b', CAST(floor(CAST(substring(task, 2) AS BIGINT) / 300) AS BIGINT))"))


def _plans(spark, sf):
    cited = F.when(F.col("n") % 2 == 0, policy.fingerprint(policy.V1)).otherwise(policy.fingerprint(V2))
    return _items(spark, sf).groupBy("bundle").agg(F.count("*").alias("items")).withColumn("n", F.substring("bundle", 2, 9).cast("int")).select(
        "bundle", F.concat(F.lit("nation:"), "n").alias("trigger"), F.when(F.col("n") % 2 == 0, "v1").otherwise("v2").alias("policy_version"),
        cited.alias("policy_hash"), F.col("items").alias("tasks_total"),
        F.when(F.col("n") % 10 == 4, F.col("items") + 1).otherwise(F.col("items")).alias("tasks_affected"))


def _header_counts(spark, sf):
    counts = policy.plan_actions(_items(spark, sf), "bundle")
    off = (F.col("bundle") == "b8") & (F.col("verdict") == "REGENERATE")
    return counts.withColumn("tasks", F.when(off, F.col("tasks") + 1).otherwise(F.col("tasks")))


def _decisions(spark):
    return policy.decision_table(spark, policy.V1, V2).drop("policy")


def verify_replay(spark, sf):
    return e.verify_replay(_plans(spark, sf), _items(spark, sf).drop("reason", "decided"), _header_counts(spark, sf),
                           policy.sealed_decisions(_sealed_policies(spark, sf)))


def replay_lines(spark, sf):
    items = _items(spark, sf).drop("reason", "decided").join(_plans(spark, sf).select("bundle", "policy_hash"), "bundle")
    return e.replay(items, _decisions(spark)).where("NOT agrees").select("bundle", "task", "sealed_action", "sealed_rule", "action", "rule")


def _sealed_policies(spark, sf):
    # Each bundle seals the table as indented text; one in five seals the other one.
    import json
    one, two = (json.dumps(p, indent=2) for p in (policy.V1, V2))
    n = F.substring("bundle", 2, 9).cast("int")
    return _plans(spark, sf).select("bundle", F.when(n % 5 == 0, F.when(n % 2 == 0, two).otherwise(one)).otherwise(
        F.when(n % 2 == 0, one).otherwise(two)).alias("content"))


def verify_policy(spark, sf):
    return e.verify_policy(_plans(spark, sf), _sealed_policies(spark, sf))


def verify_gate(spark, sf):
    facts = table(spark, sf, "facts").drop("ets").withColumn("bundle", F.explode(F.array(*[F.lit(f"g{i}") for i in range(5)])))
    gates = run_sql(spark, sf, GATES)
    sealed = ledger.gate(facts.select("subject").distinct(), table(spark, sf, "facts"), ["error"], ["purchase"], "2024-01-14").select("subject", "status")
    subjects = sealed.withColumn("bundle", F.explode(F.array(*[F.lit(f"g{i}") for i in range(5)])))
    types = gates.select("bundle", F.explode(F.create_map(F.lit("error"), F.lit(True), F.lit("purchase"), F.lit(False))).alias("event_type", "blocks"))
    # One sealed gate has no outcome, another one some subjects without a status.
    gates = gates.withColumn("passed", F.when(F.col("bundle") != "g3", F.col("passed")))
    subjects = subjects.withColumn("status", F.when(~((F.col("bundle") == "g4") & F.endswith("subject", F.lit("7"))), F.col("status")))
    return e.verify_gate(gates, subjects, types, facts)


def gate_result(spark, sf):
    sealed = ledger.gate(table(spark, sf, "facts").select("subject").distinct(), table(spark, sf, "facts"), ["error"], ["purchase"], "2024-01-14")
    return e.gate_result(run_sql(spark, sf, GATES), sealed.select("subject", "status", F.explode(F.array(*[F.lit(f"g{i}") for i in range(5)])).alias("bundle")))


def verify_decision(spark, sf):
    return e.verify_decision(run_sql(spark, sf, DECISIONS), run_sql(spark, sf, RECORDS), run_sql(spark, sf, DECIDED_PLANS))


def merge_entries(spark, sf):
    return e.merge_entries(run_sql(spark, sf, COPIES)).select("bundle", "seq", "hash", "subject")


def log_conflicts(spark, sf):
    return e.log_conflicts(run_sql(spark, sf, COPIES))


def log_timeline(spark, sf):
    return e.log_timeline(run_sql(spark, sf, COPIES)).select("seq", "subject", "hash", "fields", "in_conflict")


def _rules(spark):
    rows = [(policy.fingerprint(p), r["id"], r["action"]) for p in (policy.V1, V2) for r in p["rules"]]
    return spark.createDataFrame(rows, "policy_hash string, rule string, rule_action string")


def verdict_lookup(spark, sf):
    return e.verdict_lookup(run_sql(spark, sf, ASKED), _plans(spark, sf), _items(spark, sf), _rules(spark)).select(
        "bundle", "task", "in_plan", "trigger", "policy_version", "action", "rule", "rule_action")


def was_affected(spark, sf):
    return e.was_affected(run_sql(spark, sf, ASKED), _items(spark, sf))


def plan_summary(spark, sf):
    return e.plan_summary(_plans(spark, sf), _items(spark, sf)).select("bundle", "trigger", "verdict", "tasks")


def _plan_anchors(spark, sf):
    return _plans(spark, sf).select("bundle").unionByName(run_sql(spark, sf, GATES).select("bundle")).unionByName(
        run_sql(spark, sf, DECISIONS).select("bundle")).select("bundle", F.lit(0).cast("bigint").alias("head_seq"), F.lit("0").alias("head_hash"))


def bundle_listing(spark, sf):
    return e.bundle_listing(_plan_anchors(spark, sf), _plans(spark, sf), run_sql(spark, sf, GATES)).select("bundle", "kind", "trigger", "policy_version")


def incident_summary(spark, sf):
    checks = e.bundle_integrity(verify_replay(spark, sf), verify_gate(spark, sf), verify_decision(spark, sf))
    return e.incident_summary(_plan_anchors(spark, sf), _plans(spark, sf), run_sql(spark, sf, GATES), run_sql(spark, sf, DECISIONS), checks)


def unknowns_rollup(spark, sf):
    sealed = ledger.gate(run_sql(spark, sf, "SELECT concat('u', c_custkey) AS subject FROM {customer}"), table(spark, sf, "facts"),
                         ["error"], ["purchase"], "2024-01-14").withColumn("bundle", F.lit("g0"))
    notes = table(spark, sf, "edges").where("target LIKE '%://%'").select(
        F.expr("concat('b', CAST(floor(CAST(substring(consumer, 2) AS BIGINT) / 300) AS BIGINT))").alias("bundle"), F.concat(F.lit("remote "), "flag").alias("note")).distinct()
    return e.unknowns_rollup(_items(spark, sf), sealed, notes)


def manifest_table(spark, sf):
    files = run_sql(spark, sf, "SELECT concat('b', doc_id % 40) AS bundle, concat(CASE WHEN doc_id % 50 = 0 THEN 'a/' ELSE '' END, 'doc-', doc_id) AS name, text AS content, doc_id FROM {documents}")
    n = F.substring("bundle", 2, 9).cast("bigint")
    anchors = files.select("bundle").distinct().select(
        "bundle", F.lit(30).cast("bigint").alias("head_seq"), n.alias("since_seq"), F.when(n % 3 == 0, "p").alias("previous_bundle"),
        F.when(n % 2 == 0, n).alias("previous_seq"))
    return e.manifest_table(files, anchors)


QUERIES = {f.__name__: f for f in (
    load_bundles, verify_files, verify_log_window, witness, bundle_integrity, bundles_rechained, bundles_replayed, verify_replay, replay_lines, verify_policy, verify_gate,
    verify_decision, merge_entries, log_conflicts, log_timeline, verdict_lookup, was_affected, plan_summary, gate_result, bundle_listing,
    incident_summary, unknowns_rollup, manifest_table)}

# ------------------------------------------------------------------ oracles

READABLE = "doc_id % 13 <> 0 AND doc_id % 11 <> 0 AND doc_id % 17 <> 0 AND doc_id % 7 <> 0"
WINDOWS = CHAIN + """windowed AS (SELECT *, concat(log_id, '-', CAST(floor((seq - 1) / 20) AS INT)) AS bundle, CAST(substring(log_id, 4) AS BIGINT) AS user_no FROM chain),
win AS (SELECT bundle, user_no, min(seq) - 1 AS since, max(seq) AS head, count(*) AS n FROM windowed GROUP BY ALL),
logcheck AS (SELECT bundle, CASE WHEN user_no % 13 = 12 THEN 'head:unrecorded' WHEN since > 0 AND user_no % 7 = 3 THEN 'start:differs'
    WHEN since = 0 AND user_no % 5 = 1 AND head >= 4 THEN 'broken:4:content'
    WHEN since = 0 AND user_no % 5 = 2 AND head >= 3 THEN 'broken:3:link'
    WHEN since = 0 AND user_no % 10 = 4 AND head >= 5 THEN 'broken:5:link'
    WHEN since = 0 AND user_no % 10 = 9 AND head >= 6 THEN 'broken:6:content'
    WHEN since = 0 AND user_no % 5 = 3 AND head >= 3 THEN 'broken:3:sequence'
    WHEN since = 0 AND user_no % 5 = 3 AND head = 2 THEN 'head:hash' END AS problem, n FROM win),
witnessed AS (SELECT bundle, CASE WHEN user_no % 13 = 12 THEN 'head unrecorded' WHEN user_no % 4 = 1 AND head % 20 = 0 THEN 'live log shorter'
    WHEN user_no % 4 = 2 AND head % 20 = 0 THEN 'live log differs' END AS problem FROM win),"""
_SECOND = ("CASE rule0 WHEN 'R3' THEN 'QUARANTINE' WHEN 'R7' THEN 'PURGE' ELSE " + ACTION.replace("{r}", "rule0") + " END",
           "CASE rule0 WHEN 'R7' THEN 'R7b' ELSE rule0 END", "second")
ITEMS = "facts AS (" + FACTS + ")," + decided("facts", "task") + decided("facts", "task", *_SECOND) + """
numbered AS (SELECT v.*, CAST(floor(CAST(substring(v.task, 2) AS BIGINT) / 300) AS BIGINT) AS n, w.action AS action2, w.rule AS rule2, w.possible AS possible2 FROM verdicts v JOIN second w USING (task)),
items AS (SELECT *, concat('b', n) AS bundle, n % 2 = 1 AND (action IS DISTINCT FROM action2 OR rule IS DISTINCT FROM rule2 OR possible IS DISTINCT FROM possible2) AS off FROM numbered),
lines AS (SELECT bundle, any_value(n) AS n, count(*) AS items, count(*) FILTER (WHERE off) AS bad FROM items GROUP BY bundle),
replayed AS (SELECT bundle, CASE WHEN bad > 0 THEN concat(bad, ' of ', items, ' items differ') WHEN n % 10 = 4 THEN concat('header:', items + 1, ' items:', items)
    WHEN n = 8 THEN 'header:counts' END AS problem, items FROM lines),"""
GATED = """allowed AS (SELECT g.bundle, g.as_of, g.unknown_blocks, f.subject, f.seq, f.event_type, f.ets FROM (""" + GATES + """) g JOIN facts_log f
    ON f.event_type IN ('error', 'purchase') AND f.ets < CAST(g.as_of AS TIMESTAMP) + INTERVAL 1 DAY),
again AS (SELECT bundle, subject, CASE arg_max(event_type, (ets, seq)) WHEN 'error' THEN 'BLOCKED' ELSE 'CLEARED' END AS status FROM allowed GROUP BY ALL),
users AS (SELECT DISTINCT subject FROM facts_log),
lined AS (SELECT g.bundle, g.unknown_blocks, u.subject, coalesce(s.status, 'UNKNOWN') AS sealed, coalesce(a.status, 'UNKNOWN') AS status FROM (""" + GATES + """) g JOIN users u ON true
  LEFT JOIN again a ON a.bundle = g.bundle AND a.subject = u.subject LEFT JOIN again s ON s.bundle = 'g2' AND s.subject = u.subject),
outcome AS (SELECT bundle, NOT (bool_or(status = 'BLOCKED') OR (any_value(unknown_blocks) AND bool_or(status = 'UNKNOWN'))) AS passes,
    count(*) FILTER (WHERE status <> sealed OR (bundle = 'g4' AND subject LIKE '%7')) AS differ, count(*) AS n FROM lined GROUP BY bundle),
gated AS (SELECT bundle, CASE WHEN passes OR bundle = 'g3' THEN concat('passed:', passes) WHEN differ > 0 THEN concat(differ, ' subjects differ') END AS problem, n FROM outcome),"""
DECIDED = """dec AS (""" + DECISIONS + """), rec AS (""" + RECORDS + """), pl AS (""" + DECIDED_PLANS + """),
decisions AS (SELECT d.bundle, d.actor, nullif(concat_ws('; ', CASE WHEN pl.bundle IS NULL AND decision <> 'dismiss' THEN 'ask-without-plan' END,
    CASE WHEN pl.bundle IS NOT NULL AND NOT (decision = 'ask' AND d.trigger = pl.trigger) THEN 'other-trigger' END,
    CASE WHEN d.incident <> r.incident THEN 'other-incident' END, CASE WHEN trim(actor) = '' THEN 'no-actor' END,
    CASE WHEN d.request_sha256 <> r.request_sha256 THEN 'other-request' END), '') AS problem
  FROM dec d JOIN rec r ON r.bundle = d.bundle LEFT JOIN pl ON pl.bundle = d.bundle),"""
FACTS_LOG = "facts_log AS (SELECT * FROM {T:facts} q),"
MERGED = """copies AS (""" + COPIES + """), once AS (SELECT hash, min(bundle) AS bundle, any_value(seq) AS seq, any_value(subject) AS subject, any_value(body) AS body FROM copies GROUP BY hash),
merged AS (SELECT seq, min(bundle) AS bundle, arg_min(hash, concat(bundle, hash)) AS hash, any_value(subject) AS subject, any_value(body) AS body FROM once GROUP BY seq),"""
_V = "CASE WHEN n % 2 = 0 THEN 'v1' ELSE 'v2' END"

ORACLES = {
    "load_bundles": oracle(f"""SELECT bundle, name FROM names WHERE {READABLE} AND (name <> 'extra.txt' OR doc_id % 23 = 0)""", extra="names AS (" + NAMES + ")"),
    "verify_files": oracle("""SELECT bundle, 'files' AS check, detail LIKE '2 files%' AS ok, detail FROM (SELECT concat('b', doc_id) AS bundle,
        CASE WHEN doc_id % 11 = 0 THEN 'unsafe: ../text.json' WHEN doc_id % 17 = 0 THEN 'absent: gone.json'
          WHEN doc_id % 7 = 0 THEN 'altered: meta.json' WHEN doc_id % 19 = 0 THEN 'altered: text.json'
          WHEN doc_id % 23 = 0 THEN 'extra: extra.txt' ELSE '2 files same' END AS detail FROM documents WHERE doc_id % 13 <> 0)"""),
    "verify_log_window": oracle("SELECT bundle, 'log' AS check, problem IS NULL AS ok, coalesce(problem, concat(n, ' entries chain')) AS detail FROM logcheck",
                                "new_facts", extra=WINDOWS, recursive=True),
    "witness": oracle("SELECT bundle, 'witness' AS check, problem IS NULL AS ok, coalesce(problem, 'live log has it') AS detail FROM witnessed",
                      "new_facts", extra=WINDOWS, recursive=True),
    "verify_replay": oracle("SELECT bundle, 'replay' AS check, problem IS NULL AS ok, coalesce(problem, concat(items, ' items same')) AS detail FROM replayed", extra=ITEMS),
    "replay_lines": oracle("SELECT bundle, task, action AS sealed_action, rule AS sealed_rule, action2 AS action, rule2 AS rule FROM items WHERE off", extra=ITEMS),
    "verify_policy": oracle("""SELECT bundle, 'policy' AS check, n % 5 <> 0 AS ok, CASE WHEN n % 5 = 0 THEN 'policy:differs'
        ELSE 'policy:same' END AS detail FROM lines""", extra=ITEMS),
    "verify_gate": oracle("SELECT bundle, 'gate' AS check, problem IS NULL AS ok, coalesce(problem, concat(n, ' subjects same')) AS detail FROM gated", extra=FACTS_LOG + GATED),
    "verify_decision": oracle("SELECT bundle, 'decision' AS check, problem IS NULL AS ok, coalesce(problem, 'record:same') AS detail FROM decisions", extra=DECIDED),
    "merge_entries": oracle("SELECT bundle, seq, hash, subject FROM merged", extra=MERGED),
    "log_conflicts": oracle("SELECT seq, count(DISTINCT hash) AS entries, count(DISTINCT bundle) AS bundles FROM copies GROUP BY seq HAVING count(DISTINCT hash) > 1", extra=MERGED),
    "log_timeline": oracle("""SELECT seq, subject, hash, concat('k=', regexp_extract(body, ': ([0-9]+)', 1)) AS fields, seq % 50 = 0 AS in_conflict FROM merged""", extra=MERGED),
    "verdict_lookup": oracle(f"""SELECT a.bundle, a.task, i.task IS NOT NULL AS in_plan, concat('nation:', l.n) AS trigger, {_V.replace('n %', 'l.n %')} AS policy_version, i.action, i.rule,
        CASE WHEN l.n % 2 = 1 AND i.rule = 'R3' THEN 'QUARANTINE' WHEN l.n % 2 = 1 AND i.rule = 'R7' THEN NULL WHEN i.rule IS NOT NULL THEN {ACTION.replace('{r}', 'i.rule')} END AS rule_action
        FROM asked a LEFT JOIN items i ON i.bundle = a.bundle AND i.task = a.task JOIN lines l ON l.bundle = a.bundle""", extra=ITEMS + "asked AS (" + ASKED + ")"),
    "was_affected": oracle("SELECT a.bundle, a.task, i.task IS NOT NULL AS affected FROM asked a LEFT JOIN items i ON i.bundle = a.bundle AND i.task = a.task",
                           extra=ITEMS + "asked AS (" + ASKED + ")"),
    "plan_summary": oracle("SELECT bundle, concat('nation:', n) AS trigger, coalesce(action, 'UNDETERMINED') AS verdict, count(*) AS tasks FROM items GROUP BY ALL", extra=ITEMS),
    "gate_result": oracle("""SELECT g.bundle, g.as_of, g.passed, count(*) FILTER (WHERE sealed = 'BLOCKED') AS blocked, count(*) FILTER (WHERE sealed = 'CLEARED') AS cleared,
        count(*) FILTER (WHERE sealed = 'UNKNOWN') AS unknown FROM (""" + GATES + """) g JOIN lined l ON l.bundle = g.bundle GROUP BY ALL""", extra=FACTS_LOG + GATED),
    "bundle_listing": oracle(f"""SELECT bundle, 'plan' AS kind, concat('nation:', n) AS trigger, {_V} AS policy_version FROM lines
        UNION ALL SELECT bundle, 'gate', NULL, NULL FROM ({GATES}) UNION ALL SELECT bundle, 'unknown', NULL, NULL FROM ({DECISIONS})""", extra=ITEMS),
    "incident_summary": oracle(f"""SELECT l.bundle, 'plan' AS kind, concat('nation:', n) AS trigger, concat('asked, ', CASE WHEN n % 10 = 4 THEN l.items + 1 ELSE l.items END, ' of ', l.items, ' tasks') AS outcome,
          CAST(NULL AS VARCHAR) AS by, problem IS NULL AS all_passed FROM lines l JOIN replayed r ON r.bundle = l.bundle
        UNION ALL SELECT bundle, 'gate', NULL, 'STOP', NULL, problem IS NULL FROM gated
        UNION ALL SELECT bundle, 'decision', 'none', 'dismissed', actor, problem IS NULL FROM decisions""", extra=ITEMS + FACTS_LOG + GATED + DECIDED),
    "unknowns_rollup": oracle("""SELECT note, count(*) AS bundles, CAST(sum(n) AS BIGINT) AS count FROM (
        SELECT 'no verdict' AS note, bundle, count(*) AS n FROM items WHERE action IS NULL GROUP BY bundle
        UNION ALL SELECT 'no status', 'g0', count(*) FROM customer c WHERE concat('u', c_custkey) NOT IN (SELECT subject FROM again WHERE bundle = 'g2')
        UNION ALL SELECT DISTINCT concat('remote ', flag), concat('b', CAST(floor(CAST(substring(consumer, 2) AS BIGINT) / 300) AS BIGINT)), 1 FROM edges WHERE target LIKE '%://%') GROUP BY note""",
        "edges", extra=ITEMS + FACTS_LOG + GATED),
    "manifest_table": oracle("""SELECT concat('b', doc_id % 40) AS bundle, name, sha256(text) AS sha256, CAST(30 AS BIGINT) AS head_seq, n AS since_seq,
        CASE WHEN name LIKE '%/%' THEN 'name:unsafe' WHEN n > 30 THEN 'window:past-head' WHEN n > 0 AND n % 2 = 1 THEN 'window:gap'
          WHEN n > 0 AND n % 3 <> 0 THEN 'window:unnamed' END AS problem
        FROM (SELECT *, doc_id % 40 AS n, concat(CASE WHEN doc_id % 50 = 0 THEN 'a/' ELSE '' END, 'doc-', doc_id) AS name FROM documents)"""),
}

# Documents in between change nothing; and one row per bundle over all checks.
ORACLES |= {"bundles_rechained": ORACLES["verify_log_window"], "bundles_replayed": ORACLES["verify_replay"]}
ORACLES["bundle_integrity"] = "SELECT bundle, count(*) AS checks, count(*) FILTER (NOT ok) AS failed, bool_and(ok) AS all_passed FROM (" + " UNION ALL BY NAME ".join(
    f"SELECT bundle, ok FROM ({ORACLES[c]})" for c in ("verify_files", "verify_log_window", "witness", "verify_policy", "verify_replay", "verify_gate", "verify_decision")) + ") GROUP BY bundle"
