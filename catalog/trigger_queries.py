"""Registered queries that resolve triggers to entry tasks."""

from pyspark.sql import functions as F

from catalog.tables import oracle, run_sql, table
from wakeline.functions.text import ignored
from wakeline.operators import triggers as t

CONTAINER_NEEDLES = """SELECT DISTINCT concat('container:', lower(c_mktsegment), v) AS trigger_id, concat(lower(c_mktsegment), v) AS needle
FROM (SELECT c_mktsegment, {each:'', ':1.2', ':1.1', ':1.11'} AS v FROM {customer}) x"""
# Every word of a part name and every process word is looked for.
FIELD_NEEDLES = """SELECT DISTINCT concat('process:', o_orderpriority) AS trigger_id, o_orderpriority AS needle FROM {orders}
UNION SELECT DISTINCT concat('process:', substring(o_orderpriority, 3, 2)), substring(o_orderpriority, 3, 2) FROM {orders}"""
INPUT_NEEDLES = """SELECT concat('input:part-', p_partkey, '.dat') AS trigger_id, concat('part-', p_partkey, '.dat') AS needle FROM {part}
UNION ALL SELECT concat('input:part-', p_partkey), concat('part-', p_partkey) FROM {part}"""
LABEL_WANTED = """SELECT DISTINCT concat('segment:', c_mktsegment) AS trigger_id, 'segment' AS key, c_mktsegment AS value FROM {customer}
UNION SELECT DISTINCT concat('flag:', l_returnflag), 'flag', l_returnflag FROM {lineitem}"""
# Display names with lane suffixes, and output paths that mention customers.
LANES = """SELECT 'r0' AS run_id, concat('o', o_orderkey) AS task,
  CASE o_orderkey % 4 WHEN 0 THEN concat('ALIGN (C', o_custkey, '-L', o_orderkey % 3, ')') WHEN 1 THEN concat('ALIGN (C', o_custkey, '.x_y) ')
    WHEN 2 THEN concat('ALIGN (C', o_custkey, ')') ELSE 'MERGE' END AS name FROM {orders}"""
MENTIONS = """SELECT 'r0' AS run_id, concat('o', o_orderkey) AS task,
  concat('trim (out/C', o_custkey, '_', o_orderkey % 9, '.C', o_orderkey % 100, '-x.fq)') AS name FROM {orders}"""
LIBRARY = """SELECT concat('part-', p_partkey, '.dat') AS filename, concat(p_brand, '/', p_partkey % 10) AS id FROM {part}"""
SPECS = """SELECT concat('nation:', n_name) AS spec, 'remove' AS mode FROM {nation}
UNION ALL SELECT DISTINCT concat('segment:', c_mktsegment), 'trace' FROM {customer}
UNION ALL SELECT DISTINCT concat('segment:', c_mktsegment), 'remove' FROM {customer}
UNION ALL SELECT DISTINCT concat('container:', lower(c_mktsegment)), 'trace' FROM {customer}
UNION ALL SELECT concat('input:part-', p_partkey, '.dat'), 'trace' FROM {part}
UNION ALL SELECT DISTINCT concat('process:', o_orderpriority), 'trace' FROM {orders}
UNION ALL SELECT r_name, 'trace' FROM {region}
UNION ALL SELECT concat('region:', r_name, ':x'), 'trace' FROM {region}
UNION ALL SELECT concat('flag:', r_name), 'trace' FROM {region}"""


def _triggers(spark, sf):
    return t.parse_specs(run_sql(spark, sf, SPECS)).withColumn("trigger_id", F.concat_ws("@", "spec", "mode"))


def _nations(spark, sf):
    labels = table(spark, sf, "sheet").withColumnRenamed("member", "label")
    return {"nation": lambda tasks, edges: t.entries_by_tag(tasks, labels).withColumnRenamed("owner", "value")}


def _checked(spark, sf):
    keys = t.label_keys(table(spark, sf, "tasks"), table(spark, sf, "edges"))
    return t.check_triggers(_triggers(spark, sf), keys, declared=["nation"], removable=["nation"])


def match_container(spark, sf):
    return t.match_container(table(spark, sf, "images"), run_sql(spark, sf, CONTAINER_NEEDLES))


def match_field(spark, sf):
    return t.match_field(table(spark, sf, "tasks"), run_sql(spark, sf, FIELD_NEEDLES), "process")


def match_external_input(spark, sf):
    return t.match_external_input(table(spark, sf, "edges"), run_sql(spark, sf, INPUT_NEEDLES))


def match_label(spark, sf):
    return t.match_label(table(spark, sf, "tasks"), table(spark, sf, "edges"), run_sql(spark, sf, LABEL_WANTED))


def parse_specs(spark, sf):
    return _triggers(spark, sf).select("trigger_id", "kind", "value")


def resolve_triggers(spark, sf):
    asked = _checked(spark, sf).where("problem IS NULL")
    return t.resolve_triggers(asked, table(spark, sf, "tasks"), table(spark, sf, "edges"), _nations(spark, sf))


def trigger_guards(spark, sf):
    return t.trigger_guards(_checked(spark, sf), resolve_triggers(spark, sf)).select(
        "trigger_id", "problem", "entries", "state")


def pending_triggers(spark, sf):
    return _checked(spark, sf).select("trigger_id", "kind", "value", "mode", "problem")


def entries_by_tag(spark, sf):
    labels = table(spark, sf, "sheet").select(F.col("member").alias("label"), "owner")
    return t.entries_by_tag(run_sql(spark, sf, LANES), labels)


def entries_by_path_mention(spark, sf):
    return t.entries_by_path_mention(run_sql(spark, sf, MENTIONS), table(spark, sf, "sheet").select(F.col("member").alias("id")))


def entries_by_library(spark, sf):
    return t.entries_by_library(table(spark, sf, "edges"), run_sql(spark, sf, LIBRARY))


def library_classes(spark, sf):
    return t.library_classes(table(spark, sf, "edges"), run_sql(spark, sf, LIBRARY)).classes.withColumnsRenamed({"lefts": "tasks", "rights": "ids"})


def normalise_status(spark, sf):
    return table(spark, sf, "tasks").select("run_id", "task", t.normalise_status(F.col("engine_status")).alias("status"))


def ignore_globs(spark, sf):
    return table(spark, sf, "outputs").select("run_id", "task", "file").where(~ignored(F.col("file"), ("out-1.*", "*-[2-9].da?")))


def name_only_notes(spark, sf):
    images = table(spark, sf, "images")
    return t.name_only_notes(t.match_container(images, run_sql(spark, sf, CONTAINER_NEEDLES)), images)


def companion_notes(spark, sf):
    return t.companion_notes(match_external_input(spark, sf))


QUERIES = {f.__name__: f for f in (
    match_container, match_field, match_external_input, match_label, parse_specs, resolve_triggers, trigger_guards,
    pending_triggers, entries_by_tag, entries_by_path_mention, entries_by_library, library_classes, normalise_status, ignore_globs,
    name_only_notes, companion_notes)}

_IMAGE = """img AS (
  SELECT DISTINCT container, regexp_extract(split_part(regexp_replace(container, '^(docker|oras)://', ''), '@', 1), '[^/]*$') AS last FROM images WHERE container <> ''),
img2 AS (SELECT container, CASE WHEN last LIKE '%.sif' THEN left(last, length(last) - 4) ELSE last END AS last FROM img),
img3 AS (SELECT container,
  CASE WHEN last LIKE '%:%' THEN split_part(last, ':', 1) ELSE regexp_replace(last, '-[0-9].*$', '') END AS nm,
  CASE WHEN last LIKE '%:%' THEN split_part(last, ':', 2) WHEN regexp_matches(last, '-[0-9]') THEN regexp_extract(last, '-([0-9].*)$', 1) END AS v FROM img2),
img4 AS (SELECT container, nm, CASE WHEN v <> 'latest' AND NOT regexp_matches(split_part(v, '-', 1), '^[0-9a-f]{12,}$') THEN v END AS v FROM img3),
comp AS (SELECT DISTINCT container, v, unnest(list_append(string_split_regex(nm, '[_-]+'), nm)) AS part FROM img4),
needles AS (""" + CONTAINER_NEEDLES + """),
want AS (SELECT trigger_id, split_part(needle, ':', 1) AS part, nullif(split_part(needle, ':', 2), '') AS w FROM needles),
hits AS (SELECT trigger_id, container, CASE WHEN w IS NULL THEN 'exact' WHEN v IS NULL THEN 'name-only'
  WHEN starts_with(v, w) AND NOT regexp_matches(substring(v, length(w) + 1), '^[0-9]') THEN 'exact' END AS how
  FROM comp JOIN want ON comp.part = want.part),
matched AS (SELECT trigger_id, run_id, task, how, i.container FROM images i JOIN hits h ON i.container = h.container WHERE how IS NOT NULL),"""
_INPUT = """ext AS (SELECT DISTINCT run_id, consumer AS task, filename AS name FROM edges WHERE producer = 'EXTERNAL'),
needles AS (""" + INPUT_NEEDLES + """),
matched AS (SELECT trigger_id, run_id, task, name, name <> needle AS companion FROM ext JOIN needles
  ON needle = name OR needle = regexp_replace(name, '\\.dat$', '')),"""
_LABELS = """lab AS (SELECT run_id, task, 'segment' AS key, segment AS value FROM tasks
  UNION SELECT run_id, consumer, 'flag', flag FROM edges UNION SELECT run_id, producer, 'flag', flag FROM edges WHERE producer <> 'EXTERNAL'),"""
_TRIGGERS = """specs AS (""" + SPECS + """),
trig AS (SELECT concat(spec, '@', mode) AS trigger_id, split_part(spec, ':', 1) AS kind,
  CASE WHEN contains(spec, ':') THEN nullif(substring(spec, position(':' IN spec) + 1), '') END AS value, mode FROM specs),
checked AS (SELECT *, CASE WHEN value IS NULL THEN 'no value'
  WHEN kind NOT IN ('nation', 'container', 'script', 'process', 'input', 'segment', 'flag') THEN 'unknown kind'
  WHEN mode = 'remove' AND kind <> 'nation' THEN 'kind can only be traced' END AS problem FROM trig),"""
_RESOLVED = _TRIGGERS + _LABELS + """asked AS (SELECT * FROM checked WHERE problem IS NULL),
entries AS (
  SELECT trigger_id, run_id, task FROM asked JOIN sheet ON kind = 'nation' AND value = owner
    JOIN tasks ON regexp_extract(name, '\\(([^()]+)\\)\\s*$', 1) = member
  UNION SELECT trigger_id, run_id, task FROM asked JOIN tasks ON kind = 'container'
    AND value = split_part(regexp_extract(container, '[^/]*$'), ':', 1)
  UNION SELECT trigger_id, run_id, task FROM asked JOIN tasks ON kind = 'process' AND contains(process, value)
  UNION SELECT trigger_id, run_id, consumer FROM asked JOIN edges ON kind = 'input' AND producer = 'EXTERNAL' AND filename = value
  UNION SELECT trigger_id, run_id, task FROM asked JOIN lab ON kind = key AND asked.value = lab.value),"""

ORACLES = {
    "match_container": oracle("SELECT trigger_id, run_id, task, how FROM matched", "images", extra=_IMAGE),
    "match_field": oracle("SELECT trigger_id, run_id, task FROM tasks JOIN n ON contains(process, needle)", "tasks",
                          extra="n AS (" + FIELD_NEEDLES + ")"),
    "match_external_input": oracle("SELECT * FROM matched", "edges", extra=_INPUT),
    "match_label": oracle("SELECT trigger_id, run_id, task FROM lab JOIN w ON lab.key = w.key AND lab.value = w.value",
                          "tasks", "edges", extra=_LABELS + "w AS (" + LABEL_WANTED + ")"),
    "parse_specs": oracle("SELECT trigger_id, kind, value FROM trig", extra=_TRIGGERS),
    "resolve_triggers": oracle("SELECT *, 'exact' AS how FROM entries", "tasks", "edges", "sheet", extra=_RESOLVED),
    "trigger_guards": oracle("""SELECT c.trigger_id, problem, count(e.task) AS entries,
        CASE WHEN problem IS NOT NULL THEN 'REFUSED' WHEN count(e.task) = 0 THEN 'UNATTRIBUTED' ELSE 'ASKED' END AS state
        FROM checked c LEFT JOIN entries e ON c.trigger_id = e.trigger_id GROUP BY c.trigger_id, problem""",
        "tasks", "edges", "sheet", extra=_RESOLVED),
    "pending_triggers": oracle("SELECT trigger_id, kind, value, mode, problem FROM checked", extra=_TRIGGERS),
    "entries_by_tag": oracle("""SELECT owner, run_id, task FROM
        (SELECT run_id, task, regexp_extract(name, '\\(([^()]+)\\)\\s*$', 1) AS tag FROM lanes) JOIN sheet
        ON member = regexp_extract(tag, '^[^-_.]+')""", "sheet", extra="lanes AS (" + LANES + ")"),
    "entries_by_path_mention": oracle("""SELECT DISTINCT member AS id, run_id, task FROM
        (SELECT run_id, task, unnest(string_split_regex(regexp_extract(name, '\\(([^()]+)\\)', 1), '[-_./]')) AS word FROM m)
        JOIN sheet ON member = word""", "sheet", extra="m AS (" + MENTIONS + ")"),
    "entries_by_library": oracle("""SELECT id, run_id, task FROM (
        SELECT DISTINCT id, run_id, consumer AS task, filename FROM edges JOIN lib USING (filename)
        WHERE producer = 'EXTERNAL')""", "edges", extra="lib AS (" + LIBRARY + ")"),
    "library_classes": oracle("""SELECT filename, tasks, ids, tasks * ids AS pairs FROM
        (SELECT filename, count(DISTINCT (run_id, consumer)) AS tasks FROM edges WHERE producer = 'EXTERNAL' GROUP BY filename)
        JOIN (SELECT filename, count(DISTINCT id) AS ids FROM lib GROUP BY filename) USING (filename)""", "edges", extra="lib AS (" + LIBRARY + ")"),
    "normalise_status": oracle("""SELECT run_id, task, CASE engine_status WHEN 'DONE' THEN 'COMPLETED'
        WHEN 'FAILED' THEN 'FAILED' ELSE 'UNKNOWN' END AS status FROM tasks""", "tasks"),
    "ignore_globs": oracle("SELECT run_id, task, file FROM outputs WHERE file = 'out-0.dat'", "outputs"),
    "name_only_notes": oracle("""SELECT trigger_id, run_id, task, regexp_extract(container, '[^/]*$') AS image
        FROM matched WHERE how = 'name-only'""", "images", extra=_IMAGE),
    "companion_notes": oracle("SELECT trigger_id, name, count(*) AS tasks FROM matched WHERE companion GROUP BY ALL",
                              "edges", extra=_INPUT),
}
