"""Registered streams: the tables written out as files, streamed back in several batches, run to their end."""

from pyspark.sql import functions as F

from catalog.ledger_queries import ORACLES as LEDGER_ORACLES, _tampered
from catalog.source_queries import ORACLES as SOURCE_ORACLES, weblog_lines
from catalog.tables import oracle, table
from wakeline.session import scratch_path
from wakeline.streaming.chain import heads_now, start_verify_chain
from wakeline.streaming.common import latest_state, start_upserts
from wakeline.streaming.gate import stream_gate as gate_stream, stream_gate_now
from wakeline.streaming.task_state import stream_task_state as task_stream


def _stream(df, order, key, label):
    """
    Rows as files that arrive slice by slice along `order`, all of a key's
    rows of one slice in one file, read as a stream one file at a time.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    low, high = df.agg(F.min(order), F.max(order)).first()
    slice_of = F.floor((F.col(order) - low) * 4 / (high - low + 1))
    for n in range(4):
        df.where(slice_of == n).repartition(2, key).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _finish(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _upserts(spark, changes, *keys):
    out = scratch_path(spark, "stream-out")
    _finish(start_upserts(changes, out, scratch_path(spark, "stream-checkpoint"), once=True))
    return latest_state(spark.read.parquet(out), *keys)


def stream_task_state(spark, sf):
    state = _upserts(spark, task_stream(_stream(weblog_lines(spark, sf), "line_no", "run_id", "events")), "run_id", "task")
    return state.select("run_id", "task", "name", "status", "engine_status")


def stream_gate(spark, sf):
    # Back to front, so later batches carry back-dated facts.
    facts = table(spark, sf, "facts").drop("ets").withColumn("arrival", -F.col("seq"))
    return _upserts(spark, gate_stream(_stream(facts, "arrival", "subject", "facts"), ["error"], ["purchase"], "2024-01-15"), "subject").select(
        "subject", "status", "seq", "event_type", "effective_from", "actor")


def stream_gate_moving(spark, sf):
    """Half of the facts take effect three days after they were recorded, and fall due by themselves as the log's clock passes them."""
    facts = table(spark, sf, "facts").drop("ets").withColumn("clock", F.to_timestamp("recorded_at"))
    later = F.date_format(F.col("clock") + F.expr("INTERVAL 3 DAYS"), "yyyy-MM-dd'T'HH:mm:ss")
    facts = facts.withColumn("effective_from", F.when(F.col("seq") % 2 == 0, later).otherwise(F.col("effective_from"))).withColumn("arrival", F.unix_micros("clock"))
    # Two files come at one time, so the clock of one may be a slice behind the other's.
    waiting = stream_gate_now(_stream(facts, "arrival", "subject", "facts"), ["error"], ["purchase"], clock="clock", delay="12 days")
    return _upserts(spark, waiting, "subject").select("subject", "status", "seq", "event_type")


def stream_verify_chain(spark, sf):
    out = scratch_path(spark, "heads")
    entries = _tampered(spark, sf).drop("user_no", "how")
    _finish(start_verify_chain(_stream(entries, "seq", "log_id", "chain"), out, scratch_path(spark, "stream-checkpoint"), once=True))
    return heads_now(spark, out).select("log_id", "entries", "broken_at", "reason")


QUERIES = {f.__name__: f for f in (stream_task_state, stream_gate, stream_gate_moving, stream_verify_chain)}

ORACLES = {
    "stream_task_state": SOURCE_ORACLES["ingest_weblog"],
    "stream_gate": oracle("""SELECT subject, CASE event_type WHEN 'error' THEN 'BLOCKED' ELSE 'CLEARED' END AS status, seq, event_type, effective_from, actor
        FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ets DESC, seq DESC) AS n FROM facts WHERE event_type IN ('error', 'purchase') AND ets < TIMESTAMP '2024-01-16') WHERE n = 1""", "facts"),
    "stream_gate_moving": oracle("""SELECT subject, CASE event_type WHEN 'error' THEN 'BLOCKED' ELSE 'CLEARED' END AS status, seq, event_type
        FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY due DESC, seq DESC) AS n
              FROM (SELECT *, CAST(substring(recorded_at, 1, 19) AS TIMESTAMP) AS clock,
                        CASE WHEN seq % 2 = 0 THEN CAST(substring(recorded_at, 1, 19) AS TIMESTAMP) + INTERVAL 3 DAY ELSE ets END AS due FROM facts)
              WHERE event_type IN ('error', 'purchase')
                AND due <= (SELECT max(CAST(substring(recorded_at, 1, 19) AS TIMESTAMP)) FROM facts) - INTERVAL 12 DAY)
        WHERE n = 1""", "facts"),
    "stream_verify_chain": "SELECT log_id, entries, broken_at, reason FROM (" + LEDGER_ORACLES["verify_chain_tampered"] + ")",
}
