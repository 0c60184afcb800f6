"""The state of every task as its events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.triggers import normalise_status
from wakeline.sources.common import task_table
from wakeline.sources.workdirs import parse_events


def stream_task_state(lines: DataFrame) -> DataFrame:
    """
    Tasks out of a stream of event lines (run_id, line_no, value), for update
    mode. A text stream has no line numbers, so the order comes with the
    record; the final state is the batch job's, however the lines were cut
    into batches. State is one row per task.
    """
    latest = parse_events(lines, "run_id", "line_no").groupBy("run_id", F.col("t.hash").alias("task")).agg(F.max_by("t", "line_no").alias("t"))
    held = lambda c: F.col(f"t.{c}")
    return task_table(latest, run_id=F.col("run_id"), task=F.col("task"), status=normalise_status(held("status")), engine_status=held("status"),
                      **{c: held(c) for c in ("name", "process", "container", "workdir", "script")})
