"""A log verified window by window as it grows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wakeline.functions.canonical import GENESIS, event_hash
from wakeline.operators.ledger import CUT, EDITED, SEQUENCE
from wakeline.streaming.common import latest_state, start_upserts, with_keyed_state

HEAD = "seq bigint, hash string, entries bigint, broken_at bigint, reason string"


class _Heads(StatefulProcessor):
    """One head per log. A log that broke stays broken where it did; the next window of any other must continue from its head."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A window's entries of one log, without their bodies: their content was held against their hash before.
        window = [e for batch in rows for e in batch[["seq", "prev_hash", "hash", "whole"]].itertuples(index=False, name=None)]
        seq, last, entries, broken_at, _ = self.head.get() or (0, GENESIS, 0, None, None)
        if broken_at is not None:
            return
        broken_at, reason, good, last = follow(window, seq, last)
        head = (seq + good, last, entries + good, broken_at, reason)
        self.head.update(head)
        yield pd.DataFrame([(key[0], *head)], columns=["log_id", "seq", "hash", "entries", "broken_at", "reason"]).astype({"broken_at": "Int64"})

    def close(self) -> None:
        pass


def follow(window: list[tuple], seq: int, last: str) -> tuple[int | None, str | None, int, str]:
    """
    The first break (or None) with its reason among entries (seq, prev_hash,
    hash, whole) that should continue `seq` and `last`, how many entries come
    before it, and the hash they end at.
    """
    window = [(None if pd.isna(e[0]) else int(e[0]), *e[1:]) for e in window]
    copies = Counter(e[0] for e in window)
    hashes = {e[0]: e[2] for e in window} | {seq: last}
    broken_at, reason = None, None
    for at, prev, own, whole in sorted(window, key=lambda e: e[0] or 0):
        if at is None or at <= seq or copies[at] > 1 or hashes.get(at - 1) is None:
            reason = SEQUENCE
        elif prev is None or prev != hashes[at - 1]:
            reason = CUT
        elif not whole:
            reason = EDITED
        if reason:
            broken_at = at or 0
            break
    good = [e for e in window if e[0] is not None and (broken_at is None or e[0] < broken_at)]
    return broken_at, reason, len(good), last if broken_at is not None or not good else hashes[max(e[0] for e in good)]


def stream_heads(entries: DataFrame) -> DataFrame:
    """
    The heads (log_id, seq, hash, entries, broken_at, reason) that a micro-batch
    changes, for update mode. Contents are hashed in the JVM, wherever the
    entries are; only links travel to their log's head, which is state.
    """
    links = entries.select("log_id", "seq", "prev_hash", "hash", F.coalesce(event_hash().eqNullSafe(F.col("hash")) & F.col("hash").isNotNull(), F.lit(False)).alias("whole"))
    return with_keyed_state(links.groupBy("log_id"), _Heads(), f"log_id string, {HEAD}")


def start_verify_chain(entries: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Verify each micro-batch from the heads before it. Only changed heads are written, one folder per batch under `path`."""
    return start_upserts(stream_heads(entries), path, checkpoint, once)


def heads_now(spark, path: str) -> DataFrame:
    """The last word on every log."""
    return latest_state(spark.read.parquet(path), "log_id")
