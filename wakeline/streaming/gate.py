"""The gate over facts as they arrive, back-dated and future-dated ones included."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wakeline.operators.ledger import BLOCKED, CLEARED, check_types, decisive_facts
from wakeline.streaming.common import with_keyed_state

DECISION = "subject string, status string, seq bigint, event_type string, effective_from string"
FACT = "at bigint, seq bigint, event_type string, effective_from string"


def stream_gate(entries: DataFrame, blocking, clearing, as_of: str) -> DataFrame:
    """
    Latest decisive fact per subject as of a fixed date, for update mode. A
    late fact may be back-dated and still wins by effective time, so nothing
    is evicted by a watermark; state is one row per subject.
    """
    check_types(blocking, clearing)
    facts = decisive_facts(entries, blocking, clearing, as_of)
    latest = facts.groupBy("subject").agg(F.max_by(
        F.struct("seq", "event_type", "effective_from", "actor"), F.struct("effective_ts", "seq")).alias("f"))
    return latest.select("subject", F.when(F.col("f.event_type").isin(*blocking), BLOCKED).otherwise(CLEARED).alias("status"), "f.*")


class _Due(StatefulProcessor):
    """
    The latest decisive fact of a subject, and an entry for each fact that waits for its time. A timer is set for
    every waiting fact, so none is looked at before it is due.
    """

    def __init__(self, blocking, clock: bool):
        self.blocks, self.clock = frozenset(blocking), clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", FACT)
        self.waiting = handle.getMapState("waiting", "at bigint, seq bigint", "event_type string, effective_from string")

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.clock else timers.getCurrentProcessingTimeInMs()

    def _settled(self, key, facts: list[tuple]) -> Iterator[pd.DataFrame]:
        held = self.current.get()
        was = tuple(held) if held is not None else None
        best = max([*facts, *([was] if was else [])], key=lambda f: (f[0], f[1]), default=None)
        if best is None or best == was:
            return
        self.current.update(best)
        yield pd.DataFrame({"subject": [key[0]], "status": [BLOCKED if best[2] in self.blocks else CLEARED], "seq": [best[1]],
                            "event_type": [best[2]], "effective_from": [best[3]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, due = self._now(timerValues), []
        for batch in rows:
            for at, seq, event_type, effective_from in batch[["at", "seq", "event_type", "effective_from"]].itertuples(index=False, name=None):
                fact = (int(at), int(seq), event_type, effective_from)
                # Facts' instants are in microseconds, timers in milliseconds.
                if fact[0] <= now * 1000:
                    due = [max([*due, fact])]
                else:
                    self.waiting.updateValue(fact[:2], fact[2:])
                    self.handle.registerTimer(-(-fact[0] // 1000))
        yield from self._settled(key, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(self._now(timerValues), expiredTimerInfo.getExpiryTimeInMs())
        due = [(*map(int, k), *v) for k, v in self.waiting.iterator() if k[0] <= now * 1000]
        for fact in due:
            self.waiting.removeKey(fact[:2])
        yield from self._settled(key, due)

    def close(self) -> None:
        pass


def stream_gate_now(entries: DataFrame, blocking, clearing, clock: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """
    Latest decisive fact per subject as of the present, for update mode. A
    future-dated fact waits in its subject's state and takes effect by itself
    when its time comes; a plain maximum would let it win too early.

    The present is the machine's time, and such a query never runs out of
    work; or, with `clock`, what that column of the entries (when each was
    recorded) says, less `delay`, so a replay decides what the log's own time
    decided. `delay` must cover how much the clock's order and the order of
    arrival differ: what comes later than that is dropped by the stream.
    """
    check_types(blocking, clearing)
    if clock is not None:
        entries = entries.withWatermark(clock, delay)
    facts = decisive_facts(entries, blocking, clearing).select(
        "subject", F.unix_micros("effective_ts").alias("at"), "seq", "event_type", "effective_from", *([clock] if clock else []))
    return with_keyed_state(facts.groupBy("subject"), _Due(blocking, clock is not None), DECISION, "EventTime" if clock else "ProcessingTime")
