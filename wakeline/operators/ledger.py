"""
The append-only log of facts, and the gate over it.

An entry is (log_id, seq, effective_from, recorded_at, actor, event_type,
subject, body, prev_hash, hash). Timestamps are text, since the hash covers
the text; every comparison goes through the instant the text names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.canonical import GENESIS, event_hash, json_string
from wakeline.functions.instants import date_only, in_effect, instant
from wakeline.session import cut

BLOCKED, CLEARED, UNKNOWN = "BLOCKED", "CLEARED", "UNKNOWN"
POLICY_ADOPTED = "PolicyAdopted"

# Why a chain stops verifying.
SEQUENCE = "sequence"
CUT = "link"
EDITED = "content"


def with_instant(entries: DataFrame) -> DataFrame:
    return entries.withColumn("effective_ts", instant(F.col("effective_from")))


def bad_instants(entries: DataFrame) -> DataFrame:
    """Entries whose effective time cannot be read; the caller refuses the log on any."""
    return entries.where(instant(F.col("effective_from")).isNull())


def read_log(entries: DataFrame, since: int = 0, until: int | None = None, event_types=None, subjects=None) -> DataFrame:
    """Entries after `since` up to `until`, of the given types and subjects, in log order."""
    rows = entries.where(F.col("seq") > since)
    if until is not None:
        rows = rows.where(F.col("seq") <= until)
    if event_types is not None:
        rows = rows.where(F.col("event_type").isin(*event_types))
    if subjects is not None:
        rows = rows.where(F.col("subject").isin(*subjects))
    return rows.orderBy("log_id", "seq")


def log_head(entries: DataFrame) -> DataFrame:
    """(log_id, seq, hash) of each log's last entry; a log without entries heads at genesis."""
    return entries.groupBy("log_id").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def anchors(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (log_id, seq) with the hash at that place; NULL where the log has no such entry, genesis at 0."""
    found = wanted.join(entries.select("log_id", "seq", "hash"), ["log_id", "seq"], "left")
    return found.withColumn("hash", F.when(F.col("seq") == 0, GENESIS).otherwise(F.col("hash")))


# ---------------------------------------------------------------- hash chain

def verify_chain(entries: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """
    (log_id, ok, entries, head, broken_at, reason) per log, with the first
    failure only. `starts` (log_id, start_seq, start_prev) anchors a window;
    without it a log starts at 1 from genesis. An entry without a number breaks
    its log at 0.

    Each entry meets its predecessor by an equi-join on (log_id, seq), so one
    long log is verified by every executor at once.
    """
    if starts is None:
        rows = entries.withColumn("start_seq", F.lit(1).cast("bigint")).withColumn("start_prev", F.lit(GENESIS))
    else:
        rows = entries.join(starts, "log_id")
    previous = entries.groupBy("log_id", (F.col("seq") + 1).alias("seq")).agg(F.min("hash").alias("expected"))
    repeated = entries.groupBy("log_id", "seq").agg(F.count("*").alias("copies")).where("copies > 1")
    checked = rows.join(previous, ["log_id", "seq"], "left").join(repeated, ["log_id", "seq"], "left")
    first = F.col("seq") == F.col("start_seq")
    # What is missing never counts as a match: an entry without a number, a link or a hash is broken.
    reason = (
        F.when(F.col("seq").isNull() | (F.col("seq") < F.col("start_seq")) | (~first & F.col("expected").isNull()) | F.col("copies").isNotNull(), SEQUENCE)
        .when(~F.col("prev_hash").eqNullSafe(F.when(first, F.col("start_prev")).otherwise(F.col("expected"))) | F.col("prev_hash").isNull(), CUT)
        .when(~event_hash().eqNullSafe(F.col("hash")) | F.col("hash").isNull(), EDITED))
    judged = checked.select("log_id", F.coalesce("seq", F.lit(0)).alias("seq"), "hash", reason.alias("reason"))
    bad = judged.where("reason IS NOT NULL").groupBy("log_id").agg(
        F.min("seq").alias("broken_at"), F.min_by("reason", "seq").alias("reason"))
    totals = judged.drop("reason").join(bad, "log_id", "left").groupBy("log_id", "broken_at", "reason").agg(
        F.count_if(F.col("broken_at").isNull() | (F.col("seq") < F.col("broken_at"))).alias("entries"),
        F.max_by("hash", "seq").alias("head"))
    return totals.select("log_id", F.col("broken_at").isNull().alias("ok"), "entries",
                         F.when(F.col("broken_at").isNull(), F.col("head")).alias("head"), "broken_at", "reason")


def chain_events(facts: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """
    Entries with seq, prev_hash and hash for new facts, in order of `ord` after
    each log's head (log_id, seq, hash).

    A hash chain is sequential by nature, so each log is one run through
    sorted rows. Everything but the chaining is written in the JVM, and rows
    stream through in batches: no log is ever held whole.
    """
    if heads is None:
        rows = facts.withColumn("_seq", F.lit(0).cast("bigint")).withColumn("_prev", F.lit(GENESIS))
    else:
        last = heads.select("log_id", F.col("seq").alias("_seq"), F.col("hash").alias("_prev"))
        rows = facts.join(last, "log_id", "left").na.fill({"_seq": 0, "_prev": GENESIS})
    said = lambda c: F.coalesce(json_string(F.col(c)), F.lit("null"))
    rows = rows.select(
        "*",
        F.concat(F.lit('{"actor":'), said("actor"), F.lit(',"body":'), said("body"), F.lit(',"effective_from":'),
                 said("effective_from"), F.lit(',"event_type":'), said("event_type"), F.lit(',"prev_hash":"')).alias("_a"),
        F.concat(F.lit('","recorded_at":'), said("recorded_at"), F.lit(',"seq":')).alias("_b"),
        F.concat(F.lit(',"subject":'), said("subject"), F.lit("}")).alias("_c"),
    ).repartition("log_id").sortWithinPartitions("log_id", "ord")
    kept = [f for f in facts.schema.fields if f.name != "ord"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", seq bigint, prev_hash string, hash string"
    names = [f.name for f in kept]

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, seq, prev = None, 0, GENESIS
        for batch in batches:
            seqs, prevs, hashes = [], [], []
            for row in batch[["log_id", "_seq", "_prev", "_a", "_b", "_c"]].itertuples(index=False, name=None):
                if row[0] != log:
                    log, seq, prev = row[0], row[1], row[2]
                seq += 1
                seqs.append(seq)
                prevs.append(prev)
                prev = hashlib.sha256(f"{row[3]}{prev}{row[4]}{seq}{row[5]}".encode("ascii")).hexdigest()
                hashes.append(prev)
            yield batch[names].assign(seq=seqs, prev_hash=prevs, hash=hashes)

    return rows.mapInPandas(chain, schema)


# --------------------------------------------------------------------- gate

def check_types(blocking, clearing) -> None:
    """A gate that blocks on nothing, or both blocks and clears on one type, decides nothing."""
    if not blocking or not clearing:
        raise ValueError("a gate needs at least one blocking and one clearing type")
    both = sorted(set(blocking) & set(clearing))
    if both:
        raise ValueError(f"types both block and clear: {', '.join(both)}")


def decisive_facts(entries: DataFrame, blocking, clearing, as_of: str | None = None) -> DataFrame:
    """Facts that can decide, with their instant; those after `as_of` do not count."""
    rows = with_instant(entries.where(F.col("event_type").isin(*blocking, *clearing)))
    return rows if as_of is None else rows.where(in_effect(F.col("effective_ts"), F.lit(as_of)))


def gate(subjects: DataFrame, entries: DataFrame, blocking, clearing, as_of: str, by: tuple[str, ...] = ()) -> DataFrame:
    """
    (subject, status, seq, event_type, effective_from, actor) for every asked
    subject: the latest decisive fact in effect decides, by effective time and
    then log order. No such fact is UNKNOWN, which is not CLEARED.

    `by` names columns that key several gates answered at once.
    """
    check_types(blocking, clearing)
    return gate_over(subjects, decisive_facts(entries, blocking, clearing, as_of), F.col("event_type").isin(*blocking), by)


def gate_over(subjects: DataFrame, facts: DataFrame, blocks, by: tuple[str, ...] = ()) -> DataFrame:
    """The gate over facts already known to be decisive and in effect."""
    keys = [*by, "subject"]
    latest = facts.groupBy(keys).agg(F.max_by(
        F.struct("seq", "event_type", "effective_from", "actor", blocks.alias("blocks")),
        F.struct("effective_ts", "seq")).alias("fact"))
    status = (F.when(F.col("fact").isNull(), UNKNOWN).when(F.col("fact.blocks"), BLOCKED).otherwise(CLEARED))
    return subjects.select(keys).distinct().join(latest, keys, "left").select(
        *keys, status.alias("status"), "fact.seq", "fact.event_type", "fact.effective_from", "fact.actor")


def gate_decision(statuses: DataFrame, unknown_blocks: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and whether the gate passed; an unknown subject stops it unless told otherwise."""
    counted = statuses.groupBy(*by).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in (BLOCKED, CLEARED, UNKNOWN)])
    stopped = F.col("blocked") > 0
    if unknown_blocks:
        stopped = stopped | (F.col("unknown") > 0)
    none = (F.col("unknown") > 0) & (F.col("blocked") + F.col("cleared") == 0)
    return counted.withColumn("passed", ~stopped).withColumn("none_recognised", none)


def gate_report(statuses: DataFrame, most: int) -> DataFrame:
    """The first `most` subjects of each status, for a reader, beside the status's total."""
    order = Window.partitionBy("status").orderBy("subject")
    totals = statuses.groupBy("status").agg(F.count("*").alias("total"))
    return statuses.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).join(totals, "status")


# ------------------------------------------------------------------ histories

def adoptions(entries: DataFrame, event_type: str = POLICY_ADOPTED) -> DataFrame:
    """(log_id, seq, version, policy_hash, effective_ts, ...): who adopted which table, and from when."""
    return with_instant(entries.where(F.col("event_type") == event_type)).select(
        "log_id", "seq", F.col("subject").alias("version"), F.get_json_object("body", "$.policy_hash").alias("policy_hash"),
        "effective_from", "effective_ts", "recorded_at", "actor", "hash")


def policy_history(entries: DataFrame, event_type: str = POLICY_ADOPTED) -> DataFrame:
    """Every adoption by effective time, then log order."""
    return adoptions(entries, event_type).orderBy("log_id", "effective_ts", "seq")


def policy_in_force(entries: DataFrame, dates: DataFrame, event_type: str = POLICY_ADOPTED) -> DataFrame:
    """
    (log_id, as_of, version, policy_hash, seq) for every asked (log_id, as_of):
    the latest adoption in effect, NULL where there is none.

    An as-of join by ranges: adoptions and questions are sorted together and
    cut into ranges of one size, whatever a log or a day holds. Each range
    answers its own questions, and hands the last adoption of each log on to
    the ranges after it; that table has a row per log and one per range.
    """
    what = F.struct("version", "policy_hash", "seq")
    made = adoptions(entries, event_type).where("effective_ts IS NOT NULL").select(
        "log_id", F.lit(None).cast("string").alias("as_of"), F.col("effective_ts").alias("at"), F.lit(0).alias("turn"), "seq", what.alias("found"))
    # A date asks about its whole day: it stands just before the next midnight.
    at = F.when(date_only(F.col("as_of")), instant(F.col("as_of")) + F.expr("INTERVAL 1 DAY")).otherwise(instant(F.col("as_of")))
    turn = F.when(date_only(F.col("as_of")), -1).otherwise(1)
    asked = dates.select("log_id", "as_of").distinct().select(
        "log_id", "as_of", at.alias("at"), turn.alias("turn"), F.lit(None).cast("bigint").alias("seq"),
        F.lit(None).cast(made.schema["found"].dataType).alias("found"))
    rows = made.unionByName(asked).repartitionByRange("log_id", "at", "turn", "seq", "as_of")
    rows, _ = cut(rows.withColumn("range", F.spark_partition_id()), "as-of")
    running = Window.partitionBy("range", "log_id").orderBy("at", "turn", "seq").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("here", F.last("found", ignorenulls=True).over(running)).where("as_of IS NOT NULL")
    last = rows.groupBy("log_id", "range").agg(F.max_by("found", F.when(F.col("found").isNotNull(), F.struct("at", "seq"))).alias("last"))
    before = Window.partitionBy("log_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select("log_id", "range", F.last("last", ignorenulls=True).over(before).alias("earlier"))
    return within.join(handed, ["log_id", "range"], "left").withColumn("found", F.coalesce("here", "earlier")).select(
        "log_id", "as_of", "found.version", "found.policy_hash", "found.seq")


def subject_history(entries: DataFrame, subjects: DataFrame) -> DataFrame:
    """
    Every fact about the asked subjects by effective time, then log order. A
    subject the log never names stays, with `known` false: no record is not
    the same as nothing having happened.
    """
    facts = with_instant(entries).withColumn("known", F.lit(True))
    return subjects.select("subject").distinct().join(facts, "subject", "left").withColumn(
        "known", F.coalesce("known", F.lit(False))).orderBy("subject", "effective_ts", "seq")

