"""
Suffix dedup by refinement of block digests, in place of bucket pointers: removes every byte covered by
a string of `length` bytes that also starts anywhere else.

Only suffixes that can matter are bucketed. Every string of `length` bytes
holds `width` overlapping q-grams; the one with the smallest hash is its
anchor, so equal strings have equal anchors at equal offsets. The initial
buckets are the anchors' q-grams, and an anchor alone in its bucket settles all
strings that it stands for.

An anchor stands for a block of `width` neighbouring starts. A block has a
core, the bytes that all its strings share, and a hull, the bytes of all of
them. A bucket is all blocks with one core. Blocks with equal hulls are one
class, and a class of two or more settles all of its starts as repeated. Where
a bucket has blocks left, one block of each class (the bucket's pointers) is
refined: it falls into `FAN` smaller blocks, whose longer cores, read at later
offsets, are the next buckets. So only the borders of repeats are followed,
each down to single strings, and what a class has settled is not looked at
again. Nothing but counts per bucket and class is ever gathered: a passage
that a third of all texts share is one class, however many share it.

Cores and hulls are compared by BLAKE2b digests, of 64 and 128 bits; the last
round's hull is the string itself. Texts are known by two XXH64 values, and
equal texts are looked at once. Which texts share an anchor is known from ids
alone, and marked in a map of bounded size before any text moves; these texts
are written once, bucketed by those values, so the rounds join them without
moving them.

Defined cases: a null text is the empty text. Texts shorter than `length` lose
nothing. Null and repeated ids are rows of their own; rows with equal texts of
at least `length` bytes lose all bytes. Other columns may have any name. An
empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flat, marked, scratch_path, text_of

LENGTH = 400
FAN = 16
#: Bytes of text that are hashed at once.
PART = 2 << 20


def shape(length: int) -> tuple[int, int]:
    """(width, q): the starts an anchor stands for, a power of the fan-out, and the q-gram's bytes."""
    width = 1
    while width * FAN <= 0.7 * length:
        width *= FAN
    return width, length - width + 1


@lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)


def hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from each place on, built from hashes of powers of two of bytes."""
    base = 0x9E3779B97F4A7C15
    power, width, done, out = _bytes()[data], 1, 0, None
    while True:
        if q & width:
            if out is None:
                out, done = power, width
            else:
                n = len(data) - done - width + 1
                out = out[:n] * np.uint64(pow(base, width, 1 << 64)) + power[done:done + n]
                done += width
        if 2 * width > q:
            break
        n = len(data) - 2 * width + 1
        power = power[:n] * np.uint64(pow(base, width, 1 << 64)) + power[width:width + n]
        width *= 2
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _over(values: np.ndarray, width: int, best) -> np.ndarray:
    """The best of the `width` values from each place on."""
    step = 1
    while 2 * step <= width:
        values = best(values[:len(values) - step], values[step:])
        step *= 2
    rest = width - step
    return best(values[:len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of all strings of `length` bytes that lie within one text."""
    width, q = shape(length)
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed = hashes(data, q)
    rank = np.maximum((hashed >> np.uint64(32)).astype(np.uint32), 1)
    starts, stops = ends[:-1], ends[1:] - length + 1
    whole = stops > starts
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, starts[whole], 1)
    np.add.at(edge, stops[whole], -1)
    lowest = _over(rank, width, np.minimum)
    lowest[np.cumsum(edge)[:len(lowest)] <= 0] = 0
    reach = np.concatenate([np.zeros(width - 1, np.uint32), lowest, np.zeros(width - 1, np.uint32)])
    found = np.flatnonzero(_over(reach, width, np.maximum)[:len(rank)] == rank)
    return found, hashed[found]


def _text_anchors(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place in its text, hash) of the anchors of a batch, in parts of bounded size."""
    at, n = 0, len(ends) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PART, "right")) - 1)
        size = int(ends[to] - ends[at])
        if size <= 2 * PART:
            place, hashed = anchors(data[ends[at]:ends[to]], ends[at:to + 1] - ends[at], length)
            place = place + ends[at]
        else:  # one long text: parts that overlap by a string
            parts = [(a, *anchors(data[ends[at] + a:min(ends[at] + a + PART + length, ends[to])], np.array([0, min(PART + length, size - a)]), length)) for a in range(0, size, PART)]
            place, first = np.unique(np.concatenate([a + p for a, p, _ in parts]), return_index=True)
            hashed, place = np.concatenate([h for _, _, h in parts])[first], place + ends[at]
        row = np.searchsorted(ends, place, "right") - 1
        yield row, place - ends[row], hashed
        at = to


def _known(docs: DataFrame, text: str, *more) -> DataFrame:
    body = text_of(text)
    return docs.select(F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"), body.alias("body"), *more)


def _digests(strings: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(s, digest_size=16).digest() for s in strings), dtype="<i8").reshape(-1, 2)


_ITEM = "core long, h1 long, h2 long, k1 long, k2 long, start int"


def _blocks(rows: DataFrame, size: int, length: int, of_parent: int) -> DataFrame:
    """
    The blocks of `size` starts of texts (k1, k2, body, starts), as (core, h1,
    h2, k1, k2, start); `starts` are the blocks' own, or those of parents of
    `of_parent` starts. A block that reaches beyond its text has a hull of its own.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores, hulls, k1, k2, at = [], [], [], [], []
            columns = (batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("body"), batch.column("starts").to_pylist())
            for a, b, body, starts in zip(*columns):
                raw = body.as_buffer().to_pybytes()
                n = len(raw)
                # neighbouring anchors may share a block, which must count once
                for c in sorted({c for s in starts for c in (range(s, s + of_parent, size) if of_parent else (s,))}):
                    last = c + size - 1
                    if last < 0 or c > n - length:
                        continue
                    cores.append(raw[last:c + length])
                    hulls.append(raw[c:last + length] if c >= 0 and last <= n - length else b"cut %d %d %d" % (a, b, c))
                    k1.append(a)
                    k2.append(b)
                    at.append(c)
                if len(at) >= 20_000:
                    yield _item_batch(cores, hulls, k1, k2, at)
                    cores, hulls, k1, k2, at = [], [], [], [], []
            if at:
                yield _item_batch(cores, hulls, k1, k2, at)

    return rows.select("k1", "k2", "body", "starts").mapInArrow(of, _ITEM)


def _item_batch(cores, hulls, k1, k2, at) -> pa.RecordBatch:
    core, hull = _digests(cores), _digests(hulls)
    return pa.RecordBatch.from_arrays(
        [pa.array(core[:, 0]), pa.array(hull[:, 0]), pa.array(hull[:, 1]), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(at, pa.int32())],
        ["core", "h1", "h2", "k1", "k2", "start"])


def _bucketed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder by its k1 and k2, as many files as there are shuffle partitions."""
    spark, name = df.sparkSession, f"texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, "k1", "k2").option("compression", "zstd").option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def repeats(docs: DataFrame, length: int = LENGTH, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """
    (texts, spans): the distinct texts (k1, k2, body, copies) that share an
    anchor, and (k1, k2, start, size): `size` starts from `start` on whose
    strings of `length` bytes occur again.
    """
    width, _ = shape(length)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2")]
            for row, place, hashed in _text_anchors(*flat(batch.column("body")), length):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashed.view(np.int64)), pa.array(keys[0][row]), pa.array(keys[1][row]), pa.array(place.astype(np.int32))], ["bucket", "k1", "k2", "place"])

    first, _ = cut(_known(docs, text).mapInArrow(of, "bucket long, k1 long, k2 long, place int"), "suffix-anchors")
    # Written, so that the join has plain shuffles on both sides and a bucket that many texts share is split.
    shared, _ = cut(first.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "suffix-shared")
    lists, _ = cut(first.join(shared, "bucket").groupBy("k1", "k2").agg(F.collect_set(F.col("place") - F.lit(width - 1)).alias("starts")), "suffix-lists")
    texts = marked(_known(docs, text), F.col("k1"), lists.select(F.col("k1").alias("key"))).groupBy("k1", "k2").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("copies"))
    texts = _bucketed(texts.join(lists, ["k1", "k2"]))

    spans, rows, size, parent = [], texts, width, 0
    while True:
        items, _ = cut(_blocks(rows, size, length, parent), "suffix-blocks")
        classes, _ = cut(items.groupBy("core", "h1", "h2").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "start")).alias("one")), "suffix-classes")
        again = classes.where("n > 1").select("core", "h1", "h2")
        spans.append(items.join(again, ["core", "h1", "h2"]).select("k1", "k2", "start", F.lit(size).alias("size")))
        if size == 1:
            break
        left = classes.groupBy("core").agg(F.sum("n").alias("members"), F.count_if(F.col("n") == 1).alias("alone")).where(
            "members > 1 AND alone > 0").select("core")
        pointers = classes.join(left, "core").select("one.*").groupBy("k1", "k2").agg(F.collect_list("start").alias("starts"))
        rows = texts.drop("starts").join(pointers, ["k1", "k2"])
        size, parent = size // FAN, size
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    return texts.select("k1", "k2", "body", "copies"), every


def remaining(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text without its spans (start, end), and the runs that went."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    ends = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])), [tuple(r) for r in runs]


def deduplicated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """
    (id, n_bytes, n_removed, n_spans, kept_sha256, removed) for every row of `docs`, and with `with_bytes` the kept
    bytes too. `removed` lists the removed runs as start:end in bytes, joined by commas; null if there are none.
    """
    texts, spans = repeats(docs, length, text)
    lists = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "size")).alias("spans"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, copies, found in zip(batch.column("body"), batch.column("copies").to_pylist(), batch.column("spans").to_pylist()):
                raw = body.as_buffer().to_pybytes()
                cover = [(0, len(raw))] if copies > 1 and len(raw) >= length else [(max(0, s["start"]), s["start"] + s["size"] - 1 + length) for s in found or []]
                out.append((*remaining(raw, cover), len(raw)))
            yield pa.RecordBatch.from_arrays([
                batch.column("k1"), batch.column("k2"), pa.array([n - len(k) for k, _, n in out], pa.int64()), pa.array([len(r) for _, r, _ in out], pa.int64()),
                pa.array([sha256(k).hexdigest() for k, _, _ in out], pa.string()),
                pa.array([",".join(f"{a}:{b}" for a, b in r) or None for _, r, _ in out], pa.string()), pa.array([k if with_bytes else None for k, _, _ in out], pa.binary())],
                ["k1", "k2", "n_removed", "n_spans", "sha", "removed", "kept"])

    found = texts.join(lists, ["k1", "k2"], "left").mapInArrow(of, "k1 long, k2 long, n_removed long, n_spans long, sha string, removed string, kept binary")
    found, _ = cut(found, "suffix-found")
    body = F.col("body")
    rows = _known(docs, text, F.col(id_col).alias("id")).select(
        "id", "k1", "k2", F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("whole"), *([body.cast("binary").alias("raw")] if with_bytes else []))
    return rows.join(found, ["k1", "k2"], "left").select(
        "id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"), "removed", *([F.coalesce("kept", "raw").alias("kept_bytes")] if with_bytes else []))
