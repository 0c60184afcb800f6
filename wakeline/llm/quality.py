"""
Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams,
trained on all trusted texts, whose perplexity rejects documents above a
quantile of the trusted documents of their language. A text that a model has
seen says nothing of unseen ones, so the quantiles are taken over the scores
that all trusted texts get by models without their own of `FOLDS` folds; equal
texts are in one fold.

Counting: every task counts the n-grams of its trusted texts and hands on one
row per n-gram and fold; a model without a fold has the counts of all less the fold's. Lower orders are continuation counts of the next higher one.
Discounts, back-off weights and probabilities come from joins of these count
tables on contexts and suffixes, sharded by key.

Scoring: texts travel once, packed and compressed, to blocks; the model's
parts join each block and stream in before its texts, so a task holds the
model and one pack. Blocks are made at least `TEXT_PER_MODEL` times as large
as the model, so the model's copies stay a fixed share of the text. A model of
order n has at most 256^n entries of an order; the default of 4 has in
practice as many as the text's alphabets make.

Trusted ids are broadcast while they are few (`FEW_BYTES`); beyond that texts
and ids are shuffled together.

Defined cases: a null or empty text has no perplexity and is rejected. A null
language is a language of its own. A language without trusted documents takes
the quantile of all trusted documents; one with fewer than 1 / (1 - quantile)
of them, whose quantile is but their largest, takes the larger of the two.
Without any, or where all are one text, nothing is rejected but empty texts. Rows that repeat an id are scored each. Ids without a document,
null ids and repeated ids among the trusted ones have no effect. Other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, flat, rows_by, text_of

#: Bytes of text that are worked on at once, and that a pack holds.
PACK = 2 << 20
#: Bytes of text in a block, at least.
BLOCK = 16 << 20
TEXT_PER_MODEL = 8
FEW_BYTES = 64 << 20
#: Rows of the model in one part.
PART = 1 << 16
#: Steps of the logarithm per byte in which quantiles are taken.
STEP = 1e-4
#: Folds of the trusted texts, and the fold of the model that leaves none out.
FOLDS, ALL = 5, -1


def _slices(ends: np.ndarray, most: int = PACK) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; a longer text is a run of its own."""
    at, n = 0, len(ends) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def grams(data: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte, as a number; what lies before a text is zeros."""
    n = len(data)
    where = np.arange(n) - np.repeat(ends[:-1], np.diff(ends))
    key = data.astype(np.uint64)
    for j in range(1, order):
        before = np.zeros(n, np.uint64)
        before[j:] = data[:n - j]
        before[where < j] = 0
        key |= before << np.uint64(8 * j)
    return key


def _merge(a, b):
    if a is None:
        return b
    keys, where = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    sums = np.bincount(where, np.concatenate([a[1], b[1]]).astype(np.float64), minlength=len(keys))
    return keys, sums.astype(np.int64)


def count_grams(texts: DataFrame, order: int, body: str = "body") -> DataFrame:
    """(fold, key, n): how often each n-gram occurs in the texts of a fold (fold, and the text); each task adds up its own first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for batch in batches:
            for fold, piece in _by_fold(batch):
                data, ends = flat(piece.column(body))
                for a, b in _slices(ends):
                    if ends[b] > ends[a]:
                        here = np.unique(grams(data[ends[a]:ends[b]], ends[a:b + 1] - ends[a], order), return_counts=True)
                        totals[fold] = _merge(totals.get(fold), (here[0], here[1].astype(np.int64)))
        for fold, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total[0]), fold, np.int32)), pa.array(total[0].view(np.int64)), pa.array(total[1])], ["fold", "key", "n"])

    return texts.select("fold", body).mapInArrow(of, "fold int, key long, n long").groupBy("fold", "key").agg(F.sum("n").alias("n"))


def _by_fold(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    folds = batch.column("fold").to_numpy()
    for fold in np.unique(folds).tolist():
        yield fold, batch.filter(pa.array(folds == fold))


def without_each(counts: DataFrame) -> DataFrame:
    """(fold, key, n) of all texts, and of all but those of each fold."""
    own = {k: F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)) for k in range(FOLDS)}
    sums = counts.groupBy("key").agg(F.sum("n").alias("n"), *(x.alias(f"n{k}") for k, x in own.items()))
    rows = [F.struct(F.lit(ALL).alias("fold"), F.col("n"))] + [F.struct(F.lit(k).alias("fold"), (F.col("n") - F.col(f"n{k}")).alias("n")) for k in own]
    return sums.select("key", F.explode(F.array(*rows)).alias("r")).select("r.fold", "key", "r.n").where("n > 0")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from the numbers of n-grams seen once to four times; one half where those say none, so that every context leaves something."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    ratios = ((1, n2, n1), (2, n3, n2), (3, n4, n3))
    found = (k - (k + 1) * y * more / less if less else 0.0 for k, more, less in ratios)
    return tuple(d if d > 0 else 0.5 for d in found)


def train(texts: DataFrame, order: int = 4, body: str = "body") -> tuple[DataFrame, int]:
    """
    The model as (level, kind, key, value) and its number of rows: kind 0 is
    the logarithm of an n-gram's probability, kind 1 that of a context's
    weight for the next lower order.
    """
    model, size = _trained(count_grams(texts.select(F.lit(ALL).alias("fold"), body), order, body), order)
    return model.drop("fold"), size


def _trained(counts: DataFrame, order: int) -> tuple[DataFrame, int]:
    """A model for each fold of the counts (fold, key, n), as (fold, level, kind, key, value), and the number of rows."""
    counts, _ = cut(counts, "kn-counts")
    levels = {order: counts}
    for m in range(order - 1, 0, -1):
        suffix = F.col("key").bitwiseAND(F.lit((1 << 8 * m) - 1))
        levels[m] = cut(levels[m + 1].groupBy("fold", suffix.alias("key")).agg(F.count(F.lit(1)).alias("n")), f"kn-continuations-{m}")[0]
    parts, lower = [], None
    for m in range(1, order + 1):
        few = levels[m].groupBy("fold").agg(*(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).collect()
        off = F.lit(0.5)
        for fold, *seen in few:
            d = discounts(*seen)
            off = F.when(F.col("fold") == fold, F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])).otherwise(off)
        context = F.shiftrightunsigned("key", 8)
        contexts = levels[m].groupBy("fold", context.alias("context")).agg((F.sum(off) / F.sum("n")).alias("weight"), F.sum("n").alias("total"))
        rows = levels[m].withColumn("context", context).join(contexts, ["fold", "context"])
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * (m - 1)) - 1))).join(lower, ["fold", "suffix"])
        likely = rows.select("fold", "key", ((F.col("n") - off) / F.col("total") + F.col("weight") * F.col("below")).alias("p"))
        likely = cut(likely, f"kn-level-{m}")[0]
        lower = likely.select("fold", F.col("key").alias("suffix"), F.col("p").alias("below"))
        parts.append(likely.select("fold", F.lit(m).alias("level"), F.lit(0).alias("kind"), "key", F.log("p").cast("float").alias("value")))
        parts.append(contexts.where("weight > 0").select("fold", F.lit(m).alias("level"), F.lit(1).alias("kind"), F.col("context").alias("key"), F.log("weight").cast("float").alias("value")))
    model = parts[0]
    for p in parts[1:]:
        model = model.unionByName(p)
    return cut(model, "kn-model")


class Scorer:
    """Sums of log probabilities by a model held as sorted keys and values of each level and kind."""

    def __init__(self, tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], order: int):
        self.tables, self.order = tables, order

    def _look(self, level: int, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, values = self.tables.get((level, kind), (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return hit, np.where(hit, values[at], np.float32(0))

    def logs(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The log probability of each text."""
        keys = grams(data, ends, self.order)
        out, rest = np.zeros(len(keys)), np.arange(len(keys))
        for level in range(self.order, 0, -1):
            here = keys[rest] & np.uint64((1 << 8 * level) - 1)
            hit, value = self._look(level, 0, here)
            out[rest[hit]] += value[hit]
            rest, here = rest[~hit], here[~hit]
            out[rest] += self._look(level, 1, here >> np.uint64(8))[1]
        out[rest] += np.log(1 / 256)
        sums = np.concatenate([[0.0], np.cumsum(out)])
        return sums[ends[1:]] - sums[ends[:-1]]


def _packed(rows: DataFrame, places: dict[int, tuple[int, int]]) -> DataFrame:
    """(block, kind, part, data): the texts with id, lang and digest as compressed packs, dealt to their fold's blocks (the first, how many)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for fold, rows_ in _by_fold(batch):
                first, blocks = places[fold]
                _, ends = flat(rows_.column("body"))
                for a, b in _slices(ends):
                    sink = pa.BufferOutputStream()
                    piece = rows_.slice(a, b - a)
                    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                        out.write_batch(piece)
                    block = first + int(np.bitwise_xor.reduce(piece.column("digest").to_numpy(zero_copy_only=False).astype(np.int64))) % blocks
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([2], pa.int32()), pa.array([0], pa.int32()),
                                                      pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "kind", "part", "data"])

    return rows.mapInArrow(of, "block int, kind int, part int, data binary")


def _model_parts(model: DataFrame, size: int, places: dict[int, tuple[int, int]]) -> DataFrame:
    """(block, kind, part, data): the models in packed parts, one copy for each block of their fold."""
    parts = max(1, -(-size // PART))

    def pack(table: pa.Table) -> pa.Table:
        levels, kinds = table["level"].to_numpy().astype("<i4"), table["kind"].to_numpy().astype("<i4")
        body = b"".join((levels.tobytes(), kinds.tobytes(), table["key"].to_numpy().astype("<i8").tobytes(), table["value"].to_numpy().astype("<f4").tobytes()))
        return pa.table({"fold": pa.array([table["fold"][0].as_py()], pa.int32()), "part": pa.array([table["part"][0].as_py()], pa.int32()), "data": pa.array([body], pa.binary())})

    keyed = model.withColumn("part", F.pmod(F.xxhash64("level", "kind", "key"), F.lit(parts)).cast("int"))
    packs = keyed.groupBy("fold", "part").applyInArrow(pack, "fold int, part int, data binary")
    at = F.lit(None).cast("array<int>")
    for fold, (first, blocks) in places.items():
        at = F.when(F.col("fold") == fold, F.sequence(F.lit(first), F.lit(first + blocks - 1))).otherwise(at)
    return packs.select(F.explode(at).alias("block"), F.lit(1).alias("kind"), "part", "data")


def scores(docs: DataFrame, model: DataFrame, size: int, order: int = 4, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, lang, digest, bytes, logp): the log probability of every row's whole text."""
    rows = _rows(docs, id_col, text, lang).withColumn("fold", F.lit(ALL))
    return _scored(rows, model.withColumn("fold", F.lit(ALL)), size, order, _bytes(docs, text), [ALL]).drop("fold")


def _rows(docs: DataFrame, id_col: str, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang"), F.xxhash64(text_of(text)).alias("digest"), text_of(text).alias("body"))


def _bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0


def _scored(rows: DataFrame, model: DataFrame, size: int, order: int, total: int, folds: list[int]) -> DataFrame:
    """(id, lang, digest, bytes, logp, fold) for `rows` (id, lang, digest, body, fold), each by its fold's model; `size` rows in all, `total` bytes in fold ALL."""
    kind = rows.schema["id"].dataType.simpleString()
    blocks = max(1, -(-total // max(BLOCK, TEXT_PER_MODEL * 20 * -(-size // len(folds)))))
    places, owner = {}, []
    for fold in folds:
        n = blocks if fold == ALL else -(-blocks // FOLDS)
        places[fold] = (len(owner), n)
        owner += [fold] * n

    def load(parts: list[bytes]) -> Scorer:
        cols = [[], [], [], []]
        for body in parts:
            n = len(body) // 20
            for c, (dtype, at) in enumerate((("<i4", 0), ("<i4", 4 * n), ("<i8", 8 * n), ("<f4", 16 * n))):
                cols[c].append(np.frombuffer(body, dtype, n, at))
        if not cols[0]:
            return Scorer({}, order)
        level, what, key, value = (np.concatenate(c) for c in cols)
        tables = {}
        for m in range(1, order + 1):
            for k in (0, 1):
                own = (level == m) & (what == k)
                keys = key[own].view(np.uint64)
                by = np.argsort(keys)
                tables[m, k] = keys[by], value[own][by]
        return Scorer(tables, order)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, scorer = None, [], None
        for batch in batches:
            for here, what, data in zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("data")):
                if here != block:
                    block, parts, scorer = here, [], None
                if what == 1:
                    parts.append(data.as_py())
                    continue
                scorer = scorer or load(parts)
                pack = pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks().to_batches()[0]
                body, ends = flat(pack.column("body"))
                logs = scorer.logs(body, ends) if scorer.tables else np.zeros(len(pack))
                yield pa.RecordBatch.from_arrays([
                    pack.column("id"), pack.column("lang"), pack.column("digest"), pa.array(np.diff(ends)), pa.array(logs),
                    pa.array(np.full(len(pack), owner[here], np.int32))], ["id", "lang", "digest", "bytes", "logp", "fold"])

    both = _packed(rows, places).unionByName(_model_parts(model, size, places))
    streams = both.repartition(F.col("block")).sortWithinPartitions("block", "kind", "part")
    return streams.mapInArrow(of, f"id {kind}, lang string, digest long, bytes long, logp double, fold int")


def quantiles(scored: DataFrame, q: float) -> DataFrame:
    """(lang, limit, of) with a row for lang null and all=true over all: the smallest step that a share `q` of the trusted rows reaches, and how many they are."""
    steps = scored.select("lang", F.lit(False).alias("all"), "step").unionByName(scored.select(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("all"), "step"))
    counts = steps.groupBy("all", "lang", "step").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("all", "lang")
    below = F.sum("n").over(one.orderBy("step"))
    return counts.withColumn("below", below).withColumn("of", F.sum("n").over(one)).where(F.col("below") >= F.ceil(q * F.col("of"))).groupBy(
        "all", "lang").agg(F.min("step").alias("limit"), F.max("of").alias("of"))


def classify(docs: DataFrame, trusted: DataFrame, order: int = 4, quantile: float = 0.99, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """
    (id, digest, lang, perplexity, threshold, kept) for every row of `docs`.
    `trusted` has the ids of trusted documents in a column doc_id. Perplexity
    is per byte; a document is kept up to its language's threshold.
    """
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id IS NOT NULL").distinct()
    ids, n = cut(ids, "trusted")
    side = F.broadcast(ids) if 16 * n <= FEW_BYTES else ids
    rows = _rows(docs, id_col, text, lang)
    good = rows.join(side, F.col("id") == F.col("trusted_id"), "left_semi").withColumn("fold", F.pmod("digest", F.lit(FOLDS)).cast("int"))
    model, size = _trained(without_each(count_grams(good, order)), order)
    folds = [r["fold"] for r in model.select("fold").distinct().collect()]
    both = rows.withColumn("fold", F.lit(ALL)).unionByName(good)
    scored, _ = cut(_scored(both, model, size, order, _bytes(docs, text), [ALL, *range(FOLDS)]).withColumn(
        "step", F.when(F.col("fold").isin(folds) & (F.col("bytes") > 0), F.ceil(-F.col("logp") / F.col("bytes") / F.lit(STEP)).cast("long"))), "kn-scores")
    known, scored = scored.where((F.col("fold") != ALL) & F.col("step").isNotNull()), scored.where(F.col("fold") == ALL)
    limits = cut(quantiles(known, quantile), "kn-limits")[0]
    every = limits.where("`all`").agg(F.max("limit")).first()[0]
    few = F.col("of") < (round(1 / (1 - quantile), 6) if quantile < 1 else 1)
    own = limits.where("NOT `all`").select(F.col("lang").alias("l"), F.when(few, F.greatest(F.col("limit"), F.lit(every).cast("long"))).otherwise(F.col("limit")).alias("limit"))
    joined = scored.join(own, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("limit", F.coalesce("limit", F.lit(every).cast("long")))
    return joined.select(
        "id", "digest", "lang", F.when(F.col("step").isNotNull(), F.exp(-F.col("logp") / F.col("bytes"))).alias("perplexity"),
        F.exp(F.col("limit") * F.lit(STEP)).alias("threshold"),
        ((F.col("bytes") > 0) & F.coalesce(F.col("step") <= F.col("limit"), F.lit(True))).alias("kept"))


def survivors(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that `classify` keeps."""
    return rows_by(docs, classify(docs, trusted, id_col=id_col, text=text, **options).where("NOT kept"), "left_anti", id_col, text)
