"""
Hard-negative mining with an R-tree packed by sort-tile-recursive (STR).

`pack` sorts vectors of whole numbers by their widest coordinate into slabs of
about `SLAB` rows (a range partition; rows of one value are told apart by id
and row number, so equal vectors fill many slabs). Each slab is tiled on by its
next coordinates into pages of at most `PAGE` vectors, each with its minimum
bounding box; boxes of the slabs are the level above.

For a query q and a box [lo, hi] the inner product with anything inside lies
between sum(min(q*lo, q*hi)) and sum(max(q*lo, q*hi)). `search` opens boxes
best first (largest upper end) and skips those whose interval misses the asked
window of scores or ends strictly below the k-th score so far; a box that may
only equal it is opened, since ties go to the smaller id. A query first visits
the slab that it lies in, the k-th score found there is its bound for all
others, and only slabs whose boxes pass it are visited. All bounds are exact:
products are summed in doubles where no sum can reach 2**53, else in 64-bit
integers.

Queries are dealt in parts of `PART`; a task holds one slab's pages and lets
the queries of one part stream past, so neither a hot slab nor a hot query set
is one task's. `mine` searches twice: an anchor's best rows of its label are
its positives, then each positive's window is searched among other labels; the
windows of one anchor are searched together, from one computation of a page's
scores.

Defined cases: rows without id, label or vector, or with a null or non-finite
component, take no part. Shorter vectors count as followed by zeros. Rows that
repeat an id are candidates each, and anchors each; "another row" is one with
another id. A window is empty where the positive's score is negative.
Components and scores must fit 64 bits. Other columns may have any name. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SLAB, PAGE, PART = 4096, 128, 16384
LOWEST, HIGHEST = -(1 << 62), 1 << 62

#: A node (page or box) and a query travel in rows of one shape; kind 0 comes first.
_SHAPE = ("place int, part int, kind int, lo array<long>, hi array<long>, ids array<long>, labels array<long>, flat array<long>, "
          "key long, own long, label long, home int, v array<long>, low array<long>, high array<long>")
_QUERY = ["key", "own", "label", "home", "v", "low", "high"]


def members(rows: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component, of rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                       F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))


def tiles(vectors: np.ndarray, page: int = PAGE) -> Iterator[np.ndarray]:
    """Rows of each page: sorted by the widest coordinate into slabs, these by the next, and so on."""
    pages = -(-len(vectors) // page)
    spread = (vectors.max(axis=0).astype(object) - vectors.min(axis=0)) if len(vectors) else np.zeros(0)
    dims = sorted(range(vectors.shape[1]), key=lambda d: -spread[d])[:max(1, pages.bit_length() - 1)]

    def split(rows: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        here = -(-len(rows) // page)
        if here <= 1 or depth == len(dims):
            for at in range(0, len(rows), page):
                yield rows[at:at + page]
            return
        slabs = max(2, round(here ** (1 / (len(dims) - depth))))
        rows = rows[np.argsort(vectors[rows, dims[depth]], kind="stable")]
        size = page * -(-here // slabs)
        for at in range(0, len(rows), size):
            yield from split(rows[at:at + size], depth + 1)

    yield from split(np.arange(len(vectors)), 0)


class Boxes:
    """Bounding boxes one below the other, as matrices of the number kind that keeps products exact."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, kind: type):
        self.lo, self.hi = lo.astype(kind).T, hi.astype(kind).T

    def intervals(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest inner product of each query with anything in each box."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.lo + down @ self.hi, up @ self.hi + down @ self.lo


class Slab(Boxes):
    """The pages of one slab."""

    def __init__(self, pages: list[dict], kind: type):
        super().__init__(np.stack([p["lo"] for p in pages]), np.stack([p["hi"] for p in pages]), kind)
        self.pages = [(p["ids"], p["labels"], p["flat"].reshape(len(p["ids"]), -1).astype(kind)) for p in pages]
        self.opened = 0

    def search(self, query, least, most, own, label, low, high, k: int, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of each window: its k best rows with the label (`same`) or without it; `least`, `most` are the pages' intervals."""
        bound = low.copy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
        for page in np.argsort(-most, kind="stable"):
            if most[page] < bound.min():
                break
            wanted = np.flatnonzero((most[page] >= bound) & (least[page] <= high))
            if not len(wanted):
                continue
            ids, labels, vectors = self.pages[page]
            fits = ((labels == label) == same) & (ids != own)
            if not fits.any():
                continue
            self.opened += 1
            scores = (vectors[fits] @ query).astype(np.int64)
            ids = ids[fits]
            for w in wanted:
                inside = (scores >= bound[w]) & (scores <= high[w])
                if not inside.any():
                    continue
                s, i = np.concatenate([found[w][0], scores[inside]]), np.concatenate([found[w][1], ids[inside]])
                best = np.lexsort((i, -s))[:k]
                found[w] = s[best], i[best]
                if len(best) == k:
                    bound[w] = s[best[-1]]
        return found


def _lists(column: pa.Array) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _streamed(nodes: DataFrame, asked: DataFrame, tasks: int, held: Callable, answer: Callable, shape: str) -> DataFrame:
    """`answer(held(nodes of a place), queries)` for every place and batch of queries sent there; one place's nodes are held at a time."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, ready = None, [], None
        for batch in batches:
            where = list(zip(batch.column("place").to_pylist(), batch.column("part").to_pylist(), batch.column("kind").to_pylist()))
            at = 0
            while at < len(where):
                stop = at
                while stop < len(where) and where[stop] == where[at]:
                    stop += 1
                some, here, at = batch.slice(at, stop - at), where[at], stop
                if here[:2] != number:
                    number, rows, ready = here[:2], [], None
                if here[2] == 0:
                    columns = {n: _lists(some.column(n)) for n in ("lo", "hi", "ids", "labels", "flat")}
                    rows += [{n: c[j] for n, c in columns.items()} for j in range(len(some))]
                elif rows:
                    ready = ready or held(rows)
                    yield from answer(ready, some)

    def shaped(df: DataFrame) -> DataFrame:
        fields = (f.split(" ") for f in _SHAPE.split(", "))
        return df.select(*(F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in fields))

    stream = shaped(nodes.withColumn("kind", F.lit(0))).unionByName(shaped(asked.withColumn("kind", F.lit(1))))
    return stream.repartition(tasks, "place", "part").sortWithinPartitions("place", "part", "kind").mapInArrow(of, shape)


class Index:
    """A packed R-tree over (vec_id, label, v). `rows` are its members with `key` (a number of the row) and `home` (its slab)."""

    def __init__(self, vectors: DataFrame, slab: int = SLAB, page: int = PAGE, part: int = PART):
        vectors, self.n = cut(vectors, "vectors")
        self.part = part
        self.slabs = max(1, -(-self.n // slab))
        places = vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        # one row per coordinate
        sides = {r["d"]: (r["lo"], r["hi"]) for r in places.collect()}
        self.width = 1 + max(sides, default=0)
        widest = max(sides, key=lambda d: (sides[d][1] - sides[d][0], -d), default=0)
        largest = max((abs(x) for side in sides.values() for x in side), default=0)
        self.kind = kind = np.float64 if self.width * largest ** 2 < 2 ** 52 else np.int64
        v = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(self.width) - F.size("v")))
        rows = vectors.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", v.alias("v"))
        dealt = rows.repartitionByRange(self.slabs, F.get("v", F.lit(widest)), "vec_id", "key").withColumn("home", F.spark_partition_id())
        self.rows, _ = cut(dealt, "slabs")

        def packed(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
            flat = np.stack(_lists(table["v"].combine_chunks()))
            out = [(table["home"][0].as_py(), flat[r].min(axis=0), flat[r].max(axis=0), ids[r], labels[r], flat[r].ravel()) for r in tiles(flat, page)]
            longs = pa.list_(pa.int64())
            return pa.table([pa.array([o[0] for o in out], pa.int32())] + [pa.array([o[j] for o in out], longs) for j in range(1, 6)],
                            names=["place", "lo", "hi", "ids", "labels", "flat"])

        shape = "place int, lo array<long>, hi array<long>, ids array<long>, labels array<long>, flat array<long>"
        self.pages, _ = cut(self.rows.select("home", "vec_id", "label", "v").groupBy("home").applyInArrow(packed, shape), "pages")

        def hull(table: pa.Table) -> pa.Table:
            lo, hi = (np.stack(_lists(table[n].combine_chunks())) for n in ("lo", "hi"))
            longs = pa.list_(pa.int64())
            return pa.table([pa.array([[table["place"][0].as_py()]], longs), pa.array([lo.min(axis=0)], longs), pa.array([hi.max(axis=0)], longs)],
                            names=["ids", "lo", "hi"])

        boxes = self.pages.select("place", "lo", "hi").groupBy("place").applyInArrow(hull, "ids array<long>, lo array<long>, hi array<long>")
        # Boxes of slabs lie in blocks of a bounded number, which are the places of `route`.
        self.blocks = -(-self.slabs // 1024)
        self.boxes, _ = cut(boxes.withColumn("place", F.pmod(F.get("ids", F.lit(0)), F.lit(self.blocks)).cast("int")), "boxes")

    def _parts(self, asked: DataFrame, n: int) -> tuple[DataFrame, int]:
        parts = max(1, -(-n // self.part))
        return asked.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")), parts

    def _everywhere(self, nodes: DataFrame, parts: int) -> DataFrame:
        return nodes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def route(self, asked: DataFrame, n: int) -> DataFrame:
        """`asked` once for every slab but its home whose box may hold a score inside one of its windows, as `place`."""
        asked, parts = self._parts(asked, n)
        kind = self.kind
        schema = pa.schema([("place", pa.int32()), ("key", pa.int64()), ("own", pa.int64()), ("label", pa.int64()), ("home", pa.int32()), *(
            (c, pa.list_(pa.int64())) for c in ("v", "low", "high"))])

        def held(rows):
            return Boxes(np.stack([r["lo"] for r in rows]), np.stack([r["hi"] for r in rows]), kind), np.array([r["ids"][0] for r in rows])

        def answer(ready, some):
            boxes, names = ready
            least, most = boxes.intervals(np.stack(_lists(some.column("v"))).astype(kind))
            low, high, home = _lists(some.column("low")), _lists(some.column("high")), some.column("home").to_numpy()
            row, place = [], []
            for i in range(len(some)):
                open_ = ((most[i][:, None] >= low[i]) & (least[i][:, None] <= high[i])).any(axis=1) & (names != home[i])
                place += names[open_].tolist()
                row += [i] * int(open_.sum())
            out = some.select(_QUERY).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *(out.column(c).cast(schema.field(c).type) for c in _QUERY)], schema=schema)

        shape = "place int, key long, own long, label long, home int, v array<long>, low array<long>, high array<long>"
        dealt = asked.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        return _streamed(self._everywhere(self.boxes, parts), dealt, self.blocks * parts, held, answer, shape)

    def visit(self, asked: DataFrame, n: int, k: int, same: bool) -> DataFrame:
        """(key, w, vec_id, score): the k best rows of slab `place` in each window of each row of `asked`."""
        asked, parts = self._parts(asked, n)
        kind = self.kind

        def answer(slab: Slab, some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            low, high = _lists(some.column("low")), _lists(some.column("high"))
            key, own, label = (some.column(c).to_numpy() for c in ("key", "own", "label"))
            queries = np.stack(_lists(some.column("v"))).astype(kind)
            for at in range(0, len(some), 512):
                least, most = slab.intervals(queries[at:at + 512])
                out = [[], [], [], []]
                for i in range(at, min(at + 512, len(some))):
                    for w, (s, ids) in enumerate(slab.search(
                            queries[i], least[i - at], most[i - at], own[i], label[i], low[i], high[i], k, same)):
                        out[0] += [key[i]] * len(s)
                        out[1] += [w] * len(s)
                        out[2] += ids.tolist()
                        out[3] += s.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                                                  pa.array(out[3], pa.int64())], ["key", "w", "vec_id", "score"])

        return _streamed(self._everywhere(self.pages, parts), asked, self.slabs * parts, lambda rows: Slab(rows, kind), answer,
                         "key long, w int, vec_id long, score long")

    def search(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """
        (key, w, rank, vec_id, score): for each row of `asked` (key, own, label, home, v, low, high) and each of its windows [low[w], high[w]]
        the k best rows of the index that have its label (`same`), or have another, and another id.
        """
        asked, n = cut(asked.select(*_QUERY), "asked")
        best = Window.partitionBy("key", "w").orderBy(F.desc("score"), "vec_id")

        def first(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

        home, _ = cut(first(self.visit(asked.withColumn("place", F.col("home")), n, k, same)), "home")
        # What the home slab leaves to beat; as many entries as windows.
        kth = home.where(F.col("rank") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
        bounded = asked.join(kth, "key", "left").withColumn("low", F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.col("kth")[w], x))))
        routed, visits = cut(self.route(bounded, n), "routed")
        self.visits = visits
        away = self.visit(routed, n, k, same)
        return first(home.drop("rank").unionByName(away)).select("key", "w", "rank", "vec_id", "score")


def _floor_div(a, b: int):
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def mine(index: Index, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """
    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each of `anchors` (rows of `index.rows`) its first
    `positives` rows of its label, and for each of these the first `negatives` rows of other labels whose score is from `low` to `high` percent of the positive's.
    """
    asked = anchors.select("key", F.col("vec_id").alias("own"), "label", "home", "v", F.array(F.lit(LOWEST)).alias("low"), F.array(F.lit(HIGHEST)).alias("high"))
    near, _ = cut(index.search(asked, positives, same=True).select("key", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score")), "positives")
    score = F.col("score").cast("decimal(20,0)")  # a hundred times a score need not fit 64 bits
    least, most = -_floor_div(-score * low, 100), _floor_div(score * high, 100)
    windows = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("w", least.alias("low"), most.alias("high")))).alias("windows"))
    again = asked.drop("low", "high").join(windows, "key").withColumns({"low": F.col("windows.low"), "high": F.col("windows.high")})
    found = index.search(again, negatives, same=False).withColumns({"w": F.col("w") + 1, "negative_id": F.col("vec_id"), "negative_score": F.col("score")})
    rows = found.drop("vec_id", "score").join(near.withColumnRenamed("score", "positive_score"), ["key", "w"])
    return rows.join(asked.select("key", F.col("own").alias("anchor_id")), "key").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
