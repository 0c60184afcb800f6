"""
Exact top-k search by inner product with M-trees.

Vectors of whole numbers are dealt to trees of a bounded number of vectors. A
tree has two levels of pages: routing entries (a vector of the page, its
covering radius, the largest length below it, its distance to the tree's own
routing vector) and leaf entries (a vector, its distance to the page's routing
vector). Pages are filled by assigning vectors to far-apart pivots.

A query goes through a tree best page first. For a vector x within distance r
of c, q.x is at most (|q|^2 + m^2 - d^2) / 2, where m bounds |x| and d is the
least distance that |d(q, c) - r| leaves. Stored parent distances bound d(q, c)
and d(q, x) before they are computed (the triangle inequality), and a page or
entry whose bound is below the k-th best score so far is never computed. Bounds
are widened by a relative 1e-9, so rounding cannot cost a result; equal bounds
are followed, so ties are settled by the smaller id. Scores are exact whole
numbers.

Blocks of queries are sent to every tree; a task loads one tree's pages and
lets the blocks stream past. Each answer is a query's k best of one tree, and a
window keeps the k best of all, of which Spark keeps k in every task before it
shuffles. Trees are dealt by hash and have bounded sizes, whatever the number of
equal vectors.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part. Shorter vectors count as followed by zeros; an empty vector is
all zeros. Rows without an id take no part. Rows that repeat an id are candidates each, and
queries each, whose answers carry the one id. Components and scores must fit 64 bits. Other columns
may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TREE = 4096
PAGE = 128
QUERIES = 512
SLACK = 1e-9


def whole_vectors(rows: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, of rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    lists = column.to_pylist()
    width = max([width, *map(len, lists)]) if lists else width
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


def pages_of(ids: np.ndarray, vectors: np.ndarray, page: int = PAGE) -> Iterator[dict]:
    """The pages of one tree: far-apart pivots route, each vector goes to its nearest pivot."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    real = vectors.astype(np.float64)
    pivots = _pivots(real, max(1, -(-len(ids) // page)))
    squares = (real ** 2).sum(axis=1)
    apart = squares[:, None] + squares[pivots][None, :] - 2 * real @ real[pivots].T
    nearest_pivot = apart.argmin(axis=1)
    root = real[pivots[0]]
    for p in np.unique(nearest_pivot):
        own, center = np.flatnonzero(nearest_pivot == p), real[pivots[p]]
        to_center = np.sqrt(((real[own] - center) ** 2).sum(axis=1))
        by = np.argsort(to_center, kind="stable")
        # a pivot with many near vectors, perhaps all equal, takes several pages
        for at in range(0, len(own), page):
            rows, away = own[by[at:at + page]], to_center[by[at:at + page]]
            yield {"root": root, "center": center, "parent": float(np.sqrt(((center - root) ** 2).sum())), "radius": float(away.max()),
                   "longest": float(np.sqrt(squares[rows].max())), "ids": ids[rows], "flat": vectors[rows].ravel(), "away": away}


def _pivots(real: np.ndarray, n: int) -> np.ndarray:
    """Far-apart vectors: each the farthest from those before it."""
    chosen, away = [0], ((real - real[0]) ** 2).sum(axis=1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((real - real[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def _most(size: float, longest, least):
    """The largest inner product that lengths and least distances allow, a little widened."""
    return np.minimum((size + longest ** 2 - least ** 2) / 2, np.sqrt(size) * longest) + SLACK * (size + longest ** 2) + 1


class Tree:
    """The pages of one tree, ready for best-first search."""

    def __init__(self, pages: list[dict], exact: bool = True):
        self.source = pages
        # Where products of doubles are whole numbers without rounding, they are the scores.
        largest = max(float(p["longest"]) for p in pages)
        self.exact = exact and largest ** 2 < 2 ** 50
        kind = np.float64 if self.exact else np.int64
        self.pages = [(p["ids"], p["flat"].reshape(len(p["ids"]), -1).astype(kind), p["away"]) for p in pages]
        self.root = pages[0]["root"]
        self.centers = np.stack([p["center"] for p in pages])
        self.parents, self.radii, self.longest = (np.array([p[n] for p in pages]) for n in ("parent", "radius", "longest"))

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) of other ids, and how many vectors were computed."""
        query = query[:self.centers.shape[1]]  # what lies beyond meets zeros only
        query = np.pad(query, (0, self.centers.shape[1] - len(query)))
        q = query.astype(np.float64)
        size = float((q ** 2).sum())
        if self.exact and size >= 2 ** 50:
            return Tree(self.source, exact=False).search(own, query, k)
        to_root = math.sqrt(((q - self.root) ** 2).sum())
        bound = _most(size, self.longest, np.maximum(np.abs(to_root - self.parents) - self.radii, 0))
        to_center = np.full(len(bound), np.nan)
        best: list[tuple[int, int]] = []
        low, computed, waiting = None, 0, np.argsort(-bound, kind="stable")
        while len(waiting):
            page = waiting[0]
            if low is not None and bound[page] < low:
                break
            if to_center[page] != to_center[page]:
                some = waiting[np.isnan(to_center[waiting])][:16 if low is None else 64]
                away = self.centers[some] - q
                to_center[some] = np.sqrt(np.einsum("ij,ij->i", away, away))
                bound[some] = np.minimum(bound[some], _most(size, self.longest[some], np.maximum(to_center[some] - self.radii[some], 0)))
                waiting = waiting[np.argsort(-bound[waiting], kind="stable")]
                continue
            waiting = waiting[1:]
            ids, vectors, away = self.pages[page]
            start, stop = 0, len(ids)
            if low is not None:
                # entries lie by their distance to the page's vector: those that may reach `low` are a run of them
                most = size + self.longest[page] ** 2
                reach = math.sqrt(max(0.0, most - 2 * (low - SLACK * most - 1)))
                start, stop = away.searchsorted(to_center[page] - reach), away.searchsorted(to_center[page] + reach, "right")
            computed += int(stop - start)
            scores = vectors[start:stop] @ (q if self.exact else query)
            ids = ids[start:stop]
            rows = np.flatnonzero((scores >= low) & (ids != own)) if low is not None else np.flatnonzero(ids != own)
            if low is None:
                rows = rows[np.lexsort((ids[rows], -scores[rows]))[:k]]
            if len(rows):
                found = [(int(s), i) for s, i in zip(scores[rows].tolist(), ids[rows].tolist())]
                best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[:k]
                low = best[-1][0] if len(best) == k else None
        return best, computed


_PAGE = ("tree int, kind int, part int, root array<double>, center array<double>, parent double, radius double, longest double, "
         "ids array<long>, flat array<long>, away array<double>")
_FIELDS = [("tree", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("root", pa.list_(pa.float64())), ("center", pa.list_(pa.float64())),
           ("parent", pa.float64()), ("radius", pa.float64()), ("longest", pa.float64()), ("ids", pa.list_(pa.int64())), ("flat", pa.list_(pa.int64())),
           ("away", pa.list_(pa.float64()))]


def build(vectors: DataFrame, tree: int = TREE, page: int = PAGE) -> tuple[DataFrame, int]:
    """The index of (vec_id, v): one row per page, written once, and the number of trees."""
    vectors, n = cut(vectors, "vectors")
    trees = max(1, -(-n // tree))

    def of(table: pa.Table) -> pa.Table:
        number = table["tree"][0].as_py()
        rows = [{"tree": number, "kind": 0, "part": i, **p} for i, p in enumerate(pages_of(
            table["vec_id"].to_numpy(), _matrix(table["v"].combine_chunks()), page))]
        return pa.Table.from_pylist([{k: x.tolist() if isinstance(x, np.ndarray) else x for k, x in r.items()} for r in rows], schema=pa.schema(_FIELDS))

    dealt = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(trees)).cast("int").alias("tree"))
    return cut(dealt.groupBy("tree").applyInArrow(of, _PAGE), "metric-pages")[0], trees


def search(pages: DataFrame, trees: int, asked: DataFrame, k: int = 5, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `asked` (vec_id, v) the k best rows of the index with another id, k for each row that repeats an id."""
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), queries):
                part = batch.slice(at, queries)
                vectors = _matrix(part.column("v"))
                row = {"kind": 1, "part": 0, "ids": part.column("vec_id").to_pylist() + part.column("key").to_pylist(), "flat": vectors.ravel().tolist()}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([f for f in _FIELDS if f[0] != "tree"]))

    # A block's ids are its queries' own, then the numbers that tell their rows apart.
    blocks = asked.select("vec_id", "v", F.monotonically_increasing_id().alias("key")).mapInArrow(block, _PAGE.removeprefix("tree int, "))
    everywhere = blocks.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, index = None, [], None
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                if (here := row["tree"].as_py()) != number:
                    number, rows, index = here, [], None
                if row["kind"].as_py() == 0:
                    rows.append({n: row[n].values.to_numpy(zero_copy_only=False) for n in ("root", "center", "ids", "flat", "away")} | {
                        n: row[n].as_py() for n in ("parent", "radius", "longest")})
                    continue
                if not rows:
                    continue
                index = index or Tree(rows)
                ids, flat = row["ids"].values.to_numpy().reshape(2, -1), row["flat"].values.to_numpy()
                out = [(key, own, i, s) for own, key, q in zip(*ids.tolist(), flat.reshape(ids.shape[1], -1)) for s, i in index.search(own, q, k)[0]]
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(4)], ["key", "query_id", "vec_id", "score"])

    stream = pages.unionByName(everywhere).repartition(trees, "tree").sortWithinPartitions("tree", "kind", "part")
    found = stream.mapInArrow(of, "key long, query_id long, vec_id long, score long")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
