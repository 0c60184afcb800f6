"""
Language ID by hyperdimensional profiles.

Every letter has a pseudorandom vector of +1 and -1, made from its code point
alone. A trigram's vector binds its letters: the first one's vector rotated
twice, the second one's once, the third's as it is, multiplied element by
element. A text's vector bundles (adds) the vectors of its trigrams; a
language's prototype bundles those of its training texts. A text takes the
language whose prototype has the largest cosine with it.

A text is lower-cased; each run of what is not a letter is one space, and one
stands at either end, so that a single letter makes a trigram.

Training sums trigram counts per language inside tasks, then by a shuffle of
(language, trigram) sums; the vectors of those are bundled in parts. What
reaches the driver is one vector per language, as many as there are labels
(`MOST_LANGUAGES`, more are refused).

Defined cases: a text that is null, empty or without a letter is `und` with
score 0. Rows without a language do not train. With equal cosines the language
first in code point order is taken. Without any training text all rows are
`und`. Null and repeated ids are rows like others. Other columns may have any
name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

DIMENSIONS = 1024
SEED = 2026
MOST_LANGUAGES = 10_000
#: Letters of text that are worked on at once.
PART = 1 << 21
#: Letters of one text that are looked at at once.
PIECE = 1 << 20


@lru_cache(maxsize=1 << 16)
def letter(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vector of a letter, or of the space (32)."""
    bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, dimensions, dtype=np.int8)
    vector = (2 * bits - 1).astype(np.float32)
    vector.setflags(write=False)
    return vector


@lru_cache(maxsize=1 << 16)
def _rotated(code: int, by: int, dimensions: int) -> np.ndarray:
    return np.roll(letter(code, dimensions), by)


def bound(trigram: tuple[int, int, int], dimensions: int = DIMENSIONS) -> np.ndarray:
    a, b, c = trigram
    return _rotated(a, 2, dimensions) * _rotated(b, 1, dimensions) * letter(c, dimensions)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which of all code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def codes(text: str) -> Iterator[np.ndarray]:
    """
    The lower-cased text's letters with single spaces between runs and at both ends, in pieces that overlap by two,
    so that every trigram of the whole text lies in one piece.
    """
    low, carried, after_letter = f" {text.lower()} ", np.zeros(0, np.int64), True
    for at in range(0, len(low), PIECE):
        raw = np.frombuffer(low[at:at + PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        is_letter = _letters()[raw]
        # of what is not a letter the first stands for its run
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[0] |= after_letter
        after_letter = bool(is_letter[-1])
        piece = np.concatenate([carried, np.where(is_letter, raw, 32)[keep].astype(np.int64)])
        yield piece
        carried = piece[-2:]


def _parts(texts: list[str]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(row, piece) for the pieces of some texts, in lists of bounded length."""
    part, size = [], 0
    for i, text in enumerate(texts):
        for piece in codes(text):
            if len(piece) < 3:
                continue
            if part and size + len(piece) > PART:
                yield part
                part, size = [], 0
            part.append((i, piece))
            size += len(piece)
    if part:
        yield part


def _trigrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, texts by trigrams counts, the trigrams) for runs of texts of bounded length."""
    for part in _parts(texts):
        first = part[0][0]
        joined = np.concatenate([c for _, c in part])
        ends = np.cumsum([len(c) for _, c in part])
        row = np.repeat([i - first for i, _ in part], np.diff(ends, prepend=0))
        alphabet, dense = np.unique(joined, return_inverse=True)
        k = len(alphabet)
        key = (dense[:-2] * k + dense[1:-1]) * k + dense[2:]
        inside = np.ones(len(key) + 2, dtype=bool)
        inside[ends - 1] = inside[ends - 2] = False
        inside = inside[:-2]
        key, row = key[inside], row[:-2][inside]
        if k ** 3 <= 1 << 24:
            seen = np.zeros(k ** 3, dtype=bool)
            seen[key] = True
            used = np.flatnonzero(seen)
            number = np.cumsum(seen) - 1
            column = number[key]
        else:
            used, column = np.unique(key, return_inverse=True)
        yield first, row, column, np.stack([alphabet[used // (k * k)], alphabet[used // k % k], alphabet[used % k]], axis=1)


def _vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """The bound vectors of trigrams, one per row."""
    alphabet, dense = np.unique(grams, return_inverse=True)
    dense = dense.reshape(grams.shape)
    base = np.stack([letter(int(c), dimensions) for c in alphabet]) if len(alphabet) else np.zeros((0, dimensions), np.float32)
    out = np.roll(base, 2, axis=1)[dense[:, 0]]
    out *= np.roll(base, 1, axis=1)[dense[:, 1]]
    out *= base[dense[:, 2]]
    return out


def profiles(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """The vector of every text, and its number of trigrams that have a letter."""
    out = np.zeros((len(texts), dimensions), np.float32)
    lettered = np.zeros(len(texts), np.int64)
    for first, row, column, grams in _trigrams(texts):
        n, width = int(row[-1]) + 1, len(grams)
        lettered[first:first + n] += np.bincount(row, (grams != 32).any(axis=1)[column], minlength=n).astype(np.int64)
        step = max(1, (1 << 23) // width)
        for a in range(0, n, step):
            b = min(n, a + step)
            lo, hi = np.searchsorted(row, [a, b])
            counts = np.bincount((row[lo:hi] - a) * width + column[lo:hi], minlength=(b - a) * width).reshape(b - a, width).astype(np.float32)
            used = np.flatnonzero(counts.any(axis=0))
            out[first + a:first + b] += counts[:, used] @ _vectors(grams[used], dimensions)
    return out, lettered


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundled vector of each language's texts, unit length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for one in sorted(set(langs)):
                total: dict = {}
                for _, _, column, grams in _trigrams([x or "" for x in batch.filter(pa.array(langs == one)).column("body").to_pylist()]):
                    for g, n in zip(map(tuple, grams.tolist()), np.bincount(column, minlength=len(grams)).tolist()):
                        total[g] = total.get(g, 0) + n
                keys = list(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one] * len(keys), pa.string()), *(pa.array([k[j] for k in keys], pa.int32()) for j in range(3)), pa.array(list(total.values()), pa.int64())],
                    ["lang", "a", "b", "c", "n"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), text_of(text).alias("body")).where("lang IS NOT NULL")
    sums = rows.mapInArrow(count, "lang string, a int, b int, c int, n long").groupBy("lang", "a", "b", "c").agg(F.sum("n").alias("n"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            grams = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in "abc"], axis=1).astype(np.int64)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
            for one in sorted(set(langs)):
                own = np.flatnonzero(langs == one)
                for at in range(0, len(own), 4096):
                    some = own[at:at + 4096]
                    found[one] = found.get(one, 0) + n[some] @ _vectors(grams[some], dimensions).astype(np.float64)
        for one, vector in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([one] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector.astype(np.int64))], ["lang", "i", "x"])

    parts = sums.mapInArrow(bundle, "lang string, i int, x long").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = parts.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    got = whole.limit(MOST_LANGUAGES + 1).collect()
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {}
    for row in sorted(got, key=lambda r: r["lang"].encode()):
        vector = np.array(row["v"], dtype=np.float64)
        if norm := np.linalg.norm(vector):
            out[row["lang"]] = (vector / norm).astype(np.float32)
    return out


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, lang_pred, score) for every row; the score is the cosine, 0 if negative."""
    names = list(known)
    matrix = np.stack([known[n] for n in names]) if names else np.zeros((0, dimensions), np.float32)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                vectors, lettered = profiles([x or "" for x in part.column("body").to_pylist()], dimensions)
                langs, scores = ["und"] * len(part), np.zeros(len(part))
                if names:
                    cosines = vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                    best = cosines.argmax(axis=1)
                    scores = np.where(lettered > 0, np.clip(cosines[np.arange(len(part)), best], 0, 1), 0).astype(np.float64)
                    langs = [names[b] if n else "und" for b, n in zip(best, lettered)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(langs, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text).alias("body"))
    return rows.mapInArrow(of, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
