"""Mixing, top-k search and the pipeline beside brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wakeline.llm import mixing, topk

from odd import none_at_all, odd_docs, odd_rows, words


def n_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, held = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        level = (goal - sum(held.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return {s: held.get(s, level * w[s]) for s in names}
        held |= {s: most * sizes[s] for s in over}


def test_mix_of_odd_rows(spark):
    mix = mixing.Mix(odd_docs(spark), block=8, per_shard=16, in_bucket=5)
    rows = mix.taken().collect()
    sizes = defaultdict(int)
    for r in odd_rows():
        sizes[r[3]] += n_words(r[1] or "")
    targets = brute_targets(dict(sizes))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], n_words(r[1] or "")) for r in odd_rows())
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 8 + 0.01 * t
    again = mixing.Mix(odd_docs(spark), block=8, per_shard=16, in_bucket=5).taken().collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.Mix(none_at_all(spark)).taken().count() == 0


def test_blocks_are_the_words_taken(spark):
    docs = odd_docs(spark)
    mix = mixing.Mix(docs, block=8, per_shard=16, in_bucket=5)
    slots = mix.slots.collect()
    assert sorted(r.position for r in slots) == list(range(len(slots)))
    assert sum(r.drawn for r in mix.draws.collect()) == len(slots) and {r.shard for r in slots} == set(range(-(-len(slots) // 16)))
    uses = Counter((r.source_no, r.block) for r in slots)
    blocks = {r.source_no: r.blocks for r in mix.sources.collect()}
    for s, n in blocks.items():  # each pass over a source takes each block once
        counts = sorted(uses[s, b] for b in range(n))
        assert not counts or counts[-1] - counts[0] <= 1 and counts[-1] <= 2
    texts = mix.blocks().collect()
    assert len(texts) == len(slots) and max(n_words(r.text) for r in texts) <= 8
    assert sum(n_words(r.text) for r in texts) == sum(r.taken for r in mix.taken().collect())


def test_mixed_rows(spark):
    rows = [(i, words(i, 20 + i), "en", "abc"[i % 3], 1) for i in range(60)] + [(99, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit(1))
    mix = mixing.Mix(docs, block=8)
    out = mix.mixed()
    assert out.columns == docs.columns
    words_of = Counter()
    texts = {r[0]: r[1] for r in rows}
    for r in out.collect():
        words_of[r.doc_id] += n_words(r.text)
        assert set(r.text.split()) <= set(texts[r.doc_id].split())
    assert words_of == Counter({r.doc_id: r.taken for r in mix.taken().collect() if r.taken})


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 0, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, None: 30}, {"a": 7, "b": 7, "c": 7, "d": 7, "e": 0}, {"é": 50, "z": 10, "A": 900}])
def test_targets(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r.source for r in got} == set(want)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_permutations(spark, n):
    rows = spark.range(n).select("id", F.lit(n).cast("long").alias("n"))
    got = [r.x for r in mixing.permuted(rows, "id", "n", "x", [F.lit(3)], 5).collect()]
    assert sorted(got) == list(range(n)) and (n < 7 or got != list(range(n)))


def brute_top(vectors, asked, k):
    out = []
    for i, q in vectors:
        if asked(i):
            scores = sorted(((-int(np.dot(q, v)), j) for j, v in vectors if j != i))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(3)
    n = 300
    data = {"spread": rng.normal(size=(n, 8)), "clustered": np.repeat(rng.normal(size=(6, 8)), 50, axis=0) * 5 + rng.normal(size=(n, 8)) * 0.1,
            "equal": np.repeat(rng.normal(size=(3, 8)), 100, axis=0)}[kind]
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(data)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows]
    vectors = topk.whole_vectors(docs)
    pages, trees = topk.build(vectors, tree=64, page=8)
    assert trees == 5
    got = topk.search(pages, trees, vectors.where("vec_id % 7 = 0"), k=4, queries=5)
    assert sorted(map(tuple, got.collect())) == brute_top(whole, lambda i: i % 7 == 0, 4)


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 0.0], 1), (None, [1.0, 1.0], 1),
            (5, [0.5], 1), (6, [], 1), (7, [1.0, 2.0, 3.0], 1), (50, [-1.0, -0.001], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    vectors = topk.whole_vectors(docs)
    pages, trees = topk.build(vectors)
    got = sorted(map(tuple, topk.search(pages, trees, vectors.where("vec_id % 50 = 0")).collect()))
    whole = [(i, [math.floor(256 * x) for x in v] + [0] * (3 - len(v))) for i, v in ((0, [1.0, 2.0]), (5, [0.5]), (6, []), (7, [1.0, 2.0, 3.0]), (50, [-1.0, -0.001]))]
    assert got == brute_top(whole, lambda i: i % 50 == 0, 5)
    pages, trees = topk.build(topk.whole_vectors(docs.limit(0)))
    assert topk.search(pages, trees, topk.whole_vectors(docs)).count() == 0


def test_rows_that_repeat_an_id_are_asked_each(spark):
    whole = [(i, [i % 5, 3 - i % 4, i]) for i in range(30)]
    vectors = spark.createDataFrame(whole, "vec_id long, v array<long>")
    pages, trees = topk.build(vectors, tree=8, page=4)
    asked = [(3, [1, 0, 0]), (3, [0, -1, -1]), (3, [1, 0, 0]), (4, [0, 0, 1])]
    got = topk.search(pages, trees, spark.createDataFrame(asked, "vec_id long, v array<long>"), k=2, queries=2).collect()
    want = [(q, n, i, s) for q, a in asked for n, (s, i) in enumerate(
        [(-s, i) for s, i in sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in whole if i != q)[:2]], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_bounds_save_work():
    rng = np.random.default_rng(1)
    data = np.floor(256 * (np.repeat(rng.normal(size=(40, 16)), 50, axis=0) * 3 + rng.normal(size=(2000, 16)) * 0.05)).astype(np.int64)
    tree = topk.Tree(list(topk.pages_of(np.arange(2000), data, 50)))
    computed = [tree.search(i, data[i], 5)[1] for i in range(0, 2000, 100)]
    assert np.mean(computed) < 500


def test_pipeline_stages(spark, sf_dir):
    docs = corpus_pipeline.documents(spark, sf_dir)
    columns, kept = docs.columns, docs
    before = None
    for name, stage in corpus_pipeline.STAGES:
        kept, n = corpus_pipeline.cut(stage(spark, kept, sf_dir), f"test-{name}")
        if name != "encode":
            assert kept.columns == columns
        if name in ("quality", "exact_dedup", "near_dedup"):
            assert before is None or n <= before
            before = n
        if name == "exact_dedup":
            assert kept.select("text").distinct().count() == n
        assert n > 0
    assert kept.where("NOT exact").count() == 0
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = {r.doc_id for r in corpus_pipeline.trusted(spark, sf_dir).collect()}
    assert len(ids & good) > 0.6 * len(good)


def test_pipeline_of_odd_rows(spark, sf_dir):
    docs = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for empty in (False, True):
        kept = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            kept, n = corpus_pipeline.cut(stage(spark, kept, sf_dir), f"odd-{name}")
        assert (n == 0) == empty


def test_random_texts_mix_alike(spark):
    rng = random.Random(9)
    rows = [(i, words(i, rng.randint(0, 50)), rng.choice("abcdefg")) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = Counter(map(tuple, mixing.Mix(docs, block=16).taken().collect()))
    two = Counter(map(tuple, mixing.Mix(docs.repartition(3), block=16).taken().collect()))
    assert one == two
