"""Merkle fingerprints, spelling variants and hard negatives beside brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wakeline.llm import merkle, negatives, spelling
from wakeline.llm.merkle import NARROW, PARAGRAPH, PIECE, SECTION, WIDE

from odd import none_at_all, odd_docs, odd_rows, words


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_tree(text):
    def paragraph(p):
        return sha(p)[:WIDE], [md5(s)[:NARROW] for s in re.findall(PIECE, p)]
    return [[paragraph(p) for p in re.findall(PARAGRAPH, s)] for s in re.findall(SECTION, text)]


def brute_root(tree):
    return sha("".join(md5("".join(h for h, _ in s)) for s in tree))


def brute_likeness(a, b):
    if brute_root(a) == brute_root(b):
        return 1.0
    def frozen(t):
        return {tuple((h, tuple(p)) for h, p in s) for s in t}
    a, b = frozen(a), frozen(b)
    same = sum(len(p) for s in a & b for _, p in s)
    a, b = {p for s in a - b for p in s}, {p for s in b - a for p in s}
    same += sum(len(p) for _, p in a & b)
    a, b = {x for _, p in a - b for x in p}, {x for _, p in b - a for x in p}
    same += len(a & b)
    return 2 * same / (2 * same + len(a ^ b))


def brute_neighbours(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, sha(r[1])), reverse=True)
    for at, (i, text) in enumerate(rows):
        after, third = rows[(at + 1) % len(rows)][1], len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        own, other, following = brute_tree(text), brute_tree(edited), brute_tree(after)
        yield (i, len(text), sha(edited), brute_root(own), brute_root(other), round(brute_likeness(own, other), 12), round(brute_likeness(own, following), 12))


PROSE = [(100 + i, ".\n".join(words(i * 7 + j, 9) + "! " + words(j, 4) for j in range(i)) + "\n\n" * (i % 3)) for i in range(1, 25)]
PROSE += [(200, PROSE[-1][1][:500] + "x" + PROSE[-1][1][500:]), (None, "\n\nleading\n\n\nblank"), (201, "\U0001F600é" * 40), (202, "ab"), (203, "abc"), (204, "a,b" * 90)]


def test_neighbours(spark):
    docs = odd_docs(spark).select("*")
    more = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in PROSE], "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(more, allowMissingColumns=True)
    got = Counter((*r[:5], round(r[5], 12), round(r[6], 12)) for r in map(tuple, merkle.neighbours(both).collect()))
    assert got == Counter(brute_neighbours([(r[0], r[1]) for r in odd_rows()] + PROSE))
    assert merkle.neighbours(none_at_all(spark)).count() == 0


def test_copies_of_one_row_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 3)
    docs = spark.createDataFrame([(1, "one text of some length")] * 10 + [(0, "another")], "doc_id long, text string")
    got = Counter((*r[:5], round(r[5], 12), round(r[6], 12)) for r in map(tuple, merkle.neighbours(docs).collect()))
    assert got == Counter(brute_neighbours([(1, "one text of some length")] * 10 + [(0, "another")]))


def test_single_row_is_its_own_next(spark):
    rows = merkle.neighbours(spark.createDataFrame([(5, "abcdefghi")], "doc_id long, text string")).collect()
    assert [(r.near_next, r.edited_sha256) for r in rows] == [(1.0, sha("abcdefabc"))]


def test_edits_are_located(spark):
    lines = [words(i, 12) + "\n" for i in range(30)]
    changed = lines.copy()
    changed[17] = "new line\n"
    before = spark.createDataFrame([(1, "".join(lines)), (2, "same"), (3, None), (None, "x")], "doc_id long, text string")
    after = spark.createDataFrame([(1, "".join(changed)), (2, "same"), (4, "new")], "doc_id long, text string")
    start = sum(map(len, lines[:17]))
    got = {tuple(r) for r in merkle.edits(before, after).collect()}
    assert got == {(1, "before", start, start + len(lines[17])), (1, "after", start, start + 9), (4, "after", 0, 3)}


def test_likeness_of_any_trees(spark):
    rows = spark.createDataFrame([("a\nb\n", "b\na\n"), ("", ""), ("", "x"), ("x, y", "x, y")], "a string, b string")
    trees = rows.select(merkle.tree(rows.a).alias("row"), merkle.tree(rows.b).alias("same section"))
    assert [r.likeness for r in merkle.likeness(trees, "row", "same section").collect()] == [
        brute_likeness(brute_tree(a), brute_tree(b)) for a, b in (("a\nb\n", "b\na\n"), ("", ""), ("", "x"), ("x, y", "x, y"))]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_vocabulary(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def brute_variants(seen, ratio=10):
    near, form = defaultdict(list), {}
    for a in seen:
        for b in seen:
            if one_edit(a, b):
                near[a].append(b)
    for w in seen:
        best = min(near[w], key=lambda b: (-seen[b], b), default=None)
        form[w] = best if best is not None and seen[best] >= ratio * seen[w] else None
    for w in seen:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, seen[w], len(near[w]), seen.get(form[w])


def test_vocabulary_of_odd_rows(spark):
    got = {r.word: r.n for r in spelling.vocabulary(odd_docs(spark)).collect()}
    assert got == brute_vocabulary([(r[0], r[1]) for r in odd_rows()]) and len(got) > 5
    many = [(i, " ".join(["Straßenbahn ÀÉÿ×÷àabc", "Tomorrows", "x" * 5000][: 1 + i % 3])) for i in range(200)]
    got = {r.word: r.n for r in spelling.vocabulary(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    assert got == brute_vocabulary(many)


def mutated(rng, w, letters):
    i, kind = rng.randrange(len(w)), rng.randrange(3)
    return w[:i] + ("" if kind == 0 else rng.choice(letters)) + w[i + (kind < 2):]


@pytest.mark.parametrize("few", [0, 2, 50])
def test_variants(spark, few):
    rng = random.Random(few)
    base = ["".join(rng.choice(["ab", "ba", "tion", "é", "aa", "x"]) for _ in range(rng.randint(4, 9))) for _ in range(120)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "bababab", "abababa", "a" * 400, "a" * 399 + "b"]
    seen = {w: rng.choice([2, 3, 20, 30, 300, 4000]) for w in base if len(w) >= 7}
    for w in list(seen):
        for _ in range(3):
            m = mutated(rng, w, "abéx")
            if len(m) >= 7:
                seen.setdefault(m, rng.choice([2, 3, 20, 200]))
    df = spark.createDataFrame(list(seen.items()), "word string, n long")
    got = Counter(tuple(r) for r in spelling.variants(df, few=few, most=1 << 16).collect())
    assert got == Counter(brute_variants(seen))


def test_words_whose_grams_may_all_change(spark):
    # short words of one letter have few distinct grams, and are found by their deletions
    seen = {"aaa": 40, "aaaa": 4, "aab": 2, "ab": 2, "b": 30, "aa": 3}
    df = spark.createDataFrame(list(seen.items()), "word string, n long")
    assert Counter(tuple(r) for r in spelling.variants(df, few=0).collect()) == Counter(brute_variants(seen))
    assert spelling.variants(df.limit(0)).count() == 0


def test_an_edit_changes_no_more_grams_than_counted():
    rng = random.Random(4)
    some = ["".join(rng.choice("abc") for _ in range(rng.randint(7, 14))) for _ in range(300)]
    frequent = Counter(w[i:i + q] for w in some for q in range(2, 7) for i in range(len(w) - q + 1))
    frequent = {g: n for g, n in frequent.items() if n > 5}
    for w in some:
        grams, most = spelling.decompose(w, frequent)
        for _ in range(30):
            m = mutated(rng, w, "abc")
            left = set(grams) - set(spelling.decompose(m, frequent)[0])
            assert len(left) <= most <= spelling.LONGEST


def brute_negatives(rows, positives=5, k=10):
    out = Counter()
    for own, label, v in rows:
        if own % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, u)), i, other) for i, other, u in rows if i != own))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:k]
            for rank, (t, i, _) in enumerate(inside, 1):
                out[own, p, rank, i, -s, -t] += 1
    return out


@pytest.mark.parametrize("scale", [60, 400_000])
def test_mined_negatives(spark, scale):
    rng = np.random.default_rng(scale)
    centers = rng.normal(size=(6, 5))
    rows = [(int(i) * 10 - 300, int(rng.integers(4)), (centers[rng.integers(6)] + rng.normal(size=5) * 0.4) * scale) for i in range(400)]
    rows += [(9000 + i, 1, rows[30][2]) for i in range(150)] + [(9200 + i, 2, rows[30][2] * 0.5) for i in range(150)]
    data = [(i, lab, [float(x) for x in v], "row") for i, lab, v in rows]
    whole = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v, _ in data]
    data += [(1, None, [1.0] * 5, ""), (2, 1, None, ""), (3, 1, [1.0, None], ""), (4, 1, [float("nan")], ""), (None, 1, [1.0], ""), (5, 1, [float("inf")], ""), (600006, 3, [], "")]
    whole.append((600006, 3, [0] * 5))
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>, home string")
    index = negatives.Index(negatives.members(df), slab=64, page=8, part=7)
    got = Counter(tuple(r) for r in negatives.mine(index, index.rows.where("vec_id % 100 = 0")).collect())
    assert index.kind is (np.float64 if scale == 60 else np.int64)
    assert got == brute_negatives(whole) and len(got) > 100
    empty = negatives.Index(negatives.members(df.limit(0)))
    assert negatives.mine(empty, empty.rows).count() == 0


def test_boxes_rule_pages_out():
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.integers(-5, 5, size=(60, 4)) + c * 100 for c in range(12)])
    pages = [{"lo": vectors[r].min(axis=0), "hi": vectors[r].max(axis=0), "ids": r, "labels": r * 0, "flat": vectors[r].ravel()} for r in negatives.tiles(vectors, 16)]
    assert sorted(np.concatenate([p["ids"] for p in pages]).tolist()) == list(range(len(vectors))) and max(len(p["ids"]) for p in pages) <= 16
    slab = negatives.Slab(pages, np.float64)
    query = np.array([1.0, 1.0, 0.0, 2.0])
    least, most = slab.intervals(query[None])
    found = slab.search(query, least[0], most[0], -1, 0, np.array([1000]), np.array([2500]), 5, True)
    scores = vectors @ query
    inside = [i for i in np.lexsort((np.arange(len(vectors)), -scores)) if 1000 <= scores[i] <= 2500][:5]
    assert found[0][1].tolist() == inside and slab.opened < len(pages) / 3
