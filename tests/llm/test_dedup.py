"""Exact dedup, SimHash groups and suffix dedup beside brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest
import xxhash

from wakeline.llm import exact_dedup, simhash, suffix_dedup

from odd import none_at_all, odd_docs, odd_rows, words


def lows(x):
    return (x is not None, x if x is not None else 0)


def test_exact_members(spark):
    got = exact_dedup.members(odd_docs(spark), salts=3).collect()
    groups = defaultdict(list)
    for r in odd_rows():
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max(ids, key=lows)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want


def test_exact_survivors(spark):
    docs = odd_docs(spark)
    got = exact_dedup.survivors(docs, salts=3)
    assert got.columns == docs.columns
    rows = got.select("doc_id", "text").collect()
    want = {}
    for i, text, *_ in odd_rows():
        want[text or ""] = max(want.get(text or "", i), i, key=lows)
    assert sorted(((r.text or ""), lows(r.doc_id)) for r in rows) == sorted((t, lows(i)) for t, i in want.items())


@pytest.mark.parametrize("f", [exact_dedup.members, exact_dedup.survivors, simhash.groups, simhash.survivors, suffix_dedup.deduplicated])
def test_empty_tables(spark, f):
    assert f(none_at_all(spark)).count() == 0


def brute_fingerprint(text, k=3):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[i:i + k]), 42) for i in range(max(1, len(ws) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    names = sorted(fps)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in names:
        for b in names:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in names}


def test_simhash_groups(spark):
    rows = odd_rows() + [(100 + i, words(1, 60) + " x" * i, "en", "a", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.id, r.fp & (1 << 64) - 1, r.component) for r in simhash.groups(docs).collect())
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    roots = brute_components({f for _, f in prints}, 2)
    least = {}
    for i, f in prints:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    assert got == Counter((i, f, least.get(roots[f])) for i, f in prints)


@pytest.mark.parametrize("radius,split", [(2, 4096), (2, 3), (1, 4096), (3, 2)])
def test_links_join_what_all_pairs_join(spark, radius, split):
    """Also where blocks are divided: many fingerprints that share most bits."""
    import random
    rng = random.Random(radius)
    values = {0, (1 << 64) - 1} | {rng.getrandbits(64) for _ in range(40)}
    for base in list(values)[:10]:
        values |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(8)) for _ in range(25)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), radius, split).collect()
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u & (1 << 64) - 1), find(v & (1 << 64) - 1)
        root[max(a, b)] = min(a, b)
    assert {v: find(v) for v in values} == brute_components(values, radius)


def test_bit_sliced_distances():
    import random
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for v in values]
    for radius in (0, 1, 2, 5, 7, 17, 40):
        want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= radius}
        assert set(simhash.within(values, radius)) == want


def test_near_copies_by_five_words(spark):
    base = [words(500 + i, 200) for i in range(6)]
    rows, want = [], {}
    for i, text in enumerate(base):
        parts = text.split()
        for j in range(4):
            copy = list(parts)
            if j:
                copy[10 * j] = f"changed{j}"
            rows.append((10 * i + j, " ".join(copy)))
            want[10 * i + j] = 10 * i
        rows.append((10 * i + 9, " ".join(parts[:40]) + " " + words(900 + i, 160)))  # shares a fifth only
        want[10 * i + 9] = 10 * i + 9
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component for r in simhash.near_groups(docs).collect()} == want
    assert sorted(r.doc_id for r in simhash.survivors(docs).collect()) == sorted(set(want.values()))


def test_near_survivors_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = simhash.survivors(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert 1 in ids and None not in ids and 15 in ids


def test_near_survivors_are_one_of_each_group(spark):
    """Other texts without an id, or with an id that stands already, are documents of their own."""
    rows = [(r[0], r[1]) for r in odd_rows()] + [(None, words(300, 80)), (None, words(301, 80)), (None, words(301, 80)), (16, words(302, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = brute_near(list(enumerate(t or "" for _, t in rows)))
    best = {}
    for k, (i, text) in enumerate(rows):
        named = (i is None, i or 0, xxhash.xxh64_intdigest(text or "", 42) ^ 1 << 63)  # signed, as Spark has it
        best[near[k]] = min(best.get(near[k], named), named)
    want = Counter(r for k, r in enumerate(rows) if best[near[k]] == (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest(r[1] or "", 42) ^ 1 << 63))
    got = Counter((r.doc_id, r.text) for r in simhash.survivors(docs).collect())
    assert got == want
    assert got[None, words(300, 80)] == 1 and got[None, words(301, 80)] == 2 and sum(i == 16 for i, _ in got.elements()) == 3


def test_blocks_in_parts_lose_nothing(spark, monkeypatch):
    text = words(77, 300).split()
    rows = [(i, " ".join([*text[:i], f"w{i}", *text[i + 1:]])) for i in range(40)]
    monkeypatch.setattr(simhash, "MEMBERS", 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component for r in simhash.near_groups(docs).collect()} == {0}


def brute_near(rows, similarity=0.8):
    """The smallest id that links by whole sets of five words reach."""
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = {i: {tuple(w[a:a + 5]) for a in range(max(1, len(w) - 4))} for i, w in ((i, text.encode().translate(lower).split()) for i, text in rows)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("likeness,linked", [(0.78, False), (0.80, True), (0.82, True)])
def test_near_pairs_are_decided_by_whole_sets(spark, likeness, linked):
    """Pairs of 450 shingles, 900 * likeness / (1 + likeness) of them shared, rounded to the side of 0.8 that is asked for."""
    rows = []
    for i in range(60):
        text = [f"w{i}x{j}" for j in range(454)]
        same = round(900 * likeness / (1 + likeness)) + 4
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:same] + [f"v{i}x{j}" for j in range(454 - same)]))]
    want = brute_near(rows)
    assert all((want[2 * i + 1] == 2 * i) == linked for i in range(60))
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.component for r in got} == want


def test_candidates_that_fail_hide_no_link(spark, monkeypatch):
    """Near copies around the bound in one block, whose first links fail while others hold; blocks in parts too."""
    import random
    monkeypatch.setattr(simhash, "WHOLE", 5)
    rng = random.Random(6)
    rows = []
    for g in range(6):
        base = [f"g{g}w{j}" for j in range(300)]
        for i in range(12):
            text = list(base)
            for j in rng.sample(range(300), rng.randint(3, 9)):
                text[j] = f"g{g}c{i}x{j}"
            rows.append((len(rows), " ".join(text)))
    want = brute_near(rows)
    assert len(set(want.values())) > 12
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.component for r in got} == want


def brute_suffix(texts, length):
    seen = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 50, 8])
def test_suffix_dedup(spark, length):
    rows = odd_rows()
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter((r[0], *b) for r, b in zip(rows, brute_suffix(texts, length)))
    got = suffix_dedup.deduplicated(odd_docs(spark), length).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got:  # the runs that went are listed, apart from each other and of that many bytes
        runs = [tuple(map(int, x.split(":"))) for x in (r.removed or "").split(",") if x]
        assert len(runs) == r.n_spans and sum(b - a for a, b in runs) == r.n_removed
        assert all(a < b for a, b in runs) and all(b < c for (_, b), (c, _) in zip(runs, runs[1:])) and all(b <= r.n_bytes for _, b in runs)


def test_suffix_dedup_of_a_small_alphabet(spark):
    import random
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 400))) for _ in range(30)] + ["ab" * 200, "ba" * 150, "b" * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.id: tuple(r)[1:5] for r in suffix_dedup.deduplicated(docs, 40, with_bytes=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute_suffix([t.encode() for t in texts], 40)


def test_anchors_of_long_texts_come_in_parts(monkeypatch):
    import random

    import numpy as np
    monkeypatch.setattr(suffix_dedup, "PART", 300)
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(5000)), np.uint8)
    ends = np.array([0, 10, 3000, 3700, 5000])
    cut = {(int(r), int(p), int(h)) for r, ps, hs in ((r, p, h) for r, p, h in suffix_dedup._text_anchors(data, ends, 50)) for r, p, h in zip(r, ps, hs)}
    whole = set()
    for row, (a, b) in enumerate(zip(ends, ends[1:])):
        place, hashed = suffix_dedup.anchors(data[a:b], np.array([0, b - a]), 50)
        whole |= {(row, int(p), int(h)) for p, h in zip(place, hashed)}
    assert cut == whole
