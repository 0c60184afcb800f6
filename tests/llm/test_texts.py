"""Secret scans, quality, language, pieces and token counts beside brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import langid, quality, secret_scan, sentencepiece_codec, token_rollups
from wakeline.session import scratch_path

from odd import none_at_all, odd_docs, odd_rows, words

KINDS = [
    ("assign", re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32)]


def brute_spans(text):
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, rx, g, least) in enumerate(KINDS) for m in rx.finditer(text or "") if len(m[g]) >= least]
    return ",".join(x[2] for x in sorted(found))


def said(rows):
    return Counter((r.path, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans)) for r in rows.collect())


def test_secrets_of_odd_rows(spark):
    docs = odd_docs(spark)
    ledger = secret_scan.Ledger(spark, scratch_path(spark, "ledger"))
    ledger.commit(docs, "one")
    assert said(ledger.by_path(docs)) == Counter((r[0], brute_spans(r[1])) for r in odd_rows())
    assert ledger.scanned().count() == len({r[1] or "" for r in odd_rows()})


def test_only_unseen_pairs_are_scanned(spark, monkeypatch):
    ledger = secret_scan.Ledger(spark, scratch_path(spark, "ledger"))
    first = spark.createDataFrame([("a", "token = abcdefgh"), ("b", "token = abcdefgh"), ("c", "plain")], "doc_id string, text string")
    second = spark.createDataFrame([("a", "plain"), ("d", "secret: 12345678"), ("b", None)], "doc_id string, text string")
    ledger.commit(first, "one")
    seen = []
    scan = secret_scan.scan
    monkeypatch.setattr(secret_scan, "scan", lambda blobs: seen.append(sorted(r.body for r in blobs.collect())) or scan(blobs))
    ledger.commit(second, "two")
    ledger.commit(second, "two")  # no effect
    ledger.commit(first, "one", rules="base-2")
    assert seen == [["", "secret: 12345678"], ["plain", "token = abcdefgh"]]
    history = {(r.commit, r.path) for r in ledger.history().collect()}
    assert history == {("one", "a"), ("one", "b"), ("two", "d")}
    assert ledger.scanned().count() == 6 and ledger.findings().count() == 3


def test_a_failed_commit_leaves_no_half(spark, monkeypatch):
    ledger = secret_scan.Ledger(spark, scratch_path(spark, "ledger"))
    docs = spark.createDataFrame([("a", "token = abcdefgh")], "doc_id string, text string")

    def broken(blobs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(secret_scan, "scan", broken)
        with pytest.raises(RuntimeError):
            ledger.commit(docs, "one")
    assert ledger.versions().count() == 0
    ledger.commit(docs, "one")
    assert ledger.versions().count() == 1 and ledger.findings().count() == 1


class Brute:
    """Interpolated modified Kneser-Ney over bytes, by its formulas."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {order: Counter()}
        for t in texts:
            padded = b"\0" * (order - 1) + t
            self.counts[order].update(padded[i:i + order] for i in range(len(t)))
        for m in range(order - 1, 0, -1):
            self.counts[m] = Counter(g[1:] for g in self.counts[m + 1])
        self.d, self.total, self.few = {}, {}, {}
        for m, c in self.counts.items():
            n = Counter(c.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            d1, d2, d3 = (1 - 2 * y * n[2] / n[1] if n[1] else 0), (2 - 3 * y * n[3] / n[2] if n[2] else 0), (3 - 4 * y * n[4] / n[3] if n[3] else 0)
            self.d[m] = [0, *(x if x > 0 else 0.5 for x in (d1, d2, d3))]
            for g, k in c.items():
                self.total[m, g[:-1]] = self.total.get((m, g[:-1]), 0) + k
                self.few[m, g[:-1]] = self.few.get((m, g[:-1]), 0) + self.d[m][min(k, 3)]

    def p(self, g):
        m = len(g)
        if m == 0:
            return 1 / 256
        lower = self.p(g[1:])
        total = self.total.get((m, g[:-1]))
        if not total:
            return lower
        k = self.counts[m][g]
        return max(0, k - self.d[m][min(k, 3)]) / total + self.few[m, g[:-1]] / total * lower

    def log(self, t):
        padded = b"\0" * (self.order - 1) + t
        return sum(math.log(self.p(padded[i:i + self.order])) for i in range(len(t)))


@pytest.mark.parametrize("order", [2, 4])
def test_kneser_ney(spark, monkeypatch, order):
    monkeypatch.setattr(quality, "PACK", 700)
    monkeypatch.setattr(quality, "BLOCK", 2000)
    train = [words(i, 50).encode() for i in range(12)] + ["é ü".encode(), b""]
    model, size = quality.train(spark.createDataFrame([(t.decode(),) for t in train], "body string"), order)
    brute = Brute(train, order)
    docs = odd_docs(spark)
    got = sorted((r.bytes, r.logp) for r in quality.scores(docs, model, size, order).collect())
    want = sorted((len(t), brute.log(t)) for t in ((r[1] or "").encode() for r in odd_rows()))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-4, atol=1e-3)


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(5)
    prose = [(i, words(i, rng.randint(30, 90)), "en") for i in range(120)] + [(200 + i, words(i, 60, "de"), "de") for i in range(60)]
    junk = [(400 + i, " ".join(w.upper() + "!!" if i % 2 else w + "###$$" for w in words(i, 50).split()), "en") for i in range(20)]
    odd = [(500, None, "en"), (501, "", None), (None, words(3, 40), None), (502, words(4, 40), "xx")]
    docs = spark.createDataFrame(prose + junk + odd, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i, _, _ in prose if i % 4] + [(None,), (999,), (1,), (1,)], "doc_id long")
    got = {r.id: r for r in quality.classify(docs, trusted, quantile=0.98).collect()}
    assert sum(got[i].kept for i, _, _ in prose) >= 0.93 * len(prose)
    assert not any(got[i].kept for i, _, _ in junk)
    assert not got[500].kept and not got[501].kept and got[502].kept
    kept = quality.survivors(docs, trusted, quantile=0.98)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.values())


def test_limits_are_of_all_trusted_texts(spark):
    """Each trusted text scored without its own fold, a document by all of them; a small language is not held to its few texts alone."""
    texts = {i: words(i, 12) for i in range(30)} | {100 + i: words(i, 12, "de") for i in range(3)}
    langs = {i: "de" if i >= 100 else "en" for i in texts}
    docs = spark.createDataFrame([(i, t, langs[i]) for i, t in texts.items()] + [(200, words(200, 12), "en")], "doc_id long, text string, lang string")
    got = {r.id: r for r in quality.classify(docs, spark.createDataFrame([(i,) for i in texts], "doc_id long"), quantile=0.9).collect()}
    digests = {r.doc_id: r.d for r in docs.select("doc_id", F.xxhash64("text").alias("d")).collect()}
    fold = {i: digests[i] % quality.FOLDS for i in texts}
    models = {k: Brute([t.encode() for i, t in texts.items() if fold[i] != k], 4) for k in set(fold.values())}
    said = {i: -models[fold[i]].log(t.encode()) / len(t.encode()) for i, t in texts.items()}

    def limit(ids):
        found = sorted(said[i] for i in ids)
        return found[math.ceil(0.9 * len(found)) - 1]

    en, de = limit(i for i in texts if i < 100), max(limit(i for i in texts if i >= 100), limit(texts))
    assert abs(math.log(got[200].threshold) - en) < 2e-3 and abs(math.log(got[100].threshold) - de) < 2e-3
    whole = Brute([t.encode() for t in texts.values()], 4)
    for i in (0, 101, 200):
        text = (texts.get(i) or words(200, 12)).encode()
        assert abs(math.log(got[i].perplexity) + whole.log(text) / len(text)) < 1e-3


def test_quality_without_trust(spark):
    docs = odd_docs(spark)
    nobody = spark.createDataFrame([], "doc_id long")
    rows = quality.classify(docs, nobody).collect()
    assert len(rows) == len(odd_rows()) and all(r.perplexity is None and r.threshold is None for r in rows)
    assert Counter(r.kept for r in rows) == Counter(bool(r[1]) for r in odd_rows())
    assert quality.survivors(none_at_all(spark), nobody).count() == 0


def test_language_vectors():
    a = langid.bound((97, 98, 99))
    b = np.roll(langid.letter(97), 2) * np.roll(langid.letter(98), 1) * langid.letter(99)
    assert (a == b).all() and abs(langid.letter(97) @ langid.letter(98)) < 200


def brute_profile(text):
    out, n = np.zeros(langid.DIMENSIONS), 0
    codes = [ord(c) for c in re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")]
    for g in zip(codes, codes[1:], codes[2:]):
        out += langid.bound(g)
        n += any(c != 32 for c in g)
    return out, n


def test_profiles_are_sums_of_bound_vectors(monkeypatch):
    texts = [r[1] or "" for r in odd_rows()] + ["漢字 かな" + "".join(map(chr, range(0x4E00, 0x4F00))), "İstanbul ǅ"]
    for piece, part in ((1 << 20, 1 << 21), (50, 120), (1, 5)):
        monkeypatch.setattr(langid, "PIECE", piece)
        monkeypatch.setattr(langid, "PART", part)
        vectors, lettered = langid.profiles(texts)
        for text, v, n in zip(texts, vectors, lettered):
            w, m = brute_profile(text)
            assert np.allclose(v, w) and n == m


def test_language_held_out(spark):
    rows = [(i, words(i, 40, lang), lang) for i in range(80) for lang in ("en", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = langid.prototypes(docs.where("doc_id < 60"))
    assert list(known) == ["de", "en"]
    got = langid.identify(docs.where("doc_id >= 60").withColumn("want", F.col("lang")), known).collect()
    assert Counter(r.lang_pred for r in got) == {"en": 20, "de": 20}
    right = {(r[0], r[2]) for r in rows if r[0] >= 60}
    assert {(r.id, r.lang_pred) for r in got} == right


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = langid.identify(docs, langid.prototypes(docs)).collect()
    lettered = Counter((r[0], any(c.isalpha() for c in r[1] or "")) for r in odd_rows())
    assert Counter((r.id, r.lang_pred != "und") for r in got) == lettered
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.prototypes(none_at_all(spark)) == {}


@pytest.mark.parametrize("chunk", [40, 1 << 16])
def test_pieces_equal_the_library(spark, chunk):
    sp = sentencepiece_codec.pieces(sentencepiece_codec.MODEL).processor
    docs = odd_docs(spark)
    coded = sentencepiece_codec.encode(docs, chunk=chunk, out="pieces", exact="fp")
    assert all(r.fp == ("▁" not in (r.text or "")) for r in coded.collect())
    got = Counter((r.doc_id, r.text, None if r.pieces is None else tuple(r.pieces)) for r in coded.collect())
    assert got == Counter((r[0], r[1], None if r[1] is None else tuple(sp.encode(r[1]))) for r in odd_rows())
    back = sentencepiece_codec.decode(coded, ids="pieces").collect()
    assert all(r.decoded == (None if r.text is None else r.text.replace("▁", " ")) for r in back)
    assert sentencepiece_codec.encode(none_at_all(spark), chunk=chunk).count() == 0


def test_scan_over_hard_texts():
    p = sentencepiece_codec.pieces(sentencepiece_codec.MODEL)
    rng = random.Random(2)
    texts = ["a" * 700, " " * 200, "".join(rng.choice("ab 太é\n_") for _ in range(900)), "".join(rng.choice("thean ing") for _ in range(900))]
    for text in texts:
        whole = sentencepiece_codec.prepared(text)
        for chunk in (17, 100):
            matrices, spans = [], []
            for a in range(0, len(whole), chunk):
                b, base = min(len(whole), a + chunk), max(0, a - p.longest)
                body = whole[base:b + p.longest]
                move = lambda s, d: s if s == sentencepiece_codec.START else (s[0] + d, s[1] + d, s[2])
                found = sentencepiece_codec.transfer(p, body, a - base, b - base, a == 0, b == len(whole))
                matrices.append({move(x, base): {move(y, base): w for y, w in row.items()} for x, row in found.items()})
                spans.append((base, body))
            ends = [s for row in sentencepiece_codec._whole(matrices).values() for s in row]
            states = [sentencepiece_codec.START, *sentencepiece_codec.settle(matrices, sentencepiece_codec.START, ends[0]), ends[0]]
            ids = []
            for (base, body), x, y in zip(spans, states, states[1:]):
                ids += p.spell(body, sentencepiece_codec.trace(p, body, move(x, -base), move(y, -base)))
            assert len(ends) == 1 and ids == p.processor.encode(text)


def totals(rollup):
    return {(r.source, r.lang): (r.docs, r.tokens) for r in rollup.totals().collect()}


def brute_totals(stand):
    count = token_rollups._encoding(token_rollups.RANKS).encode_ordinary
    out: dict = {}
    for text, source, lang in stand:
        d, t = out.get((source, lang), (0, 0))
        out[source, lang] = (d + 1, t + len(count(text or "")))
    return out


def test_token_counts_cover_every_row(spark):
    """Also rows that repeat an id, whose texts may differ."""
    from wakeline.llm import queries
    folder = scratch_path(spark, "tables")
    odd_docs(spark).select("doc_id", "text", "source", "lang").write.parquet(f"{folder}/documents.parquet")
    count = token_rollups._encoding(token_rollups.RANKS).encode_ordinary
    want = {}
    for _, text, lang, source, _ in odd_rows():
        docs, tokens = want.get((source, lang), (0, 0))
        want[source, lang] = docs + 1, tokens + len(count(text or ""))
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in queries.op9_token_counts(spark, folder).collect()} == want


def test_rollup_follows_changes(spark):
    rollup = token_rollups.Rollup(spark, scratch_path(spark, "rollup"))
    schema = "op string, doc_id long, seq long, text string, source string, lang string, digest string"
    stand: dict = {}

    def apply(batch, rows):
        assert rollup.commit(spark.createDataFrame([(*r, "x") for r in rows], schema), batch)
        last = {}
        for r in sorted(rows, key=lambda r: r[2]):
            if r[1] is None:
                if r[0] != "delete":
                    stand[len(stand), "free"] = r[3:]
            else:
                last[r[1]] = r
        for i, r in last.items():
            stand.pop(i, None)
            if r[0] != "delete":
                stand[i] = r[3:]
        assert totals(rollup) == brute_totals(stand.values())

    apply("b1", [("insert", i, 0, words(i, 20), "abc"[i % 3], "en") for i in range(9)] + [("insert", None, 0, "free text", None, None), ("insert", 20, 0, None, "a", None)])
    apply("b2", [("revise", 1, 0, "shorter", "b", "en"), ("delete", 2, 0, None, None, None), ("delete", 99, 0, None, None, None), ("insert", 3, 0, "moved away", "z", "de")])
    assert not rollup.commit(spark.createDataFrame([("insert", 77, 0, "again", "a", "en", "x")], schema), "b2")
    assert totals(rollup) == brute_totals(stand.values())
    rollup.compact()
    apply("b3", [("insert", 2, 1, "back", "c", "en"), ("revise", 2, 2, "back again", "c", "en"), ("delete", 1, 0, None, None, None), ("delete", None, 0, None, None, None)])
    apply("b4", [])
    rollup.compact()
    assert totals(rollup) == brute_totals(stand.values())
    assert rollup.standing().count() == sum(1 for k in stand if not isinstance(k, tuple))


def test_a_batch_without_its_marker_does_not_count(spark, monkeypatch):
    rollup = token_rollups.Rollup(spark, scratch_path(spark, "rollup"))
    rows = spark.createDataFrame([("insert", 1, 0, "some text", "a", "en")], "op string, doc_id long, seq long, text string, source string, lang string")

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(token_rollups.Rollup, "_mark", lost)
        with pytest.raises(RuntimeError):
            rollup.commit(rows, "b")
    assert totals(rollup) == {}
    # A marker that was never put in its place is no marker.
    fs, aside = rollup._fs(f"{rollup.root}/aside/torn")
    fs.create(aside, False).close()
    assert totals(rollup) == {}
    assert rollup.commit(rows, "b") and totals(rollup) == {("a", "en"): (1, 2)}


def test_batches_that_meet_are_counted_one_after_the_other(spark, monkeypatch):
    rollup = token_rollups.Rollup(spark, scratch_path(spark, "rollup"))
    schema = "op string, doc_id long, seq long, text string, source string, lang string"
    change = lambda text: spark.createDataFrame([("revise", 1, 0, text, "a", "en")], schema)
    rollup.commit(change("one"), "first")
    mark = token_rollups.Rollup._mark
    met = []

    def late(self, kind, name, *said):
        if not met:  # another batch over the same document is marked first
            met.append(name)
            token_rollups.Rollup(spark, rollup.root).commit(change("one two three"), "between")
        return mark(self, kind, name, *said)

    monkeypatch.setattr(token_rollups.Rollup, "_mark", late)
    assert rollup.commit(change("one two"), "second") and not rollup.commit(change("x"), "second")
    assert list(rollup.committed()) == ["first", "between", "second"] and totals(rollup) == {("a", "en"): (1, 2)}
    rollup.compact()
    assert totals(rollup) == {("a", "en"): (1, 2)} and [r.tokens for r in rollup.standing().collect()] == [2]
    assert rollup.commit(spark.createDataFrame([("delete", 1, 1, None, None, None)], schema), "third") and totals(rollup) == {}
    assert rollup.standing().count() == 0
