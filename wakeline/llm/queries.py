"""The operators and the pipeline as registered queries over the driver's tables, with SQL where SQL can say them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

import corpus_pipeline

from . import exact_dedup, langid, merkle, mixing, negatives, quality, secret_scan, sentencepiece_codec, simhash, spelling, suffix_dedup, token_rollups, topk
from .common import documents, scratch_path


def _is(kind, span):
    return span["kind"] == kind


def op1_secret_scan(spark, sf_dir):
    docs = documents(spark, sf_dir)
    ledger = secret_scan.Ledger(spark, scratch_path(spark, "blob-ledger"))
    ledger.commit(docs, "first")
    rows = ledger.by_path(docs)
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return rows.select(
        F.col("path").alias("doc_id"),
        *(F.size(F.filter("spans", partial(_is, k))).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS),
        F.sha2(said, 256).alias("base_sha256"), said.alias("spans"))


def op2_mix_sources(spark, sf_dir):
    return mixing.Mix(documents(spark, sf_dir)).taken().select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.deduplicated(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op4_top_k(spark, sf_dir):
    vectors = topk.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    pages, trees = topk.build(vectors)
    return topk.search(pages, trees, vectors.where("vec_id % 50 = 0"), k=5)


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.members(documents(spark, sf_dir))


def op6_quality(spark, sf_dir):
    return quality.classify(documents(spark, sf_dir), corpus_pipeline.trusted(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "lang", "perplexity", "threshold", "kept")


def op7_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    known = langid.prototypes(docs.where(~held_out))
    rows = langid.identify(docs, known)
    return rows.select(F.col("id").alias("doc_id"), F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_sentencepiece(spark, sf_dir):
    coded = sentencepiece_codec.encode(documents(spark, sf_dir).select("doc_id", "text"), exact="exact")
    return coded.select("doc_id", "ids", F.size("ids").alias("n_tokens"), F.col("ids_chunks").alias("n_chunks"), "exact")


def op9_token_counts(spark, sf_dir):
    totals = token_rollups.Rollup(spark, scratch_path(spark, "token-rollup"))
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    totals.commit(token_rollups.apart(docs).select(F.lit("insert").alias("op"), F.lit(0).alias("seq"), "*"), "first")
    return totals.totals()


def op10_simhash(spark, sf_dir):
    return simhash.groups(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_fingerprints(spark, sf_dir):
    return merkle.neighbours(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op12_spelling(spark, sf_dir):
    return spelling.variants(spelling.vocabulary(documents(spark, sf_dir)))


def op13_hard_negatives(spark, sf_dir):
    rows = negatives.members(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    seventh = F.pmod("vec_id", F.lit(7)) == 0
    index = negatives.Index(rows.withColumn("label", F.when(seventh, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))))
    return negatives.mine(index, index.rows.where("vec_id % 100 = 0"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_mix_sources": op2_mix_sources,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_top_k": op4_top_k,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_token_counts": op9_token_counts,
    "op10_simhash": op10_simhash,
    "op11_fingerprints": op11_fingerprints,
    "op12_spelling": op12_spelling,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}

def _secret_spans(kind, no, pattern, group, least):
    """Spans of one kind in DuckDB: what lies between matches and the matches' lengths give the places."""
    return f"""
        SELECT doc_id, '{kind}' AS kind, {no} AS k, a, a + length(m) AS b FROM (
            SELECT doc_id, m, g, sum(length(between_) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS a FROM (
                SELECT doc_id, unnest(string_split_regex(body, '{pattern}')[:len(ms)]) AS between_, unnest(ms) AS m, unnest(gs) AS g, unnest(range(len(ms))) AS i FROM (
                    SELECT doc_id, body, regexp_extract_all(body, '{pattern}') AS ms, regexp_extract_all(body, '{pattern}', {group}) AS gs
                    FROM d WHERE regexp_matches(body, '{pattern}'))))
        WHERE length(g) >= {least}"""


_ASSIGN = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + (
    """)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""")


def _tree_sql(text):
    """A text's sections as DuckDB sees them: see merkle.tree."""
    pieces = f"regexp_extract_all(p, '{merkle.PIECE}')"
    paragraph = f"left(sha256(p), {merkle.WIDE}) || array_to_string(list_transform({pieces}, lambda x: left(md5(x), {merkle.NARROW})), '')"
    return f"""list_transform(regexp_extract_all({text}, '{merkle.SECTION}'), lambda n:
        array_to_string(list_transform(regexp_extract_all(n, '{merkle.PARAGRAPH}'), lambda p: {paragraph}), ','))"""


def _root_sql(tree):
    return f"""sha256(array_to_string(list_transform({tree}, lambda n:
        md5(array_to_string(list_transform(string_split(n, ','), lambda p: left(p, {merkle.WIDE})), ''))), ''))"""


def _held_sql(nodes):
    return f"coalesce(list_sum(list_transform({nodes}, lambda n: list_sum(list_transform(string_split(n, ','), lambda p: (length(p) - {merkle.WIDE}) // {merkle.NARROW})))), 0)"


def _likeness_sql(rows, left, right, name):
    """`rows` with how alike two trees are, one level after the other: see merkle.likeness."""
    only = "list_filter(list_distinct({0}), lambda x: NOT list_contains({1}, x))"
    opened = "list_distinct(flatten(list_transform({0}, lambda n: string_split(n, ','))))"
    pieces = f"list_distinct(flatten(list_transform({{0}}, lambda p: regexp_extract_all(substr(p, {merkle.WIDE + 1}), '.{{{{{merkle.NARROW}}}}}'))))"
    return f"""
        SELECT * EXCLUDE (l0, r0, l1, r1, l2, r2, same), CASE WHEN {_root_sql(left)} = {_root_sql(right)} THEN 1.0::DOUBLE ELSE
            2 * (same + len(list_intersect(l2, r2))) / (2 * (same + len(list_intersect(l2, r2)))
                + len({only.format("l2", "r2")}) + len({only.format("r2", "l2")})) END AS {name}
        FROM (SELECT * REPLACE (same + {_held_sql("list_intersect(l1, r1)")} AS same),
                  {pieces.format(only.format("l1", "r1"))} AS l2, {pieces.format(only.format("r1", "l1"))} AS r2
              FROM (SELECT *, {_held_sql("list_intersect(l0, r0)")} AS same,
                        {opened.format(only.format("l0", "r0"))} AS l1, {opened.format(only.format("r0", "l0"))} AS r1
                    FROM (SELECT *, {left} AS l0, {right} AS r0 FROM ({rows}))))"""


_NEXT_SQL = f"""
    SELECT doc_id, length(body)::BIGINT AS n_chars, edited, {_tree_sql("body")} AS tree, {_tree_sql("edited")} AS edited_tree, {_tree_sql("next_body")} AS next_tree
    FROM (SELECT doc_id, body, next_body, left(body, length(body) - length(body) // 3) || left(next_body, length(body) // 3) AS edited
          FROM (SELECT doc_id, body, coalesce(lead(body) OVER w, first(body) OVER w) AS next_body
                FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
                WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, sha256(body) DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))"""


ORACLES = {
    "op1_secret_scan": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        s AS ({" UNION ALL ".join((_secret_spans("assign", 0, _ASSIGN, 2, 8), _secret_spans("access", 1, "AKIA[A-Z0-9]+", 0, 16), _secret_spans("hex", 2, "[0-9a-f]{32,}", 0, 32)))}),
        g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                  string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
            sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (doc_id)""",
    "op4_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, 1 + len(q.v)), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256
        FROM d JOIN g USING (body)""",
    "op11_fingerprints": f"""
        SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_root_sql("tree")} AS fingerprint, {_root_sql("edited_tree")} AS edited_fingerprint, near_edited, near_next
        FROM ({_likeness_sql(_likeness_sql(_NEXT_SQL, "tree", "edited_tree", "near_edited"), "tree", "next_tree", "near_next")})""",
    # The CRC-32 of a run's bytes from the polynomial; near words share a word with one code point deleted, or one is the other's.
    "op12_spelling": """
        WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
        r AS (SELECT coalesce(doc_id::VARCHAR, '') AS i, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]{7,}')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        b AS (SELECT run, list_transform(regexp_extract_all(hex(encode(i || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM r),
        h AS (SELECT run, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM b, t),
        w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
        v AS (SELECT word, count(*)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
        k AS (SELECT DISTINCT word, unnest(list_append(list_transform(range(length(word)), lambda p: left(word, p) || substr(word, p + 2)), word)) AS key FROM v),
        -- words of two lengths that share a key: one is the other with a code point deleted, or both have one deleted (then their lengths are equal)
        q AS (SELECT DISTINCT a.word AS a, b.word AS b FROM k a JOIN k b USING (key)
              WHERE a.word <> b.word AND (length(a.word) <> length(b.word) OR len(list_filter(range(1, 1 + length(a.word)), lambda i: a.word[i] <> b.word[i])) = 1)),
        f AS (SELECT a AS word, count(*)::BIGINT AS n_near, min({m: -n, w: b}) AS best FROM q JOIN v ON v.word = b GROUP BY a),
        g AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * n THEN best.w END AS form, CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n
              FROM v LEFT JOIN f USING (word)),
        s AS (SELECT word, word AS here, 0 AS step FROM g UNION ALL SELECT s.word, g.form, step + 1 FROM s JOIN g ON g.word = s.here WHERE g.form IS NOT NULL)
        SELECT g.word, form, root, n, n_near, form_n FROM g JOIN (SELECT word, arg_max(here, step) AS root FROM s GROUP BY word) USING (word)""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                       list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_sum(list_transform(range(1, 1 + len(a.v)), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
              FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS no FROM s WHERE alike) WHERE no <= 5),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
