"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clustering, decontaminate, divergence, embeddings, language, lines, packing, pii, sharding, simhash, token_counts, urls, warc
from ._common import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_cut")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.round_trip(table(spark, sf_dir, "pages")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language, op2_simhash, op3_line_dedup, op4_token_counts, op5_warc, op6_decontamination, op7_packing, op8_embeddings, op9_urls, op10_sharding, op11_pii, op12_clusters, op13_divergence)
}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

#: 1 + floor(10^9 (n + 5) / (total + 5 kinds)), exact.
_SHARE = "(1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * {kinds}))::BIGINT"

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {shift}) & 31) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0)
)


def _lloyd(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """SQL of op12: a table for each round's assignment and one for its centroids."""
    near = "SELECT q, vec_id, x, cluster, d FROM (SELECT q, v.vec_id, v.x, c.cluster, list_sum(list_transform(range(1, {dim} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d, row_number() OVER (PARTITION BY q ORDER BY d, c.cluster) AS r FROM v, c{j} c) WHERE r = 1"
    mean = """SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{j} c LEFT JOIN (SELECT cluster, list(y ORDER BY i) AS x FROM (SELECT cluster, i, floor_div(sum(x[i])::HUGEINT, count(*)) AS y
  FROM (SELECT cluster, x, unnest(range(1, {dim} + 1)) AS i FROM a{j}) GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = c.cluster"""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS q, vec_id, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND list_bool_and(list_transform(embedding, lambda y: y IS NOT NULL AND isfinite(y))))""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS cluster, x FROM (SELECT x, sha256('3:' || vec_id::VARCHAR) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for j in range(rounds + 1):
        parts.append(f"a{j} AS MATERIALIZED ({near.format(j=j, dim=dim)})")
        if j < rounds:
            parts.append(f"c{j + 1} AS MATERIALIZED ({mean.format(j=j, dim=dim)})")
    whole = ", ".join(parts).replace("floor_div(sum(x[i])::HUGEINT, count(*))", "((sum(x[i]) - (((sum(x[i]) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT")
    return f"""WITH {whole}
SELECT vec_id, a.cluster, d AS distance, (sum(d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


ORACLE_SQL: dict[str, str] = {
    "op12_clusters": _lloyd(),
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1:i + k], ' ') AS gram FROM (SELECT item_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM bw)),
ks AS (SELECT DISTINCT k FROM g),
dw AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT DISTINCT doc_id, i, dw.k, item_id FROM dw JOIN g ON dw.gram = g.gram AND dw.k = g.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
    "op5_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
e AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  nullif(max(page_id) OVER w, page_id) AS refers_to FROM e WINDOW w AS (PARTITION BY payload_digest)""",
    "op8_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT vec_id, label, x, label IS NOT NULL AND x IS NOT NULL AND coalesce(list_bool_and(list_transform(x, lambda y: y IS NOT NULL AND isfinite(y))), false)
  AND coalesce(list_bool_or(list_transform(x, lambda y: y <> 0)), false) AS sound FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.sound AND b.sound WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM g JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op13_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS MATERIALIZED (SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(w) AS term FROM d) WHERE term <> '' GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n_lang FROM o GROUP BY lang, term HAVING count(*) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n_lang)::BIGINT AS total_lang FROM kept GROUP BY lang),
c AS MATERIALIZED (SELECT o.lang, o.source, o.term, sum(n)::BIGINT AS n FROM o JOIN kept ON o.lang = kept.lang AND o.term = kept.term GROUP BY ALL),
g AS MATERIALIZED (SELECT x.lang, x.source, coalesce(v, 0) AS v, coalesce(total_lang, 0) AS total_lang, coalesce(total, 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN langs ON x.lang = langs.lang LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) t ON t.lang = x.lang AND t.source = x.source),
full_ AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {_SHARE.format(n="coalesce(c.n, 0)", total="total", kinds="v")} AS p, {_SHARE.format(n="n_lang", total="total_lang", kinds="v")} AS q
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
summed AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM full_ a JOIN full_ b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM full_ WHERE n > 0 AND p > q),
both_ AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_) WHERE part = 'pair' OR rank <= 50""",
}
