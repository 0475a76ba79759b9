"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_extract, jaccard, line_dedup, lm_scoring, mixing, packing, suffix_dedup, topk
from . import quality as ranking
from .common import read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op2_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_bilstm_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.permutation(read(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9))


def op5_parity_sketch_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_dedup.digest_kept(docs, line_dedup.line_dedup(docs))


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return lm_scoring.lm_scores(read(spark, sf_dir, "documents"), labels.where("quality = 1 AND toxic = 0"), stored=True)


def op9_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"))


def op10_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.build_index(read(spark, sf_dir, "embeddings")), every=50, k=5)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


SPACE = r"[\x20\x09-\x0D]"

ORACLES = {
    "op1_exact_dedup": rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS text_sha256,
                  (min(doc_id) OVER () + max(doc_id) OVER ()) // 2 AS ends FROM documents),
     g AS (SELECT text_sha256, count(*) AS group_size,
                  arg_min(doc_id, struct_pack(a := -n, b := doc_id)) AS keep_id, bool_or(doc_id <= ends) AS known
           FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, known FROM d JOIN g USING (text_sha256)""",
    # the exponent is the largest of the grid 0, 1, .. 2 ** 20 over 2 ** 20 that has the target entropy, or the least that keeps repeats
    "op4_temperature_mixing": r"""
WITH RECURSIVE
     d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens,
                  CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM documents),
     t AS (SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0),
     s AS (SELECT tokens / (SELECT sum(tokens) FROM t) AS p FROM t),
     b(lo, hi) AS (SELECT 0, 1048576 UNION ALL
                   SELECT CASE WHEN ok THEN m ELSE lo END, CASE WHEN ok THEN hi ELSE m END
                   FROM (SELECT lo, hi, m, (SELECT ln(sum(p ** (m / 1048576))) - sum(p ** (m / 1048576) * (m / 1048576) * ln(p)) / sum(p ** (m / 1048576)) FROM s)
                                >= 0.92 * ln((SELECT count(*) FROM s)) AS ok
                         FROM (SELECT lo, hi, (lo + hi) // 2 AS m FROM b WHERE hi - lo > 1))),
     e AS (SELECT CASE WHEN (SELECT count(*) FROM s) = 1 THEN 1.0
                       WHEN (SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) FROM s) >= 0.92 * ln((SELECT count(*) FROM s)) THEN 1.0
                       ELSE greatest((SELECT max(lo) / 1048576 FROM b), coalesce(1 - ln(2) / nullif((SELECT ln(max(tokens) / min(tokens)) FROM t), 0), 0)) END AS a),
     w AS (SELECT source, tokens, tokens ** a / sum(tokens ** a) OVER () AS weight, sum(tokens ** a) OVER () * max(tokens ** (1 - a)) OVER () AS total FROM t, e),
     k AS (SELECT *, floor(weight * total / tokens + 1e-9) AS whole, greatest(0, weight * total - floor(weight * total / tokens + 1e-9) * tokens) AS rest FROM w),
     r AS (SELECT d.*, k.weight, coalesce(k.whole, 1) AS whole,
                  CAST(n_tokens > 0 AND k.rest > 0.5 AND sum(n_tokens) OVER (PARTITION BY d.source ORDER BY place) <= k.rest AS INT) AS last
           FROM d LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source),
     o AS (SELECT *, unnest(generate_series(0, CAST(whole AS BIGINT) + last - 1)) AS pass FROM r),
     q AS (SELECT *, CASE WHEN pass = whole THEN place ELSE CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || pass), 1, 15) AS BIGINT) END AS spot FROM o)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, CAST(pass AS INT) AS pass, CAST(spot >> 44 AS INT) AS block, spot AS place FROM q""",
    "op6_line_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
     k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^{SPACE}+', ''), '{SPACE}+$', ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     m AS (SELECT k.doc_id, k.pos, k.line, coalesce(c.keeper <> k.doc_id, false) AS lost FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(lost::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op10_pivot_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
