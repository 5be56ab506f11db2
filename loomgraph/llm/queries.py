"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import exact_dedup, language_id, lm_scoring, mixing, near_dedup, packing, secret_scan, suffix_dedup, token_counts, top_k


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_documents(spark, sf_dir)).drop("text_key")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.cross_entropy(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir)).drop("known")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_documents(spark, sf_dir)).drop("copies", "source")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path())


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), count_links=False).drop("text_key")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_lm_scoring, op4_exact_dedup, op5_source_mixing, op6_secret_scan, op7_best_fit_packing, op8_exact_top_k, op9_near_dedup, op10_language_id)}


_OP4 = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""

_OP5 = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 3) AS salt
  FROM documents
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, salt, doc_id NULLS FIRST) - 1 AS place FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight
  FROM d GROUP BY source
), r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM s),
t AS (SELECT CAST(sum(source_size) AS DOUBLE) AS total FROM s),
edges AS (SELECT DISTINCT ratio AS upto FROM r UNION ALL SELECT -1.0),
levels AS (  -- the level if exactly the sources of ratio <= upto are full
  SELECT upto, (1.5::DOUBLE * any_value(total) - 2.0::DOUBLE * coalesce(sum(source_size) FILTER (ratio <= upto), 0)) / sum(weight) FILTER (ratio > upto) AS level,
         min(ratio) FILTER (ratio > upto) AS above
  FROM edges, r, t GROUP BY upto
), chosen AS (SELECT min(level) AS level FROM levels WHERE level >= upto AND level < above),
g AS (
  SELECT source, source_size,
         CASE WHEN total = 0 THEN 0.0::DOUBLE WHEN level IS NULL THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, level * weight) END AS target,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce(source, chr(0) || 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS shift
  FROM r, t, chosen
), c AS (
  SELECT p.doc_id, p.size, g.source_size, g.target, p.place, g.shift, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST((floor(rate * (place + 1) + shift) - floor(rate * place + shift)) * size AS BIGINT) AS taken FROM c
"""

_OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": _OP4, "op5_source_mixing": _OP5, "op8_exact_top_k": _OP8}
