"""The queries of the corpus operators: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, language_id, mixing, near_dup, quality_fm, quality_rules, sharding, substring_dedup, token_store, toxicity
from .shared import documents, tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.TokenStore.write(documents(spark, sf_dir), tokenizer_path()).documents()


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    all_of = (op1_token_store, op2_sharding, op3_quality_rules, op4_decontamination, op5_mixing, op6_near_dup, op7_quality_fm, op8_toxicity, op9_language_id, op10_substring_dedup)
    return {f.__name__: f for f in all_of}


#: A word, as the operators know it.
_WORD = r"[^\x20\x09-\x0D]+"

_NEAR_DUP_SQL = f"""
WITH RECURSIVE found AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM found),
shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, p, m, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM words)
    WHERE p = 1 OR p <= m - 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b
    WHERE 100 * both_have >= 75 * (m.n + n.n - both_have)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON e.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""

_SUBSTRING_SQL = f"""
WITH found AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM found),
windows AS (
    SELECT doc_id, p, m, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS s FROM words),
late AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS owner FROM windows WHERE p <= m - 12) WHERE owner < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM late),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT found.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM found LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that it can express; their doc_ids are unique."""
    return {"op6_near_dup": _NEAR_DUP_SQL, "op10_substring_dedup": _SUBSTRING_SQL}
