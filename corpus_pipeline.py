"""The corpus pipeline: raw ``documents`` to a content-addressed store of token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import decontamination, language_id, mixing, near_dup, token_store
from siltstone.llm.shared import documents, tokenizer_path, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; null and empty texts and those without a letter go.

    Rows are judged each by its own text, so repeated rows and equal doc_ids share their fate; all columns stay.
    """
    return language_id.accepted(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id.

    Of rows that share doc_id and text one stays; rows that share a doc_id with other texts are one document and
    stay together.  A null doc_id names no document, so those rows are linked with nothing and all stay.
    """
    kept = near_dup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    chosen = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    # the join has dealt the rows by doc_id, so this shuffles nothing
    nth = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
    chosen = chosen.select(F.struct(*docs.columns).alias("_row"), nth.alias("_nth")).where("_nth = 1").select("_row.*")
    return chosen.unionByName(docs.where("doc_id is null"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none, rows are judged each."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: one row each time.

    Texts without a word add nothing to the mix, but whole passes over their source take them too; null is a
    source of its own; repeated rows count each.
    """
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The store's rows, read back from its files: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are an end id alone; rows with a null doc_id come first, repeated rows are stored each.
    """
    return token_store.TokenStore.write(docs, tokenizer_path()).documents()


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("decontamination", without_leaks),
    ("mixing", mixed),
    ("token_output", token_ids),
]

#: The stages run models, hashes and a tokenizer, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
