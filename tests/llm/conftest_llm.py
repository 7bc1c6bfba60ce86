"""Helpers of the operators' tests."""

import random
import re
import uuid

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def words(text):
    return WORD.findall(text or "")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    words = [f"{chr(97 + k % 26)}{'aeiou'[k % 5]}{chr(98 + k % 17)}{k}" for k in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def table(spark, texts, **columns):
    """documents with these texts; columns: lists for lang, source or doc_id."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((columns.get("doc_id", range(len(texts)))[i], t, columns.get("lang", [None] * len(texts))[i], columns.get("source", ["s"] * len(texts))[i], None if t is None else len(t)))
    path = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}.parquet"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)
