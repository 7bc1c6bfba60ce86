import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from conftest_llm import SCHEMA, prose  # noqa: E402

#: Columns whose names the operators use inside.
CLASHING = ("size", "bucket", "row_key", "shard", "quality", "toxic", "label", "key", "payload", "starts", "times", "component")


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = prose(9, 60_000)
    texts = [None, "", " \t\n", "one", "two words", prose(1, 40), prose(1, 40), prose(1, 40).upper(), "é ñ ß   日本", long, long, "12345 !!! ###", "a\x00b \x01 <|endoftext|> it's", prose(2, 13), prose(2, 13) + " tail"]
    rows = [(i, t, ["en", None, "fr"][i % 3], ["s", None, "t"][i % 3], None if i % 2 else 5) for i, t in enumerate(texts)]
    rows += [(None, prose(1, 40), None, None, None), (3, "one", "en", "s", 3), (3, "one", "en", "s", 3), (5, prose(3, 30), "fr", None, None)]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit("x").alias(c) for c in CLASHING))
