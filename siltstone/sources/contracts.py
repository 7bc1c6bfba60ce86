"""Data-product contracts: loading, checks, and the schemas they declare."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import avro

TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp_tz": T.TimestampType(), "bytes": T.BinaryType()}


def load(path: str | Path) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def struct_of(columns: list[dict]) -> T.StructType:
    """A contract's column list ({name, type}) as a StructType."""
    return T.StructType([T.StructField(c["name"], TYPES[c["type"]]) for c in columns])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` unchanged if names and types are the contract's, else an error that names the difference."""
    have, want = [(f.name, f.dataType.simpleString()) for f in df.schema], [(f.name, f.dataType.simpleString()) for f in schema]
    if have != want:
        raise ValueError(f"not the contract's schema: missing {sorted(set(want) - set(have))}, unexpected {sorted(set(have) - set(want))}")
    return df


def validate(product: dict, root: str | Path, models: set[str]) -> list[str]:
    """The four checks of a product: its wire schema is valid, exists, has a service level for freshness, and every Gold table has a model."""
    problems = []
    source = Path(root) / product.get("source", {}).get("schema", "")
    if not source.is_file():
        problems.append(f"schema {source} does not exist")
    else:
        try:
            avro.to_struct(json.loads(source.read_text(encoding="utf-8")))
        except (ValueError, KeyError) as e:
            problems.append(f"schema {source.name} is not valid: {e}")
    if "gold_freshness" not in product.get("slas", {}):
        problems.append("no service level for gold_freshness")
    problems += [f"gold table {t['name']} has no model" for t in product.get("gold_tables", []) if t["name"] not in models]
    return problems


def retention_days(product: dict) -> dict[str, int | None]:
    """How long the topic and the dead letters are kept."""
    return {"topic": product.get("source", {}).get("kafka_retention_days"), "dead_letters": product.get("dead_letter", {}).get("retention_days")}
