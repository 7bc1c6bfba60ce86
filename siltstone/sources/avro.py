"""Avro schemas in JSON: as Spark types, and their compatibility."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PRIMITIVES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "bytes": T.BinaryType()}
#: What a reader's type may be for a writer's type, besides the same.
_PROMOTIONS = {"int": {"long", "float", "double"}, "long": {"float", "double"}, "float": {"double"}, "string": {"bytes"}, "bytes": {"string"}}


def _type(avro: Any) -> tuple[T.DataType, bool]:
    """(Spark type, nullable)."""
    if isinstance(avro, list):
        rest = [a for a in avro if a != "null"]
        if len(rest) != 1 or len(rest) == len(avro):
            raise ValueError(f"only unions of null and one type are supported, not {avro}")
        return _type(rest[0])[0], True
    if isinstance(avro, str):
        if avro not in _PRIMITIVES:
            raise ValueError(f"unsupported Avro type {avro!r} (named and recursive references are not)")
        return _PRIMITIVES[avro], False
    kind, logical = avro["type"], avro.get("logicalType")
    if kind == "record":
        return to_struct(avro), False
    if kind == "array":
        item, nullable = _type(avro["items"])
        return T.ArrayType(item, nullable), False
    if kind == "enum":
        return T.StringType(), False
    if kind == "long" and logical in ("timestamp-millis", "timestamp-micros"):
        return T.TimestampType(), False
    if kind == "int" and logical == "date":
        return T.DateType(), False
    if isinstance(kind, (dict, list)):
        return _type(kind)
    if logical not in (None, "uuid"):
        raise ValueError(f"unsupported logical type {logical!r}")
    return _type(kind)


def to_struct(schema: dict | str) -> T.StructType:
    """An Avro record as a StructType; defaults are kept in the fields' metadata."""
    record = json.loads(schema) if isinstance(schema, str) else schema
    if record.get("type") != "record":
        raise ValueError("the schema is not a record")
    out = []
    for f in record["fields"]:
        kind, nullable = _type(f["type"])
        out.append(T.StructField(f["name"], kind, nullable, {"default": f["default"]} if "default" in f else {}))
    return T.StructType(out)


def enum_values(schema: dict, field: str) -> list[str] | None:
    for f in schema["fields"]:
        if f["name"] == field and isinstance(f["type"], dict) and f["type"].get("type") == "enum":
            return list(f["type"]["symbols"])
    return None


def decoded(raw: DataFrame, schema: dict | str, column: str = "value") -> DataFrame:
    """JSON-encoded records decoded by an Avro contract, with the contract's defaults."""
    struct = to_struct(schema)
    rows = raw.select(F.from_json(F.col(column).cast("string"), struct).alias("r"))
    return rows.select(*(F.coalesce(F.col(f"r.{f.name}"), F.lit(f.metadata["default"]).cast(f.dataType)).alias(f.name) if f.metadata.get("default") is not None else F.col(f"r.{f.name}").alias(f.name) for f in struct))


def _plain(avro: Any) -> Any:
    return _plain(avro["type"]) if isinstance(avro, dict) and set(avro) <= {"type", "logicalType", "doc"} else avro


def _readable(reader: Any, writer: Any, path: str) -> list[str]:
    """Why data of the writer's type can't be read as the reader's; empty if it can."""
    reader, writer = _plain(reader), _plain(writer)
    if isinstance(writer, list):
        return [p for w in writer for p in _readable(reader, w, path)]
    if isinstance(reader, list):
        tries = [_readable(r, writer, path) for r in reader]
        return [] if any(not t for t in tries) else [f"{path}: {writer} fits no branch of {reader}"]
    if isinstance(reader, dict) and isinstance(writer, dict):
        if reader["type"] != writer["type"]:
            return [f"{path}: {writer['type']} became {reader['type']}"]
        if reader["type"] == "record":
            return incompatibilities(reader, writer, path)
        if reader["type"] == "array":
            return _readable(reader["items"], writer["items"], f"{path}[]")
        if reader["type"] == "enum":
            lost = set(writer["symbols"]) - set(reader["symbols"])
            return [f"{path}: symbols {sorted(lost)} are gone"] if lost and "default" not in reader else []
        return []
    if reader == writer or (isinstance(writer, str) and reader in _PROMOTIONS.get(writer, ())):
        return []
    return [f"{path}: {writer} became {reader}"]


def incompatibilities(reader: dict, writer: dict, path: str = "") -> list[str]:
    """Why a reader on one record schema can't read data written with another."""
    old = {f["name"]: f for f in writer["fields"]}
    out = []
    for f in reader["fields"]:
        source = next((old[n] for n in [f["name"], *f.get("aliases", [])] if n in old), None)
        here = f"{path}.{f['name']}" if path else f["name"]
        if source is None:
            if "default" not in f:
                out.append(f"{here}: new field without a default")
        else:
            out += _readable(f["type"], source["type"], here)
    return out


def check_backward_transitive(versions: list[dict]) -> list[str]:
    """Every version must read all earlier ones; the problems, by version pair."""
    return [f"version {n + 1} reading version {m + 1}: {p}" for n in range(len(versions)) for m in range(n) for p in incompatibilities(versions[n], versions[m])]
