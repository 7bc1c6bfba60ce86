"""Sessions and the serving catalog: named tables as temporary views."""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .sources.snapshots import SnapshotTable

ENVIRONMENTS = ("local", "cluster")


class Lakehouse:
    """A warehouse root, the session that reads it, and its tables as views ``layer_table``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def connect(cls, root: str, env: str | None = None, conf: dict[str, str] | None = None) -> Lakehouse:
        """A session in UTC; ``env`` (or LAKEHOUSE_ENV) is local or cluster, anything else is an error."""
        env = env or os.environ.get("LAKEHOUSE_ENV", "local")
        if env not in ENVIRONMENTS:
            raise ValueError(f"unknown environment {env!r}; one of {', '.join(ENVIRONMENTS)}")
        builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        if env == "local" and SparkSession.getActiveSession() is None:
            builder = builder.master("local[*]")
        for k, v in (conf or {}).items():
            builder = builder.config(k, v)
        return cls(builder.getOrCreate(), root)

    def table(self, name: str) -> SnapshotTable:
        """The table ``layer.name`` under the root."""
        return SnapshotTable(self.spark, f"{self.root}/{name.replace('.', '/')}")

    def read(self, name: str, as_of: str | None = None) -> DataFrame:
        return self.table(name).read(as_of=as_of)

    def register(self, names: Iterable[str]) -> list[str]:
        """A view for each table that can be read; the others are warned about and skipped."""
        done = []
        for name in names:
            try:
                self.read(name).createOrReplaceTempView(name.replace(".", "_"))
                done.append(name)
            except (AnalysisException, FileNotFoundError, LookupError) as e:
                warnings.warn(f"{name} is not registered: {e}", stacklevel=2)
        return done
