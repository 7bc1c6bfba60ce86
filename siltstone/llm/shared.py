"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "siltstone-sources.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; one of our own only where none is set and all run on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None
        if not folder and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not folder:
            folder = tempfile.mkdtemp(prefix="siltstone-")
            context.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a table's bytes, without reading it; measured where Catalyst knows none (its default is then huge)."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if estimate < 1 << 60:
        return estimate
    texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(8 * len(df.columns)))
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def range_of(column: str, bounds: list[int]) -> Column:
    """The number of bounds below a value, as a binary search of nested conditions; null is 0."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) > bounds[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_chars: int, *also: str) -> list:
    """About ``most`` labelled documents (doc_id, text, label), chosen by a hash of doc_id and in its order.

    The labels are thinned first, so what is sent to the join and to the driver is bounded by ``most``.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    scale = 1 << 30
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * min(1.0, most / max(1, known.count())))
    chosen = known.where(keep).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.where(keep & F.col("text").isNotNull() & (F.length("text") <= most_chars)).select("doc_id", "text", *also)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", *also, "label", F.xxhash64("doc_id").alias("at")).collect()
    return sorted(rows, key=lambda r: (r["at"], r["doc_id"], r["text"]))
