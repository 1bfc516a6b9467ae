"""Shared helpers: reading tables, shared-storage intermediates, guarded broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side of at most so many bytes, by its rows and the width that the caller states, may be broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. There is no other place for intermediates."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
    return found


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to shared storage and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int | None = None, width: int = 64) -> DataFrame:
    """``df`` with a broadcast hint if its rows, of ``width`` bytes each at most, make BROADCAST_BYTES at most; else as it
    is, for a shuffled join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of documents that no model learns from: crc32(doc_id as text) mod 3 = 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
