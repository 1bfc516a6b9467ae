"""Incremental jobs: new files, minute and hour counts under a watermark, latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.files import exists


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """New Parquet files under ``path``, a few a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def counts(events: DataFrame, window: str, late: str, *keys: str) -> DataFrame:
    """Tumbling counts by key; rows later than the watermark are dropped."""
    at = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(at, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def cell_counts(events: DataFrame, z: int, late: str = "2 hours") -> DataFrame:
    """Hourly counts per cell of events with lng and lat."""
    return counts(events.withColumn("cell", geo.tile_cell("lng", "lat", z)), "1 hour", late, "cell")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that is there now, appended to a Parquet table, which is then read."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


def run_latest(stream: DataFrame, key: str, at: str, path: str, checkpoint: str, buckets: int = 256) -> DataFrame:
    """The latest row of each key, of a table in buckets of keys of which a batch rewrites those that it touches.

    Batch n reads the list n - 1, which says in which version each bucket stands, merges its rows with those buckets, writes
    them as version n, and then list n. So a batch that is run again gives the same table, what it writes grows with the
    buckets that it touches, and a list is valid as soon as it is finished. What is returned is the table of the newest list
    on storage, whichever run wrote it; a source without rows gives an empty table. Buckets that the last two lists do not
    name are deleted. Of rows of the same time, the greatest other columns in their order count.
    """
    spark = stream.sparkSession
    of = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("bucket", of)
        old = _listed(session, path, n - 1)
        touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # ``buckets`` at most
        held = _buckets(session, path, stream, {b: v for b, v in old.items() if b in touched})
        both = rows if held is None else rows.unionByName(held.withColumn("bucket", of))
        others = [c for c in stream.columns if c not in (key, at)]
        best = both.groupBy("bucket", key).agg(F.max_by(F.struct(*stream.columns), F.struct(at, *others)).alias("r")).select("r.*", "bucket")
        if touched:
            best.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{n}")
        new = old | dict.fromkeys(touched, n)
        session.createDataFrame(sorted(new.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/list{n}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    done = versions(spark, path)
    if not done:
        return spark.createDataFrame([], stream.schema)
    last = _listed(spark, path, done[-1])
    _forget(spark, path, [_listed(spark, path, n) for n in done[-2:]], done[:-2])
    return _buckets(spark, path, stream, last) if last else spark.createDataFrame([], stream.schema)


def _listed(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    """The version of each bucket in list n, or in the newest one before it."""
    older = [k for k in versions(spark, path) if k <= n]
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/list{older[-1]}").collect()} if older else {}


def _buckets(spark: SparkSession, path: str, like: DataFrame, of: dict[int, int]) -> DataFrame | None:
    """Rows of buckets in their versions."""
    return spark.read.schema(like.schema).parquet(*[f"{path}/v{v}/bucket={b}" for b, v in sorted(of.items())]) if of else None


def _forget(spark: SparkSession, path: str, lists: list[dict[int, int]], old: list[int]) -> None:
    """Deletes the buckets that none of the lists names, and the lists of old versions."""
    named = {f"v{v}/bucket={b}" for x in lists for b, v in x.items()}
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for version in [s.getPath() for s in fs.listStatus(p) if s.getPath().getName()[:1] == "v"]:
        for s in fs.listStatus(version):
            name = s.getPath().getName()
            if name.startswith("bucket=") and f"{version.getName()}/{name}" not in named:
                fs.delete(s.getPath(), True)
    for n in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/list{n}"), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished lists under ``path``, ascending."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(x[4:]) for x in names if x[:4] == "list" and x[4:].isdigit() and exists(spark, f"{path}/{x}"))


def minute_counts(events: DataFrame, late: str, *keys: str) -> DataFrame:
    """Counts by minute and key, each given out once when the watermark has passed its minute; later rows are dropped."""
    return counts(events, "1 minute", late, *keys)
