"""Readers and writers: delimited text, JSON, features, geo-partitioned datasets, pyramids."""

from __future__ import annotations

import math
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo


def workspace(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
    return f"{base}/{label}-{uuid.uuid4().hex}"


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", encoding: str = "UTF-8", comma_columns: tuple[str, ...] = ()) -> DataFrame:
    """Delimited text under an explicit schema; columns with a decimal comma become doubles."""
    df = spark.read.csv(path, schema=schema, header=True, sep=sep, encoding=encoding)
    return df.withColumns({c: F.regexp_replace(c, ",", ".").try_cast("double") for c in comma_columns})


def read_database(spark: SparkSession, url: str, table: str, limit: int, **options: str) -> DataFrame:
    """At most ``limit`` rows of a database table; the limit is part of the database's own query."""
    return spark.read.format("jdbc").options(url=url, query=f"SELECT * FROM {table} FETCH FIRST {int(limit)} ROWS ONLY", **options).load()


def read_features(spark: SparkSession, path: str, properties: str, a_line: bool = False) -> DataFrame:
    """Features of collections, one row each: properties flattened, coordinates of points as lng and lat. A file is one
    collection, or has one on each line."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: array<double>>>>"
    f = spark.read.schema(schema).json(path, multiLine=not a_line).select(F.explode("features").alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("lng"), F.col("f.geometry.coordinates")[1].alias("lat"))


def feature_lines(df: DataFrame, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """One feature a row as text."""
    rest = [c for c in df.columns if c not in (lng, lat)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), geometry.alias("geometry"))).alias("value"))


def file_zoom(rows: int, rows_per_file: int) -> int:
    """The zoom of the tiles that make files: 2, and one more for each four times as many rows as its tiles hold."""
    return min(10, max(2, math.ceil(math.log(max(rows, 1) / rows_per_file, 4))))


def write_geo(points: DataFrame, path: str, z: int | None = None, chunk_z: int | None = None, rows_per_file: int = 1_000_000) -> DataFrame:
    """Writes points (lng, lat, ...) by coarse tile, sorted by fine tile, and a table of chunk bounds beside them. Without a
    zoom, the rows decide how fine the files' tiles are; a crowded tile makes several files."""
    z = file_zoom(points.count(), rows_per_file) if z is None else z
    chunk_z = z + 4 if chunk_z is None else chunk_z
    placed = points.withColumn("file_cell", geo.tile_cell("lng", "lat", z)).withColumn("chunk", geo.tile_cell("lng", "lat", chunk_z))
    placed.repartitionByRange("file_cell", "chunk").sortWithinPartitions("file_cell", "chunk").write.partitionBy("file_cell").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/data")
    bounds = placed.groupBy("file_cell", "chunk").agg(F.min("lng").alias("minx"), F.min("lat").alias("miny"), F.max("lng").alias("maxx"), F.max("lat").alias("maxy"), F.count(F.lit(1)).alias("num_rows"))
    bounds.write.parquet(f"{path}/_bounds")
    return bounds


def read_geo(spark: SparkSession, path: str, bounds: tuple[float, float, float, float], columns: list[str] | None = None) -> DataFrame:
    """Rows within bounds; only partitions whose chunks meet them are read."""
    df = spark.read.parquet(f"{path}/data").where(F.col("file_cell").isin(parts_met(spark, path, bounds)) & geo.in_bounds(bounds))
    return df.select(*(columns or df.columns))


def write_shapes(rings: DataFrame, path: str, z: int = 2, rows_per_file: int = 1_000_000) -> None:
    """Writes rings (ring, ...) by the coarse tile of their centre, and for each tile the bounds of all its rings."""
    x, y = geo.ring_centroid("ring")
    placed = rings.where("size(ring) > 0").withColumns({"lng": x, "lat": y} | geo.ring_bounds("ring"))
    placed = placed.withColumn("file_cell", geo.tile_cell("lng", "lat", z))
    placed.repartitionByRange("file_cell", "lat", "lng").sortWithinPartitions("file_cell", "lat").write.partitionBy("file_cell").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/data")
    placed.groupBy("file_cell").agg(*(how(c).alias(c) for how, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy")))).write.parquet(f"{path}/_bounds")


def read_shapes(spark: SparkSession, path: str, bounds: tuple[float, float, float, float], centroid: bool = False, clip: bool = False) -> DataFrame:
    """Rings whose box meets the bounds, from the parts that can hold such; with ``centroid`` their centres lng and lat in place
    of the ring, with ``clip`` the part of each ring within the bounds, without those that have none."""
    x0, y0, x1, y1 = bounds
    met = spark.read.parquet(f"{path}/data").where(F.col("file_cell").isin(parts_met(spark, path, bounds))).where(f"minx <= {x1} and maxx >= {x0} and miny <= {y1} and maxy >= {y0}")
    held = met.drop("minx", "miny", "maxx", "maxy", "file_cell")
    if centroid:
        return held.drop("ring")
    held = held.drop("lng", "lat")
    return held.withColumn("ring", geo.clip_ring("ring", bounds)).where("size(ring) > 2") if clip else held


def write_cells(cells: DataFrame, path: str, z: int) -> DataFrame:
    """write_geo() for cells of zoom z (cell, ...), placed by their centres."""
    lng, lat = geo.cell_center("cell", z)
    return write_geo(cells.withColumn("lng", lng).withColumn("lat", lat), path)


def read_cells(spark: SparkSession, path: str, bounds: tuple[float, float, float, float], clip: bool = True) -> DataFrame:
    """Cells whose centre is within bounds, or without ``clip`` all of the parts that can hold such cells."""
    return read_geo(spark, path, bounds) if clip else spark.read.parquet(f"{path}/data").where(F.col("file_cell").isin(parts_met(spark, path, bounds)))


def parts_met(spark: SparkSession, path: str, bounds: tuple[float, float, float, float]) -> list[int]:
    """Coarse tiles, which are few, with chunks that meet the bounds."""
    x0, y0, x1, y1 = bounds
    met = spark.read.parquet(f"{path}/_bounds").where(f"minx <= {x1} and maxx >= {x0} and miny <= {y1} and maxy >= {y0}")
    return [r["file_cell"] for r in met.select("file_cell").distinct().collect()]


def write_pyramid(cells: DataFrame, path: str, z: int, coarsest: int, value: str) -> None:
    """Sums of finer cells by level, each from the level below it as it was written."""
    cells.select("cell", value).write.parquet(f"{path}/res={z}")
    for at in range(z - 1, coarsest - 1, -1):
        level = cells.sparkSession.read.parquet(f"{path}/res={at + 1}")
        level.groupBy(geo.cell_parent("cell", at + 1, at).alias("cell")).agg(F.sum(value).alias(value)).write.parquet(f"{path}/res={at}")


def read_pyramid(spark: SparkSession, path: str, z: int, value: str) -> DataFrame:
    """cell and value of zoom z: as stored, else summed from the coarsest stored level that is finer."""
    every = spark.read.parquet(path)
    stored = sorted(r["res"] for r in every.select("res").distinct().collect())  # a level each
    finer = next(r for r in stored if r >= z)
    level = every.where(F.col("res") == finer)
    return level.select("cell", value) if finer == z else level.groupBy(geo.cell_parent("cell", finer, z).alias("cell")).agg(F.sum(value).alias(value))


def whole_texts(docs: DataFrame, path: str, records: int = 500) -> DataFrame:
    """source and value of files of at most ``records`` texts of ``docs``, each read whole; tasks write their own files,
    so no source has to fit in one task or value."""
    docs.select(F.coalesce("text", F.lit("")).alias("value"), "source").write.option("maxRecordsPerFile", records).partitionBy("source").text(path, lineSep="\x01")
    return docs.sparkSession.read.schema("value string, source string").text(path, wholetext=True)


def content_hash(df: DataFrame) -> DataFrame:
    """A row count and an order-free hash of all rows, in which equal rows count each time."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a writer has finished at ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_once(df: DataFrame, base: str, *order: str) -> tuple[str, bool]:
    """The folder under ``base`` that holds ``df``, named by its content's hash and its columns, sorted within files; and
    whether it was written now. Content that is there already is left as it is."""
    found = content_hash(df).first()
    kind = format(hash_text(df.schema.simpleString()), "x")
    path = f"{base}/{found['rows']}-{found['hash']}-{kind}"
    if exists(df.sparkSession, path):
        return path, False
    df.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 1 << 20).parquet(path)
    return path, True


def hash_text(text: str) -> int:
    return zlib.crc32(text.encode())


def new_files(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Files of a listing that a snapshot has not, hidden ones left out."""
    return listing.where(~F.element_at(F.split("path", "/"), -1).startswith(".")).join(snapshot, "path", "left_anti")
