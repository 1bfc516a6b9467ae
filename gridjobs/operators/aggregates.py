"""Aggregations over cells, classes, pixels and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


RANGES = 64  # of a column's distinct values, within which ranks are counted


def roll_up(df: DataFrame, cell: Column, metrics: list[str]) -> DataFrame:
    """Coarser cells; the suffix of a metric names how it is combined (_sum, _avg, _min, _max, _cnt)."""
    how = {"sum": F.sum, "cnt": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    return df.groupBy(cell.alias("cell")).agg(*(how[m.rsplit("_", 1)[1]](m).alias(m) for m in metrics))


def share(df: DataFrame, group: str, part: str, value: str) -> DataFrame:
    """Percentage of each part in its group's total."""
    sums = df.groupBy(group, part).agg(F.sum(value).alias("total"))
    return sums.withColumn("pct", 100.0 * F.col("total") / F.sum("total").over(Window.partitionBy(group)))


def mode(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value of each group with its count; of ties, the smaller value."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col(value))).alias("m")).select(group, F.col(f"m.{value}").alias(value), F.col("m.n").alias("n"))


def top_class(df: DataFrame, group: str, part: str, value: str) -> DataFrame:
    """The class with the largest total of each group; of ties, the smaller class."""
    sums = df.groupBy(group, part).agg(F.sum(value).alias("total"))
    return sums.groupBy(group).agg(F.max_by(F.struct(part, "total"), F.struct(F.col("total"), -F.col(part))).alias("m")).select(group, F.col(f"m.{part}").alias(part), F.col("m.total").alias("total"))


def smooth(df: DataFrame, z: int, k: int, value: str) -> DataFrame:
    """Mean over the disk around each cell, cells that only have neighbours included: one scatter, one aggregation."""
    return df.withColumn("cell", F.explode(geo.cell_disk("cell", z, k))).groupBy("cell").agg(F.avg(value).alias("smoothed"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts of equal bins over [min, max], the last one closed, empty ones included."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    met = df.select(value).crossJoin(F.broadcast(ends))  # one row of ends
    width = (F.col("hi") - F.col("lo")) / bins
    binned = met.groupBy(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(binned, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def correlations(df: DataFrame, columns: list[str], ranks: bool = False) -> DataFrame:
    """All pairs in one aggregation; of average ranks for Spearman."""
    if ranks:
        for c in columns:
            counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where(F.col(c).isNotNull())
            cuts = sorted(set(counts.agg(F.percentile_approx(c, [i / RANGES for i in range(1, RANGES)]).alias("c")).first()["c"] or []))
            part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(c))) if cuts else F.lit(0)
            placed = counts.select(c, "n", part.alias(f"{c} part"))
            earlier = Window.orderBy(f"{c} part").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows at most
            sizes = placed.groupBy(f"{c} part").agg(F.sum("n").alias("n")).select(f"{c} part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
            below = Window.partitionBy(f"{c} part").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
            ranked = placed.join(F.broadcast(sizes), f"{c} part").select(c, (F.col("before") + F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2.0).alias(f"{c} rank"))
            df = df.join(ranked, c, "left").drop(c).withColumnRenamed(f"{c} rank", c)
    pairs = [(a, b) for a in columns for b in columns]
    wide = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])
    return wide.select(F.explode(rows).alias("p")).select("p.x", "p.y", "p.r")


def zonal(pixels: DataFrame, zone: str, value: str) -> DataFrame:
    """Mean from sum and count, so parts can be merged."""
    stats = pixels.groupBy(zone).agg(F.sum(value).alias("stats_sum"), F.count(value).alias("stats_count"), F.count(F.lit(1)).alias("stats_size"), F.min(value).alias("stats_min"), F.max(value).alias("stats_max"))
    return stats.withColumn("stats_mean", F.col("stats_sum") / F.col("stats_count"))


def composite(pixels: DataFrame, value: str) -> DataFrame:
    """Median (place count div 2 of the sorted values) and greatest value of each x, y, from counts of distinct values."""
    at = Window.partitionBy("x", "y")
    counts = pixels.groupBy("x", "y", value).agg(F.count(F.lit(1)).alias("n"))
    run = counts.select("x", "y", value, F.sum("n").over(at.orderBy(value)).alias("upto"), F.sum("n").over(at).alias("all"))
    return run.groupBy("x", "y").agg(F.min(F.when(F.expr("upto > `all` div 2"), F.col(value))).alias("median"), F.max(value).alias("greenest"))


def best_pixel(pixels: DataFrame, index: str, bands: list[str], tie: str) -> DataFrame:
    """All bands of the pixel with the greatest index at each x, y; of equals, the one with the smallest ``tie``. Nulls come last.
    First by index, then over these: single columns are aggregated by hash, while one struct of them has all pixels sorted."""
    first = lambda c: F.when(F.min(tie).isNull(), F.first(c)).otherwise(F.min_by(c, tie)).alias(c)
    each = pixels.groupBy("x", "y", index).agg(*map(first, bands), F.min(tie).alias(tie))
    best = lambda c: F.when(F.max(index).isNull(), F.first(c)).otherwise(F.max_by(c, index)).alias(c)
    return each.groupBy("x", "y").agg(F.max(index).alias(index), *map(best, [*bands, tie]))


def compact(tiles: DataFrame, z: int) -> DataFrame:
    """Four sibling tiles become their parent, level by level."""
    out, level = None, tiles.select("cell").distinct()
    for at in range(z, 0, -1):
        up = level.withColumn("parent", geo.cell_parent("cell", at, at - 1))
        full = up.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n = 4").select("parent")
        rest = up.join(full, "parent", "left_anti").select("cell")
        out = rest if out is None else out.unionByName(rest)
        level = full.withColumnRenamed("parent", "cell")
    return out.unionByName(level)


def least_squares(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
