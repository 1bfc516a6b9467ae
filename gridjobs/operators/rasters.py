"""Statistics of a raster's pixels within polygons.

A raster is a table of blocks: ``bx``, ``by`` (column and row of the block, from the north-west), ``v`` (its values, row by row,
null where there is none) and any other columns, such as a date. A ring becomes one span of columns for each row of pixels and
pair of crossings; spans meet the blocks that they lie in by an equi-join, and only the values within are taken out. All
statistics come from counts of values, which can be added up in parts.

A pixel belongs to a ring if its centre does, by the rule of geo.in_ring(). Rings outside the raster and rings without area
have no pixels; rows without ring have none. A zone without pixels does not appear.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans


#: Values of blocks that one task takes, about.
TASK_VALUES = 1 << 20


def dealt(blocks: DataFrame, values: int, *keys: str) -> DataFrame:
    """``blocks`` of so many values each, dealt by ``keys`` over as many tasks as the values ask for. Where blocks are read, one
    small file may hold millions, and groups within blocks are nearly as many as values; dealt before the values are taken out,
    groups by the keys and more stay in their task without another shuffle, and a task's memory is that of TASK_VALUES."""
    return blocks.repartition(max(1, math.ceil(blocks.count() * values / TASK_VALUES)), *keys)


@dataclass(frozen=True)
class Grid:
    """Corner and size of pixels in degrees, and how many columns and rows a block has."""

    west: float
    north: float
    dx: float
    dy: float
    width: int
    height: int


def zone_spans(zones: DataFrame, key: str, grid: Grid, ring: str = "ring") -> DataFrame:
    """key, row, first, last: the columns, ends included, of each run of pixels of a row whose centres are in the ring."""
    top, bottom = F.expr(f"array_max(transform({ring}, p -> p.y))"), F.expr(f"array_min(transform({ring}, p -> p.y))")
    r0, r1 = F.ceil((grid.north - top) / grid.dy - 0.5).cast("long"), F.floor((grid.north - bottom) / grid.dy - 0.5).cast("long")
    rows = zones.select(key, F.col(ring).alias("ring"), F.greatest(r0, F.lit(0).cast("long")).alias("r0"), r1.alias("r1")).where("r0 <= r1")
    rows = rows.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("lat", grid.north - (F.col("row") + 0.5) * grid.dy)
    q = "ring[(i + 1) % size(ring)]"
    # as in in_ring(): an edge is crossed to the east of all places that are less than x
    cross = f"array_sort(transform(filter(sequence(0, size(ring) - 1), i -> (ring[i].y > lat) != ({q}.y > lat)), i -> ({q}.x - ring[i].x) * (lat - ring[i].y) / ({q}.y - ring[i].y) + ring[i].x))"
    pairs = F.expr("transform(sequence(0, size(x) div 2 - 1), i -> struct(x[2 * i] as a, x[2 * i + 1] as b))")
    cut = rows.withColumn("x", F.expr(cross)).where("size(x) > 1").select(key, "row", F.explode(pairs).alias("s"))
    column = lambda x: F.ceil((x - grid.west) / grid.dx - 0.5).cast("long")
    return cut.select(key, "row", F.greatest(column(F.col("s.a")), F.lit(0).cast("long")).alias("first"), (column(F.col("s.b")) - 1).alias("last")).where("first <= last")


def zone_counts(zones: DataFrame, key: str, blocks: DataFrame, grid: Grid, by: tuple[str, ...] = (), ring: str = "ring") -> DataFrame:
    """key, the columns ``by`` of the blocks, value and n: how often each value, null too, stands in each zone."""
    spans = zone_spans(zones, key, grid, ring).repartition(key, "row")  # rows of a large ring do not stay in its task
    w, h = grid.width, grid.height
    parts = spans.withColumn("bx", F.explode(F.sequence(F.floor(F.col("first") / w), F.floor(F.col("last") / w)))).withColumn("by", F.floor(F.col("row") / h))
    a, b = F.greatest(F.col("first") - F.col("bx") * w, F.lit(0)), F.least(F.col("last") - F.col("bx") * w, F.lit(w - 1))
    parts = parts.select(key, "bx", "by", ((F.col("row") - F.col("by") * h) * w + a + 1).cast("int").alias("at"), (b - a + 1).cast("int").alias("len"))
    met = parts.join(blocks.select("bx", "by", "v", *by), ["bx", "by"])
    return met.select(key, *by, F.explode(F.slice("v", F.col("at"), F.col("len"))).alias("value")).groupBy(key, *by, "value").agg(F.count(F.lit(1)).alias("n"))


def statistics(counts: DataFrame, keys: list[str], kept: Column | None = None) -> DataFrame:
    """keys, stats_sum, stats_count, stats_size (nulls too), stats_min, stats_max, stats_mean, stats_std and stats_median of values
    with their counts; of values for which ``kept`` is true, where it is given."""
    counts = counts if kept is None else counts.where(kept)
    n, v = F.when(F.col("value").isNotNull(), F.col("n")), F.col("value").cast("double")
    plain = counts.groupBy(*keys).agg(F.sum(F.col("value") * F.col("n")).alias("stats_sum"), F.coalesce(F.sum(n), F.lit(0)).alias("stats_count"), F.sum("n").alias("stats_size"), F.min("value").alias("stats_min"), F.max("value").alias("stats_max"), (F.sum(v * F.col("n")) / F.sum(n)).alias("stats_mean"))
    # spread about the mean, not a difference of large sums
    away = counts.join(plain.select(*keys, "stats_mean"), keys).groupBy(*keys).agg(F.sqrt(F.sum(F.pow(v - F.col("stats_mean"), F.lit(2.0)) * F.col("n")) / F.sum(n)).alias("stats_std"))
    each = scans.running_sum(counts.where("value is not null"), keys, ["value"], "n", "upto").join(plain.select(*keys, "stats_count"), keys)
    at = lambda k: F.max(F.when((F.col("upto") - F.col("n") <= k) & (k < F.col("upto")), v))
    low, high = F.floor((F.col("stats_count") - 1) / 2), F.ceil((F.col("stats_count") - 1) / 2)
    middle = each.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("stats_median"))
    return plain.join(away, keys).join(middle, keys, "left")


def coarsen(blocks: DataFrame, grid: Grid, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """bx, by, x, y (of n by n pixels, within the block), top, mean and count of their values; n divides the block's sides."""
    held = dealt(blocks.select("bx", "by", *by, "v"), grid.width * grid.height, "bx", "by", *by)
    each = held.select("bx", "by", *by, F.posexplode("v").alias("i", "value")).where("value is not null")
    x, y = F.floor((F.col("i") % grid.width) / n).cast("int"), F.floor(F.floor(F.col("i") / grid.width) / n).cast("int")
    return each.groupBy("bx", "by", *by, x.alias("x"), y.alias("y")).agg(F.max("value").alias("top"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("count"))
