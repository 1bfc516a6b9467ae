"""Queries on rasters: statistics of pixels within polygons, composites over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rasters, scans
from .base import BOXES, query

#: Blocks of eight by eight pixels of half a degree, 90 in a row; a block's number tells its place, further ones are later layers.
GRID = rasters.Grid(west=-180.01, north=80.02, dx=0.5, dy=0.5, width=8, height=8)
_PLACE = "((p_partkey * 1013) % 3600)"
# one pixel of eleven is nodata
VALUES = f"(select p_partkey, p_partkey // 3600 as layer, {_PLACE} % 90 as bx, {_PLACE} // 90 as \"by\", i, nullif((p_partkey * i + i) % 11, 0) as value, -180.01e0 + ({_PLACE} % 90 * 8 + i % 8 + 0.5e0) * 0.5e0 as lng, 80.02e0 - ({_PLACE} // 90 * 8 + i // 8 + 0.5e0) * 0.5e0 as lat from part, range(64) r(i))"
WITHIN = f"(select n_nationkey, layer, value from {VALUES} v join {BOXES} b on lat > miny and lat < maxy and lng > minx + 2.5e0*abs(lat - miny - 4)/4 and lng < maxx - 2.5e0*abs(lat - miny - 4)/4)"


def blocks(t):
    place = F.expr("(p_partkey * 1013) % 3600")
    v = F.expr("transform(sequence(0, 63), i -> nullif((p_partkey * i + i) % 11, 0))")
    return t.part.select("p_partkey", F.expr("p_partkey div 3600").alias("layer"), (place % 90).alias("bx"), F.expr("(p_partkey * 1013) % 3600 div 90").alias("by"), v.alias("v"))


def counts(t, *by):
    return rasters.zone_counts(t.boxes.select("n_nationkey", "ring"), "n_nationkey", blocks(t), GRID, by)


@query("A23_zone_statistics", f"select n_nationkey, sum(value)::bigint as stats_sum, count(value) as stats_count, count(*) as stats_size, min(value) as stats_min, max(value) as stats_max, round(avg(value), 6) as stats_mean, round(stddev_pop(value), 6) as stats_std, median(value)::double as stats_median from {WITHIN} group by 1")
def a23(t):
    """Numbers of the pixels within each nation's ring, over all layers."""
    return rasters.statistics(counts(t), ["n_nationkey"]).withColumn("stats_mean", F.round("stats_mean", 6)).withColumn("stats_std", F.round("stats_std", 6))


@query("A23_zone_layers", f"select n_nationkey, layer, sum(value)::bigint as stats_sum, count(*) as stats_size from {WITHIN} group by 1, 2")
def a23layers(t):
    """The same by layer."""
    return rasters.statistics(counts(t, "layer"), ["n_nationkey", "layer"]).select("n_nationkey", "layer", "stats_sum", "stats_size")


@query("A24_zone_classes", f"select n_nationkey, string_agg(value || ':' || n, ',' order by value) as classes from (select n_nationkey, value, count(*) as n from {WITHIN} where value is not null group by 1, 2) group by 1")
def a24(t):
    """How often each class stands within each ring."""
    each = counts(t).where("value is not null").groupBy("n_nationkey").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("c"))  # as many as there are classes
    return each.select("n_nationkey", F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["value"].cast("string"), x["n"].cast("string"))), ",").alias("classes"))


@query("A33_zone_of_class", f"select n_nationkey, coalesce(sum(value), 0)::bigint as every, coalesce(sum(value) filter (value > 5), 0)::bigint as masked, round(coalesce(sum(value) filter (value > 5), 0)/sum(value), 6) as ratio from {WITHIN} group by 1")
def a33(t):
    """Sum of all pixels of a ring, of those of some classes, and their ratio."""
    n = F.col("value") * F.col("n")
    sums = counts(t).groupBy("n_nationkey").agg(F.coalesce(F.sum(n), F.lit(0)).alias("every"), F.coalesce(F.sum(F.when(F.col("value") > 5, n)), F.lit(0)).alias("masked"), F.sum(n).alias("all"))
    return sums.select("n_nationkey", "every", "masked", F.round(F.col("masked") / F.col("all"), 6).alias("ratio"))


@query("A26_coarsen_mean", f"select bx, \"by\", layer, (i % 8 // 2)::int as x, (i // 8 // 2)::int as y, max(value) as top, round(avg(value), 6) as mean, count(value) as count from {VALUES} where value is not null group by 1, 2, 3, 4, 5")
def a26(t):
    """Two by two pixels as one: greatest value and mean."""
    return rasters.coarsen(blocks(t), GRID, 2, ("layer",)).withColumn("mean", F.round("mean", 6))


@query("A25_percentile", f"select x, y, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50 from (select i % 8 as x, i // 8 as y, value from {VALUES} where value is not null) group by 1, 2")
def a25(t):
    """Quarter and half of each pixel's values over all blocks."""
    each = blocks(t).select(F.posexplode("v").alias("i", "value")).select(F.expr("bigint(i % 8)").alias("x"), F.expr("i div 8").alias("y"), "value")
    q = scans.quantiles(each, ["x", "y"], "value", [0.25, 0.5])
    return q.select("x", "y", F.round(F.col("quantiles")[0], 6).alias("p25"), F.round(F.col("quantiles")[1], 6).alias("p50"))


# bands of a pixel: red and near infrared, which an index is made of
_BANDS = f"(select layer, i, value as red, (p_partkey + 3*i) % 17 + 1 as nir, ((p_partkey + 3*i) % 17 + 1 - value)/((p_partkey + 3*i) % 17 + 1 + value)::double as ndvi, p_partkey from {VALUES} where value is not null)"


@query("A25_median_pixel", f"select i::int as i, red, nir, round(ndvi, 9) as ndvi, p_partkey from (select *, row_number() over (partition by i order by ndvi, p_partkey) as place, count(*) over (partition by i) as n from {_BANDS}) where place = (n - 1)//2 + 1")
def a25pixel(t):
    """All bands of the pixel whose vegetation index is the lower median, at each place of a block."""
    each = blocks(t).select("p_partkey", F.posexplode("v").alias("i", "red")).where("red is not null").withColumn("nir", F.expr("(p_partkey + 3*i) % 17 + 1"))
    each = each.withColumn("ndvi", F.expr("(nir - red) / double(nir + red)")).withColumn("one", F.lit(1))
    placed = scans.running_sum(each, ["i"], ["ndvi", "p_partkey"], "one", "place")
    sizes = each.groupBy("i").agg(F.count(F.lit(1)).alias("n"))  # a row for each place of a block
    return placed.join(F.broadcast(sizes), "i").where("place = (n - 1) div 2 + 1").select("i", "red", "nir", F.round("ndvi", 9).alias("ndvi"), "p_partkey")
