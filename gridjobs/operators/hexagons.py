"""Tables of hexagon cells: covers of polygons and bounds, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, hexagons, hexgrid


def descend(boxes: DataFrame, res: int) -> DataFrame:
    """A row (cell, lng, lat of its centre) for each cell of resolution ``res`` whose centre is in a box (minx, miny, maxx,
    maxy; west edge over east edge: over the antimeridian), beside the box's columns.

    Begins with the 122 base cells and goes down one resolution at a time: cells that are too far from the box for any
    descendant's centre to be in it are left out before their children are made, so a row never makes more than seven.
    """
    bases = boxes.sparkSession.range(122).select(geo.h3_from_digits("id", []).alias("cell"))
    level = boxes.crossJoin(F.broadcast(bases))  # 122 rows
    level = _near(level, hexgrid.REACH if res else 0.0)
    for r in range(1, res + 1):
        level = level.withColumn("cell", F.explode(hexagons.children("cell", r)))
        level = _near(level, hexgrid.REACH / 7 ** (r / 2) if r < res else 0.0)
    return level


def _near(cells: DataFrame, reach: float) -> DataFrame:
    """Rows whose cell's centre is at most ``reach`` degrees from their box."""
    placed = cells.drop("lng", "lat").withColumn("at", hexagons.centre("cell")).select("*", F.col("at.lng").alias("lng"), F.col("at.lat").alias("lat")).drop("at")
    near = F.col("lat").between(F.col("miny") - reach, F.col("maxy") + reach)
    if reach == 0:
        inside = F.when(F.col("minx") <= F.col("maxx"), F.col("lng").between(F.col("minx"), F.col("maxx"))).otherwise((F.col("lng") >= F.col("minx")) | (F.col("lng") <= F.col("maxx")))
        return placed.where(near & inside)
    # a cap of this radius spans so many degrees of longitude; one that holds a pole all of them
    high = F.least(F.abs("lat") + reach, F.lit(90.0))
    wide = F.when(high >= 89.9, 360.0).otherwise(F.degrees(F.asin(F.least(F.sin(F.radians(F.lit(reach))) / F.cos(F.radians("lat")), F.lit(1.0)))) + 1e-9)
    middle = F.when(F.col("minx") <= F.col("maxx"), (F.col("minx") + F.col("maxx")) / 2).otherwise((F.col("minx") + F.col("maxx") + 360) / 2)
    half = F.when(F.col("minx") <= F.col("maxx"), (F.col("maxx") - F.col("minx")) / 2).otherwise((F.col("maxx") + 360 - F.col("minx")) / 2)
    away = F.abs(F.pmod(F.col("lng") - middle + 180, F.lit(360.0)) - 180)
    return placed.where(near & (away <= half + wide))


def cover(rings: DataFrame, key: str, res: int) -> DataFrame:
    """key, cell, cell_count and ``fallback``: the cells of resolution ``res`` whose centre is in each ring (ring, and its
    box minx, miny, maxx, maxy); a ring with none gets the cell that holds its centroid."""
    inside = descend(rings, res).where(geo.in_ring("lng", "lat", "ring")).select(key, "cell")
    sizes = inside.groupBy(key).agg(F.count(F.lit(1)).alias("cell_count"))
    found = inside.join(sizes, key).withColumn("fallback", F.lit(False))
    x, y = geo.ring_centroid("ring")
    bare = rings.join(sizes, key, "left_anti").select(key, hexagons.cell(x, y, res).alias("cell"), F.lit(1).cast("long").alias("cell_count"), F.lit(True).alias("fallback"))
    return found.unionByName(bare)


def bounds_cells(boxes: DataFrame, key: str, res: int) -> DataFrame:
    """key, cell, lng and lat: the cells whose centre is in each box, else the one cell that holds the box's middle, which then
    stands for the centre."""
    found = descend(boxes, res).select(key, "cell", "lng", "lat")
    x, y = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    bare = boxes.join(found.select(key).distinct(), key, "left_anti")
    return found.unionByName(bare.select(key, hexagons.cell(x, y, res).alias("cell"), x.alias("lng"), y.alias("lat")))


def smooth(cells: DataFrame, k: int, value: str) -> DataFrame:
    """cell, smoothed: mean over the disk around each cell, cells that only have neighbours included."""
    each = cells.select(F.explode(hexagons.disk("cell", k)).alias("near"), value)
    return each.groupBy(F.col("near.cell").alias("cell")).agg(F.avg(value).alias("smoothed"))


def neighbourhood_join(left: DataFrame, right: DataFrame, k: int = 1) -> DataFrame:
    """Rows of ``right`` (cell, ...) in the disk of each row's cell of ``left`` (center, ...)."""
    return left.withColumn("near", F.explode(hexagons.disk("center", k))).withColumn("cell", F.col("near.cell")).drop("near").join(right, "cell")

