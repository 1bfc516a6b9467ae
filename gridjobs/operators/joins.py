"""Joins on places: neighbourhood, box, ring, distance, nearest, longest prefix."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, shapes
from ..sources.files import workspace

#: Metres of a degree of latitude.
DEGREE_M = geo.EARTH_M * math.pi / 180


def neighbourhood_join(left: DataFrame, right: DataFrame, z: int, k: int = 1) -> DataFrame:
    """Rows of ``right`` (cell, ...) in the disk of each row's cell of ``left`` (center, ...)."""
    return left.withColumn("cell", F.explode(geo.cell_disk("center", z, k))).join(right, "cell")


def with_box_cells(boxes: DataFrame, z: int) -> DataFrame:
    """A row for each tile of zoom z that a box (minx, miny, maxx, maxy) meets."""
    x = F.explode(F.sequence(geo.tile_x("minx", z), geo.tile_x("maxx", z)))
    y = F.explode(F.sequence(geo.tile_y("maxy", z), geo.tile_y("miny", z)))
    return boxes.withColumn("bx", x).withColumn("by", y).withColumn("cell", geo.cell_of(z, F.col("bx"), F.col("by"))).drop("bx", "by")


def clipped_tiles(boxes: DataFrame, z: int) -> DataFrame:
    """with_box_cells(), and the part of each tile within its box: west, south, east, north."""
    n = float(1 << z)
    x, y = geo.cell_x("cell"), geo.cell_y("cell")
    lat = lambda row: F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * row / n))))
    edges = {"west": F.greatest(x / n * 360.0 - 180.0, F.col("minx")), "east": F.least((x + 1) / n * 360.0 - 180.0, F.col("maxx")), "south": F.greatest(lat(y + 1), F.col("miny")), "north": F.least(lat(y), F.col("maxy"))}
    return with_box_cells(boxes, z).withColumns(edges)


def target_zoom(tiles: int, finest: int) -> Column:
    """For a box (minx, miny, maxx, maxy), the finest zoom, ``finest`` at most, whose tiles that meet it are ``tiles`` at most."""
    met = lambda z: (geo.tile_x("maxx", z) - geo.tile_x("minx", z) + 1) * (geo.tile_y("miny", z) - geo.tile_y("maxy", z) + 1)
    return F.coalesce(*(F.when(met(z) <= tiles, F.lit(z)) for z in range(finest, -1, -1)), F.lit(0))


def cover(rings: DataFrame, key: str, z: int) -> DataFrame:
    """key, cell, cell_count and ``fallback``: the cells whose centre is in each ring (ring, and its box); a ring with
    none gets the cell of its centroid."""
    lng, lat = geo.cell_center("cell", z)
    inside = with_box_cells(rings, z).withColumn("lng", lng).withColumn("lat", lat).where(geo.in_ring("lng", "lat", "ring"))
    sizes = inside.groupBy(key).agg(F.count(F.lit(1)).alias("cell_count"))
    found = inside.select(key, "cell").join(sizes, key).withColumn("fallback", F.lit(False))
    x, y = geo.ring_centroid("ring")
    bare = rings.join(sizes, key, "left_anti").select(key, geo.tile_cell(x, y, z).alias("cell"), F.lit(1).cast("long").alias("cell_count"), F.lit(True).alias("fallback"))
    return found.unionByName(bare)


# boxes by size: cells of level z are squares of 360 / 2 ** z degrees, and a box is stored in those of the finest level whose
# cells are not smaller than it, which are four at most

FINEST = 24


def _level(wide: Column, high: Column) -> Column:
    """The finest level whose cells are as wide and high as a box at least."""
    size = F.greatest(wide, high)
    return F.when(size > 0, F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(360.0 / size)).cast("int")))).otherwise(FINEST)


def _square(level: Column, lng: Column, lat: Column) -> tuple[Column, Column]:
    n = F.pow(F.lit(2.0), level)
    return F.floor((lng + 180.0) / 360.0 * n).cast("long"), F.floor((lat + 90.0) / 360.0 * n).cast("long")


def stored_boxes(boxes: DataFrame) -> DataFrame:
    """``boxes`` (minx, miny, maxx, maxy, ...) with level, cx and cy: a row for each of the at most four cells that a box meets.
    Boxes with a null, or with an edge over the opposite one, hold nothing and are left out."""
    sized = boxes.where("minx <= maxx and miny <= maxy").withColumn("level", _level(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))
    (x0, y0), (x1, y1) = _square(F.col("level"), F.col("minx"), F.col("miny")), _square(F.col("level"), F.col("maxx"), F.col("maxy"))
    return sized.withColumn("cx", F.explode(F.sequence(x0, x1))).withColumn("cy", F.explode(F.sequence(y0, y1)))


def levels_of(boxes: DataFrame) -> list[int]:
    """The levels that occur, FINEST + 1 at most."""
    return sorted(r["level"] for r in stored_boxes(boxes).select("level").distinct().collect())


def box_join(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points (lng, lat) with the boxes that hold them, edges included. A point looks up one cell of each level that occurs among
    the boxes, so boxes of any sizes may be mixed, and a pair meets once."""
    each = F.explode(F.array(*map(F.lit, levels_of(boxes))).cast("array<int>"))
    asked = points.withColumn("level", each)
    x, y = _square(F.col("level"), F.col("lng"), F.col("lat"))
    met = asked.withColumn("cx", x).withColumn("cy", y).join(stored_boxes(boxes), ["level", "cx", "cy"])
    return met.where("lng between minx and maxx and lat between miny and maxy").drop("level", "cx", "cy")


def ring_join(points: DataFrame, rings: DataFrame) -> DataFrame:
    """Points with the rings (ring, and its box) that hold them."""
    return box_join(points, rings).where(geo.in_ring("lng", "lat", "ring"))


def overlap_join(boxes: DataFrame, key: str) -> DataFrame:
    """Pairs of boxes that overlap, smaller key first. Of two boxes, the smaller one comes to the cells of the larger one's level;
    a pair counts in the cell that holds the south-west corner of the overlap."""
    own = stored_boxes(boxes).select(key, "minx", "miny", "maxx", "maxy", "level", "cx", "cy")
    finer = own.withColumn("up", F.explode(F.array(*map(F.lit, levels_of(boxes))).cast("array<int>"))).where("up <= level")
    shift = F.col("level") - F.col("up")
    climbed = finer.select(key, "minx", "miny", "maxx", "maxy", F.col("level").alias("own"), F.col("up").alias("level"), F.call_function("shiftright", F.col("cx"), shift).alias("cx"), F.call_function("shiftright", F.col("cy"), shift).alias("cy")).distinct()
    sides = (key, "minx", "miny", "maxx", "maxy")
    a = own.select("level", "cx", "cy", *(F.col(c).alias(f"{c}_a") for c in sides))
    b = climbed.select("level", "cx", "cy", "own", *(F.col(c).alias(f"{c}_b") for c in sides))
    met = a.join(b, ["level", "cx", "cy"]).where(f"(own > level or {key}_a < {key}_b) and minx_a <= maxx_b and minx_b <= maxx_a and miny_a <= maxy_b and miny_b <= maxy_a")
    x, y = _square(F.col("level"), F.greatest("minx_a", "minx_b"), F.greatest("miny_a", "miny_b"))
    return met.where((F.col("cx") == x) & (F.col("cy") == y)).select(F.least(f"{key}_a", f"{key}_b").alias(f"{key}_a"), F.greatest(f"{key}_a", f"{key}_b").alias(f"{key}_b"))


def range_join(values: DataFrame, ranges: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Rows of ``values`` with the ranges, ends included, that hold ``value``. Ranges may overlap and be of any lengths: each is
    stored in the one or two cells that it meets of the smallest power of two that is not shorter, and a value looks up
    one cell of each length that occurs. Nulls and ranges with the low end over the high one hold nothing."""
    length = F.col(high).cast("double") - F.col(low).cast("double")
    power = F.when(length > 0, F.greatest(F.lit(-60), F.ceil(F.log2(length)).cast("int"))).otherwise(-60)
    # the multiple of the power below a value, as a double: exact for any size, and the value itself where a power is smaller than that can tell
    cell = lambda c, p: F.col(c).cast("double") - F.pmod(F.col(c).cast("double"), F.pow(F.lit(2.0), p))
    held = ranges.where(F.col(low) <= F.col(high)).withColumn("power", power)
    powers = sorted(r["power"] for r in held.select("power").distinct().collect())  # a few hundred at most
    stored = held.withColumn("cell", F.explode(F.array_distinct(F.array(cell(low, F.col("power")), cell(high, F.col("power"))))))
    asked = values.where(F.col(value).isNotNull()).withColumn("power", F.explode(F.array(*map(F.lit, powers)).cast("array<int>"))).withColumn("cell", cell(value, F.col("power")))
    return asked.join(stored, ["power", "cell"]).where(F.col(value).between(F.col(low), F.col(high))).drop("power", "cell")


class Bands:
    """Bands of latitude of a height in metres, cut into slots that are as wide as that at the band's edge nearest a pole."""

    def __init__(self, metres: float):
        self.high = metres / DEGREE_M
        self.bands = math.ceil(180 / self.high)

    def band(self, lat: str | Column) -> Column:
        return F.least(F.floor((geo.col(lat) + 90.0) / self.high), F.lit(self.bands - 1)).cast("long")

    def slots(self, b: Column) -> Column:
        """How many a band has."""
        edge = F.greatest(F.abs(b * self.high - 90.0), F.abs((b + 1) * self.high - 90.0))
        return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / self.high)).cast("long")

    def slot(self, lng: str | Column, n: Column) -> Column:
        return F.least(F.floor((geo.col(lng) + 180.0) / 360.0 * n), n - 1).cast("long")

    def stored(self, df: DataFrame, lng: str, lat: str) -> DataFrame:
        """``df`` with band and slot."""
        return df.withColumn("band", self.band(lat)).withColumn("slot", self.slot(lng, self.slots(F.col("band"))))

    def asked(self, df: DataFrame, lng: str, lat: str) -> DataFrame:
        """``df`` with a row for each band and slot that can hold something within the height, around the globe."""
        around = df.withColumn("band", F.explode(F.sequence(F.greatest(self.band(lat) - 1, F.lit(0)), F.least(self.band(lat) + 1, F.lit(self.bands - 1)))))
        n, at = self.slots(F.col("band")), self.slot(lng, self.slots(F.col("band")))
        # the reach spans one slot to either side, two where the neighbouring band's slots are narrower
        near = F.when(n <= 5, F.sequence(F.lit(0), n - 1)).otherwise(F.transform(F.sequence(at - 2, at + 2), lambda x: F.pmod(x, n)))
        return around.withColumn("slot", F.explode(F.array_distinct(near)))


def _near(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """distance_join() of rows as they are, best for different places."""
    bands = Bands(metres)
    met = bands.asked(left, "lng", "lat").join(bands.stored(right, "r_lng", "r_lat"), ["band", "slot"]).drop("band", "slot")
    return met.withColumn("distance", geo.haversine_m("lng", "lat", "r_lng", "r_lat")).where(F.col("distance") <= metres)


#: Rows of one place that are met as one.
BUNCH = 64


def _bunches(df: DataFrame, lng: str, lat: str, name: str) -> DataFrame:
    """lng, lat and ``name``: the other columns of each place's rows, in lists of at most BUNCH."""
    nth = F.row_number().over(Window.partitionBy(lng, lat).orderBy(lng))
    numbered = df.select(lng, lat, F.struct(*(c for c in df.columns if c not in (lng, lat))).alias("row"), F.floor((nth - 1) / BUNCH).alias("bunch"))
    return numbered.groupBy(lng, lat, "bunch").agg(F.collect_list("row").alias(name)).drop("bunch")


def distance_join(left: DataFrame, right: DataFrame, metres: float, digits: int | None = None) -> DataFrame:
    """Pairs at most ``metres`` apart with ``distance``, rounded to ``digits`` where they are given; left has lng, lat, right has
    r_lng, r_lat. An equi-join on band and slot stands before the exact test. Rows of one place go through both in lists
    of at most BUNCH, so that places are met, not rows; pairs of rows are only made of places that are near."""
    met = _near(_bunches(left, "lng", "lat", "left rows"), _bunches(right, "r_lng", "r_lat", "right rows"), metres)
    met = met if digits is None else met.withColumn("distance", F.round("distance", digits))
    each = met.withColumn("left row", F.explode("left rows")).withColumn("right row", F.explode("right rows"))
    own = lambda df, row, at: [F.col(c) if c in at else F.col(row).getField(c).alias(c) for c in df.columns]
    return each.select(*own(left, "left row", ("lng", "lat")), *own(right, "right row", ("r_lng", "r_lat")), "distance")


#: Different places in a slot from which on the nearest ones are looked for within a quarter of the distance first.
CROWD = 2000


def nearest_join(left: DataFrame, right: DataFrame, key: str, other: str, metres: float, k: int) -> DataFrame:
    """The k nearest within ``metres`` for each left key, ties by the right key.

    Left rows of one place have the same answer, and of right rows of one place the k smallest keys can be in it, so equal
    places are met once. Where many places crowd into a slot, the search begins within a smaller distance, four times smaller
    for each sixteen times as many; a place with k answers there is done, the others go on with four times the distance.
    """
    spot = Window.partitionBy("r_lng", "r_lat").orderBy(other)
    spots = right.withColumn("nth", F.row_number().over(spot)).where(F.col("nth") <= k).drop("nth")
    open_ = left.select("lng", "lat").distinct()
    best = Window.partitionBy("lng", "lat").orderBy("distance", other)
    ranked = lambda places, far: _near(places, spots, far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    slots = Bands(metres).stored(right.select("r_lng", "r_lat").distinct(), "r_lng", "r_lat").groupBy("band", "slot").agg(F.count(F.lit(1)).alias("n"))
    crowd, far, found = slots.agg(F.max("n").alias("n")).first()["n"] or 0, [metres], []
    while crowd > CROWD and far[0] > 1:
        far.insert(0, far[0] / 4)
        crowd /= 16
    spark = left.sparkSession
    for near in far[:-1]:
        path = workspace(spark, "nearest")
        ranked(open_, near).write.parquet(f"{path}/met")
        met = spark.read.parquet(f"{path}/met")
        done = met.groupBy("lng", "lat").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("lng", "lat")
        found.append(met.join(done, ["lng", "lat"], "left_semi"))
        open_.join(done, ["lng", "lat"], "left_anti").write.parquet(f"{path}/open")
        open_ = spark.read.parquet(f"{path}/open")
    found.append(ranked(open_, metres))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return left.join(every, ["lng", "lat"]).select(*left.columns, *right.columns, "distance", "rank")


def _reached(spots: DataFrame, places: DataFrame, metres: float) -> DataFrame:
    """The different ``spots`` (r_lng, r_lat) that have one of the different ``places`` (lng, lat) at most ``metres`` away. No pairs
    are made: spots in a square of half that size with one of the places are done, and the rest ends at its first hit."""
    half = Bands(metres / 2)
    fine = lambda df, lng, lat: df.withColumn("band", half.band(lat)).withColumn("slot", F.floor((F.col(lng) + 180.0) / 360.0 * F.ceil(360.0 / half.high * F.cos(F.radians(F.least(F.abs(F.col("band") * half.high - 90.0), F.abs((F.col("band") + 1) * half.high - 90.0)))))))
    squares = fine(places, "lng", "lat").select("band", "slot").distinct()
    sure = fine(spots, "r_lng", "r_lat").join(squares, ["band", "slot"], "left_semi").select("r_lng", "r_lat")
    bands = Bands(metres)
    asked = bands.asked(spots.join(sure, ["r_lng", "r_lat"], "left_anti"), "r_lng", "r_lat").withColumnsRenamed({"band": "a_band", "slot": "a_slot"})
    stored = bands.stored(places, "lng", "lat")
    near = (F.col("a_band") == F.col("band")) & (F.col("a_slot") == F.col("slot")) & (geo.haversine_m("lng", "lat", "r_lng", "r_lat") <= metres)
    return sure.unionByName(asked.join(stored, near, "left_semi").select("r_lng", "r_lat").distinct())


def within_reach(rows: DataFrame, others: DataFrame, key: str, metres: float) -> DataFrame:
    """Keys of ``rows`` (key, r_lng, r_lat) that have one of ``others`` (lng, lat) at most ``metres`` away. Rows of one place have
    the same answer and are met once."""
    met = _reached(rows.select("r_lng", "r_lat").distinct(), others.select("lng", "lat").distinct(), metres)
    return rows.join(met, ["r_lng", "r_lat"], "left_semi").select(key).distinct()


def best_ring(rows: DataFrame, others: DataFrame, key: str, rings: list[tuple[float, int]]) -> DataFrame:
    """key and score of ``rows`` that are within a distance of one of ``others``: the score of the smallest such distance.
    ``rings`` are distances, ascending, and scores; only places of rows that no smaller ring holds go on to the next."""
    out, rest, places = None, rows.select("r_lng", "r_lat").distinct(), others.select("lng", "lat").distinct()
    for at, (metres, score) in enumerate(rings):
        hit = _reached(rest, places, metres)
        scored = hit.withColumn("ring", F.lit(at)).withColumn("score", F.lit(score))
        out = scored if out is None else out.unionByName(scored)
        rest = rest.join(hit, ["r_lng", "r_lat"], "left_anti")
    return rows.select(key, "r_lng", "r_lat").join(out, ["r_lng", "r_lat"]).groupBy(key).agg(F.min_by("score", "ring").alias("score"))


def prefix_join(addresses: DataFrame, blocks: DataFrame, lengths: list[int]) -> DataFrame:
    """Addresses (ip LONG) with the block (start LONG, length INT, ...) of the longest prefix that holds them.

    Only prefix lengths that occur are tried: an equi-join on length and prefix, then the longest hit.
    """
    distinct = addresses.select("ip").distinct()
    tried = distinct.withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).withColumn("prefix", F.expr("shiftright(ip, 32 - length)"))
    stored = blocks.withColumn("prefix", F.expr("shiftright(start, 32 - length)"))
    met = tried.join(stored, ["length", "prefix"]).drop("prefix")
    rest = [c for c in met.columns if c not in ("ip", "length")]
    return met.groupBy("ip").agg(F.max_by(F.struct(*rest), "length").alias("b"), F.max("length").alias("length")).select("ip", "length", "b.*")


def long_prefix_join(addresses: DataFrame, blocks: DataFrame, lengths: list[int]) -> DataFrame:
    """IPv6 addresses (ip, text) with the block (start, text; length INT, ...) of the longest prefix that holds them."""
    distinct = addresses.select("ip").distinct().withColumn("bits", shapes.address_bits("ip"))
    tried = distinct.withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).withColumn("prefix", F.expr("substring(bits, 1, length)")).drop("bits")
    stored = blocks.withColumn("prefix", F.substring(shapes.address_bits("start"), F.lit(1), F.col("length")))
    best = Window.partitionBy("ip").orderBy(F.desc("length"))
    return tried.join(stored, ["length", "prefix"]).withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "prefix")


def tagged_outer_join(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer join with ``source`` (both, left, right) and columns taken from the left side first."""
    a, b = left.alias("a"), right.alias("b")
    met = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    source = F.when(F.col(f"b.{key}").isNull(), "left").when(F.col(f"a.{key}").isNull(), "right").otherwise("both")
    return met.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in columns), source.alias("source"))
