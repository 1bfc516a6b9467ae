"""Lines and addresses: well-known text to coordinates and back, points along a line, random points, bits of IPv6 text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"-?[0-9]+(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?"
POINT = f"({NUMBER})[ ]+({NUMBER})"


def line_parts(wkt: str) -> Column:
    """array<array<struct<x, y>>>: the points of each part of LINESTRING or MULTILINESTRING text in column ``wkt``.

    A third coordinate is ignored; null, empty and other text has no parts.
    """
    points = f"transform(regexp_extract_all(part, '{POINT}', 0), p -> named_struct('x', double(regexp_extract(p, '{POINT}', 1)), 'y', double(regexp_extract(p, '{POINT}', 2))))"
    parts = rf"regexp_extract_all({wkt}, '[(]([^()]+)[)]', 1)"
    return F.when(F.upper(F.col(wkt)).rlike("^ *(MULTI)?LINESTRING"), F.expr(f"transform({parts}, part -> {points})")).otherwise(F.expr("cast(array() as array<array<struct<x: double, y: double>>>)"))


def polygon_parts(wkt: str) -> Column:
    """array<array<array<struct<x, y>>>>: the points of each ring of each part of POLYGON or MULTIPOLYGON text, which the SQL
    ``wkt`` gives, without the closing point. A third coordinate is ignored; null, empty and other text has no parts."""
    ring = r"[(][^()]+[)]"
    points = f"transform(regexp_extract_all(ring, '{POINT}', 0), p -> named_struct('x', double(regexp_extract(p, '{POINT}', 1)), 'y', double(regexp_extract(p, '{POINT}', 2))))"
    opened = f"transform(array({points}), p -> if(size(p) > 1 and p[0] = p[size(p) - 1], slice(p, 1, size(p) - 1), p))[0]"
    rings = f"transform(regexp_extract_all(part, '{ring}', 0), ring -> {opened})"
    parts = f"transform(regexp_extract_all({wkt}, '[(] *{ring}(?: *, *{ring})* *[)]', 0), part -> {rings})"
    return F.when(F.expr(f"upper({wkt}) rlike '^ *(MULTI)?POLYGON'"), F.expr(parts)).otherwise(F.expr("cast(array() as array<array<array<struct<x: double, y: double>>>>)"))


def line_wkt(line: str, digits: int = 6) -> Column:
    """LINESTRING text of ``line``: array of structs (x, y)."""
    return F.concat(F.lit("LINESTRING ("), F.expr(f"array_join(transform({line}, p -> format_string('%.{digits}f %.{digits}f', p.x, p.y)), ', ')"), F.lit(")"))


def points_along(df: DataFrame, line: str, step: float) -> DataFrame:
    """A row for each multiple ``at`` of ``step`` from 0 to the length of ``line`` (array of structs x, y), with x and y there.

    Each segment makes the points that lie within it, so no row holds a line's points; a point on a joint comes from
    the segment that begins there, the line's end from the last segment. Segments of no length make none, a line of
    no length its first point.
    """
    legs = f"transform(sequence(1, size({line}) - 1), i -> sqrt(pow({line}[i].x - {line}[i - 1].x, 2) + pow({line}[i].y - {line}[i - 1].y, 2)))"
    far = "aggregate(legs, array(double(0)), (s, d) -> concat(s, array(element_at(s, -1) + d)))"
    rest = [c for c in df.columns if c != line]
    held = df.withColumn("legs", F.when(F.size(line) > 1, F.expr(legs)).otherwise(F.expr("array(double(0))"))).withColumn("far", F.expr(far))
    held = held.where(F.size(line) > 0).withColumn("length", F.element_at("far", -1))
    # a segment from a to b makes the steps k with a <= k * step < b; the last one also k * step = length
    cut = held.select("*", F.posexplode("legs").alias("i", "leg"))
    cut = cut.withColumn("low", F.ceil(F.expr("far[i]") / step)).withColumn("high", F.ceil(F.expr("far[i + 1]") / step) - 1)
    last = F.col("i") == F.size("legs") - 1
    cut = cut.withColumn("high", F.when(last, F.floor(F.col("length") / step)).otherwise(F.col("high"))).where("low <= high")
    each = cut.withColumn("k", F.explode(F.sequence("low", "high"))).withColumn("at", F.col("k") * F.lit(float(step)))
    part = F.when(F.col("leg") > 0, (F.col("at") - F.expr("far[i]")) / F.col("leg")).otherwise(0.0)
    x, y = (F.expr(f"{line}[i].{c}") + part * (F.expr(f"coalesce(get({line}, i + 1).{c}, {line}[i].{c})") - F.expr(f"{line}[i].{c}")) for c in "xy")
    return each.select(*rest, F.col("k").cast("long").alias("k"), "at", x.alias("x"), y.alias("y"))


def random_points(boxes: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows for each of ``boxes`` (minx, miny, maxx, maxy, ...), numbered ``i`` from 0, at uniform places lng, lat within."""
    each = boxes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    lng = F.col("minx") + F.rand(seed) * (F.col("maxx") - F.col("minx"))
    return each.withColumn("lng", lng).withColumn("lat", F.col("miny") + F.rand(seed + 1) * (F.col("maxy") - F.col("miny")))


def address_bits(ip: str) -> Column:
    """The 128 bits, as text, of IPv6 text in column ``ip``; ``::`` stands for as many zero groups as are missing."""
    left, right = (f"filter(split(coalesce(get(split({ip}, '::'), {k}), ''), ':'), g -> g <> '')" for k in (0, 1))
    groups = f"concat({left}, array_repeat('0', 8 - size({left}) - size({right})), {right})"
    return F.expr(f"array_join(transform({groups}, g -> lpad(conv(g, 16, 2), 16, '0')), '')")
