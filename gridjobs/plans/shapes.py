"""Queries on lines, random points and long addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import joins
from .base import BOXES, POINTS, query

_TWO = "select event_id, {part} as part, {i} as i, cast(printf('%.3f', lng + {x}) as double) as x, cast(printf('%.3f', lat) as double) as y from " + POINTS


@query("F17_points_along", "select event_id, k, 3e0*k as at, round(event_id % 100 + case when 3*k < 5 then 1.8e0*k else 3 end, 6) as x, round(case when 3*k < 5 then 2.4e0*k else 3e0*k - 1 end, 6) as y from events, range(4) r(k) where 3*k <= 5 + event_id % 7")
def f17(t):
    """Every three units along a line of two legs for each event."""
    lines = t.events.select("event_id", F.expr("transform(array(array(0, 0), array(3, 4), array(3, 4 + event_id % 7)), p -> named_struct('x', double(event_id % 100 + p[0]), 'y', double(p[1])))").alias("line"))
    return shapes.points_along(lines, "line", 3.0).withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query("F19_line_text", " union all ".join(_TWO.format(part=p, i=i, x=x) for p, i, x in ((0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3), (1, 2, 4))))
def f19(t):
    """Text of lines with two parts, to a row for each point."""
    at = lambda x: f"format_string('%.3f %.3f', lng + {x}, lat)"
    text = t.points.select("event_id", F.expr(f"concat('MULTILINESTRING ((', {at(0)}, ', ', {at(1)}, '), (', {at(2)}, ', ', {at(3)}, ', ', {at(4)}, '))')").alias("wkt"))
    parts = text.select("event_id", F.posexplode(shapes.line_parts("wkt")).alias("part", "line"))
    return parts.select("event_id", "part", F.posexplode("line").alias("i", "p")).select("event_id", "part", "i", "p.x", "p.y")


@query("S4_random_points", "select s_suppkey, 10 as n, 10 as places, true as inside from supplier")
def s4(t):
    """Ten points in the box of each supplier's nation: how many, how many different, and whether all are inside."""
    boxes = t.supplier.join(t.boxes.select(F.col("n_nationkey").alias("s_nationkey"), "minx", "miny", "maxx", "maxy"), "s_nationkey")
    inside = F.expr("every(lng between minx and maxx and lat between miny and maxy)")
    return shapes.random_points(boxes, 10, 7).groupBy("s_suppkey").agg(F.count(F.lit(1)).cast("int").alias("n"), F.countDistinct("lng", "lat").cast("int").alias("places"), inside.alias("inside"))


@query("J15_long_prefix_join", "select distinct '2001:' || lower(to_hex(event_id % 16)) || '::' || lower(to_hex(event_id % 65536)) as ip, case when event_id % 2 = 0 then n_name else 'wide' end as place from events join nation on n_nationkey = event_id % 16")
def j15(t):
    """IPv6 addresses with the longest of the networks that hold them."""
    ips = t.events.select(F.expr("concat('2001:', lower(hex(event_id % 16)), '::', lower(hex(event_id % 65536)))").alias("ip"))
    near = t.nation.where("n_nationkey % 2 = 0").select(F.expr("concat('2001:', lower(hex(n_nationkey)), '::')").alias("start"), F.lit(32).alias("length"), F.col("n_name").alias("place"))
    wide = t.region.where("r_regionkey = 0").select(F.lit("2001::").alias("start"), F.lit(20).alias("length"), F.lit("wide").alias("place"))
    return joins.long_prefix_join(ips, near.unionByName(wide), [20, 32]).select("ip", "place")


@query("J15_all_networks", "select distinct '2001:' || lower(to_hex(event_id % 40)) || '::' || lower(to_hex(event_id % 65536)) as ip, coalesce(n_name, r_name) as place from events left join nation on n_nationkey = event_id % 40 left join region on r_regionkey = (event_id % 40) // 8")
def j15all(t):
    """Networks of every nation within wider ones of every region."""
    ips = t.events.select(F.expr("concat('2001:', lower(hex(event_id % 40)), '::', lower(hex(event_id % 65536)))").alias("ip"))
    near = t.nation.select(F.expr("concat('2001:', lower(hex(n_nationkey)), '::')").alias("start"), F.lit(32).alias("length"), F.col("n_name").alias("place"))
    wide = t.region.select(F.expr("concat('2001:', lower(hex(r_regionkey * 8)), '::')").alias("start"), F.lit(29).alias("length"), F.col("r_name").alias("place"))
    return joins.long_prefix_join(ips, near.unionByName(wide), [29, 32]).select("ip", "place")


@query("S4_points_by_nation", "select s_nationkey, 10 * count(*) as n from supplier group by 1")
def s4nation(t):
    """Random points of all suppliers, found again by the box that holds them."""
    boxes = t.supplier.join(t.boxes.select(F.col("n_nationkey").alias("s_nationkey"), "minx", "miny", "maxx", "maxy"), "s_nationkey")
    placed = shapes.random_points(boxes, 10, 7).select("lng", "lat")
    return joins.box_join(placed, t.boxes).groupBy(F.col("n_nationkey").alias("s_nationkey")).agg(F.count(F.lit(1)).alias("n"))


@query("F19_polygon_text", f"select n_nationkey, p.p as polygon, r.r as ring, i.i as i, case when p.p = 1 then minx + i.i else minx + case when i.i in (1, 2) then 10 else 0 end * case when r.r = 0 then 1e0 else 0.5e0 end end as x, case when p.p = 1 then miny + i.i * i.i else miny + case when i.i in (2, 3) then 8 else 0 end * case when r.r = 0 then 1e0 else 0.5e0 end end as y from {BOXES}, range(2) p(p), range(2) r(r), range(4) i(i) where p.p = 0 or (r.r = 0 and i.i < 3)")
def f19polygon(t):
    """Text of two polygons, one with a hole, to a row for each point; closing points are left out."""
    at = lambda x, y: f"format_string('%.4f %.4f', minx + {x}D, miny + {y}D)"
    ring = lambda *p: "concat('(', " + ", ', ', ".join(at(x, y) for x, y in [*p, p[0]]) + ", ')')"
    text = f"concat('MULTIPOLYGON ((', {ring((0, 0), (10, 0), (10, 8), (0, 8))}, ', ', {ring((0, 0), (5, 0), (5, 4), (0, 4))}, '), (', {ring((0, 0), (1, 1), (2, 4))}, '))')"
    parts = t.boxes.select("n_nationkey", F.posexplode(shapes.polygon_parts(text)).alias("polygon", "rings"))
    rings = parts.select("n_nationkey", "polygon", F.posexplode("rings").alias("ring", "points"))
    return rings.select("n_nationkey", "polygon", "ring", F.posexplode("points").alias("i", "p")).select("n_nationkey", "polygon", "ring", "i", "p.x", "p.y")
