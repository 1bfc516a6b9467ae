"""Queries on cells: indexing, roll-ups, shares, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import aggregates as agg
from ..operators import joins
from .base import BOXES, CITY, IDS, PIXELS, POINTS, RING, query, tc, tx, ty, up

X, Y = "((cell >> 28) & 268435455)", "(cell & 268435455)"
HAVERSINE = "2e0*6371008.8e0*asin(sqrt(least(1e0, pow(sin((radians({b}) - radians({d}))/2e0), 2) + cos(radians({d}))*cos(radians({b}))*pow(sin((radians({a}) - radians({c}))/2e0), 2))))"


def tiles(t, z):
    return t.points.withColumn("cell", geo.tile_cell("lng", "lat", z))


@query("G15_grid_count", f"select round(lng*3,1)/3 as lng_bin, round(lat*3,1)/3 as lat_bin, count(*) as cnt from {CITY} group by 1, 2 having count(*) > 1")
def g15(t):
    """Snapped grid with a minimum count."""
    return t.city.groupBy((F.round(F.col("lng") * 3, 1) / 3).alias("lng_bin"), (F.round(F.col("lat") * 3, 1) / 3).alias("lat_bin")).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


@query("G1_tile_cell", f"select event_id, {tc(10)} as cell from {POINTS}")
def g1(t):
    return tiles(t, 10).select("event_id", "cell")


@query("G2_cell_center", f"select cell, round(({X} + 0.5e0)/16e0*360e0 - 180e0, 6) as lng, round(degrees(atan(sinh(pi()*(1e0 - 2e0*({Y} + 0.5e0)/16e0)))), 6) as lat from (select distinct {tc(4)} as cell from {POINTS})")
def g2(t):
    lng, lat = geo.cell_center("cell", 4)
    return tiles(t, 4).select("cell").distinct().select("cell", F.round(lng, 6).alias("lng"), F.round(lat, 6).alias("lat"))


@query("G3_cell_parent", f"select cell, {up(6, 3)} as parent from (select distinct {tc(6)} as cell from {POINTS})")
def g3(t):
    return tiles(t, 6).select("cell").distinct().withColumn("parent", geo.cell_parent("cell", 6, 3))


@query("G4_id_resolution", "select cast(5 + event_id % 5 as int) as res, count(*) as n from events group by 1")
def g4(t):
    """Ids of five resolutions."""
    mixed = F.coalesce(*(F.when(F.expr("event_id % 5") == k, geo.h3_parent("h", 5 + k)) for k in range(5)))
    return t.ids.select(mixed.alias("h")).groupBy(geo.h3_resolution("h").alias("res")).agg(F.count(F.lit(1)).alias("n"))


@query("G3_id_parent", f"select ((h & ~(cast(15 as bigint) << 52)) | (cast(5 as bigint) << 52)) | 1073741823 as parent, count(*) as n from {IDS} group by 1")
def g3h(t):
    return t.ids.groupBy(geo.h3_parent("h", 5).alias("parent")).agg(F.count(F.lit(1)).alias("n"))


@query("G5_id_digits", f"select event_id, h, cast((h >> 42) & 7 as int) as pos1, cast((h >> 30) & 7 as int) as pos5, cast((h >> 18) & 7 as int) as pos9, h as back from {IDS}")
def g5(t):
    d = t.ids.select("event_id", "h", geo.h3_base_cell("h").alias("base"), *(geo.h3_digit("h", r).alias(f"pos{r}") for r in range(1, 10)))
    return d.select("event_id", "h", "pos1", "pos5", "pos9", geo.h3_from_digits("base", [F.col(f"pos{r}") for r in range(1, 10)]).alias("back"))


@query("G6_id_forms", f"select event_id, cast((h >> 45) & 127 as int) as base, lower(hex(h)) as text, h as back, ((h & ~(cast(15 as bigint) << 52)) | (cast(11 as bigint) << 52)) & ~cast({((1 << 18) - 1) ^ ((1 << 12) - 1)} as bigint) as center from {IDS}")
def g6(t):
    return t.ids.select("event_id", geo.h3_base_cell("h").alias("base"), geo.h3_text("h").alias("text"), geo.h3_number(geo.h3_text("h")).alias("back"), geo.h3_center_child("h", 9, 11).alias("center"))


@query("G6_validity", "select event_id, event_id % 3 <> 1 as valid from events")
def g6valid(t):
    """Ids, some with a digit of 7 within their resolution or with another mode."""
    broken = F.when(F.expr("event_id % 6 = 1"), F.col("h").bitwiseOR(F.lit(7 << 39))).when(F.expr("event_id % 6 = 4"), F.col("h").bitwiseXOR(F.lit(3 << 59))).otherwise(F.col("h"))
    return t.ids.select("event_id", geo.h3_valid(broken).alias("valid"))


DISK = f"(select c.*, (cast({4 << 56} as bigint) + ((({X} + dx.i + 16) % 16) << 28) + ({Y} + dy.i)) as near from ({{src}}) c, range(-1, 2) dx(i), range(-1, 2) dy(i) where {Y} + dy.i between 0 and 15)"


@query("G7_cell_disk", f"select cell, near from {DISK.format(src=f'select distinct {tc(4)} as cell from {POINTS}')}")
def g7(t):
    return tiles(t, 4).select("cell").distinct().withColumn("near", F.explode(geo.cell_disk("cell", 4, 1)))


@query("G8_polygon_cover", f"""with c as (select n_nationkey, minx, miny, x.i as x, y.i as y, (x.i + 0.5e0)/256e0*360e0 - 180e0 as lng, degrees(atan(sinh(pi()*(1e0 - 2e0*(y.i + 0.5e0)/256e0)))) as lat
 from {BOXES} b, range(256) x(i), range(256) y(i) where x.i between {tx(8, 'minx')} and {tx(8, 'maxx')} and y.i between {ty(8, 'maxy')} and {ty(8, 'miny')})
 select n_nationkey, cast({8 << 56} as bigint) + x * 268435456 + y as cell, count(*) over (partition by n_nationkey) as cell_count from c
 where lat > miny and lat < miny + 8 and lng > minx + 2.5e0*abs(lat - miny - 4)/4 and lng < minx + 10 - 2.5e0*abs(lat - miny - 4)/4""")
def g8(t):
    """Cells whose centre lies in the ring (every ring here has some)."""
    from pyspark.sql import Window

    lng, lat = geo.cell_center("cell", 8)
    cells = joins.with_box_cells(t.boxes, 8).withColumn("lng", lng).withColumn("lat", lat).where(geo.in_ring("lng", "lat", "ring"))
    return cells.select("n_nationkey", "cell", F.count(F.lit(1)).over(Window.partitionBy("n_nationkey")).alias("cell_count"))


@query("G8_cover_or_centre", f"select n_nationkey, {tc(2, 'minx + 5e0', 'miny + 4e0')} as cell, cast(1 as bigint) as cell_count from {BOXES} b where not exists (select 1 from range(4) x(i), range(4) y(i) where (x.i + 0.5e0)/4e0*360e0 - 180e0 > minx + 2.5e0*abs(degrees(atan(sinh(pi()*(1e0 - 2e0*(y.i + 0.5e0)/4e0)))) - miny - 4)/4 and (x.i + 0.5e0)/4e0*360e0 - 180e0 < maxx - 2.5e0*abs(degrees(atan(sinh(pi()*(1e0 - 2e0*(y.i + 0.5e0)/4e0)))) - miny - 4)/4 and degrees(atan(sinh(pi()*(1e0 - 2e0*(y.i + 0.5e0)/4e0)))) > miny and degrees(atan(sinh(pi()*(1e0 - 2e0*(y.i + 0.5e0)/4e0)))) < maxy)")
def g8centre(t):
    """At a coarse zoom rings without a cell get that of their centre; shown are those."""
    covered = joins.cover(t.boxes, "n_nationkey", 2)
    return covered.where("fallback").drop("fallback")


@query("G10_tiles", " union all ".join(f"select n_nationkey, {z} as z, count(*) as tiles, round(min(greatest(x.i/{n}e0*360e0 - 180e0, minx)), 6) as west, round(max(least((x.i + 1)/{n}e0*360e0 - 180e0, maxx)), 6) as east from {BOXES} b, range({n}) x(i), range({n}) y(i) where x.i between {tx(z, 'minx')} and {tx(z, 'maxx')} and y.i between {ty(z, 'maxy')} and {ty(z, 'miny')} group by 1" for z, n in ((5, 32), (6, 64))))
def g10(t):
    """Tiles of two zooms that meet each box, clipped to it."""
    found = [joins.clipped_tiles(t.boxes, z).groupBy("n_nationkey", F.lit(z).alias("z")).agg(F.count(F.lit(1)).alias("tiles"), F.round(F.min("west"), 6).alias("west"), F.round(F.max("east"), 6).alias("east")) for z in (5, 6)]
    return found[0].unionByName(found[1])


@query("G10_bounding_tile", f"select n_nationkey, max(z)::int as z from {BOXES} b, range(0, 15) r(z) where floor((minx + 180e0)/360e0*(1 << z)::double) = floor((maxx + 180e0)/360e0*(1 << z)::double) and floor((1e0 - ln(tan(radians(miny)) + 1e0/cos(radians(miny)))/pi())/2e0*(1 << z)::double) = floor((1e0 - ln(tan(radians(maxy)) + 1e0/cos(radians(maxy)))/pi())/2e0*(1 << z)::double) group by 1")
def g10one(t):
    """The zoom of the smallest tile that holds each box; a target count adds levels to it."""
    return t.boxes.select("n_nationkey", joins.target_zoom(1, 14).alias("z"))


@query("G9_bounds_cells", f"select n_nationkey, count(*) as cells from {BOXES} b, range(64) x(i), range(64) y(i) where x.i between {tx(6, 'minx')} and {tx(6, 'maxx')} and y.i between {ty(6, 'maxy')} and {ty(6, 'miny')} group by 1")
def g9(t):
    return joins.with_box_cells(t.boxes, 6).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("cells"))


@query("G11_compact", f"""with a as (select distinct {tc(4)} as cell from {POINTS}), f3 as (select {up(4, 3)} as cell from a group by 1 having count(*) = 4),
 f2 as (select {up(3, 2)} as cell from f3 group by 1 having count(*) = 4), f1 as (select {up(2, 1)} as cell from f2 group by 1 having count(*) = 4), f0 as (select {up(1, 0)} as cell from f1 group by 1 having count(*) = 4)
 select cell from a where {up(4, 3)} not in (select cell from f3) union all select cell from f3 where {up(3, 2)} not in (select cell from f2) union all select cell from f2 where {up(2, 1)} not in (select cell from f1)
 union all select cell from f1 where {up(1, 0)} not in (select cell from f0) union all select cell from f0""")
def g11(t):
    return agg.compact(tiles(t, 4), 4)


@query("G14_cell_area", f"select cell, round((sin(atan(sinh(pi()*(1e0 - 2e0*{Y}/16e0)))) - sin(atan(sinh(pi()*(1e0 - 2e0*({Y} + 1)/16e0))))) * (2e0*pi()/16e0) * 6371.0088e0*6371.0088e0, 3) as km2 from (select distinct {tc(4)} as cell from {POINTS})")
def g14(t):
    return tiles(t, 4).select("cell").distinct().select("cell", F.round(geo.cell_area_km2("cell", 4), 3).alias("km2"))


@query("G16_cell_wkt", "with c as (select distinct " + tc(4) + f" as cell from {POINTS}), k as (select cell, printf('%.6f', {X}/16e0*360e0 - 180e0) as x0, printf('%.6f', ({X} + 1)/16e0*360e0 - 180e0) as x1, printf('%.6f', degrees(atan(sinh(pi()*(1e0 - 2e0*{Y}/16e0))))) as y0, printf('%.6f', degrees(atan(sinh(pi()*(1e0 - 2e0*({Y} + 1)/16e0))))) as y1 from c) select cell, 'POLYGON ((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || '))' as wkt from k")
def g16(t):
    return tiles(t, 4).select("cell").distinct().withColumn("wkt", geo.cell_wkt("cell", 4))


@query("G17_coarser_area", f"select distinct {up(6, 4)} as parent from (select {tc(6)} as cell from {POINTS} where event_type = 'view')")
def g17(t):
    return tiles(t, 6).where("event_type = 'view'").select(geo.cell_parent("cell", 6, 4).alias("parent")).distinct()


@query("G1_hexbin", f"with p as (select (sqrt(3e0)/3e0*radians(lng) - sin(radians(lat))/3e0)/0.1e0 as a, (2e0/3e0*sin(radians(lat)))/0.1e0 as b from {POINTS}), c as (select a, b, -a - b as c, floor(a + 0.5e0) as ra, floor(b + 0.5e0) as rb, floor(-a - b + 0.5e0) as rc from p), d as (select *, abs(ra - a) as da, abs(rb - b) as db, abs(rc - c) as dc from c) select (case when da > db and da > dc then -rb - rc else ra end)::bigint as q, (case when not (da > db and da > dc) and db > dc then -ra - rc else rb end)::bigint as r, count(*) as cnt from d group by 1, 2")
def g1hex(t):
    q, r = geo.hexbin("lng", "lat", 0.1)
    return t.points.groupBy(q.alias("q"), r.alias("r")).agg(F.count(F.lit(1)).alias("cnt"))


@query("FIL1_bounds", f"select event_id, lng, lat, lng < 10 and lat < 20 as half_open from {POINTS} where lng between -10 and 10 and lat between -20 and 20")
def fil1(t):
    b = (-10.0, -20.0, 10.0, 20.0)
    return t.points.where(geo.in_bounds(b)).select("event_id", "lng", "lat", geo.in_bounds(b, closed=False).alias("half_open"))


@query("FIL2_cell_in_bounds", f"select cell from (select distinct {tc(4)} as cell from {POINTS}) where ({X} + 0.5e0)/16e0*360e0 - 180e0 between -60 and 60 and degrees(atan(sinh(pi()*(1e0 - 2e0*({Y} + 0.5e0)/16e0)))) between -30 and 60")
def fil2(t):
    lng, lat = geo.cell_center("cell", 4)
    return tiles(t, 4).select("cell").distinct().where(lng.between(-60, 60) & lat.between(-30, 60))


@query("A1_cell_counts", f"select {tc(4)} as cell, count(*) as cnt from {POINTS} group by 1 having count(*) >= 5")
def a1(t):
    return tiles(t, 4).groupBy("cell").agg(F.count(F.lit(1)).alias("cnt")).where("cnt >= 5")


METRICS = f"(select {tc(6)} as cell, sum(user_id) as u_sum, min(user_id) as u_min, max(user_id) as u_max, count(*) as n_cnt, avg(user_id) as u_avg from {POINTS} group by 1)"


@query("A2_roll_up", f"select {up(6, 3)} as cell, sum(u_sum)::bigint as u_sum, min(u_min) as u_min, max(u_max) as u_max, sum(n_cnt)::bigint as n_cnt, round(avg(u_avg), 6) as u_avg from {METRICS} group by 1")
def a2(t):
    fine = tiles(t, 6).groupBy("cell").agg(F.sum("user_id").alias("u_sum"), F.min("user_id").alias("u_min"), F.max("user_id").alias("u_max"), F.count(F.lit(1)).alias("n_cnt"), F.avg("user_id").alias("u_avg"))
    return agg.roll_up(fine, geo.cell_parent("cell", 6, 3), ["u_sum", "u_min", "u_max", "n_cnt", "u_avg"]).withColumn("u_avg", F.round("u_avg", 6))


@query("A3_shifted_mean", f"select {tc(4)} as cell, round(avg(user_id + 273) - 273e0, 2) as mean from {POINTS} group by 1")
def a3(t):
    return tiles(t, 4).groupBy("cell").agg(F.round(F.avg(F.col("user_id") + 273) - 273.0, 2).alias("mean"))


@query("A4_hourly_cells", f"select {tc(3)} as cell, hour(ts)::int as hour, count(*) as cnt, round(sqrt(count(*))*10, 6) as metric from {POINTS} group by 1, 2")
def a4(t):
    return tiles(t, 3).groupBy("cell", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("cnt")).withColumn("metric", F.round(F.sqrt("cnt") * 10, 6))


@query("A5_cell_values", f"select {tc(4)} as cell, array_to_string(list_sort(list(user_id)), ',') as vals, sum(user_id)::bigint as total from {POINTS} group by 1")
def a5(t):
    return tiles(t, 4).groupBy("cell").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("user_id")), lambda x: x.cast("string"))).alias("vals"), F.sum("user_id").alias("total"))


@query("A5_cell_means", f"select {tc(4)} as cell, round(avg(user_id), 6) as mean, sum(user_id)::bigint as total, count(distinct user_id) as different from {POINTS} group by 1")
def a5means(t):
    """Mean, sum and number of different values of each cell, without its list."""
    return tiles(t, 4).groupBy("cell").agg(F.round(F.avg("user_id"), 6).alias("mean"), F.sum("user_id").alias("total"), F.countDistinct("user_id").alias("different"))


@query("A6_share", f"select cell, data, total, round(100e0*total/sum(total) over (partition by cell), 6) as pct from (select {tc(3)} as cell, event_id % 7 as data, sum(user_id)::bigint as total from {POINTS} group by 1, 2)")
def a6(t):
    return agg.share(tiles(t, 3).withColumn("data", F.expr("event_id % 7")), "cell", "data", "user_id").withColumn("pct", F.round("pct", 6))


@query("A7_coverage", f"select {up(6, 3)} as cell, round(100e0*sum(cnt/5e0)/64e0, 6) as pct from (select {tc(6)} as cell, count(*) as cnt from {POINTS} group by 1) group by 1")
def a7(t):
    fine = tiles(t, 6).groupBy("cell").agg(F.count(F.lit(1)).alias("cnt"))
    return fine.groupBy(geo.cell_parent("cell", 6, 3).alias("cell")).agg(F.round(100.0 * F.sum(F.col("cnt") / 5.0) / 4**3, 6).alias("pct"))


@query("A8_mode", f"select cell, data, n from (select *, row_number() over (partition by cell order by n desc, data) r from (select {tc(3)} as cell, event_id % 7 as data, count(*) as n from {POINTS} group by 1, 2)) where r = 1")
def a8(t):
    return agg.mode(tiles(t, 3).withColumn("data", F.expr("event_id % 7")), "cell", "data")


@query("A9_top_class", f"select cell, data, total from (select *, row_number() over (partition by cell order by total desc, data) r from (select {tc(3)} as cell, event_id % 7 as data, sum(user_id)::bigint as total from {POINTS} group by 1, 2)) where r = 1")
def a9(t):
    return agg.top_class(tiles(t, 3).withColumn("data", F.expr("event_id % 7")), "cell", "data", "user_id")


@query("A11_smooth", f"select near as cell, round(avg(v), 6) as smoothed from {DISK.format(src=f'select {tc(4)} as cell, avg(user_id) as v from {POINTS} group by 1')} group by 1")
def a11(t):
    base = tiles(t, 4).groupBy("cell").agg(F.avg("user_id").alias("v"))
    return agg.smooth(base, 4, 1, "v").withColumn("smoothed", F.round("smoothed", 6))


@query("A14_names_per_cell", f"select {tc(2)} as cell, count(*) as cnt, string_agg(distinct event_type, ', ' order by event_type) as names from {POINTS} group by 1")
def a14(t):
    return tiles(t, 2).groupBy("cell").agg(F.count(F.lit(1)).alias("cnt"), F.concat_ws(", ", F.sort_array(F.collect_set("event_type"))).alias("names"))


@query("A31_levels", " union all ".join(f"select {z} as res, {tc(z)} as cell, count(*) as cnt from {POINTS} group by 1, 2" for z in (2, 3, 4)))
def a31(t):
    """Counted at the finest zoom; the others add those counts up."""
    finest = tiles(t, 4).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.array(*[F.struct(F.lit(z).alias("res"), geo.cell_parent("cell", 4, z).alias("cell")) for z in (2, 3, 4)])).alias("l")
    return finest.select(levels, "n").groupBy("l.res", "l.cell").agg(F.sum("n").alias("cnt"))


@query("J7_neighbourhood_top_class", f"""with crops as (select {tc(4)} as cell, event_id % 7 as crop, sum(user_id)::bigint as area from {POINTS} group by 1, 2), centers as (select distinct cell from crops),
 ring as {DISK.format(src='select cell from centers')}, sums as (select r.cell, crop, sum(area)::bigint as total from ring r join crops c on c.cell = r.near group by 1, 2)
 select cell as center, crop, total from (select *, row_number() over (partition by cell order by total desc, crop) k from sums) where k = 1""")
def j7(t):
    crops = tiles(t, 4).groupBy("cell", F.expr("event_id % 7").alias("crop")).agg(F.sum("user_id").alias("area"))
    return agg.top_class(joins.neighbourhood_join(crops.select(F.col("cell").alias("center")).distinct(), crops, 4), "center", "crop", "area")


@query("J8_box_join", f"select event_id, n_nationkey from {POINTS} p join {BOXES} b on lng between minx and maxx and lat between miny and maxy")
def j8(t):
    return joins.box_join(t.points, t.boxes).select("event_id", "n_nationkey")


@query("J9_ring_join", f"select n_nationkey, count(*) as n from {POINTS} p join {BOXES} b on lat > miny and lat < maxy and lng > minx + 2.5e0*abs(lat - miny - 4)/4 and lng < maxx - 2.5e0*abs(lat - miny - 4)/4 group by 1")
def j9(t):
    return joins.ring_join(t.points, t.boxes).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"))


PAIRS = f"(select a.event_id, b.event_id as other, {HAVERSINE.format(a='b.lng', b='b.lat', c='a.lng', d='a.lat')} as distance from {POINTS} a, {POINTS} b where a.event_type = 'purchase' and b.event_type = 'signup' and abs(a.lat - b.lat) < 4)"


def sides(t):
    right = t.points.where("event_type = 'signup'").select(F.col("event_id").alias("other"), F.col("lng").alias("r_lng"), F.col("lat").alias("r_lat"))
    return t.points.where("event_type = 'purchase'").select("event_id", "lng", "lat"), right


@query("J10_distance_join", f"select event_id, other, round(distance, 2) as distance from {PAIRS} where distance <= 200000")
def j10(t):
    return joins.distance_join(*sides(t), 200_000, digits=2).select("event_id", "other", "distance")


@query("J11_nearest_join", f"select event_id, other, rank from (select *, row_number() over (partition by event_id order by distance, other)::int as rank from {PAIRS} where distance <= 400000) where rank <= 3")
def j11(t):
    return joins.nearest_join(*sides(t), "event_id", "other", 400_000, 3).select("event_id", "other", "rank")


@query("J12_ring_scores", f"select other, max(case when distance <= 100000 then 3 when distance <= 200000 then 2 else 1 end) as score from {PAIRS} where distance <= 300000 group by 1")
def j12(t):
    """The best ring only, without pairs."""
    a, b = sides(t)
    return joins.best_ring(b, a, "other", [(100_000, 3), (200_000, 2), (300_000, 1)])


@query("J13_conflation", f"with hit as (select distinct other from {PAIRS} where distance <= 200000) select event_id as id, 'a' as source from {POINTS} where event_type = 'purchase' union all select event_id, 'b' from {POINTS} where event_type = 'signup' and event_id not in (select other from hit)")
def j13(t):
    a, b = sides(t)
    rest = b.join(joins.within_reach(b, a, "other", 200_000), "other", "left_anti")
    return a.select(F.col("event_id").alias("id"), F.lit("a").alias("source")).unionByName(rest.select(F.col("other").alias("id"), F.lit("b").alias("source")))


@query("J18_overlap_join", f"with w as (select n_nationkey, minx, miny, maxx + 51e0 as maxx, maxy + 19e0 as maxy from {BOXES}) select a.n_nationkey as n_nationkey_a, b.n_nationkey as n_nationkey_b from w a join w b on a.n_nationkey < b.n_nationkey and a.minx <= b.maxx and b.minx <= a.maxx and a.miny <= b.maxy and b.miny <= a.maxy")
def j18(t):
    return joins.overlap_join(t.boxes.withColumn("maxx", F.col("maxx") + 51.0).withColumn("maxy", F.col("maxy") + 19.0), "n_nationkey")


@query("F14_distance", f"select event_id, round({HAVERSINE.format(a='2.35e0', b='48.85e0', c='lng', d='lat')}, 1) as metres, cast(floor((lng + 180e0)/6e0) + 1 as int) as zone from {POINTS}")
def f14(t):
    return t.points.select("event_id", F.round(geo.haversine_m("lng", "lat", F.lit(2.35), F.lit(48.85)), 1).alias("metres"), geo.utm_zone("lng").alias("zone"))


@query("F15_ring_shape", f"select n_nationkey, minx + 5e0 as cx, miny + 4e0 as cy, minx, miny, maxx, maxy from {BOXES}")
def f15shape(t):
    """Centroid and bounds of each ring."""
    cx, cy = geo.ring_centroid("ring")
    return t.boxes.select("n_nationkey", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"), *(v.alias(k) for k, v in geo.ring_bounds("ring").items()))


@query("F15_area_by_region", f"select n_regionkey, round(sum(60e0 * (1 + b.n_nationkey % 3)), 6) as area from {BOXES} b join nation using (n_nationkey) group by 1")
def f15total(t):
    """Areas of rings of three widths, summed by region."""
    wide = t.boxes.withColumn("ring", F.expr("transform(ring, p -> named_struct('x', minx + (p.x - minx) * (1 + n_nationkey % 3), 'y', p.y))"))
    return wide.join(t.nation.select("n_nationkey", "n_regionkey"), "n_nationkey").groupBy("n_regionkey").agg(F.round(F.sum(geo.ring_area("ring")), 6).alias("area"))


@query("F14_projection_code", f"select event_id, (case when lat >= 0 then 32600 else 32700 end + cast(floor((lng + 180e0)/6e0) + 1 as int)) as code from {POINTS}")
def f14code(t):
    return t.points.select("event_id", geo.utm_code("lng", "lat").alias("code"))


@query("F16_utm", f"with p as (select event_id, radians(lat) as phi, radians(lng - (6*floor((lng + 180e0)/6e0) - 177e0)) as l, lat from {POINTS}), k as (select *, 0.006694379990141317e0 as e2, 0.006739496742276435e0 as p2 from p), t as (select *, 6378137e0/sqrt(1 - e2*pow(sin(phi), 2)) as n, pow(tan(phi), 2) as t, p2*pow(cos(phi), 2) as c, cos(phi)*l as a, 6378137e0*((1 - e2/4 - 3*pow(e2,2)/64 - 5*pow(e2,3)/256)*phi - (3*e2/8 + 3*pow(e2,2)/32 + 45*pow(e2,3)/1024)*sin(2*phi) + (15*pow(e2,2)/256 + 45*pow(e2,3)/1024)*sin(4*phi) - (35*pow(e2,3)/3072)*sin(6*phi)) as m from k) select event_id, round(500000e0 + 0.9996e0*n*(a + (1 - t + c)*pow(a,3)/6 + (5 - 18*t + t*t + 72*c - 58*p2)*pow(a,5)/120), 1) as easting, round(case when lat < 0 then 10000000e0 else 0e0 end + 0.9996e0*(m + n*tan(phi)*(a*a/2 + (5 - t + 9*c + 4*c*c)*pow(a,4)/24 + (61 - 58*t + t*t + 600*c - 330*p2)*pow(a,6)/720)), 1) as northing from t")
def f16utm(t):
    """Metres in each point's own zone."""
    x, y = geo.to_utm("lng", "lat")
    return t.points.select("event_id", F.round(x, 1).alias("easting"), F.round(y, 1).alias("northing"))


_S = "sin(radians(y))"
_AUTHALIC = f"({1 - geo._E**2!r} * ({_S}/(1 - {geo._E**2!r}*{_S}*{_S}) - ln((1 - {geo._E!r}*{_S})/(1 + {geo._E!r}*{_S}))/{2 * geo._E!r})/{geo._POLE!r})"
_CORNERS = "(values " + ", ".join(f"({i}, {x}e0, {y}e0)" for i, (x, y) in enumerate(RING)) + ") r(i, dx, dy)"


@query("F15_equal_area", f"with c as (select n_nationkey, i, minx + dx as x, miny + dy as y from {BOXES}, {_CORNERS}), p as (select n_nationkey, i, radians(x)*{geo.AUTHALIC_M!r} as u, {_AUTHALIC}*{geo.AUTHALIC_M!r} as v from c) select a.n_nationkey, round(abs(sum(a.u*b.v - b.u*a.v))/2e6, 3) as km2 from p a join p b on a.n_nationkey = b.n_nationkey and b.i = (a.i + 1) % 6 group by 1")
def f15equal(t):
    """Square kilometres of each ring on the ellipsoid."""
    return t.boxes.withColumn("plane", geo.equal_area_ring("ring")).select("n_nationkey", F.round(geo.ring_area("plane") / 1e6, 3).alias("km2"))


@query("F16_back", f"select event_id, round(lng, 7) as utm_lng, round(lat, 7) as utm_lat, round(lng, 9) as web_lng, round(lat, 9) as web_lat from {POINTS}")
def f16back(t):
    """Each point from its zone's metres, and from those of the web map."""
    (e, n), (x, y) = geo.to_utm("lng", "lat"), geo.to_mercator("lng", "lat")
    met = t.points.select("event_id", e.alias("e"), n.alias("n"), geo.utm_code("lng", "lat").alias("code"), x.alias("x"), y.alias("y"))
    (a, b), (c, d) = geo.from_utm("e", "n", "code"), geo.from_mercator("x", "y")
    return met.select("event_id", F.round(a, 7).alias("utm_lng"), F.round(b, 7).alias("utm_lat"), F.round(c, 9).alias("web_lng"), F.round(d, 9).alias("web_lat"))


@query("F15_ring_area", f"select n_nationkey, 60e0 as area from {BOXES}")
def f15(t):
    return t.boxes.select("n_nationkey", F.round(geo.ring_area("ring"), 6).alias("area"))


@query("F16_mercator", f"select event_id, round(radians(lng)*6378137e0, 2) as x, round(ln(tan(pi()/4e0 + radians(lat)/2e0))*6378137e0, 2) as y from {POINTS}")
def f16(t):
    x, y = geo.to_mercator("lng", "lat")
    return t.points.select("event_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("F18_sub_boxes", f"select n_nationkey, i.i as col, j.j as row, minx + i.i*2.5e0 as x0, miny + j.j*2e0 as y0 from {BOXES}, range(4) i(i), range(4) j(j)")
def f18(t):
    parts = t.boxes.withColumn("col", F.explode(F.expr("sequence(0L, 3L)"))).withColumn("row", F.explode(F.expr("sequence(0L, 3L)")))
    return parts.select("n_nationkey", "col", "row", F.expr("minx + col*2.5e0").alias("x0"), F.expr("miny + row*2e0").alias("y0"))


@query("F18_axis_split", "with w as (select s_suppkey, (s_suppkey % 36)*10e0 - 180e0 as a, case when (s_suppkey % 36)*10e0 - 180e0 + 35e0 > 180 then (s_suppkey % 36)*10e0 - 505e0 else (s_suppkey % 36)*10e0 - 145e0 end as b from supplier) select s_suppkey, a as minx, b as maxx from w where a <= b union all select s_suppkey, a, 180e0 from w where a > b union all select s_suppkey, -180e0, b from w where a > b")
def f18split(t):
    """Boxes that cross the antimeridian (west edge over east edge) as two boxes."""
    a = F.expr("(s_suppkey % 36)*10e0 - 180e0")
    b = t.supplier.select("s_suppkey", a.alias("minx"), F.when(a + 35.0 > 180, a - 325.0).otherwise(a + 35.0).alias("maxx"))
    return b.withColumn("part", F.explode(geo.split_at_antimeridian("minx", "maxx"))).select("s_suppkey", "part.minx", "part.maxx")


@query("F20_pixel_chunks", f"select p_partkey, (x // 4 + 2*(y // 4))::int as chunk, count(*) as n, sum(data)::bigint as total from {PIXELS} group by 1, 2")
def f20chunks(t):
    """Two by two chunks of each raster."""
    chunk = geo.raster_chunk("x", "y", 8, 8, 2, 2)
    return t.pixels.groupBy("p_partkey", chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sum("data").alias("total"))


@query("F20_pixels", f"select p_partkey, x::int as x, y::int as y, data from {PIXELS}")
def f20(t):
    return t.pixels.select("p_partkey", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "data")


@query("A23_zonal", f"select p_partkey, sum(data)::bigint as stats_sum, count(data) as stats_count, count(*) as stats_size, min(data) as stats_min, max(data) as stats_max, round(sum(data)/count(data), 6) as stats_mean from {PIXELS} group by 1")
def a23(t):
    return agg.zonal(t.pixels, "p_partkey", "data").withColumn("stats_mean", F.round("stats_mean", 6))


@query("A24_zonal_classes", f"select p_partkey, string_agg(data || ':' || n, ',' order by data) as classes from (select p_partkey, data, count(*) as n from {PIXELS} group by 1, 2) group by 1")
def a24(t):
    counts = t.pixels.groupBy("p_partkey", "data").agg(F.count(F.lit(1)).alias("n"))
    m = counts.groupBy("p_partkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("data", "n")))).alias("m"))
    return m.select("p_partkey", F.concat_ws(",", F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))).alias("classes"))


@query("A25_composite", f"select x::int as x, y::int as y, list_sort(list(data))[count(*)//2 + 1] as median, max(data) as greenest from {PIXELS} group by 1, 2")
def a25(t):
    return agg.composite(t.pixels.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "data"), "data")


@query("A25_greenest", f"select x::int as x, y::int as y, data, band, p_partkey from (select *, (p_partkey + i) % 7 as band, row_number() over (partition by x, y order by data desc, p_partkey) r from {PIXELS}) where r = 1")
def a25best(t):
    """The other bands of the pixel with the greatest index."""
    p = t.pixels.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "data", F.expr("(p_partkey + i) % 7").alias("band"), "p_partkey")
    return agg.best_pixel(p, "data", ["band"], "p_partkey")


@query("A26_coarsen", f"select p_partkey, (x//2)::int as x, (y//2)::int as y, max(data) as top from {PIXELS} group by 1, 2, 3")
def a26(t):
    return t.pixels.groupBy("p_partkey", F.expr("int(x div 2)").alias("x"), F.expr("int(y div 2)").alias("y")).agg(F.max("data").alias("top"))


@query("A33_masked_zonal", f"select p_partkey, sum(data)::bigint as every, coalesce(sum(data) filter (data > 5), 0)::bigint as masked, round(coalesce(sum(data) filter (data > 5), 0)/sum(data), 6) as ratio from {PIXELS} group by 1")
def a33(t):
    masked = F.sum(F.when(F.col("data") > 5, F.col("data")).otherwise(0))
    return t.pixels.groupBy("p_partkey").agg(F.sum("data").alias("every"), masked.alias("masked"), F.round(masked / F.sum("data"), 6).alias("ratio"))


@query("S9_spatial_chunks", f"select {tc(2)} as tile, count(*) as rows from {POINTS} group by 1")
def s9(t):
    return tiles(t, 2).groupBy(F.col("cell").alias("tile")).agg(F.count(F.lit(1)).alias("rows"))


@query("S9_first_tile", f"select n_nationkey, min(cast({3 << 56} as bigint) + x.i * 268435456 + y.i) as tile, count(*) as parts, round(sum((least((x.i + 1)/8e0*360e0 - 180e0, maxx) - greatest(x.i/8e0*360e0 - 180e0, minx))), 6) as width from {BOXES} b, range(8) x(i), range(8) y(i) where x.i between {tx(3, 'minx')} and {tx(3, 'maxx')} and y.i between {ty(3, 'maxy')} and {ty(3, 'miny')} group by 1")
def s9first(t):
    """The first tile that each box meets, and the box clipped to all its tiles."""
    parts = joins.clipped_tiles(t.boxes, 3)
    return parts.groupBy("n_nationkey").agg(F.min("cell").alias("tile"), F.count(F.lit(1)).alias("parts"), F.round(F.sum(F.col("east") - F.col("west")), 6).alias("width"))
