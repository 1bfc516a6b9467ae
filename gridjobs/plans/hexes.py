"""Queries on hexagon ids from coordinates, and their SQL, which finds a cell from its place on a face without any id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import geo, hexagons, hexgrid
from ..operators import hexagons as hexes
from .base import BOXES, IDS, POINTS, query

_G = hexgrid.grid()
_row = lambda *x: "(" + ", ".join(repr(v.item() if isinstance(v, np.generic) else v) for v in x) + ")"
FACES = "(values " + ", ".join(_row(f, *map(float, (*_G.centre[f], *_G.towards[f], *_G.across[f]))) for f in range(20)) + ") f(face, cx, cy, cz, ex, ey, ez, nx, ny, nz)"
BASES = "(values " + ", ".join(_row(f, a, b, _G.base[f, a, b], _G.to_home[f, a, b], bool(_G.pentagon[_G.base[f, a, b]]), _G.own_angle[f, a, b], _G.home_angle[f, a, b]) for f in range(20) for a in range(-2, 3) for b in range(-2, 3) if _G.base[f, a, b] >= 0) + ") k(face, a0, b0, base, turn, pent, own, home)"
EDGES = "(values " + ", ".join(_row(f, e, _G.other[f, e], *map(float, (_G.turn[f, e].real, _G.turn[f, e].imag, _G.shift[f, e].real, _G.shift[f, e].imag))) for f in range(20) for e in range(3)) + ") g(face, edge, other, tr, ti, sr, si)"
_div = lambda x: f"((2 * ({x}) + 7 + 14000000000) // 14 - 1000000000)"
H = 3**0.5 / 2


def cell_sql(source: str, res: int, key: str) -> str:
    """Rows of ``source`` (key, lng, lat) with h, the cell of resolution ``res``, and clng, clat, its centre."""
    s = hexgrid.scale(res)
    n = s.real**2 + s.imag**2
    out = f"""(with recursive_free as (select *, cos(radians(lat))*cos(radians(lng)) as px, cos(radians(lat))*sin(radians(lng)) as py, sin(radians(lat)) as pz from {source}),
 faced as (select {key}, arg_max(face, cx*px + cy*py + cz*pz) as face from recursive_free, {FACES} group by 1),
 flat as (select p.*, f.*, (px*ex + py*ey + pz*ez)/(px*cx + py*cy + pz*cz)/{hexgrid.UNIT!r} as u, (px*nx + py*ny + pz*nz)/(px*cx + py*cy + pz*cz)/{hexgrid.UNIT!r} as v from recursive_free p join faced using ({key}) join {FACES} using (face)),
 wide as (select *, u*({s.real!r}) - v*({s.imag!r}) as zr, u*({s.imag!r}) + v*({s.real!r}) as zi from flat),
 tried as (select *, floor(zr + zi/{2 * H!r})::bigint + i.i as a, floor(zi/{H!r})::bigint + j.j as b from wide, range(2) i(i), range(2) j(j)),
 c{res} as (select * exclude (a, b), arg_min(a, (zr - a + b/2e0)*(zr - a + b/2e0) + (zi - b*{H!r})*(zi - b*{H!r})) over w as ca, arg_min(b, (zr - a + b/2e0)*(zr - a + b/2e0) + (zi - b*{H!r})*(zi - b*{H!r})) over w as cb from tried window w as (partition by {key})),
 d{res} as (select distinct * exclude (i, j), ca as a, cb as b from c{res}),"""
    for r in range(res, 0, -1):
        p, q = (_div("3*a - b"), _div("a + 2*b")) if r % 2 else (_div("2*a + b"), _div("3*b - a"))
        x, y = ("2*p + q", "3*q - p") if r % 2 else ("3*p - q", "p + 2*q")
        out += f"""
 e{r} as (select *, {p} as p, {q} as q from d{r}), g{r} as (select *, a - ({x}) as da, b - ({y}) as db from e{r}),
 d{r - 1} as (select * exclude (a, b, p, q, da, db), p as a, q as b, [5, 4, -1, 6, 7, 3, -1, 1, 2][(da + 1)*3 + db + 2] - 1 as m{r} from g{r}),"""
    lead = "coalesce(" + "".join(f"nullif(m{r}, 6), " for r in range(1, res + 1)) + "6)"
    digits = " + ".join([f"([4, 6, 2, 3, 1, 5, 0][(case when m{r} = 6 then 6 else (m{r} + steps + 12) % 6 end) + 1]::bigint << {3 * (15 - r)})" for r in range(1, res + 1)] or ["0"])
    order = lambda x: f"(list_position([3, 5, 0, 1, 2], {x}) - 1)"
    return (
        out
        + f"""
 based as (select * from d0 join {BASES} on d0.face = k.face and d0.a = k.a0 and d0.b = k.b0), led as (select *, {lead} as lead, case when {lead} <> 4 then 0 when own = 3 then 1 else -1 end as off from based),
 turned as (select *, case when not pent then turn when lead = 6 then 0 else off + [3, 5, 0, 1, 2][({order('(lead + off + 6) % 6')} + {order('home')} - {order('own')} + 5) % 5 + 1] - (lead + off + 6) % 6 end as steps from led),
 placed as (select *, ((ca - cb/2e0)*({s.real!r}) + cb*{H!r}*({s.imag!r}))/{n!r} as x, (cb*{H!r}*({s.real!r}) - (ca - cb/2e0)*({s.imag!r}))/{n!r} as y from turned),
 past as (select * exclude (cx, cy, cz, ex, ey, ez, nx, ny, nz), list_position([x/2 + y*{H!r}, -x, x/2 - y*{H!r}], list_max([x/2 + y*{H!r}, -x, x/2 - y*{H!r}])) - 1 as far, list_max([x/2 + y*{H!r}, -x, x/2 - y*{H!r}]) > 1.000000001e0 as over from placed),
 folded as (select past.* exclude (x, y, face), case when over then other else past.face end as face, case when over then x*tr - y*ti + sr else x end as x, case when over then x*ti + y*tr + si else y end as y from past join {EDGES} on g.face = past.face and g.edge = far),
 spot as (select *, cx + {hexgrid.UNIT!r}*(x*ex + y*nx) as sx, cy + {hexgrid.UNIT!r}*(x*ey + y*ny) as sy, cz + {hexgrid.UNIT!r}*(x*ez + y*nz) as sz from folded join {FACES} using (face))
 select {key}, lng, lat, cast({(1 << 59) | (res << 52) | ((1 << 3 * (15 - res)) - 1)} as bigint) + (base::bigint << 45) + {digits} as h, degrees(atan2(sy, sx)) as clng, degrees(atan2(sz, sqrt(sx*sx + sy*sy))) as clat from spot)"""
    )


EVENTS = f"(select event_id, lng, lat from {POINTS})"


def placed(t, res):
    return t.points.withColumn("h", hexagons.cell("lng", "lat", res))


@query("G1_hex_cell", f"select event_id, h from {cell_sql(EVENTS, 7, 'event_id')}")
def g1(t):
    """Hexagon ids of resolution 7."""
    return placed(t, 7).select("event_id", "h")


@query("G2_hex_centre", f"select event_id, round(clng, 7) as lng, round(clat, 7) as lat from {cell_sql(EVENTS, 6, 'event_id')}")
def g2(t):
    """Centres of the cells of resolution 6, from their ids."""
    return placed(t, 6).select("event_id", hexagons.centre("h").alias("c")).select("event_id", F.round("c.lng", 7).alias("lng"), F.round("c.lat", 7).alias("lat"))


_HAV = "2e0*asin(sqrt(least(1e0, pow(sin((radians(b.clat) - radians(a.clat))/2e0), 2) + cos(radians(a.clat))*cos(radians(b.clat))*pow(sin((radians(b.clng) - radians(a.clng))/2e0), 2))))"
_MID = f"(select h, any_value(clng) as clng, any_value(clat) as clat from {cell_sql(EVENTS, 3, 'event_id')} group by 1)"
# neighbours are nearer than 1.2 times the distance that two cells have across the direction to their face's centre
_LOCAL = f"(select h, clng, clat, {hexgrid.UNIT / 7**1.5!r} * max(cx*cos(radians(clat))*cos(radians(clng)) + cy*cos(radians(clat))*sin(radians(clng)) + cz*sin(radians(clat))) as unit from {_MID}, {FACES} group by all)"


@query("G7_hex_disk", f"with c as {_LOCAL} select a.h as cell, b.h as near, (case when a.h = b.h then 0 else 1 end)::int as steps from c a join c b on abs(a.clat - b.clat) < 2 and {_HAV} < 1.2e0 * a.unit")
def g7(t):
    """Neighbours of the cells of resolution 3 that hold events, among these cells."""
    held = placed(t, 3).select(F.col("h").alias("cell")).distinct()
    near = held.select("cell", F.explode(hexagons.disk("cell", 1)).alias("n")).select("cell", F.col("n.cell").alias("near"), F.col("n.steps").alias("steps"))
    return near.join(held.select(F.col("cell").alias("near")), "near", "left_semi").select("cell", "near", "steps")


@query("A11_hex_smooth", f"with c as {_LOCAL}, v as (select h, avg(user_id)::double as v from {cell_sql(EVENTS, 3, 'event_id')} join events using (event_id) group by 1) select a.h as cell, round(avg(v.v), 6) as smoothed from c a join c b on abs(a.clat - b.clat) < 2 and {_HAV} < 1.2e0 * a.unit join v on v.h = b.h group by 1")
def a11(t):
    """Mean of the neighbourhood of the cells that hold events."""
    base = placed(t, 3).groupBy(F.col("h").alias("cell")).agg(F.avg("user_id").alias("v"))
    return hexes.smooth(base, 1, "v").join(base.select("cell"), "cell", "left_semi").withColumn("smoothed", F.round("smoothed", 6))


# places so close that every cell of resolution 3 about the boxes has one
_SAMPLES = f"(select n_nationkey, minx, miny, maxx, maxy, (n_nationkey*53 + i.i)*45 + j.j as k, minx - 1.5e0 + i.i*0.25e0 as lng, miny - 1.5e0 + j.j*0.25e0 as lat from {BOXES}, range(53) i(i), range(45) j(j))"
_RING = "clat > miny and clat < maxy and clng > minx + 2.5e0*abs(clat - miny - 4)/4 and clng < maxx - 2.5e0*abs(clat - miny - 4)/4"
_AROUND = f"(select n_nationkey, minx, miny, maxx, maxy, h, clng, clat from {cell_sql(_SAMPLES, 3, 'k')} join {_SAMPLES} using (k))"


def _distinct(where: str) -> str:
    return f"select distinct n_nationkey, h as cell from {_AROUND} where {where}"


@query("G8_hex_cover", f"with c as ({_distinct(_RING)}) select n_nationkey, cell, count(*) over (partition by n_nationkey) as cell_count from c")
def g8(t):
    """Cells of resolution 3 whose centre is in each nation's ring."""
    return hexes.cover(t.boxes, "n_nationkey", 3).select("n_nationkey", "cell", "cell_count")


_CENTRES = f"(select n_nationkey, minx + 5e0 as lng, miny + 4e0 as lat from {BOXES})"
_COARSE = f"(select n_nationkey, minx, miny, maxx, maxy, h, clng, clat from {cell_sql(_SAMPLES, 1, 'k')} join {_SAMPLES} using (k))"


@query("G8_hex_cover_or_centre", f"with c as (select distinct n_nationkey, h as cell from {_COARSE} where {_RING}) select n_nationkey, cell, false as fallback from c union all select n_nationkey, h, true from {cell_sql(_CENTRES, 1, 'n_nationkey')} where n_nationkey not in (select n_nationkey from c)")
def g8coarse(t):
    """Cells of resolution 1: few rings hold a centre, the others get the cell of their own middle."""
    return hexes.cover(t.boxes, "n_nationkey", 1).select("n_nationkey", "cell", "fallback")


@query("G9_hex_bounds", f"with c as (select distinct n_nationkey, h as cell from {_COARSE} where clng between minx and maxx and clat between miny and maxy) select n_nationkey, cell from c union all select n_nationkey, h from {cell_sql(_CENTRES, 1, 'n_nationkey')} where n_nationkey not in (select n_nationkey from c)")
def g9(t):
    """Cells whose centre is in each nation's box, or else the one of its middle."""
    return hexes.bounds_cells(t.boxes, "n_nationkey", 1).select("n_nationkey", "cell")


@query("A1_hex_counts", f"select h as cell, count(*) as cnt from {cell_sql(EVENTS, 2, 'event_id')} group by 1 having count(*) >= 2")
def a1(t):
    return placed(t, 2).groupBy(F.col("h").alias("cell")).agg(F.count(F.lit(1)).alias("cnt")).where("cnt >= 2")


@query("A31_hex_levels", " union all ".join(f"select {r} as res, h as cell, count(*) as cnt from {cell_sql(EVENTS, 4, 'event_id') if r == 4 else '(select ((h & ~(cast(15 as bigint) << 52)) | (cast(' + str(r) + ' as bigint) << 52)) | ' + str((1 << 3 * (15 - r)) - 1) + ' as h from ' + cell_sql(EVENTS, 4, 'event_id') + ')'} group by 1, 2" for r in (4, 3, 2)))
def a31(t):
    """Counts at three resolutions, the coarser ones from the finest one's counts."""
    finest = placed(t, 4).groupBy(F.col("h").alias("cell")).agg(F.count(F.lit(1)).alias("cnt"))
    levels = F.explode(F.array(*[F.struct(F.lit(r).alias("res"), geo.h3_parent("cell", r).alias("cell")) for r in (4, 3, 2)])).alias("l")
    return finest.select(levels, "cnt").groupBy("l.res", "l.cell").agg(F.sum("cnt").alias("cnt"))


@query("G14_hex_area", "select cast(0 as int) as res, cast(122 as bigint) as cells, round(4e0*pi()*6371.0088e0*6371.0088e0, 1) as km2 union all select 1, 842, round(4e0*pi()*6371.0088e0*6371.0088e0, 1) union all select 2, 5882, round(4e0*pi()*6371.0088e0*6371.0088e0, 1)")
def g14(t):
    """Areas of all cells of three resolutions, which add up to that of the sphere."""
    world = t.region.agg(F.min("r_regionkey").alias("k")).select(F.lit(-180.0).alias("minx"), F.lit(-90.0).alias("miny"), F.lit(180.0).alias("maxx"), F.lit(90.0).alias("maxy"))
    every = [hexes.descend(world, r).select(F.lit(r).alias("res"), hexagons.area_km2("cell").alias("km2")) for r in (0, 1, 2)]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("res").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("km2"), 1).alias("km2"))


_PENT = ", ".join(map(str, hexagons.PENTAGONS))
_pos = lambda r: f"case when ((h >> 45) & 127) in ({_PENT}) and ((h >> {3 * (16 - r)}) & {(1 << 3 * (r - 1)) - 1}) = 0 and ((h >> {3 * (15 - r)}) & 7) > 1 then ((h >> {3 * (15 - r)}) & 7) - 1 else (h >> {3 * (15 - r)}) & 7 end"


@query("G5_child_positions", f"select event_id, cast({_pos(1)} as int) as pos1, cast({_pos(2)} as int) as pos2, cast({_pos(5)} as int) as pos5, h as back from {IDS} where not (((h >> 45) & 127) in ({_PENT}) and (((h >> 42) & 7) = 1 or (((h >> 42) & 7) = 0 and (((h >> 39) & 7) = 1 or (((h >> 39) & 7) = 0 and ((h >> 36) & 7) <= 1)))))")
def g5(t):
    """Places among a parent's children, which under a pentagon skip a digit, and the id made of them again; ids that cannot be
    are left out, as are those that are in a pentagon's middle for three resolutions."""
    first = [geo.h3_digit("h", r) for r in (1, 2, 3)]
    middle = geo.h3_base_cell("h").isin(hexagons.PENTAGONS)
    odd = middle & ((first[0] == 1) | ((first[0] == 0) & ((first[1] == 1) | ((first[1] == 0) & (first[2] <= 1)))))
    d = t.ids.where(~odd).select("event_id", "h", geo.h3_base_cell("h").alias("base"), *(hexagons.child_position("h", r).alias(f"pos{r}") for r in range(1, 10)))
    return d.select("event_id", "pos1", "pos2", "pos5", hexagons.from_positions("base", [F.col(f"pos{r}") for r in range(1, 10)]).alias("back"))


@query("G16_hex_wkt", f"select event_id, 1 + 6 as points, true as around from {EVENTS}")
def g16(t):
    """Boundary text of each event's cell: how many points it has, and whether they lie around the event."""
    ring = placed(t, 8).select("event_id", "lng", "lat", hexagons.outline("h").alias("ring"), hexagons.wkt("h").alias("wkt"))
    near = ring.withColumn("lng", F.expr("lng + 360 * round((ring[0].x - lng) / 360)"))
    return near.select("event_id", F.size(F.split("wkt", ",")).alias("points"), geo.in_ring("lng", "lat", "ring").alias("around"))
