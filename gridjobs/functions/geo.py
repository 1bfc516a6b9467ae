"""Column expressions on coordinates: tiles, hexagon bins, 64-bit hexagon ids, distances, rings."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# tiles of the mercator quad tree; a cell is one long: z in the top bits, then x, then y


def tile_x(lng: str | Column, z: int) -> Column:
    return F.floor((col(lng) + 180.0) / 360.0 * float(1 << z)).cast("long")


def tile_y(lat: str | Column, z: int) -> Column:
    r = F.radians(col(lat))
    return F.floor((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0 * float(1 << z)).cast("long")


def tile_cell(lng: str | Column, lat: str | Column, z: int) -> Column:
    return F.lit(z << 56).bitwiseOR(F.shiftleft(tile_x(lng, z), 28)).bitwiseOR(tile_y(lat, z))


def cell_zoom(cell: str | Column) -> Column:
    return F.shiftrightunsigned(col(cell), 56).cast("int")


def cell_x(cell: str | Column) -> Column:
    return F.shiftrightunsigned(col(cell), 28).bitwiseAND((1 << 28) - 1)


def cell_y(cell: str | Column) -> Column:
    return col(cell).bitwiseAND((1 << 28) - 1)


def cell_of(z: int, x: Column, y: Column) -> Column:
    return F.lit(z << 56).bitwiseOR(F.shiftleft(x.cast("long"), 28)).bitwiseOR(y.cast("long"))


def cell_parent(cell: str | Column, z: int, to: int) -> Column:
    """The cell of zoom ``to`` that holds a cell of zoom ``z``."""
    return cell_of(to, F.shiftright(cell_x(cell), z - to), F.shiftright(cell_y(cell), z - to))


def cell_center(cell: str | Column, z: int) -> tuple[Column, Column]:
    n = float(1 << z)
    lng = (cell_x(cell) + 0.5) / n * 360.0 - 180.0
    return lng, F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * (cell_y(cell) + 0.5) / n))))


def cell_disk(cell: str | Column, z: int, k: int) -> Column:
    """Array of the cells at most k columns and rows away: x wraps around, y ends at the poles."""
    n = 1 << z
    near = [cell_of(z, F.pmod(cell_x(cell) + dx, F.lit(n)), cell_y(cell) + dy) for dx in range(-k, k + 1) for dy in range(-k, k + 1)]
    inside = [(cell_y(cell) + dy >= 0) & (cell_y(cell) + dy < n) for _ in range(-k, k + 1) for dy in range(-k, k + 1)]
    return F.array_compact(F.array(*[F.when(i, c) for i, c in zip(inside, near, strict=True)]))


def cell_area_km2(cell: str | Column, z: int) -> Column:
    """Area on the sphere."""
    n = float(1 << z)
    edge = lambda y: F.sin(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * y / n))))
    return (edge(cell_y(cell)) - edge(cell_y(cell) + 1)) * (2.0 * 3.141592653589793 / n) * (EARTH_M / 1000.0) ** 2


def cell_wkt(cell: str | Column, z: int) -> Column:
    """Boundary as text."""
    n = float(1 << z)
    lng = lambda x: F.format_string("%.6f", x / n * 360.0 - 180.0)
    lat = lambda y: F.format_string("%.6f", F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * y / n)))))
    x, y = cell_x(cell), cell_y(cell)
    corners = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", lng(a), lat(b)) for a, b in corners]), F.lit("))"))


# hexagon bins on the cylindrical equal-area plane, axial coordinates by cube rounding


def hexbin(lng: str | Column, lat: str | Column, size: float) -> tuple[Column, Column]:
    """Axial (q, r) of pointy-top hexagons with edge ``size`` in units of the earth's radius."""
    x, y = F.radians(col(lng)), F.sin(F.radians(col(lat)))
    q, r = (3.0**0.5 / 3.0 * x - y / 3.0) / size, (2.0 / 3.0 * y) / size
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    first, second = (dq > dr) & (dq > ds), dr > ds
    return F.when(first, -rr - rs).otherwise(rq).cast("long"), F.when(~first & second, -rq - rs).otherwise(rr).cast("long")


# 64-bit hexagon ids as they stand in tables: 4 bits mode, 4 resolution, 7 base cell, 15 digits of 3 bits


def h3_resolution(h: str | Column) -> Column:
    return F.shiftrightunsigned(col(h), 52).bitwiseAND(15).cast("int")


def h3_base_cell(h: str | Column) -> Column:
    return F.shiftrightunsigned(col(h), 45).bitwiseAND(127).cast("int")


def h3_digit(h: str | Column, r: int) -> Column:
    return F.shiftrightunsigned(col(h), 3 * (15 - r)).bitwiseAND(7).cast("int")


def h3_parent(h: str | Column, res: int) -> Column:
    """The ancestor at ``res``: resolution bits set, finer digits 7."""
    unused = (1 << 3 * (15 - res)) - 1
    return col(h).bitwiseAND(~(15 << 52)).bitwiseOR(res << 52).bitwiseOR(unused)


def h3_center_child(h: str | Column, of: int, res: int) -> Column:
    """The descendant at ``res`` whose new digits are 0."""
    opened = ((1 << 3 * (15 - of)) - 1) ^ ((1 << 3 * (15 - res)) - 1)
    return col(h).bitwiseAND(~(15 << 52)).bitwiseOR(res << 52).bitwiseAND(~opened)


def h3_from_digits(base: str | Column, digits: list[Column]) -> Column:
    res = len(digits)
    out = F.lit((1 << 59) | (res << 52) | ((1 << 3 * (15 - res)) - 1)).bitwiseOR(F.shiftleft(col(base).cast("long"), 45))
    for r, d in enumerate(digits, 1):
        out = out.bitwiseOR(F.shiftleft(d.cast("long"), 3 * (15 - r)))
    return out


def h3_text(h: str | Column) -> Column:
    return F.lower(F.hex(col(h)))


def h3_number(text: str | Column) -> Column:
    """From hexadecimal text, or decimal text of 17 digits and more."""
    t = col(text)
    return F.when(t.rlike("^[0-9]{17,}$"), t.cast("long")).otherwise(F.conv(t, 16, 10).cast("long"))


# plane and sphere


def haversine_m(lng1: str | Column, lat1: str | Column, lng2: str | Column, lat2: str | Column) -> Column:
    p, q = F.radians(col(lat1)), F.radians(col(lat2))
    a = F.pow(F.sin((q - p) / 2.0), 2.0) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(col(lng2)) - F.radians(col(lng1))) / 2.0), 2.0)
    return F.lit(2.0 * EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_bounds(bounds: tuple[float, float, float, float], lng: str = "lng", lat: str = "lat", closed: bool = True) -> Column:
    """Within [minx, miny, maxx, maxy]; half open unless ``closed``."""
    x, y = F.col(lng), F.col(lat)
    low = (x >= bounds[0]) & (y >= bounds[1])
    return low & ((x <= bounds[2]) & (y <= bounds[3]) if closed else (x < bounds[2]) & (y < bounds[3]))


def in_ring(lng: str, lat: str, ring: str) -> Column:
    """Ray casting against ``ring``: array of structs (x, y), closed or not."""
    return F.expr(
        f"aggregate(sequence(0, size({ring}) - 1), false, (inside, i) -> inside != "
        f"((({ring}[i].y > {lat}) != ({ring}[(i + 1) % size({ring})].y > {lat})) and "
        f"{lng} < ({ring}[(i + 1) % size({ring})].x - {ring}[i].x) * ({lat} - {ring}[i].y) / ({ring}[(i + 1) % size({ring})].y - {ring}[i].y) + {ring}[i].x))"
    )


def ring_area(ring: str) -> Column:
    """Shoelace area in the units of the coordinates squared."""
    return F.expr(f"abs(aggregate(sequence(0, size({ring}) - 1), double(0), (s, i) -> s + {ring}[i].x * {ring}[(i + 1) % size({ring})].y - {ring}[(i + 1) % size({ring})].x * {ring}[i].y)) / 2")


def ring_centroid(ring: str) -> tuple[Column, Column]:
    """Centroid of the area of ``ring``; of a ring without area, the mean of its points."""
    n = f"{ring}[(i + 1) % size({ring})]"
    cross = f"({ring}[i].x * {n}.y - {n}.x * {ring}[i].y)"
    total = lambda e: f"aggregate(sequence(0, size({ring}) - 1), double(0), (s, i) -> s + {e})"
    return tuple(F.expr(f"coalesce({total(f'({ring}[i].{c} + {n}.{c}) * {cross}')} / nullif(3 * {total(cross)}, 0), {total(f'{ring}[i].{c}')} / size({ring}))") for c in "xy")


def ring_bounds(ring: str) -> dict[str, Column]:
    """minx, miny, maxx, maxy of ``ring``."""
    return {f"{how}{c}": F.expr(f"array_{how}(transform({ring}, p -> p.{c}))") for how in ("min", "max") for c in "xy"}


def clip_ring(ring: str | Column, bounds: tuple[float, float, float, float]) -> Column:
    """The part of a ring within [minx, miny, maxx, maxy]: edges are cut at one side after the other, so a convex ring stays
    one, and a ring that falls apart has its parts joined along the side. Without points if the ring is outside."""

    def clipped(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
        for axis, bound, sign in ((0, bounds[0], 1), (0, bounds[2], -1), (1, bounds[1], 1), (1, bounds[3], -1)):
            out = []
            for k, here in enumerate(points):
                before = points[k - 1]
                inside, was = (here[axis] - bound) * sign >= 0, (before[axis] - bound) * sign >= 0
                if inside != was:
                    part = (bound - before[axis]) / (here[axis] - before[axis])
                    cut = [b + (h - b) * part for h, b in zip(here, before, strict=True)]
                    cut[axis] = bound
                    out.append(tuple(cut))
                if inside:
                    out.append(here)
            points = out
        return points

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def run(rings: pd.Series) -> pd.Series:
        return rings.map(lambda r: None if r is None else [{"x": x, "y": y} for x, y in clipped([(p["x"], p["y"]) for p in r])])

    return run(col(ring))


def split_at_antimeridian(minx: str, maxx: str) -> Column:
    """Array of structs (minx, maxx): one, or two where the west edge is over the east edge."""
    return F.expr(f"if({minx} <= {maxx}, array(named_struct('minx', {minx}, 'maxx', {maxx})), array(named_struct('minx', {minx}, 'maxx', 180e0), named_struct('minx', -180e0, 'maxx', {maxx})))")


def raster_chunk(x: str, y: str, width: int, height: int, x_chunks: int, y_chunks: int) -> Column:
    """Number of the chunk, row by row, of a raster's pixel; chunks are as even as can be, the last ones smaller."""
    wide, high = -(-width // x_chunks), -(-height // y_chunks)
    return F.expr(f"int({x} div {wide}) + {x_chunks} * int({y} div {high})")


def h3_valid(h: str | Column) -> Column:
    """Mode 1, a base cell under 122, digits under 7 down to the resolution and 7 below it."""
    h, res = col(h), h3_resolution(h)
    digits = [F.when(F.lit(r) <= res, h3_digit(h, r) < 7).otherwise(h3_digit(h, r) == 7) for r in range(1, 16)]
    good = (F.shiftrightunsigned(h, 59) == 1) & (h3_base_cell(h) < 122)
    for d in digits:
        good = good & d
    return F.coalesce(good, F.lit(False))


def utm_code(lng: str | Column, lat: str | Column) -> Column:
    """Number of the projection of a point's zone: 326 north, 327 south, then the zone."""
    return (F.when(col(lat) >= 0, 32600).otherwise(32700) + utm_zone(lng)).cast("int")


def to_utm(lng: str | Column, lat: str | Column) -> tuple[Column, Column]:
    """Easting and northing in metres in the point's own zone, by the series of the transverse mercator on WGS 84."""
    a, e2, k0 = 6378137.0, 0.006694379990141317, 0.9996
    second = e2 / (1 - e2)
    phi = F.radians(col(lat))
    away = F.radians(col(lng) - (utm_zone(lng) * 6.0 - 183.0))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2.0))
    t, c, w = F.pow(F.tan(phi), 2.0), second * F.pow(F.cos(phi), 2.0), F.cos(phi) * away
    arc = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = 500_000.0 + k0 * n * (w + (1 - t + c) * F.pow(w, 3.0) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * F.pow(w, 5.0) / 120)
    y = k0 * (arc + n * F.tan(phi) * (w * w / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(w, 4.0) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * second) * F.pow(w, 6.0) / 720))
    return x, F.when(col(lat) < 0, 10_000_000.0).otherwise(0.0) + y


def from_utm(x: str | Column, y: str | Column, code: str | Column) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing in the zone of a projection's number, as utm_code() gives it."""
    a, e2, k0 = 6378137.0, 0.006694379990141317, 0.9996
    second, e1 = e2 / (1 - e2), (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    zone, north = col(code) % 100, col(code) < 32700
    arc = (col(y) - F.when(north, 0.0).otherwise(10_000_000.0)) / k0
    mu = arc / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    w = 1 - e2 * F.pow(F.sin(foot), 2.0)
    n, r = a / F.sqrt(w), a * (1 - e2) / F.pow(w, 1.5)
    t, c, d = F.pow(F.tan(foot), 2.0), second * F.pow(F.cos(foot), 2.0), (col(x) - 500_000.0) / (n * k0)
    lat = foot - n * F.tan(foot) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * second) * F.pow(d, 4.0) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * second - 3 * c * c) * F.pow(d, 6.0) / 720)
    away = (d - (1 + 2 * t + c) * F.pow(d, 3.0) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * second + 24 * t * t) * F.pow(d, 5.0) / 120) / F.cos(foot)
    return zone * 6.0 - 183.0 + F.degrees(away), F.degrees(lat)


def from_mercator(x: str | Column, y: str | Column) -> tuple[Column, Column]:
    """Longitude and latitude of metres on the web mercator plane."""
    r = 6378137.0
    return F.degrees(col(x) / r), F.degrees(2.0 * F.atan(F.exp(col(y) / r)) - F.pi() / 2.0)


#: WGS 84: first eccentricity, and the value of authalic() at a pole before it is divided by that.
_E = 0.006694379990141317**0.5
_POLE = 1 + (1 - _E**2) / (2 * _E) * math.log((1 + _E) / (1 - _E))
#: Radius of the sphere that has the ellipsoid's area.
AUTHALIC_M = 6378137.0 * (_POLE / 2) ** 0.5


def authalic(lat: str) -> str:
    """SQL of the sine of the authalic latitude: on a sphere with the ellipsoid's area, zones have the areas that they have there."""
    s = f"sin(radians({lat}))"
    return f"({1 - _E**2!r}D * ({s} / (1 - {_E**2!r}D * {s} * {s}) - ln((1 - {_E!r}D * {s}) / (1 + {_E!r}D * {s})) / {2 * _E!r}D) / {_POLE!r}D)"


def equal_area_ring(ring: str) -> Column:
    """``ring`` on a plane in metres where areas are those on the ellipsoid; ring_area() of it is in square metres. Its edges are
    straight there: parallels and meridians stay what they are, other edges differ from geodesics by their length squared."""
    return F.expr(f"transform({ring}, p -> named_struct('x', radians(p.x) * {AUTHALIC_M!r}D, 'y', {authalic('p.y')} * {AUTHALIC_M!r}D))")


def to_mercator(lng: str | Column, lat: str | Column) -> tuple[Column, Column]:
    """Metres on the web mercator plane."""
    r = 6378137.0
    return F.radians(col(lng)) * r, F.log(F.tan(F.pi() / 4.0 + F.radians(col(lat)) / 2.0)) * r


def utm_zone(lng: str | Column) -> Column:
    return (F.floor((col(lng) + 180.0) / 6.0) + 1).cast("int")
