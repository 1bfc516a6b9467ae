"""Columns of 64-bit hexagon ids: from coordinates and back, neighbours, outlines, areas, children.

Functions of coordinates are vectorised over Arrow batches; those that are bit arithmetic stay with Spark's own functions.
A null or non-finite coordinate and a null id give null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import hexgrid
from .geo import EARTH_M, col, h3_base_cell, h3_digit, h3_resolution

#: Base cells with five neighbours.
PENTAGONS = [int(n) for n in np.flatnonzero(hexgrid.grid().pentagon)]


def _known(f: Callable[..., list], *inputs: pd.Series) -> pd.Series:
    """``f`` of the rows without nulls, null elsewhere."""
    ok = np.logical_and.reduce([np.isfinite(x.to_numpy(np.float64, na_value=np.nan)) for x in inputs])
    out = np.full(len(ok), None, object)
    if ok.any():
        found = np.empty(int(ok.sum()), object)
        found[:] = f(*(x[ok].to_numpy() for x in inputs))
        out[ok] = found
    return pd.Series(out)


def cell(lng: str | Column, lat: str | Column, res: int) -> Column:
    """The cell of resolution ``res`` that holds a point, in degrees."""

    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return _known(lambda a, b: hexgrid.cells(a.astype(float), b.astype(float), res).tolist(), x, y)

    return run(col(lng).cast("double"), col(lat).cast("double"))


def centre(h: str | Column) -> Column:
    """struct<lng, lat> of a cell's centre, in degrees."""

    @F.pandas_udf("array<double>")
    def run(cells: pd.Series) -> pd.Series:
        return _whole(lambda ids: list(np.stack(hexgrid.centres(ids), 1)), cells)

    at = run(col(h))
    return F.struct(at[0].alias("lng"), at[1].alias("lat"))


def disk(h: str | Column, k: int) -> Column:
    """array<struct<cell, steps>>: the cells at most ``k`` steps away, ascending."""

    @F.pandas_udf("array<struct<cell: long, steps: int>>")
    def run(cells: pd.Series) -> pd.Series:
        def each(ids: np.ndarray) -> list:
            row, near, far = hexgrid.disks(ids.astype(np.int64), k)
            order = np.lexsort((near, row))
            cuts = np.searchsorted(row[order], np.arange(1, len(ids)))
            rows = [{"cell": c, "steps": s} for c, s in zip(near[order].tolist(), far[order].tolist(), strict=True)]
            return [rows[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True)]

        return _whole(each, cells)

    return run(col(h))


def _whole(f: Callable[[np.ndarray], list], cells: pd.Series) -> pd.Series:
    """``f`` of the ids that are not null."""
    ok = cells.notna().to_numpy()
    out = np.full(len(ok), None, object)
    if ok.any():
        found = np.empty(int(ok.sum()), object)
        found[:] = f(cells[ok].to_numpy(np.int64))
        out[ok] = found
    return pd.Series(out)


def area_km2(h: str | Column) -> Column:
    """Area on the sphere, corners joined by great circles."""

    @F.pandas_udf("double")
    def run(cells: pd.Series) -> pd.Series:
        return _whole(lambda ids: (hexgrid.areas(ids) * (EARTH_M / 1000) ** 2).tolist(), cells).astype(float)

    return run(col(h))


def outline(h: str | Column) -> Column:
    """Corners as array of structs (x, y), counter-clockwise, without those that an icosahedron's edge adds; the longitudes
    of one cell do not jump at the antimeridian, so they may pass 180."""

    def each(ids: np.ndarray) -> list:
        row, x, y = hexgrid.outlines(ids)
        start = np.searchsorted(row, np.arange(len(ids)))
        x = x + 360 * np.round((x[start][row] - x) / 360)
        ends = [*start[1:].tolist(), len(row)]
        return [[{"x": a, "y": b} for a, b in zip(x[i:j].tolist(), y[i:j].tolist(), strict=True)] for i, j in zip(start.tolist(), ends, strict=True)]

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def run(cells: pd.Series) -> pd.Series:
        return _whole(each, cells)

    return run(col(h))


def wkt(h: str | Column) -> Column:
    """Boundary as text."""
    ring = F.transform(outline(h), lambda p: F.format_string("%.6f %.6f", p["x"], p["y"]))
    return F.concat(F.lit("POLYGON (("), F.array_join(F.concat(ring, F.slice(ring, 1, 1)), ", "), F.lit("))"))


def is_pentagon(h: str | Column, res: int | None = None) -> Column:
    """Whether a cell, or with ``res`` its ancestor there, has five neighbours: it lies in the middle of such a base cell."""
    kept = h3_resolution(h) if res is None else F.lit(res)
    # digits of the first ``kept`` resolutions
    digits = F.shiftrightunsigned(F.shiftleft(col(h), 19), 19)
    first = F.call_function("shiftrightunsigned", digits, (15 - kept) * 3)
    return h3_base_cell(h).isin(PENTAGONS) & (first == 0)


def child_position(h: str | Column, res: int) -> Column:
    """Place of a cell's ancestor at ``res`` among the children of that one's parent: its digit, and under a pentagon, which
    has no child of digit 1, one less beyond that."""
    digit = h3_digit(h, res)
    return F.when(is_pentagon(h, res - 1) & (digit > 1), digit - 1).otherwise(digit)


def from_positions(base: str | Column, positions: list[Column]) -> Column:
    """The id of a base cell and the places of its ancestors among their parents' children."""
    res = len(positions)
    out = F.lit((1 << 59) | (res << 52) | ((1 << 3 * (15 - res)) - 1)).bitwiseOR(F.shiftleft(col(base).cast("long"), 45))
    middle = col(base).isin(PENTAGONS)
    for r, p in enumerate(positions, 1):
        digit = F.when(middle & (p > 0), p + 1).otherwise(p)
        out = out.bitwiseOR(F.shiftleft(digit.cast("long"), 3 * (15 - r)))
        middle = middle & (p == 0)
    return out


def children(h: str | Column, res: int) -> Column:
    """array<long>: the seven or six children, of resolution ``res``, of a cell of the resolution before."""
    low = 3 * (15 - res)
    opened = col(h).bitwiseAND(F.lit(~(15 << 52) & ~(7 << low))).bitwiseOR(F.lit(res << 52))
    each = F.array(*[opened.bitwiseOR(F.lit(d << low)) for d in range(7)])
    return F.when(is_pentagon(h), F.array_remove(each, opened.bitwiseOR(F.lit(1 << low)))).otherwise(each)
