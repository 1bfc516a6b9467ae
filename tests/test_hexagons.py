"""Hexagon ids: published ones, round trips, neighbours, covers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridjobs.functions import geo, hexagons, hexgrid
from gridjobs.operators import hexagons as hexes


def level(res):
    """All cells of a resolution."""
    ids = hexgrid._pack(np.arange(122), [], 0)
    for r in range(1, res + 1):
        low = 3 * (15 - r)
        opened = (ids & ~(15 << 52) & ~(7 << low)) | (r << 52)
        ids = np.concatenate([opened[~(hexgrid.is_pentagon(ids) & (d == 1))] | (d << low) for d in range(7)])
    return ids


@pytest.mark.parametrize(("lat", "lng", "res", "text"), [(37.7752702151959257, -122.418307270836565, 9, "8928308280fffff"), (37.3615593, -122.0553238, 5, "85283473fffffff"), (40.689167, -74.044444, 10, "8a2a1072b59ffff"), (37.779, -122.418, 7, "872830828ffffff")])
def test_published_ids(lat, lng, res, text):
    assert format(int(hexgrid.cells(np.array([lng]), np.array([lat]), res)[0]), "x") == text


@pytest.mark.parametrize("res", range(6))
def test_every_cell_holds_its_centre(res):
    ids = level(res)
    assert len(np.unique(ids)) == 2 + 120 * 7**res
    assert (hexgrid.cells(*hexgrid.centres(ids), res) == ids).all()


@pytest.mark.parametrize("res", range(6, 16))
def test_base_cells_over_fine_resolutions(res):
    """Middles of the base cells, their neighbours, and random places, to the id and back."""
    x, y = hexgrid.centres(level(1))
    r = np.random.default_rng(res)
    lng, lat = np.concatenate([x, r.uniform(-180, 180, 3000)]), np.concatenate([y, np.degrees(np.arcsin(r.uniform(-1, 1, 3000)))])
    ids = hexgrid.cells(lng, lat, res)
    assert (hexgrid.cells(*hexgrid.centres(ids), res) == ids).all()
    near = hexgrid.neighbours(ids)[1]
    assert (hexgrid.cells(*hexgrid.centres(near), res) == near).all()


@pytest.mark.parametrize("res", range(4))
def test_neighbours_are_mutual(res):
    ids = level(res)
    row, near = hexgrid.neighbours(ids)
    assert (np.bincount(row) == np.where(hexgrid.is_pentagon(ids), 5, 6)).all()
    pairs = set(zip(ids[row].tolist(), near.tolist(), strict=True))
    assert len(pairs) == len(row) and pairs == {(b, a) for a, b in pairs} and all(a != b for a, b in pairs)


def test_disks():
    ids = level(3)
    far = ids[hexgrid.is_pentagon(ids)]
    for k in range(4):
        assert (np.bincount(hexgrid.disks(far, k)[0]) == 1 + 5 * k * (k + 1) // 2).all()
    plain = hexgrid.cells(np.array([10.0, -100.0]), np.array([45.0, 40.0]), 8)
    row, near, steps = hexgrid.disks(plain, 4)
    assert (np.bincount(row) == 1 + 3 * 4 * 5).all() and (np.bincount(steps) == 2 * np.array([1, 6, 12, 18, 24])).all()


def test_areas_add_up_to_the_sphere():
    for res in range(4):
        assert abs(hexgrid.areas(level(res)).sum() / (4 * np.pi) - 1) < 1e-9


def test_columns(spark):
    df = spark.createDataFrame([(2.35, 48.85), (None, 1.0), (float("nan"), 2.0), (180.0, -90.0), (-180.0, 90.0)], "lng double, lat double")
    got = df.withColumn("h", hexagons.cell("lng", "lat", 9)).withColumn("c", hexagons.centre("h")).withColumn("d", F.size(hexagons.disk("h", 2))).withColumn("w", hexagons.wkt("h")).withColumn("a", hexagons.area_km2("h")).collect()
    assert [r["h"] is None for r in got] == [False, True, True, False, False] and got[1]["c"]["lng"] is None and got[1]["w"] is None and got[1]["a"] is None
    assert got[0]["d"] == 19 and 0.05 < got[0]["a"] < 0.2 and got[0]["w"].count(",") == 6
    assert geo.haversine_m is not None and abs(got[0]["c"]["lng"] - 2.35) < 0.01
    assert df.limit(0).select(hexagons.cell("lng", "lat", 3).alias("h")).select(hexagons.centre("h"), hexagons.disk("h", 1)).count() == 0


def test_child_positions(spark):
    ids = level(3)
    df = spark.createDataFrame([(int(i),) for i in ids], "h long").select("h", geo.h3_base_cell("h").alias("base"), *(hexagons.child_position("h", r).alias(f"p{r}") for r in (1, 2, 3)))
    wrong = df.where(hexagons.from_positions("base", [F.col(f"p{r}") for r in (1, 2, 3)]) != F.col("h"))
    assert wrong.count() == 0
    # places count up without a gap
    bad = df.groupBy(geo.h3_parent("h", 2)).agg(F.max("p3").alias("top"), F.count(F.lit(1)).alias("n")).where("top + 1 <> n")
    assert bad.count() == 0
    assert sorted(r["h"] for r in df.where(hexagons.is_pentagon("h")).collect()) == sorted(ids[hexgrid.is_pentagon(ids)].tolist())


def test_cover_tests_every_centre(spark):
    boxes = [(0, -20.0, -10.0, 35.0, 40.0), (1, 170.0, 60.0, -150.0, 80.0), (2, -180.0, 84.0, 180.0, 90.0), (3, 5.0, 5.0, 5.001, 5.001), (4, -75.0, -90.0, -20.0, -60.0)]
    df = spark.createDataFrame(boxes, "k int, minx double, miny double, maxx double, maxy double")
    ids = level(3)
    x, y = hexgrid.centres(ids)
    want = {(k, int(i)) for k, a, b, c, d in boxes for i in ids[((x >= a) & (x <= c) if a <= c else (x >= a) | (x <= c)) & (y >= b) & (y <= d)]}
    got = hexes.descend(df, 3)
    assert {(r["k"], r["cell"]) for r in got.select("k", "cell").collect()} == want
    alone = hexes.bounds_cells(df.where("k = 3"), "k", 3).collect()
    assert [r["cell"] for r in alone] == hexgrid.cells(np.array([5.0005]), np.array([5.0005]), 3).tolist()
    assert hexes.bounds_cells(df.limit(0), "k", 3).count() == 0


def test_smoothing_and_neighbourhood(spark):
    one = int(hexgrid.cells(np.array([10.0]), np.array([45.0]), 5)[0])
    got = hexes.smooth(spark.createDataFrame([(one, 6.0)], "cell long, v double"), 2, "v").collect()
    assert len(got) == 19 and {r["smoothed"] for r in got} == {6.0}
    near = hexes.neighbourhood_join(spark.createDataFrame([(one,)], "center long"), spark.createDataFrame([(int(i), 1) for i in hexgrid.neighbours(np.array([one]))[1]] + [(one, 2)], "cell long, v int"))
    assert near.count() == 7
