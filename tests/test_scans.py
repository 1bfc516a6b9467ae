"""Scans over ranges with hot keys, and statistics of pixels within polygons, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridjobs.operators import rasters, scans

R = random.Random(3)


@pytest.fixture
def many(spark):
    """Ranges stay as many as they are asked for."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def rows(many):
    data = [("hot", i, R.choice([None, None, None, i])) for i in range(900)] + [(f"k{R.randrange(40)}", i, R.choice([None, i])) for i in range(300)] + [(None, i, R.choice([None, i])) for i in range(40)]
    R.shuffle(data)
    df = many.createDataFrame(data, "k string, at long, v long").repartition(5)
    assert scans.ranged(df, "k", "at").select(scans.RANGE).where("k = 'hot'").distinct().count() > 3
    return df, sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def test_sums_and_fills_over_many_ranges(rows):
    df, data = rows
    total, last, sums, back, ahead = {}, {}, {}, {}, {}
    for k, at, v in data:
        total[k] = total.get(k, 0) + (v or 0)
        last[k] = last.get(k) if v is None else v
        sums[k, at], back[k, at] = total[k], last[k]
    last = {}
    for k, at, v in reversed(data):
        last[k] = last.get(k) if v is None else v
        ahead[k, at] = last[k]
    for f, want in ((scans.running_sum, sums), (scans.last_value, back), (scans.next_value, ahead)):
        out = f(df, ["k"], ["at"], "v", "x")
        assert out.columns == ["k", "at", "v", "x"]
        assert {(r["k"], r["at"]): r["x"] for r in out.collect()} == want
        assert f(df.limit(0), ["k"], ["at"], "v", "x").count() == 0


def test_sum_without_keys_and_dense_ids(rows):
    df, data = rows
    numbered = scans.dense_ids(df.where("k = 'hot'"), "at", "n").collect()
    assert sorted((r["at"], r["n"]) for r in numbered) == [(i, i) for i in range(900)]


def test_quantiles_equal_percentile(rows):
    df, _ = rows
    f = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, f))).alias("p")).where("p is not null").collect()}
    got = {r["k"]: r["quantiles"] for r in scans.quantiles(df, ["k"], "v", f).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    same = scans.quantiles(df.withColumn("v", F.lit(4)), ["k"], "v", [0.3]).collect()
    assert {r["quantiles"][0] for r in same} == {4.0}


def inside(ring, x, y):
    odd = False
    for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
            odd = not odd
    return odd


def test_pixels_of_odd_polygons(spark):
    grid = rasters.Grid(west=-10.0, north=10.0, dx=0.25, dy=0.5, width=16, height=5)
    star = [(5 * (1 + k % 2) / 2 * np.cos(k), 5 * (1 + k % 2) / 2 * np.sin(k)) for k in np.arange(0, 6.2, 0.3)]
    rings = {"star": star, "out": [(50.0, 50.0), (60.0, 50.0), (55.0, 60.0)], "over": [(-40.0, -3.0), (40.0, -3.0), (40.0, 3.1), (-40.0, 3.1)], "flat": [(0.0, 0.0), (1.0, 0.0)], "tiny": [(0.01, 0.01), (0.02, 0.01), (0.02, 0.02)], "closed": [(-9.0, 9.0), (-5.0, 9.0), (-5.0, 5.0), (-9.0, 5.0), (-9.0, 9.0)], "bow": [(0.0, 0.0), (8.0, 6.0), (8.0, 0.0), (0.0, 6.0)]}
    zones = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in v]) for k, v in rings.items()] + [("none", None)], "zone string, ring array<struct<x: double, y: double>>")
    value = lambda bx, by, i: None if (bx + by + i) % 7 == 0 else (bx * 31 + by * 17 + i) % 13 / 2
    blocks = [(bx, by, [value(bx, by, i) for i in range(80)]) for bx in range(5) for by in range(8)]
    df = spark.createDataFrame(blocks, "bx long, by long, v array<double>")
    want = {}
    for bx, by, v in blocks:
        for i, x in enumerate(v):
            lng, lat = -10 + (bx * 16 + i % 16 + 0.5) * 0.25, 10 - (by * 5 + i // 16 + 0.5) * 0.5
            for k, ring in rings.items():
                if inside(ring, lng, lat):
                    want.setdefault(k, []).append(x)
    counts = rasters.zone_counts(zones, "zone", df, grid)
    got = {r["zone"]: r for r in rasters.statistics(counts, ["zone"]).collect()}
    assert got.keys() == want.keys() >= {"star", "over", "closed", "bow"}
    for k, r in got.items():
        known = [x for x in want[k] if x is not None]
        assert (r["stats_size"], r["stats_count"], r["stats_min"], r["stats_max"]) == (len(want[k]), len(known), min(known), max(known))
        assert np.allclose([r["stats_sum"], r["stats_mean"], r["stats_std"], r["stats_median"]], [np.sum(known), np.mean(known), np.std(known), np.median(known)])
    assert rasters.statistics(rasters.zone_counts(zones.limit(0), "zone", df, grid), ["zone"]).count() == 0
