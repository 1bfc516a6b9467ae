"""Joins of mixed sizes and crowded places against plain versions."""

import math
import random

from pyspark.sql import functions as F

from gridjobs.functions import geo
from gridjobs.operators import joins

R = random.Random(8)
BOX = "k long, minx double, miny double, maxx double, maxy double"


def mixed(n):
    out = [(-1, -180.0, -90.0, 180.0, 90.0), (-2, 10.0, 10.0, 10.0, 10.0), (-3, 5.0, 5.0, 4.0, 6.0), (-4, 180.0, 90.0, 180.0, 90.0), (-5, -180.0, -90.0, -180.0, 90.0)]
    for i in range(n):
        w, h = 10 ** R.uniform(-6, 2), 10 ** R.uniform(-6, 1.8)
        x, y = R.uniform(-180, 180 - w), R.uniform(-90, 90 - h)
        out.append((i, x, y, x + w, y + h))
    return out


def test_boxes_of_all_sizes(spark):
    boxes = mixed(150)
    points = [(i, R.uniform(-180, 180), R.uniform(-90, 90)) for i in range(300)] + [(1000 + b[0], b[1], b[4]) for b in boxes]
    df = spark.createDataFrame(boxes, BOX)
    stored = joins.stored_boxes(df)
    assert stored.groupBy("k").count().agg(F.max("count")).first()[0] <= 4  # the world too
    got = [(r["i"], r["k"]) for r in joins.box_join(spark.createDataFrame(points, "i long, lng double, lat double"), df).collect()]
    want = {(i, b[0]) for i, x, y in points for b in boxes if b[1] <= x <= b[3] and b[2] <= y <= b[4]}
    assert len(got) == len(set(got)) and set(got) == want
    pairs = [tuple(r) for r in joins.overlap_join(df, "k").collect()]
    real = [b for b in boxes if b[1] <= b[3]]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a[0], b[0]) for a in real for b in real if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    assert joins.box_join(df.select(F.lit(1.0).alias("lng"), F.lit(1.0).alias("lat")), df.limit(0)).count() == 0 == joins.overlap_join(df.limit(0), "k").count()


def test_ranges_of_all_lengths(spark):
    ranges = [(i, a, a + 10 ** R.uniform(-5, 4)) for i in range(200) for a in [R.uniform(-500, 500)]] + [(900, 3.0, 3.0), (901, 5.0, 4.0), (902, None, 4.0), (903, -1e15, 1e15)]
    values = [(i, R.choice([3.0, R.uniform(-500, 500), None, -2.0])) for i in range(200)]
    got = [(r["i"], r["k"]) for r in joins.range_join(spark.createDataFrame(values, "i long, v double"), spark.createDataFrame(ranges, "k long, lo double, hi double"), "v", "lo", "hi").collect()]
    want = {(i, k) for i, v in values for k, a, b in ranges if None not in (v, a, b) and a <= v <= b}
    assert len(got) == len(set(got)) and set(got) == want


def far(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(math.sqrt(min(x, 1.0)))


def crowded(spark, n):
    spot = lambda: R.choice([(2.0, 48.0), (2.0 + R.gauss(0, 1e-3), 48.0 + R.gauss(0, 1e-3)), (R.uniform(-180, 180), R.uniform(-90, 90)), (179.999, 10.0), (-179.999, 10.0), (R.uniform(-180, 180), 89.9)])
    a, b = [(i, *spot()) for i in range(n)], [(i, *spot()) for i in range(n)]
    return a, b, spark.createDataFrame(a, "id long, lng double, lat double"), spark.createDataFrame(b, "other long, r_lng double, r_lat double")


def test_nearest_in_growing_rings(spark, monkeypatch):
    a, b, left, right = crowded(spark, 250)
    for crowd in (2000, 5):
        monkeypatch.setattr(joins, "CROWD", crowd)
        for metres in (40_000.0, 2_000_000.0):
            got = {(r["id"], r["rank"]): (r["other"], r["distance"]) for r in joins.nearest_join(left, right, "id", "other", metres, 3).collect()}
            want = {}
            for i, *p in a:
                near = sorted((d, k) for k, *q in b for d in [far(p, q)] if d <= metres)
                want |= {(i, n): (k, d) for n, (d, k) in enumerate(near[:3], 1)}
            assert got.keys() == want.keys() and all(abs(got[x][1] - want[x][1]) < 1e-3 for x in got)
            assert all(got[x][0] == want[x][0] for x in got if want[x][1] == 0)


def test_existence_and_best_ring(spark):
    a, b, left, right = crowded(spark, 250)
    for metres in (50.0, 30_000.0, 3_000_000.0):
        met = joins.within_reach(right, left, "other", metres)
        got = [r["other"] for r in met.collect()]
        assert len(got) == len(set(got)) and set(got) == {k for k, *q in b if any(far(p, q) <= metres for _, *p in a)}
    assert "LeftSemi" in met._jdf.queryExecution().toString()
    rings = [(100.0, 9), (50_000.0, 4), (1_000_000.0, 1)]
    want = {}
    for k, *q in b:
        d = min(far(p, q) for _, *p in a)
        want |= {k: s for m, s in reversed(rings) if d <= m}
    assert {r["other"]: r["score"] for r in joins.best_ring(right, left, "other", rings).collect()} == want


def test_a_crowd_on_one_spot(spark):
    """Half a million rows on one place on either side: k answers for each, and no task gets their product."""
    n = 500_000
    left = spark.range(n).select(F.col("id"), F.lit(8.5).alias("lng"), F.lit(47.0).alias("lat"))
    right = spark.range(n).select(F.col("id").alias("other"), F.lit(8.5).alias("r_lng"), F.lit(47.0).alias("r_lat"))
    got = joins.nearest_join(left, right, "id", "other", 1000.0, 2)
    assert got.count() == 2 * n and got.agg(F.max("other")).first()[0] == 1
    assert joins.within_reach(right, left, "other", 1000.0).count() == n
