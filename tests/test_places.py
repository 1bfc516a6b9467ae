"""Joins of many rows on few places: places are met, not rows."""

import math
import random

import pytest

from gridjobs.functions import geo
from gridjobs.operators import joins

R = random.Random(6)
SPOTS = [(R.uniform(-30, 30), R.uniform(-30, 30)) for _ in range(20)] + [(179.99, 1.0), (-179.99, 1.0), (None, 4.0), (3.0, None), (12.0, 89.9)]


def far(a, b):
    if None in (*a, *b):
        return math.inf
    p, q = math.radians(a[1]), math.radians(b[1])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(math.sqrt(min(x, 1.0)))


@pytest.fixture
def crowd(spark, monkeypatch):
    """Rows of either side, and how many rows look for others."""
    a, b = [(i, *R.choice(SPOTS)) for i in range(700)], [(i, *R.choice(SPOTS)) for i in range(700)]
    looked, plain = [], joins.Bands.asked
    monkeypatch.setattr(joins.Bands, "asked", lambda self, df, lng, lat: looked.append(df.count()) or plain(self, df, lng, lat))
    return a, b, spark.createDataFrame(a, "id long, lng double, lat double"), spark.createDataFrame(b, "other long, r_lng double, r_lat double"), looked


def test_reach_by_places(spark, crowd):
    a, b, left, _, looked = crowd
    b = b + [(5, *SPOTS[0]), (None, *SPOTS[1]), (None, *SPOTS[2])]  # a key on two places, rows without key
    right = spark.createDataFrame(b, "other long, r_lng double, r_lat double")
    left, a = left.where("id % 9 = 0"), [r for r in a if r[0] % 9 == 0]
    near = {}
    for k, *q in b:
        near[k] = min(near.get(k, math.inf), min(far(p, q) for _, *p in a))
    got = [r["other"] for r in joins.within_reach(right, left, "other", 300_000.0).collect()]
    assert len(got) == len(set(got)) and set(got) == {k for k, d in near.items() if d <= 300_000}
    rings = [(10.0, 9), (400_000.0, 4), (900_000.0, 1)]
    got = [tuple(r) for r in joins.best_ring(right, left, "other", rings).collect()]
    assert sorted(got, key=repr) == sorted(((k, next(s for m, s in rings if d <= m)) for k, d in near.items() if d <= 900_000), key=repr)
    assert len(looked) == 4 and max(looked) <= len(SPOTS)


@pytest.mark.parametrize("bunch", [64, 3])
def test_pairs_by_places(crowd, monkeypatch, bunch):
    a, b, left, right, looked = crowd
    monkeypatch.setattr(joins, "BUNCH", bunch, raising=False)
    out = joins.distance_join(left.selectExpr("id", "lng", "concat('n', id) as name", "lat"), right, 500_000.0)
    assert out.columns == ["id", "lng", "name", "lat", "other", "r_lng", "r_lat", "distance"]
    got = {(r["id"], r["other"]): r for r in out.collect()}
    want = {(i, k): (*p, *q, far(p, q)) for i, *p in a for k, *q in b if far(p, q) <= 500_000}
    assert out.count() == len(got) and got.keys() == want.keys()
    for k, (*at, d) in want.items():
        r = got[k]
        assert r["name"] == f"n{k[0]}" and [r["lng"], r["lat"], r["r_lng"], r["r_lat"]] == at and abs(r["distance"] - d) < 1e-3
    assert max(looked) <= len(a) / bunch + len(SPOTS)


def test_rounded_pairs(crowd):
    _, _, left, right, _ = crowd
    rough = {(r["id"], r["other"]): r["distance"] for r in joins.distance_join(left, right, 500_000.0, digits=1).collect()}
    fine = {(r["id"], r["other"]): r["distance"] for r in joins.distance_join(left, right, 500_000.0).collect()}
    assert rough.keys() == fine.keys() and all(abs(rough[k] - fine[k]) < 0.0501 and abs(rough[k] * 10 - round(rough[k] * 10)) < 1e-6 for k in fine)
