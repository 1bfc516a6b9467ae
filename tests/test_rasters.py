"""Raster steps in tasks of bounded size against plain versions."""

import random

from pyspark.sql import functions as F

from gridjobs.operators import aggregates, rasters
from gridjobs.plans import registry

R = random.Random(5)


def test_best_pixel_without_sorting_pixels(spark):
    rows = [(R.randrange(4), R.randrange(4), R.choice([None, -0.5, 0.25, 0.5]), R.randrange(9), R.choice([None, R.random()]), i if i % 5 else None) for i in range(400)]
    rows += [(9, 9, None, 1, 0.5, 8), (9, 9, None, 2, None, 7), (8, 8, 0.5, 3, 0.1, None), (8, 8, None, 4, 0.2, 1), (7, 7, None, 5, None, None)]
    R.shuffle(rows)
    best = {}
    for r in rows:
        order = (r[2] is None, -(r[2] or 0), r[5] is None, r[5] or 0)
        if r[:2] not in best or order < best[r[:2]][0]:
            best[r[:2]] = (order, r)
    out = aggregates.best_pixel(spark.createDataFrame(rows, "x int, y int, ndvi double, red int, nir double, tie long").repartition(3), "ndvi", ["red", "nir"], "tie")
    assert out.columns == ["x", "y", "ndvi", "red", "nir", "tie"]
    assert {tuple(r)[:2]: tuple(r) for r in out.collect()} == {k: r for k, (_, r) in best.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def exchanges(df):
    """Shuffles of a plan that has not run."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_coarsened_blocks_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(rasters, "TASK_VALUES", 64 * 50)
    grid = rasters.Grid(west=0.0, north=0.0, dx=1.0, dy=1.0, width=8, height=8)
    blocks = [(i % 20, i // 20 % 10, i // 400, [R.choice([None, R.randrange(50)]) for _ in range(64)]) for i in range(1000)] + [(3, 3, 1, [i] * 64) for i in range(9)] + [(None, 1, None, [1] * 64), (1, 1, 1, None)]
    want = {}
    for bx, by, layer, v in blocks:
        for i, x in enumerate(v or []):
            if x is not None:
                want.setdefault((bx, by, layer, i % 8 // 2, i // 8 // 2), []).append(x)
    out = rasters.coarsen(spark.createDataFrame(blocks, "bx long, by long, layer long, v array<int>").coalesce(1), grid, 2, ("layer",))
    assert exchanges(out) == 1
    got = {tuple(r)[:5]: tuple(r)[5:] for r in out.collect()}
    assert got == {k: (max(v), sum(v) / len(v), len(v)) for k, v in want.items()}
    assert len(got) > 6000 and largest_task(out) < 16 * 120


def parts(spark, tmp_path, n):
    spark.range(n).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_pixels_of_one_file_in_bounded_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(rasters, "TASK_VALUES", 64 * 50)
    out = registry.QUERIES["A26_coarsen"](spark, parts(spark, tmp_path, 1000))
    assert exchanges(out) == 1
    want = {}
    for p in range(1000):
        for i in range(64):
            if p * i % 11:
                at = (p, i % 8 // 2, i // 8 // 2)
                want[at] = max(want.get(at, 0), p * i % 11)
    assert {tuple(r)[:3]: r["top"] for r in out.collect()} == want
    assert largest_task(out) < 16 * 120


def test_classes_of_one_file_in_bounded_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(rasters, "TASK_VALUES", 64 * 50)
    out = registry.QUERIES["A24_zonal_classes"](spark, parts(spark, tmp_path, 1000))
    assert exchanges(out) == 1
    want = {}
    for p in range(1000):
        each = [p * i % 11 for i in range(64) if p * i % 11]
        if each:
            want[p] = ",".join(f"{c}:{each.count(c)}" for c in sorted(set(each)))
    assert {r["p_partkey"]: r["classes"] for r in out.collect()} == want
    assert largest_task(out) < 120
