"""Round trips, invariants and plans."""

import math
import os
import random

from pyspark.sql import functions as F

from gridjobs.functions import geo, shapes
from gridjobs.operators import aggregates, joins, models, scans
from gridjobs.plans import registry
from gridjobs.sources import files
from gridjobs.streaming import jobs


def points(spark, n, seed, lng="lng", lat="lat", key="id"):
    r = random.Random(seed)
    return spark.createDataFrame([(i, r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-1, 1)))) for i in range(n)], f"{key} long, {lng} double, {lat} double")


def test_distance_join_equals_brute_force_at_poles_and_date_line(spark):
    a, b = points(spark, 300, 1), points(spark, 300, 2, "r_lng", "r_lat", "other")
    for metres in (300_000.0, 1_500_000.0):
        d = geo.haversine_m("lng", "lat", "r_lng", "r_lat")
        want = {(r["id"], r["other"]) for r in a.crossJoin(b).where(d <= metres).collect()}
        met = joins.distance_join(a, b, metres)
        found = [(r["id"], r["other"]) for r in met.collect()]
        assert len(found) == len(set(found)) and set(found) == want
        assert "Cartesian" not in met._jdf.queryExecution().toString() and "NestedLoop" not in met._jdf.queryExecution().toString()


def test_tile_round_trip_and_parent(spark):
    p = points(spark, 500, 3).where("abs(lat) < 84").withColumn("cell", geo.tile_cell("lng", "lat", 9))
    x, y = geo.cell_center("cell", 9)
    back = p.withColumn("again", geo.tile_cell(x, y, 9))
    assert back.where("again <> cell").count() == 0
    assert p.where(geo.cell_parent("cell", 9, 5) != geo.tile_cell("lng", "lat", 5)).count() == 0


def test_hexbin_center_is_nearest(spark):
    q, r = geo.hexbin("lng", "lat", 0.1)
    p = points(spark, 500, 4).withColumn("q", q).withColumn("r", r)
    x, y = F.radians("lng"), F.sin(F.radians("lat"))
    far = F.sqrt(F.pow(x - 0.1 * 3**0.5 * (F.col("q") + F.col("r") / 2), 2.0) + F.pow(y - 0.15 * F.col("r"), 2.0))
    assert p.where(far > 0.1 + 1e-9).count() == 0


def test_csv_and_features_round_trip(spark):
    rows = [(4, "Öre 'x', y", 0.5), (17, None, -2.25), (23, "tab\there", None)]
    df = spark.createDataFrame(rows, "id long, name string, value double")
    path = files.workspace(spark, "t")
    df.write.mode("overwrite").csv(path, header=True)
    assert sorted(map(tuple, files.read_delimited(spark, path, "id long, name string, value double").collect())) == rows
    path = files.workspace(spark, "f")
    spark.createDataFrame([('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"level":null},"geometry":{"type":"Point","coordinates":[5.25,-61.5]}},{"type":"Feature","properties":{"level":8},"geometry":{"type":"Point","coordinates":[0,1]}}]}',)], "value string").write.text(path)
    assert [tuple(r) for r in files.read_features(spark, path, "level: int").collect()] == [(None, 5.25, -61.5), (8, 0.0, 1.0)]


def test_bounds_read_prunes_partitions(spark):
    path = files.workspace(spark, "geo")
    files.write_geo(points(spark, 400, 5).where("abs(lat) < 84"), path)
    df = files.read_geo(spark, path, (0.0, 0.0, 20.0, 20.0))
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "file_cell" in plan.split("PartitionFilters", 1)[1]
    assert df.count() == points(spark, 400, 5).where("lng between 0 and 20 and lat between 0 and 20").count()


def test_points_along_odd_lines(spark):
    df = spark.sql("select 1 as id, array(named_struct('x', 2d, 'y', 3d)) as line union all select 2, array(named_struct('x', 0d, 'y', 0d), named_struct('x', 0d, 'y', 0d), named_struct('x', 4d, 'y', 0d), named_struct('x', 4d, 'y', 0d))")
    found = sorted((r["id"], r["k"], r["x"], r["y"]) for r in shapes.points_along(df, "line", 2.0).collect())
    assert found == [(1, 0, 2.0, 3.0), (2, 0, 0.0, 0.0), (2, 1, 2.0, 0.0), (2, 2, 4.0, 0.0)]


def test_line_text(spark):
    df = spark.createDataFrame([("LINESTRING (1 2, -3.5 4e1)",), ("LINESTRING EMPTY",), ("--",), (None,)], "wkt string").withColumn("parts", shapes.line_parts("wkt"))
    found = [r["parts"] for r in df.collect()]
    assert [[(p["x"], p["y"]) for p in part] for part in found[0]] == [[(1.0, 2.0), (-3.5, 40.0)]] and found[1:] == [[], [], []]
    assert df.where("size(parts) > 0").select(shapes.line_wkt("parts[0]", 1)).first()[0] == "LINESTRING (1.0 2.0, -3.5 40.0)"


def test_random_points_lie_in_their_boxes(spark):
    boxes = spark.createDataFrame([(-10.0, 5.0, 10.0, 6.0)], "minx double, miny double, maxx double, maxy double")
    found = shapes.random_points(boxes, 100, 3).collect()
    assert len(found) == 100 and all(-10 <= r["lng"] < 10 and 5 <= r["lat"] < 6 for r in found) and len({r["lng"] for r in found}) > 90


def test_address_bits(spark):
    import ipaddress

    texts = ["::", "::1", "2001:db8::ff00:42:8329", "1:2:3:4:5:6:7:8", "fe80::"]
    found = spark.createDataFrame([(x,) for x in texts], "ip string").select("ip", shapes.address_bits("ip").alias("b")).collect()
    assert all(int(r["b"], 2) == int(ipaddress.ip_address(r["ip"])) and len(r["b"]) == 128 for r in found)


def test_whole_texts_of_a_hot_source(spark, tmp_path):
    docs = spark.range(2000).select(F.lit("x" * 50).alias("text"), F.when(F.col("id") % 100 == 0, "007").otherwise("hot").alias("source"))
    found = files.whole_texts(docs, f"file://{tmp_path}/text", 100).select("source", F.replace("value", F.lit("\x01"), F.lit("")).alias("value")).collect()
    assert max(len(r["value"]) for r in found) <= 100 * 50
    assert sum(len(r["value"]) for r in found) == 2000 * 50 and {r["source"] for r in found} == {"007", "hot"}


def test_cosine_top_k_of_many_queries(spark, monkeypatch):
    """Every id divisible by 50 against brute force, over several blocks of either side."""
    monkeypatch.setattr(models, "VECTOR_BLOCK", 100)
    monkeypatch.setattr(models, "QUERY_BLOCK", 4)
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(500)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    found = {(x["query_id"], x["rank"]): x["vec_id"] for x in models.cosine_top_k(v, v.where("vec_id % 50 = 0"), 3).collect()}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    assert len(found) == 30
    for q in range(0, 500, 50):
        best = sorted(range(500), key=lambda i: (-cosine(rows[q][1], rows[i][1]), i))[:3]
        assert [found[q, k] for k in (1, 2, 3)] == best


def test_composite_keeps_no_lists(spark):
    r = random.Random(5)
    rows = [(r.randrange(3), r.randrange(2), r.randrange(10)) for _ in range(2000)] + [(9, 9, 4), (8, 8, 7), (8, 8, 2)]
    found = {(x["x"], x["y"]): (x["median"], x["greenest"]) for x in aggregates.composite(spark.createDataFrame(rows, "x int, y int, data int"), "data").collect()}
    for at in {row[:2] for row in rows}:
        values = sorted(v for *xy, v in rows if tuple(xy) == at)
        assert found[at] == (values[len(values) // 2], values[-1])
    plan = registry.QUERIES["A25_composite"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_rank_correlation_in_key_ranges(spark):
    """Equal to ranks by sorting, with ties; no window holds more than a range of a column."""
    r = random.Random(6)
    rows = [(float(r.randrange(300)), float(r.randrange(10**6))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double")

    def ranks(values):
        at = {}
        for i, v in enumerate(sorted(values), 1):
            at.setdefault(v, []).append(i)
        return [sum(at[v]) / len(at[v]) for v in values]

    a, b = (ranks(x) for x in zip(*rows, strict=True))
    mean = (len(rows) + 1) / 2
    cov = lambda x, y: sum((i - mean) * (j - mean) for i, j in zip(x, y, strict=True))
    found = aggregates.correlations(df, ["a", "b"], ranks=True)
    assert abs(found.where("x = 'a' and y = 'b'").first()["r"] - cov(a, b) / math.sqrt(cov(a, a) * cov(b, b))) < 1e-9
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert windows and all(" part#" in line for line in windows)


def test_content_hash_counts_equal_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (2,)], "a long")
    other = spark.createDataFrame([(3,), (3,), (4,), (4,)], "a long")
    h = lambda d: files.content_hash(d).first()["hash"]
    assert h(df) == h(df.repartition(3)) != h(other) and h(df.limit(0)) == 0
    base = files.workspace(spark, "once")
    path, new = files.write_once(df, base, "a")
    assert new and files.write_once(df.repartition(2), base, "a") == (path, False) and files.write_once(other, base, "a")[1]


def test_latest_state_after_restart(spark):
    base = files.workspace(spark, "latest")
    source = spark.createDataFrame([], "k long, at long")
    source.write.parquet(f"{base}/in")

    def run():
        stream = jobs.read_stream(spark, f"{base}/in", "k long, at long")
        return sorted(map(tuple, jobs.run_latest(stream, "k", "at", f"{base}/state", f"{base}/ck").collect()))

    assert run() == []
    for rows, want in (([(1, 1)], [(1, 1)]), ([(1, 2), (2, 1)], [(1, 2), (2, 1)]), ([(1, 0)], [(1, 2), (2, 1)])):
        spark.createDataFrame(rows, "k long, at long").coalesce(1).write.mode("append").parquet(f"{base}/in")
        assert run() == want
        assert run() == want  # with no new file


def test_latest_state_rewrites_touched_buckets_only(spark):
    base = files.workspace(spark, "many")
    names = lambda p: sorted(x for _, d, _ in os.walk(p.removeprefix("file://")) for x in d if x.startswith("bucket="))

    def run(rows):
        spark.createDataFrame(rows, "k long, at long, v string").coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = jobs.read_stream(spark, f"{base}/in", "k long, at long, v string")
        return {r["k"]: (r["at"], r["v"]) for r in jobs.run_latest(stream, "k", "at", f"{base}/state", f"{base}/ck", buckets=64).collect()}

    want = {k: (1, "a") for k in range(500)}
    assert run([(k, 1, "a") for k in range(500)]) == want
    assert len(names(f"{base}/state/v0")) == 64
    want |= {3: (2, "b"), 700: (0, "n"), None: (5, "z")}
    assert run([(3, 2, "b"), (4, 0, "old"), (700, 0, "n"), (None, 5, "z"), (None, 4, None)]) == want
    assert len(names(f"{base}/state/v1")) <= 4
    want[3] = (3, None)
    assert run([(3, 3, None)]) == want
    assert len(names(f"{base}/state/v2")) == 1
    left = len(names(f"{base}/state"))
    assert left <= 64 + 4 + 1  # the last two lists and no more


def test_equal_area_and_inverse_projections(spark):
    octant = "array(named_struct('x', 0d, 'y', 0d), named_struct('x', 90d, 'y', 0d), named_struct('x', 90d, 'y', 90d), named_struct('x', 0d, 'y', 90d))"
    world = "array(named_struct('x', -180d, 'y', -90d), named_struct('x', 180d, 'y', -90d), named_struct('x', 180d, 'y', 90d), named_struct('x', -180d, 'y', 90d))"
    df = spark.sql(f"select {octant} as ring union all select {world}").withColumn("plane", geo.equal_area_ring("ring"))
    a, b = sorted(r[0] for r in df.select(geo.ring_area("plane") / 1e12).collect())
    assert abs(b - 510.0656217) < 1e-5 and abs(a * 8 - b) < 1e-9  # the ellipsoid's area in million square kilometres
    p = points(spark, 800, 9).where("abs(lat) < 80")
    (e, n), (x, y) = geo.to_utm("lng", "lat"), geo.to_mercator("lng", "lat")
    q = p.select("lng", "lat", e.alias("e"), n.alias("n"), geo.utm_code("lng", "lat").alias("c"), x.alias("x"), y.alias("y"))
    for back, most in ((geo.from_utm("e", "n", "c"), 1e-8), (geo.from_mercator("x", "y"), 1e-10)):
        off = q.select(F.max(F.abs(back[0] - F.col("lng")) * F.cos(F.radians("lat"))), F.max(F.abs(back[1] - F.col("lat")))).first()
        assert max(off) < most  # a millimetre and less


def test_dense_ids_and_forecast(spark):
    df = spark.range(0, 900, 3).withColumnRenamed("id", "k")
    assert sorted(map(tuple, scans.dense_ids(df, "k", "n").collect())) == [(3 * i, i) for i in range(300)]
    assert scans.dense_ids(df.limit(0), "k", "n").count() == 0
    cube = spark.createDataFrame([("a", x, float(x**3 - 4 * x)) for x in range(1, 30)] + [("b", x, 5.0) for x in range(9)], "s string, x long, y double")
    found = {(r["s"], r["step"]): (r["value"], r["signal"]) for r in models.forecast(cube, "s", "x", "y").collect()}
    assert all(abs(found["a", k][0] - ((29 + k) ** 3 - 4 * (29 + k))) < 1e-3 and found["a", k][1] == "BUY" for k in range(1, 8))
    assert all(abs(found["b", k][0] - 5) < 1e-9 and found["b", k][1] == "HOLD" for k in range(1, 8))


def test_zoom_follows_the_boxes(spark):
    boxes = lambda w: spark.createDataFrame([(i, float(i), 0.0, i + w, w / 2) for i in range(20)], "k long, minx double, miny double, maxx double, maxy double")
    assert joins.levels_of(boxes(45.0)) == [3] and joins.levels_of(boxes(0.01)) == [15] and joins.levels_of(boxes(1.0).limit(0)) == []
    b = boxes(1.0)
    want = {(i, j) for i in range(20) for j in range(i + 1, 20) if j <= i + 1}
    assert {tuple(r) for r in joins.overlap_join(b, "k").collect()} == want and joins.overlap_join(b, "k").count() == len(want)
    assert joins.clipped_tiles(b, 6).where("west > east + 1e-9 or south > north + 1e-9").count() == 0


def test_plans_keep_few_rows(spark):
    """The k nearest are kept before the shuffle; a key's files are told apart by their statistics."""
    sf = "/root/testdata/sf0.001"
    plan = lambda name: registry.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan("J11_nearest_join") and "Partial" in plan("J11_nearest_join")
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,46)]" in plan("SRC9_key_ranges")
    assert "CartesianProduct" not in plan("J18_overlap_join") and "BroadcastNestedLoop" not in plan("J18_overlap_join")


def test_projections(spark):
    """A point on a central meridian, and codes of both hemispheres."""
    df = spark.createDataFrame([(3.0, 0.0), (9.0, 45.0), (-75.5, -33.25)], "lng double, lat double")
    x, y = geo.to_utm("lng", "lat")
    rows = df.select(x.alias("x"), y.alias("y"), geo.utm_code("lng", "lat").alias("c")).collect()
    assert abs(rows[0]["x"] - 500_000) < 1e-6 and abs(rows[0]["y"]) < 1e-6 and abs(rows[1]["y"] - 4_982_950.4) < 0.1
    assert [r["c"] for r in rows] == [32631, 32632, 32718]


def test_database_reader_pushes_the_limit(spark):
    url = "jdbc:derby:memory:shop;create=true"
    spark.range(50).withColumnRenamed("id", "n").write.format("jdbc").options(url=url, dbtable="ITEMS", driver="org.apache.derby.jdbc.EmbeddedDriver").mode("overwrite").save()
    df = files.read_database(spark, url, "ITEMS", 7, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert df.count() == 7 and "FETCH FIRST 7 ROWS" in df._jdf.queryExecution().toString()


def test_clusters_of_plain_groups(spark):
    """Groups far apart come out as they are, and each row is in the cluster of the nearest mean."""
    r = random.Random(4)
    rows = [(i, [(0, 0), (50, 0), (0, 80)][i % 3][0] + r.gauss(0, 1), [(0, 0), (50, 0), (0, 80)][i % 3][1] + r.gauss(0, 1)) for i in range(240)]
    got = models.clusters(spark.createDataFrame(rows, "i long, x double, y double"), ["x", "y"], 3).collect()
    of = {}
    for g in got:
        of.setdefault(g["cluster"], set()).add(g["i"] % 3)
    assert len(of) == 3 and all(len(v) == 1 for v in of.values())


def test_cluster_queries(spark):
    """Users of all clusters are all users; the categories are those that a plain count of each cluster has."""
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    sizes = registry.QUERIES["M3_clusters"](spark, sf).collect()
    assert sum(x["users"] for x in sizes) == events.select("user_id").distinct().count() and sum(x["views"] for x in sizes) == events.where("event_type = 'view'").count()
    wide = events.groupBy("user_id").pivot("event_type", ["click", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).fillna(0)
    of = {x["user_id"]: (x["cluster"], [x[c] for c in ("click", "purchase", "signup", "view")]) for x in models.clusters(wide, ["click", "purchase", "signup", "view"], 4).collect()}
    means = {c: [sum(col) / len(col) for col in zip(*[v for k, v in of.values() if k == c], strict=True)] for c in {k for k, _ in of.values()}}
    near = sum(min(means, key=lambda m: sum((a - b) ** 2 for a, b in zip(v, means[m], strict=True))) == c for c, v in of.values())
    assert near >= 0.95 * len(of)  # all, but for the last step's moves
    count = {}
    for e in events.select("user_id", F.hour("ts").alias("hour")).collect():
        key = of[e["user_id"]][0], e["hour"]
        count[key] = count.get(key, 0) + 1
    want = {(c, h): (n, k) for c in means for k, (h, n) in enumerate(sorted(((h, n) for (x, h), n in count.items() if x == c), key=lambda y: (-y[1], y[0]))[:5], 1)}
    assert {(x["cluster"], x["hour"]): (x["n"], x["rank"]) for x in registry.QUERIES["M3_cluster_categories"](spark, sf).collect()} == want


def test_joint_fit_of_several_features(spark):
    r = random.Random(6)
    rows = [(k, a, b, c, 3.0 + 2 * a - b + (k == "q") * c) for k in "pq" for a, b, c in [(r.random(), r.random() * 1e6, r.random()) for _ in range(60)]] + [("p", None, 1.0, 1.0, 1.0), ("flat", 1.0, 1.0, 1.0, 5.0)]
    got = {x["k"]: x for x in models.linear_fit(spark.createDataFrame(rows, "k string, a double, b double, c double, y double"), ["a", "b", "c"], "y", "k").collect()}
    for k in "pq":
        assert all(abs(got[k][c] - w) < 1e-6 for c, w in (("intercept", 3.0), ("a", 2.0), ("b", -1.0), ("c", float(k == "q")))) and got[k]["n"] == 60
    assert abs(got["flat"]["intercept"] - 5) < 1e-9


def test_clipped_rings_and_polygon_text(spark):
    rings = {"in": [(1, 1), (2, 1), (2, 2)], "out": [(20, 20), (30, 20), (30, 30)], "round": [(-5, -5), (15, -5), (15, 15), (-5, 15)], "corner": [(8, 8), (14, 8), (8, 14)], "touch": [(10, 0), (12, 0), (12, 5)], "none": []}
    df = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in v]) for k, v in rings.items()] + [("null", None)], "k string, ring array<struct<x: double, y: double>>")
    path = files.workspace(spark, "rings")
    files.write_shapes(df, path)
    got = {x["k"]: x["a"] for x in files.read_shapes(spark, path, (0.0, 0.0, 10.0, 10.0), clip=True).select("k", geo.ring_area("ring").alias("a")).collect()}
    assert {k: round(v, 9) for k, v in got.items() if v > 0} == {"in": 0.5, "round": 100.0, "corner": 4.0}
    assert {x["k"] for x in files.read_shapes(spark, path, (0.0, 0.0, 10.0, 10.0)).collect()} == {"in", "round", "corner", "touch"}
    assert {x["k"]: (x["lng"], x["lat"]) for x in files.read_shapes(spark, path, (0.0, 0.0, 10.0, 10.0), centroid=True).collect()}["round"] == (5.0, 5.0)
    text = spark.createDataFrame([("POLYGON ((0 0, 1 0, 1 1, 0 0))",), ("MULTIPOLYGON (((0 0,1 0,1 1)),((2 2 9, 3 2 9, 3 3 9), (2.5 2.1, 2.6 2.1, 2.6 2.2, 2.5 2.1)))",), ("LINESTRING (0 0, 1 1)",), ("POLYGON EMPTY",), (None,)], "w string")
    assert [[[len(r) for r in p] for p in x[0]] for x in text.select(shapes.polygon_parts("w")).collect()] == [[[3]], [[3], [3, 3]], [], [], []]


def test_file_tiles_follow_the_rows():
    assert [files.file_zoom(n, 1_000_000) for n in (0, 10**6, 16 * 10**6, 17 * 10**6, 10**9, 10**13)] == [2, 2, 2, 3, 5, 10]
