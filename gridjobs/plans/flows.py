"""Queries that write and read files, run streams, or fit models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import models
from ..sources import files
from ..streaming import jobs
from .base import BOXES, POINTS, query, tc, up



def one() -> Column:
    """The number of rows."""
    return F.count(F.lit(1))



@query("SRC1_csv", "select s_suppkey, s_name, s_nationkey from supplier")
def src1(t):
    path = files.workspace(t.spark, "csv")
    t.supplier.select("s_suppkey", "s_name", "s_nationkey").write.csv(path, header=True)
    return files.read_delimited(t.spark, path, "s_suppkey long, s_name string, s_nationkey long")


@query("SRC2_delimited", "select s_suppkey, round(s_acctbal::double, 2) as s_acctbal from supplier")
def src2(t):
    path = files.workspace(t.spark, "psv")
    t.supplier.select("s_suppkey", F.regexp_replace(F.round(F.col("s_acctbal").cast("double"), 2).cast("string"), "[.]", ",").alias("s_acctbal")).write.csv(path, header=True, sep="|", encoding="ISO-8859-1")
    return files.read_delimited(t.spark, path, "s_suppkey long, s_acctbal string", "|", "ISO-8859-1", ("s_acctbal",))


@query("SRC3_json", "select n_nationkey, n_name from nation")
def src3(t):
    path = files.workspace(t.spark, "json")
    t.nation.select("n_nationkey", "n_name").write.json(path)
    return t.spark.read.schema("n_nationkey long, n_name string").json(path)


@query("SRC4_preview", "select event_id, event_type from events order by event_id limit 1000")
def src4(t):
    return t.events.select("event_id", "event_type").orderBy("event_id").limit(1000)


@query("SRC5_partitioned", "select event_id, event_type from events where event_type = 'view'")
def src5(t):
    path = files.workspace(t.spark, "hive")
    t.events.select("event_id", "event_type").write.partitionBy("event_type").parquet(path)
    return t.spark.read.parquet(path).where("event_type = 'view'")


@query("SRC7_whole_text", "select count(distinct source) as files, sum(length(text))::bigint as chars from documents")
def src7(t):
    """Files of each source, read whole."""
    whole = files.whole_texts(t.documents, files.workspace(t.spark, "text"))
    return whole.agg(F.countDistinct("source").alias("files"), F.sum(F.length(F.replace("value", F.lit("\x01"), F.lit("")))).alias("chars"))


@query("SRC8_features", f"select event_id, event_type, lng, lat from {POINTS}")
def src8(t):
    path = files.workspace(t.spark, "features")
    p = t.points.select("event_id", "event_type", "lng", "lat")
    collected = p.groupBy(F.expr("event_id div 500")).agg(F.collect_list(F.struct(F.struct("event_id", "event_type").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"))).alias("features"))
    collected.select("features").write.json(path)
    return files.read_features(t.spark, path, "event_id: long, event_type: string", a_line=True)


@query("SRC9_key_ranges", "select o_orderkey, o_custkey from orders where o_custkey = 46")
def src9(t):
    path = files.workspace(t.spark, "sorted")
    t.orders.repartitionByRange("o_custkey").sortWithinPartitions("o_custkey").write.option("maxRecordsPerFile", 5_000_000).parquet(path)
    return t.spark.read.parquet(path).where("o_custkey = 46").select("o_orderkey", "o_custkey")


@query("SRC10_bounds_read", f"select event_id, lng, lat from {POINTS} where lng between -30 and 40 and lat between -10 and 50")
def src10(t):
    path = files.workspace(t.spark, "geo")
    files.write_geo(t.points.select("event_id", "lng", "lat"), path)
    return files.read_geo(t.spark, path, (-30.0, -10.0, 40.0, 50.0), ["event_id", "lng", "lat"])


_MET = f"(select n_nationkey, minx, miny, maxx, maxy from {BOXES} where minx <= 65 and maxx >= -55 and miny <= 35 and maxy >= -11)"


@query("SRC10_shapes_clipped", f"select n_nationkey, round((least(maxx, 65e0) - greatest(minx, -55e0))*(least(maxy, 35e0) - greatest(miny, -11e0)), 6) as area from {_MET} where minx < 65 and maxx > -55 and miny < 35 and maxy > -11")
def src10clip(t):
    """Boxes as rings, cut to the bounds that they were read by."""
    path = files.workspace(t.spark, "shapes")
    files.write_shapes(rectangles(t), path)
    return files.read_shapes(t.spark, path, (-55.0, -11.0, 65.0, 35.0), clip=True).select("n_nationkey", F.round(geo.ring_area("ring"), 6).alias("area"))


@query("SRC10_shapes_centres", f"select n_nationkey, (minx + maxx)/2 as lng, (miny + maxy)/2 as lat from {_MET}")
def src10centre(t):
    """The same boxes as points."""
    path = files.workspace(t.spark, "shapes")
    files.write_shapes(rectangles(t), path)
    return files.read_shapes(t.spark, path, (-55.0, -11.0, 65.0, 35.0), centroid=True).select("n_nationkey", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


def rectangles(t):
    corners = ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy")))
    return t.boxes.select("n_nationkey", F.expr(f"array({corners})").alias("ring"))


CENTRE = f"select cell, cnt from (select {tc(6)} as cell, count(*) as cnt from {POINTS} group by 1) where (((cell >> 28) & 268435455) + 0.5e0)/64e0*360e0 - 180e0 between -30 and 40 and degrees(atan(sinh(pi()*(1e0 - 2e0*((cell & 268435455) + 0.5e0)/64e0)))) between -10 and 50"


@query("SRC11_cells_in_bounds", CENTRE)
def src11(t):
    """Cells whose centre is in the bounds, from the parts of a dataset that can hold them."""
    path = files.workspace(t.spark, "cells")
    files.write_cells(t.points.groupBy(geo.tile_cell("lng", "lat", 6).alias("cell")).agg(one().alias("cnt")), path, 6)
    return files.read_cells(t.spark, path, (-30.0, -10.0, 40.0, 50.0)).select("cell", "cnt")


@query("SNK2_chunk_bounds", f"select {tc(2)} as file_cell, {tc(6)} as chunk, min(lng) as minx, min(lat) as miny, max(lng) as maxx, max(lat) as maxy, count(*) as num_rows from {POINTS} group by 1, 2")
def snk2(t):
    path = files.workspace(t.spark, "geo")
    files.write_geo(t.points.select("event_id", "lng", "lat"), path)
    return t.spark.read.parquet(f"{path}/_bounds")


@query("SRC12_pyramid_level", f"select {up(6, 4)} as cell, count(*) as cnt from (select {tc(6)} as cell from {POINTS}) group by 1")
def src12(t):
    path = files.workspace(t.spark, "pyramid")
    cells = t.points.groupBy(geo.tile_cell("lng", "lat", 6).alias("cell")).agg(one().alias("cnt"))
    files.write_pyramid(cells, path, 6, 3, "cnt")
    return files.read_pyramid(t.spark, path, 4, "cnt")


@query("SRC12_missing_level", f"select {up(6, 2)} as cell, count(*) as cnt from (select {tc(6)} as cell from {POINTS}) group by 1")
def src12missing(t):
    """A level that is not stored comes from the coarsest stored one that is finer."""
    path = files.workspace(t.spark, "pyramid")
    files.write_pyramid(t.points.groupBy(geo.tile_cell("lng", "lat", 6).alias("cell")).agg(one().alias("cnt")), path, 6, 4, "cnt")
    return files.read_pyramid(t.spark, path, 2, "cnt")


@query("SNK3_pyramid", " union all ".join(f"select {z} as res, count(distinct {tc(z)}) as cells, count(*) as cnt from {POINTS}" for z in (6, 5, 4, 3)))
def snk3(t):
    """Cells and total of each stored level."""
    path = files.workspace(t.spark, "pyramid")
    files.write_pyramid(t.points.groupBy(geo.tile_cell("lng", "lat", 6).alias("cell")).agg(one().alias("cnt")), path, 6, 3, "cnt")
    return t.spark.read.parquet(path).groupBy("res").agg(one().alias("cells"), F.sum("cnt").alias("cnt"))


@query("SRC13_new_files", "select 'f' || event_id as path from events where ts >= (select max(ts) from events) - interval 24 hour")
def src13(t):
    """One file an event; the snapshot is a day old."""
    path = F.concat(F.lit("f"), F.col("event_id")).alias("path")
    top = t.events.agg(F.max("ts").alias("top"))
    old = t.events.crossJoin(F.broadcast(top)).where("ts < top - interval 24 hours")  # one row
    return files.new_files(t.events.select(path), old.select(path))


@query("SNK1_content_hash", "select count(*) as rows, true as same, true as other, true as skipped from orders")
def snk1(t):
    """A table written once for its content: its hash as read back, another table's hash, and a second write that is left out."""
    base = files.workspace(t.spark, "out")
    path, first = files.write_once(t.orders, base, "o_custkey")
    again, second = files.write_once(t.orders.repartition(3), base, "o_custkey")
    own = files.content_hash(t.spark.read.parquet(path)).select("rows", F.col("hash").alias("own"))
    both = own.crossJoin(F.broadcast(files.content_hash(t.orders).select("hash"))).crossJoin(F.broadcast(files.content_hash(t.orders.unionByName(t.orders)).select(F.col("hash").alias("twice"))))  # one row each
    return both.select("rows", F.expr("own = hash").alias("same"), F.expr("own <> twice").alias("other"), F.lit(first and not second and again == path).alias("skipped"))


@query("SNK1_written_rows", "select o_orderkey, o_custkey from orders")
def snk1rows(t):
    """The rows of a table that was written once and asked to be written again, as they are on storage."""
    base = files.workspace(t.spark, "once")
    files.write_once(t.orders, base, "o_custkey")
    path, again = files.write_once(t.orders.repartition("o_custkey"), base, "o_custkey")
    return t.spark.read.parquet(path).where(F.lit(not again)).select("o_orderkey", "o_custkey")


@query("SNK4_feature_text", f"""select event_id, '{{"type":"Feature","properties":{{"event_id":' || event_id || '}},"geometry":{{"type":"Point","coordinates":[' || event_id % 180 || '.5,' || event_id % 80 || '.25]}}}}' as value from events""")
def snk4(t):
    p = t.events.select("event_id", F.expr("event_id % 180 + 0.5e0").alias("lng"), F.expr("event_id % 80 + 0.25e0").alias("lat"))
    lines = files.feature_lines(p)
    return lines.select(F.get_json_object("value", "$.properties.event_id").cast("long").alias("event_id"), "value")


def replay(t, columns, files_a_batch=1):
    """Events as three files."""
    path = files.workspace(t.spark, "stream")
    e = columns(t).withColumn("slice", F.dayofmonth("ts") % 3)
    e.repartition(3, "slice").write.parquet(path)
    return jobs.read_stream(t.spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.drop("slice").schema), files_a_batch), path


@query("ST1_new_files_stream", "select event_type, count(*) as n from events group by 1")
def st1(t):
    stream, path = replay(t, lambda t: t.events.select("event_id", "ts", "event_type"))
    return jobs.run_to_parquet(stream, path + "-out", path + "-ck").groupBy("event_type").agg(one().alias("n"))


@query("ST2_minutes", "select date_trunc('minute', ts)::timestamp as start, count(*) as n from events where event_type = 'view' and ts >= (select max(ts) from events) - interval 60 minute group by 1")
def st2(t):
    """The last hour of the log by minute."""
    top = t.events.agg(F.max("ts").alias("top"))
    last = t.events.crossJoin(F.broadcast(top)).where("event_type = 'view' and ts >= top - interval 60 minutes")
    return last.groupBy(F.window("ts", "1 minute")["start"].cast("timestamp_ntz").alias("start")).agg(one().alias("n"))


@query("ST2_minute_stream", "with e as (select * from events where event_type = 'view' and not (event_id % 50 = 0 and dayofmonth(ts) <= 10)) select date_trunc('minute', ts)::timestamp as start, count(*) as n from e where date_trunc('minute', ts) + interval 121 minute <= (select max(ts) from e) group by 1")
def st2stream(t):
    """Minutes that the watermark has passed; entries that come after all others are too late for their minutes."""
    path = files.workspace(t.spark, "minutes")
    e = t.events.where("event_type = 'view'").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    held = F.expr("event_id % 50 = 0 and dayofmonth(ts) <= 10")
    for part in (e.where(~held & (F.dayofmonth("ts") <= 15)), e.where(~held & (F.dayofmonth("ts") > 15)), e.where(held)):
        part.coalesce(1).write.mode("append").parquet(path)  # a file each, read in this order
    stream = jobs.read_stream(t.spark, path, "event_id long, ts timestamp")
    return jobs.run_to_parquet(jobs.minute_counts(stream, "2 hours"), path + "-out", path + "-ck").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("ST2_recent_entries", "select event_id, ts, user_id from events where event_type = 'view' and ts >= (select max(ts) from events) - interval 60 minute order by ts desc, event_id limit 100")
def st2entries(t):
    """The hundred newest entries of one name in the last hour of the log."""
    top = t.events.agg(F.max("ts").alias("top"))
    last = t.events.crossJoin(F.broadcast(top)).where("event_type = 'view' and ts >= top - interval 60 minutes")  # one row
    return last.select("event_id", "ts", "user_id").orderBy(F.desc("ts"), "event_id").limit(100)


@query("ST3_hourly_cells", f"select date_trunc('hour', ts)::timestamp as start, {tc(2)} as cell, count(*) as n from {POINTS} where date_trunc('hour', ts) + interval 3 hour <= (select max(ts) from events) group by 1, 2")
def st3(t):
    """Hours that the watermark has closed; the last ones stay in the state."""
    stream, path = replay(t, lambda t: t.points.select(F.col("ts").cast("timestamp").alias("ts"), "lng", "lat"), 10)
    return jobs.run_to_parquet(jobs.cell_counts(stream, 2, "2 hours"), path + "-out", path + "-ck").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("ST4_latest_state", "select user_id, max(ts) as ts from events group by 1")
def st4(t):
    stream, path = replay(t, lambda t: t.events.select("user_id", "ts", "event_type"))
    return jobs.run_latest(stream, "user_id", "ts", path + "-state", path + "-ck").select("user_id", "ts")


@query("M1_cosine_top_k", "with q as (select vec_id, embedding::double[] e from embeddings where vec_id % 50 = 0) select query_id, vec_id, rank from (select q.vec_id as query_id, v.vec_id, row_number() over (partition by q.vec_id order by list_cosine_similarity(q.e, v.embedding::double[]) desc, v.vec_id)::int as rank from q, embeddings v) where rank <= 10")
def m1(t):
    v = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return models.cosine_top_k(v, v.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", "rank")


@query("M3_clusters")
def m3(t):
    """Clusters of users by their counts of event types."""
    wide = t.events.groupBy("user_id").pivot("event_type", ["click", "purchase", "signup", "view"]).agg(one()).fillna(0)
    return models.clusters(wide, ["click", "purchase", "signup", "view"], 4).groupBy("cluster").agg(one().alias("users"), F.sum("view").alias("views"))


@query("M3_cluster_categories")
def m3top(t):
    """The five commonest hours of each cluster of users."""
    wide = t.events.groupBy("user_id").pivot("event_type", ["click", "purchase", "signup", "view"]).agg(one()).fillna(0)
    of = models.clusters(wide, ["click", "purchase", "signup", "view"], 4).select("user_id", "cluster")
    return models.top_categories(t.events.select("user_id", F.hour("ts").alias("hour")).join(of, "user_id"), "cluster", "hour", 5)


DAILY = "(select event_type, date_diff('day', date '2024-01-01', cast(ts as date))::double as d, count(*)::double as n from events group by 1, 2)"


@query("M4_forecast", f"""with a as (select *, d - avg(d) over (partition by event_type) as p1, count(*) over (partition by event_type) as q0 from {DAILY}),
 b as (select *, sum(p1*p1) over (partition by event_type) as q1, sum(p1*p1*p1) over (partition by event_type) as r1 from a), c as (select *, p1*p1 - r1/q1*p1 - q1/q0 as p2 from b),
 e as (select *, sum(p2*p2) over (partition by event_type) as q2, sum(p1*p2*p2) over (partition by event_type) as r2 from c), f as (select *, (p1 - r2/q2)*p2 - q2/q1*p1 as p3 from e),
 g as (select event_type, avg(d) as mean, max(d) as top, arg_max(n, d) as cur, avg(n) as c0, sum(n*p1)/max(q1) as c1, sum(n*p2)/max(q2) as c2, sum(n*p3)/sum(p3*p3) as c3, max(q0) as q0, max(q1) as q1, max(r1) as r1, max(q2) as q2, max(r2) as r2 from f group by 1),
 h as (select *, k.k as step, top + k.k - mean as x, (top + k.k - mean)*(top + k.k - mean) - r1/q1*(top + k.k - mean) - q1/q0 as y from g, range(1, 8) k(k)),
 v as (select event_type, step, cur, c0 + c1*x + c2*y + c3*((x - r2/q2)*y - q2/q1*x) as value from h)
 select event_type, step::int as step, round(value, 3) as value, case when ret > 0.5 then 'BUY' when ret < -0.5 then 'SELL' else 'HOLD' end as signal from (select *, 100e0*(max(value) filter (step = 7) over (partition by event_type) - cur)/cur as ret from v)""")
def m4forecast(t):
    """Seven steps of the cubic trend of daily counts, and what the last one's change advises."""
    n = t.events.groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("d")).agg(one().alias("n"))
    return models.forecast(n, "event_type", "d", "n").select("event_type", "step", F.round("value", 3).alias("value"), "signal")


@query("M4_trend", "select event_type, round(regr_slope(n, d), 6) as c1 from (select event_type, date_diff('day', date '2024-01-01', cast(ts as date)) as d, count(*) as n from events group by 1, 2) group by 1")
def m4(t):
    n = t.events.groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("d")).agg(one().alias("n"))
    return models.polynomial_trend(n, "event_type", "d", "n", degree=1).select("event_type", F.round("c1", 6).alias("c1"))


@query("U1_map_parameters", "select n_nationkey, n_nationkey * i.i as product from nation, range(3) i(i)")
def u1(t):
    call = lambda row: pd.DataFrame({"n_nationkey": row["n_nationkey"], "product": [row["n_nationkey"] * i for i in range(3)]})
    return models.map_parameters(t.nation.select("n_nationkey"), call, "n_nationkey long, product long")
