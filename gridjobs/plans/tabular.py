"""Queries on tables: filters, key joins, aggregations, windows, series, text."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import joins, models, scans
from .base import query



def one() -> Column:
    """The number of rows."""
    return F.count(F.lit(1))

FEEDBACK = "(select 'SUPP-' || l_suppkey as supplier_id, count(*) as num_reviews, 1 + (sum(l_linenumber) % 41)/10e0 as avg_rating from lineitem where l_suppkey % 10 <> 0 group by l_suppkey)"
PLACES = "(select 'SUP' || lpad(cast(s_suppkey as varchar), 7, '0') as supplier_ref, ['mall','street','outlet','kiosk','online','depot'][s_suppkey % 6 + 1] as store_type, s_suppkey % 90 as staff from supplier)"
STORES = f"(select s_suppkey, s_name, s_acctbal, coalesce(num_reviews, 0) as num_reviews, avg_rating, store_type, staff from supplier s left join {FEEDBACK} f on cast(regexp_extract(f.supplier_id, '[0-9]+') as bigint) = s_suppkey left join {PLACES} p on cast(regexp_extract(p.supplier_ref, '[0-9]+') as bigint) = s_suppkey)"
TYPES = ["mall", "street", "outlet", "kiosk", "online", "depot"]


def stores(t):
    """Suppliers with feedback and places, whose messy ids are cleaned to their first run of digits."""
    number = lambda c: F.regexp_extract(c, r"\d+", 0).try_cast("long")
    feedback = t.lineitem.where("l_suppkey % 10 <> 0").groupBy(F.concat(F.lit("SUPP-"), F.col("l_suppkey")).alias("supplier_id")).agg(one().alias("num_reviews"), (1 + (F.sum("l_linenumber") % 41) / 10.0).alias("avg_rating"))
    places = t.supplier.select(F.concat(F.lit("SUP"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0")).alias("supplier_ref"), F.get(F.array(*map(F.lit, TYPES)), (F.col("s_suppkey") % 6).cast("int")).alias("store_type"), (F.col("s_suppkey") % 90).alias("staff"))
    s = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    s = s.join(feedback.withColumn("s_suppkey", number("supplier_id")), "s_suppkey", "left").join(places.withColumn("s_suppkey", number("supplier_ref")), "s_suppkey", "left")
    return s.select("s_suppkey", "s_name", "s_acctbal", F.coalesce("num_reviews", F.lit(0)).alias("num_reviews"), "avg_rating", "store_type", "staff")


@query("J2_messy_keys", f"select s_suppkey, num_reviews, round(avg_rating, 6) as avg_rating, store_type, staff from {STORES}")
def j2(t):
    return stores(t).select("s_suppkey", "num_reviews", F.round("avg_rating", 6).alias("avg_rating"), "store_type", "staff")


@query("FIL3_optional_filters", f"select s_suppkey, store_type, num_reviews from {STORES} where num_reviews between 0 and 700 and lower(store_type) = lower('MALL') and coalesce(avg_rating, 0) between 0 and 4")
def fil3(t):
    """Null counts as 0 in ranges; text matches in any case; "All" would be no filter."""
    wanted, kind = {"num_reviews": (0, 700), "avg_rating": (0, 4)}, "MALL"
    out = stores(t)
    for c, (lo, hi) in wanted.items():
        out = out.where(F.coalesce(F.col(c), F.lit(0)).between(lo, hi))
    if kind != "All":
        out = out.where(F.lower("store_type") == kind.lower())
    return out.select("s_suppkey", "store_type", "num_reviews")


@query("S1_top_n", "select s_suppkey, s_acctbal from supplier order by s_acctbal desc, s_suppkey limit 10")
def s1(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)


@query("SRC6_limit", "select s_suppkey, s_name from supplier order by s_suppkey limit 100")
def src6(t):
    return t.supplier.select("s_suppkey", "s_name").orderBy("s_suppkey").limit(100)


@query("FIL4_in_list", "select event_id, event_type from events where event_type in ('view', 'signup') and user_id % 10 not in (1, 2)")
def fil4(t):
    return t.events.where(F.col("event_type").isin("view", "signup") & ~(F.col("user_id") % 10).isin(1, 2)).select("event_id", "event_type")


@query("FIL5_semi_join", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderkey % 7 = 0)")
def fil5(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_orderkey % 7 = 0"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("FIL6_unparsable", "select event_id, try_cast(v as bigint) as n from (select event_id, case when event_id % 5 = 0 then '--' when event_id % 7 = 0 then 'x1' else cast(user_id as varchar) end as v from events) where v <> '--' and try_cast(v as bigint) is not null")
def fil6(t):
    v = t.events.select("event_id", F.expr("case when event_id % 5 = 0 then '--' when event_id % 7 = 0 then 'x1' else string(user_id) end").alias("v"))
    return v.where("v <> '--'").withColumn("n", F.col("v").try_cast("long")).where("n is not null").select("event_id", "n")


@query("FIL7_latest_day", "select event_id from events where cast(ts as date) = (select max(cast(ts as date)) from events)")
def fil7(t):
    e = t.events.withColumn("day", F.to_date("ts"))
    return e.join(F.broadcast(e.agg(F.max("day").alias("day"))), "day").select("event_id")  # one row


@query("FIL8_match_ladder", "select key, n_name, level from (select *, rank() over (partition by key order by level) r from (select k.r_name as key, n.n_name, case when n.n_name = k.r_name then 1 when starts_with(n.n_name, left(k.r_name, 2)) then 2 when contains(n.n_name, left(k.r_name, 1)) then 3 end as level from region k, nation n) where level is not null) where r = 1")
def fil8(t):
    """Exact match, else prefix, else substring; both sides are fixed small dimension tables."""
    met = F.broadcast(t.region.select(F.col("r_name").alias("key"))).crossJoin(t.nation.select("n_name"))
    level = F.when(F.col("n_name") == F.col("key"), 1).when(F.col("n_name").startswith(F.left("key", F.lit(2))), 2).when(F.col("n_name").contains(F.left("key", F.lit(1))), 3)
    met = met.withColumn("level", level).where("level is not null")
    return met.withColumn("best", F.min("level").over(Window.partitionBy("key"))).where("level = best").select("key", "n_name", "level")


@query("FIL9_weighted_first", "select event_id, round(user_id/(select max(user_id) from events)::double, 6) as weight from events order by event_id limit 500")
def fil9(t):
    top = t.events.agg(F.max("user_id").alias("top"))
    return t.events.crossJoin(F.broadcast(top)).orderBy("event_id").limit(500).select("event_id", F.round(F.col("user_id") / F.col("top"), 6).alias("weight"))


@query("FIL9_row_sample", "select event_id, event_type from events where (event_id * 2654435761) % 4294967296 < 4294967296 // 20")
def fil9sample(t):
    """A twentieth of the rows, picked by a hash of the key, so that the same rows come again."""
    return t.events.where("(event_id * 2654435761) % 4294967296 < 4294967296 div 20").select("event_id", "event_type")


@query("FIL10_struct_filter", "select event_type, count(*) as n from events where user_id > 10 and cast(json_extract_string(props, '$.k') as int) > 3 and event_type in ('view', 'click') group by 1")
def fil10(t):
    s = t.events.select("event_type", F.struct("user_id", F.from_json("props", "k int")["k"].alias("k")).alias("b"))
    return s.where((F.col("b.user_id") > 10) & (F.col("b.k") > 3) & F.col("event_type").isin("view", "click")).groupBy("event_type").agg(one().alias("n"))


@query("FIL11_terms", "select p_partkey, p_size from part where p_name like '%a%' or p_name like '%e%' order by p_size desc, p_partkey limit 20")
def fil11(t):
    return t.part.where(F.col("p_name").rlike("a|e")).dropDuplicates(["p_partkey"]).select("p_partkey", "p_size").orderBy(F.desc("p_size"), "p_partkey").limit(20)


@query("PRJ1_code_labels", "select event_id, case event_type when 'view' then 'seen' when 'click' then 'pressed' else 'other' end as label from events")
def prj1(t):
    m = F.create_map(*map(F.lit, ("view", "seen", "click", "pressed")))
    return t.events.select("event_id", F.coalesce(F.try_element_at(m, F.col("event_type")), F.lit("other")).alias("label"))


@query("PRJ2_fall_through", "select n_nationkey, case when lbl = 'nation_0' then 'first' else lbl end as label from (select n_nationkey, coalesce(nullif(case when n_nationkey % 2 = 0 then null else n_name end, ''), lower(n_name)) as lbl from nation)")
def prj2(t):
    label = F.coalesce(F.when(F.col("n_nationkey") % 2 != 0, F.col("n_name")), F.lower("n_name"))
    return t.nation.select("n_nationkey", label.alias("label")).replace("nation_0", "first", subset=["label"])


@query("PRJ3_status", "select s_suppkey, case when s_acctbal < 0 then 'empty' when s_acctbal < 3000 then 'low' when s_acctbal < 7000 then 'half' else 'full' end as status from supplier")
def prj3(t):
    b = F.col("s_acctbal")
    return t.supplier.select("s_suppkey", F.when(b < 0, "empty").when(b < 3000, "low").when(b < 7000, "half").otherwise("full").alias("status"))


@query("J1_equi_join", "select user_id, a.n as views, b.n as buys from (select user_id, count(*) as n from events where event_type = 'view' group by 1) a join (select user_id, count(*) as n from events where event_type = 'purchase' group by 1) b using (user_id)")
def j1(t):
    n = lambda kind, name: t.events.where(F.col("event_type") == kind).groupBy("user_id").agg(one().alias(name))
    return n("view", "views").join(n("purchase", "buys"), "user_id")


@query("J3_tagged_outer", "select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.n, b.n) as n, case when b.user_id is null then 'left' when a.user_id is null then 'right' else 'both' end as source from (select user_id, count(*) as n from events where event_type = 'view' group by 1) a full join (select user_id, count(*) as n from events where event_type = 'signup' group by 1) b on a.user_id = b.user_id")
def j3(t):
    n = lambda kind: t.events.where(F.col("event_type") == kind).groupBy("user_id").agg(one().alias("n"))
    return joins.tagged_outer_join(n("view"), n("signup"), "user_id", ["n"])


@query("J4_release_diff", "select a.k, a.n, b.n as m, round(1e5*abs(a.n - b.n)/(a.n + b.n), 4) as diff from (select l_partkey as k, count(*) as n from lineitem where l_orderkey % 2 = 0 group by 1) a left join (select l_partkey as k, count(*) as n from lineitem where l_orderkey % 2 = 1 group by 1) b on a.k = b.k")
def j4(t):
    n = lambda r, name: t.lineitem.where(F.col("l_orderkey") % 2 == r).groupBy(F.col("l_partkey").alias("k")).agg(one().alias(name))
    return n(0, "n").join(n(1, "m"), "k", "left").withColumn("diff", F.round(F.expr("1e5*abs(n - m)/(n + m)"), 4))


@query("J5_lookup", "select lpad(cast(n_regionkey as varchar), 2, '0') || lpad(cast(n_nationkey as varchar), 3, '0') as fips, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def j5(t):
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(pad("n_regionkey", 2), pad("n_nationkey", 3)).alias("fips"), "n_name", "r_name")


@query("J6_explode_lookup", "select s_suppkey, n_name from (select s_suppkey, unnest([s_nationkey, (s_nationkey + 1) % 30]) as k from supplier) left join nation on k = n_nationkey")
def j6(t):
    each = t.supplier.select("s_suppkey", F.explode_outer(F.expr("array(s_nationkey, (s_nationkey + 1) % 30)")).alias("k"))
    return each.join(t.nation.withColumnRenamed("n_nationkey", "k"), "k", "left").select("s_suppkey", "n_name")


IPS = "(select distinct (event_id*2654435761) % 4294967296 as ip from events)"
BLOCKS = "(select i*268435456 as start, 4 as len, 'a' || i as place from range(0, 16, 2) r(i) union all select i*16777216, 8, 'b' || i from range(0, 256, 3) r(i) union all select i*1048576, 12, 'c' || i from range(0, 4096, 7) r(i))"


@query("J14_prefix_join", f"select ip, place from (select ip, place, row_number() over (partition by ip order by len desc) r from {IPS} join {BLOCKS} on (ip >> (32 - len)) = (start >> (32 - len))) where r = 1")
def j14(t):
    ips = t.events.select(F.expr("(event_id*2654435761) % 4294967296").alias("ip"))
    block = lambda n, step, length, tag: t.spark.range(0, n, step).select((F.col("id") * (1 << (32 - length))).alias("start"), F.lit(length).alias("length"), F.concat(F.lit(tag), F.col("id")).alias("place"))
    blocks = block(16, 2, 4, "a").unionByName(block(256, 3, 8, "b")).unionByName(block(4096, 7, 12, "c"))
    return joins.prefix_join(ips, blocks, [4, 8, 12]).select("ip", "place")


@query("J16_totals", "select user_id, n, round(n/sum(n) over ()::double, 9) as ratio from (select user_id, count(*) as n from events group by 1)")
def j16(t):
    n = t.events.groupBy("user_id").agg(one().alias("n"))
    return n.crossJoin(F.broadcast(t.events.agg(one().alias("all")))).select("user_id", "n", F.round(F.col("n") / F.col("all"), 9).alias("ratio"))


@query("J17_key_range", "select s_suppkey, chunk from supplier join (select l_suppkey // 20 as chunk, min(l_suppkey) as lo, max(l_suppkey) as hi from lineitem group by 1) on s_suppkey between lo and hi")
def j17(t):
    """Chunks of keys by their least and greatest key."""
    chunks = t.lineitem.groupBy(F.expr("l_suppkey div 20").alias("chunk")).agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"))
    return joins.range_join(t.supplier, chunks, "s_suppkey", "lo", "hi").select("s_suppkey", "chunk")


@query("J17_overlapping_ranges", "select o_orderkey, p_partkey from orders join (select p_partkey, p_retailprice*p_size as lo, p_retailprice*p_size*(1 + (p_partkey % 7)/10000e0) as hi from part) on o_totalprice between lo and hi")
def j17any(t):
    """Orders whose price lies in price ranges that overlap and differ in length."""
    ranges = t.part.select("p_partkey", F.expr("p_retailprice*p_size").alias("lo"), F.expr("p_retailprice*p_size*(1 + (p_partkey % 7)/10000e0)").alias("hi"))
    return joins.range_join(t.orders.select("o_orderkey", "o_totalprice"), ranges, "o_totalprice", "lo", "hi").select("o_orderkey", "p_partkey")


MEET = "(select user_id, event_id, ts, ts + interval 30 minute as fin, lead(ts) over w as nxt, lead(event_id) over w as nid from events window w as (partition by user_id, cast(ts as date) order by ts, event_id))"


@query("J19_meeting_gaps", f"select user_id, event_id, nid as next_id, date_diff('second', ts, nxt) - 1800 as gap_s, case when date_diff('second', ts, nxt) - 1800 < (event_id % 90)*60 then 'late' else 'on time' end as status from {MEET} where nxt is not null")
def j19(t):
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    m = t.events.select("user_id", "event_id", "ts", F.lead("ts").over(w).alias("nxt"), F.lead("event_id").over(w).alias("next_id")).where("nxt is not null")
    m = m.withColumn("gap_s", F.expr("unix_timestamp(nxt) - unix_timestamp(ts) - 1800"))
    return m.select("user_id", "event_id", "next_id", "gap_s", F.when(F.col("gap_s") < (F.col("event_id") % 90) * 60, "late").otherwise("on time").alias("status"))


@query("J20_snapshots", "select s_suppkey, s_name, n from supplier join (select l_suppkey, count(*) as n from lineitem where l_shipdate = (select max(l_shipdate) from lineitem x where x.l_suppkey = lineitem.l_suppkey) group by 1) on l_suppkey = s_suppkey")
def j20(t):
    latest = t.lineitem.groupBy("l_suppkey").agg(F.max("l_shipdate").alias("l_shipdate"))
    n = t.lineitem.join(latest, ["l_suppkey", "l_shipdate"]).groupBy("l_suppkey").agg(one().alias("n"))
    return t.supplier.join(n, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "s_name", "n")


@query("A10_class_summary", "select event_type, count(*) as n, round(avg(user_id), 6) as mean, min(user_id) as lo, max(user_id) as hi from events group by 1 order by n desc, 1 limit 10")
def a10(t):
    return t.events.groupBy("event_type").agg(one().alias("n"), F.round(F.avg("user_id"), 6).alias("mean"), F.min("user_id").alias("lo"), F.max("user_id").alias("hi")).orderBy(F.desc("n"), "event_type").limit(10)


@query("A12_month_series", "select date_trunc('month', o_orderdate)::date as month, count(*) as n, round(avg(o_custkey), 6) as mean from orders group by 1")
def a12(t):
    return t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(one().alias("n"), F.round(F.avg("o_custkey"), 6).alias("mean"))


@query("A13_term_share", "select lang, sum(case when contains(text, 'tion') then 1 else 0 end)::bigint as hits, round(avg(case when contains(text, 'tion') then 1e0 else 0e0 end), 9) as share from documents group by 1")
def a13(t):
    hit = F.col("text").contains("tion").cast("int")
    return t.documents.groupBy("lang").agg(F.sum(hit).alias("hits"), F.round(F.avg(hit), 9).alias("share"))


@query("A15_category_set", "select user_id, string_agg(distinct event_type, '|' order by event_type) as kinds from events group by 1")
def a15(t):
    return t.events.groupBy("user_id").agg(F.concat_ws("|", F.array_sort(F.collect_set("event_type"))).alias("kinds"))


KINDS = ["click", "purchase", "signup", "view"]


@query("A16_pivot", "select cast(ts as date) as day, " + ", ".join(f"count(*) filter (event_type = '{k}') as {k}" for k in KINDS) + " from events group by 1")
def a16(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).pivot("event_type", KINDS).agg(one()).fillna(0)


@query("A17_unpivot", "select n_nationkey, 'region' as name, n_regionkey as val from nation union all select n_nationkey, 'key', n_nationkey from nation")
def a17(t):
    return t.nation.select("n_nationkey", F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("key")).unpivot("n_nationkey", ["region", "key"], "name", "val")


@query("A18_cell_iou", "with a as (select distinct user_id, event_id % 10 as cell from events where event_type = 'view'), b as (select distinct user_id, event_id % 10 as cell from events where event_type = 'click') select user_id, count(*) filter (a.cell is not null and b.cell is not null) as inter, count(*) as total, round(count(*) filter (a.cell is not null and b.cell is not null)/count(*)::double, 9) as iou from a full join b using (user_id, cell) group by 1")
def a18(t):
    cells = lambda kind: t.events.where(F.col("event_type") == kind).select("user_id", F.expr("event_id % 10").alias("cell"), F.lit(1).alias(kind)).distinct()
    met = cells("view").join(cells("click"), ["user_id", "cell"], "full").groupBy("user_id").agg(F.count(F.when(F.col("view").isNotNull() & F.col("click").isNotNull(), 1)).alias("inter"), one().alias("total"))
    return met.withColumn("iou", F.round(F.col("inter") / F.col("total"), 9))


@query("A19_histogram", "with e as (select min(user_id)::double lo, max(user_id)::double hi from events) select b.i::int as bin, count(user_id) as n from range(10) b(i) left join (select user_id, least(floor((user_id - lo)/((hi - lo)/10)), 9) as k from events, e) x on x.k = b.i group by 1")
def a19(t):
    return agg.histogram(t.events.select(F.col("user_id").cast("double").alias("user_id")), "user_id", 10)


@query("A20_box_plot", "select event_type, min(user_id)::double as lo, quantile_cont(user_id, 0.25) as q25, quantile_cont(user_id, 0.5) as q50, quantile_cont(user_id, 0.75) as q75, max(user_id)::double as hi from events group by 1")
def a20(t):
    """From counts of distinct values in ranges, so that no group's values meet in one row."""
    q = scans.quantiles(t.events, ["event_type"], "user_id", [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.select("event_type", *(F.col("quantiles")[i].alias(c) for i, c in enumerate(("lo", "q25", "q50", "q75", "hi"))))


@query("A21_density", "with v as (select user_id::double as x, count(*) as n from events group by 1), s as (select sum(n) as c, sqrt((sum(n*x*x) - sum(n*x)*sum(n*x)/sum(n))/(sum(n) - 1))*pow(sum(n), -0.2e0) as h, min(x) as lo, max(x) as hi from v) select g.i::int as i, round(sum(n*exp(-0.5e0*pow((lo + (hi - lo)*g.i/19e0 - x)/h, 2)))/(any_value(c)*any_value(h)*sqrt(2*pi())), 9) as density from v, s, range(20) g(i) group by 1")
def a21(t):
    """Gaussian kernels on 20 grid points; equal values are grouped first, one row of totals is broadcast."""
    v = t.events.groupBy(F.col("user_id").cast("double").alias("x")).agg(one().alias("n"))
    s = v.agg(F.expr("sum(n)").alias("c"), F.expr("sqrt((sum(n*x*x) - sum(n*x)*sum(n*x)/sum(n))/(sum(n) - 1))*pow(sum(n), -0.2)").alias("h"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    each = v.crossJoin(F.broadcast(s)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19))))
    return each.groupBy("i").agg(F.round(F.expr("sum(n*exp(-0.5*pow((lo + (hi - lo)*i/19.0 - x)/h, 2)))/(any_value(c)*any_value(h)*sqrt(2*pi()))"), 9).alias("density"))


@query("A22_correlations", "select x, y, round(r, 9) as r from (select unnest(['p_size|p_size','p_size|p_retailprice','p_retailprice|p_size','p_retailprice|p_retailprice']) as k, unnest([corr(p_size, p_size), corr(p_size, p_retailprice), corr(p_retailprice, p_size), corr(p_retailprice, p_retailprice)]) as r from part), lateral (select split_part(k, '|', 1) as x, split_part(k, '|', 2) as y)")
def a22(t):
    return agg.correlations(t.part, ["p_size", "p_retailprice"]).withColumn("r", F.round("r", 9))


@query("A22_rank_correlation", "select round(corr(a, b), 9) as r from (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1)/2e0 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1)/2e0 as b from part)")
def a22s(t):
    return agg.correlations(t.part.select("p_size", "p_retailprice"), ["p_size", "p_retailprice"], ranks=True).where("x = 'p_size' and y = 'p_retailprice'").select(F.round("r", 9).alias("r"))


@query("A27_profile", "select count(*) as rows, count(*) - count(text) as null_text, count(distinct lang) as langs, min(n_chars) as lo, max(n_chars) as hi, round(avg(n_chars), 6) as mean from documents")
def a27(t):
    return t.documents.agg(one().alias("rows"), F.count_if(F.col("text").isNull()).alias("null_text"), F.countDistinct("lang").alias("langs"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("A28_class_totals", "select l_linenumber, round(sum(l_orderkey)*0.000247105e0, 4) as acres from lineitem group by 1 order by 2 desc limit 5")
def a28(t):
    return t.lineitem.groupBy("l_linenumber").agg(F.round(F.sum("l_orderkey") * 0.000247105, 4).alias("acres")).orderBy(F.desc("acres")).limit(5)


@query("A29_choices", "select distinct event_type as choice from events where user_id < 20")
def a29(t):
    return t.events.where("user_id < 20").select(F.col("event_type").alias("choice")).distinct().orderBy("choice")


@query("A30_weighted_mean", "select l_suppkey, round(sum(l_linenumber*w)/nullif(sum(w), 0)::double, 9) as mean from (select *, l_orderkey % 3 as w from lineitem) group by 1")
def a30(t):
    w = F.col("l_orderkey") % 3
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_linenumber") * w) / F.nullif(F.sum(w), F.lit(0)), 9).alias("mean"))


@query("A32_hours", "select hour(ts)::int as hour, count(*) as n from events group by 1")
def a32(t):
    return t.events.groupBy(F.hour("ts").alias("hour")).agg(one().alias("n")).orderBy("hour")


DAYS = "(select event_type, cast(ts as date) as day, count(*) as n from events group by 1, 2)"


def days(t):
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(one().alias("n"))


@query("W1_running_sum", f"select event_type, day, sum(n) over (partition by event_type order by day)::bigint as total from {DAYS}")
def w1(t):
    return days(t).select("event_type", "day", F.sum("n").over(Window.partitionBy("event_type").orderBy("day")).alias("total"))


@query("W2_moving_average", f"select event_type, day, round(avg(n) over (partition by event_type order by day rows between 5 preceding and current row), 6) as mean from {DAYS}")
def w2(t):
    return days(t).select("event_type", "day", F.round(F.avg("n").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(-5, 0)), 6).alias("mean"))


@query("W3_rank_one", f"select event_type, day, n from {DAYS} qualify row_number() over (partition by event_type order by n desc, day) = 1")
def w3(t):
    return days(t).withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "day"))).where("r = 1").drop("r")


@query("W4_window_over_aggregate", f"select event_type, day, n, round(n/sum(n) over (partition by event_type)::double, 9) as share from {DAYS}")
def w4(t):
    """Few classes: totals by aggregation and join, not by a window of giant partitions."""
    totals = t.events.groupBy("event_type").agg(one().alias("total"))
    return days(t).join(totals, "event_type").select("event_type", "day", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query("W5_best_row", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1")
def w5(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("W6_top_names", "select user_id, string_agg(event_type, ',' order by n desc, event_type) as names from (select user_id, event_type, count(*) as n from events group by 1, 2 qualify row_number() over (partition by user_id order by n desc, event_type) <= 3) group by 1")
def w6(t):
    n = t.events.groupBy("user_id", "event_type").agg(one().alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).where("r <= 3")
    return n.groupBy("user_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("r", "event_type"))), lambda x: x["event_type"])).alias("names"))


@query("W7_differences", f"select event_type, day, n - lag(n) over (partition by event_type order by day) as diff from {DAYS}")
def w7(t):
    return days(t).select("event_type", "day", (F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))).alias("diff"))


@query("W8_trip_times", "select user_id, event_id, make_timestamp((1704067200 + sum(event_id % 90) over (partition by user_id order by ts, event_id))::bigint*1000000) as at from events")
def w8(t):
    """A user's rows may fall into many ranges, so a hot user is many tasks."""
    steps = t.events.select("user_id", "event_id", "ts", (F.col("event_id") % 90).alias("took"))
    run = scans.running_sum(steps, ["user_id"], ["ts", "event_id"], "took", "run")
    return run.select("user_id", "event_id", F.timestamp_seconds(F.col("run") + 1704067200).cast("timestamp_ntz").alias("at"))


@query("W9_group_size", "select o_orderkey, count(*) over (partition by o_custkey) as n from orders")
def w9(t):
    return t.orders.select("o_orderkey", one().over(Window.partitionBy("o_custkey")).alias("n"))


@query("W10_fill", "select user_id, event_id, coalesce(last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), first_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following)) as filled from (select *, case when event_id % 4 = 0 then event_id end as v from events)")
def w10(t):
    """Forward, then backward, carried over from range to range."""
    v = t.events.select("user_id", "event_id", "ts", F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("v"))
    both = scans.next_value(scans.last_value(v, ["user_id"], ["ts", "event_id"], "v", "back"), ["user_id"], ["ts", "event_id"], "v", "ahead")
    return both.select("user_id", "event_id", F.coalesce("back", "ahead").alias("filled"))


@query("W11_chunks", "select o_orderkey, (row_number() over (order by o_orderkey) - 1)//1000 as chunk from orders")
def w11(t):
    """Chunks of a thousand rows by dense positions."""
    return scans.dense_ids(t.orders.select("o_orderkey"), "o_orderkey", "at").select("o_orderkey", F.expr("at div 1000L").alias("chunk"))


@query("W12_dense_ids", "select event_id, row_number() over (order by event_id) - 1 as id from events")
def w12(t):
    return scans.dense_ids(t.events.select("event_id"), "event_id", "id")


@query("S2_top_details", "select event_id, event_type from events where event_type in (select event_type from events group by 1 order by count(*) desc, 1 limit 2)")
def s2(t):
    top = t.events.groupBy("event_type").agg(one().alias("n")).orderBy(F.desc("n"), "event_type").limit(2)
    return t.events.select("event_id", "event_type").join(F.broadcast(top), "event_type", "left_semi")  # two rows


@query("S3_stratified", "select o_orderkey, bin from (select o_orderkey, width_bucket, width_bucket as bin, row_number() over (partition by width_bucket order by o_orderkey) r from (select o_orderkey, (o_custkey*10//(select max(o_custkey) + 1 from orders)) as width_bucket from orders)) where r <= 80")
def s3(t):
    top = t.orders.agg((F.max("o_custkey") + 1).alias("top"))
    binned = t.orders.crossJoin(F.broadcast(top)).select("o_orderkey", F.expr("o_custkey*10 div top").alias("bin"))
    return binned.withColumn("r", F.row_number().over(Window.partitionBy("bin").orderBy("o_orderkey"))).where("r <= 80").drop("r")


@query("S5_tagged_union", "select c_custkey as id, c_nationkey as nation, 'customer' as source from customer union all select s_suppkey, s_nationkey, 'supplier' from supplier")
def s5(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("source"))
    return a.unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("source")), allowMissingColumns=True)


@query("S6_difference", "select p_partkey as id from part where p_partkey not in (select l_partkey from lineitem where l_quantity = 50)")
def s6(t):
    return t.part.select(F.col("p_partkey").alias("id")).exceptAll(t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("id")).distinct())


@query("S7_first_by_order", "select user_id, min(event_id) as event_id from events group by 1")
def s7(t):
    return t.events.groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("S8_dense_axis", "select d.day::date as day, count(event_id) as n from (select unnest(generate_series((select min(cast(ts as date)) from events), (select max(cast(ts as date)) from events), interval 1 day)) as day) d left join events e on cast(e.ts as date) = d.day::date group by 1")
def s8(t):
    axis = t.events.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    n = t.events.groupBy(F.to_date("ts").alias("day")).agg(one().alias("n"))
    return axis.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("F1_first_digits", "select s_suppkey, try_cast(nullif(regexp_extract(s_name, '[0-9]+'), '') as bigint) as n from supplier")
def f1(t):
    return t.supplier.select("s_suppkey", F.regexp_extract("s_name", r"\d+", 0).try_cast("long").alias("n"))


@query("F2_links", r"""select page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) as links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ' ') as urls from pages""")
def f2(t):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return t.pages.select("page_id", F.size(found).cast("long").alias("links"), F.concat_ws(" ", F.array_sort(F.array_distinct(found))).alias("urls"))


@query("F3_strings", "select n_nationkey, lpad(cast(n_nationkey as varchar), 5, '0') as code, upper(n_name) as up, replace(n_name, '_', ' ') as spaced, contains(n_name, '1') as has1, split_part(n_name, '_', 2) as part from nation")
def f3(t):
    return t.nation.select("n_nationkey", F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("code"), F.upper("n_name").alias("up"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("spaced"), F.col("n_name").contains("1").alias("has1"), F.split_part("n_name", F.lit("_"), F.lit(2)).alias("part"))


@query("F4_partial_dates", "select event_id, case len(s) when 4 then make_date(s::int, 12, 31) when 7 then last_day(cast(s || '-01' as date)) else cast(s as date) end as fin from (select event_id, substr(cast(cast(ts as date) as varchar), 1, [4, 7, 10][event_id % 3 + 1]) as s from events)")
def f4(t):
    """Year, year and month, or a full date; the end of the period."""
    s = t.events.select("event_id", F.expr("substr(string(to_date(ts)), 1, element_at(array(4, 7, 10), int(event_id % 3) + 1))").alias("s"))
    return s.select("event_id", F.expr("case length(s) when 4 then make_date(int(s), 12, 31) when 7 then last_day(to_date(s || '-01')) else to_date(s) end").alias("fin"))


@query("F5_time_pieces", "select user_id, i.i as piece, a + (b - a)*i.i/4 as start_s from (select user_id, floor(epoch(min(ts)))::bigint as a, floor(epoch(max(ts)))::bigint as b from events group by 1), range(4) i(i)")
def f5(t):
    span = t.events.groupBy("user_id").agg(F.unix_timestamp(F.min("ts")).alias("a"), F.unix_timestamp(F.max("ts")).alias("b"))
    return span.withColumn("piece", F.explode(F.expr("sequence(0L, 3L)"))).select("user_id", "piece", F.expr("a + (b - a)*piece/4e0").alias("start_s"))


@query("F6_date_parts", "select o_orderkey, strftime(o_orderdate, '%Y-%m') as ym, round(year(o_orderdate) + dayofyear(o_orderdate)/365.25e0, 6) as yr, make_date(year(o_orderdate)::int, 1, 1) + (week(o_orderdate)::int - 1)*7 as wk from orders")
def f6(t):
    d = "o_orderdate"
    return t.orders.select("o_orderkey", F.date_format(d, "yyyy-MM").alias("ym"), F.round(F.year(d) + F.dayofyear(d) / 365.25, 6).alias("yr"), F.date_add(F.make_date(F.year(d), F.lit(1), F.lit(1)), (F.weekofyear(d) - 1) * 7).alias("wk"))


@query("F7_epoch", "select event_id, cast(epoch_ms((event_id*86400000)::bigint) as date) as day, (event_id*3600) as s from events")
def f7(t):
    return t.events.select("event_id", F.timestamp_millis(F.col("event_id") * 86400000).cast("date").alias("day"), F.unix_timestamp(F.timestamp_seconds(F.col("event_id") * 3600)).alias("s"))


@query("F8_addresses", f"select ip, (ip >> 24) || '.' || ((ip >> 16) & 255) || '.' || ((ip >> 8) & 255) || '.' || (ip & 255) as dotted, ip as back from {IPS}")
def f8(t):
    ips = t.events.select(F.expr("(event_id*2654435761) % 4294967296").alias("ip")).distinct()
    d = ips.withColumn("dotted", F.expr("concat_ws('.', shiftright(ip, 24), shiftright(ip, 16) & 255, shiftright(ip, 8) & 255, ip & 255)"))
    return d.withColumn("back", F.expr("aggregate(split(dotted, '[.]'), 0L, (a, x) -> a * 256 + bigint(x))"))


@query("F9_durations", "select event_id, (event_id % 24)*60 + event_id % 60 as minutes, event_id % 1373 as secs from events")
def f9(t):
    s = t.events.select("event_id", F.expr("lpad(string(event_id % 24), 2, '0') || ':' || lpad(string(event_id % 60), 2, '0') || ' - 23:59'").alias("slot"), F.expr("string(event_id % 1373) || 's'").alias("took"))
    clock = F.split(F.split("slot", " - ")[0], ":")
    return s.select("event_id", (clock[0].cast("long") * 60 + clock[1].cast("long")).alias("minutes"), F.regexp_extract("took", r"(\d+)s", 1).cast("long").alias("secs"))


@query("F10_json", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def f10(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("F11_json_map", "select event_id, 'k' as keys, cast(json_extract_string(props, '$.k') as int) as top, cast(json_extract_string(props, '$.k') as int) > 50 as fast from events")
def f11(t):
    m = t.events.select("event_id", F.from_json("props", "map<string,int>").alias("m"))
    return m.select("event_id", F.concat_ws(",", F.map_keys("m")).alias("keys"), F.array_max(F.map_values("m")).alias("top"), F.exists(F.map_values("m"), lambda x: x > 50).alias("fast"))


@query("F11_key_filters", "select event_id, 'k' as wanted, list_has_any([cast(json_extract_string(props, '$.k') as int)], [1, 2, 3, 5, 8]) as hit from events where json_extract_string(props, '$.k') is not null")
def f11keys(t):
    """Entries of a JSON object whose key is listed, and whether its values meet a list."""
    m = t.events.select("event_id", F.from_json("props", "map<string,int>").alias("m"))
    m = m.select("event_id", F.map_filter("m", lambda k, v: k.isin("k", "none")).alias("m")).where(F.size("m") > 0)
    return m.select("event_id", F.concat_ws(",", F.map_keys("m")).alias("wanted"), F.arrays_overlap(F.map_values("m"), F.array(*map(F.lit, (1, 2, 3, 5, 8)))).alias("hit"))


@query("F12_cosine", "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as sim from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def f12(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    met = e.select(F.col("vec_id").alias("a"), F.col("v").alias("x")).join(e.select(F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("a"), F.col("v").alias("y")), "a")
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), double(0), (s, p) -> s + p)"
    return met.select("a", "b", F.round(F.expr(f"{dot('x', 'y')} / sqrt({dot('x', 'x')} * {dot('y', 'y')})"), 6).alias("sim"))


@query("F13_bag_of_words", "select user_id, array_to_string([case when bool_or(event_type = 'click') then 1 else 0 end, case when bool_or(event_type = 'signup') then 1 else 0 end, case when bool_or(event_type = 'view') then 1 else 0 end], '') as bag from events group by 1")
def f13(t):
    words = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("w"))
    return words.select("user_id", F.concat(*[F.array_contains("w", w).cast("int").cast("string") for w in ("click", "signup", "view")]).alias("bag"))


@query("F21_index", "select l_suppkey, round((a - b)/nullif(a + b, 0)::double, 9) as nd from (select l_suppkey, sum(l_linenumber) as a, count(*) as b from lineitem group by 1)")
def f21(t):
    s = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_linenumber").alias("a"), one().alias("b"))
    return s.select("l_suppkey", F.round(F.expr("(a - b)/nullif(a + b, 0)"), 9).alias("nd"))


@query("F22_scale", "select event_type, day, round(100e0*n/max(n) over (), 6) as height from " + DAYS)
def f22(t):
    d = days(t)
    return d.crossJoin(F.broadcast(d.agg(F.max("n").alias("top")))).select("event_type", "day", F.round(100.0 * F.col("n") / F.col("top"), 6).alias("height"))


@query("F23_packed_degrees", "select event_id, round(substr(d, 1, 3)::int + substr(d, 4, 2)::int/60e0 + substr(d, 6, 2)::int/3600e0, 9) as deg from (select event_id, lpad(cast(event_id % 180 as varchar), 3, '0') || lpad(cast(event_id % 60 as varchar), 2, '0') || lpad(cast(event_id % 59 as varchar), 2, '0') as d from events)")
def f23(t):
    d = t.events.select("event_id", F.expr("lpad(string(event_id % 180), 3, '0') || lpad(string(event_id % 60), 2, '0') || lpad(string(event_id % 59), 2, '0')").alias("d"))
    return d.select("event_id", F.round(F.expr("try_cast(substr(d, 1, 3) as int) + try_cast(substr(d, 4, 2) as int)/60e0 + try_cast(substr(d, 6, 2) as int)/3600e0"), 9).alias("deg"))


@query("F24_elements", "select vec_id, embedding[1] as x, embedding[2] as y, embedding[3] as z from embeddings")
def f24(t):
    return t.embeddings.select("vec_id", *(F.col("embedding")[i].alias(c) for i, c in enumerate("xyz")))


@query("M2_profile_similarity", "with h as (select user_id, hour(ts) as hr, count(*) as n from events group by 1, 2), r as (select hr, n as m from h where user_id = (select min(user_id) from events)) select user_id, round(sum(n*coalesce(m, 0))/(sqrt(sum(n*n))*sqrt((select sum(m*m) from r))), 9) as sim from h left join r using (hr) group by 1")
def m2(t):
    h = t.events.groupBy("user_id", F.hour("ts").alias("hr")).agg(one().alias("n"))
    first = t.events.agg(F.min("user_id").alias("user_id"))
    ref = h.join(F.broadcast(first), "user_id").select("hr", F.col("n").alias("m"))  # 24 rows at most
    size = ref.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("size"))
    met = h.join(F.broadcast(ref), "hr", "left").crossJoin(F.broadcast(size))
    return met.groupBy("user_id").agg(F.round(F.expr("sum(n*coalesce(m, 0))/(sqrt(sum(n*n))*any_value(size))"), 9).alias("sim"))


@query("M5_linear_fit", "select p_size % 5 as k, round(regr_slope(p_retailprice, p_partkey), 9) as slope, round(regr_intercept(p_retailprice, p_partkey), 6) as intercept, round(regr_r2(p_retailprice, p_partkey), 9) as r2 from part group by 1")
def m5(t):
    fit = agg.least_squares(t.part.withColumn("k", F.expr("p_size % 5")), "p_partkey", "p_retailprice", "k")
    return fit.select("k", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 9).alias("r2"))


TRAINING = "(select l_partkey as p_partkey, sum(case when l_returnflag = 'A' then l_quantity else 0 end)::double as qty_a, sum(case when l_returnflag = 'N' then l_quantity else 0 end)::double as qty_n, sum(case when l_returnflag = 'R' then l_quantity else 0 end)::double as qty_r, any_value(p_retailprice)::double as target from lineitem join part on p_partkey = l_partkey group by 1)"


def training(t):
    """Quantities by return flag as features of each part, joined with its price as target."""
    sums = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum(F.col("l_quantity").cast("double")))
    wide = sums.select("p_partkey", *(F.coalesce(c, F.lit(0.0)).alias(f"qty_{c.lower()}") for c in "ANR"))
    return wide.join(t.part.select("p_partkey", F.col("p_retailprice").cast("double").alias("target")), "p_partkey")


@query("M5_training_table", f"select p_partkey, round(qty_a, 4) as qty_a, round(qty_n, 4) as qty_n, round(qty_r, 4) as qty_r, round(target, 4) as target from {TRAINING}")
def m5table(t):
    return training(t).select("p_partkey", *(F.round(c, 4).alias(c) for c in ("qty_a", "qty_n", "qty_r", "target")))


@query("M5_feature_fits", " union all ".join(f"select 'qty_{c}' as feature, round(regr_slope(target, qty_{c}), 6) as slope, round(regr_intercept(target, qty_{c}), 4) as intercept from {TRAINING}" for c in "anr"))
def m5fits(t):
    """Each feature's own line to the target, from one pass over the training table."""
    long = training(t).select("target", F.explode(F.create_map(*[x for c in "anr" for x in (F.lit(f"qty_{c}"), F.col(f"qty_{c}"))])).alias("feature", "x"))
    return agg.least_squares(long, "x", "target", "feature").select("feature", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


_TWO = f"(select p_partkey % 3 as k, count(*) as n, avg(qty_a) as ma, avg(qty_n) as mn, avg(target) as mt, covar_pop(qty_a, qty_a) as aa, covar_pop(qty_n, qty_n) as nn, covar_pop(qty_a, qty_n) as an, covar_pop(qty_a, target) as ay, covar_pop(qty_n, target) as ny from {TRAINING} group by 1)"


@query("M5_joint_fit", f"select k, n, round(mt - ma*(ay*nn - ny*an)/(aa*nn - an*an) - mn*(ny*aa - ay*an)/(aa*nn - an*an), 4) as intercept, round((ay*nn - ny*an)/(aa*nn - an*an), 6) as qty_a, round((ny*aa - ay*an)/(aa*nn - an*an), 6) as qty_n from {_TWO}")
def m5joint(t):
    """Two features at once, for each of three groups of parts."""
    fit = models.linear_fit(training(t).withColumn("k", F.expr("p_partkey % 3")), ["qty_a", "qty_n"], "target", "k")
    return fit.select("k", "n", F.round("intercept", 4).alias("intercept"), F.round("qty_a", 6).alias("qty_a"), F.round("qty_n", 6).alias("qty_n"))


_ALL = "(select 'SUPP-' || (l_suppkey + 3) as supplier_id, count(*) as num_reviews from lineitem group by l_suppkey)"


@query("J2_all_feedback", f"select s_suppkey, coalesce(num_reviews, 0) as num_reviews from supplier left join {_ALL} f on cast(regexp_extract(f.supplier_id, '[0-9]+') as bigint) = s_suppkey")
def j2all(t):
    """Whole feedback under messy ids, which begin at 3, so that some suppliers have none and some feedback no supplier."""
    feedback = t.lineitem.groupBy(F.concat(F.lit("SUPP-"), F.col("l_suppkey") + 3).alias("supplier_id")).agg(one().alias("num_reviews"))
    clean = feedback.select(F.regexp_extract("supplier_id", r"\d+", 0).try_cast("long").alias("s_suppkey"), "num_reviews")
    return t.supplier.select("s_suppkey").join(clean, "s_suppkey", "left").select("s_suppkey", F.coalesce("num_reviews", F.lit(0)).alias("num_reviews"))


@query("FIL5_semi_join_whole", "select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def fil5whole(t):
    return t.customer.select("c_custkey").join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("U2_sql_text", "select o_custkey, count(*) as n from orders where o_orderkey > 100 group by 1")
def u2(t):
    return t.spark.sql("select o_custkey, count(*) as n from {orders} where o_orderkey > :least group by 1", args={"least": 100}, orders=t.orders)
