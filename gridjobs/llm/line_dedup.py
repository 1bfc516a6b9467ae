"""Line dedup by fuzzy matching of lines, with DataFrame operations only.

Lines that are equal once trimmed are one class. A class's signature comes from one map-side aggregation over its exploded
character shingles, one row a class: the hash deals the shingles into BANDS bins, and a bin's band is the least of its
shingles in each of ROWS orders (one of ROWS minima over an eighth of the set). The same rule holds for lines of every
length; a short line has fewer bands, and one differing shingle spoils one band at most. Bands are counted, and only those
of several classes go on as buckets: classes that agree in a band are candidates. Bitmaps of the shingles give an exact
upper bound of the similarity, which rejects most candidates; the rest are confirmed by exact Jaccard similarity of all
their shingles. Distributed union-find joins the confirmed links, and of every component only the line that comes first
(doc_id, then position) stays.

Within a band's bucket each class is first paired with the bucket's first and with the one before it, which joins most
groups at the cost of a bucket's size. Crowded buckets are salted, and the salted parts' firsts paired. Then buckets that still hold several components are gone through again, in blocks of BLOCK against BLOCK: all
their pairs of different components are compared within the join, by bitmaps and then exactly, which gives links only; so every
pair that agrees in a band is linked or was compared.

Defined results: a null text has no lines and stays null; lines end at a line feed; lines of white space alone are always
kept. A line shorter than a shingle is one shingle; a line of any length counts whole. Repeated lines within a document
count like those of other documents; which of equal places comes first cannot matter. Of rows that share a doc_id, equal
positions stand and fall together; rows without a doc_id take no part and stay as they are. An empty table gives no rows.
Other columns pass through, whatever their names, but for ``n_lines`` and ``n_removed``, which are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, free_name, materialize, maybe_broadcast, release, table
from .components import connected_components

SHINGLE = 8
ROWS, BANDS = 3, 8
PERCENT = 80
CROWDED = 20_000  # classes of a bucket beyond which it is salted
BLOCK = 1024  # classes of a bucket that meet as many others in one group
WORDS = 32  # of 64 bits of a bitmap; a power of two
MAP = ("places", "bits", *(f"w{w}" for w in range(WORDS)))  # columns of a bitmap
WHITE = " \t\r\x0b\x0c"
#: Bits of a shingle's hash from which each order reads; the lowest bits say the bin, as many as BANDS.
ORDERS = (33, 21, 9)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line (trimmed, not blank) and its two hashes."""
    each = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    ends = [F.col("line").startswith(c) | F.col("line").endswith(c) for c in WHITE]
    each = each.withColumn("line", F.when(reduce(or_, ends), F.btrim("line", F.lit(WHITE))).otherwise(F.col("line"))).where("line <> ''")
    return each.withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(9), "line"))


def shingled(each: DataFrame, *keys: str) -> DataFrame:
    """``keys``, and a row for each place ``at`` of ``line`` with its shingle's hash h. Places are those of UTF-16."""
    units = each.select(*keys, F.encode("line", "UTF-16BE").alias("units"))
    last = F.expr(f"greatest(0, int(octet_length(units) div 2) - {SHINGLE})")
    at = units.select(*keys, "units", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return at.withColumn("h", F.expr(f"xxhash64(substring(units, 2 * at + 1, {2 * SHINGLE}))"))


def signatures(each: DataFrame) -> DataFrame:
    """k1, k2, the number of ``copies`` and the hashes of the BANDS bands of every class of lines, null for an empty bin. A row
    for each class and not for each bin, as a task's classes then mostly stay within Spark's fast map of groups."""
    orders = [F.expr(f"int(shiftrightunsigned(h, {s}) & 2147483647)").alias(f"v{r}") for r, s in enumerate(ORDERS)]
    at = shingled(each, "k1", "k2").select("k1", "k2", "at", F.expr(f"int(h & {BANDS - 1})").alias("bin"), *orders)
    least = [F.expr(f"min(v{r}) filter (where bin = {b})").alias(f"v{b}_{r}") for b in range(BANDS) for r in range(ROWS)]
    found = at.groupBy("k1", "k2").agg(F.expr("count(1) filter (where at = 0)").alias("copies"), *least)
    bands = [F.when(F.col(f"v{b}_0").isNotNull(), F.xxhash64(F.lit(b), *[f"v{b}_{r}" for r in range(ROWS)])) for b in range(BANDS)]
    return found.select("k1", "k2", "copies", F.array(*bands).alias("bands"))


def shared(signed: DataFrame) -> DataFrame:
    """band and size of the buckets of several classes."""
    each = signed.select(F.explode("bands").alias("band")).where("band is not null")
    return materialize(each.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")


def buckets(signed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Classes b (a struct of two hashes) by band, of buckets that hold several: n of them, the one before and the first. Those
    of more than CROWDED are cut by salts, as many as their size asks for; before and first are then within a salt."""
    each = signed.select(F.struct("k1", "k2").alias("b"), F.posexplode("bands").alias("bin", "band")).where("band is not null")
    each = each.join(spread(sizes, 16), "band").withColumn("crowded", F.col("size") > CROWDED)
    each = each.withColumn("salt", F.when(F.col("crowded"), F.pmod(F.col("b.k1"), F.ceil(F.col("size") / max(1, CROWDED)))).otherwise(F.lit(0).cast("long")))
    by = Window.partitionBy("band", "salt").orderBy("b")
    return each.select("b", "bin", "band", "crowded", F.col("size").alias("n"), F.lag("b").over(by).alias("before"), F.first("b").over(by).alias("first"))


def candidates(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that agree in a band: each with the one before and the first of its bucket."""
    pairs = met.where("before is not null").select("b", F.explode(F.array("before", "first")).alias("a"))
    firsts = met.where("before is null and crowded").select("band", "b")
    least = firsts.groupBy("band").agg(F.min("b").alias("a"))
    pairs = pairs.unionByName(firsts.join(least, "band").select("a", "b").where("a <> b"))
    return pairs.select("a", "b").distinct()


def spread(df: DataFrame, width: int) -> DataFrame:
    """``df`` to be hashed by a join: on every executor if it is small, else in each task while its share is."""
    rows = df.count()
    if rows * width <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df.hint("shuffle_hash") if rows * width <= BROADCAST_BYTES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def places_of(each: DataFrame, signed: DataFrame, met: DataFrame) -> DataFrame:
    """doc_id, pos, k1 and k2 of the lines of every class that is in a bucket or has copies; of the former also the line."""
    wanted = met.select("b.k1", "b.k2", F.lit(1).alias("met")).unionByName(signed.where("copies > 1").select("k1", "k2", F.lit(0).alias("met")))
    wanted = materialize(wanted.groupBy("k1", "k2").agg(F.max("met").alias("met")), "wanted")
    found = each.join(spread(wanted, 32), ["k1", "k2"])
    found = materialize(found.select("doc_id", "pos", "k1", "k2", F.when(F.col("met") == 1, F.col("line")).alias("line")), "places")
    release(wanted)
    return found


def bitmaps(texts: DataFrame) -> DataFrame:
    """x (k1, k2), the places of its line, the words of the bitmap of its shingles and the number of bits."""
    at = shingled(texts.select("x.k1", "x.k2", "line"), "k1", "k2").select("k1", "k2", F.expr(f"int(h & {WORDS - 1})").alias("word"), F.expr(f"shiftleft(1L, int(shiftright(h, {WORDS.bit_length() - 1}) & 63))").alias("bit"))
    words = at.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("places"), *[F.expr(f"bit_or(bit) filter (where word = {w})").alias(f"w{w}") for w in range(WORDS)])
    words = words.select(F.struct("k1", "k2").alias("x"), "places", *[F.coalesce(f"w{w}", F.lit(0).cast("long")).alias(f"w{w}") for w in range(WORDS)])
    return materialize(words.withColumn("bits", F.expr(" + ".join(f"bit_count(w{w})" for w in range(WORDS)))), "bitmaps")


def possible(a: str, b: str) -> Column:
    """False where the bitmaps, columns with the prefixes ``a`` and ``b``, rule the similarity out: each bit that only one of two
    sets has stands for a member that only that set has, and a set has no more members than its line has places. The bits of
    one alone follow from those of either and from the numbers of bits; so the expression stays small enough to be compiled."""
    either = " + ".join(f"bit_count({a}w{w} ^ {b}w{w})" for w in range(WORDS))
    most = [f"{100 - PERCENT} * (2 * {x}places - {x}bits + {y}bits)" for x, y in ((a, b), (b, a))]
    return F.expr(f"{100 + PERCENT} * ({either}) <= least({most[0]}, {most[1]})")


def shingle_set(line: str) -> str:
    """The distinct shingles of a line's UTF-16 units, which are bound to a variable: a column would be copied for each one."""
    each = f"transform(sequence(1, greatest(1, octet_length(u) - {2 * SHINGLE - 1}), 2), p -> xxhash64(substring(u, p, {2 * SHINGLE})))"
    return f"array_distinct(transform(array(encode({line}, 'UTF-16BE')), u -> {each})[0])"


def similar(a: str, b: str) -> Column:
    """Whether the sets of shingles of two lines reach the similarity; each expression is evaluated once."""
    enough = f"exists(array(size(array_intersect(s.a, s.b))), n -> 100 * n >= {PERCENT} * (size(s.a) + size(s.b) - n))"
    return F.expr(f"exists(array(named_struct('a', {shingle_set(a)}, 'b', {shingle_set(b)})), s -> {enough})")


def confirmed(texts: DataFrame, maps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets of shingles reach the similarity."""
    met = pairs
    for c in "ab":
        met = met.join(prefixed(solid(maps), c).withColumnRenamed(f"{c}_x", c), c)
    left = met = materialize(met.where(possible("a_", "b_")).select("a", "b"), "possible")
    for c in "ab":
        met = met.join(texts.select(F.col("x").alias(c), F.col("line").alias(f"line_{c}")), c)
    found = materialize(met.where(similar("line_a", "line_b")).select("a", "b"), "links")
    release(left)
    return found


def prefixed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name`` before the names of its columns."""
    return df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])


def solid(df: DataFrame) -> DataFrame:
    """``df`` with its bitmaps as columns that cannot be null: a join's code then has no tests for nulls and stays below the
    8000 bytes of a method beyond which the JVM never compiles it."""
    return df.select(*[F.coalesce(c, F.lit(0).cast(t)).alias(c) if c in MAP else F.col(c) for c, t in df.dtypes])


def rest(met: DataFrame, merged: DataFrame, texts: DataFrame, maps: DataFrame) -> DataFrame:
    """All other similar pairs (a, b) that agree in a band and are in different components of ``merged``."""
    named = maybe_broadcast(merged.select(F.col("node").alias("b"), "component"), width=96)
    # the pair of a bucket of two has been compared
    held = materialize(met.where("n > 2 or crowded").select("band", "bin", "b").join(named, "b", "left").select("band", "bin", "b", F.coalesce("component", "b").alias("component")), "held")
    sizes = held.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = materialize(sizes.where("lo < hi").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    stored = placed = materialize(held.join(maybe_broadcast(mixed, width=24), "band").select("b", "component", "band", "bin", "blocks"), "placed")
    own = placed.groupBy("b").agg(*[F.expr(f"max(band) filter (where bin = {k})").alias(f"band{k}") for k in range(BANDS)])
    known = materialize(own.join(maps.join(texts, "x").withColumnRenamed("x", "b"), "b"), "known")
    placed = solid(placed.withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")).join(known, "b"))
    side = lambda name, i, j: prefixed(placed.select(i.alias("i"), j.alias("j"), "band", F.col("b").alias("id"), "component", "bin", *known.columns[1:]), name)
    left = side("l", F.col("block"), F.explode(F.expr("sequence(block, blocks - 1)")))
    right = side("r", F.explode(F.expr("sequence(0, block)")), F.col("block"))
    same = " and ".join(f"l_{c} = r_{c}" for c in ("band", "i", "j"))
    apart = "l_component <> r_component and (l_i < l_j or l_id < r_id)"
    earlier = " or ".join(f"({k} < l_bin and coalesce(l_band{k} = r_band{k}, false))" for k in range(BANDS - 1))
    found = left.join(right, F.expr(same) & F.expr(apart) & possible("l_", "r_") & ~F.expr(earlier) & similar("l_line", "r_line"))  # in their first common band
    found = materialize(found.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b")).distinct(), "rest")
    release(held, mixed, stored, known)
    return found


def dropped(docs: DataFrame) -> DataFrame:
    """doc_id and ``gone`` (array<int>), the positions of its lines that go."""
    each = lines(docs)
    signed = materialize(signatures(each), "bands")
    sizes = shared(signed)
    met = materialize(buckets(signed, sizes), "buckets")
    release(sizes)
    places = places_of(each, signed, met)
    texts = materialize(places.where("line is not null").groupBy("k1", "k2").agg(F.min("line").alias("line")).select(F.struct("k1", "k2").alias("x"), "line"), "lines")
    maps = bitmaps(texts)
    pairs = materialize(candidates(met), "pairs")
    links = confirmed(texts, maps, pairs)
    merged = connected_components(links)
    new = rest(met, merged, texts, maps)
    whole = connected_components(links.unionByName(new)) if new.limit(1).count() else merged
    named = whole.select("node.k1", "node.k2", "component")
    again = signed.where("copies > 1").select("k1", "k2").join(named, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("component", F.struct("k1", "k2")).alias("component"))
    again = materialize(again, "again")
    place = F.struct("doc_id", "pos")
    copies = materialize(places.join(maybe_broadcast(again), ["k1", "k2"]).select("doc_id", "pos", "component"), "copies")
    first = materialize(copies.groupBy("component").agg(F.min(place).alias("first")), "first")
    gone = copies.join(first, "component").where(place > F.col("first"))
    out = materialize(gone.groupBy("doc_id").agg(F.collect_set("pos").alias("gone")), "gone")
    release(signed, met, places, texts, maps, pairs, links, new, again, copies, first, merged, *([whole] if whole is not merged else []))
    return out


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without lines that repeat, exactly or nearly, an earlier one; with ``n_lines`` and ``n_removed``."""
    gone = dropped(docs)
    size = gone.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("gone")).alias("lines")).first()
    name, own = free_name(docs, "gone"), free_name(docs, "of")
    gone = gone.select(F.col("doc_id").alias(own), F.col("gone").alias(name))
    met = docs.join(maybe_broadcast(gone, size["docs"] + (size["lines"] or 0) // 16), docs["doc_id"] == gone[own], "left")
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col(name), i)), "\n")
    columns = [F.when(F.col(name).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return met.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"), F.coalesce(F.size(name), F.lit(0)).alias("n_removed"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without lines that repeat an earlier line."""
    return keep_first_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
