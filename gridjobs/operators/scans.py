"""Running sums, fills, dense numbers and exact quantiles over ordered rows, without a window over all rows of a key.

Rows are ranged by key and order, so a hot key falls into as many ranges as its rows ask for. Each range is scanned by itself; what
the ranges before it (or after it) hand over is one value for each key that goes on from one range into another. Such a key is
the first or the last of a range, so there are at most two for each range, and only these are looked at for that.

The ranges are written to shared storage first: their bounds come from a sample, and all later steps must see the same ones.
The order has to tell rows of a key apart where results depend on it. Keys may be null. Null values count nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import workspace

RANGE = "scan_range"


def ranged(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with the number of each row's range, ascending with ``by``, as it is read back from storage."""
    path = workspace(df.sparkSession, "ranges")
    df.repartitionByRange(*by).withColumn(RANGE, F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"{k} of"]) for k in keys], F.lit(True))


def _carried(rows: DataFrame, keys: list[str], part: Column, carry: Callable[[Column, object], Column], backwards: bool) -> DataFrame:
    """range, keys (named ``... of``) and ``carried``: what the ranges on the other side hand over."""
    ends = rows.groupBy(RANGE).agg(F.min(F.struct(*keys)).alias("a"), F.max(F.struct(*keys)).alias("b"))
    ends = ends.select(F.explode(F.array("a", "b")).alias("k")).select("k.*").distinct()
    ends = ends.withColumnsRenamed({k: f"{k} of" for k in keys})
    sums = rows.join(F.broadcast(ends), _same(rows, ends, keys), "left_semi").groupBy(RANGE, *keys).agg(part.alias("part"))  # two keys a range
    order = Window.partitionBy(*keys).orderBy(RANGE)
    frame = order.rowsBetween(1, Window.unboundedFollowing) if backwards else order.rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col(RANGE).alias(f"{RANGE} of"), *(F.col(k).alias(f"{k} of") for k in keys), carry(F.col("part"), frame).alias("carried"))


def _scan(df: DataFrame, keys: list[str], order: list[str], name: str, local: Callable[[object], Column], part: Column, carry: Callable[[Column, object], Column], join: Callable[[Column, Column], Column], backwards: bool = False) -> DataFrame:
    rows = ranged(df, *keys, *order)
    carried = _carried(rows, keys, part, carry, backwards)
    met = rows.join(F.broadcast(carried), _same(rows, carried, [RANGE, *keys]), "left")  # two rows a range
    own = Window.partitionBy(RANGE, *keys).orderBy(*order)
    frame = own.rowsBetween(0, Window.unboundedFollowing) if backwards else own.rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn(name, join(local(frame), F.col("carried"))).select(*df.columns, name)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same keys up to and with each row."""
    zero = F.lit(0)
    return _scan(df, keys, order, name, lambda w: F.coalesce(F.sum(value).over(w), zero), F.sum(value), lambda p, w: F.sum(p).over(w), lambda own, more: own + F.coalesce(more, zero))


def last_value(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the last ``value`` that is not null up to and with each row of the same keys."""
    part = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    return _scan(df, keys, order, name, lambda w: F.last(value, True).over(w), part, lambda p, w: F.last(p, True).over(w), F.coalesce)


def next_value(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the first ``value`` that is not null from each row on."""
    part = F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    return _scan(df, keys, order, name, lambda w: F.first(value, True).over(w), part, lambda p, w: F.first(p, True).over(w), F.coalesce, backwards=True)


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with numbers from 0 in the order of ``key``: places within the ranges after the sizes of the ranges before."""
    rows = ranged(df, key)
    sizes = rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(RANGE, F.coalesce(F.sum("n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    own = F.row_number().over(Window.partitionBy(RANGE).orderBy(key)) - 1
    return rows.withColumn("own", own).join(F.broadcast(before), RANGE).withColumn(name, F.col("before") + F.col("own")).select(*df.columns, name)


def quantiles(df: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """keys, total and ``quantiles`` (array<double>): exact quantiles of the values that are not null, between two values in
    proportion. Distinct values and their counts are ranged, so no group has to be held by one row or task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    upto = running_sum(counts, keys, [value], "n", "upto")
    totals = upto.groupBy(*keys).agg(F.sum("n").alias("total")).withColumnsRenamed({k: f"{k} of" for k in keys})
    met = upto.join(totals, _same(upto, totals, keys))
    found = []
    for f in fractions:
        at = (F.col("total") - 1) * F.lit(float(f))
        place = lambda k: F.max(F.when((F.col("upto") - F.col("n") <= k) & (k < F.col("upto")), F.col(value).cast("double")))
        low, high = place(F.floor(at)), place(F.ceil(at))
        found.append((low, high, F.max(at - F.floor(at))))
    out = met.groupBy(*keys).agg(F.max("total").alias("total"), *(c.alias(f"q{i}{j}") for i, x in enumerate(found) for j, c in enumerate(x)))
    return out.select(*keys, "total", F.array(*[F.expr(f"q{i}0 + (q{i}1 - q{i}0) * q{i}2") for i in range(len(fractions))]).alias("quantiles"))
