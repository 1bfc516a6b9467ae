"""Model jobs: vector top-k, clusters, polynomial trends, functions over parameter rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


VECTOR_BLOCK = 8192
QUERY_BLOCK = 1024


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact top k by cosine for each row of ``queries``, both with vec_id and v: blocks of queries meet blocks of
    vectors, each pair of blocks gives its best k, then the best of these."""
    n_blocks, q_blocks = max(1, -(-vectors.count() // VECTOR_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    block = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    stored = vectors.withColumn("block", block(n_blocks)).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asked = queries.withColumn("q_block", block(q_blocks)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    unit = lambda v: (x := np.array(v.tolist(), float)) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, s, out = left["vec_id"].to_numpy(), unit(left["v"]) @ unit(right["v"]).T, []
        for j, i in enumerate(right["vec_id"]):
            top = np.lexsort((ids, -s[:, j]))[:k]
            out.append(pd.DataFrame({"query_id": i, "vec_id": ids[top], "score": s[top, j]}))
        return pd.concat(out)

    found = stored.groupBy("block", "q_block").cogroup(asked.groupBy("block", "q_block")).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def polynomial_trend(df: DataFrame, key: str, x: str, y: str, degree: int = 3) -> DataFrame:
    """Coefficients c0.. of a least-squares polynomial per series: power sums by aggregation, one small solve a series."""
    powers = [F.sum(F.pow(F.col(x), float(i))).alias(f"s{i}") for i in range(2 * degree + 1)]
    mixed = [F.sum(F.pow(F.col(x), float(i)) * F.col(y)).alias(f"t{i}") for i in range(degree + 1)]
    sums = df.groupBy(key).agg(*powers, *mixed)
    kind = dict(df.dtypes)[key]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                a = np.array([[getattr(r, f"s{i + j}") for j in range(degree + 1)] for i in range(degree + 1)])
                rows.append([getattr(r, key), *np.linalg.lstsq(a, np.array([getattr(r, f"t{i}") for i in range(degree + 1)]), rcond=None)[0]])
            yield pd.DataFrame(rows, columns=[key, *(f"c{i}" for i in range(degree + 1))])

    return sums.mapInPandas(solve, f"{key} {kind}, " + ", ".join(f"c{i} double" for i in range(degree + 1)))


def linear_fit(df: DataFrame, features: list[str], target: str, key: str) -> DataFrame:
    """key, n, intercept and a coefficient named as each feature, of the least-squares fit of all features at once: means and
    central moments by aggregation, one small solve a key. Rows with a null are left out; where features depend on each
    other, the smallest coefficients are taken."""
    every = [*features, target]
    known = df.dropna(subset=every).select(key, *(F.col(c).cast("double").alias(c) for c in every))
    pairs = [(a, b) for i, a in enumerate(features) for b in [*features[i:], target]]
    sums = known.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{i}") for i, c in enumerate(every)), *(F.covar_pop(a, b).alias(f"c_{j}") for j, (a, b) in enumerate(pairs)))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(features)
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                s, t = np.zeros((p, p)), np.zeros(p)
                for j, (a, b) in enumerate(pairs):
                    x, y = features.index(a), None if b == target else features.index(b)
                    if y is None:
                        t[x] = r[f"c_{j}"]
                    else:
                        s[x, y] = s[y, x] = r[f"c_{j}"]
                scale = np.sqrt(np.where(np.diag(s) > 0, np.diag(s), 1))
                beta = np.linalg.lstsq(s / np.outer(scale, scale), t / scale, rcond=1e-12)[0] / scale
                rows.append([r[key], r["n"], r[f"m_{p}"] - sum(b * r[f"m_{i}"] for i, b in enumerate(beta)), *beta])
            yield pd.DataFrame(rows, columns=[key, "n", "intercept", *features])

    return sums.mapInPandas(solve, f"`{key}` {dict(df.dtypes)[key]}, n long, intercept double, " + ", ".join(f"`{c}` double" for c in features))


def forecast(df: DataFrame, key: str, x: str, y: str, steps: int = 7, degree: int = 3, percent: float = 0.5) -> DataFrame:
    """key, step, value of the next ``steps`` whole numbers after each series' last x, and ``signal``: BUY or SELL where the
    last one is over ``percent`` percent above or below the last known value, else HOLD. x is scaled to [-1, 0] for the fit."""
    ends = df.groupBy(key).agg(F.max(x).alias("last"), F.greatest(F.max(x) - F.min(x), F.lit(1)).alias("span"), F.max_by(y, x).alias("current"))
    scaled = df.join(ends, key).select(key, ((F.col(x) - F.col("last")) / F.col("span")).alias("u"), y)
    fit = polynomial_trend(scaled, key, "u", y, degree).join(ends, key)
    at = lambda step: sum((F.col(f"c{i}") * F.pow(step / F.col("span"), float(i)) for i in range(1, degree + 1)), F.col("c0"))
    change = 100.0 * (at(F.lit(steps)) - F.col("current")) / F.col("current")
    signal = F.when(change > percent, "BUY").when(change < -percent, "SELL").otherwise("HOLD")
    return fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select(key, "step", at(F.col("step")).alias("value"), signal.alias("signal"))


def top_categories(df: DataFrame, group: str, category: str, n: int) -> DataFrame:
    """The n commonest categories of each group with their counts and ranks; of ties, the smaller category."""
    counts = df.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(group).orderBy(F.desc("n"), category)
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def map_parameters(parameters: DataFrame, call: Callable[[dict], pd.DataFrame], schema: str) -> DataFrame:
    """A function on each parameter row, in parallel, results together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                yield call(row)

    return parameters.mapInPandas(run, schema)


def clusters(df: DataFrame, features: list[str], k: int, seed: int = 1) -> DataFrame:
    """k-means cluster of each row."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(v).transform(v).drop("features")
