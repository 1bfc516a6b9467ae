"""Approximate nearest neighbours for maximum inner product: score-aware anisotropic quantisation.

Vectors are cut into subspaces of two components with sixteen centroids each, four bits a code. Codebook and codes
minimise a loss in which the part of the residual parallel to the vector weighs PARALLEL times the rest, because it
moves large inner products most. The codebook is fitted on a bounded, documented sample (at most SAMPLE rows); every row
is indexed. A search scans packed codes with tables of one query's inner products, two codes a byte, and scores the best
of every block anew with the original vectors in double precision.

Queries and candidates meet in blocks of bounded size; each pair of blocks gives its best k only.

Defined results: vectors that are null or zero, hold null or non-finite components, or have another number of
components than the most common one, take no part. Ties go to the smaller vec_id. A query with fewer candidates than k
gets all of them. Repeated vectors are candidates each. Rows without vec_id take no part. Columns but vec_id and the vector,
whatever their names, are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SAMPLE = 4096
CENTROIDS = 16
PARALLEL = 4.0
ROUNDS = 3
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 4096
#: Candidates of a block that are scored anew for each query, for each neighbour asked for, besides ties at the edge.
RERANKED = 8


@dataclass
class Codebook:
    """centroids: (subspaces, CENTROIDS, 2)."""

    centroids: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 3) -> Codebook:
        x = pad(x)
        n, parts = len(x), x.shape[1] // 2
        sub = x.reshape(n, parts, 2)
        r = np.random.default_rng(seed)
        book = cls(sub[r.integers(0, n, CENTROIDS)].transpose(1, 0, 2) + r.normal(0, 1e-6, (parts, CENTROIDS, 2)))
        for k in range(3 + ROUNDS):  # plain rounds first, then with the anisotropic loss
            codes = book.encode(x, PARALLEL if k >= 3 else 1.0)
            book.update(x, codes, PARALLEL if k >= 3 else 1.0)
        return book

    def encode(self, x: np.ndarray, parallel: float = PARALLEL) -> np.ndarray:
        """Codes (rows, subspaces) by coordinate descent over the subspaces."""
        x = pad(x)
        n, parts = len(x), x.shape[1] // 2
        sub = x.reshape(n, parts, 2)
        residual = ((sub[:, :, None, :] - self.centroids[None]) ** 2).sum(-1)  # rows, subspaces, centroids
        codes = residual.argmin(axis=2)
        if parallel == 1.0:
            return codes.astype(np.uint8)
        inner = np.einsum("nps,pcs->npc", sub, self.centroids)
        own = (sub**2).sum(-1)
        square = np.maximum(own.sum(1), 1e-300)
        rows = np.arange(n)
        along = own.sum(1) - np.take_along_axis(inner, codes[:, :, None], 2)[:, :, 0].sum(1)  # <residual, x>
        for p in range(parts):
            without = along + inner[rows, p, codes[:, p]]
            loss = residual[:, p] + (parallel - 1) * (without[:, None] - inner[:, p]) ** 2 / square[:, None]
            codes[:, p] = loss.argmin(axis=1)
            along = without - inner[rows, p, codes[:, p]]
        return codes.astype(np.uint8)

    def update(self, x: np.ndarray, codes: np.ndarray, parallel: float) -> None:
        """Centroids of least loss for given codes: normal equations over all centroids together."""
        n, parts = len(x), codes.shape[1]
        slot = (np.arange(parts) * CENTROIDS + codes)[:, :, None] * 2 + np.arange(2)
        slot = slot.reshape(n, -1)
        size = parts * CENTROIDS * 2
        spread = np.zeros((n, size), np.float32)
        np.put_along_axis(spread, slot, x.astype(np.float32), 1)
        counts = np.bincount(slot.ravel(), minlength=size)
        square = np.maximum((x**2).sum(1), 1e-300)
        weighted = (spread * ((parallel - 1) / square)[:, None]).astype(np.float32)
        left = np.diag(counts.astype(float)) + (weighted.T @ spread)
        right = spread.sum(0) + weighted.T @ (x**2).sum(1)
        solved = np.linalg.lstsq(left + 1e-9 * np.eye(size), right, rcond=None)[0] if parallel != 1.0 else right / np.maximum(counts, 1)
        keep = counts == 0
        flat = self.centroids.reshape(-1).copy()
        self.centroids = np.where(keep, flat, solved).reshape(parts, CENTROIDS, 2)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each pair of subspaces, a query's inner products with both centroids of each packed byte."""
        single = np.einsum("ps,pcs->pc", pad(q[None])[0].reshape(-1, 2), self.centroids).astype(np.float32)
        if len(single) % 2:
            single = np.concatenate([single, np.zeros((1, CENTROIDS), np.float32)])
        return (single[0::2, :, None] + single[1::2, None, :]).reshape(-1, CENTROIDS**2)

    @staticmethod
    def packed(codes: np.ndarray) -> np.ndarray:
        """Two codes a byte: (bytes, rows)."""
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
        return np.ascontiguousarray((codes[:, 0::2] * CENTROIDS + codes[:, 1::2]).T)


def pad(x: np.ndarray) -> np.ndarray:
    """An even number of components."""
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1) if x.shape[1] % 2 else x


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and ``v`` (array<double>) of the rows that take part."""
    v = vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).select("vec_id", F.col(vector).cast("array<double>").alias("v"))
    v = v.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.where(F.size("v") == sizes[0]["n"]) if sizes else v


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """For each row of ``queries`` its k rows of ``vectors`` with the largest inner product, itself left out.
    Both have vec_id and v, as usable() gives them."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    n, q = vectors.count(), queries.count()
    if not n or not q:
        return spark.createDataFrame([], schema)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    book = Codebook.fit(np.array([r["v"] for r in sample]))
    n_blocks, q_blocks, depth = -(-n // CANDIDATE_BLOCK), -(-q // QUERY_BLOCK), RERANKED * k
    block = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(m)).cast("int")
    stored = vectors.withColumn("block", block(1, n_blocks)).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asked = queries.withColumn("q_block", block(2, q_blocks)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        left = left.sort_values("vec_id", kind="stable")
        x, ids = np.stack(left["v"].to_numpy()), left["vec_id"].to_numpy()
        codes = book.packed(book.encode(x))
        out = []
        for name, v in zip(right["vec_id"].to_numpy(), right["v"].to_numpy(), strict=True):
            total = np.zeros(len(ids), np.float32)
            for part, byte in zip(book.tables(v), codes, strict=True):
                total += part[byte]
            total[ids == name] = -np.inf
            m = len(ids) - int((ids == name).sum())
            edge = np.partition(total, len(ids) - min(m, depth))[len(ids) - min(m, depth)] if m else np.inf
            total = np.flatnonzero((total >= edge) & (ids != name))  # everything at the edge's score too
            score = (x[total] * v).sum(axis=1)
            best = np.lexsort((ids[total], -score))[:k]
            out.append(pd.DataFrame({"query_id": name, "vec_id": ids[total][best], "score": score[best]}))
        return pd.concat(out)

    found = stored.groupBy("block", "q_block").cogroup(asked.groupBy("block", "q_block")).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_score_aware_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = materialize(usable(table(spark, sf_dir, "embeddings")), "vectors")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
