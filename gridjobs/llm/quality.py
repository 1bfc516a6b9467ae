"""Quality classifier: supervised subword embeddings.

Words, pairs of following words and character n-grams are hashed into BUCKETS learned vectors; a document is the mean
of its vectors, and a softmax over the two labels stands on top. Training is numpy stochastic gradient descent over a
bounded, documented sample (at most SAMPLE labelled documents, whole texts). As everything above a vector is linear up
to the softmax, for prediction each bucket is folded into one number: its vector's share of the difference of the two
logits. A pair of words is hashed by the difference of its words' hashes, so immediate repetition has one bucket.

Defined results: a text without words (null, empty, white space) gets the score of the learned offset alone; if
nothing could be learnt, scores are 0.5. Rows are kept one to one, repeated ones too; an empty table gives none. A text of any
length is scored whole. A score of 0.5 predicts 1. Of several labels of a doc_id the greater one is learnt; labels other than
0 and 1 and null ones teach nothing. Other columns, whatever their names, are not looked at.

A vector's step is not that of the stated mean, whose gradient has each bucket's share of the document as factor: that would
hardly move the vectors of long documents. It takes fifty times that share, one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks, mix
from .common import held_out, table

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
SIZE = 16
GRAMS = (3, 5)
SAMPLE = 4000
#: Labelled texts of more bytes teach nothing, so the sample is bounded in bytes; they are scored like all others.
FIT_BYTES = 20_000
EPOCHS = 5


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word, pair of words and character n-gram of a block of lower-case texts."""
    start, end, row = block.words()
    drop = np.uint64(64 - BUCKET_BITS)
    bucket = lambda h: (h >> drop).astype(np.int32)
    word = block.hashes(start, end)
    found, rows = [bucket(word)], [row]
    if len(word) > 1:
        same = row[1:] == row[:-1]
        found.append(bucket(mix(word[1:] - word[:-1] + np.uint64(1)))[same])
        rows.append(row[1:][same])
    length = end - start
    stop = np.repeat(end, length)
    at = np.arange(len(stop)) + np.repeat(start - (np.cumsum(length) - length), length)
    of = np.repeat(row, length)
    for n in GRAMS:
        inside = at + n <= stop
        p = at[inside]
        found.append(bucket(block.hashes(p, p + n)))
        rows.append(of[inside])
    return np.concatenate(found), np.concatenate(rows)


def train(texts: list[bytes], labels: list[int], seed: int = 5) -> tuple[np.ndarray, float]:
    """The folded model: one number per bucket, and the offset."""
    r = np.random.default_rng(seed)
    docs = []
    for _, _, block in blocks(pa.array(texts, pa.binary()), lower=True):
        bucket, row = features(block)
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(1, len(block.starts)))
        for part in np.split(bucket[order], cuts):
            docs.append(np.unique(part, return_counts=True) if len(part) else (part, part))
    vectors = r.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    weights, offset = np.zeros((SIZE, 2), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in r.permutation(len(docs)):
            rate = 0.5 * (1 - step / steps)
            step += 1
            bucket, count = docs[i]
            share = (count / max(1, count.sum())).astype(np.float32)
            hidden = share @ vectors[bucket] if len(bucket) else np.zeros(SIZE, np.float32)
            z = hidden @ weights + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = weights @ p
            weights -= rate * np.outer(hidden, p)
            offset -= rate * 0.1 * p
            if len(bucket):
                vectors[bucket] -= rate * np.minimum(share * 50, 1)[:, None] * back
    return vectors @ (weights[:, 1] - weights[:, 0]), float(offset[1] - offset[0])


def fit(docs: DataFrame, labels: DataFrame, seed: int = 5) -> tuple[np.ndarray, float] | None:
    """A model of ``labels`` (doc_id, quality), held-out rows left out; None without two kinds of labels."""
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    count = known.count()
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    sample = known.where(place < F.lit(float(1 << 30) * min(1.0, SAMPLE / max(1, count)))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = sorted(docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES).join(F.broadcast(sample), "doc_id").collect(), key=lambda r: r["doc_id"])
    if len({r["quality"] for r in rows}) < 2:
        return None
    return train([bytes(r["text"] or b"") for r in rows], [r["quality"] for r in rows], seed)


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    rest = docs.drop("score", "predicted")
    if model is None:
        return rest.withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit(1))
    fields = [f.name for f in rest.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", score double, predicted int"
    folded = rest.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, offset = folded.value
        for batch in stream:
            z = np.zeros(batch.num_rows)
            for a, b, block in blocks(batch.column("text"), lower=True):
                bucket, row = features(block)
                total = np.bincount(row, weights=value[bucket], minlength=b - a)
                z[a:b] = total / np.maximum(np.bincount(row, minlength=b - a), 1)
            p = 1 / (1 + np.exp(-np.clip(z + offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*fields, "score", "predicted"])

    return rest.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
