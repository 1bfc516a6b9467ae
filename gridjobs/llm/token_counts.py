"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram answer totals, quantiles and truncated
totals for every context limit. Suffix sums are taken within ranges of WIDTH lengths, and over the few range totals,
so no task gets the whole histogram.

Defined results: null and empty texts have length 0; repeated rows count each, rows without doc_id too; an empty table gives
no rows. Texts of any length are encoded whole. Documents of equal length share a row, so nothing can tie. Columns but doc_id
and text, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import batches
from .common import materialize, table

WIDTH = 256
_loaded: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """One per Python worker."""
    if (path, pattern) not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and n_tokens of every document."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        for batch in stream:
            for part, texts in batches(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """n_tokens, n_docs."""
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def summary(hist: DataFrame) -> DataFrame:
    """Per distinct length, taken as a context limit: documents of that length, documents and tokens above it, totals,
    the total after cutting each document to it, and the share of documents that fit (the length's quantile)."""
    hist = hist.withColumn("range", F.floor(F.col("n_tokens") / WIDTH))
    above, everything = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = hist.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    ranges = ranges.select("range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"), *(F.sum(c).over(everything).alias(f"{c}_all") for c in "dt"))
    within = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = hist.join(ranges, "range").select(
        "n_tokens",
        "n_docs",
        (F.col("d_above") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))).alias("docs_above"),
        (F.col("t_above") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(within), F.lit(0))).alias("tokens_above"),
        F.col("d_all").alias("total_docs"),
        F.col("t_all").alias("total_tokens"),
    )
    return out.withColumn("truncated_total", F.expr("total_tokens - tokens_above + docs_above * n_tokens")).withColumn("quantile", F.expr("double(total_docs - docs_above) / total_docs"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Documents that fit and the truncated total for any list of context limits."""
    each = hist.withColumn("context_limit", F.explode(F.array(*map(F.lit, limits))))
    return each.groupBy("context_limit").agg(
        F.sum(F.when(F.col("n_tokens") <= F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_within"),
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("truncated_total"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of ``documents`` with its suffix sums, one row for each distinct length."""
    import public_tokenizers

    counted = lengths(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return summary(materialize(histogram(counted), "lengths"))
