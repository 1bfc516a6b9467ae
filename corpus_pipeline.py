"""The training-data pipeline over ``documents``: language ID, line dedup, near-dedup, suffix dedup, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.llm import language_id, line_dedup, near_dedup, packing, repeats
from gridjobs.llm.common import free_name, materialize, maybe_broadcast, release, table


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and those without a letter go. Without any labels to learn from, and
    so for an empty table, all stay. Repeated rows, rows without doc_id and other columns pass."""
    net = language_id.fit(docs)
    if net is None:
        return docs
    name, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    return language_id.predict(docs, net, name, score).where(F.col(name) != language_id.UNKNOWN).select(*docs.columns)


def told(text: str = "text") -> Column:
    """True for a text with more than white space."""
    return F.coalesce(F.col(text).rlike(r"\S"), F.lit(False))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line, exactly or nearly; documents of which only white space is left
    go, null texts too. Rows without doc_id keep their lines; columns but text and n_chars pass."""
    clash = {c: free_name(docs, f"own_{c}") for c in ("n_lines", "n_removed") if c in docs.columns}
    found = line_dedup.keep_first_lines(docs.withColumnsRenamed(clash)).drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in clash.items()})
    return found.where(told()).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), that of the least doc_id, and one row of it where
    rows of a doc_id repeat. Rows without doc_id stay."""
    found = near_dedup.near_duplicates(docs, words=5, percent=80)
    rows, own = free_name(docs, "rows"), free_name(docs, "of")
    kept = materialize(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias(rows)), "kept")
    met = docs.join(maybe_broadcast(kept, width=32), docs["doc_id"] == kept[own], "left").where(F.col(own).isNotNull() | F.col("doc_id").isNull())
    if not kept.where(F.col(rows) > 1).limit(1).count():
        return met.select(*docs.columns)
    once = met.where(F.coalesce(F.col(rows), F.lit(1)) == 1)
    return once.unionByName(met.where(F.col(rows) > 1).dropDuplicates(["doc_id"])).select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 100 bytes or more that also start earlier; documents of which only white space is left
    go. Rows without doc_id stay whole; columns but text and n_chars pass."""
    found = repeats.without_repeats(docs)
    return found.where(told()).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids; of an empty table none."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack),
]
#: Several stages are beyond SQL; a test holds the stages against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage has read is deleted when it has written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
