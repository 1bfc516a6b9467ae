"""Document fingerprints by SpotSigs.

Wherever a common word (an anchor) stands, the next CHAIN content words after it form a spot signature. A document is
the set of its signatures, each hashed to 32 bits; its fingerprint is that set in ascending order as hexadecimal text.
Two documents are compared by Jaccard similarity of their sets, pruned by set sizes first: sizes whose quotient is
below the threshold cannot reach it, so near_pairs() looks only within partitions by set length and the next one up,
through an inverted index of each document's rarest signatures.

Defined results: a null text is empty. A text with words but no spot takes each of its words as an anchor; one with
fewer words than a chain takes all its words as one signature; one without words has the empty fingerprint. Two empty
fingerprints are alike (1), an empty and another are not (0). Equal texts have equal fingerprints. Among rows of one
doc_id the text decides the order. The only document of a table is its own next. A row without doc_id is its own next and
nobody else's. As many rows come out as go in; an empty table gives none. A text of any length is one value; columns but
doc_id and text, whatever their names, are not looked at.

The registered query compares given pairs of texts and needs their exact likeness, so it takes no threshold; near_pairs()
is for looking for likeness among all documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks, mix
from .common import materialize, table

CHAIN = 2
#: Fixed value: common words of English, German, French and Spanish that serve as anchors.
ANCHORS = """
a an the is are was were be to of in on at by for with and that this it as from or not
der die das ein eine ist sind war und zu in von mit auf den dem des im für nicht es sich
le la les un une des est sont et de du en que qui pour par sur dans pas au
el la los las un una es son y de del en que por para con se no lo
""".split()
RANGES_PER_PARTITION = 4


def spots(block: Block) -> list[np.ndarray]:
    """The sorted set of 32-bit spot signatures of each text of a block of lower-case texts."""
    start, end, row = block.words()
    h = block.hashes(start, end)
    anchors, at, to, _ = _anchors()
    is_anchor = np.isin(h, anchors)
    content = np.flatnonzero(~is_anchor)
    after = np.concatenate([[0], np.cumsum(~is_anchor)])[1:]  # content words up to and with each word: place of the next one
    sig = np.zeros(len(h), np.uint64)
    ok = np.zeros(len(h), bool)
    place = after + np.arange(CHAIN)[:, None]
    inside = place[-1] < len(content)
    if len(content):
        chain = content[np.minimum(place, len(content) - 1)]
        ok = inside & (row[chain[-1]] == row)
        sig = mix(h[chain[0]] + mix(h[chain[1]]) * np.uint64(3)) + h * np.uint64(5)
    spot = ok & is_anchor
    have = np.bincount(row[spot], minlength=len(block.starts)) > 0
    use = spot | (ok & ~have[row])  # no spot: every word is an anchor
    covered = np.bincount(row[use], minlength=len(block.starts)) > 0
    out32 = (mix(sig) >> np.uint64(32)).astype(np.uint32)
    order = np.flatnonzero(use)
    cuts = np.searchsorted(row[order], np.arange(len(block.starts) + 1))
    word_cuts = np.searchsorted(row, np.arange(len(block.starts) + 1))
    sets = []
    for i in range(len(block.starts)):
        if covered[i]:
            sets.append(np.unique(out32[order[cuts[i] : cuts[i + 1]]]))
        elif word_cuts[i] < word_cuts[i + 1]:  # too few words for a chain
            words = h[word_cuts[i] : word_cuts[i + 1]]
            whole = mix(np.array([(words * np.arange(1, 2 * len(words), 2, dtype=np.uint64)).sum()], np.uint64))
            sets.append((whole >> np.uint64(32)).astype(np.uint32))
        else:
            sets.append(np.zeros(0, np.uint32))
    return sets


_known: list[np.ndarray] = []


def _anchors() -> tuple[np.ndarray, np.ndarray, np.ndarray, Block]:
    if not _known:
        (_, _, block), *_ = blocks(pa.array([" ".join(sorted(set(ANCHORS)))]))
        s, e, _ = block.words()
        _known.extend([block.hashes(s, e), s, e, block])
    return tuple(_known)


def jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without a look at their members if their sizes rule ``threshold`` out."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def text_of(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``spots`` (array<long>), the sorted set of signatures."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b, block in blocks(batch.column("text"), lower=True):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([s.astype(np.int64) for s in spots(block)], pa.list_(pa.int64()))], ["doc_id", "spots"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spots array<long>")


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, similarity) of different fingerprints, by their least doc_id, of at least ``threshold``.

    Sets fall into partitions by length, each as wide as the threshold allows partners to be; a set meets sets of its own
    partition and of the next. Only the rarest signatures are indexed: sets that share none of their first
    n - ceil(threshold * n) + 1 cannot reach the threshold. Documents with equal fingerprints stand as one.
    """
    sets = materialize(fingerprints(docs).where(F.size("spots") > 0).groupBy("spots").agg(F.min("doc_id").alias("doc_id")), "spots")
    each = sets.select("doc_id", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    counts = each.groupBy("spot").agg(F.count(F.lit(1)).alias("docs"))
    ranked = each.join(counts, "spot").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("docs", "spot"))).alias("by_rarity"))
    prefix = F.expr(f"slice(by_rarity, 1, int(n - ceil({threshold} * n - 1e-9) + 1))")
    band = F.floor(F.log("n") / -math.log(threshold) + 1e-9)
    index = ranked.select("doc_id", "n", band.alias("band"), F.explode(F.transform(prefix, lambda x: x["spot"])).alias("spot"))
    probe = index.select(F.col("doc_id").alias("other"), F.col("n").alias("m"), "spot", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    met = index.join(probe, ["spot", "band"]).where(f"doc_id <> other and least(n, m) >= {threshold} * greatest(n, m)")
    pairs = met.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("spots").alias(f"spots_{c}")) for c in "ab")
    both = F.size(F.array_intersect("spots_a", "spots_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("spots_a") + F.size("spots_b") - both)).alias("similarity")).where(F.col("similarity") >= threshold)


def followed(docs: DataFrame) -> DataFrame:
    """Rows (range, last, doc_id, text) sorted within partitions such that each document is followed by the next in
    ascending doc_id, the end of a range by the first document of the next range (``last`` is 1 there). Rows without doc_id
    are dealt out over the ranges, after all others (``last`` is 2).

    Ranges of doc_id come from approximate quantiles, so they are even; there are a few for each shuffle partition, and
    only their first ids go through the driver.
    """
    spark = docs.sparkSession
    n = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = named.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    ranged = named.withColumn("range", place)
    firsts = sorted((r["range"], r["first"]) for r in ranged.groupBy("range").agg(F.min("doc_id").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    ends = spark.createDataFrame([(k, v) for k, v in before.items()], "doc_id long, range int")
    more = ranged.drop("range").join(F.broadcast(ends), "doc_id").withColumn("last", F.lit(1))
    bare = docs.where("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bare = bare.withColumn("range", F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).withColumn("last", F.lit(2))
    both = ranged.withColumn("last", F.lit(0)).unionByName(more).unionByName(bare)
    return both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "range").sortWithinPartitions("range", "last", "doc_id", "text")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text (its last half replaced by the first code points of the
    next document, ascending doc_id) and that of the next document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def out(rows: list[tuple[int | None, str]], then: list[str]) -> pa.RecordBatch:
        """then: the next text of each row, which is that of the following row but for the last one and for rows without id."""
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for (_, t), x in zip(rows, then, strict=True)]
        sets: list[np.ndarray] = []
        for _, _, block in blocks(pa.array([t for _, t in rows] + edited + then[-1:], pa.large_string()), lower=True):
            sets += spots(block)
        n = len(rows)
        own, new, last = sets[:n], sets[n : 2 * n], sets[2 * n]
        following = own if rows[0][0] is None else [*own[1:], last]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in rows], pa.int64()),
                pa.array([len(t) for _, t in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(list(map(text_of, own))),
                pa.array(list(map(text_of, new))),
                pa.array(list(map(jaccard, own, new)), pa.float64()),
                pa.array(list(map(jaccard, own, following)), pa.float64()),
            ],
            names,
        )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []  # consecutive documents of one range; the last waits for its next
        bare: list[tuple[None, str]] = []  # rows without doc_id
        size, more, current, closed = 0, 0, None, False
        for batch in stream:
            for of, last, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "last", "doc_id", "text")), strict=True):
                if last == 2:
                    bare.append((None, text))
                    more += len(text)
                    if more >= 1 << 20:
                        yield out(bare, [t for _, t in bare])
                        bare, more = [], 0
                    continue
                if of != current:
                    if held and not closed:
                        raise ValueError(f"range {current} of documents has no next one")
                    held, size, current, closed = [], 0, of, False
                if last:  # the first document of the next range (its copies of the same id come after it)
                    if held and not closed:
                        yield out(held, [t for _, t in held[1:]] + [text])
                    held, closed = [], True
                    continue
                held.append((doc_id, text))
                size += len(text)
                if size >= 1 << 20:
                    if len(held) > 1:
                        yield out(held[:-1], [t for _, t in held[1:]])
                    held, size = held[-1:], len(text) if len(text) < 1 << 20 else 0
        if held and not closed:
            raise ValueError(f"range {current} of documents has no next one")
        if bare:
            yield out(bare, [t for _, t in bare])

    return followed(docs).select("range", "last", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text, and their likeness."""
    return compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
