"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its word shingles, embedded as COORDINATES minwise tokens. The root of each of TREES
independent trees chooses a few coordinates, each with probability 1 / (threshold * COORDINATES), and sends every
document to the child named by its token there; a child with more than SMALL documents chooses coordinates of its own
and branches again. Two documents of exactly the threshold's similarity are expected to share one child at every
branching, so each tree finds them with a probability of about 0.3 at the deepest level and far more near the root, and
all trees together with about 0.9999. Small children are compared exhaustively by eight-bit sketches of the tokens;
bitmaps of the sets rule out most pairs that pass but are less alike, and the rest are confirmed on full sets. Where more
pairs pass than a child has members, as in a family of documents not alike enough, bitmaps are looked at within the task.

Skew: documents with one set are one class before anything else. A first round over CONTRACTING coordinates only links
each class with the best partner of its child, or with the best of a large child's PIVOTS, which merges big groups of
near copies; later rounds leave out children within one component and pairs within one component, so a group costs about
its size. What is still large below the deepest level is compared in blocks of BLOCK against BLOCK, but for pairs within
the component that has most of the child: the others meet it and one another.

Defined results: words are maximal runs of bytes other than ASCII white space, A-Z lower-cased. With fewer words than
a shingle has, the whole sequence is the one shingle; null texts and those without words have the empty set, are
linked with nothing and are kept. Repeated rows come out as often as they went in. Of rows that share a doc_id, one
text stands for all. Rows without a doc_id take no part and do not come out. Ties cannot arise: a component's name is its
least doc_id. A text of any length counts whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks, mix, views
from .common import materialize, maybe_broadcast, release, table
from .components import connected_components

COORDINATES = 64
TREES = 32
DEPTH = 4
SMALL = 128
CONTRACTING = 6
PIVOTS = 8
BLOCK = 1024
BITS = 2048  # of the bitmap of a set
MOST_BITS = 1 << 17  # of a bitmap that is as long as its set asks for
CROWDED = 2  # passing pairs for each member of a child beyond which they are looked at by bitmaps before they leave it
WITHIN = 2  # the side of members that meet all of their group
PASSED = 36  # of COORDINATES equal sketch bytes: at a similarity of 0.8, fewer has a probability of 4e-6
_r = np.random.default_rng(1)
FACTORS = _r.integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _r.integers(0, 1 << 63, COORDINATES, np.uint64)


def shingles(block: Block, words: int) -> list[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text of a block of lower-case texts."""
    start, end, row = block.words()
    h = block.hashes(start, end)
    n = len(block.starts)
    cuts = np.searchsorted(row, np.arange(n + 1))
    joined = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        joined += mix(h[j : j + len(joined)] + np.uint64(j)) * np.uint64(2 * j + 1)
    joined = mix(joined)
    out = []
    for i in range(n):
        a, b = cuts[i], cuts[i + 1]
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            whole = (mix(h[a:b] + np.arange(b - a, dtype=np.uint64)) * np.arange(1, 2 * (b - a), 2, dtype=np.uint64)).sum()
            out.append(mix(np.array([whole + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens (sets, COORDINATES) of nonempty sets."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(((flat * FACTORS[k] + SHIFTS[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set hashes k1 and k2, tokens (array<int>) and sketch (binary) of every row."""
    names = ["doc_id", "n_shingles", "k1", "k2", "tokens", "sketch"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b, block in blocks(batch.column("text"), lower=True):
                sets = shingles(block, words)
                size = np.array([len(s) for s in sets])
                some = np.flatnonzero(size)
                k = np.array([[s.sum(), mix(s).sum()] for s in sets], np.uint64).view(np.int64)
                t = np.zeros((len(sets), COORDINATES), np.uint32)
                if len(some):
                    t[some] = tokens([sets[i] for i in some])
                flat = pa.array(t.view(np.int32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, COORDINATES, dtype=np.int32)), flat)
                sketch = (t & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(size, pa.int64()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), lists, pa.array([x.tobytes() for x in sketch], pa.binary())], names)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, tokens array<int>, sketch binary")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, its whole shingle set (array<long>), the size of that and its bitmap of BITS bits."""
    names = ["doc_id", "shingles", "size", "bits"]

    def bitmap(found: np.ndarray) -> bytes:
        bits = np.zeros(BITS, bool)
        bits[found & np.uint64(BITS - 1)] = True
        return np.packbits(bits).tobytes()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b, block in blocks(batch.column("text"), lower=True):
                sets = shingles(block, words)
                lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists, pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>, size long, bits binary")


def possible(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of (a, b, size_a, bits_a, size_b, bits_b) whose bitmaps do not rule the similarity out: each bit that
    only one set has stands for a member that the other lacks."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("bits_a", "bits_b"))
                m, n = (np.asarray(batch.column(c)) for c in ("size_a", "size_b"))
                both = np.minimum(m - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), n - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
                ok = pa.array(both * 100 >= (m + n - both) * percent)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return pairs.select("a", "b", "size_a", "bits_a", "size_b", "bits_b").mapInArrow(run, "a long, b long")


def roots(seed: int = 2) -> list[list[int]]:
    """The coordinates that the root of each tree chooses."""
    r = np.random.default_rng(seed)
    return [np.flatnonzero(r.random(COORDINATES) < 1 / (0.8 * COORDINATES)).tolist() or [int(r.integers(COORDINATES))] for _ in range(TREES)]


def child(coordinate: int) -> Column:
    """The root's child of the tokens at a coordinate."""
    return F.xxhash64(F.lit(coordinate), F.col("tokens")[coordinate])


def _whole_groups(stream: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted rows, cut between nodes; sketches are rows of a matrix, bitmaps bytes."""

    def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        now = {c: np.asarray(batch.column(c)) for c in batch.schema.names if c not in ("sketch", "bits")}
        data, starts, _ = views(batch.column("sketch"))
        now["sketch"] = data[starts[0] : starts[0] + batch.num_rows * COORDINATES].reshape(-1, COORDINATES)
        if "bits" in batch.schema.names:
            now["bits"] = np.array([*batch.column("bits").to_pylist(), None], object)[:-1]  # bytes stay objects
        return now

    held: list[dict[str, np.ndarray]] = []
    for batch in stream:
        if not batch.num_rows:
            continue
        now = arrays(batch)
        held.append(now)
        if now["node"][-1] == held[0]["node"][0]:
            continue
        whole = {c: np.concatenate([x[c] for x in held]) for c in now}
        node = whole["node"]
        cut = int(len(node) - np.argmax(node[::-1] != node[-1]))
        yield {c: x[:cut] for c, x in whole.items()}
        held = [{c: x[cut:] for c, x in whole.items()}]
    if held:
        yield {c: np.concatenate([x[c] for x in held]) for c in held[0]}


def _alike(node: np.ndarray, component: np.ndarray, sketch: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i and j of one node whose sketches pass, of different components, and how many bytes are equal. With ``side``, of
    different sides, or both WITHIN."""
    first = np.arange(len(node))
    for d in range(1, len(node)):
        first = first[: np.searchsorted(first, len(node) - d)]
        first = first[node[first] == node[first + d]]
        if not len(first):
            break
        i = first[component[first] != component[first + d]]
        if side is not None:
            i = i[(side[i] != side[i + d]) | (side[i] == WITHIN)]
        same = np.concatenate([(sketch[x] == sketch[x + d]).sum(axis=1) for x in np.array_split(i, max(1, len(i) >> 16))])
        ok = same >= PASSED
        yield i[ok], i[ok] + d, same[ok]


def compare_children(members: DataFrame, best_only: bool) -> DataFrame:
    """Pairs (a, b) within small children whose sketches pass, of different components; for the first round each
    member's best partner only. Else a child with more than CROWDED passing pairs for each member gives its members, as a and
    ``node`` without b, in place of the pairs: those are for compare_bitmaps()."""
    names = ["a", "b"] if best_only else ["a", "b", "node"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(stream):
            node, cid = group["node"], group["cid"]
            found = list(_alike(node, group["component"], group["sketch"]))
            if not found:
                continue
            left, right, seen = map(np.concatenate, zip(*found, strict=True))
            if best_only:
                who, partner, score = np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([seen, seen])
                order = np.lexsort((cid[partner], -score, who))
                keep = order[np.concatenate([[True], who[order][1:] != who[order][:-1]])] if len(order) else order
                left, right = who[keep], partner[keep]
            else:
                of = np.cumsum(np.concatenate([[0], node[1:] != node[:-1]]))
                crowded = np.bincount(of[left], minlength=of[-1] + 1) > CROWDED * np.bincount(of)
                few, there = ~crowded[of[left]], crowded[of]
                left, right = left[few], right[few]
                if there.any():
                    yield pa.RecordBatch.from_arrays([pa.array(cid[there]), pa.nulls(int(there.sum()), pa.int64()), pa.array(node[there])], names)
            a, b = cid[left], cid[right]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())][: len(names)], names)

    placed = members.select("node", "cid", "component", "sketch").repartition("node").sortWithinPartitions("node")
    return placed.mapInArrow(run, ", ".join(f"{c} long" for c in names)).distinct()


class Bitmaps:
    """Bitmaps of sets, 8 bits or more for each member, up to MOST_BITS. The bit of a member in half the bits is that of its hash
    with one bit less, so the wider of two maps is folded."""

    def __init__(self, size: np.ndarray, bits: np.ndarray):
        self.size = size
        self.words = np.fromiter((len(x) // 8 for x in bits), np.int64, len(bits))
        self.at = np.zeros(len(bits), np.int64)
        self.maps, self.folded = {}, {}
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == w)
            self.at[own] = np.arange(len(own))
            self.maps[w] = np.frombuffer(b"".join(bits[own]), np.uint64).reshape(-1, w)
            self.folded[w // 2] = self.maps[w][:, : w // 2] | self.maps[w][:, w // 2 :]

    @staticmethod
    def of(members: np.ndarray) -> bytes:
        """The bitmap of a set of hashes."""
        bits = np.zeros(min(MOST_BITS, max(512, 1 << (8 * len(members) - 1).bit_length())), bool)
        bits[members & np.uint64(len(bits) - 1)] = True
        return np.packbits(bits).tobytes()

    def rows(self, of: np.ndarray, words: int) -> np.ndarray:
        """The maps of some sets in so many words, which is what they have or half of that."""
        out = np.empty((len(of), words), np.uint64)
        own = self.words[of] == words
        for here, maps in ((own, self.maps), (~own, self.folded)):
            if here.any():
                out[here] = maps[words][self.at[of[here]]]
        return out

    def possible(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether maps and sizes leave the similarity possible: each bit that only one set has stands for a member that the
        other lacks."""
        m, n = self.size[i], self.size[j]
        ok = np.minimum(m, n) * 100 >= np.maximum(m, n) * percent
        words = np.minimum(self.words[i], self.words[j])
        ok &= np.maximum(self.words[i], self.words[j]) <= 2 * words  # sizes so near differ by one fold at most
        for w in np.unique(words[ok]).tolist():
            of = np.flatnonzero(ok & (words == w))
            for k in np.array_split(of, max(1, len(of) * w >> 18)):
                x, y = self.rows(i[k], w), self.rows(j[k], w)
                both = np.minimum(m[k] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), n[k] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
                ok[k] = both * 100 >= (m[k] + n[k] - both) * percent
        return ok


def compare_bitmaps(docs: DataFrame, known: DataFrame, placed: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components whose sketches pass and whose bitmaps leave the similarity possible, within the
    nodes of ``placed`` (node, cid, side): of crowded children, where pairs of less likeness would grow with the square of a
    family. Bitmaps are made for their members only, and pairs ruled out do not leave the task."""

    def mapped(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b, block in blocks(batch.column("text"), lower=True):
                sets = shingles(block, words)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([Bitmaps.of(s) for s in sets], pa.binary())], ["cid", "size", "bits"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(stream):
            cid, maps = group["cid"], Bitmaps(group["size"], group["bits"])
            for i, j, _ in _alike(group["node"], group["component"], group["sketch"], group["side"]):
                ok = maps.possible(i, j, percent)
                a, b = cid[i[ok]], cid[j[ok]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    placed = materialize(placed, "placed")
    used = materialize(placed.select("cid").distinct(), "used")
    few = maybe_broadcast(used, width=16)
    texts = docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("cid"), "left_semi")
    maps = texts.mapInArrow(mapped, "cid long, size long, bits binary").dropDuplicates(["cid"])
    maps = materialize(known.select("cid", "component", "sketch").join(few, "cid", "left_semi").join(maps, "cid"), "maps")
    met = placed.join(maps, "cid").select("node", "cid", "component", "side", "sketch", "size", "bits")
    found = materialize(met.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long").distinct(), "pairs")
    release(placed, used, maps)
    return found


def compare_pivots(members: DataFrame, big: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of the children ``big`` with the best of their child's pivots whose sketch passes; pivots meet
    all pivots of their child. Pivots are the least members of PIVOTS parts by hash."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            cid, lists = np.asarray(batch.column("cid")), batch.column("pivots")
            pivot = np.asarray(lists.flatten().field("b"))
            row = np.repeat(np.arange(len(cid)), np.asarray(lists.value_lengths()))
            own, theirs = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in (batch.column("sketch"), lists.flatten().field("sketch")))
            same = np.concatenate([(own[row[i : i + 65536]] == theirs[i : i + 65536]).sum(axis=1) for i in range(0, len(row), 65536)])
            is_pivot = np.bincount(row, pivot == cid[row], len(cid)) > 0
            same[pivot == cid[row]] = 0
            order = np.lexsort((pivot, -same, row))
            best = np.zeros(len(row), bool)
            best[order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]] = True
            ok = (same >= PASSED) & (best | is_pivot[row])
            x, y = cid[row[ok]], pivot[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    n = big.count()
    within = members.select("node", "cid", "sketch").join(maybe_broadcast(big.select("node"), n, width=16), "node")
    chosen = within.groupBy("node", F.pmod(F.xxhash64("cid"), F.lit(PIVOTS))).agg(F.min("cid").alias("b")).select("node", "b")
    chosen = classes.select(F.col("cid").alias("b"), "sketch").join(maybe_broadcast(chosen, n * PIVOTS), "b")
    pivots = chosen.groupBy("node").agg(F.collect_list(F.struct("b", "sketch")).alias("pivots"))  # PIVOTS at most
    met = within.join(maybe_broadcast(pivots, n, width=128 * PIVOTS), "node").select("cid", "sketch", "pivots")
    return met.mapInArrow(run, "a long, b long").distinct()


def blockwise(members: DataFrame, mixed: DataFrame) -> DataFrame:
    """node, cid and side of the members of the children ``mixed``, in blocks of about BLOCK members against BLOCK, each a node;
    the members of a child's main component, that with most of it, meet the others only, not one another."""
    n = mixed.count()
    within = members.select("node", "cid", "component").join(maybe_broadcast(mixed.select("node"), n, width=16), "node")
    counts = within.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    shape = counts.groupBy("node").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    blocks = lambda of: F.ceil(of / BLOCK).cast("int")
    shape = materialize(shape.select("node", F.col("main.component").alias("main"), blocks(F.col("main.n")).alias("mains"), blocks(F.col("n") - F.col("main.n")).alias("rests")), "shape")
    placed = within.join(maybe_broadcast(shape, n), "node").withColumn("is_main", F.col("component") == F.col("main"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    others = F.expr("sequence(0, rests - 1)")
    # an other block meets each other block (kind 0, least block first) and each main block (kind 1)
    rest = F.transform(others, lambda k: F.struct(F.lit(0).alias("kind"), F.least("block", k).alias("i"), F.greatest("block", k).alias("j"), F.when(k == F.col("block"), WITHIN).otherwise((k < F.col("block")).cast("int")).alias("side")))
    to_main = F.transform(F.expr("sequence(0, mains - 1)"), lambda k: F.struct(F.lit(1).alias("kind"), F.col("block").alias("i"), k.alias("j"), F.lit(0).alias("side")))
    of_main = F.transform(others, lambda k: F.struct(F.lit(1).alias("kind"), k.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))
    met = placed.select("node", "cid", F.explode(F.when(F.col("is_main"), of_main).otherwise(F.concat(rest, to_main))).alias("x"))
    met = materialize(met.select(F.xxhash64("node", "x.kind", "x.i", "x.j").alias("node"), "cid", "x.side"), "blocks")
    release(shape)
    return met


def confirm(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    used = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "used")
    texts = docs.select("doc_id", "text").join(maybe_broadcast(used, width=16), "doc_id", "left_semi")
    sets = materialize(full_sets(texts, words).dropDuplicates(["doc_id"]), "sets")
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("doc_id").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")), c)
    left = stored = materialize(possible(pairs, percent), "possible")
    for c in "ab":
        left = left.join(sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}")), c)
    met = left.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    links = materialize(met.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b"), "links")
    release(stored)
    release(used, sets)
    return links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text) that has a doc_id; see the module's text."""
    signed = materialize(signatures(docs, words), "signed")
    classes = materialize(signed.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"), F.min_by("tokens", "doc_id").alias("tokens"), F.min_by("sketch", "doc_id").alias("sketch")), "classes")
    chosen = roots()
    coordinates = sorted({c for tree in chosen for c in tree})

    def members(of: DataFrame, at: list[int]) -> DataFrame:
        return of.select("cid", "component", "sketch", "tokens", F.explode(F.array(*[F.struct(child(c).alias("node"), F.lit(c).alias("coordinate")) for c in at])).alias("x")).select("cid", "component", "sketch", "tokens", "x.*")

    def large(of: DataFrame) -> DataFrame:
        sizes = of.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("coordinate").alias("coordinate"))
        return materialize(sizes.where(f"n > {SMALL}"), "large")

    # first round: merge what is plainly alike
    first = members(classes.withColumn("component", F.col("cid")), coordinates[:CONTRACTING])
    big = large(first)
    hint = maybe_broadcast(big.select("node"), width=16)
    found = compare_children(first.join(hint, "node", "left_anti"), best_only=True)
    pairs = materialize(found.unionByName(compare_pivots(first, big, classes)).distinct(), "pairs")
    links = confirm(docs, pairs, words, percent)
    release(pairs, big)
    merged = connected_components(links)
    known = materialize(classes.drop("k1", "k2").join(merged.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")), "known")

    # then all trees, level by level, for links between components
    level, found, placed, stored = members(known, coordinates), [], [], []
    for depth in range(1, DEPTH + 1):
        big = large(level)
        stored.append(big)
        small = level.join(maybe_broadcast(big.select("node"), width=16), "node", "left_anti")
        found.append(materialize(compare_children(small, best_only=False), "pairs"))
        placed.append(found[-1].where("node is not null").select("node", F.col("a").alias("cid"), F.lit(WITHIN).alias("side")))
        mixed = big.where("lo < hi")
        if not mixed.limit(1).count():
            break
        if depth == DEPTH:
            stored.append(blockwise(level, mixed))
            placed.append(stored[-1])
            break
        picked = mixed.select("node", F.col("node").alias("own"), "coordinate")
        if depth == 1:  # from here on trees differ
            trees = F.create_map(*[x for c in coordinates for x in (F.lit(c), F.array(*[F.lit(t) for t, own in enumerate(chosen) if c in own]))])
            picked = picked.withColumn("tree", F.explode(trees[F.col("coordinate")])).withColumn("own", F.xxhash64("node", "tree"))
        rate = int((1 << 20) / (0.8 * COORDINATES))
        picks = F.expr(f"filter(sequence(0, {COORDINATES - 1}), c -> pmod(xxhash64(own, c), {1 << 20}) < {rate})")
        picked = picked.select("node", "own", F.explode(picks).alias("coordinate"))
        below = level.drop("coordinate").join(maybe_broadcast(picked), "node")
        level = materialize(below.withColumn("node", F.expr("xxhash64(own, coordinate, tokens[coordinate])")).drop("own"), "level")
        stored.append(level)
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    stored.append(compare_bitmaps(docs, known, union(placed), words, percent))
    pairs = [*(x.where("node is null").select("a", "b") for x in found), stored[-1]]
    pairs = materialize(union(pairs).distinct(), "pairs")
    new = confirm(docs, pairs, words, percent)
    release(pairs, *found, *stored)
    whole = connected_components(links.unionByName(new)) if new.limit(1).count() else merged
    named = classes.select("k1", "k2", "cid").join(whole.withColumnRenamed("node", "cid"), "cid", "left").select("k1", "k2", F.coalesce("component", "cid").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op1_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` over sets of two-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
