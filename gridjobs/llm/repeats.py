"""Suffix-array dedup: bytes of strings of LENGTH bytes that also start earlier, found by merging shard Burrows-Wheeler
transforms.

Every start of such a string ("window") belongs to the run of windows that share its minimizer: the least hash of the
GRAM-byte strings within it. Equal windows have equal minimizers, so runs whose minimizer occurs once are done with. Runs
with equal bytes, by two hashes of 64 bits, are one string with several places. All strings of the other minimizers, each
with its bytes once, go to collections of about COLLECTION bytes, whole minimizers each.
The transforms of a collection's shards are built by prefix doubling and merged by iterative interleave refinement. Round
h of it puts all suffixes in the order of their first STEP * h symbols: those of a block by the places that the suffixes
STEP symbols shorter had in the round before. Suffixes that stand alone are passed over. Where a boundary appears first,
the common prefix is less than STEP * h long; what no boundary parts after LENGTH symbols is an
interval. Windows of an interval with several places are repeats; those of a string with several places go to its later
places by a join. No suffixes are sorted anew.

Skew: within a block of texts, a run whose bytes were met before repeats and is combined with the first before anything is
shuffled. Later places never meet in a task's memory. A minimizer with more than HOT different strings is taken apart into
its windows, which are compared by 128-bit hashes under a map-side aggregation, so no group is gathered.

Defined results: a null text is empty; windows do not cross texts. Order is by doc_id, then start; equal positions (rows
repeated with their doc_id) are one; rows without a doc_id take no part and stay whole. Texts under LENGTH bytes are kept
whole, a text of any length is one string of windows; an empty table gives no rows. Columns besides doc_id and text pass
through whatever their names, and only where texts are given back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import Block, blocks, mix, spans, views
from .common import free_name, materialize, maybe_broadcast, release, table

LENGTH = 100
GRAM = 32
HOT = 50_000
#: Bytes of one merged collection and of one shard, about.
COLLECTION, SHARD = 1 << 18, 1 << 16
#: Symbols that a round of the merge looks at; LENGTH is a multiple.
STEP = 5
#: A run's string, by its hashes.
STRING = ["minimizer", "content", "more"]
#: Bytes of runs that are compared at a time.
COMPARED = 1 << 22


def runs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, minimizer and row of each run of a block."""
    n, around = len(block.data), LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.view(np.uint64), none
    grams = block.hashes(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    least, width = grams, 1
    while width * 2 <= around:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[around - width : around - width + n - LENGTH + 1])
    valid = np.zeros(n + 1, np.int32)
    long = block.ends - block.starts >= LENGTH
    np.add.at(valid, block.starts[long], 1)
    np.add.at(valid, block.ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(valid)[: len(least)] > 0
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    new[block.starts[long]] = True
    start = np.flatnonzero(new & valid)
    row = block.rows(start)
    after = np.append(start[1:], n)
    return start, np.minimum(after, block.ends[row] - LENGTH + 1) - start, least[start], row


def coalesce(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals joined where they touch or overlap; any two of one document that nest do not occur."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(stop, first)


def halves(block: Block, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Second hashes of the bytes from start to stop."""
    middle = (start + stop) // 2
    return mix(block.hashes(start, middle) * np.uint64(3) + block.hashes(middle, stop))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b are the same, over each length."""
    out = np.ones(len(a), bool)
    stop = np.cumsum(length)
    for x, y in spans(stop - length, stop, COMPARED):
        n = length[x:y]
        row = np.repeat(np.arange(y - x), n)
        off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        out[x + row[data[a[x:y][row] + off] != data[b[x:y][row] + off]]] = False
    return out


def found_runs(docs: DataFrame) -> DataFrame:
    """minimizer, content, more, doc_id and place (128 * start + number of windows) of each run; and intervals known to
    repeat, with place -1 - start, their stop as content and any minimizer."""
    names = [*STRING, "doc_id", "place"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids = np.asarray(batch.column("doc_id"))
            for a, _, block in blocks(batch.column("text")):
                start, n, minimizer, row = runs(block)
                if not len(start):
                    continue
                stop = start + n + LENGTH - 1
                content, more = block.hashes(start, stop), halves(block, start, stop)
                doc, at = ids[a + row], start - block.starts[row]
                order = np.lexsort((at, doc, content, minimizer))
                m, c, e, d, s, size, spot = (x[order] for x in (minimizer, content, more, doc, at, n, start))
                first = np.concatenate([[True], (m[1:] != m[:-1]) | (c[1:] != c[:-1])])
                lead = np.flatnonzero(first)[np.cumsum(first) - 1]
                later = np.flatnonzero(((d != d[lead]) | (s != s[lead])) & (size == size[lead]))
                again = later[same_bytes(block.data, spot[later], spot[lead[later]], size[later] + LENGTH - 1)]
                alone = np.ones(len(order), bool)
                alone[again] = False
                alone &= first | (d != d[lead]) | (s != s[lead])
                cut = coalesce(d[again], s[again], (s + size + LENGTH - 1)[again])
                any_key = mix(cut[0].astype(np.uint64) + mix(cut[1].astype(np.uint64)))
                for cols in ((m[alone], c[alone], e[alone], d[alone], s[alone] * 128 + size[alone]), (any_key, cut[2], np.zeros_like(cut[2]), cut[0], -1 - cut[1])):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in cols], names)

    known = docs.where("doc_id is not null").select("doc_id", "text")
    return known.mapInArrow(run, "minimizer long, content long, more long, doc_id long, place long")


def suffixes(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffix array of strings that each end with a 0; ``end`` is where each position's string ends. Strings that are
    equal stand in their order."""
    n, at = len(text), np.arange(len(text))
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | np.where(at + j <= end, padded[j : j + n], 0).astype(np.uint64)
    width, longest = 8, int((end - at).max()) + 1
    while True:
        order = np.argsort(key)
        found = key.take(order)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], found[1:] != found[:-1]]))
        if width >= longest or rank.max() == n:
            return np.argsort(rank * n + at)
        inside = at + width <= end
        key = rank * (n + 1)
        key[inside] += rank[at[inside] + width]
        width *= 2


def merge_transforms(shards: list[tuple[np.ndarray, int]], length: int, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges shards' transforms by refining their interleave, ``step`` symbols a round, to the first ``length`` symbols (a
    multiple of ``step``).

    shards: (transform, number of strings) each. Gives, for each suffix of all shards in turn, its merged place, and by
    merged place the block of suffixes alike in ``length`` symbols, and the common prefix with the suffix before
    (``length`` if at least that; cut down to a multiple of ``step``).
    """
    n, top = sum(len(b) for b, _ in shards), sum(k for _, k in shards)
    shorter, first = np.arange(n), np.zeros(n, np.uint8)  # by suffix: that without its first symbol, and that symbol
    base = 0
    for b, k in shards:  # the ends of strings come first, and stay where they are
        inner = np.flatnonzero(b)
        order = np.argsort(b[inner], kind="stable")
        own = np.arange(base + k, base + len(b))
        shorter[own], first[own] = base + inner[order], b[inner][order]
        base += len(b)
    gram, rest = first.astype(np.uint64), shorter  # the first ``step`` symbols, and the suffix without them
    for _ in range(step - 1):
        gram, rest = (gram << np.uint64(8)) | first.take(rest), shorter.take(rest)
    at = np.argsort(gram, kind="stable")
    place, spots = np.empty(n, np.int64), np.arange(n)
    place[at] = spots
    new = np.ones(n + 1, bool)
    new[top + 1 : n] = gram[at][top + 1 :] != gram[at][top:-1]
    begun = np.maximum.accumulate(np.where(new[:n], spots, 0))  # where the block of a place begins
    prefix = (~new[:n]).astype(np.int16)  # rounds without a boundary
    active = spots  # places whose blocks have several suffixes
    for _ in range(1, length // step):
        active = active[~(new.take(active) & new.take(active + 1))]
        if not len(active):
            break
        moved, parted = at.take(active), new.take(active)
        came = place.take(rest.take(moved))
        order = np.argsort(begun.take(active) * n + came)
        moved, came = moved.take(order), begun.take(came.take(order))
        at[active], place[moved] = moved, active
        parted[1:] |= came[1:] != came[:-1]
        new[active] = parted
        begun[active] = np.maximum.accumulate(np.where(parted, active, 0))
        prefix[active] += ~parted
    return place, np.cumsum(new[:n]) - 1, prefix * np.int16(step)


def repeated(strings: list[np.ndarray], doc: np.ndarray, start: np.ndarray, several: np.ndarray) -> tuple[tuple, tuple]:
    """Two lots of intervals of the different strings (bytes at doc, start, their first place): those (doc, start, stop) of
    windows that also start earlier, and for strings with ``several`` places those (string, from, to) that repeat at each
    later place, counted from the string's start."""
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    owner = np.repeat(np.arange(len(strings)), length + 1)
    text = np.zeros(len(owner), np.uint8)
    stop = np.cumsum(length + 1)
    begin = stop - length - 1
    text[np.arange(len(text)) != stop[owner] - 1] = np.concatenate(strings) + 1
    shards, arrays = [], []
    for a, b in spans(begin, stop, SHARD):
        lo, hi = int(begin[a]), int(stop[b - 1])
        order = suffixes(text[lo:hi], stop[owner[lo:hi]] - 1 - lo)
        before = np.where(np.isin(order + lo, begin[a:b]), 0, text[lo:hi][order - 1])
        shards.append((before.astype(np.uint8), b - a))
        arrays.append(order + lo)
    place, block, _ = merge_transforms(shards, LENGTH, STEP)
    where = np.empty(len(text), np.int64)
    where[place] = np.concatenate(arrays)
    own = owner[where]
    places = np.bincount(block, weights=1 + several[own])  # of a block's windows; two stands for more
    many = np.flatnonzero((places[block] > 1) & (stop[own] - 1 - where >= LENGTH))
    own, of, at = own[many], block[many], where[many] - begin[own[many]]
    d, s = doc[own], start[own] + at
    order = np.lexsort((s, d, of))
    own, of, at, d, s = own[order], of[order], at[order], d[order], s[order]
    first = np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    again = (d != d[lead]) | (s != s[lead])
    later = several[own]
    return coalesce(d[again], s[again], s[again] + LENGTH), coalesce(own[later], at[later], at[later] + LENGTH)


def with_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (STRING, several, doc_id, place) with bytes."""
    fields = [*STRING, "several", "place"]
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    met = docs.select("doc_id", "text").join(lists, "doc_id")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            data, starts, ends = views(batch.column("text"))
            lists = batch.column("wanted")
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            place = np.asarray(flat.field("place"))
            at = starts[row] + place // 128
            to = at + place % 128 + LENGTH - 1
            there = np.flatnonzero(to <= ends[row])  # else it is of another text with this doc_id
            for k in range(0, len(there), 1 << 15):
                part = there[k : k + (1 << 15)]
                take = pa.array(part)
                found = [data[x:y].tobytes() for x, y in zip(at[part].tolist(), to[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(flat.field(x).take(take) for x in fields), pa.array(np.asarray(batch.column("doc_id"))[row[part]]), pa.array(found, pa.binary())], [*fields, "doc_id", "bytes"])

    return met.mapInArrow(run, "minimizer long, content long, more long, several boolean, place long, doc_id long, bytes binary")


def collection_repeats(rows: pa.Table) -> pa.RecordBatch:
    """Intervals that repeat among the strings of whole minimizers, sorted by STRING: of the first places by doc_id, and,
    counted from its start, those of each string with ``several`` places, without doc_id."""
    keys = [rows.column(x).to_numpy() for x in STRING]
    lead = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    rows = rows.take(pa.array(lead))
    texts = [np.frombuffer(x, np.uint8) for x in rows.column("bytes").to_pylist()]
    own, (of, a, b) = repeated(texts, rows.column("doc_id").to_numpy(), rows.column("place").to_numpy() // 128, rows.column("several").to_numpy())
    none = pa.nulls(len(own[0]), pa.int64())
    found = [pa.concat_arrays([none, pa.array(k[lead][of])]) for k in keys]
    found.append(pa.concat_arrays([pa.array(own[0].astype(np.int64)), pa.nulls(len(of), pa.int64())]))
    found += [pa.array(np.concatenate(x).astype(np.int64)) for x in ((own[1], a), (own[2], b))]
    return pa.RecordBatch.from_arrays(found, [*STRING, "doc_id", "start", "stop"])


def merged_repeats(strings: DataFrame) -> DataFrame:
    """The same for all strings, many minimizers a collection."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in stream:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("bytes").nbytes
            if size < COLLECTION:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("minimizer").to_numpy()
            other = np.flatnonzero(key != key[-1])
            last = int(other[-1]) + 1 if len(other) else 0
            if not last:
                continue
            sizes = np.cumsum(pa.compute.binary_length(rows.column("bytes")).to_numpy())
            edges = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            a = 0
            while a < last:  # whole minimizers, about COLLECTION bytes together
                b = int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + COLLECTION)) + 1
                b = min(last, int(edges[np.searchsorted(edges, max(b, a + 1))]) if b < len(key) else last)
                yield collection_repeats(rows.slice(a, b - a))
                a = b
            held = rows.slice(last).combine_chunks().to_batches()
            size = sum(x.column("bytes").nbytes for x in held)
        if held:
            yield collection_repeats(pa.Table.from_batches(held))

    schema = "minimizer long, content long, more long, doc_id long, start long, stop long"
    return strings.repartition("minimizer").sortWithinPartitions(*STRING).mapInArrow(run, schema)


def windows_apart(strings: DataFrame) -> DataFrame:
    """Intervals that repeat at the first places of strings of minimizers with very many: windows one by one, by 128-bit
    hashes."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b, block in blocks(batch.column("bytes")):
                count = block.ends - block.starts - LENGTH + 1
                row = np.repeat(np.arange(b - a), count)
                off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = block.starts[row] + off
                left, right = block.hashes(at, at + LENGTH), halves(block, at, at + LENGTH)
                yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), pa.array(np.asarray(batch.column("doc_id"))[a:b][row]), pa.array(np.asarray(batch.column("place"))[a:b][row] // 128 + off)], ["h1", "h2", "doc_id", "start"])

    each = strings.mapInArrow(run, "h1 long, h2 long, doc_id long, start long")
    first = each.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    return each.join(first, ["h1", "h2"]).where(F.struct("doc_id", "start") > F.col("first")).select("doc_id", "start", (F.col("start") + LENGTH).alias("stop"))


def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``cuts`` (array of start, stop) by doc_id: the bytes to remove, each covered by windows that start earlier elsewhere."""
    same = Window.partitionBy(*STRING)
    met = found_runs(docs).repartition("minimizer").withColumn("lead", F.dense_rank().over(same.orderBy("doc_id", "place")) == 1)
    met = met.withColumn("several", ~F.min("lead").over(same)).withColumn("n", F.count("*").over(Window.partitionBy("minimizer")))
    judged = materialize(met.where("n > 1 or place < 0").drop("n"), "judged")
    leads = judged.where("lead and place >= 0").drop("lead")
    strings, others = with_bytes(docs, leads), judged.where("not lead and place >= 0").select(*STRING, "doc_id", "place")
    crowd = materialize(leads.groupBy("minimizer").count().where(F.col("count") > hot).select("minimizer"), "hot")
    found = judged.where("place < 0").selectExpr("doc_id", "-1 - place as start", "content as stop")
    if crowd.limit(1).count():
        few = maybe_broadcast(crowd, width=16)
        later = ["doc_id", "place div 128 as start", f"place div 128 + place % 128 + {LENGTH - 1} as stop"]
        found = found.unionByName(windows_apart(strings.join(few, "minimizer", "left_semi")))
        found = found.unionByName(others.join(few, "minimizer", "left_semi").selectExpr(*later))
        strings, others = strings.join(few, "minimizer", "left_anti"), others.join(few, "minimizer", "left_anti")
    merged = materialize(merged_repeats(strings), "merged")
    found = found.unionByName(merged.where("doc_id is not null").drop(*STRING))
    later = others.join(merged.where("doc_id is null").drop("doc_id"), STRING)
    found = found.unionByName(later.selectExpr("doc_id", "place div 128 + start as start", "place div 128 + stop as stop"))
    out = materialize(found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("cuts")), "cuts")
    release(judged, crowd, merged)
    return out


def kept_bytes(docs: DataFrame, cuts: DataFrame, digest: bool) -> DataFrame:
    """``docs`` with what is left of each text: as digest columns or as new text."""
    fields = ["doc_id"] if digest else docs.columns
    met = docs.select("doc_id", "text") if digest else docs
    name, own = free_name(met, "cuts"), free_name(met, "of")
    cuts = cuts.select(F.col("doc_id").alias(own), F.col("cuts").alias(name))
    met = met.join(cuts, met["doc_id"] == cuts[own], "left").drop(own)
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else ", ".join(f"`{c}` {types[c]}" for c in fields)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            data, starts, ends = views(batch.column("text"))
            rows, texts = [], []
            for s, e, cuts in zip(starts.tolist(), ends.tolist(), batch.column(name).to_pylist(), strict=True):
                own, n, removed, parts, at, joined = data[s:e], e - s, 0, [], 0, 0
                for a, b in sorted((c["start"], c["stop"]) for c in cuts or ()):
                    if a > at or (a == 0 and not joined):
                        parts.append(own[at:a])
                        joined += 1
                        removed += b - a
                    elif b > at:
                        removed += b - at
                    at = max(at, b)
                parts.append(own[at:])
                kept = b"".join(p.tobytes() for p in parts)
                if digest:
                    rows.append((n, removed, joined, hashlib.sha256(kept).hexdigest()))
                else:
                    texts.append(kept.decode(errors="ignore") if cuts else None)
            if digest:
                cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)] + [pa.array([r[3] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                own = batch.column("text").to_pylist()
                text = pa.array([o if t is None else t for o, t in zip(own, texts, strict=True)], batch.schema.field("text").type)
                yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in fields], fields)

    return met.mapInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text`` (of a character that is cut in two, nothing stays)."""
    return kept_bytes(docs, repeats(docs), digest=False)


def op4_merged_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text of ``documents`` without strings of 100 bytes that also start earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return kept_bytes(docs, repeats(docs), digest=True)
