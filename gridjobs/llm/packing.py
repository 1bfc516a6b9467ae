"""Packing by vector bin packing with the dot-product heuristic.

Each sequence has limits on tokens, on segments and on loss-bearing tokens. Of the pieces that still fit, the one
whose demand has the largest dot product with what is left of the limits goes in next. Where pieces may be cut
(pretraining text), a sequence with room for none of them takes the first part of the longest, so sequences come out
full; the last of a group is cut to lengths that are powers of two. Instruction examples are packed whole.

Groups are runs of rows of one partition with bounded tokens, so nothing is shuffled and any one row, source or
group of copies may be as large as it likes. Sequence ids hold the partition's number, as
monotonically_increasing_id() does.

Defined results: null text counts as empty; an empty text is the closing id alone. Every id is in one piece.
Repeated rows are packed as often as they come. An empty table gives no rows. Columns besides doc_id and text are
not looked at.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import batches
from .common import table
from .word_ids import WordIds

#: Ids of one group (4 MB).
GROUP_TOKENS = 1 << 20
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """Of one sequence."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


def best_fit(demand: np.ndarray, there: np.ndarray, left: np.ndarray, capacity: np.ndarray) -> int:
    """The column of ``demand``, of those ``there``, that fits into ``left`` and has the largest dot product with it, limits
    counting alike; -1: none. Of equals, the first."""
    score = (left / capacity**2) @ demand
    score[~there | (demand[0] > left[0]) | (demand[1] > left[1]) | (demand[2] > left[2])] = -1
    at = int(score.argmax())
    return at if score[at] >= 0 else -1


class Shapes:
    """Items by what they demand of the limits: a column of ``demand`` for each shape, with ``counts`` of its items, so that
    a search looks at shapes, however many items there are."""

    def __init__(self, item: np.ndarray, demand: np.ndarray):
        kinds, of = np.unique(demand, axis=1, return_inverse=True) if len(item) else (demand, np.zeros(0, np.int64))
        order, sizes = np.argsort(of, kind="stable"), np.bincount(of, minlength=kinds.shape[1])
        self.queues = [deque(x.tolist()) for x in np.split(item[order], np.cumsum(sizes)[:-1])] if len(item) else []
        self.demand, self.counts, self.items = kinds.astype(float), sizes.copy(), len(item)
        self.where = {tuple(x): k for k, x in enumerate(self.demand.T.tolist())}

    def take(self, at: int) -> int:
        """The first item of a shape, which leaves."""
        self.counts[at] -= 1
        self.items -= 1
        return self.queues[at].popleft()

    def add(self, item: int, demand: tuple[float, float, float]) -> None:
        """An item with another demand."""
        at = self.where.setdefault(demand, len(self.queues))
        if at == len(self.queues):
            self.queues.append(deque())
            self.demand = np.concatenate([self.demand, np.array(demand)[:, None]], axis=1)
            self.counts = np.append(self.counts, 0)
        self.queues[at].append(item)
        self.counts[at] += 1
        self.items += 1


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length).

    ``loss`` gives each item's loss-bearing tokens; of an item that may be cut, they are taken to be its last ones.
    Without ``cut``, an item over a limit is a sequence of its own.
    """
    capacity = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    full = min(limits.tokens, limits.loss_tokens) if cut else limits.tokens
    out: list[list[tuple[int, int, int]]] = []
    start = np.zeros(len(tokens), np.int64)
    if cut:
        for i in np.flatnonzero(tokens >= full).tolist():
            n = int(tokens[i]) // full
            out += [[(i, k * full, full)] for k in range(n)]
            start[i] = n * full
    item = np.flatnonzero(start < tokens)
    rest = tokens[item] - start[item]
    shapes = Shapes(item, np.stack([rest, np.ones(len(item), np.int64), np.minimum(loss[item], rest)]))
    while shapes.items:
        left, row = capacity.copy(), []
        while shapes.items:
            demand = shapes.demand
            at = best_fit(demand, shapes.counts > 0, left, capacity)
            if at >= 0:
                i = shapes.take(at)
                row.append((i, int(start[i]), int(demand[0, at])))
                left -= demand[:, at]
                continue
            if cut and left.min() > 0:
                at = int(np.where(shapes.counts > 0, demand[0], -1).argmax())
                i, n, more = shapes.take(at), int(min(left[0], left[2], demand[0, at])), demand[:, at]
                row.append((i, int(start[i]), n))
                start[i] += n
                if more[0] > n:
                    shapes.add(i, (more[0] - n, 1.0, min(more[2], more[0] - n)))
            elif not row:  # over a limit by itself
                at = int(np.flatnonzero(shapes.counts)[0])
                i = shapes.take(at)
                row.append((i, int(start[i]), int(demand[0, at])))
            break
        out.append(row)
    if cut and out and sum(n for *_, n in out[-1]) < full:
        out += powers_of_two(out.pop())
    return out


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces, cut into sequences whose lengths are powers of two."""
    out, left = [], list(pieces)
    total = sum(n for *_, n in pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        row = []
        while room:
            i, start, n = left.pop(0)
            row.append((i, start, min(n, room)))
            if n > room:
                left.insert(0, (i, start + room, n - room))
            room -= min(n, room)
        out.append(row)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, limits: Limits = Limits()) -> DataFrame:
    """Pieces of the documents' ids (see PIECES); a document's first id bears no loss, having nothing before it."""

    def packed(ids: list[np.ndarray], names: list[int], first: int) -> tuple[pa.RecordBatch, int]:
        tokens = np.fromiter(map(len, ids), np.int64, len(ids))
        rows = []
        sequences = pack(tokens, tokens - 1, limits, cut=True)
        for k, pieces in enumerate(sequences):
            offset = 0
            for i, start, n in pieces:
                rows.append((names[i], start, n, zlib.crc32(ids[i][start : start + n].tobytes()), int(tokens[i]), first + k, offset))
                offset += n
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")]), first + len(sequences)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.load(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        ids, names, size, first = [], [], 0, TaskContext.get().partitionId() << 33
        for batch in stream:
            for part, texts in batches(batch, "text"):
                ids += [np.frombuffer(x + end, "<u4") for x in words(texts)]
                names += part.column("doc_id").to_pylist()
                size += sum(map(len, ids[len(ids) - len(texts) :]))
                if size >= GROUP_TOKENS:
                    out, first = packed(ids, names, first)
                    yield out
                    ids, names, size = [], [], 0
        if ids:
            yield packed(ids, names, first)[0]

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Whole examples (example_id, tokens, loss_tokens) with sequence_id and offset; nothing is cut."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for batch in stream:
            names, tokens, loss = (batch.column(c).to_pylist() for c in ("example_id", "tokens", "loss_tokens"))
            rows = []
            sequences = pack(np.array(tokens, np.int64), np.array(loss, np.int64), limits, cut=False)
            for k, pieces in enumerate(sequences):
                offset = 0
                for i, _, n in pieces:
                    rows.append((names[i], n, loss[i], first + k, offset))
                    offset += n
            first += len(sequences)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["example_id", "tokens", "loss_tokens", "sequence_id", "offset"])

    chosen = examples.selectExpr("example_id", "bigint(coalesce(tokens, 0)) tokens", "bigint(coalesce(loss_tokens, 0)) loss_tokens").where("tokens > 0")
    return chosen.mapInArrow(run, "example_id long, tokens long, loss_tokens long, sequence_id long, offset long")


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 ids."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
