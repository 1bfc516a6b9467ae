"""Byte-level BPE over length-bucketed padded numpy matrices, and decoding.

A text is split by the vocabulary's pattern. The distinct pieces of a batch, grouped by length, become rows of
padded matrices. Each round, every unfinished row merges its leftmost pair of minimum rank: pair ranks come from
a hash table of (left id, right id), the row is compacted by one cell, and only the two pairs beside the merge are
looked up anew. Pieces over LONG_PIECE bytes, for which a row of a matrix would cost its length squared, take the
same merges in the same order from a heap.

Defined results: a null or empty text has no ids; ids are those of ``tiktoken``'s ``encode_ordinary`` over the same
ranks and pattern, strings of special tokens being ordinary text. Rows are kept one to one, repeated ids included; an empty
table gives none. Texts of any length are encoded whole. Own columns named ids or decoded are replaced by the result's. Ties
of rank go to the leftmost pair.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .word_ids import Memory

#: Row lengths of the matrices; longer pieces go through the heap.
BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128, 256)
LONG_PIECE = BUCKETS[-1]
#: Cells of a matrix at most, and pieces that a worker remembers at most.
MATRIX_CELLS = 1 << 20
WIDTH = [next(w for w in BUCKETS if w >= n) for n in range(LONG_PIECE + 1)]
#: The pattern under which words and marks take the short way. Fixed value.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARKS = frozenset(".,;:!?")
#: A space at either end or beside other white space.
LOOSE_SPACE = re.compile(r"\A | \Z| \s|\s ").search
NONE = np.int32(2**31 - 1)
_loaded: dict[tuple[str, str], Bpe] = {}


class PairTable:
    """Hash table from a pair of ids to the id (and rank) of their merge: open addressing in two arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(merged) * 4 - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size + 64, -1, np.int64)
        self.values = np.full(size + 64, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        at, todo = self._home(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] == -1
            _, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[at[put]], self.values[at[put]] = keys[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = np.minimum(at[todo] + (self.keys[at[todo]] != keys[todo]), size + 63)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, NONE where there is none."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] += 1
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class Bpe:
    """A vocabulary of byte strings whose ranks are their ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.bytes[i] = token
        self.text = list(map(str, range(len(self.bytes))))
        self.plain = pattern == WORD_PATTERN
        self.findall = regex.compile(pattern).findall
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        halves = [(self.ids[t[:k]], self.ids[t[k:]], i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        self.pairs = PairTable(*np.array(halves, np.int64).T.astype(np.int32))
        self.lookup = {(a, b): i for a, b, i in halves}
        self.memory = Memory(self.learn)

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        """One per Python worker."""
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = cls(path, pattern)
        return _loaded[path, pattern]

    def merge_rows(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Ids of pieces of at most ``width`` bytes each."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        cells = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        row = np.where(np.arange(width) < length[:, None], self.single[cells], -1).astype(np.int32)
        rank = np.full((n, width), NONE, np.int32)
        if width > 1:
            rank[:, :-1] = self.pairs(row[:, :-1].ravel(), row[:, 1:].ravel()).reshape(n, width - 1)
        out = np.full((n, width), -1, np.int32)
        live, column = np.arange(n), np.arange(width)
        while len(live):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(at)), at]
            over = best == NONE
            if over.any():
                out[live[over], : row.shape[1]] = row[over]
                going = ~over
                live, row, rank, at, best = live[going], row[going], rank[going], at[going], best[going]
                if not len(live):
                    break
            width = row.shape[1]
            k = np.arange(len(at))
            row[k, at] = best
            shifted = column[: width - 1] > at[:, None]  # cells after the merged one move left by one
            row = np.where(shifted, row[:, 1:], row[:, :-1])
            rank = np.where(shifted, rank[:, 1:], rank[:, :-1])
            width -= 1
            after = at + 1 < width
            right = np.full(len(at), NONE, np.int32)
            right[after] = self.pairs(best[after], row[k[after], at[after] + 1])
            rank[k, at] = right
            before = at > 0
            rank[k[before], at[before] - 1] = self.pairs(row[k[before], at[before] - 1], best[before])
        used = (out >= 0).sum(axis=1)
        flat = out[out >= 0].tolist()
        ends = np.cumsum(used).tolist()
        return [tuple(flat[e - u : e]) for e, u in zip(ends, used.tolist(), strict=True)]

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one long piece: the same merges (leftmost minimum rank first) from a heap over linked cells."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n, rank = len(ids), self.lookup
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (x := rank.get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := before[i]) >= 0 and (x := rank.get((ids[h], r))) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return tuple(i for i in ids if i >= 0)

    def merge(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each of some distinct pieces."""
        found = {}
        by_width: dict[int, tuple[list[str], list[bytes]]] = {w: ([], []) for w in BUCKETS}
        for piece in pieces:
            raw = piece.encode()
            if (whole := self.ids.get(raw)) is not None:
                found[piece] = (whole,)
            elif len(raw) > LONG_PIECE:
                found[piece] = self.merge_long(raw)
            else:
                names, raws = by_width[WIDTH[len(raw)]]
                names.append(piece)
                raws.append(raw)
        for width, (names, raws) in by_width.items():
            step = max(1, MATRIX_CELLS // width)
            for a in range(0, len(raws), step):
                found.update(zip(names[a : a + step], self.merge_rows(raws[a : a + step], width), strict=True))
        return found

    def learn(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Ids of chunks (whole runs of pieces)."""
        split = [self.pieces(c) for c in chunks]
        ids = self.merge(list(set(chain.from_iterable(split))))
        return [ids[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, parts))) for parts in split]

    def pieces(self, chunk: str) -> list[str]:
        """The pattern's matches; a word, with a space before it or a mark behind, needs no pattern."""
        if self.plain:
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():
                return [chunk]
            if word[-1:] in MARKS and word[:-1].isalpha():
                return [chunk[:-1], word[-1]]
        return self.findall(chunk)

    def chunks(self, text: str) -> list[str]:
        """Runs of whole pieces that make up a text: where each space stands between two other characters, no piece crosses
        to before a space, so the text may be cut there; another text is one run."""
        if LOOSE_SPACE(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        split = [self.chunks(t) if t else () for t in texts]
        known = self.memory.prepare(set().union(*split)) if split else None
        return [list(chain.from_iterable(map(known, chunks))) for chunks in split]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.bytes.__getitem__, ids))


def batches(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch whose texts make about ``limit`` code points, and these texts."""
    texts = batch.column(column).to_pylist()
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit or i + 1 == len(texts):
            yield batch.slice(at, i + 1 - at), texts[at : i + 1]
            at, size = i + 1, 0


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``decoded`` (binary, the bytes that the ids decode to)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path, pattern)
        for batch in stream:
            for part, texts in batches(batch, text):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.binary())], [*part.schema.names, "ids", "decoded"])

    rest = docs.drop("ids", "decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", ids array<int>, decoded binary"
    return rest.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, SHA-256 of the ids (decimal, joined by commas) and of the bytes decoded from them."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in stream:
            for part, texts in batches(batch, "text"):
                ids = bpe.encode(texts)
                name = bpe.text.__getitem__
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array([sha(",".join(map(name, x)).encode()) for x in ids]), pa.array([sha(bpe.decode(x)) for x in ids])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded with the multilingual byte vocabulary."""
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
