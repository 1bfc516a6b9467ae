"""Vectorized views of Arrow string columns: bytes, words and rolling hashes as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are looked at in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n at least."""
    size = max(1 << 20, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 20
    if size not in _powers:
        found = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            found.append(np.multiply.accumulate(p))
        if size > 4 * BLOCK_BYTES:  # of one very long text: not kept
            return found[0], found[1]
        _powers[size] = (found[0], found[1])
    return _powers[size]


def views(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each row's bytes start and end; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    starts, ends = at[:-1].copy(), at[1:].copy()
    if column.null_count and (ends > starts)[np.asarray(column.is_null())].any():  # bytes under a null row
        return views(column.fill_null(""))
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), starts, ends


def spans(starts: np.ndarray, ends: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes make about ``limit`` together, at least one row each."""
    at, n = 0, len(starts)
    while at < n:
        to = int(np.searchsorted(ends, starts[at] + limit, side="right"))
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


class Block:
    """Some whole texts: ``data`` (uint8), ``starts``, ``ends`` of each text within it."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False):
        first, last = (int(starts[0]), int(ends[-1])) if len(starts) else (0, 0)
        data = data[first:max(first, last)]
        self.data = LOWER[data] if lower else data
        self.starts, self.ends = starts - first, ends - first
        self._prefix: np.ndarray | None = None

    @property
    def prefix(self) -> np.ndarray:
        """prefix[e] - prefix[s], times BASE ** -s, depends on the bytes from s to e only."""
        if self._prefix is None:
            n = len(self.data)
            self._prefix = np.zeros(n + 1, np.uint64)
            up, _ = powers(n + 1)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._prefix[1:])
        return self._prefix

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes from s to e."""
        _, down = powers(len(self.data) + 1)
        return mix((self.prefix[e] - self.prefix[s]) * down[s] + (e - s).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word (bytes other than ASCII white space), and the row of its text."""
        n = len(self.data)
        solid = ~SPACE[self.data]
        first = np.zeros(n + 1, bool)
        first[self.starts] = True
        before = np.empty(n, bool)
        if n:
            before[0] = True
            np.logical_not(solid[:-1], out=before[1:])
            before |= first[:n]
        after = np.ones(n, bool)
        if n:
            after[:-1] = ~solid[1:] | first[1:n]
        s = np.flatnonzero(solid & before)
        e = np.flatnonzero(solid & after) + 1
        return s, e, self.rows(s)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The row whose text holds position ``at`` (empty texts hold none)."""
        return np.searchsorted(self.ends, at, side="right")


def blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """Blocks of whole texts of a column with the range of rows of each."""
    data, starts, ends = views(column)
    for a, b in spans(starts, ends, limit):
        yield a, b, Block(data, starts[a:b], ends[a:b], lower)
