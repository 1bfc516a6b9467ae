"""Ids of the word-level public vocabulary, with a bounded memory of words that a worker has seen."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from unicodedata import is_normalized

import numpy as np

MARKS = frozenset(".,;:!?")
_loaded: dict[str, WordIds] = {}


class Memory:
    """Values of keys, learnt for many new keys at once; of two generations the older goes when the younger holds more than
    ``size`` bytes, about. Keys that one call needs are kept until the next."""

    #: Bytes of an entry besides its characters and its value's items.
    ENTRY = 150

    def __init__(self, learn: Callable[[list[str]], Iterable], size: int = 48 << 20):
        self.learn, self.size, self.held = learn, size, 0
        self.young: dict = {}
        self.old: dict = {}

    def prepare(self, keys: set[str]) -> Callable:
        """A function that gives the value of each of ``keys``."""
        new = keys - self.young.keys()
        if self.held > self.size:
            self.old, self.young, self.held = self.young, {}, 0
            new = keys
        again = new & self.old.keys()
        for k in again:
            self.young[k] = self.old[k]
        todo = list(new - again if again else new)
        if todo:
            self.young.update(zip(todo, self.learn(todo), strict=True))
        item = 1 if self.young and isinstance(next(iter(self.young.values())), bytes) else 8
        self.held += self.ENTRY * len(new) + sum(map(len, new)) + item * sum(map(len, map(self.young.__getitem__, new)))
        return self.young.__getitem__


class WordIds:
    """Encodes whole texts as the ``tokenizers`` library does with add_special_tokens=False.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its words in turn.
    """

    #: Words that one text given to the library holds, joined by spaces.
    JOINED = 128

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.memory = Memory(self.learn)

    @classmethod
    def load(cls, path: str) -> WordIds:
        """One per Python worker."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def lines(self, words: list[str], fast: bool) -> Iterator[tuple[list[str], object]]:
        """Words that one call got, and what it gave."""
        lines = [words[i : i + self.JOINED] for i in range(0, len(words), self.JOINED)]
        call = self.tokenizer.encode_batch_fast if fast else self.tokenizer.encode_batch
        return zip(lines, call([" ".join(x) for x in lines], add_special_tokens=False), strict=True)

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of each word. A lower-case word of letters alone ends with the one id that closes a word; another is told
        apart by where its ids start."""
        # lists side by side, not tuples, which the garbage collector would go through
        marked, lows, ends, others = [], [], [], []
        for w in words:
            if w.isalpha():
                stem, end = w, ""
            elif w[-1:] in MARKS:
                stem, end = w[:-1], w[-1]
            else:
                others.append(w)
                continue
            low = stem.lower()
            if low.isalpha() and (stem.isascii() or low.islower() and "Σ" not in stem and is_normalized("NFC", stem)):
                marked.append(w)
                lows.append(low)
                ends.append(end)
            else:
                others.append(w)
        # a stem may have been a word before
        stems, young, old = set(lows), self.memory.young, self.memory.old
        known: dict[str, bytes] = {w: old[w] for w in stems & old.keys()} | {w: young[w] for w in stems & young.keys()}
        stems = [*stems - known.keys()]
        for line, found in self.lines(stems, fast=True):
            ids = np.array(found.ids, "<u4")
            at = (np.flatnonzero(self.closes[ids]) + 1) * 4
            raw = ids.tobytes()
            at = at.tolist()
            known.update(zip(line, [raw[a:b] for a, b in zip([0, *at], at, strict=False)], strict=True))
        marks = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in MARKS} | {"": b""}
        out = {w: known[low] + marks[end] if end else known[low] for w, low, end in zip(marked, lows, ends, strict=True)}
        for line, found in self.lines(others, fast=False):
            ids = np.array(found.ids, "<u4")
            starts = np.array([a for a, _ in found.offsets], np.int64)
            at = np.searchsorted(starts, np.cumsum([len(w) + 1 for w in line])).tolist()
            out.update(zip(line, [ids[a:b].tobytes() for a, b in zip([0, *at], at, strict=False)], strict=True))
        return [out[w] for w in words]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.replace("\n", " ").split(" ") if t else () for t in texts]
        get = self.memory.prepare(set().union(*split)) if split else None
        return [b"".join(map(get, words)) for words in split]
