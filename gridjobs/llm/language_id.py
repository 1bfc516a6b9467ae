"""Language identification by a byte convolutional network.

Filters of several widths run over embedded bytes of fixed-length windows; each filter's maximum over a window feeds a
softmax over languages. The network is trained in numpy on windows of a bounded, documented sample of labelled
documents (at most PER_LANGUAGE documents a language, WINDOWS_PER_DOCUMENT windows each, spread evenly over the text).
For prediction, embedding and filters are folded into one table of byte responses per filter offset, and every window
of every whole text is scored; a document's probabilities are the mean over its windows, weighted by their bytes.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if no language
could be learnt. Ties go to the language first in alphabetical order. Rows are kept one to one, repeated ones too; a text
of any length counts whole, a bounded number of its windows at a time; an empty table gives no rows and teaches nothing.
Other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import spans, views
from .common import free_name, held_out, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDED = 8
PER_LANGUAGE = 400
WINDOWS_PER_DOCUMENT = 4
EPOCHS = 6
UNKNOWN = "und"


@dataclass
class ByteNet:
    """Parameters: byte embedding, filters and biases by width, output weights and biases, and the languages."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray
    languages: list[str]

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> ByteNet:
        r = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        return cls(r.normal(0, 0.5, (256, EMBEDDED)), [r.normal(0, (w * EMBEDDED) ** -0.5, (w, EMBEDDED, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], r.normal(0, n**-0.5, (n, len(languages))), np.zeros(len(languages)), languages)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.weights, self.offset]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy of windows ``x`` (n, WINDOW) with languages ``y``."""
        n, k = len(x), np.arange(len(x))[:, None]
        embedded = self.embedding[x]
        peaks, at = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            t = x.shape[1] - w + 1
            response = sum(embedded[:, j : j + t] @ f[j] for j in range(w))
            at.append(response.argmax(axis=1))
            peaks.append(np.take_along_axis(response, at[-1][:, None], axis=1)[:, 0] + b)
        peak = np.concatenate(peaks, axis=1)
        active = np.maximum(peak, 0)
        d_out = softmax(active @ self.weights + self.offset)
        d_out[np.arange(n), y] -= 1
        d_out /= n
        d_peak = (d_out @ self.weights.T) * (peak > 0)
        d_embedding, d_filters, d_biases = np.zeros_like(self.embedding), [], []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            d = d_peak[:, i * FILTERS : (i + 1) * FILTERS]
            where = at[i][:, :, None] + np.arange(w)
            d_filters.append(np.einsum("nf,nfjd->jdf", d, embedded[k[:, :, None], where]))
            d_biases.append(d.sum(axis=0))
            np.add.at(d_embedding, x[k[:, :, None], where].ravel(), (d[:, :, None, None] * f.transpose(2, 0, 1)).reshape(-1, EMBEDDED))
        return [d_embedding, *d_filters, *d_biases, active.T @ d_out, d_out.sum(axis=0)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteNet:
        """Adam over shuffled batches."""
        r, step = np.random.default_rng(seed), 0
        first, second = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), batch):
                step += 1
                pick = order[a : a + batch]
                for p, g, m, v in zip(self.parameters(), self.gradients(x[pick], y[pick]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self) -> list[list[np.ndarray]]:
        """By width and offset: the response of each filter to each byte."""
        return [[(self.embedding @ f[j]).astype(np.float32) for j in range(len(f))] for f in self.filters]

    def probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Of each language for each window."""
        peaks = []
        for parts, b in zip(tables, self.biases, strict=True):
            t = x.shape[1] - len(parts) + 1
            response = parts[0][x[:, :t]]
            for j, part in enumerate(parts[1:], 1):
                response += part[x[:, j : j + t]]
            peaks.append(response.max(axis=1) + b)
        return softmax(np.maximum(np.concatenate(peaks, axis=1), 0) @ self.weights + self.offset)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, together: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All windows of some texts, ``together`` at a time, padded with zero bytes; their text's row and number of bytes."""
    counts = -(-(ends - starts) // WINDOW)
    upto = np.cumsum(counts)
    for k in range(0, int(upto[-1]) if len(upto) else 0, together):
        n = np.arange(k, min(k + together, int(upto[-1])))
        row = np.searchsorted(upto, n, side="right")
        at = starts[row] + (n - upto[row] + counts[row]) * WINDOW
        size = np.minimum(ends[row] - at, WINDOW)
        where = at[:, None] + np.arange(WINDOW)
        x = np.where(np.arange(WINDOW) < size[:, None], data[np.minimum(where, len(data) - 1)], 0)
        yield x.astype(np.uint8), row, size


def fit(docs: DataFrame, seed: int = 7) -> ByteNet | None:
    """A network trained on the sample of ``docs`` (doc_id, text, lang), held-out rows left out; None without any labels."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 2 * PER_LANGUAGE / n))) for k, n in sorted(counts.items())])
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    sample = labelled.where(place < share * F.lit(float(1 << 30))).select("lang", place.alias("place"), "doc_id", "text")

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            data, starts, ends = views(batch.column("text"))
            found = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                n = min(WINDOWS_PER_DOCUMENT, -(-(e - s) // WINDOW))
                at = [s + max(0, e - s - WINDOW) * k // max(1, n - 1) for k in range(n)]
                found.append([data[a : min(e, a + WINDOW)].tobytes() for a in at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.binary()))], ["lang", "place", "doc_id", "windows"])

    rows = sorted(sample.mapInArrow(cut, "lang string, place long, doc_id long, windows array<binary>").collect(), key=lambda r: (r["place"], r["doc_id"]))
    languages, taken, x, y = sorted(counts), dict.fromkeys(counts, 0), [], []
    for r in rows:
        if taken[r["lang"]] < PER_LANGUAGE:
            taken[r["lang"]] += 1
            x += [np.frombuffer(bytes(w).ljust(WINDOW, b"\0"), np.uint8) for w in r["windows"]]
            y += [languages.index(r["lang"])] * len(r["windows"])
    return ByteNet.fresh(languages, seed).train(np.stack(x), np.array(y)) if x else None


def predict(docs: DataFrame, net: ByteNet | None, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language and its score under the names given; columns of these names are replaced."""
    rest = docs.drop(lang_pred, score)
    if net is None:
        return rest.withColumn(lang_pred, F.lit(UNKNOWN)).withColumn(score, F.lit(0.0))
    fields = [f.name for f in rest.schema]
    letter = free_name(rest, "letter")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + f", `{lang_pred}` string, `{score}` double"

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in stream:
            data, starts, ends = views(batch.column("text"))
            mean = np.zeros((len(starts), len(net.languages)))
            for a, b in spans(starts, ends, WINDOW * 1024):
                for x, row, size in windows(data, starts[a:b], ends[a:b]):
                    np.add.at(mean[a:b], row, net.probabilities(x, tables) * size[:, None])
            mean /= np.maximum(ends - starts, 1)[:, None]
            best = mean.argmax(axis=1)
            known = np.asarray(batch.column(letter).fill_null(False))
            names = [net.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
            scores = np.where(known, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array(names, pa.string()), pa.array(scores)], [*fields, lang_pred, score])

    return rest.withColumn(letter, F.col("text").rlike(r"\p{L}")).mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), fit(docs)).drop("text")
