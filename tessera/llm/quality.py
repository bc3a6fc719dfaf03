"""Document quality from a linear-chain CRF over lines.

Each line is a position of the chain with two states, good and bad. A line's features are binned measures
of the line and of its two neighbours (lengths, shares of character kinds, repeated words, endings). The
chain is trained on the lines of labelled documents, each line labelled as its document is. A document's
quality is the mean marginal probability "good" of its lines, weighted by their length, and then set on
the labels' scale by a logistic curve fitted to the training documents.

Defined results: a null or empty text is one empty line; with no training rows of both classes every
score is the share of label 1 among them, or 0.5 without any.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf, runtime, training
from . import textkernel as tk

SHARD_BYTES = 1 << 20

_KIND = np.zeros(256, np.int64)  # 0: other ASCII punctuation
_KIND[0x61:0x7B] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 3
_KIND[0x80:] = 4
_KIND[[0x20, *range(0x09, 0x0E)]] = 5
_KIND[[0x2E, 0x2C, 0x3B, 0x3A, 0x3F, 0x27, 0x22, 0x2D, 0x28, 0x29]] = 6  # . , ; : ? ' " - ( )
_KIND[0x21] = 7  # !
_KIND[[0x7C, 0x5C, 0x2F, 0x5F, 0x3D, 0x3C, 0x3E]] = 8  # | \ / _ = < >

_EDGES = {
    "length": [1, 10, 30, 60, 100, 200, 400, 800],
    "share": [0.001, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5],
    "words": [0.5, 1.5, 3.5, 8.5, 20.5, 60.5],
    "word length": [2, 3.5, 5, 6.5, 8, 12],
}


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers of each line, lengths of the lines, offsets of the documents' lines)."""
    n_rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    n_lines = np.bincount(row_of_break, minlength=n_rows) + 1
    line_offsets = np.concatenate(([0], np.cumsum(n_lines)))
    total = int(line_offsets[-1])
    start = np.empty(total, np.int64)
    start[line_offsets[:-1]] = offsets[:-1]
    later = np.ones(total, bool)
    later[line_offsets[:-1]] = False
    start[later] = breaks + 1
    end = np.empty(total, np.int64)
    end[line_offsets[1:] - 1] = offsets[1:]
    last = np.ones(total, bool)
    last[line_offsets[1:] - 1] = False
    end[last] = breaks
    length = end - start
    kinds = _KIND[data]
    shares = []
    solid = np.maximum(1, length)
    for k in (0, 2, 3, 4, 5, 6, 7, 8):
        sums = np.concatenate(([0], np.cumsum(kinds == k)))
        shares.append((sums[end] - sums[start]) / solid)
    ws, we, wr = tk.word_bounds(data, offsets, tk.NON_SPACE)
    (h,) = tk.word_hashes(data, ws, we)
    line = np.searchsorted(start, ws, side="right") - 1
    words = np.bincount(line, minlength=total)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[same], minlength=total) / np.maximum(1, words)
    order = np.lexsort((h, line))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = 1 - np.bincount(line[order][new], minlength=total) / np.maximum(1, words)
    mean = length / np.maximum(1, words)
    ending = np.where(length > 0, kinds[np.maximum(end - 1, 0)] if len(kinds) else 0, 9)
    columns = [np.digitize(length, _EDGES["length"]), np.digitize(words, _EDGES["words"]), np.digitize(mean, _EDGES["word length"]), ending]
    columns += [np.digitize(s, _EDGES["share"]) for s in (*shares, repeats, distinct)]
    own = np.stack([c + 10 * k for k, c in enumerate(columns)], 1)
    n = 10 * len(columns)
    before = np.full_like(own, n * 3)  # no neighbour: a feature of its own
    before[1:] = own[:-1] + n
    before[line_offsets[:-1]] = n * 3
    behind = np.full_like(own, n * 3 + 1)
    behind[:-1] = own[1:] + 2 * n
    behind[line_offsets[1:] - 1] = n * 3 + 1
    return np.concatenate([own, before, behind], 1), length, line_offsets


N_FEATURES = 10 * 14 * 3 + 2


@dataclass
class Model:
    weights: np.ndarray
    transitions: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def good(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marginal probability "good" of each line, lengths, offsets of the documents' lines)."""
        features, length, lines = measures(data, offsets)
        e = self.weights[features].sum(1)
        return crf.marginals(e, lines, self.transitions), length, lines

    def raw(self, p: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """The documents' means of their lines' marginals, weighted by length."""
        weight = length + 1.0
        return np.add.reduceat(p * weight, lines[:-1]) / np.add.reduceat(weight, lines[:-1])

    def of_lines(self, p: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(lines) - 1, self.constant)
        return training.apply_platt(self.raw(p, length, lines)[:, None], self.scale)


def train(texts: list[str], y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2), float(y.mean()) if len(y) else 0.5)
    data, offsets = tk.column_bytes(pa.array(texts, pa.large_string()))
    features, _, lines = measures(data, offsets)
    state = np.repeat(y, np.diff(lines))
    flat = features.ravel()

    def emission(w):
        return w[features].sum(1)

    def gather(v):
        return np.bincount(flat, weights=np.repeat(v, features.shape[1]), minlength=N_FEATURES)

    weights, transitions = crf.fit(emission, gather, N_FEATURES, state, lines)
    model = Model(weights, transitions, np.zeros(2))
    model.scale = training.platt(model.raw(*model.good(data, offsets))[:, None], y)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows that are not held out (training.sample states the bounds)."""
    model = train(*training.sample(docs, labels, label, id_col, text_col))
    runtime.release()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score", keep: list[str] | None = None, lines_col: str | None = None) -> DataFrame:
    """The columns `keep` (default: all) and out_col, the quality of each whole text. With lines_col also, in
    the same pass, for each line of the text the probability that it is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def each(batch):
            data, offsets = tk.column_bytes(batch.column(0))
            for lo, hi in runtime.rows_within(offsets, SHARD_BYTES):
                p, length, lines = m.good(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                out = [pa.array(m.of_lines(p, length, lines))]
                if lines_col:
                    out.append(pa.ListArray.from_arrays(pa.array(lines.astype(np.int32)), pa.array(p)))
                yield out

        return each

    fields: list[tuple[str, T.DataType]] = [(out_col, T.DoubleType())]
    if lines_col:
        fields.append((lines_col, T.ArrayType(T.DoubleType())))
    return runtime.map_arrow(docs, [text_col], make, fields, docs.columns if keep is None else keep)


def line_labels(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "lines", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) and out_col, the lines' probabilities as score() gives them."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != out_col.lower()]
    names = {f"c{i}": c for i, c in enumerate(kept)}
    inner = docs.select(F.col(f"`{text_col}`").alias("t"), *[F.col(f"`{c}`").alias(k) for k, c in names.items()])
    found = score(inner, model, "t", "score", list(names), "found")
    return found.select(*[F.col(k).alias(c) for k, c in names.items()], F.col("found").alias(out_col))


def verdict(scored: DataFrame, id_col: str = "doc_id", score_col: str = "score", threshold: float = 0.7) -> list:
    return [F.col(id_col), training.is_held_out(id_col).alias("held_out"), F.col(score_col), F.when(F.col(score_col) >= threshold, 1).otherwise(0).alias("predicted")]
