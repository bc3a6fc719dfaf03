"""Toxic spans from a linear-chain CRF over words.

Each word is a position of the chain with two states, toxic and not. Its features are hashes of the word,
of its first and last bytes and of its neighbours. Labelled tokens for training come from the labelled
documents: a word of a toxic document is labelled toxic if one of its features is found in many toxic
documents and almost never in others; every word of the other documents is labelled not toxic. After a
first fit, the words of toxic documents are labelled anew by the chain's own marginals and it is fitted
once more. Forward-backward marginals give a document's score: the largest marginal and the expected
number of toxic words, set on the labels' scale by a logistic curve; words whose marginal is at least
0.5 are the offending offsets.

Defined results: a null or empty text has no words and gets the lowest score; with no training rows of
both classes every score is the share of label 1 among them, or 0.5 without any, and no word offends.
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
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (3, 4)
BITS = 20
N_OWN = 1 + len(PREFIXES) + len(SUFFIXES)
PER_CLASS = (3000, 1000)  # most training rows of the labels 0 and 1
LEAST = 3  # occurrences in training that a feature's weight needs
TRAIN_WINDOW = 256  # words of a training sequence; scoring uses whole texts


def features(data: np.ndarray, offsets: np.ndarray):
    """(feature numbers of each word's own hashes, start and end bytes, offsets of the documents' words)."""
    starts, ends, rows = tk.word_bounds(data, offsets, tk.ALNUM)
    hashes = tk.word_hashes(data, starts, ends, PREFIXES, SUFFIXES)
    shift = np.uint64(64 - BITS)
    own = np.empty((len(starts), N_OWN), np.int32)
    for k, h in enumerate(hashes):
        own[:, k] = ((h * np.uint64(2 * k + 0x9E3779B97F4A7C15)) >> shift).astype(np.int32)
    words = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(offsets) - 1))))
    return own, starts, ends, words


@dataclass
class Model:
    own: np.ndarray  # weights of a word's own features
    near: np.ndarray  # weights of the whole-word features of its neighbours
    bias: float
    transitions: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def emission(self, own: np.ndarray, words: np.ndarray) -> np.ndarray:
        e = np.full(len(own), self.bias)
        for k in range(N_OWN):
            e += self.own[own[:, k]]
        return e + _neighbours(self.near[own[:, 0]], words)

    def marginals(self, data: np.ndarray, offsets: np.ndarray):
        own, starts, ends, words = features(data, offsets)
        return crf.marginals(self.emission(own, words), words, self.transitions), starts, ends, words

    def evidence(self, p: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Per document: the logit of the largest marginal and the logarithm of the expected number."""
        out = np.full((len(words) - 1, 2), -12.0)
        ok = np.flatnonzero(np.diff(words) > 0)
        if len(ok):
            top = np.clip(np.maximum.reduceat(p, words[:-1][ok]), 1e-6, 1 - 1e-6)
            out[ok, 0] = np.log(top / (1 - top))
            out[ok, 1] = np.log(np.maximum(np.add.reduceat(p, words[:-1][ok]), 1e-5))
        return out

    def of_marginals(self, p: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The documents' scores from their words' marginals."""
        if self.constant is not None:
            return np.full(len(words) - 1, self.constant)
        return training.apply_platt(self.evidence(p, words), self.scale)


def _neighbours(v: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums of the values at the words before and behind, inside a document."""
    out = np.zeros(len(v))
    out[1:] += v[:-1]
    out[:-1] += v[1:]
    inner = words[1:-1]
    inner = inner[(inner > 0) & (inner < len(v))]
    inner = np.unique(inner)
    out[inner] -= v[inner - 1]
    out[inner - 1] -= v[inner]
    return out


def _seeds(own: np.ndarray, words: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which words have a feature that marks toxic documents."""
    doc = np.repeat(np.arange(len(y)), np.diff(words))
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    size = 1 << BITS
    toxic = np.zeros(len(own), bool)
    for k in range(N_OWN):
        pair = np.unique(doc * np.int64(size) + own[:, k])
        d, f = pair // size, pair % size
        in1 = np.bincount(f[y[d] == 1], minlength=size)
        in0 = np.bincount(f[y[d] == 0], minlength=size)
        rate1, rate0 = in1 / n1, (in0 + 0.5) / n0
        marks = (in1 >= max(3, 0.004 * n1)) & (rate1 >= 12 * rate0)
        toxic |= marks[own[:, k]]
    return toxic & (y[doc] == 1)


def train(texts: list[str], y: np.ndarray) -> Model:
    size = 1 << BITS
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size), np.zeros(size), -60.0, np.zeros((2, 2)), np.zeros(3), float(y.mean()) if len(y) else 0.5)
    data, offsets = tk.column_bytes(pa.array(texts, pa.large_string()))
    parts = [features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in runtime.rows_within(offsets, SHARD_BYTES)]
    words = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[3]) for p in parts]))))
    own = np.empty((int(words[-1]), N_OWN), np.int32, order="F")
    at = 0
    while parts:
        part = parts.pop(0)[0]
        own[at : at + len(part)] = part
        at += len(part)
    state = _seeds(own, words, y)
    doc = np.repeat(np.arange(len(y)), np.diff(words))
    # weights only for features that occur LEAST times (number n stands for all others and has no weight);
    # columns: own features, then neighbours, then the bias
    used = np.flatnonzero(sum(np.bincount(own[:, k], minlength=size) for k in range(N_OWN)) >= LEAST)
    n = len(used)
    number = np.full(size, n, np.int32)
    number[used] = np.arange(n, dtype=np.int32)
    c = own
    for k in range(N_OWN):
        c[:, k] = number[own[:, k]]
    # training windows: the documents in pieces, all of them
    cuts = np.unique(np.concatenate([words, *(np.arange(a, b, TRAIN_WINDOW) for a, b in zip(words[:-1], words[1:], strict=True))]))
    model = Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, np.zeros((2, 2)), np.zeros(3))
    fitted = None
    for again in (False, True):
        s = state.astype(float)

        def emission(w, offsets=cuts):
            out = _neighbours(np.append(w[n : 2 * n], 0.0)[c[:, 0]], offsets) + w[2 * n]
            mine = np.append(w[:n], 0.0)
            for k in range(N_OWN):
                out += mine[c[:, k]]
            return out

        def gather(v):
            out = np.zeros(2 * n + 1)
            for k in range(N_OWN):
                out[:n] += np.bincount(c[:, k], weights=v, minlength=n + 1)[:n]
            out[n : 2 * n] = np.bincount(c[:, 0], weights=_neighbours(v, cuts), minlength=n + 1)[:n]
            out[2 * n] = v.sum()
            return out

        w, model.transitions = crf.fit(emission, gather, 2 * n + 1, s, cuts, l2=0.2, steps=8 if again else 18, start=fitted)
        fitted = np.concatenate([w, model.transitions.ravel()])
        model.own[used], model.near[used], model.bias = w[:n], w[n : 2 * n], float(w[2 * n])
        if not again:
            p = crf.marginals(emission(w, words), words, model.transitions)
            state = state | ((p >= 0.5) & (y[doc] == 1))
    p = crf.marginals(emission(w, words), words, model.transitions)
    model.scale = training.platt(model.evidence(p, words), y)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows that are not held out (training.sample states the bounds)."""
    model = train(*training.sample(docs, labels, label, id_col, text_col, PER_CLASS))
    runtime.release()
    return model


def _share(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast(model)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])


def score(
    docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score", keep: list[str] | None = None, spans_col: str | None = None, at_least: float = 0.5
) -> DataFrame:
    """The columns `keep` (default: all) and out_col, the toxicity of each whole text. With spans_col also, in
    the same pass, the offending words: (start, end, probability), in code points, end exclusive."""
    shared = _share(docs, model)

    def make():
        m = shared.value

        def each(batch):
            data, offsets = tk.column_bytes(batch.column(0))
            for lo, hi in runtime.rows_within(offsets, SHARD_BYTES):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                p, starts, ends, words = m.marginals(part, own)
                out = [pa.array(m.of_marginals(p, words))]
                if spans_col:
                    points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                    row = np.repeat(np.arange(hi - lo), np.diff(words))
                    hit = np.flatnonzero(p >= at_least)
                    base = points[own[:-1]][row[hit]]
                    values = pa.StructArray.from_arrays([pa.array(points[starts[hit]] - base), pa.array(points[ends[hit]] - base), pa.array(p[hit])], fields=list(_SPAN))
                    each_row = np.concatenate(([0], np.cumsum(np.bincount(row[hit], minlength=hi - lo)))).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(each_row), values))
                yield out

        return each

    fields: list[tuple[str, T.DataType]] = [(out_col, T.DoubleType())]
    if spans_col:
        element = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])
        fields.append((spans_col, T.ArrayType(element)))
    return runtime.map_arrow(docs, [text_col], make, fields, docs.columns if keep is None else keep)


def spans(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "spans", at_least: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) and out_col, the offending words as score() gives them."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != out_col.lower()]
    names = {f"c{i}": c for i, c in enumerate(kept)}
    inner = docs.select(F.col(f"`{text_col}`").alias("t"), *[F.col(f"`{c}`").alias(k) for k, c in names.items()])
    found = score(inner, model, "t", "score", list(names), "found", at_least)
    return found.select(*[F.col(k).alias(c) for k, c in names.items()], F.col("found").alias(out_col))


def verdict(scored: DataFrame, id_col: str = "doc_id", score_col: str = "score", threshold: float = 0.3) -> list:
    return [F.col(id_col), training.is_held_out(id_col).alias("held_out"), F.col(score_col), F.when(F.col(score_col) >= threshold, 1).otherwise(0).alias("predicted")]
