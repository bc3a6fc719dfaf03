import itertools
import zlib

import numpy as np
import pytest

from tessera.llm import crf, quality, queries, toxicity


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    w = np.array([[0.0, -1.3], [0.7, 2.0]])
    lengths = [1, 3, 0, 5, 9, 2]
    off = np.concatenate(([0], np.cumsum(lengths)))
    e = rng.normal(size=off[-1]) * 2
    p = crf.marginals(e, off, w)
    for i, n in enumerate(lengths):
        part, total, each = e[off[i] : off[i + 1]], 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            s = np.exp(sum(part[t] for t in range(n) if y[t]) + sum(w[y[t - 1], y[t]] for t in range(1, n)))
            total += s
            each += s * np.array(y)
        assert not n or np.allclose(each / total, p[off[i] : off[i + 1]])


def test_blocks_equal_recursion():
    rng = np.random.default_rng(1)
    w = np.array([[0.3, -0.4], [-1.1, 0.9]])
    lengths = [500, 48, 49, 96, 97, 1, 200]
    off = np.concatenate(([0], np.cumsum(lengths)))
    e = rng.normal(size=off[-1])
    f, _ = crf.log_ratios(e, off, w)
    for a, b in zip(off[:-1], off[1:]):
        r = None
        for t in range(a, b):
            r = e[t] if r is None else e[t] + np.logaddexp(w[0, 1], w[1, 1] + r) - np.logaddexp(w[0, 0], w[1, 0] + r)
            assert abs(r - f[t]) < 1e-9


def test_fit_recovers_a_chain():
    rng = np.random.default_rng(2)
    y = np.zeros(3000)
    for t in range(1, 3000):
        y[t] = y[t - 1] if rng.random() < 0.9 else 1 - y[t - 1]
    x = (rng.random(3000) < np.where(y > 0, 0.7, 0.3)).astype(int)
    off = np.array([0, 3000])
    w, trans = crf.fit(lambda w: w[x], lambda v: np.bincount(x, weights=v, minlength=2), 2, y, off)
    p = crf.marginals(w[x], off, trans)
    assert ((p > 0.5) == y).mean() > ((x > 0) == y).mean() + 0.05


@pytest.mark.parametrize(("query", "label", "least"), [(queries.op1_quality, "quality", 0.95), (queries.op9_toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    d = "/root/testdata/sf0.1"
    out = query(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    assert len(rows) > 300 and np.mean([r[0] == r[1] for r in rows]) >= least
    first = out.limit(50).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in first)
    assert out.count() == spark.read.parquet(f"{d}/documents.parquet").count()


ODD = [(1, "good text here. fine words follow."), (1, None), (None, ""), (3, "a " * 30000), (4, "\n\n\n"), (5, "é" * 10), (6, "idiot\nidiot")]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_inputs(spark, module):
    docs = spark.createDataFrame([(a, b, "s") for a, b in ODD], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        model = module.fit(docs, labels)
        got = module.score(docs, model, keep=["doc_id"]).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert module.score(docs.limit(0), model).count() == 0
    texts = ["a clean line of words\n" * 5, "WORSE!! LINE!! !!\n" * 5] * 30 + ["you idiot there"] * 20
    model = module.train(texts, np.array([1, 0] * 30 + [0] * 20) if module is quality else np.array([0] * 60 + [1] * 20))
    got = module.score(docs, model, keep=["doc_id"]).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)


def test_spans_and_lines(spark):
    texts = ["some plain words stand here now"] * 40 + ["éé some idiot words stand here"] * 20
    model = toxicity.train(texts, np.array([0] * 40 + [1] * 20))
    df = spark.createDataFrame([(1, "éé some idiot words"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in toxicity.spans(df, model).collect()}
    assert (8, 13) in got[1] and got[2] == []
    lines = quality.train(["good words in a line.\n" * 4, "BAD!! LINE!!\n" * 4] * 20, np.array([1, 0] * 20))
    p = {r.doc_id: r.lines for r in quality.line_labels(spark.createDataFrame([(1, "good words in a line.\nBAD!! LINE!!"), (2, None)], "doc_id long, text string"), lines).collect()}
    assert len(p[1]) == 2 and p[1][0] > 0.5 and len(p[2]) == 1


def chain(e, w):
    """Marginals of state 1 by the plain recursions, in probabilities."""
    n = len(e)
    f, b = np.zeros((n, 2)), np.ones((n, 2))
    for t in range(n):
        f[t] = np.exp([0, e[t]]) * (1 if t == 0 else f[t - 1] @ np.exp(w))
        f[t] /= f[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = np.exp(w) @ (np.exp([0, e[t + 1]]) * b[t + 1])
        b[t] /= b[t].sum()
    p = f * b
    return p[:, 1] / p.sum(1)


def test_scores_equal_plain_versions(spark):
    """Length weights, evidence, the logistic scale and the spans, each document by itself."""
    import pyarrow as pa

    from tessera.llm import textkernel as tk

    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60] + [(-1, ""), (-2, "\n\nx\n"), (-3, "é 日本 " * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    m = quality.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), labels)
    got = {r.doc_id: r for r in quality.score(df, m, keep=["doc_id"], lines_col="lines").collect()}
    for i, text in docs:
        data, offsets = tk.column_bytes(pa.array([text], pa.large_string()))
        p = chain(m.weights[quality.measures(data, offsets)[0]].sum(1), m.transitions)
        weight = np.array([len(x.encode()) + 1 for x in text.split("\n")])
        x = (p * weight).sum() / weight.sum() * m.scale[0] + m.scale[1]
        assert np.allclose(got[i].lines, p) and np.isclose(got[i].score, 1 / (1 + np.exp(-x)))
    texts = ["some plain words stand here now"] * 40 + ["éé some idiot words stand here"] * 20
    m = toxicity.train(texts, np.array([0] * 40 + [1] * 20))
    docs += [(-4, "éé some idiot words\nand an Idiot, IDIOT")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, m, keep=["doc_id"], spans_col="spans").collect()}
    for i, text in docs:
        data, offsets = tk.column_bytes(pa.array([text], pa.large_string()))
        own, starts, ends, words = toxicity.features(data, offsets)
        e = np.array([m.bias + sum(float(m.own[f]) for f in x) + sum(float(m.near[own[j][0]]) for j in (k - 1, k + 1) if 0 <= j < len(own)) for k, x in enumerate(own)])
        p = chain(e, m.transitions) if len(e) else np.zeros(0)
        top = np.clip(p.max(initial=0), 1e-6, 1 - 1e-6)
        evidence = [np.log(top / (1 - top)), np.log(max(p.sum(), 1e-5))] if len(p) else [-12.0, -12.0]
        x = evidence[0] * m.scale[0] + evidence[1] * m.scale[1] + m.scale[2]
        assert np.isclose(got[i].score, 1 / (1 + np.exp(-np.clip(x, -30, 30))), atol=1e-6)
        raw = text.encode()
        want = [(len(raw[:s].decode()), len(raw[:t].decode())) for s, t, q in zip(starts, ends, p) if q >= 0.5]
        assert [(s.start, s.end) for s in got[i].spans] == want
    assert len(got[-4].spans) >= 2


def test_an_id_repeated_in_documents_reaches_the_driver_once(spark):
    from tessera.llm import training

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, "x" * 20000)] * 50 + [(2, "x" * 20000), (3, "c"), (4, "d"), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 1, 2, 3, 4, 5, 8, 9)] + [(None, 1)], "doc_id long, quality int")
    free = {i for i in (1, 3, 4) if zlib.crc32(str(i).encode()) % 4 != 2}
    texts, y = training.sample(docs, labels, "quality")
    assert sorted(zip(texts, y.tolist())) == sorted((t, i % 2) for i, t in ((1, "a"), (3, "c"), (4, "d")) if i in free)
