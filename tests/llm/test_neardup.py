import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import graph, neardup, runtime


def shingle_set(text, words):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if len(w) >= words else frozenset([tuple(w)])


def brute(rows, words, percent):
    sets = [shingle_set(t, words) for _, t in rows]
    uf = graph.UnionFind()
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            x = len(sets[i] & sets[j])
            if a == b or 100 * x >= percent * (len(sets[i]) + len(sets[j]) - x):
                uf.join(a, b)
    return sorted(((i, len(s), i if i is None or not s else uf.find(i)) for (i, _), s in zip(rows, sets)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def vary(r, words, k):
    w = list(words)
    for _ in range(k):
        w[r.randrange(len(w))] = f"x{r.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, words, percent):
    r = random.Random(1)
    rows = [(100, ""), (101, None), (102, "One"), (103, "one"), (104, "one two"), (105, " one\ttwo\n"), (106, "a b c d e f"), (None, "a b c d e f"), (107, "A B C D E F")]
    rows += [(108, "same text twice " * 3), (108, "quite another text with some words in it"), (109, "quite another text with some words in it")]
    n = 200
    for g in range(6):  # groups of near copies with zero to many changes, also around the threshold
        base = [f"w{g}_{r.randrange(60)}" for _ in range(120)]
        for _ in range(40):
            rows.append((n, vary(r, base, r.choice([0, 0, 1, 2, 3, 4, 5, 8, 15]))))
            n += 1
    df = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, kept string")
    out = neardup.components(df, words=words, percent=percent)
    assert got(out) == brute(rows, words, percent)
    for x in out.collect():
        assert x.kept == (x.doc_id == x.component_id if x.doc_id is not None else True)
    assert neardup.deduplicate(df, words=words, percent=percent).columns == df.columns


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.components(df).count() == 0
    assert neardup.deduplicate(df).count() == 0


def test_chain_needs_the_rest(spark):
    """A chain of texts, each close only to the next, is one component."""
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[i * 4 : 100 + 0] + [f"n{j}" for j in range(i * 4)])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.components(df, words=3, percent=85)) == brute(rows, 3, 85)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    err = []
    for _ in range(100):
        e = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = np.sort(e[:160]), np.sort(e[40:])
        s = neardup.superminhash(np.concatenate([a, b]), np.array([0, 160, 320]), 120)
        err.append((s[0] == s[1]).mean() - 120 / 200)
    assert abs(np.mean(err)) < 0.012
    assert np.std(err) < np.sqrt(0.6 * 0.4 / 120)  # below the plain method's deviation


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000), (None, 3), (7, None), (3, 2)]
    df = spark.createDataFrame(edges, "a long, b long")
    labels = {r.node: r.label for r in graph.components(df, runtime.Scratch(spark, "test")).collect()}
    assert set(labels) == {*range(201), *range(1000, 1400)}
    assert graph.components(df.limit(0), runtime.Scratch(spark, "test")).count() == 0
    assert all(labels[i] == 0 for i in range(201)) and all(labels[k] == 1000 for k in range(1000, 1400))


def test_ids_of_any_type(spark):
    rows = [("x10", "same words in this text here"), ("x2", "Same words in this text here"), ("a", "other words in that text there"), (None, "same words in this text here"), ("x2", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.components(df).collect()), key=str)
    assert got == sorted([("x10", "x10", True), ("x2", "x10", False), ("a", "a", True), (None, None, True), ("x2", "x2", True)], key=str)
    dates = spark.createDataFrame([(i % 3, "the same text for all of them") for i in range(6)], "doc_id short, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.components(dates).collect()} == {(0, 0), (1, 0), (2, 0)}
    assert neardup.components(dates).schema["component_id"].dataType == dates.schema["doc_id"].dataType


def test_one_row_of_each_group_is_kept(spark):
    text, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(1, 61))
    rows = [(5, text), (5, text), (None, text), (None, near), (4, near), (None, "quite another text of its own here"), (7, "the third text of all of these"), (7, "a fourth text with the id of the third"), (9, None), (9, "")]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, `a.b` string, row string")
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(4, near), (None, rows[5][1]), (7, rows[6][1]), (7, rows[7][1]), (9, None), (9, "")], key=str)


def test_a_hot_centre_and_a_hot_shingle_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(neardup, "DEALT", 7)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    r = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, vary(r, base, r.choice([0, 1, 2, 3, 4, 5, 6, 7]))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.components(df, words=3, percent=85)) == brute(rows, 3, 85)


@pytest.mark.parametrize("bits", [1 << 9, 1 << 27])
def test_documents_are_picked_without_a_shuffle_of_their_texts(spark, monkeypatch, bits):
    """With more ids than are broadcast; half of the small bitmap is set, so that many ids are hit by chance."""
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 100)
    monkeypatch.setattr(neardup, "SIEVE_BITS", bits)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = [(i, f"text {i // 2 if i < 600 else i} of these documents", "x") for i in range(900)]
        df = spark.createDataFrame(rows, "doc_id long, text string, _maybe string")
        kept = neardup.deduplicate(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({*range(0, 600, 2), *range(600, 900)})
        if bits > 1 << 9:
            assert "SortMergeJoin" not in kept._jdf.queryExecution().sparkPlan().toString()
        gone = df.where("doc_id < 600 and doc_id % 2 = 1").select("doc_id")
        hit = neardup._marked(df.select("doc_id"), "doc_id", gone, 300).where("_maybe")
        assert hit.join(gone, "doc_id", "left_semi").count() == 300
        assert (hit.count() > 400) == (bits == 1 << 9)
        numbered = df.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
        assert sorted(r.doc_id or 0 for r in neardup.deduplicate(numbered).collect()) == sorted([*range(0, 600, 2)] + [i if i % 2 == 0 else 0 for i in range(600, 900)])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
