import random
import re

import pytest

from tessera.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    wins = []
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        k = min(window, len(w))
        wins += [(i, tuple(w[j : j + k])) for j in range(len(w) - k + 1)]
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, x in wins:
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit |= set(range(p, p + len(x)))
                    found.add(i)
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def case(seed):
    r = random.Random(seed)
    vocab = ["the", "of", "ñandú", "x1", "Zed", "alpha", "beta", "日本"]
    make = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", ".", "\n"]) for _ in range(n))
    items = [(i, make(r.choice([0, 1, 3, 6, 9, 12]))) for i in range(12)] + [(3, make(7)), (None, make(5)), (50, None), (51, "...")]
    docs = [(d, make(r.randrange(60))) for d in range(40)]
    docs += [(100 + k, make(4) + " " + (t or "") + " " + make(4)) for k, (_, t) in enumerate(items)] + [(7, None), (7, ""), (8, "..."), (9, "the")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block_words", [1 << 20, 8])
def test_equals_brute_force(spark, seed, block_words):
    docs, items = case(seed)
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for locate in (False, True):
        out = decontam.annotate(d, b, window=6, keep=["doc_id"], block_words=block_words, locate=locate)
        got = sorted(((r.doc_id, r.n_words, r.n_hit, sorted(m.item_id for m in r.matches)) for r in out.collect()), key=str)
        assert got == brute(docs, items, 6)


def test_longest_matches_are_verbatim(spark):
    docs, items = case(4)
    by_id = {}
    for i, t in items:
        by_id.setdefault(i, []).append(words(t))
    texts = {d: words(t) for d, t in docs if d >= 100}
    d = spark.createDataFrame(list(docs), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    seen = 0
    for r in decontam.annotate(d, b, window=5).where("doc_id >= 100").collect():
        w = texts[r.doc_id]
        for m in r.matches:
            piece = w[m.doc_start : m.doc_start + m.length]
            assert any(x[m.item_start : m.item_start + m.length] == piece for x in by_id[m.item_id])
            best = max(n for x in by_id[m.item_id] for a in range(len(x)) for p in range(len(w)) for n in [next((k for k in range(min(len(x) - a, len(w) - p)) if x[a + k] != w[p + k]), min(len(x) - a, len(w) - p))])
            assert m.length == best
            seen += 1
    assert seen > 10


def test_filter_and_empty_tables(spark):
    docs, items = case(5)
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n_hit int, matches int")
    b = spark.createDataFrame(items, "item_id long, text string")
    kept = decontam.remove_contaminated(d, b, window=6)
    assert kept.columns == d.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(x[0]) for x in brute(docs, items, 6) if x[2] == 0)
    assert decontam.annotate(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.annotate(d.limit(0), b).count() == 0


def test_ids_keep_their_type(spark):
    docs = spark.createDataFrame([("x1", "one two three four"), (None, "four five six seven eight"), ("x1", None)], "doc_id string, text string")
    bench = spark.createDataFrame([("q-2", "two three"), ("q-1", "five six seven"), ("q-1", "seven eight"), (None, "one"), ("q-3", None)], "item_id string, text string")
    for blocks in (1, 1 << 20):
        got = sorted(((r.doc_id, r.n_hit, [tuple(m) for m in r.matches]) for r in decontam.annotate(docs, bench, keep=["doc_id"], block_words=blocks).collect()), key=str)
        assert got == sorted([(None, 4, [("q-1", 0, 1, 3)]), ("x1", 0, []), ("x1", 2, [("q-2", 0, 1, 2)])], key=str)


def test_a_shard_is_gathered_from_batches(spark, monkeypatch):
    seen = []
    from tessera.llm import runtime

    import pyarrow as pa

    batches = [pa.record_batch({"t": pa.array(["ab" * 50] * n, pa.string())}) for n in (3, 0, 5, 40, 1)]
    for b in runtime._gathered(iter(batches), 1500):
        seen.append(b.num_rows)
    assert seen == [48, 1] or seen == [8 + 40, 1]
    assert [b.num_rows for b in runtime._gathered(iter(batches), 0)] == [3, 5, 40, 1]
