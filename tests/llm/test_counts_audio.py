import random

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import audio, tokencount

PIECES = ["▁the", "▁", "t", "h", "e", "he", "the", "▁t", "an", "a", "n", "ana", "▁b", "b", "é"]


def viterbi(model, pieces, word):
    scores = {}
    for p in pieces:
        at = model.root
        for c in p[:-1]:
            at = at[c][0]
        scores.setdefault(p, at[p[-1]][1])
    s = tokencount.MARK + word
    best = [(0.0, 0)] + [None] * len(s)
    for j in range(1, len(s) + 1):
        width = len(s[j - 1].encode())
        found = [(best[j - 1][0] + width * model.byte, -(best[j - 1][1] + width))]
        found += [(best[i][0] + scores[s[i:j]], -(best[i][1] + 1)) for i in range(j) if s[i:j] in scores]
        top = max(found)
        best[j] = (top[0], -top[1])
    return best[-1][1]


@pytest.mark.parametrize("full", [False, True])
def test_trie_equals_viterbi(full):
    pieces = tokencount.read_pieces(public_tokenizers.path("piece_bpe_32k.model")) if full else PIECES
    model = tokencount.Unigram(pieces)
    counter = tokencount.Counter(model)
    r = random.Random(2)
    words = ["".join(r.choice("thean bé日z") for _ in range(r.choice([1, 4, 9, 70]))).replace(" ", "") or "a" for _ in range(150)]
    want = [viterbi(model, pieces, w) for w in words]
    assert counter.shard(words) == [(1, n) for n in want] == counter.shard(words)
    assert counter.shard([" ".join(words), ""]) == [(len(words), sum(want)), (0, 0)]
    assert not any(len(w) > tokencount.LONG for w in counter.stored)


def test_token_frames(spark):
    rows = [(1, "the banana"), (1, None), (None, ""), (2, " \n "), (3, "x" * 3000 + " the")]
    df = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, n_tokens string")
    model = tokencount.Unigram(PIECES)
    got = sorted(((r.doc_id, r.n_pretokens, r.n_tokens) for r in tokencount.count(df, PIECES, keep=["doc_id"]).collect()), key=str)
    want = [(i, len((t or "").split()), sum(viterbi(model, PIECES, w) for w in (t or "").split())) for i, t in rows]
    assert got == sorted(want, key=str)
    assert tokencount.count(df.limit(0), PIECES).count() == 0


def melody(seed, n=64):
    return np.random.default_rng(seed).normal(size=n) * 0.15


def test_fingerprint_of_wav_and_noise():
    samples, rate = audio.render(melody(1))
    read, got = audio.read_wav(audio.write_wav(samples, rate))
    assert got == rate and np.abs(read - samples).max() < 1e-3
    a = audio.fingerprint(audio.chroma(samples, rate))
    noisy = samples + np.random.default_rng(0).normal(size=len(samples)) * 0.01
    b = audio.fingerprint(audio.chroma(noisy, rate))
    other = audio.fingerprint(audio.chroma(*audio.render(melody(2))))
    errors = lambda x, y: np.mean([bin(int(u) ^ int(v)).count("1") for u, v in zip(x.view(np.uint32), y.view(np.uint32))]) / 32
    assert len(a) > 40
    assert errors(a, b) < 0.1
    assert errors(a, other) > 0.25
    for bad in (None, b"", b"RIFF", b"RIFF0000WAVEdata"):
        assert len(audio.fingerprint(audio.chroma(*audio.read_wav(bad)))) == 0
    assert len(set(audio.fingerprint(audio.chroma(np.zeros(30000), 8000)).tolist())) == 1


def brute(prints, doubts):
    """Every offset that any place votes for, a place of the query with its doubtful bits either way."""
    out = {}
    for a, x in prints.items():
        free = [~sum(1 << ((d >> 5 * k) & 31) for k in range(audio.FLIPS)) & 0xFFFFFFFF for d in doubts[a] or []]
        for b, y in prints.items():
            if a == b or x == y or not x or not y:
                continue
            best = None
            for off in range(1 - len(y), len(x)):
                first, n = max(off, 0), min(len(x), len(y) + off) - max(off, 0)
                apart = [(x[first + k] ^ y[first - off + k]) & 0xFFFFFFFF for k in range(n)]
                votes = sum(not d & free[first + k] for k, d in enumerate(apart))
                wrong = sum(d.bit_count() for d in apart)
                if votes and n >= audio.MIN_OVERLAP and wrong <= n * 32 * audio.MAX_BIT_ERRORS:
                    best = max(best or (0,), (votes, -abs(off), off, n, wrong))
            if best:
                out[a, b] = best[2:]
    return out


def test_alignment_equals_brute_force(spark):
    vectors = {i: melody(i).tolist() for i in range(12)}
    vectors |= {20: vectors[3], 40: vectors[3][8:] + melody(90).tolist()[:8], 41: melody(91).tolist()[:16] + vectors[5][:48], 60: None, 61: [], 62: [0.0] * 64, 63: [0.0] * 64, 80: [None, 0.1] * 32}
    df = spark.createDataFrame([(k, v, "x") for k, v in vectors.items()] + [(20, vectors[3], "y")], "vec_id long, embedding array<double>, fingerprint string")
    prints = audio.fingerprints(df, "embedding", audio.render, keep=["vec_id"])
    prints.cache()
    from pyspark.sql import functions as F

    local = {r.vec_id: list(r.fingerprint) for r in prints.collect()}
    doubts = {r.vec_id: list(r.fingerprint_doubt) for r in prints.collect()}
    members, pairs = audio.align(prints, "vec_id", F.lit(True))
    rep = {r.id: r.rep for r in members.collect()}
    assert rep[20] == 3 and rep[63] == 62 and 60 not in rep
    want = {k: v for k, v in brute({k: v for k, v in local.items() if rep.get(k) == k}, doubts).items()}
    got = {(r.a, r.b): (r.offset, r.overlap, round(r.bit_errors * r.overlap * 32)) for r in pairs.collect()}
    assert got == want and (3, 40) in got
    found = {r.vec_id: r for r in audio.search(prints, "vec_id", F.col("vec_id") % 20 == 0).collect()}
    assert set(found) == {0, 20, 40, 60, 80} and found[40].best_id == 3 and found[20].n_copies == 2 and found[60].class_id is None
    assert audio.search(prints.limit(0), "vec_id", F.lit(True)).count() == 0


def test_a_passage_of_all(spark):
    from pyspark.sql import functions as F

    vectors = {i: melody(7).tolist()[:40] + melody(100 + i).tolist()[:24] for i in range(10)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    prints = audio.fingerprints(df, "embedding", audio.render, keep=["vec_id"])
    local = {r.vec_id: list(r.fingerprint) for r in prints.collect()}
    doubts = {r.vec_id: list(r.fingerprint_doubt) for r in prints.collect()}
    _, pairs = audio.align(prints, "vec_id", F.lit(True))
    assert {(r.a, r.b) for r in pairs.collect()} == set(brute(local, doubts)) != set()


def test_repeats_held_tones_and_shared_ids(spark, monkeypatch):
    """A passage that comes again votes at each of its places, silence does not multiply, an id may have two recordings."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(audio, "DEALT", 3)
    verse, other = melody(1).tolist()[:24], melody(2).tolist()
    vectors = [(1, verse + verse + verse[:16]), (2, verse + other[:8]), (3, [0.0] * 64), (3, [0.0] * 30 + verse), (4, [0.0] * 20 + verse + other[:20]), (5, other), (5, other), (5, verse + other), (None, other[:50]), (None, None)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    prints = audio.fingerprints(df, "embedding", audio.render, keep=["vec_id"]).cache()
    rows = [(r.vec_id, tuple(r.fingerprint), list(r.fingerprint_doubt)) for r in prints.collect()]
    distinct = sorted({f for _, f, _ in rows if f})
    local = dict(enumerate(map(list, distinct)))
    want = brute(local, {k: min(d for _, f, d in rows if f == tuple(v)) for k, v in local.items()})
    members, pairs = audio.align(prints, "vec_id", F.lit(True))
    assert members.select("class").distinct().count() == len(distinct)
    name = {f: min(i for i, g, _ in rows if g == f and i is not None) if any(g == f and i is not None for i, g, _ in rows) else None for f in distinct}
    got = sorted(((r.a, r.b, r.offset, r.overlap, round(r.bit_errors * r.overlap * 32)) for r in pairs.collect()), key=str)
    assert got == sorted(((name[distinct[a]], name[distinct[b]], *v) for (a, b), v in want.items()), key=str) and got
    found = audio.search(prints, "vec_id", F.lit(True)).collect()
    copies = sorted(((r.vec_id, r.class_id, r.n_copies, r.n_aligned) for r in found), key=str)
    size = {f: sum(g == f for _, g, _ in rows) for f in distinct}
    near = lambda f: sum(size[distinct[b]] for a, b in want if distinct[a] == f)
    assert copies == sorted(((i, name[f] if f else None, size[f] - 1 if f else 0, near(f) if f else 0) for i, f, _ in rows), key=str)
    long = spark.createDataFrame([(1, [0.0] * 4000), (2, [0.0] * 3000), (3, other * 40 + [0.0] * 500)], "vec_id long, embedding array<double>")
    assert {(r.a, r.b) for r in audio.align(audio.fingerprints(long, "embedding", audio.render, keep=["vec_id"]), "vec_id", F.lit(True))[1].collect()} >= {(1, 2), (2, 1)}


def test_recall_of_noisy_and_shifted_copies(spark):
    """Against an exhaustive search of all offsets."""
    from pyspark.sql import functions as F

    prints, want = {}, {}
    for kind, (sd, start) in enumerate([(0.15, 0), (0.2, 0), (0.3, 0), (0, 64), (0, 128), (0, 256)]):
        want[kind] = set()
        for seed in range(20):
            samples, rate = audio.render(melody(1000 + seed))
            noise = np.random.default_rng(5000 + seed).normal(size=len(samples)) * sd
            for i, s in ((seed, samples), (100 * (kind + 1) + seed, (samples + noise)[start:])):
                prints[i] = audio.doubted(audio.chroma(s, rate))
            x, y = (prints[i][0].view(np.uint32) for i in (seed, 100 * (kind + 1) + seed))
            for off in range(-len(y), len(x)):
                first, n = max(off, 0), min(len(x), len(y) + off) - max(off, 0)
                if n >= audio.MIN_OVERLAP and np.bitwise_count(x[first : first + n] ^ y[first - off : first - off + n]).sum() <= n * 32 * audio.MAX_BIT_ERRORS:
                    want[kind].add((seed, 100 * (kind + 1) + seed))
    rows = [(i, p.tolist(), d.tolist()) for i, (p, d) in prints.items()]
    df = spark.createDataFrame(rows, "vec_id long, fingerprint array<int>, fingerprint_doubt array<int>")
    got = {(r.a, r.b) for r in audio.align(df, "vec_id", F.col("vec_id") < 100)[1].collect()}
    recall = {k: (len(got & v), len(v)) for k, v in want.items()}
    assert all(n >= 19 for _, n in recall.values())
    assert all(found >= 0.95 * n for found, n in recall.values()), recall
