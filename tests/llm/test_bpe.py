import base64
import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.read(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(3)
    yield from ["", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the the", "\n\n  x", "é" * 50, "日本語のテキスト", "😀😀a😀", "<|endoftext|>", "'s't're"]
    for alphabet in ("ab", "the ", "aeiou", "thernd", "01", "ñíóue", "!*&", "日本語an", "Ii'l "):
        for n in (3, 17, 100, 1500):
            for _ in range(6):
                yield "".join(r.choice(alphabet) for _ in range(n))
    for _ in range(200):
        yield "".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 1200), r.randrange(0x4E00, 0x9000)])) for _ in range(r.randrange(60)))


def test_tree_equals_reference(codec, reference):
    for t in texts():
        ids = codec.encode(t)
        assert ids == reference.encode_ordinary(t), t[:60]
        assert codec.decode(ids) == t.encode()


@pytest.mark.parametrize("unit", ["a", "-", "0", "ab", " ", "é", "abc-"])
def test_long_runs(codec, reference, unit):
    """A run of a million characters takes seconds; the reference only manages shorter ones, so lengths near
    each other are compared there, and of the long one every pair of neighbours and the bytes."""
    for n in (4001, 20003):
        assert codec.encode(unit * n) == reference.encode_ordinary(unit * n)
    text = unit * 1_000_003
    began = time.perf_counter()
    ids = codec.encode(text)
    assert time.perf_counter() - began < 20
    assert codec.decode(ids) == text.encode()
    if codec.pattern.fullmatch(text):
        assert all(codec.compatible(a, b) for a, b in zip(ids, ids[1:]))


def test_window_equals_merging(codec):
    r = random.Random(7)
    for _ in range(2000):
        data = bytes(r.choice(r.choice([b"ab", b"theandir ", bytes(range(256)), b"-=", b"aeioust"])) for _ in range(r.randrange(1, 40)))
        assert codec._window(data) == codec._direct(data)


def test_join_is_associative(codec):
    r = random.Random(5)
    for _ in range(300):
        a, b, c = (bytes(r.choice(b"theandir ") for _ in range(r.randrange(12))) for _ in range(3))
        ea, eb, ec = (codec._direct(x) for x in (a, b, c))
        assert codec.join(codec.join(ea, eb), ec) == codec.join(ea, codec.join(eb, ec)) == codec._direct(a + b + c)


def test_frames(spark, reference):
    rows = [(1, "the cat", "x"), (2, None, "y"), (2, "", None), (None, "the cat" * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(df, PATH, public_tokenizers.PATTERN, decoded_col="decoded")
    got = sorted(map(tuple, out.select("doc_id", *bpe.digests(out)).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN, keep=["doc_id"])
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_equals_reference(spark, reference):
    from tessera.llm import queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.op10_bpe(spark, d).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
