"""Byte-level BPE by monoid tree reduction.

The encodings of byte strings form a monoid under `join`, so a string is encoded by a tree: its halves
are encoded on their own and joined. A sequence of tokens is the encoding of its bytes exactly if every
two neighbours a, b are `compatible`, i.e. if the bytes of a and b together encode to [a, b]. `join`
therefore checks the pair at the seam; if it is not compatible, it re-encodes a window of some tokens on
either side, and doubles the window until the pairs at both of the window's edges are compatible. All
other pairs lie inside the window (an encoding of its own) or inside a half, so the tokens outside the
window provably stay as they are. Windows are encoded from left to right in time with their length, by the
same rule of compatible neighbours, so a run of a million equal characters, whose windows grow to its end,
takes no longer than other text.

Texts are first divided by the tokenizer's pattern; each match is a tree of its own, and a text's ids are
the concatenation of its matches' ids, the monoid's product without seams. Decoding concatenates the
tokens' bytes, again up a tree.

Defined results: a null or empty text has no ids and decodes to no bytes; special tokens are never
produced; every byte string decodes back to itself, invalid surrogates excepted, which Arrow rejects.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime

LEAF = 24  # bytes encoded at once at the leaves of the tree
CACHE = 250_000  # distinct matches of a generation, of which a Python worker keeps two; half of the pairs it keeps
REPEATED = 1 << 10  # bytes from which on a half that equals the last one of its length is not encoded again
OUT_BYTES = 1 << 20  # of ids or bytes, after which a batch goes out


class Codec:
    """Encoder and decoder for a rank file's tokens (bytes in base64, a blank, the rank, on each line)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1 if ranks else 0)
        for t, r in ranks.items():
            self.token[r] = t
        self.pattern = regex.compile(pattern)
        # lengths of the tokens that begin like this, longest first: by three bytes, at an end by two
        lengths: dict[bytes, set[int]] = {}
        for t in ranks:
            lengths.setdefault(t[:3], set()).add(len(t))
        self._lengths = {k: tuple(sorted(v | {1} | ({2} if k[:2] in ranks else set()), reverse=True)) for k, v in lengths.items()}
        self._pairs: dict[int, bool] = {}  # keyed by one number, which takes less memory than a tuple
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    @classmethod
    def read(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def _direct(self, data: bytes) -> list[int]:
        """Merging the pair of lowest rank, the leftmost of equals, until none is left: what an encoding is.
        Takes time with the square of the length, so only pairs of tokens are encoded like this."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token a stays apart from a token b behind it."""
        key = a << 32 | b + 1
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= 2 * CACHE:
                self._pairs.clear()
            known = self._pairs[key] = self._direct(self.token[a] + self.token[b]) == [a, b]
        return known

    def _window(self, data: bytes) -> list[int]:
        """The encoding of a window, left to right in time with its length: the longest next token that is
        compatible with the one before it. A prefix of the window has one encoding only, so a place from
        which no token leads on is no seam of the window's encoding, and is never tried again."""
        ranks, lengths, pairs, n = self.ranks, self._lengths, self._pairs, len(data)
        out: list[int] = []
        dead: set[int] = set()
        at = 0
        while at < n:
            for k in lengths.get(data[at : at + 3], (2, 1)):
                end = at + k
                if end > n or end in dead or (t := ranks.get(data[at:end])) is None:
                    continue
                if out:
                    fits = pairs.get(out[-1] << 32 | t + 1)
                    if not (self.compatible(out[-1], t) if fits is None else fits):
                        continue
                elif k > 1 and not self._whole(t):
                    continue
                out.append(t)
                at = end
                break
            else:
                dead.add(at)
                at -= len(self.token[out.pop()])
        return out

    def _whole(self, t: int) -> bool:
        """Whether merging makes token t of its own bytes."""
        known = self._pairs.get(t << 32)
        if known is None:
            known = self._pairs[t << 32] = self._direct(self.token[t]) == [t]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring strings from theirs."""
        if not left or not right or self.compatible(left[-1], right[0]):
            return left + right
        size = 1
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            window = self._window(b"".join(map(self.token.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.compatible(left[i - 1], window[0])) and (j == len(right) or self.compatible(window[-1], right[j])):
                return left[:i] + window + right[j:]
            size *= 2

    def tree(self, data: bytes, last: dict[int, tuple[bytes, list[int]]] | None = None) -> list[int]:
        """The encoding of one match of the pattern. `last` holds the last half of each length, so a long run
        of one character costs each length of half once."""
        if len(data) <= LEAF:
            return self._window(data)
        last = {} if last is None else last
        if len(data) >= REPEATED and (seen := last.get(len(data))) and seen[0] == data:
            return seen[1]
        half = len(data) // 2
        out = self.join(self.tree(data[:half], last), self.tree(data[half:], last))
        if len(data) >= REPEATED:
            last[len(data)] = data, out
        return out

    def _word(self, match: str) -> bytes:
        """The ids of one match of the pattern, four bytes each."""
        ids = self._older.get(match)
        if ids is None:
            data = match.encode()
            rank = self.ranks.get(data)
            ids = array("i", (rank,) if rank is not None else self.tree(data)).tobytes()
        if len(match) <= 64:
            if len(self._words) >= CACHE:
                self._words, self._older = {}, self._words
            self._words[match] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """The ids of a text, four bytes each: the product of its matches' ids, which have no seams."""
        out = []
        matches = (m.group() for m in self.pattern.finditer(text)) if len(text) > 1 << 20 else iter(self.pattern.findall(text))
        while part := list(islice(matches, 100_000)):
            known = self._words.get
            out.append(b"".join([known(m) or self._word(m) for m in part]))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids) -> bytes:
        if len(ids) <= 100_000:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    return Codec.read(path, pattern)


def _ranks(df: DataFrame, path: str):
    """Sends the driver's rank file to the executors (Spark ships it by name); returns how to find it there."""
    df.sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    return lambda: SparkFiles.get(name)


def encode(
    df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """The columns `keep` (default: all) and out_col, the ids of text_col by the rank file at `path`. With
    decoded_col also the bytes that these ids decode to, in the same pass."""
    where = _ranks(df, path)

    def make():
        codec = _codec(where(), pattern)

        def each(batch):
            ids: list[bytes] = []
            back: list[bytes] = []
            size = 0

            def out():
                ends = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                return [lists, *([pa.array(back, pa.binary())] if decoded_col else [])]

            for value in batch.column(0):
                ids.append(codec.packed(value.as_py() or ""))
                if decoded_col:
                    back.append(codec.decode(array("i", ids[-1])))
                size += len(ids[-1])
                if size > OUT_BYTES:
                    yield out()
                    ids, back, size = [], [], 0
            if ids:
                yield out()

        return each

    fields: list[tuple[str, T.DataType]] = [(out_col, T.ArrayType(T.IntegerType()))]
    if decoded_col:
        fields.append((decoded_col, T.BinaryType()))
    return runtime.map_arrow(df, [text_col], make, fields, df.columns if keep is None else keep)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) and out_col, the bytes of ids_col; null ids have no bytes."""
    where = _ranks(df, path)

    def make():
        codec = _codec(where(), pattern)

        def each(batch):
            out, size = [], 0
            for value in batch.column(0):
                out.append(codec.decode(value.as_py() or []))
                size += len(out[-1])
                if size > OUT_BYTES:
                    yield [pa.array(out, pa.binary())]
                    out, size = [], 0
            if out:
                yield [pa.array(out, pa.binary())]

        return each

    return runtime.map_arrow(df, [ids_col], make, [(out_col, T.BinaryType())], df.columns if keep is None else keep)


def digests(df: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> list:
    """Columns n_tokens, ids_sha256 and decoded_sha256 of an encoded DataFrame."""
    return [
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col), 256).alias("decoded_sha256"),
    ]
