"""Token counts of a unigram model by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words (divided by white space), each with the word-start mark before it. The
best segmentation of a pre-token into pieces maximises the sum of the pieces' scores; the forward score at
a position depends on nothing behind it, so all pre-tokens that share a prefix share its forward scores.
The distinct pre-tokens of a shard of documents form a trie that is gone through depth first: in sorted
order each pre-token enters the trie at the node where it leaves the one before, and only the nodes from
there on are computed, each exactly once. The forward scores, numbers of pieces and open pieces of the
current path are all that is held. The count at a pre-token's last node is stored and summed over the
documents; stored counts are kept for later shards, up to WORDS of them, so memory is bounded, and no
shuffle is needed.

A piece's score is the logarithm of its Zipf probability, 1 / (rank + 2), by the vocabulary's own order;
a character without a piece falls back to its UTF-8 bytes. Equal scores go to fewer pieces.

Defined results: a null or empty text, or one of white space, has no pre-tokens and no tokens.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import runtime

MARK = "▁"
WORDS = 300_000  # stored counts per Python worker
SHARD_CHARS = 4_000_000
LONG = 64  # longer pre-tokens are not stored beyond their shard


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece vocabulary, best first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [sp.id_to_piece(i) for i in sorted(ids, key=lambda i: (-sp.get_score(i), i))]


class Unigram:
    """Scores of pieces, as nested tables: character -> (table of what may follow, score of the piece so far)."""

    def __init__(self, pieces: list[str]):
        total = math.log(sum(1 / (r + 2) for r in range(len(pieces) + 256)))
        self.root: dict = {}
        for r, p in enumerate(pieces):
            at = self.root
            for c in p[:-1]:
                at = at.setdefault(c, [{}, None])[0]
            last = at.setdefault(p[-1], [{}, None])
            if last[1] is None:
                last[1] = -math.log(r + 2) - total
        self.byte = -math.log(len(pieces) + 258) - total

    def counts(self, words: list[str]):
        """(word, tokens) for sorted distinct words, by depth-first traversal of their trie."""
        root, byte = self.root, self.byte
        # by depth of the path: forward score, pieces, open pieces as (table, depth at which they began)
        best, count = [0.0], [0]
        going = [[(root, 0)]]
        before = ""
        for word in words:
            s = MARK + word
            # the node where this pre-token leaves the path of the last one
            keep, most = 0, min(len(s), len(before))
            while keep < most and s[keep] == before[keep]:
                keep += 1
            del best[keep + 1 :], count[keep + 1 :], going[keep + 1 :]
            for depth in range(keep, len(s)):
                c = s[depth]
                width = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                top, n = best[depth] + width * byte, count[depth] + width
                further = []
                for table, start in going[depth]:
                    found = table.get(c)
                    if found is not None:
                        table, own = found
                        if own is not None:
                            own += best[start]
                            if own > top or (own == top and count[start] + 1 < n):
                                top, n = own, count[start] + 1
                        if table:
                            further.append((table, start))
                further.append((root, depth + 1))
                best.append(top)
                count.append(n)
                going.append(further)
            before = s
            yield word, count[-1]


class Counter:
    """Counts of pre-tokens, kept between shards."""

    def __init__(self, model: Unigram):
        self.model = model
        self.stored: dict[str, int] = {}

    def shard(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.stored) > WORDS:
            self.stored.clear()
        words = [t.split() for t in texts]
        stored = self.stored
        fresh: set[str] = set().union(*words).difference(stored) if words else set()
        own = dict(self.model.counts(sorted(fresh)))
        stored.update(own)
        out = [(len(w), sum(map(stored.__getitem__, w))) for w in words]
        for w in fresh:
            if len(w) > LONG:
                del stored[w]
        return out


def count(docs: DataFrame, pieces: list[str], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all), n_pretokens and n_tokens of each whole text. The vocabulary is
    broadcast; its size is fixed and independent of the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def make():
        counter = Counter(Unigram(shared.value))

        def emit(texts):
            found = counter.shard(texts)
            return [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())]

        def each(batch):
            texts, size = [], 0
            for v in batch.column(0):
                texts.append(v.as_py() or "")
                size += len(texts[-1])
                if size > SHARD_CHARS:
                    yield emit(texts)
                    texts, size = [], 0
            if texts:
                yield emit(texts)

        return each

    fields = [("n_pretokens", T.LongType()), ("n_tokens", T.LongType())]
    return runtime.map_arrow(docs, [text_col], make, fields, docs.columns if keep is None else keep, SHARD_CHARS)
