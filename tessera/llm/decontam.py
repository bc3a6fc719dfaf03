"""Benchmark decontamination with suffix arrays over the training shards.

Every shard (SHARD_BYTES of documents inside one task, gathered from its batches) gets a suffix array over
its words; every suffix of every benchmark item whose first word the shard has is looked up in it by binary
search, word by word, which yields the longest verbatim matches and where they lie. Nothing is shuffled: the
documents stay where they were read, and the benchmark travels to them in blocks of a fixed size
(`block_words`), each broadcast on its own. The driver holds one block at a time, and a worker that has more
than RESIDENT of them to go through holds one at a time too and reads it again from its disk for the next
shard.

Suffixes that start with a word outside the block's vocabulary, or whose run of known words is
shorter than every window, cannot hold a window and are left out of the array; this loses nothing.

Defined results: a null text has no words; an item without words matches nothing; items with a null
id are ignored; items that share an id count once; item ids keep their type; repeated documents each get
their own row; an empty benchmark leaves every document clean; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import runtime
from . import textkernel as tk

SHARD_BYTES = 4 << 20
BLOCK_WORDS = 1 << 20
RESIDENT = 2  # blocks that a worker may keep


class Block:
    """Benchmark items as numbers: a vocabulary, the items' words and each suffix's window length. `keys` are
    hashes of the items' ids."""

    def __init__(self, keys: list[int], ids: list, texts: list[str], window: int):
        data, offsets = tk.column_bytes(pa.array(texts, pa.large_string()))
        starts, ends, rows = tk.word_bounds(data, offsets, tk.ALNUM)
        (hashes,) = tk.word_hashes(data, starts, ends)
        self.vocab, words = np.unique(hashes, return_inverse=True)
        n_words = np.bincount(rows, minlength=len(texts))
        # items one after another, each closed by a 0; words are numbered from 1
        place = np.arange(len(words)) + rows
        self.words = np.zeros(len(words) + len(texts), np.int64)
        self.words[place] = words + 1
        first = np.concatenate(([0], np.cumsum(n_words)))[:-1]
        inside = np.arange(len(words)) - first[rows]
        left = n_words[rows] - inside
        self.keys, self.ids = keys, ids
        self.item = rows
        self.start = place
        self.offset = inside
        self.left = left
        length = np.minimum(n_words[rows], window)
        self.need = np.where(left >= length, length, 0)  # 0: no window starts here
        self.shortest = int(self.need[self.need > 0].min()) if (self.need > 0).any() else 0


def suffix_array(x: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions `at` in the order of their suffixes of x up to the next 0, compared to `depth` words.

    Prefix doubling over the chosen positions: ranks by the first k words give ranks by 2k words.
    Positions must be closed under "next known word", i.e. a chosen position's run is chosen whole.
    """
    rank = np.zeros(len(x) + 1, np.int64)
    rank[at] = np.unique(x[at], return_inverse=True)[1] + 1
    k = 1
    while True:
        second = rank[np.minimum(at + k, len(x))]
        key = rank[at] * (len(at) + 2) + second
        distinct, inverse = np.unique(key, return_inverse=True)
        if 2 * k >= depth or len(distinct) == len(at):
            return at[np.argsort(inverse, kind="stable")]
        # a rank holds for k words only inside the run; beyond its end x is 0 and so is the rank
        fresh = np.zeros(len(x) + 1, np.int64)
        fresh[at] = inverse + 1
        rank, k = fresh, 2 * k


def _narrow(x: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int, word: np.ndarray):
    """The part of each interval [lo, hi) of the suffix array whose word number d is `word`."""

    def bound(right: bool) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        for _ in range(int(len(sa)).bit_length() + 1):
            open_ = a < b
            if not open_.any():
                break
            mid = (a + b) >> 1
            v = x[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + d, len(x) - 1)]
            less = (v <= word) if right else (v < word)
            a = np.where(open_ & less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        return a

    return bound(False), bound(True)


def _search(x: np.ndarray, block: Block, locate: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (depth, suffixes, lo, hi, suffix array) when suffixes have matched their window, and, with
    `locate`, at every further depth while they still match."""
    known = x > 0
    if not block.shortest or not known.any():
        return
    # length of the run of known words from each position on
    stop = np.where(known, len(x), np.arange(len(x)))
    run = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(x))
    begin = known & ~np.concatenate(([False], known[:-1]))
    whole = np.repeat(run[begin], run[begin])  # for each known position, the length of its whole run
    at = np.flatnonzero(known)[whole >= block.shortest]
    if not len(at):
        return
    sa = suffix_array(x, at, int(block.left.max()))
    here = np.zeros(len(block.vocab) + 1, bool)
    here[x[at]] = True
    live = np.flatnonzero(block.need > 0)
    live = live[here[block.words[block.start[live]]]]
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64)
    d = 0
    while len(live):
        lo, hi = _narrow(x, sa, lo, hi, d, block.words[block.start[live] + d])
        d += 1
        ok = hi > lo
        live, lo, hi = live[ok], lo[ok], hi[ok]
        full = block.need[live] <= d if locate else block.need[live] == d
        if full.any():
            yield d, live[full], lo[full], hi[full], sa
        ok = block.left[live] > d if locate else block.need[live] > d
        live, lo, hi = live[ok], lo[ok], hi[ok]


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which interval, its members) for all intervals, one after another."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def scan(hashes: np.ndarray, rows: np.ndarray, n_rows: int, blocks, locate: bool):
    """Per row: words, hit words, and (row, number of the item's id, item start, document start, length) of the
    longest match of each pair; and the ids in the order of their numbers."""
    n_words = np.bincount(rows, minlength=n_rows)
    place = np.arange(len(hashes)) + rows  # a 0 closes every row
    first = np.concatenate(([0], np.cumsum(n_words + 1)))[:-1]
    total = len(hashes) + n_rows
    row_of = np.repeat(np.arange(n_rows), n_words + 1)
    hit = np.zeros(total + 1, bool)
    found: list[np.ndarray] = []
    number: dict[int, int] = {}
    ids: list = []
    for block in blocks:
        if not len(block.vocab):
            continue
        x = np.zeros(total, np.int64)
        i = np.minimum(np.searchsorted(block.vocab, hashes), len(block.vocab) - 1)
        x[place] = np.where(block.vocab[i] == hashes, i + 1, 0)
        for d, suffix, lo, hi, sa in _search(x, block, locate):
            item = block.item[suffix]
            # equal windows have equal intervals: each interval is unrolled once
            span, group = np.unique(lo * (len(sa) + 1) + hi, return_inverse=True)
            l, h = span // (len(sa) + 1), span % (len(sa) + 1)
            which, index = _expand(l, h)
            pos = sa[index]
            grow = np.zeros(total + 1, np.int64)
            np.add.at(grow, pos, 1)
            np.add.at(grow, pos + d, -1)
            hit |= np.cumsum(grow) > 0
            # (interval, row) once, then that interval's items
            pair, where = np.unique(which * np.int64(n_rows) + row_of[pos], return_index=True)
            order = np.argsort(group, kind="stable")
            begin = np.searchsorted(group[order], np.arange(len(span) + 1))
            g, r = pair // n_rows, pair % n_rows
            k, m = _expand(begin[g], begin[g + 1])
            s = order[m]
            start = pos[where][k] - first[r[k]]
            own, each = np.unique(item[s], return_inverse=True)
            for i in own.tolist():
                if number.setdefault(block.keys[i], len(ids)) == len(ids):
                    ids.append(block.ids[i])
            own = np.array([number[block.keys[i]] for i in own.tolist()], np.int64)
            found.append(np.stack([r[k], own[each], block.offset[suffix[s]], start, np.full(len(k), d)], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
    order = sorted(range(len(ids)), key=lambda i: repr(ids[i]) if isinstance(ids[i], (dict, list)) else ids[i])
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    ids = [ids[i] for i in order]
    pairs[:, 1] = place[pairs[:, 1]]
    # the longest match of each (row, item), the first of several
    pairs = pairs[np.lexsort((pairs[:, 3], pairs[:, 2], -pairs[:, 4], pairs[:, 1], pairs[:, 0]))]
    if len(pairs):
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:, 0] != pairs[:-1, 0]) | (pairs[1:, 1] != pairs[:-1, 1])
        pairs = pairs[new]
    n_hit = np.bincount(row_of[np.flatnonzero(hit[:total])], minlength=n_rows)
    return n_words, n_hit, pairs, ids


def _one_by_one(blocks) -> Iterator[Block]:
    """The broadcasts' blocks; if there are many, each is let go before the next is read."""
    for b in blocks:
        yield b.value
        if len(blocks) > RESIDENT:
            b.__dict__.pop("_value", None)


def _blocks(bench: DataFrame, item_col: str, text_col: str, window: int, block_words: int):
    """Broadcasts of at most block_words words each (a longer item stands alone)."""
    sc = bench.sparkSession.sparkContext
    rows = (
        bench.select(F.col(f"`{item_col}`").alias("i"), F.xxhash64(f"`{item_col}`").alias("k"), F.col(f"`{text_col}`").alias("t"))
        .where("i is not null and t is not null")
        .toLocalIterator()
    )
    keys, ids, texts = [], [], []
    out, size = [], 0
    for r in rows:
        if ids and size + len(r.t) // 2 > block_words:
            out.append(sc.broadcast(Block(keys, ids, texts, window)))
            keys, ids, texts, size = [], [], [], 0
        keys.append(r.k)
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t) // 2 + 1
    if ids:
        out.append(sc.broadcast(Block(keys, ids, texts, window)))
    return out


def annotate(
    docs: DataFrame,
    bench: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    keep: list[str] | None = None,
    locate: bool = True,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Columns `keep` (default: all) of docs, with n_words, n_hit and matches: one entry per benchmark item
    with a window in the document, holding its longest verbatim match (item_start, doc_start, length in
    words). With locate=False entries carry the window itself in place of the longest match."""
    blocks = _blocks(bench, item_col, item_text_col, window, block_words)
    kind = bench.schema[item_col].dataType
    arrow_kind = to_arrow_type(kind)
    entry = T.StructType([T.StructField("item_id", kind), *(T.StructField(n, T.LongType()) for n in ("item_start", "doc_start", "length"))])
    arrow_entry = pa.struct([("item_id", arrow_kind), *((n, pa.int64()) for n in ("item_start", "doc_start", "length"))])

    def make():
        def each(batch):
            data, offsets = tk.column_bytes(batch.column(0))
            for lo, hi in runtime.rows_within(offsets, SHARD_BYTES):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, rows = tk.word_bounds(part, own, tk.ALNUM)
                (hashes,) = tk.word_hashes(part, starts, ends)
                n_words, n_hit, pairs, ids = scan(hashes, rows, hi - lo, _one_by_one(blocks), locate)
                counts = np.bincount(pairs[:, 0], minlength=hi - lo)
                ends_ = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                names = pa.array(ids, arrow_kind).take(pa.array(pairs[:, 1]))
                values = pa.StructArray.from_arrays([names, *(pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(2, 5))], fields=list(arrow_entry))
                yield [pa.array(n_words), pa.array(n_hit), pa.ListArray.from_arrays(pa.array(ends_), values)]

        return each

    fields = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("matches", T.ArrayType(entry))]
    return runtime.map_arrow(docs, [text_col], make, fields, docs.columns if keep is None else keep, SHARD_BYTES)


def remove_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = 10, **options) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    # the verdict stands beside the columns under a name that none of them has
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    inner = docs.toDF(*names)
    text = next(k for k, c in names.items() if c == text_col)
    out = annotate(inner, bench, text, window=window, locate=False, **options).where("n_hit = 0")
    return out.select(*[F.col(k).alias(c) for k, c in names.items()])
