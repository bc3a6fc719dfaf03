"""Near-duplicates by SuperMinHash signatures, banding, exact verification and union-find.

One pass over the texts computes each document's set of word shingles (as 64-bit hashes), a 128-bit digest
of the set and its SuperMinHash bands. Documents with equal sets are one class from then on, so exact
copies cost nothing further, however many there are. Classes that share a band are candidates. Inside a
bucket of candidates pairs are never enumerated: every member is compared to one centre, on the full sets,
and the confirmed links are joined to components. Further centres serve the buckets that still hold several
components, as long as a round joins a fifth of these (ROUNDS at most; what they leave is joined exactly, so
their number changes no result). The members of the buckets that then remain open are joined by prefix
filtering: with a set's shingles in the order of their rarity, two sets that reach the threshold share one
among the first few of each, at positions that leave room for the overlap. Pairs inside one component need
no comparison, as they cannot change the result, so members of a shingle's largest component only meet the
others. Near copies with many changes of their own start with shingles that no other has, and meet nobody.

The number of bands follows from the threshold: a pair at the threshold is missed with a probability of at
most MISS. Sets of candidates are made once; ids and pairs are broadcast only below BROADCAST_IDS of them, and
more ids as a bitmap of at most SIEVE_BITS, so that documents are picked without a shuffle of their texts. A
centre with many members, and a shingle that many have, are divided: the many are dealt out by a salt, and the
other side is sent once to each part, not once to each pair.

Defined results: a document without words or text has an empty set and is linked with nothing; one with
fewer words than a shingle has one shingle, the whole sequence; rows that share an id are linked with each
other through it; a row with a null id is linked with nothing, has a null component_id and is kept by
components(); deduplicate() tells rows that share an id, or have none, apart and keeps one row of each group;
ids may be of any type with an order; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph, runtime
from . import textkernel as tk

SHARD_BYTES = 1 << 20
ROWS = 5
MISS = 1e-7
BROADCAST_IDS = 500_000
SIEVE_BITS = 1 << 27
ROUNDS = 8  # further centres of a bucket
DEALT = 1000  # rows of a centre or a shingle that go to one task together
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.array([0x9E3779B97F4A7C15 + 0x6A09E667F3BCC909 * k & (1 << 64) - 1 | 1 for k in range(64)], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row, and the rows' offsets."""
    n_rows = len(offsets) - 1
    starts, ends, rows = tk.word_bounds(data, offsets, tk.NON_SPACE)
    (h,) = tk.word_hashes(data, starts, ends)
    count = np.bincount(rows, minlength=n_rows)
    value = np.zeros(len(h), np.uint64)
    whole = np.zeros(len(h), bool)
    whole[: max(0, len(h) - words + 1)] = rows[words - 1 :] == rows[: max(0, len(h) - words + 1)] if len(h) >= words else False
    i = np.flatnonzero(whole)
    for k in range(words):
        value[i] += h[i + k] * _ODD[k]
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    for size in range(1, words):  # shorter documents: one shingle
        j = first[count == size]
        for k in range(size):
            value[j] += h[j + k] * _ODD[k]
        value[j] += _ODD[32 + size % 32]
        whole[j] = True
    v, r = tk.mix(value[whole]), rows[whole]
    order = np.lexsort((v, r))
    v, r = v[order], r[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[new], r[new]
    return v, np.concatenate(([0], np.cumsum(np.bincount(r, minlength=n_rows))))


def superminhash(elements: np.ndarray, offsets: np.ndarray, m: int, seed: int = 0) -> np.ndarray:
    """SuperMinHash signatures, one row of m values for each set.

    Every element draws a random permutation of the m slots, slot by slot (Fisher-Yates), and offers the
    slot at rank j the value j + r with a fresh r in [0, 1); a slot keeps the least offer. Ranks are gone
    through for all sets at once, and a set stops as soon as all its slots are taken: later ranks only
    offer larger values. A value is the rank above 48 random bits.
    """
    n_sets = len(offsets) - 1
    sig = np.full((n_sets, m), _EMPTY)
    flat = sig.reshape(-1)
    size = np.diff(offsets)
    row = np.repeat(np.arange(n_sets), size)
    state = elements ^ tk.mix(np.array([seed + 1], np.uint64))[0]
    perm = None
    for j in range(m):
        if not len(row):
            break
        x = tk.mix(state + np.uint64(0x9E3779B97F4A7C15 * (2 * j + 1) & (1 << 64) - 1))
        y = tk.mix(x + np.uint64(0xD1B54A32D192ED03))
        k = (j + ((y >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32))).astype(np.int64)
        if j == 0:
            slot = k
        else:
            if perm is None:  # after rank 0: slots 0 and k0 have changed places
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(row), 1))
                at = np.arange(len(row))
                perm[at, k0] = 0
                perm[at, 0] = k0
            at = np.arange(len(row))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, j]
        np.minimum.at(flat, row * m + slot, (np.uint64(j) << np.uint64(48)) | (x >> np.uint64(16)))
        open_ = (sig == _EMPTY).any(1)
        go = open_[row]
        if j == 0:
            k0 = k[go]
        if not go.all():
            row, state = row[go], state[go]
            if perm is not None:
                perm = perm[go]
    return sig


def bands_of(sig: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each run of `rows` values, the band's number mixed in."""
    n, m = sig.shape
    b = sig.reshape(n, m // rows, rows)
    return tk.mix((b * _ODD[:rows]).sum(2, dtype=np.uint64) + np.arange(m // rows, dtype=np.uint64) * _ODD[40])


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _per_shard(text_index: int, f):
    def make():
        def each(batch):
            data, offsets = tk.column_bytes(batch.column(text_index))
            for lo, hi in runtime.rows_within(offsets, SHARD_BYTES):
                yield f(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])

        return each

    return make


def _signatures(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """(id, n, d1, d2, bands) for (id, text)."""

    def f(data, offsets):
        v, off = shingles(data, offsets, words)
        sums = np.zeros((2, len(v) + 1), np.uint64)
        np.cumsum(tk.mix(v ^ _ODD[50]), out=sums[0, 1:])
        np.cumsum(tk.mix(v + _ODD[51]), out=sums[1, 1:])
        d = (sums[:, off[1:]] - sums[:, off[:-1]]).view(np.int64)
        full = np.diff(off) > 0
        b = bands_of(superminhash(v, off, bands * ROWS), ROWS)[full]
        ends = np.concatenate(([0], np.cumsum(np.where(full, bands, 0))))
        return [pa.array(np.diff(off)), pa.array(d[0]), pa.array(d[1]), _lists(b.reshape(-1), ends)]

    long = T.LongType()
    return runtime.map_arrow(docs, ["text"], _per_shard(0, f), [("n", long), ("d1", long), ("d2", long), ("bands", T.ArrayType(long))], ["id"])


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, set) for (id, text)."""

    def f(data, offsets):
        return [_lists(*shingles(data, offsets, words))]

    return runtime.map_arrow(docs, ["text"], _per_shard(0, f), [("set", T.ArrayType(T.LongType()))], ["id"])


def _marked(rows: DataFrame, key: str, ids: DataFrame, n: int) -> DataFrame:
    """The rows and `_maybe`: true if the key is among the n ids, and for a few other keys by chance. The ids are
    broadcast as a bitmap, in chunks of 64 words, so that the rows stay where they are."""
    bits = min(SIEVE_BITS, 1 << max(12, (32 * n).bit_length()))

    def place(column: str):
        return F.pmod(F.xxhash64(column), F.lit(bits)).alias("_place")

    words = ids.select(place(ids.columns[0])).groupBy(F.expr("_place div 64").alias("_word"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, cast(_place % 64 as int)))").alias("_bits"))
    chunks = words.groupBy(F.expr("_word div 64").alias("_chunk")).agg(F.expr("map_from_entries(collect_list(struct(_word % 64, _bits)))").alias("_words"))
    at = rows.select("*", place(key)).withColumn("_chunk", F.expr("_place div 4096"))
    bit = F.expr("coalesce(shiftright(_words[_place div 64 % 64], cast(_place % 64 as int)) & 1L = 1L, false)")
    return at.join(F.broadcast(chunks), "_chunk", "left").select(*rows.columns, bit.alias("_maybe"))


def _without(rows: DataFrame, key: str, ids: DataFrame, scratch: runtime.Scratch) -> DataFrame:
    """The rows whose key is not among the ids; no two rows share a key, and none lacks it. Only keys are shuffled:
    those that the bitmap wrongly takes for ids are found by a join of keys, and their rows stay."""
    ids = scratch.table(ids, "gone")
    n = ids.count()
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), key, "left_anti")
    by_chance = _marked(rows.select(key), key, ids, n).where("_maybe").select(key).join(ids, key, "left_anti")
    by_chance = scratch.table(by_chance.withColumn("_stays", F.lit(True)), "by-chance")
    if by_chance.count() <= BROADCAST_IDS:
        by_chance = F.broadcast(by_chance)
    found = _marked(rows, key, ids, n).join(by_chance, key, "left")
    return found.where(~F.col("_maybe") | F.col("_stays").isNotNull()).select(*rows.columns)


class _Finder:
    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.docs, self.words, self.percent = docs, words, percent
        t = percent / 100
        self.bands = math.ceil(math.log(MISS) / math.log(1 - t**ROWS))
        self.scratch = runtime.Scratch(docs.sparkSession, "neardup")

    def close(self, a: str, b: str):
        """Sizes that allow the threshold."""
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def of_ids(self, ids: DataFrame) -> DataFrame:
        """The documents with these ids, each id once in `ids`; with many ids, a few other documents too."""
        n = ids.count()
        if n <= BROADCAST_IDS:
            return self.docs.join(F.broadcast(ids), "id", "left_semi")
        return _marked(self.docs, "id", ids, n).where("_maybe").drop("_maybe")

    def sets(self, ids: DataFrame) -> DataFrame:
        """The full sets of these ids, and of a few others, as a table."""
        ids = self.scratch.table(ids.distinct(), "ids")
        out = self.scratch.table(_sets(self.of_ids(ids), self.words), "sets")
        self.scratch.drop(ids)
        return out

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the threshold, as a table. b's set goes to a's, whose pairs
        are dealt out DEALT at a time; a's set goes there once for each deal."""
        s = self.scratch
        deals = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("deals"))
        dealt = s.table(pairs.join(deals, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int").alias("deal")), "dealt")
        few = F.broadcast(dealt) if dealt.count() <= BROADCAST_IDS else dealt
        right = sets.toDF("b", "sb").join(few, "b")
        left = sets.toDF("a", "sa").join(deals, "a").select("a", "sa", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
        both = F.size(F.array_intersect("sa", "sb"))
        links = (
            right.join(left, ["a", "deal"])
            .select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), both.alias("both"))
            .where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * self.percent)
        )
        out = s.table(links.select("a", "b").distinct(), "links")
        s.drop(dealt)
        return out

    def run(self) -> DataFrame:
        s = self.scratch
        sig = s.table(_signatures(self.docs, self.words, self.bands), "signatures")
        known = sig.where("n > 0 and id is not null")
        classes = s.table(
            known.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes"
        )
        member = known.select("id", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select("id", "rep")
        # ids with several texts link their classes
        several = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("id", "a")
        links = s.table(member.join(several, "id").where("a < rep").select("a", F.col("rep").alias("b")).distinct(), "same-id")

        banded = classes.select("rep", "n", F.explode("bands").alias("bk"))
        centre = banded.groupBy("bk").agg(F.min("rep").alias("c"), F.min_by("n", "rep").alias("cn"), F.count(F.lit(1)).alias("k")).where("k > 1")
        buckets = s.table(banded.join(centre, "bk"), "buckets")
        pairs = s.table(buckets.where(F.col("c") < F.col("rep")).where(self.close("n", "cn")).select(F.col("c").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
        tested = pairs
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        links = links.unionAll(self.verified(pairs, sets))
        s.drop(sets)
        labels = s.table(graph.components(links, s), "labels")

        sets, before = None, None
        for turn in range(ROUNDS + 1):
            rows = self._open(buckets, labels, turn)
            if rows.isEmpty():
                break
            if sets is None:  # later rounds leave a part of these open
                sets = self.sets(rows.select(F.col("rep").alias("id")))
            left = rows.select("comp").distinct().count()
            last = turn == ROUNDS or (before is not None and left > 0.8 * before)
            before = left
            pairs = s.table(self._rest(rows, sets) if last else self._second(rows), "pairs")
            pairs = s.table(pairs.join(tested, ["a", "b"], "left_anti"), "untested")
            if not pairs.isEmpty():
                links = links.unionAll(self.verified(pairs, sets))
                tested = tested.unionAll(pairs)
                labels = s.table(graph.components(links, s), "labels")
            if last:
                break
        comp = member.distinct().join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
        comp = comp.groupBy("id").agg(F.min(F.coalesce("label", "rep")).alias("component"))
        found = sig.select("id", "n").join(comp, "id", "left").select(
            "id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component")
        )
        found = s.table(found, "components")
        s.close(found)
        return found

    def _open(self, buckets: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
        """(bk, rep, n, comp, k, c): the members of the buckets that hold several components, and a centre."""
        rows = (
            buckets.select("bk", "rep", "n")
            .join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
            .select("bk", "rep", "n", F.coalesce("label", "rep").alias("comp"))
        )
        spread = rows.groupBy("bk").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k"), F.max_by("rep", F.xxhash64("rep", F.lit(turn))).alias("c")
        ).where("lo <> hi")
        return self.scratch.table(rows.join(spread.select("bk", "k", "c"), "bk"), "open")

    def _second(self, rows: DataFrame) -> DataFrame:
        """Pairs of each member of the open buckets with a centre of another component."""
        centre = rows.where("rep = c").select("bk", F.col("n").alias("cn"), F.col("comp").alias("cc")).distinct()
        return (
            rows.join(centre, "bk")
            .where("comp <> cc")
            .where(self.close("n", "cn"))
            .select(F.least("c", "rep").alias("a"), F.greatest("c", "rep").alias("b"))
            .distinct()
        )

    def _rest(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """All pairs of different components among the open buckets' members that may reach the threshold."""
        s, p = self.scratch, self.percent
        reps = s.table(rows.select("rep", "comp").distinct(), "open-members")
        sets = sets.join(reps, sets["id"] == reps["rep"]).select("rep", "comp", F.xxhash64("set").alias("h"), F.size("set").alias("n"), "set")
        tokens = sets.select("rep", "comp", "h", "n", F.explode("set").alias("token"))
        shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        own = Window.partitionBy("rep", "h")
        # shingles that no other member has come first: they take up places, but need no rows
        place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "token"))
        prefix = tokens.join(shared, "token").withColumn("i", place).where(F.expr(f"i <= n - (n * {p} + 99) div 100 + 1"))
        prefix = s.table(prefix.select("token", "rep", "n", "i", "comp"), "prefixes")
        sizes = prefix.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
        mixed = sizes.groupBy("token").agg(
            F.max_by("comp", F.struct("k", "comp")).alias("major"), F.count(F.lit(1)).alias("comps"), F.ceil(F.sum("k") / DEALT).cast("int").alias("deals")
        )
        # a table of its own, so that the joins with it can be divided where a shingle has many rows
        mixed = s.table(mixed.where("comps > 1").drop("comps"), "mixed")
        marked = prefix.join(mixed, "token")
        minor = marked.where("comp <> major").withColumn("deal", F.pmod(F.xxhash64("rep"), F.col("deals")).cast("int")).drop("major", "deals")
        other = marked.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select("token", "rep", "n", "i", "comp", "deal")
        other = other.toDF("token", "rep2", "n2", "i2", "comp2", "deal")
        overlap = f"((n + n2) * {p} + {99 + p}) div {100 + p}"
        room = F.expr(f"comp <> comp2 and i <= n - {overlap} + 1 and i2 <= n2 - {overlap} + 1") & self.close("n", "n2")
        found = minor.join(other, ["token", "deal"]).where(room)
        return found.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """For each row: id_col, n_shingles, component_id (the smallest id reachable over links, itself included)
    and kept (id = component_id). Two documents are linked if 100 * |intersection| >= percent * |union| of
    their sets of `words`-word shingles; words are lower-cased (A-Z) and divided by white space."""
    inner = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema[id_col].dataType
    if isinstance(kind, T.IntegralType):
        out = _Finder(inner.withColumn("id", F.col("id").cast("long")), words, percent).run()
    else:
        # links are found between numbers: the ids' places in their order
        scratch = runtime.Scratch(docs.sparkSession, "neardup-ids")
        ids = inner.select("id").where("id is not null").distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias("number"))
        ids = scratch.table(ids, "ids")
        numbered = inner.join(ids, "id", "left").select(F.col("number").alias("id"), "text")
        found = _Finder(numbered, words, percent).run()
        found = found.join(ids.select("id", "number").toDF("own", "id"), "id", "left")
        found = found.join(ids.select(F.col("id").alias("first"), F.col("number").alias("component")), "component", "left")
        out = found.select(F.col("own").alias("id"), "n", F.col("first").alias("component"))
    return out.select(
        F.col("id").cast(kind).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").cast(kind).alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, with its own columns: the row with the least id."""
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    own = docs.toDF(*names)
    key, text = (next(k for k, c in names.items() if c == x) for x in (id_col, text_col))
    if own.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).isEmpty():
        found = components(own.select(key, text), key, text, words, percent)
        kept = _without(own, key, found.where(~F.col("kept")).select(key), runtime.Scratch(docs.sparkSession, "neardup-gone"))
    else:
        # rows are told apart by a number of their own
        scratch = runtime.Scratch(docs.sparkSession, "neardup-rows")
        rows = scratch.table(own.withColumn("row", F.monotonically_increasing_id()), "rows")
        found = components(rows.select("row", text), "row", text, words, percent).join(rows.select("row", key), "row")
        groups = found.groupBy("component_id").agg(F.min(F.struct(F.col(key).isNull(), F.col(key), "row"))["row"].alias("row"))
        gone = found.select("row").join(groups.select("row"), "row", "left_anti")
        kept = _without(rows, "row", gone, scratch).drop("row")
    return kept.select(*[F.col(k).alias(c) for k, c in names.items()])
