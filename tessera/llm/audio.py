"""Chroma fingerprints of recordings, and their alignment.

A recording's spectrum, frame by frame, is folded to twelve pitch classes. Filters that compare the sums of
rectangles of the frames-by-pitches image, taken from its integral image, are quantised to two bits each;
sixteen of them make a packed 32-bit integer per frame position. Two recordings are aligned by a histogram
of the offsets at which they have equal integers, where a query's integer also counts as each of those that
differ from it in some of its FLIPS least certain bits (whose filter values are next to a level). Every offset
found is checked by the bit errors of its overlap; of those that hold, the one found most often is taken.

Recordings with equal fingerprints are one class, told apart by a digest and not by their ids, and only classes
are compared, so copies cost nothing however many there are. An integer counts wherever it stands. Where it is
held, as in silence, its run is one row, and two runs add to the histogram once for each offset, with the number
of places that meet there, and not once for each pair of places. An integer that many recordings hold is dealt
out, DEALT rows at a time.

Defined results: a null, empty, unreadable or too short recording has no integers and aligns with nothing;
silence has integers of its own; repeated rows are copies of a class; rows that share an id but not their
recording each have a class and a result of their own; a null id is an id like others, but is the first of no class
that has another; empty tables give empty results.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime

RATE, FRAME, HOP = 8000, 1024, 512
LOW, HIGH = 55.0, 3520.0
SPAN = 16  # frames under the widest filter
#: (kind, first pitch class, pitch classes, frames) of the filters.
FILTERS = tuple((k % 4, (5 * k) % 12, 2 + (3 * k) % 9, (4, 8, 12, 16)[(k // 4) % 4]) for k in range(16))
LEVELS = (-0.35, 0.15, 0.65)  # areas without sound have a ratio of 0, well inside a step
GRAY = np.array([0, 1, 3, 2], np.uint32)
FLIPS = 6  # least certain bits of a query's integer, five bits each in the doubt
MAX_BIT_ERRORS = 0.2
MIN_OVERLAP = 12
DEALT = 20_000  # rows of an integer that go to one task together
BROADCAST_KEYS = 500_000
ROWS = 32


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (first channel, -1 to 1) and rate of a 16-bit PCM WAV file; empty if it is none."""
    none = np.zeros(0), RATE
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return none
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            fmt = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data" and fmt and fmt[0] == 1 and fmt[5] == 16 and fmt[1]:
            whole = len(body) // (2 * fmt[1]) * 2 * fmt[1]
            return np.frombuffer(body[:whole], "<i2")[:: fmt[1]] / 32768.0, fmt[2]
        at += 8 + size + size % 2
    return none


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    body = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(body))
    return head + body


def render(vector) -> tuple[np.ndarray, int]:
    """A vector as a melody: each value a tone of HOP samples whose pitch follows the value."""
    v = np.nan_to_num(np.asarray([] if vector is None else [0.0 if x is None else x for x in vector], float), posinf=1.0, neginf=-1.0)
    pitch = np.clip(np.round(v * 60), -24, 24)
    freq = 440.0 * 2 ** (pitch / 12)
    phase = np.cumsum(np.repeat(freq / RATE, HOP))
    return 0.5 * np.sin(2 * np.pi * phase), RATE


_classes: dict[int, np.ndarray] = {}


def _pitch_classes(rate: int) -> np.ndarray:
    """A (bins, 12) matrix of 0 and 1."""
    if rate not in _classes:
        f = np.fft.rfftfreq(FRAME, 1 / rate)
        out = np.zeros((len(f), 12))
        ok = np.flatnonzero((f >= LOW) & (f <= HIGH))
        out[ok, np.round(12 * np.log2(f[ok] / 440.0)).astype(int) % 12] = 1
        _classes[rate] = out
    return _classes[rate]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energies of the pitch classes, a row per frame, each row scaled to a sum of one."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    energy = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2 @ _pitch_classes(rate)
    total = energy.sum(1, keepdims=True)
    return np.where(total > 1e-9, energy / np.maximum(total, 1e-9), 1 / 12)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """Packed integers (as int32), one for each position at which the widest filter fits."""
    return doubted(frames)[0]


def doubted(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """fingerprint()'s integers, and for each the places of its FLIPS least certain bits, least certain lowest."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    wide = np.concatenate([frames, frames], 1)  # pitch classes go round
    image = np.zeros((len(wide) + 1, 25))
    image[1:, 1:] = wide.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0, t1, p0, p1):
        return image[t1, p1] - image[t0, p1] - image[t1, p0] + image[t0, p0]

    out = np.zeros(n, np.uint32)
    levels = np.array(LEVELS)
    gaps, places = np.zeros((n, len(FILTERS))), np.zeros((n, len(FILTERS)), np.int32)
    for k, (kind, p, high, long) in enumerate(FILTERS):
        h, l = high // 2, long // 2
        whole = area(t, t + long, p, p + high)
        if kind == 0:  # later against earlier
            part = area(t + l, t + long, p, p + high)
        elif kind == 1:  # upper against lower
            part = area(t, t + long, p + h, p + high)
        elif kind == 2:  # opposite quarters
            part = area(t, t + l, p, p + h) + area(t + l, t + long, p + h, p + high)
        else:  # the middle third in time
            part = area(t + long // 3, t + 2 * long // 3, p, p + high) * 1.5
        rest = whole - part
        value = np.log((part + 1e-3 * long) / (np.maximum(rest, 0) + 1e-3 * long))
        out = (out << np.uint32(2)) | GRAY[np.digitize(value, LEVELS)]
        far = np.abs(value[:, None] - levels)
        near = far.argmin(1)
        gaps[:, k] = far[t, near]
        places[:, k] = 2 * (len(FILTERS) - 1 - k) + (GRAY[near] ^ GRAY[near + 1]) // 2  # the bit that the level tells
    least = np.take_along_axis(places, gaps.argsort(1, kind="stable")[:, :FLIPS], 1)
    return out.view(np.int32), (least << (5 * np.arange(FLIPS, dtype=np.int32))).sum(1, dtype=np.int32)


def fingerprints(
    df: DataFrame, media_col: str, reader: Callable = read_wav, out_col: str = "fingerprint", keep: list[str] | None = None
) -> DataFrame:
    """The columns `keep` (default: all), out_col, the packed integers of the recording that `reader` makes of
    media_col's value (read_wav for WAV files, render for vectors), and out_col + "_doubt", their least certain bits."""

    def make():
        def each(batch):
            column = batch.column(0)
            for i in range(0, len(column), ROWS):
                prints = [doubted(chroma(*reader(v.as_py()))) for v in column[i : i + ROWS]]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(p) for p, _ in prints]))).astype(np.int32))
                yield [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c))) for c in zip(*prints)]

        return each

    ints = T.ArrayType(T.IntegerType())
    return runtime.map_arrow(df, [media_col], make, [(out_col, ints), (f"{out_col}_doubt", ints)], df.columns if keep is None else keep)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f mentions it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _runs(values: Column, what: list[str]) -> Column:
    """array<struct<..., pos, size>>: runs of equal neighbours in an array of structs with the fields `what`."""

    def of(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))
        return _let(starts, lambda s: F.zip_with(s, ends(v, s), lambda a, b: F.struct(*[F.get(v, a)[w].alias(w) for w in what], a.alias("pos"), (b - a).alias("size"))))

    def ends(v: Column, s: Column) -> Column:
        return F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.size(v)))

    return _let(values, of)


def _keys(classes: DataFrame) -> DataFrame:
    """(b, key, j, size): each run of an integer."""
    runs = F.explode(_runs(F.transform("fp", lambda x: F.struct(x.alias("key"))), ["key"])).alias("r")
    return classes.select(F.col("class").alias("b"), runs).select("b", "r.key", F.col("r.pos").alias("j"), F.col("r.size").alias("size_b"))


def _probes(classes: DataFrame) -> DataFrame:
    """(a, key, i, size): each run of an integer with any of its FLIPS least certain bits flipped."""
    both = F.zip_with("fp", "doubt", lambda x, d: F.struct(x.alias("fp"), d.alias("doubt")))
    each = classes.select(F.col("class").alias("a"), F.explode(_runs(both, ["fp", "doubt"])).alias("r")).select("a", "r.*")
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(2**FLIPS - 1))).alias("m"))
    key = F.col("fp")
    for i in range(FLIPS):
        key = key.bitwiseXOR(F.expr(f"shiftleft((m >> {i}) & 1, (doubt >> {5 * i}) & 31)"))
    return each.select("a", key.alias("key"), F.col("pos").alias("i"), F.col("size").alias("size_a"))


def _votes(probes: DataFrame, keys: DataFrame, scratch: runtime.Scratch) -> DataFrame:
    """(a, b, offset, votes): the histograms of offsets."""
    deals = keys.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("deals")).where("deals > 1")
    deals = scratch.table(deals, "deals")
    deals = F.broadcast(deals) if deals.count() <= BROADCAST_KEYS else deals
    dealt = keys.join(deals, "key", "left").select("*", F.pmod(F.xxhash64("b"), F.coalesce("deals", F.lit(1))).cast("int").alias("deal")).drop("deals")
    sent = probes.join(deals, "key", "left").select("*", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)).alias("deal")).drop("deals")
    hits = sent.join(dealt, ["key", "deal"]).where("a <> b")
    low, high = F.col("i") - F.col("j") - F.col("size_b") + 1, F.col("i") + F.col("size_a") - 1 - F.col("j")
    each = hits.select("a", "b", "size_a", "size_b", low.alias("low"), high.alias("high"), F.explode(F.sequence(low, high)).alias("offset"))
    meet = F.least("size_a", "size_b", F.col("offset") - F.col("low") + 1, F.col("high") - F.col("offset") + 1)
    return each.groupBy("a", "b", "offset").agg(F.sum(meet).alias("votes"))


def _digests(prints: DataFrame, id_col: str, is_query, fp_col: str) -> DataFrame:
    own = prints.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{fp_col}`").alias("fp"), F.col(f"`{fp_col}_doubt`").alias("doubt"), F.coalesce(is_query, F.lit(False)).alias("q"))
    return own.withColumn("d", F.when(F.size("fp") > 0, F.xxhash64("fp"))).withColumn("d2", F.when(F.size("fp") > 0, F.xxhash64(F.lit(1), "fp")))


def align(prints: DataFrame, id_col: str, is_query, fp_col: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): membership gives each row's id its class (a number) and the class's name `rep`, the
    smallest id with an equal fingerprint; pairs are classes (a: holds a query row, b: any other) that align, by
    name and by number (class_a, class_b), with the offset of b's start in a, the overlap and the share of
    differing bits. prints has fp_col and its doubt as fingerprints() makes them."""
    scratch = runtime.Scratch(prints.sparkSession, "audio")
    heard = _digests(prints, id_col, is_query, fp_col).where("d is not null")
    classes = heard.groupBy("d", "d2").agg(
        F.min("id").alias("rep"), F.first("fp").alias("fp"), F.min("doubt").alias("doubt"), F.max("q").alias("q"), F.count(F.lit(1)).alias("n")
    )
    classes = scratch.table(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    members = scratch.table(heard.select("id", "d", "d2", "q").join(classes.select("d", "d2", "rep", "class"), ["d", "d2"]).select("id", "rep", "class", "q", "d", "d2"), "members")
    votes = _votes(_probes(classes.where("q")), _keys(classes), scratch)
    one, other = (classes.select(F.col("class").alias(c), F.col("rep").alias(f"rep_{c}"), F.col("fp").alias(f"f{c}")) for c in "ab")
    pairs = votes.join(one, "a").join(other, "b")
    first = F.greatest("offset", F.lit(0))
    overlap = F.least(F.size("fa"), F.size("fb") + F.col("offset")) - first
    wrong = F.aggregate(
        F.zip_with(F.slice("fa", first + 1, F.greatest(overlap, F.lit(0))), F.slice("fb", first - F.col("offset") + 1, F.greatest(overlap, F.lit(0))), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))),
        F.lit(0),
        lambda s, x: s + x,
    )
    pairs = pairs.where(overlap >= MIN_OVERLAP).select("a", "b", "rep_a", "rep_b", "votes", F.col("offset").cast("long").alias("offset"), overlap.alias("overlap"), wrong.alias("wrong"))
    pairs = pairs.where(F.col("wrong") <= F.col("overlap") * 32 * MAX_BIT_ERRORS)
    best = F.max_by(F.struct("offset", "overlap", "wrong"), F.struct("votes", -F.abs("offset"), "offset"))
    pairs = pairs.groupBy("a", "b").agg(F.first("rep_a").alias("rep_a"), F.first("rep_b").alias("rep_b"), best.alias("best"))
    pairs = pairs.select(
        F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), F.col("a").alias("class_a"), F.col("b").alias("class_b"),
        "best.offset", F.col("best.overlap").cast("long").alias("overlap"), (F.col("best.wrong") / (F.col("best.overlap") * 32)).alias("bit_errors"),
    )
    pairs = scratch.table(pairs, "pairs")
    scratch.close(members, pairs)
    return members, pairs


def search(prints: DataFrame, id_col: str, is_query, fp_col: str = "fingerprint") -> DataFrame:
    """One row per query row: id_col, class_id, n_copies (other rows of its class), n_aligned (rows of other
    classes that align with it), best_id, best_offset and best_bit_errors of the best-aligned other class."""
    members, pairs = align(prints, id_col, is_query, fp_col)
    sizes = members.groupBy("class", "rep", "d", "d2").agg(F.count(F.lit(1)).alias("size"))
    found = (
        pairs.join(sizes.select(F.col("class").alias("class_b"), "size"), "class_b")
        .groupBy("class_a")
        .agg(F.sum("size").alias("n_aligned"), F.min(F.struct("bit_errors", "b", "offset")).alias("best"))
        .select(F.col("class_a").alias("class"), "n_aligned", "best")
    )
    known = sizes.join(found, "class", "left").select("d", "d2", "rep", "size", "n_aligned", "best")
    rows = _digests(prints, id_col, is_query, fp_col).where("q").select("id", "d", "d2")
    return rows.join(known, ["d", "d2"], "left").select(
        F.col("id").alias(id_col),
        F.col("rep").alias("class_id"),
        F.coalesce(F.col("size") - 1, F.lit(0)).cast("long").alias("n_copies"),
        F.coalesce("n_aligned", F.lit(0)).cast("long").alias("n_aligned"),
        F.col("best.b").alias("best_id"),
        F.col("best.offset").alias("best_offset"),
        F.col("best.bit_errors").alias("best_bit_errors"),
    )
