"""Secrets by fixed patterns and by character Markov models, in DataFrame operations only.

Three base kinds are found by regular expressions. A fourth, `random`, is found by the method: runs of
at least MIN_RUN key characters are scored by the log-likelihood ratio of two first-order Markov models
over characters, one trained on random strings, one on ordinary identifiers. The labelled samples are
`labelled_samples`: random strings made from digests (hexadecimal, base 62 and base 64), and the words of
all documents, each with its count; joined by "_", "-" or a capital letter they make identifiers. Words are
counted before they are shuffled, and only counts of pairs of characters reach the driver.

A run of MIN_RUN characters is the shortest that the models tell apart: README has the recall by length.

Spans are in code points, end exclusive. Base spans stay whatever the model says; runs that overlap a
base span add nothing. Positions come from one split and one extraction by the same expression: the
lengths of the pieces and of the matches between them add up to the offsets, in blocks of BLOCK matches, so
that time grows with the text and its matches and not with their product.

Defined results: a null text is an empty one and has no spans; an empty table trains on random strings
alone and finds nothing; repeated rows each get their own result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
RUN = "[A-Za-z0-9+/_-]"
MIN_RUN = 20
RANDOM_STRINGS = 6_000
BLOCK = 128  # matches of a block of offsets
PIECE = 64  # code points of a piece of text that a mask's surroundings are cut from
#: A run is random if its ratio exceeds this many nats for the run and this many for each character.
LIMIT, LIMIT_PER_CHAR = 10.0, 0.6


_FOUND = "array<struct<start:int,end:int,value:string>>"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f mentions it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(
    items: Column, zero: Column, weight: Callable[[Column], Column], combine: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str
) -> Column:
    """emit(before, item) for each item of an array, `before` being the combined weights of the items before it.
    Blocks of BLOCK items are gone through on their own, from the combined weights of the blocks before."""

    def within(block: Column, start: Column) -> Column:
        def step(acc: Column, item: Column) -> Column:
            return F.struct(combine(acc["at"], weight(item)).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], item))).alias("out"))

        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])

    def in_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, item: combine(acc, weight(item))))
        before = F.aggregate(
            totals,
            F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, t: F.struct(combine(acc["at"], t).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )
        return F.flatten(F.zip_with(blocks, before, within))

    def cut(all_: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        return F.transform(firsts, lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))

    return F.when(F.size(items) > 0, _let(_let(items, cut), in_blocks)).otherwise(F.array().cast(kind))


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches of a pattern that never
    matches the empty string."""
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda piece, match: F.struct(F.length(piece).alias("gap"), F.length(match).alias("size"), match.alias("value")),
    )

    def span(at: Column, part: Column) -> Column:
        start = at + part["gap"]
        return F.struct(start.alias("start"), (start + part["size"]).alias("end"), part["value"].alias("value"))

    found = _let(
        F.filter(parts, lambda p: p["value"].isNotNull()), lambda ps: _running(ps, F.lit(0), lambda p: p["gap"] + p["size"], lambda x, y: x + y, span, _FOUND)
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_FOUND))


def _as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the base kinds, sorted; kind is an index into KINDS."""
    whole = find_all(text, ASSIGN)
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    pairs = F.zip_with(whole, values, lambda m, v: F.struct(m["start"].alias("start"), m["end"].alias("end"), v.alias("value")))
    long = F.when(text.rlike(ASSIGN), F.filter(pairs, lambda m: F.length(m["value"]) >= 8)).otherwise(F.array().cast(_FOUND))
    # runs are maximal, so a least length in the pattern itself drops the same matches
    access = find_all(text, "AKIA[A-Z0-9]{12,}")
    hexa = find_all(text, "[0-9a-f]{32,}")
    return F.array_sort(F.concat(_as_spans(long, 0), _as_spans(access, 1), _as_spans(hexa, 2)))


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(s, random, n): labelled strings over ALPHABET to train the models on, and how often each occurs. The
    ordinary ones are the words of all documents, between blanks that stand for a joint with another word;
    words of MIN_RUN characters or more that hold a digit are left out, as they may be secrets themselves."""
    spark: SparkSession = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"), 256)
    b64 = F.base64(F.unhex(digest))
    size = F.pmod(F.col("id"), F.lit(24)).cast("int") + MIN_RUN
    kinds = F.array(
        digest.substr(F.lit(1), size),
        F.translate(b64, "+/=", "").substr(F.lit(1), size),
        F.upper(F.translate(b64, "+/=", "")).substr(F.lit(1), size),
        F.translate(b64, "=", "").substr(F.lit(1), size),
    )
    made = spark.range(RANDOM_STRINGS).select(F.get(kinds, F.pmod(F.col("id"), F.lit(4)).cast("int")).alias("s"), F.lit(True).alias("random"), F.lit(1).cast("long").alias("n"))
    texts = docs.select(F.col(f"`{text_col}`").alias("t")).where("t is not null")
    words = texts.select(F.explode(F.regexp_extract_all("t", F.lit(f"{RUN}{{2,}}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    # what may be a secret itself teaches nothing about ordinary words
    words = words.where(~((F.length("w") >= MIN_RUN) & F.col("w").rlike("[0-9]")) & ~F.col("w").rlike(ACCESS))
    return made.unionAll(words.select(F.concat(F.lit(" "), "w", F.lit(" ")).alias("s"), F.lit(False).alias("random"), "n"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random against ordinary) of each pair of characters, row by row over ALPHABET.

    The counts of pairs are summed by Spark; what comes to the driver is one row for each label and pair of
    ALPHABET and the blank, 2 * (len(ALPHABET) + 1) ** 2 at most, whatever the samples' size. A word that can
    follow another does so as an identifier's part: behind "_", behind "-", or with a capital letter.
    """
    # long strings in pieces, each with the first character of the next
    pieces = samples.select("random", "n", F.regexp_extract_all("s", F.lit("(?s).{1,500}"), F.lit(0)).alias("p"))
    pieces = pieces.select("random", "n", F.explode(F.transform("p", lambda x, i: F.concat(x, F.coalesce(F.substring(F.get("p", i + 1), 1, 1), F.lit(""))))).alias("s"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2))))
    one = f"[ {RUN[1:]}"
    counts = pieces.where(F.length("s") >= 2).select("random", "n", pair.alias("p")).where(F.col("p").rlike(f"^{one}{one}$"))
    n = len(ALPHABET)
    table = {True: [[0.5] * n for _ in range(n)], False: [[0.5] * n for _ in range(n)]}
    place = {c: i for i, c in enumerate(ALPHABET)}
    first, last = {}, {}
    for r in counts.groupBy("random", "p").agg(F.sum("n").alias("n")).collect():
        a, b = r["p"]
        if a == " ":
            first[b] = r["n"]
        elif b == " ":
            last[a] = r["n"]
        else:
            table[r["random"]][place[a]][place[b]] += r["n"]
    words = sum(first.values())
    for joint in "_-":
        for c, k in first.items():
            table[False][place[joint]][place[c]] += k
        for c, k in last.items():
            table[False][place[c]][place[joint]] += k
    for a, k in last.items():
        for b, m in first.items():
            table[False][place[a]][place[b.upper()]] += k * m / words
    sums = {k: [sum(row) for row in t] for k, t in table.items()}
    return [math.log(table[True][i][j] / sums[True][i]) - math.log(table[False][i][j] / sums[False][i]) for i in range(n) for j in range(n)]


def ratio(run: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a run of ALPHABET characters."""
    weights = F.split(F.lit(",".join(f"{w:.6f}" for w in model)), ",").cast("array<double>")
    codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    n = len(ALPHABET)
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        codes,
        start,
        lambda acc, c: F.struct(
            c.alias("before"), (acc["sum"] + F.when(acc["before"] < 0, 0.0).otherwise(F.get(weights, acc["before"] * n + c))).alias("sum")
        ),
        lambda acc: acc["sum"],
    )


def random_spans(text: Column, base: Column, model: list[float]) -> Column:
    runs = find_all(text, f"{RUN}{{{MIN_RUN},}}")
    free = F.filter(runs, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))

    def is_random(m: Column) -> Column:
        r = ratio(m["value"], model)
        return (r >= LIMIT) & (r >= LIMIT_PER_CHAR * F.length(m["value"]))

    return _as_spans(F.filter(free, is_random), 3)


def scan(docs: DataFrame, model: list[float], text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """The documents with out_col: array<struct<start, kind, end>>, sorted by start, then kind."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    cols = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out_col.lower()]
    base = docs.select(*cols, base_spans(text).alias(out_col))
    return base.withColumn(out_col, F.array_sort(F.concat(F.col(out_col), random_spans(text, F.col(out_col), model))))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float], text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with their own columns, every span of text_col replaced by the mask; nulls stay."""
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    text = next(k for k, c in names.items() if c == text_col)
    found = scan(docs.toDF(*names), model, text, "spans")
    spans = F.col("spans")
    # what stands before each span and behind those before it; null inside a mask
    kept = _running(
        spans,
        F.lit(0),
        lambda s: s["end"],
        lambda x, y: F.greatest(x, y),
        lambda at, s: F.struct(at.alias("from"), F.when(s["start"] >= at, s["start"]).alias("to")),  # an overlapping span only lengthens the mask before it
        "array<struct<from:int,to:int>>",
    )

    def piece(parts: Column, a: Column, b: Column) -> Column:
        """The code points a to b of the text, from its parts of PIECE code points."""
        lo = F.floor(a / PIECE).cast("int")
        inner = F.array_join(F.slice(parts, lo + 1, F.floor((b - 1) / PIECE).cast("int") - lo + 1), "")
        return F.when(b > a, F.substring(inner, a - lo * PIECE + 1, b - a)).otherwise("")

    end = F.aggregate(spans, F.lit(0), lambda acc, s: F.greatest(acc, s["end"]))
    done = _let(
        F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)),
        lambda parts: F.concat(
            F.array_join(F.transform(F.filter(kept, lambda k: k["to"].isNotNull()), lambda k: F.concat(piece(parts, k["from"], k["to"]), F.lit(mask))), ""),
            piece(parts, end, F.length(text)),
        ),
    )
    safe = F.when(F.size("spans") > 0, done).otherwise(F.col(text))
    return found.select(*[(safe if k == text else F.col(k)).alias(c) for k, c in names.items()])
