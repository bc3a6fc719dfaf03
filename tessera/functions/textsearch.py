"""Text-search vectors and queries.

A vector is MAP<lexeme, ARRAY<STRUCT<pos INT, weight STRING>>>; a query is its text, compiled on the
driver to a column expression, so matching runs in Catalyst.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

VECTOR = "map<string,array<struct<pos:int,weight:string>>>"
TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*'|[^\s()&|!<:']+)(?::([A-Da-d*]+))?|(<(?:-|\d+)>)|([()&|!]))")


def vector(text: str) -> Column:
    """A literal such as 'fat:2A cat:3'."""
    found: dict[str, set] = {}
    for m in re.finditer(r"('(?:[^']|'')*'|[^\s:']+)(?::([\dA-Da-d,]+))?", text):
        word = m[1][1:-1].replace("''", "'") if m[1].startswith("'") else m[1]
        marks = found.setdefault(word, set())
        for p in (m[2] or "").split(","):
            if p:
                marks.add((int(re.sub(r"\D", "", p)), (re.sub(r"\d", "", p) or "D").upper()))
    entries = []
    for w in sorted(found, key=lambda w: (len(w.encode()), w)):
        marks = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(k).alias("weight")) for p, k in sorted(found[w])]).cast("array<struct<pos:int,weight:string>>")
        entries += [F.lit(w), marks]
    return F.create_map(*entries).cast(VECTOR) if entries else F.create_map().cast(VECTOR)


def from_array(words: Column) -> Column:
    distinct = F.array_sort(F.array_distinct(words))
    return F.map_from_arrays(distinct, F.transform(distinct, lambda w: F.array().cast("array<struct<pos:int,weight:string>>")))


def to_array(v: Column) -> Column:
    return F.array_sort(F.map_keys(v))


def strip(v: Column) -> Column:
    return F.transform_values(v, lambda k, m: F.slice(m, 1, 0))


def length(v: Column) -> Column:
    return F.size(v)


def set_weight(v: Column, weight: str, only: list[str] | None = None) -> Column:
    marked = lambda m: F.transform(m, lambda x: F.struct(x["pos"].alias("pos"), F.lit(weight.upper()).alias("weight")))
    return F.transform_values(v, lambda k, m: F.when(k.isin(only), marked(m)).otherwise(m) if only is not None else marked(m))


def delete(v: Column, *words: str) -> Column:
    return F.map_filter(v, lambda k, m: ~k.isin(list(words)))


def keep_weights(v: Column, weights: list[str]) -> Column:
    only = F.transform_values(v, lambda k, m: F.filter(m, lambda x: x["weight"].isin([w.upper() for w in weights])))
    return F.map_filter(only, lambda k, m: F.size(m) > 0)


def concat(a: Column, b: Column) -> Column:
    """Positions of b move behind the last one of a."""
    last = F.coalesce(F.array_max(F.flatten(F.transform(F.map_values(a), lambda m: F.transform(m, lambda x: x["pos"])))), F.lit(0))
    moved = F.transform_values(b, lambda k, m: F.transform(m, lambda x: F.struct((x["pos"] + last).alias("pos"), x["weight"].alias("weight"))))
    none = F.array().cast("array<struct<pos:int,weight:string>>")
    return F.map_zip_with(a, moved, lambda k, x, y: F.array_sort(F.concat(F.coalesce(x, none), F.coalesce(y, none))))


def parse_query(text: str):
    """Nested tuples: ("word", lexeme, weights, prefix), ("not", q), ("and" | "or", a, b), ("phrase", n, a, b)."""
    toks, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f'syntax error in tsquery: "{text}"')
        toks.append(m.groups())
        at = m.end()
    pos = 0

    def op(*want):
        nonlocal pos
        if pos < len(toks) and (toks[pos][3] in want or (toks[pos][2] and "<" in want)):
            pos += 1
            return toks[pos - 1]
        return None

    def either():
        q = both()
        while op("|"):
            q = ("or", q, both())
        return q

    def both():
        q = phrase()
        while op("&"):
            q = ("and", q, phrase())
        return q

    def phrase():
        q = unary()
        while t := op("<"):
            q = ("phrase", 1 if t[2] == "<->" else int(t[2][1:-1]), q, unary())
        return q

    def unary():
        nonlocal pos
        if op("!"):
            return ("not", unary())
        if op("("):
            q = either()
            if not op(")"):
                raise ValueError(f'syntax error in tsquery: "{text}"')
            return q
        if pos >= len(toks) or toks[pos][0] is None:
            raise ValueError(f'syntax error in tsquery: "{text}"')
        word, marks = toks[pos][0], toks[pos][1] or ""
        pos += 1
        word = word[1:-1].replace("''", "'") if word.startswith("'") else word
        return ("word", word, "".join(sorted(marks.upper().replace("*", ""))), "*" in marks)

    if not toks:
        return None
    q = either()
    if pos != len(toks):
        raise ValueError(f'syntax error in tsquery: "{text}"')
    return q


def _positions(v: Column, q) -> Column:
    """Positions at which a query's last word stands, for phrases."""
    if q[0] == "word":
        if q[3]:
            hit = F.flatten(F.map_values(F.map_filter(v, lambda k, m: F.startswith(k, F.lit(q[1])))))
        else:
            hit = F.coalesce(F.element_at(v, F.lit(q[1])), F.array().cast("array<struct<pos:int,weight:string>>"))
        if q[2]:
            hit = F.filter(hit, lambda x: x["weight"].isin(list(q[2])))
        return F.transform(hit, lambda x: x["pos"])
    if q[0] == "phrase":
        before = _positions(v, q[2])
        return F.filter(_positions(v, q[3]), lambda p: F.array_contains(before, p - q[1]))
    if q[0] == "or":
        return F.array_union(_positions(v, q[1]), _positions(v, q[2]))
    if q[0] == "and":
        return F.array_intersect(_positions(v, q[1]), _positions(v, q[2]))
    raise ValueError("a negated phrase operand is not supported")


def matches(v: Column, query: str) -> Column:
    """vector @@ query."""

    def test(q) -> Column:
        if q[0] == "not":
            return ~test(q[1])
        if q[0] == "and":
            return test(q[1]) & test(q[2])
        if q[0] == "or":
            return test(q[1]) | test(q[2])
        if q[0] == "phrase" or (q[0] == "word" and q[2]):
            return F.size(_positions(v, q)) > 0
        if q[3]:
            return F.exists(F.map_keys(v), lambda k: F.startswith(k, F.lit(q[1])))
        return F.map_contains_key(v, F.lit(q[1]))

    q = parse_query(query)
    return F.lit(False) if q is None else test(q)


def show(q, level: int = 0) -> str:
    """A query's text."""
    if q is None:
        return ""
    if q[0] == "word":
        marks = ("*" if q[3] else "") + q[2]
        return "'" + q[1].replace("'", "''") + "'" + (":" + marks if marks else "")
    if q[0] == "not":
        return "!" + (show(q[1], 4) if q[1][0] in ("word", "not") else "( " + show(q[1]) + " )")
    rank, sign = {"or": (1, "|"), "and": (2, "&"), "phrase": (3, "<->")}[q[0]]
    if q[0] == "phrase":
        sign, q = (sign if q[1] == 1 else f"<{q[1]}>"), ("phrase", q[2], q[3])
    out = f"{show(q[1], rank)} {sign} {show(q[2], rank + (q[0] == 'phrase'))}"
    return f"( {out} )" if level > rank else out


def n_nodes(query: str) -> int:
    def count(q):
        return 0 if q is None else 1 + sum(count(x) for x in q if isinstance(x, tuple))

    return count(parse_query(query))


def phrase(a: str, b: str, distance: int = 1) -> str:
    return show(("phrase", distance, parse_query(a), parse_query(b)))


def conjunction(a: str, b: str) -> str:
    return show(("and", parse_query(a), parse_query(b)))


def disjunction(a: str, b: str) -> str:
    return show(("or", parse_query(a), parse_query(b)))


def negation(a: str) -> str:
    return show(("not", parse_query(a)))


def query_tree(query: str) -> str:
    """The part of a query that an index could use: negations drop out; T if nothing is left."""

    def clean(q):
        if q is None or q[0] == "not":
            return None
        if q[0] == "word":
            return q
        a, b = clean(q[-2]), clean(q[-1])
        if q[0] == "or":
            return None if a is None or b is None else ("or", a, b)
        if a is None or b is None:
            return a or b
        return (*q[:-2], a, b)

    q = parse_query(query)
    return show(clean(q)) or ("T" if q else "")
