"""Joins whose pairs are more than the rows that decide about them, and rows that cost more than their bytes."""

from __future__ import annotations

#: Types whose order is that of their comparison, and which a union leaves as they are.
ORDERED = {"tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz", "string"}


def _plain(e) -> bool:
    """Columns, constants and their arithmetic: one value for each row, however often it is asked for."""
    if e[0] == "op":
        return e[1] in ("+", "-", "*", "/", "%") and _plain(e[2]) and _plain(e[3])
    return e[0] in ("col", "num")


def _is_count(item) -> bool:
    e = item[0]
    return e[0] == "call" and e[1] == "count" and e[3] == {"star": True}


def _of_two(b: dict):
    """(left, right, condition) of an inner join of two tables or subqueries, or None."""
    sources, where = b["from"], b["where"]
    if len(sources) == 1 and sources[0][0] == "join" and sources[0][1] in ("inner", "cross"):
        _, _, left, right, on = sources[0]
        if on and (on[0] != "on" or where):
            return None
        sources, where = [left, right], on[1] if on else where
    if len(sources) != 2 or not where or any(s[0] not in ("table", "sub") or (s[0] == "sub" and s[4]) for s in sources):
        return None
    return *sources, where


def count_by_order(em, b: dict, outer, with_text: str) -> str | None:
    """count(*) of a join by one inequality, without its pairs: each value once with its rows on either side, dealt out
    by ranges; a running count within each range and one over the ranges' totals."""
    if outer or not b["items"] or not all(map(_is_count, b["items"])) or any(b[k] for k in ("distinct", "group", "having", "on", "windows")) or not (found := _of_two(b)):
        return None
    left, right, test = found
    if test[0] != "op" or test[1] not in ("<", "<=", ">", ">=") or not (_plain(test[2]) and _plain(test[3])):
        return None
    from .dialect import Scope, ident

    sides = [Scope(with_text, em.source(s, None, with_text), None) for s in (left, right)]
    first, second = (em.expr(e, None) for e in test[2:])
    a, c = ([em.type_of(x, s) for s in sides] for x in (first, second))
    op = test[1]
    if a[0] == "unknown" and c[1] == "unknown":
        first, second, a, c, op = second, first, c, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[op]
    if a[1] != "unknown" or c[0] != "unknown" or a[0] != c[1] or a[0] not in ORDERED:
        return None
    # how many left rows lie before each right row, or after it
    order, end = "ASC" if op in ("<", "<=") else "DESC", "CURRENT ROW" if "=" in op else "1 PRECEDING"
    rows = f"SELECT {first} AS v, 1L AS a, 0L AS b FROM {sides[0].from_text} UNION ALL SELECT {second}, 0L, 1L FROM {sides[1].from_text}"
    values = f"SELECT v, sum(a) AS a, sum(b) AS b FROM ({rows}) WHERE v IS NOT NULL GROUP BY v"
    ranges = f"SELECT spark_partition_id() AS p, v, a, b FROM (SELECT /*+ REPARTITION_BY_RANGE(v) */ v, a, b FROM ({values}))"
    within = f"SELECT p, a, b, b * coalesce(sum(a) OVER (PARTITION BY p ORDER BY v {order} ROWS BETWEEN UNBOUNDED PRECEDING AND {end}), 0L) AS n FROM ({ranges})"
    totals = f"SELECT p, sum(a) AS a, sum(b) AS b, sum(n) AS n FROM ({within}) GROUP BY p"
    n = f"SELECT n + b * coalesce(sum(a) OVER (ORDER BY p {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS n FROM ({totals})"
    return f"SELECT {', '.join(f'coalesce(sum(n), 0L) AS {ident(name or em.default_name(e))}' for e, name in b['items'])} FROM ({n})"


def _rowwise(e, em) -> bool:
    """Whether an expression is one row's own: no aggregate, window, set or subquery."""
    from . import calls

    if isinstance(e, dict):
        return "kind" not in e and all(_rowwise(x, em) for x in e.values())
    if isinstance(e, (tuple, list)):
        if len(e) == 4 and e[0] == "call" and (e[1] in calls.AGGREGATES or e[1] in em.SRF or e[3] or e[1] in ("nextval", "random", "gen_random_uuid")):
            return False
        return all(_rowwise(x, em) for x in e)
    return True


#: Spark makes no part of a file smaller than this (spark.sql.files.openCostInBytes), so smaller tables keep few cores busy.
LEAST_PART = 4 << 20


def dealt_out(em, b: dict, from_text: str, with_text: str, items: str) -> str:
    """The FROM clause of one table, its rows dealt out over the cores where Python or functions over arrays work on
    each and the table is too small to be read in as many parts."""
    if len(b["from"]) != 1 or b["from"][0][0] != "table" or not ("tessera_" in items or " -> " in items):
        return from_text
    from ..operators.relational import estimated_bytes
    from .dialect import ident

    n = _parts(em)
    size = estimated_bytes(em.spark.sql(f"{with_text} SELECT * FROM {from_text}"))
    if n < 2 or size >= n * LEAST_PART:
        return from_text
    return f"(SELECT /*+ REPARTITION({n}) */ * FROM {from_text}) AS {ident(b['from'][0][2] or b['from'][0][1])}"


def _parts(em) -> int:
    return min(em.spark._jsparkSession.sessionState().conf().numShufflePartitions(), 4 * em.spark.sparkContext.defaultParallelism)


def full(em, b: dict, outer, with_text: str) -> str | None:
    """A full join as an outer join, whose rows stream however many a key has, and the other side's rows without a
    partner. Spark's own full join holds all pairs of a key in memory (or runs one thread a key). The larger side
    is dealt out anew where the smaller one can be broadcast."""
    sources = b["from"]
    if outer or len(sources) != 1 or sources[0][0] != "join" or sources[0][1] != "full" or any(b[k] for k in ("distinct", "group", "having", "on", "windows")):
        return None
    _, _, left, right, on = sources[0]
    if not on or on[0] != "on" or any(s[0] not in ("table", "sub") or (s[0] == "sub" and (s[4] or not s[2])) for s in (left, right)):
        return None
    if any(e[0] == "star" for e, _ in b["items"]) or not _rowwise([e for e, _ in b["items"]], em) or not (_rowwise(on[1], em) and _rowwise(b["where"], em)):
        return None
    from ..operators.relational import estimated_bytes
    from .dialect import Scope, ident

    texts = [em.source(s, None, with_text) for s in (left, right)]
    names = [ident(s[2] or s[1]) for s in (left, right)]
    scope = Scope(with_text, f"{texts[0]} CROSS JOIN {texts[1]}", None)
    test, where = em.expr(on[1], scope), em.expr(b["where"], scope) if b["where"] else None
    items = ", ".join(f"{em.expr(e, scope, top=True)} AS {ident(alias or em.default_name(e))}" for e, alias in b["items"])
    sizes = [estimated_bytes(em.spark.sql(f"{with_text} SELECT * FROM {t}")) for t in texts]
    kept = 0 if sizes[0] >= sizes[1] else 1
    conf = em.spark._jsparkSession.sessionState().conf()
    sides = list(texts)
    if sizes[1 - kept] <= conf.autoBroadcastJoinThreshold():
        sides[kept] = f"(SELECT /*+ REPARTITION({_parts(em)}) */ * FROM {texts[kept]}) AS {names[kept]}"
    none = [f"(SELECT * FROM {t} WHERE FALSE) AS {n}" for t, n in zip(texts, names, strict=True)]
    word, back = ("LEFT", "RIGHT") if kept == 0 else ("RIGHT", "LEFT")
    alone = f"{none[0]} {back} JOIN {texts[1]} ON TRUE" if kept == 0 else f"{texts[0]} {back} JOIN {none[1]} ON TRUE"
    also = f" AND ({where})" if where else ""
    pairs = f"SELECT {items} FROM {sides[0]} {word} JOIN {sides[1]} ON {test}" + (f" WHERE {where}" if where else "")
    return f"{pairs} UNION ALL SELECT {items} FROM {alone} WHERE NOT EXISTS (SELECT 1 FROM {texts[kept]} WHERE {test}){also}"
