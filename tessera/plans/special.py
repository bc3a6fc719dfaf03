"""Types that Spark lacks, in SQL text: literals, casts, operators, functions and output forms.

Values are structs whose fields tell the type (functions.values.SHAPES), so Catalyst itself carries the types
through subqueries and tables. What an operator does is said by the type libraries; this module only says which
of their functions an operator or a name stands for.
"""

from __future__ import annotations

import re
from decimal import Decimal

from ..functions import textsearch, values
from .parser import SqlError
from .texts import Text, library, quoted

GEOMETRY = ("point", "lseg", "box", "line", "circle", "path", "polygon")
_KINDS = {v.replace(" ", ""): k for k, v in values.SHAPES.items()}


def kind_of(spark_type: str) -> str | None:
    return _KINDS.get(spark_type.lower().replace(" ", ""))


# literals and casts
def _value(v) -> str:
    if isinstance(v, dict):
        return "named_struct(" + ", ".join(f"'{k}', {_value(x)}" for k, x in v.items()) + ")"
    if isinstance(v, list):
        return f"array({', '.join(map(_value, v))})"
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, Decimal):
        return f"CAST('{v}' AS DECIMAL(20,0))"
    return quoted(v) if isinstance(v, str) else str(v)


def literal(kind: str, text: str) -> str:
    if kind == "tsvector":
        return library("textsearch").vector(text).sql
    try:
        v = values.parse(kind, text)
    except ValueError as e:
        raise SqlError(str(e), "22P02") from None
    if kind == "interval":
        return _interval(v["months"], v["days"], f"{v['micros']}L")
    return f"CAST({_value(v)} AS {values.SHAPES[kind]})"


def _interval(months, days, micros) -> str:
    return f"CAST(named_struct('months', {months}, 'days', {days}, 'micros', {micros}) AS {values.SHAPES['interval']})"


def cast(kind: str, a: str, source: str, have: str | None) -> str:
    """a, of the Spark type `source` and perhaps a type of ours, as `kind`."""
    if have == kind:
        return a
    geo, iv = library("geo"), library("interval")
    x = Text(a)
    pairs = {
        ("box", "point"): lambda: geo.box_center(x), ("lseg", "point"): lambda: geo.lseg_center(x), ("circle", "point"): lambda: x["center"], ("polygon", "point"): lambda: geo.polygon_center(x),
        ("point", "box"): lambda: geo.box(x), ("circle", "box"): lambda: geo.circle_box(x), ("polygon", "box"): lambda: geo.polygon_box(x),
        ("box", "circle"): lambda: geo.box_circle(x), ("polygon", "circle"): lambda: geo.polygon_circle(x),
        ("box", "polygon"): lambda: geo.box_polygon(x), ("circle", "polygon"): lambda: geo.circle_polygon(x), ("path", "polygon"): lambda: geo.polygon(x["points"]),
        ("polygon", "path"): lambda: geo.path(x["points"]), ("box", "lseg"): lambda: geo.box_diagonal(x),
        ("cidr", "inet"): lambda: Text(f"named_struct('inet', tessera_inet('plain', {a}.cidr))"), ("inet", "cidr"): lambda: Text(f"named_struct('cidr', tessera_inet('network', {a}.inet))"),
        ("interval", "time"): lambda: Text(f"named_struct('time', pmod({a}.micros, 86400000000))"), ("time", "interval"): lambda: Text(_interval(0, 0, f"{a}.time")),
        ("macaddr", "macaddr8"): lambda: Text(f"named_struct('mac8', CAST(CAST({a}.mac div 16777216 AS DECIMAL(20,0)) * 1099511627776 + 1099478073344 + {a}.mac % 16777216 AS DECIMAL(20,0)))"),
    }
    if (have, kind) in pairs:
        return pairs[have, kind]().sql
    if kind == "money" and source.startswith(("int", "bigint", "decimal", "double", "smallint")):
        return f"named_struct('cents', CAST(round({a} * 100) AS BIGINT))"
    if kind == "time" and source.startswith("timestamp"):
        return f"named_struct('time', unix_micros(CAST({a} AS TIMESTAMP_LTZ)) - unix_micros(CAST(date_trunc('day', {a}) AS TIMESTAMP_LTZ)))"
    if kind == "interval" and source.startswith("interval"):
        return native_interval(a, source)
    if kind == "tsvector":
        raise SqlError("tsvector needs a literal", "0A000")
    if source in ("string", "void"):
        return _coerced(kind, a)
    raise SqlError(f"cannot cast type {have or source} to {kind}", "42846")


def native_interval(a: str, source: str) -> str:
    """A Spark interval as ours."""
    if "month" in source or "year" in source:
        return _interval(f"CAST(extract(YEAR FROM {a}) * 12 + extract(MONTH FROM {a}) AS INT)", 0, "0L")
    clock = f"extract(HOUR FROM {a}) * 3600000000 + extract(MINUTE FROM {a}) * 60000000 + CAST(extract(SECOND FROM {a}) * 1000000 AS BIGINT)"
    return _interval(0, f"CAST(extract(DAY FROM {a}) AS INT)", f"CAST({clock} AS BIGINT)")


# output
def _num(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) AND abs({x}) < 1E15D THEN CAST(CAST({x} AS BIGINT) AS STRING) ELSE CAST({x} AS STRING) END"


def _point(p: str) -> str:
    return f"concat('(', {_num(p + '.x')}, ',', {_num(p + '.y')}, ')')"


def show(kind: str, a: str) -> str:
    """The output form."""
    ring = f"array_join(transform({a}.points, _p -> {_point('_p')}), ',')"
    clock = f"{a}.time"
    text = {
        "point": lambda: _point(a),
        "lseg": lambda: f"concat('[', {_point(a + '.a')}, ',', {_point(a + '.b')}, ']')",
        "box": lambda: f"concat({_point(a + '.high')}, ',', {_point(a + '.low')})",
        "line": lambda: f"concat('{{', {_num(a + '.a')}, ',', {_num(a + '.b')}, ',', {_num(a + '.c')}, '}}')",
        "circle": lambda: f"concat('<', {_point(a + '.center')}, ',', {_num(a + '.radius')}, '>')",
        "path": lambda: f"concat(CASE WHEN {a}.closed THEN '(' ELSE '[' END, {ring}, CASE WHEN {a}.closed THEN ')' ELSE ']' END)",
        "polygon": lambda: f"concat('(', {ring}, ')')",
        "interval": lambda: library("interval").text(Text(a)).sql,
        "time": lambda: f"concat(lpad({clock} div 3600000000, 2, '0'), ':', lpad({clock} div 60000000 % 60, 2, '0'), ':', lpad({clock} div 1000000 % 60, 2, '0'), CASE WHEN {clock} % 1000000 = 0 THEN '' ELSE rtrim('0', concat('.', lpad({clock} % 1000000, 6, '0'))) END)",
        "money": lambda: f"concat(CASE WHEN {a}.cents < 0 THEN '-' ELSE '' END, '$', format_number(CAST(abs({a}.cents) AS DECIMAL(20,0)) / 100, 2))",
        "inet": lambda: f"{a}.inet",
        "cidr": lambda: f"{a}.cidr",
        "macaddr": lambda: f"regexp_replace(lpad(lower(hex({a}.mac)), 12, '0'), '(..)(?!$)', '$1:')",
        "macaddr8": lambda: f"regexp_replace(lpad(lower(conv(CAST({a}.mac8 AS STRING), 10, 16)), 16, '0'), '(..)(?!$)', '$1:')",
        "pg_lsn": lambda: f"concat(conv(CAST(CAST(floor({a}.lsn / 4294967296) AS BIGINT) AS STRING), 10, 16), '/', conv(CAST(CAST({a}.lsn % 4294967296 AS BIGINT) AS STRING), 10, 16))",
        "tsvector": lambda: f"array_join(transform(array_sort(map_keys({a})), _k -> concat('\\'', _k, '\\'', CASE WHEN size(element_at({a}, _k)) > 0 THEN concat(':', array_join(transform(element_at({a}, _k), _m -> concat(CAST(_m.pos AS STRING), CASE WHEN _m.weight = 'D' THEN '' ELSE _m.weight END)), ',')) ELSE '' END)), ' ')",
        "tsquery": lambda: f"{a}.tsquery",
    }[kind]()
    return f"CASE WHEN {a} IS NOT NULL THEN {text} END"


# operators
def _flip(f):
    return lambda x, y: f(y, x)


def _geometry() -> dict:
    g = library("geo")
    edge = lambda f, u, v: (lambda x, y: f(u(x), v(y)))
    ops: dict = {
        ("+", "point", "point"): g.point_add, ("-", "point", "point"): g.point_sub, ("*", "point", "point"): g.point_mul, ("/", "point", "point"): g.point_div,
        ("<->", "point", "point"): g.point_distance, ("~=", "point", "point"): g.point_same, ("=", "point", "point"): g.point_same,
        ("<<", "point", "point"): g.left_of, (">>", "point", "point"): g.right_of, ("<^", "point", "point"): g.below, (">^", "point", "point"): g.above, ("<<|", "point", "point"): g.below, ("|>>", "point", "point"): g.above,
        ("?-", "point", "point"): g.horizontal, ("?|", "point", "point"): g.vertical,
        ("<->", "point", "lseg"): g.point_lseg_distance, ("<@", "point", "lseg"): g.point_on_lseg, ("##", "point", "lseg"): g.closest_on_lseg,
        ("<->", "lseg", "lseg"): g.lseg_distance, ("?||", "lseg", "lseg"): g.lseg_parallel, ("?-|", "lseg", "lseg"): g.lseg_perpendicular, ("#", "lseg", "lseg"): g.lseg_intersection, ("?#", "lseg", "lseg"): g.lseg_intersects,
        ("=", "lseg", "lseg"): g.lseg_same, ("##", "lseg", "lseg"): g.closest_on_other_lseg,
        ("<->", "line", "line"): g.line_distance, ("<->", "point", "line"): g.point_line_distance, ("##", "point", "line"): g.closest_on_line, ("<@", "point", "line"): g.point_on_line, ("=", "line", "line"): g.line_same,
        ("?||", "line", "line"): g.line_parallel, ("?-|", "line", "line"): g.line_perpendicular, ("#", "line", "line"): g.line_intersection, ("?#", "line", "line"): g.line_intersects,
        ("<@", "lseg", "line"): g.lseg_on_line, ("?#", "lseg", "line"): g.lseg_crosses_line, ("<->", "lseg", "line"): g.lseg_line_distance, ("##", "line", "lseg"): _flip(g.closest_on_lseg_to_line), ("?#", "line", "box"): _flip(g.box_meets_line),
        ("&&", "box", "box"): g.box_overlaps, ("#", "box", "box"): g.box_intersection, ("@>", "box", "box"): g.box_contains, ("@>", "box", "point"): g.box_contains_point, ("~=", "box", "box"): g.box_same, ("?#", "box", "box"): g.box_overlaps,
        ("<<", "box", "box"): g.box_left, (">>", "box", "box"): g.box_right, ("&<", "box", "box"): g.box_over_left, ("&>", "box", "box"): g.box_over_right, ("<<|", "box", "box"): g.box_below, ("|>>", "box", "box"): g.box_above,
        ("&<|", "box", "box"): g.box_over_below, ("|&>", "box", "box"): g.box_over_above, ("<^", "box", "box"): g.box_below_eq, (">^", "box", "box"): g.box_above_eq,
        ("<->", "box", "box"): g.box_distance, ("<->", "point", "box"): g.point_box_distance, ("##", "point", "box"): g.closest_on_box, ("+", "box", "point"): g.box_shift, ("-", "box", "point"): lambda b, p: g.box_shift(b, p, -1),
        ("*", "box", "point"): g.box_scale, ("/", "box", "point"): lambda b, p: g.box_scale(b, g.point_div(g.point(1, 0), p)),
        ("<@", "lseg", "box"): g.lseg_in_box, ("?#", "lseg", "box"): g.lseg_meets_box, ("<->", "lseg", "box"): g.lseg_box_distance, ("##", "lseg", "box"): g.closest_on_box_to_lseg,
        ("<->", "circle", "circle"): g.circle_distance, ("&&", "circle", "circle"): g.circle_overlaps, ("@>", "circle", "circle"): g.circle_contains, ("@>", "circle", "point"): g.circle_contains_point, ("~=", "circle", "circle"): g.circle_same,
        ("<->", "point", "circle"): g.point_circle_distance, ("+", "circle", "point"): g.circle_shift, ("-", "circle", "point"): lambda c, p: g.circle_shift(c, p, -1), ("*", "circle", "point"): g.circle_scale,
        ("/", "circle", "point"): lambda c, p: g.circle_scale(c, g.point_div(g.point(1, 0), p)),
        ("+", "path", "path"): g.path_concat, ("+", "path", "point"): g.path_shift, ("-", "path", "point"): lambda p, x: g.path_shift(p, x, -1), ("*", "path", "point"): g.path_scale, ("/", "path", "point"): lambda p, x: g.path_scale(p, g.point_div(g.point(1, 0), x)),
        ("<->", "path", "path"): g.path_distance, ("<->", "point", "path"): lambda x, p: g.path_point_distance(p, x), ("<@", "point", "path"): lambda x, p: g.path_contains_point(p, x), ("?#", "path", "path"): g.path_intersects,
        ("~=", "polygon", "polygon"): g.polygon_same, ("&&", "polygon", "polygon"): g.polygon_overlaps, ("@>", "polygon", "polygon"): g.polygon_contains, ("@>", "polygon", "point"): g.polygon_contains_point,
        ("<->", "polygon", "polygon"): g.polygon_distance, ("<->", "polygon", "point"): g.polygon_point_distance, ("<->", "circle", "polygon"): g.circle_polygon_distance,
    }
    # circles and polygons lie as their boxes do, circles by their true sides
    for name, f in (("<<", g.box_left), (">>", g.box_right), ("&<", g.box_over_left), ("&>", g.box_over_right), ("<<|", g.box_below), ("|>>", g.box_above), ("&<|", g.box_over_below), ("|&>", g.box_over_above)):
        ops[name, "polygon", "polygon"] = edge(f, g.polygon_box, g.polygon_box)
        ops[name, "circle", "circle"] = edge(f, g.circle_bounds, g.circle_bounds)
    size = {"lseg": g.lseg_length, "box": g.box_area, "circle": g.circle_area, "path": g.n_points}
    for k, f in size.items():
        for name, test in (("=", g.eq), ("<", g.lt), ("<=", g.le)):
            ops.setdefault((name, k, k), edge(test, f, f))
        ops.setdefault((">", k, k), _flip(ops["<", k, k]))
        ops.setdefault((">=", k, k), _flip(ops["<=", k, k]))
    for k in GEOMETRY:
        if ("=", k, k) in ops:
            ops["<>", k, k] = lambda x, y, f=ops["=", k, k]: ~f(x, y)
    # distances and containment the other way round
    for (name, a, b), f in list(ops.items()):
        back = {"<->": "<->", "@>": "<@", "<@": "@>", "?#": "?#"}.get(name)
        if back and (back, b, a) not in ops:
            ops[back, b, a] = _flip(f)
    return ops


_OPS: dict = {}


def _coerced(kind: str, a: str) -> str:
    """A text as a value of the type: here if it is a literal, else where the query runs."""
    if len(a) > 1 and a[0] == a[-1] == "'" and not re.search(r"(?<!\\)'", a[1:-1]):
        return literal(kind, re.sub(r"\\(.)", r"\1", a[1:-1]))
    return f"tessera_to_{kind}({a})"


def op(name: str, ka: str | None, a: str, ta: str, kb: str | None, b: str, tb: str) -> str | None:
    """a `name` b where a type of ours takes part, or None where the operator has no special meaning."""
    if not _OPS:
        _OPS.update(_geometry())
    x, y = Text(a), Text(b)
    if (f := _OPS.get((name, ka, kb))) is not None:
        return f(x, y).sql
    iv = library("interval")
    number = lambda t: t.startswith(("int", "bigint", "smallint", "decimal", "double", "float"))
    if name in ("=", "<>", "<", ">", "<=", ">=") and (ka or kb):
        if ka and tb == "string":
            kb, y = ka, Text(_coerced(ka, b))
        elif kb and ta == "string":
            ka, x = kb, Text(_coerced(kb, a))
        if (f := _OPS.get((name, ka, kb))) is not None:
            return f(x, y).sql
        if ka == kb == "interval":
            return f"({iv.span(x).sql} {name} {iv.span(y).sql})"
        if {ka, kb} <= {"inet", "cidr"}:
            return f"(tessera_inet_key({x.sql}.{ka}) {name} tessera_inet_key({y.sql}.{kb}))"
        if ka == kb and ka in ("time", "money", "macaddr", "macaddr8", "pg_lsn", "tsquery"):
            return f"({x.sql} {name} {y.sql})"
        if ka == kb == "tsvector":
            same = f"(map_entries({a}) = map_entries({b}))"
            if name in ("=", "<>"):
                return same if name == "=" else f"(NOT {same})"
    if ka == "interval" or kb == "interval":
        if ka == kb:
            if name in ("+", "-"):
                return (iv.add if name == "+" else iv.subtract)(x, y).sql
        elif name == "*" and (number(ta) or number(tb)):
            return iv.multiply(*((x, Text(f"CAST({b} AS DOUBLE)")) if ka else (y, Text(f"CAST({a} AS DOUBLE)")))).sql
        elif name == "/" and ka and number(tb):
            return iv.divide(x, Text(f"CAST({b} AS DOUBLE)")).sql
        elif name in ("+", "-") and kb and ta.startswith(("timestamp", "date")):
            return _shifted(a, ta, b, name)
        elif name == "+" and ka and tb.startswith(("timestamp", "date")):
            return _shifted(b, tb, a, "+")
        elif name in ("+", "-") and ka == "time":
            return f"named_struct('time', pmod({a}.time {name} {b}.micros, 86400000000))"
        elif name == "+" and kb == "time":
            return f"named_struct('time', pmod({b}.time + {a}.micros, 86400000000))"
    if ka == kb == "time" and name == "-":
        return _interval(0, 0, f"{a}.time - {b}.time")
    if name == "+" and "time" in (ka, kb) and "date" in (ta, tb):
        d, t = (a, b) if ta == "date" else (b, a)
        return f"CAST(timestamp_micros(unix_micros(CAST({d} AS TIMESTAMP_LTZ)) + {t}.time) AS TIMESTAMP_NTZ)"
    if ka == "money" or kb == "money":
        if ka == kb and name in ("+", "-"):
            return f"named_struct('cents', {a}.cents {name} {b}.cents)"
        if ka == kb and name == "/":
            return f"(CAST({a}.cents AS DOUBLE) / {b}.cents)"
        if name in ("*", "/") and ka and number(tb):
            whole = name == "/" and tb in ("int", "bigint", "smallint")
            return f"named_struct('cents', {f'{a}.cents div {b}' if whole else f'CAST(rint({a}.cents {name} CAST({b} AS DOUBLE)) AS BIGINT)'})"
        if name == "*" and number(ta):
            return f"named_struct('cents', CAST(rint({b}.cents * CAST({a} AS DOUBLE)) AS BIGINT))"
    if ka in ("inet", "cidr"):
        if kb in ("inet", "cidr"):
            call = f"tessera_inet_op('{name}', {a}.{ka}, {b}.{kb})"
            if name in ("<<", "<<=", ">>", ">>=", "&&"):
                return f"({call} = 't')"
            if name in ("&", "|"):
                return f"named_struct('inet', {call})"
            if name == "-":
                return f"CAST({call} AS BIGINT)"
        if name in ("+", "-") and number(tb):
            return f"named_struct('inet', tessera_inet_op('{name}', {a}.{ka}, CAST({b} AS STRING)))"
    if kb in ("inet", "cidr") and name == "+" and number(ta):
        return f"named_struct('inet', tessera_inet_op('+', {b}.{kb}, CAST({a} AS STRING)))"
    if ka == kb == "macaddr" and name in ("&", "|"):
        return f"named_struct('mac', {a}.mac {name} {b}.mac)"
    if ka == "pg_lsn":
        if kb == "pg_lsn" and name == "-":
            return f"({a}.lsn - {b}.lsn)"
        if name in ("+", "-") and number(tb):
            return f"named_struct('lsn', CAST({a}.lsn {name} CAST({b} AS DECIMAL(20,0)) AS DECIMAL(20,0)))"
    if ka == kb == "tsvector" and name == "||":
        return library("textsearch").concat(x, y).sql
    if name == "||" and (ka or kb) and "string" in (ta, tb):
        return f"concat({show(ka, a) if ka else a}, {show(kb, b) if kb else b})"
    return None


def search(vector: str, query: str) -> str:
    """tsvector @@ a literal tsquery."""
    return library("textsearch").matches(Text(vector), query).sql


def _shifted(ts: str, kind: str, i: str, sign: str) -> str:
    iv = library("interval")
    x = iv.negate(Text(i)) if sign == "-" else Text(i)
    out = iv.add_to(Text(f"CAST({ts} AS TIMESTAMP_NTZ)" if kind == "date" else ts), x).sql
    return f"CAST({out} AS TIMESTAMP_LTZ)" if kind == "timestamp" else out


def unary(name: str, kind: str, a: str) -> str | None:
    g, iv, x = library("geo"), library("interval"), Text(a)
    found = {
        ("-", "interval"): lambda: iv.negate(x).sql,
        ("-", "money"): lambda: f"named_struct('cents', -{a}.cents)",
        ("~", "inet"): lambda: f"named_struct('inet', tessera_inet_op('~', {a}.inet, '0'))",
        ("~", "macaddr"): lambda: f"named_struct('mac', (~{a}.mac) & 281474976710655)",
        ("@-@", "lseg"): lambda: g.lseg_length(x).sql,
        ("@-@", "path"): lambda: g.path_length(x).sql,
        ("@@", "lseg"): lambda: g.lseg_center(x).sql,
        ("@@", "box"): lambda: g.box_center(x).sql,
        ("@@", "circle"): lambda: f"{a}.center",
        ("@@", "polygon"): lambda: g.polygon_center(x).sql,
        ("#", "path"): lambda: g.n_points(x).sql,
        ("#", "polygon"): lambda: g.n_points(x).sql,
        ("?-", "lseg"): lambda: g.horizontal(x["a"], x["b"]).sql,
        ("?|", "lseg"): lambda: g.vertical(x["a"], x["b"]).sql,
        ("?-", "line"): lambda: g.eq(x["a"], 0.0).sql,
        ("?|", "line"): lambda: g.eq(x["b"], 0.0).sql,
    }.get((name, kind))
    return found() if found else None


#: Functions that make values of these types from others.
NAMES = {"point", "circle", "make_interval", "make_time", "age", "pg_lsn", "array_to_tsvector"}


# functions
def call(name: str, a: list[str], kinds: list[str | None], types: list[str], literals: list) -> str | None:
    """A function of a type of ours, or None for any other."""
    g, iv, ts = library("geo"), library("interval"), library("textsearch")
    x = list(map(Text, a))
    k = tuple(kinds)
    numeric = lambda i: not kinds[i]
    n = len(a)
    one = {
        "point": {"box": g.box_center, "lseg": g.lseg_center, "circle": lambda c: c["center"], "polygon": g.polygon_center}, "box": {"point": g.box, "circle": g.circle_box, "polygon": g.polygon_box},
        "circle": {"box": g.box_circle, "polygon": g.polygon_circle}, "polygon": {"box": g.box_polygon, "circle": g.circle_polygon, "path": lambda p: g.polygon(p["points"])}, "path": {"polygon": lambda p: g.path(p["points"])},
        "lseg": {"box": g.box_diagonal}, "diagonal": {"box": g.box_diagonal}, "center": {"box": g.box_center, "circle": lambda c: c["center"]}, "width": {"box": g.box_width}, "height": {"box": g.box_height},
        "area": {"box": g.box_area, "circle": g.circle_area, "path": g.path_area}, "length": {"lseg": g.lseg_length, "path": g.path_length, "tsvector": ts.length}, "radius": {"circle": lambda c: c["radius"]}, "diameter": {"circle": g.circle_diameter},
        "npoints": {"path": g.n_points, "polygon": g.n_points}, "isopen": {"path": lambda p: ~p["closed"]}, "isclosed": {"path": lambda p: p["closed"]}, "popen": {"path": g.path_open}, "pclose": {"path": g.path_close},
        "ishorizontal": {"lseg": lambda s: g.horizontal(s["a"], s["b"]), "line": lambda l: g.eq(l["a"], 0.0)}, "isvertical": {"lseg": lambda s: g.vertical(s["a"], s["b"]), "line": lambda l: g.eq(l["b"], 0.0)},
        "justify_hours": {"interval": iv.justify_hours}, "justify_days": {"interval": iv.justify_days}, "justify_interval": {"interval": iv.justify_interval}, "strip": {"tsvector": ts.strip}, "tsvector_to_array": {"tsvector": ts.to_array},
        "isfinite": {"interval": lambda i: Text(f"({i.sql} IS NOT NULL OR NULL)")}, "macaddr8_set7bit": {"macaddr8": lambda m: Text(f"named_struct('mac8', CASE WHEN floor({m.sql}.mac8 / 144115188075855872) % 2 = 0 THEN CAST({m.sql}.mac8 + 144115188075855872 AS DECIMAL(20,0)) ELSE {m.sql}.mac8 END)")},
    }
    if n == 1 and name in one and kinds[0] in one[name]:
        return one[name][kinds[0]](x[0]).sql
    two = {
        ("lseg", "point", "point"): g.lseg, ("box", "point", "point"): g.box, ("line", "point", "point"): g.line, ("slope", "point", "point"): g.slope, ("bound_box", "box", "box"): g.bound_box,
        ("isparallel", "line", "line"): g.line_parallel, ("isparallel", "lseg", "lseg"): g.lseg_parallel, ("isperp", "line", "line"): g.line_perpendicular, ("isperp", "lseg", "lseg"): g.lseg_perpendicular,
        ("ishorizontal", "point", "point"): g.horizontal, ("isvertical", "point", "point"): g.vertical, ("pt_contained_circle", "point", "circle"): _flip(g.circle_contains_point), ("pt_contained_poly", "point", "polygon"): _flip(g.polygon_contains_point),
    }
    if n == 2 and (name, *k) in two:
        return two[name, *k](*x).sql
    double = lambda i: Text(f"CAST({a[i]} AS DOUBLE)")
    if name == "point" and n == 2 and numeric(0) and numeric(1):
        return f"named_struct('x', {double(0).sql}, 'y', {double(1).sql})"
    if name == "circle" and n == 2 and kinds[0] == "point":
        return f"named_struct('center', {a[0]}, 'radius', {double(1).sql})"
    if name == "polygon" and n == 2 and kinds[1] == "circle" and a[0].isdigit():
        return g.circle_polygon(x[1], int(a[0])).sql
    if name == "make_interval":
        parts = (a + ["0"] * 7)[:7]
        seconds = f"CAST(rint(CAST({parts[6]} AS DOUBLE) * 1000000) AS BIGINT)"
        return _interval(f"CAST({parts[0]} * 12 + {parts[1]} AS INT)", f"CAST({parts[2]} * 7 + {parts[3]} AS INT)", f"{parts[4]} * 3600000000L + {parts[5]} * 60000000L + {seconds}")
    if name == "make_time" and n == 3:
        return f"named_struct('time', CAST({a[0]} * 3600000000L + {a[1]} * 60000000L + rint(CAST({a[2]} AS DOUBLE) * 1000000) AS BIGINT))"
    if name == "age" and n in (1, 2) and types[0].startswith(("timestamp", "date")):
        ntz = lambda i: Text(f"CAST({a[i]} AS TIMESTAMP_NTZ)")
        return (iv.age(ntz(0), ntz(1)) if n == 2 else iv.age(Text("CAST(current_date() AS TIMESTAMP_NTZ)"), ntz(0))).sql
    if name in ("extract", "date_part", "date_trunc") and n == 2 and kinds[1] in ("interval", "time"):
        return _part(name, (literals[0] or "").lower(), kinds[1], a[1])
    if kinds and kinds[0] in ("inet", "cidr"):
        own = f"{a[0]}.{kinds[0]}"
        if name == "abbrev":
            return f"tessera_abbreviated({own})" if kinds[0] == "cidr" else f"tessera_inet('abbrev', {own})"
        if name in ("host", "netmask", "hostmask"):
            out = f"tessera_inet('{name}', {own})"
            return out if name == "host" else f"named_struct('inet', {out})"
        if name in ("masklen", "family"):
            return f"CAST(tessera_inet('{name}', {own}) AS INT)"
        if name == "network":
            return f"named_struct('cidr', tessera_inet('network', {own}))"
        if name == "broadcast":
            return f"named_struct('inet', tessera_inet('broadcast', {own}))"
        if name == "text":
            return f"tessera_inet('text', {own})"
        if name == "set_masklen":
            return f"named_struct('{kinds[0]}', tessera_inet_set({own}, CAST({a[1]} AS INT), {'TRUE' if kinds[0] == 'cidr' else 'FALSE'}))"
        if name == "inet_same_family":
            return f"(tessera_inet('family', {own}) = tessera_inet('family', {a[1]}.{kinds[1]}))"
        if name == "inet_merge":
            return f"named_struct('cidr', tessera_inet_merge({own}, {a[1]}.{kinds[1]}))"
    if kinds and kinds[0] == "macaddr" and name == "trunc":
        return f"named_struct('mac', {a[0]}.mac & 281474959933440)"
    if kinds and kinds[0] == "money" and name in ("cashlarger", "cashsmaller", "greatest", "least"):
        return f"{'greatest' if name in ('cashlarger', 'greatest') else 'least'}({', '.join(a)})"
    if name == "cash_words" and kinds[0] == "money":
        return f"tessera_cash_words({a[0]}.cents)"
    if name == "pg_lsn" and n == 1:
        return f"named_struct('lsn', CAST({a[0]} AS DECIMAL(20,0)))"
    # text search
    if name == "array_to_tsvector":
        return ts.from_array(x[0]).sql
    if kinds and kinds[0] == "tsvector":
        if name == "setweight" and literals[1]:
            return ts.set_weight(x[0], literals[1], literals[2].strip("{}").split(",") if n > 2 and literals[2] else None).sql
        if name == "ts_delete" and literals[1] is not None:
            words = literals[1].strip("{}").split(",") if literals[1].startswith("{") else [literals[1]]
            return ts.delete(x[0], *words).sql
        if name == "ts_filter" and literals[1]:
            return ts.keep_weights(x[0], [w.strip().upper() for w in literals[1].strip("{}").split(",")]).sql
    if kinds and kinds[0] == "tsquery":
        if name in ("numnode", "querytree"):
            return f"tessera_{name}({a[0]}.tsquery)"
        if name == "tsquery_phrase":
            return f"named_struct('tsquery', tessera_tsquery_phrase({a[0]}.tsquery, {a[1]}.tsquery, {a[2] if n > 2 else 1}))"
    return None


def _part(name: str, field: str, kind: str, a: str) -> str:
    field = {"years": "year", "months": "month", "days": "day", "hours": "hour", "minutes": "minute", "seconds": "second"}.get(field, field)
    us = f"{a}.micros" if kind == "interval" else f"{a}.time"
    if name == "date_trunc":
        unit = {"microseconds": 1, "milliseconds": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 0, "month": 0, "year": 0}.get(field)
        if kind != "interval" or unit is None:
            raise SqlError(f'unit "{field}" not recognized', "22023")
        clock = f"({us} div {unit} * {unit})" if unit else "0L"
        days = f"{a}.days" if field not in ("month", "year") else "0"
        months = f"({a}.months div 12 * 12)" if field == "year" else f"{a}.months"
        return _interval(f"CAST({months} AS INT)", days, f"CAST({clock} AS BIGINT)")
    seconds = f"{us} % 60000000"
    found = {"hour": f"{us} div 3600000000", "minute": f"{us} div 60000000 % 60", "second": f"({seconds}) / 1000000BD", "milliseconds": f"({seconds}) / 1000BD", "microseconds": seconds}
    if kind == "interval":
        m = f"{a}.months"
        found |= {
            "year": f"{m} div 12", "month": f"{m} % 12", "day": f"{a}.days", "quarter": f"{m} % 12 div 3 + 1", "decade": f"{m} div 120", "century": f"{m} div 1200", "millennium": f"{m} div 12000",
            "epoch": f"({m} div 12 * 31557600 + {m} % 12 * 2592000 + {a}.days * 86400L) + {us} / 1000000BD",
        }
    else:
        found["epoch"] = f"{us} / 1000000BD"
    if field not in found:
        raise SqlError(f'unit "{field}" not recognized', "22023")
    return f"CAST({found[field]} AS {'DECIMAL(38,6)' if name == 'extract' else 'DOUBLE'})"


#: textsearch's own helpers on the driver, for literals
show_query, parse_query = textsearch.show, textsearch.parse_query
