"""Function calls of the dialect as Spark SQL text.

AGGREGATES and SCALARS map a name to a function of its emitted arguments. Names that Spark spells and
means alike are listed in SAME; everything else says here what differs.
"""

from __future__ import annotations

import re
import time
from string import Formatter

from ..types import family, spark_type
from . import patterns, special
from .parser import SqlError

AGGREGATES = set(
    """count min max sum avg string_agg array_agg bool_and bool_or every stddev stddev_samp stddev_pop variance var_samp var_pop
    corr covar_pop covar_samp regr_slope regr_intercept regr_r2 regr_count percentile_cont percentile_disc mode bit_and bit_or bit_xor
    lag lead first_value last_value nth_value ntile percent_rank cume_dist grouping approx_count_distinct any_value json_agg""".split()
)


def aggregate(name: str, a: list[str], kind: str, distinct: str, keep: str, over: str, order: list) -> str:
    f = family(kind) if kind else ""
    if name in ("min", "max") and f == "boolean":
        raise SqlError(f"function {name}(boolean) does not exist", "42883")
    if name == "sum":
        if kind == "bigint":
            return f"sum({distinct}CAST({a[0]} AS DECIMAL(38,0))){keep}{over}"
        if kind == "float":
            return f"CAST(sum({distinct}{a[0]}){keep}{over} AS FLOAT)"
        if f == "decimal":
            return f"sum({distinct}{a[0]}){keep}{over}"
        return f"sum({distinct}{a[0]}){keep}{over}"
    if name == "avg":
        if f in ("int", "decimal"):
            wide = "DECIMAL(38,0)" if f == "int" else f"DECIMAL(38,{kind.rstrip(')').split(',')[1]})"
            total = f"sum({distinct}CAST({a[0]} AS {wide})){keep}{over}"
            n = f"nullif(count({distinct}{a[0]}){keep}{over}, 0)"
            return f"(CAST({total} AS DECIMAL(38,16)) / {n})"
        return f"avg({distinct}{a[0]}){keep}{over}"
    if name == "string_agg":
        text = f"listagg({distinct}{a[0]}, {a[1]})"
        if order:
            by = ", ".join(f"{e} {'ASC' if asc else 'DESC'} NULLS {'FIRST' if first else 'LAST'}" for e, asc, first in order)
            text += f" WITHIN GROUP (ORDER BY {by})"
        return f"{text}{keep}{over}"
    if name in ("array_agg", "json_agg"):
        if distinct:
            # sorted ascending, NULL last
            return f"transform(array_sort(collect_set(struct({a[0]} IS NULL AS n, {a[0]} AS v)){keep}{over}), _e -> _e.v)"
        if order:
            keys = ", ".join(f"{e} IS {'NOT ' if first else ''}NULL AS n{k}, {e} AS k{k}" for k, (e, _, first) in enumerate(order))
            lists = f"collect_list(struct({keys}, {a[0]} AS v)){keep}{over}"
            if all(asc for _, asc, _ in order):
                text = f"transform(array_sort({lists}), _e -> _e.v)"
            else:
                tests = "".join(
                    f" WHEN l.n{k} <> r.n{k} THEN CASE WHEN l.n{k} THEN 1 ELSE -1 END WHEN l.k{k} < r.k{k} THEN {-1 if asc else 1} WHEN l.k{k} > r.k{k} THEN {1 if asc else -1}"
                    for k, (_, asc, _) in enumerate(order)
                )
                text = f"transform(array_sort({lists}, (l, r) -> CASE{tests} ELSE 0 END), _e -> _e.v)"
        else:
            text = f"transform(collect_list(struct({a[0]} AS v)){keep}{over}, _e -> _e.v)"
        return f"CASE WHEN count(*){keep}{over} = 0 THEN NULL ELSE {text} END"
    if name in ("percentile_cont", "percentile_disc") and order:
        e, asc, _ = order[0]
        return f"{name}({a[0]}) WITHIN GROUP (ORDER BY {e} {'ASC' if asc else 'DESC'}){keep}{over}"
    if name == "mode" and order:
        return f"mode({order[0][0]}){keep}{over}"
    spark = {"stddev": "stddev_samp", "variance": "var_samp", "every": "bool_and"}.get(name, name)
    return f"{spark}({distinct}{', '.join(a)}){keep}{over}"


def json_access(op: str, a: str, b: str, kind: str) -> str:
    """-> ->> #> #>> on JSON text. -> keeps JSON text; ->> gives text, and NULL for a JSON null."""
    if op in ("#>", "#>>"):
        m = re.fullmatch(r"'\{(.*)\}'", b)
        if m:
            steps = [s.strip() for s in m[1].split(",")] if m[1] else []
            return _path(a, steps, op == "#>>")
        return f"tessera_json_path({a}, {b}, {'TRUE' if op == '#>>' else 'FALSE'})"
    if kind == "int":
        if re.fullmatch(r"-\d+", b):
            return f"tessera_json_path({a}, concat('{{', {b}, '}}'), {'TRUE' if op == '->>' else 'FALSE'})"
        return _path(a, [f"[{b}]"], op == "->>")
    m = re.fullmatch(r"'(.*)'", b)
    if m:
        return _path(a, [f"['{m[1]}']"], op == "->>")
    return f"tessera_json_path({a}, concat('{{', {b}, '}}'), {'TRUE' if op == '->>' else 'FALSE'})"


def _path(a: str, steps: list[str], as_text: bool) -> str:
    path = "$" + "".join(s if s.startswith("[") else f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps)
    path = path.replace("'", "\\'")
    if as_text:
        return f"get_json_object({a}, '{path}')"
    return f"to_json(variant_get(parse_json({a}), '{path}', 'variant'))"


#: Same name and meaning in Spark.
SAME = set(
    """abs ceil floor sqrt cbrt ln log10 sinh cosh tanh asinh sin cos tan cot atan atan2 degrees radians pi mod upper lower
    replace translate reverse ascii greatest least coalesce nullif split_part lpad rpad repeat md5 make_date cardinality array_position
    concat_ws char_length character_length octet_length bit_length version current_user strpos""".split()
)

#: date_part and extract fields of a timestamp t, as numbers (fixed values and formulas).
FIELDS = {
    "year": "year({t})", "month": "month({t})", "day": "day({t})", "hour": "hour({t})", "minute": "minute({t})", "quarter": "quarter({t})",
    "doy": "dayofyear({t})", "dow": "(dayofweek({t}) - 1)", "isodow": "(weekday({t}) + 1)", "week": "weekofyear({t})", "isoyear": "extract(YEAROFWEEK FROM {t})",
    "decade": "CAST(floor(year({t}) / 10) AS INT)", "century": "CAST(ceil(year({t}) / 100) AS INT)", "millennium": "CAST(ceil(year({t}) / 1000) AS INT)",
    "julian": "(datediff({t}, DATE'1970-01-01') + 2440588)",
}


def _micros(t: str) -> str:
    return f"unix_micros(CAST({t} AS TIMESTAMP_LTZ))" if not t.startswith("unix") else t


def extract(field: str, t: str, kind: str, numeric: bool) -> str:
    field = {"years": "year", "months": "month", "days": "day", "hours": "hour", "minutes": "minute", "seconds": "second", "mon": "month"}.get(field, field)
    f = family(kind)
    if f == "interval":
        return _interval_field(field, t, kind, numeric)
    ts = f"CAST({t} AS TIMESTAMP_NTZ)" if f in ("date", "string") else t
    if field in FIELDS:
        out = FIELDS[field].format(t=ts)
        return f"CAST({out} AS {'DECIMAL(38,0)' if numeric else 'DOUBLE'})"
    # the session's zone is UTC, so NTZ and its instant have the same microseconds
    us = f"unix_micros(CAST({ts} AS TIMESTAMP_LTZ))"
    minute = f"pmod({us}, 60000000)"
    exact = {
        "epoch": (us, 6), "second": (minute, 6), "milliseconds": (minute, 3), "microseconds": (minute, 0),
    }.get(field)
    if exact is None:
        raise SqlError(f'unit "{field}" not recognized', "22023")
    value, scale = exact
    if numeric:
        return f"CAST(CAST({value} AS DECIMAL(38,{scale})) / {10**scale} AS DECIMAL(38,{scale}))"
    return f"({value} / {10**scale}D)"


def _interval_field(field: str, t: str, kind: str, numeric: bool) -> str:
    if "month" in kind or "year" in kind:
        months = f"(extract(YEAR FROM {t}) * 12 + extract(MONTH FROM {t}))"
        out = {"year": f"({months} div 12)", "month": f"({months} % 12)", "epoch": f"({months} div 12 * 31557600 + {months} % 12 * 2592000)", "quarter": f"({months} % 12 div 3 + 1)"}.get(field, "0")
    else:
        us = f"(extract(DAY FROM {t}) * 86400000000 + extract(HOUR FROM {t}) * 3600000000 + extract(MINUTE FROM {t}) * 60000000 + CAST(extract(SECOND FROM {t}) * 1000000 AS BIGINT))"
        out = {"day": f"extract(DAY FROM {t})", "hour": f"extract(HOUR FROM {t})", "minute": f"extract(MINUTE FROM {t})", "second": f"extract(SECOND FROM {t})", "epoch": f"({us} / 1000000D)"}.get(field, "0")
    return f"CAST({out} AS {'DECIMAL(38,6)' if numeric else 'DOUBLE'})"


def date_trunc(unit: str, t: str, kind: str) -> str:
    f = family(kind)
    out = "TIMESTAMP_LTZ" if kind == "timestamp" else "TIMESTAMP_NTZ"
    ts = t if f == "timestamp" else f"CAST({t} AS TIMESTAMP_NTZ)"
    years = {"decade": f"year({ts}) - pmod(year({ts}), 10)", "century": f"year({ts}) - pmod(year({ts}) - 1, 100)", "millennium": f"year({ts}) - pmod(year({ts}) - 1, 1000)"}
    if unit in years:
        return f"CAST(make_date({years[unit]}, 1, 1) AS {out})"
    unit = {"milliseconds": "millisecond", "microseconds": "microsecond"}.get(unit, unit)
    return f"CAST(date_trunc('{unit}', {ts}) AS {out})"


def date_bin(stride: str, t: str, origin: str, kind: str = "timestamp_ntz") -> str:
    us = lambda x: f"unix_micros(CAST({x} AS TIMESTAMP_LTZ))"
    step = f"(unix_micros(TIMESTAMP'1970-01-01 00:00:00Z' + {stride}))"
    return f"CAST(timestamp_micros({us(origin)} + CAST(floor(({us(t)} - {us(origin)}) / {step}) AS BIGINT) * {step}) AS {'TIMESTAMP_LTZ' if kind == 'timestamp' else 'TIMESTAMP_NTZ'})"


def _regexp_replace(a, literal, types):
    pattern, flags = literal[1], (literal[3] if len(a) > 3 and literal[3] is not None else "")
    if pattern is None or (len(a) > 2 and literal[2] is None):
        if "g" in flags:
            return f"regexp_replace({a[0]}, {a[1]}, {a[2]})"
        return f"tessera_regexp_replace({a[0]}, {a[1]}, {a[2]}, '{flags}')"
    j, r = patterns.java(pattern, flags), patterns.replacement(literal[2])
    if "g" in flags:
        return f"regexp_replace({a[0]}, {q(j)}, {q(r)})"
    # the first match only: everything from the start is one match; own groups shift by one
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}" if m[1] != "0" else "$2", r)
    whole = f"(?s)^(.*?)({j})" if "$0" in r else f"(?s)^(.*?)(?:{j})"
    if "$0" in r:
        shifted = re.sub(r"\$(\d)", lambda m: "$2" if m[1] == "0" else f"${int(m[1]) + 2}", r)
    return f"regexp_replace({a[0]}, {q(whole)}, {q('$1' + shifted)})"


def q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _flags(literal, i):
    return literal[i] if len(literal) > i and literal[i] is not None else ""


def _pattern(a, literal, i, flags=""):
    return q(patterns.java(literal[i], flags)) if literal[i] is not None else a[i]


def _substring(a, literal, types):
    if len(a) >= 2 and family(types[1]()) == "string":
        # the first group, or the whole match without one
        p = patterns.java(literal[1])
        n = 1 if re.search(r"(?<!\\)\((?!\?)", p) else 0
        return f"nullif(CASE WHEN {a[0]} RLIKE {q(p)} THEN regexp_extract({a[0]}, {q(p)}, {n}) END, NULL)"
    s, start = a[0], a[1]
    if len(a) == 2:
        return f"substring({s}, greatest({start}, 1))"
    end = f"({start} + {a[2]})"
    return f"CASE WHEN {a[2]} < 0 THEN CAST(raise_error('negative substring length not allowed') AS STRING) ELSE substring({s}, greatest({start}, 1), greatest({end} - greatest({start}, 1), 0)) END"


def _round(a, literal, types):
    f = family(types[0]())
    if len(a) > 1:
        return f"round({a[0]}, {a[1]})"
    return f"rint({a[0]})" if f == "float" else f"round({a[0]})"


def _trunc(a, literal, types):
    f = family(types[0]())
    if len(a) > 1:
        return f"CAST(sign({a[0]}) * floor(abs({a[0]}) * CAST(power(10, {a[1]}) AS DECIMAL(38,0))) / CAST(power(10, {a[1]}) AS DECIMAL(38,0)) AS DECIMAL(38,{a[1]}))"
    if f == "float":
        return f"(signum({a[0]}) * CAST(floor(abs({a[0]})) AS DOUBLE))"
    return f"(sign({a[0]}) * floor(abs({a[0]})))"


def _floored(name):
    def f(a, literal, types):
        return f"CAST({name}({a[0]}) AS DOUBLE)" if family(types[0]()) == "float" else f"{name}({a[0]})"

    return f


def _length(a, literal, types):
    return f"octet_length({a[0]})" if types[0]() == "binary" else f"char_length({a[0]})"


def _guard(test: str, message: str, value: str) -> str:
    return f"CASE WHEN {test} THEN CAST(raise_error('{message}') AS DOUBLE) ELSE {value} END"


def _degrees(name):
    exact = {
        "sind": ("sin", {0: "0", 30: "0.5", 90: "1", 150: "0.5", 180: "0", 210: "-0.5", 270: "-1", 330: "-0.5"}),
        "cosd": ("cos", {0: "1", 60: "0.5", 90: "0", 120: "-0.5", 180: "-1", 240: "-0.5", 270: "0", 300: "0.5"}),
        "tand": ("tan", {0: "0", 45: "1", 135: "-1", 180: "0", 225: "1", 315: "-1"}),
        "cotd": ("cot", {45: "1", 90: "0", 135: "-1", 225: "1", 270: "0", 315: "-1"}),
    }[name]

    def f(a, literal, types):
        x = f"pmod(CAST({a[0]} AS DOUBLE), 360D)"
        whens = " ".join(f"WHEN {x} = {k} THEN {v}D" for k, v in exact[1].items())
        return f"CASE {whens} ELSE {exact[0]}(radians(CAST({a[0]} AS DOUBLE))) END"

    return f


def _inverse_degrees(name):
    table = {"asind": ("asin", {0: 0, 0.5: 30, 1: 90, -0.5: -30, -1: -90}), "acosd": ("acos", {1: 0, 0.5: 60, 0: 90, -0.5: 120, -1: 180}), "atand": ("atan", {0: 0, 1: 45, -1: -45})}
    base, exact = table[name]

    def f(a, literal, types):
        whens = " ".join(f"WHEN {a[0]} = {k} THEN {v}D" for k, v in exact.items())
        inner = f"CASE {whens} ELSE degrees({base}(CAST({a[0]} AS DOUBLE))) END"
        return _guard(f"abs({a[0]}) > 1", "input is out of range", inner) if base != "atan" else inner

    return f


def _to_hex(a, literal, types):
    return f"lower(hex(CAST({a[0]} AS BIGINT) & 4294967295L))" if types[0]() == "int" else f"lower(hex({a[0]}))"


def _encode(a, literal, types):
    b = f"CAST({a[0]} AS BINARY)"
    if literal[1] == "hex":
        return f"lower(hex({b}))"
    if literal[1] == "base64":
        return f"rtrim('\\n', regexp_replace(replace(replace(base64({b}), '\\r', ''), '\\n', ''), '(.{{76}})', '$1\\n'))"
    return f"tessera_escape({b})"


def _decode(a, literal, types):
    return {"hex": f"unhex({a[0]})", "base64": f"unbase64({a[0]})"}.get(literal[1]) or f"tessera_unescape({a[0]})"


#: Date patterns and their Java spelling, longest first (fixed values).
DATE_PATTERNS = (("HH24", "HH"), ("HH12", "hh"), ("YYYY", "yyyy"), ("Month", "MMMM"), ("MON", "MMM"), ("Mon", "MMM"), ("DDD", "DDD"), ("Day", "EEEE"), ("DY", "EEE"), ("Dy", "EEE"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("AM", "a"), ("PM", "a"))


def java_date_pattern(pattern: str) -> str | None:
    """The Java pattern with the same output, or None where there is none."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == '"':
            j = pattern.find('"', i + 1)
            out.append("'" + pattern[i + 1 : j] + "'")
            i = j + 1
            continue
        for p, j in DATE_PATTERNS:
            if pattern.startswith(p, i):
                if p in ("Month", "Day", "MON", "DY"):
                    return None  # padded or upper-case
                out.append(j)
                i += len(p)
                break
        else:
            if pattern[i].isalpha():
                return None
            out.append(pattern[i])
            i += 1
    return "".join(out)


def _to_char(a, literal, types):
    f = family(types[0]())
    if f in ("timestamp", "date"):
        j = java_date_pattern(literal[1]) if literal[1] is not None else None
        if j is not None:
            return f"date_format({a[0]}, {q(j)})"
        return f"tessera_to_char_time(CAST({a[0]} AS TIMESTAMP_LTZ), {a[1]})"
    return f"tessera_to_char_number(CAST({a[0]} AS STRING), {a[1]})"


def _to_date(a, literal, types):
    j = java_date_pattern(literal[1]) if literal[1] is not None else None
    return f"to_date({a[0]}, {q(j)})" if j else f"to_date(tessera_to_timestamp({a[0]}, {a[1]}))"


def _to_timestamp(a, literal, types):
    if len(a) == 1:
        return f"timestamp_micros(CAST(rint({a[0]} * 1000000) AS BIGINT))"
    j = java_date_pattern(literal[1]) if literal[1] is not None else None
    return f"to_timestamp({a[0]}, {q(j)})" if j else f"tessera_to_timestamp({a[0]}, {a[1]})"


def _typeof(a, literal, types):
    t = types[0]()
    names = {"int": "integer", "bigint": "bigint", "smallint": "smallint", "double": "double precision", "float": "real", "string": "text", "timestamp_ntz": "timestamp without time zone", "timestamp": "timestamp with time zone", "binary": "bytea", "void": "unknown"}
    if kind := special.kind_of(t):
        return f"'{ {'time': 'time without time zone'}.get(kind, kind)}'"
    if t.startswith("array<"):
        return f"'{names.get(t[6:-1], t[6:-1])}[]'"
    return "'numeric'" if t.startswith("decimal") else f"'{names.get(t, t)}'"


def _regexp_matches(a, literal, types):
    p = patterns.java(literal[1], _flags(literal, 2))
    groups = len(re.findall(r"(?<!\\)\((?!\?)", p))
    return f"CASE WHEN {a[0]} RLIKE {q(p)} THEN array({', '.join(f'regexp_extract({a[0]}, {q(p)}, {k})' for k in (range(1, groups + 1) if groups else [0]))}) END"


def LIT(s: str):  # noqa: N802
    """A call without arguments (a precision in seconds aside)."""

    def f(a, literal, types):
        if len(a) > 1 or (a and not a[0].isdigit()):
            raise IndexError
        return s

    return f


def E(template: str):  # noqa: N802
    """A call with as many arguments as the template has places, or with any number for {all}."""
    places = {name for _, name, _, _ in Formatter().parse(template) if name is not None}
    n = None if "all" in places else 1 + max(map(int, places))

    def f(a, literal, types):
        if n is not None and len(a) != n:
            raise IndexError
        return template.format(*a, all=", ".join(a))

    return f


def _jsonb(function: str, form: str = "{}"):
    """A JSON path function of a document, a path, variables and whether errors are silent."""

    def f(a, literal, types):
        if not 2 <= len(a) <= 4:
            raise IndexError
        rest = [*a[2:], *["'{}'", "FALSE"][len(a) - 2 :]]
        return form.format(f"{function}({a[0]}, {a[1]}, {', '.join(rest)})")

    return f

#: Server encodings and types by their numbers (fixed values).
ENCODINGS = {0: "SQL_ASCII", 1: "EUC_JP", 2: "EUC_CN", 3: "EUC_KR", 4: "EUC_TW", 5: "EUC_JIS_2004", 6: "UTF8", 7: "MULE_INTERNAL", 8: "LATIN1", 9: "LATIN2", 10: "LATIN3", 11: "LATIN4", 12: "LATIN5", 13: "LATIN6", 14: "LATIN7", 15: "LATIN8", 16: "LATIN9", 17: "LATIN10", 18: "WIN1256", 19: "WIN1258"}
ENCODING_NAMES = "map(" + ", ".join(f"{k}, '{v}'" for k, v in ENCODINGS.items()) + ")"
ENCODING_NUMBERS = "map(" + ", ".join(f"'{v}', {k}" for k, v in ENCODINGS.items()) + ")"
TYPES = {16: "boolean", 17: "bytea", 20: "bigint", 21: "smallint", 23: "integer", 25: "text", 26: "oid", 114: "json", 600: "point", 700: "real", 701: "double precision", 790: "money", 829: "macaddr", 869: "inet", 1042: "character", 1043: "character varying", 1082: "date", 1083: "time without time zone", 1114: "timestamp without time zone", 1184: "timestamp with time zone", 1186: "interval", 1700: "numeric", 2950: "uuid", 3802: "jsonb"}
TYPE_NAMES = "map(" + ", ".join(f"{k}, '{v}'" for k, v in TYPES.items()) + ")"

#: The milliseconds since 1970, and a random id's bits behind the version.
_MILLIS = "lpad(lower(hex(unix_millis(current_timestamp()))), 12, '0')"
UUID7 = f"concat(substring({_MILLIS}, 1, 8), '-', substring({_MILLIS}, 9, 4), '-7', substring(uuid(), 16, 21))"

SCALARS = {
    # math
    "ceil": _floored("ceil"), "ceiling": _floored("ceil"), "floor": _floored("floor"), "round": _round, "trunc": _trunc,
    "sign": E("CAST(sign({0}) AS DOUBLE)"), "power": E("power({all})"), "pow": E("power({all})"), "exp": E("exp({0})"),
    "sqrt": lambda a, l, t: _guard(f"{a[0]} < 0", "cannot take square root of a negative number", f"sqrt({a[0]})"),
    "ln": lambda a, l, t: _guard(f"{a[0]} <= 0", "cannot take logarithm of a non-positive number", f"ln({a[0]})"),
    "log10": lambda a, l, t: _guard(f"{a[0]} <= 0", "cannot take logarithm of a non-positive number", f"log10({a[0]})"),
    "log": lambda a, l, t: f"log10({a[0]})" if len(a) == 1 else f"log({a[0]}, {a[1]})",
    "asin": lambda a, l, t: _guard(f"abs({a[0]}) > 1", "input is out of range", f"asin({a[0]})"),
    "acos": lambda a, l, t: _guard(f"abs({a[0]}) > 1", "input is out of range", f"acos({a[0]})"),
    "acosh": lambda a, l, t: _guard(f"{a[0]} < 1", "input is out of range", f"acosh({a[0]})"),
    "atanh": lambda a, l, t: _guard(f"abs({a[0]}) > 1", "input is out of range", f"atanh({a[0]})"),
    "sind": _degrees("sind"), "cosd": _degrees("cosd"), "tand": _degrees("tand"), "cotd": _degrees("cotd"),
    "asind": _inverse_degrees("asind"), "acosd": _inverse_degrees("acosd"), "atand": _inverse_degrees("atand"), "atan2d": E("degrees(atan2({0}, {1}))"),
    "gcd": E("tessera_gcd(CAST({0} AS BIGINT), CAST({1} AS BIGINT))"), "lcm": E("tessera_lcm(CAST({0} AS BIGINT), CAST({1} AS BIGINT))"),
    "erf": E("tessera_erf(CAST({0} AS DOUBLE))"), "erfc": E("tessera_erfc(CAST({0} AS DOUBLE))"), "gamma": E("tessera_gamma(CAST({0} AS DOUBLE))"), "lgamma": E("tessera_lgamma(CAST({0} AS DOUBLE))"),
    "width_bucket": E("CAST(width_bucket({all}) AS INT)"), "booleq": E("({0} = {1})"), "boolne": E("({0} <> {1})"), "factorial": E("factorial(CAST({0} AS INT))"),
    "cashlarger": E("greatest({0}, {1})"), "cashsmaller": E("least({0}, {1})"), "float4send": E("tessera_float4send(CAST({0} AS FLOAT))"), "float8send": E("tessera_float8send(CAST({0} AS DOUBLE))"),
    # text
    "length": _length, "concat": lambda a, l, t: "concat_ws('', " + ", ".join(f"CAST({x} AS STRING)" for x in a) + ")",
    "concat_ws": lambda a, l, t: f"concat_ws({a[0]}, " + ", ".join(f"CAST({x} AS STRING)" for x in a[1:]) + ")",
    "initcap": E("array_join(transform(regexp_extract_all(lower({0}), '[\\\\p{{L}}\\\\p{{N}}]+|[^\\\\p{{L}}\\\\p{{N}}]+', 0), w -> concat(upper(substring(w, 1, 1)), substring(w, 2))), '')"),
    "substring": _substring, "substr": _substring, "position": E("position({all})"), "overlay": lambda a, l, t: f"overlay({a[0]} PLACING {a[1]} FROM {a[2]}" + (f" FOR {a[3]})" if len(a) > 3 else f" FOR char_length({a[1]}))"),
    "strpos": E("instr({0}, {1})"), "btrim": lambda a, l, t: f"trim({a[0]})" if len(a) == 1 else f"btrim({a[0]}, {a[1]})",
    "ltrim": lambda a, l, t: f"ltrim({a[0]})" if len(a) == 1 else f"ltrim({a[1]}, {a[0]})", "rtrim": lambda a, l, t: f"rtrim({a[0]})" if len(a) == 1 else f"rtrim({a[1]}, {a[0]})",
    "left": E("CASE WHEN {1} >= 0 THEN substring({0}, 1, {1}) ELSE substring({0}, 1, greatest(char_length({0}) + {1}, 0)) END"),
    "right": E("CASE WHEN {1} > 0 THEN substring({0}, greatest(char_length({0}) - {1} + 1, 1)) WHEN {1} = 0 THEN '' ELSE substring({0}, 1 - {1}) END"),
    "chr": E("decode(encode(tessera_chr({0}), 'UTF-8'), 'UTF-8')"), "starts_with": E("startswith({0}, {1})"), "to_hex": _to_hex, "encode": _encode, "decode": _decode,
    "lpad": lambda a, l, t: f"CASE WHEN {a[1]} <= 0 THEN '' ELSE lpad({a[0]}, {a[1]}, {a[2] if len(a) > 2 else chr(39) + ' ' + chr(39)}) END",
    "rpad": lambda a, l, t: f"CASE WHEN {a[1]} <= 0 THEN '' ELSE rpad({a[0]}, {a[1]}, {a[2] if len(a) > 2 else chr(39) + ' ' + chr(39)}) END",
    "quote_ident": E("CASE WHEN {0} RLIKE '^[a-z_][a-z0-9_$]*$' THEN {0} ELSE concat('\"', replace({0}, '\"', '\"\"'), '\"') END"),
    "quote_literal": E("concat(CASE WHEN contains({0}, '\\\\') THEN 'E' ELSE '' END, '\\'', replace(replace({0}, '\\'', '\\'\\''), '\\\\', '\\\\\\\\'), '\\'')"),
    "quote_nullable": E("coalesce(concat('\\'', replace({0}, '\\'', '\\'\\''), '\\''), 'NULL')"),
    "format": E("tessera_format({0}, array(CAST(NULL AS STRING)))"),
    "regexp_replace": _regexp_replace,
    "regexp_like": lambda a, l, t: f"({a[0]} RLIKE {_pattern(a, l, 1, _flags(l, 2))})",
    "regexp_count": lambda a, l, t: f"regexp_count({a[0] if len(a) < 3 else f'substring({a[0]}, {a[2]})'}, {_pattern(a, l, 1, _flags(l, 3))})",
    "regexp_substr": lambda a, l, t: f"regexp_substr({a[0]}, {_pattern(a, l, 1)})" if len(a) < 3 else f"get(regexp_extract_all(substring({a[0]}, {a[2]}), {_pattern(a, l, 1, _flags(l, 4))}, 0), {a[3] if len(a) > 3 else 1} - 1)",
    "regexp_instr": lambda a, l, t: f"regexp_instr({a[0]}, {_pattern(a, l, 1)})", "regexp_match": _regexp_matches,
    "regexp_split_to_array": lambda a, l, t: f"split({a[0]}, {_pattern(a, l, 1, _flags(l, 2))})",
    "string_to_array": E("split({0}, concat('\\\\Q', {1}, '\\\\E'))"),
    # dates
    "now": LIT("current_timestamp()"), "transaction_timestamp": LIT("current_timestamp()"), "statement_timestamp": LIT("current_timestamp()"), "clock_timestamp": LIT("current_timestamp()"),
    "current_date": LIT("current_date()"), "current_timestamp": LIT("current_timestamp()"), "localtimestamp": LIT("localtimestamp()"),
    "extract": lambda a, l, t: extract(l[0].lower(), a[1], t[1](), True), "date_part": lambda a, l, t: extract(l[0].lower(), a[1], t[1](), False),
    "date_trunc": lambda a, l, t: date_trunc(l[0].lower(), a[1], t[1]()), "date_bin": lambda a, l, t: date_bin(*a, t[1]()),
    "isfinite": E("({0} IS NOT NULL OR NULL)"), "make_timestamp": E("make_timestamp_ntz({all})"), "make_timestamptz": E("make_timestamp_ltz({all})"),
    "make_interval": lambda a, l, t: f"make_interval({', '.join((a + ['0'] * 7)[:7])})", "make_time": E("CAST({0} * 3600000000L + {1} * 60000000L + rint({2} * 1000000) AS BIGINT)"),
    "age": lambda a, l, t: f"({a[0]} - {a[1]})" if len(a) > 1 else f"(CAST(current_date() AS TIMESTAMP_NTZ) - {a[0]})",
    "to_char": _to_char, "to_date": _to_date, "to_timestamp": _to_timestamp, "to_number": E("CAST(tessera_to_number({0}, {1}) AS DECIMAL(38,16))"),
    "timezone": E("from_utc_timestamp(to_utc_timestamp({1}, {0}), current_timezone())"),
    # hashes, ids
    "sha224": E("unhex(sha2(CAST({0} AS BINARY), 224))"), "sha256": E("unhex(sha2(CAST({0} AS BINARY), 256))"), "sha384": E("unhex(sha2(CAST({0} AS BINARY), 384))"), "sha512": E("unhex(sha2(CAST({0} AS BINARY), 512))"),
    "crc32": E("crc32(CAST({0} AS BINARY))"), "crc32c": E("tessera_crc32c(CAST({0} AS BINARY))"), "gen_random_uuid": LIT("uuid()"), "uuidv4": LIT("uuid()"), "uuidv7": LIT(UUID7),
    "uuid_extract_version": E("CAST(conv(substring({0}, 15, 1), 16, 10) AS SMALLINT)"),
    "uuid_extract_timestamp": E("CASE WHEN substring({0}, 15, 1) = '7' THEN timestamp_millis(CAST(conv(substring(replace({0}, '-', ''), 1, 12), 16, 10) AS BIGINT)) END"),
    # arrays
    "array_length": E("CASE WHEN {1} = 1 AND size({0}) > 0 THEN size({0}) END"), "array_upper": E("CASE WHEN {1} = 1 AND size({0}) > 0 THEN size({0}) END"), "array_lower": E("CASE WHEN {1} = 1 AND size({0}) > 0 THEN 1 END"),
    "array_append": E("array_append({0}, {1})"), "array_prepend": E("array_prepend({1}, {0})"), "array_cat": E("CASE WHEN {0} IS NULL THEN {1} WHEN {1} IS NULL THEN {0} ELSE concat({0}, {1}) END"),
    "array_to_string": lambda a, l, t: f"array_join(transform({a[0]}, _e -> CAST(_e AS STRING)), {', '.join(a[1:])})", "cardinality": E("size({0})"), "array_remove": E("array_remove({0}, {1})"),
    # json
    "jsonb_path_exists": _jsonb("tessera_jsonb_path_exists"), "jsonb_path_match": _jsonb("tessera_jsonb_path_match"), "jsonb_path_query_array": _jsonb("tessera_jsonb_path_query", "concat('[', array_join({}, ', '), ']')"), "jsonb_path_query_first": _jsonb("tessera_jsonb_path_query", "get({}, 0)"),
    "jsonb_typeof": E("tessera_jsonb_typeof({0})"), "json_typeof": E("tessera_jsonb_typeof({0})"), "json_array_length": E("json_array_length({0})"), "jsonb_array_length": E("json_array_length({0})"),
    # network
    "host": E("tessera_inet('host', {0})"), "masklen": E("CAST(tessera_inet('masklen', {0}) AS INT)"), "family": E("CAST(tessera_inet('family', {0}) AS INT)"), "network": E("tessera_inet('network', {0})"), "abbrev": E("tessera_inet('abbrev', {0})"), "broadcast": E("tessera_inet('broadcast', {0})"), "netmask": E("tessera_inet('netmask', {0})"),
    # bit strings
    "get_bit": E("CAST(substring({0}, {1} + 1, 1) AS INT)"), "set_bit": E("overlay({0} PLACING CAST({2} AS STRING) FROM {1} + 1 FOR 1)"), "bit_count": E("CAST(length(replace({0}, '0', '')) AS BIGINT)"),
    # session
    "pg_typeof": _typeof, "version": LIT("'Tessera on Spark'"), "current_database": LIT("'tessera'"), "current_catalog": LIT("'tessera'"), "current_schema": LIT("'public'"), "session_user": LIT("current_user()"), "user": LIT("current_user()"), "current_role": LIT("current_user()"), "pg_backend_pid": LIT("1"), "pg_is_in_recovery": LIT("FALSE"), "pg_size_pretty": E("tessera_size_pretty(CAST({0} AS BIGINT))"),
    "pg_input_is_valid": lambda a, l, t: f"(try_cast({a[0]} AS {spark_type(l[1])}) IS NOT NULL)",
    "current_schemas": E("CASE WHEN {0} THEN array('pg_catalog', 'public') ELSE array('public') END"), "pg_my_temp_schema": LIT("0L"), "pg_is_other_temp_schema": E("({0} IS NULL AND NULL)"), "pg_postmaster_start_time": LIT(f"timestamp_millis({int(time.time() * 1000)}L)"),
    "pg_encoding_to_char": lambda a, l, t: f"coalesce(element_at({ENCODING_NAMES}, CAST({a[0]} AS INT)), '')", "pg_char_to_encoding": lambda a, l, t: f"coalesce(element_at({ENCODING_NUMBERS}, replace(upper({a[0]}), '-', '')), -1)",
    "pg_tablespace_location": E("CASE WHEN {0} IS NOT NULL THEN '' END"), "pg_get_userbyid": E("concat('unknown (OID=', CAST({0} AS STRING), ')')"), "xid8cmp": E("CASE WHEN {0} < {1} THEN -1 WHEN {0} > {1} THEN 1 WHEN {0} = {1} THEN 0 END"),
    "tid_block": E("CAST(regexp_extract({0}, '^\\\\((\\\\d+),', 1) AS BIGINT)"), "tid_offset": E("CAST(regexp_extract({0}, ',(\\\\d+)\\\\)', 1) AS INT)"),
    "pg_xact_status": E("CASE WHEN {0} IS NOT NULL THEN 'committed' END"), "format_type": lambda a, l, t: f"coalesce(element_at({TYPE_NAMES}, CAST({a[0]} AS INT)), CASE WHEN {a[0]} IS NOT NULL THEN '???' END)",
    "num_nulls": lambda a, l, t: "(" + " + ".join(f"CASE WHEN {x} IS NULL THEN 1 ELSE 0 END" for x in a) + ")", "num_nonnulls": lambda a, l, t: "(" + " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END" for x in a) + ")",
}


#: Least and most arguments of the functions that are not made from a template with a fixed number of places.
ARITY = {
    **dict.fromkeys("ceil ceiling floor sqrt ln log10 asin acos acosh atanh sind cosd tand cotd asind acosd atand length pg_typeof pg_encoding_to_char pg_char_to_encoding".split(), (1, 1)),
    **dict.fromkeys("round trunc log btrim ltrim rtrim age to_timestamp".split(), (1, 2)), **dict.fromkeys("extract date_part to_char to_date encode decode format_type pg_input_is_valid".split(), (2, 2)),
    **dict.fromkeys("substring substr lpad rpad regexp_match regexp_split_to_array regexp_like".split(), (2, 3)), "power": (2, 2), "pow": (2, 2), "to_hex": (1, 1), "overlay": (3, 4), "position": (2, 2),
    "date_trunc": (2, 3), "date_bin": (3, 3), "regexp_replace": (3, 6), "regexp_count": (2, 4), "regexp_substr": (2, 6), "regexp_instr": (2, 7), "array_to_string": (2, 3), "make_interval": (0, 7), "width_bucket": (2, 4),
    "make_timestamp": (6, 6), "make_timestamptz": (6, 7), "concat": (1, 999), "concat_ws": (1, 999), "num_nulls": (1, 999), "num_nonnulls": (1, 999),
}


def scalar(name: str, a: list[str], literal: list, types: list) -> str:
    least, most = ARITY.get(name, (0, 999))
    if not least <= len(a) <= most:
        raise SqlError(f"function {name} does not exist with {len(a)} arguments", "42883")
    if name == "format":
        rest = ", ".join(f"CAST({x} AS STRING)" for x in a[1:])
        return f"tessera_format({a[0]}, array({rest}))" if rest else f"tessera_format({a[0]}, CAST(array() AS ARRAY<STRING>))"
    if name in SCALARS:
        try:
            return SCALARS[name](a, literal, types)
        except IndexError:
            raise SqlError(f"function {name} does not exist with {len(a)} arguments", "42883") from None
    if name in SAME:
        return f"{name}({', '.join(a)})"
    if name.startswith("tessera_"):
        return f"{name}({', '.join(a)})"
    raise SqlError(f"function {name} does not exist", "42883")
