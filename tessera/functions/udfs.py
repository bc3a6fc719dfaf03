"""Functions that no Catalyst expression provides, as Arrow-batched Python functions named tessera_*."""

from __future__ import annotations

import ipaddress
import json
import math
import re
import struct
from datetime import datetime
from decimal import Decimal
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from . import jsonpath, textsearch, values


def fmt(pattern, args):
    """format(): %s, %I and %L with positions and widths."""
    if pattern is None:
        return None
    out, at, args = [], 0, list(args or [])
    for m in re.finditer(r"%(?:(\d+)\$)?(-)?(\d+)?([sIL%])", pattern):
        literal = pattern[: m.start()] if not out else pattern[last : m.start()]
        out.append(literal)
        last = m.end()
        if m[4] == "%":
            out.append("%")
            continue
        if m[1]:
            at = int(m[1])
        else:
            at += 1
        if at > len(args):
            raise ValueError("too few arguments for format()")
        v = args[at - 1]
        if m[4] == "s":
            v = "" if v is None else v
        elif m[4] == "I":
            if v is None:
                raise ValueError("null values cannot be formatted as an SQL identifier")
            v = v if re.fullmatch("[a-z_][a-z0-9_$]*", v) else '"' + v.replace('"', '""') + '"'
        else:
            v = "NULL" if v is None else "'" + v.replace("'", "''") + "'"
        if m[3]:
            v = v.ljust(int(m[3])) if m[2] else v.rjust(int(m[3]))
        out.append(v)
    return "".join(out) + (pattern[last:] if out else pattern)


MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


def to_char_time(t, pattern):
    """to_char of a timestamp by its template patterns."""
    if t is None or pattern is None:
        return None
    h12 = t.hour % 12 or 12
    values = {
        "HH24": f"{t.hour:02}", "HH12": f"{h12:02}", "HH": f"{h12:02}", "MI": f"{t.minute:02}", "SS": f"{t.second:02}", "SSSS": str(t.hour * 3600 + t.minute * 60 + t.second),
        "MS": f"{t.microsecond // 1000:03}", "US": f"{t.microsecond:06}", "YYYY": f"{t.year:04}", "YYY": f"{t.year % 1000:03}", "YY": f"{t.year % 100:02}", "Y": str(t.year % 10),
        "MM": f"{t.month:02}", "DD": f"{t.day:02}", "DDD": f"{t.timetuple().tm_yday:03}", "D": str(t.isoweekday() % 7 + 1), "ID": str(t.isoweekday()),
        "MONTH": MONTHS[t.month - 1].upper().ljust(9), "Month": MONTHS[t.month - 1].ljust(9), "month": MONTHS[t.month - 1].lower().ljust(9),
        "MON": MONTHS[t.month - 1][:3].upper(), "Mon": MONTHS[t.month - 1][:3], "mon": MONTHS[t.month - 1][:3].lower(),
        "DAY": DAYS[t.weekday()].upper().ljust(9), "Day": DAYS[t.weekday()].ljust(9), "day": DAYS[t.weekday()].lower().ljust(9),
        "DY": DAYS[t.weekday()][:3].upper(), "Dy": DAYS[t.weekday()][:3], "dy": DAYS[t.weekday()][:3].lower(),
        "AM": "AM" if t.hour < 12 else "PM", "PM": "AM" if t.hour < 12 else "PM", "am": "am" if t.hour < 12 else "pm", "pm": "am" if t.hour < 12 else "pm",
        "Q": str((t.month + 2) // 3), "WW": f"{(t.timetuple().tm_yday + 6) // 7:02}", "IW": f"{t.isocalendar()[1]:02}", "IYYY": f"{t.isocalendar()[0]:04}", "CC": f"{(t.year + 99) // 100:02}",
        "J": str(t.toordinal() + 1721425),
    }
    names = sorted(values, key=len, reverse=True)
    token = re.compile('"([^"]*)"|(FM)?(' + "|".join(names) + ")(TH|th)?")

    def one(m):
        if m[3] is None:
            return m[1]
        v = values[m[3]]
        if m[2]:
            v = v.strip().lstrip("0") or "0"
        if m[4]:
            n = int(v)
            end = "th" if 10 <= n % 100 <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
            v += end.upper() if m[4] == "TH" else end
        return v

    return token.sub(one, pattern)


def to_char_number(text, pattern):
    """to_char of a number: 9 0 . , G D FM S MI PR."""
    if text is None or pattern is None:
        return None
    fill = not pattern.upper().startswith("FM")
    body = re.sub("(?i)FM", "", pattern)
    pr, mi, sign = "PR" in body.upper(), "MI" in body.upper(), "S" in body.upper()
    digits = re.sub("(?i)PR|MI|S|TH", "", body).replace("G", ",").replace("D", ".")
    whole, _, part = digits.partition(".")
    places = len(re.findall("[90]", part))
    v = Decimal(text).quantize(Decimal(1).scaleb(-places), rounding="ROUND_HALF_UP")
    negative, v = v < 0, abs(v)
    i, _, f = f"{v:f}".partition(".")
    slots = [c for c in whole if c in "90"]
    if len(i) > len(slots) and i != "0":
        i, f = "#" * len(slots), "#" * places
    least = len(slots) - slots.index("0") if "0" in slots else 0
    i = ("" if i == "0" and not least and places else i).rjust(least, "0")
    out, k = [], len(i)
    for c in reversed(whole):
        if c in "90":
            k -= 1
            out.append(i[k] if k >= 0 else " ")
        elif c == ",":
            out.append("," if k > 0 else " ")
        else:
            out.append(c)
    text = "".join(reversed(out))
    if part:
        if not fill:
            keep = max((j + 1 for j, c in enumerate(part) if c == "0"), default=0)
            while len(f) > keep and f.endswith("0"):
                f = f[:-1]
        text += "." + f
    bare = text.lstrip(" ")
    gap = len(text) - len(bare)
    if pr:
        text = " " * gap + (f"<{bare}>" if negative else f" {bare} ")
    elif mi:
        text = " " * gap + bare + ("-" if negative else " ")
    elif sign:
        text = " " * gap + ("-" if negative else "+") + bare
    else:
        text = " " * gap + ("-" if negative else " ") + bare
    return text if fill else text.strip()


def to_number(text, pattern):
    if text is None:
        return None
    v = re.sub(r"[^0-9.+\-<>]", "", text)
    sign = -1 if "-" in v or "<" in v else 1
    return str(sign * Decimal(re.sub(r"[^0-9.]", "", v) or "0"))


def to_timestamp(text, pattern):
    if text is None or pattern is None:
        return None
    table = {"HH24": "%H", "HH12": "%I", "HH": "%I", "MI": "%M", "SS": "%S", "YYYY": "%Y", "MM": "%m", "DD": "%d", "Month": "%B", "MONTH": "%B", "Mon": "%b", "MON": "%b", "AM": "%p", "PM": "%p", "DDD": "%j", "US": "%f", "Day": "%A", "Dy": "%a", "DY": "%a", "YY": "%y"}
    p = re.sub("|".join(sorted(table, key=len, reverse=True)), lambda m: table[m[0]], pattern)
    t = datetime.strptime(re.sub(r"\s+", " ", text.strip()), re.sub(r"\s+", " ", p))
    if "YY" in pattern and "YYYY" not in pattern:  # two digits: 70 to 69 of the next century
        y = t.year % 100
        t = t.replace(year=(1900 if y >= 70 else 2000) + y)
    return t.replace(tzinfo=UTC)


def escape(data):
    return None if data is None else "".join(chr(b) if 32 <= b < 127 and b != 92 else "\\\\" if b == 92 else f"\\{b:03o}" for b in data)


def unescape(text):
    return None if text is None else re.sub(rb"\\(\\|[0-7]{3})", lambda m: b"\\" if m[1] == b"\\" else bytes([int(m[1], 8)]), text.encode())


def inet(what, text):
    if text is None:
        return None
    if known := values.v4(text):
        if what == "host":
            return values.v4_text(known[0])
        if what == "network":
            return f"{values.v4_text(values.v4_network(*known))}/{known[1]}"
    i = ipaddress.ip_interface(text)
    return {
        "host": lambda: str(i.ip), "masklen": lambda: str(i.network.prefixlen), "family": lambda: "4" if i.version == 4 else "6", "network": lambda: str(i.network),
        "plain": lambda: str(i.ip) if i.network.prefixlen == i.max_prefixlen else str(i), "text": lambda: str(i), "hostmask": lambda: str(i.hostmask),
        "abbrev": lambda: str(i.ip) if i.network.prefixlen == i.max_prefixlen else str(i), "broadcast": lambda: f"{i.network.broadcast_address}/{i.network.prefixlen}", "netmask": lambda: str(i.netmask),
    }[what]()


def _v4_op(op, address, bits, b):
    """inet_op of an IPv4 address, or None where b or the result is none."""
    if "." not in b and ":" not in b:
        if op not in ("+", "-") or not re.fullmatch(r"-?\d+", b):
            return None
        moved = address + (int(b) if op == "+" else -int(b))
        return values.v4_text(moved, bits) if 0 <= moved < 1 << 32 else None
    if not (other := values.v4(b)):
        return None
    if op == "-":
        return str(address - other[0])
    if op in ("&", "|"):
        return values.v4_text(address & other[0] if op == "&" else address | other[0], bits)
    least = min(bits, other[1])
    if values.v4_network(address, least) != values.v4_network(other[0], least):
        return "f"
    return "t" if {"<<": bits > other[1], "<<=": bits >= other[1], ">>": bits < other[1], ">>=": bits <= other[1], "&&": True}[op] else "f"


def inet_op(op, a, b):
    """inet operators: << <<= >> >>= && as text "t"/"f"; & | ~ + - as addresses or numbers."""
    if a is None or (b is None and op != "~"):
        return None
    if op != "~" and (known := values.v4(a)) and (out := _v4_op(op, *known, b)) is not None:
        return out
    x = ipaddress.ip_interface(a)
    tail = "" if x.network.prefixlen == x.max_prefixlen else f"/{x.network.prefixlen}"
    if op == "~":
        return f"{ipaddress.ip_address(int(x.ip) ^ ((1 << x.max_prefixlen) - 1))}{tail}"
    if op in ("+", "-") and re.fullmatch(r"-?\d+", b):
        return f"{x.ip + (int(b) if op == '+' else -int(b))}{tail}"
    y = ipaddress.ip_interface(b)
    if op == "-":
        return str(int(x.ip) - int(y.ip))
    if op in ("&", "|"):
        v = int(x.ip) & int(y.ip) if op == "&" else int(x.ip) | int(y.ip)
        return f"{ipaddress.ip_address(v)}{tail}"
    same = x.version == y.version
    inside = same and x.network.subnet_of(y.network)
    around = same and y.network.subnet_of(x.network)
    value = {"<<": inside and x.network != y.network, "<<=": inside, ">>": around and x.network != y.network, ">>=": around, "&&": inside or around}[op]
    return "t" if value else "f"


def inet_set(text, bits, is_network):
    """The address with another prefix; a network loses the bits behind it."""
    if 0 <= bits <= 32 and (known := values.v4(text)):
        return f"{values.v4_text(values.v4_network(known[0], bits))}/{bits}" if is_network else values.v4_text(known[0], bits)
    i = ipaddress.ip_interface(f"{ipaddress.ip_interface(text).ip}/{bits if bits >= 0 else ipaddress.ip_interface(text).max_prefixlen}")
    return str(i.network) if is_network else inet("plain", str(i))


def inet_merge(a, b):
    """The smallest network that holds both."""
    x, y = ipaddress.ip_interface(a).network, ipaddress.ip_interface(b).network
    if x.version != y.version:
        raise ValueError("cannot merge addresses from different families")
    while not (y.subnet_of(x)):
        x = x.supernet()
    return str(x)


ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()


def _below_thousand(n):
    out = [ONES[n // 100] + " hundred"] if n >= 100 else []
    n %= 100
    if n >= 20:
        out.append(TENS[n // 10] + (f" {ONES[n % 10]}" if n % 10 else ""))
    elif n or not out:
        out.append(ONES[n])
    return " ".join(out)


def cash_words(cents):
    """An amount of money in words."""
    sign, cents = ("minus " if cents < 0 else ""), abs(cents)
    whole, rest, parts = cents // 100, cents % 100, []
    for size, name in ((10**15, " quadrillion"), (10**12, " trillion"), (10**9, " billion"), (10**6, " million"), (1000, " thousand"), (1, "")):
        if whole >= size:
            parts.append(_below_thousand(whole // size) + name)
            whole %= size
    dollars = " ".join(parts) or "zero"
    text = f"{sign}{dollars} dollar{'' if cents // 100 == 1 else 's'} and {_below_thousand(rest)} cent{'' if rest == 1 else 's'}"
    return text[0].upper() + text[1:]


def crc32c(data):
    if data is None:
        return None
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def json_path(text, steps, as_text):
    """The value at a path of keys and positions (negative ones from the end)."""
    if text is None or steps is None:
        return None
    v = json.loads(text)
    for s in [x.strip().strip('"') for x in steps.strip("{}").split(",")] if steps != "{}" else []:
        if isinstance(v, dict) and s in v:
            v = v[s]
        elif isinstance(v, list) and re.fullmatch(r"-?\d+", s) and -len(v) <= int(s) < len(v):
            v = v[int(s)]
        else:
            return None
    if as_text:
        return None if v is None else v if isinstance(v, str) else jsonpath.dump(v)
    return jsonpath.dump(v)


def jsonb_contains(a, b):
    def inside(x, y):
        if isinstance(x, dict) and isinstance(y, dict):
            return all(k in x and inside(x[k], v) for k, v in y.items())
        if isinstance(x, list) and isinstance(y, list):
            return all(any(inside(e, v) for e in x) for v in y)
        return type(x) is type(y) and x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool) and not isinstance(y, bool) and x == y)

    return None if a is None or b is None else inside(json.loads(a), json.loads(b))


def jsonb_canonical(text):
    """The canonical text: keys by length, then bytes; the last of duplicate keys wins."""
    return None if text is None else jsonpath.dump(json.loads(text))


def jsonb_typeof(text):
    if text is None:
        return None
    v = json.loads(text)
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def regexp_replace(text, pattern, repl, flags):
    if None in (text, pattern, repl):
        return None
    r = re.sub(r"\\(\d|&)", lambda m: rf"\g<{0 if m[1] == '&' else m[1]}>", repl)
    return re.sub(pattern, r, text, count=0 if "g" in flags else 1, flags=re.I if "i" in flags else 0)


def size_pretty(n):
    if n is None:
        return None
    unit, v = "bytes", float(n)
    for unit in ("bytes", "kB", "MB", "GB", "TB", "PB"):
        if abs(v) < 10240 or unit == "PB":
            break
        v /= 1024
    return f"{int(v + (0.5 if v >= 0 else -0.5))} {unit}"


def _path_match(doc, path, variables, silent):
    try:
        return jsonpath.match(json.loads(doc), path, json.loads(variables))
    except jsonpath.JsonPathError:
        if silent:
            return None
        raise


def _safe(f):
    return lambda *a: None if any(x is None for x in a) else f(*a)


def _lgamma(x):
    return math.inf if x <= 0 and x == int(x) else math.lgamma(x)


S, D, L, B, I = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.IntegerType()  # noqa: E741
FUNCTIONS = {
    "format": (fmt, S), "to_char_time": (to_char_time, S), "to_char_number": (to_char_number, S), "to_number": (to_number, S), "to_timestamp": (to_timestamp, T.TimestampType()),
    "escape": (escape, S), "unescape": (unescape, T.BinaryType()), "inet": (inet, S), "inet_op": (inet_op, S), "crc32c": (crc32c, L), "json_path": (json_path, S), "jsonb_contains": (jsonb_contains, B),
    "jsonb_canonical": (jsonb_canonical, S), "jsonb_typeof": (jsonb_typeof, S), "regexp_replace": (regexp_replace, S), "size_pretty": (size_pretty, S), "chr": (_safe(chr), S),
    "gcd": (_safe(math.gcd), L), "lcm": (_safe(math.lcm), L), "erf": (_safe(math.erf), D), "erfc": (_safe(math.erfc), D), "gamma": (_safe(math.gamma), D), "lgamma": (_safe(_lgamma), D),
    "float4send": (_safe(lambda x: struct.pack(">f", x)), T.BinaryType()), "float8send": (_safe(lambda x: struct.pack(">d", x)), T.BinaryType()),
    "jsonb_path_query": (_safe(lambda t, p, v, s: [jsonpath.dump(x) for x in jsonpath.query(json.loads(t), p, json.loads(v), s)]), T.ArrayType(S)),
    "jsonb_path_exists": (_safe(lambda t, p, v, s: bool(jsonpath.query(json.loads(t), p, json.loads(v), s))), B), "jsonb_path_match": (_safe(_path_match), B),
    "inet_key": (values.inet_key, T.BinaryType()), "abbreviated": (values.abbreviated, S), "inet_set": (_safe(inet_set), S), "inet_merge": (_safe(inet_merge), S), "cash_words": (_safe(cash_words), S),
    "numnode": (_safe(textsearch.n_nodes), I), "querytree": (_safe(textsearch.query_tree), S), "tsquery_phrase": (_safe(textsearch.phrase), S),
    **{f"to_{k}": (partial(values.parse, k), values.SHAPES[k]) for k in values.PARSERS},
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL, once."""
    if spark.catalog.functionExists("tessera_format"):
        return
    ship(spark)
    for name, (f, kind) in FUNCTIONS.items():
        spark.udf.register(f"tessera_{name}", F.udf(f, kind, useArrow=True))
