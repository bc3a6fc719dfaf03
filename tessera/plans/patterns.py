"""Pattern and literal translation: regular expressions, SIMILAR TO, intervals."""

from __future__ import annotations

import re

#: POSIX classes and their Java spelling (fixed values).
CLASSES = {"alpha": r"\p{Alpha}", "digit": r"\d", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "blank": r" \t", "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}", "word": r"\w"}
#: Escapes for word edges: start, end, either, neither (fixed values).
EDGES = {"m": r"\b(?=\w)", "M": r"\b(?<=\w)", "y": r"\b", "Y": r"\B", "A": r"\A", "Z": r"\z"}


def java(pattern: str, flags: str = "") -> str:
    """An advanced regular expression as a Java one."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(EDGES.get(pattern[i + 1], pattern[i : i + 2]))
            i += 2
        elif m := re.match(r"\[:(\w+):\]", pattern[i:]):
            out.append(CLASSES.get(m[1], m[0]))
            i += m.end()
        else:
            out.append(c)
            i += 1
    inline = "".join(j for f, j in (("i", "i"), ("x", "x"), ("n", "m"), ("m", "m")) if f in flags)
    return (f"(?{inline})" if inline else "") + "".join(out)


def similar(pattern: str, escape: str = "\\") -> str:
    """A SIMILAR TO pattern as an anchored Java regular expression."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 1
        elif inside:
            inside = c != "]"
            out.append(c)
        elif c == "[":
            inside = True
            out.append(c)
        elif c in "%_":
            out.append(".*" if c == "%" else ".")
        elif c in "|*+?{}()":
            out.append("(?:" if c == "(" else c)
        elif c.isalnum() or c.isspace():
            out.append(c)
        else:
            out.append("\\" + c)
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def replacement(text: str) -> str:
    r"""A replacement's \1 and \& as Java's $1 and $0."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            n = text[i + 1]
            out.append("$" + n if n.isdigit() else "$0" if n == "&" else "\\\\")
            i += 2
            continue
        out.append("\\$" if c == "$" else c)
        i += 1
    return "".join(out)


#: Microseconds of the clock units and months of the calendar units (fixed values).
CLOCK = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6}
CALENDAR = {"month": 1, "year": 12, "decade": 120, "century": 1200, "millennium": 12000}
SHORT = {"us": "microsecond", "usec": "microsecond", "ms": "millisecond", "msec": "millisecond", "s": "second", "sec": "second", "min": "minute", "m": "minute", "h": "hour", "hr": "hour", "d": "day", "w": "week", "mon": "month", "mons": "month", "y": "year", "yr": "year", "centuries": "century", "millennia": "millennium"}


def parse_interval(text: str, fields: tuple = ()) -> tuple[int, int, int]:
    """(months, days, microseconds) of an interval literal."""
    months = days = micros = 0.0
    sign = 1
    body = text.strip().lower()
    if body.startswith("@"):
        body = body[1:].strip()
    if body.endswith(" ago"):
        sign, body = -1, body[:-4]
    if m := re.fullmatch(r"p(?:(-?[\d.]+)y)?(?:(-?[\d.]+)m)?(?:(-?[\d.]+)w)?(?:(-?[\d.]+)d)?(?:t(?:(-?[\d.]+)h)?(?:(-?[\d.]+)m)?(?:(-?[\d.]+)s)?)?", body):
        y, mo, w, d, h, mi, s = (float(x or 0) for x in m.groups())
        return int(12 * y + mo), int(7 * w + d), round((h * 3600 + mi * 60 + s) * 10**6)
    if re.fullmatch(r"-?[\d.]+", body) and fields:
        body += " " + fields[-1]
    elif re.fullmatch(r"-?[\d.]+", body):
        body += " second"
    at = 0
    token = re.compile(r"\s*(?:([+-]?)(\d+):(\d+)(?::(\d+(?:\.\d*)?))?|([+-]?(?:\d+\.?\d*|\.\d+))\s*([a-z]+)|([+-]?\d+)-(\d+))")
    while at < len(body.rstrip()):
        m = token.match(body, at)
        if not m:
            raise ValueError(f'invalid input syntax for type interval: "{text}"')
        at = m.end()
        if m[2]:
            micros += (-1 if m[1] == "-" else 1) * (int(m[2]) * 3600 + int(m[3]) * 60 + float(m[4] or 0)) * 10**6
        elif m[7]:
            months += int(m[7]) * 12 + (-1 if m[7].startswith("-") else 1) * int(m[8])
        else:
            v, unit = float(m[5]), m[6]
            unit = SHORT.get(unit, unit)
            unit = SHORT.get(unit, unit[:-1] if unit.endswith("s") else unit)
            if unit in CLOCK:
                micros += v * CLOCK[unit]
            elif unit in ("day", "week"):
                v *= 7 if unit == "week" else 1
                days += int(v)
                micros += round((v - int(v)) * 86400 * 10**6)
            elif unit in CALENDAR:
                v *= CALENDAR[unit]
                months += int(v)
                days += int(round((v - int(v)) * 30, 6))
            else:
                raise ValueError(f'invalid input syntax for type interval: "{text}"')
    return sign * int(months), sign * int(days), sign * round(micros)


def interval_literal(text: str, fields: tuple = ()) -> str:
    """A Spark interval: of months, of days and time, or a calendar interval where both occur."""
    months, days, micros = parse_interval(text, fields)
    if months and not (days or micros):
        return f"INTERVAL '{months}' MONTH"
    total = days * 86400 * 10**6 + micros
    if not months:
        s = "-" if total < 0 else ""
        d, rest = divmod(abs(total), 86400 * 10**6)
        h, rest = divmod(rest, 3600 * 10**6)
        m, rest = divmod(rest, 60 * 10**6)
        return f"INTERVAL '{s}{d} {h:02}:{m:02}:{rest // 10**6:02}.{rest % 10**6:06}' DAY TO SECOND"
    return f"make_interval(0, {months}, 0, {days}, 0, 0, CAST({micros / 10**6:.6f} AS DECIMAL(18,6)))"
