"""Input forms of the types that Spark lacks. parse(kind, text) gives plain Python values of the types' shapes:
geometric values as nested dicts, clock times and addresses as numbers, network addresses as canonical text.
"""

from __future__ import annotations

import ipaddress
import re
from decimal import Decimal

from ..plans.patterns import parse_interval
from . import textsearch

POINT = "struct<x:double,y:double>"
#: The Spark types by which the SQL front end knows them (fixed values).
SHAPES = {
    "point": POINT,
    "lseg": f"struct<a:{POINT},b:{POINT}>",
    "box": f"struct<high:{POINT},low:{POINT}>",
    "line": "struct<a:double,b:double,c:double>",
    "circle": f"struct<center:{POINT},radius:double>",
    "path": f"struct<closed:boolean,points:array<{POINT}>>",
    "polygon": f"struct<points:array<{POINT}>>",
    "interval": "struct<months:int,days:int,micros:bigint>",
    "time": "struct<time:bigint>",
    "money": "struct<cents:bigint>",
    "inet": "struct<inet:string>",
    "cidr": "struct<cidr:string>",
    "macaddr": "struct<mac:bigint>",
    "macaddr8": "struct<mac8:decimal(20,0)>",
    "pg_lsn": "struct<lsn:decimal(20,0)>",
    "tsvector": textsearch.VECTOR,
    "tsquery": "struct<tsquery:string>",
}
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


class InputError(ValueError):
    """Text that is no value of the type."""


def _bad(kind: str, text: str) -> InputError:
    return InputError(f'invalid input syntax for type {kind}: "{text}"')


def _points(kind: str, text: str, least: int, most: int | None = None) -> list[dict]:
    shape = re.sub(NUMBER, "n", text)
    numbers = list(map(float, re.findall(NUMBER, text)))
    if re.sub(r"[\s(),\[\]]", "", shape).strip("n") or len(numbers) % 2 or len(numbers) < 2 * least or (most and len(numbers) > 2 * most):
        raise _bad(kind, text)
    return [{"x": x, "y": y} for x, y in zip(numbers[::2], numbers[1::2], strict=True)]


def _corners(p: dict, q: dict) -> dict:
    return {"high": {k: max(p[k], q[k]) for k in "xy"}, "low": {k: min(p[k], q[k]) for k in "xy"}}


def _line(text: str) -> dict:
    if m := re.fullmatch(rf"\s*\{{\s*({NUMBER})\s*,\s*({NUMBER})\s*,\s*({NUMBER})\s*\}}\s*", text):
        return dict(zip("abc", map(float, m.groups()), strict=True))
    p, q = _points("line", text, 2, 2)
    if abs(p["x"] - q["x"]) <= 1e-6:
        return {"a": -1.0, "b": 0.0, "c": p["x"]}
    m = (q["y"] - p["y"]) / (q["x"] - p["x"])
    return {"a": m, "b": -1.0, "c": p["y"] - m * p["x"]}


def _time(text: str) -> dict:
    m = re.fullmatch(r"\s*(?:\d{4}-\d\d-\d\d\s+)?(\d{1,2}):(\d\d)(?::(\d\d(?:\.\d*)?))?\s*([aApP][mM])?\s*", text)
    if not m or int(m[2]) > 59 or float(m[3] or 0) >= 61 or int(m[1]) > 24:
        raise _bad("time", text)
    hour = int(m[1]) % 12 + 12 * (m[4].lower() == "pm") if m[4] else int(m[1])
    micros = (hour * 60 + int(m[2])) * 60 * 10**6 + round(Decimal(m[3] or 0) * 10**6)
    if micros > 24 * 3600 * 10**6:
        raise _bad("time", text)
    return {"time": micros}


def _money(text: str) -> dict:
    m = re.fullmatch(r"\s*(\()?\s*(-)?\s*\$?\s*(-)?([\d,]*\.?\d*)\s*\)?\s*", text)
    if not m or not re.search(r"\d", m[4]):
        raise _bad("money", text)
    cents = int((Decimal(m[4].replace(",", "")) * 100).quantize(Decimal(1), "ROUND_HALF_UP"))
    return {"cents": -cents if m[1] or m[2] or m[3] else cents}


def _inet(text: str) -> dict:
    try:
        i = ipaddress.ip_interface(text.strip())
    except ValueError:
        raise _bad("inet", text) from None
    return {"inet": str(i.ip) if i.network.prefixlen == i.max_prefixlen else str(i)}


def _cidr(text: str) -> dict:
    body, _, bits = text.strip().partition("/")
    if ":" not in body:
        octets = body.split(".")
        bits = bits or str(8 * len(octets) if len(octets) < 4 else 32)
        body = ".".join(octets + ["0"] * (4 - len(octets)))
    try:
        return {"cidr": str(ipaddress.ip_network(f"{body}/{bits or 128}"))}
    except ValueError as e:
        raise _bad("cidr", text) from e


def _mac(text: str, digits: int) -> int:
    body = re.sub(r"[:.\-\s]", "", text)
    if digits == 16 and len(body) == 12:
        body = body[:6] + "fffe" + body[6:]
    if not re.fullmatch(rf"[0-9a-fA-F]{{{digits}}}", body):
        raise _bad("macaddr" if digits == 12 else "macaddr8", text)
    return int(body, 16)


def _lsn(text: str) -> dict:
    m = re.fullmatch(r"([0-9a-fA-F]{1,8})/([0-9a-fA-F]{1,8})", text.strip())
    if not m:
        raise _bad("pg_lsn", text)
    return {"lsn": Decimal((int(m[1], 16) << 32) + int(m[2], 16))}


def _circle(text: str) -> dict:
    n = list(map(float, re.findall(NUMBER, text)))
    if len(n) != 3 or n[2] < 0 or re.sub(rf"{NUMBER}|[\s<>(),]", "", text):
        raise _bad("circle", text)
    return {"center": {"x": n[0], "y": n[1]}, "radius": n[2]}


def _interval(text: str) -> dict:
    try:
        months, days, micros = parse_interval(text)
    except ValueError:
        raise _bad("interval", text) from None
    return {"months": months, "days": days, "micros": micros}


PARSERS = {
    "point": lambda t: _points("point", t, 1, 1)[0],
    "lseg": lambda t: dict(zip("ab", _points("lseg", t, 2, 2), strict=True)),
    "box": lambda t: _corners(*_points("box", t, 2, 2)),
    "line": _line,
    "circle": _circle,
    "path": lambda t: {"closed": not t.strip().startswith("["), "points": _points("path", t, 1)},
    "polygon": lambda t: {"points": _points("polygon", t, 1)},
    "interval": _interval,
    "time": _time,
    "money": _money,
    "inet": _inet,
    "cidr": _cidr,
    "macaddr": lambda t: {"mac": _mac(t, 12)},
    "macaddr8": lambda t: {"mac8": Decimal(_mac(t, 16))},
    "pg_lsn": _lsn,
    "tsquery": lambda t: {"tsquery": textsearch.show(textsearch.parse_query(t))},
}


def parse(kind: str, text: str | None):
    return None if text is None else PARSERS[kind](text)


OCTETS = {str(i): i for i in range(256)}


def v4(text: str) -> tuple[int, int] | None:
    """(address, length of the prefix) of a plain IPv4 text, or None for any other: ipaddress makes objects for the
    address, the network and its masks, some ten times the work."""
    host, slash, bits = text.partition("/")
    try:
        a, b, c, d = map(OCTETS.__getitem__, host.split("."))
    except (KeyError, ValueError):
        return None
    if not slash:
        return a << 24 | b << 16 | c << 8 | d, 32
    n = OCTETS.get(bits, 33)
    return (a << 24 | b << 16 | c << 8 | d, n) if n <= 32 else None


def v4_text(address: int, bits: int = 32) -> str:
    host = f"{address >> 24}.{address >> 16 & 255}.{address >> 8 & 255}.{address & 255}"
    return host if bits == 32 else f"{host}/{bits}"


def v4_network(address: int, bits: int) -> int:
    return address >> 32 - bits << 32 - bits


def inet_key(text: str | None) -> bytes | None:
    """Bytes in the order of network addresses: family, network, length of the prefix, address."""
    if text is None:
        return None
    if known := v4(text):
        return b"\x04" + v4_network(*known).to_bytes(4) + bytes([known[1]]) + known[0].to_bytes(4)
    i = ipaddress.ip_interface(text)
    return bytes([i.version]) + i.network.network_address.packed + bytes([i.network.prefixlen]) + i.ip.packed


def abbreviated(text: str | None) -> str | None:
    """A network without the octets that its prefix does not reach."""
    if text is None:
        return None
    if (known := v4(text)) and v4_network(*known) == known[0]:
        return ".".join(v4_text(known[0]).split(".")[: max(1, -(-known[1] // 8))]) + f"/{known[1]}"
    n = ipaddress.ip_network(text)
    if n.version == 6:
        return str(n)
    octets = str(n.network_address).split(".")
    return ".".join(octets[: max(1, -(-n.prefixlen // 8))]) + f"/{n.prefixlen}"
