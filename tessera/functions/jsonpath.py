"""The SQL/JSON path language: accessors, filters, arithmetic and methods, in lax and strict mode."""

from __future__ import annotations

import json
import math
import re

TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|(\d+\.?\d*(?:[eE][+-]?\d+)?)|(\$[A-Za-z_]\w*|\$)|(like_regex|starts|with|exists|is|unknown|true|false|null|last|to|flag|strict|lax)\b|([A-Za-z_]\w*)|(\*\*|&&|\|\||==|!=|<>|<=|>=|[-+*/%.,()\[\]{}?@!<>=]))')


class JsonPathError(ValueError):
    """A path that does not parse, or a structural error in strict mode."""


def dump(v) -> str:
    """Canonical JSON text: keys by length, then bytes."""
    if isinstance(v, dict):
        keys = sorted(v, key=lambda k: (len(k.encode()), k.encode()))
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {dump(v[k])}" for k in keys) + "}"
    if isinstance(v, list):
        return "[" + ", ".join(map(dump, v)) + "]"
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return str(int(v)) if not math.copysign(1, v) < 0 or v else "0"
    return json.dumps(v, ensure_ascii=False)


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise JsonPathError(f"syntax error in jsonpath at {text[at : at + 10]!r}")
        at = m.end()
        kinds = ("string", "number", "var", "word", "name", "op")
        kind, value = next((k, g) for k, g in zip(kinds, m.groups(), strict=True) if g is not None)
        out.append((kind, value))
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text):
        self.t, self.i = _tokens(text), 0

    def at(self, *v):
        return self.t[self.i][1] in v and self.t[self.i][0] != "string"

    def take(self, *v):
        if self.at(*v):
            self.i += 1
            return self.t[self.i - 1][1]
        return None

    def need(self, v):
        if not self.take(v):
            raise JsonPathError(f"expected {v} in jsonpath, found {self.t[self.i][1]!r}")

    def path(self):
        mode = self.take("strict", "lax") or "lax"
        e = self.either()
        if self.t[self.i][0] != "end":
            raise JsonPathError(f"syntax error in jsonpath at {self.t[self.i][1]!r}")
        return mode, e

    def either(self):
        e = self.both()
        while self.take("||"):
            e = ("or", e, self.both())
        return e

    def both(self):
        e = self.test()
        while self.take("&&"):
            e = ("and", e, self.test())
        return e

    def test(self):
        if self.take("!"):
            return ("not", self.test())
        if self.take("exists"):
            self.need("(")
            e = self.either()
            self.need(")")
            return ("exists", e)
        e = self.sum()
        while True:
            op = self.take("==", "!=", "<>", "<=", ">=", "<", ">", "=")
            if op:
                e = ("cmp", {"<>": "!=", "=": "=="}.get(op, op), e, self.sum())
            elif self.take("starts"):
                self.need("with")
                e = ("starts", e, self.sum())
            elif self.take("like_regex"):
                pattern = json.loads(self.t[self.i][1])
                self.i += 1
                flags = ""
                if self.take("flag"):
                    flags = json.loads(self.t[self.i][1])
                    self.i += 1
                e = ("regex", e, pattern, flags)
            elif self.take("is"):
                self.need("unknown")
                e = ("unknown", e)
            else:
                return e

    def sum(self):
        e = self.product()
        while op := self.take("+", "-"):
            e = ("math", op, e, self.product())
        return e

    def product(self):
        e = self.unary()
        while op := self.take("*", "/", "%"):
            e = ("math", op, e, self.unary())
        return e

    def unary(self):
        if op := self.take("+", "-"):
            return ("sign", op, self.unary())
        return self.steps(self.primary())

    def primary(self):
        kind, v = self.t[self.i]
        self.i += 1
        if kind == "var":
            return ("root",) if v == "$" else ("var", v[1:])
        if v == "@":
            return ("here",)
        if kind == "number":
            return ("value", float(v) if re.search("[.eE]", v) else int(v))
        if kind == "string":
            return ("value", json.loads(v))
        if v in ("true", "false", "null"):
            return ("value", json.loads(v))
        if v == "last":
            return ("last",)
        if v == "(":
            e = self.either()
            self.need(")")
            return e
        raise JsonPathError(f"syntax error in jsonpath at {v!r}")

    def steps(self, e):
        while True:
            if self.take("."):
                if self.take("*"):
                    e = ("members", e)
                elif self.take("**"):
                    lo, hi = 0, None
                    if self.take("{"):
                        lo = self.level()
                        hi = self.level() if self.take("to") else lo
                        self.need("}")
                    e = ("deep", e, lo, hi)
                else:
                    kind, v = self.t[self.i]
                    self.i += 1
                    name = json.loads(v) if kind == "string" else v
                    if kind != "string" and self.take("("):
                        self.need(")")
                        e = ("method", e, name)
                    else:
                        e = ("key", e, name)
            elif self.take("["):
                if self.take("*"):
                    e = ("elements", e)
                else:
                    parts = []
                    while True:
                        a = self.sum()
                        parts.append((a, self.sum() if self.take("to") else None))
                        if not self.take(","):
                            break
                    e = ("index", e, parts)
                self.need("]")
            elif self.take("?"):
                self.need("(")
                e = ("filter", e, self.either())
                self.need(")")
            else:
                return e

    def level(self):
        if self.take("last"):
            return None
        self.i += 1
        return int(self.t[self.i - 1][1])


class _Run:
    def __init__(self, root, strict, variables):
        self.root, self.strict, self.vars = root, strict, variables or {}

    def items(self, e, here, size):
        kind = e[0]
        if kind == "root":
            return [self.root]
        if kind == "here":
            return [here]
        if kind == "value":
            return [e[1]]
        if kind == "var":
            if e[1] not in self.vars:
                raise JsonPathError(f'could not find jsonpath variable "{e[1]}"')
            return [self.vars[e[1]]]
        if kind == "last":
            return [size - 1]
        if kind in ("or", "and", "not", "exists", "cmp", "starts", "regex", "unknown"):
            return [self.truth(e, here, size)]
        if kind == "sign":
            return [self.number(v) if e[1] == "+" else -self.number(v) for v in self.open(self.items(e[2], here, size))]
        if kind == "math":
            a, b = (self.one(self.items(x, here, size)) for x in e[2:])
            if e[1] in "/%" and b == 0:
                raise JsonPathError("division by zero")
            value = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b)}[e[1]]()
            return [int(value) if isinstance(value, float) and value == int(value) else value]
        found = self.items(e[1], here, size)
        out = []
        if kind == "key":
            for v in self.open(found):
                if isinstance(v, dict) and e[2] in v:
                    out.append(v[e[2]])
                elif self.strict:
                    raise JsonPathError(f'JSON object does not contain key "{e[2]}"')
        elif kind == "members":
            for v in self.open(found):
                if isinstance(v, dict):
                    out += v.values()
                elif self.strict:
                    raise JsonPathError("jsonpath wildcard member accessor can only be applied to an object")
        elif kind == "elements":
            for v in found:
                if isinstance(v, list):
                    out += v
                elif self.strict:
                    raise JsonPathError("jsonpath wildcard array accessor can only be applied to an array")
                else:
                    out.append(v)
        elif kind == "index":
            for v in found:
                if not isinstance(v, list):
                    if self.strict:
                        raise JsonPathError("jsonpath array accessor can only be applied to an array")
                    v = [v]
                for a, b in e[2]:
                    lo = int(self.one(self.items(a, here, len(v))))
                    hi = lo if b is None else int(self.one(self.items(b, here, len(v))))
                    if self.strict and (lo < 0 or hi >= len(v)):
                        raise JsonPathError("jsonpath array subscript is out of bounds")
                    out += [v[k] for k in range(max(lo, 0), min(hi, len(v) - 1) + 1)]
        elif kind == "deep":
            for v in found:
                self.deep(v, 0, e[2], e[3], out)
        elif kind == "filter":
            out = [v for v in self.open(found) if self.truth(e[2], v, size) is True]
        elif kind == "method":
            for v in found if e[2] in ("size", "type") else self.open(found):
                out += self.method(v, e[2])
        return out

    def open(self, values):
        """Lax mode unwraps arrays."""
        if self.strict:
            return values
        return [x for v in values for x in (v if isinstance(v, list) else [v])]

    def deep(self, v, depth, lo, hi, out):
        children = list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
        if (lo is None and not children) or (lo is not None and depth >= lo and (hi is None or depth <= hi)):
            out.append(v)
        for c in children:
            self.deep(c, depth + 1, lo, hi, out)

    @staticmethod
    def number(v):
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise JsonPathError("operand of a jsonpath operator is not a numeric value")
        return v

    def one(self, values):
        values = self.open(values)
        if len(values) != 1:
            raise JsonPathError("operand of a jsonpath operator is not a single value")
        return self.number(values[0])

    def method(self, v, name):
        if name == "size":
            return [len(v) if isinstance(v, list) else 1]
        if name == "type":
            return ["null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"]
        if name == "double":
            return [float(v)]
        if name == "keyvalue":
            if not isinstance(v, dict):
                raise JsonPathError("jsonpath item method .keyvalue() can only be applied to an object")
            return [{"id": 0, "key": k, "value": x} for k, x in v.items()]
        n = self.number(v)
        return [{"abs": abs, "floor": math.floor, "ceiling": math.ceil}[name](n)]

    def truth(self, e, here, size):
        """True, False or None (unknown)."""
        kind = e[0]
        if kind == "or":
            a, b = self.truth(e[1], here, size), self.truth(e[2], here, size)
            return True if True in (a, b) else None if None in (a, b) else False
        if kind == "and":
            a, b = self.truth(e[1], here, size), self.truth(e[2], here, size)
            return False if False in (a, b) else None if None in (a, b) else True
        if kind == "not":
            a = self.truth(e[1], here, size)
            return None if a is None else not a
        if kind == "unknown":
            return self.truth(e[1], here, size) is None
        try:
            if kind == "exists":
                return bool(self.items(e[1], here, size))
            left = self.open(self.items(e[2] if kind == "cmp" else e[1], here, size))
            if kind == "cmp":
                tests = [self.compare(e[1], a, b) for a in left for b in self.open(self.items(e[3], here, size))]
            elif kind == "starts":
                tests = [a.startswith(b) if isinstance(a, str) and isinstance(b, str) else None for a in left for b in self.items(e[2], here, size)]
            elif kind == "regex":
                flags = (re.I if "i" in e[3] else 0) | (re.S if "s" in e[3] else 0) | (re.M if "m" in e[3] else 0)
                tests = [bool(re.search(re.escape(e[2]) if "q" in e[3] else e[2], a, flags)) if isinstance(a, str) else None for a in left]
            else:
                v = self.items(e, here, size)
                return v[0] if len(v) == 1 and isinstance(v[0], bool) else None
        except JsonPathError:
            return None
        if self.strict and None in tests:
            return None
        return True if True in tests else None if None in tests else False

    @staticmethod
    def compare(op, a, b):
        kinds = [0 if v is None else 1 if isinstance(v, bool) else 2 if isinstance(v, (int, float)) else 3 if isinstance(v, str) else 4 for v in (a, b)]
        if 4 in kinds:
            return None
        if kinds[0] != kinds[1]:
            return {"!=": True, "==": False}.get(op) if 0 in kinds else None
        if a is None:
            return op in ("==", "<=", ">=")
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


_parsed: dict = {}


def query(doc, path: str, variables=None, silent: bool = False) -> list:
    """All items of a document at a path."""
    if path not in _parsed:
        if len(_parsed) > 1000:
            _parsed.clear()
        _parsed[path] = _Parser(path).path()
    mode, e = _parsed[path]
    try:
        return _Run(doc, mode == "strict", variables).items(e, doc, 0)
    except JsonPathError:
        if silent:
            return []
        raise


def match(doc, path: str, variables=None):
    """The single boolean that a predicate path yields, else None."""
    found = query(doc, path, variables)
    if len(found) == 1 and (found[0] is None or isinstance(found[0], bool)):
        return found[0]
    raise JsonPathError("single boolean result is expected")
