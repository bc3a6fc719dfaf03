"""PL/pgSQL routines, interpreted on the driver. Expressions and statements run through the database."""

from __future__ import annotations

import re

from .plans.parser import Parser, SqlError


class _Exit(Exception):
    def __init__(self, label):
        self.label = label


class _Continue(Exception):
    def __init__(self, label):
        self.label = label


class _Return(Exception):
    def __init__(self, value):
        self.value = value


class RaisedError(SqlError):
    """RAISE EXCEPTION."""


def _split(body: str) -> list[str]:
    """Words, strings and punctuation of a body, statements still joined."""
    return re.findall(r"--[^\n]*|'(?:[^']|'')*'|<<\w+>>|:=|\.\.|<=|>=|<>|!=|\|\||::|[A-Za-z_]\w*|\d+\.\d+|\d+|\S", body)


class Routine:
    """A body of DECLARE, BEGIN ... END with assignments, IF, LOOP, WHILE, FOR over ranges, EXIT, CONTINUE,
    RETURN, RAISE, PERFORM, SELECT INTO and other statements."""

    def __init__(self, db, name: str, params: list, body: str):
        self.db, self.name, self.params = db, name, params
        self.t = [w for w in _split(body) if not w.startswith("--")]
        self.i = 0
        self.notices: list[str] = []
        self.block = self._block()

    # parsing
    def _at(self, *words: str, k: int = 0) -> bool:
        return self.i + k < len(self.t) and self.t[self.i + k].lower() in words

    def _take(self, *words: str) -> bool:
        if self._at(*words):
            self.i += 1
            return True
        return False

    def _need(self, word: str) -> None:
        if not self._take(word):
            raise SqlError(f"expected {word} in {self.name}, found {self.t[self.i : self.i + 1]}")

    def _until(self, *words: str) -> str:
        out, depth = [], 0
        while self.i < len(self.t):
            w = self.t[self.i]
            if depth == 0 and w.lower() in words:
                return " ".join(out)
            depth += (w in "([") - (w in ")]") if len(w) == 1 else 0
            if w.lower() == "case":
                depth += 1
            if w.lower() == "end" and depth:
                depth -= 1
            out.append(w)
            self.i += 1
        raise SqlError(f"unexpected end of {self.name}")

    def _block(self):
        names = []
        if self._take("declare"):
            while not self._at("begin"):
                v = self.t[self.i].lower()
                self.i += 1
                self._take("constant")
                kind = self._until(";", ":=", "default", "=")
                first = None
                if not self._at(";"):
                    self.i += 1
                    first = self._until(";")
                self._need(";")
                names.append((v, kind, first))
        self._need("begin")
        body = self._statements("end")
        self._need("end")
        self._take(";")
        return ("block", names, body)

    def _statements(self, *stops: str) -> list:
        out = []
        while not self._at(*stops):
            out.append(self._statement())
        return out

    def _statement(self):
        label = None
        if self.t[self.i].startswith("<<"):
            label = self.t[self.i][2:-2].lower()
            self.i += 1
        if self._at("declare", "begin"):
            return self._block()
        if self._take("if"):
            arms, other = [], []
            cond = self._until("then")
            self._need("then")
            arms.append((cond, self._statements("elsif", "elseif", "else", "end")))
            while self._take("elsif", "elseif"):
                cond = self._until("then")
                self._need("then")
                arms.append((cond, self._statements("elsif", "elseif", "else", "end")))
            if self._take("else"):
                other = self._statements("end")
            for w in ("end", "if", ";"):
                self._need(w)
            return ("if", arms, other)
        if self._at("while", "for", "loop"):
            head = ("loop",)
            if self._take("while"):
                head = ("while", self._until("loop"))
            elif self._take("for"):
                v = self.t[self.i].lower()
                self.i += 1
                self._need("in")
                down = self._take("reverse")
                lo = self._until("..")
                self._need("..")
                hi = self._until("by", "loop")
                head = ("for", v, down, lo, hi, self._until("loop") if self._take("by") else "1")
            self._need("loop")
            body = self._statements("end")
            for w in ("end", "loop"):
                self._need(w)
            if not self._at(";"):
                self.i += 1
            self._need(";")
            return ("repeat", label, head, body)
        if self._at("exit", "continue"):
            word = self.t[self.i].lower()
            self.i += 1
            target = None
            if not self._at("when", ";"):
                target = self.t[self.i].lower()
                self.i += 1
            cond = self._until(";") if self._take("when") else None
            self._need(";")
            return (word, target, cond)
        text = self._until(";")
        self._need(";")
        word = text.split(" ", 1)[0].lower() if text else "null"
        rest = text[len(word) :].strip()
        if word == "return":
            return ("return", rest or None)
        if word == "raise":
            return ("raise", rest)
        if word == "perform":
            return ("perform", "select " + rest)
        if word == "null":
            return ("null",)
        if m := re.match(r"(\w+) (?::=|=) (.*)$", text, re.S):
            return ("assign", m[1].lower(), m[2])
        if m := re.match(r"(?is)select (.*?) into (?:strict )?([\w ,]+?)( from .*)?$", text):
            return ("into", [x.strip().lower() for x in m[2].split(",")], f"select {m[1]}{m[3] or ''}")
        return ("sql", text)

    # running
    def call(self, args: list):
        scope = {}
        for (name, _), v in zip(self.params, args, strict=True):
            scope[name] = v
        for k, v in enumerate(args):
            scope[f"${k + 1}"] = v
        try:
            self._run(self.block, scope)
        except _Return as r:
            return r.value
        return None

    def _bound(self, text: str, scope: dict) -> str:
        """The text with variables replaced by their values, outside strings."""
        out = []
        for k, w in enumerate(words := _split(text)):
            before = words[k - 1] if k else ""
            value = scope.get(w.lower(), self) if not w.startswith("'") and before != "." and (k + 1 >= len(words) or words[k + 1] != "(") else self
            out.append(w if value is self else self.db.quote(value))
        return " ".join(out).replace(" . ", ".").replace(" :: ", "::").replace("$ ", "$")

    def _value(self, text: str, scope: dict):
        bound = self._bound(text, scope)
        if re.fullmatch(r"-?\d+", bound):
            return int(bound)
        return self.db.query(f"select {bound} as x").first()[0]

    def _run(self, s, scope: dict) -> None:
        kind = s[0]
        if kind == "block":
            inner = scope
            for v, _, first in s[1]:
                inner[v] = self._value(first, inner) if first else None
            for x in s[2]:
                self._run(x, inner)
        elif kind == "assign":
            scope[s[1]] = self._value(s[2], scope)
        elif kind == "if":
            for cond, body in s[1]:
                if self._value(cond, scope) is True:
                    break
            else:
                body = s[2]
            for x in body:
                self._run(x, scope)
        elif kind == "repeat":
            self._loop(s, scope)
        elif kind in ("exit", "continue"):
            if s[2] is None or self._value(s[2], scope) is True:
                raise (_Exit if kind == "exit" else _Continue)(s[1])
        elif kind == "return":
            raise _Return(self._value(s[1], scope) if s[1] else None)
        elif kind == "raise":
            self._raise(s[1], scope)
        elif kind == "perform":
            self.db.query(self._bound(s[1], scope)).collect()
        elif kind == "into":
            row = self.db.query(self._bound(s[2], scope)).first()
            for k, v in enumerate(s[1]):
                scope[v] = row[k] if row else None
        elif kind == "sql":
            self.db.sql(self._bound(s[1], scope))

    def _loop(self, s, scope) -> None:
        _, label, head, body = s
        if head[0] == "for":
            _, v, down, lo, hi, by = head
            a, b, step = (int(self._value(x, scope)) for x in (lo, hi, by))
            turns = iter(range(a, b - 1, -step) if down else range(a, b + 1, step))
        else:
            turns = iter(int, 1)
        while True:
            if head[0] == "while" and self._value(head[1], scope) is not True:
                return
            k = next(turns, None)
            if head[0] == "for":
                if k is None:
                    return
                scope[v] = k
            try:
                for x in body:
                    self._run(x, scope)
            except _Exit as e:
                if e.label not in (None, label):
                    raise
                return
            except _Continue as e:
                if e.label not in (None, label):
                    raise

    def _raise(self, text: str, scope) -> None:
        m = re.match(r"(?is)(debug|log|info|notice|warning|exception)?\s*('(?:[^']|'')*')?\s*(?:,\s*(.*))?$", text)
        message = (m[2] or "''")[1:-1].replace("''", "'")
        if m[3]:
            p = Parser(self._bound(m[3], scope))
            n = len(p.expr_list())
            values = self.db.query("select " + ", ".join(f"{x} as c{k}" for k, x in enumerate(self._arguments(m[3], n, scope)))).first()
            for v in values:
                message = message.replace("%", "<NULL>" if v is None else str(v), 1)
        if (m[1] or "exception").lower() == "exception":
            raise RaisedError(message, "P0001")
        self.notices.append(message)

    def _arguments(self, text: str, n: int, scope) -> list[str]:
        out, depth, at = [], 0, ""
        for w in _split(text):
            depth += (w in "([") - (w in ")]") if len(w) == 1 else 0
            if w == "," and depth == 0:
                out.append(at)
                at = ""
            else:
                at += " " + w
        return [self._bound(x, scope) for x in [*out, at]][:n]
