"""Column expressions as Spark SQL text.

The type libraries (`functions.geo`, `functions.interval`, `functions.textsearch`) are written once, against
the names `F` and `Column`. `library` loads a second copy of such a module in which these names make text, so
that the SQL front end emits the very same expressions.
"""

from __future__ import annotations

import importlib.util
from functools import lru_cache
from inspect import signature


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def text_of(v) -> str:
    if isinstance(v, Text):
        return v.sql
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, str):
        return quoted(v)
    if isinstance(v, int) and abs(v) > 2**31 - 1:
        return f"{v}L" if abs(v) < 2**63 else f"{v}BD"
    return str(v)


class Text:
    """An expression. It answers to what the libraries ask of a Column."""

    def __init__(self, sql: str, name: str | None = None):
        self.sql, self.name = sql, name

    def _op(self, op: str, other) -> Text:
        return Text(f"({self.sql} {op} {text_of(other)})")

    def _back(self, op: str, other) -> Text:
        return Text(f"({text_of(other)} {op} {self.sql})")

    __add__ = lambda a, b: a._op("+", b)
    __radd__ = lambda a, b: a._back("+", b)
    __sub__ = lambda a, b: a._op("-", b)
    __rsub__ = lambda a, b: a._back("-", b)
    __mul__ = lambda a, b: a._op("*", b)
    __rmul__ = lambda a, b: a._back("*", b)
    __truediv__ = lambda a, b: a._op("/", b)
    __rtruediv__ = lambda a, b: a._back("/", b)
    __mod__ = lambda a, b: a._op("%", b)
    __and__ = lambda a, b: a._op("AND", b)
    __or__ = lambda a, b: a._op("OR", b)
    __lt__ = lambda a, b: a._op("<", b)
    __le__ = lambda a, b: a._op("<=", b)
    __gt__ = lambda a, b: a._op(">", b)
    __ge__ = lambda a, b: a._op(">=", b)
    __eq__ = lambda a, b: a._op("=", b)
    __ne__ = lambda a, b: a._op("<>", b)
    __hash__ = None

    def __invert__(self) -> Text:
        return Text(f"(NOT {self.sql})")

    def __neg__(self) -> Text:
        return Text(f"(-{self.sql})")

    def __getitem__(self, key) -> Text:
        return Text(f"{self.sql}.{key}" if isinstance(key, str) else f"get({self.sql}, {key})")

    def alias(self, name: str) -> Text:
        return Text(self.sql, name)

    def cast(self, kind: str) -> Text:
        kind = "timestamp_ltz" if kind == "timestamp" else kind
        return Text(f"CAST({self.sql} AS {kind})")

    def isNull(self) -> Text:  # noqa: N802
        return Text(f"({self.sql} IS NULL)")

    def isNotNull(self) -> Text:  # noqa: N802
        return Text(f"({self.sql} IS NOT NULL)")

    def isin(self, *values) -> Text:
        values = values[0] if len(values) == 1 and isinstance(values[0], (list, tuple)) else values
        return Text(f"({self.sql} IN ({', '.join(map(text_of, values))}))" if values else "FALSE")

    def eqNullSafe(self, other) -> Text:  # noqa: N802
        return self._op("<=>", other)


class _Case(Text):
    """CASE WHEN ... so far, without its END."""

    def __init__(self, head: str):
        super().__init__(f"{head} END")
        self.head = head

    def when(self, test, value) -> _Case:
        return _Case(f"{self.head} WHEN {text_of(test)} THEN {text_of(value)}")

    def otherwise(self, value) -> Text:
        return Text(f"{self.head} ELSE {text_of(value)} END")


class Functions:
    """pyspark.sql.functions, making text. Names that are not here are functions of the same name in SQL."""

    _n = 0

    def lit(self, v) -> Text:
        return v if isinstance(v, Text) else Text(text_of(v))

    def struct(self, *fields) -> Text:
        return Text("named_struct(" + ", ".join(f"'{f.name}', {f.sql}" for f in fields) + ")")

    def when(self, test, value) -> _Case:
        return _Case(f"CASE WHEN {text_of(test)} THEN {text_of(value)}")

    def create_map(self, *entries) -> Text:
        return Text(f"map({', '.join(map(text_of, entries))})")

    def rtrim(self, text, characters) -> Text:
        return Text(f"rtrim({text_of(characters)}, {text_of(text)})")

    def __getattr__(self, name: str):
        def call(*args) -> Text:
            return Text(f"{name}({', '.join(self._lambda(a) if callable(a) and not isinstance(a, Text) else text_of(a) for a in args)})")

        return call

    def _lambda(self, f) -> str:
        names = []
        for _ in signature(f).parameters:
            Functions._n = (Functions._n + 1) % 100_000
            names.append(f"_v{Functions._n}")
        body = text_of(f(*map(Text, names)))
        head = names[0] if len(names) == 1 else f"({', '.join(names)})"
        return f"{head} -> {body}"


@lru_cache
def library(name: str):
    """The module tessera.functions.<name> with text in place of Columns."""
    spec = importlib.util.find_spec(f"tessera.functions.{name}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    module.F, module.Column = Functions(), Text
    if hasattr(module, "let"):
        module.let = library("interval").let if name != "interval" else module.let
    if hasattr(module, "LEAST"):
        module.LEAST, module.MOST = module.F.least, module.F.greatest
    return module
