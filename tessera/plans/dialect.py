"""Emits Spark SQL for the parsed PostgreSQL query.

Where PostgreSQL's meaning depends on operand types (integer division, date arithmetic, exact averages),
the types come from Catalyst itself: the operand is analysed against the query's own FROM clause, without
running anything.
"""

from __future__ import annotations

import re

from pyspark.logger import PySparkLogger
from pyspark.sql import SparkSession

from .. import types as ty
from . import calls, joins, patterns, special
from .parser import SqlError, parse_query


def ident(name: str) -> str:
    return name if re.fullmatch(r"[a-z_][a-z0-9_]*", name) else "`" + name.replace("`", "``") + "`"


def string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


class Scope:
    """What a query's expressions can see: its CTEs and FROM clause as text, and the enclosing scope."""

    def __init__(self, with_text: str, from_text: str, outer: Scope | None, names: dict | None = None):
        self.with_text, self.from_text, self.outer = with_text, from_text, outer
        self.names = names or {}  # output name -> expression, for GROUP BY
        self.windows: dict = {}


class Emitter:
    def __init__(self, spark: SparkSession, args: list | None = None, functions: dict | None = None, enums: dict | None = None):
        self.spark, self.args, self.functions, self.enums = spark, args or [], functions or {}, enums or {}
        self._types: dict = {}
        self._n = 0
        self.db = None  # the session, for sequences and settings
        self.numbered: list[tuple[str, str]] = []  # (output column, sequence) of nextval in a select list
        self.natives: dict[str, str] = {}  # interval literals by their text, as Spark's own intervals
        self.searches: dict[str, str] = {}  # tsquery literals by their text

    def fresh(self) -> str:
        self._n += 1
        return f"_t{self._n}"

    # types
    def type_of(self, sql: str, scope: Scope | None) -> str:
        """The simple Spark type of an emitted expression, or "unknown"."""
        key = (sql, scope.from_text if scope else "", scope.with_text if scope else "")
        if key not in self._types:
            self._types[key] = self._analyse(sql, scope)
        return self._types[key]

    def _analyse(self, sql: str, scope: Scope | None) -> str:
        """Asks Catalyst. An attempt that fails is part of asking, so nothing is logged about it."""
        log = PySparkLogger.getLogger("SQLQueryContextLogger")
        before, log.disabled = log.disabled, True
        try:
            return self._attempts(sql, scope)
        finally:
            log.disabled = before

    def _attempts(self, sql: str, scope: Scope | None) -> str:
        with_text, froms, s = "", [], scope
        while s:
            with_text = with_text or s.with_text
            if s.from_text:
                froms.append(s.from_text)
            attempt = f"{with_text} SELECT {sql} AS _x" + (f" FROM {', '.join(froms)}" if froms else "")
            try:
                return self.spark.sql(attempt).schema[0].dataType.simpleString()
            except Exception:  # noqa: BLE001 - an outer reference: try again with the enclosing FROM
                s = s.outer
        try:
            return self.spark.sql(f"SELECT {sql} AS _x").schema[0].dataType.simpleString()
        except Exception:  # noqa: BLE001
            return "unknown"

    def kind(self, sql: str, scope: Scope | None) -> str | None:
        """The type of an expression if it is one that Spark lacks. Columns are asked for only where the FROM
        clauses have such a column at all."""
        if "struct" in sql or "map" in sql or "tessera_to_" in sql or self._has_special(scope):
            return special.kind_of(self.type_of(sql, scope))
        return None

    def _has_special(self, scope: Scope | None) -> bool:
        """Whether a FROM clause may have a column of a type that Spark lacks: by the session's list of tables with
        one and by the text of derived tables, else by asking Catalyst."""
        while scope:
            text = scope.from_text + scope.with_text
            if "struct" in text.lower() or "tessera_to_" in text or "map(" in text:
                return True
            if self.db is not None:
                if self.db.special and not self.db.special.isdisjoint(re.findall(r"\w+", text.lower())):
                    return True
            elif scope.from_text:
                key = ("*", scope.from_text, scope.with_text)
                if key not in self._types:
                    try:
                        fields = self.spark.sql(f"{scope.with_text} SELECT * FROM {scope.from_text}").schema
                        self._types[key] = any(special.kind_of(f.dataType.simpleString()) for f in fields)
                    except Exception:  # noqa: BLE001 - refers to an outer query
                        self._types[key] = True
                if self._types[key]:
                    return True
            scope = scope.outer
        return False

    def family(self, sql: str, scope) -> str:
        return ty.family(self.type_of(sql, scope))

    # queries
    def query(self, q: dict, outer: Scope | None = None, with_text: str = "") -> str:
        if q["kind"] != "query":
            return self.body(q, outer, with_text, [], None)
        own = with_text
        if q["ctes"]:
            parts = []
            for name, cols, sub in q["ctes"]:
                head = ident(name) + (f"({', '.join(map(ident, cols))})" if cols else "")
                before = self._with(with_text, parts, q["recursive"])
                text = self.query(sub, outer, before)
                parts.append(f"{head} AS ({self._strip(text, before)})")
            own = self._with(with_text, parts, q["recursive"])
        text = self.body(q["body"], outer, own, q["order"], q)
        return f"{own} {text}" if own and not with_text else (f"{own} {text}" if q["ctes"] else text)

    @staticmethod
    def _with(before: str, parts: list[str], recursive: bool) -> str:
        if not parts:
            return before
        if before:
            return before + ", " + ", ".join(parts)
        return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts)

    @staticmethod
    def _strip(text: str, with_text: str) -> str:
        return text[len(with_text) :].lstrip() if with_text and text.startswith(with_text) else text

    def nested(self, q: dict, scope: Scope | None) -> str:
        """A subquery: the CTEs in force are defined at the top of the statement."""
        with_text = scope.with_text if scope else ""
        return self._strip(self.query(q, scope, with_text), with_text) if not q.get("ctes") else self.query(q, scope, "")

    def tail(self, q: dict | None, scope: Scope | None) -> str:
        out = ""
        if q:
            for word in ("limit", "offset"):
                e = q[word]
                if e is None or e == ("const", "null"):
                    continue
                text = self.expr(e, scope)
                if re.fullmatch(r"\(?- ?\d+\)?", text):
                    raise SqlError(f"{word.upper()} must not be negative", "2201W" if word == "limit" else "2201X")
                out += f" {word.upper()} {text}"
        return out

    def order_text(self, items, scope, names=()) -> str:
        out = []
        for e, asc, first in items:
            text = e[1] if e[0] == "num" and e[1].isdigit() else (ident(e[1][0]) if e[0] == "col" and len(e[1]) == 1 and e[1][0] in names else self.expr(e, scope))
            if self.kind(text, scope) == "interval":
                text = special.library("interval").span(special.Text(text)).sql
            out.append(f"{text} {'ASC' if asc else 'DESC'} NULLS {'FIRST' if first else 'LAST'}")
        return ", ".join(out)

    def body(self, b: dict, outer, with_text: str, order: list, q: dict | None) -> str:
        kind = b["kind"]
        if kind == "query":
            text = f"({self._strip(self.query(b, outer, with_text), with_text)})"
        elif kind == "values":
            scope = Scope(with_text, "", outer)
            rows = ["(" + ", ".join(self.expr(e, scope) for e in r) + ")" for r in b["rows"]]
            n = len(b["rows"][0])
            text = f"SELECT * FROM VALUES {', '.join(rows)} AS {self.fresh()}({', '.join(f'column{i + 1}' for i in range(n))})"
        elif kind == "set":
            left, right = (self._arm(b[k], outer, with_text) for k in ("left", "right"))
            text = f"{left} {b['op'].upper()} {'ALL' if b['all'] else 'DISTINCT'} {right}"
        else:
            return self.select(b, outer, with_text, order, q)
        scope = Scope(with_text, "", outer)
        if order:
            names = self._output_names(text, with_text)
            text += f" ORDER BY {self.order_text(order, scope, names)}"
        return text + self.tail(q, scope)

    def _output_names(self, text: str, with_text: str) -> list[str]:
        return self.spark.sql(f"{with_text} {text}").columns

    def _arm(self, b: dict, outer, with_text: str) -> str:
        text = self.body(b, outer, with_text, [], None) if b["kind"] != "query" else self._strip(self.query(b, outer, with_text), with_text)
        return f"({text})"

    # FROM
    def source(self, item, outer, with_text: str) -> str:
        kind = item[0]
        if kind == "table":
            _, name, alias, cols = item
            text = ident(name)
            if alias:
                text += f" AS {ident(alias)}" + (f"({', '.join(map(ident, cols))})" if cols else "")
            return text
        if kind == "sub":
            _, q, alias, cols, lateral = item
            scope = Scope(with_text, "", outer)
            text = f"({self.nested(q, scope)}) AS {ident(alias or self.fresh())}" + (f"({', '.join(map(ident, cols))})" if cols else "")
            return ("LATERAL " if lateral else "") + text
        if kind == "srf":
            return self.table_function(item, outer, with_text)
        _, how, left, right, cond = item
        a, b = self.source(left, outer, with_text), self.source(right, outer, with_text)
        words = {"cross": "CROSS JOIN", "inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}[how]
        if cond and cond[0] == "natural":
            return f"{a} NATURAL {words} {b}"
        text = f"{a} {words} {b}"
        if cond and cond[0] == "using":
            return f"{text} USING ({', '.join(map(ident, cond[1]))})"
        if cond:
            return f"{text} ON {self.expr(cond[1], Scope(with_text, f'{a} CROSS JOIN {b}', outer))}"
        return text

    def table_function(self, item, outer, with_text: str) -> str:
        _, name, args, ordinal, alias, cols, lateral = item
        scope = Scope(with_text, "", outer)
        if name in ("pg_input_error_info", "pg_partition_ancestors", "pg_available_extensions"):
            return f"({self._catalog_rows(name, args, scope)}) AS {ident(alias or name)}" + (f"({', '.join(map(ident, cols))})" if cols else "")
        array = self.series(name, args, scope)
        alias = alias or name
        out = list(cols or [alias])
        if ordinal:
            out = (out + ["ordinality"])[:2] if len(out) < 2 else out
            inner = f"SELECT v AS {ident(out[0])}, CAST(p + 1 AS BIGINT) AS {ident(out[1])} FROM (SELECT posexplode({array}) AS (p, v))"
        else:
            inner = f"SELECT explode({array}) AS {ident(out[0])}"
        return f"{'LATERAL ' if lateral else ''}({inner}) AS {ident(alias)}"

    def _catalog_rows(self, name: str, args: list, scope) -> str:
        """Set-returning functions of the catalog: few rows, known when the query is planned."""
        if name == "pg_available_extensions":
            return "SELECT 'plpgsql' AS name, '1.0' AS default_version, 'PL/pgSQL procedural language' AS comment"
        if name == "pg_partition_ancestors":
            chain, at = [], args[0][1] if args[0][0] == "str" else args[0][1][1]
            while self.db and at in self.db.tables:
                chain.append(at)
                at = self.db.tables[at].parent
            return f"SELECT explode({'array(' + ', '.join(map(string, chain)) + ')' if chain else 'CAST(array() AS ARRAY<STRING>)'}) AS relid"
        text, kind = self.expr(args[0], scope), args[1][1]
        error = None
        try:
            self.spark.sql(f"SELECT {self._cast(text, (kind, (), False), scope)} AS x").collect()
        except Exception as x:  # noqa: BLE001 - whatever the type's input says
            shown = {"int": "integer", "int4": "integer", "int8": "bigint", "bool": "boolean", "float8": "double precision"}.get(kind, kind)
            error = str(x) if isinstance(x, SqlError) else f'invalid input syntax for type {shown}: "{args[0][1]}"'
        none = "CAST(NULL AS STRING)"
        return f"SELECT {string(error) if error else none} AS message, {none} AS detail, {none} AS hint, {string('22P02') if error else none} AS sql_error_code"

    def series(self, name: str, args: list, scope) -> str:
        """The array whose elements a set-returning function returns."""
        a = [self.expr(x, scope) for x in args]
        if name == "unnest":
            return a[0]
        if name == "generate_series":
            step = self.natives.get(a[2], a[2]) if len(a) > 2 else None
            f = self.family(a[0], scope)
            if f in ("timestamp", "date"):
                a[0], a[1] = (f"CAST({x} AS TIMESTAMP_NTZ)" for x in a[:2])
                return f"CASE WHEN {a[1]} >= {a[0]} THEN sequence({a[0]}, {a[1]}, {step}) ELSE array() END"
            if f == "decimal" or (step and self.family(step, scope) == "decimal"):
                step = step or "1"
                n = f"CAST(floor(({a[1]} - {a[0]}) / {step}) AS INT)"
                return f"transform(CASE WHEN {n} >= 0 THEN sequence(0, {n}) ELSE CAST(array() AS ARRAY<INT>) END, i -> {a[0]} + i * {step})"
            step = step or "1"
            wide = "BIGINT" if "bigint" in (self.type_of(a[0], scope), self.type_of(a[1], scope)) else "INT"
            a[0], a[1] = (f"CAST({x} AS {wide})" for x in a[:2])
            return f"CASE WHEN ({a[1]} >= {a[0]}) = ({step} > 0) OR {a[0]} = {a[1]} THEN sequence({a[0]}, {a[1]}, CAST({step} AS {wide})) ELSE CAST(array() AS ARRAY<{wide}>) END"
        if name == "generate_subscripts":
            n = f"size({a[0]})"
            up = f"CASE WHEN {n} > 0 AND {a[1]} = 1 THEN sequence(1, {n}) ELSE CAST(array() AS ARRAY<INT>) END"
            return f"CASE WHEN {a[2]} THEN reverse({up}) ELSE {up} END" if len(a) > 2 else up
        if name == "regexp_split_to_table":
            return f"split({a[0]}, {a[1]})"
        if name == "string_to_table":
            return f"split({a[0]}, concat('\\\\Q', {a[1]}, '\\\\E'))"
        if name == "jsonb_path_query":
            return f"tessera_jsonb_path_query({', '.join([*a, *(chr(39) + '{}' + chr(39), 'FALSE')[len(a) - 2 :]])})"
        raise SqlError(f"function {name} does not exist", "42883")

    SRF = {"generate_series", "unnest", "generate_subscripts", "regexp_split_to_table", "string_to_table", "jsonb_path_query"}

    # SELECT
    def select(self, b: dict, outer, with_text: str, order: list, q: dict | None) -> str:
        if not order and (text := joins.count_by_order(self, b, outer, with_text)) is not None:
            return text + self.tail(q, Scope(with_text, "", None))
        if not order and not (q and (q["limit"] or q["offset"])) and (text := joins.full(self, b, outer, with_text)) is not None:
            return text
        from_text = ", ".join(self.source(f, outer, with_text) for f in b["from"])
        scope = Scope(with_text, from_text, outer)
        scope.windows = {n: spec for n, spec in b["windows"]}
        items, names = [], []
        srfs = [e for e, _ in b["items"] if e[0] == "call" and e[1] in self.SRF]
        for e, alias in b["items"]:
            if e[0] == "star":
                items.append(f"{ident(e[1])}.*" if e[1] else "*")
                continue
            name = alias or self.default_name(e)
            names.append(name)
            if e[0] == "call" and e[1] == "nextval" and from_text and not outer and self.db:
                self.numbered.append((name, self._sequence(e[2])))
                items.append(f"monotonically_increasing_id() AS {ident(name)}")
                continue
            if e in srfs:
                items.append((name, self.series(e[1], e[2], scope)))
            else:
                items.append(f"{self.expr(e, scope, top=True)} AS {ident(name)}")
            scope.names.setdefault(name, e)
        where = f" WHERE {self.expr(b['where'], scope)}" if b["where"] else ""
        group = self.group(b["group"], b["items"], scope) if b["group"] else ""
        having = f" HAVING {self.expr(b['having'], scope)}" if b["having"] else ""
        if not outer and not self.numbered:
            from_text = joins.dealt_out(self, b, from_text, with_text, "".join(i if isinstance(i, str) else i[1] for i in items))
        from_ = (f" FROM {from_text}" if from_text else "") + where + group + having
        if srfs:
            return self._lockstep(items, from_, order, scope, names) + self.tail(q, scope)
        if b["on"]:
            return self._distinct_on(b, items, names, from_, order, scope) + self.tail(q, scope)
        text = f"SELECT {'DISTINCT ' if b['distinct'] else ''}{', '.join(items)}{from_}"
        if order:
            text += f" ORDER BY {self.order_text(order, scope, names)}"
        return text + self.tail(q, scope)

    def _lockstep(self, items, from_, order, scope, names) -> str:
        """Set-returning functions in the select list advance together; the shorter ones yield NULL."""
        arrays = [(n, a) for n, a in (i for i in items if isinstance(i, tuple))]
        plain = [i for i in items if isinstance(i, str)]
        zipped = f"arrays_zip({', '.join(f'a{k}' for k in range(len(arrays)))})"
        inner = f"SELECT {', '.join([*plain, *(f'{a} AS a{k}' for k, (_, a) in enumerate(arrays))])}{from_}"
        place = iter(range(len(arrays)))
        out = []
        for i in items:
            out.append(f"z.a{next(place)} AS {ident(i[0])}" if isinstance(i, tuple) else ident(i.rsplit(" AS ", 1)[1].strip("`")))
        text = f"SELECT {', '.join(out)} FROM (SELECT *, explode({zipped}) AS z FROM ({inner}))"
        return text + (f" ORDER BY {self.order_text(order, scope, names)}" if order else "")

    def _distinct_on(self, b, items, names, from_, order, scope) -> str:
        keys = [self.expr(self._target(e, b), scope) for e in b["on"]]
        by = [(self._target(e, b), asc, first) for e, asc, first in order]
        lead = [self.expr(e, scope) for e, _, _ in by[: len(keys)]]
        if order and not set(keys) >= set(lead):
            raise SqlError("SELECT DISTINCT ON expressions must match initial ORDER BY expressions", "42P10")
        inside = self.order_text(by, scope) if by else "1"
        sorts = [f"{self.expr(e, scope)} AS _s{k}" for k, (e, _, _) in enumerate(by)]
        rank = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {inside}) AS _rn"
        inner = f"SELECT {', '.join([*items, *sorts, rank])}{from_}"
        outer = ", ".join(f"_s{k} {'ASC' if a else 'DESC'} NULLS {'FIRST' if f else 'LAST'}" for k, (_, a, f) in enumerate(by))
        return f"SELECT {', '.join(map(ident, names))} FROM ({inner}) WHERE _rn = 1" + (f" ORDER BY {outer}" if outer else "")

    def _target(self, e, b):
        """An ordinal or output name stands for the select item."""
        if e[0] == "num" and e[1].isdigit():
            return b["items"][int(e[1]) - 1][0]
        if e[0] == "col" and len(e[1]) == 1:
            for item, alias in b["items"]:
                if alias == e[1][0]:
                    return item
        return e

    def group(self, groups, items, scope) -> str:
        def one(e) -> str:
            if e[0] == "num" and e[1].isdigit():
                return self.expr(items[int(e[1]) - 1][0], scope)
            if e[0] == "col" and len(e[1]) == 1:
                own = self.expr(e, scope)
                # an input column wins over an output name
                if e[1][0] in scope.names and self.type_of(own, scope) == "unknown":
                    return self.expr(scope.names[e[1][0]], scope)
            return self.expr(e, scope)

        out = []
        for kind, e in groups:
            if kind == "expr":
                out.append(one(e))
            elif kind == "sets":
                out.append("GROUPING SETS (" + ", ".join("(" + ", ".join(map(one, s)) + ")" for s in e) + ")")
            else:
                out.append(f"{kind.upper()}({', '.join(map(one, e))})")
        return " GROUP BY " + ", ".join(out)

    def default_name(self, e) -> str:
        kind = e[0]
        if kind == "col":
            return e[1][-1]
        if kind == "call":
            return e[1]
        if kind == "cast":
            inner = self.default_name(e[1])
            return inner if inner != "?column?" else {"int": "int4", "integer": "int4", "bigint": "int8"}.get(e[2][0], e[2][0])
        if kind == "case":
            return self.default_name(e[3]) if e[3] and e[3][0] == "col" else "case"
        if kind in ("scalar",):
            item = e[1]["body"].get("items") if e[1]["body"]["kind"] == "select" else None
            return item[0][1] or self.default_name(item[0][0]) if item else "?column?"
        if kind in ("array", "arraysub", "exists"):
            return "array" if kind != "exists" else kind
        if kind == "typed":
            return e[1]
        if kind in ("collate", "subscript"):
            return self.default_name(e[1])
        return "?column?"

    # expressions
    def expr(self, e, scope, top: bool = False) -> str:
        return getattr(self, "x_" + e[0])(e, scope) if e[0] != "insub" else self.x_insub(e, scope, top)

    def x_num(self, e, scope):
        v = e[1]
        if re.search("[eE]", v):
            return f"{v}BD" if "." in v else f"CAST({v} AS DECIMAL(38,16))"
        if v.isdigit() and int(v) > 2**63 - 1:
            return f"{v}BD"
        if v.isdigit() and int(v) > 2**31 - 1:
            return f"{v}L"
        return v

    def x_str(self, e, scope):
        return string(e[1])

    def x_bits(self, e, scope):
        return string(e[1])

    def x_const(self, e, scope):
        return e[1].upper()

    def x_param(self, e, scope):
        if not 1 <= e[1] <= len(self.args):
            raise SqlError(f"there is no parameter ${e[1]}", "42P02")
        v = self.args[e[1] - 1]
        if v is None or isinstance(v, bool):
            return str(v).upper().replace("NONE", "NULL")
        return repr(v) if isinstance(v, (int, float)) else string(str(v))

    def x_col(self, e, scope):
        return ".".join(map(ident, e[1]))

    def x_row(self, e, scope):
        return "struct(" + ", ".join(self.expr(x, scope) for x in e[1]) + ")"

    def x_or(self, e, scope):
        return f"({self.expr(e[1], scope)} OR {self.expr(e[2], scope)})"

    def x_and(self, e, scope):
        return f"({self.expr(e[1], scope)} AND {self.expr(e[2], scope)})"

    def x_not(self, e, scope):
        return f"(NOT {self.expr(e[1], scope)})"

    def x_is(self, e, scope):
        word = "null" if e[2] == "unknown" else e[2]
        return f"({self.expr(e[1], scope)} IS {'NOT ' if e[3] else ''}{word.upper()})"

    def x_distinct(self, e, scope):
        text = f"({self.expr(e[1], scope)} <=> {self.expr(e[2], scope)})"
        return text if e[3] else f"(NOT {text})"

    def x_in(self, e, scope):
        if any(self.kind(self.expr(x, scope), scope) for x in (e[1], *e[2])):
            text = "(" + " OR ".join(self.x_op(("op", "=", e[1], x), scope) for x in e[2]) + ")"
            return f"(NOT {text})" if e[3] else text
        return f"({self.expr(e[1], scope)} {'NOT ' if e[3] else ''}IN ({', '.join(self.expr(x, scope) for x in e[2])}))"

    def x_insub(self, e, scope, top=False):
        a, sub = self.expr(e[1], scope), self.nested(e[2], scope)
        text = f"({a} {'NOT ' if e[3] else ''}IN ({sub}))"
        if not top:
            return text
        # in a select list Spark answers false where SQL says NULL
        t = self.fresh()
        nulls = f"EXISTS (SELECT 1 FROM ({sub}) AS {t}(c) WHERE c IS NULL)"
        return f"CASE WHEN {a} IN ({sub}) THEN {'FALSE' if e[3] else 'TRUE'} WHEN ({a} IS NULL AND EXISTS ({sub})) OR {nulls} THEN NULL ELSE {'TRUE' if e[3] else 'FALSE'} END"

    def x_exists(self, e, scope):
        return f"EXISTS ({self.nested(e[1], scope)})"

    def x_scalar(self, e, scope):
        return f"({self.nested(e[1], scope)})"

    def x_arraysub(self, e, scope):
        t = self.fresh()
        return f"(SELECT transform(collect_list(struct(c)), x -> x.c) FROM ({self.nested(e[1], scope)}) AS {t}(c))"

    def x_anyarr(self, e, scope):
        _, op, word, left, arr = e
        a, b = self.expr(left, scope), self.expr(arr, scope)
        test = {"=": f"{a} = _e", "<>": f"{a} <> _e"}.get(op) or (f"{a} {op} _e" if op in ("<", ">", "<=", ">=") else self._op(op, a, "_e", scope))
        return f"{'exists' if word == 'any' else 'forall'}({b}, _e -> {test})"

    def x_anysub(self, e, scope):
        _, op, word, left, q = e
        a, sub = self.expr(left, scope), self.nested(q, scope)
        if op == "=" and word == "any":
            return f"({a} IN ({sub}))"
        if op == "<>" and word == "all":
            return f"({a} NOT IN ({sub}))"
        t = self.fresh()
        # the extreme decides; then NULLs on either side leave the rest unknown
        extreme = {(">", "all"): "max", (">=", "all"): "max", ("<", "all"): "min", ("<=", "all"): "min",
                   (">", "any"): "min", (">=", "any"): "min", ("<", "any"): "max", ("<=", "any"): "max"}.get((op, word))
        if extreme is None:  # = ALL, <> ANY: both extremes
            s = f"(SELECT struct(count(*) AS n, count(c) AS k, min(c) AS lo, max(c) AS hi) FROM ({sub}) AS {t}(c))"
            same = f"({a} = {s}.lo AND {a} = {s}.hi)"
            if word == "all":
                return f"CASE WHEN {s}.n = 0 THEN TRUE WHEN NOT {same} THEN FALSE WHEN {s}.k < {s}.n THEN NULL ELSE {same} END"
            return f"CASE WHEN {s}.n = 0 THEN FALSE WHEN NOT {same} THEN TRUE WHEN {s}.k < {s}.n THEN NULL ELSE NOT {same} END"
        s = f"(SELECT struct(count(*) AS n, count(c) AS k, {extreme}(c) AS m) FROM ({sub}) AS {t}(c))"
        if word == "all":
            return f"CASE WHEN {s}.n = 0 THEN TRUE WHEN NOT ({a} {op} {s}.m) THEN FALSE WHEN {s}.k < {s}.n THEN NULL ELSE {a} {op} {s}.m END"
        return f"CASE WHEN {s}.n = 0 THEN FALSE WHEN {a} {op} {s}.m THEN TRUE WHEN {s}.k < {s}.n THEN NULL ELSE {a} {op} {s}.m END"

    def x_between(self, e, scope):
        a, lo, hi = (self.expr(x, scope) for x in e[1:4])
        if any(self.kind(x, scope) for x in (a, lo, hi)):
            inside = lambda x, y: f"({self._op('>=', a, x, scope)} AND {self._op('<=', a, y, scope)})"
            text = f"({inside(lo, hi)} OR {inside(hi, lo)})" if e[5] else inside(lo, hi)
            return f"(NOT {text})" if e[4] else text
        if e[5]:
            lo, hi = f"least({lo}, {hi})", f"greatest({lo}, {hi})"
        return f"({a} {'NOT ' if e[4] else ''}BETWEEN {lo} AND {hi})"

    def x_like(self, e, scope):
        esc = f" ESCAPE {self.expr(e[3], scope)}" if e[3] else ""
        return f"({self.expr(e[1], scope)} {'NOT ' if e[4] else ''}{e[0].upper()} {self.expr(e[2], scope)}{esc})"

    x_ilike = x_like

    def x_similar(self, e, scope):
        if e[2][0] != "str":
            raise SqlError("SIMILAR TO needs a literal pattern", "0A000")
        esc = e[3][1] if e[3] else "\\"
        return f"({'NOT ' if e[4] else ''}({self.expr(e[1], scope)} RLIKE {string(patterns.similar(e[2][1], esc))}))"

    def x_case(self, e, scope):
        _, operand, whens, other = e
        head = f" {self.expr(operand, scope)}" if operand else ""
        body = "".join(f" WHEN {self.expr(c, scope)} THEN {self.expr(v, scope)}" for c, v in whens)
        tail = f" ELSE {self.expr(other, scope)}" if other else ""
        return f"CASE{head}{body}{tail} END"

    def x_array(self, e, scope):
        return f"array({', '.join(self.expr(x, scope) for x in e[1])})"

    def x_subscript(self, e, scope):
        i = self.expr(e[2], scope)
        return f"CASE WHEN {i} >= 1 THEN get({self.expr(e[1], scope)}, CAST({i} AS INT) - 1) END"

    def x_collate(self, e, scope):
        name = {"c": "UTF8_BINARY", "posix": "UTF8_BINARY", "default": "UTF8_BINARY", "ucs_basic": "UTF8_BINARY"}.get(e[2].lower(), "UNICODE")
        return f"collate({self.expr(e[1], scope)}, '{name}')"

    def x_zone(self, e, scope):
        a, z = self.expr(e[1], scope), self.expr(e[2], scope)
        t = self.type_of(a, scope)
        if t == "timestamp":
            return f"CAST(from_utc_timestamp(to_utc_timestamp({a}, current_timezone()), {z}) AS TIMESTAMP_NTZ)"
        return f"from_utc_timestamp(to_utc_timestamp(CAST({a} AS TIMESTAMP_NTZ), {z}), current_timezone())"

    def x_typed(self, e, scope):
        _, name, value, fields = e
        if name in special.values.SHAPES:
            return self._special(name, value, fields)
        if name in ("numeric", "decimal"):
            return self._numeric(value)
        return self._cast(string(value), (name, (), False), scope)

    def _special(self, name: str, value: str, fields: tuple = ()) -> str:
        """A literal of a type that Spark lacks."""
        if name == "interval" and fields:
            months, days, micros = patterns.parse_interval(value, fields)
            value = f"{months} mons {days} days {micros} us"
        text = special.literal(name, value)
        if name == "interval":
            self.natives[text] = patterns.interval_literal(value)
        elif name == "tsquery":
            self.searches[text] = value
        return text

    def x_cast(self, e, scope):
        if e[1][0] == "str" and not e[2][2] and e[2][0] in special.values.SHAPES:
            return self._special(e[2][0], e[1][1])
        if e[1][0] == "str" and e[2][0] in ("numeric", "decimal") and not e[2][1] and not e[2][2]:
            return self._numeric(e[1][1])
        return self._cast(self.expr(e[1], scope), e[2], scope)

    @staticmethod
    def _numeric(value: str) -> str:
        """A numeric literal; beyond 22 digits before the point with as many behind it as Spark's 38 leave."""
        text = value.strip()
        if text.lower() in ("nan", "infinity", "-infinity", "inf", "-inf"):
            raise SqlError(f'numeric "{text}" is not supported', "0A000")
        m = re.fullmatch(r"[-+]?(\d*)(?:\.(\d*))?(?:[eE][-+]?\d+)?", text)
        if not m or not (m[1] or m[2]):
            raise SqlError(f'invalid input syntax for type numeric: "{value}"', "22P02")
        whole = len((m[1] or "").lstrip("0"))
        if whole > 38:
            raise SqlError("value overflows numeric format", "22003")
        kind = ty.NUMERIC if whole <= 22 else f"DECIMAL(38,{38 - whole})"
        return f"CAST({string(text)} AS {kind})"

    def _cast(self, a: str, t: tuple, scope) -> str:
        name, args, array = t
        if not array and (name in special.values.SHAPES or (have := self.kind(a, scope))):
            have = self.kind(a, scope)
            if name in special.values.SHAPES:
                return special.cast(name, a, self.type_of(a, scope), have)
            if have == "money" and name in ("numeric", "decimal"):
                a = f"(CAST({a}.cents AS DECIMAL(38,2)) / 100)"
            elif have == "pg_lsn" and name in ("numeric", "decimal"):
                a = f"{a}.lsn"
            else:
                a = special.show(have, a)
        if name in self.enums and not array:
            labels = self.enums[name]
            return f"CASE WHEN {a} IN ({', '.join(map(string, labels))}) THEN {a} ELSE raise_error(concat('invalid input value for enum {name}: ', {a})) END"
        try:
            target = ty.spark_type(name, args, array)
        except KeyError as x:
            raise SqlError(str(x.args[0]), "42704") from None
        if array and re.fullmatch(r"'\{.*\}'", a):
            inner = a[2:-2]
            return f"CAST({'split(' + string(inner) + ', ' + string(',') + ')' if inner else 'array()'} AS {target})"
        f = self.family(a, scope)
        if target in ("SMALLINT", "INT", "BIGINT") and f == "float":
            return f"CAST(rint({a}) AS {target})"
        if target in ("SMALLINT", "INT", "BIGINT") and f == "decimal":
            return f"CAST(round({a}) AS {target})"
        if target in ("SMALLINT", "INT", "BIGINT") and f == "string":
            return f"CAST(trim({a}) AS {target})"
        if target == "BOOLEAN" and f == "string":
            low = f"lower(trim({a}))"
            return f"CASE WHEN {low} IN ('t','true','y','yes','on','1') THEN TRUE WHEN {low} IN ('f','false','n','no','off','0') THEN FALSE WHEN {a} IS NOT NULL THEN CAST(raise_error('invalid input syntax for type boolean') AS BOOLEAN) END"
        if target == "STRING":
            text = f"CAST({a} AS STRING)" if f != "binary" else f"concat('\\\\x', lower(hex({a})))"
            if name in ("varchar", "char", "character", "bpchar") and args:
                text = f"substring({text}, 1, {args[0]})"
                return f"rpad({text}, {args[0]}, ' ')" if name != "varchar" else text
            return f"lower({text})" if name == "uuid" else text
        if name in ("numeric", "decimal") and args and len(args) > 1 and args[1] < 0:
            return f"CAST(round({a}, {args[1]}) AS {target})"
        return f"CAST({a} AS {target})"

    def x_unary(self, e, scope):
        a = self.expr(e[2], scope)
        if e[1] == "-" and e[2][0] == "num":
            return f"-{a}"
        if e[1] == "!!" and a in self.searches:
            return self._special("tsquery", special.textsearch.negation(self.searches[a]))
        if (kind := self.kind(a, scope)) and (out := special.unary(e[1], kind, a)) is not None:
            return out
        if e[1] not in ("-", "+", "~", "@", "|/", "||/"):
            raise SqlError(f"operator does not exist: {e[1]} {kind or self.type_of(a, scope)}", "42883")
        return {"-": f"(-{a})", "+": a, "~": f"(~{a})", "@": f"abs({a})", "|/": f"sqrt({a})", "||/": f"cbrt({a})"}[e[1]]

    def x_op(self, e, scope):
        _, op, left, right = e
        if left[0] == "row" and right[0] == "row":
            parts = [f"({self.expr(x, scope)} = {self.expr(y, scope)})" for x, y in zip(left[1], right[1], strict=True)]
            text = "(" + " AND ".join(parts) + ")"
            if op in ("=", "<>"):
                return text if op == "=" else f"(NOT {text})"
            return f"(struct({', '.join(self.expr(x, scope) for x in left[1])}) {op} struct({', '.join(self.expr(x, scope) for x in right[1])}))"
        if op in ("~", "~*", "!~", "!~*") and right[0] == "str":
            text = f"({self.expr(left, scope)} RLIKE {string(patterns.java(right[1], 'i' if '*' in op else ''))})"
            return f"(NOT {text})" if op[0] == "!" else text
        return self._op(op, self.expr(left, scope), self.expr(right, scope), scope)

    def _op(self, op: str, a: str, b: str, scope) -> str:
        ka, kb = self.kind(a, scope), self.kind(b, scope)
        if ka or kb:
            out = self._special_op(op, ka, a, kb, b, scope)
            if out is not None:
                return out
        if op in ("=", "<>", "<", ">", "<=", ">="):
            return f"({a} {op} {b})"
        if op in ("@?", "@@"):
            return f"tessera_jsonb_path_{'exists' if op == '@?' else 'match'}({a}, {b}, '{{}}', TRUE)"
        if op == "^@":
            return f"startswith({a}, {b})"
        if op in ("~~", "!~~", "~~*", "!~~*"):
            return f"({a} {'NOT ' if op[0] == '!' else ''}{'ILIKE' if '*' in op else 'LIKE'} {b})"
        if op in ("~", "~*", "!~", "!~*"):
            text = f"({a} RLIKE " + (f"concat('(?i)', {b}))" if "*" in op else f"{b})")
            return f"(NOT {text})" if op[0] == "!" else text
        fa, fb = self.family(a, scope), self.family(b, scope)
        if op == "||":
            if "array" in (fa, fb):
                if fa == fb == "array" or "void" in (fa, fb):
                    return f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE concat({a}, {b}) END"
                return f"array_append({a}, {b})" if fa == "array" else f"array_prepend({b}, {a})"
            return f"concat(CAST({a} AS STRING), CAST({b} AS STRING))"
        if op == "^":
            return f"power({a}, {b})"
        if op in ("&", "|"):
            return f"({a} {op} {b})"
        if op == "#":
            return f"({a} ^ {b})"
        if op in ("<<", ">>"):
            return f"{'shiftleft' if op == '<<' else 'shiftright'}({a}, CAST({b} AS INT))"
        if op in ("@>", "<@"):
            big, small = (a, b) if op == "@>" else (b, a)
            if self.family(big, scope) == "array":
                return f"forall({small}, _y -> coalesce(array_contains({big}, _y), FALSE))"
            return f"tessera_jsonb_contains({big}, {small})"
        if op == "&&":
            return f"coalesce(arrays_overlap({a}, {b}), FALSE)"
        if op in ("->", "->>", "#>", "#>>"):
            return calls.json_access(op, a, b, fb)
        if op == "/":
            if fa == fb == "int":
                wide = ty.common_type(self.type_of(a, scope), self.type_of(b, scope))
                return f"CAST(({a} div {b}) AS {wide})"
            if "float" in (fa, fb) or "interval" in (fa, fb) or "unknown" in (fa, fb):
                return f"({a} / {b})"
            return f"(CAST({a} AS DECIMAL(38,16)) / {b})"
        if op in ("+", "-"):
            if fa == "date" and fb == "int":
                return f"date_add({a}, {'-' if op == '-' else ''}{b})"
            if fb == "date" and fa == "int":
                return f"date_add({b}, {a})"
            if fa == fb == "date":
                return f"datediff({a}, {b})"
            if op == "-" and fa in ("timestamp", "date") and fb in ("timestamp", "date"):
                ntz = lambda x, f: special.Text(f"CAST({x} AS TIMESTAMP_NTZ)" if f == "date" else x)
                return special.library("interval").between(ntz(a, fa), ntz(b, fb)).sql
            if fa == "date" and fb == "interval":
                return f"(CAST({a} AS TIMESTAMP_NTZ) {op} {b})"
            if fa == "timestamp" and fb == "date":
                return f"({a} {op} CAST({b} AS TIMESTAMP_NTZ))"
        return f"({a} {op} {b})"

    def _special_op(self, op: str, ka, a: str, kb, b: str, scope) -> str | None:
        """An operator that a type of ours takes part in. Intervals that are literals are added to times as
        Spark's own, so that Catalyst folds them and filters reach the scan."""
        if op in ("+", "-") and b in self.natives and not ka and self.family(a, scope) in ("timestamp", "date"):
            a = f"CAST({a} AS TIMESTAMP_NTZ)" if self.family(a, scope) == "date" else a
            return f"({a} {op} {self.natives[b]})"
        if op == "+" and a in self.natives and not kb and self.family(b, scope) in ("timestamp", "date"):
            return self._special_op("+", None, b, ka, a, scope)
        if "tsvector" in (ka, kb) and op == "@@":
            vector, query = (a, b) if ka == "tsvector" else (b, a)
            if query not in self.searches:
                raise SqlError("@@ needs a literal tsquery", "0A000")
            return special.search(vector, self.searches[query])
        if ka == kb == "tsquery" and op in ("&&", "||", "<->"):
            if a not in self.searches or b not in self.searches:
                raise SqlError(f"{op} needs literal tsqueries", "0A000")
            join = {"&&": special.textsearch.conjunction, "||": special.textsearch.disjunction, "<->": special.textsearch.phrase}[op]
            return self._special("tsquery", join(self.searches[a], self.searches[b]))
        out = special.op(op, ka, a, self.type_of(a, scope), kb, b, self.type_of(b, scope))
        if out is None and op not in ("=", "<>", "||", "^@"):
            raise SqlError(f"operator does not exist: {ka or self.type_of(a, scope)} {op} {kb or self.type_of(b, scope)}", "42883")
        return out

    # calls
    def _sequence(self, args: list) -> str:
        name = args[0][1] if args and args[0][0] in ("str", "cast") else None
        name = name[1] if isinstance(name, tuple) else name
        if name is None or name not in self.db.sequences:
            raise SqlError(f'relation "{name}" does not exist', "42P01")
        return name

    def _of_session(self, name: str, args: list, scope) -> str | None:
        """Functions of the session's sequences and settings: values that are known when the query is planned."""
        db = self.db
        if db is None:
            return None
        if name in ("nextval", "currval", "setval"):
            s = self._sequence(args)
            if name == "currval":
                return f"{db.currval(s)}L"
            if scope and scope.from_text:
                raise SqlError(f"{name} inside an expression over a table is not supported", "0A000")
            if name == "nextval":
                return f"{db.nextval(s)}L"
            value = int(self.expr(args[1], scope).rstrip("L"))
            return f"{db.setval(s, value, len(args) < 3 or args[2] != ('const', 'false'))}L"
        if name == "lastval":
            return f"{db.lastval()}L"
        if name == "current_setting":
            value = db.settings.get(args[0][1].lower())
            if value is None and not (len(args) > 1 and args[1] == ("const", "true")):
                raise SqlError(f'unrecognized configuration parameter "{args[0][1]}"', "42704")
            return string(value) if value is not None else "CAST(NULL AS STRING)"
        if name in ("txid_current", "pg_current_xact_id"):
            return f"{db.transaction()}L"
        if name in ("txid_current_if_assigned", "pg_current_xact_id_if_assigned"):
            return f"{db.transaction()}L" if db._saved is not None else "CAST(NULL AS BIGINT)"
        if name in ("pg_relation_size", "pg_table_size", "pg_total_relation_size"):
            return f"{db.size_of(args[0][1] if args[0][0] == 'str' else args[0][1][1])}L"
        if name in ("pg_get_serial_sequence", "pg_get_viewdef", "obj_description", "col_description", "pg_table_is_visible") and args and args[0][0] == "str":
            return db.describe(name, *[a[1] for a in args])
        return None

    def x_call(self, e, scope):
        _, name, args, extra = e
        if "over" in extra:
            return self._windowed(name, args, extra, scope)
        return self._call(name, args, extra, scope, "")

    def _windowed(self, name, args, extra, scope):
        spec = extra["over"]
        text = " OVER (" + self.window(spec, scope) + ")"
        if name in ("row_number", "rank", "dense_rank", "ntile"):
            return f"CAST({name}({', '.join(self.expr(a, scope) for a in args)}){text} AS BIGINT)"
        return self._call(name, args, extra, scope, text)

    def _resolve(self, spec, scope) -> dict:
        if isinstance(spec, str):
            if spec not in scope.windows:
                raise SqlError(f'window "{spec}" does not exist', "42704")
            return self._resolve(scope.windows[spec], scope)
        if spec["base"]:
            base = self._resolve(spec["base"], scope)
            return {"base": None, "partition": base["partition"], "order": spec["order"] or base["order"], "frame": spec["frame"]}
        return spec

    def window(self, spec, scope) -> str:
        spec = self._resolve(spec, scope)
        out = []
        if spec["partition"]:
            out.append("PARTITION BY " + ", ".join(self.expr(p, scope) for p in spec["partition"]))
        if spec["order"]:
            out.append("ORDER BY " + self.order_text(spec["order"], scope))
        if spec["frame"]:
            out.append(spec["frame"].upper())
        return " ".join(out)

    def _call(self, name, args, extra, scope, over: str) -> str:
        keep = f" FILTER (WHERE {self.expr(extra['filter'], scope)})" if "filter" in extra else ""
        distinct = "DISTINCT " if extra.get("distinct") else ""
        if extra.get("star"):
            return f"count(*){keep}{over}"
        if name in calls.AGGREGATES:
            a = [self.expr(x, scope) for x in args]
            order = [(self.expr(x, scope), asc, first) for x, asc, first in extra.get("order") or extra.get("within") or []]
            if a and (kind := self.kind(a[0], scope)) in ("money", "interval", "time") and name in ("sum", "avg", "min", "max"):
                return self._special_aggregate(name, kind, a[0], distinct, keep, over)
            return calls.aggregate(name, a, self.type_of(a[0], scope) if a else "", distinct, keep, over, order)
        if name in self.functions:
            return self._inline(name, args, scope)
        if (out := self._of_session(name, args, scope)) is not None:
            return out
        a = [self.expr(x, scope) for x in args]
        literal = [x[1] if x[0] == "str" else None for x in args]
        kinds = [self.kind(x, scope) for x in a]
        if any(kinds) or name in special.NAMES:
            if name == "date_bin":
                a[0] = self.natives.get(a[0], a[0])
            elif (out := special.call(name, a, kinds, [self.type_of(x, scope) for x in a], literal)) is not None:
                return out
            else:
                a = [special.show(k, x) if k and name in ("concat", "concat_ws", "format", "quote_literal", "md5", "length", "upper", "lower", "left", "right", "to_char") else x for k, x in zip(kinds, a, strict=True)]
        out = calls.scalar(name, a, literal, [lambda x=x: self.type_of(x, scope) for x in a])
        return f"{out}{over}"

    def _special_aggregate(self, name, kind, a, distinct, keep, over) -> str:
        total = lambda x, t: f"CAST(sum({distinct}{x}){keep}{over} AS {t})"
        n = f"count({distinct}{a}){keep}{over}"
        if name in ("min", "max"):
            if kind != "interval":
                return f"{name}({a}){keep}{over}"
            return f"{name}_by({a}, {special.library('interval').span(special.Text(a)).sql}){keep}{over}"
        if kind == "money":
            if name == "avg":
                raise SqlError("function avg(money) does not exist", "42883")
            return f"CASE WHEN {n} > 0 THEN named_struct('cents', {total(a + '.cents', 'BIGINT')}) END"
        if kind == "time":
            raise SqlError(f"function {name}(time without time zone) does not exist", "42883")
        whole = special._interval(total(f"{a}.months", "INT"), total(f"{a}.days", "INT"), total(f"{a}.micros", "BIGINT"))
        if name == "avg":
            whole = special.library("interval").divide(special.Text(whole), special.Text(f"CAST({n} AS DOUBLE)")).sql
        return f"CASE WHEN {n} > 0 THEN {whole} END"

    def _inline(self, name, args, scope):
        """A SQL-language function: its expression with the arguments in place of the parameters."""
        fn = self.functions[name]
        params, body = fn["params"], fn["body"]
        if len(params) != len(args):
            raise SqlError(f"function {name} does not exist", "42883")
        bound = dict(zip((p for p, _ in params), args, strict=True))

        def put(e):
            if isinstance(e, tuple):
                if e and e[0] == "col" and len(e[1]) == 1 and e[1][0] in bound:
                    i = [p for p, _ in params].index(e[1][0])
                    return ("cast", bound[e[1][0]], params[i][1])
                if e and e[0] == "param" and 1 <= e[1] <= len(args):
                    return ("cast", args[e[1] - 1], params[e[1] - 1][1])
                return tuple(put(x) for x in e)
            if isinstance(e, list):
                return [put(x) for x in e]
            if isinstance(e, dict):
                return {k: put(v) for k, v in e.items()}
            return e

        text = self._cast(self.expr(put(body), scope), fn["returns"], scope)
        if fn["strict"]:
            nulls = " OR ".join(f"{self.expr(a, scope)} IS NULL" for a in args)
            text = f"CASE WHEN {nulls} THEN NULL ELSE {text} END" if nulls else text
        return text



def to_spark(spark: SparkSession, text: str, args: list | None = None, functions: dict | None = None, enums: dict | None = None) -> str:
    """Spark SQL for a PostgreSQL query."""
    return Emitter(spark, args, functions, enums).query(parse_query(text))
