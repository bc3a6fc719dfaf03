"""A database of Parquet tables with PostgreSQL's statements on top.

Tables are lists of immutable Parquet folders. INSERT and COPY add a folder with the new rows, UPDATE and DELETE
write the table's rows once into a new one; the list is swapped after the constraints hold, so a failed statement
changes nothing. Constraints are checked on the new rows alone, in one pass; keys are joined with the old ones.
VACUUM deletes folders that no table lists any more. Queries are rewritten to Spark SQL and run by Catalyst.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import types as ty
from .functions import udfs
from .plans import special
from .plans.dialect import Emitter, Scope, ident, string
from .plans.parser import Parser, SqlError
from .scratch import shared_folder

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass
class Table:
    name: str
    columns: list[tuple[str, str]] = field(default_factory=list)  # name, Spark type
    paths: tuple[str, ...] = ()  # the folders that make up its rows
    defaults: dict[str, object] = field(default_factory=dict)
    not_null: set[str] = field(default_factory=set)
    checks: list[tuple[str, object]] = field(default_factory=list)
    unique: list[tuple[str, list[str]]] = field(default_factory=list)
    generated: dict[str, tuple[object, bool]] = field(default_factory=dict)  # expression, stored
    lengths: dict[str, int] = field(default_factory=dict)
    partition_by: str | None = None
    partitions: list[str] = field(default_factory=list)
    bounds: tuple[object, object] | None = None
    parent: str | None = None
    children: list[str] = field(default_factory=list)


@dataclass
class Sequence:
    start: int = 1
    step: int = 1
    last: int | None = None


class Database:
    """One session: its tables, views, functions, types, prepared statements, cursors and transaction."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        base = folder or shared_folder(spark)
        self.folder = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex[:12]}"
        self.tables: dict[str, Table] = {}
        self.views: dict[str, str] = {}
        self.functions: dict[str, dict] = {}
        self.enums: dict[str, list[str]] = {}
        self.sequences: dict[str, Sequence] = {}
        self.prepared: dict[str, tuple[list, str]] = {}
        self.cursors: dict[str, Cursor] = {}
        self.settings: dict[str, str] = {"datestyle": "ISO, MDY", "timezone": "UTC", "search_path": '"$user", public'}
        self.special: set[str] = set()  # tables and views with a column of a type that Spark lacks
        self._saved: dict | None = None
        # compiled, a full join holds all rows of a key before it hands on the first
        spark.conf.set("spark.sql.codegen.join.fullOuterSortMergeJoin.enabled", "false")
        udfs.register(spark)

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> Database:
        """A database whose tables are the Parquet files of a folder."""
        db = cls(spark)
        for t in TABLES if tables is None else tables:
            db._named(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        return db

    def _named(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)
        self.special.discard(name)
        if any(special.kind_of(f.dataType.simpleString()) for f in df.schema):
            self.special.add(name)

    # entry points
    def sql(self, text: str, args: list | None = None) -> DataFrame:
        """Runs one statement. Queries are lazy; other statements act at once."""
        p = Parser(text)
        word = p.peek()[1]
        if word in ("select", "with", "values", "table", "("):
            return self.query(text, args)
        method = getattr(self, f"_{word}_" if word == "commit" else f"_{word}", None)
        if method is None or word.startswith("_"):
            raise SqlError(f'syntax error at or near "{word}"')
        p.i += 1
        self._args = args
        out = method(p, text)
        return out if isinstance(out, DataFrame) else self.spark.createDataFrame([(out or word.upper(),)], "command string")

    def query(self, text: str, args: list | None = None) -> DataFrame:
        """The rows of a query; values of types that Spark lacks in their output form."""
        p = Parser(text)
        q = p.query()
        p.done()
        em = self._emitter(args)
        return self._shown(self._numbers(self.spark.sql(em.query(q)), em.numbered))

    @staticmethod
    def _shown(df: DataFrame) -> DataFrame:
        kinds = [special.kind_of(f.dataType.simpleString()) for f in df.schema]
        if not any(kinds):
            return df
        plain = df.toDF(*[f"c{i}" for i in range(len(kinds))])
        return plain.select(*[(F.expr(special.show(k, f"c{i}")) if k else F.col(f"c{i}")).alias(c) for i, (k, c) in enumerate(zip(kinds, df.columns, strict=True))])

    def _numbers(self, df: DataFrame, numbered: list[tuple[str, str]]) -> DataFrame:
        """Sequences' values in place of the row numbers in these columns, one after another without gaps."""
        if not numbered:
            return df
        rows = self._pinned(df)
        for name, sequence in numbered:
            number, n = self._consecutive(rows, F.col(f"`{name}`"))
            s = self.sequences[sequence]
            first = s.start if s.last is None else s.last + s.step
            rows = rows.withColumn(name, number * s.step + first)
            if n:
                s.last = first + (n - 1) * s.step
                self._lastval = sequence
        return rows

    def _consecutive(self, rows: DataFrame, place):
        """(0, 1, 2, ... for the rows in the order of monotonically increasing ids, and their number). The ids
        hold their partition above 33 bits; only the partitions' counts come to the driver."""
        part = F.shiftright(place, 33)
        counts = sorted(tuple(r) for r in rows.groupBy(part.alias("p")).count().collect())
        before, total = {}, 0
        for p, n in counts:
            before[p] = total
            total += n
        offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map().cast("map<bigint,bigint>")
        return F.element_at(offsets.cast("map<bigint,bigint>"), part) + place.bitwiseAND(F.lit((1 << 33) - 1)), total

    def translate(self, text: str, args: list | None = None) -> str:
        """The Spark SQL of a query."""
        p = Parser(text)
        q = p.query()
        p.done()
        return self._emitter(args).query(q)

    def explain(self, text: str) -> str:
        return self.query(text)._jdf.queryExecution().toString()

    def _emitter(self, args=None) -> Emitter:
        em = Emitter(self.spark, args, self.functions, self.enums)
        em.db = self
        return em

    def _expr(self, e, t: Table | None = None):
        """A Column from a parsed expression over a table's columns."""
        return F.expr(self._emitter(getattr(self, "_args", None)).expr(e, self._scope(t)))

    @staticmethod
    def _scope(t: Table | None) -> Scope | None:
        """What expressions over a table see: its columns by their types, without reading a row."""
        if t is None:
            return None
        columns = ", ".join(f"CAST(NULL AS {k}) AS {ident(c)}" for c, k in t.columns)
        return Scope("", f"(SELECT {columns}) AS {ident(t.name)}", None)

    # tables
    def frame(self, name: str) -> DataFrame:
        """The rows of a table: its own, its partitions' and its children's."""
        t = self._table(name)
        arms = [self._own(t)] if not t.partition_by else []
        arms += [self.frame(c) for c in (*t.partitions, *t.children)]
        cols = [c for c, _ in t.columns]
        if not arms:
            return self.spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in t.columns))
        return reduce(lambda a, b: a.unionByName(b), (a.select(*cols) for a in arms))

    def _own(self, t: Table, paths: tuple[str, ...] | None = None) -> DataFrame:
        """The rows of a table's own folders (or of some of them)."""
        paths = t.paths if paths is None else paths
        schema = ", ".join(f"`{c}` {k}" for c, k in self._stored(t))
        df = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        for c, (e, kept) in t.generated.items():
            if not kept:
                df = df.withColumn(c, self._expr(e, t).cast(dict(t.columns)[c]))
        return df.select(*[c for c, _ in t.columns])

    @staticmethod
    def _stored(t: Table) -> list[tuple[str, str]]:
        return [(c, k) for c, k in t.columns if c not in t.generated or t.generated[c][1]]

    def _table(self, name: str) -> Table:
        if name not in self.tables:
            raise SqlError(f'relation "{name}" does not exist', "42P01")
        return self.tables[name]

    def _publish(self, name: str) -> None:
        """Views are names for snapshots: everything above a changed table is named anew."""
        while name:
            self._named(name, self.frame(name))
            name = self.tables[name].parent

    def _write(self, t: Table, df: DataFrame) -> str:
        path = f"{self.folder}/{t.name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _commit(self, t: Table, path: str, append: bool) -> None:
        """Takes a folder of rows into the table, beside its others or in their place, if the constraints hold."""
        old = t.paths
        t.paths = (*old, path) if append else (path,)
        try:
            self._validate(t, self._own(t, (path,)), self._own(t, old) if append and old else None)
        except Exception:
            t.paths = old
            raise
        self._publish(t.name)

    def _validate(self, t: Table, rows: DataFrame, before: DataFrame | None = None) -> None:
        """Checks new rows: one pass for all that concerns a row by itself, then each key, on the new rows and
        against the rows before."""
        tests = [(F.col(c).isNull(), f'null value in column "{c}" of relation "{t.name}" violates not-null constraint', "23502") for c in sorted(t.not_null)]
        tests += [(~F.coalesce(self._expr(e, t), F.lit(True)), f'new row for relation "{t.name}" violates check constraint "{name}"', "23514") for name, e in t.checks]
        tests += [(F.char_length(F.rtrim(c)) > n, f"value too long for type character varying({n})", "22001") for c, n in t.lengths.items()]
        key = self.tables[t.parent].partition_by if t.bounds and t.parent else None
        if key:
            tests.append((~F.coalesce(self._inside(t, key), F.lit(False)), f'new row for relation "{t.name}" violates partition constraint', "23514"))
        if tests:
            broken = rows.agg(*[F.bool_or(x).alias(f"b{i}") for i, (x, _, _) in enumerate(tests)]).first()
            for wrong, (_, message, state) in zip(broken, tests, strict=True):
                if wrong:
                    raise SqlError(message, state)
        for name, cols in t.unique:
            keyed = rows.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols))).select(*cols)
            twice = not keyed.groupBy(*cols).count().where("count > 1").isEmpty()
            if twice or (before is not None and not before.select(*cols).join(keyed, cols, "left_semi").isEmpty()):
                raise SqlError(f'duplicate key value violates unique constraint "{name}"', "23505")

    def _inside(self, t: Table, key: str):
        lo, hi = t.bounds
        kind = dict(t.columns)[key]
        c = F.lit(True)
        if lo is not None:
            c = c & (F.col(key) >= F.expr(lo).cast(kind))
        if hi is not None:
            c = c & (F.col(key) < F.expr(hi).cast(kind))
        return c

    # CREATE
    def _create(self, p: Parser, text: str):
        p.take_all("or", "replace")
        temp = p.take("temp", "temporary")
        what = p.ident()
        if what == "unique":
            what = p.ident()
        return getattr(self, f"_create_{what}", self._unknown)(p, text, temp)

    def _unknown(self, p, text, temp=None):
        raise SqlError(f"statement is not supported: {text[:40]}", "0A000")

    def _create_table(self, p: Parser, text: str, temp):
        exists_ok = p.take_all("if", "not", "exists")
        name = p.ident()
        if name in self.tables:
            if exists_ok:
                return "CREATE TABLE"
            raise SqlError(f'relation "{name}" already exists', "42P07")
        t = Table(name)
        if p.take("as"):
            df = self.query(text[re.search(r"(?i)\bas\b", text).end() :])
            t.columns = [(f.name, f.dataType.simpleString()) for f in df.schema]
            self.tables[name] = t
            self._commit(t, self._write(t, df), append=False)
            return "SELECT"
        if p.take_all("partition", "of"):
            return self._create_partition(p, t)
        p.need("(")
        while not p.at(")"):
            self._definition(p, t)
            if not p.take(","):
                break
        p.need(")")
        if p.take("inherits"):
            parent = p.names()[0]
            up = self._table(parent)
            have = {c for c, _ in t.columns}
            t.columns = [c for c in up.columns if c[0] not in have] + t.columns
            t.not_null |= up.not_null
            t.checks = [*up.checks, *t.checks]
            t.parent = parent
            up.children.append(name)
        if p.take_all("partition", "by"):
            if p.ident() != "range":
                raise SqlError("only RANGE partitions are supported", "0A000")
            t.partition_by = p.names()[0]
        self.tables[name] = t
        self._publish(name)
        return "CREATE TABLE"

    def _create_partition(self, p: Parser, t: Table):
        up = self._table(p.ident())
        p.need("for")
        p.need("values")
        p.need("from")

        def bound():
            p.need("(")
            e = None if p.take("minvalue", "maxvalue") else p.expr()
            p.need(")")
            return None if e is None else self._emitter().expr(e, None)

        lo = bound()
        p.need("to")
        t.bounds = (lo, bound())
        t.columns, t.not_null, t.checks, t.unique, t.defaults, t.parent = up.columns, up.not_null, up.checks, up.unique, up.defaults, up.name
        t.generated, t.lengths = up.generated, up.lengths
        up.partitions.append(t.name)
        self.tables[t.name] = t
        self._publish(t.name)
        return "CREATE TABLE"

    def _definition(self, p: Parser, t: Table) -> None:
        label = None
        if p.take("constraint"):
            label = p.ident()
        if p.at("primary", "unique", "check") and (label or not p.peek(1)[0] == "name" or p.at("primary")):
            self._constraint(p, t, label, None)
            return
        column = p.ident()
        name, args, array = p.type_name()
        if name in ("serial", "bigserial"):
            self.sequences[f"{t.name}_{column}_seq"] = Sequence()
            t.defaults[column] = ("call", "nextval", [("str", f"{t.name}_{column}_seq")], {})
            name = "int" if name == "serial" else "bigint"
        kind = "STRING" if name in self.enums else ty.spark_type(name, args, array)
        if name in self.enums:
            labels = self.enums[name]
            t.checks.append((f"{t.name}_{column}_enum", ("in", ("col", [column]), [("str", x) for x in labels], False)))
        if name in ("varchar", "char", "character") and args:
            t.lengths[column] = args[0]
        t.columns.append((column, kind.lower() if "<" not in kind else kind))
        while not p.at(",", ")"):
            label = p.ident() if p.take("constraint") else None
            if p.take("not"):
                p.need("null")
                t.not_null.add(column)
            elif p.take("null"):
                pass
            elif p.take("default"):
                t.defaults[column] = p.other()
            elif p.take("generated"):
                p.take("always")
                p.need("as")
                p.need("(")
                e = p.expr()
                p.need(")")
                stored = not p.take("virtual")
                p.take("stored")
                t.generated[column] = (e, stored)
            elif p.at("primary", "unique", "check"):
                self._constraint(p, t, label, column)
            else:
                raise SqlError(f'syntax error at or near "{p.peek()[1]}"')

    def _constraint(self, p: Parser, t: Table, label, column) -> None:
        word = p.ident()
        if word == "check":
            p.need("(")
            e = p.expr()
            p.need(")")
            taken = {n for n, _ in t.checks}
            base = label or f"{t.name}_{column + '_' if column else ''}check"
            name, k = base, 0
            while name in taken:
                k += 1
                name = f"{base}{k}"
            t.checks.append((name, e))
            return
        if word == "primary":
            p.need("key")
        cols = [column] if column else p.names()
        if word == "primary":
            t.not_null |= set(cols)
        t.unique.append((label or (f"{t.name}_pkey" if word == "primary" else f"{t.name}_{'_'.join(cols)}_key"), cols))

    def _create_view(self, p: Parser, text: str, temp):
        name = p.ident()
        cols = p.names() if p.at("(") else None
        p.need("as")
        q = p.query()
        p.done()
        df = self.spark.sql(self._emitter().query(q))
        self._named(name, df.toDF(*cols) if cols else df)
        self.views[name] = text
        return "CREATE VIEW"

    def _create_type(self, p: Parser, text: str, temp):
        name = p.ident()
        p.need("as")
        if p.ident() != "enum":
            raise SqlError("only enum types are supported", "0A000")
        p.need("(")
        labels = [e[1] for e in p.expr_list()]
        if len(set(labels)) != len(labels):
            raise SqlError(f'enum label "{max(labels, key=labels.count)}" used more than once', "42710")
        self.enums[name] = labels
        return "CREATE TYPE"

    def enum_rank(self, name: str, column: str):
        """The place of an enum value in its type's definition, to order by."""
        return F.array_position(F.array(*map(F.lit, self.enums[name])), F.col(column))

    def _create_sequence(self, p: Parser, text: str, temp):
        name, s = p.ident(), Sequence()
        while p.peek()[0] != "end" and not p.at(";"):
            word = p.ident()
            p.take("by") or p.take("with")
            if word in ("increment", "start"):
                sign = -1 if p.take("-") else 1
                v = sign * int(p.peek()[1])
                p.i += 1
                if word == "increment":
                    s.step = v
                else:
                    s.start = v
        self.sequences[name] = s
        return "CREATE SEQUENCE"

    def nextval(self, name: str) -> int:
        s = self.sequences[name]
        self._lastval = name
        s.last = s.start if s.last is None else s.last + s.step
        return s.last

    def currval(self, name: str) -> int:
        if self.sequences[name].last is None:
            raise SqlError(f'currval of sequence "{name}" is not yet defined in this session', "55000")
        return self.sequences[name].last

    def lastval(self) -> int:
        if getattr(self, "_lastval", None) is None:
            raise SqlError("lastval is not yet defined in this session", "55000")
        return self.currval(self._lastval)

    def transaction(self) -> int:
        """The number of the transaction, or of the statement outside one."""
        if self._saved is None or getattr(self, "_xid", None) is None:
            self._xid = getattr(self, "_xid_last", 2) + 1
            self._xid_last = self._xid
        return self._xid

    def size_of(self, name: str) -> int:
        """Bytes of a table's files."""
        paths = [x for leaf in self._leaves(self._table(name)) for x in leaf.paths] if name in self.tables else []
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
        return sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in found)

    def describe(self, name: str, *args: str) -> str:
        """Catalog functions as literals."""
        if name == "pg_get_serial_sequence":
            e = self._table(args[0]).defaults.get(args[1])
            return string(f"public.{e[2][0][1]}") if isinstance(e, tuple) and e[:2] == ("call", "nextval") else "CAST(NULL AS STRING)"
        if name == "pg_get_viewdef":
            text = self.views.get(args[0])
            return string(re.sub(r"(?is)^.*?\bas\b\s*", " ", text, count=1).rstrip("; ") + ";") if text else "CAST(NULL AS STRING)"
        if name == "pg_table_is_visible":
            return str(args[0] in self.tables or args[0] in self.views).upper()
        return "CAST(NULL AS STRING)"

    def setval(self, name: str, value: int, called: bool = True) -> int:
        s = self.sequences[name]
        s.last = value if called else value - s.step
        return value

    def _create_function(self, p: Parser, text: str, temp):
        """LANGUAGE SQL functions of one expression, put in place of their calls."""
        name = p.ident()
        p.need("(")
        params = []
        while not p.at(")"):
            kind, v = p.peek(1)
            label = p.ident() if kind == "name" and not p.at(",", ")", k=1) and not p.at("precision", "varying", "(", "[", k=1) else f"${len(params) + 1}"
            params.append((label, p.type_name()))
            p.take(",")
        p.need(")")
        p.need("returns")
        returns = p.type_name()
        strict, body, language = False, None, "sql"
        while p.peek()[0] != "end" and not p.at(";"):
            if p.take("language"):
                language = p.ident()
            elif p.take("strict"):
                strict = True
            elif p.take_all("returns", "null", "on", "null", "input"):
                strict = True
            elif p.take("as"):
                body = p.peek()[1]
                p.i += 1
            elif p.take("return"):
                body = p.expr()
            else:
                p.i += 1
        if language == "plpgsql":
            from .procedural import Routine

            self.routines = {**getattr(self, "routines", {}), name: Routine(self, name, params, body)}
            return "CREATE FUNCTION"
        if isinstance(body, str):
            b = Parser(body)
            b.take("select")
            body = b.expr()
        self.functions[name] = {"params": params, "returns": returns, "strict": strict, "body": body}
        return "CREATE FUNCTION"

    _create_procedure = _create_function

    def _create_index(self, p, text, temp):
        m = re.search(r"(?is)create\s+unique\s+index\s+(\w+)?\s*on\s+(\w+)\s*\(([^)]*)\)", text)
        if m:
            t = self._table(m[2].lower())
            t.unique.append((m[1] or f"{m[2]}_idx", [c.strip() for c in m[3].split(",")]))
            self._validate(t, self._own(t))
        return "CREATE INDEX"

    def _create_schema(self, p, text, temp):
        return "CREATE SCHEMA"

    def _drop(self, p: Parser, text: str):
        what = p.ident()
        quiet = p.take_all("if", "exists")
        name = p.ident()
        store = {"table": self.tables, "view": self.views, "function": self.functions, "type": self.enums, "sequence": self.sequences}.get(what, {})
        if name not in store and not quiet:
            raise SqlError(f'{what} "{name}" does not exist', "42P01")
        gone = store.pop(name, None)
        if what in ("table", "view"):
            self.spark.catalog.dropTempView(name)
        if isinstance(gone, Table) and gone.parent:
            up = self.tables[gone.parent]
            up.partitions = [x for x in up.partitions if x != name]
            up.children = [x for x in up.children if x != name]
            self._publish(up.name)
        return f"DROP {what.upper()}"

    def _alter(self, p: Parser, text: str):
        p.need("table")
        t = self._table(p.ident())
        p.need("add")
        label = p.ident() if p.take("constraint") else None
        self._constraint(p, t, label, None)
        self._validate(t, self._own(t))
        return "ALTER TABLE"

    # DML
    def _insert(self, p: Parser, text: str):
        p.need("into")
        t = self._table(p.ident())
        names = [c for c, _ in t.columns]
        cols = p.names() if p.at("(") else [c for c in names if c not in t.generated]
        for c in cols:
            if c in t.generated:
                raise SqlError(f'cannot insert a non-DEFAULT value into column "{c}"', "428C9")
        em = self._emitter(getattr(self, "_args", None))
        kinds = dict(t.columns)
        if p.take_all("default", "values"):
            rows, cols = self.spark.range(1), []
        elif p.take("values"):
            parts, marks = [], []
            while True:
                p.need("(")
                r = p.expr_list()
                p.need(")")
                if len(r) > len(cols):
                    raise SqlError("INSERT has more expressions than target columns", "42601")
                parts.append(r)
                marks.append({i for i, e in enumerate(r) if e == ("const", "default")})
                if not p.take(","):
                    break
            cols = cols[: len(parts[0])]
            body = [
                "(" + ", ".join(em.expr(self._default(t, cols[i]) if i in m else self._meant(e, kinds[cols[i]]), None) for i, e in enumerate(r)) + ")" for r, m in zip(parts, marks, strict=True)
            ]
            rows = self.spark.sql(f"SELECT * FROM VALUES {', '.join(body)} AS v({', '.join(f'c{i}' for i in range(len(cols)))})")
        else:
            q = p.query()
            rows = self.spark.sql(em.query(q))
            cols = cols[: len(rows.columns)]
        rows = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
        put = {c: self._assigned(F.col(f"c{i}"), rows.schema[i].dataType.simpleString(), kinds[c]) for i, c in enumerate(cols)}
        counted = {c: s for c in names if c not in put and c not in t.generated and (s := self._own_sequence(t, c))}
        if counted:
            rows = self._numbers(rows.select("*", *[F.monotonically_increasing_id().alias(f"_n_{c}") for c in counted]), [(f"_n_{c}", s) for c, s in counted.items()])
            put |= {c: F.col(f"_n_{c}").cast(kinds[c]) for c in counted}
        for c in names:
            if c not in put and c not in t.generated:
                put[c] = F.expr(em.expr(self._meant(self._default(t, c), kinds[c]), None)).cast(kinds[c])
        rows = rows.select(*[put[c].alias(c) for c in names if c not in t.generated])
        for c, (e, _) in t.generated.items():
            rows = rows.withColumn(c, F.expr(em.expr(e, self._scope(t))).cast(kinds[c]))
        rows = self._added(t, rows.select(*names))
        return self._returning(p, t, rows, f"INSERT 0 {rows.count()}")

    def _added(self, t: Table, rows: DataFrame) -> DataFrame:
        """Adds rows to a table, written once; to a partitioned table once more, by partition."""
        if t.partition_by:
            rows = self._pinned(rows)
            self._route(t, rows)
            return rows
        path = self._write(t, rows.select(*[c for c, _ in self._stored(t)]))
        self._commit(t, path, append=True)
        return self._own(t, (path,))

    @staticmethod
    def _own_sequence(t: Table, c: str) -> str | None:
        """The sequence that a column's default draws from."""
        e = t.defaults.get(c)
        return e[2][0][1] if isinstance(e, tuple) and e[:2] == ("call", "nextval") else None

    @staticmethod
    def _meant(e, kind: str):
        """A literal for a column of a type that Spark lacks is of that type."""
        special_kind = special.kind_of(kind)
        return ("cast", e, (special_kind, (), False)) if special_kind and e[0] == "str" else e

    @staticmethod
    def _assigned(column, have: str, want: str):
        kind = special.kind_of(want)
        if kind and have == "string":
            return F.call_function(f"tessera_to_{kind}", column).cast(want)
        return column.cast(want)

    def _default(self, t: Table, c: str):
        e = t.defaults.get(c, ("const", "null"))
        if isinstance(e, tuple) and e[0] == "call" and e[1] == "nextval":
            return ("num", str(self.nextval(e[2][0][1])))
        return e

    def _pinned(self, df: DataFrame) -> DataFrame:
        """The statement's rows, computed once."""
        path = f"{self.folder}/_rows/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _route(self, t: Table, rows: DataFrame) -> None:
        """Rows to the leaf whose bounds hold them; all of them or none."""
        if not t.partition_by:
            self._added(t, rows)
            return
        rest, plan = rows, []
        for leaf in (self._table(n) for n in t.partitions):
            inside = F.coalesce(self._inside(leaf, t.partition_by), F.lit(False))
            plan.append((leaf, rows.where(inside)))
            rest = rest.where(~inside)
        if not rest.isEmpty():
            raise SqlError(f'no partition of relation "{t.name}" found for row', "23514")
        saved = {leaf.name: leaf.paths for leaf, _ in plan}
        try:
            for leaf, part in plan:
                if not part.isEmpty():
                    self._route(leaf, part)
        except Exception:
            for leaf, _ in plan:
                leaf.paths = saved[leaf.name]
            self._publish(t.name)
            raise

    def _returning(self, p: Parser, t: Table, rows: DataFrame, command: str):
        if not p.take("returning"):
            p.done()
            return command
        items = [p.select_item()]
        while p.take(","):
            items.append(p.select_item())
        p.done()
        em = self._emitter()
        name = f"_r{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(name)
        cols = ["*" if e[0] == "star" else f"{em.expr(e, self._scope(t))} AS {ident(a or em.default_name(e))}" for e, a in items]
        return self._shown(self.spark.sql(f"SELECT {', '.join(cols)} FROM {name}"))

    def _leaves(self, t: Table) -> list[Table]:
        below = [x for n in (*t.partitions, *t.children) for x in self._leaves(self._table(n))]
        return below if t.partition_by else [t, *below]

    def _update(self, p: Parser, text: str):
        t = self._table(p.ident())
        p.take("as")
        p.need("set")
        sets = {}
        while True:
            c = p.ident()
            p.need("=")
            sets[c] = p.expr()
            if not p.take(","):
                break
        where = p.expr() if p.take("where") else ("const", "true")
        em = self._emitter(getattr(self, "_args", None))
        kinds = dict(t.columns)
        changed, plan = [], []
        for leaf in self._leaves(t):
            own = self._own(leaf)
            scope = self._scope(t)
            hit = F.coalesce(F.expr(em.expr(where, scope)), F.lit(False))
            values = {c: F.expr(em.expr(self._default(t, c) if e == ("const", "default") else self._meant(e, kinds[c]), scope)).cast(kinds[c]) for c, e in sets.items()}
            marked = own.withColumn("_hit", hit)
            after = marked.select(*[(F.when(F.col("_hit"), values[c]).otherwise(F.col(c)) if c in values else F.col(c)).alias(c) for c, _ in t.columns], "_hit")
            for c, (e, _) in t.generated.items():
                after = after.withColumn(c, F.expr(em.expr(e, scope)).cast(kinds[c]))
            # one folder holds the rows and which of them have changed; the table does not read that column
            path = self._write(leaf, after)
            after = self.spark.read.schema(after.schema).parquet(path)
            changed.append(after.where("_hit").drop("_hit"))
            plan.append((leaf, after.drop("_hit"), path))
        rows = reduce(DataFrame.unionByName, changed)
        saved = {leaf.name: leaf.paths for leaf, _, _ in plan}
        try:
            if t.partition_by in sets:  # rows may change partitions
                for leaf, _, _ in plan:
                    leaf.paths = ()
                self._route(t, reduce(DataFrame.unionByName, (a for _, a, _ in plan)))
            else:
                for leaf, _, path in plan:
                    self._commit(leaf, path, append=False)
        except Exception:
            for leaf, _, _ in plan:
                leaf.paths = saved[leaf.name]
                self._publish(leaf.name)
            raise
        return self._returning(p, t, rows, f"UPDATE {rows.count()}")

    def _delete(self, p: Parser, text: str):
        p.need("from")
        t = self._table(p.ident())
        where = p.expr() if p.take("where") else ("const", "true")
        em = self._emitter(getattr(self, "_args", None))
        gone = []
        for leaf in self._leaves(t):
            own, hit = self._own(leaf), F.coalesce(F.expr(em.expr(where, self._scope(t))), F.lit(False))
            gone.append(own.where(hit))  # from the folders before, which stay as they are
            leaf.paths = (self._write(leaf, own.where(~hit).select(*[c for c, _ in self._stored(leaf)])),)
            self._publish(leaf.name)
        rows = reduce(DataFrame.unionByName, gone)
        return self._returning(p, t, rows, f"DELETE {rows.count()}")

    def _truncate(self, p: Parser, text: str):
        p.take("table")
        while True:
            for leaf in self._leaves(self._table(p.ident())):
                leaf.paths = ()
                self._publish(leaf.name)
            if not p.take(","):
                return "TRUNCATE TABLE"

    def copy(self, name: str, path: str, options=None) -> int:
        """COPY name FROM path."""
        from pyspark.sql.types import StructType

        from .sources.copy import CopyOptions, copy_from

        t = self._table(name)
        o = options or CopyOptions()
        em = self._emitter()
        o.defaults = {c: F.expr(em.expr(e, None)) for c, e in t.defaults.items() if e[0] != "call"}
        schema = StructType.fromDDL(", ".join(f"`{c}` {k}" for c, k in t.columns))
        return self._added(t, copy_from(self.spark, path, schema, o)).count()

    def _copy(self, p: Parser, text: str):
        """COPY table [(columns)] FROM 'path' | STDIN [WITH] (option value, ...). STDIN's lines are the argument."""
        from .sources.copy import CopyOptions

        name = p.ident()
        columns = tuple(p.names()) if p.at("(") else None
        p.need("from")
        if p.take("stdin"):
            path = f"{self.folder}/_stdin/{uuid.uuid4().hex}"
            lines = [(x,) for x in (self._args[0] if self._args else "").split("\n")]
            self.spark.createDataFrame(lines[:-1] if lines[-1] == ("",) else lines, "value string").coalesce(1).write.text(path)
        else:
            path = p.peek()[1]
            p.i += 1
        p.take("with")
        o = CopyOptions(columns=columns)
        if p.take("("):
            while not p.take(")"):
                word = p.ident()
                kind, value = p.peek()
                if word == "header":
                    o.header = True
                    if not p.at(",", ")"):
                        p.i += 1
                        o.header = "match" if value == "match" else value in ("true", "on", "1")
                elif word == "force_not_null":
                    o.force_not_null = tuple(p.names())
                elif word in ("format", "delimiter", "null", "quote", "escape"):
                    p.i += 1
                    setattr(o, word, value)
                else:
                    raise SqlError(f'option "{word}" not recognized', "42601")
                p.take(",")
        p.done()
        return f"COPY {self.copy(name, path, o)}"

    # transactions: a snapshot of all table versions
    def _begin(self, p, text):
        self._saved = {n: (t.paths, t) for n, t in self.tables.items()}
        return "BEGIN"

    _start = _begin

    def _commit_(self, p, text):
        self._saved = None
        return "COMMIT"

    def _rollback(self, p, text):
        if self._saved is not None:
            self.tables = {}
            for n, (path, t) in self._saved.items():
                t.paths = path
                self.tables[n] = t
            for n in list(self.tables):
                self._publish(n)
        self._saved = None
        return "ROLLBACK"

    _abort = _rollback

    def _end(self, p, text):
        return self._commit_(p, text)

    # prepared statements, cursors, settings
    def _prepare(self, p: Parser, text: str):
        name = p.ident()
        kinds = []
        if p.take("("):
            while not p.take(")"):
                kinds.append(p.type_name())
                p.take(",")
        p.need("as")
        body = text[re.search(r"(?i)\bas\b", text).end() :]
        self.prepared[name] = (kinds, body)
        return "PREPARE"

    def _execute(self, p: Parser, text: str):
        name = p.ident()
        if name not in self.prepared:
            raise SqlError(f'prepared statement "{name}" does not exist', "26000")
        args = []
        if p.take("("):
            for e in p.expr_list():
                args.append(self.spark.sql(f"SELECT {self._emitter().expr(e, None)} AS x").first()[0])
            p.need(")")
        return self.sql(self.prepared[name][1], args)

    def _deallocate(self, p: Parser, text: str):
        p.take("prepare")
        if p.take("all"):
            self.prepared.clear()
        else:
            self.prepared.pop(p.ident(), None)
        return "DEALLOCATE"

    def _declare(self, p: Parser, text: str):
        name = p.ident()
        df = self.query(text[re.search(r"(?i)\bfor\b", text).end() :])
        rows = self._pinned(df.withColumn("_place", F.monotonically_increasing_id()))
        number, total = self._consecutive(rows, F.col("_place"))
        self.cursors[name] = Cursor(rows.withColumn("_place", number), total)
        return "DECLARE CURSOR"

    def _fetch(self, p: Parser, text: str):
        n: int | None = 1
        back = False
        if p.take("next"):
            pass
        elif p.take("all"):
            n = None
        elif p.take("backward", "prior"):
            back = True
        elif p.take("forward"):
            pass
        if p.peek()[0] == "number":
            n = int(p.peek()[1])
            p.i += 1
        elif p.take("all"):
            n = None
        p.take("from") or p.take("in")
        name = p.ident()
        if name not in self.cursors:
            raise SqlError(f'cursor "{name}" does not exist', "34000")
        return self.cursors[name].fetch(n, back)

    def _move(self, p: Parser, text: str):
        return f"MOVE {self._fetch(p, text).count()}"

    def _close(self, p: Parser, text: str):
        if p.take("all"):
            self.cursors.clear()
        else:
            self.cursors.pop(p.ident())
        return "CLOSE CURSOR"

    def _set(self, p: Parser, text: str):
        p.take("local") or p.take("session")
        name = p.ident()
        p.take("=") or p.take("to")
        self.settings[name] = p.peek()[1]
        return "SET"

    def _show(self, p: Parser, text: str):
        name = p.ident()
        if name not in self.settings:
            raise SqlError(f'unrecognized configuration parameter "{name}"', "42704")
        return self.spark.createDataFrame([(self.settings[name],)], f"`{name}` string")

    def _reset(self, p: Parser, text: str):
        self.settings.pop(p.ident(), None)
        return "RESET"

    def _explain(self, p: Parser, text: str):
        body = re.sub(r"(?i)^\s*explain\s*(analyze)?", "", text)
        lines = self.explain(body).splitlines()
        return self.spark.createDataFrame([(x,) for x in lines], "`QUERY PLAN` string")

    def _analyze(self, p, text):
        return "ANALYZE"

    def _vacuum(self, p, text):
        """Deletes the folders of rows that neither a table nor an open transaction lists."""
        kept = {x for t in self.tables.values() for x in t.paths} | {x for paths, _ in (self._saved or {}).values() for x in paths}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in self.tables:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            fs = folder.getFileSystem(conf)
            for f in fs.listStatus(folder) if fs.exists(folder) else []:
                if f"{self.folder}/{name}/{f.getPath().getName()}" not in kept:
                    fs.delete(f.getPath(), True)
        return "VACUUM"

    def _do(self, p: Parser, text: str):
        from .procedural import Routine

        Routine(self, "do", [], p.peek()[1]).call([])
        return "DO"

    def _call(self, p: Parser, text: str):
        name = p.ident()
        p.need("(")
        args = [] if p.at(")") else [self.spark.sql(f"SELECT {self._emitter().expr(e, None)} AS x").first()[0] for e in p.expr_list()]
        self.call(name, *args)
        return "CALL"

    def call(self, name: str, *args):
        """Runs a procedural function on the driver."""
        routines = getattr(self, "routines", {})
        if name not in routines:
            raise SqlError(f"function {name} does not exist", "42883")
        return routines[name].call(list(args))

    def quote(self, value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).upper()
        return repr(value) if isinstance(value, (int, float)) else string(str(value))


class Cursor:
    """A query's rows, written once with their places, and a position among them. What is fetched is a range of
    places, read when it is asked for; nothing is kept on the driver."""

    def __init__(self, rows: DataFrame, total: int):
        self.rows, self.total = rows, total
        self.at = 0  # rows before the position

    def fetch(self, n: int | None, back: bool = False) -> DataFrame:
        if back:
            first = max(0, self.at - 1)
            least = 0 if n is None else max(0, first - n)
            self.at = least + 1 if n is not None and first - least == n else 0
            lo, hi, order = least, first, F.col("_place").desc()
        else:
            lo = min(self.at, self.total)
            hi = self.total if n is None else min(self.total, lo + n)
            self.at = hi if n is not None and lo + n <= self.total else self.total + 1
            order = F.col("_place").asc()
        return self.rows.where((F.col("_place") >= lo) & (F.col("_place") < hi)).orderBy(order).drop("_place")
