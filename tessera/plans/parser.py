"""A parser for the PostgreSQL query language. Nodes are tuples whose first field names the kind."""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"""
    (?P<space>\s+|--[^\n]*|/\*.*?\*/)
  | (?P<estring>[eE]'(?:[^'\\]|\\.|'')*')
  | (?P<bits>[bBxX]'[0-9a-fA-F]*')
  | (?P<string>'(?:[^']|'')*')
  | (?P<dollar>\$(?P<tag>[A-Za-z_]*)\$.*?\$(?P=tag)\$)
  | (?P<param>\$\d+)
  | (?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
  | (?P<quoted>"(?:[^"]|"")*")
  | (?P<name>[A-Za-z_\u0080-￿][A-Za-z0-9_$\u0080-￿]*)
  | (?P<op>!~~\*|!~~|~~\*|~~|!~\*|~\*|!~|~=|->>|\#>>|->|\#>|\#\#|@-@|@@|@\?|@>|<->|<@|&&|&<\||\|&>|&<|&>|<<\||\|>>|<\^|>\^|\^@|<<=|>>=|\?-\||\?\|\||\?-|\?\||\?\#|!!|\|\|/|\|/|\|\||::|<=|>=|<>|!=|<<|>>|:=|=>|[-+*/%^<>=~!@\#&|?])
  | (?P<punct>[()\[\],;.:])
    """,
    re.X | re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class SqlError(Exception):
    """An error with its SQLSTATE."""

    def __init__(self, message: str, state: str = "42601"):
        super().__init__(message)
        self.state = state


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SqlError(f'syntax error at or near "{text[at : at + 10]}"')
        at, kind, v = m.end(), m.lastgroup, m.group()
        if kind == "tag":
            kind = "dollar"
        if kind == "space":
            continue
        if kind == "string":
            out.append(("string", v[1:-1].replace("''", "'")))
        elif kind == "estring":
            body = v[2:-1].replace("''", "'")
            out.append(("string", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), body, flags=re.S)))
        elif kind == "dollar":
            tag = v[: v.index("$", 1) + 1]
            out.append(("string", v[len(tag) : -len(tag)]))
        elif kind == "bits":
            body = v[2:-1]
            out.append(("bits", body if v[0] in "bB" else "".join(f"{int(c, 16):04b}" for c in body)))
        elif kind == "quoted":
            out.append(("ident", v[1:-1].replace('""', '"')))
        elif kind == "name":
            out.append(("name", v.lower()))
        else:
            out.append((kind, v))
    out.append(("end", ""))
    return out


RESERVED = set(
    """all and any array as asc both case cast check collate column constraint create cross current_date current_time
    current_timestamp default desc distinct do else end except fetch for from full group having in inner intersect into
    is isnull join leading left like ilike limit natural not notnull null offset on or order outer references returning right
    select similar some symmetric table then to trailing union unique using values when where window with""".split()
)
COMPARE = {"<", ">", "=", "<=", ">=", "<>", "!="}
#: Words that name a type when a string literal follows.
TYPED = {"date", "timestamp", "timestamptz", "time", "interval", "numeric", "int", "bigint", "float8", "text", "json", "jsonb", "uuid", "boolean", "bool", "bytea", "double", "point", "lseg", "box", "line", "circle", "path", "polygon", "inet", "cidr", "macaddr", "macaddr8", "money", "pg_lsn", "tsvector", "tsquery"}


class Parser:
    def __init__(self, text: str):
        self.toks = tokenize(text)
        self.i = 0

    # tokens
    def peek(self, k: int = 0):
        return self.toks[min(self.i + k, len(self.toks) - 1)]

    def at(self, *words: str, k: int = 0) -> bool:
        kind, v = self.peek(k)
        return kind in ("name", "op", "punct") and v in words

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += 1
            return True
        return False

    def take_all(self, *words: str) -> bool:
        if all(self.at(w, k=j) for j, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> str:
        v = self.peek()[1]
        if not self.take(*words):
            raise SqlError(f'syntax error at or near "{v}", expected {" or ".join(words)}')
        return v

    def ident(self) -> str:
        kind, v = self.peek()
        if kind not in ("name", "ident"):
            raise SqlError(f'syntax error at or near "{v}"')
        self.i += 1
        return v

    def names(self) -> list[str]:
        self.need("(")
        out = [self.ident()]
        while self.take(","):
            out.append(self.ident())
        self.need(")")
        return out

    def done(self) -> None:
        self.take(";")
        if self.peek()[0] != "end":
            raise SqlError(f'syntax error at or near "{self.peek()[1]}"')

    # queries
    def query(self) -> dict:
        ctes, recursive = [], False
        if self.take("with"):
            recursive = self.take("recursive")
            while True:
                name = self.ident()
                cols = self.names() if self.at("(") else None
                self.need("as")
                self.take_all("not", "materialized") or self.take("materialized")
                self.need("(")
                if any(c[0] == name for c in ctes):
                    raise SqlError(f'WITH query name "{name}" specified more than once', "42712")
                ctes.append((name, cols, self.query()))
                self.need(")")
                if not self.take(","):
                    break
        body = self.set_operation()
        out = {"kind": "query", "ctes": ctes, "recursive": recursive, "body": body, "order": [], "limit": None, "offset": None}
        if self.take_all("order", "by"):
            out["order"] = self.order_items()
        while True:
            if self.take("limit"):
                out["limit"] = None if self.take("all") else self.expr()
            elif self.take("offset"):
                out["offset"] = self.expr()
                self.take("rows") or self.take("row")
            elif self.take("fetch"):
                self.need("first", "next")
                out["limit"] = ("num", "1") if self.at("row", "rows") else self.expr()
                self.need("row", "rows")
                self.need("only")
            else:
                return out

    def order_items(self) -> list:
        out = []
        while True:
            e = self.expr()
            asc = not self.take("desc")
            if asc:
                self.take("asc")
            first = not asc
            if self.take("nulls"):
                first = self.need("first", "last") == "first"
            out.append((e, asc, first))
            if not self.take(","):
                return out

    def set_operation(self, level: int = 0):
        left = self.set_operation(1) if level == 0 else self.set_primary()
        while self.at("union", "except") if level == 0 else self.at("intersect"):
            op = self.ident()
            every = self.take("all")
            if not every:
                self.take("distinct")
            right = self.set_operation(1) if level == 0 else self.set_primary()
            left = {"kind": "set", "op": op, "all": every, "left": left, "right": right}
        return left

    def set_primary(self):
        if self.take("("):
            q = self.query()
            self.need(")")
            return q
        if self.take("values"):
            rows = []
            while True:
                self.need("(")
                rows.append(self.expr_list())
                self.need(")")
                if not self.take(","):
                    return {"kind": "values", "rows": rows}
        if self.take("table"):
            name = self.ident()
            return self.plain_select([("star", None)], [("table", name, None, None)])
        return self.select()

    def plain_select(self, items, from_):
        return {
            "kind": "select", "distinct": False, "on": None, "items": [(i, None) for i in items], "from": from_,
            "where": None, "group": None, "having": None, "windows": [],
        }

    def select(self) -> dict:
        self.need("select")
        out = self.plain_select([], [])
        if self.take("distinct"):
            out["distinct"] = True
            if self.take("on"):
                self.need("(")
                out["on"] = self.expr_list()
                self.need(")")
        else:
            self.take("all")
        items = []
        if not self.at("from") and self.peek()[0] != "end" and not self.at(")", ";"):
            while True:
                items.append(self.select_item())
                if not self.take(","):
                    break
        out["items"] = items
        if self.take("from"):
            while True:
                out["from"].append(self.joined())
                if not self.take(","):
                    break
        if self.take("where"):
            out["where"] = self.expr()
        if self.take_all("group", "by"):
            out["group"] = self.group_items()
        if self.take("having"):
            out["having"] = self.expr()
        if self.take("window"):
            while True:
                name = self.ident()
                self.need("as")
                out["windows"].append((name, self.window_spec()))
                if not self.take(","):
                    break
        return out

    def group_items(self) -> list:
        out = []
        while True:
            if self.at("cube", "rollup") and self.at("(", k=1):
                word = self.ident()
                self.need("(")
                out.append((word, self.expr_list()))
                self.need(")")
            elif self.take_all("grouping", "sets"):
                self.need("(")
                sets = []
                while True:
                    if self.take("("):
                        sets.append([] if self.at(")") else self.expr_list())
                        self.need(")")
                    else:
                        sets.append([self.expr()])
                    if not self.take(","):
                        break
                self.need(")")
                out.append(("sets", sets))
            else:
                out.append(("expr", self.expr()))
            if not self.take(","):
                return out

    def select_item(self):
        if self.take("*"):
            return (("star", None), None)
        if self.peek()[0] in ("name", "ident") and self.at(".", k=1) and self.at("*", k=2):
            t = self.ident()
            self.i += 2
            return (("star", t), None)
        e = self.expr()
        if self.take("as"):
            return (e, self.ident())
        kind, v = self.peek()
        if kind == "ident" or (kind == "name" and v not in RESERVED):
            return (e, self.ident())
        return (e, None)

    # FROM
    def joined(self):
        left = self.table_item()
        while True:
            natural = self.take("natural")
            kind = None
            if self.take("cross"):
                kind = "cross"
            elif self.at("inner", "left", "right", "full", "join"):
                kind = "inner" if self.at("join") else self.ident()
                self.take("outer")
            if kind is None:
                return left
            self.need("join")
            right = self.table_item()
            cond = None
            if natural:
                cond = ("natural",)
            elif kind != "cross":
                if self.take("on"):
                    cond = ("on", self.expr())
                else:
                    self.need("using")
                    cond = ("using", self.names())
            left = ("join", kind, left, right, cond)

    def table_item(self):
        lateral = self.take("lateral")
        if self.take("("):
            if self.at("select", "with", "values", "table", "("):
                mark = self.i
                try:
                    q = self.query()
                    self.need(")")
                    return ("sub", q, *self.alias(), lateral)
                except SqlError:
                    self.i = mark
            j = self.joined()
            self.need(")")
            return j
        name = self.ident()
        while self.take("."):
            name = self.ident()
        if self.take("("):
            args = [] if self.at(")") else self.expr_list()
            self.need(")")
            ordinal = self.take_all("with", "ordinality")
            return ("srf", name, args, ordinal, *self.alias(), lateral)
        return ("table", name, *self.alias())

    def alias(self):
        name = None
        if self.take("as"):
            name = self.ident()
        else:
            kind, v = self.peek()
            if kind == "ident" or (kind == "name" and v not in RESERVED and v not in ("set", "lateral")):
                name = self.ident()
        cols = self.names() if name and self.at("(") else None
        return name, cols

    # expressions
    def expr_list(self) -> list:
        out = [self.expr()]
        while self.take(","):
            out.append(self.expr())
        return out

    def expr(self):
        left = self.and_expr()
        while self.take("or"):
            left = ("or", left, self.and_expr())
        return left

    def and_expr(self):
        left = self.not_expr()
        while self.take("and"):
            left = ("and", left, self.not_expr())
        return left

    def not_expr(self):
        if self.take("not"):
            return ("not", self.not_expr())
        return self.is_expr()

    def is_expr(self):
        left = self.comparison()
        while True:
            if self.take("isnull"):
                left = ("is", left, "null", False)
            elif self.take("notnull"):
                left = ("is", left, "null", True)
            elif self.take("is"):
                no = self.take("not")
                if self.take_all("distinct", "from"):
                    left = ("distinct", left, self.comparison(), no)
                else:
                    left = ("is", left, self.need("null", "true", "false", "unknown"), no)
            else:
                return left

    def comparison(self):
        left = self.matching()
        while self.peek()[0] == "op" and self.peek()[1] in COMPARE:
            op = self.peek()[1]
            self.i += 1
            op = "<>" if op == "!=" else op
            left = self.quantified(op, left) or ("op", op, left, self.matching())
        return left

    def quantified(self, op: str, left):
        if self.at("any", "some", "all") and self.at("(", k=1):
            word = "all" if self.ident() == "all" else "any"
            self.need("(")
            if self.at("select", "with", "values"):
                q = self.query()
                self.need(")")
                return ("anysub", op, word, left, q)
            e = self.expr()
            self.need(")")
            return ("anyarr", op, word, left, e)
        return None

    def matching(self):
        left = self.other()
        while True:
            no = self.at("not") and self.at("in", "between", "like", "ilike", "similar", k=1)
            if no:
                self.i += 1
            if self.take("in"):
                self.need("(")
                if self.at("select", "with", "values"):
                    left = ("insub", left, self.query(), no)
                else:
                    left = ("in", left, self.expr_list(), no)
                self.need(")")
            elif self.take("between"):
                sym = self.take("symmetric")
                low = self.other()
                self.need("and")
                left = ("between", left, low, self.other(), no, sym)
            elif self.at("like", "ilike"):
                word = self.ident()
                pattern = self.other()
                left = (word, left, pattern, self.other() if self.take("escape") else None, no)
            elif self.take_all("similar", "to"):
                pattern = self.other()
                left = ("similar", left, pattern, self.other() if self.take("escape") else None, no)
            else:
                return left

    OTHER = {"||", "->", "->>", "#>", "#>>", "@>", "<@", "&&", "~", "~*", "!~", "!~*", "~~", "~~*", "!~~", "!~~*", "&", "|", "#", "<<", ">>", "?"} | set("~= ## @@ @? <-> &< &> &<| |&> <<| |>> <^ >^ <<= >>= ?-| ?|| ?- ?| ?# ^@".split())

    def other(self):
        left = self.additive()
        while self.peek()[0] == "op" and self.peek()[1] in self.OTHER:
            op = self.peek()[1]
            self.i += 1
            left = self.quantified(op, left) or ("op", op, left, self.additive())
        return left

    def additive(self):
        left = self.term()
        while self.at("+", "-"):
            op = self.peek()[1]
            self.i += 1
            left = ("op", op, left, self.term())
        return left

    def term(self):
        left = self.power()
        while self.at("*", "/", "%"):
            op = self.peek()[1]
            self.i += 1
            left = ("op", op, left, self.power())
        return left

    def power(self):
        left = self.zoned()
        while self.take("^"):
            left = ("op", "^", left, self.zoned())
        return left

    def zoned(self):
        left = self.unary()
        while True:
            if self.take_all("at", "time", "zone"):
                left = ("zone", left, self.unary())
            elif self.take("collate"):
                left = ("collate", left, self.ident())
            else:
                return left

    def unary(self):
        for op in ("-", "+", "~", "@", "|/", "||/", "@-@", "@@", "#", "?-", "?|", "!!"):
            if self.peek() == ("op", op):
                self.i += 1
                return ("unary", op, self.unary())
        return self.postfix()

    def postfix(self):
        e = self.primary()
        while True:
            if self.take("::"):
                e = ("cast", e, self.type_name())
            elif self.take("["):
                e = ("subscript", e, self.expr())
                self.need("]")
            else:
                return e

    def type_name(self) -> tuple:
        name = self.ident()
        if name == "double":
            self.take("precision")
        if name == "character" and self.take("varying"):
            name = "varchar"
        if name == "bit" and self.take("varying"):
            name = "varbit"
        args = []
        if self.take("("):
            args = [int(self.peek()[1])]
            self.i += 1
            while self.take(","):
                sign = -1 if self.take("-") else 1
                args.append(sign * int(self.peek()[1]))
                self.i += 1
            self.need(")")
        if name in ("timestamp", "time"):
            if self.take_all("with", "time", "zone"):
                name += "tz"
            else:
                self.take_all("without", "time", "zone")
        array = False
        while self.take("["):
            if self.peek()[0] == "number":
                self.i += 1
            self.need("]")
            array = True
        return (name, tuple(args), array)

    def primary(self):
        kind, v = self.peek()
        if kind == "number":
            self.i += 1
            return ("num", v)
        if kind == "string":
            self.i += 1
            return ("str", v)
        if kind == "bits":
            self.i += 1
            return ("bits", v)
        if kind == "param":
            self.i += 1
            return ("param", int(v[1:]))
        if self.take("("):
            if self.at("select", "with", "values"):
                q = self.query()
                self.need(")")
                return ("scalar", q)
            items = self.expr_list()
            self.need(")")
            return items[0] if len(items) == 1 else ("row", items)
        if kind == "ident" or (kind == "name" and v not in RESERVED) or (kind == "name" and self.at("(", k=1) and v in ("left", "right")):
            return self.named()
        word = v if kind == "name" else None
        if word in ("null", "true", "false", "default"):
            self.i += 1
            return ("const", word)
        if word == "case":
            return self.case()
        if word == "cast":
            self.i += 1
            self.need("(")
            e = self.expr()
            self.need("as")
            t = self.type_name()
            self.need(")")
            return ("cast", e, t)
        if word == "array":
            self.i += 1
            if self.take("("):
                q = self.query()
                self.need(")")
                return ("arraysub", q)
            self.need("[")
            items = [] if self.at("]") else self.expr_list()
            self.need("]")
            return ("array", items)
        if word and word.startswith("current_"):
            self.i += 1
            return ("call", word, [], {})
        if word == "not":
            return self.not_expr()
        raise SqlError(f'syntax error at or near "{v}"')

    def case(self):
        self.need("case")
        operand = None if self.at("when") else self.expr()
        whens = []
        while self.take("when"):
            c = self.expr()
            self.need("then")
            whens.append((c, self.expr()))
        other = self.expr() if self.take("else") else None
        self.need("end")
        return ("case", operand, whens, other)

    def named(self):
        quoted = self.peek()[0] == "ident"
        name = self.ident()
        if not quoted and name in TYPED and self.peek()[0] == "string":
            v = self.peek()[1]
            self.i += 1
            fields = []
            while name == "interval" and self.at("year", "month", "day", "hour", "minute", "second", "to"):
                fields.append(self.ident())
            return ("typed", name, v, tuple(fields))
        if not quoted and name == "double" and self.at("precision"):
            self.i += 1
            v = self.peek()[1]
            self.i += 1
            return ("typed", "float8", v, ())
        if not quoted and name == "exists" and self.at("("):
            self.need("(")
            q = self.query()
            self.need(")")
            return ("exists", q)
        if not quoted and name in ("current_date", "current_timestamp", "localtimestamp", "current_user", "session_user", "user") and not self.at("("):
            return ("call", name, [], {})
        if self.at("("):
            return self.call(name)
        parts = [name]
        while self.take("."):
            parts.append(self.ident())
        if self.at("(") and len(parts) > 1:
            return self.call(parts[-1])
        return ("col", parts)

    def call(self, name: str):
        self.need("(")
        extra: dict = {}
        args: list = []
        if name == "extract":
            kind, field = self.peek()
            self.i += 1
            self.need("from")
            args = [("str", field), self.expr()]
        elif name == "position":
            a = self.additive()
            self.need("in")
            args = [self.expr(), a]
            name = "strpos"
        elif name == "trim":
            side = self.ident() if self.at("both", "leading", "trailing") else "both"
            chars = None if self.at("from") else self.expr()
            if self.take("from"):
                args = [self.expr()] + ([chars] if chars else [])
            else:
                args = [chars] + ([self.expr()] if self.take(",") else [])
            name = {"both": "btrim", "leading": "ltrim", "trailing": "rtrim"}[side]
        elif name == "overlay":
            args = [self.expr()]
            if self.take("placing"):
                args.append(self.expr())
                self.need("from")
                args.append(self.expr())
                if self.take("for"):
                    args.append(self.expr())
            else:
                while self.take(","):
                    args.append(self.expr())
        elif name == "substring":
            args = [self.expr()]
            if self.at("from", "for"):
                start = self.expr() if self.take("from") else ("num", "1")
                args += [start] + ([self.expr()] if self.take("for") else [])
            else:
                while self.take(","):
                    args.append(self.expr())
        elif self.take("*"):
            extra["star"] = True
        elif not self.at(")"):
            if self.take("distinct"):
                extra["distinct"] = True
            args = self.expr_list()
            if self.take_all("order", "by"):
                extra["order"] = self.order_items()
        self.need(")")
        if self.take_all("within", "group"):
            self.need("(")
            self.need("order")
            self.need("by")
            extra["within"] = self.order_items()
            self.need(")")
        if self.take("filter"):
            self.need("(")
            self.need("where")
            extra["filter"] = self.expr()
            self.need(")")
        if self.take("over"):
            extra["over"] = self.ident() if not self.at("(") else self.window_spec()
        return ("call", name, args, extra)

    def window_spec(self) -> dict:
        self.need("(")
        out = {"base": None, "partition": [], "order": [], "frame": None}
        if self.peek()[0] in ("name", "ident") and not self.at("partition", "order", "rows", "range", "groups"):
            out["base"] = self.ident()
        if self.take_all("partition", "by"):
            out["partition"] = self.expr_list()
        if self.take_all("order", "by"):
            out["order"] = self.order_items()
        if self.at("rows", "range"):
            words = [self.ident()]
            while not self.at(")"):
                words.append(self.peek()[1])
                self.i += 1
            out["frame"] = " ".join(words)
        self.need(")")
        return out


def parse_query(text: str) -> dict:
    p = Parser(text)
    q = p.query()
    p.done()
    return q


def parse_expression(text: str):
    p = Parser(text)
    e = p.expr()
    p.done()
    return e
