"""PostgreSQL type names, their Spark types, and the implicit-cast lattice."""

from __future__ import annotations

from pyspark.sql import types as T

from .functions import values

#: Spark SQL names of the scalar types (fixed values).
SPARK = {
    "bool": "BOOLEAN", "boolean": "BOOLEAN",
    "smallint": "SMALLINT", "int2": "SMALLINT", "int": "INT", "integer": "INT", "int4": "INT", "bigint": "BIGINT", "int8": "BIGINT",
    "real": "FLOAT", "float4": "FLOAT", "float": "DOUBLE", "double": "DOUBLE", "float8": "DOUBLE",
    "text": "STRING", "varchar": "STRING", "char": "STRING", "character": "STRING", "bpchar": "STRING", "name": "STRING",
    "date": "DATE", "timestamp": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP_LTZ", "bytea": "BINARY",
    "uuid": "STRING", "json": "STRING", "jsonb": "STRING", "bit": "STRING", "varbit": "STRING",
    "oid": "BIGINT", "regclass": "STRING", "xid": "BIGINT", "xid8": "DECIMAL(20,0)", "tid": "STRING",
    **values.SHAPES,
}
NUMERIC = "DECIMAL(38,16)"
INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
FLOATS = {"float", "double"}
#: Implicit casts go from left to right inside each chain (fixed values).
CHAINS = (("smallint", "int", "bigint", "decimal", "float", "double"), ("date", "timestamp_ntz", "timestamp"))


def spark_type(name: str, args: tuple = (), array: bool = False) -> str:
    """The Spark SQL type of a PostgreSQL type name with its modifiers."""
    if name in ("numeric", "decimal"):
        if not args:
            out = NUMERIC
        else:
            p, s = args[0], args[1] if len(args) > 1 else 0
            out = f"DECIMAL({p if s >= 0 else p - s},{max(s, 0)})"
    else:
        if name not in SPARK:
            raise KeyError(f'type "{name}" does not exist')
        out = SPARK[name]
    return f"ARRAY<{out}>" if array else out


def family(t: T.DataType | str) -> str:
    """A short name for a Spark type: int, decimal, float, string, date, timestamp, interval, array, ..."""
    s = t if isinstance(t, str) else t.simpleString()
    s = s.lower()
    if s in INTEGRAL:
        return "int"
    if s in FLOATS:
        return "float"
    if s.startswith("decimal"):
        return "decimal"
    if s.startswith("timestamp"):
        return "timestamp"
    if s.startswith("interval"):
        return "interval"
    if s.startswith(("array", "struct", "map")):
        return s.split("<")[0]
    return s


def common_type(a: str, b: str) -> str:
    """The common type of two simple Spark types for UNION, CASE, COALESCE and VALUES."""
    a, b = a.lower(), b.lower()
    if a == b or b in ("void", "null"):
        return a
    if a in ("void", "null"):
        return b
    if a.startswith("decimal") and b.startswith("decimal"):
        (pa, sa), (pb, sb) = (tuple(map(int, x[8:-1].split(","))) for x in (a, b))
        s = max(sa, sb)
        return f"decimal({min(38, max(pa - sa, pb - sb) + s)},{s})"
    short = lambda t: "decimal" if t.startswith("decimal") else t
    for chain in CHAINS:
        if short(a) in chain and short(b) in chain:
            if "decimal" in (short(a), short(b)) and "int" in (family(a), family(b)):
                d = a if a.startswith("decimal") else b
                s = int(d[8:-1].split(",")[1])
                return f"decimal({min(38, 20 + s)},{s})"
            return max((a, b), key=lambda t: chain.index(short(t)))
    if family(a) == family(b) == "string":
        return a
    raise TypeError(f"types {a} and {b} cannot be matched")
