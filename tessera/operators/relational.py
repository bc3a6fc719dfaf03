"""Relational operators as DataFrame functions: what the SQL front end emits, for callers without SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side under this many bytes by its statistics may be broadcast.
BROADCAST_BYTES = 64 << 20


def order(c: str | Column, desc: bool = False, nulls_first: bool | None = None) -> Column:
    """PostgreSQL's order: NULLs last when ascending, first when descending, unless stated."""
    c = F.col(c) if isinstance(c, str) else c
    first = desc if nulls_first is None else nulls_first
    if desc:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def distinct_on(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """The first row of each key in the order `by`.

    One aggregate with map-side combining where the whole row can be a minimum is not possible for
    arbitrary orders, so rows are ranked; a WindowGroupLimit (rank = 1) prunes before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def union(arms: list[DataFrame], distinct: bool = False) -> DataFrame:
    """UNION [ALL] by position, with the columns' common types."""
    from ..types import common_type

    names = arms[0].columns
    kinds = [reduce(common_type, (a.schema[i].dataType.simpleString() for a in arms)) for i in range(len(names))]
    cast = [a.toDF(*names).select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in zip(names, kinds, strict=True)]) for a in arms]
    out = reduce(DataFrame.unionAll, cast)
    return out.distinct() if distinct else out


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join whose right side is broadcast only if its estimated size is bounded; else Spark shuffles, and
    splits skewed partitions at run time."""
    small = how in ("inner", "left", "left_semi", "left_anti") and estimated_bytes(right) <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right, on, how)


def not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """NOT IN with its NULLs: nothing if the values hold a NULL, and no row whose column is NULL unless the
    values are empty. An anti join and one aggregate, in place of a null-aware nested loop."""
    v = values.toDF("_v")
    some = v.agg(F.count(F.lit(1)).alias("_n"), F.count("_v").alias("_k"))
    kept = df.join(v.where("_v is not null").distinct(), F.col(column) == F.col("_v"), "left_anti")
    return kept.join(F.broadcast(some), how="cross").where((F.col("_n") == 0) | ((F.col("_n") == F.col("_k")) & F.col(column).isNotNull())).drop("_n", "_k")


def as_of(left: DataFrame, right: DataFrame, on: str, by: list[str], right_on: str | None = None) -> DataFrame:
    """Each left row with the last right row of its key not after it: a union, then one window over the key.
    Right columns other than keys come with the prefix r_."""
    right_on = right_on or on
    own = [c for c in right.columns if c not in by]
    l = left.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*own)).schema[0].dataType).alias("_r"))
    r = right.select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.struct(*own).alias("_r"))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionAll(r).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_l.*", *[F.col(f"_last.{c}").alias(f"r_{c}") for c in own])


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """An inner join whose hot left keys are dealt over `salts` partitions; the right side is copied that
    many times, so use it where the right side is small next to the left. Rows are dealt by their number, so
    equal rows of a hot key part too and columns may be of any type. Only the right side's share of a partition
    is held: its copies are never broadcast, as Spark would have it by the size before copying, nor is the left sorted."""
    l = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r.hint("shuffle_hash"), [key, "_salt"]).drop("_salt")


def generate_series(spark, start: int, stop: int, step: int = 1) -> DataFrame:
    """generate_series over integers as a distributed range."""
    if step == 0:
        raise ValueError("step size cannot equal zero")
    return spark.range(start, stop + (1 if step > 0 else -1), step).toDF("generate_series")


def lockstep(df: DataFrame, **arrays: Column) -> DataFrame:
    """Several set-returning expressions side by side, the shorter ones padded with NULL."""
    zipped = F.arrays_zip(*[c.alias(n) for n, c in arrays.items()])
    return df.select("*", F.explode(zipped).alias("_z")).select(*df.columns, *[F.col(f"_z.{n}").alias(n) for n in arrays])
