"""Parquet tables: scans with pruning and pushdown, sorted writes, appends of partitions and children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """A scan whose filter and columns reach the reader."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def append(arms: list[DataFrame]) -> DataFrame:
    """The rows of all arms, columns by name; children may have more columns, which the first lacks."""
    first = arms[0].columns
    return reduce(lambda a, b: a.unionByName(b.select(*first)), arms)


def write(df: DataFrame, path: str, sort: list[str] | None = None, mode: str = "overwrite") -> None:
    """Files sorted by `sort`, whose footers then carry tight bounds."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode(mode).parquet(path)
