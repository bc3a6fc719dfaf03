"""COPY FROM: text and CSV files as DataFrames of a declared schema.

Files are read by Spark; the text format's escapes are decoded by column expressions. Files in text format are
split; those in CSV format only where CopyOptions.split says that no quoted field holds a line's end, as a line's
end alone then ends a row. A header line is the first line of each file, whatever it says; with HEADER MATCH it has
to name the columns. A row that does not fit the schema fails the query when it runs, as in the original command.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CopyError(ValueError):
    """An option that does not fit the format."""


@dataclass
class CopyOptions:
    format: str = "text"
    delimiter: str | None = None
    null: str | None = None
    header: bool | str = False  # True, or "match"
    quote: str = '"'
    escape: str | None = None
    force_not_null: tuple[str, ...] = ()
    columns: tuple[str, ...] | None = None  # the file's columns, in order
    defaults: dict[str, object] = field(default_factory=dict)  # values of the columns that the file lacks
    split: bool = False  # CSV: no quoted field holds a line's end

    def check(self) -> None:
        if self.format not in ("text", "csv"):
            raise CopyError(f'COPY format "{self.format}" not recognized')
        if len(self.delimiter or ",") != 1:
            raise CopyError("COPY delimiter must be a single one-byte character")
        if self.format == "text" and self.force_not_null:
            raise CopyError("COPY FORCE_NOT_NULL requires CSV mode")


_ESCAPES = (("\\\\b", "\b"), ("\\\\f", "\f"), ("\\\\n", "\n"), ("\\\\r", "\r"), ("\\\\t", "\t"), ("\\\\v", "\v"))


def _unescape(c: Column) -> Column:
    """The backslash escapes of the text format. A doubled backslash is set aside first."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for pattern, char in _ESCAPES:
        out = F.replace(out, F.lit(pattern[1:]), F.lit(char))
    return F.replace(F.regexp_replace(out, r"\\(.)", "$1"), F.lit("\x00"), F.lit("\\"))


def _typed(df: DataFrame, schema: T.StructType, o: CopyOptions) -> DataFrame:
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            text = F.col(f"`{f.name}`")
            cols.append(text.cast(f.dataType).alias(f.name))
        else:
            v = o.defaults.get(f.name)
            cols.append((v if isinstance(v, Column) else F.lit(v)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def _without_headers(lines: DataFrame, wanted: str | None) -> DataFrame:
    """The lines without the first of each file. It is the first line of the split that begins at the file's
    start, and a task reads its splits one after another."""
    import pyarrow as pa

    def skip(batches):
        seen = set()
        for b in batches:
            keep = []
            for line, file, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                first = start == 0 and file not in seen
                if first:
                    seen.add(file)
                    if wanted is not None and line != wanted:
                        raise CopyError(f'column name mismatch in header line: got "{line}", expected "{wanted}"')
                keep.append(not first)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], names=["value"])

    located = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return located.mapInArrow(skip, "value string")


def read_text(spark: SparkSession, path: str, schema: T.StructType, o: CopyOptions) -> DataFrame:
    o.check()
    names = list(o.columns or schema.fieldNames())
    delimiter, null = o.delimiter or "\t", "\\N" if o.null is None else o.null
    lines = spark.read.text(path)
    if o.header:
        lines = _without_headers(lines, delimiter.join(names) if o.header == "match" else None)
    lines = lines.where(F.col("value") != "\\.")
    # a delimiter behind an odd number of backslashes is data
    parts = F.split("value", rf"(?<!(?<!\\)\\)\Q{delimiter}\E")
    wrong = F.raise_error(F.concat(F.lit("missing or extra data in COPY line: "), F.col("value")))
    lines = lines.select(F.when(F.size(parts) == len(names), parts).otherwise(wrong).alias("p"))
    cols = [F.when(F.get("p", F.lit(i)) == null, None).otherwise(_unescape(F.get("p", F.lit(i)))).alias(n) for i, n in enumerate(names)]
    return _typed(lines.select(*cols), schema, o)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, o: CopyOptions) -> DataFrame:
    o.check()
    names = list(o.columns or schema.fieldNames())
    strings = T.StructType([T.StructField(n, T.StringType()) for n in names])
    # an unquoted empty field is NULL, a quoted one the empty text
    df = (
        spark.read.option("sep", o.delimiter or ",").option("quote", o.quote).option("escape", o.escape or o.quote)
        .option("header", bool(o.header)).option("enforceSchema", o.header != "match").option("mode", "FAILFAST")
        .option("nullValue", o.null or "").option("emptyValue", "\x01" if not o.null else "").option("multiLine", not o.split)
        .schema(strings).csv(path)
    )
    out = []
    for n in names:
        c = F.when(F.col(f"`{n}`") == "\x01", "").otherwise(F.col(f"`{n}`"))
        out.append((F.coalesce(c, F.lit(o.null or "")) if n in o.force_not_null else c).alias(n))
    return _typed(df.select(*out), schema, o)


def copy_from(spark: SparkSession, path: str, schema: T.StructType, options: CopyOptions | None = None) -> DataFrame:
    o = options or CopyOptions()
    return read_csv(spark, path, schema, o) if o.format == "csv" else read_text(spark, path, schema, o)


def copy_to(df: DataFrame, path: str, options: CopyOptions | None = None) -> None:
    """COPY TO, beyond the original: a folder of text or CSV files."""
    o = options or CopyOptions()
    if o.format == "csv":
        df.write.mode("overwrite").option("sep", o.delimiter or ",").option("header", bool(o.header)).option("escape", o.escape or o.quote).option("emptyValue", '""').csv(path)
        return
    def field_text(c):
        t = F.col(f"`{c}`").cast("string")
        t = F.replace(t, F.lit("\\"), F.lit("\\\\"))
        for pattern, char in _ESCAPES:
            t = F.replace(t, F.lit(char), F.lit(pattern[1:]))
        return F.coalesce(t, F.lit("\\N" if o.null is None else o.null))

    df.select(F.concat_ws(o.delimiter or "\t", *map(field_text, df.columns)).alias("value")).write.mode("overwrite").text(path)
