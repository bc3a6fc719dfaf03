"""Session helpers: scratch tables in the shared folder, Arrow passes with columns by position."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship

def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Where that is unset: a folder of the warehouse,
    which a cluster shares too, and a temporary one only if driver and executors are one process (local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        found = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-checkpoints").rstrip("/")


#: Rows and bytes of a batch that goes to a Python worker and back. Texts are long, so Spark's own 10,000
#: rows would make batches of tens of megabytes, held several times over by the JVM and by Python.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batch size, unless it is set below ours already. It stays set, as Spark reads it
    when a plan runs, which is after the operator has returned its DataFrame."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Gives freed memory back to the system: a worker lives on between stages, the driver between models."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage. drop() frees those that no later plan reads, close()
    all but those that the operator's result still reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._made: list[str] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        self._made.append(f"{self.base}/{len(self._made) + 1:03d}-{name}")
        return self._made[-1]

    def drop(self, *tables: DataFrame) -> None:
        self._delete({os.path.dirname(f) for t in tables for f in t.inputFiles()})

    def close(self, *keep: DataFrame) -> None:
        kept = {os.path.basename(os.path.dirname(f)) for t in keep for f in t.inputFiles()}
        self._delete({m for m in self._made if os.path.basename(m) not in kept})

    def _delete(self, paths: set[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for f in paths:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(conf).delete(p, True)


def map_arrow(
    df: DataFrame,
    read: list[str],
    make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]],
    fields: list[tuple[str, T.DataType]],
    keep: list[str] | None = None,
    gather: int = 0,
) -> DataFrame:
    """mapInArrow over the columns `read` (as _r0, _r1, ...), passing the columns `keep` through.

    make() runs once per task and returns a function from a batch to batches holding the kept columns
    (_k0, ...) followed by `fields`. Columns are handled by position inside, so extra columns whose
    names clash with the new ones do no harm: the operator's column replaces the old one. Batches are
    put together until they have `gather` bytes.
    """
    ship(df.sparkSession)
    _small_batches(df.sparkSession)
    made = {n.lower() for n, _ in fields}
    keep = [c for c in (keep or []) if c.lower() not in made]
    inner = df.select(
        *[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(read)],
        *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)],
    )
    schema = T.StructType(
        [T.StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
        + [T.StructField(f"_o{i}", t) for i, (_, t) in enumerate(fields)]
    )
    n_read, n_keep = len(read), len(keep)

    def run(batches):
        each = make()
        for b in _gathered(batches, gather):
            kept = [b.column(n_read + i) for i in range(n_keep)]
            at = 0
            for out in each(b):
                n = len(out[0])
                cols = [k.slice(at, n) for k in kept] + list(out)
                at += n
                yield pa.RecordBatch.from_arrays(cols, names=[f"_k{i}" for i in range(n_keep)] + [f"_o{i}" for i in range(len(out))])
        del each
        release()

    out = inner.mapInArrow(run, schema)
    return out.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        *[F.col(f"_o{i}").alias(n) for i, (n, _) in enumerate(fields)],
    )


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches that have rows, neighbours put together until they have `size` bytes."""
    held, held_bytes = [], 0

    def together():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if b.num_rows:
            held.append(b)
            held_bytes += b.nbytes
        if held and held_bytes >= size:
            yield together()
            held, held_bytes = [], 0
    if held:
        yield together()


def rows_within(offsets, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `limit` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = lo + 1
        while hi < n and offsets[hi + 1] - offsets[lo] <= limit:
            hi += 1
        yield lo, hi
        lo = hi
