"""Streams over files: windowed aggregates with watermarks, and a running total.

The analytical dialect has no streams of its own; `date_bin` is the batch form of the tumbling windows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_folder


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at `path` (a file's folder is watched for that file)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if path.endswith(".parquet"):
        folder, name = path.rsplit("/", 1)
        # a table may be one file or a folder of files
        return reader.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")
    return reader.parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and event type."""
    return (
        events.withColumn("at", F.col("ts").cast("timestamp"))
        .withWatermark("at", late)
        .groupBy(F.window("at", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return (
        events.withColumn("at", F.col("ts").cast("timestamp"))
        .withWatermark("at", late)
        .groupBy(F.session_window("at", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")
    )


def running_totals(events: DataFrame) -> DataFrame:
    """Per user, the number and sum of events so far: a streaming aggregate, whose state Spark keeps."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def drain(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what its source holds now and returns what it put out, as a table of files: the last
    state in complete mode, else the rows of all micro-batches.

    Table and checkpoint lie in the cluster's shared folder, so that a restarted query resumes; a batch that is
    run again replaces its own files."""
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        name = "state" if mode == "complete" else f"batch-{number}"
        batch.write.mode("overwrite").parquet(f"{base}/rows/{name}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/rows")
