"""The SparkSession that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings of every session; cluster sizes are left to the deployment.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "false",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def create(app: str = "tessera", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map={**SETTINGS, **extra})
    return (builder.master(master) if master else builder).getOrCreate()
