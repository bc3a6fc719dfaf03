"""The folder for tables and checkpoints that executors and driver share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a folder of the warehouse, which a cluster shares too, and a
    temporary one only if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not found and master.startswith("local") and not master.startswith("local-cluster"):
        found = os.path.join(tempfile.gettempdir(), "tessera-tables")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-tables").rstrip("/")
