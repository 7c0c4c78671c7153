"""The folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder of spark.checkpoint.dir; in the warehouse where that is unset, which a local session
    only may do: a cluster's machines don't share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{found}/{label}-{uuid.uuid4().hex}"


def put_lines(frame: DataFrame, label: str) -> str:
    """Writes the column value as lines, and returns their folder."""
    path = scratch(frame.sparkSession, label)
    frame.select("value").write.text(path)
    return path
