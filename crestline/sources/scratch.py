"""A folder that the driver and all executors share, for files that a run writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; in a folder of our own where that is unset, on a single machine only."""
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{key} is not set: it must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="crestline-")
    return f"{base.rstrip('/')}/crestline/{name}-{uuid.uuid4().hex}"
