"""The folder that driver and executors share."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session (a test) gets a folder of its own; a cluster does not, since each
    executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        found = tempfile.mkdtemp(prefix="schemaloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
