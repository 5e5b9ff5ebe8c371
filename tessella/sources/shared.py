"""Folders for intermediate tables that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Where no cluster names a shared folder: only with a master on one machine, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/tessella"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the driver ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    out = f"{(named or LOCAL_SHARED).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return out
