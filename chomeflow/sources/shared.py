"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session may lack one and gets a temporary folder."""
    at = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"{CHECKPOINT} must name a folder that driver and executors share")
    at = "file://" + tempfile.mkdtemp(prefix="chomeflow-")
    spark.conf.set(CHECKPOINT, at)
    return at


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as Spark resolves it, in the form that other libraries read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub(r"^file:/(?!/)", "file:///", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString())
