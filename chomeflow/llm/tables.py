"""Reading inputs and writing intermediate tables.

Intermediates go to the folder that the session names in
``spark.checkpoint.dir``; it is shared by driver and executors, so a lost
executor costs no more than a reread.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chomeflow.sources.shared import shared_dir

#: Rows of a few short columns that a broadcast may have: some 50 MB.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables of one operator run."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Writes ``df`` and returns it as a scan, with no lineage behind it."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{label}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in saved:
            if path := getattr(df, "_scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def bounded(df: DataFrame) -> DataFrame:
    """A saved table, to be broadcast in a join if it has ``BROADCAST_ROWS`` rows at most; else the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have (Spark ignores case in names)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
