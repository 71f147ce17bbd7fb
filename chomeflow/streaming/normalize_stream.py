"""The pipeline on a stream: it keeps no state, so each batch is joined to the registry like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chomeflow.plans.normalize import normalize
from chomeflow.plans.validate import validate


def normalize_stream(spark: SparkSession, path: str, schema: str, address: str = "address") -> DataFrame:
    """A streaming DataFrame of normalised rows of Parquet files that arrive in ``path``."""
    return normalize(spark.readStream.schema(schema).parquet(path), address)


def validate_stream(spark: SparkSession, path: str, schema: str, address: str = "address") -> DataFrame:
    return validate(spark.readStream.schema(schema).parquet(path), address)


def write_stream(stream: DataFrame, path: str, checkpoint: str):
    """Runs over what is there now and writes Parquet; ``checkpoint`` is on shared storage."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
