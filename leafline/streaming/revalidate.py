"""Continuous validation of a folder of record contents. An extension: the batch operators run on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.schema import Schema
from ..operators.validate import violations
from ..sources.records import from_contents


def contents_stream(spark: SparkSession, path: str) -> DataFrame:
    """path and content of Parquet files as they arrive."""
    return spark.readStream.schema("path string, content string").parquet(path)


def revalidate(stream: DataFrame, schema: Schema, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the violations of each micro-batch to a Parquet table."""

    def batch(df: DataFrame, _: int) -> None:
        violations(from_contents(df), schema).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
