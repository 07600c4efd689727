"""Row-wise features on streams: the same expressions as in batch, with no state and so no watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType


def stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(df: DataFrame, columns: dict[str, Column], out: str, checkpoint: str) -> None:
    """Adds columns to all rows that are there now and appends them to a folder; a later call goes on after them."""
    query = df.withColumns(columns).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(out)
    query.awaitTermination()
