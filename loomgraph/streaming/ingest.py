"""Structured Streaming: incremental replace of re-analysed files, and event windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

KEYS = ("repo_url", "source_file")


def latest_files(batch: DataFrame, order: str = "ord", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Of several analyses of a file in one batch, the records of the last."""
    last = batch.groupBy(*keys).agg(F.max(order).alias("_last"))
    return batch.join(last, list(keys)).where(F.col(order) == F.col("_last")).drop("_last")


def replace_stream(stream: DataFrame, target: str, checkpoint: str, order: str = "ord", keys: tuple[str, ...] = KEYS) -> StreamingQuery:
    """Append each batch's records to `target` under its batch number; `current` reads the latest records of each file.

    A batch costs what it holds, however large the table is. A batch that is tried again replaces its own folder.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        latest_files(batch, order, keys).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, schema: StructType, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The records of a replace_stream target: of each file those of the last batch that brought it."""
    all_ = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", target).parquet(target)
    last = all_.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return all_.join(last, [*keys, "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, target: str, into: str, schema: StructType, keys: tuple[str, ...] = KEYS) -> None:
    """Write the current records as batch 0 of a new target, when many batches have gathered."""
    current(spark, target, schema, keys).write.mode("overwrite").parquet(f"{into}/batch=0")


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events and their value by type and window; works on a batch and, with the watermark, on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of a folder as a stream, read with the schema of the files there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder)
