"""Structured Streaming over a growing log. An extension: the batch operators are the measure."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.session import shared_dir


def event_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of a Parquet file, or of the files of a folder; as a glob, a single file is no folder to it."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, etype, n) by arrival time, with a watermark; event types of null are counted as such."""
    timed = events.withColumn("arrived", F.col("ingested_at").cast("timestamp")).withWatermark("arrived", late)
    counts = timed.groupBy(F.window("arrived", every).alias("w"), "etype").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "etype", "n")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there and give the table it wrote in the shared folder.

    Each batch of a complete result replaces the one before it, so the table holds the last.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{at}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = (
        stream.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
