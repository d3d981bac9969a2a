"""Ingest of a drop folder as a stream.

An extension: batches of raw drawers are inserted with the first writer winning, within a watermark for
repeated ids of the stream and against the stored ids of each batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memlake.operators.store import DRAWER, first_writer

SCHEMA = "seq long, id string, document string, wing string, room string, source string, filed_at string, hall string"


def drop_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The parquet files of a folder as a stream of raw drawers with their arrival time."""
    rows = spark.readStream.schema(SCHEMA).parquet(folder)
    return rows.withColumn("arrived", F.current_timestamp())


def ingest(rows: DataFrame, store: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Starts the stream: unknown ids are appended to the table at ``store``."""
    fresh = rows.where("id IS NOT NULL").withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["id"])

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = first_writer(batch.select("seq", *DRAWER))
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(store).select("id"), "id", "left_anti")
        new.select("seq", *DRAWER).write.mode("append").partitionBy("wing").parquet(store)

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, at: str, size: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Messages per window and role, late rows accepted within the delay; the same for a batch and a stream."""
    return rows.withWatermark(at, delay).groupBy(F.window(at, size), "role").agg(F.count("*").alias("n"))
