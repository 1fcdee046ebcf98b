"""Event-time queries over streams: the same expressions as in batch, with a watermark."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, off the heap, as keyed processors need."""
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was)


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet file, or a folder of them, as a stream; ts becomes a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")  # a stream takes a single file only as a match of a pattern
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once, as long as its copies come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def outcomes(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Hourly counts and hits."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
    return by.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("hits")).select(F.col("w.start").alias("start"), "n", "hits")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user."""
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All rows that are there now, written as Parquet; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
