"""Streams: tumbling counts, and files that are processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling_counts(stream: DataFrame, ts: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Rows in each window by keys; rows later than ``late`` are dropped on a stream."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n")


def pending(files: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Files that no run with the same software and database versions has processed."""
    return files.join(done.select(*keys).distinct(), keys, "left_anti")


def process_once(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], glob: str = "*.fna"):
    """Runs ``handle`` on files not seen before; the checkpoint remembers them."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(path)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
