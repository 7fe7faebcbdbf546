"""Streams of files: chunked readers, event-time windows and sinks on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """Files of a folder as they appear, a bounded number a trigger."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def windowed(df: DataFrame, ts: str, every: str, aggregates: dict[str, Column], keys: list[str] | None = None, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding event-time windows; events later than ``late`` are dropped with their state."""
    stamped = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.window(ts, every, slide) if slide else F.window(ts, every)
    out = stamped.groupBy(w, *(keys or [])).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(keys or []), *aggregates)


def sessions(df: DataFrame, ts: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """(key, session_start, session_end, n): runs of events with no gap longer than ``gap``."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def write_stream(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Appends finished rows to files, once each, until the input is used up."""
    return df.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(df: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
