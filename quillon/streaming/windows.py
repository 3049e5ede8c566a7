"""Structured Streaming over event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def tumbling(events: DataFrame, time: str, size: str, keys: Sequence[str] = (), late: str | None = None, slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by window of time (sliding if slide is given); late: how long rows are waited for, on a stream."""
    timed = events.withColumn(time, F.col(time).cast("timestamp_ltz"))
    timed = timed.withWatermark(time, late) if late else timed
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = timed.groupBy(window.alias("w"), *keys).agg(*(e.alias(n) for n, e in aggregates.items()))
    stamp = lambda c: F.col(c).cast("timestamp_ntz")
    return out.select(stamp("w.start").alias("window_start"), stamp("w.end").alias("window_end"), *keys, *aggregates)


def sessions(events: DataFrame, time: str, gap: str, keys: Sequence[str], late: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by session: a key's rows with no gap between them."""
    timed = events.withColumn(time, F.col(time).cast("timestamp_ltz"))
    timed = timed.withWatermark(time, late) if late else timed
    out = timed.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*(e.alias(n) for n, e in aggregates.items()))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), *keys, *aggregates)


def deduplicated(events: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """The first row of each key; state is dropped after the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp_ltz")).withWatermark(time, late).dropDuplicatesWithinWatermark([*keys])
