"""Streaming ingest: running statistics of values as they arrive, by event time, with late rows left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import known


def windowed_statistics(events: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n, mean, lo, hi of each key and time window. Works on a stream (rows later than `late` are dropped) and a batch."""
    # a watermark needs a timestamp with a zone
    source = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    got = source.groupBy(F.window(ts, width), *keys).agg(F.count(known(value)).alias("n"), F.avg(known(value)).alias("mean"), F.min(known(value)).alias("lo"), F.max(known(value)).alias("hi"))
    return got.select(*keys, F.col("window.start").alias("window_start"), "n", "mean", "lo", "hi")


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
