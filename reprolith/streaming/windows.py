"""The metrics over streams of outputs (X3): event-time windows with watermarks.

The same builders run on a batch frame and on a stream; a stream's state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", files: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive, with event time as a timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(df: DataFrame, ts: str = "ts", size: str = "1 day", slide: str | None = None, late: str = "1 day", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Count, mean and range of each tumbling or sliding window; rows later than `late` are left out of a stream."""
    w = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    out = df.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "mean", "min", "max")


def sessions(df: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 day", key: str = "user_id") -> DataFrame:
    """Sessions of a key: their start, end and rows."""
    out = df.withWatermark(ts, late).groupBy(F.session_window(F.col(ts), gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def running_repeatability(df: DataFrame, ts: str = "ts", size: str = "1 day", late: str = "1 day", output: str = "event_type") -> DataFrame:
    """How often each output occurs in each window: the first stage of R_raw; `finish` makes the metric."""
    out = df.withWatermark(ts, late).groupBy(F.window(F.col(ts), size).alias("w"), output).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), output, "n")


def finish(counts: DataFrame) -> DataFrame:
    """R_raw and entropy of windows that are closed (from a sink of `running_repeatability`)."""
    return counts.groupBy("window_start").agg((F.max("n") / F.sum("n")).alias("r_raw"), F.abs(F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n")).alias("entropy"), F.sum("n").alias("n"))
