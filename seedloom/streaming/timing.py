"""Rank timing report per interval, on a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_report(events: DataFrame, ts: str = "ts", step: str = "step", rank: str = "rank", duration: str = "duration", every: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Per interval and step: calls, fastest and slowest duration and the ranks they belong to.

    The same plan serves both forms; on a stream the watermark bounds the state to open
    intervals x steps.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming and late else rows
    out = rows.groupBy(F.window(ts, every).alias("w"), step).agg(
        F.count(F.lit(1)).alias("calls"),
        F.min(duration).alias("min_time"),
        F.min_by(rank, F.struct(duration, rank)).alias("min_rank"),
        F.max(duration).alias("max_time"),
        F.max_by(rank, F.struct(F.col(duration), -F.col(rank))).alias("max_rank"),
    )
    return out.select(F.col("w.start").alias("begins"), step, "calls", "min_time", "min_rank", "max_time", "max_rank")
