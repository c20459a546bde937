"""Event-time windows over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import anomaly, bars


def streamed_bars(ticks: DataFrame, interval: str, late: str = "10 minutes") -> DataFrame:
    """OHLCV bars; a bar is emitted once its window is closed by the watermark.

    The state holds one row per open (symbol, window), however many ticks arrive.
    """
    return bars.resample(ticks.withWatermark("ts", late), interval)


def sessions(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Activity sessions per key, closed after ``gap`` without an event."""
    return (
        events.withWatermark("ts", late)
        .groupBy(key, F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events")
    )


def streamed_alerts(checks: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes", **windows: str) -> DataFrame:
    """Alerts over sliding windows of anomalous checks."""
    return anomaly.alerts(checks.withWatermark(ts, late), key, ts, **windows)
