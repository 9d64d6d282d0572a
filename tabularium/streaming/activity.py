"""Streaming forms of the activity and log jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.operators.activity import IDLE_SECONDS, hourly_rollup


def event_time(column: Column) -> Column:
    """Event time for a watermark, which takes instants only."""
    return column.cast("timestamp")


def streaming_sessions(
    events: DataFrame, key: str, time_col: str, idle_seconds: int = IDLE_SECONDS, lateness: str = "1 hour"
) -> DataFrame:
    """Sessions of a stream. Spark joins events exactly one gap apart, so the
    gap is a microsecond shorter to end a session at exactly ``idle_seconds``.

    State holds one row per open session, not its events.
    """
    gap = f"{idle_seconds - 1}.999999 seconds"
    return (
        events.withWatermark(time_col, lateness)
        .groupBy(F.session_window(time_col, gap), key)
        .agg(F.min(time_col).alias("session_start"), F.max(time_col).alias("session_end"), F.count("*").alias("events"))
        .select(key, "session_start", "session_end", "events")
    )


def streaming_rollup(
    events: DataFrame, time_col: str, group: str, value: str | None = None, lateness: str = "1 hour"
) -> DataFrame:
    """Hourly roll-up of a stream; rows later than the watermark are dropped."""
    return hourly_rollup(events.withWatermark(time_col, lateness), time_col, group, value)
