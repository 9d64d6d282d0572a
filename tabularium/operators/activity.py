"""Activity sessions and log roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Seconds without activity that end a session; a gap of exactly this length does.
IDLE_SECONDS = 600


def sessions(
    events: DataFrame, key: str, time_col: str, idle_seconds: int = IDLE_SECONDS, slice_seconds: int = 86_400
) -> DataFrame:
    """Sessions ``key, session_start, session_end, events`` between idle gaps.

    Events are first merged per key and time slice, so a key with a large share
    of all events is worked on by as many tasks as it has slices; only the
    islands of each slice, of which a slice holds a bounded number, meet in the
    window of the whole key.
    """
    gap = F.expr(f"INTERVAL {idle_seconds} SECONDS")
    epoch = F.unix_micros(F.col(time_col).cast("timestamp"))
    sliced = events.select(key, F.col(time_col).alias("_t"), F.floor(epoch / (slice_seconds * 1_000_000)).alias("_slice"))
    inside = Window.partitionBy(key, "_slice").orderBy("_t")
    previous = F.lag("_t").over(inside)
    opened = F.when(previous.isNull() | (F.col("_t") >= previous + gap), 1).otherwise(0)
    islands = (
        sliced.withColumn("_new", opened)
        .withColumn("_island", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "_slice", "_island")
        .agg(F.min("_t").alias("_start"), F.max("_t").alias("_end"), F.count("*").alias("_n"))
    )
    across = Window.partitionBy(key).orderBy("_start")
    before = F.lag("_end").over(across)
    joined = F.when(before.isNull() | (F.col("_start") >= before + gap), 1).otherwise(0)
    return (
        islands.withColumn("_new", joined)
        .withColumn("_session", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "_session")
        .agg(F.min("_start").alias("session_start"), F.max("_end").alias("session_end"), F.sum("_n").alias("events"))
        .drop("_session")
    )


def hourly_rollup(events: DataFrame, time_col: str, group: str, value: str | None = None) -> DataFrame:
    """Counts, and sums of ``value``, per hour and group; also for streams."""
    measures = [F.count("*").alias("events")]
    if value:
        measures.append(F.round(F.sum(value), 6).alias("total"))
    return (
        events.groupBy(F.window(time_col, "1 hour"), group)
        .agg(*measures)
        .select(F.col("window.start").alias("hour"), group, *[m for m in ("events", "total") if m == "events" or value])
    )
