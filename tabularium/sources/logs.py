"""Append-only logs and chat history, partitioned by day."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators.lifecycle import CHAT_DAYS, expired
from tabularium.session import shared_path
from tabularium.sources.files import delete, list_names

_DAY = "day="
# Fixed value: Spark's folder name for a null.
_UNDATED = "__HIVE_DEFAULT_PARTITION__"


def append_log(entries: DataFrame, root: str, time_col: str = "created_at") -> None:
    """Append entries; each day is a folder, so filters on the day skip the rest.

    The rebalance keeps files large without sending one busy day to one task.
    """
    dated = entries.withColumn("day", F.to_date(time_col))
    dated.hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(root)


def read_log(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """Entries, from a day (``yyyy-MM-dd``) on; older folders are not opened."""
    log = spark.read.parquet(root)
    return log.filter(F.col("day") >= F.to_date(F.lit(since))) if since else log


def _days(spark: SparkSession, root: str) -> list[date]:
    names = [n.removeprefix(_DAY) for n in list_names(spark, root) if n.startswith(_DAY)]
    return sorted(date.fromisoformat(n) for n in names if n[:4].isdigit())


def _has_days(spark: SparkSession, root: str) -> bool:
    return any(n.startswith(_DAY) for n in list_names(spark, root))


def _rewrite(spark: SparkSession, root: str, days: list[date | None], keep: Callable[[DataFrame], DataFrame]) -> None:
    """Keep what ``keep`` lets through of some days; None stands for entries without a time. Other days are not opened.

    What is kept is written aside first and stays there until the days have been
    replaced. A day of which nothing is kept loses its folder.
    """
    if not days:
        return
    dated = [day for day in days if day is not None]
    inside = F.col("day").isin(dated) if len(dated) == len(days) else F.col("day").isin(dated) | F.col("day").isNull()
    old = spark.read.parquet(root).filter(inside)
    aside = shared_path(spark, "log-kept")
    keep(old).select(*old.columns).hint("rebalance", F.col("day")).write.partitionBy("day").parquet(aside)
    left = {n for n in list_names(spark, aside) if n.startswith(_DAY)}
    if left:
        # Types are those of the log, whatever the folder names look like.
        kept = spark.read.schema(old.schema).parquet(aside)
        kept.hint("rebalance", F.col("day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(root)
    for day in days:
        name = f"{_DAY}{_UNDATED if day is None else day}"
        if name not in left:
            delete(spark, f"{root}/{name}")
    delete(spark, aside)


def retain_log(spark: SparkSession, root: str, as_of: datetime | Column, days: int = CHAT_DAYS, time_col: str = "created_at") -> DataFrame:
    """Apply the retention rule to a stored log; returns one row ``deleted, kept``.

    Days before the boundary lose their folders, the boundary's own day is
    rewritten, and no other day is opened but to be counted. Entries exactly
    ``days`` old stay, and so do those without a time.
    """
    if not _has_days(spark, root):
        return spark.createDataFrame([(0, 0)], "deleted long, kept long")
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    boundary = spark.range(1).select(F.to_date(moment - F.make_dt_interval(F.lit(days)))).first()[0]
    held = _days(spark, root)
    log = spark.read.parquet(root)
    # Days that go or stay as a whole are counted by the files' footers.
    gone = log.filter(F.col("day") < F.lit(boundary)).count()
    old = expired(as_of, days, time_col)
    gone += log.filter((F.col("day") == F.lit(boundary)) & old).count()
    kept = log.count() - gone
    for day in held:
        if day < boundary:
            delete(spark, f"{root}/{_DAY}{day}")
    _rewrite(spark, root, [day for day in held if day == boundary], lambda entries: entries.filter(~old))
    return spark.createDataFrame([(gone, kept)], "deleted long, kept long")


def erase_from_log(spark: SparkSession, root: str, column: str, values: DataFrame) -> int:
    """Drop the entries whose ``column`` is among ``values`` (one column); returns how many.

    Only days that hold such entries are rewritten.
    """
    if not _has_days(spark, root):
        return 0
    wanted = values.select(F.col(values.columns[0]).alias(column)).distinct()
    hit = spark.read.parquet(root).join(wanted, column, "left_semi").groupBy("day").agg(F.count("*").alias("n")).collect()
    _rewrite(spark, root, [row["day"] for row in hit], lambda entries: entries.join(wanted, column, "left_anti"))
    return sum(row["n"] for row in hit)
