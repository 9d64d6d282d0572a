"""Manifest, change detection, erasure, retention and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.operators.upsert import keyed_merge

# Days a chat message is kept.
CHAT_DAYS = 30

MANIFEST = (
    "file_path string, file_hash string, processed_at timestamp, chunk_count long, "
    "file_size string, content_type string, last_error string"
)


def facet(points: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Distinct values of a key with their counts, most frequent first."""
    counted = points.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count"))
    return counted if limit is None else counted.orderBy(F.desc("count"), F.asc(key)).limit(limit)


def scroll(points: DataFrame, condition: Column, limit: int, id_col: str = "id") -> DataFrame:
    """First ``limit`` matching points by id, without their vectors."""
    vectors = [c for c in ("dense", "sparse") if c in points.columns]
    return points.drop(*vectors).filter(condition).orderBy(id_col).limit(limit)


def files_in_collection(points: DataFrame) -> DataFrame:
    """One row per file hash: chunk count and the payload of its smallest id.

    Count and sample come from one aggregation with map-side partials, so a
    file that holds a large share of all points is no hot group.
    """
    sample = F.struct("source", "fileSize", "contentType")
    return (
        points.filter(F.col("fileHash").isNotNull())
        .groupBy(F.col("fileHash").alias("file_hash"))
        .agg(F.count("*").alias("chunk_count"), F.min_by(sample, F.col("id")).alias("_sample"))
        .select(
            "file_hash",
            "chunk_count",
            F.col("_sample.source").alias("file_path"),
            F.col("_sample.fileSize").alias("file_size"),
            F.col("_sample.contentType").alias("content_type"),
        )
    )


def found_files(points: DataFrame, now: Column) -> DataFrame:
    """Manifest rows of the files a collection holds. Files without a path are
    skipped; several hashes may share a path."""
    return (
        files_in_collection(points)
        .filter(F.coalesce("file_path", F.lit("")) != "")
        .withColumn("processed_at", now)
        .withColumn("last_error", F.lit(None).cast("string"))
    )


def hash_order() -> list[Column]:
    """Of several hashes with one path the one with most chunks wins, then the smaller hash."""
    return [F.desc("chunk_count"), F.asc("file_hash")]


def reconcile(manifest: DataFrame, points: DataFrame, now: Column) -> DataFrame:
    """Manifest rebuilt from a collection, keyed by path; other rows stay."""
    return keyed_merge(manifest, found_files(points, now), ["file_path"], hash_order())


def reconcile_reply(points: DataFrame) -> DataFrame:
    """Distinct hashes and how many of them have a path."""
    return files_in_collection(points).agg(
        F.count("*").alias("distinct_hashes"),
        F.count_if(F.coalesce("file_path", F.lit("")) != "").alias("processed"),
    )


def detect_changes(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """``file_path, file_hash, status``: new, modified, unchanged, deleted, or
    failed (unchanged, but the last attempt ended in an error)."""
    seen = manifest.select("file_path", F.col("file_hash").alias("_old"), F.col("last_error").alias("_error"))
    joined = listing.select("file_path", "file_hash").join(seen, "file_path", "full_outer")
    status = (
        F.when(F.col("file_hash").isNull(), "deleted")
        .when(F.col("_old").isNull(), "new")
        .when(F.col("file_hash") != F.col("_old"), "modified")
        .when(F.col("_error").isNotNull(), "failed")
        .otherwise("unchanged")
    )
    return joined.select("file_path", F.coalesce("file_hash", "_old").alias("file_hash"), status.alias("status"))


def erase_sources(frames: dict[str, tuple[DataFrame, str]], sources: DataFrame) -> dict[str, DataFrame]:
    """Every frame without the rows of ``sources(source)``.

    ``frames`` maps a name to a frame and its source column. A row without a
    source is kept.
    """
    wanted = sources.select(F.col("source").alias("_source")).distinct()
    return {
        name: frame.join(wanted, frame[column] == wanted["_source"], "left_anti")
        for name, (frame, column) in frames.items()
    }


def retain(messages: DataFrame, as_of: datetime | Column, days: int = CHAT_DAYS, time_col: str = "created_at") -> DataFrame:
    """Messages that are kept: exactly ``days`` old still is."""
    return messages.filter(~expired(as_of, days, time_col))


def expired(as_of: datetime | Column, days: int = CHAT_DAYS, time_col: str = "created_at") -> Column:
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.coalesce(F.col(time_col) < moment - F.make_dt_interval(F.lit(days)), F.lit(False))


def retention_reply(messages: DataFrame, as_of: datetime | Column, days: int = CHAT_DAYS, time_col: str = "created_at") -> DataFrame:
    gone = expired(as_of, days, time_col)
    return messages.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


def ingest_stats(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"),
        F.max("processed_at").alias("last_processed"),
        F.round(F.avg("chunk_count"), 2).alias("avg_chunks_per_file"),
    )


def record_outcomes(manifest: DataFrame, outcomes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Manifest after an ingest: errors are set on failure, cleared on success.

    A failed file keeps the hash and counts of its last success, if it had one.
    """
    # A failure reports neither hash nor counts, so the old ones are carried over.
    old = manifest.select(
        "file_path",
        F.col("file_hash").alias("_hash"),
        F.col("chunk_count").alias("_chunks"),
    )
    failed = F.col("last_error").isNotNull()
    merged = (
        outcomes.join(old, "file_path", "left")
        .withColumn("file_hash", F.when(failed & F.col("_hash").isNotNull(), F.col("_hash")).otherwise(F.col("file_hash")))
        .withColumn("chunk_count", F.when(failed, F.coalesce("_chunks", F.lit(0).cast("long"))).otherwise(F.col("chunk_count")))
        .drop("_hash", "_chunks")
    )
    return keyed_merge(manifest, merged, ["file_path"], order)
