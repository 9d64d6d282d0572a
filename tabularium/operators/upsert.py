"""Keyed upserts and deletes as plain DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.operators.ranking import latest


def keyed_upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``existing`` with rows inserted or replaced by ``key``.

    Of several incoming rows with one key the first by ``order`` wins; columns
    the target does not have, such as a batch number, may be used for that.
    Only the incoming side is deduplicated. The existing side meets the new keys
    in an anti join, which adaptive execution turns into a broadcast for a
    small batch, so a large target is then not shuffled at all.
    """
    newest = latest(incoming, key, order).select(*existing.columns)
    untouched = existing.join(incoming.select(*key), list(key), "left_anti").select(*existing.columns)
    return untouched.unionByName(newest)


def keyed_merge(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The same result for an incoming side that is large or costly to compute:
    each side is computed once and both meet in a single shuffle."""
    columns = existing.columns
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in incoming.schema.fields if f.name not in columns]
    both = existing.select("*", *extra, F.lit(1).alias("_age")).unionByName(incoming.withColumn("_age", F.lit(0)))
    return latest(both, key, [F.asc("_age"), *order]).select(*columns)


def upsert_counts(incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows handed in and distinct keys among them."""
    per_key = incoming.groupBy(*key).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("submitted"), F.count("*").alias("distinct_ids")
    )


def without_value(points: DataFrame, column: str, value: str) -> DataFrame:
    """Drop rows whose column equals the value; rows without one stay."""
    return points.filter(~F.col(column).eqNullSafe(F.lit(value)))
