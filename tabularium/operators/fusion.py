"""Reciprocal rank fusion (Cormack, Clarke and Buettcher, SIGIR 2009)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.operators.ranking import top_k

RRF_K = 60
# Sums of a few reciprocals; rounding makes them independent of addition order.
_FUSED_DIGITS = 12


def union_legs(**legs: DataFrame) -> DataFrame:
    """Stack ranked legs as ``query_id, leg, id, rank``."""
    frames = [frame.select("query_id", F.lit(name).alias("leg"), "id", "rank") for name, frame in legs.items()]
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame)
    return stacked


def fuse(
    legs: DataFrame,
    limit: int,
    rrf_k: int = RRF_K,
    score_threshold: float | None = None,
) -> DataFrame:
    """``query_id, id, score, rank`` from ranked legs; an id may be in one leg only.

    The threshold cuts on the fused score. Input is bounded by the leg limits,
    so both shuffles move at most ``queries x legs x leg limit`` rows.
    """
    fused = legs.groupBy("query_id", "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))), _FUSED_DIGITS).alias("score")
    )
    if score_threshold is not None:
        fused = fused.filter(F.col("score") >= score_threshold)
    return top_k(fused, ["query_id"], [F.desc("score"), F.asc("id")], limit)
