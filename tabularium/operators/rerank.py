"""Second-stage scoring of retrieved candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.text import overlap
from tabularium.operators.ranking import top_k
from tabularium.operators.scan import SCORE_DIGITS

RERANK_BATCH = 32

Scorer = Callable[[Column, Column], Column]


def overlap_scorer(query: Column, text: Column) -> Column:
    """Built-in scorer: share of the query's words found in the text."""
    return overlap(query, text)


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = RERANK_BATCH) -> Scorer:
    """Wrap a pair model: ``load`` runs once per worker, calls get ``batch`` pairs."""

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in pairs:
            values: list[float] = []
            for first in range(0, len(queries), batch):
                part = slice(first, first + batch)
                values.extend(model(queries.iloc[part].tolist(), texts.iloc[part].tolist()))
            yield pd.Series(values, dtype="float64")

    return score


def rerank(candidates: DataFrame, k: int | None = None, scorer: Scorer = overlap_scorer) -> DataFrame:
    """Replace ``score`` and ``rank`` of ``(query_id, query, id, text, rank, ...)``.

    Sorted by the new score; equal scores keep the candidate order. All other
    columns are kept, and without ``k`` so are all rows.
    """
    scored = candidates.withColumn("score", F.round(scorer(F.col("query"), F.col("text")), SCORE_DIGITS))
    return _rank(scored, k)


def apply_ranker_reply(candidates: DataFrame, replies: DataFrame, k: int | None = None) -> DataFrame:
    """Take scores from an external ranker.

    ``replies`` is ``(query_id, index, relevance_score)`` where ``index`` is the
    0-based candidate position; candidates the reply does not name are dropped.
    """
    scored = (
        candidates.withColumn("index", (F.col("rank") - 1).cast("int"))
        .drop("score")
        .join(replies.select("query_id", "index", F.col("relevance_score").alias("score")), ["query_id", "index"])
        .drop("index")
    )
    return _rank(scored, k)


def _rank(scored: DataFrame, k: int | None) -> DataFrame:
    order = [F.desc("score"), F.asc("_first_rank")]
    scored = scored.withColumnRenamed("rank", "_first_rank")
    if k is None:
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    else:
        ranked = top_k(scored, ["query_id"], order, k)
    return ranked.drop("_first_rank")
