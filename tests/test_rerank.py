from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabularium.operators.rerank import apply_ranker_reply, model_scorer, rerank

ROWS = [
    (1, "alpha beta gamma", "d1", 0.9, 1, "beta gamma alpha words", {"s": "1"}),
    (1, "alpha beta gamma", "d2", 0.8, 2, "nothing here", {"s": "2"}),
    (1, "alpha beta gamma", "d3", 0.7, 3, "Alpha only Europa.", {"s": "3"}),
    (1, "alpha beta gamma", "d4", 0.6, 4, "beta nbsp gamma", {"s": "4"}),
]
SHAPE = "query_id int, query string, id string, score double, rank int, text string, metadata map<string,string>"


@pytest.fixture
def candidates(spark):
    return spark.createDataFrame(ROWS, SHAPE)


def ids(frame):
    return [r["id"] for r in frame.orderBy("rank").collect()]


def test_order_and_scores(candidates):
    ranked = rerank(candidates).orderBy("rank").collect()
    assert [r["id"] for r in ranked] == ["d1", "d4", "d3", "d2"]
    assert [r["score"] for r in ranked] == [1.0, 0.666667, 0.333333, 0.0]
    assert ranked[0]["metadata"] == {"s": "1"} and ranked[0]["text"] == ROWS[0][5]


@pytest.mark.parametrize(("k", "n"), [(None, 4), (2, 2), (100, 4)])
def test_top_k(candidates, k, n):
    assert rerank(candidates, k).count() == n


def test_empty(candidates):
    assert rerank(candidates.limit(0), 3).count() == 0


def test_input_is_not_changed(candidates):
    before = candidates.collect()
    rerank(candidates).collect()
    assert candidates.collect() == before


def test_ties_keep_the_candidate_order(candidates):
    assert ids(rerank(candidates.withColumn("query", F.lit("unknown words")))) == ["d1", "d2", "d3", "d4"]


def test_europa_keeps_its_dot(candidates):
    scores = {r["id"]: r["score"] for r in rerank(candidates.withColumn("query", F.lit("Europa"))).collect()}
    assert scores["d3"] == 0.0


def test_model_scorer_runs_in_batches(candidates):
    def load():
        return lambda queries, texts: [float(len(texts)) + len(t) / 100 for t in texts]

    ranked = rerank(candidates.coalesce(1), 2, model_scorer(load, batch=3)).collect()
    assert len(ranked) == 2 and max(r["score"] for r in ranked) > 3


def test_external_reply(spark, candidates):
    replies = spark.createDataFrame([(1, 3, 0.9), (1, 0, 0.2), (2, 1, 5.0)], "query_id int, index int, relevance_score double")
    ranked = apply_ranker_reply(candidates, replies).orderBy("rank").collect()
    assert [(r["id"], r["score"], r["rank"]) for r in ranked] == [("d4", 0.9, 1), ("d1", 0.2, 2)]
    assert ids(apply_ranker_reply(candidates, replies, 1)) == ["d4"]
