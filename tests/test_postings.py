"""Pruned searches in stored postings against full scans, and query blocks in one scan."""

from __future__ import annotations

import glob
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabularium.operators import postings as stored
from tabularium.operators import sparse
from tabularium.operators.dense import dense_top_k
from tabularium.operators.postings import BLOCK, max_score, postings_top_k, write_postings
from tabularium.operators.scan import RunningBest
from tabularium.operators.sparse import Bm25, corpus_stats, sparse_top_k, sparse_vectors
from tabularium.plans.retrieval import sparse_encode
from tabularium.session import shared_path


def texts(spark, n=900, seed=1):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(f"d{i:04}", " ".join(draw.choices(words, weights, k=draw.choice([0, 1, 3, 20, 200])))) for i in range(n)]
    rows += [("same1", "w1 w2 w3"), ("same2", "w1 w2 w3"), ("null", None)]
    return spark.createDataFrame(rows, "id string, text string").repartition(5)


def queries(spark, seed=2):
    draw = random.Random(seed)
    rows = [(i, " ".join(f"w{draw.randrange(70)}" for _ in range(draw.randint(1, 8)))) for i in range(30)]
    return spark.createDataFrame([*rows, (100, "nobody has this"), (101, ""), (102, "w1 w1 w1 w2"), (103, "w0")], "query_id int, query string")


def hits(frame):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in frame.collect())


@pytest.mark.parametrize(("segment", "k", "weight", "params"), [
    (1 << 19, 10, "distinct", Bm25()), (300, 3, "tf", Bm25()), (2000, 1, "distinct", Bm25(2.0, 0.0)), (1, 25, "distinct", Bm25(0.5, 1.0)), (5000, 2000, "distinct", Bm25()),
])
def test_postings_give_the_hits_of_a_full_scan(spark, segment, k, weight, params):
    corpus, asked, path = texts(spark, 900 if segment > 1 else 60), queries(spark), shared_path(spark, "postings")
    write_postings(corpus, path, segment_postings=segment)
    stats = corpus_stats(corpus)
    whole = hits(sparse_top_k(corpus, asked, k, stats=stats, query_weight=weight, params=params))
    assert whole
    for limit in (1_000_000, 12):
        found = postings_top_k(spark.read.parquet(path), stats, asked, k, params, weight, terms_per_block=limit)
        assert hits(found) == whole


def test_only_the_columns_of_asked_terms_are_read(spark):
    corpus, path = texts(spark), shared_path(spark, "postings")
    write_postings(corpus, path)
    asked = spark.createDataFrame([(1, "w3 w4")], "query_id int, query string")
    found = postings_top_k(spark.read.parquet(path), corpus_stats(corpus), asked, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    read = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert len({part.split("#")[0] for part in read.split("[", 1)[1].split("]", 1)[0].split(",")}) <= 4


def test_empty_corpus(spark):
    corpus, path = texts(spark).limit(0), shared_path(spark, "postings")
    write_postings(corpus, path)
    assert postings_top_k(spark.read.parquet(path), corpus_stats(corpus), queries(spark), 5).count() == 0


def test_max_score_prunes(spark):
    """With a common, weak term and a rare, strong one the weak one's postings are only looked up."""
    draw = np.random.default_rng(3)
    common, rare = np.arange(20_000, dtype=np.int32), np.sort(draw.choice(20_000, 40, replace=False)).astype(np.int32)
    weak, strong = draw.random(20_000), 5 + draw.random(40)
    asked = []

    def told(scores):
        def gains(at):
            asked.append(len(at))
            return scores[at]

        return gains

    def bounds(scores):
        return np.maximum.reduceat(scores, np.arange(0, len(scores), BLOCK))

    lists = [(float(strong.max()), bounds(strong), rare, told(strong)), (float(weak.max()), bounds(weak), common, told(weak))]
    total = np.zeros(20_000)
    total[rare] += strong
    total += weak
    floor = np.sort(total)[-10]
    docs, scores = max_score(lists, floor)
    assert sum(asked) <= 80
    best = np.argsort(-scores)[:10]
    assert sorted(docs[best]) == sorted(np.argsort(-total)[:10])
    assert np.allclose(np.sort(scores[best]), np.sort(total)[-10:])
    # Blocks whose best cannot reach the floor give no candidates.
    asked.clear()
    peaked = np.where(np.arange(20_000) // BLOCK == 7, 1.0, 0.1)
    docs, _ = max_score([(1.0, bounds(peaked), common, told(peaked))], 0.5)
    assert set(docs // BLOCK) == {7} and asked == [BLOCK]


@pytest.mark.parametrize("blocks_per_scan", [8, 2])
def test_blocks_share_a_scan(spark, monkeypatch, blocks_per_scan):
    monkeypatch.setattr("tabularium.operators.scan.BLOCKS_PER_SCAN", blocks_per_scan)
    monkeypatch.setattr("tabularium.operators.scan.TILE_BYTES", 2000)
    draw, path = np.random.default_rng(5), shared_path(spark, "vectors")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.normal(size=(500, 8)))], "id long, dense array<double>").write.parquet(path)
    points = spark.read.parquet(path)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.normal(size=(40, 8)))], "query_id long, dense array<double>")
    whole = dense_top_k(points, asked, 6, 8)
    parts = dense_top_k(points, asked, 6, 8, cells_per_block=64)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == -(-5 // blocks_per_scan)
    assert hits(parts) == hits(whole) and parts.count() == 240


def test_segments_hold_every_posting_once(spark):
    corpus, path = texts(spark), shared_path(spark, "postings")
    write_postings(corpus, path, segment_postings=700)
    segments = spark.read.parquet(path)
    assert segments.count() > 5
    columns = [F.col(stored._name(c)) for c in range(stored.COLUMNS)]
    n = segments.select(sum((F.coalesce(F.size(c["docs"]), F.lit(0)) for c in columns), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
    expected = corpus.select(F.size(F.array_distinct(F.filter(F.split("text", " "), lambda w: w != ""))).alias("n")).filter("n > 0").agg(F.sum("n")).first()[0]
    assert n == expected


def test_segments_are_spread_over_row_groups_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(stored, "ROW_GROUP_BYTES", 1 << 10, raising=False)
    corpus, path = texts(spark).coalesce(1), shared_path(spark, "postings")
    write_postings(corpus, path, segment_postings=300)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path.removeprefix('file://').removeprefix('file:')}/*.parquet")]
    assert sum(one.num_rows for one in files) > 10
    assert all(one.row_group(i).num_rows <= 2 for one in files for i in range(one.num_row_groups))


def test_small_offers_do_not_pile_up():
    best = RunningBest(3, 2)
    for i in range(5000):
        best.offer(np.array([i % 3]), np.array([float(i)]), pa.array([f"d{i}"]), np.array([0]))
        assert len(best._tables) < 1000
    found = best.result(pa.array([10, 11, 12])).to_pydict()
    assert sorted(zip(found["query_id"], found["id"], strict=True)) == [(10, "d4995"), (10, "d4998"), (11, "d4996"), (11, "d4999"), (12, "d4994"), (12, "d4997")]


def test_vectors_are_counted_in_pieces_of_a_batch(spark, monkeypatch):
    def vectors():
        return sorted((r["id"], sorted(zip(r["terms"], r["tfs"], strict=True)), r["length"]) for r in sparse_vectors(texts(spark).coalesce(1)).collect())

    whole = vectors()
    # Some texts have more tokens than a piece, some none.
    monkeypatch.setattr(sparse, "TOKENS_AT_ONCE", 10)
    assert vectors() == whole
    assert sum(n for _, _, n in whole) > 1000


def test_a_filter_on_vectors_counts_no_text_twice(spark, small):
    plan = sparse_encode(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
