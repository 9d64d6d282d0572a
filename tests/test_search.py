"""Hybrid search over a small collection of texts."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.functions.payload import point_id
from tabularium.operators.cells import assign_cells, cell_top_k, measure_cells
from tabularium.operators.dense import dense_top_k, embed, hashing_embedder, model_embedder
from tabularium.operators.fusion import fuse
from tabularium.operators.search import SearchOptions, hybrid_search, sparse_input
from tabularium.operators.sparse import corpus_stats, sparse_top_k, sparse_vectors
from tabularium.session import shared_path
from tabularium.sources.collection import build_points, checked, collection

TEXTS = {
    "constitution": "Das Grundgesetz schützt die Würde des Menschen und die Meinungsfreiheit.",
    "rivers": "Der Rhein führt bei Köln im Mittel 2100 m³/s Wasser nach Norden.",
    "cars": "Die Automobilindustrie baut Elektrofahrzeuge und Verbrennungsmotoren.",
    "learning": "Neuronale Netze lernen Gewichte durch Rückpropagation von Fehlern.",
    "traffic": "Die Straßenverkehrsordnung regelt Vorfahrt und Höchstgeschwindigkeit.",
    "cooking": "Für den Apfelstrudel braucht man Äpfel, Zimt und Rosinen.",
}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(str(i), text, {"topic": topic, "text": "x"}) for i, (topic, text) in enumerate(TEXTS.items())]
    return spark.createDataFrame(rows, "id string, text string, metadata map<string,string>").cache()


def ask(spark, query, keywords=None):
    return spark.createDataFrame([(1, query, keywords)], "query_id int, query string, keywords array<string>")


def hits(frame):
    return [r.asDict() for r in frame.orderBy("rank").collect()]


def test_hit_shape_limit_and_metadata(spark, corpus):
    found = hits(hybrid_search(corpus, ask(spark, "Rhein Wasser Köln"), SearchOptions(limit=2)))
    assert len(found) == 2
    assert found[0]["metadata"] == {"topic": "rivers"}
    assert found[0]["text"] == TEXTS["rivers"]
    assert isinstance(found[0]["id"], str) and not found[0]["reranked"]
    assert [h["rank"] for h in found] == [1, 2]


def test_compound_words(spark, corpus):
    found = hits(hybrid_search(corpus, ask(spark, "Straßenverkehrsordnung Höchstgeschwindigkeit"), SearchOptions(limit=3)))
    assert found[0]["metadata"]["topic"] == "traffic"


def test_rerank_and_top_k(spark, corpus):
    query = ask(spark, "Neuronale Netze lernen")
    found = hits(hybrid_search(corpus, query, SearchOptions(limit=5, rerank=True)))
    assert all(h["reranked"] for h in found) and found[0]["metadata"]["topic"] == "learning"
    assert found[0]["score"] == 1.0
    one = hits(hybrid_search(corpus, query, SearchOptions(limit=5, rerank=True, rerank_top_k=1)))
    assert len(one) == 1


def test_keywords_drive_the_sparse_leg(spark, corpus):
    found = hits(hybrid_search(corpus, ask(spark, "Was ist das?", ["Apfelstrudel", "Zimt"]), SearchOptions(limit=3)))
    assert "cooking" in [h["metadata"]["topic"] for h in found]


@pytest.mark.parametrize("keywords", [None, []])
def test_no_keywords_means_the_question(spark, keywords):
    assert sparse_input(ask(spark, "Rhein", keywords)).first()["query"] == "Rhein"


def test_empty_corpus_and_queries(spark, corpus):
    assert hybrid_search(corpus.limit(0), ask(spark, "Rhein")).count() == 0
    assert hybrid_search(corpus, ask(spark, "Rhein").limit(0)).count() == 0
    assert sparse_top_k(corpus, ask(spark, "!!!"), 3).count() == 0


def test_bm25_by_hand(spark, corpus):
    texts = {str(i): [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()] for i, t in enumerate(TEXTS.values())}
    mean = sum(map(len, texts.values())) / len(texts)
    expected = {}
    for doc, words in texts.items():
        score = 0.0
        for term in {"die", "und", "zimt"}:
            df = sum(term in w for w in texts.values())
            tf = Counter(words)[term]
            if tf:
                norm = tf + 1.2 * (0.25 + 0.75 * len(words) / mean)
                score += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / norm
        if score:
            expected[doc] = round(score, 6)
    found = sparse_top_k(corpus, ask(spark, "die die und Zimt"), 10).collect()
    assert {r["id"]: r["score"] for r in found} == pytest.approx(expected)
    assert [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, len(expected) + 1))


def test_repeated_terms_count_on_request(spark, corpus):
    once = sparse_top_k(corpus, ask(spark, "Zimt Zimt"), 1).first()["score"]
    twice = sparse_top_k(corpus, ask(spark, "Zimt Zimt"), 1, query_weight="tf").first()["score"]
    assert twice == pytest.approx(2 * once, abs=1e-5)


def test_blocks_of_queries_give_the_same_result(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    queries = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    whole = sparse_top_k(documents, queries, 7).collect()
    parts = sparse_top_k(documents, queries, 7, terms_per_block=300).collect()
    assert sorted(whole) == sorted(parts) and whole
    embedder = hashing_embedder(16)
    points, asked = embed(documents, embedder), queries.select("query_id", embedder(F.col("query")).alias("dense"))
    whole = dense_top_k(points, asked, 7, 16).collect()
    parts = dense_top_k(points, asked, 7, 16, cells_per_block=64).collect()
    assert sorted(whole) == sorted(parts) and len(whole) == 7 * queries.count()


def test_written_statistics_save_a_pass(spark, corpus):
    path = shared_path(spark, "stats")
    corpus_stats(corpus).write.parquet(path)
    stats = spark.read.parquet(path)
    query = ask(spark, "die und Zimt")
    assert sparse_top_k(corpus, query, 5, stats=stats).collect() == sparse_top_k(corpus, query, 5).collect()


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8)).round(1)
    vectors[10] = vectors[20]
    vectors[30] = 0
    queries = rng.normal(size=(9, 8))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, dense array<double>").repartition(5)
    odd = spark.createDataFrame([(1000, [1.0] * 3), (1001, None)], points.schema)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id int, dense array<double>")
    found = dense_top_k(points.unionByName(odd), asked, 12, 8).collect()
    norms = np.linalg.norm(vectors, axis=1)
    unit = np.divide(vectors, norms[:, None], out=np.zeros_like(vectors), where=norms[:, None] > 0)
    scores = np.round(unit @ (queries / np.linalg.norm(queries, axis=1, keepdims=True)).T, 6)
    for q in range(9):
        best = sorted(range(300), key=lambda i: (-scores[i, q], i))[:12]
        assert [r["id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == best


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_cells_give_the_full_scan(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    members = rng.integers(0, 6, 400) * (rng.random(400) > 0.4)
    vectors = (centres[members] + spread * rng.normal(size=(400, 8))).astype(np.float32)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, dense array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[::40])], "query_id int, dense array<float>")
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    placed = assign_cells(points, unit).cache()
    pruned = cell_top_k(placed, measure_cells(placed, unit), asked, 30).collect()
    assert sorted(pruned) == sorted(dense_top_k(points, asked, 30, 8).collect())


def test_model_plug_in_gets_batches(spark, corpus):
    def load():
        return lambda texts: [[float(len(texts)), float(len(t))] for t in texts]

    vectors = embed(corpus.coalesce(1), model_embedder(load, batch=4)).collect()
    assert sorted(v["dense"][0] for v in vectors) == [2.0, 2.0, 4.0, 4.0, 4.0, 4.0]


def test_embedding_is_stable_and_unit(spark, corpus):
    first, second = (embed(corpus, hashing_embedder(32)).orderBy("id").collect() for _ in range(2))
    assert first == second
    assert all(abs(sum(x * x for x in r["dense"]) - 1) < 1e-6 and len(r["dense"]) == 32 for r in first)


def test_fusion_by_hand(spark):
    legs = spark.createDataFrame(
        [(1, "dense", "a", 1), (1, "dense", "b", 2), (1, "sparse", "b", 1), (1, "sparse", "c", 2), (2, "dense", "z", 1), (2, "sparse", "y", 1)],
        "query_id int, leg string, id string, rank int",
    )
    rows = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in fuse(legs, 2).collect()}
    assert rows[(1, 1)] == ("b", pytest.approx(1 / 61 + 1 / 62))
    assert rows[(1, 2)][0] == "a"
    assert rows[(2, 1)][0] == "y" and rows[(2, 2)][0] == "z"
    assert fuse(legs, 5, score_threshold=0.03).select("id").collect() == [("b",)]


def test_point_ids(spark):
    rows = spark.createDataFrame([("given", "a"), (None, "a"), (None, "b")], "id string, text string")
    ids = [r[0] for r in rows.select(point_id(F.col("id"), F.col("text"))).collect()]
    assert ids[0] == "given" and len(set(ids)) == 3
    assert all(len(i) == 36 and i.count("-") == 4 for i in ids[1:])


def test_collection_is_idempotent(spark, corpus):
    points = checked(build_points(corpus, hashing_embedder(16)), 16)
    stored = collection(spark, shared_path(spark, "points"))
    stored.upsert(points)
    stored.upsert(points.limit(3))
    assert stored.read().count() == 6
    assert collection(spark, stored.root).read().count() == 6
    row = stored.read().filter("id = '1'").first()
    assert '"topic":"rivers"' in row["payload"] and row["text"] == TEXTS["rivers"]


def test_wrong_dimension_stops_the_upsert(spark, corpus):
    points = checked(build_points(corpus, hashing_embedder(8)), 16)
    with pytest.raises(Exception, match="16 dimensions"):
        points.collect()


def test_lengths_of_training_vectors_are_not_worked_out_per_component(spark, monkeypatch):
    from tabularium.operators import cells

    seen = []

    class Watched(cells.KMeans):
        def fit(self, frame):
            seen.append(frame._jdf.queryExecution().optimizedPlan().toString())
            return super().fit(frame)

    monkeypatch.setattr(cells, "KMeans", Watched)
    points = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [6.0, 8.0]), (6, [-1.0, 0.0])], "id long, dense array<float>")
    centres = cells.train_centres(points, 2, 2)
    assert np.allclose(sorted(centres.tolist()), [[-1, 0], [0.6, 0.8]]) and "aggregate(" not in seen[0]


def test_hashed_tokens_and_odd_texts(spark):
    texts = [None, "", " - ", "Äpfel, äpfel & 7", "a b c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    expected = []
    for bag in ([], [], [], ["äpfel", "äpfel", "7"], ["a", "b", "c"]):
        vector = np.zeros(16)
        for token in bag:
            digest = hashlib.md5(token.encode()).hexdigest()
            vector[int(digest[:6], 16) % 16] += 1.0 if int(digest[6], 16) < 8 else -1.0
        expected.append(vector / (np.sqrt((vector**2).sum()) or 1.0))
    found = embed(rows, hashing_embedder(16)).orderBy("id").collect()
    assert np.allclose([r["dense"] for r in found], expected)
    counted = sparse_vectors(rows).orderBy("id").collect()
    assert [dict(zip(r["terms"], r["tfs"], strict=True)) for r in counted] == [{}, {}, {}, {"äpfel": 2, "7": 1}, {"a": 1, "b": 1, "c": 1}]
    assert [r["length"] for r in counted] == [0, 0, 0, 3, 3]
