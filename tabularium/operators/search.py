"""Hybrid search: dense and BM25 legs, fusion, optional reranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.functions.payload import without_text
from tabularium.operators.dense import Embedder, dense_top_k, embed, hashing_embedder
from tabularium.operators.fusion import RRF_K, fuse, union_legs
from tabularium.operators.rerank import Scorer, overlap_scorer, rerank
from tabularium.operators.sparse import Bm25, sparse_top_k

# Embedded queries and a limit to a ranked dense leg.
DenseSearch = Callable[[DataFrame, int], DataFrame]
# queries(query_id, query), limit -> hits
SparseSearch = Callable[[DataFrame, int], DataFrame]

# Candidates fetched per wanted hit when a reranker follows.
OVERFETCH = 5
# Each leg fetches twice what fusion returns.
LEG_FACTOR = 2


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 5
    rerank: bool = False
    rerank_top_k: int | None = None
    score_threshold: float | None = None
    rrf_k: int = RRF_K
    dimension: int = 64
    bm25: Bm25 = field(default_factory=Bm25)

    @property
    def retrieval_limit(self) -> int:
        return self.limit * OVERFETCH if self.rerank else self.limit

    @property
    def leg_limit(self) -> int:
        return self.retrieval_limit * LEG_FACTOR

    @property
    def final_limit(self) -> int:
        return self.limit if self.rerank_top_k is None else self.rerank_top_k


# Described limits for the two kinds of collection.
DOCUMENT_SEARCH = SearchOptions(limit=15, rerank=True)
TABLE_SEARCH = SearchOptions(limit=8, rerank=True)


def sparse_input(queries: DataFrame) -> DataFrame:
    """``query_id, query`` for the BM25 leg: keywords, when given, replace the
    question; null and empty lists mean no keywords."""
    if "keywords" not in queries.columns:
        return queries.select("query_id", "query")
    given = F.coalesce(F.size("keywords"), F.lit(0)) > 0
    asked = F.when(given, F.array_join("keywords", " ")).otherwise(F.col("query"))
    return queries.select("query_id", asked.alias("query"))


def retrieve(
    corpus: DataFrame,
    queries: DataFrame,
    options: SearchOptions = SearchOptions(),
    embedder: Embedder | None = None,
    stats: DataFrame | None = None,
    dense_search: DenseSearch | None = None,
    sparse_search: SparseSearch | None = None,
) -> DataFrame:
    """Fused hits ``query_id, id, score, rank`` before any reranking.

    A corpus that already carries a ``dense`` column, or stored sparse vectors,
    is neither embedded nor tokenised again. ``dense_search`` and ``sparse_search``
    take the place of the legs' scans, e.g. searches in stored cells and postings.
    """
    embedder = embedder or hashing_embedder(options.dimension)
    asked = queries.select("query_id", embedder(F.col("query")).alias("dense"))
    if dense_search is not None:
        dense = dense_search(asked, options.leg_limit)
    else:
        points = corpus if "dense" in corpus.columns else embed(corpus.select("id", "text"), embedder)
        dense = dense_top_k(points, asked, options.leg_limit, options.dimension)
    if sparse_search is not None:
        sparse = sparse_search(sparse_input(queries), options.leg_limit)
    else:
        sparse = sparse_top_k(corpus, sparse_input(queries), options.leg_limit, params=options.bm25, stats=stats)
    return fuse(
        union_legs(dense=dense, sparse=sparse), options.retrieval_limit, options.rrf_k, options.score_threshold
    )


def with_texts(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Fetch the texts of hits; adaptive execution broadcasts a hit list that turns out small."""
    return corpus.join(hits, "id")


def hybrid_search(
    corpus: DataFrame,
    queries: DataFrame,
    options: SearchOptions = SearchOptions(),
    embedder: Embedder | None = None,
    scorer: Scorer = overlap_scorer,
    stats: DataFrame | None = None,
    dense_search: DenseSearch | None = None,
    sparse_search: SparseSearch | None = None,
) -> DataFrame:
    """Answer ``queries(query_id, query[, keywords])`` from ``corpus(id, text[, metadata, dense])``.

    Returns ``query_id, id, score, rank, text[, metadata], reranked``. The scorer
    sees only fused candidates, never the corpus.
    """
    hits = retrieve(corpus, queries, options, embedder, stats, dense_search, sparse_search)
    columns = ["id", "text"] + (["metadata"] if "metadata" in corpus.columns else [])
    found = with_texts(hits, corpus.select(*columns))
    if options.rerank:
        asked = queries.select("query_id", "query")
        found = rerank(found.join(asked, "query_id"), options.final_limit, scorer).drop("query")
    found = found.withColumn("id", F.col("id").cast("string")).withColumn("reranked", F.lit(options.rerank))
    if "metadata" in columns:
        found = found.withColumn("metadata", without_text(F.col("metadata")))
    ordered = ["query_id", "id", "score", "rank", *columns[1:], "reranked"]
    return found.select(*ordered)
