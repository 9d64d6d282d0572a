"""BM25 leg: term statistics, sparse vectors and exact top-k.

Weights follow Robertson and Zaragoza, "The Probabilistic Relevance Framework:
BM25 and Beyond" (2009), with the non-negative form of the inverse document
frequency.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.arrays import by_pieces, explode_once, split_texts
from tabularium.functions.text import token_text, tokens
from tabularium.operators.scan import (
    SCORE_DIGITS,
    TILE_CELLS,
    WHOLE_BATCH,
    RunningBest,
    block_reader,
    hits_type,
    no_hits,
    numbered_blocks,
    offer_matrix,
    one_array,
    scan_blocks,
    tile_rows,
)

# Query terms in one broadcast block: about 64 MB of terms and weights.
TERMS_PER_BLOCK = 1_000_000
# Tokens that a task counts at once, about: what counting holds beside its batch.
TOKENS_AT_ONCE = 1 << 18
# Bytes of a token and its blank, about.
_TOKEN_BYTES = 8


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


# Row of a statistics table that stands for the whole corpus.
TOTALS = ""

# Plug-in that turns a text column into an array of tokens.
Tokenizer = Callable[[Column], Column]


def postings(
    corpus: DataFrame, id_col: str = "id", text_col: str = "text", tokenizer: Tokenizer = tokens
) -> DataFrame:
    """Long form ``(id, term, tf, length)``, one row per distinct term of a row;
    unrolled from the row's own counts, so nothing is shuffled."""
    vectors = sparse_vectors(corpus, id_col, text_col, tokenizer)
    pairs = explode_once(vectors, F.arrays_zip("terms", "tfs"), "_pair")
    return pairs.select("id", F.col("_pair.terms").alias("term"), F.col("_pair.tfs").alias("tf"), "length")


def document_frequency(corpus: DataFrame, text_col: str = "text", tokenizer: Tokenizer = tokens) -> DataFrame:
    """``(term, df)``. Terms are made distinct inside the row, so one shuffle of
    map-side counts is all it takes, however common a term is."""
    return (
        explode_once(corpus.select(text_col), F.array_distinct(tokenizer(F.col(text_col))), "term")
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def idf(df: Column, documents: Column) -> Column:
    return F.log(F.lit(1.0) + (documents - df + 0.5) / (df + 0.5))


def corpus_stats(corpus: DataFrame, text_col: str = "text", tokenizer: Tokenizer = tokens) -> DataFrame:
    """Statistics table ``(term, df, length)`` of a corpus, in one pass.

    The row of the empty term holds the number of documents and their summed
    length. Every document contributes its distinct terms and that one, so one
    aggregation with map-side partials yields both.
    """
    return _count_terms(corpus.select(tokenizer(F.col(text_col)).alias("_bag")), F.size("_bag"))


def stored_stats(points: DataFrame) -> DataFrame:
    """The same from stored sparse vectors: no text is read."""
    return _count_terms(points.select(F.col("terms").alias("_bag"), "length"), F.col("length"))


def _count_terms(bags: DataFrame, length: Column) -> DataFrame:
    sized = bags.select("_bag", F.coalesce(length.cast("long"), F.lit(0)).alias("_length"))
    terms = F.concat(F.array(F.lit(TOTALS)), F.array_distinct(F.coalesce("_bag", F.array().cast("array<string>"))))
    return (
        explode_once(sized, terms, "term")
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("_length").alias("length"))
    )


STORED = ("terms", "tfs", "length")


def is_stored(corpus: DataFrame) -> bool:
    """Whether a corpus carries sparse vectors, as points of a collection do."""
    return set(STORED) <= set(corpus.columns)


def _counted(bags: pa.Array) -> pa.StructArray:
    """Distinct terms, their counts and the length of each bag."""
    lengths = pc.list_value_length(bags).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(pc.list_flatten(bags))
    vocabulary = max(1, len(coded.dictionary))
    key = np.repeat(np.arange(len(bags)), lengths) * vocabulary + coded.indices.to_numpy(zero_copy_only=False)
    pairs, counts = np.unique(key, return_counts=True)
    offsets = pa.array(np.searchsorted(pairs // vocabulary, np.arange(len(bags) + 1)), pa.int32())
    terms = coded.dictionary.take(pa.array(pairs % vocabulary)).cast(pa.string())
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(offsets, terms),
            pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
            pa.array(lengths, pa.int32()),
        ],
        names=["terms", "tfs", "length"],
    )


def sparse_encoder(tokenizer: Tokenizer = tokens) -> Callable[[Column], Column]:
    """Text to its stored form ``struct<terms, tfs, length>``, by an Arrow kernel."""

    @F.arrow_udf("struct<terms:array<string>,tfs:array<int>,length:int>")
    def encode(bags: pa.Array) -> pa.Array:
        if pa.types.is_list(bags.type):
            return by_pieces(bags, _counted, TOKENS_AT_ONCE)
        return by_pieces(bags, lambda texts: _counted(split_texts(texts)), TOKENS_AT_ONCE * _TOKEN_BYTES)

    # Otherwise a filter on the result, pushed below it, would have every text counted twice, by twice the workers.
    once = encode.asNondeterministic()
    # The tokens of a plug-in may hold blanks.
    return lambda text: once((token_text if tokenizer is tokens else tokenizer)(text))


def sparse_vectors(
    corpus: DataFrame, id_col: str = "id", text_col: str = "text", tokenizer: Tokenizer = tokens
) -> DataFrame:
    """Stored form of the sparse leg: ``id, terms, tfs, length`` per row.

    Counting stays inside the row, so encoding a corpus shuffles nothing.
    """
    encoded = corpus.select(F.col(id_col).alias("id"), sparse_encoder(tokenizer)(F.col(text_col)).alias("_sparse"))
    return encoded.select("id", "_sparse.terms", "_sparse.tfs", "_sparse.length")


def sparse_top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "id",
    text_col: str = "text",
    params: Bm25 = Bm25(),
    stats: DataFrame | None = None,
    query_weight: str = "distinct",
    terms_per_block: int = TERMS_PER_BLOCK,
    tokenizer: Tokenizer = tokens,
) -> DataFrame:
    """Exact BM25 top-k for every row of ``queries(query_id, query)``.

    A corpus with stored sparse vectors is scored from them; otherwise its text
    is tokenised. A written statistics table saves the first of two passes.
    ``query_weight='tf'`` counts repeated query terms, ``'distinct'`` does not.
    """
    stored = is_stored(corpus)
    if stats is None:
        stats = stored_stats(corpus) if stored else corpus_stats(corpus, text_col, tokenizer)
    if stored:
        documents = corpus.select(F.col(id_col).alias("id"), *STORED)
    else:
        documents = corpus.select(F.col(id_col).alias("id"), tokenizer(F.col(text_col)).alias("tokens"))
    read, count, weigh, mean_length = asked_terms(queries, stats, query_weight, terms_per_block, tokenizer)
    schema = hits_type(queries.schema["query_id"].dataType, documents.schema["id"].dataType)
    k1, b = params.k1, params.b

    def side(table: pa.Table) -> dict:
        query_codes = one_array(table["query_id"]).dictionary_encode()
        term_codes = one_array(table["term"]).dictionary_encode()
        codes = term_codes.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        return {
            "query_ids": query_codes.dictionary,
            "vocabulary": term_codes.dictionary.cast(pa.string()),
            # Queries per term, in compressed rows.
            "start": np.searchsorted(codes[order], np.arange(len(term_codes.dictionary) + 1)),
            "query": query_codes.indices.to_numpy()[order],
            "weight": weigh(table)[order],
        }

    def score(side: dict, best: RunningBest, batch: pa.RecordBatch) -> None:
        n_queries = len(side["query_ids"])
        fan_out = np.diff(side["start"])
        step = tile_rows(n_queries)
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            row, code, tf, lengths = _term_counts(part, side["vocabulary"])
            if not len(row):
                continue
            norm = k1 * (1.0 - b + b * lengths[row] / mean_length)
            gain = tf * (k1 + 1.0) / (tf + norm)
            scores = np.zeros(part.num_rows * n_queries)
            # A term may occur in many queries: expand a bounded part at a time.
            copies = fan_out[code]
            cuts = np.searchsorted(np.cumsum(copies), np.arange(TILE_CELLS, copies.sum(), TILE_CELLS))
            for piece in np.split(np.arange(len(code)), cuts):
                times = copies[piece]
                offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                slot = np.repeat(side["start"][code[piece]], times) + offset
                cell = np.repeat(row[piece], times) * n_queries + side["query"][slot]
                scores += np.bincount(cell, np.repeat(gain[piece], times) * side["weight"][slot], len(scores))
            scores = np.round(scores.reshape(-1, n_queries), SCORE_DIGITS)
            offer_matrix(best, scores, part.column(0), scores > 0)

    found = scan_blocks(lambda _: documents, read, count, side, score, k, schema)
    return no_hits(documents, schema) if found is None else found


def asked_terms(
    queries: DataFrame, stats: DataFrame, query_weight: str, terms_per_block: int, tokenizer: Tokenizer
) -> tuple[Callable[[int], pa.Table], int, Callable[[pa.Table], np.ndarray], float]:
    """What a search needs to know of its queries and the corpus.

    That is a reader of the blocks' ``query_id, term, qtf, df, length``, the number of
    blocks, the weights of a block's rows, and the mean length of the documents.
    The statistics are filtered as they are counted, before anything is shuffled.
    """
    bags = queries.select("query_id", tokenizer(F.col("query")).alias("_tokens")).filter(F.size("_tokens") > 0)
    bags, count = numbered_blocks(bags, F.size("_tokens").cast("long"), terms_per_block)
    terms = explode_once(bags, F.col("_tokens"), "term").groupBy("block", "query_id", "term").agg(F.count("*").alias("qtf"))
    wanted = terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit(TOTALS).alias("term"))).distinct()
    # One block has a bounded size; of more, Spark's own size check decides.
    few = F.broadcast if count == 1 else lambda frame: frame
    known = stats.join(few(wanted), "term", "left_semi").join(few(terms), "term", "left")
    read = block_reader(known.select(F.coalesce("block", F.lit(WHOLE_BATCH)).alias("block"), "query_id", "term", "qtf", "df", "length"), count)
    totals = read(WHOLE_BATCH).to_pylist()
    documents, length = (totals[0]["df"], totals[0]["length"]) if totals else (0, 0)

    def weigh(table: pa.Table) -> np.ndarray:
        df = table["df"].to_numpy().astype(float)
        weight = np.log1p((documents - df + 0.5) / (df + 0.5))
        return weight * table["qtf"].to_numpy() if query_weight == "tf" else weight

    return read, count, weigh, max(length / max(documents, 1), 1e-12)


def _term_counts(
    part: pa.RecordBatch, vocabulary: pa.Array
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term code and count of the vocabulary's terms, and all row lengths.

    The batch is ``id, tokens`` or ``id, terms, tfs, length``.
    """
    sizes = pc.list_value_length(part.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = pc.index_in(pc.list_flatten(part.column(1)).cast(pa.string()), value_set=vocabulary)
    known = pc.is_valid(codes).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(part.num_rows), sizes)[known]
    code = pc.drop_null(codes).to_numpy(zero_copy_only=False).astype(np.int64)
    if part.num_columns == 4:
        tf = pc.list_flatten(part.column(2)).to_numpy(zero_copy_only=False)[known]
        return row, code, tf, part.column(3).fill_null(0).to_numpy(zero_copy_only=False)
    pairs, tf = np.unique(row * len(vocabulary) + code, return_counts=True)
    return pairs // len(vocabulary), pairs % len(vocabulary), tf, sizes


def term_weights(corpus: DataFrame, id_col: str = "id", text_col: str = "text", params: Bm25 = Bm25()) -> DataFrame:
    """Length-normalised term weights ``(id, term, weight)`` without the idf,
    which is applied when a query is scored."""
    mean_length = corpus.agg(F.avg(F.size(tokens(F.col(text_col))))).scalar()
    norm = params.k1 * (1.0 - params.b + params.b * F.col("length") / mean_length)
    weight = F.col("tf") * (params.k1 + 1.0) / (F.col("tf") + norm)
    return postings(corpus, id_col, text_col).select("id", "term", weight.alias("weight"))
