"""Dense leg: embedding plug-in, built-in hashing embedder, exact cosine top-k."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.arrays import by_pieces, split_texts
from tabularium.functions.text import token_text
from tabularium.operators.scan import (
    SCORE_DIGITS,
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

EMBED_BATCH = 128
# Vector cells in one broadcast block: 64 MB of doubles.
CELLS_PER_BLOCK = 8_000_000

Embedder = Callable[[Column], Column]


def hashing_embedder(dimension: int = 64) -> Embedder:
    """Deterministic stand-in for a model: signed feature hashing, unit length.

    A token goes to the dimension given by the first six hex digits of its md5,
    with the sign given by the seventh.
    """

    def vectors(texts: pa.Array) -> pa.Array:
        bags = split_texts(texts)
        coded = pc.dictionary_encode(pc.list_flatten(bags))
        # The first seven hex digits are three bytes and half of the fourth.
        digests = b"".join([hashlib.md5(t.encode()).digest()[:4] for t in coded.dictionary.to_pylist()])
        first = np.frombuffer(digests, ">u4").astype(np.int64)
        bucket, sign = (first >> 8) % dimension, np.where(first & 0x80, -1.0, 1.0)
        code = coded.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(bags)), pc.list_value_length(bags).to_numpy(zero_copy_only=False))
        cells = np.bincount(row * dimension + bucket[code], sign[code], len(bags) * dimension)
        # Without a single token the cells are whole numbers.
        matrix = cells.astype(np.float64).reshape(len(bags), dimension)
        length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
        offsets = np.arange(len(bags) + 1, dtype=np.int32) * dimension
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel().astype(np.float32)))

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        return by_pieces(texts, vectors)

    return lambda text: embed(token_text(text))


def model_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = EMBED_BATCH) -> Embedder:
    """Wrap a model: ``load`` runs once per Python worker, calls get ``batch`` texts."""

    @F.arrow_udf("array<float>")
    def embed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for chunk in texts:
            values = chunk.to_pylist()
            vectors: list[list[float]] = []
            for first in range(0, len(values), batch):
                vectors.extend(model(values[first : first + batch]))
            yield pa.array(vectors, pa.list_(pa.float32()))

    return embed


def embed(df: DataFrame, embedder: Embedder, text_col: str = "text", into: str = "dense") -> DataFrame:
    return df.withColumn(into, embedder(F.col(text_col)))


def dense_top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    dimension: int,
    id_col: str = "id",
    vector_col: str = "dense",
    cells_per_block: int = CELLS_PER_BLOCK,
) -> DataFrame:
    """Exact cosine top-k for every row of ``queries(query_id, dense)``.

    Rows whose vector is missing or of another length take no part.
    """
    points = corpus.select(F.col(id_col).alias("id"), F.col(vector_col).alias("dense"))
    asked, count = numbered_blocks(queries.select("query_id", "dense"), F.lit(dimension).cast("long"), cells_per_block)
    schema = hits_type(asked.schema["query_id"].dataType, points.schema["id"].dataType)

    def side(table: pa.Table) -> dict:
        table = complete_rows(table, dimension).combine_chunks()
        return {"query_ids": one_array(table["query_id"]), "vectors": as_matrix(one_array(table["dense"]), dimension)}

    def score(side: dict, best: RunningBest, batch: pa.RecordBatch) -> None:
        if not len(side["query_ids"]):
            return
        batch = complete_rows(batch, dimension)
        ids, matrix = batch.column(0), as_matrix(batch.column(1), dimension)
        step = tile_rows(len(side["query_ids"]))
        for first in range(0, len(ids), step):
            scores = np.round(matrix[first : first + step] @ side["vectors"].T, SCORE_DIGITS)
            offer_matrix(best, scores, ids.slice(first, step), np.ones_like(scores, dtype=bool))

    found = scan_blocks(lambda _: points, block_reader(asked, count), count, side, score, k, schema)
    return no_hits(points, schema) if found is None else found


def complete_rows(batch: pa.RecordBatch | pa.Table, dimension: int) -> pa.RecordBatch | pa.Table:
    """Rows with a vector of the right length. Checked here and not in a filter:
    a filter on an embedding column would make Catalyst evaluate the model twice."""
    return batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dimension), False))


def as_matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    """Unit-length rows in double precision; zero rows stay zero."""
    matrix = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    matrix = np.nan_to_num(matrix, nan=0.0)
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
