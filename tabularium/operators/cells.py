"""Dense top-k with cell pruning: most of a big collection is never scored.

Points are laid out in cells around centres. A query first looks into its
nearest cells, which gives it a score to beat; of the others only those are read
whose best possible score, by the triangle inequality on angles, reaches it. The
result is the exact top-k, whatever the centres are; good ones only save work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.operators.dense import CELLS_PER_BLOCK, as_matrix, complete_rows
from tabularium.operators.ranking import top_k
from tabularium.operators.scan import (
    SCORE_DIGITS,
    RunningBest,
    blocks,
    hits_type,
    offer_matrix,
    score_blocks,
    tile_rows,
)
from tabularium.session import shared_path

# Bytes of centres that may be broadcast.
CENTRE_BYTES = 64 << 20
# Angles are compared with this slack, scores with half a unit of their last digit.
_ANGLE_SLACK = 1e-9
_SCORE_SLACK = 10.0**-SCORE_DIGITS


@dataclass(frozen=True)
class Cells:
    """Centres (unit rows) and, per cell, the widest angle and the point count."""

    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray


def train_centres(points: DataFrame, cells: int, dimension: int, fraction: float = 1.0, seed: int = 1) -> np.ndarray:
    """Centres by distributed k-means on unit vectors. A fraction is enough for
    a big collection: centres decide the layout, not the result."""
    vectors = points if fraction >= 1.0 else points.sample(fraction, seed)
    # A length worked out inside a lambda would be worked out again for every component.
    nonzero = vectors.filter(F.forall("dense", F.isnotnull) & F.exists("dense", lambda x: x != 0))
    nonzero = nonzero.select(array_to_vector(F.col("dense").cast("array<double>")).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="features").transform(nonzero).select("features")
    model = KMeans(k=cells, seed=seed, maxIter=8).fit(unit)
    centres = np.asarray(model.clusterCenters()).reshape(-1, dimension)
    norms = np.sqrt((centres * centres).sum(axis=1, keepdims=True))
    return np.divide(centres, norms, out=np.zeros_like(centres), where=norms > 0)


def nearest_centres(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best centre of each row and its cosine, a bounded tile of the matrix at a time."""
    cell, close = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors))
    step = tile_rows(len(centres))
    for first in range(0, len(vectors), step):
        cosines = vectors[first : first + step] @ centres.T
        best = cosines.argmax(axis=1)
        cell[first : first + step], close[first : first + step] = best, cosines[np.arange(len(best)), best]
    return cell, close


def assign_cells(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """``id, dense, cell, angle`` of ``points(id, dense)``; nothing is shuffled."""
    dimension = centres.shape[1]
    if centres.nbytes > CENTRE_BYTES:
        raise ValueError(f"the centres take more than {CENTRE_BYTES} bytes: use fewer cells")
    shared = points.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType(
        [
            T.StructField("id", points.schema["id"].dataType),
            T.StructField("dense", T.ArrayType(T.FloatType())),
            T.StructField("cell", T.IntegerType()),
            T.StructField("angle", T.DoubleType()),
        ]
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = complete_rows(batch, dimension)
            cell, close = nearest_centres(as_matrix(batch.column(1), dimension), shared.value)
            angle = np.arccos(np.clip(close, -1.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1).cast(pa.list_(pa.float32())),
                    pa.array(cell, pa.int32()),
                    pa.array(angle),
                ],
                names=["id", "dense", "cell", "angle"],
            )

    return points.select("id", F.col("dense").cast("array<float>").alias("dense")).mapInArrow(kernel, schema)


def write_cells(placed: DataFrame, path: str) -> None:
    """Store placed points, partitioned by cell so that a search reads only the
    cells it needs. The rebalance lets adaptive execution spread a cell that
    holds a large share of all points over several tasks."""
    placed.hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(path)


def measure_cells(placed: DataFrame, centres: np.ndarray) -> Cells:
    """Radius and count of every cell: one row per cell on the driver."""
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    for row in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():
        radius[row["cell"]], count[row["cell"]] = row["radius"], row["n"]
    return Cells(centres, radius, count)


def write_bounds(cells: Cells, placed: DataFrame, path: str) -> None:
    """Store centres and bounds, one row per cell."""
    rows = [
        (number, cells.centres[number].tolist(), float(cells.radius[number]), int(cells.count[number]))
        for number in range(len(cells.centres))
    ]
    shape = "cell int, centre array<double>, radius double, n long"
    placed.sparkSession.createDataFrame(rows, shape).coalesce(1).write.mode("overwrite").parquet(path)


def read_bounds(bounds: DataFrame) -> Cells:
    """Centres and bounds as stored: one row per cell on the driver."""
    rows = bounds.orderBy("cell").collect()
    return Cells(
        np.array([row["centre"] for row in rows]),
        np.array([row["radius"] for row in rows]),
        np.array([row["n"] for row in rows], dtype=np.int64),
    )


def cell_top_k(
    placed: DataFrame,
    cells: Cells,
    queries: DataFrame,
    k: int,
    cells_per_block: int = CELLS_PER_BLOCK,
) -> DataFrame:
    """Exact cosine top-k from placed points; same result as a full scan.

    A query weighs its vector and its angle to every centre, so that neither of
    the two outgrows a block.
    """
    dimension = cells.centres.shape[1]
    weight = F.lit(dimension + len(cells.centres)).cast("long")
    asked = queries.select("query_id", "dense")

    def score_one(block: DataFrame) -> DataFrame:
        return _score_block(placed, cells, block, k, dimension)

    return score_blocks(blocks(asked, weight, cells_per_block), score_one, k)


def _score_block(placed: DataFrame, cells: Cells, block: DataFrame, k: int, dimension: int) -> DataFrame:
    spark = placed.sparkSession
    table = complete_rows(block.toArrow(), dimension).combine_chunks()
    schema = hits_type(block.schema["query_id"].dataType, placed.schema["id"].dataType)
    if table.num_rows == 0:
        return spark.createDataFrame([], schema)
    query_ids = table["query_id"].combine_chunks()
    vectors = as_matrix(table["dense"].combine_chunks(), dimension)
    angles = np.arccos(np.clip(vectors @ cells.centres.T, -1.0, 1.0))
    first = _nearest_cells(angles, cells.count, k)
    opening = shared_path(spark, "opening")
    # The opening hits are used twice; written once, they survive lost executors.
    _scan_cells(placed, query_ids, vectors, first, k, schema).write.parquet(opening)
    found = spark.read.schema(schema).parquet(opening)
    beaten = _scores_to_beat(found, query_ids, k)
    possible = np.cos(np.maximum(angles - cells.radius - _ANGLE_SLACK, 0.0))
    # A zero vector scores zero, whatever its angle to a centre is.
    possible = np.where((vectors == 0).all(axis=1)[:, None], 1.0, np.maximum(possible, 0.0))
    rest = ~first & (cells.count > 0) & (possible >= beaten[:, None] - _SCORE_SLACK)
    if not rest.any():
        return found
    return found.unionByName(_scan_cells(placed, query_ids, vectors, rest, k, schema))


def _nearest_cells(angles: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """Per query the nearest cells that together hold at least ``k`` points."""
    order = np.argsort(angles, axis=1, kind="stable")
    held = np.cumsum(count[order], axis=1)
    needed = np.concatenate([np.zeros((len(order), 1)), held[:, :-1]], axis=1) < k
    chosen = np.zeros_like(needed)
    np.put_along_axis(chosen, order, needed, axis=1)
    return chosen & (count > 0)


def _scores_to_beat(found: DataFrame, query_ids: pa.Array, k: int) -> np.ndarray:
    """The k-th best score so far per query: one number per query of the block."""
    ranked = top_k(found, ["query_id"], [F.desc("score"), F.asc("id")], k).filter(F.col("rank") == k)
    kth = {row["query_id"]: row["score"] for row in ranked.select("query_id", "score").collect()}
    return np.array([kth.get(q, -np.inf) for q in query_ids.to_pylist()])


def _scan_cells(
    placed: DataFrame, query_ids: pa.Array, vectors: np.ndarray, wanted: np.ndarray, k: int, schema: T.StructType
) -> DataFrame:
    """Score the wanted (query, cell) combinations; other cells are not read."""
    shared = placed.sparkSession.sparkContext.broadcast((query_ids, vectors, wanted))
    dimension = vectors.shape[1]
    needed = [int(c) for c in np.flatnonzero(wanted.any(axis=0))]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_asked, asked, allowed = shared.value
        best = RunningBest(len(ids_asked), k)
        step = tile_rows(len(ids_asked))
        for batch in batches:
            matrix = as_matrix(batch.column(1), dimension)
            cell = batch.column(2).to_numpy(zero_copy_only=False)
            for number in np.unique(cell):
                rows, queries = np.flatnonzero(cell == number), np.flatnonzero(allowed[:, number])
                for begin in range(0, len(rows), step) if len(queries) else ():
                    part = rows[begin : begin + step]
                    scores = np.round(matrix[part] @ asked[queries].T, SCORE_DIGITS)
                    ids = batch.column(0).take(pa.array(part))
                    offer_matrix(best, scores, ids, np.ones_like(scores, dtype=bool), queries)
        result = best.result(ids_asked)
        if result is not None:
            yield result

    return placed.filter(F.col("cell").isin(needed)).select("id", "dense", "cell").mapInArrow(kernel, schema)
