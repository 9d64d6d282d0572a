"""Approximate dense top-k: points in leaves of a two-level centre tree, of which a query looks into the nearest.

Branch centres come from distributed k-means; each branch's own vectors, in the same
sample, give its leaf centres. A point is compared with the branches, then with the
leaves of its branch, so assignment costs the square root of the number of leaves. A
query looks into its ``probe`` best leaves; what it misses is measured by ``recall``
against the exact search, and more probes find more.

All blocks of queries meet the points in one scan, in which a row is scored by the
queries that look into its leaf and no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.operators.cells import train_centres
from tabularium.operators.dense import CELLS_PER_BLOCK, as_matrix, complete_rows
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

# Rows that the tree is fitted on, about; it decides what is found, all rows are indexed.
SAMPLE_ROWS = 200_000
# Bytes of centres that may be broadcast.
TREE_BYTES = 64 << 20
_ROUNDS = 8


@dataclass(frozen=True)
class CentreTree:
    """Branch centres, and all leaf centres with the branch of each, sorted by branch. Rows have unit length."""

    branches: np.ndarray
    leaves: np.ndarray
    branch_of: np.ndarray

    def __post_init__(self) -> None:
        if self.branches.nbytes + self.leaves.nbytes > TREE_BYTES:
            raise ValueError(f"the centres take more than {TREE_BYTES} bytes: use fewer leaves")

    @property
    def dimension(self) -> int:
        return self.branches.shape[1]

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each unit row."""
        leaf = np.zeros(len(vectors), np.int64)
        step = tile_rows(len(self.branches))
        starts = np.searchsorted(self.branch_of, np.arange(len(self.branches) + 1))
        for first in range(0, len(vectors), step):
            part = vectors[first : first + step]
            branch = (part @ self.branches.T).argmax(axis=1)
            for number in np.unique(branch):
                own = np.flatnonzero(branch == number)
                a, b = starts[number], starts[number + 1]
                leaf[first + own] = a + (part[own] @ self.leaves[a:b].T).argmax(axis=1)
        return leaf

    def nearest(self, vectors: np.ndarray, probe: int) -> np.ndarray:
        """The ``probe`` best leaves of each unit row."""
        probe = min(probe, len(self.leaves))
        found = np.zeros((len(vectors), probe), np.int64)
        step = tile_rows(len(self.leaves))
        for first in range(0, len(vectors), step):
            close = vectors[first : first + step] @ self.leaves.T
            found[first : first + step] = np.argsort(-close, axis=1, kind="stable")[:, :probe]
        return found


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _spherical_means(vectors: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` centres of unit rows; starts are spread evenly over the rows as they come."""
    centres = vectors[np.unique(np.linspace(0, len(vectors) - 1, min(k, len(vectors))).astype(np.int64))]
    for _ in range(_ROUNDS):
        near = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        centres = np.where(np.bincount(near, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return centres


def train_tree(points: DataFrame, branches: int, leaves: int, dimension: int, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> CentreTree:
    """A tree for ``points(id, dense)`` of ``branches`` times up to ``leaves`` leaves, fitted on about ``sample_rows`` rows."""
    points = points.filter(F.size("dense") == dimension)
    n = points.count()
    sample = points if n <= sample_rows else points.sample(sample_rows / n, seed)
    tops = train_centres(sample, branches, dimension)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = complete_rows(batch, dimension)
            branch = (as_matrix(batch.column(1), dimension) @ tops.T).argmax(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(branch, pa.int32()), batch.column(0), batch.column(1).cast(pa.list_(pa.float64()))], ["branch", "id", "dense"])

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        centres = _spherical_means(_unit(np.array(rows["dense"].tolist(), np.float64).reshape(-1, dimension)), leaves)
        return pd.DataFrame({"branch": key[0], "number": range(len(centres)), "centre": centres.tolist()})

    id_sql = points.schema["id"].dataType.simpleString()
    placed = sample.select("id", "dense").mapInArrow(near, f"branch int, id {id_sql}, dense array<double>")
    # A group is a branch's part of the sample, so it is bounded.
    made = placed.groupBy("branch").applyInPandas(split, "branch int, number int, centre array<double>").orderBy("branch", "number").collect()
    found = np.array([r["centre"] for r in made], np.float64).reshape(-1, dimension)
    numbers = np.array([r["branch"] for r in made], np.int64)
    # Branches that no row is in have no leaves and are left out.
    used, branch_of = np.unique(numbers, return_inverse=True)
    return CentreTree(tops[used], found, branch_of)


def assign_leaves(points: DataFrame, tree: CentreTree) -> DataFrame:
    """``id, dense, leaf`` of ``points(id, dense)``; nothing is shuffled."""
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            batch = complete_rows(batch, tree.dimension)
            leaf = tree.place(as_matrix(batch.column(1), tree.dimension))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float32())), pa.array(leaf, pa.int32())], ["id", "dense", "leaf"])

    schema = T.StructType([T.StructField("id", points.schema["id"].dataType), T.StructField("dense", T.ArrayType(T.FloatType())), T.StructField("leaf", T.IntegerType())])
    return points.select("id", "dense").mapInArrow(kernel, schema)


def write_leaves(placed: DataFrame, path: str) -> None:
    """Store placed points sorted by leaf, so that files and their row groups skip leaves by their statistics."""
    placed.hint("rebalance", F.col("leaf")).sortWithinPartitions("leaf").write.mode("overwrite").parquet(path)


def leaf_top_k(placed: DataFrame, tree: CentreTree, queries: DataFrame, k: int, probe: int, cells_per_block: int = CELLS_PER_BLOCK) -> DataFrame:
    """Best ``k`` by cosine among the points in each query's ``probe`` nearest leaves: ``query_id, id, score, rank``."""
    dimension = tree.dimension
    asked, count = numbered_blocks(queries.select("query_id", "dense"), F.lit(dimension + probe).cast("long"), cells_per_block)
    schema = hits_type(asked.schema["query_id"].dataType, placed.schema["id"].dataType)

    def side(table: pa.Table) -> dict:
        table = complete_rows(table, dimension).combine_chunks()
        vectors = as_matrix(one_array(table["dense"]), dimension)
        wanted = tree.nearest(vectors, probe)
        leaf = wanted.ravel()
        order = np.argsort(leaf, kind="stable")
        return {
            "query_ids": one_array(table["query_id"]), "vectors": vectors,
            # Queries by the leaf that they look into.
            "start": np.searchsorted(leaf[order], np.arange(len(tree.leaves) + 1)), "query": np.repeat(np.arange(len(vectors)), wanted.shape[1])[order],
            "columns": np.unique(leaf).tolist(),
        }

    def points(wanted: list[list[int]]) -> DataFrame:
        needed = sorted({leaf for one in wanted for leaf in one})
        # Runs of leaves, which the scan can skip by; few of them, as the filter is part of the plan.
        few = needed if len(needed) <= 64 else None
        rows = placed.select("id", "dense", "leaf")
        return rows.filter(F.col("leaf").isin(few)) if few is not None else rows.filter(F.col("leaf").between(needed[0], needed[-1]))

    def score(side: dict, best: RunningBest, batch: pa.RecordBatch) -> None:
        leaves = batch.column(2).to_numpy(zero_copy_only=False)
        order = np.argsort(leaves, kind="stable")
        edges = np.flatnonzero(np.diff(leaves[order], prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
            leaf = int(leaves[order[a]])
            own = side["query"][side["start"][leaf] : side["start"][leaf + 1]]
            if not len(own):
                continue
            part = batch.take(pa.array(order[a:b]))
            matrix = as_matrix(part.column(1), dimension)
            step = tile_rows(len(own))
            for first in range(0, len(matrix), step):
                scores = np.round(matrix[first : first + step] @ side["vectors"][own].T, SCORE_DIGITS)
                offer_matrix(best, scores, part.column(0).slice(first, step), np.ones_like(scores, dtype=bool), own)

    found = scan_blocks(points, block_reader(asked, count), count, side, score, k, schema)
    return no_hits(placed, schema) if found is None else found


def pairs_scored(placed: DataFrame, tree: CentreTree, queries: DataFrame, probe: int) -> DataFrame:
    """One row ``scored, all``: (query, point) pairs that a search scores, and those of an exact one."""
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"))
    looked = queries.select("query_id", "dense").mapInArrow(_looks(queries.sparkSession.sparkContext.broadcast(tree), probe), "leaf int, looks long")
    looked = looked.groupBy("leaf").agg(F.sum("looks").alias("looks"))
    scored = sizes.join(looked, "leaf", "left").agg(F.sum(F.col("n") * F.coalesce("looks", F.lit(0))).alias("scored"), F.sum("n").alias("points"))
    asked = queries.agg(F.count("*").alias("asked"))
    return scored.join(F.broadcast(asked)).select("scored", (F.col("points") * F.col("asked")).alias("all"))


def _looks(shared, probe: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            batch = complete_rows(batch, tree.dimension)
            if batch.num_rows:
                leaf, looks = np.unique(tree.nearest(as_matrix(batch.column(1), tree.dimension), probe), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(looks, pa.int64())], ["leaf", "looks"])

    return kernel


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``recall``: the share of the exact hits ``query_id, id`` that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg((F.count("hit") / F.greatest(F.count("*"), F.lit(1))).alias("recall"))
