"""Exact scoring of a whole corpus against blocks of queries.

The corpus stays where Spark put it. Each task scores its own rows against a
broadcast block of queries and keeps only the best ``k`` per query, so what is
shuffled is ``tasks x queries x k`` narrow rows, never query-document pairs.

Only a block of bounded size is ever broadcast. A larger query batch is cut
into several blocks by a hash of the query id and written by block; the driver
holds one block at a time. Up to ``BLOCKS_PER_SCAN`` blocks go through one scan of
the corpus: a task takes a tile of its rows, lets all blocks pass over it, and ships
the best ``k`` per query before it takes the next tile. So neither side is ever held
as a whole, and a larger batch costs more scoring, not more reading.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.operators.ranking import top_k
from tabularium.session import shared_path, shared_root

SCORE_DIGITS = 6
_SHRINK_AT = 400_000
# Offers held before they become one: a small one takes far more room than its rows.
_OFFERS_HELD = 512
TILE_CELLS = 4_000_000
# Corpus bytes that a task holds while several query blocks pass over them.
TILE_BYTES = 64 << 20
# Query blocks of one scan: what a task may have to hold of them.
BLOCKS_PER_SCAN = 8
# Block number of rows that belong to the whole batch.
WHOLE_BATCH = -1


class RunningBest:
    """Best ``k`` (score, id) pairs per query position, fed batch by batch.

    Higher scores first, equal scores by ascending id.
    """

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        # The best scores so far of queries that are pruned one by one, rising.
        self.top: dict[int, np.ndarray] = {}
        self._tables: list[pa.Table] = []
        self._rows = 0

    def offer(self, query: np.ndarray, score: np.ndarray, ids: pa.Array, row: np.ndarray) -> None:
        keep = score >= self.floor[query]
        if not keep.any():
            return
        self._tables.append(
            pa.table({"q": query[keep].astype(np.int64), "score": score[keep], "id": ids.take(pa.array(row[keep]))})
        )
        self._rows += int(keep.sum())
        if self._rows > _SHRINK_AT or len(self._tables) > _OFFERS_HELD:
            self._shrink()

    def _shrink(self) -> pa.Table:
        merged = pa.concat_tables(self._tables)
        order = pc.sort_indices(merged, [("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        merged = merged.take(order)
        query = merged["q"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        last = place == self.k - 1
        self.floor[query[last]] = merged["score"].to_numpy()[last]
        merged = merged.filter(pa.array(place < self.k))
        self._tables, self._rows = [merged], merged.num_rows
        return merged

    def result(self, query_ids: pa.Array) -> pa.RecordBatch | None:
        if not self._tables:
            return None
        best = self._shrink().combine_chunks()
        return pa.RecordBatch.from_arrays(
            [
                query_ids.take(best["q"].combine_chunks()),
                best["id"].combine_chunks(),
                best["score"].combine_chunks(),
            ],
            names=["query_id", "id", "score"],
        )


def offer_matrix(
    best: RunningBest, scores: np.ndarray, ids: pa.Array, wanted: np.ndarray, queries: np.ndarray | None = None
) -> None:
    """Offer a rows x queries score matrix; ``wanted`` masks valid cells.

    ``queries`` gives the query positions of the columns, if they are not all.
    """
    k = best.k
    scores = np.where(wanted, scores, -np.inf)
    floor = best.floor if queries is None else best.floor[queries]
    if scores.shape[0] > k:
        floor = np.maximum(floor, np.partition(scores, -k, axis=0)[-k])
    row, query = np.nonzero(wanted & (scores >= floor))
    if len(row):
        best.offer(query if queries is None else queries[query], scores[row, query], ids, row)


def tile_rows(n_queries: int) -> int:
    return max(1, TILE_CELLS // max(1, n_queries))


def blocks(queries: DataFrame, weight, limit: int) -> list[DataFrame]:
    """Cut a query batch so that the summed ``weight`` of a block is about ``limit``."""
    total = queries.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("total")).first()["total"]
    count = max(1, -(-int(total) // limit))
    if count == 1:
        return [queries]
    block_no = F.pmod(F.xxhash64("query_id"), F.lit(count))
    return [queries.filter(block_no == number) for number in range(count)]


def score_blocks(
    query_blocks: list[DataFrame],
    score_one: Callable[[DataFrame], DataFrame],
    k: int,
) -> DataFrame:
    """Score block after block and rank: ``query_id, id, score, rank``."""
    results = []
    for block in query_blocks:
        partial = score_one(block)
        ranked = top_k(partial, ["query_id"], [F.desc("score"), F.asc("id")], k, spread_by="id")
        if len(query_blocks) > 1:
            shared_root(ranked.sparkSession)
            ranked = ranked.checkpoint()
        results.append(ranked)
    return reduce(DataFrame.unionByName, results)


def numbered_blocks(queries: DataFrame, weight, limit: int) -> tuple[DataFrame, int]:
    """Queries with the number of their ``block``, and how many blocks there are: the summed ``weight`` of each is about ``limit``."""
    total = queries.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("total")).first()["total"]
    count = max(1, -(-int(total) // limit))
    return queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(count)).cast("int")), count


def block_reader(asked: DataFrame, count: int) -> Callable[[int], pa.Table]:
    """Reads one block of ``asked`` at a time; several are written by block first, so that what they are made from is read once."""
    if count == 1:
        whole = asked.toArrow()
        return lambda number: whole.filter(pc.equal(whole["block"], number)).drop_columns(["block"]).combine_chunks()
    spark, path = asked.sparkSession, shared_path(asked.sparkSession, "asked")
    asked.repartition("block").write.partitionBy("block").parquet(path)
    written = spark.read.parquet(path)
    return lambda number: written.filter(F.col("block") == number).drop("block").toArrow().combine_chunks()


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    tile, size = [], 0
    for batch in batches:
        tile.append(batch)
        size += batch.nbytes
        if size >= TILE_BYTES:
            yield tile
            tile, size = [], 0
    if tile:
        yield tile


def scan_blocks(
    corpus: Callable[[list[Any]], DataFrame],
    block: Callable[[int], pa.Table],
    count: int,
    side: Callable[[pa.Table], dict],
    score: Callable[[dict, RunningBest, pa.RecordBatch], None],
    k: int,
    schema: T.StructType,
) -> DataFrame | None:
    """``query_id, id, score, rank`` of all blocks; None if no block holds anything.

    ``side`` makes what tasks need of a block, with its ``query_ids``, and ``corpus``
    the rows to scan for the sides given; ``score`` offers the hits of a batch of rows.
    """
    results = []
    for first in range(0, count, BLOCKS_PER_SCAN):
        tables = (block(number) for number in range(first, min(count, first + BLOCKS_PER_SCAN)))
        shared: list[Broadcast] = []
        wanted = []
        rows = None
        for table in tables:
            if table.num_rows:
                made = side(table)
                wanted.append(made.get("columns"))
                rows = corpus(wanted)
                shared.append(rows.sparkSession.sparkContext.broadcast(made))
        if rows is not None:
            partial = rows.mapInArrow(_scanner(shared, score, k), schema)
            results.append(top_k(partial, ["query_id"], [F.desc("score"), F.asc("id")], k, spread_by="id"))
    return reduce(DataFrame.unionByName, results) if results else None


def _scanner(shared: list[Broadcast], score: Callable[[dict, RunningBest, pa.RecordBatch], None], k: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One block needs no second look at any row, so all rows are one tile.
        for tile in [batches] if len(shared) == 1 else _tiles(batches):
            for one in shared:
                side = one.value
                best = RunningBest(len(side["query_ids"]), k)
                for batch in tile:
                    score(side, best, batch)
                result = best.result(side["query_ids"])
                if result is not None:
                    yield result

    return kernel


def hits_type(query_type: T.DataType, id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("id", id_type),
            T.StructField("score", T.DoubleType()),
        ]
    )


def no_hits(corpus: DataFrame, schema: T.StructType) -> DataFrame:
    return corpus.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
