"""Approximate dense search by a centre tree."""

from __future__ import annotations

import numpy as np
import pytest

from tabularium.operators import centretree
from tabularium.operators.cells import nearest_centres
from tabularium.operators.centretree import CentreTree, assign_leaves, leaf_top_k, pairs_scored, recall, train_tree, write_leaves
from tabularium.operators.dense import dense_top_k
from tabularium.session import shared_path

SHAPE = "id long, dense array<double>"


def clustered(n=1500, dimension=8, seed=1):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(25, dimension)) * 3
    return middles[draw.integers(25, size=n)] + draw.normal(size=(n, dimension))


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(vectors)], SHAPE)


@pytest.fixture(scope="module")
def indexed(spark):
    rows = [*[(i, v.tolist()) for i, v in enumerate(clustered())], (5000, None), (5001, [1.0]), (5002, [0.0] * 8)]
    points = spark.createDataFrame(rows, SHAPE)
    tree, path = train_tree(points, 5, 6, 8), shared_path(spark, "leaves")
    write_leaves(assign_leaves(points, tree), path)
    return points, tree, spark.read.parquet(path)


def hits(found):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found.collect())


def test_all_probes_are_exact(spark, indexed):
    points, tree, placed = indexed
    asked = frame(spark, clustered(20, seed=2)).withColumnRenamed("id", "query_id")
    assert placed.count() == 1501 and len(tree.leaves) <= 30
    assert hits(leaf_top_k(placed, tree, asked, 7, 10_000)) == hits(dense_top_k(points, asked, 7, 8))


def test_recall_rises_with_probes(spark, indexed):
    points, tree, placed = indexed
    asked = points.filter("id % 50 = 0 and size(dense) = 8").withColumnRenamed("id", "query_id")
    exact = dense_top_k(points, asked, 10, 8)
    shares, work = [], []
    for probe in (1, 6):
        shares.append(recall(leaf_top_k(placed, tree, asked, 10, probe), exact).first()["recall"])
        counted = pairs_scored(placed, tree, asked, probe).first()
        work.append(counted["scored"] / counted["all"])
    assert shares[0] < shares[1] and shares[1] >= 0.9
    assert work[0] < work[1] < 0.5


def test_blocks_and_nothing(spark, indexed):
    _, tree, placed = indexed
    asked = frame(spark, clustered(30, seed=3)).withColumnRenamed("id", "query_id")
    assert hits(leaf_top_k(placed, tree, asked, 5, 4, cells_per_block=60)) == hits(leaf_top_k(placed, tree, asked, 5, 4))
    assert leaf_top_k(placed, tree, asked.limit(0), 5, 4).count() == 0
    assert leaf_top_k(placed.limit(0), tree, asked, 5, 4).count() == 0


def test_tiles_change_nothing(monkeypatch):
    vectors, tree_rows = clustered(300), clustered(40, seed=5)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    vectors, leaves = unit(vectors), unit(tree_rows)
    tree = CentreTree(leaves[::10], leaves, np.repeat(np.arange(4), 10))
    whole = tree.place(vectors), tree.nearest(vectors, 3), nearest_centres(vectors, leaves)
    monkeypatch.setattr("tabularium.operators.scan.TILE_CELLS", 50)
    assert (tree.place(vectors) == whole[0]).all() and (tree.nearest(vectors, 3) == whole[1]).all()
    assert (nearest_centres(vectors, leaves)[0] == whole[2][0]).all()


def test_too_many_centres_are_refused(monkeypatch):
    monkeypatch.setattr(centretree, "TREE_BYTES", 100)
    with pytest.raises(ValueError, match="fewer leaves"):
        CentreTree(np.zeros((2, 8)), np.zeros((4, 8)), np.array([0, 0, 1, 1]))
