"""Nearest neighbours against brute force; recall of the pruned search."""

import numpy as np
import pytest

from biblark.operators import vectors
from biblark.operators.neighbours import neighbours

SCHEMA = "id long, v array<float>"


def rows_of(spark, x, first=0):
    return spark.createDataFrame([(first + i, None if r is None else [float(c) for c in r]) for i, r in enumerate(x)], SCHEMA)


def brute(x, k, floor=-1.0, with_self=False):
    x = np.asarray(x, dtype=np.float32).astype(np.float64)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sims = np.round(u @ u.T, 6)
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if (with_self or i != j) and sims[i, j] >= floor), key=lambda j: (-sims[i, j], j))
        yield from ((i, j, sims[i, j]) for j in order[:k])


def result(df):
    return {(r["src"], r["dst"]): r["weight"] for r in df.collect()}


@pytest.mark.parametrize("block", [7, 4096])
@pytest.mark.parametrize("with_self", [True, False])
def test_exact_with_copies(spark, block, with_self):
    """A third of the rows is one vector; blocks are smaller than a group."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5)).round(1)
    x[rng.permutation(90)[:30]] = x[0]
    got = result(neighbours(rows_of(spark, x), "id", "v", 4, 0.1, with_self=with_self, exact=True, block=block))
    expected = {(a, b): w for a, b, w in brute(x, 4, 0.1, with_self)}
    assert got.keys() == expected.keys() and all(abs(got[p] - expected[p]) < 2e-6 for p in got)


def test_queries_and_odd_vectors(spark):
    x = [[1.0, 0.0], [1.0, 0.1], [0.0, 0.0], None, [], [1.0, 0.0, 0.0], [0.9, 0.0]]
    got = neighbours(rows_of(spark, x), "id", "v", 2, 0.5, queries=rows_of(spark, [[2.0, 0.0], [1.0]], 100))
    assert set(result(got)) == {(100, 0), (100, 6)}


def test_empty(spark):
    assert neighbours(rows_of(spark, [[1.0]]).limit(0), "id", "v", 3).count() == 0


def test_pruned_search_keeps_its_recall(spark):
    """Cells are visited in part only, and nine of ten true neighbours at least are found."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + 0.4 * rng.normal(size=(150, 16)) for c in centres]).astype(np.float32)
    rows = rows_of(spark, x)
    got = set(result(neighbours(rows, "id", "v", 5, block=512)))
    expected = {(a, b) for a, b, _ in brute(x, 5)}
    assert len(got) == 5 * len(x) and len(got & expected) / len(expected) >= 0.9


def test_graph_inside_a_subtree(spark):
    """Neighbours are sought among the members, so an outsider between two of them does not keep them apart."""
    x = rows_of(spark, [[1.0, 0.0], [1.0, 0.2], [1.0, 0.1], [0.0, 1.0]])
    members = spark.createDataFrame([(7, 0), (8, 1), (9, 2), (8, 3)], "collection_id long, document_id long")
    inside = spark.createDataFrame([(7,), (8,)], "id long")
    got = vectors.subtree_edges(x, "id", "v", members, inside, k=1, floor=0.5).collect()
    assert [(r["a"], r["b"]) for r in got] == [(0, 1)]
