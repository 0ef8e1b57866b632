"""More distinct vectors than one cell holds: queries over neighbours equal their SQL, operators equal brute force."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from biblark import queries
from biblark.operators import vectors
from biblark.operators.neighbours import neighbours
from tests.oracle import assert_same, connection
from tests.test_neighbours import result, rows_of

HERE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The tables of sf0.01 with more vectors."""
    at = tmp_path_factory.mktemp("tables")
    for table in Path(HERE).glob("*.parquet"):
        if table.name != "embeddings.parquet":
            (at / table.name).symlink_to(table)
    ids = [i for i in range(8600) if i % 2 or i % 20 == 0]  # even ones are filed in groups
    rng = np.random.default_rng(11)
    centres, own = rng.normal(size=(40, 64)), rng.integers(40, size=len(ids))
    alone = rng.random(len(ids)) < 0.12  # the others lie in clusters
    x = (np.where(alone, 0.0, 1.0)[:, None] * centres[own] + rng.normal(size=(len(ids), 64))).astype(np.float32)
    columns = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array([i // 20 % 10 for i in ids], pa.int32())}
    pq.write_table(pa.table(columns), at / "embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["knn_graph_edges", "graph_degree", "graph_hubs", "knn_related", "knn_topk", "passage_answers", "reading_paths", "suggest_both", "suggest_name"])
def test_query_equals_its_sql(spark, folder, name):
    assert_same(queries.QUERIES[name](spark, folder), connection(folder), queries.ORACLE_SQL[name])


def clustered(count, width):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, width))[rng.integers(40, size=count)] * (rng.random(count) < 0.8)[:, None] + rng.normal(size=(count, width))
    return x.astype(np.float32)


def test_subtree_of_many_members(spark):
    x = clustered(4300, 12)
    members = spark.createDataFrame([(7, i) for i in range(len(x))], "collection_id long, document_id long")
    got = vectors.subtree_edges(rows_of(spark, x), "id", "v", members, spark.createDataFrame([(7,)], "id long"), k=2, floor=0.3).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 6)
    np.fill_diagonal(sims, -2)
    best = np.argsort(-sims, axis=1, kind="stable")[:, :2]
    expected = {(min(i, j), max(i, j)): sims[i, j] for i in range(len(x)) for j in map(int, best[i]) if sims[i, j] >= 0.3}
    assert {(r["a"], r["b"]): r["weight"] for r in got} == pytest.approx(expected, abs=2e-6)


def test_pruned_search_is_asked_for(spark):
    x = clustered(1500, 12)
    exact, pruned = (set(result(neighbours(rows_of(spark, x), "id", "v", 5, block=128, exact=e))) for e in (True, False))
    assert len(exact) == len(pruned) == 5 * len(x) and len(exact & pruned) >= 0.9 * len(exact)


def test_products_tie_at_their_bounds(spark):
    """Below 0 and above 1 products are equal, and equal rounded ones come in order of id whatever their cosines."""
    x = [[-1.0, 0.0], [-1.0, 0.1], [0.0, 1.0], [1.0, 2e-7], [1.0, 0.0], [1.0, 1e-3], [float("nan"), 1.0]]
    asked = rows_of(spark, [[1.0, 0.0], [3.0, 3.0], [0.3, 0.3e-3]], 100)
    got = neighbours(rows_of(spark, x), "id", "v", 3, queries=asked, with_self=True, product=True)
    by = {}
    for r in got.collect():
        by.setdefault(r["src"], set()).add((r["dst"], r["weight"]))
    assert by == {100: {(3, 1.0), (4, 1.0), (5, 1.0)}, 101: {(2, 1.0), (3, 1.0), (4, 1.0)}, 102: {(3, 0.3), (4, 0.3), (5, 0.3)}}


def test_edges_are_found_once(spark):
    """The rounds of label propagation read the edges; they don't find them again."""
    found = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def weight(w):
        found.add(1)
        return w

    pairs = [(i, i + 1, 0.5 + i % 3 / 10) for i in range(12)]
    edges = spark.createDataFrame(pairs, "a long, b long, w double").select("a", "b", weight("w").alias("weight"))
    assert vectors.communities(edges).count() == 13 and found.value == len(pairs)
