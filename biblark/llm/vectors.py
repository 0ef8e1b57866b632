"""Near-duplicate vectors through an inverted multi-index.

Method: k-means codebooks, one for each half of the vectors, form a product
grid of cells. Multi-sequence traversal visits cells in order of the summed
distances to both halves' centroids, as many as the target recall needs; what
is found is verified by cosine in double precision. Codebooks and the number
of cells to visit are fitted on a bounded sample (``SAMPLE`` vectors of least
hash); every vector is indexed and every vector is a query.

Each vector stands in its home cell and is sent to those visited cells that
come later than its home, so a pair is compared once at most. Only pairs with a
member at home are compared: the vectors at home in a cell are cut into tiles,
all its vectors into slices, both of at most about ``TILE`` rows, and each tile
meets each slice in a task of its own. Equal vectors are compared as one with a
multiplicity. A task returns a link count and a component root for each vector,
never pairs.

Defined results: a vector that is null, zero, of another length than most, or
that holds null or non-finite components links with nothing and is its own
component; repeated rows count as other vectors; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblark.llm.common import Forest, Scratch, connected_components, least_of_components, table

THRESHOLD = 0.9
RECALL = 0.995
SAMPLE = 8192
CELL_ROWS = 256
TILE = 4096
BLOCK = 512


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = distances(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        size = np.bincount(nearest, minlength=k)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


class MultiIndex:
    """Codebooks of both halves and the number of cells that a query visits."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, recall: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        k = int(np.clip(round((rows / CELL_ROWS) ** 0.5), 1, min(256, len(sample))))
        self.books = [kmeans(part, k, rng) for part in (sample[:, : self.half], sample[:, self.half :])]
        self.k = k
        # The hardest neighbours: at the threshold itself, in random directions.
        q = sample[:1024]
        noise = rng.normal(size=q.shape)
        noise -= (noise * q).sum(1, keepdims=True) * q
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        near = threshold * q + np.sqrt(max(0, 1 - threshold**2)) * noise
        du, dv = self.halves(q)
        nu, nv = self.halves(near)
        at = du[np.arange(len(q)), nu.argmin(1)] + dv[np.arange(len(q)), nv.argmin(1)]
        rank = np.array([((u[:, None] + v[None, :]) < s).sum() for u, v, s in zip(du, dv, at)])
        self.visits = min(k * k, int(np.quantile(rank, recall)) + 1)
        i, j = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
        inside = (i + 1) * (j + 1) <= self.visits
        self.steps = i[inside], j[inside]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home cell and the visited cells, nearest first. In order of both halves' ranks, the
        n-th nearest cell has (rank + 1) * (rank + 1) <= n, so only those sums are formed."""
        du, dv = self.halves(x)
        ou, ov = du.argsort(1), dv.argsort(1)
        su, sv = np.take_along_axis(du, ou, 1), np.take_along_axis(dv, ov, 1)
        i, j = self.steps
        sums = su[:, i] + sv[:, j]
        best = np.argsort(sums, axis=1, kind="stable")[:, : self.visits]
        cells = np.take_along_axis(ou, i[best], 1) * self.k + np.take_along_axis(ov, j[best], 1)
        return ou[:, 0] * self.k + ov[:, 0], cells


def links_in_task(home: np.ndarray, home_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, at_home: np.ndarray, times: np.ndarray, home_times: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at home against a slice of their cell: the links (with multiplicity) of each row, those at home first,
    and its component's root. Two vectors at home are compared where the first has the smaller id."""
    size = len(home)
    n = np.zeros(size + len(x), dtype=np.int64)
    forest = Forest(size + len(x))
    for i in range(0, size, BLOCK):
        a = slice(i, i + BLOCK)
        for j in range(0, len(x), BLOCK):
            b = slice(j, j + BLOCK)
            near = (home[a] @ x[b].T >= threshold) & (~at_home[None, b] | (home_ids[a, None] < ids[None, b]))
            if near.any():
                n[i : i + near.shape[0]] += near @ times[b]
                n[size + j : size + j + near.shape[1]] += near.T @ home_times[a]
                r, c = np.nonzero(near)
                forest.join(r + i, c + size + j)
    return n, forest.root


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding)."""
    scratch = Scratch(spark, "vectors")
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    common = rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    width = common[0]["d"] if common else 1
    usable = F.coalesce((F.size(e) == width) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    keyed = rows.withColumn("k1", F.when(usable, F.xxhash64("embedding"))).withColumn("k2", F.when(usable, F.hash("embedding")))
    distinct = keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.first("embedding").alias("embedding"))
    distinct = scratch.keep(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    total = distinct.count()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    drawn = distinct.select("k1", "k2", "embedding").orderBy(F.xxhash64("k1", F.lit(1)), "k1", "k2").limit(sample).toPandas()
    index = MultiIndex(unit(drawn["embedding"]), total, threshold, recall)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.iloc[k : k + 1024]
                home, cells = index.cells(unit(part["embedding"]))
                yield part.assign(home=home, cells=[[h, *c[c > h].tolist()] for h, c in zip(home.tolist(), cells)])

    kind = dict(distinct.dtypes)["embedding"]
    coded = distinct.select("node", "times", "embedding").mapInPandas(assign, f"node long, times long, embedding {kind}, home int, cells array<int>")
    coded = scratch.keep(coded, "coded")
    placed = coded.select("node", F.explode("cells").alias("cell"), (F.col("home") == F.col("cell")).alias("at_home"))
    pieces = lambda c: F.ceil(c / TILE).cast("long")
    sizes = placed.groupBy("cell").agg(pieces(F.count("*")).alias("slices"), pieces(F.sum(F.col("at_home").cast("long"))).alias("tiles")).where("tiles > 0")
    cells = coded.select("node", "times", "embedding", "home", F.explode("cells").alias("cell")).join(sizes, "cell").withColumn("at_home", F.col("home") == F.col("cell"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), c - 1)
    own = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), c)
    # Where each row stands: as a member of its slice beside every tile, and if at home as a member of its tile beside every slice.
    member = F.transform(upto(F.col("tiles")), lambda t: F.struct(F.lit(False).alias("leads"), t.alias("tile"), own(F.col("slices"), 1).alias("slice")))
    leader = F.transform(upto(F.col("slices")), lambda s: F.struct(F.lit(True).alias("leads"), own(F.col("tiles"), 2).alias("tile"), s.alias("slice")))
    tiled = cells.withColumn("at", F.explode(F.concat(member, F.when(F.col("at_home"), leader).otherwise(F.array().cast("array<struct<leads:boolean,tile:bigint,slice:bigint>>")))))
    tiled = tiled.select("cell", "at.tile", "at.slice", "at.leads", "at_home", "node", "times", "embedding")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        leads = group["leads"].to_numpy(dtype=bool)
        if not leads.any() or leads.all():
            return pd.DataFrame({"node": [], "n": [], "root": []}).astype("int64")
        x, ids, times, at_home = unit(group["embedding"]), group["node"].to_numpy(), group["times"].to_numpy(), group["at_home"].to_numpy(dtype=bool)
        n, root = links_in_task(x[leads], ids[leads], x[~leads], ids[~leads], at_home[~leads], times[~leads], times[leads], threshold)
        both, has = np.r_[ids[leads], ids[~leads]], n > 0
        return pd.DataFrame({"node": both[has], "n": n[has], "root": both[root[has]]})

    found = scratch.keep(tiled.groupBy("cell", "tile", "slice").applyInPandas(compare, "node long, n long, root long"), "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    classes = least_of_components(distinct.select("node", "k1", "k2", "least", "times").join(counts, "node", "left"), roots)
    classes = classes.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    scratch.drop(coded)
    out = keyed.drop("embedding").join(classes, ["k1", "k2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))
