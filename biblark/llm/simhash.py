"""Near-duplicate documents by 64-bit SimHash, compared exactly.

Method: tiled exact comparison with numpy exclusive-or and bit counts. Of two
fingerprints at most ``radius`` bits apart, at least ``blocks - radius`` of
their blocks are equal, so the pairs to compare meet in buckets keyed by each
choice of that many blocks; no pair within the radius is lost. Distinct
fingerprints only are compared. A bucket of more than ``TILE`` fingerprints is
laid out in order of population count and cut into tiles; only pairs of tiles
whose population counts come within the radius make a task, and inside a task
sub-tiles are skipped the same way. A task returns a spanning forest of its
links, so a large group of near copies gives rows in proportion to its size.

Defined results: texts without words (null, empty, white space) have
fingerprint zero and link like any other; repeated rows stay; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblark.llm.common import Forest, Scratch, connected_components, fresh, least_of_components, table

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
TILE = 2048
SUBTILE = 256


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned; bytes.lower and bytes.split touch A-Z and the six ASCII white-space bytes only."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    begin, end = starts[: len(words) - shingle + 1].tolist(), (starts[shingle:] - 1).tolist()
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(begin), 32768):
        hashes = np.array([xxh64_intdigest(joined[i:j], seed) for i, j in zip(begin[k : k + 32768], end[k : k + 32768])], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * total > len(begin)).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns to carry: the fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), *carry, of(F.col("text")).alias("fp"))


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links_in_tile(fp: np.ndarray, side: np.ndarray, radius: int, subtile: int = SUBTILE) -> np.ndarray:
    """For each fingerprint the first member of its component in this task. ``side``: 0 all against all,
    1 against 2 where two tiles meet."""
    weight = np.bitwise_count(fp)
    order = np.argsort(weight, kind="stable")
    fp, side, weight = fp[order], side[order], weight[order]
    forest = Forest(len(fp))
    starts = range(0, len(fp), subtile)
    for i in starts:
        for j in range(i, len(fp), subtile):
            top = min(i + subtile, len(fp)) - 1
            if int(weight[j]) - int(weight[top]) > radius:
                break
            near = np.bitwise_count(fp[i : i + subtile, None] ^ fp[None, j : j + subtile]) <= radius
            near &= (side[i : i + subtile, None] == 0) | (side[i : i + subtile, None] != side[None, j : j + subtile])
            a, b = np.nonzero(near)
            forest.join(a + i, b + j)
    root = np.empty(len(fp), dtype=np.int64)
    root[order] = order[forest.root]
    return root


def links_in_small(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked positions where rows of equal keys stand together in many short runs."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(1, len(key)):
        same = np.flatnonzero(key[d:] == key[:-d])
        if not len(same):
            break
        near = same[np.bitwise_count(fp[same] ^ fp[same + d]) <= radius]
        found.append((near, near + d))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2


def near_links(spark: SparkSession, fps: DataFrame, scratch: Scratch, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect what is linked; ``fps`` has distinct fingerprints in column fp."""
    masks = block_masks(blocks, radius)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])).alias("k")).select("fp", F.col("k.c").alias("c"), F.col("k.v").alias("v"))
    sizes = keyed.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1")
    rows = scratch.keep(keyed.join(sizes, ["c", "v"]).withColumn("pop", F.bit_count("fp")), "buckets")

    # Large buckets: places in order of population count, tiles of them, and the tiles that each row must meet.
    pops = rows.where(F.col("n") > tile).groupBy("c", "v", "pop").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("c", "v").orderBy("pop")
    pops = pops.withColumn("first", F.sum("m").over(upto) - F.col("m"))
    reach = upto.rangeBetween(-radius, radius)
    pops = pops.withColumn("lo", F.min("first").over(reach)).withColumn("hi", F.max(F.col("first") + F.col("m")).over(reach) - 1)
    large = rows.where(F.col("n") > tile).join(pops, ["c", "v", "pop"])
    own = F.floor((F.col("first") + F.pmod(F.xxhash64("fp"), F.col("m"))) / tile)
    large = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.floor(F.col("lo") / tile), F.floor(F.col("hi") / tile))))
    large = large.select("c", "v", F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"), "own", "fp")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy().view(np.uint64)
        ta, tb = int(group["ta"].iloc[0]), int(group["tb"].iloc[0])
        side = np.zeros(len(fp), dtype=np.int8) if ta == tb else np.where(group["own"].to_numpy() == ta, 1, 2).astype(np.int8)
        root = links_in_tile(fp, side, radius)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[moved].view(np.int64), "b": fp[root[moved]].view(np.int64)})

    def compare_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        done = object()
        while True:
            batch = next(batches, done)
            rows = rest if batch is done else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rows is not None and len(rows):
                key = rows["c"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rows["v"].to_numpy().view(np.uint64)
                cut = len(key) if batch is done else int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
                fp = rows["fp"].to_numpy().view(np.uint64)
                run = np.cumsum(np.r_[0, (rows["c"].to_numpy()[1:] != rows["c"].to_numpy()[:-1]) | (rows["v"].to_numpy()[1:] != rows["v"].to_numpy()[:-1])])
                yield pd.DataFrame(_runs(run[:cut], fp[:cut], radius))
                rest = rows.iloc[cut:]
            if batch is done:
                return

    small = rows.where(F.col("n") <= tile).select("c", "v", "fp").repartition("c", "v").sortWithinPartitions("c", "v", "fp")
    edges = small.mapInPandas(compare_runs, "a long, b long").unionByName(large.groupBy("c", "v", "ta", "tb").applyInPandas(compare, "a long, b long"))
    return scratch.keep(edges.distinct(), "links")


def _runs(run: np.ndarray, fp: np.ndarray, radius: int, short: int = 24) -> dict[str, np.ndarray]:
    """Edges of sorted runs of equal keys: short runs all at once, longer ones by tiles."""
    if not len(run):
        return {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}
    size = np.bincount(run - run[0])
    is_short = (size <= short)[run - run[0]]
    a, b = links_in_small(run[is_short], fp[is_short], radius)
    ea, eb = [fp[is_short][a]], [fp[is_short][b]]
    for r in np.flatnonzero(size > short):
        lo = int(np.searchsorted(run, r + run[0]))
        part = fp[lo : lo + size[r]]
        root = links_in_tile(part, np.zeros(len(part), np.int8), radius)
        moved = np.flatnonzero(root != np.arange(len(part)))
        ea.append(part[moved])
        eb.append(part[root[moved]])
    return {"a": np.concatenate(ea).view(np.int64), "b": np.concatenate(eb).view(np.int64)}


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, root, component_id) and the columns to carry per row; component_id is the smallest
    doc_id that links reach, root a fingerprint that names the component."""
    scratch = Scratch(spark, "simhash")
    marks = scratch.keep(fingerprints(docs, shingle, carry=carry), "fingerprints")
    distinct = scratch.keep(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = near_links(spark, distinct, scratch, radius)
    roots = connected_components(links, scratch)
    classes = least_of_components(distinct.withColumnRenamed("fp", "node"), roots).select(F.col("node").alias("fp"), "root", "component_id")
    return marks.join(classes, "fp")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, of equal ids that of the least
    text hash, of equal rows any one."""
    h, i, j = (fresh(docs, n) for n in ("_text_hash", "_first_id", "_first_hash"))
    hashed = docs.withColumn(h, F.xxhash64("text"))
    found = near_duplicates(spark, hashed.select("doc_id", "text", F.col(h).alias("_text_hash")), carry=("_text_hash",))
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id").agg(F.min("_text_hash").alias("_text_hash"))
    first = first.select(F.col("doc_id").alias(i), F.col("_text_hash").alias(j)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(j))
    return hashed.join(first, same, "left_semi").dropDuplicates(["doc_id", h]).select(*docs.columns)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
