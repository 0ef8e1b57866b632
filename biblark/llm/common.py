"""What the operators of this subpackage share: reading tables, shared scratch space, graph components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. It is read from ``spark.checkpoint.dir``;
    only where that is unset (tests, one machine) a temporary one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            folder = own.get()
        else:
            folder = f"file://{tempfile.mkdtemp(prefix='biblark-')}"
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and a lost executor loses nothing.

    ``keep`` writes a table and reads it back; ``drop`` deletes tables that no
    result reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._biblark_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.drop_path(df._biblark_path)

    def drop_path(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, bigint, either order, repeats allowed).

    Rounds of contraction: every node moves to the neighbour of least hash (or
    stays, if that is itself), edges follow, loops and repeats go. Hashing makes
    the order random, so chains as well as stars shrink by a constant share a
    round. Only the number of remaining edges comes to the driver. Nodes with a
    very large number of edges are summed before the shuffle and joined by
    joins that adaptive execution can split.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    current = first = scratch.keep(edges, "edges")
    moves: list[DataFrame] = []
    while current.limit(1).count():
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        move = least.where(F.col("m") < rank("a")).select(F.col("a").alias("node"), F.col("m.n").alias("to"))
        moves.append(scratch.keep(move, "move"))
        step = current
        for c in ("a", "b"):
            to = moves[-1].select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))
            step = step.join(to, c, "left").withColumn(c, F.coalesce(f"to_{c}", c)).drop(f"to_{c}")
        step = step.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        before, current = current, scratch.keep(step, "edges")
        if before is not first:
            scratch.drop(before)
    nodes = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct()
    roots = nodes.withColumn("root", F.col("node"))
    follow = lambda df, m: df.join(m.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return scratch.keep(reduce(follow, moves, roots), "components")


def least_of_components(nodes: DataFrame, roots: DataFrame, salts: int = 16) -> DataFrame:
    """``nodes`` (node, least and others) with component_id, the smallest ``least`` of the node's component; ``roots``
    is that of connected_components. Nodes without links are components of their own and not shuffled by root;
    the others meet their root's row in ``salts`` parts, so that one large component is no task of its own."""
    rooted = nodes.join(roots, "node", "left")
    linked = rooted.where("root is not null").withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts)))))
    single = rooted.where("root is null").withColumn("component_id", F.col("least")).withColumn("root", F.col("node"))
    return linked.join(least, ["root", "_salt"]).drop("_salt").unionByName(single)


class Forest:
    """Components within one task: ``join`` takes arrays of linked positions."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
