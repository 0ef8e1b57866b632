"""The tree of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblark.operators.storage import stored

DEEPEST = 64


def ancestors(collections: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(id, ancestor, distance), each node its own ancestor at distance 0. One join a level, each written once; the loop ends
    with the deepest node, or at ``deepest`` when parents form a circle."""
    edges = collections.select(F.col("id").alias("ancestor"), "parent_id")
    level = collections.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    out = level
    for _ in range(deepest - 1):
        level = stored(level.join(edges, "ancestor").where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("ancestor"), (F.col("distance") + 1).alias("distance")), "level")
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out


def subtree(collections: DataFrame, root: int) -> DataFrame:
    """Ids of a collection and all below it."""
    children = collections.select(F.col("parent_id").alias("id"), F.col("id").alias("child"))
    level = collections.where(F.col("id") == root).select("id")
    out = level
    for _ in range(DEEPEST - 1):
        level = stored(level.join(children, "id").select(F.col("child").alias("id")), "level")
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out


def subtree_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """(id, direct, total): memberships of a collection, and of its whole subtree."""
    direct = members.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("direct"))
    sums = ancestors(collections).join(direct, "id").groupBy(F.col("ancestor").alias("id")).agg(F.sum("direct").alias("total"))
    return collections.select("id").join(direct, "id", "left").join(sums, "id", "left").select("id", F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("total", F.lit(0)).alias("total"))


def paths(collections: DataFrame, name=lambda c: c) -> DataFrame:
    """(id, path, depth): names from the root down."""
    named = ancestors(collections).join(collections.select(F.col("id").alias("ancestor"), name(F.col("name")).alias("name")), "ancestor")
    parts = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name")))
    return named.groupBy("id").agg(F.array_join(F.transform(parts, lambda p: p["name"]), "/").alias("path"), F.max("distance").alias("depth"))


def may_move(collections: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (id, target) with allowed: a collection may not go below itself."""
    below = ancestors(collections).select(F.col("id").alias("target"), F.col("ancestor").alias("id"), F.lit(True).alias("_below"))
    return moves.join(below, ["id", "target"], "left").select("id", "target", F.col("_below").isNull().alias("allowed"))


def depth_first(collections: DataFrame) -> DataFrame:
    """(id, depth, position): the order in which the tree is shown, names without regard to case. Positions
    follow from subtree sizes, without one sort of all nodes."""
    up = ancestors(collections)
    size = up.groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("size"))
    siblings = Window.partitionBy("parent_id").orderBy(F.lower("name"), "id").rowsBetween(Window.unboundedPreceding, -1)
    before = collections.join(size, "id").select(F.col("id").alias("ancestor"), F.coalesce(F.sum("size").over(siblings), F.lit(0)).alias("before"))
    return up.join(before, "ancestor").groupBy("id").agg(F.max("distance").alias("depth"), (F.sum("before") + F.max("distance") + 1).alias("position"))


def delete_collection(collections: DataFrame, gone: int) -> DataFrame:
    """The tree without one collection, whose children rise to its parent."""
    parent = collections.where(F.col("id") == gone).select(F.col("id").alias("parent_id"), F.col("parent_id").alias("up"))
    moved = collections.where(F.col("id") != gone).join(parent, "parent_id", "left")
    return moved.select("id", "name", F.when(F.col("parent_id") == gone, F.col("up")).otherwise(F.col("parent_id")).alias("parent_id"))
