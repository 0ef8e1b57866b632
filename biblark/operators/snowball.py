"""Snowball search: from known works along references and citing works, hop by hop, as a tree of discoveries.

Each work's neighbours are ranked once: its ``most`` most cited references and its ``most`` most cited citing works, ties by id.
A hop is one join of the frontier of all seeds with that table, whatever the number of seeds. A work hangs under the
first parent that finds it: hops before hops, then the parents' own order, references before citing works, then rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.operators.storage import stored

REFERENCE, CITING = "reference", "citing"
TREE = "seed long, hop int, place long, id long, parent long, direction string"


def ranked_links(works: DataFrame, citations: DataFrame, most: int = 50) -> DataFrame:
    """(work, id, direction, rank): ``works``: id, citations (how often it is cited, null as 0); ``citations``: a cites b.
    Works without an id, and ends that are no known work, are left out."""
    known = works.where("id is not null").select("id", F.coalesce("citations", F.lit(0)).alias("c"))
    ties = citations.where("a <> b").select("a", "b").distinct()
    sides = ties.select(F.col("a").alias("work"), F.col("b").alias("id"), F.lit(REFERENCE).alias("direction")).unionByName(ties.select(F.col("b").alias("work"), F.col("a").alias("id"), F.lit(CITING).alias("direction")))
    best = Window.partitionBy("work", "direction").orderBy(F.desc("c"), "id")
    return sides.join(known, "id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("work", "id", "direction", "rank")


def snowball(works: DataFrame, citations: DataFrame, seeds: DataFrame, depth: int = 3, most: int = 50) -> DataFrame:
    """(seed, hop, place, id, parent, direction) of every seed (``seeds``: id), the seeds themselves at hop 0 without a parent.
    ``place`` is the order of discovery within a seed and hop, from 1."""
    links = stored(ranked_links(works, citations, most), "links")
    start = seeds.where("id is not null").select(F.col("id").alias("seed")).distinct()
    hop = stored(start.select("seed", F.lit(0).alias("hop"), F.lit(1).cast("long").alias("place"), F.col("seed").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("direction")), "hop")
    tree = hop
    first = Window.partitionBy("seed", "id").orderBy("_place", F.col("direction") != REFERENCE, "rank")
    order = Window.partitionBy("seed").orderBy("_place", F.col("direction") != REFERENCE, "rank")
    for k in range(1, depth + 1):
        frontier = hop.select("seed", F.col("place").alias("_place"), F.col("id").alias("work"))
        found = frontier.join(links, "work").join(tree.select("seed", "id"), ["seed", "id"], "left_anti")
        found = found.withColumn("_n", F.row_number().over(first)).where("_n = 1")
        hop = stored(found.select("seed", F.lit(k).alias("hop"), F.row_number().over(order).cast("long").alias("place"), "id", F.col("work").alias("parent"), "direction"), "hop")
        if not hop.limit(1).count():
            break
        tree = tree.unionByName(hop)
    return tree


def without_subtrees(tree: DataFrame, dropped: DataFrame) -> DataFrame:
    """``tree`` without the works in ``dropped`` (seed, id) and all that hangs below them; a join a hop."""
    deepest = tree.agg(F.max("hop")).first()[0] or 0
    gone = stored(dropped.select("seed", "id").distinct(), "gone")
    out = tree.join(gone, ["seed", "id"], "left_anti")
    cut = gone
    for k in range(1, deepest + 1):
        below = tree.where(F.col("hop") == k).join(cut.select("seed", F.col("id").alias("parent")), ["seed", "parent"], "left_semi").select("seed", "id")
        cut = stored(cut.unionByName(below).distinct(), "gone")
    return out.join(cut, ["seed", "id"], "left_anti").select(*tree.columns)


def seeds_by_title(titles: DataFrame, works: DataFrame) -> DataFrame:
    """(name, id): each of ``titles`` (name, title) with the first work of the same title, by the strict rule that titles_match
    has; names without one are left out rather than led to another paper. One equality join."""
    words = T.title_words(F.col("title"))
    key = F.when(F.size(words) >= 3, F.concat(F.lit("w "), F.array_join(F.array_sort(words), " "))).when(T.plain_title(F.col("title")) != "", F.concat(F.lit("t "), T.plain_title(F.col("title"))))
    known = works.select(key.alias("_k"), "id").where("_k is not null and id is not null").groupBy("_k").agg(F.min("id").alias("id"))
    return titles.select("name", key.alias("_k")).join(known, "_k").select("name", "id")
