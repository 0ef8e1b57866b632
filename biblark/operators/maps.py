"""The map of a library: names of its communities, their halos, and where each node starts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.operators.folders import running

# The spread of a map, the angle between turns of its spiral, distances of rings and of notes beside papers.
LEAST_SPREAD, SPREAD = 180, 30
GOLDEN = math.pi * (3 - math.sqrt(5))
PLANE, JITTER = 2.2, 2.2
RING, NOTE_RING, BESIDE = 130, 170, 46


def labels(communities: DataFrame, titles: DataFrame, words: int = 3) -> DataFrame:
    """(community, size, label) of ``communities`` (id, community; below 0 is none): the distinctive words of their titles
    (id, title) with the greatest product of how many titles of the community hold them and how rare they are in all,
    ties in order of the words. A community without such words has an empty label."""
    members = communities.where("community >= 0").select("id", "community").distinct()
    said = titles.select("id", F.explode(T.title_words(F.col("title"))).alias("word")).distinct()
    total = titles.agg(F.count_distinct("id").alias("_n"))
    spread = said.groupBy("word").agg(F.count("*").alias("df"))
    counted = members.join(said, "id").groupBy("community", "word").agg(F.count("*").alias("tf")).join(spread, "word").join(F.broadcast(total))  # one row
    scored = counted.withColumn("_s", F.round(F.col("tf") * F.log(1 + F.col("_n") / F.col("df")), 6))
    best = Window.partitionBy("community").orderBy(F.desc("_s"), "word")
    first = scored.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= words)
    named = first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "word"))), lambda w: w["word"]), ", ").alias("label"))
    return members.groupBy("community").agg(F.count("*").alias("size")).join(named, "community", "left").select("community", "size", F.coalesce("label", F.lit("")).alias("label"))


def halos(places: DataFrame, communities: DataFrame, least: int = 3) -> DataFrame:
    """(community, n, x, y, radius): the middle of each community's ``places`` (id, x, y) and how far its farthest member is;
    communities below 0 and those of fewer than ``least`` places have none."""
    inside = places.join(communities.where("community >= 0"), "id").select("community", "x", "y")
    middle = inside.groupBy("community").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my")).where(F.col("n") >= least)
    far = inside.join(middle, "community").groupBy("community").agg(F.max(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))).alias("radius"))
    return middle.join(far, "community").select("community", "n", F.round("mx", 6).alias("x"), F.round("my", 6).alias("y"), F.round("radius", 6).alias("radius"))


def years(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(nodes, least_year, greatest_year) over the documents (id, year) that an edge (a, b) touches."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return docs.join(ends, "id", "left_semi").agg(F.count("*").alias("nodes"), F.min("year").alias("least_year"), F.max("year").alias("greatest_year"))


def circle(angle: Column, radius: Column | float) -> Column:
    radius = radius if isinstance(radius, Column) else F.lit(float(radius))
    return F.struct((radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def starts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, x, y, how): where each of ``nodes`` (id, kind, degree, sx, sy, px, py) starts. In this order: its saved place; for a
    note, beside the paper to which the strongest edge (a, b, weight; ties to the smaller id) leads, or on the outermost
    ring if that has no place; its place on the plane, moved a little by its id so that equal ones don't stack; on a
    spiral if it has edges, on a ring if it has none, both in order of id. Numbers along spiral and ring are running
    sums over blocks of ids."""
    size = nodes.agg(F.count("*").alias("_all"), F.count_if(F.col("degree") == 0).alias("_alone"))
    known = nodes.join(F.broadcast(size))  # one row
    spread = F.greatest(F.lit(float(LEAST_SPREAD)), SPREAD * F.sqrt("_all"))
    saved = F.col("sx").isNotNull() & F.col("sy").isNotNull()
    flat = (F.coalesce("px", F.lit(0.0)) != 0) | (F.coalesce("py", F.lit(0.0)) != 0)
    how = F.when(saved, "saved").when(F.col("kind") == "note", "note").when(flat, "plane").when(F.col("degree") > 0, "spiral").otherwise("ring")
    placed = running(known.withColumn("how", how), ["how"], "id", F.lit(1), "_i").withColumn("_i", F.col("_i") - 1)
    jitter = lambda n, half: ((F.col("id") % n) - half) * JITTER
    on_plane = F.struct((F.col("px") * spread * PLANE + jitter(13, 6)).alias("x"), (F.col("py") * spread * PLANE + jitter(7, 3)).alias("y"))
    on_spiral = circle(F.col("_i") * GOLDEN, spread * F.sqrt((F.col("_i") + 0.5) / F.greatest(F.lit(1), F.col("_all") - F.col("_alone"))))
    on_ring = circle(F.col("_i") / F.greatest(F.lit(1), F.col("_alone")) * (2 * math.pi) + 0.4, spread + RING)
    at = F.when(F.col("how") == "saved", F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"))).when(F.col("how") == "plane", on_plane).when(F.col("how") == "spiral", on_spiral).when(F.col("how") == "ring", on_ring)
    first = placed.select("id", "how", spread.alias("_spread"), at.alias("at"))
    notes = first.where("how = 'note'").select("id", "_spread")
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"), "weight"))
    strongest = both.where("id <> other").join(notes, "id", "left_semi").groupBy("id").agg(F.max_by("other", F.struct("weight", -F.col("other"))).alias("other"))
    anchors = strongest.join(first.where("at is not null").select(F.col("id").alias("other"), F.col("at").alias("_anchor")), "other").select("id", "_anchor")
    near = circle(F.radians((F.abs("id") * 61) % 360), BESIDE)
    outer = circle((F.abs("id") % 97) / 97 * (2 * math.pi), F.col("_spread") + NOTE_RING)
    beside = F.struct((F.col("_anchor.x") + near["x"]).alias("x"), (F.col("_anchor.y") + near["y"]).alias("y"))
    rest = notes.join(anchors, "id", "left").select("id", F.lit("note").alias("how"), F.when(F.col("_anchor").isNotNull(), beside).otherwise(outer).alias("at"))
    every = first.where("at is not null").select("id", "how", "at").unionByName(rest)
    return every.select("id", F.round("at.x", 6).alias("x"), F.round("at.y", 6).alias("y"), "how")
