"""Vectors: cosine, nearest neighbours, centroids, graphs, two-dimensional maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblark.operators import retrieval
from biblark.operators.folders import running
from biblark.operators.neighbours import neighbours
from biblark.operators.storage import stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths, empty ones and zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, key: str, column: str, query: list[float], k: int) -> DataFrame:
    """(key, distance) of the k nearest by cosine distance: one scan, k rows from each task."""
    q = F.array(*[F.lit(float(v)) for v in query])
    return vectors.select(key, F.round(1 - cosine(F.col(column), q), 6).alias("distance")).orderBy("distance", key).limit(k)


def similarity_edges(vectors: DataFrame, key: str, column: str, k: int = 4, floor: float = 0.55, exact: bool = True) -> DataFrame:
    """Undirected edges (a, b, weight), kept if either end chose the other."""
    n = neighbours(vectors, key, column, k, floor, exact=exact)
    return n.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight"))


def subtree_edges(vectors: DataFrame, key: str, column: str, members: DataFrame, collections: DataFrame, k: int = 4, floor: float = 0.55, exact: bool = True) -> DataFrame:
    """The similarity graph of the documents in ``collections`` (id), such as a collection and all below it, with neighbours
    sought among them only. ``members``: collection_id, document_id."""
    inside = members.join(collections.select(F.col("id").alias("collection_id")), "collection_id", "left_semi").select(F.col("document_id").alias(key)).distinct()
    return similarity_edges(vectors.join(inside, key, "left_semi"), key, column, k, floor, exact)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))


def communities(edges: DataFrame, rounds: int = 20, least: int = 3) -> DataFrame:
    """(id, community) by weighted label propagation, ties to the smallest label; small ones are -1 and the
    others numbered by size, then by smallest member. Labels that still move after ``rounds`` count as they are.
    Edges and labels are stored, so that no round finds the edges again."""
    edges = stored(edges.select("a", "b", "weight"), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    labels = stored(both.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a", "label").agg(F.round(F.sum("weight"), 6).alias("w"))
        new = stored(votes.groupBy(F.col("a").alias("id")).agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label")), "labels")
        moved = new.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            break
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= least)
    # Numbers start behind all larger communities; as many rows meet in one window as there are different sizes.
    larger = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    behind = sizes.groupBy("n").agg(F.count("*").alias("_c")).select("n", F.coalesce(F.sum("_c").over(larger), F.lit(0)).alias("_behind"))
    order = running(sizes, ["n"], "first", F.lit(1), "_i").join(behind, "n").withColumn("community", (F.col("_behind") + F.col("_i") - 1).cast("int"))
    return labels.join(order.select("label", "community"), "label", "left").select("id", F.coalesce("community", F.lit(-1)).alias("community"))


def centroids(vectors: DataFrame, group: str, column: str) -> DataFrame:
    """(group, centroid): means by position, summed before the shuffle."""
    by_place = vectors.select(group, F.posexplode(column).alias("i", "v")).groupBy(group, "i").agg(F.avg("v").alias("v"))
    return by_place.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid"))


def suggestions(vectors: DataFrame, key: str, column: str, group: str, limit: int) -> DataFrame:
    """(group, key, score): vectors outside a group that are nearest to its centroid. There are as many
    centroids as groups, joined by broadcast only below the threshold that Spark checks."""
    scored = vectors.select(F.col(key), F.col(column).alias("_v"), F.col(group).alias("_own")).join(centroids(vectors, group, column), F.col("_own") != F.col(group))
    scored = scored.select(group, key, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("_v"), F.col("centroid")))), 6).alias("score"))
    best = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= limit).drop("_n")


def principal_plane(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, x, y) on the two first principal axes, scaled to [-1, 1]; fewer than three rows are all zeros. The
    covariance is summed on the executors; its size is the square of the dimension."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.where(F.size(column) > 0).select(key, array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    if rows.limit(3).count() < 3:
        return rows.select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    flat = PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).select(key, vector_to_array("p").alias("p"))
    flat = flat.select(key, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    middle = flat.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    moved = flat.join(F.broadcast(middle)).select(key, (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))  # one row
    top = moved.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("top"))
    scale = lambda c: F.when(F.col("top") > 0, F.col(c) / F.col("top")).otherwise(0.0).alias(c)
    return moved.join(F.broadcast(top)).select(key, scale("x"), scale("y"))


def scaled(v: Column) -> Column:
    """``v`` at length one; null for zero and empty vectors."""
    length = F.sqrt(dot(v, v))
    return F.when((F.size(v) > 0) & (length > 0), F.transform(v, lambda x: x.cast("double") / length))


def name_vectors(postings: DataFrame, names: DataFrame, vectors: DataFrame) -> DataFrame:
    """(group, centroid): a vector for each of ``names`` (group, name) without a model, the mean of the ``vectors`` (id, v) of the
    texts that hold all its words. ``postings``: id, term. A name that no text holds whole has none."""
    words = names.select("group", F.array_distinct(retrieval.terms(F.col("name"))).alias("_t")).where("size(_t) > 0")
    asked = words.select("group", F.size("_t").alias("_n"), F.explode("_t").alias("term"))
    hits = asked.join(postings.select("id", "term").distinct(), "term").groupBy("group", "_n", "id").agg(F.count("*").alias("_k")).where("_k = _n")
    return centroids(hits.join(vectors, "id").select("group", "v"), "group", "v")


def mixed(content: DataFrame | None, names: DataFrame | None, weight: float = 0.5) -> DataFrame:
    """(group, q): what a group is about, from its members' centroid (group, centroid), its name's, or both with ``weight`` on
    the content. Scaled first, so the product of a scaled vector with q is the weighted mean of both cosines. A group
    that lacks one of two asked for has none: no mode turns into another."""
    parts = [d.select("group", scaled(F.col("centroid")).alias(f"_{i}")).where(f"_{i} is not null") for i, d in enumerate((content, names)) if d is not None]
    if len(parts) == 1:
        return parts[0].toDF("group", "q")
    return parts[0].join(parts[1], "group").where("size(_0) = size(_1)").select("group", F.zip_with("_0", "_1", lambda a, b: weight * a + (1 - weight) * b).alias("q"))


def suggested(vectors: DataFrame, members: DataFrame, about: DataFrame, limit: int, only_unfiled: bool = False) -> DataFrame:
    """(group, id, score): for each group of ``about`` (group, q) the ``limit`` best of the ``vectors`` (id, v) outside it, or outside all
    groups (``members``: group, id). Null, zero and empty vectors are never suggested. The score is the product of the scaled vector with q, held to 0 to 1. Vectors outside
    all groups are sought by that score among all of them; otherwise each group meets the vectors, and its
    members are taken away before the best are chosen."""
    asked = about.select("group", "q")
    if only_unfiled:
        open_ = vectors.join(members.select("id").distinct(), "id", "left_anti").where(scaled(F.col("v")).isNotNull())
        near = neighbours(open_.select("id", "v"), "id", "v", limit, queries=asked.select(F.col("group").alias("id"), F.col("q").alias("v")), with_self=True, product=True)
        return near.select(F.col("src").alias("group"), F.col("dst").alias("id"), F.col("weight").alias("score"))
    # Every part of the vectors meets a copy of the groups.
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = vectors.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    copies = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = dealt.join(copies, "_part").where(F.size("v") == F.size("q")).drop("_part").join(members.select("group", "id").distinct(), ["group", "id"], "left_anti")
    product = pairs.select("group", "id", dot(scaled(F.col("v")), F.col("q")).alias("_p")).where("_p is not null")
    scored = product.select("group", "id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_p"))), 6).alias("score"))
    best = Window.partitionBy("group").orderBy(F.desc("score"), "id")
    return scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= limit).drop("_n")


def by_meaning(hits: DataFrame, members: DataFrame, vectors: DataFrame, floor: float, least: int = 3) -> DataFrame:
    """``hits`` (group, v, ...) that come close to their group: the cosine with the centroid of its ``members`` (group, id) that have
    ``vectors`` (id, v) is ``floor`` or more. Groups of fewer than ``least`` such members let everything pass."""
    inside = members.select("group", "id").distinct().join(vectors, "id").select("group", "v")
    full = inside.groupBy("group").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("group")
    centre = centroids(inside.join(full, "group", "left_semi"), "group", "v")
    return hits.join(centre, "group", "left").where(F.col("centroid").isNull() | (cosine(F.col("v"), F.col("centroid")) >= floor)).drop("centroid")
