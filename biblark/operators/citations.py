"""The citation graph: what a document cites, what cites it, what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblark.plans.library import Library


def owned(lib: Library) -> DataFrame:
    return lib.live.where("doi IS NOT NULL").select(F.lower("doi").alias("doi"), F.col("id").alias("cited_id"))


def outgoing(lib: Library) -> DataFrame:
    """(document_id, doi, cited_id): references of live documents; cited_id is null when the work is not owned."""
    refs = lib.references.select("document_id", F.lower("ref_doi").alias("doi")).distinct()
    refs = refs.join(lib.live.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return refs.join(owned(lib), "doi", "left").select("document_id", "doi", "cited_id")


def cited_by(lib: Library) -> DataFrame:
    """(cited_id, n): how many live documents cite each owned one."""
    return outgoing(lib).where("cited_id IS NOT NULL").groupBy("cited_id").agg(F.count_distinct("document_id").alias("n"))


def gaps(lib: Library, limit: int) -> DataFrame:
    """The works cited most that are not owned: (doi, n, sample)."""
    refs = lib.references.where("ref_doi IS NOT NULL").select("document_id", F.lower("ref_doi").alias("doi"), "raw").join(lib.live.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    # One row for each work and document first, so that works that many cite are summed before they meet.
    missing = refs.groupBy("doi", "document_id").agg(F.min("raw").alias("raw")).groupBy("doi").agg(F.count("*").alias("n"), F.min("raw").alias("sample"))
    return missing.join(owned(lib), "doi", "left_anti").orderBy(F.desc("n"), "doi").limit(limit)


def reading_path(lib: Library, document_id: int, missing: int = 5) -> DataFrame:
    """(leg, rank, id, doi): cited and owned works by year, then missing ones by how many cite them."""
    mine = outgoing(lib).where(F.col("document_id") == document_id)
    have = mine.where("cited_id IS NOT NULL").join(lib.live.select(F.col("id").alias("cited_id"), "year"), "cited_id")
    first = have.select(F.lit("owned").alias("leg"), F.coalesce("year", F.lit(9999)).cast("long").alias("rank"), F.col("cited_id").alias("id"), "doi")
    counts = lib.references.select("document_id", F.lower("ref_doi").alias("doi")).distinct().join(mine.where("cited_id IS NULL").select("doi"), "doi", "left_semi").groupBy("doi").agg(F.count("*").alias("n"))
    rest = counts.orderBy(F.desc("n"), "doi").limit(missing).select(F.lit("missing").alias("leg"), F.col("n").alias("rank"), F.lit(None).cast("long").alias("id"), "doi")
    return first.unionByName(rest)


#: The legs of a reading path, in order, with the reason that a step gives.
LEGS = {"foundation": "cited and in the library", "neighbour": "earlier and close in content", "missing": "cited, not in the library"}


def reading_paths(lib: Library, seeds: DataFrame, similar: DataFrame, nearest: int = 5, missing: int = 5) -> DataFrame:
    """(document_id, place, leg, reason, id, doi): what to read before each of ``seeds`` (id). First the works it cites that the
    library has, oldest first; then the ``nearest`` documents closest to it by ``similar`` (a, b, weight) among those of an
    earlier year that it doesn't cite; then the ``missing`` works it cites that the library lacks, by how many live
    documents cite them. Seeds without a year have no neighbours, works without one come last; ties by id or DOI."""
    live = lib.live.select("id", "year")
    mine = outgoing(lib).join(seeds.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_semi")
    dated = live.withColumnsRenamed({"id": "cited_id", "year": "_year"})
    have = mine.where("cited_id is not null and cited_id <> document_id").join(dated, "cited_id").groupBy("document_id", F.col("cited_id").alias("id")).agg(F.min("doi").alias("doi"), F.min("_year").alias("_year"))
    first = have.select("document_id", F.lit("foundation").alias("leg"), "id", "doi", F.coalesce("_year", F.lit(9999)).cast("double").alias("_by"))
    ends = similar.select(F.col("a").alias("document_id"), F.col("b").alias("id"), "weight").unionByName(similar.select(F.col("b").alias("document_id"), F.col("a").alias("id"), "weight"))
    asked = live.join(seeds.select("id").distinct(), "id", "left_semi").withColumnsRenamed({"id": "document_id", "year": "_mine"})
    early = ends.join(asked, "document_id").join(live, "id").where("year < _mine").join(have.select("document_id", "id"), ["document_id", "id"], "left_anti")
    close = early.groupBy("document_id", "id").agg(F.max("weight").alias("_w")).select("document_id", F.lit("neighbour").alias("leg"), "id", F.lit(None).cast("string").alias("doi"), (-F.col("_w")).cast("double").alias("_by"))
    lacking = mine.where("cited_id is null").select("document_id", "doi").distinct()
    counts = outgoing(lib).select("document_id", "doi").distinct().join(lacking.select("doi").distinct(), "doi", "left_semi").groupBy("doi").agg(F.count("*").alias("_n"))
    rest = lacking.join(counts, "doi").select("document_id", F.lit("missing").alias("leg"), F.lit(None).cast("long").alias("id"), "doi", (-F.col("_n")).cast("double").alias("_by"))
    own = Window.partitionBy("document_id", "leg").orderBy("_by", "id", "doi")
    steps = first.unionByName(close).unionByName(rest).withColumn("_k", F.row_number().over(own))
    steps = steps.where((F.col("leg") == "foundation") | ((F.col("leg") == "neighbour") & (F.col("_k") <= nearest)) | ((F.col("leg") == "missing") & (F.col("_k") <= missing)))
    order = F.array_position(F.array(*map(F.lit, LEGS)), F.col("leg"))
    reason = F.coalesce(*[F.when(F.col("leg") == leg, F.lit(why)) for leg, why in LEGS.items()])
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(order, "_k"))
    return steps.select("document_id", place.cast("long").alias("place"), "leg", reason.alias("reason"), "id", "doi")
