"""Which records are the same work: imports, duplicates, merges, metadata candidates, writes.

Tables are immutable files, so a write is a new version of a table: every
function returns the table as it is afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.operators.storage import checkpointed


def existing(docs: DataFrame, arriving: DataFrame) -> DataFrame:
    """``arriving`` (path, file_hash) with the id of a holder of the same path, else of the same content."""
    by_path = docs.groupBy("path").agg(F.min("id").alias("path_id"))
    by_hash = docs.where("file_hash is not null").groupBy("file_hash").agg(F.min("id").alias("hash_id"))
    return arriving.join(by_path, "path", "left").join(by_hash, "file_hash", "left").withColumn("existing_id", F.coalesce("path_id", "hash_id")).drop("path_id", "hash_id")


def import_decisions(docs: DataFrame, arriving: DataFrame, passive: bool = False) -> DataFrame:
    """(path, file_hash, decision, id): new, duplicate or restore. A trashed document of the same path is restored,
    whatever else holds the content; one of the same content only if no live document has the path or the content.
    A passive import restores nothing. Otherwise whoever holds the path, then the content, makes a duplicate. Of
    arriving files with equal content the first path counts, the rest are duplicates."""
    live, gone = F.col("deleted_at").isNull(), F.col("deleted_at").isNotNull()
    sides = lambda key, name: docs.groupBy(key).agg(F.min("id").alias(f"any_{name}"), F.min(F.when(live, F.col("id"))).alias(f"live_{name}"), F.min(F.when(gone, F.col("id"))).alias(f"gone_{name}"))
    out = arriving.join(sides("path", "path"), "path", "left").join(sides("file_hash", "hash"), "file_hash", "left")
    out = out.join(arriving.groupBy("file_hash").agg(F.min("path").alias("first_path")), "file_hash", "left")
    held = F.coalesce("live_path", "live_hash")
    restored = F.when(F.lit(passive), None).when(F.col("gone_path").isNotNull(), F.col("gone_path")).when(held.isNull(), F.col("gone_hash"))
    existing_id = F.coalesce("any_path", "any_hash")
    decision = F.when(restored.isNotNull(), "restore").when(existing_id.isNotNull(), "duplicate").when(F.col("path") == F.col("first_path"), "new").otherwise("duplicate")
    return out.select("path", "file_hash", decision.alias("decision"), F.coalesce(restored, existing_id).alias("id"))


def duplicate_links(docs: DataFrame) -> DataFrame:
    """(a, b): every document and the first one that shares its content, its DOI or its title (three
    distinctive words or more). One row a document and criterion, however large a group is."""
    parts = []
    words = T.title_words(F.col("title"))
    for key in (F.col("file_hash"), F.lower("doi"), F.when(F.size(words) >= 3, T.plain_title(F.col("title")))):
        keyed = docs.select("id", key.alias("k")).where("k is not null")
        first = keyed.groupBy("k").agg(F.min("id").alias("a"))
        parts.append(keyed.join(first, "k").where("id <> a").select("a", F.col("id").alias("b")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, group): the smallest id that links reach. Labels fall to the least of the neighbours' and are then
    followed to the label's own label, so that chains halve; lineage is cut by reliable checkpoints."""
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("group")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "group"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group").alias("near"))
        low = labels.join(near, "id").select("id", F.least("group", "near").alias("group"), F.col("group").alias("old"))
        jump = low.select(F.col("id").alias("group"), F.col("group").alias("up"))
        new = checkpointed(low.join(jump, "group", "left").select("id", F.coalesce("up", "group").alias("group"), "old"))
        moved = new.where("group <> old").limit(1).count()
        labels = new.select("id", "group")
        if not moved:
            return labels
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """(id, group) of live documents that have a duplicate."""
    return components(duplicate_links(docs.where("deleted_at is null")))


def merged(docs: DataFrame, bridges: dict[str, DataFrame], groups: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Documents and bridges (document_id, ...) after every group went into its smallest id: the others are
    put in the trash, and what hung on them hangs on the master, each link once."""
    others = groups.where("id <> group").select(F.col("id").alias("_id"), F.col("group").alias("_master"))
    left = docs.join(others, F.col("id") == F.col("_id"), "left").withColumn("deleted_at", F.when(F.col("_master").isNotNull() & F.col("deleted_at").isNull(), F.current_timestamp().cast(docs.schema["deleted_at"].dataType)).otherwise(F.col("deleted_at"))).select(*docs.columns)
    moved = lambda b: b.join(others, F.col("document_id") == F.col("_id"), "left").withColumn("document_id", F.coalesce("_master", "document_id")).select(*b.columns).distinct()
    return left, {name: moved(b) for name, b in bridges.items()}


def purged(docs: DataFrame, bridges: dict[str, DataFrame], ids: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Documents and bridges without the trashed documents named in ``ids`` (id)."""
    gone = docs.where("deleted_at is not null").join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("document_id"))
    left = docs.join(gone, docs["id"] == gone["document_id"], "left_anti")
    return left, {name: b.join(gone, "document_id", "left_anti") for name, b in bridges.items()}


def doi_owners(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """``docs`` after ``claims`` (id, doi): a live holder keeps its DOI and the claim is dropped; a trashed holder
    loses it to the claim; of several claims for one DOI the smallest id wins."""
    wanted = claims.select("id", F.lower("doi").alias("_doi")).where("_doi is not null").groupBy("_doi").agg(F.min("id").alias("_by"))
    holders = docs.where("doi is not null and deleted_at is null").select(F.lower("doi").alias("_doi"), F.col("id").alias("_holder"))
    granted = wanted.join(holders, "_doi", "left").where("_holder is null or _holder = _by").select("_doi", "_by")
    given = docs.join(granted.select(F.col("_by").alias("id"), F.col("_doi").alias("_new")), "id", "left").join(granted.select(F.col("_doi").alias("_held"), F.col("_by").alias("_taker")), F.lower("doi") == F.col("_held"), "left")
    lost = F.col("deleted_at").isNotNull() & F.col("_taker").isNotNull() & (F.col("_taker") != F.col("id"))
    return given.withColumn("doi", F.coalesce("_new", F.when(~lost, F.col("doi")))).select(*docs.columns)


def authors_with(authors: DataFrame, names: DataFrame) -> DataFrame:
    """``authors`` (id, given, family) with new ids for ``names`` (given, family) that are not there yet, null-safe."""
    wanted = names.select("given", "family").distinct().alias("w")
    have = authors.alias("h")
    new = wanted.join(have, F.col("w.given").eqNullSafe(F.col("h.given")) & F.col("w.family").eqNullSafe(F.col("h.family")), "left_anti")
    top = authors.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    # New names of one import are few; their numbers need one order.
    numbered = new.withColumn("_n", F.row_number().over(Window.orderBy(F.col("family").asc_nulls_first(), F.col("given").asc_nulls_first())))
    return authors.unionByName(numbered.join(F.broadcast(top)).select((F.col("_top") + F.col("_n")).cast("long").alias("id"), "given", "family"))


def resolved(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The candidate that each document takes. ``found`` (id, source, rank, title, doi): its title must match
    the document's; sources are asked in the order doi, title, arxiv, openalex, s2; ties go by rank, then doi."""
    order = F.array(*map(F.lit, ("doi", "title", "arxiv", "openalex", "s2")))
    both = found.withColumnRenamed("title", "found_title").join(docs.select("id", "title"), "id")
    good = both.where((F.col("source") == "doi") | T.titles_match(F.col("title"), F.col("found_title")))
    best = Window.partitionBy("id").orderBy(F.array_position(order, F.col("source")), "rank", "doi")
    return good.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("id", "source", "doi", "found_title")


def candidates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(id, doi, score, sure, duplicate_of): how well each candidate's title fits, and whether another live
    document holds its DOI already."""
    holders = docs.where("doi is not null and deleted_at is null").select(F.lower("doi").alias("_doi"), F.col("id").alias("_holder"))
    both = found.withColumnRenamed("title", "found_title").join(docs.select("id", "title"), "id")
    scored = both.select("id", "doi", F.round(T.title_overlap(F.col("title"), F.col("found_title")), 6).alias("score"), T.titles_match(F.col("title"), F.col("found_title")).alias("sure"))
    return scored.join(holders, (F.lower("doi") == F.col("_doi")) & (F.col("_holder") != F.col("id")), "left").select("id", "doi", "score", "sure", F.col("_holder").alias("duplicate_of"))


def backfilled_references(references: DataFrame, found: DataFrame) -> DataFrame:
    """``references`` (id, raw, ref_doi) with missing DOIs from ``found`` (id, rank, title, doi, is_preprint):
    the title must be named in the raw text; published work comes before preprints."""
    open_ = references.where("ref_doi is null").select("id", "raw")
    named = found.join(open_, "id").where(T.reference_names(F.col("title"), F.col("raw")))
    best = named.groupBy("id").agg(F.min_by("doi", F.struct("is_preprint", "rank", "doi")).alias("_doi"))
    return references.join(best, "id", "left").withColumn("ref_doi", F.coalesce("ref_doi", "_doi")).drop("_doi")


def relinked(docs: DataFrame, files: DataFrame, before: str, after: str) -> DataFrame:
    """``docs`` with paths under ``before`` moved to ``after`` where ``files`` (path, file_hash) has the same content there."""
    moved = F.concat(F.lit(after), F.substr("path", F.lit(len(before) + 1)))
    there = files.select(F.col("path").alias("_path"), F.col("file_hash").alias("_hash"))
    wanted = docs.withColumn("_moved", F.when(F.startswith(F.col("path"), F.lit(before)), moved))
    joined = wanted.join(there, (F.col("_moved") == F.col("_path")) & (F.col("file_hash") == F.col("_hash")), "left")
    return joined.withColumn("path", F.coalesce("_path", "path")).select(*docs.columns)
