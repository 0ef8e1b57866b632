"""Catalogue operators: projections, filters, searches, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.plans.library import Library

MOST_ROWS = 100_000


def limit_or(limit: int | None, default: int) -> int:
    """A limit from 1 to 100,000, else the default."""
    return limit if limit is not None and 1 <= limit <= MOST_ROWS else default


def display_name() -> Column:
    return F.trim(F.concat(F.coalesce("given", F.lit("")), F.lit(" "), F.coalesce("family", F.lit(""))))


def author_names(lib: Library) -> DataFrame:
    """(document_id, names): display names in order of position, then of author."""
    named = lib.document_authors.join(lib.authors.select(F.col("id").alias("author_id"), display_name().alias("name")), "author_id")
    ordered = F.array_sort(F.collect_list(F.struct("position", "author_id", "name")))
    return named.groupBy("document_id").agg(F.transform(ordered, lambda x: x["name"]).alias("names"))


def has_pdf(path: Column) -> Column:
    return ~T.ascii_lower(path).startswith("ref:")


def with_authors(docs: DataFrame, lib: Library) -> DataFrame:
    """The shared projection of ten columns."""
    authors = author_names(lib).select(F.col("document_id").alias("id"), F.array_join("names", "; ").alias("authors"))
    columns = ["id", "title", "year", "venue", "doi", "citekey", "is_read", "favorite", has_pdf(F.col("path")).alias("has_pdf"), "authors"]
    return docs.join(authors, "id", "left").select(*columns)


def search(lib: Library, text: str, limit: int | None = None) -> DataFrame:
    """Live documents with ``text`` in title, venue, doi, key or an author's name; newest year first. The
    limit is taken before authors are gathered, so that only the rows shown are joined."""
    hit = lambda *names: reduce(Column.__or__, [F.coalesce(T.contains_nocase(F.col(n), text), F.lit(False)) for n in names])
    named = lib.document_authors.join(lib.authors.where(hit("family", "given")).select(F.col("id").alias("author_id")), "author_id", "left_semi").select(F.col("document_id").alias("id"), F.lit(True).alias("_named")).distinct()
    found = lib.live.join(named, "id", "left").where(hit("title", "venue", "doi", "citekey") | F.coalesce("_named", F.lit(False))).drop("_named")
    top = found.orderBy(F.desc_nulls_last("year"), F.asc_nulls_first("title"), "id").limit(limit_or(limit, 50))
    return with_authors(top, lib)


def tagged(docs: DataFrame, lib: Library, tag: str) -> DataFrame:
    """Documents that have the tag, without regard to ASCII case."""
    ids = lib.document_tags.join(lib.tags.where(T.ascii_lower(F.col("name")) == tag.lower()).select(F.col("id").alias("tag_id")), "tag_id", "left_semi").select(F.col("document_id").alias("id"))
    return docs.join(ids, "id", "left_semi")


def list_documents(lib: Library, unread: bool = False, favorite: bool = False, tag: str | None = None, limit: int | None = None) -> DataFrame:
    docs = lib.live
    if unread:
        docs = docs.where("NOT is_read")
    if favorite:
        docs = docs.where("favorite")
    if tag is not None:
        docs = tagged(docs, lib, tag)
    return with_authors(docs.orderBy(F.desc("added_at"), "id").limit(limit_or(limit, 200)), lib)


def full_records(lib: Library) -> DataFrame:
    """Every live document with authors, tags and counts of references and annotations."""
    tags = lib.document_tags.join(lib.tags.withColumnRenamed("id", "tag_id"), "tag_id").groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("tags"))
    refs = lib.references.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n_references"))
    notes = lib.annotations.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n_annotations"))
    authors = author_names(lib).select(F.col("document_id").alias("id"), F.array_join("names", "; ").alias("authors"))
    joined = lib.live.join(authors, "id", "left").join(tags, "id", "left").join(refs, "id", "left").join(notes, "id", "left")
    return joined.select("id", "title", "year", "venue", "doi", "citekey", "is_read", "favorite", "page_count", "github_url", "added_at", has_pdf(F.col("path")).alias("has_pdf"), "authors", "tags", F.coalesce("n_references", F.lit(0)).alias("n_references"), F.coalesce("n_annotations", F.lit(0)).alias("n_annotations"))


def tag_counts(lib: Library, live_only: bool) -> DataFrame:
    """(name, n). The plain count takes documents in the trash along, as the bridge has them."""
    bridge = lib.document_tags
    if live_only:
        bridge = bridge.join(lib.live.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    counts = bridge.groupBy(F.col("tag_id").alias("id")).agg(F.count("*").alias("n"))
    return lib.tags.join(counts, "id", "left").select("name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), T.ascii_lower(F.col("name")))


def statistics(lib: Library) -> DataFrame:
    """One row of twelve counters; each table is read once."""
    live = lib.live.agg(
        F.count("*").alias("documents"),
        F.count_if(has_pdf(F.col("path"))).alias("with_pdf"),
        F.count_if(~has_pdf(F.col("path"))).alias("references_only"),
        F.count_if(~F.col("is_read")).alias("unread"),
        F.count_if("favorite").alias("favorite"),
        F.count("doi").alias("with_doi"),
    )
    size = lambda df, name: df.agg(F.count("*").alias(name))
    others = [size(lib.tags, "tags"), size(lib.collections, "collections"), size(lib.authors, "authors"), size(lib.annotations, "annotations"), lib.watch_hits.agg(F.countDistinct("watch").alias("saved_searches"), F.count_if(F.col("state") == "new").alias("novelties"))]
    return reduce(DataFrame.crossJoin, others, live)  # one row each


def status(docs: DataFrame) -> Column:
    return T.publication_status(F.col("doi"), F.col("venue"), F.col("path"))


def facets(lib: Library) -> DataFrame:
    reviewed = F.coalesce(status(lib.live).isin("published", "preprint_reviewed"), F.lit(False))
    return lib.live.agg(F.count("*").alias("all"), F.count_if("favorite").alias("favorite"), F.count_if(~F.col("is_read")).alias("unread"), F.count("github_url").alias("github"), F.count_if(reviewed).alias("peerreviewed"), F.count_if("is_own").alias("own"))


def bare(docs: DataFrame, lib: Library) -> DataFrame:
    """Documents without authors, year and venue."""
    ids = lib.document_authors.select(F.col("document_id").alias("id"))
    return docs.where((F.coalesce("year", F.lit(0)) == 0) & (F.coalesce("venue", F.lit("")) == "")).join(ids, "id", "left_anti")


def reading_percent() -> Column:
    """100 when read; null when unknown; else the share of pages seen."""
    share = F.least(F.lit(100), F.floor(100 * F.col("last_page") / F.col("page_count") + 0.5)).cast("int")
    return F.when(F.col("is_read"), 100).when((F.coalesce("page_count", F.lit(0)) > 0) & (F.col("last_page") > 0), share)


def original_link() -> Column:
    return F.when(F.col("doi").isNotNull(), F.concat(F.lit("https://doi.org/"), F.col("doi")))


def multi_tag(lib: Library, names: list[str], every: bool) -> DataFrame:
    """Ids of live documents with any, or every one, of the tags."""
    wanted = lib.tags.where(F.col("name").isin(names)).select(F.col("id").alias("tag_id"))
    hits = lib.document_tags.join(wanted, "tag_id").groupBy(F.col("document_id").alias("id")).agg(F.count_distinct("tag_id").alias("n"))
    enough = hits.where(F.col("n") >= (len(set(names)) if every else 1)).select("id")
    return lib.live.select("id", "title").join(enough, "id", "left_semi")


def unfiled(lib: Library) -> DataFrame:
    return lib.live.select("id", "title").join(lib.members.select(F.col("document_id").alias("id")), "id", "left_anti")


def by_author(lib: Library, name: str) -> DataFrame:
    ids = lib.document_authors.join(lib.authors.where(T.ascii_lower(display_name()) == name.lower()).select(F.col("id").alias("author_id")), "author_id", "left_semi").select(F.col("document_id").alias("id"))
    return lib.live.select("id", "title").join(ids, "id", "left_semi")


def smart_rule(lib: Library, rules: list[dict]) -> DataFrame:
    """Live documents that meet all rules: untagged, year_gte, tag (id), text."""
    docs = lib.live
    for rule in rules:
        kind, value = rule["kind"], rule.get("value")
        if kind == "untagged":
            docs = docs.join(lib.document_tags.select(F.col("document_id").alias("id")), "id", "left_anti")
        elif kind == "year_gte":
            docs = docs.where(F.col("year") >= int(value))
        elif kind == "tag":
            docs = docs.join(lib.document_tags.where(F.col("tag_id") == int(value)).select(F.col("document_id").alias("id")), "id", "left_semi")
        elif kind == "text":
            docs = docs.where(T.contains_nocase(F.col("title"), value))
        else:
            raise ValueError(f"unknown rule {kind!r}")
    return docs.select("id", "title", "year")


def sorted_by(docs: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Stacked sort keys (column, descending); missing texts sort as '' and missing numbers as 0."""
    kinds = dict(docs.dtypes)
    value = lambda c: F.coalesce(F.col(c), F.lit("" if kinds[c] == "string" else 0)) if kinds[c] in ("string", "int", "bigint") else F.col(c)
    return docs.orderBy(*[value(c).desc() if down else value(c).asc() for c, down in keys], "id")


def home_counters(lib: Library, month: str) -> DataFrame:
    added = F.date_trunc("month", F.col("added_at")) == F.lit(month).cast("timestamp")
    pdf = has_pdf(F.col("path"))
    return lib.live.agg(F.count_if(pdf & ~F.col("is_read")).alias("unread_pdf"), F.count_if(~F.col("is_read") & (F.col("last_page") > 1)).alias("reading"), F.count_if(added).alias("added"))


def health(lib: Library, files: DataFrame, texts: DataFrame, thumbs: DataFrame) -> DataFrame:
    """(issue, id) of live documents: missing_file (a path outside ``files``, references apart), no_text (nothing but white
    space in ``texts``), no_metadata (neither authors nor year nor venue), no_embedding, no_thumbnail (not in ``thumbs``), and
    duplicate (the same content as another one). ``files``: path; ``texts``: id, text; ``thumbs``: id."""
    d = lib.live.select("id", "path", "year", "venue", "file_hash")
    lacking = lambda name, rows, have: rows.join(have, "id", "left_anti").select(F.lit(name).alias("issue"), "id")
    pdf = d.where(has_pdf(F.col("path")))
    authored = lib.document_authors.select(F.col("document_id").alias("id"))
    nameless = d.where((F.coalesce("year", F.lit(0)) == 0) & (F.coalesce("venue", F.lit("")) == ""))
    found = [
        pdf.join(files.select("path"), "path", "left_anti").select(F.lit("missing_file").alias("issue"), "id"),
        lacking("no_text", pdf, texts.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("id")),
        lacking("no_metadata", nameless, authored),
        lacking("no_embedding", d, lib.table("embeddings").select(F.col("vec_id").alias("id"))),
        lacking("no_thumbnail", pdf, thumbs.select("id")),
        content_classes(d).select(F.lit("duplicate").alias("issue"), "id"),
    ]
    return reduce(DataFrame.unionByName, found)


def content_classes(docs: DataFrame) -> DataFrame:
    """(id, class, n): documents whose content others have too, with the smallest id among them and how many they are. A row
    a document, whatever the size of a class."""
    sizes = docs.where("file_hash is not null").groupBy("file_hash").agg(F.min("id").alias("class"), F.count("*").alias("n")).where("n > 1")
    return docs.select("id", "file_hash").join(sizes, "file_hash").select("id", "class", "n")


def daily_pick(lib: Library, day: int) -> DataFrame:
    """One unread document, the same all day: number ``day`` modulo the number of unread ones. Only the count
    comes to the driver; the row is found through the counts of id ranges."""
    pool = lib.live.where("NOT is_read").select("id", "title")
    n = pool.count()
    if not n:
        return pool
    wanted = day % n
    ranges = pool.groupBy(F.floor(F.col("id") / 100_000).alias("r")).count().orderBy("r").toLocalIterator()
    for row in ranges:
        if wanted < row["count"]:
            inside = pool.where(F.floor(F.col("id") / 100_000) == row["r"])
            return inside.orderBy("id").offset(wanted).limit(1)
        wanted -= row["count"]
    return pool.limit(0)


def thin_metadata(lib) -> DataFrame:
    """(id) of live documents without a title, a year or an author."""
    thin = lib.live.join(lib.document_authors.select(F.col("document_id").alias("id"), F.lit(True).alias("_has")).distinct(), "id", "left")
    return thin.where("title IS NULL OR trim(title) = '' OR year IS NULL OR _has IS NULL").select("id")


def weighted_pick(docs: DataFrame, seed: int) -> DataFrame:
    """One of ``docs`` at random, the same for the same seed: unread ones weigh 2 more than 1, never opened ones 1.5, favorites
    0.5. A race of exponential clocks, read from a digest of seed and id, so that no total is needed."""
    weight = 1 + F.when(F.col("is_read"), 0).otherwise(2) + F.when(F.coalesce("last_page", F.lit(0)) == 0, 1.5).otherwise(0) + F.when(F.col("favorite"), 0.5).otherwise(0)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"))
    chance = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return docs.orderBy(-F.log(chance) / weight, "id").limit(1).select("id", "title")


def pretty_json(record: Column) -> Column:
    """A record as indented JSON with its nulls, a space after each colon only."""
    return F.regexp_replace(F.to_json(record, {"pretty": "true", "ignoreNullFields": "false"}), r'(?m)^(\s*"(?:[^"\\\\]|\\\\.)*") : ', "$1: ")


def filing_counts(lib: Library) -> DataFrame:
    """(kind, id, n): live documents of each collection, those of none, and all of them."""
    live = lib.live.select(F.col("id").alias("document_id"))
    filed = lib.members.join(live, "document_id", "left_semi").distinct()
    direct = lib.collections.select("id").join(filed.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    alone = live.join(filed, "document_id", "left_anti")
    size = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("id"), "n")
    return direct.select(F.lit("collection").alias("kind"), "id", F.coalesce("n", F.lit(0)).alias("n")).unionByName(size(alone, "unfiled")).unionByName(size(live, "total"))
