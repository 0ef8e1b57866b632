"""Notes: links between notes and papers, both ways, search, lists, and counters over the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.operators.search_index import SearchIndex
from biblark.plans.library import Library

LINK = r"\[\[([^\[\]\n]+)\]\]"


def link_targets(body: Column) -> Column:
    """Lower-case targets of ``[[target]]`` and ``[[target|label]]`` outside fenced code, in order. A fence of three
    backticks or tildes ends with one of its own kind."""
    lines = F.split(F.coalesce(body, F.lit("")), "\n")
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<string>").alias("open"))

    def step(state: Column, line: Column) -> Column:
        begins = F.ltrim(line)
        mark = F.when(begins.startswith("```"), "`").when(begins.startswith("~~~"), "~").otherwise("")
        fence = F.when((mark != "") & (state["fence"] == ""), mark).when((mark != "") & (mark == state["fence"]), "").otherwise(state["fence"])
        inside = (mark != "") | (state["fence"] != "")
        return F.struct(fence.alias("fence"), F.when(inside, state["open"]).otherwise(F.concat(state["open"], F.array(line))).alias("open"))

    kept = F.aggregate(lines, start, step, lambda s: s["open"])
    found = F.flatten(F.transform(kept, lambda line: F.regexp_extract_all(line, F.lit(LINK), F.lit(1))))
    return F.filter(F.transform(found, lambda t: F.lower(F.trim(F.get(F.split(t, r"\|"), 0)))), lambda t: t != "")


def note_links(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """(note_id, target, to_note, to_document): each link with the note of that title, else the live paper of that title
    or ``@citekey``; of several the smallest id. One equality join a kind."""
    links = notes.select(F.col("id").alias("note_id"), F.explode(link_targets(F.col("body"))).alias("target")).distinct()
    by_title = notes.groupBy(F.lower(F.trim("title")).alias("target")).agg(F.min("id").alias("to_note"))
    live = docs.where("deleted_at IS NULL")
    names = live.select("id", F.lower(F.trim("title")).alias("target")).unionByName(live.select("id", F.concat(F.lit("@"), F.lower("citekey")).alias("target")))
    papers = names.where("target IS NOT NULL").groupBy("target").agg(F.min("id").alias("to_document"))
    joined = links.join(by_title, "target", "left").join(papers, "target", "left")
    return joined.select("note_id", "target", "to_note", F.when(F.col("to_note").isNull(), F.col("to_document")).alias("to_document"))


def backlinks(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, id, n, first): how many notes link to each note and paper, and the smallest of them."""
    links = note_links(notes, docs)
    ends = links.select(F.lit("note").alias("kind"), F.col("to_note").alias("id"), "note_id").unionByName(links.select(F.lit("paper").alias("kind"), F.col("to_document").alias("id"), "note_id"))
    return ends.where("id IS NOT NULL").groupBy("kind", "id").agg(F.count_distinct("note_id").alias("n"), F.min("note_id").alias("first"))


def search(index: SearchIndex, rows: DataFrame, text: str) -> DataFrame:
    """(id, snippet) of rows that hold every word of ``text`` in any indexed column, from the kept index. The snippet is
    taken around the first word, from the last column that holds it."""
    terms = index.terms_of(text)
    found = rows.join(index.match_all(text).select(F.col("id").alias(index.key)), index.key, "left_semi")
    parts = [T.excerpt_of_term(F.col(c), terms[0]) for c in reversed(index.columns)] if terms else [F.lit(None).cast("string")]
    return found.select(F.col(index.key).alias("id"), F.coalesce(*parts).alias("snippet"))


def in_collection(notes: DataFrame, collection: int) -> DataFrame:
    """0 all notes, -1 those of no collection, else those of one."""
    return notes if collection == 0 else notes.where("collection_id IS NULL") if collection == -1 else notes.where(F.col("collection_id") == collection)


def sorted_notes(notes: DataFrame, by: str = "updated") -> DataFrame:
    """Notes (id, title, created_at, updated_at) by title, or newest first by creation or change, those without a time last;
    ties by title without regard to case and accents, then by id."""
    if by not in ("title", "created", "updated"):
        raise ValueError(f"no order by {by!r}")
    title = [F.collate("title", "UNICODE_CI_AI").asc(), F.col("id").asc()]
    return notes.orderBy(*([] if by == "title" else [F.desc_nulls_last(f"{by}_at")]), *title)


def snapshot(lib: Library, passages: DataFrame | None = None) -> DataFrame:
    """Counters of the library, one row each; with ``passages`` (document_id, ...) also how many there are and of how many
    documents. Watches are the saved searches that have found anything."""
    one = lambda df, name, test="true": df.where(test).agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
    docs = lib.documents.agg(F.count_if(F.col("deleted_at").isNull()).alias("docs"), F.count_if(F.col("deleted_at").isNotNull()).alias("trash"), F.count_if(F.col("deleted_at").isNull() & F.col("path").startswith("ref:")).alias("refs_only"))
    out = docs.unpivot([], ["docs", "trash", "refs_only"], "counter", "n")
    for df, name in ((lib.table("embeddings"), "embedded"), (lib.notes, "notes"), (lib.collections, "collections")):
        out = out.unionByName(one(df, name))
    if passages is None:
        return out
    held = passages.agg(F.count_distinct("document_id").alias("rag_docs"), F.count("*").alias("rag_chunks")).unpivot([], ["rag_docs", "rag_chunks"], "counter", "n")
    return out.unionByName(held).unionByName(one(lib.watch_hits.select("watch").distinct(), "watches"))


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): the value at place n div 2 of the sorted values, from 0; 0 where there is none. Equal values are
    counted first, so a group costs as many rows as it has different values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    by_value = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("k").over(by_value)).withColumn("n", F.sum("k").over(Window.partitionBy(group)))
    middle = placed.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(group).agg(F.min(F.col(value).cast("double")).alias("median"))
    known = rows.select(group).distinct().withColumnRenamed(group, "_g")
    return known.join(middle, F.col("_g").eqNullSafe(F.col(group)), "left").select(F.col("_g").alias(group), F.coalesce("median", F.lit(0.0)).alias("median"))


def export_list(lib: Library, ids: list[int] | None = None, tag: str | None = None) -> DataFrame:
    """(id, title, year) of live documents by id and tag, years downwards (none last), then by id."""
    docs = lib.live if ids is None else lib.live.where(F.col("id").isin(ids))
    if tag is not None:
        wanted = lib.document_tags.join(lib.tags.where(F.lower("name") == tag.lower()).select(F.col("id").alias("tag_id")), "tag_id")
        docs = docs.join(wanted.select(F.col("document_id").alias("id")), "id", "left_semi")
    return docs.select("id", "title", "year").orderBy(F.desc_nulls_last("year"), "id")


def wings(lib: Library, most: int = 40) -> DataFrame:
    """(document_id, wing, place, other_id, year): on either side of each live document the papers of the library that it
    cites and those that cite it, oldest first, those without a year last; at most ``most`` a wing, the size of the map."""
    owners = lib.live.select(F.lower("doi").alias("_doi"), F.col("id").alias("cited_id")).where("_doi is not null")
    live = lib.live.select(F.col("id").alias("document_id"))
    links = lib.references.withColumn("_doi", F.lower("ref_doi")).join(owners, "_doi").join(live, "document_id", "left_semi").where("document_id <> cited_id").select("document_id", "cited_id").distinct()
    both = links.select("document_id", F.lit("cited").alias("wing"), F.col("cited_id").alias("other_id")).unionByName(links.select(F.col("cited_id").alias("document_id"), F.lit("citing").alias("wing"), F.col("document_id").alias("other_id")))
    dated = both.join(lib.live.select(F.col("id").alias("other_id"), "year"), "other_id")
    place = F.row_number().over(Window.partitionBy("document_id", "wing").orderBy(F.coalesce("year", F.lit(9999)), "other_id"))
    return dated.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("document_id", "wing", "place", "other_id", "year")


def graph_search(docs: DataFrame, authors: DataFrame, query: str, most: int = 8) -> DataFrame:
    """(id, rank): titles that begin with the query, then those that contain it, then documents of such an author; the
    first ``most``, by id. Queries of less than two characters find nothing."""
    folded = T.without_marks(F.lit(query.strip()))
    title = T.without_marks(F.coalesce("title", F.lit("")))
    by_author = authors.where(T.without_marks(F.coalesce("family", F.lit(""))).contains(folded)).select(F.col("document_id").alias("id")).distinct().withColumn("_by", F.lit(True))
    rank = F.when(title.startswith(folded), 0).when(title.contains(folded), 1).when(F.col("_by"), 2)
    found = docs.join(by_author, "id", "left").select("id", rank.alias("rank")).where("rank IS NOT NULL")
    return found.where(F.lit(len(query.strip()) >= 2)).orderBy("rank", "id").limit(most)


def moved(members: DataFrame, document_ids: DataFrame, source: int | None, target: int | None) -> DataFrame:
    """Memberships after adding ``document_ids`` (document_id) to ``target`` and taking them from ``source``; either may be missing."""
    kept = members
    if source is not None:
        gone = document_ids.withColumn("collection_id", F.lit(source).cast("long"))
        kept = members.join(gone, ["collection_id", "document_id"], "left_anti")
    if target is None:
        return kept
    return kept.unionByName(document_ids.select(F.lit(target).cast("long").alias("collection_id"), "document_id")).distinct()


def padded(name: str, width: int) -> Column:
    """Spaces up to ``width``; longer values stay whole."""
    return F.rpad(name, F.greatest(F.length(name), F.lit(width)), F.lit(" "))


def log_lines(events: DataFrame) -> DataFrame:
    """(id, line) of an event log (id, ts, node, state, label, done, total, detail): time, node, state, what, how far."""
    far = F.when(F.col("done").isNotNull() & F.col("total").isNotNull(), F.format_string(" [%d/%d]", "done", "total"))
    rest = F.concat(F.coalesce(far, F.lit("")), F.coalesce(F.concat(F.lit(" — "), F.col("detail")), F.lit("")))
    return events.select("id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss'Z'"), F.lit("  "), padded("node", 10), F.lit(" "), padded("state", 8), F.lit(" "), F.col("label"), rest).alias("line"))
