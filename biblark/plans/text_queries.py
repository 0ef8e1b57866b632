"""Registered queries over scalar functions, applied to whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.plans.library import Library
from biblark.plans.retrieval_queries import LINE


def titles(lib: Library) -> DataFrame:
    return lib.table("documents").select(F.col("doc_id").alias("id"), T.first_line(F.col("text")).alias("title"), "text")


def pages(lib: Library) -> DataFrame:
    return lib.table("pages").select(F.col("page_id").alias("id"), "url", "html")


def inverted(lib: Library) -> DataFrame:
    """Inverted indexes of whole texts as JSON, and read back."""
    words = F.transform(F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " +"), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    placed = lib.table("documents").select(F.col("doc_id").alias("id"), F.explode(words).alias("p")).where("p.w <> ''").groupBy("id", "p.w").agg(F.sort_array(F.collect_list("p.i")).alias("at"))
    index = placed.groupBy("id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("w", "at")))).alias("index"))
    return index.select("id", F.sha2(T.inverted_abstract(F.col("index")), 256).alias("digest"))


def routed(lib: Library) -> DataFrame:
    n = F.col("p_partkey")
    s = n.cast("string")
    raw = F.when(n % 5 == 0, F.concat(F.lit("https://doi.org/10.1000/ABC"), s)).when(n % 5 == 1, F.concat(F.lit("arXiv:2101."), F.lpad((n % 10000).cast("string"), 5, "0"))).when(n % 5 == 2, F.lit("978-3-16-148410-0")).when(n % 5 == 3, F.concat(F.lit("PMID: "), (n + 10000000).cast("string"))).otherwise(F.lit("no identifier here"))
    route = T.identifier_route(raw)
    return lib.table("part").select(n.alias("id"), route["kind"].alias("kind"), route["value"].alias("value"))


HTML = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
QUERIES = {
    "note_titles": (lambda lib: titles(lib).select("id", "title"), f"SELECT doc_id AS id, {LINE} AS title FROM documents"),
    "slugify": (
        lambda lib: titles(lib).select("id", T.slugify(F.col("title")).alias("slug")),
        f"SELECT doc_id AS id, coalesce(nullif(trim(regexp_replace(lower({LINE}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), ''), 'pagina') AS slug FROM documents",
    ),
    "page_titles": (lambda lib: pages(lib).select("id", T.between(F.col("html"), "<h1>", "</h1>").alias("title")).select("id", F.length("title").alias("n")).where("n > 0").select("id"), "SELECT page_id AS id FROM pages WHERE regexp_matches(html, '<h1>[^<]*[^<\\s][^<]*</h1>')"),
    "content_digest": (lambda lib: titles(lib).select("id", F.sha2(F.col("text"), 256).alias("digest")), "SELECT doc_id AS id, sha256(text) AS digest FROM documents"),
    "percent_encode": (lambda lib: pages(lib).select("id", T.percent_encode(F.col("url")).alias("encoded")), "SELECT page_id AS id, url_encode(url) AS encoded FROM pages"),
    "civil_date": (lambda lib: lib.table("events").select(F.col("event_id").alias("id"), T.civil_date(F.unix_millis(F.col("ts").cast("timestamp"))).alias("day")), "SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS day FROM events"),
    "duration_text": (
        lambda lib: lib.table("events").select(F.col("event_id").alias("id"), T.duration_text((F.col("event_id") * 1000 * 7).cast("long")).alias("took")),
        "WITH e AS (SELECT event_id AS id, event_id * 7 AS s FROM events) SELECT id, CASE WHEN s < 1 THEN '<1s' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS took FROM e",
    ),
    "inverted_abstract": (
        inverted,
        "WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' +'), lambda x: x <> '') AS w FROM documents) SELECT id, sha256(array_to_string(w, ' ')) AS digest FROM w WHERE len(w) > 0",
    ),
    "identifier_route": (
        routed,
        """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'doi' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'isbn' WHEN 3 THEN 'pmid' END AS kind,
           CASE p_partkey % 5 WHEN 0 THEN '10.1000/ABC' || p_partkey WHEN 1 THEN '2101.' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 5, '0') WHEN 2 THEN '9783161484100' WHEN 3 THEN CAST(p_partkey + 10000000 AS VARCHAR) END AS value FROM part""",
    ),
    "markdown_cells": (lambda lib: titles(lib).select("id", F.sha2(T.md_cell(F.col("text")), 256).alias("cell")), "SELECT doc_id AS id, sha256(regexp_replace(replace(text, '|', '\\|'), '[\\r\\n]+', ' ', 'g')) AS cell FROM documents"),
}
