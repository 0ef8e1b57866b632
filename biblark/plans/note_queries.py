"""Notes, links, counters, lists: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from biblark.operators import notes
from biblark.plans.library import NATION, Library, cte

WORDS = "regexp_split_to_array(lower({}), '[^a-z0-9]+')"
# A word's place by the first character before it that is no letter or digit.
AT = "(CASE WHEN regexp_matches(lower({0}), '^{1}([^a-z0-9]|$)') THEN 1 ELSE strpos(lower({0}), regexp_extract(lower({0}), '[^a-z0-9]{1}([^a-z0-9]|$)')) + 1 END)"
SNIPPET = f"trim(regexp_replace(substring({{0}}, greatest(1, {AT} - 90), {AT} + length('{{1}}') + 90 - greatest(1, {AT} - 90)), '\\s+', ' ', 'g'))"
TARGETS = """t AS (SELECT DISTINCT id AS note_id, lower(trim(split_part(unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1)), '|', 1))) AS target
    FROM (SELECT id, regexp_replace(body, '(?s)```.*?```', '', 'g') AS body FROM lib_notes)),
    bt AS (SELECT lower(trim(title)) AS target, min(id) AS to_note FROM lib_notes GROUP BY 1),
    pt AS (SELECT target, min(id) AS to_document FROM (SELECT id, lower(trim(title)) AS target FROM lib_live UNION ALL SELECT id, '@' || lower(citekey) FROM lib_live) WHERE target IS NOT NULL GROUP BY 1),
    l AS (SELECT note_id, target, to_note, CASE WHEN to_note IS NULL THEN to_document END AS to_document FROM t LEFT JOIN bt USING (target) LEFT JOIN pt USING (target) WHERE target <> '')"""
IDS = list(range(1, 4000, 7))
TAG = "brand#12"


def with_authors(lib: Library):
    return lib.document_authors.join(lib.authors.select(F.col("id").alias("author_id"), "family"), "author_id").select("document_id", "family")


def log(lib: Library):
    e = F.col("event_id")
    return lib.table("events").select(e.alias("id"), "ts", F.concat(F.lit("node"), (F.col("user_id") % 5).cast("string")).alias("node"), F.when(e % 2 == 0, "start").otherwise("done").alias("state"), F.col("event_type").alias("label"), F.when(e % 3 == 0, e % 10).alias("done"), F.lit(10).cast("long").alias("total"), F.when(e % 4 == 0, F.col("event_type")).alias("detail"))


QUERIES = {
    "note_links": (lambda lib: notes.note_links(lib.notes, lib.documents), cte(f"WITH {TARGETS} SELECT * FROM l")),
    "backlinks": (lambda lib: notes.backlinks(lib.notes, lib.documents), cte(f"WITH {TARGETS} SELECT kind, id, count(DISTINCT note_id) AS n, min(note_id) AS first FROM (SELECT 'note' AS kind, to_note AS id, note_id FROM l UNION ALL SELECT 'paper', to_document, note_id FROM l) WHERE id IS NOT NULL GROUP BY 1, 2")),
    "annotation_search": (lambda lib: notes.search(lib.index("annotations"), lib.annotations, "k 7"), cte(f"SELECT id, {SNIPPET.format('quote', 'k')} AS snippet FROM lib_annotations WHERE list_contains({WORDS.format('quote')}, 'k') AND list_contains({WORDS.format('quote')}, '7')")),
    "note_search": (lambda lib: notes.search(lib.index("notes"), lib.notes, "methods low").select("id"), cte(f"SELECT id FROM lib_notes WHERE list_contains({WORDS.format('body')}, 'methods') AND list_contains({WORDS.format('body')}, 'low')")),
    "note_snippets": (lambda lib: notes.search(lib.index("notes"), lib.notes, "methods low"), cte(f"SELECT id, {SNIPPET.format('body', 'methods')} AS snippet FROM lib_notes WHERE list_contains({WORDS.format('body')}, 'methods') AND list_contains({WORDS.format('body')}, 'low')")),
    "note_counts": (lambda lib: lib.notes.groupBy("collection_id").agg(F.count("*").alias("n")), cte("SELECT collection_id, count(*) AS n FROM lib_notes GROUP BY 1")),
    "notes_unfiled": (lambda lib: notes.in_collection(lib.notes, -1).select("id", "title"), cte("SELECT id, title FROM lib_notes WHERE collection_id IS NULL")),
    "notes_of_collection": (lambda lib: notes.in_collection(lib.notes, NATION + 3).select("id", "title"), cte(f"SELECT id, title FROM lib_notes WHERE collection_id = {NATION + 3}")),
    "snapshot_counters": (lambda lib: notes.snapshot(lib), cte("SELECT 'docs' AS counter, count(*) AS n FROM lib_live UNION ALL SELECT 'trash', count(*) FROM lib_documents WHERE deleted_at IS NOT NULL UNION ALL SELECT 'refs_only', count(*) FROM lib_live WHERE path LIKE 'ref:%' UNION ALL SELECT 'embedded', count(*) FROM embeddings UNION ALL SELECT 'notes', count(*) FROM lib_notes UNION ALL SELECT 'collections', count(*) FROM lib_collections")),
    "upper_median": (lambda lib: notes.upper_median(lib.live, "venue", "page_count"), cte("SELECT venue, coalesce(CAST(list_sort(list(page_count) FILTER (page_count IS NOT NULL))[count(page_count) // 2 + 1] AS DOUBLE), 0.0) AS median FROM lib_live GROUP BY 1")),
    "export_list": (lambda lib: notes.export_list(lib, IDS, TAG), cte(f"SELECT id, title, year FROM lib_live d WHERE id IN ({', '.join(map(str, IDS))}) AND EXISTS (SELECT 1 FROM lib_document_tags dt JOIN lib_tags t ON t.id = dt.tag_id WHERE dt.document_id = d.id AND lower(t.name) = '{TAG}') ORDER BY year DESC NULLS LAST, id")),
    "citation_wings": (
        lambda lib: notes.wings(lib),
        cte("""WITH k AS (SELECT DISTINCT r.document_id AS a, d.id AS b FROM lib_references r JOIN lib_live d ON lower(d.doi) = lower(r.ref_doi) WHERE r.document_id IN (SELECT id FROM lib_live) AND r.document_id <> d.id),
            w AS (SELECT a AS document_id, 'cited' AS wing, b AS other_id FROM k UNION ALL SELECT b, 'citing', a FROM k)
            SELECT document_id, wing, other_id, year, place FROM (SELECT document_id, wing, other_id, year, row_number() OVER (PARTITION BY document_id, wing ORDER BY coalesce(year, 9999), other_id) AS place FROM w JOIN lib_live d ON d.id = other_id) WHERE place <= 40"""),
    ),
    "graph_search": (lambda lib: notes.graph_search(lib.live, with_authors(lib), "supplier#000000007"), cte("SELECT id, CAST(2 AS INT) AS rank FROM lib_live d WHERE EXISTS (SELECT 1 FROM lib_document_authors da JOIN lib_authors a ON a.id = da.author_id WHERE da.document_id = d.id AND lower(a.family) LIKE '%supplier#000000007%') ORDER BY id LIMIT 8")),
    "move_members": (
        lambda lib: notes.moved(lib.members, lib.live.where("favorite").select(F.col("id").alias("document_id")), 1001, 1002),
        cte("WITH f AS (SELECT id AS document_id FROM lib_live WHERE favorite) SELECT DISTINCT collection_id, document_id FROM (SELECT * FROM lib_members m WHERE NOT (collection_id = 1001 AND document_id IN (SELECT document_id FROM f)) UNION ALL SELECT 1002, document_id FROM f)"),
    ),
    "event_log_text": (lambda lib: notes.log_lines(log(lib)), "SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%SZ') || '  ' || rpad('node' || (user_id % 5), 10, ' ') || ' ' || rpad(CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'done' END, 8, ' ') || ' ' || event_type || CASE WHEN event_id % 3 = 0 THEN ' [' || (event_id % 10) || '/10]' ELSE '' END || CASE WHEN event_id % 4 = 0 THEN ' — ' || event_type ELSE '' END AS line FROM events"),
    "tags_by_name": (lambda lib: lib.tags.select("id", "name").orderBy(F.collate("name", "UNICODE_CI_AI"), "id"), cte("SELECT id, name FROM lib_tags ORDER BY lower(name), id")),
}
