"""Registered queries over the catalogue, the citation graph and the tree of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.operators import bibliography, catalog, citations, folders, hierarchy, palette, snowball
from biblark.operators.storage import stored
from biblark.plans.library import CUSTOMER, NATION, REGION, Library, cte

NAMES = "SELECT da.document_id, string_agg(trim(coalesce(a.given, '') || ' ' || coalesce(a.family, '')), '; ' ORDER BY da.position, da.author_id) AS authors FROM lib_document_authors da JOIN lib_authors a ON a.id = da.author_id GROUP BY 1"
PROJECTION = "d.id, d.title, d.year, d.venue, d.doi, d.citekey, d.is_read, d.favorite, lower(d.path) NOT LIKE 'ref:%' AS has_pdf, n.authors"
STATUS = """CASE WHEN (doi LIKE '10.48550/arxiv%' OR doi LIKE '10.1101%' OR doi LIKE '10.21203%' OR doi LIKE '10.26434%'
    OR regexp_matches(coalesce(lower(venue), '') || ' ' || coalesce(lower(path), ''), 'arxiv|biorxiv|medrxiv|chemrxiv|preprint|ssrn|research square|researchsquare|osf|techrxiv|authorea'))
    THEN CASE WHEN doi IS NOT NULL AND NOT (doi LIKE '10.48550/arxiv%' OR doi LIKE '10.1101%' OR doi LIKE '10.21203%' OR doi LIKE '10.26434%') THEN 'preprint_reviewed' ELSE 'preprint' END
    WHEN doi IS NOT NULL OR coalesce(venue, '') <> '' THEN 'published' END"""
UP = "up(id, ancestor, distance) AS (SELECT id, id, 0 FROM lib_collections UNION ALL SELECT u.id, c.parent_id, u.distance + 1 FROM up u JOIN lib_collections c ON c.id = u.ancestor WHERE c.parent_id IS NOT NULL)"


def listing(where: str, order: str, limit: int) -> str:
    return cte(f"WITH top AS (SELECT * FROM lib_live d WHERE {where} ORDER BY {order} LIMIT {limit}), names AS ({NAMES}) SELECT {PROJECTION} FROM top d LEFT JOIN names n ON n.document_id = d.id")


TAGGED = "EXISTS (SELECT 1 FROM lib_document_tags dt JOIN lib_tags t ON t.id = dt.tag_id WHERE dt.document_id = d.id AND lower(t.name) = '{}')"


def citation_items(lib: Library) -> DataFrame:
    """Live documents of a small range with their authors as structs, for the formats."""
    people = lib.document_authors.join(lib.authors.withColumnRenamed("id", "author_id"), "author_id")
    ordered = F.array_sort(F.collect_list(F.struct("position", "author_id", "given", "family")))
    people = people.groupBy(F.col("document_id").alias("id")).agg(F.transform(ordered, lambda a: F.struct(a["given"].alias("given"), a["family"].alias("family"))).alias("authors"))
    return lib.live.join(people, "id")


def formats(lib: Library) -> DataFrame:
    d = citation_items(lib)
    key = F.coalesce(F.when(F.trim("citekey") != "", F.trim("citekey")), bibliography.base_key(F.get(d["authors"], 0)["family"], d["year"], d["title"]))
    return d.select("id", bibliography.bibtex(key, d).alias("bibtex"), bibliography.ris(d).alias("ris"), bibliography.apa(d).alias("apa"), bibliography.ieee(F.lit(1), d).alias("ieee"), F.concat(F.lit("\\cite{"), key, F.lit("}")).alias("latex"), F.concat(F.lit("[@"), key, F.lit("]")).alias("pandoc"), key.alias("citekey"))


FORMATS_SQL = cte("""WITH people AS (SELECT da.document_id, list({'given': a.given, 'family': a.family} ORDER BY da.position, da.author_id) AS a FROM lib_document_authors da JOIN lib_authors a ON a.id = da.author_id GROUP BY 1),
    d AS (SELECT l.*, p.a, coalesce(l.citekey, regexp_replace(lower(p.a[1].family), '[^a-z0-9]', '', 'g') || coalesce(CAST(l.year AS VARCHAR), '') || 'study') AS key,
      list_transform(p.a, lambda x: concat_ws(', ', x.family, x.given)) AS fg,
      list_transform(p.a, lambda x: x.family || CASE WHEN x.given IS NULL THEN '' ELSE ', ' || upper(substring(x.given, 1, 1)) || '.' END) AS fi,
      list_transform(p.a, lambda x: CASE WHEN x.given IS NULL THEN '' ELSE upper(substring(x.given, 1, 1)) || '. ' END || x.family) AS if_
      FROM lib_live l JOIN people p ON p.document_id = l.id)
    SELECT id, '@article{' || key || concat_ws('', ',' || chr(10) || '  title = {' || title || '}', ',' || chr(10) || '  author = {' || array_to_string(fg, ' and ') || '}', ',' || chr(10) || '  year = {' || year || '}', ',' || chr(10) || '  journal = {' || venue || '}', ',' || chr(10) || '  doi = {' || doi || '}') || chr(10) || '}' AS bibtex,
      concat_ws(chr(10), 'TY  - JOUR', 'TI  - ' || title, array_to_string(list_transform(fg, lambda x: 'AU  - ' || x), chr(10)), 'PY  - ' || year, 'JO  - ' || venue, 'DO  - ' || doi, 'ER  - ') AS ris,
      trim(CASE WHEN len(fi) = 1 THEN fi[1] ELSE array_to_string(fi[:len(fi) - 1], ', ') || ', & ' || fi[len(fi)] END || ' ' || coalesce('(' || year || '). ', '') || title || '.' || coalesce(' ' || venue || '.', '') || coalesce(' https://doi.org/' || doi, '')) AS apa,
      '[1] ' || array_to_string(if_, ', ') || ', "' || title || ',"' || coalesce(' ' || venue || ',', '') || coalesce(' ' || year || '.', '') || coalesce(' doi: ' || doi || '.', '') AS ieee,
      '\\cite{' || key || '}' AS latex, '[@' || key || ']' AS pandoc, key AS citekey FROM d""")

GAPS = "refs AS (SELECT r.document_id, lower(r.ref_doi) AS doi, r.raw FROM lib_references r JOIN lib_live d ON d.id = r.document_id), own AS (SELECT lower(doi) AS doi, id AS cited_id FROM lib_live WHERE doi IS NOT NULL)"

# name: (query over a library, SQL or None)
SNOWBALL_HOP = """f{0} AS (SELECT t.seed, l.id, t.place AS pp, l.o, l.rank, l.work AS parent, l.direction FROM {1} t JOIN ln l ON l.work = t.id WHERE (t.seed, l.id) NOT IN ({2}) QUALIFY row_number() OVER (PARTITION BY t.seed, l.id ORDER BY t.place, l.o, l.rank) = 1),
    t{0} AS (SELECT seed, {0} AS hop, row_number() OVER (PARTITION BY seed ORDER BY pp, o, rank) AS place, id, parent, direction FROM f{0})"""
SNOWBALL = f"""WITH k AS (SELECT DISTINCT r.document_id AS a, d.id AS b FROM lib_references r JOIN lib_live d ON lower(d.doi) = lower(r.ref_doi) WHERE r.document_id IN (SELECT id FROM lib_live) AND r.document_id <> d.id),
    wk AS (SELECT id, coalesce(c, 0) AS c FROM lib_live LEFT JOIN (SELECT b, count(*) AS c FROM k GROUP BY 1) ON b = id),
    sd AS (SELECT a AS work, b AS id, 'reference' AS direction, 0 AS o FROM k UNION ALL SELECT b, a, 'citing', 1 FROM k),
    ln AS (SELECT work, sd.id, direction, o, row_number() OVER (PARTITION BY work, direction ORDER BY c DESC, sd.id) AS rank FROM sd JOIN wk ON wk.id = sd.id QUALIFY rank <= 5),
    t0 AS (SELECT id AS seed, 0 AS hop, 1 AS place, id, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS VARCHAR) AS direction FROM lib_live WHERE id % 100 = 0),
    {SNOWBALL_HOP.format(1, "t0", "SELECT seed, id FROM t0")}, {SNOWBALL_HOP.format(2, "t1", "SELECT seed, id FROM t0 UNION ALL SELECT seed, id FROM t1")},
    {SNOWBALL_HOP.format(3, "t2", "SELECT seed, id FROM t0 UNION ALL SELECT seed, id FROM t1 UNION ALL SELECT seed, id FROM t2")},
    tr AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)"""


def grown(lib: Library) -> DataFrame:
    """Trees of depth three from every document whose id is divisible by 100, five works a side."""
    owners = lib.live.select(F.lower("doi").alias("_doi"), F.col("id").alias("b")).where("_doi is not null")
    live = lib.live.select(F.col("id").alias("a"))
    ties = lib.references.select(F.col("document_id").alias("a"), F.lower("ref_doi").alias("_doi")).join(owners, "_doi").join(live, "a", "left_semi").where("a <> b").select("a", "b").distinct()
    counts = ties.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("citations"))
    works = lib.live.select("id").join(counts, "id", "left")
    return snowball.snowball(works, ties, lib.live.where("id % 100 = 0").select("id"), 3, 5)


def pruned(lib: Library) -> DataFrame:
    """The same trees without what hangs below the first work of each."""
    tree = stored(grown(lib), "trees")
    return snowball.without_subtrees(tree, tree.where("hop = 1 and place = 1").select("seed", "id")).select("seed", "hop", "id")



class Earlier(Library):
    """The library before every seventh document was filed."""

    @property
    def members(self) -> DataFrame:
        return super().members.where("document_id % 7 <> 0")


FILES = """{0}filed AS (SELECT coalesce(p.folder, 'Senza raccolta') AS folder, d.id, d.path AS source,
        coalesce(a.family || ' ', '') || coalesce(d.year || ' — ', '') || d.title AS stem, m.collection_id
    FROM (SELECT * FROM lib_live WHERE path NOT LIKE 'ref:%') d LEFT JOIN {1} m ON m.document_id = d.id
    LEFT JOIN (SELECT c.id, concat_ws('/', g.name, f.name, c.name) AS folder FROM lib_collections c LEFT JOIN lib_collections f ON f.id = c.parent_id LEFT JOIN lib_collections g ON g.id = f.parent_id) p ON p.id = m.collection_id
    LEFT JOIN (SELECT da.document_id, arg_min(u.family, row(da.position, u.id)) AS family FROM lib_document_authors da JOIN lib_authors u ON u.id = da.author_id GROUP BY 1) a ON a.document_id = d.id),
    {0}files AS (SELECT folder, id, source, stem || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.pdf' AS name FROM (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY id) AS k FROM {0}filed))"""
EVERY = "{0}every AS (SELECT DISTINCT array_to_string(parts[1:k], '/') AS folder FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT DISTINCT string_split(folder, '/') AS parts FROM {0}files)))"

QUERIES = {
    "catalog_search": (lambda lib: catalog.search(lib, "urgent", 50), listing("lower(title) LIKE '%urgent%' OR lower(venue) LIKE '%urgent%' OR lower(doi) LIKE '%urgent%' OR lower(citekey) LIKE '%urgent%' OR EXISTS (SELECT 1 FROM lib_document_authors da JOIN lib_authors a ON a.id = da.author_id WHERE da.document_id = d.id AND (lower(a.family) LIKE '%urgent%' OR lower(a.given) LIKE '%urgent%'))", "year DESC NULLS LAST, title NULLS FIRST, id", 50)),
    "catalog_search_author": (lambda lib: catalog.search(lib, "SUPPLIER#000000007", 1000), listing("lower(title) LIKE '%supplier#000000007%' OR EXISTS (SELECT 1 FROM lib_document_authors da JOIN lib_authors a ON a.id = da.author_id WHERE da.document_id = d.id AND lower(a.family) LIKE '%supplier#000000007%')", "year DESC NULLS LAST, title NULLS FIRST, id", 1000)),
    "list_flagged": (lambda lib: catalog.list_documents(lib, unread=True, favorite=True), listing("NOT is_read AND favorite", "added_at DESC, id", 200)),
    "list_tagged": (lambda lib: catalog.list_documents(lib, tag="brand#7", limit=100_000), listing(TAGGED.format("brand#7"), "added_at DESC, id", 100000)),
    "show_record": (
        lambda lib: catalog.full_records(lib),
        cte(f"""WITH names AS ({NAMES}), tg AS (SELECT dt.document_id, string_agg(t.name, ',' ORDER BY t.name) AS tags FROM lib_document_tags dt JOIN lib_tags t ON t.id = dt.tag_id GROUP BY 1),
        rf AS (SELECT document_id, count(*) AS n FROM lib_references GROUP BY 1), an AS (SELECT document_id, count(*) AS n FROM lib_annotations GROUP BY 1)
        SELECT d.id, title, year, venue, doi, citekey, is_read, favorite, page_count, github_url, added_at, lower(path) NOT LIKE 'ref:%' AS has_pdf, names.authors, tg.tags, coalesce(rf.n, 0) AS n_references, coalesce(an.n, 0) AS n_annotations
        FROM lib_live d LEFT JOIN names ON names.document_id = d.id LEFT JOIN tg ON tg.document_id = d.id LEFT JOIN rf ON rf.document_id = d.id LEFT JOIN an ON an.document_id = d.id"""),
    ),
    "tag_counts_raw": (lambda lib: catalog.tag_counts(lib, False), cte("SELECT t.name, count(dt.document_id) AS n FROM lib_tags t LEFT JOIN lib_document_tags dt ON dt.tag_id = t.id GROUP BY t.id, t.name")),
    "tag_counts_live": (lambda lib: catalog.tag_counts(lib, True), cte("SELECT t.name, count(d.id) AS n FROM lib_tags t LEFT JOIN lib_document_tags dt ON dt.tag_id = t.id LEFT JOIN lib_live d ON d.id = dt.document_id GROUP BY t.id, t.name")),
    "library_stats": (
        lambda lib: catalog.statistics(lib),
        cte("""SELECT (SELECT count(*) FROM lib_live) AS documents, (SELECT count(*) FROM lib_live WHERE path NOT LIKE 'ref:%') AS with_pdf, (SELECT count(*) FROM lib_live WHERE path LIKE 'ref:%') AS references_only,
        (SELECT count(*) FROM lib_live WHERE NOT is_read) AS unread, (SELECT count(*) FROM lib_live WHERE favorite) AS favorite, (SELECT count(doi) FROM lib_live) AS with_doi, (SELECT count(*) FROM lib_tags) AS tags,
        (SELECT count(*) FROM lib_collections) AS collections, (SELECT count(*) FROM lib_authors) AS authors, (SELECT count(*) FROM lib_annotations) AS annotations,
        (SELECT count(DISTINCT watch) FROM lib_watch_hits) AS saved_searches, (SELECT count(*) FROM lib_watch_hits WHERE state = 'new') AS novelties"""),
    ),
    "facets": (lambda lib: catalog.facets(lib), cte(f'SELECT count(*) AS "all", count_if(favorite) AS favorite, count_if(NOT is_read) AS unread, count(github_url) AS github, count_if(coalesce({STATUS}, \'\') IN (\'published\', \'preprint_reviewed\')) AS peerreviewed, count_if(is_own) AS own FROM lib_live')),
    "status_classify": (lambda lib: lib.live.select("id", catalog.status(lib.live).alias("status")), cte(f"SELECT id, {STATUS} AS status FROM lib_live")),
    "bare_documents": (lambda lib: catalog.bare(lib.live, lib).select("id", "title"), cte("SELECT id, title FROM lib_live d WHERE coalesce(year, 0) = 0 AND coalesce(venue, '') = '' AND NOT EXISTS (SELECT 1 FROM lib_document_authors a WHERE a.document_id = d.id)")),
    "reading_percent": (lambda lib: lib.live.select("id", catalog.reading_percent().alias("percent")), cte("SELECT id, CASE WHEN is_read THEN 100 WHEN coalesce(page_count, 0) > 0 AND last_page > 0 THEN CAST(least(100, floor(100.0 * last_page / page_count + 0.5)) AS INT) END AS percent FROM lib_live")),
    "original_link": (lambda lib: lib.live.select("id", catalog.original_link().alias("link")), cte("SELECT id, 'https://doi.org/' || doi AS link FROM lib_live")),
    "first_author": (lambda lib: lib.document_authors.groupBy("document_id").agg(F.min_by("author_id", F.struct("position", "author_id")).alias("author_id")).join(lib.authors.select(F.col("id").alias("author_id"), "family"), "author_id").select("document_id", "family"), cte("SELECT document_id, family FROM (SELECT da.document_id, a.family, row_number() OVER (PARTITION BY document_id ORDER BY position, author_id) AS k FROM lib_document_authors da JOIN lib_authors a ON a.id = da.author_id) WHERE k = 1")),
    "ordered_concat": (lambda lib: catalog.author_names(lib).select("document_id", F.array_join("names", "; ").alias("authors")), cte(NAMES)),
    "author_line": (lambda lib: catalog.author_names(lib).select("document_id", T.author_line(F.col("names")).alias("line")), cte("SELECT document_id, CASE WHEN len(l) <= 3 THEN array_to_string(l, ', ') ELSE array_to_string(l[:3], ', ') || ' et al.' END AS line FROM (SELECT da.document_id, list(trim(coalesce(a.given, '') || ' ' || coalesce(a.family, '')) ORDER BY da.position, da.author_id) AS l FROM lib_document_authors da JOIN lib_authors a ON a.id = da.author_id GROUP BY 1)")),
    "multi_tag_any": (lambda lib: catalog.multi_tag(lib, ["Brand#1", "Brand#2"], False), cte("SELECT id, title FROM lib_live d WHERE EXISTS (SELECT 1 FROM lib_document_tags dt JOIN lib_tags t ON t.id = dt.tag_id WHERE dt.document_id = d.id AND t.name IN ('Brand#1', 'Brand#2'))")),
    "multi_tag_all": (lambda lib: catalog.multi_tag(lib, ["Brand#1", "Brand#2"], True), cte("SELECT id, title FROM lib_live d WHERE (SELECT count(DISTINCT t.id) FROM lib_document_tags dt JOIN lib_tags t ON t.id = dt.tag_id WHERE dt.document_id = d.id AND t.name IN ('Brand#1', 'Brand#2')) = 2")),
    "unfiled": (lambda lib: catalog.unfiled(lib), cte("SELECT id, title FROM lib_live WHERE id NOT IN (SELECT document_id FROM lib_members)")),
    "by_author": (lambda lib: catalog.by_author(lib, "supplier#000000003"), cte("SELECT id, title FROM lib_live d WHERE EXISTS (SELECT 1 FROM lib_document_authors da JOIN lib_authors a ON a.id = da.author_id WHERE da.document_id = d.id AND lower(trim(coalesce(given, '') || ' ' || family)) = 'supplier#000000003')")),
    "smart_rule": (lambda lib: catalog.smart_rule(lib, [{"kind": "untagged"}, {"kind": "year_gte", "value": 1998}, {"kind": "text", "value": "Low"}]), cte("SELECT id, title, year FROM lib_live d WHERE NOT EXISTS (SELECT 1 FROM lib_document_tags t WHERE t.document_id = d.id) AND year >= 1998 AND lower(title) LIKE '%low%'")),
    "trash": (lambda lib: lib.documents.where("deleted_at IS NOT NULL").select("id", "title", "deleted_at"), cte("SELECT id, title, deleted_at FROM lib_documents WHERE deleted_at IS NOT NULL")),
    "thin_metadata": (lambda lib: catalog.thin_metadata(lib), cte("SELECT id FROM lib_live d WHERE title IS NULL OR trim(title) = '' OR year IS NULL OR NOT EXISTS (SELECT 1 FROM lib_document_authors a WHERE a.document_id = d.id)")),
    "recent_documents": (lambda lib: lib.live.where("last_opened_at IS NOT NULL").select("id", "title", "last_opened_at").orderBy(F.desc("last_opened_at"), "id").limit(30), cte("SELECT id, title, last_opened_at FROM lib_live WHERE last_opened_at IS NOT NULL ORDER BY last_opened_at DESC, id LIMIT 30")),
    "multi_key_sort": (lambda lib: catalog.sorted_by(lib.live.select("id", "favorite", "venue", "year"), [("favorite", True), ("venue", False), ("year", True)]).limit(100), cte("SELECT id, favorite, venue, year FROM lib_live ORDER BY favorite DESC, coalesce(venue, ''), coalesce(year, 0) DESC, id LIMIT 100")),
    "home_counters": (lambda lib: catalog.home_counters(lib, "1998-05-01"), cte("SELECT count_if(path NOT LIKE 'ref:%' AND NOT is_read) AS unread_pdf, count_if(NOT is_read AND last_page > 1) AS reading, count_if(date_trunc('month', added_at) = TIMESTAMP '1998-05-01') AS added FROM lib_live")),
    "health_report": (
        lambda lib: catalog.health(lib, lib.documents.where("id % 9 <> 0").select("path"), lib.table("documents").select(F.col("doc_id").alias("id"), "text"), lib.documents.where("id % 4 <> 3").select("id")),
        cte("""WITH p AS (SELECT * FROM lib_live WHERE path NOT LIKE 'ref:%'), h AS (SELECT file_hash FROM lib_live GROUP BY 1 HAVING count(*) > 1)
            SELECT 'missing_file' AS issue, id FROM p WHERE id % 9 = 0 UNION ALL SELECT 'no_text', id FROM p WHERE id NOT IN (SELECT doc_id FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')
            UNION ALL SELECT 'no_metadata', id FROM lib_live WHERE year IS NULL AND venue IS NULL AND id NOT IN (SELECT document_id FROM lib_document_authors)
            UNION ALL SELECT 'no_embedding', id FROM lib_live WHERE id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'no_thumbnail', id FROM p WHERE id % 4 = 3
            UNION ALL SELECT 'duplicate', id FROM lib_live WHERE file_hash IN (SELECT file_hash FROM h)"""),
    ),
    "dup_by_hash": (lambda lib: catalog.content_classes(lib.live), cte("SELECT id, min(id) OVER (PARTITION BY file_hash) AS class, count(*) OVER (PARTITION BY file_hash) AS n FROM lib_live QUALIFY n > 1")),
    "annotation_counts": (lambda lib: lib.annotations.groupBy("document_id").agg(F.count("*").alias("n")), cte("SELECT document_id, count(*) AS n FROM lib_annotations GROUP BY 1")),
    "daily_pick": (lambda lib: catalog.daily_pick(lib, 12345), cte("SELECT id, title FROM (SELECT id, title, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM lib_live WHERE NOT is_read) WHERE k = 12345 % n")),
    "backup_keep_newest": (lambda lib: lib.watch_hits.select("id", "watch", "found_at", F.expr("row_number() OVER (PARTITION BY watch ORDER BY found_at DESC, id DESC)").alias("k")).where("k <= 5").select("id", "watch"), cte("SELECT id, watch FROM (SELECT id, watch, row_number() OVER (PARTITION BY watch ORDER BY found_at DESC, id DESC) AS k FROM lib_watch_hits) WHERE k <= 5")),
    "palette_search": (lambda lib: palette.search(lib.live.select(F.coalesce("venue", F.lit("")).alias("section"), "id", "title", F.lit(None).cast("string").alias("keywords")), "Sty mtd 4"), None),
    # citations
    "snowball_trees": (grown, cte(f"{SNOWBALL} SELECT seed, CAST(hop AS INT) AS hop, place, id, parent, direction FROM tr")),
    "snowball_pruned": (
        pruned,
        cte(f"{SNOWBALL}, g1 AS (SELECT seed, id FROM t1 WHERE place = 1), g2 AS (SELECT t2.seed, t2.id FROM t2 JOIN g1 ON g1.seed = t2.seed AND g1.id = parent), g3 AS (SELECT t3.seed, t3.id FROM t3 JOIN g2 ON g2.seed = t3.seed AND g2.id = parent) SELECT seed, CAST(hop AS INT) AS hop, id FROM tr WHERE (seed, id) NOT IN (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3)"),
    ),
    "citation_out": (lambda lib: citations.outgoing(lib), cte(f"WITH {GAPS} SELECT DISTINCT refs.document_id, refs.doi, cited_id FROM refs LEFT JOIN own USING (doi)")),
    "cited_by": (lambda lib: citations.cited_by(lib), cte(f"WITH {GAPS} SELECT cited_id, count(DISTINCT document_id) AS n FROM refs JOIN own USING (doi) GROUP BY 1")),
    "citation_gaps": (lambda lib: citations.gaps(lib, 100), cte(f"WITH {GAPS} SELECT doi, count(DISTINCT document_id) AS n, min(raw) AS sample FROM refs WHERE doi NOT IN (SELECT doi FROM own) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")),
    "reading_path": (
        lambda lib: citations.reading_path(lib, 5),
        cte(f"""WITH {GAPS}, mine AS (SELECT DISTINCT refs.doi, cited_id FROM refs LEFT JOIN own USING (doi) WHERE document_id = 5),
        m AS (SELECT 'missing' AS leg, count(DISTINCT r.document_id) AS rank, CAST(NULL AS BIGINT) AS id, lower(r.ref_doi) AS doi FROM lib_references r WHERE lower(r.ref_doi) IN (SELECT doi FROM mine WHERE cited_id IS NULL) GROUP BY 4 ORDER BY 2 DESC, 4 LIMIT 5)
        SELECT 'owned' AS leg, CAST(coalesce(year, 9999) AS BIGINT) AS rank, cited_id AS id, mine.doi FROM mine JOIN lib_live d ON d.id = cited_id UNION ALL SELECT * FROM m"""),
    ),
    # the tree of collections
    "subtree": (lambda lib: hierarchy.subtree(lib.collections, REGION), cte(f"WITH down(id) AS (SELECT id FROM lib_collections WHERE id = {REGION} UNION ALL SELECT c.id FROM lib_collections c JOIN down d ON c.parent_id = d.id) SELECT id FROM down", True)),
    "subtree_counts": (lambda lib: hierarchy.subtree_counts(lib.collections, lib.members), cte(f"WITH {UP}, dir AS (SELECT collection_id AS id, count(*) AS n FROM lib_members GROUP BY 1), tot AS (SELECT ancestor AS id, CAST(sum(n) AS BIGINT) AS n FROM up JOIN dir USING (id) GROUP BY 1) SELECT c.id, coalesce(dir.n, 0) AS direct, coalesce(tot.n, 0) AS total FROM lib_collections c LEFT JOIN dir USING (id) LEFT JOIN tot USING (id)", True)),
    "tree_path": (lambda lib: hierarchy.paths(lib.collections), cte(f"WITH {UP} SELECT up.id, string_agg(c.name, '/' ORDER BY distance DESC) AS path, max(distance) AS depth FROM up JOIN lib_collections c ON c.id = up.ancestor GROUP BY 1", True)),
    "breadcrumb": (lambda lib: hierarchy.ancestors(lib.collections).where(F.col("id") == CUSTOMER + 3).select("ancestor", "distance"), cte(f"WITH {UP} SELECT ancestor, distance FROM up WHERE id = {CUSTOMER + 3}", True)),
    "legal_move": (lambda lib: hierarchy.may_move(lib.collections, lib.collections.select(F.col("parent_id").alias("id"), F.col("id").alias("target")).where("id IS NOT NULL").unionByName(lib.collections.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("target")))), cte("SELECT parent_id AS id, id AS target, false AS allowed FROM lib_collections WHERE parent_id IS NOT NULL UNION ALL SELECT id, parent_id, true FROM lib_collections WHERE parent_id IS NOT NULL")),
    "depth_first": (
        lambda lib: hierarchy.depth_first(lib.collections),
        cte("WITH walk(id, depth, key) AS (SELECT id, 0, '/' || lower(name) || lpad(CAST(id AS VARCHAR), 12, '0') FROM lib_collections WHERE parent_id IS NULL UNION ALL SELECT c.id, w.depth + 1, w.key || '/' || lower(c.name) || lpad(CAST(c.id AS VARCHAR), 12, '0') FROM lib_collections c JOIN walk w ON c.parent_id = w.id) SELECT id, depth, row_number() OVER (ORDER BY key) AS position FROM walk", True),
    ),
    "delete_collection": (lambda lib: hierarchy.delete_collection(lib.collections, NATION + 2), cte(f"SELECT c.id, c.name, CASE WHEN c.parent_id = {NATION + 2} THEN (SELECT parent_id FROM lib_collections WHERE id = {NATION + 2}) ELSE c.parent_id END AS parent_id FROM lib_collections c WHERE c.id <> {NATION + 2}")),
    "collection_documents": (lambda lib: lib.members.join(lib.live.select(F.col("id").alias("document_id"), "title"), "document_id").join(lib.collections.select(F.col("id").alias("collection_id"), "name"), "collection_id").select("collection_id", "name", "document_id", "title"), cte("SELECT m.collection_id, c.name, m.document_id, d.title FROM lib_members m JOIN lib_live d ON d.id = m.document_id JOIN lib_collections c ON c.id = m.collection_id")),
    "folder_files": (lambda lib: folders.projection(lib), cte(f"WITH {FILES.format('', 'lib_members')} SELECT * FROM files")),
    "folder_changes": (
        lambda lib: folders.changes(folders.projection(Earlier.of(lib.spark, lib.folder)), folders.projection(lib)),
        cte(f"WITH {FILES.format('', 'lib_members')}, old_members AS (SELECT * FROM lib_members WHERE document_id % 7 <> 0), {FILES.format('old_', 'old_members')} SELECT 'remove' AS action, * FROM (SELECT folder, name, source FROM old_files EXCEPT ALL SELECT folder, name, source FROM files) UNION ALL SELECT 'make', * FROM (SELECT folder, name, source FROM files EXCEPT ALL SELECT folder, name, source FROM old_files)"),
    ),
    "folders_to_make": (
        lambda lib: folders.folder_changes(folders.projection(Earlier.of(lib.spark, lib.folder)), folders.projection(lib)),
        cte(f"WITH {FILES.format('', 'lib_members')}, old_members AS (SELECT * FROM lib_members WHERE document_id % 7 <> 0), {FILES.format('old_', 'old_members')}, {EVERY.format('')}, {EVERY.format('old_')} SELECT 'remove' AS action, folder FROM old_every WHERE folder NOT IN (SELECT folder FROM every) UNION ALL SELECT 'make', folder FROM every WHERE folder NOT IN (SELECT folder FROM old_every)"),
    ),
    "suffix_disambiguation": (lambda lib: folders.numbered_names(lib.live.select(F.coalesce("venue", F.lit("")).alias("folder"), F.col("title").alias("name"), "id")).select("folder", "id", "shown"), cte("SELECT coalesce(venue, '') AS folder, id, CASE WHEN row_number() OVER (PARTITION BY coalesce(venue, ''), title ORDER BY id) = 1 THEN title ELSE title || ' (' || row_number() OVER (PARTITION BY coalesce(venue, ''), title ORDER BY id) || ')' END AS shown FROM lib_live")),
    # keys and formats
    "citekeys": (
        lambda lib: bibliography.assigned_keys(citation_items(lib).where("citekey IS NULL OR trim(citekey) = ''").select("id", "year", "title", F.get("authors", 0)["family"].alias("family")), lib.documents),
        cte("""WITH f AS (SELECT document_id, family FROM (SELECT da.document_id, a.family, row_number() OVER (PARTITION BY document_id ORDER BY position, author_id) AS k FROM lib_document_authors da JOIN lib_authors a ON a.id = da.author_id) WHERE k = 1),
        b AS (SELECT d.id, regexp_replace(lower(f.family), '[^a-z0-9]', '', 'g') || coalesce(CAST(year AS VARCHAR), '') || 'study' AS base FROM lib_live d JOIN f ON f.document_id = d.id WHERE citekey IS NULL OR trim(citekey) = ''),
        n AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) - 1 AS n FROM b)
        SELECT id, base || CASE WHEN n = 0 THEN '' WHEN n < 25 THEN chr(CAST(97 + n AS INT)) ELSE CAST(n + 1 AS VARCHAR) END AS key FROM n"""),
    ),
    "ieee_list": (
        lambda lib: (lambda d: d.select("id", bibliography.ieee(F.col("number"), d).alias("ieee")))(bibliography.numbered(citation_items(lib))),
        None,
    ),
    "cited_together": (
        lambda lib: bibliography.cited_together(lib.members.join(lib.live.where("citekey IS NOT NULL").select(F.col("id"), F.col("citekey").alias("key")), F.col("document_id") == F.col("id")).select("collection_id", "id", "key"), "collection_id"),
        cte("""SELECT m.collection_id, '\\cite{' || string_agg(d.citekey, ',' ORDER BY d.id) || '}' AS latex, '[' || string_agg('@' || d.citekey, '; ' ORDER BY d.id) || ']' AS pandoc
        FROM lib_members m JOIN lib_live d ON d.id = m.document_id WHERE d.citekey IS NOT NULL GROUP BY 1"""),
    ),
    "citation_formats": (formats, FORMATS_SQL),
    "csl_json": (lambda lib: (lambda d: d.select("id", bibliography.csl(F.coalesce("citekey", F.concat(F.lit("doc"), F.col("id").cast("string"))), d).alias("csl")))(citation_items(lib)), None),
    "headless_bibtex": (lambda lib: (lambda d: d.select("id", bibliography.plain_bibtex(d).alias("bibtex")))(citation_items(lib)), None),
}
