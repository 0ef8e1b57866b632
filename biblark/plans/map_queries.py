"""Registered queries over the map, suggestions for collections, reading paths and counters, and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.operators import catalog, citations, maps, notes, retrieval, vectors
from biblark.plans.library import Library, cte
from biblark.plans.retrieval_queries import EDGES, LINE, PASSAGES, WORDS, docs, edges, embedded, page_passages
from biblark.plans.title_queries import FOLDED

WEIGHT, BEST, FLOOR, SEED = 0.3, 5, 0.05, 20240501


def clusters(lib: Library) -> DataFrame:
    return embedded(lib).select("id", F.col("label").alias("community"))


def places(lib: Library) -> DataFrame:
    """Two components of each vector as a place."""
    at = lambda k: F.get("embedding", k).cast("double")
    return embedded(lib).select("id", at(0).alias("x"), at(1).alias("y"))


def start_places(lib: Library) -> DataFrame:
    """Every document and note: some with saved places, some on a plane, some with similar documents only, some alone."""
    i = F.col("id")
    ties = edges(lib)
    said = lib.notes.select((-i - 1).alias("a"), (i % 700).alias("b"), F.lit(0.5).alias("weight"))
    half = lambda n, m: F.when(i % 3 == 0, (i % n - m) / 10).otherwise(0.0)
    papers = docs(lib).select("id").join(vectors.degrees(ties), "id", "left").select("id", F.lit("doc").alias("kind"), F.coalesce("degree", F.lit(0)).alias("degree"), F.when(i % 10 == 0, i.cast("double")).alias("sx"), F.when(i % 10 == 0, -2.0 * i).alias("sy"), half(7, 3).alias("px"), half(5, 2).alias("py"))
    written = lib.notes.select((-i - 1).alias("id"), F.lit("note").alias("kind"), F.lit(1).cast("long").alias("degree"), F.lit(None).cast("double").alias("sx"), F.lit(None).cast("double").alias("sy"), F.lit(0.0).alias("px"), F.lit(0.0).alias("py"))
    return maps.starts(papers.unionByName(written), ties.unionByName(said))


def filed(lib: Library) -> DataFrame:
    """The even vectors in groups by label; the odd ones are in none."""
    return embedded(lib).where("id % 2 = 0").select(F.col("label").cast("long").alias("group"), "id")


def held(lib: Library) -> DataFrame:
    return embedded(lib).select("id", F.col("embedding").alias("v"))


def about(lib: Library, content: bool, name: bool) -> DataFrame:
    """What the groups are about; a group's name is the two first words of the document with its number."""
    inside = filed(lib).join(held(lib), "id").select("group", "v")
    names = docs(lib).where("id < 10").select(F.col("id").alias("group"), F.array_join(F.slice(retrieval.terms(F.col("text")), 1, 2), " ").alias("name"))
    by_name = vectors.name_vectors(retrieval.postings(docs(lib), "id", "text"), names, held(lib)) if name else None
    return vectors.mixed(vectors.centroids(inside, "group", "v") if content else None, by_name, WEIGHT)


def suggestions(lib: Library, content: bool, name: bool, only_unfiled: bool) -> DataFrame:
    return vectors.suggested(held(lib), filed(lib), about(lib, content, name), BEST, only_unfiled)


def close_hits(lib: Library) -> DataFrame:
    """Hits for groups by label, and for one that has no members."""
    hits = embedded(lib).where("id % 2 = 1").select("id", F.when(F.col("id") % 50 == 1, 99).otherwise(F.col("label")).cast("long").alias("group"), F.col("embedding").alias("v"))
    return vectors.by_meaning(hits, filed(lib), held(lib), FLOOR).select("id", "group")


def reading(lib: Library) -> DataFrame:
    return citations.reading_paths(lib, lib.live.where("id % 100 = 0").select("id"), edges(lib))


def dated_notes(lib: Library) -> DataFrame:
    i = F.col("id")
    return lib.notes.select("id", "title", F.timestamp_seconds(i % 50).alias("created_at"), F.when(i % 3 != 0, F.timestamp_seconds(i % 20)).alias("updated_at"))


def centre_sql(name: str, rows: str) -> str:
    """``rows``: grp, id."""
    return f"{name} AS (SELECT grp, list(v ORDER BY i) AS c FROM (SELECT grp, i, avg(v) AS v FROM (SELECT grp, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM ({rows}) JOIN embeddings ON vec_id = id) GROUP BY 1, 2) GROUP BY 1)"


STOP = ", ".join(f"'{w}'" for w in T.TITLE_STOP)
TITLES = f"""tw AS (SELECT doc_id AS id, unnest(list_distinct(list_filter(regexp_split_to_array({FOLDED.format(LINE)}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 4 AND x NOT IN ({STOP})))) AS word FROM documents),
    df AS (SELECT word, count(*) AS df FROM tw GROUP BY 1),
    tf AS (SELECT label AS community, word, count(*) AS tf FROM tw JOIN embeddings ON vec_id = id GROUP BY 1, 2),
    tk AS (SELECT community, word, row_number() OVER (PARTITION BY community ORDER BY round(tf * ln(1 + (SELECT count(*) FROM documents) / df), 6) DESC, word) AS k FROM tf JOIN df USING (word) QUALIFY k <= 3)"""
CONTENT = centre_sql("cv", "SELECT label AS grp, vec_id AS id FROM embeddings WHERE vec_id % 2 = 0")
NAMES = f"""dt AS (SELECT doc_id, {WORDS} AS t FROM documents),
    nm AS (SELECT doc_id AS grp, unnest(list_distinct(t[1:2])) AS term, len(list_distinct(t[1:2])) AS k FROM dt WHERE doc_id < 10),
    ht AS (SELECT grp, doc_id AS id FROM nm JOIN (SELECT doc_id, unnest(list_distinct(t)) AS term FROM dt) USING (term) GROUP BY grp, doc_id, k HAVING count(*) = k),
    {centre_sql("nv", "SELECT * FROM ht")}"""
COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), {}.c)"


def suggested_sql(score: str, tables: str, test: str) -> str:
    return f"""SELECT * FROM (SELECT CAST(grp AS BIGINT) AS "group", vec_id AS id, round(greatest(0, least(1, {score})), 6) AS score FROM embeddings, {tables} WHERE {test})
        QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY score DESC, id) <= {BEST}"""


RING = "struct_pack(x := {1} * cos({0}), y := {1} * sin({0}))"
STARTS = f"""WITH {EDGES},
    dg AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1),
    nd AS (SELECT doc_id AS id, 'doc' AS kind, coalesce(degree, 0) AS degree, CASE WHEN doc_id % 10 = 0 THEN CAST(doc_id AS DOUBLE) END AS sx, CASE WHEN doc_id % 10 = 0 THEN -2e0 * doc_id END AS sy,
            CASE WHEN doc_id % 3 = 0 THEN (doc_id % 7 - 3) / 10e0 ELSE 0e0 END AS px, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 5 - 2) / 10e0 ELSE 0e0 END AS py FROM documents LEFT JOIN dg ON id = doc_id
        UNION ALL SELECT -id - 1, 'note', 1, NULL, NULL, 0e0, 0e0 FROM lib_notes),
    c AS (SELECT count(*) AS total, count(*) FILTER (degree = 0) AS alone, greatest(180e0, 30e0 * sqrt(count(*))) AS spread FROM nd),
    h AS (SELECT nd.*, c.*, CASE WHEN sx IS NOT NULL THEN 'saved' WHEN kind = 'note' THEN 'note' WHEN px <> 0 OR py <> 0 THEN 'plane' WHEN degree > 0 THEN 'spiral' ELSE 'ring' END AS how FROM nd, c),
    k AS (SELECT *, row_number() OVER (PARTITION BY how ORDER BY id) - 1 AS i FROM h),
    f AS (SELECT id, how, spread, CASE how WHEN 'saved' THEN struct_pack(x := sx, y := sy) WHEN 'plane' THEN struct_pack(x := px * spread * 2.2e0 + (id % 13 - 6) * 2.2e0, y := py * spread * 2.2e0 + (id % 7 - 3) * 2.2e0)
        WHEN 'spiral' THEN {RING.format("(i * pi() * (3 - sqrt(5e0)))", "spread * sqrt((i + 0.5e0) / greatest(1, total - alone))")} WHEN 'ring' THEN {RING.format("(i / greatest(1, alone) * 2 * pi() + 0.4e0)", "(spread + 130)")} END AS p FROM k),
    w AS (SELECT f.id, g.p AS q FROM f JOIN f g ON f.how = 'note' AND g.id = (-f.id - 1) % 700 AND g.p IS NOT NULL),
    z AS (SELECT f.id, f.how, CASE WHEN f.how <> 'note' THEN p WHEN q IS NOT NULL THEN struct_pack(x := q.x + 46 * cos(radians((-f.id * 61) % 360)), y := q.y + 46 * sin(radians((-f.id * 61) % 360)))
        ELSE {RING.format("((-f.id) % 97 / 97e0 * 2 * pi())", "(spread + 170)")} END AS p FROM f LEFT JOIN w ON w.id = f.id)
    SELECT id, how, round(p.x, 6) AS x, round(p.y, 6) AS y FROM z"""
READING = f"""WITH {EDGES},
    o AS (SELECT DISTINCT r.document_id, lower(r.ref_doi) AS doi, d.id AS cited_id FROM lib_references r JOIN lib_live l ON l.id = r.document_id LEFT JOIN lib_live d ON lower(d.doi) = lower(r.ref_doi)),
    m AS (SELECT * FROM o WHERE document_id % 100 = 0),
    own AS (SELECT m.document_id, m.cited_id AS id, m.doi, coalesce(d.year, 9999) AS k FROM m JOIN lib_live d ON d.id = m.cited_id WHERE m.cited_id <> m.document_id),
    near AS (SELECT x.s AS document_id, x.t AS id, NULL AS doi, -weight AS k FROM (SELECT a AS s, b AS t, weight FROM e UNION ALL SELECT b, a, weight FROM e) x JOIN lib_live sd ON sd.id = x.s JOIN lib_live td ON td.id = x.t
        WHERE x.s % 100 = 0 AND td.year < sd.year AND (x.s, x.t) NOT IN (SELECT document_id, id FROM own)),
    lack AS (SELECT document_id, NULL AS id, doi, -n AS k FROM (SELECT DISTINCT document_id, doi FROM m WHERE cited_id IS NULL) JOIN (SELECT doi, count(DISTINCT document_id) AS n FROM o GROUP BY 1) USING (doi)),
    s AS (SELECT 1 AS l, 'foundation' AS leg, 'cited and in the library' AS reason, * FROM own UNION ALL SELECT 2, 'neighbour', 'earlier and close in content', * FROM near UNION ALL SELECT 3, 'missing', 'cited, not in the library', * FROM lack),
    q AS (SELECT *, row_number() OVER (PARTITION BY document_id, l ORDER BY k, id, doi) AS n FROM s QUALIFY l = 1 OR n <= 5)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY l, n) AS place, leg, reason, CAST(id AS BIGINT) AS id, doi FROM q"""
PICK = f"-ln((CAST('0x' || substr(md5('{SEED}:' || id), 1, 12) AS BIGINT) + 0.5e0) / 281474976710656e0) / (1e0 + CASE WHEN is_read THEN 0 ELSE 2 END + CASE WHEN last_page = 0 THEN 1.5e0 ELSE 0 END + CASE WHEN favorite THEN 0.5e0 ELSE 0 END)"
COUNTERS = f"""WITH {PASSAGES} SELECT 'docs' AS counter, count(*) AS n FROM lib_live UNION ALL SELECT 'trash', count(*) FROM lib_documents WHERE deleted_at IS NOT NULL UNION ALL SELECT 'refs_only', count(*) FROM lib_live WHERE path LIKE 'ref:%'
    UNION ALL SELECT 'embedded', count(*) FROM embeddings UNION ALL SELECT 'notes', count(*) FROM lib_notes UNION ALL SELECT 'collections', count(*) FROM lib_collections
    UNION ALL SELECT 'rag_docs', count(DISTINCT document_id) FROM ps UNION ALL SELECT 'rag_chunks', count(*) FROM ps UNION ALL SELECT 'watches', count(DISTINCT watch) FROM lib_watch_hits"""
RECORD = """'{' || chr(10) || '  "id": ' || id || ',' || chr(10) || '  "title": "' || title || '",' || chr(10) || '  "year": ' || coalesce(CAST(year AS VARCHAR), 'null') || ',' || chr(10) || '  "venue": ' || coalesce('"' || venue || '"', 'null') || ',' || chr(10) || '  "favorite": ' || favorite || chr(10) || '}'"""

QUERIES = {
    "cluster_labels": (lambda lib: maps.labels(clusters(lib), docs(lib).select("id", "title")), f"WITH {TITLES} SELECT e.label AS community, count(DISTINCT vec_id) AS size, coalesce((SELECT string_agg(word, ', ' ORDER BY k) FROM tk WHERE tk.community = e.label), '') AS label FROM embeddings e GROUP BY e.label"),
    "cluster_halos": (lambda lib: maps.halos(places(lib), clusters(lib)), "WITH p AS (SELECT label AS community, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), m AS (SELECT community, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM p GROUP BY 1) SELECT community, n, round(mx, 6) AS x, round(my, 6) AS y, round(max(sqrt((p.x - mx) * (p.x - mx) + (p.y - my) * (p.y - my))), 6) AS radius FROM p JOIN m USING (community) WHERE n >= 3 GROUP BY community, n, mx, my"),
    "graph_years": (lambda lib: maps.years(edges(lib), lib.live), cte(f"WITH {EDGES} SELECT count(*) AS nodes, min(year) AS least_year, max(year) AS greatest_year FROM lib_live WHERE id IN (SELECT a FROM e UNION SELECT b FROM e)")),
    "map_starts": (start_places, cte(STARTS)),
    "suggest_content": (lambda lib: suggestions(lib, True, False, False), f"WITH {CONTENT} {suggested_sql(COSINE.format('cv'), 'cv', 'NOT (vec_id % 2 = 0 AND label = grp)')}"),
    "suggest_name": (lambda lib: suggestions(lib, False, True, True), f"WITH {NAMES} {suggested_sql(COSINE.format('nv'), 'nv', 'vec_id % 2 = 1')}"),
    "suggest_both": (lambda lib: suggestions(lib, True, True, True), f"WITH {CONTENT}, {NAMES} {suggested_sql(f'{WEIGHT}e0 * ' + COSINE.format('cv') + f' + {1 - WEIGHT}e0 * ' + COSINE.format('nv'), 'cv JOIN nv USING (grp)', 'vec_id % 2 = 1')}"),
    "novelty_by_meaning": (close_hits, f"WITH {CONTENT}, h AS (SELECT vec_id AS id, embedding, CASE WHEN vec_id % 50 = 1 THEN 99 ELSE label END AS g FROM embeddings WHERE vec_id % 2 = 1) SELECT id, CAST(g AS BIGINT) AS \"group\" FROM h LEFT JOIN cv ON grp = g WHERE c IS NULL OR {COSINE.format('cv')} >= {FLOOR}"),
    "reading_paths": (reading, cte(READING)),
    "weighted_pick": (lambda lib: catalog.weighted_pick(lib.live, SEED), cte(f"SELECT id, title FROM lib_live ORDER BY {PICK}, id LIMIT 1")),
    "filing_counts": (lambda lib: catalog.filing_counts(lib), cte("WITH f AS (SELECT DISTINCT * FROM lib_members WHERE document_id IN (SELECT id FROM lib_live)) SELECT 'collection' AS kind, id, (SELECT count(*) FROM f WHERE collection_id = c.id) AS n FROM lib_collections c UNION ALL SELECT 'unfiled', NULL, count(*) FROM lib_live WHERE id NOT IN (SELECT document_id FROM f) UNION ALL SELECT 'total', NULL, count(*) FROM lib_live")),
    "snapshot_all": (lambda lib: notes.snapshot(lib, page_passages(lib)), cte(COUNTERS, True)),
    "notes_sorted": (lambda lib: notes.sorted_notes(dated_notes(lib)).select("id", "title"), cte("SELECT id, title FROM lib_notes ORDER BY CASE WHEN id % 3 <> 0 THEN id % 20 END DESC NULLS LAST, lower(title), id")),
    "json_records": (lambda lib: lib.live.select("id", catalog.pretty_json(F.struct("id", "title", "year", "venue", "favorite")).alias("json")), cte(f"SELECT id, {RECORD} AS json FROM lib_live")),
}
