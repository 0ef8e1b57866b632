"""Registered queries about duplicates, imports, merges and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblark.operators import catalog, identity
from biblark.plans.library import Library, cte


def arriving(lib: Library) -> DataFrame:
    """Files that come in: known paths, known contents, new ones."""
    o = F.col("o_orderkey")
    return lib.table("orders").where("o_orderkey % 3 = 0").select(F.when(o % 2 == 0, F.concat(F.lit("/library/"), o.cast("string"), F.lit(".pdf"))).otherwise(F.concat(F.lit("/inbox/"), o.cast("string"), F.lit(".pdf"))).alias("path"), F.sha2((o % 9000).cast("string"), 256).alias("file_hash"))


ARRIVING = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN '/library/' || o_orderkey || '.pdf' ELSE '/inbox/' || o_orderkey || '.pdf' END AS path, sha256(CAST(o_orderkey % 9000 AS VARCHAR)) AS file_hash FROM orders WHERE o_orderkey % 3 = 0"


def found(lib: Library) -> DataFrame:
    """Recorded answers of two sources for each document."""
    d = lib.live
    a = d.select("id", F.lit("title").alias("source"), F.lit(1).alias("rank"), F.when(F.col("id") % 2 == 0, F.upper("title")).otherwise(F.lit("Another work about quite different things")).alias("title"), F.concat(F.lit("10.2000/a"), F.col("id").cast("string")).alias("doi"))
    b = d.where("id % 5 = 0").select("id", F.lit("s2").alias("source"), F.lit(1).alias("rank"), "title", F.concat(F.lit("10.2000/b"), F.col("id").cast("string")).alias("doi"))
    return a.unionByName(b)


def taken(lib: Library) -> DataFrame:
    """The recorded answers; every seventh names a DOI that another document may hold."""
    held = F.concat(F.lit("10.1000/"), (F.col("id") - F.col("id") % 3 + 3).cast("string"))
    return found(lib).withColumn("doi", F.when((F.col("id") % 7 == 0) & (F.col("source") == "title"), held).otherwise(F.col("doi")))


def merged_tags(lib: Library) -> DataFrame:
    groups = catalog.content_classes(lib.live).select("id", F.col("class").alias("group"))
    _, bridges = identity.merged(lib.documents, {"tags": lib.document_tags}, groups)
    return bridges["tags"].groupBy("document_id").agg(F.count("*").alias("n"))


def purged_tags(lib: Library) -> DataFrame:
    docs, bridges = identity.purged(lib.documents, {"tags": lib.document_tags}, lib.documents.where("id % 2 = 0").select("id"))
    return docs.agg(F.count("*").alias("documents")).join(F.broadcast(bridges["tags"].agg(F.count("*").alias("links"))))


def claimed(lib: Library) -> DataFrame:
    docs = lib.documents
    claims = docs.where("deleted_at is null and id % 100 = 1").select("id", F.concat(F.lit("10.1000/"), ((F.col("id") * 13) % 6000).cast("string")).alias("doi"))
    return identity.doi_owners(docs, claims).where("doi is not null").select("id", "doi")


HASHES = "SELECT file_hash, min(id) AS m FROM lib_live GROUP BY 1"
QUERIES = {
    "existing_documents": (
        lambda lib: identity.existing(lib.documents, arriving(lib)),
        cte(f"WITH a AS ({ARRIVING}) SELECT path, file_hash, coalesce((SELECT min(id) FROM lib_documents d WHERE d.path = a.path), (SELECT min(id) FROM lib_documents d WHERE d.file_hash = a.file_hash)) AS existing_id FROM a"),
    ),
    "import_decisions": (
        lambda lib: identity.import_decisions(lib.documents, arriving(lib)),
        cte(
            f"""WITH a AS ({ARRIVING}), p AS (SELECT path, min(id) AS ap, min(id) FILTER (deleted_at IS NULL) AS lp, min(id) FILTER (deleted_at IS NOT NULL) AS gp FROM lib_documents GROUP BY 1),
            h AS (SELECT file_hash, min(id) AS ah, min(id) FILTER (deleted_at IS NULL) AS lh, min(id) FILTER (deleted_at IS NOT NULL) AS gh FROM lib_documents GROUP BY 1),
            x AS (SELECT a.*, ap, lp, gp, ah, lh, gh, min(a.path) OVER (PARTITION BY a.file_hash) AS fp FROM a LEFT JOIN p USING (path) LEFT JOIN h USING (file_hash)),
            y AS (SELECT *, CASE WHEN gp IS NOT NULL THEN gp WHEN lp IS NULL AND lh IS NULL THEN gh END AS back FROM x)
            SELECT path, file_hash, CASE WHEN back IS NOT NULL THEN 'restore' WHEN ap IS NOT NULL OR ah IS NOT NULL THEN 'duplicate' WHEN path = fp THEN 'new' ELSE 'duplicate' END AS decision, coalesce(back, ap, ah) AS id FROM y"""
        ),
    ),
    "duplicate_links_by_content": (
        lambda lib: identity.duplicate_links(lib.live.withColumn("title", F.lit("x"))),
        cte(f"SELECT DISTINCT h.m AS a, d.id AS b FROM lib_live d JOIN ({HASHES}) h USING (file_hash) WHERE d.id <> h.m"),
    ),
    "duplicate_groups": (
        lambda lib: identity.duplicate_groups(lib.documents.withColumn("title", F.concat(F.lit("w"), "id"))),
        cte(f"SELECT d.id, h.m AS \"group\" FROM lib_live d JOIN ({HASHES}) h USING (file_hash) WHERE d.file_hash IN (SELECT file_hash FROM lib_live GROUP BY 1 HAVING count(*) > 1)"),
    ),
    # The two above replace the titles and so read contents and DOIs only, as their SQL does; these two are the whole job.
    "duplicate_links_all": (lambda lib: identity.duplicate_links(lib.live), None),
    "duplicate_groups_all": (lambda lib: identity.duplicate_groups(lib.documents), None),
    "merge_documents": (
        merged_tags,
        cte(f"WITH h AS ({HASHES}), o AS (SELECT d.id, h.m FROM lib_live d JOIN h USING (file_hash)) SELECT document_id, count(*) AS n FROM (SELECT DISTINCT coalesce(o.m, t.document_id) AS document_id, tag_id FROM lib_document_tags t LEFT JOIN o ON o.id = t.document_id) GROUP BY 1"),
    ),
    "purge_trash": (purged_tags, cte("WITH g AS (SELECT id FROM lib_documents WHERE deleted_at IS NOT NULL AND id % 2 = 0) SELECT (SELECT count(*) FROM lib_documents WHERE id NOT IN (SELECT id FROM g)) AS documents, (SELECT count(*) FROM lib_document_tags WHERE document_id NOT IN (SELECT id FROM g)) AS links")),
    "doi_ownership": (
        claimed,
        cte(
            """WITH w AS (SELECT '10.1000/' || ((id * 13) % 6000) AS doi, min(id) AS taker FROM lib_live WHERE id % 100 = 1 GROUP BY 1),
            g AS (SELECT w.* FROM w LEFT JOIN lib_live l ON l.doi = w.doi WHERE l.id IS NULL OR l.id = w.taker)
            SELECT d.id, coalesce(n.doi, CASE WHEN h.taker IS NULL OR d.deleted_at IS NULL OR h.taker = d.id THEN d.doi END) AS doi FROM lib_documents d LEFT JOIN g n ON n.taker = d.id LEFT JOIN g h ON h.doi = d.doi
            WHERE coalesce(n.doi, CASE WHEN h.taker IS NULL OR d.deleted_at IS NULL OR h.taker = d.id THEN d.doi END) IS NOT NULL"""
        ),
    ),
    "resolve_metadata": (
        lambda lib: identity.resolved(lib.live, found(lib)).select("id", "source", "doi"),
        cte("SELECT id, CASE WHEN id % 2 = 0 THEN 'title' ELSE 's2' END AS source, CASE WHEN id % 2 = 0 THEN '10.2000/a' || id ELSE '10.2000/b' || id END AS doi FROM lib_live WHERE id % 2 = 0 OR id % 5 = 0"),
    ),
    "metadata_candidates": (
        lambda lib: identity.candidates(lib.live, taken(lib)),
        cte("""WITH f AS (SELECT id, title, id % 2 = 0 AS same, CASE WHEN id % 7 = 0 THEN '10.1000/' || (id - id % 3 + 3) ELSE '10.2000/a' || id END AS doi FROM lib_live
                UNION ALL SELECT id, title, true, '10.2000/b' || id FROM lib_live WHERE id % 5 = 0),
            h AS (SELECT lower(doi) AS doi, id AS holder FROM lib_live WHERE doi IS NOT NULL)
            SELECT f.id, f.doi, CAST(CASE WHEN same AND len(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: strlen(w) >= 4 AND w NOT IN ('study', 'methods'))) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS score, same AS sure, holder AS duplicate_of
            FROM f LEFT JOIN h ON h.doi = lower(f.doi) AND holder <> f.id"""),
    ),
    "relink_folder": (
        lambda lib: identity.relinked(lib.live, lib.documents.where("id % 2 = 0").select(F.regexp_replace("path", "^/library/", "/disk/").alias("path"), "file_hash"), "/library/", "/disk/").select("id", "path"),
        cte("SELECT id, CASE WHEN id % 2 = 0 AND path LIKE '/library/%' THEN '/disk/' || substring(path, 10) ELSE path END AS path FROM lib_live"),
    ),
}
