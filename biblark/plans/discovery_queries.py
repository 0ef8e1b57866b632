"""Answers of online catalogues, recorded from the library's own documents in each catalogue's form, read as one table; and SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblark.operators.storage import stored
from biblark.plans.library import Library, cte
from biblark.sources import records


def recorded(docs: DataFrame, answer: Column) -> DataFrame:
    return docs.select(F.to_json(answer).alias("json"))


def text(c: str) -> Column:
    return F.col(c).cast("string")


def named(*names: Column) -> Column:
    return F.array(*[F.struct(n.alias("name")) for n in names])


def answers(docs: DataFrame) -> dict[str, DataFrame]:
    """What each catalogue would say about ``docs``, an answer a document; fields that are null are left out of the JSON."""
    odd = F.col("id") % 2 == 1
    people = named(F.lit("Ann Lee"), F.concat(F.lit("Author "), text("id")))
    one = lambda item: F.array(item)
    ads = F.struct(F.struct(one(F.struct(
        F.concat(F.lit("bib"), text("id")).alias("bibcode"), F.array("title").alias("title"), F.array(F.lit("Lee, A."), F.concat(F.lit("Author "), text("id"))).alias("author"), text("year").alias("year"), F.col("venue").alias("pub"),
        F.when(F.col("doi").isNotNull(), F.array(F.concat(F.lit("https://doi.org/"), "doi"))).alias("doi"), F.col("page_count").alias("citation_count"),
        F.when(odd, F.array(F.lit("other:1"), F.concat(F.lit("arXiv:2101."), text("id")))).otherwise(F.array(F.lit("other:1"))).alias("identifier"), F.array(F.when(F.col("id") % 3 == 0, "PUB_OPENACCESS").otherwise("ARTICLE")).alias("property"),
    )).alias("docs")).alias("response"))
    scholar = F.struct(one(F.struct(
        F.concat(F.lit("p"), text("id")).alias("paperId"), "title", "year", F.coalesce("venue", F.lit("")).alias("venue"), F.col("page_count").alias("citationCount"), odd.alias("isOpenAccess"),
        F.struct(F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://x.org/"), text("id"), F.lit(".pdf"))).otherwise("").alias("url")).alias("openAccessPdf"), people.alias("authors"), F.struct(F.upper("doi").alias("DOI")).alias("externalIds"),
    )).alias("data"))
    epmc = F.struct(F.struct(one(F.struct(
        F.lit("MED").alias("source"), text("id").alias("id"), "title", F.concat(F.lit("Lee A, Author "), text("id"), F.lit(".")).alias("authorString"), text("year").alias("pubYear"), F.col("venue").alias("journalTitle"), "doi", F.col("page_count").alias("citedByCount"),
        F.when(odd, "Y").otherwise("N").alias("isOpenAccess"),
        F.struct(F.array(*[F.struct(F.lit(s).alias("documentStyle"), F.lit(a).alias("availabilityCode"), F.concat(F.lit(f"https://{h}/"), text("id")).alias("url")) for s, a, h in (("html", "OA", "h.org"), ("pdf", "S", "s.org"), ("pdf", "OA", "o.org"))]).alias("fullTextUrl")).alias("fullTextUrlList"),
    )).alias("result")).alias("resultList"))
    core = F.struct(one(F.struct("id", "title", people.alias("authors"), F.col("year").alias("yearPublished"), F.coalesce("venue", F.lit("")).alias("publisher"), "doi", F.when(odd, F.concat(F.lit("https://c.org/"), text("id"))).alias("downloadUrl"), F.col("page_count").alias("citationCount"))).alias("results"))
    link = F.concat(F.lit("https://j.org/"), text("id"), F.when(odd, ".PDF").otherwise("/view"))
    doaj = F.struct(one(F.struct(
        F.concat(F.lit("j"), text("id")).alias("id"),
        F.struct("title", people.alias("author"), text("year").alias("year"), F.struct(F.col("venue").alias("title")).alias("journal"), F.array(F.struct(F.lit("pissn").alias("type"), F.lit("1").alias("id")), F.struct(F.lit("doi").alias("type"), F.col("doi").alias("id"))).alias("identifier"), F.array(F.struct(F.lit("fulltext").alias("type"), link.alias("url"))).alias("link")).alias("bibjson"),
    )).alias("results"))
    papers = one(F.struct(F.struct(F.concat(F.lit("2101."), text("id")).alias("id"), "title", people.alias("authors"), F.concat(text("year"), F.lit("-05-01T00:00:00Z")).alias("publishedAt"), F.col("github_url").alias("githubRepo"), F.col("page_count").alias("upvotes")).alias("paper")))
    return {"ads": recorded(docs, ads), "scholar": recorded(docs, scholar), "epmc": recorded(docs, epmc), "core": recorded(docs, core), "doaj": recorded(docs, doaj), "papers": recorded(docs, papers)}


READERS = {"ads": records.astrophysics, "scholar": records.semantic_scholar, "epmc": records.europe_pmc, "core": records.core, "doaj": records.open_journals, "papers": records.papers_with_code}


def results(lib: Library) -> DataFrame:
    """All documents as six catalogues know them."""
    found = answers(lib.documents)
    return reduce(DataFrame.unionByName, [read(found[name]) for name, read in READERS.items()])


def flat(found: DataFrame) -> DataFrame:
    return found.withColumn("authors", F.array_join("authors", "; ")).drop("abstract")


def chosen(lib: Library) -> DataFrame:
    """(chip, source, external_id) of what each chip, and two together, leave."""
    found = stored(results(lib).select("source", "external_id", "code_url", "pub_status"), "results")
    asked = {"code": {"code": True}, "reviewed": {"reviewed": True}, "preprints": {"preprints": True}, "both": {"reviewed": True, "preprints": True}}
    parts = [records.chips(found, **how).select(F.lit(name).alias("chip"), "source", "external_id") for name, how in asked.items()]
    return reduce(DataFrame.unionByName, parts)


def books(lib: Library) -> DataFrame:
    """(kind, key, title, authors, year, venue): every part of the library as a book and as a summary of a paper."""
    d = lib.documents
    people = named(F.lit("Ann Mary Lee"), F.concat(F.lit("Author"), text("id")))
    book = F.create_map(F.concat(F.lit("ISBN:"), text("id")), F.struct("title", people.alias("authors"), named(F.col("venue")).alias("publishers"), F.concat(F.lit("May 3, "), text("year")).alias("publish_date")))
    paper = F.struct(F.struct("title", people.alias("authors"), F.col("venue").alias("source"), F.concat(text("year"), F.lit(" Jan")).alias("pubdate")))
    summary = F.concat(F.lit('{"result":{"uids":["'), text("id"), F.lit('"],"'), text("id"), F.lit('":'), F.regexp_extract(F.to_json(paper), r"(?s)^\{[^:]*:(.*)\}$", 1), F.lit("}}"))
    a = records.books(recorded(d, book)).select(F.lit("isbn").alias("kind"), F.col("isbn").alias("key"), "title", "authors", "year", "venue")
    b = records.pubmed(d.select(summary.alias("json"))).select(F.lit("pmid").alias("kind"), F.col("pmid").alias("key"), "title", "authors", "year", "venue")
    people_of = F.array_join(F.transform("authors", lambda p: F.concat_ws("|", p["family"], p["given"])), "; ")
    return a.unionByName(b).withColumn("authors", people_of)


def copies(lib: Library) -> DataFrame:
    """Open copies of all documents with a DOI: at the best place, or at another one."""
    d = lib.documents.where("doi is not null")
    at = lambda name: F.concat(F.lit("https://u.org/"), text("id"), F.lit(name))
    best = F.when(F.col("id") % 5 < 2, F.struct(F.when(F.col("id") % 5 == 0, at(".pdf")).alias("url_for_pdf"), at("").alias("url")))
    others = F.array(F.struct(F.lit(None).cast("string").alias("url_for_pdf")), F.struct(F.when(F.col("id") % 5 < 4, at("/other.pdf")).alias("url_for_pdf")))
    return records.open_copies(recorded(d, F.struct(F.upper("doi").alias("doi"), best.alias("best_oa_location"), others.alias("oa_locations"))))


def preprints(lib: Library) -> DataFrame:
    """(id, number): the numbers of bibliography entries with marked, bare, old and foreign ones."""
    i = F.col("id")
    number = F.concat(F.lit("2103."), F.lpad((i % 100000).cast("string"), 5, "0"))
    eprint = F.when(i % 6 == 0, F.concat(F.lit("arXiv:"), number, F.lit("v2"))).when(i % 6 == 1, F.concat(number, F.lit("v3"))).when(i % 6 == 2, F.concat(F.lit("math/"), text("id"))).when(i % 6 == 3, F.concat(F.lit("hal-"), text("id"))).when(i % 6 == 4, "").otherwise(number)
    prefix = F.when(i % 5 == 0, "HAL").when(i % 5 < 3, "arXiv")
    return lib.documents.select("id", records.arxiv_of_eprint(eprint, prefix).alias("number"))


def backfilled(lib: Library) -> DataFrame:
    """(id, github_url) after documents without a repository took the first that their texts name."""
    i = F.col("id")
    body = F.when(i % 4 == 0, F.concat(F.lit("Code: https://github.com/group"), text("id"), F.lit("/tool.git). See github.com/other/one."))).when(i % 4 == 1, F.lit("see github.com/features/actions and nothing else"))
    texts = lib.documents.select("id", body.alias("fulltext"), F.when(i % 3 == 0, F.concat(F.lit("Also at github.com/lab/abs"), text("id"))).alias("abstract"))
    return records.with_repositories(lib.documents, texts).select("id", "github_url")


STATUS = "CASE WHEN {0} THEN CASE WHEN doi IS NULL THEN 'preprint' ELSE 'preprint_reviewed' END WHEN doi IS NOT NULL OR venue <> '' THEN 'published' END"
PEOPLE = "'Ann Lee; Author ' || id"
FOUND = f"""r AS (SELECT 'ads' AS source, 'bib' || id AS external_id, title, 'Lee, A.; Author ' || id AS authors, year, venue, doi, 'https://ui.adsabs.harvard.edu/abs/bib' || id AS url,
        CASE WHEN id % 2 = 1 THEN 'https://arxiv.org/pdf/2101.' || id END AS pdf_url, coalesce(page_count, 0) AS citations, id % 2 = 1 OR id % 3 = 0 AS open_access, NULL AS code_url FROM lib_documents
    UNION ALL SELECT 'semanticscholar', 'p' || id, title, {PEOPLE}, year, venue, doi, 'https://www.semanticscholar.org/paper/p' || id, CASE WHEN id % 3 = 0 THEN 'https://x.org/' || id || '.pdf' END, coalesce(page_count, 0), id % 2 = 1 OR id % 3 = 0, NULL FROM lib_documents
    UNION ALL SELECT 'europepmc', 'MED:' || id, title, 'Lee A; Author ' || id, year, venue, doi, 'https://europepmc.org/article/MED/' || id, 'https://o.org/' || id, coalesce(page_count, 0), id % 2 = 1, NULL FROM lib_documents
    UNION ALL SELECT 'core', CAST(id AS VARCHAR), title, {PEOPLE}, year, venue, doi, coalesce('https://doi.org/' || doi, CASE WHEN id % 2 = 1 THEN 'https://c.org/' || id END), CASE WHEN id % 2 = 1 THEN 'https://c.org/' || id END, coalesce(page_count, 0), id % 2 = 1, NULL FROM lib_documents
    UNION ALL SELECT 'doaj', 'j' || id, title, {PEOPLE}, year, venue, doi, 'https://j.org/' || id || CASE WHEN id % 2 = 1 THEN '.PDF' ELSE '/view' END, CASE WHEN id % 2 = 1 THEN 'https://j.org/' || id || '.PDF' END, 0, true, NULL FROM lib_documents
    UNION ALL SELECT 'huggingface', '2101.' || id, title, {PEOPLE}, year, 'arXiv · HF Papers', NULL, 'https://huggingface.co/papers/2101.' || id, 'https://arxiv.org/pdf/2101.' || id, coalesce(page_count, 0), true, github_url FROM lib_documents),
    f AS (SELECT source, external_id, title, authors, CAST(year AS BIGINT) AS year, venue, doi, url, pdf_url, CAST(citations AS BIGINT) AS citations, open_access, code_url, {STATUS.format("contains(lower(coalesce(venue, '')), 'arxiv')")} AS pub_status FROM r)"""
REVIEWED, PREPRINT = "pub_status IN ('published', 'preprint_reviewed')", "pub_status IN ('preprint', 'preprint_reviewed')"
WORKS = "CAST(id AS VARCHAR) AS key, title, 'Lee|Ann Mary; Author' || id AS authors, CAST(year AS BIGINT) AS year, venue FROM lib_documents"
NUMBER = "'2103.' || lpad(CAST(id % 100000 AS VARCHAR), 5, '0')"

QUERIES = {
    "discovery_results": (lambda lib: flat(results(lib)), cte(f"WITH {FOUND} SELECT * FROM f")),
    "discovery_chips": (chosen, cte(f"WITH {FOUND} SELECT 'code' AS chip, source, external_id FROM f WHERE code_url IS NOT NULL UNION ALL SELECT 'reviewed', source, external_id FROM f WHERE {REVIEWED} UNION ALL SELECT 'preprints', source, external_id FROM f WHERE {PREPRINT} UNION ALL SELECT 'both', source, external_id FROM f WHERE {REVIEWED} AND {PREPRINT}")),
    "discovery_sorted": (lambda lib: records.ordered(results(lib), "venue", down=True).select("source", "external_id", "venue"), cte(f"WITH {FOUND} SELECT source, external_id, venue FROM f ORDER BY lower(coalesce(venue, '')) DESC, source, external_id")),
    "discovery_in_library": (
        lambda lib: records.in_library(results(lib).select("source", "external_id", "doi"), lib.documents.withColumn("path", F.when(F.col("id") % 4 == 0, F.concat(F.lit("ref:core:"), text("id"))).otherwise(F.col("path")))).select("source", "external_id", "in_library"),
        cte(f"WITH {FOUND} SELECT source, external_id, coalesce(doi IN (SELECT doi FROM lib_live WHERE doi IS NOT NULL), false) OR (source = 'core' AND external_id IN (SELECT CAST(id AS VARCHAR) FROM lib_live WHERE id % 4 = 0)) AS in_library FROM f"),
    ),
    "discovery_filtered": (
        lambda lib: records.filtered(results(lib), year_from=1993, year_to=1996, open_access_only=True, author="lee").select("source", "external_id"),
        cte(f"WITH {FOUND} SELECT source, external_id FROM f WHERE coalesce(year BETWEEN 1993 AND 1996, true) AND open_access"),
    ),
    "recorded_works": (books, cte(f"SELECT 'isbn' AS kind, {WORKS} UNION ALL SELECT 'pmid' AS kind, {WORKS}")),
    "open_copies": (copies, cte("SELECT doi, CASE id % 5 WHEN 0 THEN 'https://u.org/' || id || '.pdf' WHEN 1 THEN 'https://u.org/' || id ELSE 'https://u.org/' || id || '/other.pdf' END AS pdf_url FROM lib_documents WHERE doi IS NOT NULL AND id % 5 < 4")),
    "eprint_numbers": (preprints, cte(f"SELECT id, CASE WHEN id % 5 = 0 OR id % 6 IN (3, 4) THEN NULL WHEN id % 6 = 2 THEN CASE WHEN id % 5 < 3 THEN 'math/' || id END ELSE {NUMBER} END AS number FROM lib_documents")),
    "repository_backfill": (backfilled, cte("SELECT id, coalesce(github_url, CASE WHEN id % 4 = 0 THEN 'https://github.com/group' || id || '/tool' WHEN id % 3 = 0 THEN 'https://github.com/lab/abs' || id END) AS github_url FROM lib_documents")),
}
