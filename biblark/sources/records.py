"""Recorded answers of online catalogues (one JSON text a row) as one table of results.

Nothing is fetched here: a collector stores answers, and these functions read
them with declared schemas, so that only the named fields are parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblark.functions import text as T

COLUMNS = ["source", "external_id", "title", "authors", "year", "venue", "doi", "abstract", "url", "pdf_url", "citations", "open_access", "code_url", "pub_status"]
NAMED = "array<struct<name:string>>"
OPENALEX = "results array<struct<id:string,title:string,display_name:string,publication_year:int,doi:string,cited_by_count:bigint,open_access:struct<is_oa:boolean,oa_url:string>,best_oa_location:struct<pdf_url:string>,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<source:struct<display_name:string>>,abstract_inverted_index:map<string,array<int>>>>"
CROSSREF = "message struct<items:array<struct<DOI:string,title:array<string>,`container-title`:array<string>,author:array<struct<given:string,family:string,name:string>>,issued:struct<`date-parts`:array<array<int>>>,`is-referenced-by-count`:bigint,abstract:string>>>"
SCHOLAR = f"data array<struct<paperId:string,title:string,year:int,venue:string,citationCount:bigint,isOpenAccess:boolean,openAccessPdf:struct<url:string>,abstract:string,authors:{NAMED},externalIds:struct<DOI:string>>>"
EUROPE_PMC = "resultList struct<result:array<struct<source:string,id:string,title:string,authorString:string,pubYear:string,journalTitle:string,doi:string,citedByCount:bigint,isOpenAccess:string,abstractText:string,fullTextUrlList:struct<fullTextUrl:array<struct<documentStyle:string,availabilityCode:string,url:string>>>>>>"
ADS = "response struct<docs:array<struct<bibcode:string,title:array<string>,author:array<string>,year:string,pub:string,doi:array<string>,citation_count:bigint,abstract:string,identifier:array<string>,property:array<string>>>>"
CORE = f"results array<struct<id:string,title:string,authors:{NAMED},yearPublished:int,publisher:string,doi:string,abstract:string,downloadUrl:string,citationCount:bigint>>"
DOAJ = f"results array<struct<id:string,bibjson:struct<title:string,author:{NAMED},year:string,journal:struct<title:string>,abstract:string,identifier:array<struct<type:string,id:string>>,link:array<struct<type:string,url:string>>>>>"
PAPERS = f"array<struct<title:string,publishedAt:string,paper:struct<id:string,title:string,summary:string,authors:{NAMED},publishedAt:string,githubRepo:string,upvotes:bigint>>>"
BOOK = f"struct<title:string,authors:{NAMED},publishers:{NAMED},publish_date:string>"
PUBMED = f"struct<title:string,authors:{NAMED},source:string,pubdate:string>"
UNPAYWALL = "doi string, best_oa_location struct<url_for_pdf:string,url:string>, oa_locations array<struct<url_for_pdf:string>>"


def filled(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def present(items: Column, value=lambda x: x) -> Column:
    """The values that are there, in order; none gives an empty array."""
    return F.coalesce(F.filter(F.transform(items, value), lambda v: v.isNotNull()), F.array().cast("array<string>"))


def first_of(items: Column, test, value) -> Column:
    return F.get(F.transform(F.filter(items, test), value), 0)


def finished(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    """The common columns; results without an id are left out. Unknown counts are 0, unknown access is closed."""
    columns = {name: F.lit(None).cast("string") for name in ("abstract", "url", "pdf_url", "code_url")} | columns
    doi = filled(T.clean_doi(columns["doi"]))
    columns |= {"doi": doi, "citations": F.coalesce(columns["citations"], F.lit(0)).cast("long"), "open_access": F.coalesce(columns["open_access"], F.lit(False)), "year": columns["year"].cast("long")}
    status = T.publication_status(doi, columns["venue"], F.lit(None).cast("string"))
    out = rows.select(F.lit(source).alias("source"), *[c.alias(n) for n, c in columns.items()], status.alias("pub_status"))
    return out.where("external_id is not null and external_id <> ''").select(*COLUMNS)


def landing(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), T.clean_doi(doi))


def openalex(answers: DataFrame) -> DataFrame:
    r = answers.select(F.explode(F.from_json("json", OPENALEX)["results"]).alias("r"))
    pairs = F.map_entries("r.abstract_inverted_index")
    placed = F.array_sort(F.flatten(F.transform(pairs, lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))))
    abstract = F.when(F.size(placed) > 0, F.array_join(F.transform(placed, lambda x: x["w"]), " "))
    pdf = F.coalesce("r.best_oa_location.pdf_url", "r.open_access.oa_url")
    return finished(r, "openalex", external_id=F.regexp_extract("r.id", r"([^/]*)$", 1), title=F.coalesce("r.title", "r.display_name"), authors=present(F.col("r.authorships"), lambda a: a["author"]["display_name"]), year=F.col("r.publication_year"), venue=F.col("r.primary_location.source.display_name"), doi=F.col("r.doi"), abstract=abstract, url=F.coalesce(landing(F.col("r.doi")), filled(F.col("r.id"))), pdf_url=pdf, citations=F.col("r.cited_by_count"), open_access=F.col("r.open_access.is_oa"))


def crossref(answers: DataFrame) -> DataFrame:
    r = answers.select(F.explode(F.from_json("json", CROSSREF)["message"]["items"]).alias("r"))
    name = lambda a: F.coalesce(filled(F.trim(F.concat_ws(" ", a["given"], a["family"]))), a["name"])
    return finished(r, "crossref", external_id=F.lower("r.DOI"), title=F.get(F.col("r.title"), 0), authors=present(F.col("r.author"), name), year=F.get(F.get(F.col("r.issued")["date-parts"], 0), 0), venue=F.get(F.col("r")["container-title"], 0), doi=F.col("r.DOI"), abstract=T.strip_markup(F.col("r.abstract")), url=landing(F.col("r.DOI")), citations=F.col("r")["is-referenced-by-count"], open_access=F.lit(None).cast("boolean"))


def semantic_scholar(answers: DataFrame) -> DataFrame:
    r = answers.select(F.explode(F.from_json("json", SCHOLAR)["data"]).alias("r"))
    pdf = filled(F.col("r.openAccessPdf.url"))
    return finished(r, "semanticscholar", external_id=F.col("r.paperId"), title=F.col("r.title"), authors=present(F.col("r.authors"), lambda a: a["name"]), year=F.col("r.year"), venue=filled(F.col("r.venue")), doi=F.col("r.externalIds.DOI"), abstract=F.col("r.abstract"), url=F.concat(F.lit("https://www.semanticscholar.org/paper/"), "r.paperId"), pdf_url=pdf, citations=F.col("r.citationCount"), open_access=F.coalesce("r.isOpenAccess", F.lit(False)) | pdf.isNotNull())


def europe_pmc(answers: DataFrame) -> DataFrame:
    """Ids are those of the catalogue behind the result, such as ``MED:123``. An open PDF comes before any other PDF."""
    r = answers.select(F.explode(F.from_json("json", EUROPE_PMC)["resultList"]["result"]).alias("r"))
    links = F.filter(F.col("r.fullTextUrlList.fullTextUrl"), lambda u: u["documentStyle"] == "pdf")
    pdf = F.coalesce(first_of(links, lambda u: u["availabilityCode"] == "OA", lambda u: u["url"]), first_of(links, lambda u: F.lit(True), lambda u: u["url"]))
    origin = F.coalesce("r.source", F.lit(""))
    return finished(r.where("r.id <> ''"), "europepmc", external_id=F.concat(origin, F.lit(":"), "r.id"), title=F.col("r.title"), authors=present(F.split(F.regexp_replace("r.authorString", r"\.+$", ""), ", ")), year=F.col("r.pubYear").try_cast("int"), venue=filled(F.col("r.journalTitle")), doi=F.col("r.doi"), abstract=F.col("r.abstractText"), url=F.concat(F.lit("https://europepmc.org/article/"), origin, F.lit("/"), "r.id"), pdf_url=pdf, citations=F.col("r.citedByCount"), open_access=F.col("r.isOpenAccess") == "Y")


def arxiv(answers: DataFrame) -> DataFrame:
    """Atom feeds: column ``json`` holds the XML text."""
    entries = answers.select(F.explode(F.regexp_extract_all("json", F.lit(r"(?s)<entry>(.*?)</entry>"), 1)).alias("e"))
    e = F.col("e")
    authors = F.transform(F.regexp_extract_all(e, F.lit(r"(?s)<name>(.*?)</name>"), 1), lambda a: F.trim(a))
    number = F.regexp_extract(e, r"<id>[^<]*/abs/([^<]+)</id>", 1)
    return finished(entries, "arxiv", external_id=number, title=T.between(e, "<title>", "</title>"), authors=authors, year=T.year_prefix(T.between(e, "<published>", "</published>")), venue=F.lit("arXiv"), doi=T.between(e, "<arxiv:doi>", "</arxiv:doi>"), abstract=T.between(e, "<summary>", "</summary>"), url=F.concat(F.lit("https://arxiv.org/abs/"), number), pdf_url=F.concat(F.lit("https://arxiv.org/pdf/"), number), citations=F.lit(0), open_access=F.lit(True))


def astrophysics(answers: DataFrame) -> DataFrame:
    """Astrophysics Data System. A preprint named among the identifiers is the open PDF."""
    r = answers.select(F.explode(F.from_json("json", ADS)["response"]["docs"]).alias("r"))
    preprint = first_of(F.col("r.identifier"), lambda i: i.rlike("(?i)^arxiv:"), lambda i: F.substring(i, 7, 100))
    marked = F.exists(F.coalesce("r.property", F.array().cast("array<string>")), lambda p: F.coalesce(F.upper(p).contains("OPENACCESS"), F.lit(False)))
    first = lambda c: F.get(present(F.col(c)), 0)
    return finished(r, "ads", external_id=F.col("r.bibcode"), title=first("r.title"), authors=present(F.col("r.author")), year=F.trim("r.year").try_cast("long"), venue=F.col("r.pub"), doi=first("r.doi"), abstract=F.col("r.abstract"), url=F.concat(F.lit("https://ui.adsabs.harvard.edu/abs/"), "r.bibcode"), pdf_url=F.concat(F.lit("https://arxiv.org/pdf/"), preprint), citations=F.col("r.citation_count"), open_access=marked | preprint.isNotNull())


def core(answers: DataFrame) -> DataFrame:
    r = answers.select(F.explode(F.from_json("json", CORE)["results"]).alias("r"))
    pdf = filled(F.col("r.downloadUrl"))
    return finished(r, "core", external_id=F.col("r.id"), title=F.col("r.title"), authors=present(F.col("r.authors"), lambda a: a["name"]), year=F.col("r.yearPublished"), venue=filled(F.col("r.publisher")), doi=F.col("r.doi"), abstract=F.col("r.abstract"), url=F.coalesce(landing(F.col("r.doi")), pdf), pdf_url=pdf, citations=F.col("r.citationCount"), open_access=pdf.isNotNull())


def open_journals(answers: DataFrame) -> DataFrame:
    """Directory of Open Access Journals: all open, uncounted. A link is a PDF's only if it looks like one."""
    r = answers.select(F.explode(F.from_json("json", DOAJ)["results"]).alias("r")).select("r.id", "r.bibjson.*")
    link = first_of(F.col("link"), lambda i: i["type"] == "fulltext", lambda i: i["url"])
    return finished(r, "doaj", external_id=F.col("id"), title=F.col("title"), authors=present(F.col("author"), lambda a: a["name"]), year=F.col("year").try_cast("long"), venue=F.col("journal.title"), doi=first_of(F.col("identifier"), lambda i: i["type"] == "doi", lambda i: i["id"]), abstract=F.col("abstract"), url=link, pdf_url=F.when(link.rlike("(?i)\\.pdf$|/pdf"), link), citations=F.lit(0), open_access=F.lit(True))


def papers_with_code(answers: DataFrame) -> DataFrame:
    """Daily papers and searches among them: each is a preprint, some name their repository; votes stand for citations."""
    r = answers.select(F.explode(F.from_json("json", PAPERS)).alias("r"))
    number = F.col("r.paper.id")
    code = F.when(F.startswith(F.col("r.paper.githubRepo"), F.lit("https://github.com/")), F.col("r.paper.githubRepo"))
    return finished(r, "huggingface", external_id=number, title=F.coalesce("r.paper.title", "r.title"), authors=present(F.col("r.paper.authors"), lambda a: a["name"]), year=T.year_prefix(F.coalesce("r.paper.publishedAt", "r.publishedAt")), venue=F.lit("arXiv · HF Papers"), doi=F.lit(None).cast("string"), abstract=F.col("r.paper.summary"), url=F.concat(F.lit("https://huggingface.co/papers/"), number), pdf_url=F.concat(F.lit("https://arxiv.org/pdf/"), number), citations=F.col("r.paper.upvotes"), open_access=F.lit(True), code_url=code)


def books(answers: DataFrame) -> DataFrame:
    """(isbn, title, authors, year, venue) of Open Library answers, whose keys are ``ISBN:`` and a number."""
    r = answers.select(F.explode(F.from_json("json", f"map<string,{BOOK}>")).alias("k", "r")).where("startswith(k, 'ISBN:') and r is not null")
    return r.select(F.substring("k", 6, 20).alias("isbn"), "r.title", F.transform(present(F.col("r.authors"), lambda a: a["name"]), T.split_name).alias("authors"), T.year_window(F.col("r.publish_date")).alias("year"), F.get(F.col("r.publishers.name"), 0).alias("venue"))


def pubmed(answers: DataFrame) -> DataFrame:
    """(pmid, title, authors, year, venue) of summaries, which stand beside a list of their ids."""
    r = answers.select(F.explode(F.from_json("json", "result map<string,string>")["result"]).alias("pmid", "j")).where("pmid <> 'uids'").select("pmid", F.from_json("j", PUBMED).alias("r")).where("r is not null")
    return r.select("pmid", T.strip_markup(F.col("r.title")).alias("title"), F.transform(present(F.col("r.authors"), lambda a: a["name"]), T.split_name).alias("authors"), T.year_window(F.col("r.pubdate")).alias("year"), F.col("r.source").alias("venue"))


def open_copies(answers: DataFrame) -> DataFrame:
    """(doi, pdf_url) of Unpaywall answers that have an open copy: the best place's PDF, else its page, else any place's PDF."""
    r = answers.select(F.from_json("json", UNPAYWALL).alias("r"))
    url = F.coalesce("r.best_oa_location.url_for_pdf", "r.best_oa_location.url", F.get(present(F.col("r.oa_locations"), lambda p: p["url_for_pdf"]), 0))
    return r.select(T.clean_doi(F.col("r.doi")).alias("doi"), url.alias("pdf_url")).where("pdf_url is not null")


def arxiv_of_eprint(eprint: Column, prefix: Column) -> Column:
    """The preprint's number, without a version, of a bibliography entry's ``eprint``. A declared archive other than arXiv rules
    it out; an undeclared one needs the form of a number; numbers of the old form count only where arXiv is declared."""
    e, declared = F.trim(eprint), F.lower(F.trim(prefix)).contains("arxiv")
    marked = F.regexp_replace(F.get(T.extract_arxiv_ids(e, 1), 0), r"v\d+$", "")
    bare = filled(F.regexp_extract(e, r"^(?:arXiv:|arxiv:)*\s*(\d{4}\.\d{4,5})(?:v.*)?$", 1))
    old = F.when(declared & e.contains("/") & ~e.contains(" ") & (F.octet_length(e) <= 24), F.regexp_replace(e, "^(?:arXiv:)+", ""))
    return F.when((e != "") & F.coalesce(declared, F.lit(True)), F.coalesce(marked, bare, old))


def filtered(results: DataFrame, year_from: int | None = None, year_to: int | None = None, open_access_only: bool = False, author: str | None = None) -> DataFrame:
    """Discovery filters; a missing year passes."""
    out = results
    if year_from is not None:
        out = out.where(F.col("year").isNull() | (F.col("year") >= year_from))
    if year_to is not None:
        out = out.where(F.col("year").isNull() | (F.col("year") <= year_to))
    if open_access_only:
        out = out.where("open_access")
    if author:
        out = out.where(F.exists("authors", lambda a: F.contains(F.lower(a), F.lit(author.lower()))))
    return out


def in_library(results: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds in_library: whether a live document has the result's DOI, or is kept as a reference to it (a path ``ref:`` and the
    id, with or without the source)."""
    live = docs.where("deleted_at is null")
    owned = live.where("doi is not null").select(F.lower("doi").alias("doi")).distinct().withColumn("_own", F.lit(True))
    kept = live.where("startswith(path, 'ref:')").select(F.substr("path", F.lit(5)).alias("_ref")).distinct()
    named = results.select("source", "external_id").where("external_id <> ''").distinct()
    named = named.select("source", "external_id", F.explode(F.array("external_id", F.concat("source", F.lit(":"), "external_id"))).alias("_ref"))
    held = named.join(kept, "_ref", "left_semi").select("source", "external_id").distinct().withColumn("_held", F.lit(True))
    return results.join(owned, "doi", "left").join(held, ["source", "external_id"], "left").withColumn("in_library", F.coalesce("_own", "_held", F.lit(False))).drop("_own", "_held")


def chips(results: DataFrame, code: bool = False, reviewed: bool = False, preprints: bool = False) -> DataFrame:
    """Results that have code, a reviewed version, a preprint; what is asked for together must hold together."""
    out = results.where("code_url is not null and code_url <> ''") if code else results
    out = out.where(F.col("pub_status").isin("published", "preprint_reviewed")) if reviewed else out
    return out.where(F.col("pub_status").isin("preprint", "preprint_reviewed")) if preprints else out


def ordered(results: DataFrame, key: str, down: bool = False) -> DataFrame:
    """By title or venue (in lower case, missing as empty) or by year or citations (missing as 0); ties by source and id."""
    if key not in ("title", "venue", "year", "citations"):
        raise ValueError(f"no order by {key!r}")
    value = F.lower(F.coalesce(key, F.lit(""))) if key in ("title", "venue") else F.coalesce(key, F.lit(0))
    return results.orderBy(value.desc() if down else value.asc(), "source", "external_id")


def with_repositories(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``docs`` where those without a github_url have the first repository that ``texts`` (id, fulltext, abstract) name, the full
    text before the abstract. A repository once known stays, so a second run changes nothing."""
    body = F.concat(F.coalesce("fulltext", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    open_ = docs.where("github_url is null").select("id")
    named = texts.join(open_, "id", "left_semi").select("id", F.concat(F.lit("https://github.com/"), F.get(T.repositories(body, 1), 0)).alias("_url")).where("_url is not null")
    first = named.groupBy("id").agg(F.min("_url").alias("_url"))
    return docs.join(first, "id", "left").withColumn("github_url", F.coalesce("github_url", "_url")).select(*docs.columns)
