import json

import pytest
from pyspark.sql import functions as F

from biblark.sources import records


def answered(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) or v is None else json.dumps(v),) for v in values], "json string")


def test_astrophysics(spark):
    docs = [
        {"bibcode": "b1", "title": ["T", "U"], "year": "2020", "identifier": ["x", "ARXIV:2101.00001"], "property": ["REFEREED"]},
        {"bibcode": "b2", "title": [], "year": 1999, "property": ["pub_openaccess"], "doi": ["https://doi.org/10.1/A"]},
        {"bibcode": "b3", "year": "soon"},
        {"bibcode": ""},
        {"title": ["no id"]},
    ]
    got = {r["external_id"]: r for r in records.astrophysics(answered(spark, {"response": {"docs": docs}}, "not json", None, {})).collect()}
    assert set(got) == {"b1", "b2", "b3"}
    assert (got["b1"]["title"], got["b1"]["year"], got["b1"]["pdf_url"], got["b1"]["open_access"]) == ("T", 2020, "https://arxiv.org/pdf/2101.00001", True)
    assert (got["b2"]["title"], got["b2"]["year"], got["b2"]["doi"], got["b2"]["open_access"], got["b2"]["pdf_url"]) == (None, 1999, "10.1/a", True, None)
    assert (got["b3"]["year"], got["b3"]["authors"], got["b3"]["citations"], got["b3"]["open_access"], got["b3"]["pub_status"]) == (None, [], 0, False, None)


def test_open_catalogues(spark):
    core = records.core(answered(spark, {"results": [{"id": 7, "title": "A", "authors": [{"name": "X"}, {}], "doi": "10.1/C"}, {"id": "8", "downloadUrl": "https://c/8"}, {"title": "none"}]}))
    got = {r["external_id"]: r for r in core.collect()}
    assert set(got) == {"7", "8"}
    assert (got["7"]["authors"], got["7"]["url"], got["7"]["open_access"]) == (["X"], "https://doi.org/10.1/c", False)
    assert (got["8"]["url"], got["8"]["pdf_url"], got["8"]["open_access"]) == ("https://c/8", "https://c/8", True)
    journal = {"id": "j", "bibjson": {"title": "B", "year": "2001", "link": [{"type": "home", "url": "h"}, {"type": "fulltext", "url": "https://j/pdf/1"}], "identifier": [{"type": "doi", "id": "10.2/D"}]}}
    row = records.open_journals(answered(spark, {"results": [journal]})).first()
    assert (row["url"], row["pdf_url"], row["doi"], row["year"], row["open_access"], row["citations"]) == ("https://j/pdf/1", "https://j/pdf/1", "10.2/d", 2001, True, 0)
    daily = [{"title": "outer", "publishedAt": "2024-01-01", "paper": {"id": "2401.1", "upvotes": 3, "githubRepo": "https://gitlab.com/a/b"}}, {"paper": {"id": "2401.2", "title": "inner", "githubRepo": "https://github.com/a/b"}}, {"paper": {}}]
    got = [(r["external_id"], r["title"], r["year"], r["citations"], r["code_url"], r["pub_status"]) for r in records.papers_with_code(answered(spark, daily)).orderBy("external_id").collect()]
    assert got == [("2401.1", "outer", 2024, 3, None, "preprint"), ("2401.2", "inner", None, 0, "https://github.com/a/b", "preprint")]


def test_europe_pmc_prefers_open_pdf(spark):
    links = [{"documentStyle": "pdf", "availabilityCode": "S", "url": "first"}, {"documentStyle": "pdf", "availabilityCode": "OA", "url": "open"}]
    found = [{"source": "MED", "id": "1", "authorString": "A B, C D.", "fullTextUrlList": {"fullTextUrl": links}}, {"source": "PMC", "id": "2", "fullTextUrlList": {"fullTextUrl": links[:1]}, "isOpenAccess": "Y"}, {"source": "MED", "id": ""}]
    got = {r["external_id"]: r for r in records.europe_pmc(answered(spark, {"resultList": {"result": found}})).collect()}
    assert set(got) == {"MED:1", "PMC:2"}
    assert (got["MED:1"]["authors"], got["MED:1"]["pdf_url"], got["MED:1"]["open_access"]) == (["A B", "C D"], "open", False)
    assert (got["PMC:2"]["pdf_url"], got["PMC:2"]["open_access"]) == ("first", True)


def test_works_by_number(spark):
    book = records.books(answered(spark, {"ISBN:1": {"title": "B", "authors": [{"name": "Ann Lee"}], "publishers": [{"name": "P"}, {"name": "Q"}], "publish_date": "Spring 1988"}, "other": {"title": "x"}, "ISBN:2": None}, {})).collect()
    assert [(r["isbn"], r["title"], tuple(r["authors"][0]), r["year"], r["venue"]) for r in book] == [("1", "B", ("Ann", "Lee"), 1988, "P")]
    paper = records.pubmed(answered(spark, {"result": {"uids": ["9"], "9": {"title": "On <i>x</i> &amp; y", "source": "J", "pubdate": "1999 Feb"}}}, "[]")).collect()
    assert [(r["pmid"], r["title"], r["authors"], r["year"], r["venue"]) for r in paper] == [("9", "On x & y", [], 1999, "J")]
    copies = records.open_copies(answered(spark, {"doi": "10.1/A", "best_oa_location": None, "oa_locations": [{"url_for_pdf": None}, {"url_for_pdf": "u"}]}, {"doi": "10.1/B", "best_oa_location": {"url": "page"}}, {"doi": "10.1/C", "oa_locations": []})).collect()
    assert sorted(map(tuple, copies)) == [("10.1/a", "u"), ("10.1/b", "page")]


@pytest.mark.parametrize(
    ("eprint", "prefix", "number"),
    [
        ("2103.00020", None, "2103.00020"),
        (" 2103.00020v2 ", "arXiv", "2103.00020"),
        ("arXiv:2103.00020v4", None, "2103.00020"),
        ("2103.00020", "HAL", None),
        ("math/0211159", "arXiv", "math/0211159"),
        ("math/0211159", None, None),
        ("arXiv:math/0211159", "arxiv", "math/0211159"),
        ("hal-0123", None, None),
        ("", "arXiv", None),
        (None, "arXiv", None),
    ],
)
def test_number_of_eprint(spark, eprint, prefix, number):
    row = spark.createDataFrame([(eprint, prefix)], "e string, p string").select(records.arxiv_of_eprint(F.col("e"), F.col("p")).alias("n")).first()
    assert row["n"] == number


def test_order_and_chips(spark):
    rows = [("a", "1", "beta", 2000, None, 5, None, "published"), ("a", "2", None, None, "V", 0, "u", "preprint"), ("b", "1", "Alpha", 1990, "v", 5, "", "preprint_reviewed"), ("b", "2", "alpha", 2001, None, 9, None, None)]
    found = spark.createDataFrame(rows, "source string, external_id string, title string, year long, venue string, citations long, code_url string, pub_status string")
    names = lambda df: [r["source"] + r["external_id"] for r in df.collect()]
    assert names(records.ordered(found, "title")) == ["a2", "b1", "b2", "a1"]
    assert names(records.ordered(found, "year", down=True)) == ["b2", "a1", "b1", "a2"]
    assert names(records.ordered(found, "citations", down=True)) == ["b2", "a1", "b1", "a2"]
    assert names(records.ordered(found, "venue", down=True)) == ["a2", "b1", "a1", "b2"]
    with pytest.raises(ValueError):
        records.ordered(found, "doi")
    assert names(records.chips(found, code=True)) == ["a2"]
    assert sorted(names(records.chips(found, reviewed=True))) == ["a1", "b1"]
    assert names(records.chips(found, reviewed=True, preprints=True)) == ["b1"]
    assert names(records.chips(found)) == names(found)


def test_repositories_are_filled_once(spark):
    docs = spark.createDataFrame([(1, None), (2, "kept"), (3, None), (4, None)], "id long, github_url string")
    texts = spark.createDataFrame([(1, "x github.com/a/b.git, github.com/c/d", None), (2, "github.com/a/b", None), (3, None, "github.com/e/f"), (3, None, "github.com/e/f"), (9, "github.com/z/z", None)], "id long, fulltext string, abstract string")
    once = records.with_repositories(docs, texts)
    assert sorted(map(tuple, once.collect())) == [(1, "https://github.com/a/b"), (2, "kept"), (3, "https://github.com/e/f"), (4, None)]
    assert sorted(map(tuple, records.with_repositories(once, texts).collect())) == sorted(map(tuple, once.collect()))
