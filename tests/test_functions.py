"""Known answers of the scalar functions, parsers, sources and stream operators."""

import json

import pytest
from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.operators import bibliography, identity, retrieval, vectors
from biblark.sources import files, records
from biblark.streaming import activity


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<array<string>>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]




@pytest.mark.parametrize(
    "column,text,want",
    [
        (lambda: T.extract_doi(F.col("c")), "see doi:10.1000/ABC.12). next", "10.1000/ABC.12"),
        (lambda: T.extract_doi(F.col("c")), "10.1234/abchttps://x.org", "10.1234/abc"),
        (lambda: T.extract_doi(F.col("c")), "none", None),
        (lambda: T.extract_dois(F.col("c"), 5), "10.1000/a, 10.1000/A and 10.1000/b.", ["10.1000/a", "10.1000/b"]),
        (lambda: T.extract_arxiv_ids(F.col("c"), 5), "arXiv:2101.00001v2 and 2101.00002 and arXiv:2199.00001", ["2101.00001v2"]),
        (lambda: T.arxiv_id_of_file(F.col("c")), "2101.00001v3.pdf", "2101.00001v3"),
        (lambda: T.clean_doi(F.col("c")), "https://doi.org/10.1000/X", "10.1000/x"),
        (lambda: T.fold(F.col("c")), "Straße Élan", "strasse elan"),
        (lambda: T.slugify(F.col("c")), "  Ünïcode & More!  ", "ünïcode-more"),
        (lambda: T.slugify(F.col("c")), "!!!", "pagina"),
        (lambda: T.strip_markup(F.col("c")), "<b>a</b> &amp; <i>b</i>", "a & b"),
        (lambda: T.year_window(F.col("c")), "v12 of 2019-05", 2019),
        (lambda: T.year_prefix(F.col("c")), "2020-01-01T00", 2020),
        (lambda: T.cited_numbers(F.col("c")), "a [2] b [1] c [2]", [1, 2]),
        (lambda: T.without_reasoning(F.col("c")), "<think>hm</think>Answer", "Answer"),
        (lambda: T.without_reasoning(F.col("c")), "<think>never closed", ""),
        (lambda: T.first_line(F.col("c")), "\n \n## Title here \nbody", "Title here"),
        (lambda: T.first_line(F.col("c")), None, ""),
        (lambda: T.percent_encode(F.col("c")), "a b*~é", "a%20b%2A~%C3%A9"),
        (lambda: T.excerpt(F.col("c"), "needle"), "a  b needle c", "a b needle c"),
        (lambda: T.excerpt(F.col("c"), "x"), "abc", None),
        (lambda: T.civil_date(F.lit(0).cast("long")), "", "1970-01-01"),
        (lambda: T.duration_text(F.lit(3_725_000).cast("long")), "", "1h 2m"),
        (lambda: T.csv_cell(F.col("c")), 'a"b,c', '"a""b,c"'),
        (lambda: T.split_name(F.col("c"))["family"], "Ada King Lovelace", "Lovelace"),
        (lambda: T.split_ris_name(F.col("c"))["given"], "King, Martin, Jr.", "Martin"),
        (lambda: T.split_keywords(F.col("c")), "a; B, b ,a", ["a", "B"]),
    ],
)
def test_scalar(spark, column, text, want):
    assert one(spark, column(), c=text) == want


def test_titles(spark):
    same = lambda a, b: one(spark, T.titles_match(F.col("a"), F.col("b")), a=a, b=b)
    assert same("Deep learning of protein folding", "DEEP LEARNING of Protein-Folding")
    assert not same("Deep learning of protein folding", "Deep learning of protein folding revisited")
    assert not same("Deep nets", "Deep nets two")


def test_grids(spark):
    grid = [["a|b", "c"], ["1"]]
    assert one(spark, files.markdown_table(F.col("c")), c=grid) == "| a\\|b | c |\n| --- | --- |\n| 1 |  |"
    assert one(spark, files.csv_text(F.col("c")), c=[["x,y", 'q"'], ["1", "2"]]) == '"x,y","q"""\r\n1,2\r\n'


def test_like_marks(spark):
    df = spark.createDataFrame([("100% sure",), ("a_b",), ("a\\b",), (None,)], "c string")
    assert df.where(T.contains_nocase(F.col("c"), "A_B")).count() == 2
    assert df.where(T.contains_nocase(F.col("c"), "\\")).count() == 1
    assert df.where(T.contains_nocase(F.col("c"), "0% S")).count() == 1


def test_parsers(spark):
    bib = '@article{k1, title={A {B}raced title}, author="Doe, Jane and John Smith", year=2020, pages={1--2}}\n@comment{x}\n@misc{k2, title={}}'
    ris = "TY  - JOUR\nTI  - A title\nAU  - Doe, Jane\nPY  - 2019/01\nKW  - x; y\nER  -\n"
    csl = json.dumps([{"title": "T", "author": [{"literal": "Group"}], "issued": {"date-parts": [[2018]]}}])
    df = spark.createDataFrame([("a.bib", bib), ("b.ris", ris), ("c.json", csl)], "path string, text string")
    rows = {(r["path"], r["title"]): r for r in bibliography.parsed(df).collect()}
    assert {("a.bib", "A Braced title"), ("b.ris", "A title"), ("c.json", "T")} == set(rows)
    assert [r["year"] for r in sorted(rows.values(), key=lambda r: r["path"])] == [2020, 2019, 2018]


def test_chunks_cover_texts():
    words = [f"w{i}" for i in range(500)]
    parts = retrieval.chunk(" ".join(words), 100, 20, 1000)
    assert parts[0].startswith("w0 ") and parts[-1].endswith("w499") and all(len(p) < 110 for p in parts)
    assert retrieval.chunk("", 100, 20, 9) == [] and len(retrieval.chunk("x" * 5000, 100, 200, 9)) == 1


def test_index_follows_changes(spark):
    old = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, None)], "id long, t string")
    new = spark.createDataFrame([(1, "alpha gamma"), (3, "delta"), (4, "beta beta")], "id long, t string")
    got = retrieval.reindexed(retrieval.postings(old, "id", "t"), old, new, "id", "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.postings(new, "id", "t").collect()))


def test_neighbours_by_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 6)
    np.fill_diagonal(sims, -2)
    want = {(i, int(j)) for i in range(60) for j in np.lexsort((np.arange(60), -sims[i]))[:3] if sims[i, j] >= 0.2}
    for block in (7, 1000):
        assert {(r["src"], r["dst"]) for r in vectors.neighbours(df, "id", "v", 3, 0.2, block).collect()} == want


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (100, 102)]
    got = {r["id"]: r["group"] for r in identity.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_authors_are_null_safe(spark):
    have = spark.createDataFrame([(1, None, "Doe"), (2, "A", "B")], "id long, given string, family string")
    names = spark.createDataFrame([(None, "Doe"), ("A", "B"), ("New", "One"), ("New", "One")], "given string, family string")
    assert sorted(tuple(r) for r in identity.authors_with(have, names).collect() if r["id"] > 2) == [(3, "New", "One")]


def test_references_are_backfilled(spark):
    refs = spark.createDataFrame([(1, "Doe: Robust estimation of hidden markov models, 2001", None), (2, "other", "10.1/x")], "id long, raw string, ref_doi string")
    title = "Robust estimation of hidden markov models"
    found = spark.createDataFrame([(1, 1, title, "10.9/pre", True), (1, 2, title, "10.9/pub", False), (1, 3, "Quite different words stand here", "10.9/no", False)], "id long, rank int, title string, doi string, is_preprint boolean")
    assert {r["id"]: r["ref_doi"] for r in identity.backfilled_references(refs, found).collect()} == {1: "10.9/pub", 2: "10.1/x"}


def test_notes_and_projects(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.md").write_text("# First\nbody")
    (tmp_path / "n/b.MD").write_text("\n\nplain")
    (tmp_path / "n/c.txt").write_text("no")
    assert {r["slug"]: r["title"] for r in files.notes(spark, str(tmp_path / "n")).collect()} == {"a": "First", "b": "plain"}
    assert files.note(spark, str(tmp_path / "n"), "a").first()["body"] == "# First\nbody"
    with pytest.raises(ValueError):
        files.note(spark, str(tmp_path), "../x")
    for f in ("p/one/main.tex", "p/one/refs.bib", "p/two/sub/main.tex"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    got = {r["slug"]: (r["has_main"], r["has_bib"], r["has_pdf"]) for r in files.projects(spark, str(tmp_path / "p")).collect()}
    assert got == {"one": (True, True, False), "two": (False, False, False)}
    (tmp_path / "imp").mkdir()
    (tmp_path / "imp/my file.txt").write_bytes(b"a\x00b\tc\n")
    row = files.prepared_imports(spark, str(tmp_path / "imp")).first()
    assert row["title"] == "my file" and row["fulltext"] == "ab\tc\n"


def test_recorded_answers(spark):
    df = lambda value: spark.createDataFrame([(value if isinstance(value, str) else json.dumps(value),)], "json string")
    oa = records.openalex(df({"results": [{"id": "https://openalex.org/W1", "display_name": "T", "publication_year": 2020, "doi": "https://doi.org/10.1/X", "abstract_inverted_index": {"b": [1], "a": [0, 2]}}, {"id": "", "display_name": "dropped"}]})).collect()
    assert [(r["external_id"], r["doi"], r["abstract"], r["pub_status"]) for r in oa] == [("W1", "10.1/x", "a b a", "published")]
    cr = records.crossref(df({"message": {"items": [{"DOI": "10.1/Y", "title": ["C"], "author": [{"given": "A", "family": "B"}, {"name": "Group"}], "issued": {"date-parts": [[2011, 2]]}}]}})).first()
    assert (cr["authors"], cr["year"]) == (["A B", "Group"], 2011)
    feed = "<feed><entry><id>http://arxiv.org/abs/2101.00001v1</id><title>On\n things</title><published>2021-01-02</published><name>A B</name></entry></feed>"
    ax = records.arxiv(df(feed)).first()
    assert (ax["external_id"], ax["title"], ax["year"], ax["pub_status"]) == ("2101.00001v1", "On things", 2021, "preprint")
    assert records.filtered(records.arxiv(df(feed)), year_from=2022).count() == 0


def test_jobs_heal_order(spark, tmp_path):
    rows = [(1, "n", "start", 1000), (2, "n", "start", 2000), (3, "n", "ok", 5000), (4, "n", "start", 4000), (5, "n", "err", 6000), (6, "n", "ok", 7000)]
    df = spark.createDataFrame(rows, "id long, node string, state string, ts long")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    activity.jobs(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["at"], r["busy"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(5000, 2), (6000, 1), (7000, 0)]


def test_arrivals_import_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("same")
    (tmp_path / "in/b.txt").write_text("same")
    run = lambda: activity.import_arrivals(activity.arrivals(spark, str(tmp_path / "in")), f"{tmp_path}/docs", f"{tmp_path}/c").awaitTermination()
    run()
    (tmp_path / "in/c.txt").write_text("same")
    (tmp_path / "in/d.txt").write_text("new")
    run()
    assert sorted(r["title"] for r in spark.read.parquet(f"{tmp_path}/docs").collect()) == ["a", "d"]
