"""Names of files and folders, numbers for equal ones, plans between two states."""

import random
import re
from dataclasses import dataclass

from pyspark.sql import functions as F

from biblark.operators import folders


def plain_name(name):
    s = re.sub(r'[<>:"/\\|?*\x00-\x1f]', " ", name or "")
    s = " ".join(s.split()).rstrip(". ")
    if len(s.encode()) > 90:
        s = s.encode()[:90].decode(errors="ignore").rstrip(". ")
    return f"_{s}" if not s or s.upper() in folders.RESERVED else s


def test_safe_components(spark):
    names = ["a/b\\c:d", "  two   words. . ", "con", "COM9", "com10", "con.txt", "..", ".", "", None, "x" * 89 + "é", "é" * 46, "a" + "é" * 60, "€" * 40, "𝄞" * 23, "x" * 88 + ". y", "tab\tnew\nline\x00", "a  b", "..a", "n" * 90, "Ø. "]
    rng = random.Random(3)
    names += ["".join(rng.choice("ab. é€𝄞/:") for _ in range(rng.randint(0, 130))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {r["id"]: r["s"] for r in rows.select("id", folders.safe_component(F.col("name")).alias("s")).collect()}
    assert got == {i: plain_name(n) for i, n in enumerate(names)}


def test_document_names(spark):
    rows = [(1, " Rossi ", 2020, " On it: a b "), (2, None, None, None), (3, "", 1999, " ")]
    df = spark.createDataFrame(rows, "id long, lead string, year int, title string")
    got = [r["n"] for r in df.orderBy("id").select(folders.document_name(F.col("lead"), F.col("year"), F.col("title"), F.col("id")).alias("n")).collect()]
    assert got == ["Rossi 2020 — On it a b.pdf", "Documento 2.pdf", "1999 — Documento 3.pdf"]


def plain_numbers(rows, ending):
    """Names that are spelled out are taken; the rest takes the first free number, by id."""
    names = {(f, n) for f, n, _ in rows}
    seen, given, out = set(), {}, {}
    for f, n, i in sorted(rows, key=lambda r: r[2]):
        if (f, n) not in seen:
            seen.add((f, n))
            out[i] = n
            continue
        stem, tail = (n[: -len(ending)], ending) if ending and n.endswith(ending) else (n, "")
        k = given.get((f, n), 1) + 1
        while (f, f"{stem} ({k}){tail}") in names:
            k += 1
        given[(f, n)] = k
        out[i] = f"{stem} ({k}){tail}"
    return out


def test_numbers_pass_over_names_that_are_spelled_out(spark, monkeypatch):
    monkeypatch.setattr(folders, "BLOCK", 7)
    rng = random.Random(11)
    rows = [(f"f{rng.randint(0, 1)}", rng.choice(["a", "a", "a", "b", "a (2)", "a (3)", "a (5)", "a (02)", "a (2) (2)", "b (1)", "b (2)", "", "\n (2)"]), i) for i in range(150)]
    for ending in ("", ".pdf"):
        cases = [(f, n + ending, i) for f, n, i in rows]
        got = folders.numbered_names(spark.createDataFrame(cases, "folder string, name string, id long"), ending).collect()
        assert {r["id"]: r["shown"] for r in got} == plain_numbers(cases, ending)
        assert len({(r["folder"], r["shown"]) for r in got}) == len(got)


def test_numbers_of_nulls_repeats_and_nothing(spark):
    schema = "folder string, name string, id long, further string"
    got = folders.numbered_names(spark.createDataFrame([(None, None, 1, "x"), (None, None, 2, None), ("f", "n", 3, "y"), ("f", "n", 3, "y")], schema)).collect()
    assert sorted((r["folder"], r["shown"], r["id"]) for r in got) == [("", "", 1), ("", " (2)", 2), ("f", "n", 3), ("f", "n (2)", 3)]
    assert folders.numbered_names(spark.createDataFrame([], schema)).count() == 0


@dataclass(frozen=True)
class Small:
    live: object
    collections: object
    members: object
    authors: object
    document_authors: object


def small(spark, members):
    live = spark.createDataFrame([(1, "A/B", 2001, "/p/1"), (2, "A B", 2001, "/p/2"), (3, "C", None, "/p/3"), (4, "D", 2000, "ref:4"), (5, None, None, "/p/5")], "id long, title string, year int, path string")
    collections = spark.createDataFrame([(1, "Top.", None), (2, "x:y", 1), (3, "x y", 1)], "id long, name string, parent_id long")
    authors = spark.createDataFrame([(1, "Ada"), (2, "Bo")], "id long, family string")
    wrote = spark.createDataFrame([(1, 2, 2), (1, 1, 1), (2, 1, 1)], "document_id long, author_id long, position int")
    return Small(live, collections, spark.createDataFrame(members, "collection_id long, document_id long"), authors, wrote)


def test_projection_and_changes(spark):
    lib = small(spark, [(2, 1), (3, 2), (1, 3), (1, 4)])
    files = folders.projection(lib)
    want = {("Top/x y", 1, "Ada 2001 — A B.pdf", "/p/1"), ("Top/x y", 2, "Ada 2001 — A B (2).pdf", "/p/2"), ("Top", 3, "C.pdf", "/p/3"), ("Senza raccolta", 5, "Documento 5.pdf", "/p/5")}
    assert {tuple(r) for r in files.collect()} == want
    assert folders.changes(files, folders.projection(lib)).count() == 0
    assert folders.folder_changes(files, files).count() == 0
    later = folders.projection(small(spark, [(3, 2), (3, 3), (1, 4)]))
    plan = {tuple(r) for r in folders.changes(files, later).collect()}
    assert plan == {
        ("remove", "Top/x y", "Ada 2001 — A B.pdf", "/p/1"), ("remove", "Top/x y", "Ada 2001 — A B (2).pdf", "/p/2"), ("make", "Top/x y", "Ada 2001 — A B.pdf", "/p/2"),
        ("remove", "Top", "C.pdf", "/p/3"), ("make", "Top/x y", "C.pdf", "/p/3"), ("make", "Senza raccolta", "Ada 2001 — A B.pdf", "/p/1"),
    }
    none = folders.projection(small(spark, []), present=spark.createDataFrame([("/p/5",), ("/p/5",)], "source string"))
    assert [tuple(r) for r in none.collect()] == [("Senza raccolta", 5, "Documento 5.pdf", "/p/5")]
    assert {tuple(r) for r in folders.folder_changes(files, none).collect()} == {("remove", "Top"), ("remove", "Top/x y")}
