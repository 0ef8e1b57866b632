"""Citation keys, import precedence, attached files and numbered lists, by rules read out one row at a time."""

import random

from biblark.operators import bibliography, identity

DOC = "id long, family string, year int, title string"


def suffix(n):
    return "" if n == 0 else chr(97 + n) if n < 25 else str(n + 1)


def keys_one_by_one(docs, held):
    used, out = set(held), {}
    for i, family, year, title in sorted(docs):
        if not (family or "").strip():
            continue
        plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
        words = [plain(w) for w in (title or "").split() if len(plain(w).encode()) > 3]
        base = (plain(family) or "anon") + (str(year) if year else "") + (words[0] if words else "")
        n = 0
        while base + suffix(n) in used:
            n += 1
        out[i] = base + suffix(n)
        used.add(out[i])
    return out


def assigned(spark, docs, held=()):
    keys = spark.createDataFrame([(k,) for k in held], "citekey string")
    return {r["id"]: r["key"] for r in bibliography.assigned_keys(spark.createDataFrame(docs, DOC), keys).collect()}


def test_keys_take_the_lowest_free_suffix(spark):
    docs = [(i, "Doe", 2020, "Study of rain") for i in range(1, 31)] + [(40, "Roe", None, "On it"), (41, " ", 1999, "Nothing here"), (42, "Poe", 1845, "Raven")]
    held = ["doe2020study", "doe2020studyd", "doe2020study27", "roe", None, "poe1845ravenb"]
    got = assigned(spark, docs, held)
    assert got == keys_one_by_one(docs, held) and got[1] == "doe2020studyb" and got[40] == "roeb" and got[42] == "poe1845raven" and 41 not in got


def test_keys_of_bases_that_meet(spark):
    """One base and a suffix is another base: keys stay unique, in order of id."""
    docs = [(1, "Doe", 2020, "study"), (2, "Doe", 2020, "study"), (3, "Doe", 2020, "studyb"), (4, "Doe", 2020, "studyb"), (5, "Doe", 2020, "study")]
    got = assigned(spark, docs)
    assert got == keys_one_by_one(docs, []) and len(set(got.values())) == 5


def test_keys_by_random(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["Doe", "Do", "Doeb", "É", None]), rng.choice([None, 2, 20, 202, 2026]), rng.choice([None, "stud", "studb", "studbb", "a study"])) for i in range(400)]
    held = [k + rng.choice(["", "b", "c", "26", "30"]) for k in ("doe2stud", "do20studb", "doeb", "doe2026study", "anon2stud")]
    assert assigned(spark, docs, held) == keys_one_by_one(docs, held)


def test_a_trashed_document_of_the_path_comes_back_first(spark):
    docs = spark.createDataFrame([(1, "/a", "h1", "gone"), (2, "/b", "h1", None), (3, "/c", "h3", "gone"), (4, "/d", "h4", "gone"), (5, "/e", "h4", None)], "id long, path string, file_hash string, deleted_at string")
    files = [("/a", "h1"), ("/x", "h3"), ("/y", "h4"), ("/b", "h9"), ("/n", "new"), ("/o", "new")]
    run = lambda passive: {r["path"]: (r["decision"], r["id"]) for r in identity.import_decisions(docs, spark.createDataFrame(files, "path string, file_hash string"), passive).collect()}
    assert run(False) == {"/a": ("restore", 1), "/x": ("restore", 3), "/y": ("duplicate", 4), "/b": ("duplicate", 2), "/n": ("new", None), "/o": ("duplicate", None)}
    assert {d for d, _ in run(True).values()} == {"duplicate", "new"}


def test_attached_files():
    for field, want in [
        ("/home/me/a.pdf", ["/home/me/a.pdf"]),
        ("Full Text:files/12/a.pdf:application/pdf", ["files/12/a.pdf"]),
        (r"x\: y:C\:\\papers\\b.pdf:PDF;/c.pdf:application/pdf", [r"C:\papers\b.pdf", "/c.pdf"]),
        (":notes.txt:text;d.PDF", ["d.PDF"]),
        (r"a\;b.pdf", [r"a\;b.pdf"]),
        ("", []),
    ]:
        assert bibliography.attached(field) == want
    entry = bibliography.parse_file("x.bib", "@article{k, title={T}, file={:one.pdf:PDF;two.html}}")
    assert entry[0]["files"] == ["one.pdf"]


def test_numbers_run_through_the_list(spark):
    ids = [7, 3, 900, 12, 5, 44, 1]
    got = bibliography.numbered(spark.createDataFrame([(i,) for i in ids], "id long"), 3).collect()
    assert {r["id"]: r["number"] for r in got} == {i: k + 1 for k, i in enumerate(sorted(ids))}
