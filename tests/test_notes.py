"""Links of notes outside fences, medians and lists, by cases with known answers."""

import random

from biblark.operators import notes
from pyspark.sql import functions as F


def test_targets_outside_fences(spark):
    cases = {
        "[[A]] and [[ B | label ]] [[]] [[|x]]": ["a", "b"],
        "```\n[[in]]\n```\n[[Out]]": ["out"],
        "~~~\n[[in]]\n```\n[[still in]]\n~~~\n[[out]]": ["out"],
        "  ```py [[in the mark]]\n[[in]]": [],
        "[[one\ntwo]] [[x [[y]]": ["y"],
        None: [],
    }
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(cases)], "id long, body string")
    got = {r["id"]: r["t"] for r in rows.select("id", notes.link_targets(F.col("body")).alias("t")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_notes_come_before_papers_and_trash_is_no_target(spark):
    n = spark.createDataFrame([(1, "Plan", "[[paper]] [[plan]] [[@KEY]] [[gone]]"), (2, "Paper", "x")], "id long, title string, body string")
    d = spark.createDataFrame([(5, "paper", "key", None), (6, "Plan", None, None), (7, "gone", None, "t")], "id long, title string, citekey string, deleted_at string")
    got = {(r["target"], r["to_note"], r["to_document"]) for r in notes.note_links(n, d).collect()}
    assert got == {("paper", 2, None), ("plan", 1, None), ("@key", None, 5), ("gone", None, None)}
    assert {tuple(r) for r in notes.backlinks(n, d).collect()} == {("note", 2, 1, 1), ("note", 1, 1, 1), ("paper", 5, 1, 1)}


def test_upper_median(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice([None, 1, 2, 5, 9])) for _ in range(60)] + [("none", None), (None, 3)]
    want = {}
    for g, v in rows:
        want.setdefault(g, []).extend([v] if v is not None else [])
    got = {r["g"]: r["median"] for r in notes.upper_median(spark.createDataFrame(rows, "g string, v int"), "g", "v").collect()}
    assert got == {g: float(sorted(v)[len(v) // 2]) if v else 0.0 for g, v in want.items()}


def test_graph_search_ranks(spark):
    d = spark.createDataFrame([(1, "Rain in spring"), (2, "On rain"), (3, "Snow"), (4, "RÁIN"), (5, None)], "id long, title string")
    a = spark.createDataFrame([(3, "Rainer"), (1, "Rainer"), (5, "Other")], "document_id long, family string")
    assert [tuple(r) for r in notes.graph_search(d, a, "rain").collect()] == [(1, 0), (4, 0), (2, 1), (3, 2)]
    assert notes.graph_search(d, a, "r").count() == 0
