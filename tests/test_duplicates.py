"""Duplicates by content, DOI and title on the real titles, against a union of all equal keys."""

import re

import pytest

from biblark import queries
from biblark.functions.text import TITLE_STOP
from biblark.operators import identity
from biblark.plans.library import Library

FOLDER = "/root/testdata/sf0.01"


def distinctive(title):
    return {w for w in re.split("[^a-z0-9]+", title.lower()) if len(w) >= 4 and w not in TITLE_STOP}


def test_groups_by_brute_force(spark):
    docs = Library.of(spark, FOLDER).live.select("id", "file_hash", "doi", "title").collect()
    root = {r["id"]: r["id"] for r in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links, count = set(), {}
    for key in ("file_hash", "doi", "title"):
        first = {}
        for r in sorted(docs, key=lambda r: r["id"]):
            if r[key] is not None and (key != "title" or len(distinctive(r[key])) >= 3) and first.setdefault(r[key], r["id"]) != r["id"]:
                links.add((first[r[key]], r["id"]))
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    for i in root:
        count[find(i)] = count.get(find(i), 0) + 1
    assert {tuple(r) for r in queries.QUERIES["duplicate_links_all"](spark, FOLDER).collect()} == links
    got = {r["id"]: r["group"] for r in queries.QUERIES["duplicate_groups_all"](spark, FOLDER).collect()}
    assert got == {i: find(i) for i in root if count[find(i)] > 1}


def test_unsettled_components_raise(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        identity.components(links, rounds=1)


def test_criteria_chain(spark):
    rows = [(1, "h1", None, "Robust estimation of hidden markov chains"), (2, "h1", "10.1/a", "Other"), (3, "h3", None, "ROBUST estimation of hidden Markov-chains"), (4, "h4", "10.1/A", "More"), (5, "h5", None, "Other")]
    docs = spark.createDataFrame([(*r, None) for r in rows], "id long, file_hash string, doi string, title string, deleted_at timestamp")
    assert {r["id"]: r["group"] for r in identity.duplicate_groups(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
