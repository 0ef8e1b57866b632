"""The kept index: equal to scans, however its texts came about, and reading the buckets of its terms only."""

import random
import re

import pytest

from biblark.functions import text as T
from biblark.operators import notes, retrieval
from biblark.operators.search_index import SearchIndex

DOCS = "id long, title string, body string"
CHANGES = DOCS + ", gone boolean"
WORDS = ["río", "rio", "straße", "strasse", "the", "a_b", "3.14", "Ok", "ok!", "n", "x"]


def made(rng):
    return rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randrange(1, 9)))]), " ".join(rng.choices(WORDS, k=rng.randrange(0, 30)))


def state(index):
    at = index.last()
    rows = index._living(index._segments("postings", "id long, field int, term string, tf long, length long, positions array<int>", at), at)
    return at.docs, at.words, sorted((r["id"], r["field"], r["term"], r["tf"], r["length"], tuple(r["positions"])) for r in rows.collect())


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_changes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(5)
    live = {i: made(rng) for i in range(40)}
    index = SearchIndex(spark, f"file://{tmp_path}/kept", "id", ["title", "body"])
    index.build(spark.createDataFrame([(i, *t) for i, t in live.items()], DOCS))
    for step in range(4):
        changes = {}
        for i in rng.sample(range(60), 15):
            gone = rng.random() < 0.3
            text = live.get(i) if rng.random() < 0.3 and i in live else made(rng)
            changes[i] = (*text, gone)
            if gone:
                live.pop(i, None)
            else:
                live[i] = text
        index.update(spark.createDataFrame([(i, *c) for i, c in changes.items()], CHANGES))
        if step == 2:
            index.merge()
            assert len(index.last().segments) == 1
    docs = spark.createDataFrame([(i, *t) for i, t in live.items()], DOCS)
    fresh = SearchIndex(spark, f"file://{tmp_path}/fresh", "id", ["title", "body"])
    fresh.build(docs)
    assert state(index) == state(fresh)
    assert not index.stale(docs)
    for text in ("rio", "strasse the", "3.14 OK", "ok x n"):
        terms = index.terms_of(text)
        assert ids(index.match_all(text)) == ids(retrieval.match_all(docs, "id", ["title", "body"], terms))
        assert [tuple(r) for r in index.bm25(text, 7).collect()] == [tuple(r) for r in retrieval.bm25(docs, "id", ["title", "body"], terms, 7).collect()]
        phrase = {i for c in ("title", "body") for i in ids(retrieval.match_phrase(docs, "id", c, terms))}
        assert set(ids(index.match_phrase(text))) == phrase


def test_equal_texts_are_left_alone(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i", "id", ["title", "body"])
    index.build(spark.createDataFrame([(1, None, "a"), (2, "b", None)], DOCS))
    same = spark.createDataFrame([(1, None, "a", False), (2, "b", None, False), (9, "x", "x", True)], CHANGES)
    assert index.update(same) == 0 and index.last().segment == 1


def test_a_broken_segment_does_not_count(spark, tmp_path):
    """Postings without a commit row are not there, and the next update writes them over."""
    index = SearchIndex(spark, f"file://{tmp_path}/i", "id", ["title", "body"])
    index.build(spark.createDataFrame([(1, None, "apple")], DOCS))
    index._write(2, spark.createDataFrame([(2, None, "apple")], DOCS), 16)
    assert ids(index.match_all("apple")) == [1]
    assert index.update(spark.createDataFrame([(3, None, "apple", False)], CHANGES)) == 1
    assert ids(index.match_all("apple")) == [1, 3]


def test_stale_index_is_rebuilt(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i", "id", ["title", "body"])
    docs = spark.createDataFrame([(1, None, "apple")], DOCS)
    assert index.reconcile(docs) and not index.reconcile(docs)
    assert index.reconcile(docs.unionByName(spark.createDataFrame([(2, None, "apple")], DOCS)))
    assert ids(index.match_all("apple")) == [1, 2]


def test_empty(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i", "id", ["title", "body"])
    index.build(spark.createDataFrame([], DOCS))
    assert not ids(index.match_all("apple")) and not ids(index.match_all(" ")) and not ids(index.match_phrase("")) and not ids(index.bm25("a", 3)) and not ids(index.bm25("", 3))


def test_reads_the_buckets_of_its_terms(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i", "id", ["title", "body"])
    index.build(spark.createDataFrame([(i, None, f"w{i} w{i % 7}") for i in range(300)], DOCS))
    hits = index.hits(["w3"])
    plan = hits._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*term", plan)
    read = {r[0].rsplit("/", 2)[1] for r in hits.select("_metadata.file_path").distinct().collect()}
    assert read == {f"bucket={hits.first()['bucket']}"}


@pytest.mark.parametrize(("body", "word", "expected"), [("x Müller y", "muller", "x Müller y"), ("die Straße", "strasse", "die Straße"), ("İstanbul ok", "ok", "İstanbul ok"), ("booking", "ok", None), (None, "a", None), ("a" * 95 + " hit " + "b" * 95, "hit", "a" * 89 + " hit " + "b" * 89)])
def test_excerpt_of_term(spark, body, word, expected):
    assert spark.createDataFrame([(body,)], "b string").select(T.excerpt_of_term(T.F.col("b"), word)).first()[0] == expected


def test_search_shows_the_column_that_holds_the_word(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i", "id", ["title", "body"])
    rows = spark.createDataFrame([(1, "Über Äpfel", "nothing here"), (2, "", "zwei ÄPFEL über")], DOCS)
    index.build(rows)
    assert {tuple(r) for r in notes.search(index, rows, "äpfel Über").collect()} == {(1, "Über Äpfel"), (2, "zwei ÄPFEL über")}


@pytest.mark.parametrize("query", ["müller", "MULLER", "müller"])
def test_graph_search_folds_both_sides(spark, query):
    docs = spark.createDataFrame([(1, "Müller und Söhne"), (2, "Der Muller"), (3, "Møller"), (4, "x")], "id long, title string")
    authors = spark.createDataFrame([(4, "Anna-Müller")], "document_id long, family string")
    assert [tuple(r) for r in notes.graph_search(docs, authors, query).collect()] == [(1, 0), (2, 1), (4, 2)]


def test_log_lines_keep_long_names(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select("id", F.lit("2024-01-02 03:04:05").cast("timestamp").alias("ts"), F.lit("a-long-node-name").alias("node"), F.lit("in-progress").alias("state"), F.lit("l").alias("label"), F.lit(None).cast("long").alias("done"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("string").alias("detail"))
    assert notes.log_lines(row).first()["line"] == "2024-01-02 03:04:05Z  a-long-node-name in-progress l"
