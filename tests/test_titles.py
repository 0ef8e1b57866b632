"""Titles of first pages by cases with known answers."""

import re

import pytest
from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.functions import titles

CASES = {
    "Downloaded from https://x.org\r© 2021 Publisher\rISSN 1234-5678\re-ISSN 8765-4321\rISBN 978-0-000\rThis content downloaded from 1.2.3.4\rDeep Residual Learning for Image Recognition.": "Deep Residual Learning for Image Recognition",
    "Machine Learning Approaches to Protein Folding.\rAvailable at ScienceDirect\rJournal of Computational Biology": "Machine Learning Approaches to Protein Folding",
    "A Workshop on Reproducibility Is Not Enough.\rJane Doe": "A Workshop on Reproducibility Is Not Enough",
    "Contents lists available at ScienceDirect\rArtificial Intelligence in Medicine\rjournal homepage: www.elsevier.com/locate/artmed\rDeep learning for retinal disease detection\rJane Doe1, John Smith2": "Deep learning for retinal disease detection",
    "Me, Myself, and AI:\r The Situational Awareness Dataset (SAD) for LLMs\r Rudolf Laine\r Independent": "Me, Myself, and AI: The Situational Awareness Dataset (SAD) for LLMs",
    "xLSTM: Extended Long Short-Term Memory\rMaximilian Beck∗ 1,2,3\rKorbinian Pöppel": "xLSTM: Extended Long Short-Term Memory",
    "Titans: Learning to Memorize at Test Time Ali Behrouz†, Peilin Zhong": "Titans: Learning to Memorize at Test Time Ali Behrouz",
    "ab\ncd": None,
    "": None,
    None: None,
    "doi:10.1/x\nwww.x.org": None,
    "A title\nAbstract of it": "A title",
    " Wide space around \n ": "Wide space around",
}


def test_first_line_titles(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "id int, text string")
    got = {r["id"]: r["t"] for r in rows.select("id", titles.first_line_title(F.col("text")).alias("t")).collect()}
    assert got == dict(enumerate(CASES.values()))


def variants(spark, text):
    return spark.createDataFrame([(text,)], "text string").select(titles.title_variants(F.col("text")).alias("v")).first()["v"]


def test_variants_find_a_buried_title(spark):
    head = "Published as a conference paper at ICLR 2026\n Scaling Laws for Neural Language Models\n Jared Kaplan1, Sam McCandlish1\n Abstract\n"
    found = variants(spark, head)
    assert 0 < len(found) <= 6
    rows = spark.createDataFrame([(v,) for v in found], "v string")
    match = lambda title: rows.where(T.titles_match(F.col("v"), F.lit(title))).count()
    assert match("Scaling Laws for Neural Language Models") > 0
    assert match("Jared Kaplan Sam McCandlish") == 0
    assert len({re.sub(r"\W+", " ", v.lower()).strip() for v in found}) == len(found)


@pytest.mark.parametrize("text", ["", "ab\ncd", None])
def test_no_variants(spark, text):
    assert variants(spark, text) == []


def test_variants_cut_at_a_separator(spark):
    assert variants(spark, "Maps of the north - a history.") == ["Maps of the north - a history", "Maps of the north"]
    assert variants(spark, "One long line\ntwo long lines") == ["One long line two long lines", "One long line", "two long lines"]
