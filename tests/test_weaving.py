"""Links in notes, linked page names against a plain version, title lines, citations and claims."""

import re

import pytest
from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.operators import weaving
from biblark.plans import weaving_queries
from biblark.plans.library import Library


def applied(spark, values, column):
    rows = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, a string, b string" if isinstance(values[0], tuple) else "i int, a string")
    return [r["x"] for r in rows.orderBy("i").select(column.alias("x")).collect()]


def test_marks_become_links(spark):
    known = {"attention": ("Attention", "#note-attention"), "@vaswani2017": ("Vaswani [2017]", "#doc-42"), "x": ("X", "#note-x")}
    entries = [F.struct(F.lit(k).alias("k"), F.struct(F.lit(a).alias("label"), F.lit(b).alias("href")).alias("v")) for k, (a, b) in known.items()]
    cases = {
        "see [[Attention]] and [[@vaswani2017]] and [[unknown]].": "see [Attention](#note-attention) and [Vaswani (2017)](#doc-42) and unknown.",
        "[[x| A [label]]": "[[x| A [label]]",
        "[[X|A label]] [[lost|its label]]": "[A label](#note-x) its label",
        "a [[ ]] b [[|c]]": "a [[ ]] b [[|c]]",
        "[[[x]]]": "[[X](#note-x)]",
        "```\n[[Attention]]\n```\n": "```\n[[Attention]]\n```\n",
        "```\n~~~\n[[Attention]]\n```\nout [[Attention]]": "```\n~~~\n[[Attention]]\n```\nout [Attention](#note-attention)",
        "[[x]]\r\n\n [[x]]": "[X](#note-x)\r\n\n [X](#note-x)",
        "": "",
        None: None,
    }
    assert applied(spark, list(cases), weaving.woven_marks(F.col("a"), F.map_from_entries(F.array(*entries)))) == list(cases.values())


def test_notes_link_to_notes_before_papers(spark):
    n = spark.createDataFrame([(1, "My Plan", "[[paper]] [[my plan]] [[@KEY|it]] [[gone]]"), (2, "Paper", None), (3, "No links", "x")], "id long, title string, body string")
    d = spark.createDataFrame([(5, "paper", "key", None), (7, "gone", None, "t")], "id long, title string, citekey string, deleted_at string")
    assert {tuple(r) for r in weaving.weave_notes(n, d).collect()} == {(1, "[Paper](#note-paper) [My Plan](#note-my-plan) [it](#doc-5) gone"), (2, None), (3, "x")}


def test_title_lines(spark):
    cases = {
        "# Old\n\nbody": "# New\n\nbody",
        "old title\nmore": "# New\nmore",
        "\n```\nx\n```\n# T\n": "\n```\nx\n```\n# New\n",
        "   \n": "# New\n\n",
        "": "# New\n\n",
        "# Old\r\nbody\r\n": "# New\r\nbody\r\n",
        "```\nonly code": "# New\n\n```\nonly code",
        None: None,
    }
    assert applied(spark, list(cases), weaving.title_set(F.col("a"), F.lit(" New "))) == list(cases.values())


def plain_weave(text, own, pages):
    lines, fence, free = text.split("\n"), "", []
    for line in lines:
        begins = line.lstrip()
        mark = begins[:1] if begins.startswith(("```", "~~~")) else ""
        turns = mark != "" and fence in ("", mark)
        free.append(not turns and fence == "")
        fence = fence if not turns else mark if fence == "" else ""
    for name, slug in sorted(pages, key=lambda p: (-len(p[0]), p)):
        target = f"](#wiki-{slug})"
        if slug == own or len(name) < 4 or any(target in line for line, ok in zip(lines, free) if ok):
            continue
        pattern = re.compile(rf"(?<![^\W_])({''.join(f'[{c.lower()}{c.upper()}]' if c.isascii() and c.isalpha() else re.escape(c) for c in name)})(?![^\W_])")
        for k, line in enumerate(lines):
            if free[k] and not line.lstrip(" ").startswith("#") and "[" not in line and pattern.search(line):
                lines[k] = pattern.sub(lambda m: f"[{m.group(1)}{target}", line, count=1)
                break
    return "\n".join(lines)


def test_names_become_links(spark):
    pages = [("reinforcement learning", "reinforcement-learning"), ("learning", "learning"), ("c++ (2$)", "c-2"), ("rna", "rna"), ("été", "t"), ("Über uns", "ber-uns"), ("of", "of"), ("----", "none"), (None, "null")]
    texts = [
        "## In short\nreinforcement Learning leads.\nAgain reinforcement learning here.",
        "İstanbul and learning in depth", "relearning learnings, learning!", "# learning\n```\nlearning\n```\n [x] learning\nlearning_x learning",
        "use C++ (2$) now\nrna RNA", "see (c++ (2$)", "über uns Über uns", "already [learning](#wiki-learning)\nlearning", "", None, "of ---- all", "learning reinforcement\nthe learning",
    ]
    rows = spark.createDataFrame([(i, "learning" if i == 11 else None, t) for i, t in enumerate(texts)], "id long, slug string, text string")
    names = spark.createDataFrame(pages, "name string, slug string")
    once = weaving.weave_pages(rows, names)
    got = {r["id"]: r["text"] for r in once.collect()}
    usable = [p for p in pages if p[0] and re.search(r"\w", p[0])]
    assert got == {i: None if t is None else plain_weave(t, "learning" if i == 11 else None, usable) for i, t in enumerate(texts)}
    assert got[0] == "## In short\n[reinforcement Learning](#wiki-reinforcement-learning) leads.\nAgain reinforcement [learning](#wiki-learning) here."
    assert got[5] == "see ([c++ (2$)](#wiki-c-2)" and got[11] == texts[11]
    again = weaving.weave_pages(rows.drop("text").join(once, "id"), names)
    assert {r["id"]: r["text"] for r in again.collect()} == got


@pytest.mark.parametrize("empty", ["texts", "names"])
def test_nothing_to_weave(spark, empty):
    rows = spark.createDataFrame([(1, "a", "text with name")][: empty != "texts"], "id long, slug string, text string")
    names = spark.createDataFrame([("name", "name")][: empty != "names"], "name string, slug string")
    assert [tuple(r) for r in weaving.weave_pages(rows, names).collect()] == ([] if empty == "texts" else [(1, "text with name")])


def test_whole_table_against_plain_version(spark):
    lib = Library.of(spark, "/root/testdata/sf0.001")
    texts, names = weaving_queries.wiki(lib)
    once = weaving.weave_pages(texts, names).cache()
    got = {r["id"]: r["text"] for r in once.collect()}
    pages = sorted({s: min(r["name"] for r in rs if len(r["name"]) >= 4) for s, rs in grouped(names).items() if any(len(r["name"]) >= 4 for r in rs)}.items())
    pages = [(name, slug) for slug, name in pages]
    want = {r["id"]: plain_weave(r["text"], r["slug"], pages) for r in texts.collect()}
    assert got == want and sum(t.count("](#wiki-") for t in got.values()) > 20
    again = weaving.weave_pages(texts.drop("text").join(once, "id"), names)
    assert {r["id"]: r["text"] for r in again.collect()} == got


def grouped(names):
    out = {}
    for r in names.collect():
        out.setdefault(r["slug"], []).append(r)
    return out


def test_citations_and_claims(spark):
    md = "First [1]. Second [2, 3]? No: [12]."
    linked = applied(spark, [md], T.link_citations(F.col("a")))[0]
    assert linked == "First [\\[1\\]](#src-1). Second [2, 3]? No: [\\[12\\]](#src-12)."
    assert applied(spark, [linked, "[1](x) \\[2] [3]"], T.link_citations(F.col("a"))) == [linked, "[1](x) \\[2] [\\[3\\]](#src-3)"]
    assert applied(spark, [md], T.cited_numbers(F.col("a"))) == [[1, 12]]
    found = applied(spark, ["- First claim (p. 4)\n- Second without a page\nnoise\n- Third (p. 12)"], T.claims(F.col("a")))[0]
    assert [tuple(c) for c in found] == [("First claim", 4), ("Second without a page", None), ("Third", 12)]
