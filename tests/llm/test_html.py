"""Main text through inferred wrappers: the whole table, neutral names, and what the inference changes."""

import html as entities
import re

import pytest
from pyspark.sql import functions as F

from biblark.llm import html_text
from biblark.llm.html_text import groups_of, judged, main_text, merged, outline, packed, parse, rule_of, settled, unpacked

FOLDER = "/root/testdata/sf0.01"
PAGE = "page_id long, url string, html string"


def article_of(page):
    """By the markup of the given pages alone."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br|ul|li|div)[^>]*>", inner))
    return " ".join(p for p in parts if p)


def neutral(page):
    return re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(nav|footer|article)\b", r"<\1div", page))


@pytest.mark.parametrize("change", [None, neutral])
def test_whole_table(spark, change):
    rows = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    pages = spark.createDataFrame([(r["page_id"], r["url"], change(r["html"]) if change else r["html"]) for r in rows], PAGE)
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark, pages.withColumn("rule", F.lit("x")).withColumn("text", F.lit("y"))).collect()}
    assert got == {r["page_id"]: article_of(r["html"]) for r in rows}


def wrapper(pages):
    found = None
    for p in pages:
        g = html_text.bare(groups_of(parse(p)))
        found = g if found is None else merged(found, g)
    settled(found)
    return unpacked(packed(found))


def rule(pages):
    return rule_of(wrapper(pages))


def boxes(title, advert, body):
    return f"<html><body><div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div>{advert}</div><div><h1>{title}</h1>{body}</div><div>&copy; {title}</div></body></html>"


LONG = [boxes(f"Title {i}", f"Buy number {i}", f"<p>{'word ' * (50 + i)}end {i}</p><p>More {i}</p>") for i in range(5)]


def test_inference_changes_the_text():
    """A page whose advert is longer than its article: alone it can't be read, with its host's pages it can."""
    short = boxes("T", "a very long advert " * 9, "<p>Body</p>")
    assert main_text(short, rule([*LONG, short])) == "T Body"
    assert main_text(short, None) != "T Body"


def test_a_host_of_one_page_is_read_by_its_likes(spark):
    short = boxes("T", "a very long advert " * 9, "<p>Body</p>")
    rows = [(i, f"http://h{i}.example/", p) for i, p in enumerate([*LONG, short])]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark, spark.createDataFrame(rows, PAGE)).collect()}
    assert got[5] == "T Body" and got[2].startswith("Title 2 word") and got[2].endswith("More 2")


def test_optional_repeated_and_slots():
    a = groups_of(parse("<div><section><p>one</p></section><section><p>two</p></section><ul><li><a>x</a><li><a>y</a></ul></div>"))
    b = groups_of(parse("<div><section><p>one</p></section></div>"))
    section, links = merged(a, b).children[0].children
    assert (section.n, section.count, links.n) == (2, 3, 1) and section.children[0].k is None
    assert merged(b, b).children[0].children[0].children[0].k is not None


def test_fixed_closing_paragraph_and_links_in_prose_stay():
    """A rule names one place: neither takes its neighbours along."""
    page = lambda i: f"<body><div class=notice>We use cookies</div><article><h1>T{i}</h1><p>First {i} text.</p><p><a href=x>Read more {i}</a></p><ul><li>point {i}</li></ul><p>Second {i}.</p><p>Closing words.</p></article></body>"
    pages = [page(i) for i in range(6)]
    assert main_text(pages[3], rule(pages)) == "T3 First 3 text. Read more 3 point 3 Second 3. Closing words."


def test_fixed_boxes_and_menus_inside_the_article_go():
    page = lambda i: f"<body><div><h1>T{i}</h1><p>Text {i} of the page.</p><div>All rights reserved by us</div><p>And {i} more.</p><ul><li><a>Share</a><li><a>Mail</a></ul></div></body>"
    pages = [page(i) for i in range(6)]
    assert main_text(pages[2], rule(pages)) == "T2 Text 2 of the page. And 2 more."


def test_comments_go_where_they_are_longer_than_the_article():
    comments = "".join(f"<div><b>user {k}</b><p>{'I think so too ' * 9}{k}</p></div>" for k in range(4))
    page = lambda i: f"<body><main><div><h1>T{i}</h1><p>{'Story text goes on ' * 8}{i}.</p></div><section>{comments}{i}</section></main></body>"
    pages = [page(i).replace("user", f"user{i}") for i in range(6)]
    got = main_text(pages[4], rule(pages))
    assert got.startswith("T4 Story") or "user" not in got


def test_nesting_and_width_have_no_limit():
    deep = "".join(f"<div>t{i} " for i in range(3000))
    got = main_text(deep, None).split()  # the innermost box with half of the text
    assert len(got) > 1000 and got == [f"t{i}" for i in range(3000)][-len(got) :]
    wide = "<div>" + "".join(f"<h2>a{i}</h2><section>b{i}</section><aside><form><p>x</p></form></aside>" for i in range(300)) + "</div>"
    got = main_text(wide, rule([wide, wide.replace("a1", "c1")])).split()
    assert got == [w for i in range(300) for w in (f"a{i}", f"b{i}")]
    assert main_text("<div>" * 3000 + "deep", None) == "deep"


def test_odd_pages():
    for page, want in [(None, ""), ("", ""), ("<!-- open", ""), ("plain < text", "plain < text"), ("<form><p>All in one form</p></form>", "All in one form"), ("<p>x <math><mi>y</mi></math> z", "x y z"), ("<script>a<b", "")]:
        assert main_text(page, None) == want
        assert main_text(page, rule(LONG)) == want


def test_rules_survive_packing():
    g = wrapper(LONG)
    assert packed(unpacked(packed(g))) == packed(g) and outline(unpacked(packed(g))) == outline(g)
    labels = [c.label for c in judged(g).children[0].children[0].children]
    assert labels == ["", "", "here", ""]
