"""Escapes, embedded images and blocks by cases with known answers."""

import base64

from pyspark.sql import functions as F

from biblark.functions import exports


def applied(spark, column, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, a string")
    return [r["x"] for r in rows.orderBy("i").select(column(F.col("a")).alias("x")).collect()]


def test_marks_become_labels(spark):
    cases = {"[[a]] and [[ a | b ]]": "a and b", "[[@einstein1905]]": "einstein1905", "[[@@x|@@ y]]": " y", "[[a|b|c]]": "c", "[[]] [[ ]] [[|]]": "[[]]  ", "[\\[a]\\] [a]": "[\\[a]\\] [a]", "[[[x]]]": "[x]", "[[two\nlines]]": "two\nlines", None: None}
    assert applied(spark, exports.without_marks, list(cases)) == list(cases.values())


def test_escapes(spark):
    cases = {"a\\b{c}": "a\\textbackslash{}b\\{c\\}", "50% of $x_1 & #2": "50\\% of \\$x\\_1 \\& \\#2", "~^\\\\": "\\textasciitilde{}\\textasciicircum{}\\textbackslash{}\\textbackslash{}", "http://e.com/a%20b": "http://e.com/a\\%20b", "": "", None: None}
    assert applied(spark, exports.latex_escaped, list(cases)) == list(cases.values())
    assert applied(spark, exports.html_escaped, ["<a & b> &amp;", None]) == ["&lt;a &amp; b&gt; &amp;amp;", None]


def test_data_images(spark):
    code = base64.b64encode(b"hello").decode()
    good = {f"data:image/png;base64,{code}": ("png", b"hello"), f"data:image/JPEG;base64, {code}\n": ("jpg", b"hello"), "data:image/gif;base64,": ("gif", b"")}
    bad = ["data:image/svg+xml;base64,PHN2Zz4=", "data:image/png;base64,***", "data:image/png;base64,aGVsbG8", f"x data:image/png;base64,{code}", "http://x.org/a.png", "", None]
    got = applied(spark, exports.data_image, [*good, *bad])
    assert [(r["ext"], bytes(r["bytes"])) for r in got[: len(good)]] == list(good.values())
    assert got[len(good) :] == [None] * len(bad)


def test_blocks(spark):
    one = spark.createDataFrame([("first [[x]] \r\n\r\nsecond\t\n", " key ", "T", 4)], "a string, k string, t string, p int")
    of = lambda column: one.select(column.alias("x")).first()["x"]
    a, k, t, p, none = F.col("a"), F.col("k"), F.col("t"), F.col("p"), F.lit(None).cast("string")
    assert of(exports.quote_block(a, k, t, p, none)) == "> first [\\[x]\\]\n>\n> second\n>\n> — [[@key]], p. 4"
    assert of(exports.quote_block(a, none, F.lit(" A [b] | c "), p, F.lit(" Note "), collapse=True)) == "> first [\\[x]\\] second\n>\n> — Note [[A b  c]]"
    assert of(exports.quote_block(none, F.lit(" "), none, none, F.lit(" "))) == ">\n>\n> — [[senza titolo]]"
    assert of(exports.code_block(F.lit("x ```` y\n\n"), F.lit("latex"), k, t, none, F.lit("Eq"))) == "`````latex\nx ```` y\n`````\n\n*Eq [[@key]]*"
    assert of(exports.code_block(none, F.lit("latex"), k, t, p, none)) == "```latex\n\n```\n\n*[[@key]], p. 4*"
    assert of(exports.raw_block(F.lit("| [[a]] |\r\n\n"), k, t, p, none)) == "| [\\[a]\\] |\n\n*[[@key]], p. 4*"
