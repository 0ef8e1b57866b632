"""What a note takes from a paper, and what leaves it for HTML and LaTeX, as column expressions.

Null texts count as empty in blocks and stay null elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblark.functions.titles import let, trimmed

# Image types that a LaTeX document can hold, the title of works that have none.
RASTER = {"png": "png", "jpeg": "jpg", "jpg": "jpg", "gif": "gif", "webp": "webp"}
UNTITLED = "senza titolo"


def without_marks(markdown: Column) -> Column:
    """``[[target]]`` and ``[[target|label]]`` become their label, without leading @."""
    return F.regexp_replace(markdown, r"(?U)\[\[(?=[^\[\]])(?:[^\[\]]*\|)?\s*@*([^\[\]|]*?)\s*\]\]", "$1")


def html_escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def latex_escaped(c: Column) -> Column:
    """Characters that LaTeX reads as commands, made literal; for texts and for links."""
    def plain(part: Column) -> Column:
        marked = F.regexp_replace(part, r"([{}#$%&_])", r"\\$1")
        return F.replace(F.replace(marked, F.lit("~"), F.lit(r"\textasciitilde{}")), F.lit("^"), F.lit(r"\textasciicircum{}"))

    return F.array_join(F.transform(F.split(c, r"\\", -1), plain), r"\textbackslash{}")


def data_image(url: Column) -> Column:
    """struct(ext, bytes) of a ``data:`` link with an image in base 64; null for other links, types and broken codes."""
    kind = F.lower(F.regexp_extract(url, r"(?s)^data:image/(.*?);base64,", 1))
    code = trimmed(F.regexp_replace(url, r"(?s)^data:image/.*?;base64,", ""))
    ext = F.element_at(F.create_map(*[F.lit(x) for pair in RASTER.items() for x in pair]), kind)
    sound = (F.length(code) % 4 == 0) & code.rlike(r"^[A-Za-z0-9+/]*+={0,2}\z")
    return F.when(ext.isNotNull() & sound, F.struct(ext.alias("ext"), F.unbase64(code).alias("bytes")))


def reference_mark(citekey: Column, title: Column) -> Column:
    """``[[@citekey]]``, else ``[[title]]`` without the characters that break it."""
    key = trimmed(citekey)
    safe = trimmed(F.translate(F.coalesce(title, F.lit("")), "[]|", ""))
    return F.when(key != "", F.concat(F.lit("[[@"), key, F.lit("]]"))).otherwise(F.concat(F.lit("[["), F.when(safe == "", UNTITLED).otherwise(safe), F.lit("]]")))


def unlinked(c: Column) -> Column:
    """Doubled brackets escaped, so that quoted text makes no links."""
    return F.replace(F.replace(c, F.lit("[["), F.lit("[\\[")), F.lit("]]"), F.lit("]\\]"))


def lines_of(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n"))


def quote_block(content: Column, citekey: Column, title: Column, page: Column, label: Column, collapse: bool = False) -> Column:
    """A block quotation and its source: behind a label, or with its page. ``collapse`` joins the lines of a selection."""
    text = trimmed(F.regexp_replace(lines_of(content), r"(?U)\s+", " ")) if collapse else trimmed(F.regexp_replace(lines_of(content), r"[ \t]+(?=\n|\z)", ""))
    quoted = F.array_join(F.transform(F.split(unlinked(text), "\n", -1), lambda l: F.when(trimmed(l) == "", ">").otherwise(F.concat(F.lit("> "), l))), "\n")
    ref = reference_mark(citekey, title)
    source = F.when(trimmed(label) != "", F.concat(trimmed(label), F.lit(" "), ref)).otherwise(F.concat(ref, F.coalesce(F.concat(F.lit(", p. "), page.cast("string")), F.lit(""))))
    return F.concat(quoted, F.lit("\n>\n> — "), source)


def caption(citekey: Column, title: Column, page: Column, label: Column) -> Column:
    said = F.when(trimmed(label) != "", F.concat(trimmed(label), F.lit(" "))).otherwise("")
    return F.concat(F.lit("\n\n*"), said, reference_mark(citekey, title), F.coalesce(F.concat(F.lit(", p. "), page.cast("string")), F.lit("")), F.lit("*"))


def code_block(content: Column, language: Column, citekey: Column, title: Column, page: Column, label: Column) -> Column:
    """The content between fences longer than any run of backticks in it, its source below."""
    body = F.regexp_replace(lines_of(content), r"\n+\z", "")
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(body, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))
    fenced = let(F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1)), lambda f: F.concat(f, F.coalesce(language, F.lit("")), F.lit("\n"), body, F.lit("\n"), f))
    return F.concat(fenced, caption(citekey, title, page, label))


def raw_block(content: Column, citekey: Column, title: Column, page: Column, label: Column) -> Column:
    """Markdown as it is, but for links that it would make, its source below."""
    return F.concat(unlinked(F.regexp_replace(lines_of(content), r"\n+\z", "")), caption(citekey, title, page, label))
