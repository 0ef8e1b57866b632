"""Blocks quoted from every text and marks made safe for exports, and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblark.functions import exports
from biblark.plans.library import Library, cte


def digest(lib: Library, value) -> DataFrame:
    return lib.table("documents").select(F.col("doc_id").alias("id"), F.sha2(value, 256).alias("digest"))


def blocks(lib: Library) -> DataFrame:
    """Every text as a quotation (selections joined), as code and as it is; with and without keys, pages and labels."""
    i = F.col("doc_id")
    key, title = F.when(i % 2 == 0, F.concat(F.lit(" key"), i.cast("string"))), F.concat(F.lit("Text [["), "lang", F.lit("|x]]"))
    page, label = F.when(i % 3 == 0, i % 100), F.when(i % 5 == 0, " Summary ")
    said = {
        "quote": exports.quote_block(F.col("text"), key, title, page, label),
        "joined": exports.quote_block(F.col("text"), key, title, page, label, collapse=True),
        "code": exports.code_block(F.col("text"), F.lit("latex"), key, title, page, label),
        "raw": exports.raw_block(F.col("text"), key, title, page, label),
    }
    return lib.table("documents").select(i.alias("id"), *[F.sha2(v, 256).alias(k) for k, v in said.items()])


REF = "CASE WHEN doc_id % 2 = 0 THEN '[[@key' || doc_id || ']]' ELSE '[[Text ' || lang || 'x]]' END"
PAGE = "CASE WHEN doc_id % 3 = 0 THEN ', p. ' || (doc_id % 100) ELSE '' END"
SAFE = "replace(replace({0}, '[[', '[\\['), ']]', ']\\]')"
QUOTED = "array_to_string(list_transform(string_split({0}, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^\\s*$') THEN '>' ELSE '> ' || l END), chr(10)) || chr(10) || '>' || chr(10) || '> — ' || CASE WHEN doc_id % 5 = 0 THEN 'Summary ' || r ELSE r || p END"
CAPTION = "chr(10) || chr(10) || '*' || CASE WHEN doc_id % 5 = 0 THEN 'Summary ' ELSE '' END || r || p || '*'"
QUERIES = {
    "note_blocks": (
        blocks,
        f"""WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS t, {REF} AS r, {PAGE} AS p FROM documents),
            b AS (SELECT *, regexp_replace(t, '\\n+$', '') AS body FROM d),
            f AS (SELECT *, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(body, '`+'), lambda x: length(x))), 0))) AS fence FROM b)
            SELECT doc_id AS id, sha256({QUOTED.format(SAFE.format("regexp_replace(regexp_replace(t, '[ \\t]+(\\n|$)', '\\1', 'g'), '^\\s+|\\s+$', '', 'g')"))}) AS quote,
                sha256({QUOTED.format(SAFE.format("trim(regexp_replace(t, '\\s+', ' ', 'g'))"))}) AS joined,
                sha256(fence || 'latex' || chr(10) || body || chr(10) || fence || {CAPTION}) AS code, sha256({SAFE.format('body')} || {CAPTION}) AS raw FROM f""",
    ),
    "latex_escaped": (
        lambda lib: digest(lib, exports.latex_escaped(F.col("text"))),
        "SELECT doc_id AS id, sha256(array_to_string(list_transform(string_split(text, '\\'), lambda x: replace(replace(regexp_replace(x, '([{}#$%&_])', '\\\\\\1', 'g'), '~', '\\textasciitilde{}'), '^', '\\textasciicircum{}')), '\\textbackslash{}')) AS digest FROM documents",
    ),
    "html_escaped": (lambda lib: digest(lib, exports.html_escaped(F.col("text"))), "SELECT doc_id AS id, sha256(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM documents"),
    "notes_for_export": (
        lambda lib: lib.notes.select("id", exports.without_marks(F.col("body")).alias("body")),
        cte("SELECT id, regexp_replace(regexp_replace(body, '\\[\\[[^\\[\\]]*\\|([^\\[\\]|]*)\\]\\]', '\\1', 'g'), '\\[\\[([^\\[\\]]+)\\]\\]', '\\1', 'g') AS body FROM lib_notes"),
    ),
}
