"""Notes and pages with their links written in, over whole tables, and SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.operators import weaving
from biblark.plans.library import Library, cte


def wiki(lib: Library) -> tuple[DataFrame, DataFrame]:
    """Every document as a page (id, slug, text), and the names of all pages: up to three words at the front of each text."""
    name = F.trim(F.regexp_extract("text", r"^\W*(\w+(?: \w+){0,2})", 1))
    pages = lib.table("documents").select(F.col("doc_id").alias("id"), "text", name.alias("name"))
    return pages.select("id", T.slugify(F.col("name")).alias("slug"), "text"), pages.where("name <> ''").select("name", T.slugify(F.col("name")).alias("slug"))


def digest(df: DataFrame, column: str) -> DataFrame:
    return df.select("id", F.sha2(column, 256).alias("digest"))


QUERIES = {
    "wiki_woven": (lambda lib: digest(weaving.weave_pages(*wiki(lib)), "text"), None),
    "notes_woven": (
        lambda lib: weaving.weave_notes(lib.notes, lib.documents),
        cte("""WITH p AS (SELECT lower(title) AS t, min(id) AS id, any_value(title) AS title FROM lib_live GROUP BY 1),
            n AS (SELECT c_custkey AS id, 'Study of ' || CASE WHEN c_custkey % 2 = 0 THEN 'LOW' ELSE 'MEDIUM' END || ' methods, part ' || (c_custkey % 500) AS paper, c_custkey % 100 + 1 AS other FROM customer)
            SELECT n.id, 'On ' || coalesce('[' || p.title || '](#doc-' || p.id || ')', n.paper) || ' and ' || CASE WHEN k.id IS NULL THEN 'it' ELSE '[it](#doc-' || k.id || ')' END || chr(10) || '```' || chr(10) || '[[not a link]]' || chr(10) || '```' || chr(10)
                || 'see ' || CASE WHEN o.id IS NULL THEN 'Note ' || n.other ELSE '[Note ' || n.other || '](#note-note-' || n.other || ')' END || ' nowhere' AS body
            FROM n LEFT JOIN p ON p.t = lower(n.paper) LEFT JOIN lib_live k ON k.citekey = 'key' || n.id LEFT JOIN lib_notes o ON o.id = n.other"""),
    ),
    "notes_renamed": (
        lambda lib: lib.notes.select("id", weaving.title_set(F.col("body"), F.concat(F.lit("Renamed "), F.col("id").cast("string"))).alias("body")),
        cte("SELECT id, '# Renamed ' || id || substring(body, strpos(body, chr(10))) AS body FROM lib_notes"),
    ),
    "texts_retitled": (
        lambda lib: digest(lib.table("documents").select(F.col("doc_id").alias("id"), weaving.title_set(F.coalesce("text", F.lit("")), F.col("lang")).alias("text")), "text"),
        """WITH l AS (SELECT doc_id AS id, lang, CASE WHEN ends_with(text, chr(10)) THEN chr(10) ELSE '' END AS last, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents),
            a AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(x, '\\S')), true) AS k FROM l)
            SELECT id, sha256(CASE WHEN k IS NULL OR k = 0 THEN '# ' || lang || chr(10) || chr(10) ELSE array_to_string(list_concat(l[1:k - 1], ['# ' || lang], l[k + 1:]), chr(10)) || last END) AS digest FROM a""",
    ),
}
