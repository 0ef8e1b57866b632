"""Titles of first pages over all documents, and SQL. The head of each document gets what publishers print there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.functions import titles
from biblark.plans.library import Library


def heads(lib: Library) -> DataFrame:
    """Every text, behind a banner, behind a journal's name and homepage, or as it is."""
    k = F.col("doc_id") % 4
    front = F.when(k == 0, "Downloaded from x\r© 2021 Publisher\n").when(k == 1, "Contents lists available at Y\nJournal of Z\njournal homepage: z.org\n").when(k == 2, " \n").otherwise("")
    return lib.table("documents").select(F.col("doc_id").alias("id"), F.concat(front, F.regexp_replace("text", r"\. ", "\n")).alias("text"))


def recovered(lib: Library) -> DataFrame:
    """(id, place, variant) of every variant of every document."""
    return heads(lib).select("id", F.posexplode(titles.title_variants(F.col("text"))).alias("place", "variant"))


def gated(lib: Library) -> DataFrame:
    """(id, n): how many variants match the first line of the document itself by the strong test."""
    own = lib.table("documents").select(F.col("doc_id").alias("id"), T.first_line(F.regexp_replace("text", r"\. ", "\n")).alias("title"))
    return recovered(lib).join(own, "id").groupBy("id").agg(F.count_if(T.titles_match(F.col("variant"), F.col("title"))).alias("n"))


TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
TIDY = TRIM.format(f"regexp_replace({TRIM}, '[: ,.\\-]+$', '')")
STARTS = "|".join(w.replace(".", "\\.").replace("(", "\\(").replace(")", "\\)") for w in titles.BANNER_STARTS)
BANNER = f"(length({{0}}) < 3 OR regexp_matches(lower({{0}}), '^({STARTS})|{'|'.join(titles.BANNER_PHRASES)}'))"
HEADS = f"""h AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'Downloaded from x' || chr(13) || '© 2021 Publisher' || chr(10) WHEN 1 THEN 'Contents lists available at Y' || chr(10) || 'Journal of Z' || chr(10) || 'journal homepage: z.org' || chr(10) WHEN 2 THEN ' ' || chr(10) ELSE '' END
        || replace(text, '. ', chr(10)) AS text FROM documents),
    l AS (SELECT id, list_filter(list_transform(regexp_split_to_array(text, '[\\r\\n]'), lambda x: {TRIM.format('x')}), lambda x: x <> '') AS l FROM h),
    f AS (SELECT id, l[1:12] AS l, l[1:10] AS t FROM l),
    b AS (SELECT id, l, t[coalesce(list_position(list_transform(t, lambda x: {BANNER.format('x')}), false), 99):] AS t FROM f),
    s AS (SELECT id, l, CASE WHEN lower(t[2]) LIKE '%journal homepage%' THEN t[3:][coalesce(list_position(list_transform(t[3:], lambda x: {BANNER.format('x')}), false), 99):] ELSE t END AS t FROM b),
    j AS (SELECT id, l, CASE WHEN t[2] IS NULL OR regexp_matches(t[1], '[.?!]$') OR regexp_matches(lower(t[2]), '^(abstract|introduction)') OR {BANNER.format('t[2]')} OR regexp_matches(t[2], '[{titles.MARKERS}0-9]') THEN t[1] ELSE t[1] || ' ' || t[2] END AS t FROM s),
    t AS (SELECT id, l, {TIDY.format(f"regexp_replace(t, '(?s)[{titles.MARKERS}].*', '')")} AS t FROM j),
    first AS (SELECT id, l, CASE WHEN length(t) >= 4 THEN t END AS title FROM t)"""
FOLDED = "replace(translate(lower({0}), '" + T.FOLD_FROM + "', '" + T.FOLD_TO + "'), 'ß', 'ss')"
PLAIN = "trim(regexp_replace(" + FOLDED + ", '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
VARIANTS = f"""{HEADS},
    c AS (SELECT id, list_filter(list_transform(list_concat([title], list_filter(l[1:6], lambda x: NOT {BANNER.format('x')}),
        list_transform(list_filter(range(1, 5), lambda i: l[i + 1] IS NOT NULL AND NOT {BANNER.format('l[i]')} AND NOT {BANNER.format('l[i + 1]')} AND NOT starts_with(lower(l[i + 1]), 'abstract')), lambda i: l[i] || ' ' || l[i + 1])), lambda x: {TIDY.format('x')}), lambda x: length(x) >= 8) AS c FROM first),
    d AS (SELECT id, list_concat(c, list_filter([{', '.join(f"CASE WHEN contains(c[1], '{sep}') THEN {TIDY.format(f'split_part(c[1], {sep!r}, 1)')} END" for sep in titles.TAILS)}], lambda x: length(x) >= 8)) AS c FROM c),
    e AS (SELECT id, unnest(c) AS variant, unnest(range(len(c))) AS k FROM d),
    g AS (SELECT id, {PLAIN.format('variant')} AS plain, arg_min(variant, k) AS variant, min(k) AS k FROM e GROUP BY 1, 2),
    v AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INT) AS place, variant FROM g QUALIFY place < 6)"""

QUERIES = {
    "first_page_titles": (lambda lib: heads(lib).select("id", titles.first_line_title(F.col("text")).alias("title")), f"WITH {HEADS} SELECT id, title FROM first"),
    "title_variants": (recovered, f"WITH {VARIANTS} SELECT * FROM v"),
    "titles_recovered": (gated, None),
}
