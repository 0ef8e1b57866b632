"""The title of a paper from the lines at the head of its first page, and the strings that are tried for it.

Null texts and texts without a usable line have no title and no variants. Only the first lines are looked at, as is the
rule for first pages; white space and letters are Unicode's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblark.functions import text as T

# How lines of a publisher begin, and what they contain.
BANNER_STARTS = ["http://", "https://", "www.", "doi:", "arxiv:", "issn", "e-issn", "isbn", "©", "(c) 20"]
BANNER_PHRASES = ["lists available at", "available online at", "copy available at", "journal homepage", "downloaded from", "content downloaded", "rights reserved", "creative commons", "copyright ", "©"]
# Marks of an author's affiliation, separators before a subtitle or a venue.
MARKERS = "∗†‡§"
TAILS = [" - ", " — ", " | "]

HEAD_LINES, VARIANT_LINES, MOST_VARIANTS = 10, 12, 6


def quoted(words: list[str]) -> str:
    return "|".join(rf"\Q{w}\E" for w in words)


BANNER = rf"^(?:{quoted(BANNER_STARTS)})|{quoted(BANNER_PHRASES)}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def head_lines(text: Column, most: int) -> Column:
    """The first lines that are not blank."""
    lines = F.transform(F.split(text, "[\r\n]"), trimmed)
    return F.slice(F.filter(lines, lambda line: line != ""), 1, most)


def is_banner(line: Column) -> Column:
    """A line of the publisher: shorter than three characters, a link, an identifier, a notice."""
    return (F.length(line) < 3) | F.lower(line).rlike(BANNER)


def after_banners(lines: Column) -> Column:
    """Without the banners at the front; banners further down stay."""
    return let(F.array_position(F.transform(lines, is_banner), F.lit(False)).cast("int"), lambda at: F.when(at > 0, F.slice(lines, at, F.size(lines))).otherwise(F.slice(lines, 1, 0)))


def tidy(c: Column) -> Column:
    return trimmed(F.regexp_replace(trimmed(c), r"[: ,.\-]+\z", ""))


def first_line_title(text: Column) -> Column:
    """The first line after the publisher's, also after a journal's name between them and its homepage; with the next line
    where it is no complete sentence and the next has no sign of authors or of an abstract; up to the first mark
    of an affiliation. Null below four characters."""

    def title(lines: Column) -> Column:
        first, second = F.get(lines, 0), F.get(lines, 1)
        other = F.lower(second).rlike("^(?:abstract|introduction)") | is_banner(second) | second.rlike(f"[{MARKERS}0-9]")
        joined = F.when(second.isNull() | first.rlike(r"[.?!]\z") | other, first).otherwise(F.concat(first, F.lit(" "), second))
        return let(tidy(F.regexp_replace(joined, f"(?s)[{MARKERS}].*", "")), lambda t: F.when(F.length(t) >= 4, t))

    def past_homepage(lines: Column) -> Column:
        return F.when(F.lower(F.get(lines, 1)).contains("journal homepage"), after_banners(F.slice(lines, 3, HEAD_LINES))).otherwise(lines)

    return let(let(after_banners(head_lines(text, HEAD_LINES)), past_homepage), title)


def title_variants(text: Column) -> Column:
    """Up to six strings of eight characters or more that may be the title, likeliest first, no two with the same words:
    the title above, the first six lines alone, the first four pairs of neighbours, and the first
    variant up to a separator."""

    def variants(lines: Column) -> Column:
        alone = F.filter(F.slice(lines, 1, 6), lambda line: ~is_banner(line))
        pairs = F.transform(F.slice(lines, 1, 4), lambda line, i: F.struct(line.alias("a"), F.get(lines, i + 1).alias("b")))
        good = F.filter(pairs, lambda p: p["b"].isNotNull() & ~is_banner(p["a"]) & ~is_banner(p["b"]) & ~F.lower(p["b"]).startswith("abstract"))
        found = F.concat(F.array(first_line_title(text)), alone, F.transform(good, lambda p: F.concat(p["a"], F.lit(" "), p["b"])))
        return let(long_enough(F.transform(found, tidy)), with_cuts)

    def with_cuts(found: Column) -> Column:
        first = F.get(found, 0)
        cuts = F.array(*[F.when(first.contains(sep), tidy(F.substring_index(first, sep, 1))) for sep in TAILS])
        return let(F.concat(found, long_enough(cuts)), lambda every: F.slice(T.distinct_in_order(every, T.plain_title), 1, MOST_VARIANTS))

    return let(head_lines(F.coalesce(text, F.lit("")), VARIANT_LINES), variants)


def long_enough(items: Column) -> Column:
    return F.filter(items, lambda t: F.length(t) >= 8)
