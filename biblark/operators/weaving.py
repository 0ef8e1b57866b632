"""Links written into texts: marks ``[[target]]`` resolved, titles of other pages linked where they are named, title lines set.

Null texts stay null. Fences of three backticks or tildes end with one of their own kind; what they hold stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.functions.titles import let, trimmed
from biblark.operators.notes import LINK, note_links
from biblark.operators.storage import stored

LEAST_NAME = 4
LETTER = r"[\p{IsAlphabetic}\p{N}]"
# Words of a name that find it; bits a name and probes of the filter over all names; characters hashed at once.
GRAM, BITS, PROBES, CHARS = 3, 16, 4, 1 << 20
BLANK = "".join(map(chr, [*range(9, 14), 32, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
ASCII = {c: c + 32 for c in range(65, 91)}


def fenced_lines(lines: Column) -> Column:
    """array of struct(line, open): whether each line is outside of fences and no fence itself."""
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<struct<line:string,open:boolean>>").alias("done"))

    def step(state: Column, line: Column) -> Column:
        begins = F.regexp_replace(line, r"(?U)^\s+", "")
        mark = F.when(begins.startswith("```"), "`").when(begins.startswith("~~~"), "~").otherwise("")
        turns = (mark != "") & ((state["fence"] == "") | (mark == state["fence"]))
        fence = F.when(~turns, state["fence"]).when(state["fence"] == "", mark).otherwise("")
        seen = F.struct(line.alias("line"), (~turns & (state["fence"] == "")).alias("open"))
        return F.struct(fence.alias("fence"), F.concat(state["done"], F.array(seen)).alias("done"))

    return F.aggregate(lines, start, step, lambda s: s["done"])


def woven_marks(body: Column, known: Column) -> Column:
    """``body`` with each ``[[target]]`` or ``[[target|label]]`` as a Markdown link. ``known`` maps lower-case targets to
    struct(label, href); what it lacks becomes plain text, marks without a target stay."""

    def one(mark: Column) -> Column:
        raw = trimmed(mark)
        target = trimmed(F.substring_index(raw, "|", 1))
        label = F.when(raw.contains("|"), trimmed(F.substr(raw, F.locate("|", raw) + 1, F.length(raw))))

        def said(found: Column) -> Column:
            text = F.translate(F.coalesce(label, found["label"]), "[]", "()")
            return F.when(found.isNull(), F.coalesce(label, target)).otherwise(F.concat(F.lit("["), text, F.lit("]("), found["href"], F.lit(")")))

        return F.when(target == "", F.concat(F.lit("[["), mark, F.lit("]]"))).otherwise(let(F.element_at(known, F.lower(target)), said))

    def line(l: Column) -> Column:
        between = F.split(l["line"], LINK, -1)
        marks = F.transform(F.regexp_extract_all(l["line"], F.lit(LINK), F.lit(1)), one)
        joined = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get(marks, i), F.lit("")))), "")
        return F.when(l["open"] & l["line"].contains("[["), joined).otherwise(l["line"])

    return F.array_join(F.transform(fenced_lines(F.split(body, "\n", -1)), line), "\n")


def weave_notes(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, body) of every note with its links resolved: to the note of that title, else to the live paper. A note's links
    are gathered by note, so they are no more than its text holds."""
    found = note_links(notes, docs).where("to_note IS NOT NULL OR to_document IS NOT NULL")
    titles = notes.select(F.col("id").alias("to_note"), F.col("title").alias("_note"), T.slugify(F.col("title")).alias("_slug"))
    papers = docs.select(F.col("id").alias("to_document"), F.coalesce(F.col("title"), F.col("citekey")).alias("_paper"))
    named = found.join(titles, "to_note", "left").join(papers, "to_document", "left")
    href = F.when(F.col("to_note").isNotNull(), F.concat(F.lit("#note-"), "_slug")).otherwise(F.concat(F.lit("#doc-"), F.col("to_document").cast("string")))
    entry = F.struct("target", F.struct(F.coalesce("_note", "_paper", "target").alias("label"), href.alias("href")).alias("to"))
    known = named.groupBy(F.col("note_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("_known"))
    none = F.create_map().cast("map<string,struct<label:string,href:string>>")
    return notes.select("id", "body").join(known, "id", "left").select("id", woven_marks(F.col("body"), F.coalesce("_known", none)).alias("body"))


def title_set(body: Column, title: Column) -> Column:
    """``body`` with ``# title`` for its first line outside of fences that is not blank; before it where there is none. Line
    ends stay those that the text uses: with a carriage return if any has one."""
    heading = F.concat(F.lit("# "), trimmed(title))
    end = F.when(body.contains("\r\n"), "\r\n").otherwise("\n")
    last = F.when(body.endswith("\n"), end).otherwise("")
    lines = fenced_lines(F.split(F.regexp_replace(F.regexp_replace(body, "\r\n", "\n"), r"\n\z", ""), "\n", -1))

    def placed(ls: Column) -> Column:
        at = F.array_position(F.transform(ls, lambda l: l["open"] & (trimmed(l["line"]) != "")), F.lit(True))
        before = F.when(trimmed(body) == "", F.concat(heading, end, end)).otherwise(F.concat(heading, end, end, body))
        changed = let(at, lambda k: F.concat(F.replace(F.array_join(F.transform(ls, lambda l, i: F.when(i + 1 == k, heading).otherwise(l["line"])), "\n"), F.lit("\n"), end), last))
        return F.when(at == 0, before).otherwise(changed)

    return F.when(body.isNotNull(), let(lines, placed))


def letters(spark: SparkSession) -> str:
    """LETTER as a pattern of Python, which has other tables of Unicode: all characters go through Spark's engine once."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    found = spark.createDataFrame([(every,)], "c string").select(F.regexp_replace("c", LETTER.replace("[", "[^", 1), "").alias("c")).first()["c"]
    spans = ([c for _, c in run] for _, run in groupby(enumerate(map(ord, found)), lambda p: p[1] - p[0]))
    return "[" + "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in spans) + "]"


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def grams(lines: list[str], word: re.Pattern) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of one to ``GRAM`` words: the line in which each stands, in order, and its hash."""
    words = [word.findall(line.translate(ASCII)) for line in lines]
    line = np.repeat(np.arange(len(words)), [len(w) for w in words])
    codes, distinct = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    each = pd.util.hash_array(distinct, categorize=False)[codes] if len(codes) else np.array([], dtype=np.uint64)
    found, key = [(line, each)], each
    for n in range(1, GRAM):
        key = mixed(key[:-1], each[n:])
        inside = line[: len(key)] == line[n:]
        found.append((line[: len(key)][inside], key[inside]))
    return found


def bits_at(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for p in range(PROBES):
        yield mixed(keys, np.full(len(keys), p, dtype=np.uint64)) & np.uint64(size - 1)


def named_in(texts: DataFrame, names: DataFrame, letter: str) -> DataFrame:
    """(id, names): for each text (id, text) the pages (name, slug) whose words, the first ``GRAM`` at least, stand side by side
    in one of its lines, longest name first. Names and runs of words meet by their hash, and
    only runs that a filter over all names lets pass are dealt out, so a text gives out little more than what it names.
    Names of less than four characters and without a letter or digit name nothing."""
    pages = names.where((F.length("name") >= LEAST_NAME) & F.col("slug").isNotNull()).groupBy("slug").agg(F.min("name").alias("name"))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = re.compile(letter + "+")
        for rows in batches:
            own = np.zeros(len(rows), dtype=np.uint64)
            some = np.zeros(len(rows), dtype=bool)
            for line, key in grams([n.replace("\n", " ") for n in rows["name"]], word):
                first, at = np.unique(line, return_index=True)
                own[first], some[first] = key[at], True
            yield rows.assign(key=own.view(np.int64))[some]

    pages = stored(pages.mapInPandas(keyed, "slug string, name string, key long"), "names")
    keys = pages.select("key").distinct().toArrow()["key"].to_numpy().view(np.uint64)
    size = 1 << max(10, (len(keys) * BITS - 1).bit_length())
    known = np.zeros(size, dtype=bool)
    for at in bits_at(keys, size):
        known[at] = True
    filter_ = texts.sparkSession.sparkContext.broadcast((size, np.packbits(known)))  # two to four bytes a name

    def given(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = re.compile(letter + "+")
        size, packed = filter_.value
        for rows in batches:
            ends = np.cumsum(rows["text"].str.len().to_numpy()) // CHARS
            for _, part in rows.groupby(ends):
                ids, lines = [], []
                for i, text in zip(part["id"], part["text"]):
                    cut = text.split("\n")
                    ids += [i] * len(cut)
                    lines += cut
                ids = np.array(ids)
                out = []
                for line, key in grams(lines, word):
                    good = np.ones(len(key), dtype=bool)
                    for at in bits_at(key, size):
                        good &= (packed[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
                    out.append(pd.DataFrame({"id": ids[line[good]], "key": key[good].view(np.int64)}))
                yield pd.concat(out).drop_duplicates()

    id_ = texts.schema["id"].dataType.simpleString()
    held = texts.where("text is not null and id is not null").select("id", "text").mapInPandas(given, f"id {id_}, key long").join(pages, "key").select("id", "slug", "name")
    return held.groupBy("id").agg(F.array_sort(F.collect_set(F.struct((-F.length("name")).alias("rank"), "name", "slug"))).alias("names"))


def fences(lines: list[str]) -> list[bool]:
    """As ``fenced_lines``: whether each line is outside of fences and no fence itself."""
    fence, free = "", []
    for line in lines:
        begins = line.lstrip(BLANK)
        mark = begins[:1] if begins.startswith(("```", "~~~")) else ""
        turns = mark != "" and fence in ("", mark)
        free.append(not turns and fence == "")
        fence = fence if not turns else mark if fence == "" else ""
    return free


def woven(text: str, names: list[str], slugs: list[str], letter: re.Pattern) -> str:
    lines = text.split("\n")
    outside = fences(lines)
    linked = [line for line, ok in zip(lines, outside) if ok and "](#wiki-" in line]
    free = [(k, line.translate(ASCII)) for k, (line, ok) in enumerate(zip(lines, outside)) if ok and not line.lstrip(" ").startswith("#") and "[" not in line]
    for name, slug in zip(names, slugs):
        if not free:
            break
        target = f"](#wiki-{slug})"
        if any(target in line for line in linked):
            continue
        sought, long = name.translate(ASCII), len(name)
        for n, (k, line) in enumerate(free):
            at = line.find(sought)
            while at >= 0 and (at and letter.match(line, at - 1) or letter.match(line, at + long)):
                at = line.find(sought, at + 1)
            if at >= 0:
                lines[k] = f"{lines[k][:at]}[{lines[k][at:at + long]}{target}{lines[k][at + long:]}"
                del free[n]
                break
    return "\n".join(lines)


def woven_names(text: Column, names: Column, letter: str) -> Column:
    """``text`` with the first place of each name, as whole words and without regard to ASCII case, as a link to
    ``#wiki-slug``. Headings, fences and lines with a bracket stay as they are, so a line gets one link, and a name that
    is linked somewhere gets no second one: weaving again changes nothing."""

    @F.pandas_udf("string")
    def one(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        one_letter = re.compile(letter)
        for texts, called, slugs in batches:
            yield pd.Series([t if t is None or n is None else woven(t, n, s, one_letter) for t, n, s in zip(texts, called, slugs)], dtype=object)

    return one(text, F.transform(names, lambda n: n["name"]), F.transform(names, lambda n: n["slug"]))


def weave_pages(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, text) of every text (id, slug, text) with the pages (name, slug) that it names linked; of names with one slug the
    smallest stands for the page. Slugs are letters, digits and hyphens."""
    letter = letters(texts.sparkSession)
    found = named_in(texts, names, letter)
    others = F.filter("names", lambda n: ~n["slug"].eqNullSafe(F.col("slug")))
    return texts.join(found, "id", "left").select("id", woven_names(F.col("text"), others, letter).alias("text"))
