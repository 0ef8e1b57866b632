"""Bibliographies: parsing of BibTeX, RIS and CSL-JSON, citation keys, citation formats."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblark.functions import text as T

ENTRY = "entry_type string, key string, fields map<string,string>"
AUTHOR = "array<struct<given:string,family:string>>"
RECORD = f"title string, doi string, url string, year long, venue string, abstract string, authors {AUTHOR}, keywords array<string>, files array<string>, key string"

# RIS tags of each field.
RIS_TAGS = {"TI": "title", "T1": "title", "DO": "doi", "PY": "year", "Y1": "year", "DA": "year", "JO": "venue", "JF": "venue", "JA": "venue", "T2": "venue", "AB": "abstract", "N2": "abstract", "ID": "key", "UR": "url"}
RIS_AUTHORS = ("AU", "A1", "A2", "A3", "A4")
RIS_LINE = re.compile(r"([A-Z][A-Z0-9])  - (.*)")
ENTRY_HEAD = re.compile(r"@([\w]+)\s*\{")
FIELD_NAME = re.compile(r"[\s,]*([^=}\s]+)\s*=\s*")


def tidy(value: str) -> str:
    value = value.replace("\n", " ")
    for a, b in (("\\&", "&"), ("--", "–"), ("``", '"'), ("''", '"'), ("\\%", "%")):
        value = value.replace(a, b)
    return " ".join(value.replace("{", "").replace("}", "").split())


def closing(text: str, at: int, quote: bool = False) -> int:
    """Position of the brace (or quote) that ends a value begun before ``at``; the end of the text if none does."""
    depth = 0
    for m in re.compile(r'[{}"]' if quote else r"[{}]").finditer(text, at):
        c = m[0]
        if c == "{":
            depth += 1
        elif c == "}":
            if not depth and not quote:
                return m.start()
            depth = max(0, depth - 1)
        elif not depth:
            return m.start()
    return len(text)


def parse_bibtex(text: str) -> list[dict]:
    """Entries with type, key and fields; comments, strings and preambles are passed over, a broken entry ends where it breaks."""
    out, at = [], 0
    while m := ENTRY_HEAD.search(text, at):
        at, kind = m.end(), m[1].lower()
        if kind in ("comment", "string", "preamble"):
            at = closing(text, at) + 1
            continue
        key = re.compile(r"[^,}]*").match(text, at)
        at, fields = key.end(), {}
        while f := FIELD_NAME.match(text, at):
            start = f.end()
            if text[start : start + 1] in ("{", '"'):
                end = closing(text, start + 1, text[start] == '"')
                value, at = text[start + 1 : end], end + 1
            else:
                value = re.compile(r"[^,}]*").match(text, start)
                at, value = value.end(), value[0].strip()
            fields[f[1].strip().lower()] = tidy(value)
        if fields:
            out.append({"entry_type": kind, "key": key[0].strip(), "fields": fields})
    return out


def first_year(text: str | None) -> int | None:
    return next((int(r[:4]) for r in re.findall(r"\d{4,}", text or "") if 1000 <= int(r[:4]) <= 3000), None)


def unique(items: list[str]) -> list[str]:
    return list({s.lower(): s for s in reversed(items)}.values())[::-1]


def parse_ris(text: str) -> list[dict]:
    """Records between TY and ER; the first value of a field counts; a line without a tag continues a title or an abstract."""
    out: list[dict] = []
    record: dict | None = None
    last = ""

    def end() -> None:
        if record and (record.get("title") or record.get("doi")):
            files = record["files"] + [u for u in record["urls"] if u.lower().endswith(".pdf")]
            names = []
            for name in record["authors"]:
                family, given = ([p.strip() or None for p in name.split(",", 2)] + [None, None])[:2]
                names.append({"given": given if family else None, "family": family or name.strip() or None})
            out.append({k: record.get(k) for k in ("title", "doi", "url", "venue", "abstract")} | {"key": record.get("key") or "", "year": first_year(record.get("year")), "authors": [n for n in names if n["given"] or n["family"]], "keywords": unique(record["keywords"]), "files": unique(files)})

    for line in text.splitlines():
        m = RIS_LINE.match(line)
        if m and m[1] == "TY":
            end()
            record, last = {"authors": [], "keywords": [], "files": [], "urls": []}, "TY"
        elif m and m[1] == "ER":
            end()
            record, last = None, ""
        elif m and record is not None:
            tag, value = m[1], m[2].strip()
            last = tag
            if value:
                if tag in RIS_AUTHORS:
                    record["authors"].append(value)
                elif tag == "KW":
                    record["keywords"] += [w.strip() for w in re.split("[,;]", value) if w.strip()]
                elif tag in ("L1", "L4"):
                    record["files"].append(value)
                elif tag in RIS_TAGS:
                    record.setdefault(RIS_TAGS[tag], value)
                    if tag == "UR":
                        record["urls"].append(value)
        elif not m and record is not None and line.strip() and RIS_TAGS.get(last) in ("title", "abstract") and RIS_TAGS[last] in record:
            record[RIS_TAGS[last]] += " " + line.strip()
    end()
    return out


def parse_csl(text: str) -> list[dict]:
    """CSL-JSON: an array, one item or an object with ``items``."""
    try:
        data = json.loads(text)
    except ValueError:
        return []
    items = data.get("items", [data]) if isinstance(data, dict) else data
    out = []
    for it in items if isinstance(items, list) else []:
        first = lambda v: v[0] if isinstance(v, list) and v else v if isinstance(v, str) else None
        title, doi = first(it.get("title")), it.get("DOI")
        if not title and not doi:
            continue
        dates = (it.get("issued") or {}).get("date-parts") or [[None]]
        names = [{"given": a.get("given"), "family": a.get("family") or a.get("literal")} for a in it.get("author") or []]
        words = it.get("keyword") or ""
        out.append({"title": title, "doi": doi, "url": it.get("URL"), "year": first_year(str(dates[0][0]) if dates[0] and dates[0][0] else None), "venue": first(it.get("container-title")), "abstract": it.get("abstract"), "authors": [n for n in names if n["given"] or n["family"]], "keywords": unique([w.strip() for w in re.split("[,;]", words) if w.strip()]), "files": [], "key": str(it.get("id") or "")})
    return out


def bibtex_record(entry: dict) -> dict | None:
    f = entry["fields"]
    if not f.get("title") and not f.get("doi"):
        return None
    names = []
    for name in (n.strip() for n in f.get("author", "").split(" and ")):
        family, comma, given = name.partition(",")
        if not comma:
            given, _, family = name.rpartition(" ")
        if given.strip() or family.strip():
            names.append({"given": given.strip() or None, "family": family.strip() or None})
    return {"title": f.get("title") or None, "doi": f.get("doi") or None, "url": f.get("url"), "year": first_year(f.get("year") or f.get("date")), "venue": f.get("journal") or f.get("booktitle"), "abstract": f.get("abstract"), "authors": names, "keywords": unique([w.strip() for w in re.split("[,;]", f.get("keywords", "")) if w.strip()]), "files": attached(f.get("file", "")), "key": entry["key"]}


def attached(field: str) -> list[str]:
    """PDF paths of a ``file`` field: entries between semicolons, each a path, ``path:type`` or ``description:path:type``;
    a backslash protects the character after it. A drive letter starts a path wherever it stands."""
    found = []
    for entry in re.findall(r"(?:\\.|[^;\\])+", field, re.S):
        path = re.sub(r"\\([\\:])", r"\1", entry).strip()
        path = re.sub(r"(?i)(?::application/pdf|:pdf)$", "", path).strip()
        drive = re.search(r"(?<![A-Za-z0-9])[A-Za-z]:[\\/]", path)
        path = path[drive.start() :] if drive else path if path.startswith("/") else path.rpartition(":")[2]
        if path.strip().lower().endswith(".pdf"):
            found.append(path.strip())
    return found


def format_of(name: str, text: str) -> str:
    """bibtex, ris or csl, by file name, else by what the text begins with."""
    for end, kind in ((".bib", "bibtex"), (".ris", "ris"), (".json", "csl")):
        if name.lower().endswith(end):
            return kind
    head = text.lstrip()[:2000]
    return "csl" if head[:1] in ("[", "{") else "ris" if re.search(r"(?m)^TY  - ", head) else "bibtex"


def parse_file(name: str, text: str) -> list[dict]:
    kind = format_of(name, text)
    if kind == "bibtex":
        return [r for e in parse_bibtex(text) if (r := bibtex_record(e))]
    return parse_ris(text) if kind == "ris" else parse_csl(text)


def parsed(files: DataFrame) -> DataFrame:
    """(path, record fields) of bibliography files (path, text), one row a record."""
    names = [f.split(" ")[0] for f in re.split(r", (?=\w+ )", RECORD)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p} | r for p, t in zip(batch["path"], batch["text"]) for r in parse_file(p, t or "")]
            out = pd.DataFrame(rows, columns=["path", *names])
            out["year"] = out["year"].astype("Int64")
            yield out

    return files.select("path", "text").mapInPandas(read, f"path string, {RECORD}")


# ---- keys and formats


def alnum(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def base_key(family: Column, year: Column, title: Column) -> Column:
    """Family name, year and the first title word of more than three bytes."""
    who = F.when(alnum(family) != "", alnum(family)).otherwise("anon")
    words = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), r"\s+"), alnum), lambda w: F.octet_length(w) > 3)
    return F.concat(F.coalesce(who, F.lit("anon")), F.coalesce(year.cast("string"), F.lit("")), F.coalesce(F.get(words, 0), F.lit("")))


def suffix(n: Column) -> Column:
    """The n-th holder of a key, from 0: nothing, b to y, then n + 1."""
    return F.when(n == 0, "").when(n < 25, F.char(F.lit(97) + n)).otherwise((n + 1).cast("string"))


def bases_behind(key: Column, least: int = 26) -> Column:
    """Every (base, n) whose n-th key is ``key``: the key itself, the key without a last letter b to y, or without a
    last number of ``least`` or more."""
    row = lambda base, n: F.struct(base.alias("base"), n.cast("int").alias("n"))
    none = F.array().cast("array<struct<base:string,n:int>>")
    last = F.right(key, F.lit(1))
    letter = F.when(last.between("b", "y") & (F.length(key) > 1), F.array(row(F.substring(key, F.lit(1), F.length(key) - 1), F.ascii(last) - 97)))
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(9), F.length(key) - 1)), lambda k: F.struct(F.substring(key, F.lit(1), F.length(key) - k).alias("base"), F.right(key, k).alias("end")))
    numbers = F.transform(F.filter(ends, lambda e: e["end"].rlike("^[1-9][0-9]*$") & (e["end"].try_cast("int") >= least)), lambda e: row(e["base"], e["end"].cast("int") - 1))
    return F.concat(F.array(row(key, F.lit(0))), F.coalesce(letter, none), F.when(F.length(key) > 1, numbers).otherwise(none))


def assigned_keys(docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(id, key) for ``docs`` (id, family, year, title) with a first author: in order of id each gets its base key with
    the lowest suffix that no other document holds, of ``docs`` or of ``held`` (citekey), which has those in the trash
    too. Bases that no other base extends by what may be a suffix are numbered in windows of their own; the few others
    are numbered one after the other, apart by first character."""
    based = docs.where(F.trim("family") != "").select("id", base_key(F.col("family"), F.col("year"), F.col("title")).alias("base"))
    bases = based.select("base").distinct()
    used = held.where("citekey IS NOT NULL").select("citekey").distinct() if held is not None else bases.limit(0).toDF("citekey")
    taken = used.select(F.explode(bases_behind(F.col("citekey"))).alias("t")).select("t.*").join(bases, "base").distinct()

    behind = bases.select(F.col("base").alias("longer"), F.explode(bases_behind(F.col("base"), 1)).alias("t")).where("t.base <> longer")
    pairs = behind.select("longer", F.col("t.base").alias("base")).join(bases, "base")
    mixed = pairs.select("base").unionByName(pairs.select(F.col("longer").alias("base"))).distinct()

    # The r-th free number is r and the number of taken ones t (the i-th from 0) with t - i <= r.
    by_id, by_n = (Window.partitionBy("base").orderBy(c) for c in ("id", "n"))
    alone = based.join(mixed, "base", "left_anti").withColumn("v", F.row_number().over(by_id) - 1)
    gaps = taken.select("base", (F.col("n") - F.row_number().over(by_n) + 1).alias("v"), F.lit(None).cast("long").alias("id"))
    both = alone.select("base", "v", F.col("id").cast("long").alias("id")).unionByName(gaps)
    before = F.sum(F.col("id").isNull().cast("int")).over(Window.partitionBy("base").orderBy("v", F.col("id").isNotNull(), "id").rowsBetween(Window.unboundedPreceding, 0))
    free = both.withColumn("n", F.col("v") + before).where("id IS NOT NULL").select("id", F.concat("base", suffix(F.col("n"))).alias("key"))

    def one_after_the_other(group: pd.DataFrame) -> pd.DataFrame:
        keys = set(group.loc[group["id"].isna(), "base"])
        rows, following = group[group["id"].notna()].sort_values("id"), {}
        out = []
        for base in rows["base"]:
            n = following.get(base, 0)
            while (key := base + ("" if n == 0 else chr(97 + n) if n < 25 else str(n + 1))) in keys:
                n += 1
            following[base] = n + 1
            keys.add(key)
            out.append(key)
        return pd.DataFrame({"id": rows["id"].astype("int64"), "key": out})

    entwined = based.join(mixed, "base").select(F.col("id").cast("long").alias("id"), "base")
    theirs = taken.join(mixed, "base").select(F.lit(None).cast("long").alias("id"), F.concat("base", suffix(F.col("n"))).alias("base")).distinct()
    return free.unionByName(entwined.unionByName(theirs).groupBy(F.left("base", F.lit(1))).applyInPandas(one_after_the_other, "id long, key string"))


def named(authors: Column, join: str) -> Column:
    """"Family, Given" of (given, family) structs."""
    one = lambda a: F.concat_ws(", ", a["family"], a["given"])
    return F.array_join(F.filter(F.transform(authors, one), lambda s: s != ""), join)


def initials(given: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(given, r"\s+"), lambda p: p != ""), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), " ")


def block(*parts: Column) -> Column:
    """Lines, missing ones left out."""
    return F.concat_ws("\n", *parts)


def optional(before: str, value: Column, after: str = "") -> Column:
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def bibtex(key: Column, d: DataFrame) -> Column:
    a = named(d["authors"], " and ")
    fields = F.concat_ws(",\n", F.concat(F.lit("@article{"), key), optional("  title = {", d["title"], "}"), F.when(a != "", optional("  author = {", a, "}")), optional("  year = {", d["year"], "}"), optional("  journal = {", d["venue"], "}"), optional("  doi = {", d["doi"], "}"))
    return F.concat(fields, F.lit("\n}"))


def ris(d: DataFrame) -> Column:
    people = F.transform(d["authors"], lambda a: F.concat(F.lit("AU  - "), F.concat_ws(", ", a["family"], a["given"])))
    people = F.filter(people, lambda s: s != "AU  - ")
    lines = F.flatten(F.array(F.array(F.lit("TY  - JOUR"), optional("TI  - ", d["title"])), people, F.array(optional("PY  - ", d["year"]), optional("JO  - ", d["venue"]), optional("DO  - ", d["doi"]), F.lit("ER  - "))))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def csl(key: Column, d: DataFrame) -> Column:
    return F.to_json(F.struct(key.alias("id"), F.lit("article-journal").alias("type"), d["title"].alias("title"), d["authors"].alias("author"), F.struct(F.array(F.array(d["year"])).alias("date-parts")).alias("issued"), d["venue"].alias("container-title"), d["doi"].alias("DOI")))


def apa(d: DataFrame) -> Column:
    one = lambda a: F.when(F.coalesce(a["given"], F.lit("")) != "", F.concat(F.coalesce(a["family"], F.lit("")), F.lit(", "), initials(a["given"]))).otherwise(F.coalesce(a["family"], F.lit("")))
    people = F.filter(F.transform(d["authors"], one), lambda s: s != "")
    n = F.size(people)
    who = F.when(n <= 1, F.array_join(people, "")).otherwise(F.concat(F.array_join(F.slice(people, F.lit(1), n - 1), ", "), F.lit(", & "), F.element_at(people, -1)))
    none = lambda c: F.coalesce(c, F.lit(""))
    return F.trim(F.concat(none(who), F.lit(" "), none(optional("(", d["year"], "). ")), none(d["title"]), F.lit("."), none(optional(" ", d["venue"], ".")), none(optional(" https://doi.org/", d["doi"]))))


def ieee(number: Column, d: DataFrame) -> Column:
    one = lambda a: F.when(F.coalesce(a["given"], F.lit("")) != "", F.concat(initials(a["given"]), F.lit(" "), F.coalesce(a["family"], F.lit("")))).otherwise(F.coalesce(a["family"], F.lit("")))
    who = F.array_join(F.filter(F.transform(d["authors"], one), lambda s: s != ""), ", ")
    none = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), who, F.lit(', "'), none(d["title"]), F.lit(',"'), none(optional(" ", d["venue"], ",")), none(optional(" ", d["year"], ".")), none(optional(" doi: ", d["doi"], ".")))


def numbered(items: DataFrame, parts: int = 64) -> DataFrame:
    """``items`` with number, from 1 in order of id: ranges of ids are counted, then numbered on their own."""
    marks = items.approxQuantile("id", [k / parts for k in range(1, parts)], 0.001)
    edges = F.array(*[F.lit(float(m)) for m in sorted(set(marks))]).cast("array<double>")
    placed = items.withColumn("_range", F.size(F.filter(edges, lambda m: m < F.col("id"))))
    counts = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}  # at most ``parts`` rows
    before = {k: sum(n for j, n in counts.items() if j < k) for k in counts}
    offset = F.coalesce(*[F.when(F.col("_range") == k, F.lit(n)) for k, n in sorted(before.items())], F.lit(0))
    return placed.withColumn("number", F.row_number().over(Window.partitionBy("_range").orderBy("id")) + offset).drop("_range")


def cited_together(keys: DataFrame, group: str) -> DataFrame:
    """(group, latex, pandoc) from ``keys`` (group, id, key): one citation command for the list of each group, in order of id."""
    listed = keys.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "key"))), lambda s: s["key"]).alias("k"))
    pandoc = F.array_join(F.transform("k", lambda k: F.concat(F.lit("@"), k)), "; ")
    return listed.select(group, F.concat(F.lit("\\cite{"), F.array_join("k", ","), F.lit("}")).alias("latex"), F.concat(F.lit("["), pandoc, F.lit("]")).alias("pandoc"))


def plain_bibtex(d: DataFrame) -> Column:
    """The headless exporter's dialect: @misc without a venue, escaped fields, trailing commas, doc{id} as last key."""
    family = F.trim(F.get(d["authors"], 0)["family"])
    word = F.get(F.transform(F.filter(F.split(F.coalesce(d["title"], F.lit("")), r"\s+"), lambda w: F.length(alnum(w)) > 3), alnum), 0)
    computed = F.when(F.coalesce(alnum(family), F.lit("")) == "", F.concat(F.lit("doc"), d["id"].cast("string"))).when(d["year"].isNull(), alnum(family)).otherwise(F.concat(alnum(family), d["year"].cast("string"), F.coalesce(word, F.lit(""))))
    key = F.when(F.trim(F.coalesce(d["citekey"], F.lit(""))) != "", d["citekey"]).otherwise(computed)
    venue = F.when(F.trim(F.coalesce(d["venue"], F.lit(""))) != "", d["venue"])
    doi = F.when(F.trim(F.coalesce(d["doi"], F.lit(""))) != "", d["doi"])
    part = lambda c: F.trim(F.coalesce(c, F.lit("")))
    one = lambda a: F.when(part(a["given"]) == "", T.bibtex_field(part(a["family"]))).otherwise(F.concat(T.bibtex_field(part(a["family"])), F.lit(", "), T.bibtex_field(part(a["given"]))))
    who = F.array_join(F.transform(d["authors"], one), " and ")
    line = lambda name, c: optional(f"  {name} = {{", c, "},\n")
    fields = [line("title", T.bibtex_field(d["title"])), F.when(who != "", line("author", who)), line("year", d["year"]), line("journal", T.bibtex_field(venue)), line("doi", T.bibtex_field(doi))]
    return F.concat(F.lit("@"), F.when(venue.isNotNull(), "article").otherwise("misc"), F.lit("{"), key, F.lit(",\n"), *[F.coalesce(f, F.lit("")) for f in fields], F.lit("}\n"))
