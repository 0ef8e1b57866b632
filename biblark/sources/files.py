"""Files as tables: a vault of notes, project folders, imports; and tables as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblark.functions import text as T

MOST_BYTES = 300 * 1024 * 1024
MOST_CHARS = 5_000_000


def file_name(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\+", "%2B"))


def notes(spark: SparkSession, folder: str, limit: int = 500) -> DataFrame:
    """(slug, title, bytes, modified) of the Markdown files of a folder, newest first."""
    files = spark.read.option("pathGlobFilter", "*.[mM][dD]").text(folder, wholetext=True)
    named = files.select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified"))
    slug = F.regexp_replace("name", r"(?i)\.md$", "")
    return named.select(slug.alias("slug"), T.first_line(F.col("value")).alias("title"), "bytes", "modified").orderBy(F.desc("modified"), "slug").limit(limit)


def note(spark: SparkSession, folder: str, slug: str) -> DataFrame:
    """(slug, body) of one note; a slug with separators, dots in a row or a colon is refused."""
    if not slug or any(mark in slug for mark in ("/", "\\", "..", ":")):
        raise ValueError(f"not a slug: {slug!r}")
    return spark.read.text(f"{folder.rstrip('/')}/{slug}.md", wholetext=True).select(F.lit(slug).alias("slug"), F.col("value").alias("body"))


def projects(spark: SparkSession, folder: str, limit: int | None = 200) -> DataFrame:
    """(slug, has_main, has_bib, has_pdf, modified) of the sub-folders, newest first. File contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime")
    inner = F.regexp_replace("path", "^.*?" + folder.split("://")[-1].strip("/").replace(".", r"\.") + "/", "")
    parts = files.select(F.split(inner, "/").alias("p"), "modificationTime").where("size(p) > 1")
    name = F.lower(F.element_at("p", -1))
    top = F.size("p") == 2
    out = parts.groupBy(F.col("p")[0].alias("slug")).agg(F.bool_or(top & (name == "main.tex")).alias("has_main"), F.bool_or(top & name.endswith(".bib")).alias("has_bib"), F.bool_or(top & (name == "main.pdf")).alias("has_pdf"), F.max("modificationTime").alias("modified"))
    out = out.orderBy(F.desc("modified"), "slug")
    return out.limit(limit) if limit else out


def prepared_imports(spark: SparkSession, folder: str, glob: str = "*", most_bytes: int = MOST_BYTES, most_chars: int = MOST_CHARS) -> DataFrame:
    """(path, file_hash, title, fulltext) of text files of at most ``most_bytes``: control characters but line
    feeds, returns and tabs go, texts are cut at ``most_chars``; the title is the name without its extension."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).where(F.col("length") <= most_bytes)
    clean = F.regexp_replace(F.decode("content", "UTF-8"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return files.select("path", F.sha2("content", 256).alias("file_hash"), F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", "").alias("title"), F.substring(clean, 1, most_chars).alias("fulltext"))


def csv_text(grid: Column) -> Column:
    """RFC 4180 text of an array of rows; rows end in CR LF."""
    row = lambda cells: F.concat(F.array_join(F.transform(cells, lambda c: T.csv_cell(F.coalesce(c, F.lit("")))), ","), F.lit("\r\n"))
    return F.array_join(F.transform(grid, row), "")


def markdown_table(grid: Column) -> Column:
    """A Markdown table of an array of rows; the first is the header and short rows are filled up."""
    width = F.array_max(F.transform(grid, lambda r: F.size(r)))
    padded = lambda r: F.concat(F.transform(r, lambda c: T.md_cell(F.coalesce(c, F.lit("")))), F.array_repeat(F.lit(""), (width - F.size(r)).cast("int")))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    lines = F.transform(grid, lambda r: line(padded(r)))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(grid) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000)), "\n")).otherwise("")


def safe_name(name: Column) -> Column:
    """A file name for a vault: marks that file systems or links refuse become spaces; at most 120 characters."""
    plain = F.trim(T.squeeze(F.regexp_replace(name, r'[<>:"/\\|?*#^\[\]\x00-\x1F]', " ")))
    plain = F.regexp_replace(F.substring(plain, 1, 120), r"[. ]+$", "")
    reserved = F.upper(F.regexp_extract(plain, r"^([^.]*)", 1)).rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    return F.when(plain == "", "senza-titolo").when(reserved, F.concat(F.lit("_"), plain)).otherwise(plain)


def vault_pages(docs: DataFrame) -> DataFrame:
    """(file, content) for documents with title, authors (array), year, venue, doi, tags (array) and abstract:
    Markdown with front matter, one row a document; equal names are numbered apart."""
    from biblark.operators.folders import numbered_names

    quoted = lambda c: F.when(c.isNotNull(), T.yaml_quoted(c))
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))
    many = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("["), F.array_join(F.transform(c, T.yaml_quoted), ", "), F.lit("]")))
    head = F.concat_ws("\n", F.lit("---"), field("title", quoted(F.col("title"))), field("authors", many(F.col("authors"))), field("year", F.col("year").cast("string")), field("venue", quoted(F.col("venue"))), field("doi", quoted(F.col("doi"))), field("tags", many(F.col("tags"))), F.lit("---"))
    body = F.concat_ws("\n\n", head, F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.col("abstract"))
    named = numbered_names(docs.select("id", F.lit("").alias("folder"), safe_name(F.coalesce("title", F.lit(""))).alias("name")))
    return docs.select("id", body.alias("content")).join(named.select("id", F.concat("shown", F.lit(".md")).alias("file")), "id").select("file", "content")
