"""A library as folders of files: safe names, numbers for names that collide, and what to change between two states.

Rows without a folder or a name lie in folder "" and under name "" (which a safe name never is). Repeated rows count as
further files of the same name. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblark.functions.titles import let
from biblark.operators import hierarchy
from biblark.plans.library import Library

# Names that a file system keeps for devices, the folder of documents without a collection.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{k}" for k in range(1, 10)], *[f"LPT{k}" for k in range(1, 10)]]
UNFILED = "Senza raccolta"
MOST_BYTES = 90
BLOCK = 65_536


def safe_component(name: Column) -> Column:
    """A name for a file or folder: refused marks become spaces, white space is squeezed, dots and spaces at the end go, at
    most 90 bytes of whole characters; empty and reserved names get an underscore in front."""
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+", " "), r"^ | \z", "")
    ended = lambda s: F.regexp_replace(s, r"[. ]+\z", "")
    fits = lambda s: F.size(F.filter(F.sequence(F.lit(1), F.lit(MOST_BYTES)), lambda k: F.octet_length(F.substr(s, F.lit(1), k)) <= MOST_BYTES))
    cut = lambda s: F.when(F.octet_length(s) > MOST_BYTES, ended(F.substr(s, F.lit(1), fits(s)))).otherwise(s)
    guarded = lambda s: F.when((s == "") | F.upper(s).isin(RESERVED), F.concat(F.lit("_"), s)).otherwise(s)
    return let(let(ended(plain), cut), guarded)


def document_name(lead: Column, year: Column, title: Column, number: Column) -> Column:
    """"Author Year — Title.pdf"; parts that are missing are left out, without a title the document's number stands."""
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    front = F.concat(F.coalesce(F.concat(said(lead), F.lit(" ")), F.lit("")), F.coalesce(F.concat(year.cast("string"), F.lit(" — ")), F.lit("")))
    return F.concat(safe_component(F.concat(front, F.coalesce(said(title), F.concat(F.lit("Documento "), number.cast("string"))))), F.lit(".pdf"))


def running(rows: DataFrame, keys: list[str], order: str, value: Column, into: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each of them within ``keys``, in order of the long column ``order``. Sums
    of blocks of the order come first, so that a key with any number of rows is spread over as many tasks as it has blocks."""
    named = rows.withColumn("_v", value).withColumn("_block", F.floor(F.col(order) / BLOCK))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = named.groupBy(*keys, "_block").agg(F.sum("_v").alias("_s"))
    offsets = blocks.select(*keys, "_block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    joined = named.join(offsets, [*keys, "_block"])
    return joined.withColumn(into, (F.sum("_v").over(inside) + F.col("_offset")).cast("long")).drop("_v", "_block", "_offset")


def numbered_names(entries: DataFrame, ending: str = "") -> DataFrame:
    """``entries`` (folder, name, id, …) with shown: of equal names in a folder that of the smallest id stays, the others get
    " (2)", " (3)" and so on before ``ending``, leaving out numbers that another name of the folder spells out already."""
    keys = ["folder", "_stem"]
    filled = entries.withColumns({c: F.coalesce(c, F.lit("")) for c in ("folder", "name")})
    stem = F.when(F.col("name").endswith(ending), F.substr("name", F.lit(1), F.length("name") - len(ending))).otherwise(F.col("name")) if ending else F.col("name")
    ranked = running(filled.withColumn("_stem", stem), ["folder", "name"], "id", F.lit(1), "_rank", tuple(c for c in entries.columns if c not in ("folder", "name", "id")))
    first = ranked.where("_rank = 1").drop("_rank").withColumn("shown", F.col("name"))
    again = ranked.where("_rank > 1").withColumn("_j", F.col("_rank") - 1)
    # The i-th number t that is spelled out has t - 1 - i free ones below it.
    taken = first.select("folder", F.regexp_extract("_stem", r"(?s)^(.*) \(([1-9][0-9]{0,17})\)\z", 1).alias("_base"), F.regexp_extract("_stem", r"(?s)^(.*) \(([1-9][0-9]{0,17})\)\z", 2).alias("_t"))
    taken = taken.where("_t <> ''").select("folder", F.col("_base").alias("_stem"), F.col("_t").cast("long").alias("_t")).where("_t >= 2").distinct()
    counted = running(taken, keys, "_t", F.lit(1), "_i").select(*keys, (2 * (F.col("_t") - 1 - F.col("_i")) + 1).alias("_at"), F.lit(1).alias("_one"))
    merged = counted.unionByName(again.withColumn("_at", 2 * F.col("_j")).withColumn("_one", F.lit(0)), allowMissingColumns=True)
    placed = running(merged, keys, "_at", F.col("_one"), "_skipped").where("_one = 0")
    number = (F.col("_j") + 1 + F.col("_skipped")).cast("string")
    renamed = placed.withColumn("shown", F.concat("_stem", F.lit(" ("), number, F.lit(")"), F.when(F.col("name").endswith(ending), ending).otherwise("")))
    columns = [*entries.columns, "shown"]
    return first.select(*columns).unionByName(renamed.select(*columns))


def projection(lib: Library, present: DataFrame | None = None) -> DataFrame:
    """(folder, id, name, source): a file for each live document with a file of its own in each of its collections, and in
    one folder more for those of no collection. ``present`` (source) holds the files that exist; others are left out."""
    files = lib.live.where(~F.col("path").startswith("ref:"))
    if present is not None:
        files = files.join(present.select(F.col("source").alias("path")).distinct(), "path", "left_semi")
    leads = lib.document_authors.join(lib.authors.select(F.col("id").alias("author_id"), "family"), "author_id")
    leads = leads.groupBy(F.col("document_id").alias("id")).agg(F.min_by("family", F.struct("position", "author_id")).alias("lead"))
    named = files.join(leads, "id", "left").select("id", F.col("path").alias("source"), document_name(F.col("lead"), F.col("year"), F.col("title"), F.col("id")).alias("name"))
    folders = hierarchy.paths(lib.collections, safe_component).select(F.col("id").alias("collection_id"), F.col("path").alias("folder"))
    members = lib.members.select("collection_id", F.col("document_id").alias("id")).distinct()
    filed = named.join(members.join(folders, "collection_id"), "id")
    loose = named.join(members, "id", "left_anti").withColumn("collection_id", F.lit(None).cast("long")).withColumn("folder", F.lit(UNFILED))
    shown = numbered_names(filed.unionByName(loose).select("folder", "name", "id", "collection_id", "source"), ".pdf")
    return shown.select("folder", "id", F.col("shown").alias("name"), "source")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(action, folder, name, source): links to take away and to make so that the state ``before`` becomes ``after``; a file
    whose source changed is taken away and made again. Nothing for equal states."""
    place = ["folder", "name", "source"]
    minus = lambda a, b, action: a.select(*place).exceptAll(b.select(*place)).select(F.lit(action).alias("action"), *place)
    return minus(before, after, "remove").unionByName(minus(after, before, "make"))


def folder_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(action, folder) for folders with all above them that come or go; the deepest go first when sorted downwards."""
    def every(files: DataFrame) -> DataFrame:
        parts = F.split("folder", "/")
        up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
        return files.select("folder").distinct().select(F.explode(up).alias("folder")).distinct()

    old, new = every(before), every(after)
    sides = (old.join(new, "folder", "left_anti").withColumn("action", F.lit("remove")), new.join(old, "folder", "left_anti").withColumn("action", F.lit("make")))
    return reduce(DataFrame.unionByName, sides).select("action", "folder")
