"""A Merkle manifest of a corpus: every document a leaf, a root for each language, one root over all.

Method: a radix-ranked trie. Sorting a corpus to number its documents is not
needed: a document's rank in its language is the number of documents under
smaller digits. Digits of doc_id are counted level by level, three hexadecimal
digits at a time, until every prefix holds one row, whose rank is then the sum of
what was counted before it; a digit's window has at most 4,097 rows. Languages get
their numbers in the same way, from the digits of their bytes. The ranks' digits in the base of the fan-out
are the keys of a second trie, whose nodes are reduced by longest prefix: each
level groups by the key without its last digit, until one node is left. The
siblings on the way back down are the proofs. Every leaf, tampered with or not,
is folded with its proof and compared with the root.

``manifest`` gives a row per document with its leaf, the root of its language,
the root of all and its path (left and right siblings of each level); ``folded``
recomputes the root from any leaf and a path.

Defined results: null columns have their own encoding; a null language is a
group, and the first one; null ids come first in their language. Rows of equal
doc_id and language go by their leaf's first 15 digits, then by their place in
the input; repeated rows have equal leaves, so their order changes nothing but
which of them has which proof. An empty table has no rows and no root. Further
columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblark.llm.common import Scratch, table

FANOUT, BITS = 8, 3
DIGITS = 3
SPLIT = 1
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<l:string,r:string>>"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """The digest of a row; ``text`` stands in for the row's own."""
    return sha(*[encoded(docs[c] if c != "text" or text is None else text) for c in FIELDS])


def common_prefix(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def id_digits(doc_id: Column) -> Column:
    """16 hexadecimal digits in the order of signed ids; null for null."""
    return F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def ranked(scratch: Scratch, rows: DataFrame, key: Column, shared: int, split: int = SPLIT) -> DataFrame:
    """``rows`` (g and others) with r, the rank in g by ``key``, from 0. Keys are digits, no two alike in a group, the
    first ``shared`` the same in all. Prefixes of at most ``split`` rows are not counted further, but numbered."""
    left = rows.withColumn("_k", key).withColumn("r", F.lit(0).cast("long"))
    levels, cut = [], shared
    while True:
        cut += DIGITS
        at = left.withColumn("_p", F.substring("_k", 1, cut))
        before = Window.partitionBy("g", F.substring("_p", 1, cut - DIGITS)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        counts = at.groupBy("g", "_p").agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        counts = scratch.keep(counts, "digits")
        at = at.join(counts, ["g", "_p"]).withColumn("r", F.col("r") + F.col("_b"))
        levels.append(at.where(F.col("_n") <= split))
        if not counts.where(F.col("_n") > split).limit(1).count():
            break
        left = scratch.keep(at.where(F.col("_n") > split).select(*rows.columns, "_k", "r"), "open")
    found = reduce(DataFrame.unionByName, levels)
    if split > 1:
        found = found.withColumn("r", F.col("r") + F.row_number().over(Window.partitionBy("g", "_p").orderBy("_k")) - 1)
    return found.select(*rows.columns, "r")


def ranked_documents(scratch: Scratch, rows: DataFrame, split: int = SPLIT) -> DataFrame:
    """``rows`` (g, doc_id, leaf, row and others) ranked in g by (doc_id, leaf, row)."""
    least, most = rows.agg(F.min(id_digits(F.col("doc_id"))), F.max(id_digits(F.col("doc_id")))).first()
    common = common_prefix(least or "0" * 16, most or "0" * 16)
    key = F.concat(F.coalesce(id_digits(F.col("doc_id")), F.lit(common.ljust(16))), F.substring("leaf", 1, 15), F.lpad(F.hex("row"), 16, "0"))
    return ranked(scratch, rows, key, len(common), split)


def ranked_languages(scratch: Scratch, tops: DataFrame) -> DataFrame:
    """``tops`` (g and others) as one group, with lang for what was g, ranked by its bytes."""
    rows = scratch.keep(tops.withColumnRenamed("g", "lang").withColumn("g", F.lit("")), "languages")
    key = F.hex(F.encode("lang", "utf-8"))
    return ranked(scratch, rows, key, len(common_prefix(*rows.agg(F.min(key), F.max(key)).first())))


def height(n: Column) -> Column:
    """Levels above the leaves of a trie with n leaves."""
    return reduce(lambda c, k: c.when(n <= FANOUT**k, k), range(1, 21), F.when(n <= 1, 0)).cast("int")


def reduced(scratch: Scratch, leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Runs of siblings, level by level: (g, h, i, digest, members), where i is the parent's key, digest its own
    and members the children in order. ``leaves``: (g, h, r, digest, more), where more is kept beside the digest."""
    runs: list[DataFrame] = []
    nodes = leaves
    for k in range(max(levels, 1)):
        nodes = nodes.where(F.col("h") > k) if k else nodes
        run = nodes.groupBy("g", "h", F.shiftright("r", BITS).alias("i")).agg(F.sort_array(F.collect_list(F.struct("r", "digest", "more"))).alias("members"))
        run = run.withColumn("digest", F.sha2(F.array_join(F.transform("members", lambda m: m["digest"]), ""), 256))
        runs.append(scratch.keep(run, "runs"))
        nodes = runs[-1].select("g", "h", F.col("i").alias("r"), "digest", F.lit(None).cast("string").alias("more"))
    return runs


def tops(runs: list[DataFrame]) -> DataFrame:
    """(g, h, digest): the last node of each group."""
    lone = runs[0].where("h = 0").select("g", "h", F.col("members")[0]["digest"].alias("digest"))
    return reduce(DataFrame.unionByName, [run.where(F.col("h") == k + 1).select("g", "h", "digest") for k, run in enumerate(runs)], lone)


def described(runs: list[DataFrame], starts: DataFrame) -> DataFrame:
    """Leaves with their way to the root: (g, digest, more, top, path). ``starts``: (g, h, top, path above the group)."""
    at = lambda k: starts.where(F.col("h") == k).select("g", F.lit(0).cast("long").alias("i"), "h", "top", "path")
    parents = at(len(runs))
    for k in range(len(runs) - 1, -1, -1):
        if k == 0:
            parents = parents.unionByName(at(0))
        met = runs[k].select("g", "i", "members").join(parents, ["g", "i"])
        member = met.select("g", "i", "h", "top", "path", "members", F.posexplode("members").alias("pos", "m"))
        side = lambda part: F.array_join(F.transform(part, lambda m: m["digest"]), "")
        left = side(F.slice("members", F.lit(1), F.col("pos")))
        right = side(F.slice("members", F.col("pos") + 2, F.lit(FANOUT)))
        own = F.array(F.struct(left.alias("l"), right.alias("r")))
        path = F.when(F.col("h") > k, F.concat(own, F.col("path"))).otherwise(F.col("path"))
        member = member.select("g", F.col("m")["r"].alias("i"), "h", "top", path.alias("path"), F.col("m")["digest"].alias("digest"), F.col("m")["more"].alias("more"))
        if k == 0:
            return member.select("g", "digest", "more", "top", "path")
        parents = member.select("g", "i", "h", "top", "path").unionByName(at(k))
    raise AssertionError("no levels")


def manifest(spark: SparkSession, docs: DataFrame, more: Column | None = None, split: int = SPLIT) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, more): ``more`` is a string column over ``docs`` that is carried along."""
    scratch = Scratch(spark, "manifest")
    more = F.lit(None).cast("string") if more is None else more
    group = F.coalesce(F.concat(F.lit("+"), docs["lang"]), F.lit(""))
    leaves = scratch.keep(docs.select(group.alias("g"), docs["doc_id"].cast("long").alias("doc_id"), leaf(docs).alias("leaf"), more.alias("more"), F.monotonically_increasing_id().alias("row")), "leaves")
    groups = scratch.keep(leaves.groupBy("g").agg(F.count("*").alias("n")).withColumn("h", height(F.col("n"))), "groups")
    langs, highest = groups.agg(F.count("*"), F.max("h")).first()
    if not langs:
        return spark.createDataFrame([], f"doc_id long, leaf string, subroot string, root string, path {PATH}, more string")
    placed = ranked_documents(scratch, leaves, split).join(groups.select("g", "h"), "g")
    carried = F.to_json(F.struct("doc_id", "more"))
    runs = reduced(scratch, placed.select("g", "h", "r", F.col("leaf").alias("digest"), carried.alias("more")), highest)
    of_lang = ranked_languages(scratch, tops(runs).select("g", "h", "digest"))
    over = next(k for k in range(22) if langs <= FANOUT**k)
    subroots = of_lang.select("g", F.lit(over).alias("h"), "r", "digest", F.to_json(F.struct("lang", "h")).alias("more"))
    upper = reduced(scratch, subroots, over)
    root = tops(upper).first()["digest"]
    nothing = F.array().cast(PATH)
    way = described(upper, spark.range(1).select(F.lit("").alias("g"), F.lit(over).alias("h"), F.lit("").alias("top"), nothing.alias("path")))
    of = F.from_json("more", "lang string, h int")
    starts = scratch.keep(way.select(of["lang"].alias("g"), of["h"].alias("h"), F.col("digest").alias("top"), "path"), "ways")
    found = described(runs, starts)
    own = F.from_json("more", "doc_id long, more string")
    return found.select(own["doc_id"].alias("doc_id"), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root).alias("root"), "path", own["more"].alias("more"))


def proof(path: Column) -> Column:
    """The digest of all siblings, from the leaf's run up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way."""
    return F.aggregate(path, start, lambda digest, s: sha(s["l"], digest, s["r"]))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof; a third of the documents is tampered with, all are checked."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    tampered = F.when(chosen, leaf(docs, F.translate(docs["text"], UPPER, LOWER)))
    found = manifest(spark, docs, tampered)
    now = folded(F.coalesce("more", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), now.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
