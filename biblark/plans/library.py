"""The data model of a research library, laid over the test tables.

A library has documents, authors and their bridge, tags and their bridge, a
tree of collections and its members, references, annotations and watch hits.
``Library.of`` derives them lazily, column by column, so that a query reads
only what it uses; ``cte`` gives the same tables as SQL text for comparison.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblark.operators import search_index
from biblark.operators.search_index import SearchIndex
from biblark.operators.storage import shared_folder

REGION, NATION, CUSTOMER = 1, 100, 1000


@dataclass(frozen=True)
class Library:
    spark: SparkSession
    folder: str

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Library:
        return cls(spark, sf_dir.rstrip("/"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        o, when = F.col("o_orderkey"), F.when
        return self.table("orders").select(
            o.alias("id"),
            F.concat(F.lit("Study of "), F.substring("o_orderpriority", 3, 20), F.lit(" methods, part "), (o % 500).cast("string")).alias("title"),
            when(o % 11 != 0, F.year("o_orderdate")).alias("year"),
            when(o % 7 != 0, F.col("o_orderpriority")).alias("venue"),
            when(o % 3 == 0, F.concat(F.lit("10.1000/"), o.cast("string"))).alias("doi"),
            when(o % 2 == 0, F.concat(F.lit("key"), o.cast("string"))).alias("citekey"),
            (F.col("o_orderstatus") == "F").alias("is_read"),
            (F.col("o_totalprice") > 400000).alias("favorite"),
            when(o % 4 == 0, F.concat(F.lit("ref:doi:"), o.cast("string"))).otherwise(F.concat(F.lit("/library/"), o.cast("string"), F.lit(".pdf"))).alias("path"),
            when(o % 13 == 0, F.col("o_orderdate")).alias("deleted_at"),
            F.col("o_orderdate").alias("added_at"),
            when(o % 5 == 0, F.col("o_orderdate")).alias("last_opened_at"),
            when(o % 40 != 0, (o % 40).cast("int")).alias("page_count"),
            (o % 25).cast("int").alias("last_page"),
            when(o % 6 == 0, F.concat(F.lit("https://github.com/lab/repo"), o.cast("string"))).alias("github_url"),
            (o % 50 == 0).alias("is_own"),
            F.sha2((o % 5000).cast("string"), 256).alias("file_hash"),
        )

    @cached_property
    def live(self) -> DataFrame:
        return self.documents.where("deleted_at IS NULL")

    @cached_property
    def authors(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("given"), F.col("s_name").alias("family"))

    @cached_property
    def document_authors(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("author_id")).agg(F.min("l_linenumber").alias("position"))

    @cached_property
    def tags(self) -> DataFrame:
        return self.table("part").select(F.regexp_extract("p_brand", r"\d+", 0).cast("long").alias("id"), F.col("p_brand").alias("name")).distinct()

    @cached_property
    def document_tags(self) -> DataFrame:
        part = self.table("part").select("p_partkey", F.regexp_extract("p_brand", r"\d+", 0).cast("long").alias("tag_id"))
        return self.table("lineitem").where("l_linenumber = 1").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("document_id"), "tag_id").distinct()

    @cached_property
    def collections(self) -> DataFrame:
        region = self.table("region").select((F.col("r_regionkey") + REGION).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id"))
        nation = self.table("nation").select((F.col("n_nationkey") + NATION).cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + REGION).cast("long").alias("parent_id"))
        customer = self.table("customer").select((F.col("c_custkey") + CUSTOMER).alias("id"), F.col("c_name").alias("name"), (F.col("c_nationkey") + NATION).cast("long").alias("parent_id"))
        return region.unionByName(nation).unionByName(customer)

    @cached_property
    def members(self) -> DataFrame:
        return self.table("orders").where("o_orderkey % 10 <> 0").select((F.col("o_custkey") + CUSTOMER).alias("collection_id"), F.col("o_orderkey").alias("document_id"))

    @cached_property
    def references(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("10.1000/"), (F.col("l_partkey") * 3).cast("string")).alias("ref_doi"), F.concat(F.lit("Reference "), F.col("l_partkey").cast("string")).alias("raw"))

    @cached_property
    def annotations(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("kind"), F.col("props").alias("quote"), F.col("ts").alias("created_at"))

    @cached_property
    def notes(self) -> DataFrame:
        c = F.col("c_custkey")
        body = F.concat(F.lit("On [[Study of "), F.when(c % 2 == 0, "LOW").otherwise("MEDIUM"), F.lit(" methods, part "), (c % 500).cast("string"), F.lit("]] and [[@key"), c.cast("string"), F.lit("|it]]\n```\n[[not a link]]\n```\nsee [[Note "), (c % 100 + 1).cast("string"), F.lit("]] [[nowhere]]"))
        return self.table("customer").select(c.alias("id"), F.concat(F.lit("Note "), c.cast("string")).alias("title"), body.alias("body"), F.when(c % 5 != 0, F.col("c_nationkey").cast("long") + NATION).alias("collection_id"))

    @cached_property
    def watch_hits(self) -> DataFrame:
        e = F.col("event_id")
        state = F.when(e % 3 == 0, "new").when(e % 3 == 1, "added").otherwise("dismissed")
        return self.table("events").select(e.alias("id"), F.col("event_type").alias("watch"), F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("external_id"), F.col("value").alias("score"), F.col("ts").alias("found_at"), state.alias("state"))

    def index(self, name: str) -> SearchIndex:
        """The kept full-text index of ``texts`` (those of the documents), ``notes`` or ``annotations``."""
        columns = {"texts": ["text"], "notes": ["title", "body"], "annotations": ["kind", "quote"]}[name]
        rows = self.table("documents").select(F.col("doc_id").alias("id"), "text") if name == "texts" else getattr(self, name)
        return search_index.kept(self.spark, self.kept_folder(name), rows.select("id", *columns), "id", columns)

    def kept_folder(self, name: str) -> str:
        """Where an index over these tables is kept, for as long as the application runs: the tables behind a path may be
        others next time, with as many rows. A library that changes by updates keeps its index in a folder of its own."""
        tables = hashlib.sha256(self.folder.encode()).hexdigest()[:16]
        return f"{shared_folder(self.spark)}/kept/{self.spark.sparkContext.applicationId}/{name}-{tables}"


CTES = {
    "documents": """SELECT o_orderkey AS id, 'Study of ' || substring(o_orderpriority, 3, 20) || ' methods, part ' || (o_orderkey % 500) AS title,
        CASE WHEN o_orderkey % 11 <> 0 THEN CAST(year(o_orderdate) AS INT) END AS year, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS venue,
        CASE WHEN o_orderkey % 3 = 0 THEN '10.1000/' || o_orderkey END AS doi, CASE WHEN o_orderkey % 2 = 0 THEN 'key' || o_orderkey END AS citekey,
        o_orderstatus = 'F' AS is_read, o_totalprice > 400000 AS favorite,
        CASE WHEN o_orderkey % 4 = 0 THEN 'ref:doi:' || o_orderkey ELSE '/library/' || o_orderkey || '.pdf' END AS path,
        CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate END AS deleted_at, o_orderdate AS added_at, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS last_opened_at,
        CASE WHEN o_orderkey % 40 <> 0 THEN CAST(o_orderkey % 40 AS INT) END AS page_count, CAST(o_orderkey % 25 AS INT) AS last_page,
        CASE WHEN o_orderkey % 6 = 0 THEN 'https://github.com/lab/repo' || o_orderkey END AS github_url, o_orderkey % 50 = 0 AS is_own,
        sha256(CAST(o_orderkey % 5000 AS VARCHAR)) AS file_hash FROM orders""",
    "live": "SELECT * FROM lib_documents WHERE deleted_at IS NULL",
    "authors": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN 'N' || s_nationkey END AS given, s_name AS family FROM supplier",
    "document_authors": "SELECT l_orderkey AS document_id, l_suppkey AS author_id, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2",
    "tags": "SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS id, p_brand AS name FROM part",
    "document_tags": "SELECT DISTINCT l_orderkey AS document_id, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS tag_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1",
    "collections": f"""SELECT CAST(r_regionkey + {REGION} AS BIGINT) AS id, r_name AS name, CAST(NULL AS BIGINT) AS parent_id FROM region
        UNION ALL SELECT n_nationkey + {NATION}, n_name, n_regionkey + {REGION} FROM nation
        UNION ALL SELECT c_custkey + {CUSTOMER}, c_name, c_nationkey + {NATION} FROM customer""",
    "members": f"SELECT o_custkey + {CUSTOMER} AS collection_id, o_orderkey AS document_id FROM orders WHERE o_orderkey % 10 <> 0",
    "references": "SELECT l_orderkey AS document_id, '10.1000/' || (l_partkey * 3) AS ref_doi, 'Reference ' || l_partkey AS raw FROM lineitem",
    "annotations": "SELECT event_id AS id, user_id AS document_id, event_type AS kind, props AS quote, ts AS created_at FROM events",
    "notes": f"""SELECT c_custkey AS id, 'Note ' || c_custkey AS title, 'On [[Study of ' || CASE WHEN c_custkey % 2 = 0 THEN 'LOW' ELSE 'MEDIUM' END || ' methods, part ' || (c_custkey % 500) || ']] and [[@key' || c_custkey || '|it]]' || chr(10) || '```' || chr(10) || '[[not a link]]' || chr(10) || '```' || chr(10) || 'see [[Note ' || (c_custkey % 100 + 1) || ']] [[nowhere]]' AS body,
        CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey + {NATION} AS BIGINT) END AS collection_id FROM customer""",
    "watch_hits": "SELECT event_id AS id, event_type AS watch, 'x' || user_id AS external_id, value AS score, ts AS found_at, CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'added' ELSE 'dismissed' END AS state FROM events",
}


def cte(body: str, recursive: bool = False) -> str:
    """``body`` behind the library tables that it names (``lib_`` and the table's name)."""
    names = [n for n in CTES if f"lib_{n}" in body or (n == "documents" and "lib_live" in body)]
    head = ", ".join(f"lib_{n} AS ({CTES[n]})" for n in names)
    body = body.strip()
    word = "WITH RECURSIVE " if recursive else "WITH "
    if not head:
        return word + body[5:].strip() if body.startswith("WITH ") and recursive else body
    return f"{word}{head}, {body[5:].strip()}" if body.startswith("WITH ") else f"{word}{head} {body}"
