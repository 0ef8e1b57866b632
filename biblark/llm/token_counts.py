"""Token counts by source, language and tokenizer version, kept up to date by deltas.

Method: delta-maintained rollups. A batch carries inserts, deletes and revised
counts of documents. The ledger's key is (doc_id, tokenizer). Each key of a
batch is looked up in the ledger of the batches before it and becomes signed
rows: what the ledger holds of it is taken away, what the batch says of it is
added. Totals are additive, so a batch's signed rows are summed on their own
and added to the totals before it; documents that the batch does not name are
not read again but for their keys.

A batch is written under its serial number and becomes visible by a commit row,
written last. A batch whose commit row exists is left alone when it comes
again; one that was broken off before its commit is written over. There is one
writer at a time.

Defined results: null text has zero tokens; null source or language is a group
of its own. An insert or a revision of a known document replaces it, of an
unknown one adds it, so a document counts once however many batches bring it;
a delete of an unknown document changes nothing. Of several rows of one batch
for one key the last by ``seq`` counts (null or no such column: all equal); of
equal ones a delete before a revision before an insert, then the most tokens.
Rows without a doc_id have no key: all their inserts and revisions count, and
nothing takes them away. An empty batch commits empty totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblark.llm import tokens
from biblark.llm.common import Scratch, table

VERSION = "byte_bpe_50k"
KEYS = ["source", "lang", "tokenizer"]
DELTA = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
TOTAL = "source string, lang string, tokenizer string, docs long, tokens long"


def counted(docs: DataFrame, version: str = VERSION, paths: tuple[str, str] | None = None) -> DataFrame:
    """A batch of inserts: (op, doc_id, source, lang, tokenizer, tokens) per row of ``docs``."""
    json_path, rank_path = paths or tokens.default_paths()

    @F.pandas_udf("long")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokens.encoder(json_path, rank_path)
        for texts in batches:
            yield pd.Series([len(encode(t or "")) for t in texts], dtype="int64")

    return docs.select(F.lit("insert").alias("op"), F.col("doc_id").cast("long"), "source", "lang", F.lit(version).alias("tokenizer"), size(F.col("text")).alias("tokens"))


class TokenRollup:
    """Ledger, batch totals and commits under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        return self._read("commits", "batch string, serial long")

    def serial(self) -> int:
        """The number of committed batches."""
        return self.commits().agg(F.max("serial")).first()[0] or 0

    def ledger(self) -> DataFrame:
        """Signed rows of committed batches."""
        return self._read("ledger", DELTA + ", serial long").where(F.col("serial") <= self.serial())

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens), groups that came down to nothing left out."""
        last = self.serial()
        found = self._read(f"totals/serial={last}", TOTAL) if last else self.spark.createDataFrame([], TOTAL)
        return found.where("docs <> 0 or tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Takes in ``changes`` (op, doc_id, source, lang, tokenizer, tokens, seq if any); False if ``batch`` was committed before."""
        if self.commits().where(F.col("batch") == batch).limit(1).count():
            return False
        serial = self.serial() + 1
        path = f"{self.folder}/ledger/serial={serial}"
        signed(changes, self.ledger() if serial > 1 else None).write.mode("overwrite").parquet(path)
        new = self.spark.read.schema(DELTA).parquet(path).select(*KEYS, "docs", "tokens")
        before = self._read(f"totals/serial={serial - 1}", TOTAL)
        sums = new.unionByName(before).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/totals/serial={serial}")
        self.spark.createDataFrame([(batch, serial)], "batch string, serial long").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return True


def signed(changes: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """The batch as signed rows. The ledger is looked up for the batch's keys; without one there is none before it."""
    key = ["doc_id", "tokenizer"]
    one = F.lit(1).cast("long")
    changes = changes if "seq" in changes.columns else changes.withColumn("seq", F.lit(None).cast("long"))
    known = changes.where("op in ('insert', 'revise', 'delete')").select("op", *key, "source", "lang", F.col("tokens").cast("long").alias("tokens"), "seq")
    order = F.struct(F.coalesce("seq", F.lit(-(1 << 62))).alias("seq"), (F.when(F.col("op") == "delete", 2).when(F.col("op") == "revise", 1).otherwise(0)).alias("rank"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "source", "lang")
    last = known.where("doc_id is not null").groupBy(*key).agg(F.max(order).alias("o"))
    last = last.select(*key, "o.source", "o.lang", "o.rank", "o.tokens")
    added = last.where("rank < 2").select("doc_id", *KEYS, one.alias("docs"), "tokens")
    loose = known.where("doc_id is null and op <> 'delete'").select("doc_id", *KEYS, one.alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    out = added.unionByName(loose)
    if ledger is None:
        return out
    held = ledger.join(last.select(*key), key, "left_semi").groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return out.unionByName(held.where("docs <> 0 or tokens <> 0").select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all documents, reached as they are in a running corpus: in batches of inserts, corrections,
    deletes and documents that come again. Every document counts in the end, once, with its true count."""
    scratch = Scratch(spark, "token-counts")
    docs = scratch.keep(counted(table(spark, sf_dir, "documents")), "counted")
    part = F.when(F.col("doc_id").isNull(), 3).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    of = lambda *parts: docs.where(part.isin(*parts))
    rollup = TokenRollup(spark, scratch.path("rollup"))
    first = docs.where(part < 6).withColumn("tokens", F.when(part == 0, 0).otherwise(F.col("tokens")))
    corrections = of(0).withColumn("op", F.lit("revise")).unionByName(of(1).withColumn("op", F.lit("delete")))
    rollup.commit("1 first load, some not counted yet", first)
    rollup.commit("2 their counts, and deletes", corrections)
    rollup.commit("2 their counts, and deletes", corrections)  # comes again: left alone
    rollup.commit("3 the rest, the deleted ones and some a second time", of(1, 2, 6, 7))
    totals = scratch.keep(rollup.totals(), "totals")
    scratch.drop(docs)
    scratch.drop_path(rollup.folder)
    return totals
