"""From raw documents to packed training sequences, stage by stage.

Each stage gets all rows that the stage before it kept and is written as
Parquet and read again, so that a lost executor costs no earlier stage.

Defined results, for all stages: rows without doc_id are read like others; null
and empty texts are scored as empty, are near copies of each other, hold no
benchmark passage and no personal data, and become one token; repeated rows are
near copies of each other; further columns stay, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblark.llm import decontaminate, near_copies, packing, pii, quality
from biblark.llm.common import Scratch, fresh, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality network rejects."""
    network = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.good(docs, network)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: 5-word shingles, similarity 0.8 or more."""
    return near_copies.one_of_each(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages. Texts are named by their hash: of rows that share a doc_id only
    those with a contaminated text go."""
    leak = fresh(docs, "_leak")
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaks = decontaminate.contaminated(spark, texts, table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select(F.col("doc_id").alias(leak)).distinct(), F.xxhash64(docs["text"]) == F.col(leak), "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("best-fit packing", pack),
]

#: No SQL: the quality network is learned, and SQL has no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
