"""A kept full-text index: written postings by term, updated by segments, merged, rebuilt when stale.

Layout under one folder:

* ``postings/segment=s/bucket=b``: (id, field, term, tf, length, positions), sorted by term. The bucket is a hash of
  the term, so a search opens the buckets of its terms only; a bucket of very common terms is several files.
* ``docs/segment=s``: (id, length, digest) of the documents that the segment brought.
* ``dead/segment=s``: ids whose rows in earlier segments no longer count.
* ``commits``: one row a segment, written last: what is not named there does not exist. It holds the number of
  documents and words afterwards, so ranking needs no pass over the documents.

There is one writer at a time. A segment that was broken off is written over. A document whose texts are the same
as those indexed is left alone; ``merge`` writes what counts as one new base segment. The key must be unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblark.operators import retrieval

WORDS_A_BUCKET = 4_000_000
LEAST_BUCKETS, MOST_BUCKETS = 16, 4096
POSTING = "id long, field int, term string, tf long, length long, positions array<int>"
DOC = "id long, length long, digest string"
COMMIT = "segment long, base boolean, docs long, words long, buckets int"


def inverted(batch: pa.RecordBatch, field: int, length: pa.Array) -> pa.RecordBatch:
    """Postings of one column of word lists: the words of a batch sorted by document, word and place."""
    lists = batch.column(field + 1)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = row * max(1, len(words.dictionary)) + words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    of = pa.array(row[order][first])
    ends = np.append(first, len(key)).astype(np.int32)
    terms = words.dictionary.take(pa.array(key[first] % max(1, len(words.dictionary)))).cast(pa.string())
    positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32)))
    columns = [batch.column(0).take(of), pa.array(np.full(len(first), field, dtype=np.int32)), terms, pa.array(np.diff(ends).astype(np.int64)), length.take(of), positions]
    return pa.RecordBatch.from_arrays(columns, ["id", "field", "term", "tf", "length", "positions"])


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, field, term, tf, length, positions) of every document: one narrow pass, nothing is shuffled."""
    words = docs.select(F.col(key).cast("long").alias("id"), *[retrieval.terms(F.col(c)).alias(f"f{i}") for i, c in enumerate(columns)])

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pa.array(sum(pc.fill_null(pc.list_value_length(batch.column(i + 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(columns))))
            for field in range(len(columns)):
                yield inverted(batch, field, length)

    return words.mapInArrow(invert, POSTING)


@dataclass(frozen=True)
class Commit:
    segment: int
    docs: int
    words: int
    buckets: int
    segments: tuple[int, ...]  # those that count, the base first


class SearchIndex:
    def __init__(self, spark: SparkSession, folder: str, key: str, columns: list[str]):
        self.spark, self.folder, self.key, self.columns = spark, folder.rstrip("/"), key, columns

    def last(self) -> Commit | None:
        """The state after the last commit; a row a segment comes to the driver."""
        try:
            rows = sorted(self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits").collect())
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        base = max(r["segment"] for r in rows if r["base"])
        top = rows[-1]
        return Commit(top["segment"], top["docs"], top["words"], top["buckets"], tuple(r["segment"] for r in rows if r["segment"] >= base))

    def _segments(self, name: str, schema: str, at: Commit) -> DataFrame:
        paths = [f"{self.folder}/{name}/segment={s}" for s in at.segments]
        return self.spark.read.schema(f"{schema}, segment long" + (", bucket int" if name == "postings" else "")).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def _living(self, rows: DataFrame, at: Commit) -> DataFrame:
        """Without rows that a later segment replaced."""
        if len(at.segments) == 1:
            return rows
        dead = self._segments("dead", "id long", at).select(F.col("id").alias("_id"), F.col("segment").alias("_since"))
        return rows.join(dead, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("_since")), "left_anti")

    def docs(self, at: Commit) -> DataFrame:
        return self._living(self._segments("docs", DOC, at), at)

    def _digest(self) -> Column:
        return F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(self.columns)])), 256)

    def _write(self, segment: int, texts: DataFrame, buckets: int | None) -> tuple[int, int, int]:
        """Documents and postings of ``texts``; how many documents, words and buckets there are."""
        size = sum((F.size(retrieval.terms(F.col(c))) for c in self.columns[1:]), F.size(retrieval.terms(F.col(self.columns[0]))))
        at = f"{self.folder}/docs/segment={segment}"
        texts.select(F.col(self.key).cast("long").alias("id"), size.cast("long").alias("length"), self._digest().alias("digest")).write.mode("overwrite").parquet(at)
        docs, words = self.spark.read.schema(DOC).parquet(at).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if buckets is None:
            buckets = LEAST_BUCKETS
            while buckets < MOST_BUCKETS and words > buckets * WORDS_A_BUCKET:
                buckets *= 2
        self._store(segment, postings(texts, self.key, self.columns), buckets)
        return docs, words, buckets

    def _store(self, segment: int, rows: DataFrame, buckets: int) -> None:
        """Rows by bucket: adaptive execution splits buckets that common terms make large."""
        placed = rows.withColumn("bucket", bucket_of(F.col("term"), buckets)).hint("rebalance", F.col("bucket"))
        placed.sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")

    def _commit(self, segment: int, base: bool, docs: int, words: int, buckets: int) -> None:
        self.spark.createDataFrame([(segment, base, docs, words, buckets)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def build(self, docs: DataFrame) -> None:
        """A new base of all ``docs``; what was before no longer counts."""
        at = self.last()
        segment = at.segment + 1 if at else 1
        self.spark.createDataFrame([], "id long").write.mode("overwrite").parquet(f"{self.folder}/dead/segment={segment}")
        self._commit(segment, True, *self._write(segment, docs, None))

    def update(self, changes: DataFrame) -> int:
        """Takes in ``changes``: the key, the columns and ``gone``, a row a document; new and changed texts come, texts
        that are gone leave, equal ones stay as they are. Returns how many documents changed."""
        at = self.last()
        if at is None:
            self.build(changes.where("not gone"))
            return self.last().docs
        segment = at.segment + 1
        have = self.docs(at).select(F.col("id").alias("_have"), "length", F.col("digest").alias("_old"))
        met = changes.join(have, F.col(self.key).cast("long") == F.col("_have"), "left")
        touched = met.where(F.when(F.col("gone"), F.col("_have").isNotNull()).otherwise(~F.col("_old").eqNullSafe(self._digest())))
        path = f"{self.folder}/touched/segment={segment}"
        touched.write.mode("overwrite").parquet(path)
        touched = self.spark.read.schema(touched.schema).parquet(path)
        touched.select(F.col(self.key).cast("long").alias("id")).write.mode("overwrite").parquet(f"{self.folder}/dead/segment={segment}")
        count, left_docs, left_words = touched.agg(F.count("*"), F.count("_have"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if not count:
            return 0
        docs, words, _ = self._write(segment, touched.where("not gone").select(self.key, *self.columns), at.buckets)
        self._commit(segment, False, at.docs - left_docs + docs, at.words - left_words + words, at.buckets)
        return count

    def merge(self) -> None:
        """One base segment of what counts."""
        at = self.last()
        segment = at.segment + 1
        living = self._living(self._segments("postings", POSTING, at), at).drop("segment", "bucket")
        self.docs(at).drop("segment").write.mode("overwrite").parquet(f"{self.folder}/docs/segment={segment}")
        self.spark.createDataFrame([], "id long").write.mode("overwrite").parquet(f"{self.folder}/dead/segment={segment}")
        self._store(segment, living, at.buckets)
        self._commit(segment, True, at.docs, at.words, at.buckets)

    def stale(self, docs: DataFrame) -> bool:
        """The documents are more or fewer than the index holds: a count of rows, which Parquet keeps, not a pass over texts."""
        at = self.last()
        return at is None or docs.count() != at.docs

    def reconcile(self, docs: DataFrame) -> bool:
        """Builds the index anew if it is stale."""
        stale = self.stale(docs)
        if stale:
            self.build(docs)
        return stale

    # ---- searches: each reads the postings of its terms

    def terms_of(self, text: str) -> list[str]:
        return list(self.spark.range(1).select(retrieval.terms(F.lit(text))).first()[0])

    def hits(self, terms: list[str]) -> DataFrame:
        """Living postings of the terms, from their buckets."""
        at = self.last()
        wanted = sorted(set(terms))
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "term string").select(bucket_of(F.col("term"), at.buckets)).distinct().collect()] if wanted else []
        found = self._segments("postings", POSTING, at).where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted)) if wanted else self.spark.createDataFrame([], f"{POSTING}, segment long, bucket int")
        return self._living(found, at)

    def match_all(self, text: str) -> DataFrame:
        """(id) of documents that hold every word of ``text``, in any of the columns; none for a text without words."""
        terms = self.terms_of(text)
        return self.hits(terms).groupBy("id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(set(terms))).select("id")

    def match_phrase(self, text: str) -> DataFrame:
        """(id) of documents in which the words of ``text`` follow each other within one column."""
        terms = self.terms_of(text)
        if not terms:
            return self.hits([]).select("id")
        places = self.hits(terms).groupBy("id", "field").agg(*[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(terms)])
        starts = F.col("p0")
        for i in range(1, len(terms)):
            starts = F.array_intersect(starts, shifted(F.col(f"p{i}"), i))
        return places.where(F.size(starts) > 0).select("id").distinct()

    def bm25(self, text: str, limit: int) -> DataFrame:
        """(id, score, rank) of the best documents; the corpus' sums come from the last commit."""
        terms = self.terms_of(text)
        at = self.last()
        if not terms:
            return self.hits([]).select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        by_doc = self.hits(terms).groupBy("id").agg(F.first("length").alias("length"), *[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)])
        seen = by_doc.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
        scored = by_doc.crossJoin(F.broadcast(seen))  # one row
        mean, k1, b = at.words / max(1, at.docs), retrieval.K1, retrieval.B
        part = lambda i: F.log(1 + (F.lit(at.docs) - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("length") / mean))
        score = sum((part(i) for i in range(1, len(terms))), part(0))
        top = scored.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # a bounded list


def shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def kept(spark: SparkSession, folder: str, docs: DataFrame, key: str, columns: list[str]) -> SearchIndex:
    """The index in that folder, built where there is none or its count is off."""
    index = SearchIndex(spark, folder, key, columns)
    index.reconcile(docs)
    return index
