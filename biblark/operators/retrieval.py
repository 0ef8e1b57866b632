"""Full text, ranking, fusion, passages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblark.functions import text as T

K1, B = 1.2, 0.75
FUSION = 60


def terms(c: Column) -> Column:
    """Tokens: runs of letters and digits, lower case, without accents."""
    return F.filter(F.split(T.fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, term, tf) of one text column."""
    return docs.select(key, F.explode(terms(F.col(column))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_hits(docs: DataFrame, key: str, columns: list[str], query: list[str]) -> DataFrame:
    """(key, length, one count a query term) by one narrow pass: no explosion of texts into postings."""
    words = F.concat(*[terms(F.col(c)) for c in columns])
    times = lambda q: F.size(F.filter("_w", lambda w: w == q))
    return docs.select(key, words.alias("_w")).select(key, F.size("_w").alias("length"), *[times(q).alias(f"tf{i}") for i, q in enumerate(query)])


def match_all(docs: DataFrame, key: str, columns: list[str], query: list[str]) -> DataFrame:
    """Keys of texts that hold every term."""
    words = F.concat(*[terms(F.col(c)) for c in columns])
    return docs.where(F.forall(F.array(*map(F.lit, query)), lambda q: F.array_contains(words, q))).select(key)


def match_phrase(docs: DataFrame, key: str, column: str, query: list[str]) -> DataFrame:
    joined = F.concat(F.lit(" "), F.array_join(terms(F.col(column)), " "), F.lit(" "))
    return docs.where(joined.contains(" " + " ".join(query) + " ")).select(key)


def bm25(docs: DataFrame, key: str, columns: list[str], query: list[str], limit: int) -> DataFrame:
    """(key, score, rank) of the best texts. Corpus statistics are one row of sums over all texts."""
    hits = term_hits(docs, key, columns, query)
    stats = hits.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))])
    scored = hits.where(" OR ".join(f"tf{i} > 0" for i in range(len(query)))).join(F.broadcast(stats))  # one row
    part = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    score = sum((part(i) for i in range(1, len(query))), part(0))
    top = scored.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)
    return ranked(top, key, "score")


def ranked(top: DataFrame, key: str, score: str) -> DataFrame:
    """Ranks of a bounded list."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def fused(lists: list[DataFrame], key: str, limit: int, constant: int = FUSION) -> DataFrame:
    """Reciprocal-rank fusion of bounded ranked lists: (key, score)."""
    union = lists[0].select(key, "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select(key, "rank"))
    return union.groupBy(key).agg(F.round(F.sum(1 / (constant + F.col("rank"))), 8).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def snippets(docs: DataFrame, key: str, title: str, body: str, query: str) -> DataFrame:
    """Substring search over title and body with an excerpt of the body."""
    found = docs.where(T.contains_nocase(F.col(title), query) | T.contains_nocase(F.col(body), query))
    return found.select(key, T.excerpt(F.col(body), query).alias("excerpt"))


def chunk(text: str | None, target: int, overlap: int, most: int | None = None) -> list[str]:
    """Passages on word borders: words are taken until their bytes and one each reach ``target``; the next
    passage starts as many words back as ``overlap`` needs, one word further at least."""
    words = (text or "").split()
    sizes = [len(w.encode("utf-8", "surrogatepass")) + 1 for w in words]
    out: list[str] = []
    start = 0
    while start < len(words) and (most is None or len(out) < most):
        end = size = start
        size = 0
        while end < len(words) and size < target:
            size += sizes[end]
            end += 1
        out.append(" ".join(words[start:end]))
        if end == len(words):
            break
        back, carried = end, 0
        while back > start and carried < overlap:
            back -= 1
            carried += sizes[back]
        start = max(back, start + 1)
    return out


def chunks(docs: DataFrame, key: str, column: str, target: int = 1000, overlap: int = 200, most: int | None = None) -> DataFrame:
    """(key, ord, passage) of every text, at most ``most`` of each if that is given."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([chunk(t, target, overlap, most) for t in texts])

    return docs.select(key, F.posexplode(cut(F.col(column))).alias("ord", "passage"))


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``new`` whose indexed texts differ from ``old``, nulls compared as values."""
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns]
    test = same[0]
    for s in same[1:]:
        test = test & s
    joined = new.alias("n").join(old.alias("o"), key, "left")
    return joined.where(F.col(f"o.{columns[0]}").isNull() | ~test).select("n.*")


def reindexed(index: DataFrame, old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Postings after ``old`` became ``new``: those of gone and changed texts leave, those of new and changed ones come."""
    touched = changed(old, new, key, [column])
    gone = old.join(new, key, "left_anti").select(key)
    kept = index.join(touched.select(key).unionByName(gone), key, "left_anti")
    return kept.unionByName(postings(touched, key, column))
