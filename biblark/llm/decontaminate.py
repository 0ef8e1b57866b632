"""Documents that contain benchmark passages, in their order or reordered.

Method: greedy string tiling. A document and a benchmark item are compared
where they share a seed of ``SEED`` tokens. Again and again their longest
common run of unmarked tokens is marked, down to ``SEED`` tokens; runs are
found by Karp-Rabin hashes. The share of the item's tokens that is marked is
its coverage. From ``COVERAGE`` on the document is contaminated, whatever the
order of the passages.

Documents are read once: a fixed-size bit map of the benchmark's seed hashes
(``FILTER_BITS``, however large the benchmark) leaves of each document only
the stretches that may share seeds; those are joined with the benchmark by
seed. Every item leaves its commonest seeds out of that join, as many as no
contaminated document can do without others, so a phrase that many documents and
items share makes no candidates by itself. An item of fewer than ``SEED`` tokens
is its own seed.

Defined results: tokens are runs of letters and digits, lower case. Null and
empty texts and items have no tokens and match nothing. Repeated documents are
found one by one; items of equal text all count. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblark.llm.common import Scratch, table

SEED = 5
COVERAGE = 0.6
FILTER_BITS = 1 << 24
TOKEN = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(text: str | None) -> np.ndarray:
    from xxhash import xxh64_intdigest

    known: dict[str, int] = {}
    out = []
    for t in TOKEN.findall((text or "").lower()):
        h = known.get(t)
        if h is None:
            h = known[t] = xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
        out.append(h)
    return np.array(out, dtype=np.uint64)


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n tokens, modulo 2**64."""
    if len(ids) < n or n < 1:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * BASE + (ids[j : len(ids) - n + 1 + j] ^ (ids[j : len(ids) - n + 1 + j] >> np.uint64(29)))
    return out


def prefix_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the Karp-Rabin hash of any run follows at once: the run's sum of tokens by powers of the
    inverse of ``BASE``, brought to its first token by a power of ``BASE``."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        powers = lambda b: np.r_[np.uint64(1), np.cumprod(np.full(max(len(ids) - 1, 0), b))][: len(ids)].astype(np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum((ids ^ (ids >> np.uint64(29))) * powers(inverse), dtype=np.uint64)]
    return sums, powers(BASE)


def run_hashes(prefix: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    sums, powers = prefix
    with np.errstate(over="ignore"):
        return (sums[n:] - sums[:-n]) * powers[: len(sums) - n]


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> np.ndarray:
    """Which tokens of ``item`` greedy string tiling marks: again and again the longest common run of unmarked tokens,
    found by halving on Karp-Rabin hashes; all runs of that length that do not overlap, from the left of the document."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    of_doc, of_item = prefix_hashes(doc), prefix_hashes(item)

    def open_runs(free: np.ndarray, n: int) -> np.ndarray:
        taken = np.r_[0, np.cumsum(~free)]
        return taken[n:] == taken[:-n]

    def matches(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hd, hi = run_hashes(of_doc, n), run_hashes(of_item, n)
        starts_d, starts_i = np.flatnonzero(open_runs(free_doc, n)), np.flatnonzero(open_runs(free_item, n))
        starts_i = starts_i[np.isin(hi[starts_i], hd[starts_d])]
        starts_d = starts_d[np.isin(hd[starts_d], hi[starts_i])]
        return starts_d, starts_i, hd, hi

    high = min(len(doc), len(item))
    while high >= least:
        found = matches(least)
        if not len(found[0]):
            break
        low = least
        while low < high:  # the longest run that still matches
            middle = (low + high + 1) // 2
            more = matches(middle)
            if len(more[0]):
                low, found = middle, more
            else:
                high = middle - 1
        starts_d, starts_i, hd, hi = found
        where: dict[int, list[int]] = {}
        for j in starts_i[::-1].tolist():
            where.setdefault(int(hi[j]), []).append(j)  # the leftmost comes last
        upto = 0
        for p in starts_d.tolist():
            if p < upto:
                continue
            left = where[int(hd[p])]
            while left and not free_item[left[-1] : left[-1] + low].all():
                left.pop()
            if left and np.array_equal(doc[p : p + low], item[left[-1] : left[-1] + low]):
                j = left.pop()
                free_doc[p : p + low] = free_item[j : j + low] = False
                upto = p + low
        high = low if upto else low - 1
    return ~free_item


def least_seeds(item_tokens: int, seed: int, coverage: float) -> int:
    """How many seed places of an item a contaminated document shares at least: a run of n tokens has n - seed + 1."""
    return max(1, -(-math.ceil(coverage * item_tokens - 1e-9) // min(seed, item_tokens)))


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = COVERAGE, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id, matched_tokens, item_tokens, coverage) of every document and item from ``coverage`` on."""
    scratch = scratch or Scratch(spark, "decontaminate")

    def read_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [token_hashes(t) for t in batch["text"]]
            seeds = [window_hashes(x, min(seed, len(x))).view(np.int64) for x in ids]
            yield pd.DataFrame({"item_id": batch["item_id"], "item": [x.view(np.int64) for x in ids], "places": seeds, "least": [least_seeds(len(x), seed, coverage) if len(x) else 0 for x in ids]})

    as_text = lambda c: F.col(c).cast("long").cast("string").alias(c)  # noqa: E731  (pandas rounds long ids beside nulls)
    known = items.select(as_text("item_id"), "text").mapInPandas(read_items, "item_id string, item array<long>, places array<long>, least int").where("size(item) > 0")
    known = known.withColumn("seeds", F.array_distinct("places")).withColumn("entry", F.monotonically_increasing_id())
    known = scratch.keep(known, "items")

    # The bit map, set on the executors and merged into FILTER_BITS bits; and which seed lengths occur.
    bits = known.select(F.explode("seeds").alias("s")).select(F.pmod("s", F.lit(FILTER_BITS)).alias("bit")).distinct().select((F.col("bit") / 4096).cast("int").alias("page"), (F.col("bit") % 4096).cast("int").alias("bit"))
    pages = bits.groupBy("page").agg(F.collect_list("bit").alias("bits"))
    present = np.zeros(FILTER_BITS, dtype=bool)
    for row in pages.toLocalIterator():
        present[row["page"] * 4096 + np.array(row["bits"])] = True
    packed = spark.sparkContext.broadcast(np.packbits(present))
    lengths = sorted(r["n"] for r in known.select(F.least(F.size("item"), F.lit(seed)).alias("n")).distinct().collect())

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = np.unpackbits(packed.value).view(bool)
        for batch in batches:
            rows = []
            for row, (doc_id, text) in enumerate(zip(batch["doc_id"], batch["text"])):
                ids = token_hashes(text)
                keep, seeds = np.zeros(len(ids), bool), []
                for n in lengths:
                    h = window_hashes(ids, n)
                    hit = np.flatnonzero(have[(h % np.uint64(FILTER_BITS)).astype(np.int64)])
                    if len(hit):
                        seeds.append(h[hit])
                        for j in range(n):
                            keep[hit + j] = True
                if seeds:
                    at = np.flatnonzero(keep)
                    # A stretch is followed by a zero wherever tokens were left out, so that no run crosses it.
                    parts = np.split(ids[at], np.flatnonzero(np.diff(at) > 1) + 1)
                    gap = np.zeros(1, np.uint64)
                    joined = np.concatenate([x for p in parts for x in (p, gap)])
                    rows.append((doc_id, joined.view(np.int64), np.unique(np.concatenate(seeds)).view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "doc", "seeds"])

    part = docs.select(as_text("doc_id"), "text").mapInPandas(stretches, "doc_id string, doc array<long>, seeds array<long>")
    part = scratch.keep(part.withColumn("row", F.monotonically_increasing_id()), "stretches")

    # Each item is sought by its rarest seeds only. A contaminated document shares ``least`` of the item's seed places
    # or more, so it shares one of those that are left when the commonest ``least`` - 1 places are not sought.
    places = known.select("entry", "least", F.explode("places").alias("s")).groupBy("entry", "least", "s").agg(F.count("*").alias("times"))
    in_docs = part.select(F.explode("seeds").alias("s")).groupBy("s").agg(F.count("*").alias("docs"))
    common_first = Window.partitionBy("entry").orderBy(F.desc("docs"), "s")
    ranked = places.join(in_docs, "s").withColumn("upto", F.sum("times").over(common_first.rowsBetween(Window.unboundedPreceding, 0)))
    by_seed = ranked.where("upto >= least").select("entry", "s")
    pairs = part.select("row", F.explode("seeds").alias("s")).join(by_seed, "s").select("row", "entry").distinct()
    pairs = pairs.join(known.select("entry", "item_id", "item", "places", "least"), "entry").join(part.select("row", "doc_id", "doc", "seeds"), "row")

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, doc, seeds, item_id, item, places, least in zip(*(batch[c] for c in ("doc_id", "doc", "seeds", "item_id", "item", "places", "least"))):
                if np.isin(places, seeds).sum() < least:
                    continue
                item = np.asarray(item, dtype=np.int64).view(np.uint64)
                marked = int(tile(np.asarray(doc, dtype=np.int64).view(np.uint64), item, min(seed, len(item))).sum())
                if marked >= coverage * len(item):
                    rows.append((doc_id, item_id, marked, len(item), marked / len(item)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "matched_tokens", "item_tokens", "coverage"])

    found = pairs.select("doc_id", "doc", "seeds", "item_id", "item", "places", "least").mapInPandas(cover, "doc_id string, item_id string, matched_tokens long, item_tokens long, coverage double")
    return found.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("item_id", F.col("item_id").cast("long"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
