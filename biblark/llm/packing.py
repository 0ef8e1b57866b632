"""Best-fit packing of tokenised documents into sequences of a fixed length.

Method: pattern packing by non-negative least squares. Only the histogram of
piece lengths (at most ``capacity`` counters, whatever the corpus) reaches the
driver. There all patterns of up to ``depth`` lengths that fill a sequence
exactly are enumerated; non-negative least squares fits repeat counts to the
histogram; the counts are rounded and trimmed to what exists; best fit places
the residual lengths. The plan is applied on the executors: a piece's rank
among the pieces of its length tells its pattern, copy and place.

Defined results: null text counts as empty (one piece that holds the end
token); repeated rows are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from biblark.llm import tokens
from biblark.llm.common import Scratch, table

CAPACITY = 1024
END_ID = 2
#: Fractions from which a fitted count is rounded up.
ROUNDINGS = (0.5, 0.75, 1.0)
#: Rows of one length that share a salt, on average.
ROWS_PER_SALT = 500


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end token, cut
    into pieces of ``capacity`` of which the first takes what is over."""
    json_path, rank_path = paths or tokens.default_paths()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(json_path, rank_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                first = len(ids) % capacity or capacity
                ends = range(first, len(ids) + 1, capacity)
                start = 0
                for piece, end in enumerate(ends):
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    # doc_id goes through as text: pandas has no integer column that holds nulls without rounding the others.
    pieces = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))


def fit_patterns(histogram: np.ndarray, capacity: int, depth: int = 3, block: int = 48, rounds: int = 200) -> list[tuple[tuple[int, ...], float]]:
    """Patterns and repeat counts (not yet rounded) by an active-set non-negative least-squares fit of ``histogram``."""
    a, b = np.meshgrid(np.arange(capacity + 1), np.arange(capacity + 1), indexing="ij")
    c = capacity - a - b
    keep = (a >= b) & (b >= c) & (c >= 0)
    if depth < 3:
        keep &= c == 0
    parts = np.stack([a[keep], b[keep], c[keep]], axis=1)
    have = histogram > 0
    have[0] = True
    parts = parts[have[parts].all(axis=1)]
    if not len(parts):
        return []
    target = histogram.astype(float)
    target[0] = 0
    columns = np.zeros((capacity + 1, 0))
    chosen = np.zeros(0, dtype=int)
    amount = np.zeros(0)
    rest = target.copy()
    for _ in range(rounds):
        gain = rest[parts].sum(axis=1)
        gain[chosen] = -1
        order = np.argsort(-gain)[:4000]
        taken, new = np.zeros(capacity + 1, dtype=bool), []
        for p in order[gain[order] > 0.5]:
            lengths = parts[p][parts[p] > 0]
            if not taken[lengths].any():
                taken[lengths] = True
                new.append(p)
                if len(new) == block:
                    break
        if not new:
            break
        more = np.zeros((capacity + 1, len(new)))
        for slot in range(3):
            np.add.at(more, (parts[new][:, slot], np.arange(len(new))), 1)
        more[0] = 0
        columns, chosen, amount = np.hstack([columns, more]), np.r_[chosen, new], np.r_[amount, np.zeros(len(new))]
        while True:
            gram = columns.T @ columns
            gram[np.diag_indices_from(gram)] += 1e-8
            best = np.linalg.solve(gram, columns.T @ target)
            if (best > 0).all():
                amount = best
                break
            low = best <= 0
            step = np.min(amount[low] / np.maximum(amount[low] - best[low], 1e-12))
            amount = amount + step * (best - amount)
            stay = ~(low & (amount <= 1e-9))
            columns, chosen, amount = columns[:, stay], chosen[stay], amount[stay]
            if not len(chosen):
                break
        rest = target - columns @ amount if len(chosen) else target.copy()
    return [(tuple(int(n) for n in parts[p] if n), float(x)) for p, x in zip(chosen, amount)]


def plan_packing(histogram: np.ndarray, capacity: int = CAPACITY, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a sequence, number of such sequences)] that use every piece of the histogram once. The fitted
    counts are rounded from each of ``ROUNDINGS`` on; the rounding that needs the fewest sequences counts, since
    small histograms have many counts below one."""
    fitted = fit_patterns(histogram, capacity, depth)
    plans = [rounded_plan(histogram, fitted, up, capacity) for up in ROUNDINGS]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def rounded_plan(histogram: np.ndarray, fitted: list[tuple[tuple[int, ...], float]], up: float, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Counts rounded up from the fraction ``up`` on, trimmed to the pieces there are, and the residual packed by best fit."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[tuple[int, ...], int]] = []
    for lengths, amount in sorted(fitted, key=lambda p: -p[1]):
        need = {n: lengths.count(n) for n in lengths}
        times = min(int(amount + 1 - up), *(int(left[n]) // k for n, k in need.items()))
        if times > 0:
            plan.append((lengths, times))
            for n, k in need.items():
                left[n] -= k * times
    # Best fit of the residual, many equal pieces at a time.
    free: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        while todo:
            room = next((r for r in range(n, capacity + 1) if free[r]), None)
            lengths, bins = free[room].pop() if room else ((), todo)
            room = room or capacity
            each = min(room // n, todo)
            used = min(bins, todo // each)
            if lengths and used < bins:
                free[room].append((lengths, bins - used))
            free[room - each * n].append((lengths + (n,) * each, used))
            todo -= each * used
    return plan + [entry for entries in free for entry in entries]


def slots(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """The plan as intervals over all pieces in order of length: from which position which sequence, at which offset."""
    rows, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            rows.append((n, times, sequence, offset))
            offset += n
        sequence += times
    rows.sort(key=lambda r: r[0])
    length, times, first, offset = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else (np.zeros(0, dtype=np.int64),) * 4
    return {"start": np.cumsum(times) - times, "sequence": first, "offset": offset}


def pack(pieces: DataFrame, capacity: int = CAPACITY, depth: int = 3) -> DataFrame:
    """Adds sequence_id and offset. ``pieces`` is read several times and should be a written table."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in counts.items():
        histogram[n] = k
    at = slots(plan_packing(histogram, capacity, depth), capacity)
    salts = np.maximum(1, -(-histogram // ROWS_PER_SALT)).tolist()
    before = np.cumsum(histogram) - histogram

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(F.lit(salts), F.col("length").cast("int"))))
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    bases = sums.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_rank", within).join(bases, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))

    place = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])

    @F.pandas_udf(place)
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        position = before[length.to_numpy()] + rank.to_numpy()
        row = np.searchsorted(at["start"], position, side="right") - 1
        return pd.DataFrame({"sequence_id": at["sequence"][row] + position - at["start"][row], "offset": at["offset"][row]})

    return ranked.withColumn("_at", placed("length", "_rank")).select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    scratch = Scratch(spark, "packing")
    return pack(scratch.keep(tokenized_pieces(docs, capacity), "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))
