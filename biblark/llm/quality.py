"""Document quality by a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes run over every byte of a text. Two
channels go in: the byte, and whether its word repeats the word before. The
rectified responses are max-pooled over overlapping chunks (``CHUNK`` bytes,
half of it shared with the next), the pooled chunks are combined by their mean
and their maximum, and a logistic layer gives one probability. It is trained
on the driver on at most ``SAMPLE`` labelled rows (least hash of doc_id, texts
of at most ``SAMPLE_BYTES`` bytes); scoring covers whole texts, in Arrow
batches, in bounded blocks.

Defined results: a null or empty text is scored as an empty byte string; labels
other than 0 and 1 are no labels; with no labelled rows every score is 0.5;
repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblark.llm.common import table

FILTERS = 16
WIDTH = 4
CHUNK = 128
SAMPLE = 3000
SAMPLE_BYTES = 20_000
#: Texts that training sees, repeats included.
SEEN = 18_000
BLOCK = 1 << 17
FOLDS = 5
THRESHOLD = 0.3

SIGNS = np.random.default_rng(5).integers(1, 1 << 48, 256, dtype=np.uint64)
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, each filled with zero bytes to whole half-chunks (``WIDTH`` - 1 zeros at
    least); the repeat channel; the first half-chunk of each text."""
    half = CHUNK // 2
    sizes = np.array([-(-(len(t) + WIDTH - 1) // half) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()) * half + WIDTH, dtype=np.uint8)
    for t, s in zip(texts, starts.tolist()):
        data[s * half : s * half + len(t)] = np.frombuffer(t, dtype=np.uint8)
    gap = SPACES[data] | (data == 0)
    sign = np.cumsum(np.where(gap, np.uint64(0), SIGNS[data]))
    edge = np.diff(np.r_[True, gap, True].astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = sign[end - 1] - np.where(begin > 0, sign[begin - 1], np.uint64(0))
    again = np.flatnonzero((word[1:] == word[:-1]) & (end - begin)[1:].astype(bool)) + 1
    mark = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(mark, begin[again], 1)
    np.add.at(mark, end[again], -1)
    return data, np.cumsum(mark[:-1]).astype(np.float32), starts


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {
            "byte": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
            "again": rng.normal(0, 0.3, (WIDTH, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "shift": np.zeros(1, np.float32),
        }

    def pooled(self, data: np.ndarray, again: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Highest response of each filter in each half-chunk, and at which byte."""
        half, p = CHUNK // 2, self.p
        n = (len(data) - WIDTH) // half * half
        best, at = np.empty((n // half, FILTERS), np.float32), np.empty((n // half, FILTERS), np.int64) if where else None
        for s in range(0, n, BLOCK):
            e = min(s + BLOCK, n)
            act = p["byte"][0][data[s:e]]
            for j in range(1, WIDTH):
                act += p["byte"][j][data[s + j : e + j]]
            marked = np.flatnonzero(again[s : e + WIDTH])
            for j in range(WIDTH):
                rows = marked - j
                rows = rows[(rows >= 0) & (rows < e - s)]
                act[rows] += p["again"][j]
            act = act.reshape(-1, half, FILTERS)
            best[s // half : e // half] = act.max(axis=1)
            if where:
                at[s // half : e // half] = act.argmax(axis=1) + (np.arange(s, e, half))[:, None]
        best += p["bias"]
        return best, at

    def features(self, best: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean and maximum over a text's overlapping chunks. A chunk is two neighbouring half-chunks."""
        r = np.maximum(best, 0)
        last = np.r_[starts[1:], len(r)] - 1
        chunk = np.maximum(r, np.r_[r[1:], r[-1:]])
        chunk[last] = r[last]  # the last half-chunk of a text stands alone
        count = (last - starts + 1)[:, None]
        return np.add.reduceat(chunk, starts, axis=0) / count, np.maximum.reduceat(chunk, starts, axis=0), chunk

    def scores(self, texts: list[bytes]) -> np.ndarray:
        data, again, starts = lay_out(texts)
        best, _ = self.pooled(data, again)
        mean, top, _ = self.features(best, starts)
        z = np.hstack([mean, top]) @ self.p["out"] + self.p["shift"]
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def gradient(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        data, again, starts = lay_out(texts)
        best, at = self.pooled(data, again, where=True)
        mean, top, chunk = self.features(best, starts)
        x = np.hstack([mean, top])
        dz = (1 / (1 + np.exp(-(x @ self.p["out"] + self.p["shift"]))) - labels).astype(np.float32) / len(labels)
        dx = dz[:, None] * self.p["out"][None, :]
        sizes = np.diff(np.r_[starts, len(best)])
        owner = np.repeat(np.arange(len(starts)), sizes)
        d_chunk = (dx[:, :FILTERS] / sizes[:, None])[owner]
        is_top = chunk == top[owner]
        d_chunk += dx[:, FILTERS:][owner] * is_top / np.maximum(np.add.reduceat(is_top.astype(np.float32), starts, axis=0), 1)[owner]
        # A chunk's maximum stands in its own half or in the next one.
        r = np.maximum(best, 0)
        here = chunk == r
        d_best = np.where(here, d_chunk, 0)
        d_best[1:] += np.where(here, 0, d_chunk)[:-1]
        d_best *= best > 0
        g = {"out": x.T @ dz, "shift": dz.sum(keepdims=True), "bias": d_best.sum(0), "byte": np.zeros_like(self.p["byte"]), "again": np.zeros_like(self.p["again"])}
        f = np.broadcast_to(np.arange(FILTERS), at.shape)
        for j in range(WIDTH):
            np.add.at(g["byte"][j], (data[at + j], f), d_best)
            g["again"][j] = (again[at + j] * d_best).sum(0)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, seen: int = SEEN, batch: int = 32, rate: float = 0.01, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        epochs = -(-seen // len(texts))
        step, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for s in range(0, len(order), batch):
                pick = order[s : s + batch]
                step += 1
                for k, g in self.gradient([texts[i] for i in pick], labels[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.98 * v[k] + 0.02 * g * g
                    now = rate * (1 - 0.9 * step / total)
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-7)).astype(np.float32)


def fold(column: str = "doc_id", folds: int = FOLDS):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, rows: int, most_bytes: int) -> pd.DataFrame:
    """Texts and labels of at most ``rows`` training rows. The ids are drawn from the labels alone, so
    only a bounded table is joined with the texts."""
    drawn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(train & F.col("label").isin(0, 1)).dropDuplicates(["doc_id"])
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= most_bytes)
    return texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id", ignore_index=True)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    drawn = labelled_sample(docs, labels, "quality", fold() != 0, sample, SAMPLE_BYTES)
    if not len(drawn):
        return None
    network = Network()
    network.fit([t.encode("utf-8", "surrogatepass") for t in drawn["text"]], drawn["label"].to_numpy(dtype=np.float32))
    return network


def probability_column(network: Network | None) -> Column:
    """The score of column text."""

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, group, held = [], [], 0
            for t in texts:
                group.append((t or "").encode("utf-8", "surrogatepass"))
                held += len(group[-1])
                if held > 4 * BLOCK:
                    out.append(network.scores(group))
                    group, held = [], 0
            if group:
                out.append(network.scores(group))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return F.lit(0.5) if network is None else probability(F.col("text"))


def good(docs: DataFrame, network: Network | None) -> DataFrame:
    """The rows that the network takes; no column is added."""
    return docs.where(probability_column(network) >= THRESHOLD)


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """Adds score and predicted to ``docs``."""
    scored = docs.withColumn("score", probability_column(network))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    network = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, network).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
