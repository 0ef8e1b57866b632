"""One document of each group of near copies: SimHash candidates, verified by their shingles.

Two texts are linked if the sets of their shingles of ``SHINGLE`` words have a
Jaccard similarity of ``SIMILAR`` or more. Candidates are texts whose 128-bit
SimHash fingerprints come within ``RADIUS`` bits and agree on all bits of one
of ``MASKS`` masks of ``BITS`` bits; a fixed number of bits keeps the recall
the same at every size. Every link is then verified exactly, so the fingerprints
can miss a link but never make one.

Search in passes. First each text meets the nearest earlier candidate of each of
its buckets; the verified ones make components. Then the same again with the nearest
candidates of other components, earlier and later ones. A pair leaves the first bucket
that its texts share and no other. So the nearest candidate of all is among a text's
pairs, as it is the nearest in that bucket too, and no text with candidates is
left out, as the first bucket where it has any gives one out; but few of the up to
``MASKS`` buckets in which two texts meet make a row. Last, the texts that have any are compared once more, all against all
of other components, by SimHash fingerprints of ``WIDE`` bits: a similarity of
``SIMILAR`` comes further apart than the radius about once in 700 times. Of a
bucket only the texts of such pairs go on, each pair in the first bucket that its
texts share; they fetch their shingles and meet again by bucket, where pairs are
verified in the task. Only links that join two components leave it, fewer than the
bucket has texts: so no pass makes rows by the square of a group, whether its
members are similar or just below. Pairs with a text of more than ``LONG`` shingles
are verified outside, as a task could not hold a bucket of those. Texts whose numbers
of shingles rule out the similarity are no candidates. A bucket of more than ``TILE``
texts (``LAST_TILE`` in the last pass) is cut into tiles, and every pair of tiles is
compared on its own.

Defined results: texts without words are copies of each other; texts equal in
words, apart from the case of A-Z, are one node, named by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblark.llm.common import Scratch, connected_components, fresh

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 32
MASKS = 48
BITS = 10
SEED = 42
TILE = 32768
LAST_TILE = 4096
LONG = 2048
ROWS = 128
WIDE = 1024


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, shingle: int = SHINGLE) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def shingle_hashes(text: str | None) -> np.ndarray:
    """The set of shingles as sorted 64-bit hashes."""
    from xxhash import xxh3_64_intdigest

    return np.unique(np.array([xxh3_64_intdigest(g) for g in shingles(text)], dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WIDE`` bits as signed 64-bit words, from the hashes of the shingles."""
    out = np.zeros(WIDE // 64, dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(len(out)):
            x = hashes + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out[k] = np.packbits(2 * bits > len(hashes)).view(np.int64)[0]
    return out


def wide_radius(least: float) -> int:
    """Three standard deviations beyond the bits in which sets of that Jaccard similarity differ on average."""
    share = np.arccos(2 * least / (1 + least)) / np.pi
    return int(np.ceil(WIDE * share + 3 * np.sqrt(WIDE * share * (1 - share))))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> tuple[int, int, int, int]:
    """(node, f1, f2, size), signed: a hash of the words, the two halves of the fingerprint of the set of shingles, and its size."""
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    grams = list(shingles(text, shingle))
    total = np.zeros(128, dtype=np.int64)
    for k in range(0, len(grams), 16384):
        hashes = np.frombuffer(b"".join(xxh3_128_digest(g, seed) for g in grams[k : k + 16384]), dtype=np.uint8).reshape(-1, 16)
        total += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    f = np.packbits(2 * total > len(grams)).view(np.int64)
    return int(np.uint64(xxh3_64_intdigest(b" ".join(words_of(text)), seed)).view(np.int64)), int(f[0]), int(f[1]), len(grams)


def masks(count: int = MASKS, bits: int = BITS, seed: int = SEED) -> list[tuple[int, int]]:
    """Pairs of signed 64-bit masks, with ``bits`` of the 128 bits set in each pair."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        chosen = np.zeros(128, dtype=np.uint8)
        chosen[rng.choice(128, bits, replace=False)] = 1
        out.append(tuple(np.packbits(chosen).view(np.int64).tolist()))
    return out


@cache
def mask_words() -> np.ndarray:
    """The two halves of all masks."""
    return np.array(masks()).view(np.uint64).T


def close_enough(wide: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs of rows come within the radius, some at a time."""
    parts = [np.bitwise_count(wide[a[k : k + 65536]] ^ wide[b[k : k + 65536]]).sum(axis=1, dtype=np.int64) <= radius for k in range(0, len(a), 65536)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def owned(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs agree on no mask before that of this bucket."""
    out = np.ones(len(a), dtype=bool)
    m, n = mask_words()
    for k in range(0, len(a), 4096):
        c, d = a[k : k + 4096, None], b[k : k + 4096, None]
        agree = (((rows["f1"][c] ^ rows["f1"][d]) & m) | ((rows["f2"][c] ^ rows["f2"][d]) & n)) == 0
        out[k : k + 4096] = agree.argmax(axis=1) >= rows["nth"][c[:, 0]]
    return out


def pairs_in_bucket(rows: dict[str, np.ndarray], radius: int, least: float, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) within the radius, a before b in the order given, of different components if there is ``comp``: all
    whose wide fingerprints come close too, or the nearest a of each b, and with ``comp`` the nearest b of each a; of these those that this bucket owns. ``side``: 0 all against all, 1 against 2 where two tiles meet."""
    f1, f2, side, comp, set_size = (rows.get(c) for c in ("f1", "f2", "side", "comp", "set_size"))
    count, places = len(f1), np.arange(len(f1))
    low, best = np.full(count, 255, dtype=np.uint8), np.zeros(count, dtype=np.int64)
    found = []
    for i in range(0, count, ROWS):
        a = slice(i, i + ROWS)
        d = np.bitwise_count(f1[a, None] ^ f1[None, i:]) + np.bitwise_count(f2[a, None] ^ f2[None, i:])
        near = (d <= radius) & (places[a, None] < places[None, i:]) & ((side[a, None] == 0) | (side[a, None] != side[None, i:]))
        near &= (set_size[a, None] >= least * set_size[None, i:]) & (set_size[None, i:] >= least * set_size[a, None])
        if comp is not None:
            near &= comp[a, None] != comp[None, i:]
        if nearest:
            d = np.where(near, d, 255)
            first = d.argmin(axis=0)
            value = d[first, np.arange(d.shape[1])]
            better = np.flatnonzero(value < low[i:])
            low[i + better], best[i + better] = value[better], first[better] + i
            if comp is not None:
                last = d.argmin(axis=1)
                has = np.flatnonzero(d[np.arange(len(d)), last] < 255)
                found.append((has + i, last[has] + i))
        else:
            r, c = (x + i for x in np.nonzero(near))
            good = close_enough(rows["wide"], r, c, wide_radius(least))
            good[good] = owned(rows, r[good], c[good])
            found.append((r[good], c[good]))
    if not nearest:
        return tuple(np.concatenate(x) for x in zip(*found))
    b = np.flatnonzero(low < 255)
    found.append((best[b], b))
    a, b = divmod(np.unique(np.concatenate([x * count + y for x, y in found])), count)
    own = owned(rows, a, b)
    return a[own], b[own]


def joining_links(a: np.ndarray, b: np.ndarray, comp: np.ndarray, sets: list[np.ndarray | None], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sure) of the pairs of places, in order of a: similar ones, as far as they join two components; pairs of a
    text whose set is not at hand (None) stay, not sure."""
    comp = np.unique(comp, return_inverse=True)[1]
    here = np.array([x is not None for x in sets])
    known = here[a] & here[b]
    out = [(x, y, False) for x, y in zip(a[~known], b[~known])]
    a, b = a[known], b[known]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else []
    for s, e in zip(starts, np.r_[starts[1:], len(a)]):
        own = a[s]
        x = sets[own]
        for k in range(s, e, 256):
            others = b[k : min(k + 256, e)]
            others = others[comp[others] != comp[own]]
            if not len(others):
                continue
            sizes = np.array([len(sets[o]) for o in others])
            every = np.concatenate([sets[o] for o in others])
            hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
            both = np.bincount(np.repeat(np.arange(len(others)), sizes), hit, len(others))
            for o in others[both / (len(x) + sizes - both) >= least]:
                if comp[o] != comp[own]:
                    out.append((own, o, True))
                    comp[comp == comp[o]] = comp[own]
    return tuple(np.array([r[i] for r in out], dtype=t) for i, t in enumerate((np.int64, np.int64, bool)))


def whole_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, dict[str, np.ndarray]]]:
    """Buckets of more than one row, of batches in order of ``k``: as rows and as arrays."""
    held: list[pd.DataFrame] = []
    done = object()
    while True:
        batch = next(batches, done)
        if batch is not done:
            if not len(batch):
                continue
            key = batch["k"].to_numpy()
            cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
            if held and not cut and held[-1]["k"].iloc[-1] == key[0]:
                held.append(batch)  # one bucket over several batches
                continue
            held.append(batch.iloc[:cut])
        if held:
            rows = pd.concat(held, ignore_index=True)
            if len(rows):
                key = rows["k"].to_numpy()
                columns = {c: rows[c].to_numpy() for c in rows.columns if c not in ("k", "wide", "hashes")}
                columns |= {c: columns[c].view(np.uint64) for c in ("f1", "f2")}
                if "wide" in rows.columns:
                    columns["wide"] = np.stack(rows["wide"]).view(np.uint64)
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                for s, e in zip(starts, np.r_[starts[1:], len(key)]):
                    if e - s > 1:
                        yield rows.iloc[s:e], {c: v[s:e] for c, v in columns.items()}
        if batch is done:
            return
        held = [batch.iloc[cut:]]


def in_buckets(texts: DataFrame, tile: int) -> DataFrame:
    """``texts`` (node, f1, f2, ...) once a mask and tile that its bucket meets: with k, the bucket, nth, the mask, and side."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("f1").bitwiseAND(F.lit(m)), F.col("f2").bitwiseAND(F.lit(n))) for i, (m, n) in enumerate(masks())])
    keyed = texts.select("*", F.posexplode(keys).alias("nth", "v"))
    # Large buckets are at most as many as rows by the tile size, and as masks by 2 ** BITS.
    large = keyed.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("v", F.ceil(F.col("n") / tile).alias("tiles"))
    tiled = keyed.join(large, "v", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), "tiles")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte")
    return tiled.select(F.xxhash64("v", F.least("own", "other"), F.greatest("own", "other")).alias("k"), F.col("nth").cast("byte").alias("nth"), side.alias("side"), *texts.columns)


def met(rows: DataFrame) -> DataFrame:
    return rows.repartition("k").sortWithinPartitions("k", "node")


def candidates(texts: DataFrame, radius: int = RADIUS, least: float = SIMILAR, tile: int = TILE) -> DataFrame:
    """(a, b), the nearest ones, each from one bucket, from ``texts`` (node, f1, f2, set_size and, in the second pass, comp)."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in whole_buckets(batches):
            a, b = pairs_in_bucket(rows, radius, least, True)
            if len(a):
                yield pd.DataFrame({"a": rows["node"][a], "b": rows["node"][b]})

    return met(in_buckets(texts, tile)).mapInPandas(compare, "a long, b long")


def with_pairs(texts: DataFrame, radius: int = RADIUS, least: float = SIMILAR, tile: int = LAST_TILE) -> DataFrame:
    """The rows of ``in_buckets`` that are part of a pair: ``texts`` has comp and wide besides."""
    rows = in_buckets(texts, tile)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, columns in whole_buckets(batches):
            used = np.unique(np.concatenate(pairs_in_bucket(columns, radius, least, False)))
            if len(used):
                yield part.iloc[used]

    return met(rows).mapInPandas(compare, rows.schema)


def last_links(rows: DataFrame, sets: DataFrame, radius: int = RADIUS, least: float = SIMILAR) -> DataFrame:
    """(a, b, sure) from the rows of ``with_pairs``: verified links between components, and pairs of long texts."""
    short = sets.where(F.octet_length("hashes") <= 8 * LONG).select("node", "hashes")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, columns in whole_buckets(batches):
            hashes = [None if h is None else np.frombuffer(h, np.uint64) for h in part["hashes"]]
            a, b, sure = joining_links(*pairs_in_bucket(columns, radius, least, False), columns["comp"], hashes, least)
            if len(a):
                yield pd.DataFrame({"a": columns["node"][a], "b": columns["node"][b], "sure": sure})

    return met(rows.join(short, "node", "left")).mapInPandas(compare, "a long, b long, sure boolean")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingles are similar; ``sets`` has node, its shingle hashes as bytes and the wide fingerprint."""

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(a, b)], dtype=bool)

    def beside(df: DataFrame, column: str) -> DataFrame:
        for c in ("a", "b"):
            df = df.join(sets.select(F.col("node").alias(c), F.col(column).alias(f"_{c}")), c)
        return df

    apart = reduce(lambda x, y: x + y, (F.bit_count(F.get("_a", F.lit(k)).bitwiseXOR(F.get("_b", F.lit(k)))) for k in range(WIDE // 64)))
    close = beside(pairs, "wide").where(apart <= wide_radius(least)).select("a", "b")
    return beside(close, "hashes").where(similar("_a", "_b")).select("a", "b")


def near_copies(spark: SparkSession, docs: DataFrame, least: float = SIMILAR, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(node, doc_id, text_hash, root) per row of ``docs`` (doc_id, text, text_hash); root names the group."""
    scratch = Scratch(spark, "near-copies")

    @F.pandas_udf("node long, f1 long, f2 long, set_size long")
    def marked(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fingerprint(t) for t in texts], columns=["node", "f1", "f2", "set_size"], dtype=np.int64)

    @F.pandas_udf("hashes binary, wide array<long>")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_hashes(t) for t in texts]
        return pd.DataFrame({"hashes": [h.tobytes() for h in sets], "wide": [wide_fingerprint(h) for h in sets]})

    marks = scratch.keep(docs.select("doc_id", "text_hash", marked("text").alias("m")).select("doc_id", "text_hash", "m.*"), "marks")
    nodes = scratch.keep(marks.groupBy("node").agg(F.min("f1").alias("f1"), F.min("f2").alias("f2"), F.min("set_size").alias("set_size"), F.min(F.struct("doc_id", "text_hash")).alias("of")), "nodes")

    def sets_of(pairs: DataFrame) -> DataFrame:
        """(node, hashes, wide) of the nodes in ``pairs``: from the text of one row of each."""
        needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        one = nodes.join(needed, "node").select("node", F.col("of.doc_id").alias("_i"), F.col("of.text_hash").alias("_h"))
        same = F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_h"))
        return docs.join(one, same).select("node", "text").dropDuplicates(["node"]).select("node", hashed("text").alias("h")).select("node", "h.*")

    fps = nodes.select("node", "f1", "f2", "set_size")
    links: list[DataFrame] = []

    def with_components(fps: DataFrame, links: list[DataFrame]) -> DataFrame:
        roots = connected_components(reduce(DataFrame.unionByName, links), scratch)
        return fps.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")

    for step in ("nearest", "other-nearest"):
        if links:
            fps = with_components(fps, links)
        pairs = scratch.keep(candidates(fps, radius, least, tile), f"{step}-pairs")
        sets = scratch.keep(sets_of(pairs), f"{step}-sets")
        links.append(scratch.keep(verified(pairs, sets, least), f"{step}-links"))
        scratch.drop(pairs)
    # Whoever has a candidate in another component had one in the pass before.
    fps = with_components(fps.drop("comp"), links).join(sets.select("node", "wide"), "node")
    rows = scratch.keep(with_pairs(fps, radius, least, min(tile, LAST_TILE)), "last-rows")
    found = scratch.keep(last_links(rows, sets, radius, least), "last-found")
    links += [found.where("sure").select("a", "b"), verified(found.where("not sure").select("a", "b"), sets, least)]
    roots = connected_components(reduce(DataFrame.unionByName, links), scratch)
    return marks.join(roots, "node", "left").select("node", "doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def one_of_each(spark: SparkSession, docs: DataFrame, least: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest doc_id, of equal ids that of the
    least text hash, of equal rows any one."""
    h, i, j = (fresh(docs, n) for n in ("_text_hash", "_first_id", "_first_hash"))
    hashed = docs.withColumn(h, F.xxhash64("text"))
    found = near_copies(spark, hashed.select("doc_id", "text", F.col(h).alias("text_hash")), least, radius)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("m"))
    first = first.select(F.col("m.doc_id").alias(i), F.col("m.text_hash").alias(j)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(j))
    return hashed.join(first, same, "left_semi").dropDuplicates(["doc_id", h]).select(*docs.columns)
