"""Null and very large ids, clashing columns, ties, empty tables, and brute force where the main tests have little."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from biblark.llm import decontaminate, html_text, near_copies, packing, pii, quality, simhash, toxicity, vectors, warc
from biblark.llm.decontaminate import least_seeds, prefix_hashes, run_hashes, tile
from tests.llm.test_operators import documents

BIG = 9_007_199_254_740_993  # not a float64
TEXT = "mail joe@example.org about the long plan that we made together last week in town"


def test_ids_beside_nulls_stay_exact(spark, tmp_path):
    docs = spark.createDataFrame([(BIG, TEXT), (None, TEXT), (BIG + 1, None), (BIG + 1, None)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(BIG, TEXT), (None, "other words that never occur in any of these texts")], "item_id long, text string").coalesce(1)
    pages = docs.selectExpr("doc_id page_id", "'http://a/' url", "text html")
    warc.write_arc(pages, f"file://{tmp_path}/arc")
    warc.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ids = lambda df, c="doc_id": sorted((r[c] for r in df.collect()), key=lambda v: v or 0)
    want = [None, BIG, BIG + 1, BIG + 1]
    assert ids(packing.pack_documents(spark, docs)) == want
    assert ids(pii.find_personal_data(spark, docs)) == want
    assert ids(quality.score(docs, quality.train(docs, none))) == want
    assert ids(simhash.near_duplicates(spark, docs)) == want
    assert ids(toxicity.score(docs, toxicity.train(docs, none))) == want
    assert ids(decontaminate.contaminated(spark, docs, items)) == [None, BIG]
    assert ids(decontaminate.contaminated(spark, docs, items), "item_id") == [BIG, BIG]
    assert ids(warc.read_warc_files(spark, f"file://{tmp_path}/warc"), "page_id") == want
    assert ids(html_text.extract(spark, pages), "page_id") == want
    assert ids(near_copies.one_of_each(spark, docs)) == [BIG, BIG + 1]


def test_vector_ids_beside_nulls(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=16).tolist(), rng.normal(size=16).tolist()
    near = (np.array(a) * 1.01).tolist()
    rows = [(BIG, a), (None, near), (BIG + 2, near), (None, b), (BIG + 4, None)]
    got = vectors.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("k1", F.lit(2))).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] or r["n_links"]) == [(0, 2, BIG, False), (BIG, 2, BIG, True), (BIG + 2, 2, BIG, False), (BIG + 4, 0, BIG + 4, True)]
    assert [(r["component_id"], r["kept"]) for r in got if not r["vec_id"] and not r["n_links"]] == [(None, True)]


def planted(kind, rng, base):
    """Neighbours of cosine 0.90 to 0.95, noise in all directions or in one half of the vector only."""
    noise = rng.normal(size=base.shape)
    half = base.shape[1] // 2
    if kind == "first":
        noise[:, half:] = 0
    if kind == "second":
        noise[:, :half] = 0
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = rng.uniform(0.9005, 0.95, size=(len(base), 1))
    near = c * base + np.sqrt(1 - c * c) * noise
    return near / np.linalg.norm(near, axis=1, keepdims=True)


def test_recall_on_a_hundred_cells(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(26_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kinds = {k: planted(k, rng, x[i * 500 : i * 500 + 500]) for i, k in enumerate(("all", "first", "second"))}
    full = np.vstack([x, *kinds.values()])
    index = vectors.MultiIndex(full[rng.choice(len(full), vectors.SAMPLE, replace=False)], len(full), vectors.THRESHOLD, vectors.RECALL)
    assert index.k**2 >= 100 and index.visits < index.k**2
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(full.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(spark, rows).where("n_links > 0").collect()}
    want = np.zeros(len(full), int)
    for i in range(0, len(full), 1000):
        want[i : i + 1000] = (full[i : i + 1000] @ full.T >= 0.9).sum(1) - 1
    assert want.sum() >= 3000 and sum(got.values()) >= 0.97 * want.sum()
    assert all(n <= want[i] for i, n in got.items())
    for i, k in enumerate(kinds):
        pairs = [(26_000 + i * 500 + j) in got for j in range(500)]
        print(k, np.mean(pairs))
        assert np.mean(pairs) >= 0.95, k


@pytest.mark.parametrize("size", [3, 8])
def test_vector_tiles_lose_no_link(spark, monkeypatch, size):
    monkeypatch.setattr(vectors, "TILE", size)
    rng = np.random.default_rng(4)
    x = [(c + rng.normal(scale=0.2, size=16)).tolist() for c in rng.normal(size=(4, 16)) for _ in range(12)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark, spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    assert [got[i]["n_links"] for i in range(len(x))] == ((u @ u.T >= 0.9).sum(1) - 1).tolist()


# ---- tiling


def plain_tile(doc, item, least):
    """Greedy string tiling by its definition."""
    free_d, free_i = [True] * len(doc), [True] * len(item)
    while True:
        best = 0
        for p in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while p + n < len(doc) and j + n < len(item) and free_d[p + n] and free_i[j + n] and doc[p + n] == item[j + n]:
                    n += 1
                best = max(best, n)
        if best < least:
            return [not f for f in free_i]
        for p in range(len(doc) - best + 1):
            for j in range(len(item) - best + 1):
                if all(free_d[p : p + best]) and all(free_i[j : j + best]) and doc[p : p + best] == item[j : j + best]:
                    free_d[p : p + best] = [False] * best
                    free_i[j : j + best] = [False] * best


def test_tiling_by_brute_force():
    rng = np.random.default_rng(5)
    for case in range(120):
        symbols = 2 + case % 5
        doc, item = (rng.integers(1, 1 + symbols, rng.integers(1, 24)) for _ in range(2))
        least = int(rng.integers(1, 5))
        got = tile(doc.astype(np.uint64), item.astype(np.uint64), least)
        assert got.tolist() == plain_tile(doc.tolist(), item.tolist(), least)


def test_run_hashes_agree_with_the_seed_hashes():
    ids = np.random.default_rng(6).integers(0, 1 << 63, 50, dtype=np.uint64)
    ids[30:40] = ids[10:20]
    for n in (1, 5, 10, 50):
        h = run_hashes(prefix_hashes(ids), n)
        assert len(h) == 51 - n and (n == 50 or h[10] == h[30] if n <= 10 else True)


def test_equal_tokens_take_no_quadratic_memory_or_time():
    began = time.perf_counter()
    assert tile(np.ones(200_000, np.uint64), np.ones(300, np.uint64), 5).all()
    assert time.perf_counter() - began < 5


def test_common_phrases_make_no_candidates_and_lose_none(spark):
    """Every item and every document holds the same phrase; contaminated ones are found all the same."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    phrase = [word() for _ in range(7)]
    items = [[*phrase, *(word() for _ in range(43))] for _ in range(12)]
    texts = [" ".join([*(word() for _ in range(30)), *phrase, *(word() for _ in range(30))]) for _ in range(60)]
    for k in (0, 5):  # 60 % of an item in runs of five tokens, which share one seed each
        runs = [items[k][i : i + 5] for i in range(0, 50, 5)]
        texts.append(" ".join(" ".join([*r, word()]) for r in (runs[j] for j in (8, 3, 6, 1, 7, 5))))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark, documents(spark, texts), table).collect())
    assert got == [(60, 0), (61, 5)]
    assert least_seeds(50, 5, 0.6) == 6 and least_seeds(3, 5, 0.6) == 1
