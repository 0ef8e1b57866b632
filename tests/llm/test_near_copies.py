"""The pipeline's near-copy stage against brute force over all pairs."""

import numpy as np
from pyspark.sql import functions as F

from biblark.llm import near_copies
from tests.llm.test_operators import ODD, documents


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similarity(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def edited_texts(groups=60):
    """Texts of 60 to 300 words and copies with 1 to 6 words changed: similarities on both sides of 0.8."""
    rng = np.random.default_rng(8)
    out = []
    for _ in range(groups):
        words = [f"w{i}" for i in rng.integers(0, 5000, rng.integers(60, 300))]
        out.append(" ".join(words))
        for changes in range(1, 7):
            copy = list(words)
            for at in rng.choice(len(words), changes, replace=False):
                copy[at] = f"x{rng.integers(0, 5000)}"
            out.append(" ".join(copy))
    return out


def roots_by_brute_force(texts):
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    pairs = [(j, i) for i in range(len(texts)) for j in range(i) if plain_similarity(sets[i], sets[j]) >= 0.8]
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(len(texts))], pairs


def test_stage_by_brute_force(spark):
    import corpus_pipeline

    texts = [*ODD[:7], *edited_texts(), "A B c", "a b C", "a b d"]
    roots, pairs = roots_by_brute_force(texts)
    docs = documents(spark, texts)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(roots)
    prints = [near_copies.fingerprint(t) for t in texts]
    apart = [sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(prints[a][1:3], prints[b][1:3])) for a, b in pairs]
    wide = [near_copies.wide_fingerprint(near_copies.shingle_hashes(t)) for t in texts]
    assert np.mean([int(np.bitwise_count((wide[a] ^ wide[b]).view(np.uint64)).sum()) <= near_copies.wide_radius(0.8) for a, b in pairs]) >= 0.99
    assert len(pairs) > 300 and np.mean(np.array(apart) <= near_copies.RADIUS) >= 0.99


def test_tiles_change_nothing(spark):
    texts = edited_texts(20)
    docs = documents(spark, texts).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    groups = {}
    for r in near_copies.near_copies(spark, docs, tile=5).collect():
        groups.setdefault(r["root"], set()).add(r["doc_id"])
    want = {}
    for i, r in enumerate(roots_by_brute_force(texts)[0]):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_empty(spark):
    docs = documents(spark, []).limit(0)
    assert near_copies.one_of_each(spark, docs).count() == 0


def test_a_group_of_unlike_texts_makes_few_pairs(spark):
    """Texts that share two thirds of their words with each other but no link: nothing is joined that isn't similar."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for at in rng.choice(150, 12, replace=False):
            copy[at] = f"x{rng.integers(0, 5000)}"
        texts.append(" ".join(copy))
    docs = documents(spark, texts).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    roots, _ = roots_by_brute_force(texts)
    assert near_copies.near_copies(spark, docs).select("root").distinct().count() == len(set(roots))


def test_joining_links_by_brute_force():
    """Links from all pairs connect what all similar pairs connect, one link fewer than texts; unknown sets stay open."""
    sets = [near_copies.shingle_hashes(t) for t in edited_texts(12)]
    a, b = np.triu_indices(len(sets), 1)
    similar = [(x, y) for x, y in zip(a, b) if near_copies.similarity(sets[x], sets[y]) >= 0.8]

    def groups(pairs):
        root = list(range(len(sets)))
        for x, y in pairs:
            root = [root[x] if r == root[y] else r for r in root]
        return len(set(root)), {(i, j) for i in range(len(sets)) for j in range(i) if root[i] == root[j]}

    x, y, sure = near_copies.joining_links(a, b, np.arange(len(sets)), sets, 0.8)
    assert sure.all() and set(zip(x, y)) <= set(similar)
    assert groups(zip(x, y)) == groups(similar) and len(x) == len(sets) - groups(similar)[0]
    open_ = [None if i % 5 == 0 else s for i, s in enumerate(sets)]
    x, y, sure = near_copies.joining_links(a, b, np.arange(len(sets)), open_, 0.8)
    assert set(zip(x[~sure], y[~sure])) == {(i, j) for i, j in zip(a, b) if i % 5 == 0 or j % 5 == 0}
    assert not len(near_copies.joining_links(a[:0], b[:0], np.arange(len(sets)), sets, 0.8)[0])


def test_the_last_pass_alone(spark, monkeypatch):
    """All against all finds the groups by itself, in tiles of any size, for texts that fetch their shingles and for long ones."""
    texts = edited_texts(20)
    want = {}
    for i, r in enumerate(roots_by_brute_force(texts)[0]):
        want.setdefault(r, set()).add(i)
    rows = [(int(n), int(f1), int(f2), k, int(n)) for n, f1, f2, k in map(near_copies.fingerprint, texts)]
    wide = spark.createDataFrame([(r[0], h.tobytes(), near_copies.wide_fingerprint(h).tolist()) for r, h in zip(rows, map(near_copies.shingle_hashes, texts))], "node long, hashes binary, wide array<long>")
    fps = spark.createDataFrame(rows, "node long, f1 long, f2 long, set_size long, comp long").join(wide.select("node", "wide"), "node")
    place = {r[0]: i for i, r in enumerate(rows)}
    for long, tile in ((0, 4096), (120, 7), (10**6, 7)):
        monkeypatch.setattr(near_copies, "LONG", long)
        found = near_copies.last_links(near_copies.with_pairs(fps, tile=tile), wide)
        links = found.where("sure").select("a", "b").unionByName(near_copies.verified(found.where("not sure").select("a", "b"), wide, 0.8))
        root = list(range(len(texts)))
        for r in links.collect():
            x, y = sorted((root[place[r["a"]]], root[place[r["b"]]]))
            root = [x if z == y else z for z in root]
        groups = {}
        for i, r in enumerate(root):
            groups.setdefault(r, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_nearest_pairs_leave_one_bucket_each(spark):
    """No pair is given out twice, no text with a candidate is left out, and the nearest candidate of all is given out."""
    texts = edited_texts(30)
    prints = np.unique(np.array([near_copies.fingerprint(t) for t in texts], dtype=np.int64), axis=0)
    node, f1, f2, size = prints.T
    bits = np.unpackbits(prints[:, 1:3].copy().view(np.uint8), axis=1).astype(int)
    apart = (bits[:, None] != bits[None]).sum(axis=2)
    near = (apart <= near_copies.RADIUS) & (size[:, None] >= 0.8 * size) & (size >= 0.8 * size[:, None]) & ~np.eye(len(node), dtype=bool)
    shared = np.any([((f1[:, None] ^ f1) & m | (f2[:, None] ^ f2) & n) == 0 for m, n in near_copies.masks()], axis=0)
    near &= shared
    for comp in (None, np.arange(len(node))):
        given = []
        for nth, (m, n) in enumerate(near_copies.masks()):
            for key in {(x, y) for x, y in zip(f1 & m, f2 & n)}:
                at = np.flatnonzero((f1 & m == key[0]) & (f2 & n == key[1]))
                rows = {"f1": f1[at].view(np.uint64), "f2": f2[at].view(np.uint64), "side": np.zeros(len(at), np.int8), "set_size": size[at], "nth": np.full(len(at), nth, np.int8)}
                rows |= {} if comp is None else {"comp": comp[at]}
                a, b = near_copies.pairs_in_bucket(rows, near_copies.RADIUS, 0.8, True)
                given += zip(at[a].tolist(), at[b].tolist())
        assert len(given) == len(set(given)) and all(near[a, b] and a < b for a, b in given)
        for b in range(len(node)):
            earlier = np.flatnonzero(near[:b, b])
            if len(earlier):
                assert (earlier[apart[earlier, b].argmin()], b) in given
        if comp is not None:
            assert {x for pair in given for x in pair} == set(np.flatnonzero(near.any(axis=0)).tolist())
    rows = spark.createDataFrame([tuple(map(int, r)) for r in prints], "node long, f1 long, f2 long, set_size long")
    pairs = near_copies.candidates(rows)
    assert 0 < pairs.count() == pairs.distinct().count() < 6 * len(node)
