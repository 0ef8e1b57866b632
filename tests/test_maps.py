import math
import random

import pytest
from pyspark.sql import functions as F

from biblark.operators import catalog, maps, notes, vectors


def test_labels_of_communities(spark):
    communities = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (3, 0), (4, 1), (5, -1)], "id long, community int")
    titles = spark.createDataFrame([(1, "Galaxy clusters"), (2, "Galaxy and Stars"), (3, "Ünder galaxy"), (4, "The of"), (5, "stars"), (6, None)], "id long, title string")
    got = {r["community"]: (r["size"], r["label"]) for r in maps.labels(communities, titles, 2).collect()}
    assert got == {0: (3, "galaxy, clusters"), 1: (1, "")}
    assert maps.labels(communities.limit(0), titles).count() == 0


def test_halos(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 0.0), (3, 1.0, 3.0), (4, 9.0, 9.0), (5, 5.0, 5.0)], "id long, x double, y double")
    communities = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, -1)], "id long, community int")
    assert [tuple(r) for r in maps.halos(places, communities).collect()] == [(0, 3, 1.0, 1.0, 2.0)]


def test_communities_equal_plain_version(spark):
    rng = random.Random(5)
    weights = {}
    for _ in range(90):
        a, b = sorted(rng.sample(range(40), 2))
        weights[a, b] = rng.choice([0.5, 0.6, 0.7, 0.8])
    beside = {}
    for (a, b), w in weights.items():
        beside.setdefault(a, []).append((b, w))
        beside.setdefault(b, []).append((a, w))
    label = {i: i for i in beside}
    for _ in range(20):
        new = {}
        for i, others in beside.items():
            votes = {}
            for j, w in others:
                votes[label[j]] = votes.get(label[j], 0) + w
            new[i] = min(votes, key=lambda v: (-round(votes[v], 6), v))
        label, settled = new, new == label
        if settled:
            break
    groups = {}
    for i, v in label.items():
        groups.setdefault(v, []).append(i)
    large = sorted((g for g in groups.values() if len(g) >= 3), key=lambda g: (-len(g), min(g)))
    expected = {i: next((k for k, g in enumerate(large) if i in g), -1) for i in label}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "a long, b long, weight double")
    assert {r["id"]: r["community"] for r in vectors.communities(edges).collect()} == expected


def test_plane_scales_and_separates(spark):
    rng = random.Random(3)
    rows = [(i, [(10.0 if i < 10 else -10.0) + rng.random(), rng.random(), rng.random()]) for i in range(20)]
    vecs = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: (r["x"], r["y"]) for r in vectors.principal_plane(vecs, "id", "v").collect()}
    left, right = [got[i][0] for i in range(10)], [got[i][0] for i in range(10, 20)]
    assert max(left) < min(right) or max(right) < min(left)
    assert math.isclose(max(abs(c) for p in got.values() for c in p), 1.0)
    assert {(r["x"], r["y"]) for r in vectors.principal_plane(vecs.limit(2), "id", "v").collect()} == {(0.0, 0.0)}


def test_starts(spark):
    schema = "id long, kind string, degree long, sx double, sy double, px double, py double"
    rows = [(1, "doc", 1, 5.0, 6.0, 0.3, 0.3), (2, "doc", 1, None, None, 0.5, -0.5), (3, "doc", 2, None, None, None, None), (4, "doc", 0, None, None, 0.0, 0.0), (-7, "note", 1, None, None, 0.0, 0.0), (-8, "note", 0, None, None, 0.0, 0.0), (-9, "note", 1, 1.0, 2.0, 0.0, 0.0)]
    edges = spark.createDataFrame([(-7, 1, 0.9), (3, -7, 0.5), (-7, -8, 1.0), (-9, 3, 0.5)], "a long, b long, weight double")
    got = {r["id"]: (r["how"], r["x"], r["y"]) for r in maps.starts(spark.createDataFrame(rows, schema), edges).collect()}
    assert got[1] == ("saved", 5.0, 6.0) and got[-9] == ("saved", 1.0, 2.0)
    assert got[2][0] == "plane" and got[2][1:] == pytest.approx((0.5 * 180 * 2.2 - 4 * 2.2, -0.5 * 180 * 2.2 - 2.2))
    assert got[3][0] == "spiral" and got[3][1:] == pytest.approx((180 * math.sqrt(0.5 / 5), 0))
    assert got[4][0] == "ring" and got[4][1:] == pytest.approx((310 * math.cos(0.4), 310 * math.sin(0.4)))
    # Its strongest edge leads to a note that has no place yet, so it stands on the outer ring.
    assert got[-7][0] == "note" and got[-7][1:] == pytest.approx((350 * math.cos(7 / 97 * 2 * math.pi), 350 * math.sin(7 / 97 * 2 * math.pi)), abs=1e-5)
    near = {r["id"]: (r["x"], r["y"]) for r in maps.starts(spark.createDataFrame(rows, schema), edges.where("b <> -8")).collect()}
    assert near[-7] == pytest.approx((5 + 46 * math.cos(math.radians(67)), 6 + 46 * math.sin(math.radians(67))), abs=1e-5)


def test_suggestions_by_name_and_content(spark):
    held = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [-1.0, 0.0]), (6, None), (7, [1.0])], "id long, v array<double>")
    members = spark.createDataFrame([(10, 1), (10, 1), (20, 2)], "group long, id long")
    content = vectors.centroids(members.distinct().join(held, "id").select("group", "v"), "group", "v")
    postings = spark.createDataFrame([(2, "star"), (2, "dust"), (3, "star"), (1, "dust")], "id long, term string")
    names = spark.createDataFrame([(10, "Star dust"), (20, "nowhere"), (30, "star"), (40, "")], "group long, name string")
    by_name = vectors.name_vectors(postings, names, held)
    assert {r["group"]: r["centroid"] for r in by_name.collect()} == {10: [0.0, 2.0], 30: [0.5, 1.5]}
    rows = lambda df: sorted(map(tuple, df.collect()))
    half = round(math.sqrt(0.5), 6)
    assert rows(vectors.suggested(held, members, vectors.mixed(content, None), 2)) == [(10, 2, 0.0), (10, 3, half), (20, 1, 0.0), (20, 3, half)]
    both = vectors.suggested(held, members, vectors.mixed(content, by_name, 0.25), 3, only_unfiled=True)
    assert rows(both) == [(10, 3, half), (10, 5, 0.0)]
    assert rows(vectors.suggested(held, members, vectors.mixed(content, by_name, 0.25), 9)) == [(10, 2, 0.75), (10, 3, half), (10, 5, 0.0)]


def test_meaning_filter_needs_three_members(spark):
    held = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)] + [(9, [0.0, 1.0])], "id long, v array<double>")
    members = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 1), (2, 77)], "group long, id long")
    hits = spark.createDataFrame([(1, "near", [1.0, 0.1]), (1, "far", [0.0, 1.0]), (1, "none", None), (2, "far", [0.0, 1.0]), (3, "any", None)], "group long, name string, v array<double>")
    assert sorted((r["group"], r["name"]) for r in vectors.by_meaning(hits, members, held, 0.5).collect()) == [(1, "near"), (2, "far"), (3, "any")]


def test_weighted_pick_follows_weights(spark):
    docs = spark.createDataFrame([(1, "a", True, 5, False), (2, "b", False, None, True)], "id long, title string, is_read boolean, last_page int, favorite boolean")
    picks = [catalog.weighted_pick(docs, seed).first()["id"] for seed in range(60)]
    assert picks == [catalog.weighted_pick(docs, seed).first()["id"] for seed in range(3)] + picks[3:]
    assert 40 <= picks.count(2) <= 58  # five times the weight
    assert catalog.weighted_pick(docs.limit(0), 1).count() == 0


def test_notes_in_order_and_json(spark):
    rows = [(1, "beta", 5, 1), (2, "Álpha", 5, None), (3, "alpha", 9, 7), (4, "gamma", None, 7)]
    df = spark.createDataFrame(rows, "id long, title string, created_at long, updated_at long")
    ids = lambda by: [r["id"] for r in notes.sorted_notes(df, by).collect()]
    assert (ids("title"), ids("created"), ids("updated")) == ([2, 3, 1, 4], [3, 2, 1, 4], [3, 4, 1, 2])
    with pytest.raises(ValueError):
        notes.sorted_notes(df, "size")
    tricky = spark.createDataFrame([('a" : b\n"c" : 1',)], "s string").select(catalog.pretty_json(F.struct("s", F.lit(None).cast("int").alias("n"), F.array(F.lit(1), F.lit(2)).alias("l"))).alias("j")).first()["j"]
    assert tricky.startswith('{\n  "s": "a\\" : b\\n\\"c\\" : 1",\n  "n": null,\n  "l": [')
