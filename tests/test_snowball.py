"""Snowball trees against a plain version."""

import random

from biblark.functions import text as T
from biblark.operators import snowball


def plain(works, ties, seed, depth, most):
    best = lambda ids: sorted((i for i in ids if i in works), key=lambda i: (-(works[i] or 0), i))[:most]
    seen, rows, frontier = {seed}, [(seed, 0, 1, seed, None, None)], [seed]
    for hop in range(1, depth + 1):
        new = []
        for work in frontier:
            for direction, ids in ((snowball.REFERENCE, {b for a, b in ties if a == work}), (snowball.CITING, {a for a, b in ties if b == work})):
                for i in best(ids - {work}):
                    if i not in seen:
                        seen.add(i)
                        new.append(i)
                        rows.append((seed, hop, len(new), i, work, direction))
        frontier = new
    return rows


def test_trees(spark):
    rng = random.Random(1)
    works = {i: rng.choice([None, 0, 1, 5, 9]) for i in range(80)}
    ties = {(rng.randrange(90), rng.randrange(90)) for _ in range(220)} | {(i, 3) for i in range(40)}
    w = spark.createDataFrame([*works.items(), (None, 99)], "id long, citations long")
    c = spark.createDataFrame([*ties, *list(ties)[:20], (None, 1), (1, None)], "a long, b long")
    seeds = [0, 3, 50, 200]
    got = [tuple(r) for r in snowball.snowball(w, c, spark.createDataFrame([(s,) for s in [*seeds, 3, None]], "id long"), 3, 2).collect()]
    assert sorted(got, key=repr) == sorted((r for s in seeds for r in plain(works, ties, s, 3, 2)), key=repr)


def test_a_subtree_is_left_out(spark):
    rows = [(1, 0, 1, 1, None, None), (1, 1, 1, 2, 1, "reference"), (1, 1, 2, 3, 1, "citing"), (1, 2, 1, 4, 2, "citing"), (1, 3, 1, 5, 4, "citing"), (1, 2, 2, 6, 3, "citing"), (9, 1, 1, 2, 9, "citing")]
    tree = spark.createDataFrame(rows, snowball.TREE)
    left = snowball.without_subtrees(tree, spark.createDataFrame([(1, 2)], "seed long, id long")).collect()
    assert {(r["seed"], r["id"]) for r in left} == {(1, 1), (1, 3), (1, 6), (9, 2)}


def test_titles_by_the_strict_rule(spark):
    works = [(1, "Robust estimation of hidden Markov chains"), (2, "Robust estimation of hidden Markov chains revisited"), (3, "A study"), (4, None), (5, "robust hidden markov chains: estimation")]
    titles = [("a", "ROBUST Estimation of hidden markov-chains"), ("b", "A Study!"), ("c", "Study"), ("d", None), ("e", "Robust estimation of hidden")]
    got = snowball.seeds_by_title(spark.createDataFrame(titles, "name string, title string"), spark.createDataFrame(works, "id long, title string")).collect()
    assert {tuple(r) for r in got} == {("a", 1), ("b", 3)}
    pairs = spark.createDataFrame([(n, t, i, w) for n, t in titles for i, w in works], "name string, title string, id long, other string")
    F = T.F
    alike = pairs.where(T.titles_match(F.col("title"), F.col("other"))).groupBy("name").agg(F.min("id")).collect()
    assert {tuple(r) for r in alike} == {tuple(r) for r in got}
