"""The Merkle manifest against a plain version."""

import hashlib
import zlib
from collections import Counter

import pytest

from biblark.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g string, more string, r int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text=...):
    values = [*row[:4], row[4] if text is ... else text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        a = i // 8 * 8
        yield "".join(level[a:i]), "".join(level[i + 1 : a + 8])
        i //= 8


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda lang: (lang is not None, (lang or "").encode()))
    own = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs}
    trees = {lang: tree([leaf(r) for r in own[lang]]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    root = (top[-1] or [None])[0]
    for j, lang in enumerate(langs):
        for i, r in enumerate(own[lang]):
            way = [*siblings(trees[lang], i), *siblings(top, j)]
            now = trees[lang][0][i]
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                now = leaf(r, r[4].translate({c: c + 32 for c in range(65, 91)}))
            for a, b in way:
                now = sha(a + now + b)
            yield r[0], trees[lang][0][i], trees[lang][-1][0], root, sha("".join(a + b for a, b in way)), now, now == root


def made(spark, folder, rows):
    spark.createDataFrame([(*r, "x", "x", "x", 1) for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return [tuple(r) for r in manifest.op11_merkle_manifest(spark, str(folder)).collect()]


ODD = [
    (3, None, None, None, None), (None, "s", "en", 1, "A"), (None, "s", "en", 1, "B"), (5, "s", "en", 2, ""), (5, "s", "en", 2, ""), (5, "s", "en", 9, "Other"),
    (-7, "s", "en", 3, "Éa Ä"), (2**63 - 1, "s", "en", 3, "X"), (-(2**63), "s", "en", 3, "X" * 50_000), (1, "s", "", 0, "alone"), (2, "s", "日本", 0, "Alone"),
]


def test_odd_rows(spark, tmp_path):
    rows = [*ODD, *[(37 * i, "web", ["de", "fr"][i % 2], i, f"Text {i}") for i in range(150)]]
    assert Counter(made(spark, tmp_path, rows)) == Counter(plain(rows))


@pytest.mark.parametrize("n", [0, 1, 8, 9, 65])
def test_sizes(spark, tmp_path, n):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(n)]
    assert Counter(made(spark, tmp_path, rows)) == Counter(plain(rows))


def test_heavy_prefixes_are_split(spark, tmp_path):
    """Ranks stay exact where every bucket is counted further, repeated rows included."""
    rows = [*ODD, *[(i * 5000 % 7919, "s", "en", i % 3, "same") for i in range(300)], *[(77, "s", "en", 1, "hot")] * 40]
    docs = spark.createDataFrame([(*r, "x", "x", "x", 1) for r in rows], SCHEMA)
    found = manifest.manifest(spark, docs, split=4).select("doc_id", "leaf", "subroot", "root", manifest.proof(manifest.F.col("path"))).collect()
    assert Counter(map(tuple, found)) == Counter(r[:5] for r in plain(rows))


def test_more_than_one_level_of_languages(spark, tmp_path):
    rows = [(i, "s", f"l{i % 70}", i, "T") for i in range(90)]
    assert Counter(made(spark, tmp_path, rows)) == Counter(plain(rows))


def test_every_leaf_is_folded_with_its_proof(spark, tmp_path, monkeypatch):
    """A proof that does not lead to the root shows, for documents that nobody tampered with too."""
    whole = manifest.manifest

    def spoilt(*args):
        found = whole(*args)
        path = manifest.F.concat(manifest.F.array(manifest.F.struct(manifest.F.lit("0").alias("l"), manifest.F.lit("").alias("r"))), "path")
        return found.withColumn("path", path)

    monkeypatch.setattr(manifest, "manifest", spoilt)
    rows = [(i, "s", "en", i, f"T{i}") for i in range(30)]
    assert [r[6] for r in made(spark, tmp_path, rows)] == [False] * 30


def test_ranks_come_from_counts_alone(spark, tmp_path, monkeypatch):
    """Nothing is numbered in sorted order, neither documents nor languages."""
    def sorts(*args, **kwargs):
        raise AssertionError("sorted to be numbered")

    monkeypatch.setattr(manifest.F, "row_number", sorts)
    monkeypatch.setattr(type(spark.range(0)), "sortWithinPartitions", sorts)
    rows = [*ODD, *[(37 * i, "web", ["de", "fr", "d", "deu"][i % 4], i, f"Text {i}") for i in range(90)]]
    assert Counter(made(spark, tmp_path, rows)) == Counter(plain(rows))
