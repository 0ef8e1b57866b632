"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from biblark.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, run string"


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(words):
    gaps = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[i, w[:i] + w[i + 1 :]].add(w)
    for w in words:
        found = {w[:i] + w[i + 1 :] for i in range(len(w))} & set(words)
        for i in range(len(w) + 1):
            found |= gaps.get((i, w), set()) | gaps.get((i, w[:i] + w[i + 1 :]), set())
        yield w, found - {w}


def plain(words):
    rows = {}
    for w, others in near(words):
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 2 * words[w] else None
        rows[w] = (form, words[w], len(others), words.get(form))
    for w, row in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        yield w, row[0], root, *row[1:]


def result(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ODD = [(1, None), (None, "words words words Words"), (2, ""), (3, "é" * 3), (4, "×÷×÷×  ×÷×÷×  ×÷×÷×"), (5, "Straße straße STRASSE strasse strasse naïve naÏve"), (6, ("x" * 4000 + " ") * 3 + "x" * 3999), (6, "words words"), (6, "words words"), (7, "aaaaa aaaaaa aaaaaaa " * 4)]


def test_odd_texts(spark, tmp_path):
    rng = random.Random(1)
    some = [(i, " ".join("".join(rng.choice("abÀ") for _ in range(rng.randrange(4, 8))) for _ in range(60))) for i in range(100)]
    rows = [*ODD, *some]
    spark.createDataFrame([(*r, "x", 1, "x") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    words = counted(rows)
    assert len(words) > 300
    assert result(spelling.op12_spelling_variants(spark, str(tmp_path))) == set(plain(words))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert spelling.op12_spelling_variants(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("shard", "wave"), [(7, 300), (50, 1), (1000, 1 << 20)])
def test_many_shards_and_waves(spark, shard, wave):
    rng = random.Random(2)
    words = {"".join(rng.choice("abcÿ") for _ in range(rng.randrange(0, 7))): rng.randrange(1, 9) for _ in range(400)}
    got = spelling.variants(spark, spark.createDataFrame(list(words.items()), "word string, n long"), shard, wave)
    assert result(got) == set(plain(words))


def test_a_chain_of_forms_is_followed_to_its_end(spark):
    words = {"a" * k: 3 * 2 ** (k - 5) for k in range(5, 40)}
    rows = result(spelling.variants(spark, spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {r[2] for r in rows} == {"a" * 39}


def test_trie_round_trip():
    words = sorted({"", "a", "ab", "abc", "b", "ÿz", "zz"})
    trie = spelling.Trie.unpacked(spelling.Trie.of(words, np.arange(len(words))).packed())
    assert trie.word(np.arange(len(words))) == words and list(trie.n) == list(range(len(words)))
