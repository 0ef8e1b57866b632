"""Layout of whole regions at hand: equal to the same rules over rows, and nothing is dealt to other tasks for it."""

import numpy as np
import pyarrow as pa
import pytest

from biblark import queries
from biblark.operators import layout
from tests.oracle import assert_same, connection

@pytest.mark.parametrize("name", ["layout_lines", "layout_words"])
def test_no_word_is_shuffled(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def as_table(spark, at, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{at}/parts")
    next((at / "parts").glob("*.parquet")).rename(at / "documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["layout_lines", "layout_words"])
def test_odd_texts_equal_sql(spark, tmp_path, name):
    """Blank, empty and null texts, long ones, marks of Markdown, characters of all widths. The SQL of characters has a row without region for an empty text."""
    long = " ".join(f"w{i}*" for i in range(400))
    texts = ["# a b\n- c 1. d", long, "", " \n\t", None, "x\u00a0y \u2003 \U0001f600z & <b> 12) q", "same", "--- === +  > 1. 2)"]
    texts = [t for t in texts if t != "" or name == "layout_lines"]
    folder = as_table(spark, tmp_path, [*enumerate(texts), (2**31, "far away")])
    assert_same(queries.QUERIES[name](spark, folder), connection(folder), queries.ORACLE_SQL[name])


def test_texts_of_one_number_share_their_pages(spark, tmp_path):
    folder = as_table(spark, tmp_path, [(1, "a b c"), (7, "d"), (7, "e f")])
    got = {(r["region"], r["text"]) for r in queries.QUERIES["layout_lines"](spark, folder).collect()}
    assert {t for r, t in got if r == 100_000} == {"<sup>***a***</sup> b c"} and len(got) == 2
    assert {frozenset(t.replace("*", " ").replace("<sup>", "").replace("</sup>", "").split()) for r, t in got if r == 700_000} == {frozenset("def")}


def styled(rng, count):
    """Boxes in few places, styles and sizes, some of them unusable."""
    pick = lambda *v: rng.choice(np.array(v, dtype=object), count)
    x0 = (rng.integers(0, 12, count) / 12).astype(object)
    y0 = (rng.integers(0, 9, count) * 0.02 + rng.integers(0, 3, count) * 0.003).astype(object)
    x1 = x0 + pick(0.02, 0.05, 0.08, -0.01)
    y1 = y0 + pick(0.01, 0.012, 0.02)
    x0[rng.random(count) < 0.02] = float("nan")
    region = rng.integers(0, 6, count)
    return region, x0, y0, x1, y1, pick(True, False, False), pick(True, False, False, False), pick(10.0, 10.0, 7.0, 0.0, 12.0), pick(500.0, 500.0, 496.5, 502.0, float("nan"))


def arrays(columns):
    kinds = [np.int64, np.float64, np.float64, np.float64, np.float64, bool, bool, np.float64, np.float64]
    return dict(zip(["region", "x0", "y0", "x1", "y1", "italic", "bold", "size", "baseline"], [c.astype(k) for c, k in zip(columns, kinds)]))


def test_lines_equal_those_over_rows(spark):
    rng = np.random.default_rng(5)
    columns, texts = styled(rng, 600), [str(t) if t else None for t in rng.choice(["a", "b*", "1.", "-", "# x", "<&", "", "~"], 600)]
    rows = [(int(c[0]), i, texts[i], *map(lambda v: v if isinstance(v, bool) else float(v), c[1:])) for i, c in enumerate(zip(*columns))]
    expected = {tuple(r) for r in layout.rich_lines(spark.createDataFrame(rows, "region long, word long, text string, x0 double, y0 double, x1 double, y1 double, italic boolean, bold boolean, size double, baseline double")).collect()}
    region, line, text = layout.lines_in(arrays(columns) | {"word": np.arange(600), "text": pa.array(texts, pa.string())})
    assert set(zip(region.tolist(), line.tolist(), text.to_pylist())) == expected and len(expected) > 40


def test_words_equal_those_over_rows(spark):
    rng = np.random.default_rng(6)
    columns, chars = styled(rng, 900), rng.choice(list("abcé \u2003\U0001f600"), 900)
    runs = np.arange(900) // 6 % 16  # most characters follow each other
    columns = (columns[0] * 0 + np.arange(900) // 96, (0.05 + np.arange(900) % 6 * 0.02 + (rng.random(900) < 0.1) * 0.3).astype(object), (runs * 0.05).astype(object), (0.07 + np.arange(900) % 6 * 0.02).astype(object), (runs * 0.05 + 0.03).astype(object), np.array(runs % 3 == 0, dtype=object), np.array(runs % 5 == 0, dtype=object), columns[7], columns[8] * 0.0)
    rows = [(int(c[0]), i, str(chars[i]), *map(lambda v: v if isinstance(v, bool) else float(v), c[1:])) for i, c in enumerate(zip(*columns))]
    frame = spark.createDataFrame(rows, "region long, place long, char string, x0 double, y0 double, x1 double, y1 double, italic boolean, bold boolean, size double, baseline double")
    kept = ["region", "word", "text", "x0", "y0", "x1", "y1", "italic", "bold", "size"]
    area = (0.0, 0.0, 0.4, 0.7)
    expected = {tuple(r) for r in layout.words_of_chars(frame, area).select(*kept).collect()}
    got = layout.words_in(arrays(columns) | {"place": np.arange(900), "char": np.array([ord(c) for c in chars], dtype=np.uint32)}, area)
    assert set(zip(*[got[k].to_pylist() if k == "text" else got[k].tolist() for k in kept])) == expected and len(expected) > 100


def test_nothing_at_hand():
    none = {k: np.array([]) for k in ("x0", "y0", "x1", "y1", "size", "baseline")} | {k: np.array([], dtype=np.int64) for k in ("region", "word", "place", "char")} | {k: np.array([], dtype=bool) for k in ("italic", "bold")}
    assert len(layout.lines_in(none | {"text": pa.array([], pa.string())})[2]) == 0
    assert len(layout.words_in(none)["text"]) == 0
