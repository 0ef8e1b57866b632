"""Passages of very long texts reach the last word."""

from biblark.operators import retrieval


def test_long_text_is_covered(spark):
    words = [f"w{i}" for i in range(200_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, None)], "id long, text string")
    rows = sorted(retrieval.chunks(df, "id", "text").collect(), key=lambda r: r["ord"])
    assert len(" ".join(words)) > 1_000_000 and {r["id"] for r in rows} == {1}
    assert rows[-1]["passage"].endswith("w199999")
    assert {w for r in rows for w in r["passage"].split()} == set(words)
    assert retrieval.chunks(df, "id", "text", most=3).count() == 3
