from pyspark.sql import functions as F

from biblark import queries
from biblark.functions import text as T
from tests.oracle import assert_same, connection


def test_odd_texts_equal_sql(spark, tmp_path):
    """Spaces of all kinds at both ends and where the text is cut, line ends, blank and empty texts, nulls."""
    texts = ["plain", "", " ", "\u00a0a\u3000", "\u2003", "\na\n", "\t a \t", "a" * 1999 + "\u00a0b", "a" * 1999 + " b", "\u2009" * 2000 + "b", "\u2028a\u200b", "\U0001f600" * 2001, None]
    rows = [(i, t, "en", "web") for i, t in enumerate(texts)] + [(90, "a", "", " s "), (91, "a", None, "web"), (92, "a", "en", None), (93, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert_same(queries.QUERIES["embedding_text"](spark, str(tmp_path)), connection(str(tmp_path)), queries.ORACLE_SQL["embedding_text"])


def test_missing_lines_are_left_out(spark):
    row = spark.range(1).select(T.embedding_text(F.lit(None).cast("string"), F.lit("abstract"), F.lit("text"))).first()
    assert row[0] == "abstract\ntext"
