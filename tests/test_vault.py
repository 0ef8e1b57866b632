"""Pages of a vault with names numbered apart, and functions on names, years and repositories."""

from pyspark.sql import functions as F

from biblark.functions import text as T
from biblark.sources import files


def test_vault_pages(spark):
    rows = [(1, "A: b", ["Ada"], 2001, None, None, [], "Text"), (2, "A: b", None, None, None, None, None, None), (3, "A b (2)", None, None, None, None, None, None), (4, None, None, None, None, None, None, None)]
    schema = "id long, title string, authors array<string>, year int, venue string, doi string, tags array<string>, abstract string"
    got = {r["file"]: r["content"] for r in files.vault_pages(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"A b.md", "A b (3).md", "A b (2).md", "senza-titolo.md"}
    assert got["A b.md"] == '---\ntitle: "A: b"\nauthors: ["Ada"]\nyear: 2001\n---\n\n# A: b\n\nText'


def test_functions(spark):
    one = spark.range(1)
    of = lambda column: one.select(column.alias("x")).first()["x"]
    names = of(T.split_bibtex_authors(F.lit("Rossi, Anna and Bob Lee and Plato and ")))
    assert [tuple(n) for n in names] == [("Anna", "Rossi"), ("Bob", "Lee"), (None, "Plato")]
    assert of(T.year_run(F.lit("12 in 0999 or 20240115"))) == 2024 and of(T.year_run(F.lit("12"))) is None
    assert of(T.yaml_quoted(F.lit('a "b"\\\nc'))) == '"a \\"b\\"\\\\ c"'
    assert of(T.repositories(F.lit("see github.com/Lab/Tool.git, github.com/lab/tool and github.com/features/x github.com/a/b."), 5)) == ["Lab/Tool", "a/b"]
    assert of(T.title_in_head(F.lit("Scaling laws for neural giants"), F.lit("SCALING LAWS ..."))) is True
    assert of(T.title_in_head(F.lit("Completely different words"), F.lit("nothing of it"))) is False
