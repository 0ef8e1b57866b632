"""Names meet the texts that say them, and only those."""

from biblark.operators import weaving
from tests.test_weaving import plain_weave


def test_words_that_stand_apart_are_no_name(spark):
    """A text that holds all words of a name, but not side by side, is not dealt the name."""
    words = [f"word{i}" for i in range(400)]
    texts = spark.createDataFrame([(1, " ".join(words)), (2, "word7 word3\nword9"), (3, "WORD3, word7!")], "id long, text string")
    names = spark.createDataFrame([(f"{a} {b}", f"{a}-{b}") for a in words[:20] for b in words[:20]], "name string, slug string")
    found = weaving.named_in(texts, names, weaving.letters(spark)).collect()
    assert {r["id"]: {n["name"] for n in r["names"]} for r in found} == {1: {f"{a} {b}" for a, b in zip(words, words[1:20])}, 2: {"word7 word3"}, 3: {"word3 word7"}}


def test_long_names_and_odd_letters(spark):
    pages = [("one two three four", "a"), ("one two three five", "b"), ("x\nyz w", "c"), ("Ωμέγα ₂ state", "d"), ("नमस्ते लोग", "e"), ("(2$) cost", "f"), ("..., --- abc", "g")]
    texts = ["say one two three five now\nOne two three four", "one two\nthree four x\nyz w", "the Ωμέγα ₂ STATE\nΩμέγα ₂ states", "कह नमस्ते लोग", "at (2$) cost\na(2$) cost", "z..., --- abc z", "..., --- ABC"]
    rows = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "id long, slug string, text string")
    got = {r["id"]: r["text"] for r in weaving.weave_pages(rows, spark.createDataFrame(pages, "name string, slug string")).collect()}
    # Vowel signs are letters to Spark but not to the plain version's pattern; that row holds none at the ends of the name.
    assert got == {i: plain_weave(t, None, pages) for i, t in enumerate(texts)} and sum("](#wiki-" in t for t in got.values()) == 5
