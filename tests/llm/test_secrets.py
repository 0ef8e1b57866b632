"""Long secrets and overlapping spans are masked to their ends."""

from biblark.llm import pii
from tests.llm.test_operators import documents

LONG = "eyJhbGciOiJIUzI1NiJ9." + "aB3dE5fG7hJ9" * 40 + ".sgnTR42x"


def test_secret_runs_to_its_end():
    text = f"the token = {LONG} and more"
    (found,) = [c for c in pii.candidates(text, pii.base_spans(text)) if c[0] == "secret"]
    assert text[found[1] : found[2]] == LONG


def test_masks_reach_the_furthest_end(spark):
    texts = [f"the token = {LONG} and more", "call +49 170 1234567@example.com now", "write +49 170 1234567 or joe@example.com"]
    masked = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, texts)).collect()}
    assert masked[0] == "the token = <SECRET> and more"
    assert masked[1] == "call <PHONE> now"
    assert masked[2] == "write <PHONE> or <EMAIL>"
