"""Scores come from every gram, however few are broadcast."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sparseloom.llm import ppm
from test_operators import ROWS, TEXTS, docs, naive_ppm  # noqa: F401  docs is a fixture


@pytest.mark.parametrize("most", [0, 40])
def test_a_tiny_head_gives_the_same_scores(docs, monkeypatch, most):  # noqa: F811
    monkeypatch.setattr(ppm, "TRIE", most)
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in ROWS]
    model = naive_ppm([t for t, h in zip(TEXTS, held, strict=True) if not h], ppm.ORDER)
    want = Counter((r[0], round(model(t), 6)) for r, t in zip(ROWS, TEXTS, strict=True))
    assert Counter((r.doc_id, round(r.score, 6)) for r in ppm.model_scores(docs).select("doc_id", F.col("score")).collect()) == want
