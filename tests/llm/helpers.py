"""Small document tables with awkward rows, shared by the operators' tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, body string, h long"


def table(spark, texts, ids=None, langs=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = langs or [None] * len(texts)
    rows = [(i, t, g, "s", len(t or ""), "x", "y", 7) for i, t, g in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
