from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, doc_tokens int, part string, body string, word string"


@pytest.fixture
def documents(spark):
    """Makes a documents table, with extra columns whose names clash with what operators use inside."""

    def make(*texts, first: int = 0, ids=None):
        ids = list(range(first, first + len(texts))) if ids is None else ids
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t) if t is not None else None, 7, "u", "x", "y") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make
