from __future__ import annotations

import pytest

EXTRA = "text_len int, component long, score double, label string"


@pytest.fixture
def make_docs(spark):
    """Documents (doc_id, text, lang, source) with extra columns whose names operators use themselves."""

    def make(*rows):
        full = [(i, t, lang, source, None if t is None else len(t), 1, 0.5, "x") for i, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, component long, score double, label string")

    return make
