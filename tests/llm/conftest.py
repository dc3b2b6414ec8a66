from __future__ import annotations

import pytest

#: Columns that operators don't know, with names that they use inside.
EXTRA = "key string, row long, size long, score double, text_a string, bucket long, spans string, _row string"


@pytest.fixture
def docs(spark):
    """documents (doc_id, text, lang, source, n_chars) of rows (doc_id, text[, source[, lang]])."""

    def make(rows, extra: bool = True):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            frame = frame.selectExpr("*", *[f"cast(null as {k}) as {n}" for n, k in (c.split() for c in EXTRA.split(", "))])
        return frame

    return make
