from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string, block long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of (doc_id, text[, lang[, source]]), with columns whose names operators use themselves."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), None, "x", "y", 1) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build
