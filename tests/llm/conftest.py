"""Small invented documents for the training-data operators."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows, with columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "xx", r[2] if len(r) > 2 else "s", 7, "clash", 5, "k") for r in rows]
        return spark.createDataFrame(full, DOCS + ", size string, shard int, key string")

    return make


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)
