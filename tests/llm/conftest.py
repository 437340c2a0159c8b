from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def make_docs(spark):
    """Documents from (doc_id, text) pairs; the other columns hold nulls."""

    def make(rows, extra: str = ""):
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
        return df.selectExpr("*", extra) if extra else df

    return make
