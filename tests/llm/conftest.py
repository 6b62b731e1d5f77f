from __future__ import annotations

import pytest

from typeflow.llm.common import importable

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Documents from texts, (doc_id, text) or (doc_id, text, source)."""
    importable(spark)

    def build(rows, extra=None):
        data = []
        for i, row in enumerate(rows):
            doc_id, text, source = (i, row, "s") if row is None or isinstance(row, str) else (*row, "s")[:3]
            data.append((doc_id, text, "en", source, None if text is None else len(text)))
        df = spark.createDataFrame(data, DOCS)
        return df if extra is None else df.selectExpr("*", *extra)

    return build


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
