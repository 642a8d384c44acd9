import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text) pairs or (doc_id, text, lang) triples."""

    def make(rows, extra=None):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1]) if r[1] is not None else None) for r in rows]
        schema = DOCS + (f", {extra[0]}" if extra else "")
        return spark.createDataFrame([r + ((extra[1],) if extra else ()) for r in full], schema)

    return make


@pytest.fixture(scope="session")
def table(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
