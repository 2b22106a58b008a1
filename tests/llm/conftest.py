import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(autouse=True)
def _shipped(spark):
    from finlake.llm.queries import ship
    ship(spark)


@pytest.fixture
def frame(spark):
    """docs(rows): documents with clashing extra columns; rows of (id, text)."""
    def make(rows, extra=("id", "spans", "n_words", "start", "length")):
        schema = "doc_id long, text string" + "".join(f", {c} string" for c in extra)
        return spark.createDataFrame([(i, t, *["x"] * len(extra)) for i, t in rows], schema)
    return make
