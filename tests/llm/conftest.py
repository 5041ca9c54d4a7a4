import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from texts (ids count from 0) or from (id, text) pairs; with clashing extra columns."""
    def make(*texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(
            [(i, t, None, "src", 7, "x", 1) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, ids string, n int")
    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
