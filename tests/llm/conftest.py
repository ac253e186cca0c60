import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from parcelwise.llm.shared import prepared  # noqa: E402


@pytest.fixture(scope="session")
def session(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def documents(session):
    """Build a documents table from (doc_id, text) pairs, or longer rows."""

    def build(*rows):
        full = [(*r, "en", "s", len(r[1] or ""))[:5] if len(r) == 2 else r for r in rows]
        return session.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return build


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
