import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from forecourt import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", local_cores=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def name():
    """A table name no other test uses."""
    return f"t_{uuid.uuid4().hex[:10]}"


def values(df, *columns):
    """Rows as sorted tuples (NULL sorts first)."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in rows), key=lambda t: [(v is not None, str(v)) for v in t])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
