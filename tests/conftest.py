import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from farewise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def rows():
    """Collected rows of a DataFrame as a set of tuples in the given column order."""

    def collect(df, *columns):
        return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}

    return collect
