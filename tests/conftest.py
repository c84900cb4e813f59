import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clusterlens.session import local  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local(8, "tests")
    yield session
    session.stop()


@pytest.fixture()
def rows():
    """Rows of a frame as sorted tuples of the given columns."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.toLocalIterator()), key=repr)

    return collect
