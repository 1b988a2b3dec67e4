from __future__ import annotations

import pytest

from tests.session import session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


def rows(df) -> list[tuple]:
    """Rows as sorted plain tuples."""
    return sorted((tuple(row) for row in df.collect()), key=repr)
