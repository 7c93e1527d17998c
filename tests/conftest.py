from __future__ import annotations

import pytest

from .comparing import TESTDATA, connect
from .session import make_session


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return str(TESTDATA / "sf0.001")


@pytest.fixture(scope="session")
def duck(folder):
    return connect(folder)


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate expressions over literal rows: values(rows, schema, column...)."""

    def run(rows, schema, *columns):
        found = spark.createDataFrame(rows, schema).select(*columns).collect()
        return [row[0] if len(columns) == 1 else tuple(row) for row in found]

    return run
