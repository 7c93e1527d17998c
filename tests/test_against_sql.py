"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from papercorpus.plans import catalog, oracle

from .comparing import differences

QUERIES, SQL = catalog.QUERIES, oracle.ORACLES


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, duck):
    assert differences(QUERIES[name], SQL[name], spark, folder, duck) == []


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["split", "primary_topic", "rows"]
    assert rows.count() > 0
