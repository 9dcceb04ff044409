"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    bad, rows, _, _ = compare(spark, con, name, entry.queries()[name], ORACLES.get(name), SF)
    assert not bad, "\n".join(bad)
    assert rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert "mean_f1" in df.columns and df.count() > 0
