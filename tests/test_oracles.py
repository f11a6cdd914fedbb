"""Every registered query against its SQL oracle, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from harness import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    # Both sides empty would prove nothing, so it fails as well.
    note = compare(QUERIES[name](spark, sf), ORACLES[name], sf)
    assert note is None, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["request_id", "rank", "name", "domain", "experience", "price", "satisfaction"]
    assert df.count() > 0
