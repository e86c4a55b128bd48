"""Every registered query of the analytics operators: against its oracle, or that it runs where it has none."""

import pytest

from quillspan.plans import catalogue

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLES:
        same(con, df, catalogue.ORACLES[name])
    else:
        assert df.count() >= 0 and df.columns


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "site_id"
