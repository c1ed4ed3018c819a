"""Every registered query against its SQL at the smallest scale."""

import pytest
from oracle import compare, connect

from gridlake.plans import registered

ENTRIES = registered()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, con, sf_dir, name):
    run, sql = ENTRIES[name]
    assert compare(spark, con, run, sql, sf_dir) == ""


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
