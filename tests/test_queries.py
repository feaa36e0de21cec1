"""Every registered query against its SQL oracle, on the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from check_queries import canonical, duck
from suite import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Queries of optional packages have their tests beside them.
QUERIES = {k: v for k, v in entry.queries().items() if k in catalog.QUERIES}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def oracle():
    return duck(SF)


def test_flagship_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "effect" in df.columns


def test_only_file_hashes_has_no_oracle():
    assert set(QUERIES) - set(ORACLES) == {"file_hashes"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    cursor = oracle.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.columns, rows) == canonical(names, cursor.fetchall())
