"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest
from compare import difference, duck

from casemill.workload import load_all
from casemill.workload.registry import ORACLE, QUERIES

load_all()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_matches_sql(spark, sf, con, name):
    verdict = difference(QUERIES[name](spark, sf), con, ORACLE[name])
    assert verdict is None or verdict == "no rows", verdict


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
