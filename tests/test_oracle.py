"""Every query with an oracle matches DuckDB at sf0.01 (the driver's check)."""

import pytest

import __spark_entry__ as E
from prepark.plans.catalog import QUERIES
from prepark.plans.oracle import ORACLE
from paths import SF01
from harness import compare, duck

KEYS = sorted(k for k in ORACLE if k in QUERIES)  # queries of optional subpackages have tests of their own


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, con, key):
    sp = QUERIES[key](spark, SF01).toPandas()
    dk = con.execute(ORACLE[key]).df()
    ok, msg = compare(sp, dk)
    assert ok, msg


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, key):
    assert QUERIES[key](spark, SF01).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["event_id", "ts", "user_id", "event_type", "value", "k"]
