"""The registered queries against their DuckDB twins (sf0.001) and the driver contract."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

from conftest import SF_SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()
FAST = sorted(n for n in SQL if n not in ("live_counts", "rule_stream"))


def test_contract(spark):
    assert set(SQL) <= set(QUERIES)
    df = E.entry(spark)
    assert df.columns and df.count() >= 0


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sp = QUERIES[name](spark, SF_SMALL).toPandas()
    dd = con.execute(SQL[name]).df()
    assert compare(sp, dd) == "OK"


@pytest.mark.parametrize("name", ["live_counts", "rule_stream"])
def test_streams_equal_batch(spark, con, name):
    sp = QUERIES[name](spark, SF_SMALL).toPandas()
    dd = con.execute(SQL[name]).df()
    assert compare(sp, dd) == "OK"


def test_shared_tables_are_reused_and_released(spark):
    from logsleuth.plans import catalog as Q
    a = Q.alerts_df(spark, SF_SMALL)
    assert Q.alerts_df(spark, SF_SMALL) is a          # one stored alert table per folder
    n = a.count()
    Q.release_shared(spark)
    b = Q.alerts_df(spark, SF_SMALL)
    assert b is not a and b.count() == n
