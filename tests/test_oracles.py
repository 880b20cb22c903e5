"""Every registered query with an oracle matches DuckDB on the small fixture."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

from conftest import SF_SMALL

ORACLE_NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ORACLE_NAMES)
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dk = con.execute(E.oracle_sql()[name]).df()
    verdict = compare(sp, dk)
    assert verdict.startswith("OK"), f"{name}: {verdict}"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "target_temp" in df.columns and len(df.columns) == 43
