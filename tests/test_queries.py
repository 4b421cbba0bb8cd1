"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from checks.compare import difference, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")
ORACLE = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, connection, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    problem = difference(df, connection, ORACLE[name])
    assert problem is None, problem


def test_ambiguous_names_are_registered(spark, connection):
    df = entry_module.queries()["ambiguous_names"](spark, SF_DIR)
    assert difference(df, connection, ORACLE["ambiguous_names"]) is None
    assert df.where("doubt = 'names_with_several_prices'").count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
