"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry
from lakeseek.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert oracle.difference(df, catalogue.SQL[name], db) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
