"""Every query against its SQL; queries without SQL must run and give rows."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry

SQL = entry.oracle_sql()
RUN = entry.queries()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", [n for n in RUN if n in SQL])
def test_equals_sql(spark, folder, con, name):
    assert difference(RUN[name](spark, folder), con, SQL[name]) is None


@pytest.mark.parametrize("name", [n for n in RUN if n not in SQL])
def test_gives_rows(spark, folder, name):
    assert len(RUN[name](spark, folder).take(1)) == 1


def test_entry(spark):
    assert entry.entry(spark).columns == ["event_type", "bucket", "n", "velocity", "acceleration",
                                          "stage"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(RUN)
