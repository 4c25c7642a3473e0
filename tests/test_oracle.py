import pytest

import __spark_entry__ as entry
from oracle_check import compare

FOLDER = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    mine, theirs = compare(spark, FOLDER, entry.queries()[name], ORACLE[name])
    assert mine == theirs


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
