import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_package_is_shipped_once(spark):
    entry.ship(spark)
    n = len(spark.sparkContext.listFiles)
    entry.ship(spark)
    assert len(spark.sparkContext.listFiles) == n
