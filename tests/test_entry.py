"""The driver's entry works with and without the optional text subpackage."""

import __spark_entry__ as spark_entry


def test_entry(spark):
    assert spark_entry.entry(spark).limit(1).count() == 1


def test_sql_belongs_to_queries():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
