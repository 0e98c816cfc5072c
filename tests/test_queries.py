import pytest

from cueloom.plans import registry
from tests.oracle import actual, expected

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    names, want = expected(registry.ORACLES[name], SF)
    got_names, got = actual(registry.QUERIES[name](spark, SF))
    assert got_names == names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows_whatever_the_partitions(spark, name):
    """These have step-by-step or brute-force tests of their own; here their rows over the tables must not depend on how they are dealt out."""
    first = actual(registry.QUERIES[name](spark, SF))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert actual(registry.QUERIES[name](spark, SF)) == first and first[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
