"""Every registered query against its SQL, and basic rules of the registry."""

import pytest

import __spark_entry__ as contract
from storegrain.catalog import load_all
from storegrain.catalog.compare import connect, difference

REGISTRY = load_all()
WITH_SQL = [name for name, q in REGISTRY.items() if q.sql]
# Training queries take long; they are run in test_training.
ROWS_ONLY = [n for n, q in REGISTRY.items() if not q.sql and q.run.__module__.split(".")[-1] != "learning"]


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, duck, folder, name):
    assert difference(spark, duck, folder, REGISTRY[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, folder, name):
    assert REGISTRY[name].run(spark, folder).count() > 0


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["survival_stats", "clean_all", "dedupe_latest", "stats_cube", "split_assign", "upsert_stores"])
def test_same_on_one_partition(spark, duck, folder, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert difference(spark, duck, folder, REGISTRY[name]) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
