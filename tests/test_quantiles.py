import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from storegrain.catalog import preparation
from storegrain.operators.quantiles import exact_quantiles, ranked_values, values_at_ranks

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def check(spark, values, gather):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    got = exact_quantiles(df, {"x": PROBS}, direct=0, gather=gather)["x"]
    assert got == pytest.approx(list(np.quantile([v for v in values if v is not None and v == v], PROBS)), rel=1e-12)


def test_bracketing_matches_numpy(spark):
    rng = random.Random(1)
    check(spark, [rng.gauss(0, 1) ** 3 for _ in range(12_000)], 40)


def test_bracketing_with_a_hot_value(spark):
    rng = random.Random(2)
    values = [5.0] * 10_000 + [rng.random() * 10 for _ in range(15_000)] + [1e12, -1e12, None, float("nan")]
    check(spark, values, 40)


def test_two_hot_ends(spark):
    rng = random.Random(3)
    check(spark, [0.0] * 9_000 + [1.0] * 9_000 + [rng.random() for _ in range(5_000)], 20)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e6, 1e6, allow_subnormal=False), min_size=1, max_size=60))
def test_any_values(spark, values):
    check(spark, values, 3)


def test_direct_and_bracketed_agree(spark):
    df = spark.range(5_000).selectExpr("cast(id * id % 997 as double) as x", "case when id % 3 = 0 then id end as y")
    wanted = {"x": [0.25, 0.75], "y": [0.5]}
    assert exact_quantiles(df, wanted) == exact_quantiles(df, wanted, direct=0, gather=10)


def test_empty_column(spark):
    df = spark.range(3).selectExpr("cast(null as double) as x")
    assert exact_quantiles(df, {"x": [0.5]}) == {"x": [None]}


def test_big_integers_keep_every_digit(spark):
    base = 1 << 59
    df = spark.range(20_000).selectExpr(f"{base} + id * 3 as x")
    assert values_at_ranks(df, "x", [0, 7_777, 19_999], 20_000, gather=50) == {
        0: base, 7_777: base + 3 * 7_777, 19_999: base + 3 * 19_999}


def test_columns_of_several_types_together(spark):
    rng = random.Random(4)
    rows = [(rng.gauss(0, 1), float(i % 3), rng.randrange(1 << 60), None if i % 2 else i, rng.randrange(9)) for i in range(6_000)]
    df = spark.createDataFrame(rows, "a double, b float, c bigint, d int, e smallint").withColumn("f", F.lit(None).cast("double"))
    got = exact_quantiles(df, {c: PROBS for c in df.columns}, direct=0, gather=30)
    for i, name in enumerate("abde"):
        values = [r["abcde".index(name)] for r in rows]
        assert got[name] == pytest.approx(list(np.quantile([v for v in values if v is not None], PROBS)), rel=1e-12)
    ordered = sorted(r[2] for r in rows)
    whole = ranked_values(df, {"c": [0, 4_321, 5_999], "e": [17]}, {"c": 6_000, "e": 6_000}, gather=30)
    assert whole == {"c": {k: ordered[k] for k in (0, 4_321, 5_999)}, "e": {17: 0}}
    assert got["f"] == [None] * len(PROBS)


def test_the_number_of_jobs_does_not_grow_with_the_columns(spark):
    def jobs(n):
        df = spark.range(20_000).select(*[((F.col("id") * (2 * i + 3)) % 19_997).cast("double").alias(f"c{i}") for i in range(n)])
        group = f"quantiles-{n}"
        spark.sparkContext.setJobGroup(group, group)
        got = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in df.columns}, direct=0, gather=1_000)
        assert got["c0"] == exact_quantiles(df.select("c0"), {"c0": [0.25, 0.5, 0.75]})["c0"]
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(24) <= jobs(3) + 2


def test_columns_keep_their_order(spark):
    """Whether a column has few or many values is not seen in the result."""
    df = spark.range(200).select(F.col("id").alias("many"), (F.col("id") % 3).alias("few"), (F.col("id") * 2).alias("more"))
    assert list(exact_quantiles(df, {"many": [0.5], "few": [0.5], "more": [0.5]}, direct=50, gather=20).items()) == [
        ("many", [99.5]), ("few", [1.0]), ("more", [199.0])]


def test_medians_compute_their_rows_once(spark, monkeypatch):
    """All passes of ``impute_median`` read rows that were joined once."""
    made = spark.sparkContext.accumulator(0)

    def noted(x):
        made.add(1)
        return float(x)

    rows = spark.range(300).select(F.udf(noted, "double")("id").alias("monthly_rent"), F.col("id").alias("age"), F.col("id").cast("double").alias("store_size_sqm"))
    monkeypatch.setattr(preparation, "stores", lambda *_: rows)
    assert tuple(preparation.impute_median(spark, "").first()) == (149.5, 149.5, 149.5) and made.value == 300
