import time

import pytest
from pyspark.sql import functions as F, types as T

from storegrain import schemas
from storegrain.operators import cleaning, mapping
from storegrain.plans.stages import clean_stage


def test_aliases_collapse_and_keep_order(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", "y", None)], "bizesId string, indsLclsCdNm string, indsLclsNm string")
    out = mapping.to_model_names(df)
    assert out.columns == ["biz_id", "business_category"]
    assert [r.business_category for r in out.orderBy("biz_id").collect()] == ["x", "y"]


def test_existing_dong_code_wins_over_the_api_name(spark):
    df = spark.createDataFrame([("1", "2"), (None, "3")], "dong_code string, adongCd string")
    assert sorted(r.dong_code for r in mapping.to_model_names(df).collect()) == ["1", "3"]


def test_table_names_only_where_the_target_is_absent(spark):
    df = spark.createDataFrame([("model", "table")], "business_category string, category_large string")
    out = mapping.to_model_names(df)
    assert out.first().business_category == "model" and "category_large" in out.columns


def test_api_names_cover_the_table(spark):
    df = spark.createDataFrame([tuple("v" for _ in schemas.API_TO_TABLE)], list(schemas.API_TO_TABLE))
    out = mapping.to_table_names(df)
    assert set(out.columns) <= {f.name for f in schemas.STORES.fields}
    assert len(out.columns) == len(set(schemas.API_TO_TABLE.values()))


def test_bookkeeping_does_not_keep_copies(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3)], "id bigint, name string, updated_at bigint")
    assert cleaning.drop_copies(df).count() == 2


def test_defaults_for_absent_columns(spark):
    row = mapping.fill_absent(spark.createDataFrame([("a",)], "biz_id string")).first()
    assert (row.age, row.initial_investment, row.store_size_sqm, row.gender) == (35, 50_000_000, 33.0, "M")


def test_outliers_are_sequential(spark):
    # 300 goes first; only then is 40 far outside the rents that are left.
    rows = [(float(i), 10.0 + i) for i in range(20)] + [(300.0, 12.0), (7.0, 90.0)]
    df = spark.createDataFrame(rows, "initial_investment double, monthly_rent double")
    out = cleaning.remove_outliers(df)
    assert out.count() == 20 and out.agg(F.max("monthly_rent")).first()[0] == 29.0


def test_zero_spread_keeps_all_and_empty_column_drops_all(spark):
    same = spark.createDataFrame([(5.0,)] * 9 + [(1000.0,)], "monthly_rent double")
    assert cleaning.remove_outliers(same).count() == 10
    none = spark.createDataFrame([(None,), (None,)], "monthly_rent double")
    assert cleaning.remove_outliers(none).count() == 0


def test_nan_rows_fall_out(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),)], "store_size_sqm double")
    assert cleaning.remove_outliers(df).count() == 3


def test_text_outlier_columns_are_skipped(spark):
    assert cleaning.remove_outliers(spark.createDataFrame([("x",)], "monthly_rent string")).count() == 1


def test_casts_tolerate_text(spark):
    df = spark.createDataFrame([("41.9", "x"), (None, "12.5")], "age string, monthly_rent string")
    assert sorted(tuple(r) for r in cleaning.cast_types(df).collect()) == [(0, 12.5), (41, 0.0)]


def test_clean_stage_keeps_good_rows(spark, applicants):
    noisy = applicants.withColumn("monthly_rent", F.when(F.col("biz_id") != "2", F.col("monthly_rent")))
    out = clean_stage(noisy.unionByName(noisy))
    assert out.count() == 5
    assert out.filter("biz_id = '2'").first().monthly_rent == pytest.approx(2_500_000)
    assert dict(out.dtypes)["age"] == "bigint" and dict(out.dtypes)["initial_investment"] == "double"


def test_text_with_an_exponent_is_cast_without_an_exception_for_every_row(spark):
    names, texts = "abcd", ("12.7", "1.5E8", " 12 ", "+5", "abc", "9223372036854775808", "12.0", "9007199254740993", "5L", None)
    whole = T.StructType([T.StructField(n, T.LongType()) for n in names])
    rows = spark.createDataFrame([(t,) for t in texts], "a string")
    assert [r.a for r in mapping.project(rows, whole).collect()] == [13, 150_000_000, 12, 5, None, 9223372036854775807, 12, 9007199254740993, None, None]

    def seconds(end):
        text = spark.range(0, 400_000, 1, 8).select(*[F.concat(F.col("id").cast("string"), F.lit(end)).alias(n) for n in names])
        def once():
            start = time.perf_counter()
            mapping.project(text, whole).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start
        return min(once() for _ in range(4))

    assert seconds(".5E2") < 3 * seconds("0")  # 9 times as long with an exception a value
