import re

import pytest
from pyspark.sql import functions as F

from storegrain import schemas
from storegrain.operators import features, labels
from storegrain.plans import stages


def test_survival_from_either_status_column(spark):
    rows = [("1", "01"), ("2", "02"), ("3", "03"), ("4", None)]
    for name in ("b_stt_cd", "biz_status_cd"):
        out = labels.label_survival(spark.createDataFrame(rows, f"biz_id string, {name} string")).orderBy("biz_id")
        assert [(r.survival_1yr, r.survival_3yr) for r in out.collect()] == [(1, 1), (1, 0), (0, 0), (1, 0)]


def test_survival_is_drawn_without_closures(spark):
    df = spark.range(20_000).selectExpr("cast(id as string) as biz_id", "'01' as b_stt_cd")
    out = labels.label_survival(df)
    rates = out.agg(F.avg("survival_1yr"), F.avg("survival_3yr")).first()
    assert rates[0] == pytest.approx(0.7, abs=0.02) and rates[1] == pytest.approx(0.5, abs=0.02)
    again = labels.label_survival(df.repartition(7))
    assert out.exceptAll(again).isEmpty()


def test_existing_revenue_stays_and_break_even_falls_back(spark):
    df = spark.createDataFrame([("1", 7, 100)], "biz_id string, monthly_revenue bigint, initial_investment bigint")
    row = labels.label_break_even(labels.label_revenue(df)).first()
    assert row.monthly_revenue == 7 and row.break_even_months == 18


def test_risk_by_hand(spark, applicants):
    rows = {r.biz_id: r.risk_score for r in labels.label_risk(applicants).collect()}
    assert rows["4"] == pytest.approx(0.3 * (12e6 / 20_000_001) + 0.2 * 20 / 30 + 0.2 + 0.15)
    assert rows["5"] == pytest.approx(0.3 * (60e6 / 150_000_001) + 0.2 * 3 / 30 + 0.1)


def test_labels_are_within_bounds(applicants):
    out = labels.label_all(applicants)
    assert set(schemas.TARGETS) <= set(out.columns)
    bad = out.filter("risk_score < 0 or risk_score > 1 or break_even_months < 1 or break_even_months > 60 "
                     "or monthly_profit < monthly_revenue * 0.1 - 1 or monthly_profit > monthly_revenue * 0.3")
    assert bad.isEmpty() and out.count() == 5


def test_all_24_features_in_fixed_order(applicants):
    labelled = labels.label_all(applicants)
    state = stages.fit_features(labelled)
    assert state.columns == schemas.FEATURES and len(state.columns) == 24
    out = stages.transform_features(labelled, state, ["biz_id"])
    assert out.columns == ["biz_id", *schemas.FEATURES, *schemas.TARGETS]
    means = out.agg(*[F.avg(c).alias(c) for c in schemas.FEATURES]).first()
    assert all(abs(means[c]) < 1e-9 for c in schemas.FEATURES)


def test_unseen_and_null_classes(spark):
    fit = spark.createDataFrame([("b",), ("a",), (None,)], "gender string")
    classes = features.fit_encoder(fit)
    assert [(r["class"], r.idx) for r in classes.orderBy("idx").collect()] == [("a", 0), ("b", 1), ("unknown", 2)]
    rows = spark.createDataFrame([(1, "b"), (2, "zzz"), (3, None)], "i int, gender string")
    safe = features.encode(rows, classes).orderBy("i").collect()
    assert [r.gender for r in safe] == [1, -1, 2]
    plain = features.encode(rows, classes, null_is_unknown=False).orderBy("i").collect()
    assert [r.gender for r in plain] == [1, -1, -1]
    back = features.decode(features.encode(rows, classes), classes).orderBy("i").collect()
    assert [r.gender for r in back] == ["b", "unknown", "unknown"]


def test_long_class_lists_are_numbered_by_range(spark):
    df = spark.range(3_000).selectExpr("concat('d', lpad(id * 7 % 3000, 5, '0')) as district", "'M' as gender")
    short, long = features.fit_encoder(df), features.fit_encoder(df, single_sort=100)
    assert short.exceptAll(long).isEmpty() and short.count() == long.count() == 3_001


def test_rows_are_read_once_however_long_class_lists_are(spark):
    df = spark.range(2_000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('d', id) end as district")
    classes = features.fit_encoder(df)
    a = sorted(map(tuple, features.encode(df, classes).collect()))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = df.withColumns({"gender": F.lit("M"), "education_level": F.lit("x")})
        plan = features.encode(wide, features.fit_encoder(wide))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Range (0, 2000") == 1 and "Union" not in plan
        assert sorted(map(tuple, features.encode(df, classes).collect())) == a and len(a) == 2_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_onehot_unseen_is_zero(spark):
    df = spark.createDataFrame([(1, "M"), (2, "X")], "i int, gender string")
    out = features.onehot(df, "gender", ["F", "M"])
    assert [tuple(r)[2:] for r in out.orderBy("i").collect()] == [(0.0, 1.0), (0.0, 0.0)]
    assert [r.gender for r in features.onehot_inverse(out, "gender", ["F", "M"]).orderBy("i").collect()] == ["M", None]


def test_constant_columns_scale_by_one(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "a double, b double")
    scaler = features.fit_standard(df, ["a", "b"])
    assert scaler.scale == {"a": 1.0, "b": 1.0} and scaler.centre == {"a": 2.0, "b": 2.0}
    robust = features.fit_robust(df, ["a", "b"])
    assert robust.scale == {"a": 1.0, "b": 1.0}
    back = features.unscale(features.scale(df, scaler), scaler)
    assert sorted(map(tuple, back.collect())) == [(2.0, 1.0), (2.0, 3.0)]


def test_state_survives_a_round_trip(spark, applicants, tmp_path):
    labelled = labels.label_all(applicants)
    state = stages.fit_features(labelled)
    state.save(str(tmp_path))
    again = stages.FeatureState.load(spark, str(tmp_path))
    assert again.columns == state.columns
    a = stages.transform_features(labelled, state, ["biz_id"])
    assert a.exceptAll(stages.transform_features(labelled, again, ["biz_id"])).isEmpty()


def test_encoders_are_chosen_by_sketches(spark):
    rows = spark.range(30_000).selectExpr(
        "cast(id % 5 as string) as gender", "cast(id % 6 as string) as education_level", "cast(id as string) as district",
        "cast(null as string) as business_category")
    want = {"gender": (5, "onehot"), "education_level": (6, "label"), "district": (30_000, "label"), "business_category": (0, "onehot")}
    exact = features.choose_encoders(rows)
    assert {r.column_name: (r.n_classes, r.encoder) for r in exact.collect()} == want
    halves = [features.class_sketches(rows.filter(f"cast(district as int) % 2 = {i}")) for i in (0, 1)]
    united = features.unite_sketches(halves[0].unionByName(halves[1]))
    near = features.choose_encoders(rows, approximate=True, sketches=united)
    got = {r.column_name: (r.n_classes, r.encoder) for r in near.collect()}
    assert got.pop("district")[0] == pytest.approx(30_000, rel=0.06)
    assert got == {c: v for c, v in want.items() if c != "district"}
    plan = features.class_sketches(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan[plan.index("Aggregate"):]  # only the one row of sketches is unpivoted
    assert {tuple(r)[1:] for r in features.choose_encoders(rows.limit(0)).collect()} == {(0, "onehot")}


def test_labels_of_all_targets_fit_a_method_that_the_jvm_compiles(spark, folder, capsys):
    from storegrain.catalog.views import stores
    from storegrain.operators import splits
    from storegrain.plans import stages

    rows = splits.assign_split(stages.label_stage(stages.clean_stage(stores(spark, folder))), "biz_id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows no code before it has run
    try:
        capsys.readouterr()
        rows.select("*").explain(mode="codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
