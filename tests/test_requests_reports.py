from pyspark.sql import functions as F

from storegrain.functions import risk
from storegrain.functions.columns import fixed_text
from storegrain.operators import metrics, reports, requests, stats

REQUEST = "founder_age bigint, business_category string, initial_investment bigint, district string, monthly_rent bigint"


def test_violations(spark):
    rows = [(30, "food", 10, "A", 0), (17, "food", 10, "A", -1), (None, None, None, None, None)]
    out = requests.validate_requests(spark.createDataFrame(rows, REQUEST)).collect()
    assert out[0].is_valid and out[0].violations == []
    assert out[1].violations == ["founder_age out of range", "monthly_rent negative"]
    assert out[2].violations == [f"{c} missing" for c in requests.REQUIRED]


def test_request_defaults(spark):
    row = requests.to_model_input(spark.createDataFrame([(30, "food", 10, "A", None)], REQUEST)).first()
    assert (row.gender, row.education_level, row.nearby_competitor_count, row.floating_population_level) == ("M", "bachelor", 5, "medium")
    assert (row.initial_capital, row.monthly_rent, row.is_franchise) == (10.0, 0.0, 0)
    counted = spark.createDataFrame([(30, "food", 10, "A", None, 12)], REQUEST + ", near bigint")
    assert requests.to_model_input(counted, "near").first().nearby_competitor_count == 12


def test_factors_and_advice(spark):
    rows = [(1_000_000, 10_000_000, 11, 0, 24), (1, 10_000_000, 10, 1, 25), (5, 0, 0, 1, 40)]
    df = spark.createDataFrame(rows, "monthly_rent bigint, initial_investment bigint, nearby_competitor_count bigint, has_related_experience bigint, age bigint")
    out = df.select(risk.risk_factors(df.columns).alias("f")).select("f", risk.recommendations("f").alias("r")).collect()
    assert out[0].f == [risk.RENT_FACTOR, risk.COMPETITION_FACTOR, risk.EXPERIENCE_FACTOR, risk.YOUNG_FACTOR]
    assert out[0].r == [risk.RENT_ADVICE, risk.EXPERIENCE_ADVICE]
    assert out[1].f == [] and out[1].r == [risk.DEFAULT_ADVICE] and out[2].f == []
    bare = spark.createDataFrame([(1,)], "x int")
    assert bare.select(risk.risk_factors(bare.columns)).first()[0] == [risk.EXPERIENCE_FACTOR]


def test_levels_at_the_edges(spark):
    df = spark.createDataFrame([(0.29,), (0.3,), (0.6,), (0.8,)], "s double")
    assert [r[0] for r in df.select(risk.risk_level("s")).collect()] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def test_missing_heads_take_defaults(spark):
    row = requests.postprocess(spark.createDataFrame([(1,)], "x int")).first()
    assert (row.survival_1yr, row.survival_3yr, row.risk_score, row.risk_level, row.break_even_months) == (0.5, 0.3, 0.5, "MEDIUM", 12)


def test_synthetic_applicants_repeat(spark):
    a, b = requests.applicants(spark, 3_000), requests.applicants(spark, 3_000).repartition(3)
    assert a.exceptAll(b).isEmpty()
    share = a.agg(F.avg("is_franchise"), F.min("age"), F.max("age")).first()
    assert abs(share[0] - 0.4) < 0.03 and share[1] >= 20 and share[2] <= 64


def test_keyword_synonyms_and_nulls(spark):
    df = spark.createDataFrame([("음식",), ("소매 FOOD",), (None,)], "c string")
    assert [r[0] for r in df.select(stats.keyword_match("c", "Food")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(stats.keyword_match("c", "(소매")).collect()] == [False, False, False]


def test_rates_where_nothing_is_decided(spark):
    df = spark.createDataFrame([("x", "m", "d", "02"), ("x", None, "d", None)], "category_large string, category_mid string, adong_name string, biz_status_cd string")
    assert stats.survival_by(df, "category_large").isEmpty()
    row = stats.category_stats(df, "X").first()
    assert (row.total, row.matched, row.survival_rate, row.top_sub_categories) == (2, 2, 0.0, "m(1)")
    assert stats.category_profile(df, "zzz").isEmpty()
    assert stats.category_stats(df, "zzz").first().pct == 0.0


def test_null_names_use_a_place_in_table_statistics(spark):
    rows = [("x", None, "d", "01")] * 3 + [("x", c, "d", "01") for c in "abcde"]
    df = spark.createDataFrame(rows, "category_large string, category_mid string, adong_name string, biz_status_cd string")
    assert stats.category_stats(df, "x").first().top_sub_categories == "a(1), b(1), c(1), d(1)"
    assert stats.category_profile(df, "x").first().top_sub_categories == "a(1), b(1), c(1), d(1), e(1)"


def test_short_conversations_keep_all_turns(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(7)] + [(2, 0, "user", "hi")]
    out = {r.conv_id: r.history for r in reports.last_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert out[1] == "user: m2\nadviser: m3\nuser: m4\nadviser: m5\nuser: m6" and out[2] == "user: hi"


def test_texts_are_never_null(spark, applicants):
    out = requests.postprocess(applicants)
    for kind in reports.TASKS:
        assert reports.prompt_text(out, kind).filter("prompt is null or length(prompt) < 50").isEmpty()
    report = reports.rule_report(out).filter("biz_id = '1'").first().report
    assert report.startswith("One-year survival 50.0%") and risk.DEFAULT_ADVICE in report


def test_percent_halves_go_to_even(spark):
    df = spark.createDataFrame([(56.25,), (56.75,), (12.34,), (0.05,)], "x double")
    assert [r[0] for r in df.select(reports.percent_text("x")).collect()] == ["%.1f%%" % v for v in (56.25, 56.75, 12.34, 0.05)]


def test_fixed_decimals_follow_the_exact_value(spark):
    """Numbers whose shortest form ends in a half, which is not what is stored; rates of counts; small, negative and large ones."""
    values = [i / 20 for i in range(1, 400, 2)] + [100 * a / n for n in (400, 2000, 8000, 3999) for a in range(1, n, 7)]
    values += [0.0005, 0.0015, 0.5005, 0.9995, 0.99951, -2.675, -0.05, 2e-9, 123456.7895, 3e12, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2, 3):
        assert [r[0] for r in df.select(fixed_text(F.col("x"), digits)).collect()] == [f"{v:.{digits}f}" for v in values]


def test_rates_and_summary_are_rounded_once(spark):
    cube = spark.createDataFrame([(3, None, None, 2000, 21, 1979, 0, 100 * 21 / 2000, 100 * 1979 / 2000)],
                                 "level int, category string, district string, total long, active long, closed long, suspended long, survival_rate double, closure_rate double")
    assert f"({100 * 21 / 2000:.1f}%)" in reports.stats_text(cube).first().stats_text and f"({100 * 1979 / 2000:.1f}%)" in reports.stats_text(cube).first().stats_text
    wide = spark.createDataFrame([(0.50150, 0.5005, 12344.5)], "survival_1yr_acc double, survival_1yr_auc double, revenue_mae double")
    assert wide.select(metrics.summary_line(wide.columns)).first()[0] == f"1yr accuracy={0.50150 * 100:.1f}%, AUC={0.5005:.3f}, revenue MAE=12,345"


def test_top_lists_of_every_scope(spark):
    rows = [("a", "x", "d", "01")] * 3 + [("a", "y", "d", "01")] * 3 + [("a", None, "e", None), ("b", "x", None, "03"), (None, "z", "d", "01")]
    df = spark.createDataFrame(rows, "category_large string, category_mid string, adong_name string, biz_status_cd string")
    tops = stats.scope_tops(df)
    got = {(r.level, r.category, r.district): (r.top_categories, r.top_sub_categories, r.top_districts) for r in tops.collect()}
    assert got == {
        (3, None, None): ("a(7), b(1)", None, None), (2, None, "d"): ("a(6)", None, None), (2, None, "e"): ("a(1)", None, None),
        (2, None, None): ("b(1)", None, None), (1, "a", None): (None, "x(3), y(3)", "d(6), e(1)"), (1, "b", None): (None, "x(1)", None),
        (1, None, None): (None, "z(1)", "d(1)"), (0, "a", "d"): (None, "x(3), y(3)", None), (0, "b", None): (None, "x(1)", None),
        (0, None, "d"): (None, "z(1)", None)}
    assert stats.scope_tops(df.limit(0)).isEmpty()
