"""Splits, metrics, comparison, request rules and score post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from storegrain.catalog import query
from storegrain.catalog.preparation import (
    LABEL_STEPS, RAW_AS_CLEAN, model_rows,
)
from storegrain.catalog.views import (
    REQUESTS_SQL, plain, rounded, stores, table, uniform_sql, view, with_stores,
)
from storegrain.functions import risk
from storegrain.functions.columns import draw
from storegrain.operators import labels, metrics, requests, splits
from storegrain.plans.training import weighted_mean
from storegrain.session import stage, staging_path
from storegrain.sources import tables

# -- splits -----------------------------------------------------------------

U = uniform_sql("biz_id", "split|42")
SPLIT = f"SELECT *, CASE WHEN {U} < 0.1e0 THEN 'test' WHEN {U} < 0.1e0 + 0.1e0 THEN 'val' ELSE 'train' END AS split FROM stores"


@query("split_assign", with_stores("SELECT biz_id, split FROM parts", parts=SPLIT))
def split_assign(spark, folder):
    return splits.assign_split(stores(spark, folder), "biz_id").select("biz_id", "split")


@query("split_assign_exact", with_stores("""
SELECT biz_id, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + ceil((n - n_test) * (0.1e0 / (1 - 0.1e0))) THEN 'val'
  ELSE 'train' END AS split
FROM (SELECT biz_id, row_number() OVER (ORDER BY substr(md5(biz_id || '|split|42'), 1, 15)) AS rn, count(*) OVER () AS n,
        ceil(count(*) OVER () * 0.1e0) AS n_test FROM stores)"""))
def split_assign_exact(spark, folder):
    rows = stage(stores(spark, folder).select("biz_id"), "keys")
    return splits.assign_split(rows, "biz_id", exact=True).select("biz_id", "split")


@query("split_sizes", with_stores("SELECT split, count(*) AS n FROM parts GROUP BY 1", parts=SPLIT))
def split_sizes(spark, folder):
    return splits.split_counts(splits.assign_split(stores(spark, folder), "biz_id"))


@query("split_read", with_stores("SELECT biz_id, age FROM parts WHERE split = 'val'", parts=SPLIT))
def split_read(spark, folder):
    path = staging_path(spark, "splits")
    tables.save_splits(splits.assign_split(stores(spark, folder), "biz_id").select("biz_id", "age", "split"), path)
    return tables.load_split(spark, path, "val")


# -- metrics ----------------------------------------------------------------

SCORED = f"""SELECT biz_id, survival_1yr, survival_3yr, monthly_revenue, monthly_profit, risk_score,
  round(0.3e0 * survival_1yr + 0.7e0 * {uniform_sql('biz_id', 'score1')}, 3) AS p_survival_1yr,
  round(0.2e0 * survival_3yr + 0.8e0 * {uniform_sql('biz_id', 'score3')}, 3) AS p_survival_3yr,
  monthly_revenue * (0.9e0 + 0.2e0 * {uniform_sql('biz_id', 'revenue')}) AS p_monthly_revenue,
  monthly_profit * (0.8e0 + 0.4e0 * {uniform_sql('biz_id', 'profit')}) AS p_monthly_profit,
  least(1e0, risk_score + 0.1e0 * {uniform_sql('biz_id', 'risk')}) AS p_risk_score FROM labelled"""


def scored(spark, folder):
    """Labelled rows with drawn scores, some of them tied."""
    rows = model_rows(spark, folder).withColumn("monthly_rent", F.coalesce("monthly_rent", F.lit(0.0)))
    out = labels.label_all(rows)
    return out.select(
        "biz_id", "survival_1yr", "survival_3yr", "monthly_revenue", "monthly_profit", "risk_score",
        F.round(0.3 * F.col("survival_1yr") + 0.7 * draw("biz_id", "score1"), 3).alias("p_survival_1yr"),
        F.round(0.2 * F.col("survival_3yr") + 0.8 * draw("biz_id", "score3"), 3).alias("p_survival_3yr"),
        (F.col("monthly_revenue") * (0.9 + 0.2 * draw("biz_id", "revenue"))).alias("p_monthly_revenue"),
        (F.col("monthly_profit") * (0.8 + 0.4 * draw("biz_id", "profit"))).alias("p_monthly_profit"),
        F.least(F.lit(1.0), F.col("risk_score") + 0.1 * draw("biz_id", "risk")).alias("p_risk_score"))


SCORED_STEPS = {"model_rows": RAW_AS_CLEAN["clean"],
                "clean": "SELECT * REPLACE (coalesce(monthly_rent, 0) AS monthly_rent) FROM model_rows",
                **LABEL_STEPS, "scored": SCORED}


def class_sql(tag: str) -> str:
    y, p = f"survival_{tag} > 0.5", f"p_survival_{tag} > 0.5"
    return f"""round(count(*) FILTER (({y}) = ({p})) * 1e0 / count(*), 6) AS survival_{tag}_acc,
  round(coalesce(2e0 * count(*) FILTER ({y} AND {p}) / nullif(2 * count(*) FILTER ({y} AND {p})
    + count(*) FILTER (NOT {y} AND {p}) + count(*) FILTER ({y} AND NOT {p}), 0), 0), 6) AS survival_{tag}_f1"""


CLASSIFICATION = f"SELECT {class_sql('1yr')}, {class_sql('3yr')} FROM scored"


def auc_sql(tag: str) -> str:
    return f"""(SELECT round(sum(p * (below + n / 2e0)) / (sum(p) * sum(n)), 6) FROM (
      SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
        SELECT p_survival_{tag} AS s, count(*) FILTER (survival_{tag} > 0.5) AS p, count(*) FILTER (survival_{tag} <= 0.5) AS n
        FROM scored GROUP BY 1)))"""


AUC = f"SELECT {auc_sql('1yr')} AS survival_1yr_auc, {auc_sql('3yr')} AS survival_3yr_auc"
REGRESSION = """SELECT round(avg(abs(monthly_revenue - p_monthly_revenue)), 2) AS revenue_mae,
  round(1 - sum(pow(monthly_revenue - p_monthly_revenue, 2)) / (var_pop(monthly_revenue) * count(*)), 6) AS revenue_r2,
  round(avg(abs(monthly_profit - p_monthly_profit)), 2) AS profit_mae, round(avg(abs(risk_score - p_risk_score)), 6) AS risk_mae
  FROM scored"""


@query("metrics_classification", with_stores(CLASSIFICATION, **SCORED_STEPS))
def metrics_classification(spark, folder):
    out = metrics.classification_metrics(scored(spark, folder))
    return rounded(out, 6, *out.columns)


@query("metrics_auc", with_stores(AUC, **SCORED_STEPS))
def metrics_auc(spark, folder):
    out = metrics.auc_metrics(stage(scored(spark, folder), "scored"))
    return rounded(out, 6, *out.columns)


@query("metrics_regression", with_stores(REGRESSION, **SCORED_STEPS))
def metrics_regression(spark, folder):
    out = metrics.regression_metrics(scored(spark, folder))
    return rounded(rounded(out, 2, "revenue_mae", "profit_mae"), 6, "revenue_r2", "risk_mae")


LONG = """SELECT 'alpha' AS model, 'survival_acc' AS metric, avg(CAST((survival_1yr > 0.5) = (p_survival_1yr > 0.5) AS INTEGER)) AS value FROM scored
  UNION ALL SELECT 'beta', 'survival_acc', avg(CAST((survival_1yr > 0.5) = (p_survival_3yr > 0.5) AS INTEGER)) FROM scored
  UNION ALL SELECT 'alpha', 'risk_mae', avg(abs(risk_score - p_risk_score)) FROM scored
  UNION ALL SELECT 'beta', 'risk_mae', avg(abs(risk_score - p_survival_1yr)) FROM scored
  UNION ALL SELECT 'beta', 'profit_mae', avg(abs(monthly_profit - p_monthly_profit)) FROM scored"""


@query("compare_models", with_stores("""
SELECT metric, n_models, round(low, 6) AS low, round(high, 6) AS high, best_model FROM (
  SELECT metric, count(*) AS n_models, min(value) AS low, max(value) AS high,
    CASE WHEN contains(metric, 'loss') OR contains(metric, 'mae') THEN arg_min(model, value) ELSE arg_max(model, value) END AS best_model
  FROM long GROUP BY 1) WHERE n_models >= 2""", **SCORED_STEPS, long=LONG))
def compare_models(spark, folder):
    rows = scored(spark, folder)

    def hit(score):
        return F.avg(((F.col("survival_1yr") > 0.5) == (F.col(score) > 0.5)).cast("double"))

    wide = rows.agg(
        hit("p_survival_1yr").alias("alpha|survival_acc"), hit("p_survival_3yr").alias("beta|survival_acc"),
        F.avg(F.abs(F.col("risk_score") - F.col("p_risk_score"))).alias("alpha|risk_mae"),
        F.avg(F.abs(F.col("risk_score") - F.col("p_survival_1yr"))).alias("beta|risk_mae"),
        F.avg(F.abs(F.col("monthly_profit") - F.col("p_monthly_profit"))).alias("beta|profit_mae"))
    long = wide.unpivot([], wide.columns, "name", "value").select(
        F.split("name", r"\|")[0].alias("model"), F.split("name", r"\|")[1].alias("metric"), "value")
    return rounded(metrics.compare_models(long), 6, "low", "high")


@query("eval_report", with_stores("""
SELECT '{"name":"drawn"}' AS model, printf('1yr accuracy=%.1f%%, AUC=%.3f, revenue MAE=%s', survival_1yr_acc * 100, survival_1yr_auc,
  format('{:,}', CAST(round(revenue_mae) AS BIGINT))) AS summary, 7 AS n_metrics
FROM class, auc, reg""", **SCORED_STEPS, **{"class": CLASSIFICATION, "auc": AUC, "reg": REGRESSION}))
def eval_report(spark, folder):
    rows = stage(scored(spark, folder), "scored")
    parts = [metrics.classification_metrics(rows), metrics.regression_metrics(rows)]
    area = metrics.auc_metrics(rows).first()
    wide = parts[0].select("*", *[F.lit(area[c]).alias(c) for c in area.asDict()],
                           *[parts[1].select(c).scalar().alias(c) for c in parts[1].columns])
    wide = wide.select("survival_1yr_acc", "survival_1yr_f1", "survival_3yr_acc", "survival_1yr_auc", "revenue_mae", "revenue_r2", "risk_mae")
    wide = rounded(rounded(wide, 6, "survival_1yr_acc", "survival_1yr_auc"), 2, "revenue_mae")
    report = metrics.report_row(wide, {"name": "drawn"})
    return report.select("model", "summary", F.size(F.from_json("metrics", "map<string,double>")).alias("n_metrics"))


REPORTED = ["survival_1yr_acc", "survival_1yr_f1", "survival_3yr_acc", "survival_1yr_auc", "revenue_mae", "revenue_r2", "risk_mae"]


@query("report_files", with_stores(
    " UNION ALL ".join(f"""SELECT '{{"name":"drawn"}}' AS model, {i}::INTEGER AS position, '{m}' AS metric, round({m}, 6) AS value FROM class, auc, reg"""
                       for i, m in enumerate(REPORTED)),
    **SCORED_STEPS, **{"class": CLASSIFICATION, "auc": AUC, "reg": REGRESSION}))
def report_files(spark, folder):
    """Two reports of one model written as JSON and read again: the metrics of the newer one, in their order."""
    rows = stage(scored(spark, folder), "scored")
    area = metrics.auc_metrics(rows).first()
    errors = metrics.regression_metrics(rows)
    wide = metrics.classification_metrics(rows).select(
        "*", *[F.lit(area[c]).alias(c) for c in area.asDict()], *[errors.select(c).scalar().alias(c) for c in errors.columns])
    path = staging_path(spark, "reports")
    for day, factor in (("2024-01-01", 2.0), ("2024-01-02", 1.0)):
        row = wide.select(*[(F.col(c) * factor).alias(c) for c in REPORTED])
        metrics.write_report(metrics.report_row(row, {"name": "drawn"}, F.lit(day).cast("timestamp")), path)
    found = metrics.latest_reports(metrics.read_reports(spark, path)).drop("created_at")
    money = F.col("metric").isin("revenue_mae", "profit_mae")
    return found.withColumn("value", F.when(money, F.round("value", 2)).otherwise(F.round("value", 6)))


# -- requests ---------------------------------------------------------------

REQUESTS = plain(REQUESTS_SQL)


@query("validate_requests", f"""SELECT request_id, concat_ws('; ',
  CASE WHEN founder_age IS NULL THEN 'founder_age missing' END, CASE WHEN business_category IS NULL THEN 'business_category missing' END,
  CASE WHEN initial_investment IS NULL THEN 'initial_investment missing' END, CASE WHEN district IS NULL THEN 'district missing' END,
  CASE WHEN founder_age NOT BETWEEN 18 AND 80 THEN 'founder_age out of range' END,
  CASE WHEN experience_years < 0 THEN 'experience_years negative' END,
  CASE WHEN initial_investment < 0 THEN 'initial_investment negative' END,
  CASE WHEN monthly_rent < 0 THEN 'monthly_rent negative' END, CASE WHEN store_size_sqm < 0 THEN 'store_size_sqm negative' END,
  CASE WHEN employee_count < 0 THEN 'employee_count negative' END) AS violations,
  coalesce(founder_age BETWEEN 18 AND 80, false) AND business_category IS NOT NULL AND experience_years >= 0
    AND initial_investment >= 0 AS is_valid
FROM ({REQUESTS})""")
def validate_requests(spark, folder):
    out = requests.validate_requests(view(spark, folder, REQUESTS_SQL))
    return out.select("request_id", F.array_join("violations", "; ").alias("violations"), "is_valid")


@query("request_to_input", f"""SELECT request_id, founder_age AS age, coalesce(founder_gender, 'M') AS gender,
  coalesce(founder_education, 'bachelor') AS education_level, experience_years, CAST(has_related_experience AS BIGINT) AS has_related_experience,
  CAST(0 AS BIGINT) AS has_startup_experience, CAST(initial_investment AS DOUBLE) AS initial_capital, business_category,
  business_sub_category, district, store_size_sqm, CAST(initial_investment AS DOUBLE) AS initial_investment,
  CAST(monthly_rent AS DOUBLE) AS monthly_rent, employee_count, CAST(is_franchise AS BIGINT) AS is_franchise,
  CAST(5 AS BIGINT) AS nearby_competitor_count, 'medium' AS floating_population_level FROM ({REQUESTS})""")
def request_to_input(spark, folder):
    return requests.to_model_input(view(spark, folder, REQUESTS_SQL))


# -- score rules ------------------------------------------------------------

HEADS = f"""SELECT biz_id, {uniform_sql('biz_id', 'h1')} AS survival_1yr, {uniform_sql('biz_id', 'h2')} * 1e7 AS monthly_revenue,
  {uniform_sql('biz_id', 'h3')} AS risk_score, {uniform_sql('biz_id', 'h4')} * 4 - 1 AS break_even_months, * EXCLUDE (biz_id) FROM stores"""


def heads(spark, folder):
    return stores(spark, folder).withColumns({
        "survival_1yr": draw("biz_id", "h1"), "monthly_revenue": draw("biz_id", "h2") * 1e7,
        "risk_score": draw("biz_id", "h3"), "break_even_months": draw("biz_id", "h4") * 4 - 1})


LEVEL = "CASE WHEN risk_score < 0.3 THEN 'LOW' WHEN risk_score < 0.6 THEN 'MEDIUM' WHEN risk_score < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END"
FACTORS = f"""concat_ws('; ', CASE WHEN initial_investment > 0 AND coalesce(monthly_rent, 0) * 12 / initial_investment > 0.5 THEN '{risk.RENT_FACTOR}' END,
  CASE WHEN nearby_competitor_count > 10 THEN '{risk.COMPETITION_FACTOR}' END,
  CASE WHEN has_related_experience = 0 THEN '{risk.EXPERIENCE_FACTOR}' END, CASE WHEN age < 25 THEN '{risk.YOUNG_FACTOR}' END)"""


@query("risk_level", with_stores(f"SELECT biz_id, {LEVEL} AS risk_level FROM heads", heads=HEADS))
def risk_level(spark, folder):
    return heads(spark, folder).select("biz_id", risk.risk_level("risk_score").alias("risk_level"))


@query("risk_factors", with_stores(f"SELECT biz_id, {FACTORS} AS risk_factors FROM stores"))
def risk_factors(spark, folder):
    rows = stores(spark, folder)
    return rows.select("biz_id", F.array_join(risk.risk_factors(rows.columns), "; ").alias("risk_factors"))


@query("recommendations", with_stores(f"""SELECT biz_id, CASE WHEN advice = '' THEN '{risk.DEFAULT_ADVICE}' ELSE advice END AS recommendations
FROM (SELECT biz_id, concat_ws('; ', CASE WHEN contains(f, '임대료') THEN '{risk.RENT_ADVICE}' END,
  CASE WHEN contains(f, '경험') THEN '{risk.EXPERIENCE_ADVICE}' END) AS advice FROM (SELECT biz_id, {FACTORS} AS f FROM stores))"""))
def recommendations(spark, folder):
    rows = stores(spark, folder)
    advice = risk.recommendations(risk.risk_factors(rows.columns))
    return rows.select("biz_id", F.array_join(advice, "; ").alias("recommendations"))


@query("postprocess", with_stores(f"""SELECT biz_id, round(survival_1yr, 4) AS survival_1yr, 0.3e0 AS survival_3yr,
  CAST(floor(monthly_revenue) AS BIGINT) AS monthly_revenue, CAST(0 AS BIGINT) AS monthly_profit, round(risk_score, 4) AS risk_score,
  {LEVEL} AS risk_level, CAST(greatest(1, trunc(break_even_months)) AS BIGINT) AS break_even_months FROM heads""", heads=HEADS))
def postprocess(spark, folder):
    # Two heads are absent and take their defaults.
    return requests.postprocess(heads(spark, folder)).select(
        "biz_id", "survival_1yr", "survival_3yr", "monthly_revenue", "monthly_profit", "risk_score", "risk_level", "break_even_months")


@query("ensemble_average", with_stores(f"""SELECT biz_id, round(0.6e0 * a + 0.4e0 * b, 9) AS p_risk_score FROM (
  SELECT biz_id, {uniform_sql('biz_id', 'a')} AS a, {uniform_sql('biz_id', 'b')} AS b FROM stores)"""))
def ensemble_average(spark, folder):
    rows = stores(spark, folder).select("biz_id", draw("biz_id", "a").alias("a"), draw("biz_id", "b").alias("b"))
    return rounded(weighted_mean(rows, {"p_risk_score": ["a", "b"]}, [0.6, 0.4]), 9, "p_risk_score")


def chosen_sql(name: str) -> str:
    values, weights = requests.CHOICES[name]
    u, edge, parts = uniform_sql("id", f"{name}|42"), 0.0, []
    for value, weight in list(zip(values, weights))[:-1]:
        edge += weight
        parts.append(f"WHEN {u} < {edge!r}::DOUBLE THEN " + (f"'{value}'" if isinstance(value, str) else f"{value}::BIGINT"))
    last = values[-1]
    return "CASE " + " ".join(parts) + " ELSE " + (f"'{last}'" if isinstance(last, str) else f"{last}::BIGINT") + f" END AS {name}"


@query("synthetic_applicants", "SELECT id, " + ", ".join(chosen_sql(n) for n in requests.CHOICES) + ", " + ", ".join(
    f"CAST({low} + floor({uniform_sql('id', f'{n}|42')} * {high - low}) AS BIGINT) AS {n}" for n, (low, high) in requests.INTEGERS.items())
    + f", round(10e0 + {uniform_sql('id', 'store_size_sqm|42')} * 140e0, 6) AS store_size_sqm"
    + " FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders)")
def synthetic_applicants(spark, folder):
    ids = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    return rounded(requests.synthetic_applicants(ids), 6, "store_size_sqm")


