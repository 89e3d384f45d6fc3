"""Mapping, cleaning, labels and features over the store view."""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from storegrain import schemas
from storegrain.catalog import query
from storegrain.catalog.views import api_rows, plain, rounded, stores, uniform_sql, view, with_stores, HDONG_SQL
from storegrain.operators import cleaning, features, labels, mapping
from storegrain.plans import stages
from storegrain.session import stage

# -- mapping ----------------------------------------------------------------

MODEL = """SELECT biz_id, store_name, category_large AS business_category, category_mid AS business_sub_category,
  adong_name AS district, longitude, latitude FROM stores"""


@query("map_api_columns", with_stores(MODEL))
def map_api_columns(spark, folder):
    return mapping.to_model_names(api_rows(spark, folder)).select(
        "biz_id", "store_name", "business_category", "business_sub_category", "district", "longitude", "latitude")


@query("map_db_columns", with_stores(MODEL))
def map_db_columns(spark, folder):
    return mapping.to_model_names(stores(spark, folder)).select(
        "biz_id", "store_name", "business_category", "business_sub_category", "district", "longitude", "latitude")


@query("api_to_table", with_stores("""
SELECT biz_id, store_name, category_large, category_mid, sido_name, sgg_name, adong_name, longitude, latitude,
  '202401' AS data_ym FROM stores"""))
def api_to_table(spark, folder):
    return mapping.to_table_names(api_rows(spark, folder)).select(
        "biz_id", "store_name", "category_large", "category_mid", "sido_name", "sgg_name", "adong_name", "longitude",
        "latitude", "data_ym")


@query("region_rename", f"""
SELECT hdong_cd AS region_cd, sido_nm AS sido_name, sgg_nm AS sgg_name, dong_nm AS dong_name FROM ({plain(HDONG_SQL)})""")
def region_rename(spark, folder):
    return mapping.to_region_names(view(spark, folder, HDONG_SQL)).withColumnRenamed("hdong_cd", "region_cd")


@query("project_to_schema", with_stores("""
SELECT biz_id, store_name, category_large, category_mid, sido_name, sgg_name, adong_name, biz_status_cd FROM stores"""))
def project_to_schema(spark, folder):
    kept = mapping.project(stores(spark, folder), schemas.STORES, ("collected_at", "updated_at", "longitude", "latitude"))
    return kept


@query("fill_missing_features", with_stores("""
SELECT biz_id, age, CAST(50000000 AS BIGINT) AS initial_capital, 'bachelor' AS education_level,
  'medium' AS floating_population_level, CAST(0 AS BIGINT) AS has_startup_experience FROM stores"""))
def fill_missing_features(spark, folder):
    return mapping.fill_absent(stores(spark, folder)).select(
        "biz_id", "age", "initial_capital", "education_level", "floating_population_level", "has_startup_experience")


@query("nan_to_null", with_stores("""
SELECT biz_id, CASE WHEN CAST(biz_id AS BIGINT) % 10 <> 3 THEN initial_investment END AS initial_investment FROM stores"""))
def nan_to_null(spark, folder):
    broken = F.when(F.col("biz_id").cast("bigint") % 10 == 3, F.lit(float("nan"))).otherwise(F.col("initial_investment"))
    return mapping.nan_to_null(stores(spark, folder).select("biz_id", broken.alias("initial_investment")))


@query("feature_columns", """
SELECT * FROM (VALUES (1, 'age'), (2, 'experience_years'), (3, 'initial_investment'), (4, 'monthly_rent'),
  (5, 'store_size_sqm'), (6, 'employee_count'), (7, 'nearby_competitor_count'), (8, 'initial_capital'), (9, 'gender'),
  (10, 'education_level'), (11, 'business_category'), (12, 'business_sub_category'), (13, 'district'),
  (14, 'floating_population_level'), (15, 'has_related_experience'), (16, 'has_startup_experience'), (17, 'is_franchise'),
  (18, 'rent_burden_ratio'), (19, 'investment_per_sqm'), (20, 'investment_per_person'), (21, 'is_high_competition'),
  (22, 'is_young'), (23, 'is_senior'), (24, 'inexperienced_independent')) t(position, feature)""")
def feature_columns(spark, folder):
    rows = features.derive(mapping.fill_absent(mapping.to_model_names(stores(spark, folder))))
    columns = features.feature_columns(rows)
    # Any value of any row shows that its column is there: counts per column, then numbered names.
    counts = rows.agg(*[F.count(F.lit(1)).alias(c) for c in columns]).unpivot([], columns, "feature", "n")
    position = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature"))
    return counts.filter("n > 0").select(position.cast("int").alias("position"), "feature")


# -- cleaning ---------------------------------------------------------------

RAW = ["age", "experience_years", "initial_investment", "monthly_rent", "store_size_sqm", "employee_count",
       "nearby_competitor_count", "gender", "has_related_experience", "is_franchise", "biz_status_cd"]
MODEL_ROWS = f"""SELECT biz_id, category_large AS business_category, category_mid AS business_sub_category,
  adong_name AS district, {', '.join(RAW)} FROM stores"""
FILLED = """SELECT * REPLACE (coalesce(monthly_rent, (SELECT median(monthly_rent) FROM model_rows)) AS monthly_rent),
  'bachelor' AS education_level, 'medium' AS floating_population_level, 0::BIGINT AS has_startup_experience,
  50000000e0 AS initial_capital FROM model_rows"""


def fence_sql(source: str, column: str) -> str:
    return f"""SELECT * FROM {source} WHERE {column} BETWEEN
      (SELECT quantile_cont({column}, 0.25) - 3 * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) FROM {source})
      AND (SELECT quantile_cont({column}, 0.75) + 3 * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) FROM {source})"""


CLEAN_STEPS = {
    "model_rows": MODEL_ROWS, "filled": FILLED, "fenced_1": fence_sql("filled", "initial_investment"),
    "fenced_2": fence_sql("fenced_1", "monthly_rent"), "clean": fence_sql("fenced_2", "store_size_sqm"),
}
CLEAN_COLUMNS = ["biz_id", "business_category", "district", "age", "experience_years", "initial_investment",
                 "initial_capital", "monthly_rent", "store_size_sqm", "employee_count", "nearby_competitor_count",
                 "gender", "education_level", "floating_population_level", "has_related_experience",
                 "has_startup_experience", "is_franchise", "biz_status_cd"]


def model_rows(spark, folder) -> DataFrame:
    return mapping.to_model_names(stores(spark, folder))


@query("dedupe_rows", with_stores("""
SELECT gender, category_large, adong_name, biz_status_cd, age FROM stores GROUP BY ALL"""))
def dedupe_rows(spark, folder):
    # The timestamp is bookkeeping and must not keep copies apart.
    rows = stores(spark, folder).select("gender", "category_large", "adong_name", "biz_status_cd", "age", "collected_at")
    return cleaning.drop_copies(rows).drop("collected_at")


@query("impute_median", with_stores(
    "SELECT round(median(monthly_rent), 4) AS monthly_rent, median(age) AS age, median(store_size_sqm) AS store_size_sqm FROM stores"))
def impute_median(spark, folder):
    # The passes of the search read the joined rows once written, instead of joining (and broadcasting) again each time.
    names = ["monthly_rent", "age", "store_size_sqm"]
    rows = stage(stores(spark, folder).select(*names), "numbers")
    middle = cleaning.medians(rows, names)
    one = rows.agg(F.count(F.lit(1)))
    return one.select(*[F.lit(v).alias(k) for k, v in middle.items()]).withColumn("monthly_rent", F.round("monthly_rent", 4))


@query("fill_nulls", with_stores("""
SELECT biz_id, round(monthly_rent, 4) AS monthly_rent, age, coalesce(business_category, 'unknown') AS business_category, is_franchise
FROM (SELECT * REPLACE (CASE WHEN CAST(biz_id AS BIGINT) % 9 = 0 THEN NULL ELSE business_category END AS business_category,
      CASE WHEN CAST(biz_id AS BIGINT) % 8 = 0 THEN 0 ELSE is_franchise END AS is_franchise) FROM filled)""",
    model_rows=MODEL_ROWS, filled=FILLED))
def fill_nulls(spark, folder):
    n = F.col("biz_id").cast("bigint")
    rows = model_rows(spark, folder).withColumns({
        "business_category": F.when(n % 9 != 0, F.col("business_category")),
        "is_franchise": F.when(n % 8 != 0, F.col("is_franchise"))})
    return rounded(cleaning.fill_nulls(rows), 4, "monthly_rent").select(
        "biz_id", "monthly_rent", F.col("age").cast("bigint").alias("age"), "business_category", "is_franchise")


@query("iqr_outliers", with_stores("SELECT biz_id, round(monthly_rent, 4) AS monthly_rent, store_size_sqm FROM clean", **CLEAN_STEPS))
def iqr_outliers(spark, folder):
    rows = stage(cleaning.fill_nulls(mapping.fill_absent(model_rows(spark, folder))), "filled")
    return rounded(cleaning.remove_outliers(rows).select("biz_id", "monthly_rent", "store_size_sqm"), 4, "monthly_rent")


@query("cast_types", with_stores("""
SELECT biz_id, CASE WHEN CAST(biz_id AS BIGINT) % 6 = 0 THEN 0 ELSE age END AS age,
  CASE WHEN CAST(biz_id AS BIGINT) % 7 = 0 THEN 0e0 ELSE store_size_sqm END AS store_size_sqm, employee_count FROM stores"""))
def cast_types(spark, folder):
    n = F.col("biz_id").cast("bigint")
    text = stores(spark, folder).select(
        "biz_id", F.when(n % 6 == 0, "none").otherwise(F.concat(F.col("age").cast("string"), F.lit(".7"))).alias("age"),
        F.when(n % 7 == 0, None).otherwise(F.col("store_size_sqm").cast("string")).alias("store_size_sqm"),
        F.col("employee_count").cast("string").alias("employee_count"))
    return cleaning.cast_types(text)


CLEAN_SELECT = ", ".join(
    f"round({c}, 4) AS {c}" if c in ("monthly_rent", "initial_investment") else c for c in CLEAN_COLUMNS)


@query("clean_all", with_stores(f"SELECT {CLEAN_SELECT} FROM clean", **CLEAN_STEPS))
def clean_all(spark, folder):
    return rounded(stages.clean_stage(stores(spark, folder)), 4, "monthly_rent", "initial_investment").select(*CLEAN_COLUMNS)


# -- labels -----------------------------------------------------------------

PROFIT_RATE = f"(0.1e0 + {uniform_sql('biz_id', 'profit|42')} * 0.2e0)"
LABEL_STEPS = {
    "with_revenue": """SELECT *, CAST(coalesce(CASE business_category WHEN 'food' THEN 15000000 WHEN 'retail' THEN 20000000
        WHEN 'service' THEN 10000000 WHEN 'it' THEN 25000000 WHEN 'education' THEN 12000000 END, 12000000) AS BIGINT)
        AS monthly_revenue FROM clean""",
    "with_profit": f"SELECT *, CAST(floor(monthly_revenue * {PROFIT_RATE}) AS BIGINT) AS monthly_profit FROM with_revenue",
    "labelled": """SELECT *, CASE WHEN biz_status_cd = '03' THEN 0e0 ELSE 1e0 END AS survival_1yr,
        CASE WHEN biz_status_cd = '01' THEN 1e0 ELSE 0e0 END AS survival_3yr,
        least(1e0, greatest(0e0, 0.3e0 * least(1e0, greatest(0e0, 12 * monthly_rent / (initial_investment + 1)))
          + 0.2e0 * least(1e0, nearby_competitor_count / 30e0) + 0.2e0 * (1 - has_related_experience)
          + CASE WHEN age < 25 THEN 0.15e0 WHEN age > 60 THEN 0.1e0 ELSE 0e0 END)) AS risk_score,
        CAST(least(60, greatest(1, trunc(initial_investment / CASE WHEN monthly_profit = 0 THEN 1 ELSE monthly_profit END)))
          AS BIGINT) AS break_even_months FROM with_profit""",
}
RAW_AS_CLEAN = {"clean": MODEL_ROWS}


@query("label_survival", with_stores("SELECT biz_id, survival_1yr, survival_3yr FROM labelled", **RAW_AS_CLEAN, **LABEL_STEPS))
def label_survival(spark, folder):
    return labels.label_survival(model_rows(spark, folder)).select("biz_id", "survival_1yr", "survival_3yr")


@query("label_survival_hash", with_stores(f"""
SELECT biz_id, CASE WHEN {uniform_sql('biz_id', 'survival_1yr|42')} < 0.7e0 THEN 1e0 ELSE 0e0 END AS survival_1yr,
  CASE WHEN {uniform_sql('biz_id', 'survival_3yr|42')} < 0.5e0 THEN 1e0 ELSE 0e0 END AS survival_3yr FROM stores"""))
def label_survival_hash(spark, folder):
    rows = model_rows(spark, folder).drop("biz_status_cd")
    return labels.label_survival(rows).select("biz_id", "survival_1yr", "survival_3yr")


@query("lookup_revenue", with_stores("SELECT biz_id, business_category, monthly_revenue FROM with_revenue", **RAW_AS_CLEAN, **LABEL_STEPS))
def lookup_revenue(spark, folder):
    return labels.label_revenue(model_rows(spark, folder)).select("biz_id", "business_category", "monthly_revenue")


@query("label_revenue", with_stores("SELECT biz_id, monthly_revenue, monthly_profit FROM with_profit", **RAW_AS_CLEAN, **LABEL_STEPS))
def label_revenue(spark, folder):
    return labels.label_revenue(model_rows(spark, folder)).select("biz_id", "monthly_revenue", "monthly_profit")


@query("label_risk", with_stores(
    "SELECT biz_id, round(risk_score, 6) AS risk_score FROM labelled", **CLEAN_STEPS, **LABEL_STEPS))
def label_risk(spark, folder):
    return rounded(labels.label_risk(stages.clean_stage(stores(spark, folder))).select("biz_id", "risk_score"), 6, "risk_score")


@query("label_break_even", with_stores("SELECT biz_id, break_even_months FROM labelled", **RAW_AS_CLEAN, **LABEL_STEPS))
def label_break_even(spark, folder):
    return labels.label_break_even(labels.label_revenue(model_rows(spark, folder))).select("biz_id", "break_even_months")


LABELS = """biz_id, survival_1yr, survival_3yr, monthly_revenue, monthly_profit, round(risk_score, 6) AS risk_score,
  break_even_months"""


@query("label_all", with_stores(f"SELECT {LABELS} FROM labelled", **CLEAN_STEPS, **LABEL_STEPS))
def label_all(spark, folder):
    out = stages.label_stage(stages.clean_stage(stores(spark, folder)))
    return rounded(out.select("biz_id", *schemas.TARGETS), 6, "risk_score")


# -- features ---------------------------------------------------------------

DERIVED = """SELECT *, 12 * monthly_rent / CASE WHEN initial_investment = 0 THEN 1 ELSE initial_investment END AS rent_burden_ratio,
  initial_investment / CASE WHEN store_size_sqm = 0 THEN 1 ELSE store_size_sqm END AS investment_per_sqm,
  initial_investment / (employee_count + 1) AS investment_per_person,
  CAST(nearby_competitor_count > 10 AS BIGINT) AS is_high_competition, CAST(age < 30 AS BIGINT) AS is_young,
  CAST(age >= 50 AS BIGINT) AS is_senior,
  CAST(has_related_experience = 0 AND is_franchise = 0 AS BIGINT) AS inexperienced_independent FROM {source}"""


@query("derived_features", with_stores("""
SELECT biz_id, round(rent_burden_ratio, 6) AS rent_burden_ratio, round(investment_per_sqm, 4) AS investment_per_sqm,
  round(investment_per_person, 4) AS investment_per_person, is_high_competition, is_young, is_senior, inexperienced_independent
FROM derived""", clean=MODEL_ROWS, derived=DERIVED.format(source="clean")))
def derived_features(spark, folder):
    out = features.derive(model_rows(spark, folder)).select("biz_id", *schemas.DERIVED)
    return rounded(rounded(out, 6, "rent_burden_ratio"), 4, "investment_per_sqm", "investment_per_person")


def classes_sql(source: str, columns) -> str:
    union = " UNION ".join(f"SELECT '{c}' AS column_name, coalesce({c}, 'unknown') AS class FROM {source}" for c in columns)
    return f"""SELECT column_name, class, CAST(row_number() OVER (PARTITION BY column_name ORDER BY class) - 1 AS BIGINT) AS idx
      FROM ({union})"""


ENCODED = ["gender", "business_category", "business_sub_category", "district"]


@query("encoder_fit", with_stores(classes_sql("model_rows", ENCODED), model_rows=MODEL_ROWS))
def encoder_fit(spark, folder):
    return features.fit_encoder(model_rows(spark, folder))


# Classes are learned from the male half, so the other half brings unseen districts and a gender.
HALF = "SELECT * FROM model_rows WHERE gender = 'M'"


@query("encode_label", with_stores("""
SELECT biz_id, coalesce(g.idx, -1) AS gender, coalesce(b.idx, -1) AS business_category, coalesce(d.idx, -1) AS district
FROM model_rows LEFT JOIN classes g ON g.column_name = 'gender' AND g.class = gender
LEFT JOIN classes b ON b.column_name = 'business_category' AND b.class = business_category
LEFT JOIN classes d ON d.column_name = 'district' AND d.class = district""",
    model_rows=MODEL_ROWS, half=HALF, classes=classes_sql("half", ENCODED)))
def encode_label(spark, folder):
    rows = model_rows(spark, folder)
    classes = features.fit_encoder(rows.filter("gender = 'M'"))
    return features.encode(rows, classes).select("biz_id", "gender", "business_category", "district")


@query("decode_label", with_stores("""
SELECT biz_id, CASE WHEN gender = 'M' THEN 'M' ELSE 'unknown' END AS gender, business_category,
  CASE WHEN district IN (SELECT district FROM half) THEN district ELSE 'unknown' END AS district
FROM model_rows""", model_rows=MODEL_ROWS, half=HALF))
def decode_label(spark, folder):
    rows = model_rows(spark, folder)
    classes = features.fit_encoder(rows.filter("gender = 'M'"))
    columns = ["gender", "business_category", "district"]
    return features.decode(features.encode(rows, classes, columns), classes, columns).select("biz_id", *columns)


@query("encoder_choice", with_stores("""
SELECT column_name, n_classes, CASE WHEN n_classes <= 5 THEN 'onehot' ELSE 'label' END AS encoder FROM (
  SELECT 'gender' AS column_name, count(DISTINCT gender) AS n_classes FROM stores
  UNION ALL SELECT 'business_category', count(DISTINCT category_large) FROM stores
  UNION ALL SELECT 'business_sub_category', count(DISTINCT category_mid) FROM stores
  UNION ALL SELECT 'district', count(DISTINCT adong_name) FROM stores)"""))
def encoder_choice(spark, folder):
    return features.choose_encoders(model_rows(spark, folder))


@query("encode_onehot", with_stores("""
SELECT biz_id, business_category, CAST(category_large = 'food' AS DOUBLE) AS business_category_food,
  CAST(category_large = 'it' AS DOUBLE) AS business_category_it, CAST(category_large = 'other' AS DOUBLE) AS business_category_other,
  CAST(category_large = 'retail' AS DOUBLE) AS business_category_retail,
  CAST(category_large = 'service' AS DOUBLE) AS business_category_service
FROM (SELECT *, category_large AS business_category FROM stores)"""))
def encode_onehot(spark, folder):
    rows = model_rows(spark, folder).select("biz_id", "business_category")
    values = features.short_class_list(rows, "business_category")
    coded = features.onehot(rows, "business_category", values).drop("business_category")
    return features.onehot_inverse(coded, "business_category", values)


NUMBERS = ["age", "experience_years", "initial_investment", "store_size_sqm", "employee_count", "nearby_competitor_count"]


@query("scaler_fit", with_stores(" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature, round(avg({c}), 4) AS centre, round(sqrt(var_pop({c})), 4) AS scale FROM stores"
    for i, c in enumerate(NUMBERS))))
def scaler_fit(spark, folder):
    rows = stores(spark, folder)
    out = features.scaler_table(rows, features.fit_standard(rows, NUMBERS)).drop("variance")
    return rounded(out, 4, "centre", "scale")


@query("robust_fit", with_stores(" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature, round(median({c}), 4) AS centre, "
    f"round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS scale FROM stores"
    for i, c in enumerate(NUMBERS))))
def robust_fit(spark, folder):
    rows = stores(spark, folder)
    out = features.scaler_table(rows, features.fit_robust(rows, NUMBERS)).drop("variance")
    return rounded(out, 4, "centre", "scale")


def scaled_sql(centre: str, scale: str) -> str:
    return "SELECT biz_id, " + ", ".join(
        f"round(({c} - (SELECT {centre.format(c=c)} FROM stores)) / (SELECT {scale.format(c=c)} FROM stores), 5) AS {c}"
        for c in NUMBERS) + " FROM stores"


@query("scale_standard", with_stores(scaled_sql("avg({c})", "sqrt(var_pop({c}))")))
def scale_standard(spark, folder):
    rows = stores(spark, folder)
    return rounded(features.scale(rows, features.fit_standard(rows, NUMBERS)).select("biz_id", *NUMBERS), 5, *NUMBERS)


@query("scale_robust", with_stores(scaled_sql("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))")))
def scale_robust(spark, folder):
    rows = stores(spark, folder)
    return rounded(features.scale(rows, features.fit_robust(rows, NUMBERS)).select("biz_id", *NUMBERS), 5, *NUMBERS)


@query("unscale_standard", with_stores(
    "SELECT biz_id, " + ", ".join(f"round(CAST({c} AS DOUBLE), 3) AS {c}" for c in NUMBERS) + " FROM stores"))
def unscale_standard(spark, folder):
    rows = stores(spark, folder)
    scaler = features.fit_standard(rows, NUMBERS)
    return rounded(features.unscale(features.scale(rows, scaler), scaler).select("biz_id", *NUMBERS), 3, *NUMBERS)


ALL_ENCODED = schemas.CATEGORICAL
ENCODED_ROWS = "SELECT derived.* REPLACE (" + ", ".join(f"{c}_t.idx AS {c}" for c in ALL_ENCODED) + ") FROM derived " + " ".join(
    f"JOIN classes {c}_t ON {c}_t.column_name = '{c}' AND {c}_t.class = derived.{c}" for c in ALL_ENCODED)
FITTED = "SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN var_pop({c}) > 0 THEN sqrt(var_pop({c})) ELSE 1e0 END AS s_{c}"
    for c in schemas.FEATURES) + " FROM encoded"


@query("features_all", with_stores(
    "SELECT biz_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 4) AS {c}" for c in schemas.FEATURES)
    + ", survival_1yr, survival_3yr, monthly_revenue, monthly_profit, round(risk_score, 6) AS risk_score, break_even_months"
    + " FROM encoded, fitted",
    **CLEAN_STEPS, **LABEL_STEPS, derived=DERIVED.format(source="labelled"),
    classes=classes_sql("derived", ALL_ENCODED), encoded=ENCODED_ROWS, fitted=FITTED))
def features_all(spark, folder):
    rows = stage(stages.label_stage(stages.clean_stage(stores(spark, folder))), "labelled")
    state = stages.fit_features(rows)
    out = stages.transform_features(rows, state, ["biz_id"])
    return rounded(rounded(out, 4, *schemas.FEATURES), 6, "risk_score")


