"""Applicant requests: validation, model input, synthetic applicants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from storegrain.functions.columns import draw, kept
from storegrain.functions.risk import recommendations, risk_factors, tidy_scores

# Request limits and defaults.
AGE_RANGE = (18, 80)
NON_NEGATIVE = ("experience_years", "initial_investment", "monthly_rent", "store_size_sqm", "employee_count")
REQUIRED = ("founder_age", "business_category", "initial_investment", "district")
REQUEST_DEFAULTS = {
    "founder_gender": "M", "founder_education": "bachelor", "experience_years": 0, "has_related_experience": False,
    "business_sub_category": "", "monthly_rent": 0, "store_size_sqm": 0.0, "employee_count": 0, "is_franchise": False,
}
ASSUMED_COMPETITORS = 5
ASSUMED_POPULATION = "medium"


def with_request_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in REQUEST_DEFAULTS.items()})


def violations(columns) -> Column:
    """Names of the broken rules, empty for a valid request."""
    rules = [(F.col(c).isNull() if c in columns else F.lit(True), f"{c} missing") for c in REQUIRED]
    rules.append((~F.col("founder_age").between(*AGE_RANGE), "founder_age out of range"))
    rules += [(F.col(c) < 0, f"{c} negative") for c in NON_NEGATIVE if c in columns]
    return kept(rules)


def validate_requests(df: DataFrame) -> DataFrame:
    """Adds ``violations`` and ``is_valid``; split on the latter."""
    return df.withColumn("violations", violations(df.columns)).withColumn("is_valid", F.size("violations") == 0)


def to_model_input(df: DataFrame, competitors: str | None = None) -> DataFrame:
    """Requests as model rows. Competitors are assumed unless a counted column is named."""
    df = with_request_defaults(df)
    carried = ["request_id"] if "request_id" in df.columns else []
    near = F.coalesce(F.col(competitors), F.lit(ASSUMED_COMPETITORS)) if competitors else F.lit(ASSUMED_COMPETITORS)
    return df.select(
        *carried,
        F.col("founder_age").cast("bigint").alias("age"), F.col("founder_gender").alias("gender"),
        F.col("founder_education").alias("education_level"), F.col("experience_years").cast("bigint").alias("experience_years"),
        F.col("has_related_experience").cast("bigint").alias("has_related_experience"),
        F.lit(0).cast("bigint").alias("has_startup_experience"),
        F.col("initial_investment").cast("double").alias("initial_capital"), "business_category", "business_sub_category",
        "district", F.col("store_size_sqm").cast("double").alias("store_size_sqm"),
        F.col("initial_investment").cast("double").alias("initial_investment"),
        F.col("monthly_rent").cast("double").alias("monthly_rent"), F.col("employee_count").cast("bigint").alias("employee_count"),
        F.col("is_franchise").cast("bigint").alias("is_franchise"), near.cast("bigint").alias("nearby_competitor_count"),
        F.lit(ASSUMED_POPULATION).alias("floating_population_level"))


def postprocess(df: DataFrame, digits: int | None = 4) -> DataFrame:
    """Score columns in their final form, risk level, factors and recommendations."""
    out = df.withColumns(tidy_scores(df.columns, digits))
    out = out.withColumn("risk_factors", risk_factors(df.columns))
    return out.withColumn("recommendations", recommendations("risk_factors"))


# Synthetic applicants.
DISTRICTS = ["강남구", "서초구", "마포구", "종로구", "영등포구", "성동구"]
CHOICES = {
    "gender": (["M", "F"], [0.5, 0.5]),
    "education_level": (["high_school", "bachelor", "master"], [0.3, 0.55, 0.15]),
    "has_related_experience": ([0, 1], [0.4, 0.6]),
    "has_startup_experience": ([0, 1], [0.7, 0.3]),
    "business_category": (["food", "retail", "service", "it", "education"], [0.2] * 5),
    "business_sub_category": (["cafe", "chicken", "beauty", "academy", "online"], [0.2] * 5),
    "district": (DISTRICTS, [1 / 6] * 6),
    "is_franchise": ([0, 1], [0.6, 0.4]),
    "floating_population_level": (["low", "medium", "high"], [1 / 3] * 3),
}
INTEGERS = {
    "age": (20, 65), "experience_years": (0, 25), "initial_capital": (10_000_000, 500_000_000),
    "initial_investment": (10_000_000, 300_000_000), "monthly_rent": (500_000, 10_000_000),
    "employee_count": (0, 10), "nearby_competitor_count": (0, 30),
}
SIZES = (10.0, 150.0)


def choose(u: Column, values: list, weights: list[float]) -> Column:
    """The value whose share of [0, 1) holds ``u``."""
    edge, out = 0.0, None
    for value, weight in list(zip(values, weights))[:-1]:
        edge += weight
        out = F.when(u < edge, value) if out is None else out.when(u < edge, value)
    return out.otherwise(values[-1])


def synthetic_applicants(ids: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """One drawn applicant per id; the same on every partitioning."""
    def u(name):
        return draw(key, f"{name}|{seed}")

    columns = {n: choose(u(n), *spec) for n, spec in CHOICES.items()}
    for name in ("has_related_experience", "has_startup_experience", "is_franchise"):
        columns[name] = columns[name].cast("bigint")
    for name, (low, high) in INTEGERS.items():
        columns[name] = F.lit(low).cast("bigint") + F.floor(u(name) * (high - low)).cast("bigint")
    columns["store_size_sqm"] = F.lit(SIZES[0]) + u("store_size_sqm") * (SIZES[1] - SIZES[0])
    return ids.select(key, *[c.alias(n) for n, c in columns.items()])


def applicants(spark, n: int, seed: int = 42) -> DataFrame:
    return synthetic_applicants(spark.range(n), "id", seed)
