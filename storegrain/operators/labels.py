"""Targets a model learns: survival, revenue, risk, break-even."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storegrain.functions.columns import clip, draw, first_present, flag, lookup, one_if_zero
from storegrain.schemas import ACTIVE, CLOSED, SUSPENDED

STATUS_COLUMNS = ("b_stt_cd", "biz_status_cd")

# Monthly revenue by category.
REVENUE_BY_CATEGORY = {
    "food": 15_000_000,
    "retail": 20_000_000,
    "service": 10_000_000,
    "it": 25_000_000,
    "education": 12_000_000,
}
DEFAULT_REVENUE = 12_000_000


def has_closures(df: DataFrame) -> bool:
    """Whether any row is known to be closed or suspended; stops at the first."""
    status = first_present(df.columns, STATUS_COLUMNS)
    return status is not None and not df.filter(F.col(status).isin(SUSPENDED, CLOSED)).select(status).isEmpty()


def label_survival(df: DataFrame, key: str = "biz_id", seed: int = 42, closures: bool | None = None) -> DataFrame:
    """From the status codes where closures are known, otherwise drawn per key."""
    status = first_present(df.columns, STATUS_COLUMNS)
    if has_closures(df) if closures is None else closures:
        code = F.col(status)
        one = flag(~code.eqNullSafe(F.lit(CLOSED)))
        three = flag(code == ACTIVE)
    else:
        one = flag(draw(key, f"survival_1yr|{seed}") < 0.7)
        three = flag(draw(key, f"survival_3yr|{seed}") < 0.5)
    return df.withColumns({"survival_1yr": one.cast("double"), "survival_3yr": three.cast("double")})


def label_revenue(df: DataFrame, key: str = "biz_id", seed: int = 42) -> DataFrame:
    """Category revenue and a drawn profit, unless revenue is already there."""
    if "monthly_revenue" in df.columns:
        return df
    if "business_category" in df.columns:
        revenue = lookup(REVENUE_BY_CATEGORY, "business_category", DEFAULT_REVENUE)
    else:
        revenue = F.lit(DEFAULT_REVENUE)
    rate = F.lit(0.1) + draw(key, f"profit|{seed}") * F.lit(0.2)
    return df.withColumns({
        "monthly_revenue": revenue.cast("bigint"),
        "monthly_profit": (revenue * rate).cast("bigint"),
    })


def label_risk(df: DataFrame) -> DataFrame:
    """Weighted sum of rent share, competition, inexperience and age, clipped to 0..1.

    What is clipped is a column of its own first: ``clip`` reads its value twice, and written out each time the labels
    of all targets grow into one generated method of more than 8,000 bytes, which the JVM does not compile.
    """
    have = set(df.columns)
    risk, parts = F.lit(0.0), {}
    if {"monthly_rent", "initial_investment"} <= have:
        parts["__share"] = F.col("monthly_rent") * 12 / (F.col("initial_investment") + 1)
        risk = risk + clip(F.col("__share"), 0.0, 1.0) * 0.3
    if "nearby_competitor_count" in have:
        parts["__crowd"] = F.col("nearby_competitor_count") / 30
        risk = risk + clip(F.col("__crowd"), 0.0, 1.0) * 0.2
    if "has_related_experience" in have:
        risk = risk + (1 - F.col("has_related_experience")) * 0.2
    if "age" in have:
        risk = risk + F.when(F.col("age") < 25, 0.15).when(F.col("age") > 60, 0.1).otherwise(0.0)
    out = df.withColumns(parts).withColumn("__risk", risk).withColumn("risk_score", clip(F.col("__risk"), 0.0, 1.0))
    return out.drop("__risk", *parts)


def label_break_even(df: DataFrame) -> DataFrame:
    """Months until the investment is earned back, 1 to 60; 18 where inputs are absent."""
    if {"monthly_profit", "initial_investment"} <= set(df.columns):
        raw = df.withColumn("__months", (F.col("initial_investment") / one_if_zero("monthly_profit")).cast("bigint"))
        return raw.withColumn("break_even_months", clip(F.col("__months"), 1, 60).cast("bigint")).drop("__months")
    return df.withColumn("break_even_months", F.lit(18).cast("bigint"))


def label_all(df: DataFrame, key: str = "biz_id", seed: int = 42) -> DataFrame:
    df = label_survival(df, key, seed)
    df = label_revenue(df, key, seed)
    return label_break_even(label_risk(df))
