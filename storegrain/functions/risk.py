"""Scoring rules: levels, factors, recommendations, score clean-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from storegrain.functions.columns import as_column, kept

# Factor and recommendation texts.
RENT_FACTOR = "임대료가 투자금 대비 과도합니다"
COMPETITION_FACTOR = "경쟁 과밀 지역입니다"
EXPERIENCE_FACTOR = "해당 업종 경험이 부족합니다"
YOUNG_FACTOR = "청년 창업은 통계적 생존율이 낮습니다"
RENT_ADVICE = "임대료가 낮은 인근 지역을 검토하세요"
EXPERIENCE_ADVICE = "프랜차이즈 창업이나 현장 실습을 권장합니다"
DEFAULT_ADVICE = "전반적으로 양호합니다. 마케팅 전략에 집중하세요"


def risk_level(score) -> Column:
    score = as_column(score)
    return (
        F.when(score < 0.3, "LOW").when(score < 0.6, "MEDIUM").when(score < 0.8, "HIGH").otherwise("CRITICAL")
    )


def _input(columns, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in columns else F.lit(default)


def risk_factors(columns) -> Column:
    """Reasons for concern as an array; absent inputs take neutral values."""
    rent = _input(columns, "monthly_rent", 0)
    money = _input(columns, "initial_investment", 1)
    share = F.try_divide((rent * 12).cast("double"), money.cast("double"))
    return kept([
        ((money > 0) & (share > 0.5), RENT_FACTOR),
        (_input(columns, "nearby_competitor_count", 0) > 10, COMPETITION_FACTOR),
        (_input(columns, "has_related_experience", 0) == 0, EXPERIENCE_FACTOR),
        (_input(columns, "age", 30) < 25, YOUNG_FACTOR),
    ])


def recommendations(factors) -> Column:
    factors = as_column(factors)
    advice = kept([
        (F.array_contains(factors, RENT_FACTOR), RENT_ADVICE),
        (F.array_contains(factors, EXPERIENCE_FACTOR), EXPERIENCE_ADVICE),
    ])
    return F.when(F.size(advice) == 0, F.array(F.lit(DEFAULT_ADVICE))).otherwise(advice)


def tidy_scores(columns, digits: int | None = 4) -> dict[str, Column]:
    """Rounded, truncated and floored score columns; heads a model lacks get defaults."""
    def head(name, default):
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in columns else F.lit(default)

    def rounded(value):
        return F.round(value, digits) if digits is not None else value

    return {
        "survival_1yr": rounded(head("survival_1yr", 0.5)),
        "survival_3yr": rounded(head("survival_3yr", 0.3)),
        "monthly_revenue": head("monthly_revenue", 0.0).cast("bigint"),
        "monthly_profit": head("monthly_profit", 0.0).cast("bigint"),
        "risk_score": rounded(head("risk_score", 0.5)),
        "risk_level": risk_level(head("risk_score", 0.5)),
        "break_even_months": F.greatest(F.lit(1), head("break_even_months", 12.0).cast("bigint")).cast("bigint"),
    }


def survival_band(score) -> Column:
    score = as_column(score)
    return F.when(score >= 0.7, "good").when(score >= 0.5, "fair").otherwise("weak")
