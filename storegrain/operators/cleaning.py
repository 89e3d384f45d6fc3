"""Deduplicate, impute, remove outliers, cast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from storegrain import schemas
from storegrain.operators.quantiles import exact_quantiles

# Columns that say when or under which number a row was stored, not what it is.
BOOKKEEPING = ("id", "collected_at", "updated_at", "cleaned_at", "labeled_at", "pipeline_run_id")
OUTLIER_COLUMNS = ("initial_investment", "monthly_rent", "store_size_sqm")
INTEGER_COLUMNS = ("age", "experience_years", "employee_count", "nearby_competitor_count")
FLOAT_COLUMNS = ("store_size_sqm", "initial_investment", "monthly_rent", "initial_capital")


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def drop_copies(df: DataFrame) -> DataFrame:
    """Rows that agree on every business column, once; ids and timestamps are those of the copy with the smallest ones.

    Copies combine inside each task before the shuffle.
    """
    keys = [c for c in df.columns if c not in BOOKKEEPING]
    rest = [c for c in df.columns if c in BOOKKEEPING]
    if not rest:
        return df.dropDuplicates()
    first = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__first"))
    return first.select(*[F.col(f"__first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def numeric_columns(df: DataFrame, names) -> list[str]:
    return [c for c in names if c in df.columns and _is_number(df, c)]


def medians(df: DataFrame, names=None, bound: dict[str, int] | None = None) -> dict[str, float | None]:
    names = numeric_columns(df, names or schemas.NUMERICAL)
    return {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in names}, bound=bound).items()}


def fill_nulls(df: DataFrame, middle: dict[str, float | None] | None = None,
               bound: dict[str, int] | None = None) -> DataFrame:
    """Numbers get the median, categories ``unknown``, flags 0."""
    middle = medians(df, bound=bound) if middle is None else middle
    changes = {}
    for name in schemas.NUMERICAL:
        if name in df.columns and _is_number(df, name):
            value, known = F.col(name), middle.get(name)
            if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
                value = F.when(~F.isnan(name), value) if known is None else F.nanvl(value, F.lit(float(known)))
            changes[name] = value if known is None else F.coalesce(value, F.lit(float(known)))
    for name in schemas.CATEGORICAL:
        if name in df.columns:
            changes[name] = F.coalesce(F.col(name), F.lit("unknown"))
    for name in schemas.BINARY:
        if name in df.columns:
            changes[name] = F.coalesce(F.col(name), F.lit(0))
    return df.withColumns(changes) if changes else df


def fences(quartiles: list[float | None], width: float = 3.0) -> tuple[float, float] | None:
    """Accepted interval, or None where the middle half is a single value."""
    low, high = quartiles
    spread = high - low
    return None if spread == 0 else (low - width * spread, high + width * spread)


def remove_outliers(df: DataFrame, columns=OUTLIER_COLUMNS, width: float = 3.0,
                    bound: dict[str, int] | None = None) -> DataFrame:
    """Keep rows inside the fences, one column after the other.

    The fences of a column are taken from the rows the earlier columns left, so
    the passes are sequential; each reads one more column. The fences
    end up as literals and reach the scan as pushed filters.
    """
    for name in columns:
        if name not in df.columns or not _is_number(df, name):
            continue
        quartiles = exact_quantiles(df, {name: [0.25, 0.75]}, bound=bound)[name]
        if quartiles[0] is None:
            return df.filter(F.lit(False))
        bounds = fences(quartiles, width)
        if bounds is None:
            continue
        value = F.col(name)
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(name), value)
        df = df.filter(value.between(*bounds))
    return df


def cast_types(df: DataFrame) -> DataFrame:
    """Tolerant casts: text that is no number and numbers out of range become 0; integers are truncated."""
    changes = {}
    for name in INTEGER_COLUMNS + FLOAT_COLUMNS:
        if name in df.columns:
            number = F.col(name).cast("double") if _is_number(df, name) else F.col(name).try_cast("double")
            number = F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))
            changes[name] = F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint")) if name in INTEGER_COLUMNS else number
    return df.withColumns(changes) if changes else df
