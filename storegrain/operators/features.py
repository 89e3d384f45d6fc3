"""Derived features, encoders and scalers."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from storegrain import schemas
from storegrain.functions.columns import flag, one_if_zero
from storegrain.operators.joins import attach
from storegrain.operators.quantiles import exact_quantiles
from storegrain.operators.ranking import global_index
from storegrain.session import stage

UNKNOWN = "unknown"
UNSEEN = -1
ONEHOT_LIMIT = 5
# Columns of which a sketch sees at most this many values are counted one by one; a sketch of so few is exact but for
# equal hashes, so nothing near ONEHOT_LIMIT is missed.
NEAR_LIMIT = 64
SKETCH_BITS = 12
# Class lists up to this size are numbered in one sort; longer ones range by range.
SINGLE_SORT_CLASSES = 200_000


def derive(df: DataFrame) -> DataFrame:
    """The seven derived features whose inputs are present."""
    have = set(df.columns)
    new: dict[str, Column] = {}
    if {"monthly_rent", "initial_investment"} <= have:
        new["rent_burden_ratio"] = F.col("monthly_rent") * 12 / one_if_zero("initial_investment")
    if {"initial_investment", "store_size_sqm"} <= have:
        new["investment_per_sqm"] = F.col("initial_investment") / one_if_zero("store_size_sqm")
    if {"initial_investment", "employee_count"} <= have:
        new["investment_per_person"] = F.try_divide(
            F.col("initial_investment").cast("double"), (F.col("employee_count") + 1).cast("double"))
    if "nearby_competitor_count" in have:
        new["is_high_competition"] = flag(F.col("nearby_competitor_count") > 10)
    if "age" in have:
        new["is_young"] = flag(F.col("age") < 30)
        new["is_senior"] = flag(F.col("age") >= 50)
    if {"has_related_experience", "is_franchise"} <= have:
        new["inexperienced_independent"] = flag(
            (F.col("has_related_experience") == 0) & (F.col("is_franchise") == 0))
    return df.withColumns(new)


def feature_columns(df: DataFrame) -> list[str]:
    """The model inputs a frame has, in registry order."""
    return [c for c in schemas.FEATURES if c in df.columns]


# -- label encoding ---------------------------------------------------------

def fit_encoder(df: DataFrame, columns=None, single_sort: int = SINGLE_SORT_CLASSES) -> DataFrame:
    """Class table ``(column_name, class, idx)``: sorted distinct values of every column.

    One pass for all columns; null counts as the class ``unknown``.
    """
    columns = [c for c in (columns or schemas.CATEGORICAL) if c in df.columns]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias("class"))
        for c in columns
    ])
    classes = df.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    classes = stage(classes, "classes")
    longest = classes.groupBy("column_name").count().agg(F.max("count")).first()[0] or 0
    if longest <= single_sort:
        window = Window.partitionBy("column_name").orderBy("class")
        numbered = classes.withColumn("idx", (F.row_number().over(window) - 1).cast("bigint"))
        return stage(numbered, "encoder")
    numbered = [
        global_index(classes.filter(F.col("column_name") == c), ["class"], "idx") for c in columns
    ]
    return stage(reduce(DataFrame.unionByName, numbered).select("column_name", "class", "idx"), "encoder")


def encode(df: DataFrame, classes: DataFrame, columns=None, null_is_unknown: bool = True) -> DataFrame:
    """Replace values by their class number; -1 for a value not seen in fitting.

    One left join for each column, so the rows are read once however long a class list is.
    """
    columns = [c for c in (columns or schemas.CATEGORICAL) if c in df.columns]
    order = df.columns
    for name in columns:
        table = classes.filter(F.col("column_name") == name).select(F.col("class").alias(name), F.col("idx").alias("_idx"))
        if null_is_unknown:
            df = df.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit(UNKNOWN)))
        df = attach(df, table, name)
        df = df.withColumn(name, F.coalesce("_idx", F.lit(UNSEEN).cast("bigint"))).drop("_idx")
    return df.select(*order)


def decode(df: DataFrame, classes: DataFrame, columns=None) -> DataFrame:
    """Class numbers back to values; -1 becomes ``unknown``."""
    columns = [c for c in (columns or schemas.CATEGORICAL) if c in df.columns]
    order = df.columns
    for name in columns:
        table = classes.filter(F.col("column_name") == name).select(F.col("idx").alias(name), F.col("class").alias("_class"))
        df = attach(df, table, name)
        df = df.withColumn(name, F.coalesce("_class", F.lit(UNKNOWN))).drop("_class")
    return df.select(*order)


def class_sketches(df: DataFrame, columns=None) -> DataFrame:
    """``(column_name, sketch)``: a mergeable sketch of the distinct values of every column, from one pass.

    Some kilobytes each: written beside a run, they are united with those of other runs by
    ``unite_sketches`` without reading the rows again.
    """
    columns = [c for c in (columns or schemas.CATEGORICAL) if c in df.columns]
    wide = df.agg(*[F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS).alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "sketch")


def unite_sketches(sketches: DataFrame) -> DataFrame:
    """``(column_name, sketch)`` of the values of all runs together."""
    return sketches.groupBy("column_name").agg(F.hll_union_agg("sketch").alias("sketch"))


def choose_encoders(df: DataFrame, columns=None, approximate: bool = False, sketches: DataFrame | None = None) -> DataFrame:
    """``(column_name, n_classes, encoder)``: few classes get one-hot, others labels.

    The sketches (of ``df``, or handed over) tell long columns from short ones. The decision is always exact: columns
    whose estimate is near the limit are counted as sets, which are small by then. The number of classes of a long column is
    counted exactly too, unless ``approximate`` asks for the estimate; values combine in the tasks before the shuffle.
    """
    columns = [c for c in (columns or schemas.CATEGORICAL) if c in df.columns]
    sketches = class_sketches(df, columns) if sketches is None else sketches.filter(F.col("column_name").isin(columns))
    # One row for each column.
    guess = dict(sketches.select("column_name", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0))).collect())
    short = [c for c in columns if guess[c] <= NEAR_LIMIT]
    long = [c for c in columns if c not in short]
    counts = dict(guess)
    if short:
        sets = df.agg(*[F.size(F.collect_set(F.col(c).cast("string"))).alias(c) for c in short]).first()
        counts |= sets.asDict()
    if long and not approximate:
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("class")) for c in long])
        classes = df.select(F.explode(pairs).alias("p")).select("p.*").filter("class IS NOT NULL").distinct()
        counts |= dict(classes.groupBy("column_name").count().collect())
    rows = [(c, int(counts[c]), "onehot" if counts[c] <= ONEHOT_LIMIT else "label") for c in columns]
    return df.sparkSession.createDataFrame(rows, "column_name string, n_classes bigint, encoder string")


def onehot(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """One 0/1 column per class of a short list; an unseen value is all zeros."""
    value = F.coalesce(F.col(name).cast("string"), F.lit(UNKNOWN))
    return df.withColumns({f"{name}_{v}": flag(value == v).cast("double") for v in values})


def onehot_inverse(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """The class whose column is 1, or null for a row of zeros."""
    back = F.coalesce(*[F.when(F.col(f"{name}_{v}") == 1, F.lit(v)) for v in values])
    return df.withColumn(name, back)


def short_class_list(df: DataFrame, name: str, limit: int = ONEHOT_LIMIT) -> list[str]:
    """Sorted classes of a column that was chosen for one-hot; at most ``limit`` are fetched."""
    value = F.coalesce(F.col(name).cast("string"), F.lit(UNKNOWN)).alias("v")
    found = [r[0] for r in df.select(value).distinct().orderBy("v").limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{name} has more than {limit} classes")
    return found


# -- scaling ----------------------------------------------------------------

@dataclass
class Scaler:
    """Per column: what is subtracted and what divides."""

    kind: str
    centre: dict[str, float]
    scale: dict[str, float]
    extra: dict[str, float] = field(default_factory=dict)


def fit_standard(df: DataFrame, columns: list[str]) -> Scaler:
    """Mean and population deviation; a constant column is divided by 1."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)],
    ).first()
    mean = {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(columns)}
    var = {c: float(row[f"v{i}"] or 0.0) for i, c in enumerate(columns)}
    return Scaler("standard", mean, {c: v ** 0.5 if v > 0 else 1.0 for c, v in var.items()}, var)


def fit_robust(df: DataFrame, columns: list[str]) -> Scaler:
    """Median and interquartile range; a range of 0 divides by 1."""
    parts = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    centre = {c: float(q[1] or 0.0) for c, q in parts.items()}
    spread = {c: (q[2] - q[0]) if q[0] is not None else 0.0 for c, q in parts.items()}
    return Scaler("robust", centre, {c: float(s) if s else 1.0 for c, s in spread.items()})


SCALERS = {"standard": fit_standard, "robust": fit_robust}


def scale(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({
        c: (F.col(c).cast("double") - F.lit(m)) / F.lit(scaler.scale[c]) for c, m in scaler.centre.items()
    })


def unscale(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(scaler.scale[c]) + F.lit(m) for c, m in scaler.centre.items()})


def scaler_table(df: DataFrame, scaler: Scaler) -> DataFrame:
    """The fitted numbers as rows ``(position, feature, mean, scale, var)``."""
    rows = [
        (i, c, float(m), float(scaler.scale[c]), scaler.extra.get(c))
        for i, (c, m) in enumerate(scaler.centre.items())
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, feature string, centre double, scale double, variance double")


def scaler_from_table(table: DataFrame, kind: str = "standard") -> Scaler:
    rows = table.orderBy("position").collect()  # one row per feature
    return Scaler(
        kind, {r.feature: r.centre for r in rows}, {r.feature: r.scale for r in rows},
        {r.feature: r.variance for r in rows if r.variance is not None},
    )
