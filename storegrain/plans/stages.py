"""Clean, label and feature stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from storegrain import schemas
from storegrain.operators import cleaning, features, labels, mapping
from storegrain.operators.quantiles import value_counts_bound
from storegrain.session import stage
from storegrain.sources import tables


def clean_stage(df: DataFrame) -> DataFrame:
    """Names, copies, defaults, nulls, outliers, types.

    The deduplicated rows are written once: the medians and the three fence passes
    then read single columns instead of repeating the shuffle.
    """
    rows = stage(cleaning.drop_copies(mapping.to_model_names(df)), "distinct")
    # Imputation adds one value to a column and the fences add none; a default is a single value.
    # So one measurement serves all quantile passes.
    distinct = value_counts_bound(rows, cleaning.numeric_columns(rows, schemas.NUMERICAL))
    bound = {c: distinct.get(c, 0) + 1 for c in schemas.NUMERICAL}
    rows = cleaning.fill_nulls(mapping.fill_absent(rows), bound=bound)
    return cleaning.cast_types(cleaning.remove_outliers(rows, bound=bound))


def label_stage(df: DataFrame, key: str = "biz_id", seed: int = 42) -> DataFrame:
    return labels.label_all(df, key, seed)


@dataclass
class FeatureState:
    """What a feature stage learned: class table, scaler, column order."""

    classes: DataFrame
    scaler: features.Scaler

    @property
    def columns(self) -> list[str]:
        return list(self.scaler.centre)

    def save(self, path: str) -> None:
        tables.save_state(path, self.classes, self.scaler)

    @staticmethod
    def load(spark, path: str) -> "FeatureState":
        return FeatureState(*tables.load_state(spark, path))


def fit_features(df: DataFrame, scaler: str = "standard", fit_on: DataFrame | None = None) -> FeatureState:
    """Learn classes and scaling; ``fit_on`` restricts this to training rows."""
    source = features.derive(df if fit_on is None else fit_on)
    classes = features.fit_encoder(source)
    encoded = features.encode(source, classes)
    return FeatureState(classes, features.SCALERS[scaler](encoded, features.feature_columns(encoded)))


def transform_features(df: DataFrame, state: FeatureState, keep: list[str] | None = None) -> DataFrame:
    """Key, features in their fixed order, and targets if present."""
    encoded = features.encode(features.derive(df), state.classes)
    scaled = features.scale(encoded, state.scaler)
    carried = [c for c in (keep or []) if c in df.columns and c not in state.columns]
    targets = [c for c in schemas.TARGETS if c in df.columns]
    return scaled.select(*carried, *state.columns, *targets)


def collect_to_labels(df: DataFrame, root: str, run_id: str) -> DataFrame:
    """Collected rows to the cleaned and labelled tables of one run; older runs go once it is written."""
    spark = df.sparkSession
    clean = clean_stage(df)
    if "biz_status_cd" not in clean.columns and "b_stt_cd" in clean.columns:
        clean = clean.withColumnRenamed("b_stt_cd", "biz_status_cd")
    tables.append_cleaned(clean, f"{root}/cleaned_stores", run_id)
    tables.drop_old_runs(spark, f"{root}/cleaned_stores", 1, "cleaned_at")
    stored = tables.read_runs(spark, f"{root}/cleaned_stores", run_id).drop("cleaned_at", "pipeline_run_id")
    tables.append_labeled(label_stage(stored), f"{root}/labeled_stores", run_id)
    tables.drop_old_runs(spark, f"{root}/labeled_stores", 1, "labeled_at")
    return tables.read_runs(spark, f"{root}/labeled_stores", run_id)


def export_features(df: DataFrame, path: str, state: FeatureState) -> None:
    """Matrix and targets side by side as CSV, and the numbered feature list."""
    targets = [c for c in schemas.TARGETS if c in df.columns]
    df.select(*state.columns, *targets).write.mode("overwrite").option("header", True).csv(f"{path}/features")
    tables.feature_list(df.sparkSession, state.columns).coalesce(1).write.mode("overwrite").option(
        "header", True).csv(f"{path}/feature_columns")
