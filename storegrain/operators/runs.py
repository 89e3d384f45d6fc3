"""Run-scoped tables and the training log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storegrain.operators.joins import last_write


def run_list(df: DataFrame, run: str = "pipeline_run_id", stamp: str = "created_at") -> DataFrame:
    """Each run with its newest timestamp; a short table."""
    return df.groupBy(run).agg(F.max(stamp).alias("last_at"))


def latest_run(df: DataFrame, run: str = "pipeline_run_id", stamp: str = "created_at") -> DataFrame:
    """One row with the newest run; ties go to the larger id."""
    return df.agg(F.max_by(run, F.struct(stamp, run)).alias(run))


def newest_runs(df: DataFrame, keep: int, run: str = "pipeline_run_id", stamp: str = "created_at") -> DataFrame:
    return run_list(df, run, stamp).orderBy(F.desc("last_at"), F.desc(run)).limit(keep).select(run)


def retain_runs(df: DataFrame, keep: int = 1, run: str = "pipeline_run_id", stamp: str = "created_at") -> DataFrame:
    """Rows of the newest ``keep`` runs; ``keep`` may be 0."""
    return df.join(newest_runs(df, keep, run, stamp), run, "left_semi").select(*df.columns)


def dropped_rows(df: DataFrame, keep: int = 1, run: str = "pipeline_run_id", stamp: str = "created_at") -> DataFrame:
    """How many rows a retention removes."""
    old = df.join(newest_runs(df, keep, run, stamp), run, "left_anti")
    return old.agg(F.count("*").alias("n_deleted"))


def scan_run(df: DataFrame, run_id: str | None = None, run: str = "pipeline_run_id",
             stamp: str = "created_at", leave_out=()) -> DataFrame:
    """Rows of one run, the newest if none is named. A partition filter on run-partitioned tables."""
    wanted = F.lit(run_id) if run_id is not None else latest_run(df, run, stamp).scalar()
    return df.filter(F.col(run) == wanted).drop(*leave_out)


def run_state(events: DataFrame) -> DataFrame:
    """Current state of every training run from its event rows.

    The newest event gives the status; metrics, paths and messages keep the last
    value given; a run is completed at its last ``completed`` or ``failed`` event.
    """
    order = F.struct("event_ts", *(["event_id"] if "event_id" in events.columns else []), "status")
    ended = F.col("status").isin("completed", "failed")
    columns = [F.max_by("status", order).alias("status"), F.min("event_ts").alias("started_at"),
               F.max(F.when(ended, F.col("event_ts"))).alias("completed_at")]
    for name in events.columns:
        if name in ("run_id", "status", "event_ts", "event_id"):
            continue
        columns.append(F.max_by(name, F.when(F.col(name).isNotNull(), order)).alias(name))
    return events.groupBy("run_id").agg(*columns)


def latest_completed(state: DataFrame) -> DataFrame:
    """The newest completed run per model type."""
    done = state.filter(F.col("status") == "completed")
    return last_write(done, "model_type", [F.desc("completed_at"), F.desc("run_id")])
