"""Keyed merges: the last write wins, columns missing from the batch survive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storegrain.operators.joins import last_write

INSERT_STAMP = "collected_at"
UPDATE_STAMP = "updated_at"


def upsert(target: DataFrame, batch: DataFrame, key: str, order: list, now=None) -> DataFrame:
    """``target`` after the batch was written to it.

    Of several batch rows with one key the first in ``order`` counts. Columns the
    batch has are overwritten, also by null; others keep their value. Rows
    without a key can collide with nothing and are appended. Both sides of the
    join hold a key once, so no key is hot.
    """
    now = F.current_timestamp() if now is None else now
    stamps = [c for c in (INSERT_STAMP, UPDATE_STAMP) if c in target.columns]
    given = [c for c in batch.columns if c in target.columns and c not in stamps]
    # Rows that tie in ``order`` are told apart by their content, so a repeated task picks the same one.
    fresh = last_write(batch.filter(F.col(key).isNotNull()), key, [*order, F.xxhash64(*given)])
    old = target.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.struct(*target.columns).alias("_old"))
    new = fresh.select(F.col(key).alias("_key"), F.struct(*given).alias("_new"))
    both = old.join(new, "_key", "full_outer")
    written = F.col("_new").isNotNull()

    def merged(name: str):
        if name == key:
            return F.col("_key")
        if name in given:
            return F.when(written, F.col(f"_new.{name}")).otherwise(F.col(f"_old.{name}"))
        if name == INSERT_STAMP:
            return F.when(F.col("_old").isNull(), now).otherwise(F.col(f"_old.{name}"))
        if name == UPDATE_STAMP:
            return F.when(written, now).otherwise(F.col(f"_old.{name}"))
        return F.col(f"_old.{name}")

    def typed(column, name):
        return column.cast(target.schema[name].dataType).alias(name)

    merged_rows = both.select(*[typed(merged(c), c) for c in target.columns])
    keyless = batch.filter(F.col(key).isNull()).select(*[
        typed(now if c in stamps else F.col(c) if c in given else F.lit(None), c) for c in target.columns])
    return merged_rows.unionByName(target.filter(F.col(key).isNull())).unionByName(keyless)


def upsert_counts(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """One row: how many keys the batch inserts and how many it updates."""
    keys = batch.select(key).filter(F.col(key).isNotNull()).distinct()
    known = target.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(1))
    return keys.join(known, key, "left").agg(
        F.count(F.when(F.col("_known").isNull(), 1)).alias("inserted"),
        F.count("_known").alias("updated"),
    )


def keys_except(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def keys_intersect(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def union_batches(*batches: DataFrame) -> DataFrame:
    """Rows of all batches; a column a batch lacks is null there."""
    out = batches[0]
    for batch in batches[1:]:
        out = out.unionByName(batch, allowMissingColumns=True)
    return out
