"""Numbering and top-k that never sort everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from storegrain.session import stage


def top_k(df: DataFrame, groups: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group; each task keeps at most ``k`` per group before the shuffle."""
    window = Window.partitionBy(*groups).orderBy(*order) if groups else Window.orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def top_values(df: DataFrame, groups: list[str], value: str, k: int, *, keep_null: bool = False,
               weight: str | None = None) -> DataFrame:
    """The ``k`` most frequent values of a column per group: groups, value, n, rank.

    Ties go to the smaller value. With ``keep_null`` a null takes part in the
    ranking and is dropped afterwards, so it may use up a place. ``weight`` names a
    column of counts where the rows were counted before.
    """
    data = df if keep_null else df.filter(F.col(value).isNotNull())
    counts = data.groupBy(*groups, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    if not groups:
        # One group: an ordered limit is a bounded top-k, an open window is not.
        best = counts.orderBy(F.desc("n"), F.asc_nulls_last(value)).limit(k)
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc_nulls_last(value))))
    else:
        ranked = top_k(counts, groups, [F.desc("n"), F.asc_nulls_last(value)], k)
    return ranked.filter(F.col(value).isNotNull() & (F.col(value) != ""))


def listed(tops: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """Rows of ``top_values`` as one text per group: ``value(n), value(n)``; lists of at most k items."""
    item = F.struct("rank", F.concat(F.col(value), F.lit("("), F.format_number("n", 0), F.lit(")")).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), ", ")
    return tops.groupBy(*groups).agg(text.alias(name)) if groups else tops.agg(text.alias(name))


def global_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based position in the sorted order of a unique key.

    Rows are range-partitioned, numbered inside each range and shifted by
    the sizes of the ranges before it: one number per partition is all the
    driver sees. The ranges are written first, so a repeated task cannot see others.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = stage(ranged, "ranges")
    sizes = {r[0]: r[1] for r in ranged.groupBy("_range").count().collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    table = df.sparkSession.createDataFrame(offsets, "_range int, _offset bigint")
    window = Window.partitionBy("_range").orderBy(*order)
    numbered = ranged.withColumn(name, F.row_number().over(window) - 1)
    # One row per partition of the shuffle above.
    return numbered.join(F.broadcast(table), "_range").withColumn(
        name, F.col(name) + F.col("_offset")).drop("_range", "_offset")
