"""Train, validation and test parts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from storegrain.functions.columns import draw, ordinal_draw
from storegrain.operators.quantiles import values_at_ranks
from storegrain.session import stage


def split_sizes(n: int, val_ratio: float = 0.1, test_ratio: float = 0.1) -> dict[str, int]:
    """Exact sizes: test first, then validation from what is left, both rounded up."""
    test = math.ceil(n * test_ratio)
    val = math.ceil((n - test) * (val_ratio / (1 - test_ratio)))
    return {"train": n - test - val, "val": val, "test": test}


def assign_split(df: DataFrame, key: str, val_ratio: float = 0.1, test_ratio: float = 0.1, seed: int = 42,
                 exact: bool = False) -> DataFrame:
    """Adds ``split``. A row's part depends on its key only, so new rows move nobody.

    With ``exact`` the parts have the sizes of ``split_sizes``: the rows with the
    smallest draws are the test part, the next ones validation. The two limits are
    positions in the sorted draws and are found without a sort.
    Keys must be unique for the sizes to come out exactly.
    """
    if not exact:
        u = draw(key, f"split|{seed}")
        part = F.when(u < test_ratio, "test").when(u < test_ratio + val_ratio, "val").otherwise("train")
        return df.withColumn("split", part)
    drawn = df.withColumn("_draw", ordinal_draw(key, f"split|{seed}"))
    # The draws alone, written once: each pass of the search then reads eight bytes per row.
    draws = stage(drawn.select("_draw"), "draws")
    total = draws.count()
    sizes = split_sizes(total, val_ratio, test_ratio)
    ends = {name: end - 1 for name, end in
            (("test", sizes["test"]), ("val", sizes["test"] + sizes["val"])) if end > 0}
    values = values_at_ranks(draws, "_draw", sorted(set(ends.values())), total) if ends else {}
    part = F.lit("train")
    for name in ("val", "test"):
        if name in ends and sizes[name]:
            part = F.when(F.col("_draw") <= values[ends[name]], name).otherwise(part)
    return drawn.withColumn("split", part).drop("_draw")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))
