"""Replacing the stretches of a text that spans cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.llm.common import unpacked


def _stretches(spans: str):
    """Spans (start, end) as disjoint stretches (lo, hi) in order; those that touch or overlap are one."""
    return F.aggregate(
        F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("lo"), s["end"].alias("hi")))),
        F.array().cast("array<struct<lo:bigint,hi:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["hi"] >= s["lo"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
                F.element_at(done, -1)["lo"].alias("lo"), F.greatest(F.element_at(done, -1)["hi"], s["hi"]).alias("hi"))))
        ).otherwise(F.concat(done, F.array(s))))


def cut_spans(found: DataFrame, columns: list[str], text_col: str, spans: str, mark: str) -> DataFrame:
    """Packed rows with ``spans`` of their text to the rows' ``columns``, the text with ``mark`` for each stretch; a null text stays null."""
    edges = found.withColumn("cut", _stretches(spans))
    parts = F.transform(F.sequence(F.lit(0), F.size("cut")), lambda i: F.substring(
        F.col("text"), F.when(i == 0, 1).otherwise(F.get("cut", i - 1)["hi"] + 1).cast("int"),
        (F.coalesce(F.get("cut", i)["lo"], F.char_length("text").cast("long"))
         - F.when(i == 0, 0).otherwise(F.get("cut", i - 1)["hi"])).cast("int")))
    return unpacked(edges, columns, text_col, F.when(F.size("cut") > 0, F.array_join(parts, mark)).otherwise(F.col("text")))
