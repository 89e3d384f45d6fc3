"""Exact quantiles of columns of any size.

``percentile`` keeps every distinct value of a column in one task, so it is used
only where the number of values is known to be small. The other columns are laid
out as rows ``(column, value)`` and searched together: the wanted positions are
bracketed with the bounded ``percentile_approx`` sketch, the rows below and inside
the brackets are counted, and the brackets are narrowed until the distinct values
left inside are few. The number of passes does not depend on the number of columns,
and no pass shuffles more than partial aggregates.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

DIRECT_VALUES = 500_000
GATHER_VALUES = 50_000
ACCURACY = 10_000


def _usable(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    if dict(df.dtypes)[name] in ("double", "float"):
        return F.when(~F.isnan(column), column)
    return column


@dataclass(frozen=True)
class _Span:
    """Values of column ``key`` between ``low`` and ``high``; ``below`` rows lie under them."""

    key: int
    low: object
    high: object
    below: int
    inside: int


def value_counts_bound(df: DataFrame, names: list[str]) -> dict[str, int]:
    """About how many distinct values each column has, for all columns in one pass.

    Filtering rows later can only lower these numbers, so one measurement serves several calls.
    """
    if not names:
        return {}
    usable = df.select([_usable(df, n).alias(n) for n in names])
    row = usable.agg(*[F.approx_count_distinct(n).alias(f"d{i}") for i, n in enumerate(names)]).first()
    return {n: row[f"d{i}"] for i, n in enumerate(names)}


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], *, bound: dict[str, int] | None = None,
                    direct: int = DIRECT_VALUES, gather: int = GATHER_VALUES) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles, nulls and NaN left out; None for an empty column. Columns come in the order they were asked for.

    ``bound`` passes on the result of ``value_counts_bound``.
    """
    names = list(wanted)
    if not names:
        return {}
    bound = value_counts_bound(df, names) if bound is None else bound
    usable = df.select([_usable(df, n).alias(n) for n in names])
    small = [n for n in names if bound[n] <= direct]
    result: dict[str, list[float | None]] = {}
    if small:
        row = usable.agg(*[
            F.percentile(n, F.array(*[F.lit(float(p)) for p in wanted[n]])).alias(n) for n in small
        ]).first()
        for n in small:
            result[n] = list(row[n]) if row[n] is not None else [None] * len(wanted[n])
    large = [n for n in names if n not in small]
    totals = usable.agg(*[F.count(n).alias(n) for n in large]).first() if large else {}
    spots = {n: [p * (totals[n] - 1) for p in wanted[n]] for n in large if totals[n]}
    ranks = {n: sorted({r for h in s for r in (math.floor(h), math.ceil(h))}) for n, s in spots.items()}
    values = ranked_values(usable, ranks, {n: totals[n] for n in ranks}, gather=gather)
    for name in large:
        found = values.get(name)
        result[name] = [None] * len(wanted[name]) if found is None else [
            found[math.floor(h)] + (found[math.ceil(h)] - found[math.floor(h)]) * (h - math.floor(h))
            for h in spots[name]
        ]
    return {n: result[n] for n in names}


def values_at_ranks(df: DataFrame, name: str, ranks: list[int], total: int, *,
                    gather: int = GATHER_VALUES) -> dict[int, object]:
    """The values at 0-based positions of the sorted, non-null column."""
    return ranked_values(df, {name: ranks}, {name: total}, gather=gather)[name]


def ranked_values(df: DataFrame, ranks: dict[str, list[int]], totals: dict[str, int], *,
                  gather: int = GATHER_VALUES) -> dict[str, dict[int, object]]:
    """The values at 0-based positions of several sorted, non-null columns.

    Columns of one type share every pass; whole numbers are compared as such, so no digit is lost.
    """
    families: dict[T.DataType, list[str]] = defaultdict(list)
    for name in ranks:
        kind = df.schema[name].dataType
        if isinstance(kind, T.IntegralType):
            kind = T.LongType()
        elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            kind = T.DoubleType()
        families[kind].append(name)
    found: dict[str, dict[int, object]] = {}
    for kind, names in families.items():
        pairs = F.array(*[
            F.struct(F.lit(i).alias("key"), F.col(n).cast(kind).alias("value")) for i, n in enumerate(names)])
        data = df.select(F.explode(pairs).alias("p")).select("p.*").filter("value IS NOT NULL")
        places = _search(data, kind, [ranks[n] for n in names], [totals[n] for n in names], gather)
        found |= {n: {r: places[i, r] for r in ranks[n]} for i, n in enumerate(names)}
    return found


def _table(data: DataFrame, kind: T.DataType, rows: list[tuple], numbers: list[str]) -> DataFrame:
    """A few spans or cuts, ``(key, low, high)`` and whole numbers, as a table small enough for every task."""
    fields = [T.StructField("key", T.IntegerType()), T.StructField("low", kind), T.StructField("high", kind)]
    schema = T.StructType(fields + [T.StructField(n, T.LongType()) for n in numbers])
    return F.broadcast(data.sparkSession.createDataFrame(rows, schema))


def _within(data: DataFrame, table: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Rows beside each span of their column that holds them."""
    return data.join(table, "key").filter(F.col("value").between(F.col(low), F.col(high)))


def _search(data: DataFrame, kind: T.DataType, ranks: list[list[int]], totals: list[int],
            gather: int) -> dict[tuple[int, int], object]:
    ends = {r["key"]: r for r in data.groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()}
    spans = {
        (key, rank): _Span(key, ends[key]["low"], ends[key]["high"], 0, totals[key])
        for key, wanted in enumerate(ranks) for rank in wanted}
    found: dict[tuple[int, int], object] = {}
    ready: dict[tuple[int, int], _Span] = {}
    while True:
        for place, span in list(spans.items()):
            if span.low == span.high:
                found[place] = spans.pop(place).low
            elif span.inside <= gather:
                ready[place] = spans.pop(place)
        if not spans:
            return found | _gathered(data, kind, ready)
        spans = _narrowed(data, kind, spans)


def _narrowed(data: DataFrame, kind: T.DataType, spans: dict[tuple[int, int], _Span]) -> dict[tuple[int, int], _Span]:
    """One round for all positions: a sketch of every span, then counts around the brackets it gives."""
    margin = 2.0 / ACCURACY
    bundles: dict[_Span, list[int]] = defaultdict(list)
    for (_, rank), span in sorted(spans.items(), key=lambda item: item[0]):
        bundles[span].append(rank)
    order = list(bundles)
    # Neighbouring positions of a span, such as both sides of a median, share one bracket.
    brackets: list[tuple[int, list[int]]] = []
    for s, span in enumerate(order):
        for rank in bundles[span]:
            if brackets and brackets[-1][0] == s and rank - brackets[-1][1][-1] <= 1:
                brackets[-1][1].append(rank)
            else:
                brackets.append((s, [rank]))
    shares = [
        (max(0.0, (members[0] - order[s].below) / order[s].inside - margin),
         min(1.0, (members[-1] - order[s].below + 1) / order[s].inside + margin)) for s, members in brackets]
    steps = sorted({p for pair in shares for p in pair})
    table = _table(data, kind, [(s.key, s.low, s.high, i) for i, s in enumerate(order)], ["span"])
    sketch = dict(_within(data, table).groupBy("span").agg(
        F.percentile_approx("value", F.array(*[F.lit(p) for p in steps]), ACCURACY).alias("at")).collect())

    # The sketch works in doubles, so big integers come back a little off: keep to the span.
    cuts = [
        tuple(min(max(sketch[s][steps.index(p)], order[s].low), order[s].high) for p in pair)
        for (s, _), pair in zip(brackets, shares)]
    fields = [T.StructField("key", T.IntegerType()), T.StructField("low", kind), T.StructField("high", kind),
              T.StructField("cut", T.IntegerType()), T.StructField("cut_low", kind), T.StructField("cut_high", kind)]
    rows = [(order[s].key, order[s].low, order[s].high, i, *cuts[i]) for i, (s, _) in enumerate(brackets)]
    table = F.broadcast(data.sparkSession.createDataFrame(rows, T.StructType(fields)))
    value, low, high = F.col("value"), F.col("cut_low"), F.col("cut_high")
    counts = {r["cut"]: r for r in _within(data, table).groupBy("cut").agg(
        F.count(F.when(value < low, 1)).alias("under"),
        F.count(F.when(value == low, 1)).alias("at_low"),
        F.count(F.when((value > low) & (value < high), 1)).alias("between"),
        F.count(F.when((value == high) & (value > low), 1)).alias("at_high"),
        F.max(F.when(value < low, value)).alias("before_low"),
        F.min(F.when(value > low, value)).alias("after_low"),
        F.max(F.when(value < high, value)).alias("before_high"),
        F.min(F.when(value > high, value)).alias("after_high")).collect()}

    narrowed = {}
    for i, (s, members) in enumerate(brackets):
        old, (low, high), n = order[s], cuts[i], counts[i]
        under = old.below + n["under"]
        start = under + n["at_low"]
        end = start + n["between"]
        last = end + n["at_high"]
        for rank in members:
            # Every branch leaves out at least the copies of one end, so spans shrink until they close.
            if rank < under:
                span = _Span(old.key, old.low, n["before_low"], old.below, under - old.below)
            elif rank < start:
                span = _Span(old.key, low, low, under, start - under)
            elif rank < end:
                span = _Span(old.key, n["after_low"], n["before_high"], start, end - start)
            elif rank < last:
                span = _Span(old.key, high, high, end, last - end)
            else:
                span = _Span(old.key, n["after_high"], old.high, last, old.below + old.inside - last)
            narrowed[old.key, rank] = span
    return narrowed


def _gathered(data: DataFrame, kind: T.DataType, ready: dict[tuple[int, int], _Span]) -> dict[tuple[int, int], object]:
    """Running counts over the distinct values of spans that are known to hold few."""
    if not ready:
        return {}
    order = list(dict.fromkeys(ready.values()))
    table = _table(data, kind, [(s.key, s.low, s.high, i, s.below) for i, s in enumerate(order)], ["span", "below"])
    counts = _within(data, table).groupBy("span", "below", "value").agg(F.count("*").alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("span").orderBy("value"))
    places = data.sparkSession.createDataFrame(
        [(order.index(span), key, rank) for (key, rank), span in ready.items()], "span long, key int, rank long")
    hits = counts.withColumn("upto", upto).join(F.broadcast(places), "span").filter(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return {(r["key"], r["rank"]): r["value"] for r in hits.select("key", "rank", "value").collect()}
