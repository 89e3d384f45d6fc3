"""Small column helpers."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, functions as F


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def draw(key, salt: str) -> Column:
    """A number in [0, 1) that depends only on ``key`` and ``salt``.

    The same on every partitioning and after a retry, unlike ``rand``.
    """
    digest = F.md5(F.concat(as_column(key).cast("string"), F.lit("|" + salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def ordinal_draw(key, salt: str) -> Column:
    """A 60-bit integer that depends only on ``key`` and ``salt``."""
    digest = F.md5(F.concat(as_column(key).cast("string"), F.lit("|" + salt)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def one_if_zero(value) -> Column:
    value = as_column(value)
    return F.when(value == 0, F.lit(1)).otherwise(value)


def flag(condition: Column) -> Column:
    """0/1 as a number; an undecided condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def clip(value: Column, low=None, high=None) -> Column:
    """``value`` within the bounds; null stays null (``greatest`` and ``least`` would pass over it)."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(value.isNotNull(), bounded)


def lookup(mapping: dict, key, default=None) -> Column:
    """Value of a small fixed map, as a literal instead of a join."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(pairs, as_column(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def contains_text(value, needle) -> Column:
    """Case-insensitive literal containment; null never matches."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.coalesce(F.contains(F.lower(as_column(value)), F.lower(needle)), F.lit(False))


def first_present(columns, candidates) -> str | None:
    """The first candidate a frame has; plan-time only."""
    return next((c for c in candidates if c in columns), None)


def blank_to_null(value) -> Column:
    value = as_column(value).cast("string")
    return F.when(~F.trim(value).isin("", "nan"), value)


def kept(conditions: list[tuple[Column, str]]) -> Column:
    """Array of the texts whose condition holds, in the given order."""
    items = [F.when(F.coalesce(cond, F.lit(False)), F.lit(text)) for cond, text in conditions]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def total_order(columns) -> list[Column]:
    """Descending order over the given columns with nulls last."""
    return [as_column(c).desc_nulls_last() for c in columns]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def fixed_text(value: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value, halves to the even digit.

    ``format_string`` rounds the shortest decimal form up instead: 2.675 is stored as less than that.
    """
    value = value.cast("double")
    size, scale, unit = F.abs(value), 10**digits, 57
    whole = F.floor(size)
    rest = (size - whole) * 2.0**unit  # exact, as are its two words
    left, number = rest.cast("bigint"), whole.cast("bigint")
    low = ((rest - F.floor(rest)) * 2.0**30).cast("bigint")
    for _ in range(digits):
        low = low * 10
        left = left * 10 + F.shiftright(low, 30)
        low = low.bitwiseAND(F.lit(2**30 - 1))
        number, left = number * 10 + F.shiftright(left, unit), left.bitwiseAND(F.lit(2**unit - 1))
    half = F.lit(2 ** (unit - 1))
    up = (left > half) | ((left == half) & ((low > 0) | (number % 2 == 1)))
    number = number + up.cast("bigint")
    point = F.concat(F.lit("."), F.lpad((number % scale).cast("string"), digits, "0")) if digits else F.lit("")
    shown = F.concat(F.when(value < 0, "-").otherwise(""), ((number - number % scale) / scale).cast("bigint").cast("string"), point)
    return F.when(size < 1e9, shown).otherwise(F.format_string(f"%.{digits}f", value))
