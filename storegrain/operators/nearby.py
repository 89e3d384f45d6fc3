"""Stores around points.

A radius count never pairs all rows of a cell. Rows are first counted per
position; positions are points of the unit sphere, binned in cubes half the radius
wide, so neither the poles nor the 180th meridian is a border. The cubes are joined with
their neighbours. A pair of cubes that lies wholly inside the radius adds its
count as a number. Of the pairs the circle cuts, those with many comparisons are divided into
eighths and judged again, level by level, like the nodes of an octree of counts; only what is then
still cut is compared position by position.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from storegrain.functions.geo import half_chord_limit, within
from storegrain.session import stage

CELLS_PER_RADIUS = 2
# Pairs of cells with more comparisons than this are divided again.
PAIR_LIMIT = 32_768
FINER = 2
MAX_LEVELS = 20
# Relative width of the band around the radius that is left to exact comparison.
SLACK = 1e-9
AXES = ("x", "y", "z")


def stores_in_radius(df: DataFrame, lat: float, lon: float, radius_m: float = 500.0, lat_col: str = "latitude",
                     lon_col: str = "longitude") -> DataFrame:
    """Rows around one point; the bounding box is pushed to the scan."""
    return df.filter(within(F.col(lat_col).cast("double"), F.col(lon_col).cast("double"), lat, lon, radius_m))


def _kind(limit: float) -> Column:
    """Whether two boxes lie inside, outside or across the radius, from bounds that hold for all their points."""
    c = F.col
    far = near = F.lit(0.0)
    for v in AXES:
        gap = F.greatest(F.lit(0.0), c(f"a_{v}0") - c(f"b_{v}1"), c(f"b_{v}0") - c(f"a_{v}1"))
        reach = F.greatest(c(f"a_{v}1") - c(f"b_{v}0"), c(f"b_{v}1") - c(f"a_{v}0"))
        near, far = near + gap * gap, far + reach * reach
    return F.when(far <= 4 * limit * (1 - SLACK), "inside").when(near > 4 * limit * (1 + SLACK), "outside").otherwise("cut")


def _positions(df: DataFrame, group: list[str], lat: str, lon: str) -> DataFrame:
    spots = df.select(*group, F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    spots = spots.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    counted = spots.groupBy(*group, "lat", "lon").agg(F.count("*").alias("n"))
    phi, theta = F.radians("lat"), F.radians("lon")
    # On the unit sphere the squared half chord of two positions needs no further sines.
    return stage(counted.select("*", (F.cos(phi) * F.cos(theta)).alias("x"), (F.cos(phi) * F.sin(theta)).alias("y"),
                                F.sin(phi).alias("z")), "positions")


def _cell(width: float, tag: str) -> list[Column]:
    return [F.floor(F.col(v) / width).alias(f"{tag}{v}") for v in AXES]


def _names(tag: str) -> list[str]:
    return [f"{tag}{v}" for v in AXES]


def _boxes(cells: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Per cell: points, positions and the bounding box of what it holds."""
    ends = [f(v).alias(f"{tag}_{v}{i}") for v in AXES for i, f in enumerate((F.min, F.max))]
    return cells.groupBy(*keys).agg(F.sum("n").alias(f"{tag}_n"), F.count("*").alias(f"{tag}_spots"), *ends)


def _offsets() -> Column:
    """Cell offsets that can hold a point within the radius: the gap between the cells is short enough."""
    reach = range(-CELLS_PER_RADIUS - 1, CELLS_PER_RADIUS + 2)
    steps = [
        F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z"))
        for i in reach for j in reach for k in reach
        if sum(max(abs(d) - 1, 0) ** 2 for d in (i, j, k)) <= CELLS_PER_RADIUS ** 2
    ]
    return F.array(*steps)


def counts_in_radius(centres: DataFrame, points: DataFrame, radius_m: float, group: list[str] | None = None,
                     lat: str = "latitude", lon: str = "longitude", pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """For every distinct position (and group) of ``centres``: the points within the radius.

    Rows without a position, or with NaN for one, are left out.
    """
    group = group or []
    here = _positions(centres, group, lat, lon)
    there = here if points is centres else _positions(points, group, lat, lon)
    limit = half_chord_limit(radius_m)
    # A little wider than the chord asks for, so that rounding never puts a neighbour one cell too far away.
    width = max(2 * math.sqrt(limit) / CELLS_PER_RADIUS, 1e-9) * (1 + 1e-6)
    a, b = _names("a"), _names("b")

    boxes = _boxes(here.select("*", *_cell(width, "a")), [*group, *a], "a").withColumn("_o", F.explode(_offsets()))
    boxes = boxes.withColumns({f"b{v}": F.col(f"a{v}") + F.col(f"_o.{v}") for v in AXES}).drop("_o")
    pairs = boxes.join(_boxes(there.select("*", *_cell(width, "b")), [*group, *b], "b"), [*group, *b])

    found = []
    for level in range(MAX_LEVELS + 1):
        pairs = stage(pairs.withColumn("kind", _kind(limit)).filter("kind <> 'outside'").select(
            *group, *a, *b, "b_n", "kind", (F.col("a_spots") * F.col("b_spots")).alias("work")), "pairs")
        spots_a = here.select(*group, "lat", "lon", *AXES, *_cell(width, "a"))
        spots_b = there.select(*group, *[F.col(v).alias(f"b_{v}") for v in AXES], "n", *_cell(width, "b"))
        whole = pairs.filter("kind = 'inside'").groupBy(*group, *a).agg(F.sum("b_n").alias("m"))
        found.append(spots_a.join(whole, [*group, *a]).select(*group, "lat", "lon", "m"))
        crowded = (F.col("kind") == "cut") & (F.col("work") > pair_limit)
        last = level == MAX_LEVELS or pairs.filter(crowded).isEmpty()
        plain = pairs.filter("kind = 'cut'") if last else pairs.filter((F.col("kind") == "cut") & (F.col("work") <= pair_limit))
        chord = [F.col(v) - F.col(f"b_{v}") for v in AXES]
        near = chord[0] * chord[0] + chord[1] * chord[1] + chord[2] * chord[2] <= 4 * limit
        found.append(
            spots_a.join(plain.select(*group, *a, *b), [*group, *a])
            .join(spots_b, [*group, *b]).filter(near)
            .groupBy(*group, "lat", "lon").agg(F.sum("n").alias("m")))
        if last:
            break
        # The crowded pairs again, with each cell divided FINER times along every axis.
        pa, pb = _names("pa"), _names("pb")
        parents = pairs.filter(crowded).select(
            *group, *[F.col(v).alias(f"p{v}") for v in (*a, *b)])
        fine_a = here.select("*", *_cell(width, "pa"), *_cell(width / FINER, "a"))
        fine_b = there.select("*", *_cell(width, "pb"), *_cell(width / FINER, "b"))
        pairs = parents.join(_boxes(fine_a, [*group, *pa, *a], "a"), [*group, *pa]).join(
            _boxes(fine_b, [*group, *pb, *b], "b"), [*group, *pb])
        width /= FINER

    parts = reduce(DataFrame.unionByName, found).groupBy(*group, "lat", "lon").agg(F.sum("m").alias("m"))
    return here.join(parts, [*group, "lat", "lon"], "left").select(
        *group, F.col("lat").alias(lat), F.col("lon").alias(lon), F.coalesce("m", F.lit(0)).alias("n_within"))


def competitors_in_radius(df: DataFrame, radius_m: float, category: str = "category_large", lat: str = "latitude",
                          lon: str = "longitude", **kw) -> DataFrame:
    """Per position and category: the other stores of that category within the radius."""
    counts = counts_in_radius(df, df, radius_m, [category], lat, lon, **kw)
    return counts.withColumn("n_competitors", F.col("n_within") - 1).drop("n_within")
