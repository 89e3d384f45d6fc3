"""Category and district statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from storegrain.functions.columns import contains_text, first_present, lookup
from storegrain.operators.ranking import listed, top_k, top_values
from storegrain.schemas import ACTIVE, CATEGORY_SYNONYMS, CLOSED, SUSPENDED
from storegrain.session import stage

# Where a frame may keep each role; the first present column is used.
CATEGORY = ("category_large", "indsLclsCdNm", "business_category", "indsLclsNm")
SUB_CATEGORY = ("category_mid", "indsMclsCdNm", "business_sub_category")
DISTRICT = ("adong_name", "adongNm", "district")
STATUS = ("biz_status_cd", "b_stt_cd", "b_stt")


def role(df: DataFrame, candidates) -> str:
    name = first_present(df.columns, candidates)
    if name is None:
        raise ValueError(f"none of {candidates} is present")
    return name


def scan_stores(df: DataFrame, category: str | None = None, district: str | None = None) -> DataFrame:
    """Rows whose category and district contain the given texts."""
    if category:
        df = df.filter(contains_text(role(df, CATEGORY), category))
    if district:
        df = df.filter(contains_text(role(df, DISTRICT), district))
    return df


def keyword_match(value, keyword, synonyms: dict[str, str] | None = None) -> Column:
    """Containment of a keyword or of what it is a synonym for; null never matches."""
    keyword = F.lit(keyword) if isinstance(keyword, str) else keyword
    term = F.coalesce(lookup(synonyms or CATEGORY_SYNONYMS, F.lower(keyword)), keyword)
    return contains_text(value, term)


def status_counts(status: str) -> dict[str, Column]:
    code = F.col(status)
    return {
        "active": F.count(F.when(code == ACTIVE, 1)),
        "suspended": F.count(F.when(code == SUSPENDED, 1)),
        "closed": F.count(F.when(code == CLOSED, 1)),
    }


def percent(part, whole, empty: float | None = None) -> Column:
    """100 * part / whole in double; ``empty`` where the whole is 0."""
    value = F.try_divide(part.cast("double") * 100, whole.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def _rates(empty: float | None) -> dict[str, Column]:
    decided = F.col("active") + F.col("closed")
    return {
        "survival_rate": percent(F.col("active"), decided, empty),
        "closure_rate": percent(F.col("closed"), decided, empty),
    }


def store_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_stores"))


def counted(df: DataFrame) -> DataFrame:
    """Rows per distinct category, sub-category, district and status, under those names.

    The profiles below read this small table several times. It is written first, so
    the stores themselves are scanned once.
    """
    roles = {"category": CATEGORY, "sub_category": SUB_CATEGORY, "district": DISTRICT, "status": STATUS}
    columns = [F.col(role(df, names)).alias(name) for name, names in roles.items()]
    return stage(df.select(*columns).groupBy(*roles).agg(F.count("*").alias("n")), "counts")


def _total(condition=None) -> Column:
    n = F.col("n") if condition is None else F.when(condition, F.col("n"))
    return F.coalesce(F.sum(n), F.lit(0))


def _top_text(counts: DataFrame, value: str, k: int, keep_null: bool = False) -> Column:
    tops = top_values(counts, [], value, k, keep_null=keep_null, weight="n")
    return F.coalesce(listed(tops, [], value, "top").scalar(), F.lit(""))


def _leader(counts: DataFrame, value: str) -> Column:
    return top_values(counts, [], value, 1, weight="n").select(value).scalar()


def category_stats(df: DataFrame, category: str | None = None, district: str | None = None) -> DataFrame:
    """One row: total, matches, share, rates (0 where undefined) and the top five sub-categories."""
    counts = counted(df)
    hit = contains_text("category", category) if category else F.lit(True)
    if district:
        hit = hit & contains_text("district", district)
    sums = counts.agg(
        _total().alias("total"), _total(hit).alias("matched"),
        _total(hit & (F.col("status") == ACTIVE)).alias("active"), _total(hit & (F.col("status") == CLOSED)).alias("closed"))
    return sums.select(
        "total", "matched", percent(F.col("matched"), F.col("total"), 0.0).alias("pct"),
        *[c.alias(n) for n, c in _rates(0.0).items()],
        _top_text(counts.filter(hit), "sub_category", 5, keep_null=True).alias("top_sub_categories"))


def district_stats(df: DataFrame, district: str) -> DataFrame:
    """One row: count and the top five categories of the matching districts."""
    counts = counted(df).filter(contains_text("district", district))
    return counts.agg(_total().alias("matched")).withColumn(
        "top_categories", _top_text(counts, "category", 5, keep_null=True))


def overall_stats(df: DataFrame) -> DataFrame:
    counts = counted(df)
    return counts.agg(_total().alias("total"), F.countDistinct("district").alias("n_districts")).withColumn(
        "top_categories", _top_text(counts, "category", 5))


def category_profile(df: DataFrame, category: str) -> DataFrame:
    """Count, most frequent name, top lists and share of a category; no row if nothing matches."""
    counts = counted(df)
    hit = keyword_match("category", category)
    subset = counts.filter(hit)
    return counts.agg(_total(hit).alias("matched"), _total().alias("_all")).filter("matched > 0").select(
        "matched", _leader(subset, "category").alias("matched_name"),
        _top_text(subset, "sub_category", 5).alias("top_sub_categories"), _top_text(subset, "district", 5).alias("top_districts"),
        percent(F.col("matched"), F.col("_all")).alias("pct"))


def district_profile(df: DataFrame, district: str) -> DataFrame:
    subset = counted(df).filter(keyword_match("district", district))
    return subset.agg(_total().alias("matched")).filter("matched > 0").select(
        "matched", _leader(subset, "district").alias("matched_name"), _top_text(subset, "category", 5).alias("top_categories"))


def cross_profile(df: DataFrame, category: str, district: str) -> DataFrame:
    """Category within district: count, share of the district, top three sub-categories."""
    in_district = counted(df).filter(keyword_match("district", district))
    hit = keyword_match("category", category)
    subset = in_district.filter(hit)
    return in_district.agg(_total(hit).alias("matched"), _total().alias("_all")).filter("matched > 0").select(
        "matched", _leader(subset, "category").alias("matched_category"),
        _top_text(subset, "sub_category", 3).alias("top_sub_categories"),
        _leader(subset, "district").alias("matched_district"), percent(F.col("matched"), F.col("_all")).alias("district_pct"))


def cross_table(df: DataFrame) -> DataFrame:
    """Every district and category: count and share of the district."""
    category, district = role(df, CATEGORY), role(df, DISTRICT)
    pairs = df.groupBy(district, category).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(district))
    return pairs.withColumn("district_pct", percent(F.col("n"), whole))


def survival_by(df: DataFrame, *groups: str) -> DataFrame:
    """Status counts and rates per group; no row where nothing is active or closed."""
    counts = df.groupBy(*groups).agg(
        F.count("*").alias("total"), *[c.alias(n) for n, c in status_counts(role(df, STATUS)).items()])
    return counts.filter("active + closed > 0").withColumn(
        "unknown", F.col("total") - F.col("active") - F.col("suspended") - F.col("closed")).withColumns(_rates(None))


def status_pivot(df: DataFrame, *groups: str) -> DataFrame:
    """Counts per status code as columns; the codes are given, so no extra pass looks for them."""
    codes = [ACTIVE, SUSPENDED, CLOSED]
    wide = df.groupBy(*groups).pivot(role(df, STATUS), codes).agg(F.count(F.lit(1)))
    return wide.select(*groups, *[F.coalesce(F.col(c), F.lit(0)).alias(f"n_{c}") for c in codes])


def _finest(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[c.alias(k) for k, c in status_counts(role(df, STATUS)).items()])


def _rolled(grouped, level: Column, extra: list[Column]) -> DataFrame:
    return grouped.agg(
        level.alias("level"), F.sum("n").alias("total"),
        *[F.sum(c).alias(c) for c in ("active", "suspended", "closed")], *extra,
    ).withColumns(_rates(None))


def stats_cube(df: DataFrame) -> DataFrame:
    """All four scopes at once: overall, per category, per district, per pair.

    The rows are first counted per pair, so the cube multiplies the few counts
    and not the rows. ``level`` tells the scopes apart: bit 2 set when the category
    is rolled up, bit 1 when the district is.
    """
    finest = _finest(df.select(
        F.col(role(df, CATEGORY)).alias("category"), F.col(role(df, DISTRICT)).alias("district"),
        F.col(role(df, STATUS)).alias("biz_status_cd")), ["category", "district"])
    return _rolled(finest.cube("category", "district"), F.grouping_id().cast("int"),
                   [F.countDistinct("district").alias("n_districts")])


# Places of the top lists per scope; the pair of a category and a district has shorter ones.
TOP_PLACES = 5
PAIR_PLACES = 3


def scope_tops(df: DataFrame) -> DataFrame:
    """Top lists beside ``stats_cube``: ``level, category, district, top_categories, top_sub_categories, top_districts``.

    Overall and per district the most frequent categories, per category the sub-categories and districts, per
    pair the sub-categories, as ``name(count)`` texts; null where a scope has no such list or no name for it.
    The stores are counted once; every count then stands for its five lists, and each task
    keeps only as many names of a list as it has places before the lists meet.
    """
    nothing = F.lit(None).cast("string")

    def part(level: int, kind: str, category=nothing, district=nothing):
        return F.struct(F.lit(level).alias("level"), category.alias("category"), district.alias("district"),
                        F.lit(kind).alias("kind"), F.col(kind).alias("value"))

    c, d = F.col("category"), F.col("district")
    parts = F.array(part(3, "category"), part(2, "category", district=d), part(1, "sub_category", c),
                    part(1, "district", c), part(0, "sub_category", c, d))
    scope = ["level", "category", "district"]
    lists = counted(df).select(F.explode(parts).alias("p"), "n").select("p.*", "n").filter("value <> ''")
    sums = lists.groupBy(*scope, "kind", "value").agg(F.sum("n").alias("n"))
    best = top_k(sums, [*scope, "kind"], [F.desc("n"), F.asc("value")], TOP_PLACES).filter(
        (F.col("level") > 0) | (F.col("rank") <= PAIR_PLACES))
    item = F.struct("rank", F.concat("value", F.lit("("), F.format_number("n", 0), F.lit(")")).alias("text"))

    def text(kind: str) -> Column:
        items = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item)))
        return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: x["text"]), ", "))

    return best.groupBy(*scope).agg(
        text("category").alias("top_categories"), text("sub_category").alias("top_sub_categories"),
        text("district").alias("top_districts"))


def stats_grouping_sets(df: DataFrame) -> DataFrame:
    """The category and the district scope only."""
    finest = _finest(df.select(
        F.col(role(df, CATEGORY)).alias("category"), F.col(role(df, DISTRICT)).alias("district"),
        F.col(role(df, STATUS)).alias("biz_status_cd")), ["category", "district"])
    keys = [F.col("category"), F.col("district")]
    return _rolled(finest.groupingSets([[keys[0]], [keys[1]]], *keys), F.grouping_id().cast("int"), [])


def stats_rollup(df: DataFrame, keys: list[str]) -> DataFrame:
    """Subtotals along a hierarchy such as province, district, neighbourhood."""
    return _rolled(_finest(df, keys).rollup(*keys), F.grouping_id().cast("int"), [])


def top_lists(df: DataFrame, groups: list[str], value: str, k: int, name: str) -> DataFrame:
    return listed(top_values(df, groups, value, k), groups, value, name)


def category_leaders(df: DataFrame, k: int = 5) -> DataFrame:
    """Top sub-categories per category as rows."""
    return top_values(df, [role(df, CATEGORY)], role(df, SUB_CATEGORY), k)


def limited(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in a fixed order; a bounded top-k in every task."""
    return df.orderBy(*order).limit(n)
