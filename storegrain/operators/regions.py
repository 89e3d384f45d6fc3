"""Region codes: ten digits = province 2, district 3, neighbourhood 3, village 2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from storegrain.functions.columns import any_of, lookup
from storegrain.schemas import PROVINCES

# Names of subtotal rows.
SUBTOTALS = ("소계", "합계", "")


def part(code, start: int, length: int) -> Column:
    return F.substring(code, start, length)


def last_word(name) -> Column:
    return F.element_at(F.split(F.trim(F.col(name)), " +"), -1)


def provinces(register: DataFrame) -> DataFrame:
    """Province rows: everything after the first two digits is zero."""
    return register.filter(part("region_cd", 3, 8) == "00000000").select(
        "region_cd", part("region_cd", 1, 2).alias("sido_cd"), F.col("locatadd_nm").alias("sido_nm"))


def districts(register: DataFrame, sido_cd: str) -> DataFrame:
    """District rows of one province."""
    keep = (
        (part("region_cd", 1, 2) == sido_cd)
        & (part("region_cd", 6, 5) == "00000")
        & (part("region_cd", 3, 3) != "000")
    )
    return register.filter(keep).select(
        "region_cd", part("region_cd", 1, 2).alias("sido_cd"), part("region_cd", 3, 3).alias("sgg_cd"),
        last_word("locatadd_nm").alias("sgg_nm"), F.col("locatadd_nm").alias("full_nm"))


def neighbourhoods(register: DataFrame, sido_cd: str | None = None, sgg_cd: str | None = None) -> DataFrame:
    """Neighbourhood rows with the code taken apart; village rows are left out."""
    keep = (part("region_cd", 6, 3) != "000") & (part("region_cd", 9, 2) == "00")
    if sido_cd:
        keep = keep & (part("region_cd", 1, 2) == sido_cd)
    if sgg_cd:
        keep = keep & (part("region_cd", 3, 3) == sgg_cd)
    active = F.coalesce(F.col("flag"), F.lit("Y")) if "flag" in register.columns else F.lit("Y")
    return register.filter(keep).select(
        "region_cd", part("region_cd", 1, 2).alias("sido_cd"), part("region_cd", 3, 3).alias("sgg_cd"),
        part("region_cd", 6, 3).alias("dong_cd"), last_word("locatadd_nm").alias("dong_nm"),
        F.col("locatadd_nm").alias("full_nm"), active.alias("flag"))


def search_regions(register: DataFrame, text: str) -> DataFrame:
    """Active regions whose full name contains a text."""
    hit = F.contains(F.col("locatadd_nm"), F.lit(text))
    if "flag" in register.columns:
        hit = hit & (F.coalesce(F.col("flag"), F.lit("Y")) == "Y")
    return register.filter(hit)


def aggregate_level(code: str = "region_cd_8") -> Column:
    """Whether an eight-digit code stands for a province or district; null counts as no."""
    return F.coalesce(F.endswith(F.col(code), F.lit("0000")), F.lit(False))


def dong_codes(regions: DataFrame, sido_cd: str | None = None) -> DataFrame:
    if sido_cd:
        regions = regions.filter(F.col("sido_cd") == sido_cd)
    return regions.filter(~aggregate_level()).select("region_cd_8")


def region_targets(regions: DataFrame, sido_cd: str | None = None, sgg_filter: list[str] | None = None,
                   dong_filter: list[str] | None = None) -> DataFrame:
    """Codes to collect, from either kind of region file; column ``code``."""
    have = regions.columns
    if sido_cd and "sido_cd" in have:
        regions = regions.filter(F.col("sido_cd") == sido_cd)
    if "region_cd_8" in have:
        regions = regions.filter(~aggregate_level())
    elif "region_cd" in have:
        regions = regions.filter(
            (F.length("region_cd") == 10) & (part("region_cd", 6, 3) != "000") & (part("region_cd", 9, 2) == "00"))
    if "dong_nm" in have:
        regions = regions.filter(~F.coalesce(F.col("dong_nm").isin(*SUBTOTALS), F.lit(False)))
    if "flag" in have:
        regions = regions.filter(F.col("flag") == "Y")
    if sgg_filter and "full_nm" in have:
        regions = regions.filter(any_of([F.contains(F.col("full_nm"), F.lit(s)) for s in sgg_filter]))
    if dong_filter and "dong_nm" in have:
        regions = regions.filter(F.col("dong_nm").isin(*dong_filter))
    return regions.select(F.col("region_cd_8" if "region_cd_8" in have else "region_cd").alias("code"))


def resolve_province(regions: DataFrame, text: str, name: str = "sido_nm", codes: dict[str, str] | None = None,
                     default: str = "00") -> DataFrame:
    """One row: the province called ``text``, else the first whose name contains it, and its code."""
    names = regions.filter(F.contains(F.col(name), F.lit(text))).select(name).distinct()
    best = names.orderBy((F.col(name) != text), F.col(name)).limit(1)
    return best.withColumn("sido_cd", lookup(codes or PROVINCES, name, default))


def normalize_codes(df: DataFrame, code: str = "hdong_cd", sido: str = "sido_nm", sgg: str = "sgg_nm",
                    dong: str = "dong_nm") -> DataFrame:
    """Ten-digit administrative codes in the layout of the region table."""
    return df.select(
        F.col(code).alias("region_cd"), part(code, 1, 8).alias("region_cd_8"), part(code, 1, 2).alias("sido_cd"),
        part(code, 3, 3).alias("sgg_cd"), part(code, 6, 3).alias("dong_cd"), F.col(sido).alias("sido_nm"),
        F.col(sgg).alias("sgg_nm"), F.col(dong).alias("dong_nm"),
        F.concat(F.col(sido), F.lit(" "), F.col(sgg), F.lit(" "), F.col(dong)).alias("full_nm"))


def page_completeness(pages: DataFrame) -> DataFrame:
    """Per request: rows read so far, rows promised, and whether reading may stop.

    ``pages(request, page, page_size, total, n_rows)``; a request is complete when
    its rows reach the promised total, or its last page is short and no page before it is missing.
    """
    grouped = pages.groupBy("request").agg(
        F.count("*").alias("n_pages"), F.sum("n_rows").alias("n_rows"), F.max("total").alias("total"),
        F.max_by(F.col("n_rows") < F.col("page_size"), "page").alias("short_end"),
        (F.countDistinct("page") == F.max("page") - F.min("page") + 1).alias("no_gap"))
    return grouped.withColumn(
        "complete", (F.col("n_rows") >= F.col("total")) | (F.col("short_end") & F.col("no_gap"))).drop("no_gap")


def collection_log(targets: DataFrame, rows: DataFrame, code: str = "dong_code", now=None,
                   attempts: DataFrame | None = None) -> DataFrame:
    """One log row per requested neighbourhood, also for those without a store.

    ``attempts(code, error)`` is what was landed for a neighbourhood, one row per answer, ``error`` null for a
    readable one (``files.landed_attempts``). A neighbourhood with a failed answer, or asked in
    vain, counts as ``fail`` even if other answers brought stores: its rows are not whole. The message names every different error.
    """
    counts = rows.groupBy(code).agg(F.count("*").alias("store_count"))
    joined = targets.join(counts, code, "left")
    n = F.coalesce(F.col("store_count"), F.lit(0))
    error = F.lit(None).cast("string")
    if attempts is not None:
        # Equal errors of a neighbourhood combine before the shuffle, so one that failed often is not gathered.
        errors = attempts.groupBy(code, "error").agg(F.count("*").alias("n"))
        text = F.when(F.col("error").isNotNull(), F.concat("error", F.when(F.col("n") > 1, F.concat(F.lit(" x"), F.col("n").cast("string"))).otherwise("")))
        message = F.array_join(F.array_sort(F.collect_list(text)), "; ")
        errors = errors.groupBy(code).agg(F.lit(True).alias("tried"), message.alias("message"))
        joined = joined.join(errors, code, "left")
        error = F.when(F.col("tried").isNull(), "no answer landed").when(F.col("message") != "", F.col("message"))
    return joined.select(
        F.col(code).alias("dong_cd"), F.col("dong_name"), n.alias("store_count"),
        F.when(error.isNotNull(), "fail").when(n > 0, "success").otherwise("no_data").alias("status"),
        error.alias("error_msg"), (F.current_timestamp() if now is None else now).alias("collected_at"))


def response_rate(requested: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """One row: keys asked for, keys answered, percentage."""
    asked = requested.select(key).filter(F.col(key).isNotNull()).distinct()
    got = answered.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_got", F.lit(1))
    counts = asked.join(got, key, "left").agg(F.count("*").alias("requested"), F.count("_got").alias("answered"))
    return counts.withColumn("pct", F.coalesce(
        F.try_divide(F.col("answered") * F.lit(100.0), F.col("requested").cast("double")), F.lit(0.0)))
