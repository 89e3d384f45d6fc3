"""Counts, profiles, cubes and texts over the store view."""

from __future__ import annotations

from pyspark.sql import functions as F

from storegrain.catalog import query
from storegrain.catalog.views import rounded, stores, table, view, with_stores, REQUESTS_SQL, plain
from storegrain.operators import reports, stats
from storegrain.session import stage

CATEGORY, DISTRICT = "food", "nation_1"

RATES = """round(100e0 * active / nullif(active + closed, 0), 6) AS survival_rate,
  round(100e0 * closed / nullif(active + closed, 0), 6) AS closure_rate"""
COUNTS = """count(*) AS total, count(*) FILTER (biz_status_cd = '01') AS active,
  count(*) FILTER (biz_status_cd = '02') AS suspended, count(*) FILTER (biz_status_cd = '03') AS closed"""


def listed_sql(source: str, value: str, k: int, where: str = "true") -> str:
    """One text of the top k values, as ``ranking.listed`` writes it."""
    return f"""coalesce((SELECT string_agg({value} || '(' || format('{{:,}}', n) || ')', ', ' ORDER BY n DESC, {value})
      FROM (SELECT {value}, count(*) AS n FROM {source} WHERE {value} IS NOT NULL AND {where} GROUP BY 1
      ORDER BY n DESC, {value} LIMIT {k})), '')"""


def leader_sql(source: str, value: str, where: str) -> str:
    return f"""(SELECT {value} FROM {source} WHERE {value} IS NOT NULL AND {where} GROUP BY 1
      ORDER BY count(*) DESC, {value} LIMIT 1)"""


IN_CATEGORY = f"contains(lower(category_large), '{CATEGORY}')"
IN_DISTRICT = f"contains(lower(adong_name), '{DISTRICT}')"


@query("survival_stats", with_stores(f"""
SELECT category_large, adong_name, total, active, suspended, closed, total - active - suspended - closed AS unknown, {RATES}
FROM (SELECT category_large, adong_name, {COUNTS} FROM stores GROUP BY 1, 2) WHERE active + closed > 0"""))
def survival_stats(spark, folder):
    out = stats.survival_by(stores(spark, folder), "category_large", "adong_name")
    return rounded(out, 6, "survival_rate", "closure_rate")


@query("scan_stores", with_stores(f"""
SELECT biz_id, store_name, category_large, adong_name, biz_status_cd FROM stores WHERE {IN_CATEGORY} AND {IN_DISTRICT}"""))
def scan_stores(spark, folder):
    return stats.scan_stores(stores(spark, folder), CATEGORY, DISTRICT).select(
        "biz_id", "store_name", "category_large", "adong_name", "biz_status_cd")


@query("keyword_match", with_stores("""
SELECT biz_id, contains(lower(category_large), 'retail') AS by_synonym, contains(lower(category_mid), 'low') AS by_text
FROM stores"""))
def keyword_match(spark, folder):
    # The view has English names, so its synonyms map to those.
    synonyms = {"shop": "retail", "cafe": "food"}
    return stores(spark, folder).select(
        "biz_id", stats.keyword_match("category_large", "Shop", synonyms).alias("by_synonym"),
        stats.keyword_match("category_mid", "LOW", synonyms).alias("by_text"))


@query("store_count", with_stores("SELECT count(*) AS n_stores FROM stores"))
def store_count(spark, folder):
    return stats.store_count(stores(spark, folder))


@query("category_stats", with_stores(f"""
SELECT (SELECT count(*) FROM stores) AS total, count(*) AS matched,
  round(count(*) * 100e0 / (SELECT count(*) FROM stores), 6) AS pct,
  round(coalesce(100e0 * count(*) FILTER (biz_status_cd = '01')
    / nullif(count(*) FILTER (biz_status_cd IN ('01', '03')), 0), 0e0), 6) AS survival_rate,
  round(coalesce(100e0 * count(*) FILTER (biz_status_cd = '03')
    / nullif(count(*) FILTER (biz_status_cd IN ('01', '03')), 0), 0e0), 6) AS closure_rate,
  {listed_sql('stores', 'category_mid', 5, f'{IN_CATEGORY} AND {IN_DISTRICT}')} AS top_sub_categories
FROM stores WHERE {IN_CATEGORY} AND {IN_DISTRICT}"""))
def category_stats(spark, folder):
    return rounded(stats.category_stats(stores(spark, folder), CATEGORY, DISTRICT), 6, "pct", "survival_rate", "closure_rate")


@query("district_stats", with_stores(f"""
SELECT count(*) AS matched, {listed_sql('stores', 'category_large', 5, IN_DISTRICT)} AS top_categories
FROM stores WHERE {IN_DISTRICT}"""))
def district_stats(spark, folder):
    return stats.district_stats(stores(spark, folder), DISTRICT)


@query("overall_stats", with_stores(f"""
SELECT count(*) AS total, count(DISTINCT adong_name) AS n_districts,
  {listed_sql('stores', 'category_large', 5)} AS top_categories FROM stores"""))
def overall_stats(spark, folder):
    return stats.overall_stats(stores(spark, folder))


@query("category_profile", with_stores(f"""
SELECT count(*) AS matched, {leader_sql('stores', 'category_large', IN_CATEGORY)} AS matched_name,
  {listed_sql('stores', 'category_mid', 5, IN_CATEGORY)} AS top_sub_categories,
  {listed_sql('stores', 'adong_name', 5, IN_CATEGORY)} AS top_districts,
  round(count(*) * 100e0 / (SELECT count(*) FROM stores), 6) AS pct
FROM stores WHERE {IN_CATEGORY} HAVING count(*) > 0"""))
def category_profile(spark, folder):
    # ``food`` itself is a synonym for a Korean name; the view keeps English names.
    return rounded(stats.category_profile(stores(spark, folder), "FOO"), 6, "pct")


@query("district_profile", with_stores(f"""
SELECT count(*) AS matched, {leader_sql('stores', 'adong_name', IN_DISTRICT)} AS matched_name,
  {listed_sql('stores', 'category_large', 5, IN_DISTRICT)} AS top_categories
FROM stores WHERE {IN_DISTRICT} HAVING count(*) > 0"""))
def district_profile(spark, folder):
    return stats.district_profile(stores(spark, folder), DISTRICT)


@query("cross_profile", with_stores("""
SELECT adong_name, category_large, n, round(100e0 * n / sum(n) OVER (PARTITION BY adong_name), 6) AS district_pct, top_sub_categories
FROM (SELECT adong_name, category_large, count(*) AS n FROM stores GROUP BY 1, 2)
JOIN (SELECT adong_name, category_large,
        string_agg(category_mid || '(' || format('{:,}', m) || ')', ', ' ORDER BY rk) AS top_sub_categories
      FROM (SELECT adong_name, category_large, category_mid, count(*) AS m,
              row_number() OVER (PARTITION BY adong_name, category_large ORDER BY count(*) DESC, category_mid) AS rk
            FROM stores GROUP BY 1, 2, 3) WHERE rk <= 3 GROUP BY 1, 2) USING (adong_name, category_large)"""))
def cross_profile(spark, folder):
    rows = stores(spark, folder)
    groups = ["adong_name", "category_large"]
    tops = stats.top_lists(rows, groups, "category_mid", 3, "top_sub_categories")
    return rounded(stats.cross_table(rows), 6, "district_pct").join(tops, groups)


@query("cross_profile_one", with_stores(f"""
SELECT count(*) AS matched, {leader_sql('stores', 'category_large', f'{IN_CATEGORY} AND {IN_DISTRICT}')} AS matched_category,
  {listed_sql('stores', 'category_mid', 3, f'{IN_CATEGORY} AND {IN_DISTRICT}')} AS top_sub_categories,
  {leader_sql('stores', 'adong_name', f'{IN_CATEGORY} AND {IN_DISTRICT}')} AS matched_district,
  round(count(*) * 100e0 / (SELECT count(*) FROM stores WHERE {IN_DISTRICT}), 6) AS district_pct
FROM stores WHERE {IN_CATEGORY} AND {IN_DISTRICT} HAVING count(*) > 0"""))
def cross_profile_one(spark, folder):
    return rounded(stats.cross_profile(stores(spark, folder), "FOO", DISTRICT), 6, "district_pct")


@query("status_pivot", with_stores("""
SELECT category_large, count(*) FILTER (biz_status_cd = '01') AS n_01, count(*) FILTER (biz_status_cd = '02') AS n_02,
  count(*) FILTER (biz_status_cd = '03') AS n_03 FROM stores GROUP BY 1"""))
def status_pivot(spark, folder):
    return stats.status_pivot(stores(spark, folder), "category_large")


CUBE = f"""SELECT level, category, district, total, active, suspended, closed, {RATES}, n_districts FROM (
  SELECT CAST(grouping(category_large) * 2 + grouping(adong_name) AS INTEGER) AS level, category_large AS category,
    adong_name AS district, {COUNTS}, count(DISTINCT adong_name) AS n_districts
  FROM stores GROUP BY CUBE (category_large, adong_name))"""


@query("stats_cube", with_stores(CUBE))
def stats_cube(spark, folder):
    return rounded(stats.stats_cube(stores(spark, folder)), 6, "survival_rate", "closure_rate").select(
        "level", "category", "district", "total", "active", "suspended", "closed", "survival_rate", "closure_rate", "n_districts")


@query("stats_grouping_sets", with_stores(f"""
SELECT level, category, district, total, active, suspended, closed, {RATES} FROM (
  SELECT CAST(grouping(category_large) * 2 + grouping(adong_name) AS INTEGER) AS level, category_large AS category,
    adong_name AS district, {COUNTS}
  FROM stores GROUP BY GROUPING SETS ((category_large), (adong_name)))"""))
def stats_grouping_sets(spark, folder):
    return rounded(stats.stats_grouping_sets(stores(spark, folder)), 6, "survival_rate", "closure_rate")


@query("stats_rollup_region", with_stores(f"""
SELECT level, sido_name, sgg_name, adong_name, total, active, suspended, closed, {RATES} FROM (
  SELECT CAST(grouping(sido_name) * 4 + grouping(sgg_name) * 2 + grouping(adong_name) AS INTEGER) AS level,
    sido_name, sgg_name, adong_name, {COUNTS}
  FROM stores GROUP BY ROLLUP (sido_name, sgg_name, adong_name))"""))
def stats_rollup_region(spark, folder):
    out = stats.stats_rollup(stores(spark, folder), ["sido_name", "sgg_name", "adong_name"])
    return rounded(out, 6, "survival_rate", "closure_rate")


@query("top_subcategories", with_stores("""
SELECT category_large, category_mid, n, rank FROM (
  SELECT category_large, category_mid, count(*) AS n,
    CAST(row_number() OVER (PARTITION BY category_large ORDER BY count(*) DESC, category_mid) AS INTEGER) AS rank
  FROM stores GROUP BY 1, 2) WHERE rank <= 5"""))
def top_subcategories(spark, folder):
    return stats.category_leaders(stores(spark, folder))


@query("limit_codes", with_stores("""
SELECT adong_name FROM (SELECT DISTINCT adong_name FROM stores) ORDER BY adong_name LIMIT 10"""))
def limit_codes(spark, folder):
    # A top-k report: the limit is the feature.
    return stats.limited(stores(spark, folder).select("adong_name").distinct(), ["adong_name"], 10)


def text_sql(number: str) -> str:
    return f"format('{{:,}}', {number})"


def percent_sql(number: str) -> str:
    return f"printf('%.1f%%', {number})"


STATS_TEXT = f"""SELECT level, category, district,
  coalesce(category, 'all categories') || ' / ' || coalesce(district, 'all districts') || ': ' || {text_sql('total')} || ' stores'
  || CASE WHEN active + closed > 0 THEN chr(10) || 'trading ' || {text_sql('active')} || ' ('
    || {percent_sql('100e0 * active / (active + closed)')} || '), closed ' || {text_sql('closed')} || ' ('
    || {percent_sql('100e0 * closed / (active + closed)')} || '), suspended ' || {text_sql('suspended')} || ', unknown '
    || {text_sql('total - active - suspended - closed')} ELSE '' END
  || coalesce(chr(10) || 'top categories: ' || t1.list, '') || coalesce(chr(10) || 'top sub-categories: ' || t2.list, '')
  || coalesce(chr(10) || 'top districts: ' || t3.list, '') AS stats_text
FROM cube""" + "".join(f"""
LEFT JOIN (SELECT level AS l, category AS c, district AS d, list FROM tops WHERE kind = '{kind}') t{i}
  ON t{i}.l = level AND t{i}.c IS NOT DISTINCT FROM category AND t{i}.d IS NOT DISTINCT FROM district"""
    for i, kind in enumerate(("category", "sub_category", "district"), 1))

TOPS = """SELECT level, category, district, kind, string_agg(value || '(' || format('{:,}', n) || ')', ', ' ORDER BY rk) AS list
FROM (SELECT *, row_number() OVER (PARTITION BY level, category, district, kind ORDER BY n DESC, value) AS rk FROM (
  SELECT 3 AS level, NULL AS category, NULL AS district, 'category' AS kind, category_large AS value, count(*) AS n
  FROM stores GROUP BY ALL
  UNION ALL SELECT 2, NULL, adong_name, 'category', category_large, count(*) FROM stores GROUP BY ALL
  UNION ALL SELECT 1, category_large, NULL, 'sub_category', category_mid, count(*) FROM stores GROUP BY ALL
  UNION ALL SELECT 1, category_large, NULL, 'district', adong_name, count(*) FROM stores GROUP BY ALL
  UNION ALL SELECT 0, category_large, adong_name, 'sub_category', category_mid, count(*) FROM stores GROUP BY ALL)
  WHERE value <> '')
WHERE rk <= CASE WHEN level = 0 THEN 3 ELSE 5 END GROUP BY 1, 2, 3, 4"""


@query("stats_text", with_stores(STATS_TEXT, cube=CUBE, tops=TOPS))
def stats_text(spark, folder):
    rows = stores(spark, folder)
    return reports.stats_text(stats.stats_cube(rows), stats.scope_tops(rows))


LAST_TURNS = """
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'user' ELSE 'adviser' END || ': ' || coalesce(text, ''), chr(10)
  ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 5 GROUP BY conv_id"""


@query("last_turns", LAST_TURNS)
def last_turns(spark, folder):
    return reports.last_turns(table(spark, folder, "conversations"))


@query("request_context", with_stores("""
SELECT request_id, business_category AS category, requests.district, c.total AS category_total,
  c.survival_rate AS category_survival_rate, d.total AS district_total, d.survival_rate AS district_survival_rate,
  p.total AS pair_total, p.survival_rate AS pair_survival_rate
FROM requests LEFT JOIN cube c ON c.level = 1 AND c.category = business_category
LEFT JOIN cube d ON d.level = 2 AND d.district = requests.district
LEFT JOIN cube p ON p.level = 0 AND p.category = business_category AND p.district = requests.district""",
    cube=CUBE, requests=plain(REQUESTS_SQL)))
def request_context(spark, folder):
    cube = stage(stats.stats_cube(stores(spark, folder)), "cube")
    requests = view(spark, folder, REQUESTS_SQL).select("request_id", F.col("business_category").alias("category"), "district")
    out = reports.request_context(requests, cube)
    return rounded(out, 6, "category_survival_rate", "district_survival_rate", "pair_survival_rate")
