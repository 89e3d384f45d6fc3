"""Region codes and radius queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from storegrain.catalog import query
from storegrain.catalog.views import HDONG_SQL, REGISTER_SQL, plain, rounded, stores, view, with_stores
from storegrain.functions.geo import EARTH_RADIUS_M, haversine_m
from storegrain.operators import nearby, regions

REGISTER = plain(REGISTER_SQL)
NORMAL = f"""SELECT hdong_cd AS region_cd, substr(hdong_cd, 1, 8) AS region_cd_8, substr(hdong_cd, 1, 2) AS sido_cd,
  substr(hdong_cd, 3, 3) AS sgg_cd, substr(hdong_cd, 6, 3) AS dong_cd, sido_nm, sgg_nm, dong_nm,
  sido_nm || ' ' || sgg_nm || ' ' || dong_nm AS full_nm FROM ({plain(HDONG_SQL)})"""


@query("region_sido", f"""SELECT region_cd, substr(region_cd, 1, 2) AS sido_cd, locatadd_nm AS sido_nm FROM ({REGISTER})
WHERE substr(region_cd, 3) = '00000000'""")
def region_sido(spark, folder):
    return regions.provinces(view(spark, folder, REGISTER_SQL))


@query("region_sgg", f"""SELECT region_cd, substr(region_cd, 1, 2) AS sido_cd, substr(region_cd, 3, 3) AS sgg_cd,
  split_part(locatadd_nm, ' ', -1) AS sgg_nm, locatadd_nm AS full_nm FROM ({REGISTER})
WHERE substr(region_cd, 1, 2) = '12' AND substr(region_cd, 6) = '00000' AND substr(region_cd, 3, 3) <> '000'""")
def region_sgg(spark, folder):
    return regions.districts(view(spark, folder, REGISTER_SQL), "12")


@query("region_dong", f"""SELECT region_cd, substr(region_cd, 1, 2) AS sido_cd, substr(region_cd, 3, 3) AS sgg_cd,
  substr(region_cd, 6, 3) AS dong_cd, split_part(locatadd_nm, ' ', -1) AS dong_nm, locatadd_nm AS full_nm, flag FROM ({REGISTER})
WHERE substr(region_cd, 6, 3) <> '000' AND substr(region_cd, 9) = '00'""")
def region_dong(spark, folder):
    return regions.neighbourhoods(view(spark, folder, REGISTER_SQL))


@query("region_search", f"""SELECT region_cd, locatadd_nm FROM ({REGISTER}) WHERE contains(locatadd_nm, 'NATION_1') AND flag = 'Y'""")
def region_search(spark, folder):
    return regions.search_regions(view(spark, folder, REGISTER_SQL), "NATION_1").select("region_cd", "locatadd_nm")


@query("normalize_hdong", NORMAL)
def normalize_hdong(spark, folder):
    return regions.normalize_codes(view(spark, folder, HDONG_SQL))


@query("dong_codes", f"""SELECT region_cd_8 FROM ({NORMAL}) WHERE sido_cd = '13' AND NOT suffix(region_cd_8, '0000')""")
def dong_codes(spark, folder):
    return regions.dong_codes(regions.normalize_codes(view(spark, folder, HDONG_SQL)), "13")


@query("region_targets", f"""SELECT region_cd_8 AS code FROM ({NORMAL}) WHERE sido_cd = '12' AND NOT suffix(region_cd_8, '0000')
AND dong_nm NOT IN ('소계', '합계', '') AND (contains(full_nm, 'NATION_1') OR contains(full_nm, 'NATION_2'))""")
def region_targets(spark, folder):
    codes = regions.normalize_codes(view(spark, folder, HDONG_SQL))
    return regions.region_targets(codes, "12", ["NATION_1", "NATION_2"])


@query("region_targets_legal", f"""SELECT region_cd AS code FROM (SELECT region_cd, substr(region_cd, 1, 2) AS sido_cd,
  locatadd_nm AS full_nm, split_part(locatadd_nm, ' ', -1) AS dong_nm, flag FROM ({REGISTER}))
WHERE sido_cd = '11' AND length(region_cd) = 10 AND substr(region_cd, 6, 3) <> '000' AND substr(region_cd, 9) = '00'
AND flag = 'Y' AND dong_nm IN ('dong3', 'dong9', 'dong27', 'dong30')""")
def region_targets_legal(spark, folder):
    rows = view(spark, folder, REGISTER_SQL).select(
        "region_cd", F.substring("region_cd", 1, 2).alias("sido_cd"), F.col("locatadd_nm").alias("full_nm"),
        regions.last_word("locatadd_nm").alias("dong_nm"), "flag")
    return regions.region_targets(rows, "11", dong_filter=["dong3", "dong9", "dong27", "dong30"])


@query("resolve_sido", f"""SELECT sido_nm, '11' AS sido_cd FROM ({NORMAL}) WHERE contains(sido_nm, 'AFRI') GROUP BY 1
ORDER BY sido_nm <> 'AFRI', sido_nm LIMIT 1""")
def resolve_sido(spark, folder):
    codes = regions.normalize_codes(view(spark, folder, HDONG_SQL))
    # The view's provinces are world regions, so their codes stand in for the fixed ones.
    return regions.resolve_province(codes, "AFRI", codes={"AFRICA": "11", "AMERICA": "12"})


CENTRE = (37.5, 127.0, 2500.0)
DISTANCE = f"""2 * {EARTH_RADIUS_M} * asin(sqrt(pow(sin(radians({{lat2}} - {{lat1}}) / 2), 2)
  + cos(radians({{lat1}})) * cos(radians({{lat2}})) * pow(sin(radians({{lon2}} - {{lon1}}) / 2), 2)))"""


def distance_sql(lat1, lon1, lat2, lon2) -> str:
    return DISTANCE.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


@query("stores_in_radius", with_stores(f"""SELECT biz_id, round(d, 3) AS metres FROM (
  SELECT biz_id, {distance_sql('37.5e0', '127e0', 'latitude', 'longitude')} AS d FROM stores) WHERE d <= 2500"""))
def stores_in_radius(spark, folder):
    lat, lon, radius = CENTRE
    rows = nearby.stores_in_radius(stores(spark, folder), lat, lon, radius)
    metres = haversine_m(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    return rounded(rows.select("biz_id", metres.alias("metres")), 3, "metres")


@query("competitors_in_radius", with_stores(f"""
SELECT a.category_large, round(a.latitude, 6) AS latitude, round(a.longitude, 6) AS longitude,
  CAST(sum(b.n) - 1 AS BIGINT) AS n_competitors
FROM spots a JOIN spots b ON a.category_large = b.category_large
WHERE {distance_sql('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 1234 GROUP BY ALL""",
    spots="SELECT category_large, latitude, longitude, count(*) AS n FROM stores GROUP BY ALL"))
def competitors_in_radius(spark, folder):
    out = nearby.competitors_in_radius(stores(spark, folder), 1234.0)
    return rounded(out, 6, "latitude", "longitude")
