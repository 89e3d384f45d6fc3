"""The given tables seen as stores, API pages, regions, requests and runs.

The view texts are valid in Spark and in DuckDB, so a query and its SQL start from
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

STORES_SQL = """
SELECT CAST(o.o_orderkey AS STRING) AS biz_id, c.c_name AS store_name,
  CASE c.c_mktsegment WHEN 'BUILDING' THEN 'food' WHEN 'MACHINERY' THEN 'retail' WHEN 'FURNITURE' THEN 'service'
       WHEN 'AUTOMOBILE' THEN 'it' ELSE 'other' END AS category_large,
  substr(o.o_orderpriority, 3) AS category_mid, r.r_name AS sido_name, n.n_name AS sgg_name,
  n.n_name || '-' || CAST(c.c_custkey % 4 AS STRING) AS adong_name,
  CASE WHEN o.o_orderkey % 50 = 0 THEN NULL WHEN o.o_orderstatus = 'F' THEN '01'
       WHEN o.o_orderstatus = 'P' THEN '02' ELSE '03' END AS biz_status_cd,
  CAST(20 + c.c_custkey % 45 AS BIGINT) AS age, CAST(o.o_orderkey % 25 AS BIGINT) AS experience_years,
  o.o_totalprice * 500 AS initial_investment,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE (c.c_acctbal + 1000) * 800 END AS monthly_rent,
  CASE WHEN o.o_orderkey % 997 = 0 THEN 5e3 ELSE 1e1 + o.o_orderkey % 140 END AS store_size_sqm,
  CAST(o.o_orderkey % 10 AS BIGINT) AS employee_count, CAST(c.c_custkey % 31 AS BIGINT) AS nearby_competitor_count,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
  CAST(CASE WHEN o.o_orderkey % 5 < 3 THEN 1 ELSE 0 END AS BIGINT) AS has_related_experience,
  CAST(CASE WHEN o.o_orderkey % 5 < 2 THEN 1 ELSE 0 END AS BIGINT) AS is_franchise,
  126.8e0 + (c.c_custkey % 400) / 1e3 AS longitude, 37.4e0 + (o.o_orderkey % 300) / 1e3 AS latitude,
  o.o_orderdate AS collected_at
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

# Lines of orders as repeated writes to one key: the latest shipment wins.
LINES_SQL = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS biz_id,
  CAST(l_partkey AS STRING) AS store_name, l_returnflag AS category_large, l_linestatus AS category_mid,
  CAST(l_suppkey AS STRING) AS adong_cd, l_shipdate AS written_at, l_partkey, l_suppkey, l_quantity, l_extendedprice
FROM {lineitem}
"""

# A register of ten-digit codes: provinces from regions, districts from nations, the rest from customers.
REGISTER_SQL = """
SELECT lpad(CAST(r_regionkey + 11 AS STRING), 2, '0') || '00000000' AS region_cd, r_name AS locatadd_nm, 'Y' AS flag
FROM {region}
UNION ALL
SELECT lpad(CAST(n_regionkey + 11 AS STRING), 2, '0') || lpad(CAST(n_nationkey + 101 AS STRING), 3, '0') || '00000',
  r_name || ' ' || n_name, 'Y' FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT DISTINCT lpad(CAST(n_regionkey + 11 AS STRING), 2, '0') || lpad(CAST(n_nationkey + 101 AS STRING), 3, '0')
  || lpad(CAST(c_custkey % 400 AS STRING), 3, '0') || lpad(CAST(c_custkey % 3 AS STRING), 2, '0'),
  r_name || ' ' || n_name || ' dong' || CAST(c_custkey % 400 AS STRING), CASE WHEN c_custkey % 400 % 7 = 0 THEN 'N' ELSE 'Y' END
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# Administrative codes with names, one row per code.
HDONG_SQL = """
SELECT DISTINCT lpad(CAST(n_regionkey + 11 AS STRING), 2, '0') || lpad(CAST(n_nationkey + 101 AS STRING), 3, '0')
  || lpad(CAST(c_custkey % 400 AS STRING), 3, '0') || '00' AS hdong_cd, r_name AS sido_nm, n_name AS sgg_nm,
  CASE WHEN c_custkey % 400 = 9 THEN '소계' ELSE 'dong' || CAST(c_custkey % 400 AS STRING) END AS dong_nm
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# One applicant per customer; some break the rules.
REQUESTS_SQL = """
SELECT CAST(c_custkey AS STRING) AS request_id,
  CAST(CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE 15 + c_custkey % 70 END AS BIGINT) AS founder_age,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS founder_gender,
  CASE WHEN c_custkey % 4 = 0 THEN 'master' ELSE NULL END AS founder_education,
  CAST(c_custkey % 12 - 1 AS BIGINT) AS experience_years, c_custkey % 2 = 1 AS has_related_experience,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'food' WHEN 'MACHINERY' THEN 'retail' WHEN 'FURNITURE' THEN 'service'
       WHEN 'AUTOMOBILE' THEN 'it' ELSE NULL END AS business_category,
  'MEDIUM' AS business_sub_category, CAST(floor(c_acctbal * 10000) AS BIGINT) AS initial_investment,
  CAST(c_custkey % 100 * 30000 AS BIGINT) AS monthly_rent, c_custkey % 90 * 1e0 AS store_size_sqm,
  CAST(c_custkey % 7 AS BIGINT) AS employee_count, c_custkey % 5 = 0 AS is_franchise,
  n_name || '-' || CAST(c_custkey % 4 AS STRING) AS district
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

# Events read as the log of training runs, one run per user.
RUN_EVENTS_SQL = """
SELECT CAST(user_id AS STRING) AS run_id, CASE WHEN user_id % 2 = 0 THEN 'trees' ELSE 'network' END AS model_type,
  CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'training' WHEN 'click' THEN 'evaluating'
       WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN event_type = 'purchase' THEN value END AS score,
  CASE WHEN event_type = 'purchase' THEN 'models/' || CAST(event_id AS STRING) END AS model_path,
  ts AS event_ts, event_id
FROM {events}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, text: str) -> DataFrame:
    names = [n for n in TABLES if "{" + n + "}" in text]
    return spark.sql(text, **{n: table(spark, folder, n) for n in names})


def plain(text: str) -> str:
    """The view text for DuckDB, where the tables have their own names."""
    return text.format(**{n: n for n in TABLES}).strip()


STORES = plain(STORES_SQL)


def stores(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, STORES_SQL)


def with_stores(select: str, **ctes: str) -> str:
    """SQL over the store view and further named steps."""
    steps = "".join(f", {name} AS ({text})" for name, text in ctes.items())
    return f"WITH stores AS ({STORES}){steps} {select}"


def uniform_sql(key: str, salt: str) -> str:
    """DuckDB text of ``functions.columns.draw``."""
    return f"(concat('0x', substr(md5({key} || '|{salt}'), 1, 8))::BIGINT / 4294967296e0)"


# API names for the store view; a third of the rows has its category under the second alias only.
API_NAMES = {
    "biz_id": "bizesId", "store_name": "bizesNm", "sido_name": "ctprvnNm", "sgg_name": "signguNm",
    "adong_name": "adongNm", "longitude": "lon", "latitude": "lat", "category_mid": "indsMclsNm",
}


def api_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = stores(spark, folder)
    first = F.when(F.col("biz_id").cast("bigint") % 3 != 0, F.col("category_large"))
    second = F.when(F.col("biz_id").cast("bigint") % 3 == 0, F.col("category_large"))
    return rows.select(
        *[F.col(k).alias(v) for k, v in API_NAMES.items()], first.alias("indsLclsCdNm"), second.alias("indsLclsNm"),
        F.lit("202401").alias("stdrYm"))


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
