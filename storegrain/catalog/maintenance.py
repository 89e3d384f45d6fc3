"""Joins, upserts, runs, unions and key sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from storegrain.catalog import query
from storegrain.catalog.views import (
    LINES_SQL, RUN_EVENTS_SQL, plain, rounded, stores, table, view, with_stores,
)
from storegrain.operators import joins, regions, runs, upsert
from storegrain.operators.mapping import to_region_names
from storegrain.catalog.views import HDONG_SQL
from storegrain.schemas import REGION_CODES
from storegrain.streaming.ingest import collection_windows

LINES = plain(LINES_SQL)
# Full order of the writes to one key; the rest of the columns breaks ties.
WRITE_ORDER = ["written_at", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "category_large", "category_mid"]
ORDER_SQL = ", ".join(f"{c} DESC" for c in WRITE_ORDER)


def write_order():
    return [F.desc(c) for c in WRITE_ORDER]


LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY biz_id ORDER BY {ORDER_SQL}) AS rn FROM lines) WHERE rn = 1"


@query("dedupe_latest", f"""WITH lines AS ({LINES})
SELECT biz_id, store_name, category_large, category_mid, adong_cd, l_quantity FROM ({LATEST})""")
def dedupe_latest(spark, folder):
    rows = joins.last_write(view(spark, folder, LINES_SQL), "biz_id", write_order())
    return rows.select("biz_id", "store_name", "category_large", "category_mid", "adong_cd", "l_quantity")


# -- joins ------------------------------------------------------------------

# Every order reports a status; a fifth of them under a number that no store has.
STATUS_SQL = """SELECT CAST(o_orderkey + CASE WHEN o_totalprice > 100000 THEN 0 ELSE 1000000000000 END AS STRING) AS b_no,
  CASE o_orderstatus WHEN 'F' THEN '01' WHEN 'P' THEN '02' ELSE '03' END AS b_stt_cd, CAST(CAST(o_orderdate AS DATE) AS STRING) AS end_dt FROM {orders}"""


@query("join_status", with_stores(f"""
SELECT biz_id, store_name, b_stt_cd, end_dt FROM stores LEFT JOIN ({plain(STATUS_SQL)}) ON biz_id = b_no"""))
def join_status(spark, folder):
    return attach_status(stores(spark, folder).select("biz_id", "store_name"), view(spark, folder, STATUS_SQL))


def attach_status(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Business status beside each store; a number reported twice counts once, with its later end."""
    once = joins.last_write(status, "b_no", [F.desc_nulls_last("end_dt"), F.desc("b_stt_cd")])
    return joins.attach(rows, once.withColumnRenamed("b_no", "biz_id"), "biz_id")


# Every district; those with low sales under a code that no store has.
DONG_SQL = """SELECT CASE WHEN avg_sales > 4000 THEN code ELSE 'former ' || code END AS dong_code, avg_sales, floating_pop
  FROM (SELECT n_name || '-' || CAST(c_custkey % 4 AS STRING) AS code, round(avg(c_acctbal), 4) AS avg_sales, count(*) AS floating_pop
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1)"""


@query("merge_commercial", with_stores(f"""
SELECT biz_id, dong_code, avg_sales, floating_pop FROM (SELECT biz_id, adong_name AS dong_code FROM stores)
LEFT JOIN ({plain(DONG_SQL)}) USING (dong_code)"""))
def merge_commercial(spark, folder):
    rows = stores(spark, folder).select("biz_id", F.col("adong_name").alias("dong_code"))
    return joins.attach(rows, view(spark, folder, DONG_SQL), "dong_code").select("biz_id", "dong_code", "avg_sales", "floating_pop")


@query("merge_population", with_stores(f"""
SELECT biz_id, dong_code, residents FROM (SELECT biz_id, adong_name AS dong_code FROM stores)
LEFT JOIN (SELECT dong_code, floating_pop * 1000 AS residents FROM ({plain(DONG_SQL)})) USING (dong_code)"""))
def merge_population(spark, folder):
    rows = stores(spark, folder).select("biz_id", F.col("adong_name").alias("dong_code"))
    people = view(spark, folder, DONG_SQL).select("dong_code", (F.col("floating_pop") * 1000).alias("residents"))
    return joins.attach(rows, people, "dong_code").select("biz_id", "dong_code", "residents")


@query("distinct_biz", f"WITH lines AS ({LINES}) SELECT DISTINCT biz_id FROM lines WHERE biz_id IS NOT NULL")
def distinct_biz(spark, folder):
    return view(spark, folder, LINES_SQL).select("biz_id").dropna().distinct()


# -- upserts ----------------------------------------------------------------

TARGET = T.StructType(
    [T.StructField(c, T.StringType()) for c in (
        "biz_id", "store_name", "category_large", "category_mid", "adong_cd", "road_address")]
    + [T.StructField(c, T.TimestampNTZType()) for c in ("collected_at", "updated_at")])


def old_and_new(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Lines written before 1998 are the stored table, the others a batch without addresses; some keys are null."""
    lines = view(spark, folder, LINES_SQL)
    # The cut is the business rule of this example: earlier writes against later writes.
    early = F.col("written_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    stored = joins.last_write(lines.filter(early), "biz_id", write_order()).select(
        "biz_id", "store_name", "category_large", "category_mid", "adong_cd", F.concat(F.lit("road "), "adong_cd").alias("road_address"),
        F.col("written_at").alias("collected_at"), F.col("written_at").alias("updated_at"))
    batch = lines.filter(~early).drop("adong_cd").withColumns({
        "biz_id": F.when(F.col("l_quantity") < 49, F.col("biz_id")),
        "category_mid": F.when(F.col("l_quantity") < 25, F.col("category_mid"))})
    return stored, batch


UPSERT_STEPS = f"""lines AS ({LINES}),
stored AS (SELECT biz_id, store_name, category_large, category_mid, adong_cd, 'road ' || adong_cd AS road_address, written_at
  FROM (SELECT *, row_number() OVER (PARTITION BY biz_id ORDER BY {ORDER_SQL}) AS rn FROM lines WHERE written_at < TIMESTAMP '1998-01-01')
  WHERE rn = 1),
batch AS (SELECT * REPLACE (CASE WHEN l_quantity < 49 THEN biz_id END AS biz_id, CASE WHEN l_quantity < 25 THEN category_mid END AS category_mid)
  FROM lines WHERE written_at >= TIMESTAMP '1998-01-01'),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY biz_id ORDER BY {ORDER_SQL}) AS rn FROM batch WHERE biz_id IS NOT NULL)
  WHERE rn = 1)"""
# Of equal keys the null category sorts last in both engines.
UPSERT_STEPS = UPSERT_STEPS.replace("category_mid DESC", "category_mid DESC NULLS LAST")


@query("upsert_stores", f"""WITH {UPSERT_STEPS}
SELECT coalesce(s.biz_id, f.biz_id) AS biz_id, CASE WHEN f.biz_id IS NOT NULL THEN f.store_name ELSE s.store_name END AS store_name,
  CASE WHEN f.biz_id IS NOT NULL THEN f.category_large ELSE s.category_large END AS category_large,
  CASE WHEN f.biz_id IS NOT NULL THEN f.category_mid ELSE s.category_mid END AS category_mid,
  s.adong_cd, s.road_address, CASE WHEN f.biz_id IS NULL THEN 'kept' WHEN s.biz_id IS NULL THEN 'inserted' ELSE 'updated' END AS outcome
FROM stored s FULL JOIN fresh f ON s.biz_id = f.biz_id
UNION ALL SELECT NULL, store_name, category_large, category_mid, NULL, NULL, 'inserted' FROM batch WHERE biz_id IS NULL""")
def upsert_stores(spark, folder):
    stored, batch = old_and_new(spark, folder)
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    out = upsert.upsert(mapped(stored), batch, "biz_id", [F.desc_nulls_last(c) for c in WRITE_ORDER], now)
    outcome = F.when(F.col("collected_at") == now, "inserted").when(F.col("updated_at") == now, "updated").otherwise("kept")
    return out.withColumn("outcome", outcome).drop("collected_at", "updated_at")


def mapped(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TARGET.fields])


@query("upsert_counts", f"""WITH {UPSERT_STEPS}
SELECT count(*) FILTER (s.biz_id IS NULL) AS inserted, count(s.biz_id) AS updated FROM fresh f LEFT JOIN stored s ON s.biz_id = f.biz_id""")
def upsert_counts(spark, folder):
    stored, batch = old_and_new(spark, folder)
    return upsert.upsert_counts(stored, batch, "biz_id")


@query("keys_except", f"""WITH {UPSERT_STEPS}
SELECT biz_id FROM stored EXCEPT SELECT biz_id FROM batch""")
def keys_except(spark, folder):
    stored, batch = old_and_new(spark, folder)
    return upsert.keys_except(stored, batch, "biz_id")


@query("keys_intersect", f"""WITH {UPSERT_STEPS}
SELECT biz_id FROM stored INTERSECT SELECT biz_id FROM batch""")
def keys_intersect(spark, folder):
    stored, batch = old_and_new(spark, folder)
    return upsert.keys_intersect(stored, batch, "biz_id")


REGION_SOURCE = plain(HDONG_SQL)


@query("upsert_regions", f"""
SELECT hdong_cd AS region_cd, substr(hdong_cd, 1, 8) AS region_cd_8, sido_nm AS sido_name, sgg_nm AS sgg_name,
  CASE WHEN substr(hdong_cd, 6, 3) < '200' THEN 'new ' || dong_nm ELSE dong_nm END AS dong_name FROM ({REGION_SOURCE})""")
def upsert_regions(spark, folder):
    codes = regions.normalize_codes(view(spark, folder, HDONG_SQL))
    stored = to_region_names(codes).select(*[f.name for f in REGION_CODES.fields if f.name in to_region_names(codes).columns])
    renamed = codes.filter(F.substring("region_cd", 6, 3) < "200").select(
        "region_cd", F.concat(F.lit("new "), "dong_nm").alias("dong_nm"))
    out = upsert.upsert(stored, to_region_names(renamed), "region_cd", [F.desc("dong_name")])
    return out.select("region_cd", "region_cd_8", "sido_name", "sgg_name", "dong_name")


@query("union_batches", """
SELECT CAST(o_orderkey AS STRING) AS biz_id, o_orderstatus AS status, NULL AS note FROM orders
UNION ALL SELECT CAST(l_orderkey AS STRING), NULL, l_returnflag FROM lineitem""")
def union_batches(spark, folder):
    first = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("biz_id"), F.col("o_orderstatus").alias("status"))
    second = table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("biz_id"), F.col("l_returnflag").alias("note"))
    return upsert.union_batches(first, second)


# -- runs -------------------------------------------------------------------

RUN_ROWS = """SELECT biz_id, category_large, 'run-' || CAST(CAST(biz_id AS BIGINT) % 7 AS VARCHAR) AS pipeline_run_id,
  collected_at AS created_at FROM stores"""


def run_rows(spark, folder) -> DataFrame:
    run = F.concat(F.lit("run-"), (F.col("biz_id").cast("bigint") % 7).cast("string"))
    return stores(spark, folder).select(
        "biz_id", "category_large", run.alias("pipeline_run_id"), F.col("collected_at").alias("created_at"))


NEWEST = "SELECT pipeline_run_id FROM run_rows GROUP BY 1 ORDER BY max(created_at) DESC, pipeline_run_id DESC LIMIT {n}"


@query("latest_run", with_stores(NEWEST.format(n=1), run_rows=RUN_ROWS))
def latest_run(spark, folder):
    return runs.latest_run(run_rows(spark, folder))


@query("scan_run", with_stores(
    f"SELECT biz_id, category_large, pipeline_run_id FROM run_rows WHERE pipeline_run_id = ({NEWEST.format(n=1)})", run_rows=RUN_ROWS))
def scan_run(spark, folder):
    return runs.scan_run(run_rows(spark, folder), leave_out=["created_at"])


@query("retain_runs", with_stores(
    f"SELECT biz_id, category_large, pipeline_run_id FROM run_rows WHERE pipeline_run_id IN ({NEWEST.format(n=3)})", run_rows=RUN_ROWS))
def retain_runs(spark, folder):
    return runs.retain_runs(run_rows(spark, folder), 3).drop("created_at")


@query("retain_runs_deleted", with_stores(
    f"SELECT count(*) AS n_deleted FROM run_rows WHERE pipeline_run_id NOT IN ({NEWEST.format(n=3)})", run_rows=RUN_ROWS))
def retain_runs_deleted(spark, folder):
    return runs.dropped_rows(run_rows(spark, folder), 3)


EVENTS = plain(RUN_EVENTS_SQL)
STATE = f"""SELECT run_id, arg_max(model_type, (event_ts, event_id)) AS model_type, arg_max(status, (event_ts, event_id)) AS status,
  arg_max(score, (event_ts, event_id)) FILTER (score IS NOT NULL) AS score,
  arg_max(model_path, (event_ts, event_id)) FILTER (model_path IS NOT NULL) AS model_path,
  max(event_ts) FILTER (status IN ('completed', 'failed')) AS completed_at FROM ({EVENTS}) GROUP BY run_id"""


@query("run_state", f"""SELECT run_id, model_type, status, score, model_path, strftime(completed_at, '%Y-%m-%d %H:%M:%S') AS completed_at
FROM ({STATE})""")
def run_state(spark, folder):
    state = runs.run_state(view(spark, folder, RUN_EVENTS_SQL))
    return state.select("run_id", "model_type", "status", "score", "model_path",
                        F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


@query("latest_completed", f"""SELECT model_type, run_id, score, model_path FROM (SELECT *, row_number() OVER (
  PARTITION BY model_type ORDER BY completed_at DESC, run_id DESC) AS rn FROM ({STATE}) WHERE status = 'completed') WHERE rn = 1""")
def latest_completed(spark, folder):
    state = runs.run_state(view(spark, folder, RUN_EVENTS_SQL))
    return runs.latest_completed(state).select("model_type", "run_id", "score", "model_path")


# -- collection -------------------------------------------------------------

TARGETS = """SELECT DISTINCT n_name || '-' || CAST(c_custkey % 5 AS STRING) AS dong_code, n_name AS dong_name
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""


@query("collection_log", with_stores(f"""
SELECT dong_code AS dong_cd, dong_name, coalesce(n, 0) AS store_count, CASE WHEN n > 0 THEN 'success' ELSE 'no_data' END AS status
FROM ({plain(TARGETS)}) LEFT JOIN (SELECT adong_name, count(*) AS n FROM stores GROUP BY 1) ON adong_name = dong_code"""))
def collection_log(spark, folder):
    rows = stores(spark, folder).select(F.col("adong_name").alias("dong_code"))
    return regions.collection_log(view(spark, folder, TARGETS), rows).drop("error_msg", "collected_at")


@query("collection_coverage", with_stores(f"""
SELECT count(*) AS requested, count(b_no) AS answered, round(count(b_no) * 100e0 / count(*), 6) AS pct
FROM (SELECT DISTINCT biz_id FROM stores) LEFT JOIN (SELECT DISTINCT b_no FROM ({plain(STATUS_SQL)})) ON b_no = biz_id"""))
def collection_coverage(spark, folder):
    answered = view(spark, folder, STATUS_SQL).withColumnRenamed("b_no", "biz_id")
    return rounded(regions.response_rate(stores(spark, folder), answered, "biz_id"), 6, "pct")


@query("collection_windows", """
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY 1, 2""")
def windows(spark, folder):
    out = collection_windows(table(spark, folder, "events"), "ts", "event_type", "value")
    return rounded(out, 4, "total").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n", "total")


@query("collection_windows_sliding", """
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events)
GROUP BY 1, 2""")
def sliding(spark, folder):
    out = collection_windows(table(spark, folder, "events"), "ts", "event_type", "value", "1 day", "12 hours")
    return rounded(out, 4, "total").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", "total")
