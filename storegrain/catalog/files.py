"""File scans and sinks, run tables and streams, on files Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storegrain import schemas
from storegrain.catalog import query
from storegrain.catalog.maintenance import STATUS_SQL, attach_status
from storegrain.catalog.places import NORMAL, REGISTER
from storegrain.catalog.preparation import CLEAN_STEPS, LABEL_STEPS
from storegrain.catalog.views import (
    HDONG_SQL, REGISTER_SQL, api_rows, plain, rounded, stores, table, view, with_stores,
)
from storegrain.operators import regions
from storegrain.operators.mapping import to_table_names
from storegrain.plans import stages
from storegrain.session import stage, staging_path
from storegrain.sources import files, tables
from storegrain.streaming import ingest

# -- CSV --------------------------------------------------------------------

SIMPLE = ["biz_id", "store_name", "category_large", "adong_name", "age", "initial_investment", "longitude"]


def csv_copy(spark, folder) -> str:
    path = staging_path(spark, "csv")
    files.write_csv(stores(spark, folder).select(*SIMPLE), path)
    return path


@query("scan_csv", with_stores("SELECT CAST(biz_id AS INTEGER) AS biz_id, store_name, category_large, adong_name, CAST(age AS INTEGER) AS age, "
                               "initial_investment, longitude FROM stores"))
def scan_csv(spark, folder):
    return files.read_csv(spark, csv_copy(spark, folder))


@query("scan_csv_typed", with_stores(f"SELECT {', '.join(SIMPLE)} FROM stores"))
def scan_csv_typed(spark, folder):
    path = csv_copy(spark, folder)
    return files.read_csv(spark, path, stores(spark, folder).select(*SIMPLE).schema)


@query("scan_csv_text", f"SELECT region_cd, sido_cd, dong_cd, full_nm FROM ({NORMAL})")
def scan_csv_text(spark, folder):
    path = staging_path(spark, "codes")
    files.write_csv(regions.normalize_codes(view(spark, folder, HDONG_SQL)), path)
    return files.read_csv_text(spark, path).select("region_cd", "sido_cd", "dong_cd", "full_nm")


@query("sink_csv", with_stores("SELECT adong_name, count(*) AS n FROM stores GROUP BY 1"))
def sink_csv(spark, folder):
    path = staging_path(spark, "export")
    files.write_csv(stores(spark, folder).groupBy("adong_name").agg(F.count("*").alias("n")), path)
    return files.read_csv_text(spark, path).select("adong_name", F.col("n").cast("bigint").alias("n"))


@query("scan_region_files", f"""
SELECT sido_cd, count(*) AS n, count(DISTINCT CAST(dong_cd AS INTEGER) % 3) AS n_files FROM ({NORMAL}) GROUP BY 1""")
def scan_region_files(spark, folder):
    """Up to three files per province; the scan reads them together and says which file a row came from."""
    root = staging_path(spark, "regions")
    codes = regions.normalize_codes(view(spark, folder, HDONG_SQL))
    third = (F.col("dong_cd").cast("int") % 3).alias("third")
    # One task holds all rows of a folder, so each folder gets one file.
    codes.withColumns({"file": F.col("sido_cd"), "third": third}).repartition("file", "third").write.partitionBy(
        "file", "third").option("header", True).csv(f"{root}/hdong_codes_all.csv")
    rows = files.read_region_files(spark, root)
    return rows.groupBy("sido_cd").agg(F.count("*").alias("n"), F.countDistinct("source_file", "third").alias("n_files"))


# -- landed pages -----------------------------------------------------------

PAGE_ROWS = 500


def store_pages(spark, folder) -> str:
    """Store rows landed as API pages of at most PAGE_ROWS items: the order number gives the page."""
    path = staging_path(spark, "pages")
    item = schemas.STORE_PAGE["body"].dataType["items"].dataType.elementType
    rows = api_rows(spark, folder)
    fields = [F.col(f.name).alias(f.name) for f in item.fields if f.name in rows.columns]
    # Order numbers are unique, so a page never holds more than PAGE_ROWS of them.
    page = F.floor(F.col("bizesId").cast("bigint") / PAGE_ROWS)
    pages = rows.groupBy(page.alias("page")).agg(F.collect_list(F.struct(*fields)).alias("items"))
    files.write_json(pages.select("page", F.struct("items").alias("body")), path)
    return path


@query("scan_store_pages", with_stores("""
SELECT biz_id AS "bizesId", store_name AS "bizesNm", category_mid AS "indsMclsNm", longitude AS lon, latitude AS lat,
  CAST(floor(CAST(biz_id AS BIGINT) / 500) AS BIGINT) AS page FROM stores"""))
def scan_store_pages(spark, folder):
    return files.read_store_pages(spark, store_pages(spark, folder)).select("bizesId", "bizesNm", "indsMclsNm", "lon", "lat", "page")


@query("scan_status_pages", f"SELECT b_no, b_stt_cd, end_dt FROM ({plain(STATUS_SQL)})")
def scan_status_pages(spark, folder):
    path = staging_path(spark, "status")
    status = view(spark, folder, STATUS_SQL)
    # One hundred numbers per answer, as the service takes them.
    page = F.floor(F.col("b_no").cast("bigint") / 100)
    files.write_json(status.groupBy(page.alias("page")).agg(F.collect_list(F.struct("b_no", "b_stt_cd", "end_dt")).alias("data")), path)
    return files.read_status_pages(spark, path).select("b_no", "b_stt_cd", "end_dt")


def region_documents(spark, folder, lost: str = "false") -> str:
    """The register landed as XML answers: one request per district, pages of at most 100 rows, without the pages ``lost`` says."""
    path = staging_path(spark, "xml")
    register = view(spark, folder, REGISTER_SQL).withColumn("request", F.substring("region_cd", 1, 5))
    total = register.groupBy("request").agg(F.count("*").alias("total"))
    # A code's neighbourhood number gives its page: 30 numbers with at most 3 villages each.
    page = F.floor(F.substring("region_cd", 6, 3).cast("bigint") / 30) + 1
    row = F.concat(
        F.lit("<row><region_cd>"), F.col("region_cd"), F.lit("</region_cd><locatadd_nm>"), F.col("locatadd_nm"),
        F.lit("</locatadd_nm><locat_rm></locat_rm></row>"))
    pages = register.groupBy("request", page.alias("page")).agg(F.array_join(F.collect_list(row), "").alias("rows"))
    document = F.concat(
        F.lit("<StanReginCd><head><totalCount>"), F.col("total").cast("string"), F.lit("</totalCount><numOfRows>100</numOfRows><pageNo>"),
        F.col("page").cast("string"), F.lit("</pageNo><request>"), F.col("request"), F.lit("</request></head>"), F.col("rows"),
        F.lit("</StanReginCd>"))
    pages.filter(f"NOT ({lost})").join(total, "request").select(document.alias("value")).write.text(path)
    return path


@query("scan_region_xml", f"SELECT region_cd, locatadd_nm, '' AS locat_rm FROM ({REGISTER})")
def scan_region_xml(spark, folder):
    return files.read_region_xml(spark, region_documents(spark, folder), per_line=True).select("region_cd", "locatadd_nm", "locat_rm")


LOST_PAGE = "page = 3 AND request % 4 = 1 OR page = 14 AND request % 4 = 2"


@query("page_completeness", f"""
SELECT request, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_rows, any_value(total) AS total,
  sum(n) >= any_value(total) OR max_by(n < 100, page) AND count(*) = max(page) - min(page) + 1 AS complete
FROM (SELECT request, page, count(*) AS n, sum(count(*)) OVER (PARTITION BY request) AS total
  FROM (SELECT substr(region_cd, 1, 5) AS request, CAST(substr(region_cd, 6, 3) AS BIGINT) // 30 + 1 AS page FROM ({REGISTER})) GROUP BY 1, 2)
WHERE NOT (page = 3 AND CAST(request AS INTEGER) % 4 = 1 OR page = 14 AND CAST(request AS INTEGER) % 4 = 2) GROUP BY 1""")
def page_completeness(spark, folder):
    """Of some districts a page in the middle never arrived, of others the last one."""
    documents = files.read_region_documents(spark, region_documents(spark, folder, LOST_PAGE), per_line=True)
    return regions.page_completeness(files.region_pages(documents)).drop("short_end")


ASKED = """SELECT DISTINCT n_nationkey, n_name || '-' || CAST(c_custkey % 5 AS STRING) AS dong_code, n_name AS dong_name
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""


@query("collection_failures", with_stores("""
SELECT dong_code AS dong_cd, dong_name, coalesce(n, 0) AS store_count,
  CASE WHEN error_msg IS NOT NULL THEN 'fail' WHEN n > 0 THEN 'success' ELSE 'no_data' END AS status, error_msg
FROM (SELECT dong_code, dong_name, n, CASE WHEN landed.adong_name IS NOT NULL THEN message
    WHEN n_nationkey % 2 = 1 THEN 'no answer landed' END AS error_msg
  FROM asked LEFT JOIN landed ON landed.adong_name = dong_code LEFT JOIN messages ON messages.adong_name = dong_code)""",
    asked=plain(ASKED),
    landed_pages="""SELECT adong_name, CASE WHEN suffix(adong_name, '1') THEN CAST(biz_id AS BIGINT) // 2000 % 11 ELSE 0 END AS kind, count(DISTINCT CAST(biz_id AS BIGINT) // 2000) AS pages, count(*) AS n
  FROM stores GROUP BY 1, 2""",
    landed="SELECT adong_name, CAST(coalesce(sum(n) FILTER (kind NOT IN (3, 5)), 0) AS BIGINT) AS n FROM landed_pages GROUP BY 1",
    messages="""SELECT adong_name, string_agg(error || CASE WHEN pages > 1 THEN ' x' || pages ELSE '' END, '; '
    ORDER BY error || CASE WHEN pages > 1 THEN ' x' || pages ELSE '' END) AS message
  FROM (SELECT adong_name, pages, CASE kind WHEN 3 THEN 'page is no JSON document' ELSE 'page does not fit its schema: body' END AS error
    FROM landed_pages WHERE kind IN (3, 5)) GROUP BY 1"""))
def collection_failures(spark, folder):
    """Answers per neighbourhood: some cut off, some of another shape, some empty, and some neighbourhoods without any."""
    path = staging_path(spark, "answers")
    asked = view(spark, folder, ASKED)
    rows = stores(spark, folder).select(
        F.col("adong_name").alias("dong_code"), F.floor(F.col("biz_id").cast("bigint") / 2000).alias("page"),
        F.struct(F.col("biz_id").alias("bizesId"), F.col("adong_name").alias("adongNm")).alias("item"))
    pages = rows.groupBy("dong_code", "page").agg(F.collect_list("item").alias("items"))
    kind = F.when(F.endswith("dong_code", F.lit("1")), F.col("page") % 11).otherwise(0)
    whole = F.to_json(F.struct("page", F.struct("items").alias("body")))
    answer = F.when(kind == 3, F.expr("left(answer, length(answer) - 5)")).when(
        kind == 5, F.to_json(F.struct("page", F.lit("busy").alias("body")))).otherwise(F.col("answer"))
    answers = pages.withColumn("answer", whole).select("dong_code", answer.alias("value"))
    empty = asked.filter("n_nationkey % 2 = 0").join(rows.select("dong_code").distinct(), "dong_code", "left_anti")
    answers = answers.unionByName(empty.select("dong_code", F.lit('{"page":0,"body":{"items":[]}}').alias("value")))
    answers.repartition("dong_code").write.partitionBy("dong_code").text(path)
    found = files.read_store_pages(spark, path).withColumnRenamed("adongNm", "dong_code")
    attempts = files.landed_attempts(spark, path, schemas.STORE_PAGE, "dong_code")
    return regions.collection_log(asked, found, attempts=attempts).drop("collected_at")


# -- run tables -------------------------------------------------------------

@query("append_run", with_stores(
    "SELECT biz_id, business_category, CAST(age AS INTEGER) AS age, CAST(round(initial_investment) AS BIGINT) AS initial_investment, "
    "'run-b' AS pipeline_run_id FROM clean", **CLEAN_STEPS))
def append_run(spark, folder):
    path = f"{staging_path(spark, 'cleaned')}"
    clean = stages.clean_stage(stores(spark, folder))
    tables.append_cleaned(clean, path, "run-a")
    tables.append_cleaned(clean, path, "run-b")
    # A second attempt at one run replaces it.
    tables.append_cleaned(clean, path, "run-b")
    return tables.read_runs(spark, path, "run-b").select("biz_id", "business_category", "age", "initial_investment", "pipeline_run_id")


@query("collect_to_labels", with_stores(
    "SELECT biz_id, business_category, survival_1yr, survival_3yr, monthly_revenue, 'run-1' AS pipeline_run_id FROM labelled",
    **CLEAN_STEPS, **LABEL_STEPS))
def collect_to_labels(spark, folder):
    out = stages.collect_to_labels(stores(spark, folder), staging_path(spark, "run"), "run-1")
    return out.select("biz_id", "business_category", "survival_1yr", "survival_3yr", "monthly_revenue", "pipeline_run_id")


COLLECTED = f"""SELECT biz_id, store_name, adong_name, CAST(longitude AS DOUBLE) AS longitude, b_stt_cd AS biz_status_cd, end_dt AS closure_date
FROM (SELECT * EXCLUDE (biz_status_cd) FROM stores) LEFT JOIN ({plain(STATUS_SQL)}) ON b_no = biz_id"""


@query("collect_stores", with_stores(f"SELECT * REPLACE (round(longitude, 6) AS longitude) FROM ({COLLECTED})"))
def collect_stores(spark, folder):
    """Landed store and status pages into the keyed store table."""
    rows = files.read_store_pages(spark, store_pages(spark, folder)).withColumnRenamed("bizesId", "biz_id")
    rows = attach_status(rows, view(spark, folder, STATUS_SQL))
    out = tables.upsert_stores(spark, staging_path(spark, "stores"), rows, [F.desc("page")])
    return out.select("biz_id", "store_name", "adong_name", F.round(F.col("longitude").cast("double"), 6).alias("longitude"),
                      "biz_status_cd", "closure_date")


@query("bulk_load", with_stores(f"""
SELECT 'region_codes' AS name, count(*) AS n FROM ({NORMAL}) WHERE NOT suffix(region_cd_8, '0000')
UNION ALL SELECT 'stores', count(*) FROM stores UNION ALL SELECT 'cleaned_stores', count(*) FROM clean
UNION ALL SELECT 'labeled_stores', count(*) FROM labelled""", **CLEAN_STEPS, **LABEL_STEPS))
def bulk_load(spark, folder):
    """CSV files into all four tables, one run id for the last two."""
    root = staging_path(spark, "load")
    files.write_csv(regions.normalize_codes(view(spark, folder, HDONG_SQL)), f"{root}/in/hdong_codes_11.csv")
    files.write_csv(to_table_names(api_rows(spark, folder)), f"{root}/in/stores")
    clean = stages.clean_stage(stores(spark, folder))
    files.write_csv(clean, f"{root}/in/cleaned")
    files.write_csv(stages.label_stage(files.read_csv(spark, f"{root}/in/cleaned", clean.schema)), f"{root}/in/labeled")

    found = files.read_region_files(spark, f"{root}/in")
    found = found.filter(~regions.aggregate_level())
    loaded = {
        "region_codes": tables.upsert_regions(spark, f"{root}/region_codes", found, [F.desc("source_file")]),
        "stores": tables.upsert_stores(spark, f"{root}/stores", files.read_csv_text(spark, f"{root}/in/stores"), [F.desc("store_name")]),
    }
    tables.append_cleaned(files.read_csv_text(spark, f"{root}/in/cleaned"), f"{root}/cleaned_stores", "load-1")
    tables.append_labeled(files.read_csv_text(spark, f"{root}/in/labeled"), f"{root}/labeled_stores", "load-1")
    for name in ("cleaned_stores", "labeled_stores"):
        loaded[name] = tables.read_runs(spark, f"{root}/{name}", "load-1")
    out = None
    for name, df in loaded.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("feature_export", with_stores("""SELECT count(*) AS n_rows, 24 AS n_features,
  round(avg(risk_score), 5) AS mean_risk FROM labelled""", **CLEAN_STEPS, **LABEL_STEPS))
def feature_export(spark, folder):
    rows = stage(stages.label_stage(stages.clean_stage(stores(spark, folder))), "labelled")
    state = stages.fit_features(rows)
    path, matrix = staging_path(spark, "features"), stages.transform_features(rows, state)
    stages.export_features(matrix, path, state)
    listed = files.read_csv(spark, f"{path}/feature_columns")
    # The types are known: inferring them would read the whole file once more.
    matrix = files.read_csv(spark, f"{path}/features", matrix.schema)
    return matrix.agg(F.count("*").alias("n_rows"), F.round(F.avg("risk_score"), 5).alias("mean_risk")).withColumn(
        "n_features", listed.agg(F.count("*")).scalar().cast("int"))


# -- streams ----------------------------------------------------------------

@query("stream_upsert", with_stores("SELECT biz_id, store_name, category_large, adong_name FROM stores"))
def stream_upsert(spark, folder):
    """Pages arrive in several micro-batches; afterwards the table holds every store once."""
    landed, root = store_pages(spark, folder), staging_path(spark, "stream")
    rows = ingest.store_page_stream(spark, landed, files_per_batch=4)
    ingest.stream_upsert(rows, root, f"{root}/_checkpoint").awaitTermination()
    return ingest.current_stores(spark, root).select("biz_id", "store_name", "category_large", "adong_name")


def event_stream(spark, folder) -> DataFrame:
    """Events landed as files, read as a stream."""
    path = staging_path(spark, "events")
    table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


@query("stream_dedupe", "SELECT DISTINCT user_id FROM events")
def stream_dedupe(spark, folder):
    """Within a watermark longer than the data only the first event of a user stays."""
    root = staging_path(spark, "dedupe")
    once = ingest.stream_dedupe(event_stream(spark, folder), "user_id", "ts", "60 days").select("user_id")
    ingest.to_parquet(once, f"{root}/out", f"{root}/_checkpoint").awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{root}/out")


@query("stream_latest", """
WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen_at, event_id, event_type, round(value, 4) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY ts DESC, event_id DESC) AS rn FROM g)
WHERE rn = 1 AND ts + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_latest(spark, folder):
    """The last event of each run of a user's events that the watermark has passed, with its values."""
    root = staging_path(spark, "latest")
    out = ingest.stream_latest(event_stream(spark, folder), "user_id", "ts", ["ts", "event_id"])
    ingest.to_parquet(out, f"{root}/out", f"{root}/_checkpoint").awaitTermination()
    done = spark.read.schema(out.schema).parquet(f"{root}/out")
    return rounded(done, 4, "value").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at"), "event_id", "event_type", "value")


@query("stream_windows", """
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL 1 DAY, min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_windows(spark, folder):
    """Append mode hands out the windows the watermark has passed; the last day stays open."""
    root = staging_path(spark, "windows")
    out = ingest.collection_windows(event_stream(spark, folder), "ts", "event_type", "value", delay="1 day")
    ingest.to_parquet(out, f"{root}/out", f"{root}/_checkpoint").awaitTermination()
    done = spark.read.schema(out.schema).parquet(f"{root}/out")
    return rounded(done, 4, "total").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n", "total")


