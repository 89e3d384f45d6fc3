from pyspark.sql import functions as F

from storegrain.streaming import ingest


def land(spark, path, page, rows):
    items = spark.createDataFrame(rows, "bizesId string, bizesNm string").agg(F.collect_list(F.struct("bizesId", "bizesNm")).alias("items"))
    items.select(F.lit(page).cast("bigint").alias("page"), F.struct("items").alias("body")).coalesce(1).write.mode("append").json(path)


def test_pages_arrive_over_time(spark, tmp_path):
    landed, root = str(tmp_path / "in"), str(tmp_path / "stores")

    def run():
        rows = ingest.store_page_stream(spark, landed)
        ingest.stream_upsert(rows, root, f"{root}/_checkpoint").awaitTermination()
        return sorted((r.biz_id, r.store_name) for r in ingest.current_stores(spark, root).collect())

    land(spark, landed, 1, [("1", "a"), ("2", "b")])
    assert run() == [("1", "a"), ("2", "b")]
    land(spark, landed, 2, [("2", "B"), ("3", "c")])
    assert run() == [("1", "a"), ("2", "B"), ("3", "c")]
    assert run() == [("1", "a"), ("2", "B"), ("3", "c")]


def test_late_rows_are_left_out_of_closed_windows(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")

    def write(rows):
        spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode(
            "append").parquet(path)

    def run():
        stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(path)
        windows = ingest.collection_windows(stream, "ts", "k", "v", delay="1 hour")
        ingest.to_parquet(windows, out, str(tmp_path / "cp")).awaitTermination()
        return {(str(r.window_start)[:10], r.k): (r.n, r.total) for r in spark.read.parquet(out).collect()}

    write([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 11:00:00", "a", 2.0), ("2024-01-03 00:30:00", "a", 1.0)])
    assert run() == {("2024-01-01", "a"): (2, 3.0)}
    write([("2024-01-01 12:00:00", "a", 9.0), ("2024-01-05 00:00:00", "a", 1.0)])
    assert run() == {("2024-01-01", "a"): (2, 3.0), ("2024-01-03", "a"): (1, 1.0)}


def test_first_row_per_key(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("2024-01-01 10:00:00", "a"), ("2024-01-01 10:05:00", "a"), ("2024-01-01 10:06:00", "b")]
    spark.createDataFrame(rows, "ts string, k string").withColumn("ts", F.to_timestamp("ts")).write.parquet(path)
    stream = ingest.stream_dedupe(spark.readStream.schema("ts timestamp, k string").parquet(path), "k", "ts", "1 day").select("k")
    ingest.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_latest_row_per_key(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")

    def write(rows):
        spark.createDataFrame(rows, "ts string, k string, v int").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = ingest.stream_latest(spark.readStream.schema("ts timestamp, k string, v int").parquet(path), "k", "ts", ["ts", "v"], "1 hour")
        ingest.to_parquet(stream, out, str(tmp_path / "cp")).awaitTermination()
        return sorted((r.k, r.v) for r in spark.read.schema("ts timestamp, k string, v int").parquet(out).collect())

    write([("2024-01-01 10:00:00", "a", 1), ("2024-01-01 10:30:00", "a", 2), ("2024-01-01 10:30:00", "a", 3), ("2024-01-01 10:10:00", "b", 4)])
    assert run() == []  # a later row may still come
    write([("2024-01-01 11:10:00", "a", 5), ("2024-01-01 13:00:00", "c", 6)])
    assert run() == [("b", 4)]  # a was extended and is still open
    write([("2024-01-01 18:00:00", "c", 7), ("2024-01-01 10:40:00", "b", 8)])
    assert run() == [("a", 5), ("b", 4), ("c", 6)]  # b's row came behind the watermark
