"""Landed pages to keyed tables, stream deduplication, collection windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from storegrain import schemas
from storegrain.sources.tables import KeyedTable, upsert_stores


def store_page_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Store rows of landed API pages as they arrive."""
    pages = spark.readStream.schema(schemas.STORE_PAGE).option("maxFilesPerTrigger", files_per_batch).json(path)
    return pages.select("page", F.explode("body.items").alias("item")).select("page", "item.*")


def stream_upsert(rows: DataFrame, root: str, checkpoint: str, order: list | None = None, now=None) -> StreamingQuery:
    """Every micro-batch is merged into the buckets of ``stores`` it touches; a repeated batch changes nothing."""
    spark = rows.sparkSession
    order = [F.desc("page")] if order is None else order

    def merge(batch: DataFrame, _: int) -> None:
        batch.persist()  # it is read for its buckets and for its rows
        try:
            upsert_stores(spark, root, batch, order, now)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_stores(spark: SparkSession, root: str) -> DataFrame:
    return KeyedTable(spark, root, schemas.STORES, "biz_id").read()


def stream_dedupe(rows: DataFrame, key: str, stamp: str, delay: str = "1 day") -> DataFrame:
    """The first row per key within the watermark; state older than ``delay`` is dropped."""
    return rows.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key])


def stream_latest(rows: DataFrame, key: str, stamp: str, order: list[str], delay: str = "1 day") -> DataFrame:
    """The latest row per key, given out once no row of the key has come for ``delay`` and the watermark has passed that.

    The state of a key is one session: a later row (by ``order``) replaces the one that is kept and extends the session. Rows of a key that lie further
    apart are sessions of their own, each with its latest row. Works on streams (append mode) and on tables.
    """
    if rows.isStreaming:
        rows = rows.withWatermark(stamp, delay)
    latest = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("latest")
    return rows.groupBy(F.session_window(stamp, delay).alias("w"), F.col(key).alias("_key")).agg(latest).select("latest.*")


def collection_windows(rows: DataFrame, stamp: str, group: str, amount: str, size: str = "1 day",
                       slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Row count and sum per time window and group. Works on streams and on tables;
    on a stream, rows later than ``delay`` are left out."""
    if rows.isStreaming:
        rows = rows.withWatermark(stamp, delay)
    return rows.groupBy(F.window(stamp, size, slide).alias("w"), group).agg(
        F.count("*").alias("n"), F.sum(amount).alias("total")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), group, "n", "total")


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
