"""Parquet tables: run-partitioned appends, upserts by key, fitted state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from storegrain import schemas
from storegrain.operators.features import Scaler, scaler_from_table, scaler_table
from storegrain.operators.mapping import nan_to_null, project, to_region_names, to_table_names
from storegrain.operators.runs import run_list
from storegrain.operators.upsert import upsert
from storegrain.session import stage


def _stamped(df: DataFrame, schema: T.StructType, run_id: str, stamp: str) -> DataFrame:
    known = project(nan_to_null(df), schema, leave_out=("pipeline_run_id", stamp))
    return known.withColumns({stamp: F.current_timestamp(), "pipeline_run_id": F.lit(run_id)})


def append_run(df: DataFrame, path: str, run_id: str, schema: T.StructType, stamp: str) -> None:
    """Append rows as a partition of their run; columns the table does not know are left out.

    An earlier attempt at the same run is replaced, so a repeated job does not double it.
    """
    (_stamped(df, schema, run_id, stamp).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("pipeline_run_id").parquet(path))


def append_cleaned(df: DataFrame, path: str, run_id: str) -> None:
    append_run(df, path, run_id, schemas.CLEANED_STORES, "cleaned_at")


def append_labeled(df: DataFrame, path: str, run_id: str) -> None:
    append_run(df, path, run_id, schemas.LABELED_STORES, "labeled_at")


def read_runs(spark: SparkSession, path: str, run_id: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A run-partitioned table; naming a run prunes to its folder.

    Run ids are text, whatever they look like. A table without files needs ``schema``; it is then empty.
    """
    if schema is None:
        schema = spark.read.option("basePath", path).parquet(path).schema
    # the type of a folder's value must be given, or 00012 would be read as 12
    fields = [f for f in schema.fields if f.name != "pipeline_run_id"]
    typed = T.StructType([*fields, T.StructField("pipeline_run_id", T.StringType())])
    df = spark.read.schema(typed).option("basePath", path).parquet(path)
    return df.filter(F.col("pipeline_run_id") == run_id) if run_id is not None else df


def drop_old_runs(spark: SparkSession, path: str, keep: int, stamp: str) -> list[str]:
    """Keep the newest ``keep`` runs; the others lose their folders, no row is rewritten."""
    listed = run_list(read_runs(spark, path), "pipeline_run_id", stamp)
    old = [r[0] for r in listed.orderBy(F.desc("last_at"), F.desc("pipeline_run_id")).offset(keep).collect()]
    sc = spark.sparkContext
    escape = sc._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for run_id in old:
        folder = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/pipeline_run_id={escape(run_id)}")
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
    return old


# -- keyed tables -----------------------------------------------------------

#: Buckets of a new keyed table. One bucket is what a single key costs an upsert: choose it so that a bucket is 1 GB at most.
BUCKETS = 32
#: The bucket of rows without a key; they collide with nothing, so they are only appended.
KEYLESS = -1


class KeyedTable:
    """A Parquet table in folders by hash bucket of its key; an upsert overwrites the folders of the buckets that its batch touches.

    The merged rows are staged before the old ones are replaced. A batch whose write failed is merged again: that gives the same rows, those of
    rows without a key apart, which are appended as often as they are written. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key, self.new_buckets = spark, root.rstrip("/"), schema, key, buckets

    def _stored(self) -> DataFrame | None:
        """All rows with ``_of`` (the number of buckets) and ``_bucket``; None before the first write."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder) or not any("_of=" in x.getPath().getName() for x in fs.listStatus(folder)):
            return None
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_of", T.IntegerType()), T.StructField("_bucket", T.IntegerType())])).parquet(self.root)

    def read(self) -> DataFrame:
        stored = self._stored()
        return self.spark.createDataFrame([], self.schema) if stored is None else stored.select(*self.schema.names)

    def upsert(self, batch: DataFrame, order: list, now=None) -> DataFrame:
        """Merge ``batch``; it is read twice (its buckets, its rows), so hand over a stored one if it is costly."""
        stored = self._stored()
        buckets = self.new_buckets if stored is None else stored.select("_of").first()[0]  # once chosen, the number stays
        key = F.col(self.key).cast(self.schema[self.key].dataType)
        bucket = F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(buckets))).otherwise(KEYLESS).cast("int")
        touched = {r[0] for r in batch.select(bucket.alias("b")).distinct().collect()}  # one number for each bucket at most
        if not touched:
            return self.read()
        keyed = touched - {KEYLESS}
        old = self.read().limit(0) if stored is None else stored.filter(F.col("_bucket").isin(*keyed)).select(*self.schema.names) if keyed else self.read().limit(0)
        merged = upsert(old, batch, self.key, order, now).withColumns({"_of": F.lit(buckets), "_bucket": bucket})
        # keyless rows share a bucket, so they are spread by their content; others have a task for each bucket
        spread = F.when(F.col("_bucket") == KEYLESS, F.xxhash64(*self.schema.names)).otherwise(F.col("_bucket"))
        merged = stage(merged, "merged")
        parts = merged.repartition("_bucket", spread)
        if keyed:
            (parts.filter(F.col("_bucket") != KEYLESS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("_of", "_bucket").parquet(self.root))
        if KEYLESS in touched:
            parts.filter(F.col("_bucket") == KEYLESS).write.mode("append").partitionBy("_of", "_bucket").parquet(self.root)
        return self.read()


def upsert_stores(spark: SparkSession, root: str, df: DataFrame, order: list, now=None) -> DataFrame:
    """API or table rows into ``stores`` by ``biz_id``."""
    batch = nan_to_null(to_table_names(df))
    return KeyedTable(spark, root, schemas.STORES, "biz_id").upsert(batch, order, now)


def upsert_regions(spark: SparkSession, root: str, df: DataFrame, order: list) -> DataFrame:
    """Region rows into ``region_codes`` by ``region_cd``."""
    batch = to_region_names(df)
    return KeyedTable(spark, root, schemas.REGION_CODES, "region_cd").upsert(batch, order)


# -- feature sets and fitted state ------------------------------------------

def feature_set_meta(run_id: str, features: DataFrame, columns: list[str], targets: list[str], scaler: Scaler,
                     classes: DataFrame, source_rows: int | None = None) -> DataFrame:
    """One row describing a feature set; the matrix itself stays in rows.

    The row lists the classes of every column, as the class table does.
    """
    n = features.agg(F.count("*").alias("n_samples"))
    lists = classes.groupBy("column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "class"))), lambda x: x["class"]).alias("classes"))
    class_map = lists.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column_name", "classes")))))
    params = F.create_map(*[x for name, values in (
        ("mean", scaler.centre), ("scale", scaler.scale), ("var", scaler.extra)) for x in (
        F.lit(name), F.array(*[F.lit(float(values[c])) for c in columns if c in values]))])
    return n.select(
        F.lit(run_id).alias("pipeline_run_id"), F.array(*[F.lit(c) for c in columns]).alias("feature_columns"),
        F.array(*[F.lit(c) for c in targets]).alias("target_columns"), "n_samples",
        F.lit(len(columns)).alias("n_features"), F.lit(len(targets)).alias("n_targets"),
        params.alias("scaler_params"), class_map.scalar().alias("encoder_classes"),
        (F.lit(source_rows).cast("bigint") if source_rows is not None else F.col("n_samples")).alias("source_row_count"),
        F.current_timestamp().alias("created_at"))


def feature_list(spark: SparkSession, columns: list[str]) -> DataFrame:
    """Numbered feature names."""
    names = spark.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("i", "feature"))
    return names.select((F.col("i") + 1).alias("position"), "feature")


def save_state(path: str, classes: DataFrame, scaler: Scaler) -> None:
    """Class table and scaler as Parquet; the feature list is the scaler's column order."""
    classes.write.mode("overwrite").parquet(f"{path}/encoder_classes")
    table = scaler_table(classes, scaler).withColumn("kind", F.lit(scaler.kind))
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler_params")


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, Scaler]:
    table = spark.read.parquet(f"{path}/scaler_params")
    kind = table.select("kind").first()
    return spark.read.parquet(f"{path}/encoder_classes"), scaler_from_table(table, kind[0] if kind else "standard")


def save_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One part; only its folder is read."""
    return spark.read.parquet(path).filter(F.col("split") == split).drop("split")
