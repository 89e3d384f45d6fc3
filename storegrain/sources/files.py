"""File sources and sinks: CSV, JSON pages, XML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from storegrain import schemas


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """CSV with a header. A schema saves the extra pass that inference needs."""
    reader = spark.read.options(header=True, **options)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_csv_text(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV with every column as text, so codes keep their leading zeros."""
    return spark.read.options(header=True, inferSchema=False, **options).csv(path)


def read_region_files(spark: SparkSession, folder: str, pattern: str = "hdong_codes_*.csv") -> DataFrame:
    """All region files of a folder in one scan, with the file each row came from."""
    df = read_csv(spark, f"{folder}/{pattern}", schemas.REGION_FILE)
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    """CSV parts with a header. Spark writes UTF-8 without a byte-order mark."""
    df.write.mode(mode).options(header=True, **options).csv(path)


def rejected_pages(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """``file, record`` of every landed page that is no JSON document of the schema; the readers below leave these out."""
    known = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    pages = spark.read.schema(known).json(path, multiLine=multi_line).select("*", F.col("_metadata.file_path").alias("file"))
    # Spark refuses to read the corrupt column alone, so what could be parsed is looked at, too
    parsed = F.length(F.to_json(F.struct(*schema.names)))
    return pages.filter(F.col("_corrupt_record").isNotNull() & (parsed >= 0)).select(
        "file", F.col("_corrupt_record").alias("record"))


def landed_attempts(spark: SparkSession, path: str, schema: T.StructType, code: str, multi_line: bool = False) -> DataFrame:
    """One row ``(code, error)`` per answer landed under ``path/code=.../``: null for a readable page, else what is wrong.

    Spark reads the code from the folder, so it is known for a page that is no JSON at all. A page of which not a
    single field could be read is called broken as a whole, other broken pages by the fields that are missing.
    """
    known = T.StructType([
        *schema.fields, T.StructField("_corrupt_record", T.StringType()), T.StructField(code, T.StringType())])
    pages = spark.read.schema(known).json(path, multiLine=multi_line)
    lost = F.array_join(F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in schema.names])), ", ")
    nothing = F.lit(", ".join(schema.names))
    broken = F.col("_corrupt_record").isNotNull()
    error = F.when(broken & (lost == nothing), "page is no JSON document").when(
        broken, F.concat(F.lit("page does not fit its schema: "), lost)).when(
        F.col(schema.names[-1]).isNull(), F.lit(f"answer without {schema.names[-1]}"))
    return pages.select(F.col(code), error.alias("error"))


def read_store_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Landed store API pages, one JSON document per line or (``multi_line``) per file; a page without items adds no rows.

    Broken pages are in ``rejected_pages``.
    """
    pages = spark.read.schema(schemas.STORE_PAGE).json(path, multiLine=multi_line)
    return pages.select("page", F.explode("body.items").alias("item")).select("page", "item.*")


def read_status_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Landed status pages, as ``read_store_pages`` reads them."""
    pages = spark.read.schema(schemas.STATUS_PAGE).json(path, multiLine=multi_line)
    return pages.select(F.explode("data").alias("item")).select("item.*")


def read_region_documents(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Landed region XML: one row per response with its head and its ``row`` elements.

    One response per file, or with ``per_line`` any number per file, one to a line; such
    files can be split between tasks.
    """
    return spark.read.format("xml").options(rowTag="StanReginCd", multiLine=not per_line).schema(
        schemas.REGION_PAGE).load(path)


def read_region_xml(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Region rows of all responses; an absent text is the empty string."""
    rows = read_region_documents(spark, path, per_line).select(F.explode("row").alias("r")).select("r.*")
    return rows.na.fill("")


def region_pages(documents: DataFrame) -> DataFrame:
    """Page headers with the number of rows each page brought."""
    return documents.select(
        F.col("head.request").alias("request"), F.col("head.pageNo").alias("page"),
        F.col("head.numOfRows").alias("page_size"), F.coalesce("head.totalCount", F.lit(0)).alias("total"),
        F.coalesce(F.size("row"), F.lit(0)).cast("bigint").alias("n_rows"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
