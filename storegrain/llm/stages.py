"""The stages of the corpus pipeline: each takes and returns documents (the last one returns pieces).

Documents have ``doc_id`` and ``text``; all other columns, whatever their names, travel in a struct and come out as they went in. Rows are
judged, not ids: repeated rows and null ids are rows like others. Very long texts are read whole. A table without rows gives one without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.llm import decontaminate, minhash, pieces, quality, secret_scan
from storegrain.llm.common import packed, table, unpacked
from storegrain.session import stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier selects; it is fitted on the labels of documents that are here.

    A null or empty text is judged by its form (none of the features). Without labelled documents the prior decides for all alike.
    """
    model = quality.train(docs.select("doc_id", "text"), quality.graded(table(spark, sf_dir, "labels")))
    return unpacked(quality.judge(packed(docs), model).where("selected"), docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): that with the smallest id (a null id last), of equal ids the first.

    Null, empty and blank texts are like no other and all stay; of equal rows one stays.
    """
    rows = stage(packed(docs, "text", F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("number")), "numbered")
    groups = minhash.near_duplicates(rows.select("number", "text"), "number", k=5, percent=80).select("number", "component_id")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number"))
    kept = groups.join(rows.select("number", "id"), "number").groupBy("component_id").agg(first.alias("first"))
    return unpacked(rows.join(kept.select(F.col("first.number").alias("number")), "number", "left_semi"), docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated: no hit, or hits in less than a twentieth of their words. Null and empty texts have no words and stay."""
    found = decontaminate.find_benchmark(packed(docs), table(spark, sf_dir, "benchmark"))
    return unpacked(found.where(~decontaminate.contaminated()), docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and ``n_chars`` (where there is one) of what is left; null texts stay null."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, piece_ids, scores, other_ids, round_trip`` of what is left; a null text has null ids, an empty one none."""
    model = pieces.default_model()
    return pieces.encode_texts(docs.select("doc_id", "text"), model, round_trip=True).drop("text")
