"""A corpus through five stages: quality, near duplicates, decontamination, secrets, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storegrain.llm import stages
from storegrain.session import staging_path

STAGES = [
    ("quality classifier", stages.quality_stage),
    ("minhash near-dedup", stages.near_dedup_stage),
    ("benchmark decontamination", stages.decontaminate_stage),
    ("secret scan", stages.secrets_stage),
    ("sentencepiece", stages.sentencepiece_stage),
]

#: A fitted model decides in the first stage, which SQL cannot express; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each one is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = staging_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
