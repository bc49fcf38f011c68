"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratamem.llm import common, mixing, neardup, packing, quality, secrets

STAGES = [
    ("quality_rules", quality.stage),
    ("near_duplicates", neardup.stage),
    ("secret_scan", secrets.stage),
    ("source_mix", mixing.stage),
    ("packing", packing.stage),
]

#: Signatures, sampling by seed and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written before the next one reads it."""
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, f"stage-{name}")
    return docs
