"""All queries of the library with their oracles, gathered from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratamem.functions import questions, text
from stratamem.operators import audits, checks, context, evaluation, extraction, facts, hooks, measures, retrieval, similarity, textindex, timeline, writes
from stratamem.sources import tables
from stratamem.streaming import jobs
from stratamem.streaming import timeline as live

MODULES = (retrieval, textindex, similarity, facts, measures, timeline, evaluation, text, questions, writes, extraction, audits, checks, context, hooks, tables, jobs, live)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of all benchmark texts against all documents."""
    return retrieval.QUERIES["ret01_bm25"](spark, sf_dir)
