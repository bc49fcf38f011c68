"""Queries and oracles of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratamem.llm import brown, divergence, mixing, neardup, packing, pii, quality, repair, secrets, sharding, substring, tokenfiles, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_classes": brown.op1_brown_classes,
    "op2_winnowing": winnowing.op2_winnowing,
    "op3_blob_ledger": secrets.op3_blob_ledger,
    "op4_bounded_space_packing": packing.op4_bounded_space_packing,
    "op5_levelwise_doubling": substring.op5_levelwise_doubling,
    "op6_quality_cascade": quality.op6_quality_cascade,
    "op7_histogram_sort": sharding.op7_histogram_sort,
    "op8_probminhash": neardup.op8_probminhash,
    "op9_disclosure": pii.op9_disclosure,
    "op10_subset_sum_mix": mixing.op10_subset_sum_mix,
    "op11_checkpointed_repair": repair.op11_checkpointed_repair,
    "op12_bit_packing": tokenfiles.op12_bit_packing,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES: dict[str, str] = {**quality.ORACLE, **divergence.ORACLE}
