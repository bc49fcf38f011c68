"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within each source. A source's budget is met by whole passes
over the source, then by an even share of every length, rounded by a seeded draw, for all but the last few
thousand words, and these by a bounded-knapsack dynamic program over the documents that are left. The plan says
how many documents of each length go once more; a seeded hash says which.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.llm import common

#: Words that the even share leaves to the dynamic program, at least; also three times the longest document.
TABLE_WORDS = 1 << 13
SEED = 20_240
#: A length's documents are ranked in so many seeded parts, so that no task holds a whole length.
PARTS = 64


def n_words(text: str = "text") -> Column:
    return F.size(common.words(F.col(text))).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target. sources: one row a source (source, source_size).

    Weights repeat along the sources in code-point order, null last. share x all words are dealt by
    weight; a source's target stops at most x its size, and the excess goes to the others by weight,
    round by round, until none is above. Each round is one aggregate over one row a source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    table = common.written(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))), "sources")
    total = table.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    full = F.lit(False)
    level, stopped = 0.0, -1
    while True:
        x = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count_if(full).alias("n")).first()
        if x["n"] == stopped or not x["weight"]:
            break
        stopped, level = x["n"], (share * total - x["used"]) / x["weight"]
        full = F.col("weight") * F.lit(level) > F.col("cap")
    return table.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: Sequence[int] = (0,)) -> np.ndarray:
    """How many documents of each length to take, at most counts, for a sum as near budget as found and never above.

    An even share of each length first, of a budget that is smaller by what the table is to fill. Where a
    share is no whole number, systematic rounding from a seeded start, along ascending lengths, decides; its sum
    misses the share's by less than twice the longest length. Then a subset-sum table over all
    documents left, kept as the bits of an integer, lengths in seeded order, each length's count split into powers
    of two. A budget that the table alone covers gets the greatest sum that exists; otherwise it is the greatest
    that completes the even share. No length is favoured: neither step prefers long documents or short ones.
    """
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.astype(np.int64).copy()
    draw = np.random.default_rng(list(seed))
    shared = budget - max(TABLE_WORDS, 3 * int(sizes.max()))
    if shared > 0:
        take = np.array([int(c) * shared // total for c in counts], np.int64)
        parts = np.array([int(c) * shared % total / total for c in counts])
        up = np.argsort(sizes, kind="stable")
        steps = np.floor(np.cumsum(parts[up]) + draw.random())
        take[up] += np.diff(np.append(0, steps)).astype(np.int64)
        take = np.minimum(take, counts)
    left = budget - int((take * sizes).sum())
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for k in draw.permutation(len(sizes)):
        size, free = int(sizes[k]), int(counts[k] - take[k])
        if not size or size > left:
            continue
        free, part = min(free, left // size), 1
        while free > 0 and not reach >> left & 1:
            part = min(part, free)
            before, reach = reach, (reach | reach << part * size) & mask
            if reach != before:
                steps.append((k, part, before))
            free -= part
            part *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for k, part, before in reversed(steps):
        if not before >> at & 1:
            take[k] += part
            at -= part * int(sizes[k])
    return take


def _plan(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    whole = int(pdf["source_size"].iloc[0])
    budget = int(round(float(pdf["target"].iloc[0])))
    passes = budget // whole if whole else 0
    extra = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), budget - passes * whole, (seed, zlib.crc32(pdf["src"].iloc[0].encode())))
    return pdf[["src", "size", "source_size", "target"]].assign(passes=np.int64(passes), extra=extra)


def takes(docs: DataFrame, sizes: Column, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, source, rk, size, source_size, target, times.

    times says how often the mix takes the document; rk is a key of its id and text. docs has doc_id,
    text and source. A null source is a source of its own, listed last; a null text has size 0. A
    document is taken at most ceil(most) times, and a source's takes add up to its target as near as
    whole documents allow. The hash of seed, id and text decides which documents of a length are taken,
    so reruns agree; rows equal in both are alike, and which of them is taken makes no difference. Other
    columns of docs are left out. An empty table gives an empty table.

    Texts are read once and never shuffled.
    """
    # '=' before a source keeps a null apart from any text
    src = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("src")
    rows = docs.select("doc_id", "source", src, common.row_key().alias("rk"), sizes.alias("size"))
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), "rk")).withColumn("part", F.pmod("draw", F.lit(PARTS)).cast("int"))
    rows = common.written(rows, "sizes")
    lengths = common.written(rows.groupBy("src", "source", "size", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sources, weights, share, most).select(src, "source_size", "target")
    by_length = lengths.groupBy("src", "size").agg(F.sum("n").alias("n")).join(goal, "src")
    plan = by_length.groupBy("src").applyInPandas(lambda pdf: _plan(pdf, seed), "src string, size long, source_size long, target double, passes long, extra long")
    # how many documents of a length stand before each part
    before = F.coalesce(F.sum("n").over(W.partitionBy("src", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = common.written(lengths.select("src", "size", "part", before.alias("before")).join(plan, ["src", "size"]), "plan")
    place = F.row_number().over(W.partitionBy("src", "size", "part").orderBy("draw", "rk"))
    ranked = rows.withColumn("place", place).join(cut, ["src", "size", "part"])
    times = F.col("passes") + F.when(F.col("before") + F.col("place") <= F.col("extra"), 1).otherwise(0)
    return ranked.select("doc_id", "source", "rk", "size", "source_size", "target", times.alias("times"))


def mix(docs: DataFrame, sizes: Column, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """Each row of docs as often as the mix takes it, with its columns; empties and nulls as for takes.

    Rows equal in id and text are taken as often, together, as their takes add up to: each row is
    joined to its own take, numbered within the key.
    """
    number = lambda by: F.row_number().over(W.partitionBy("_rk").orderBy(by))
    own = docs.columns
    dealt = takes(docs, sizes, weights, share, most, seed).select(F.col("rk").alias("_rk"), F.col("times").alias("_times")).withColumn("_n", number("_times"))
    rows = docs.withColumn("_rk", common.row_key()).withColumn("_n", number(F.col("source")))
    return rows.join(dealt.where("_times > 0"), ["_rk", "_n"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*own)


def op10_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = takes(common.documents(spark, sf_dir).select("doc_id", "text", "source"), n_words())
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


@common.other_columns_apart
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with all columns it came with, whatever their names."""
    return mix(docs, n_words())
