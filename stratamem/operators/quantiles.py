"""Exact order statistics and row numbers of groups of any size, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.sources.tables import kept

#: Stretches that an interval is counted in, a round.
PROBES = 1024


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], probes: int = PROBES) -> DataFrame:
    """by, and for each name the value at a rank of its group: ranks gives the rank from 1 as a function of the group's size.

    A round counts each wanted value's interval in `probes` stretches, with the least and greatest value of
    each, and goes on in the stretch that holds the rank, until its least value is its greatest. All groups go
    at once, counts combine before they are shuffled, and no group is sorted or gathered; a few rounds
    do for most data. Nulls and NaN are left out, a group of nothing else too. The rank must lie within 1 and the size.
    """
    kind = df.schema[value].dataType.simpleString()
    rows = df.select(*by, F.col(value).alias("x_")).where(F.col("x_").isNotNull() & ((~F.isnan("x_")) if kind in ("double", "float") else F.lit(True)))
    # a difference that neither overflows nor loses the low digits of whole numbers
    gap = (lambda a, b: (a / 2 - b / 2).cast("double")) if kind in ("double", "float") else (lambda a, b: (a.cast("decimal(38,6)") - b.cast("decimal(38,6)")).cast("double"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"), F.min("x_").alias("lo_"), F.max("x_").alias("hi_"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name_"), rank(F.col("n_")).cast("long").alias("left_")) for name, rank in ranks.items()])).alias("w_")
    found = kept(sizes.select(*by, wanted, "lo_", "hi_").select(*by, "w_.*", "lo_", "hi_"), "ranks")
    order = W.partitionBy(*by, "name_").orderBy("bin_").rowsBetween(W.unboundedPreceding, -1)
    while not (active := found.where("lo_ < hi_")).isEmpty():
        met = rows.join(active.withColumnsRenamed({c: f"{c}_of_" for c in by}), [rows[c].eqNullSafe(F.col(f"{c}_of_")) for c in by] or F.lit(True)).where("x_ >= lo_ AND x_ <= hi_")
        at = F.least(F.floor(gap(F.col("x_"), F.col("lo_")) / gap(F.col("hi_"), F.col("lo_")) * probes), F.lit(probes - 1)).alias("bin_")
        counted = met.groupBy(*by, "name_", "left_", at).agg(F.count(F.lit(1)).alias("c_"), F.min("x_").alias("lo_"), F.max("x_").alias("hi_"))
        below = counted.withColumn("below_", F.coalesce(F.sum("c_").over(order), F.lit(0)))
        holds = below.where((F.col("left_") > F.col("below_")) & (F.col("left_") <= F.col("below_") + F.col("c_")))
        found = kept(holds.select(*by, "name_", (F.col("left_") - F.col("below_")).alias("left_"), "lo_", "hi_").unionByName(found.where("lo_ >= hi_")), "ranks")
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name_") == name, F.col("lo_"))).alias(name) for name in ranks])


def half_even(q: float) -> Callable[[Column], Column]:
    """The rank nearest to the share q of the way, half to even."""
    return lambda n: F.bround(F.lit(q) * (n - 1)) + 1


def upper_middle(n: Column) -> Column:
    """The rank of the upper median."""
    return F.floor(n / 2) + 1


def row_numbers(rows: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """rows with `name`, their number from 1 in their group by `order`, which should leave no ties open.

    Rows are sorted in ranges of group and order, so that a large group goes to many tasks; the rows of a
    group in a range follow each other, and what stands before them is known from a row a group and range.
    """
    keys = [*[F.col(c) for c in by], *order]
    placed = kept(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id()), "numbered")
    stretch = F.shiftright("at_", 33)
    firsts = placed.groupBy(*by, stretch.alias("part_")).agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(W.partitionBy(*by).orderBy("part_").rowsBetween(W.unboundedPreceding, -1))
    firsts = firsts.select(*[F.col(c).alias(f"{c}_of_") for c in by], "part_", "first_", F.coalesce(before, F.lit(0)).alias("before_"))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_of_")) for c in by] + [stretch == F.col("part_")]
    number = (F.col("before_") + F.col("at_") - F.col("first_") + 1).cast("long").alias(name)
    return placed.join(firsts, on).select(*rows.columns, number)
