"""Sharding by histogram sort.

Rows are put in order by one key, text checksum first, so that equal texts stand together. The
boundaries between shards are found without moving a row: each round counts, in one aggregation, the
exact bytes below a few hundred probe keys, and narrows the interval in which each boundary lies, until
the bytes below it are near enough to its share. Then rows are exchanged once.
"""

from __future__ import annotations

import bisect

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.llm import common

SHARDS = 16
#: A boundary may miss its share by this part of a shard.
TOLERANCE = 0.002
#: Probes a boundary and round.
PROBES = 8
#: Rows of a stripe of a shard, about.
STRIPE_ROWS = 250_000
_LOW = "0" * 16
#: Digits of the checksum, the id and the place in a key.
_PARTS = ((0, 8), (8, 24), (24, 40))
SEED = 5


def sort_key(id_col: str = "doc_id", text: str = "text") -> Column:
    """40 hexadecimal digits whose order is that of the text's CRC-32, then of the id, then of a seeded place.

    A null id comes before all others. The place tells rows apart that are equal in id and text, so that no key is
    heavier than a row.
    """
    sign = F.lit(-(1 << 63)).cast("long")
    ordered = F.lpad(F.lower(F.hex(F.col(id_col).cast("long").bitwiseXOR(sign))), 16, "0")
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(digits(F.crc32(common.text_or_empty(text).cast("binary")), 8), F.coalesce(ordered, F.lit(_LOW)), digits(F.xxhash64(F.lit(SEED), F.monotonically_increasing_id()), 16))


def place(key: Column, cuts: list[str]) -> Column:
    """How many of the ascending cuts are at most key, by a tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def _probes(lo: str, hi: str, n: int) -> list[str]:
    """Keys above lo and at most hi; while they span several checksums, only where a checksum begins, and likewise for ids."""
    at, to = next((a, b) for a, b in _PARTS if lo[a:b] != hi[a:b])
    low, high = int(lo[at:to], 16), int(hi[at:to], 16)
    return sorted({f"{lo[:at]}{low + max(1, (high - low) * i // n):0{to - at}x}".ljust(40, "0") for i in range(1, n + 1)})


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[str]:
    """shards - 1 ascending keys; a row belongs to the shard of as many as are at most its key.

    rows: key, size. For each boundary the search holds a lower key and an upper one with the bytes
    below each. One round's aggregate gives for each gap between probes the bytes and the least and
    greatest key in it, so that empty stretches of the key space are left at once. It ends when every
    boundary is within tolerance or its interval holds a single key.
    """
    total = rows.agg(F.sum("size").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    if not total["n"]:
        return []
    share = total["n"] / shards
    want = [share * i for i in range(1, shards)]
    # (bytes below lo, lo, bytes up to hi, hi): the keys among which the boundary lies
    span = [(0, total["lo"], total["n"], total["hi"])] * (shards - 1)
    best: list[tuple[float, str]] = [(w, total["lo"]) for w in want]  # all rows above
    for i, w in enumerate(want):
        if abs(total["n"] - w) < w:
            best[i] = (abs(total["n"] - w), total["hi"] + "g")
    while True:
        open_ = [i for i in range(shards - 1) if best[i][0] > tolerance * share and span[i][1] != span[i][3]]
        cuts = sorted({p for i in open_ for p in _probes(span[i][1], span[i][3], probes)})
        if not cuts:
            return sorted(k for _, k in best)
        found = rows.groupBy(place(F.col("key"), cuts).alias("gap")).agg(F.sum("size").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        gaps = {x["gap"]: x for x in found}
        below, ordered = 0, []
        for g in sorted(gaps):
            x = gaps[g]
            ordered.append((below, x["lo"], below + x["n"], x["hi"]))
            below += x["n"]
        starts = [x[0] for x in ordered]
        for i in open_:
            at = bisect.bisect_right(starts, want[i]) - 1
            for miss, key in ((abs(want[i] - ordered[at][0]), ordered[at][1]), (abs(want[i] - ordered[at][2]), ordered[at + 1][1] if at + 1 < len(ordered) else ordered[at][3] + "g")):
                if miss < best[i][0]:
                    best[i] = (miss, key)
            # a gap may reach beyond the interval, where only other boundaries have probes
            low, high = max(span[i][:2], ordered[at][:2], key=lambda x: x[1]), min(span[i][2:], ordered[at][2:], key=lambda x: x[1])
            span[i] = (*low, *high)


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, shard, slot.

    size is the UTF-8 bytes of the text, none if null, and one. Shards differ in bytes by no more than
    the tolerance on either side, or by what one row weighs where that is more. Equal texts share a shard
    unless a boundary has to fall among them; that holds for rows equal in id and text, too, whose places
    are drawn by seed. Where all rows are fewer than the shards, some shards stay empty. Slots count from 0 in each shard without a gap, by stripe, then by
    key. Other columns of docs are left out; an empty table gives an empty table.

    Only keys and sizes are cached, and only they are exchanged. A stripe holds part of a shard, so that
    no task handles a whole one.
    """
    text = common.text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), sort_key().alias("key"))
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)
    cuts = splitters(held.select("key", "size"), shards, tolerance)
    dealt = held.withColumn("shard", place(F.col("key"), cuts))
    n = held.count()
    stripes = max(1, -(-n // (STRIPE_ROWS * shards)), -(-2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    dealt = dealt.withColumn("stripe", F.pmod(F.xxhash64("key"), F.lit(stripes)).cast("int"))
    counts = dealt.groupBy("shard", "stripe").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("stripe").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = common.written(counts.select("shard", "stripe", before.alias("first")), "stripes")
    held.unpersist()
    nth = F.row_number().over(W.partitionBy("shard", "stripe").orderBy("key", "size")) - 1
    out = dealt.withColumn("nth", nth).join(first, ["shard", "stripe"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"))


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
