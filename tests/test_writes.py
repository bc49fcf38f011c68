"""Writes by bucket: only the folders of changed keys are written anew."""

import os
import random

from pyspark.sql import functions as F

from stratamem.operators.writes import Buckets, add_counters, drift, fingerprint
from stratamem.sources.tables import drop_scratch, kept


def files(table):
    root = table.path.removeprefix("file:")
    return {d: sorted(f for f in os.listdir(f"{root}/{d}") if f.startswith("part-")) for d in os.listdir(root) if d.startswith("bucket=")}


def rows_of(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_untouched_folders_keep_their_files(spark):
    rnd = random.Random(12)
    rows = {(k, k % 3): rnd.randrange(100) for k in range(500)}
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "user long, item long, x long")
    table = Buckets(spark, "t", ["user"], buckets=16)
    table.write(frame(rows))
    before = files(table)
    assert len(before) == 16 and rows_of(table) == sorted(((*k, v) for k, v in rows.items()), key=str)
    change = {(7, 1): -1, (7, 2): -2, (9999, 0): -3}
    touched = table.upsert(frame(change), ["user", "item"])
    rows |= change
    after = files(table)
    assert 1 <= len(touched) <= 2 and rows_of(table) == sorted(((*k, v) for k, v in rows.items()), key=str)
    assert {d for d in before if before[d] != after[d]} == {f"bucket={b}" for b in touched}
    assert table.upsert(frame(change), ["user", "item"]) and rows_of(table) == sorted(((*k, v) for k, v in rows.items()), key=str)  # again
    assert table.upsert(frame({}), ["user", "item"]) == [] and files(table).keys() == after.keys()
    # the last version of a key counts
    versions = spark.createDataFrame([(7, 1, 5, 1), (7, 1, 6, 3), (7, 1, 7, 2)], "user long, item long, x long, v int")
    wide = Buckets(spark, "w", ["user"], buckets=2)
    wide.write(versions.limit(0))
    wide.upsert(versions, ["user", "item"], "v")
    assert rows_of(wide) == [(7, 1, 6, 3)]


def test_folders_that_lose_all_rows_and_null_keys(spark):
    table = Buckets(spark, "t", ["k"], buckets=4)
    table.write(spark.createDataFrame([(k,) for k in range(40)] + [(None,)], "k long"))
    table.delete(spark.createDataFrame([(k,) for k in range(40)], "k long"))
    assert rows_of(table) == [(None,)]
    table.upsert(spark.createDataFrame([(3,)], "k long"), ["k"])
    assert sorted(rows_of(table), key=str) == [(3,), (None,)]
    plan = table._stored().where(F.col("bucket").isin([1]))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_counters_add_up_once_a_batch(spark):
    table = Buckets(spark, "c", ["k"], buckets=4)
    delta = lambda *rows: spark.createDataFrame(list(rows), "k string, n long")
    table.write(delta().withColumn("batch", F.lit(None).cast("int")))
    add_counters(table, delta(("a", 1), ("b", 5)), ["n"], 0)
    for _ in range(2):
        add_counters(table, delta(("a", 10), ("c", 7)), ["n"], 1)
    assert rows_of(table) == [("a", 11, 1), ("b", 5, 0), ("c", 7, 1)]


def test_drift(spark):
    one = spark.createDataFrame([(1,), (2,)], "i long")
    two = spark.createDataFrame([(1,), (3,)], "i long")
    same = fingerprint({"t": (one, "i")})
    assert drift(same, same).count() == 0
    assert {tuple(r) for r in drift(same, fingerprint({"t": (two, "i")})).collect()} == {("t.greatest", "changed", "2", "3"), ("t.sum", "changed", "3", "4")}


def test_scratch_is_dropped(spark):
    rows = kept(spark.range(5).toDF("x"), "five")
    path = rows.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert rows.count() == 5 and os.path.isdir(path)
    assert drop_scratch(spark) > 0 and not os.path.exists(path)
    assert drop_scratch(spark) == 0
