"""Writes to stored tables that touch no more than the keys they change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.operators.timeline import upsert
from stratamem.plans.fixtures import Registry, Tables
from stratamem.sources.tables import ERASED, erasure_journal, erasures, kept, scratch

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


class Buckets:
    """A Parquet table with a folder for each of `buckets` hashes of the columns `by`.

    A change reads and writes the folders of the keys it names and leaves the files of all others as they are:
    Spark's own writer replaces the folders that it has rows for. A folder that loses its last row keeps
    one that marks it as empty. Each change gives the same table when it runs again.
    """

    def __init__(self, spark: SparkSession, name: str, by: list[str], buckets: int = 64):
        self.spark, self.path, self.by, self.buckets = spark, scratch(spark, name), by, buckets
        self.names: list[str] = []
        self.schema = ""

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame, touched: list[int]) -> None:
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema], F.lit(False).alias("held"), "bucket")
        dealt = rows.withColumns({"held": F.lit(True), "bucket": self._bucket()}).unionByName(marks)
        # ranges of folder and key, so that a folder of many rows is written by many tasks
        dealt.repartitionByRange("bucket", *self.by).write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def write(self, rows: DataFrame) -> None:
        """Makes rows the table's content."""
        self.names = rows.columns
        self.schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["held boolean", "bucket int"])
        self._put(rows, list(range(self.buckets)))

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).where("held")

    def read(self) -> DataFrame:
        return self._stored().select(*self.names)

    def touched(self, keys: DataFrame) -> list[int]:
        """The folders of keys, `buckets` at most."""
        return [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]

    def change(self, keys: DataFrame, how: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Puts how(rows) in place of the rows of all folders that keys (with the columns `by`) fall in; returns these folders.

        how may drop, change and add rows, but not move one to a folder outside of them.
        """
        touched = self.touched(keys)
        if touched:
            old = self._stored().where(F.col("bucket").isin(touched)).select(*self.names)
            # written aside: the new rows come from files that the write replaces
            self._put(kept(how(old).select(*self.names), "change"), touched)
        return touched

    def upsert(self, changes: DataFrame, keys: list[str], version: str | None = None) -> list[int]:
        """Puts changes in by keys, the last by version of those that share a key; keys hold the columns `by`."""
        return self.change(changes, lambda old: upsert(old, changes, keys, version))

    def delete(self, keys: DataFrame) -> list[int]:
        """Drops the rows whose columns `by` are among keys."""
        return self.change(keys, lambda old: old.join(keys.select(*self.by).distinct(), self.by, "left_anti"))


@R.add("dml01_upsert_turns", "SELECT session_id, turn_index, CASE WHEN turn_index = 1 THEN 'edited' ELSE role END AS role FROM turns UNION ALL SELECT 100000 + session_id, turn_index, role FROM turns WHERE session_id < 3")
def _(t: Tables) -> DataFrame:
    table = Buckets(t.spark, "turns", ["session_id"])
    base = t.turns.select("session_id", "turn_index", "role")
    table.write(base)
    new = base.where("session_id < 3").withColumn("session_id", F.col("session_id") + 100000)
    table.upsert(base.where("turn_index = 1").withColumn("role", F.lit("edited")).union(new), ["session_id", "turn_index"])
    return table.read()


@R.add("dml02_facts_and_links", "SELECT user_id || ':' || e AS link, count(*) AS facts FROM (SELECT user_id, unnest(entities) AS e FROM memories) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """Facts are put into a stored table by id, their links where there are none yet."""
    facts, links = Buckets(t.spark, "facts", ["id"]), Buckets(t.spark, "links", ["id"])
    base = t.memories.select("id", "user_id", "entities")
    linked = lambda rows: rows.select("id", "user_id", F.explode("entities").alias("e")).distinct()
    first, second = base.where("id % 3 <> 0"), base.where("id % 3 <> 1")
    facts.write(first)
    links.write(linked(first))
    facts.upsert(second, ["id"])
    links.upsert(linked(second), ["id", "user_id", "e"])
    known = links.read().join(facts.read().select("id"), "id", "left_semi")
    return known.groupBy(F.concat_ws(":", "user_id", "e").alias("link")).agg(F.count(F.lit(1)).alias("facts"))


@R.add("dml03_conditional_update", "SELECT id, CASE WHEN update_op = 'removes' AND status = 'active' THEN 'superseded' ELSE status END AS status, CAST(CAST(CASE WHEN update_op = 'removes' AND status = 'active' THEN observed_at END AS DATE) AS VARCHAR) AS ended FROM memories")
def _(t: Tables) -> DataFrame:
    """Active facts in a change table are closed with their end; others keep their state."""
    table = Buckets(t.spark, "facts", ["id"])
    table.write(t.memories.select("id", "status", F.lit(None).cast("date").alias("ended")))
    change = t.memories.where("update_op = 'removes'").select("id", F.lit("superseded").alias("new_status"), F.to_date("observed_at").alias("end"))
    closes = (F.col("status") == "active") & F.col("new_status").isNotNull()
    closed = lambda old: old.join(change, "id", "left").select("id", F.when(closes, F.col("new_status")).otherwise(F.col("status")).alias("status"), F.when(closes, F.col("end")).otherwise(F.col("ended")).alias("ended"))
    table.change(change, closed)
    return table.read().select("id", "status", F.col("ended").cast("string").alias("ended"))


FORGOTTEN = "SELECT user_id FROM events GROUP BY user_id HAVING max_by(event_type, event_id) = 'error'"


@R.add("dml05_forget_user", f"g AS ({FORGOTTEN}) SELECT 'facts' AS name, count(*) AS n, count(*) FILTER (user_id IN (FROM g)) AS deleted FROM memories UNION ALL SELECT 'turns', count(*), count(*) FILTER (user_id IN (FROM g)) FROM turns UNION ALL SELECT 'sessions', count(*), count(*) FILTER (user_id IN (FROM g)) FROM sessions UNION ALL SELECT 'entities', count(*), count(*) FILTER (user_id IN (FROM g)) FROM (SELECT DISTINCT user_id, unnest(entities) AS e FROM memories)")
def _(t: Tables) -> DataFrame:
    """Users whose last event was an error are erased from all stored tables, which lie by user; what each table held and lost."""
    gone = kept(t.raw("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last")).where("last = 'error'").select("user_id"), "gone")
    tables = {"facts": t.memories.select("id", "user_id"), "turns": t.turns.select("session_id", "turn_index", "user_id"), "sessions": t.sessions, "entities": t.memories.select("user_id", F.explode("entities").alias("e")).distinct()}
    out = None
    for name, rows in tables.items():
        table = Buckets(t.spark, name, ["user_id"])
        table.write(rows)
        held = table.read().count()
        table.delete(gone)
        row = table.read().agg(F.lit(name).alias("name"), F.lit(held).cast("long").alias("n"), (F.lit(held).cast("long") - F.count(F.lit(1))).alias("deleted"))
        out = row if out is None else out.union(row)
    return out


@R.add("dml06_reapply_erasures", f"e AS ({ERASED}) SELECT id FROM memories WHERE user_id NOT IN (SELECT user_id FROM e WHERE user_id % 10 <> 3 AND (user_id % 7 = 0 OR gone_at >= TIMESTAMP '2024-01-30'))")
def _(t: Tables) -> DataFrame:
    """A table restored as of a day is rid of all whose erasure is not before it."""
    table = Buckets(t.spark, "restored", ["user_id"])
    table.write(t.memories.select("id", "user_id"))
    table.delete(erasures(t.spark, erasure_journal(t), "2024-01-30").where("still and user_id is not null").select("user_id").distinct())
    return table.read().select("id")


def add_counters(table: Buckets, delta: DataFrame, sums: list[str], batch: int) -> list[int]:
    """Adds a batch's sums to the counters of its keys, or puts them in; a key notes its last batch, so that none counts twice."""
    keys = table.by
    theirs = delta.select(*keys, *[F.col(n).alias(f"{n}_more") for n in sums])

    def added(old: DataFrame) -> DataFrame:
        both = old.join(theirs, keys, "full_outer")
        done = F.coalesce(F.col("batch"), F.lit(-1)) >= batch
        total = lambda n: F.coalesce(n, F.lit(0)) + F.when(done, F.lit(0)).otherwise(F.coalesce(f"{n}_more", F.lit(0)))
        came = F.coalesce(*[F.col(f"{n}_more") for n in sums]).isNotNull()
        return both.select(*keys, *[total(n).alias(n) for n in sums], F.when(came & ~done, F.lit(batch)).otherwise(F.col("batch")).alias("batch"))

    return table.change(theirs, added)


@R.add("dml07_counter_upsert", "SELECT user_id, operation, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(failed_calls) AS BIGINT) AS failed, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM usage GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """Counters of a stored table, to which two batches are added, the second twice, as a job that runs again does."""
    keys, sums = ["user_id", "operation"], {"calls": "calls", "failed_calls": "failed", "input_tokens": "tokens"}
    counted = lambda rows: rows.groupBy(*keys).agg(*[F.sum(c).alias(n) for c, n in sums.items()])
    table = Buckets(t.spark, "counters", keys)
    table.write(counted(t.usage.limit(0)).withColumn("batch", F.lit(None).cast("int")))
    for batch, rows in ((0, "event_id % 2 = 0"), (1, "event_id % 2 = 1"), (1, "event_id % 2 = 1")):
        add_counters(table, counted(t.usage.where(rows)), list(sums.values()), batch)
    return table.read().drop("batch")


def fingerprint(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """key, value of a store: for each table its rows, and the least, greatest and sum of its ids; one pass each."""
    out = None
    for name, (rows, id_) in tables.items():
        facts = F.create_map(*[F.lit(x) if isinstance(x, str) else x.cast("string") for k, v in (("rows", F.count(F.lit(1))), ("least", F.min(id_)), ("greatest", F.max(id_)), ("sum", F.sum(F.col(id_).cast("decimal(38,0)")))) for x in (f"{name}.{k}", v)])
        row = rows.agg(F.explode(facts).alias("key", "value"))
        out = row if out is None else out.union(row)
    return out


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, state, before, after of what differs between two fingerprints: added, removed or changed."""
    x, y = before.select("key", F.col("value").alias("before")), after.select("key", F.col("value").alias("after"))
    state = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").otherwise("changed")
    return x.join(y, "key", "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select("key", state.alias("state"), "before", "after")


_META = "SELECT '{name}' AS name, CAST(count(*) AS VARCHAR) AS rows, CAST(min({id}) AS VARCHAR) AS least, CAST(max({id}) AS VARCHAR) AS greatest, CAST(sum({id}::HUGEINT) AS VARCHAR) AS sum FROM {table}"
_PAIRS = "SELECT name || '.' || k AS key, value FROM (SELECT name, unnest(['rows', 'least', 'greatest', 'sum']) AS k, unnest([rows, least, greatest, sum]) AS value FROM ({})) WHERE value IS NOT NULL"


@R.add(
    "dml12_meta_drift",
    "x AS (" + _PAIRS.format(" UNION ALL ".join(_META.format(name=n, id=i, table=q) for n, i, q in (("orders", "o_orderkey", "orders"), ("customer", "c_custkey", "customer"), ("nation", "n_nationkey", "nation"))))
    + "),\ny AS (" + _PAIRS.format(" UNION ALL ".join(_META.format(name=n, id=i, table=q) for n, i, q in (("orders", "o_orderkey", "orders WHERE o_orderstatus <> 'F'"), ("customer", "c_custkey", "customer"), ("region", "r_regionkey", "region"))))
    + ") SELECT key, CASE WHEN y.value IS NULL THEN 'removed' WHEN x.value IS NULL THEN 'added' ELSE 'changed' END AS state, x.value AS before, y.value AS after FROM x FULL JOIN y USING (key) WHERE x.value IS DISTINCT FROM y.value",
)
def _(t: Tables) -> DataFrame:
    """The store's fingerprint is noted, finished orders are erased and a table changes places with another; what the next fingerprint says."""
    note = Buckets(t.spark, "meta", ["key"], buckets=4)
    note.write(fingerprint({"orders": (t.raw("orders"), "o_orderkey"), "customer": (t.raw("customer"), "c_custkey"), "nation": (t.raw("nation"), "n_nationkey")}))
    after = fingerprint({"orders": (t.raw("orders").where("o_orderstatus <> 'F'"), "o_orderkey"), "customer": (t.raw("customer"), "c_custkey"), "region": (t.raw("region"), "r_regionkey")})
    return drift(note.read(), after.where("value IS NOT NULL"))
