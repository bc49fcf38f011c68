"""Incremental behaviour as Structured Streaming: ledgers, idempotent writes, live timelines.

Each query runs its stream over the table until what is there is read, and returns what the sink holds.
Sources are files; a job in production reads its own.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratamem.operators.timeline import FOLDED, KEY, KeyState, Stored, decayed, resolved
from stratamem.plans.fixtures import Registry, Tables
from stratamem.sources.tables import scratch

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

STATES = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(t: Tables) -> DataFrame:
    """The events table as a stream, its time in the session's zone."""
    schema = t.raw("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(t: Tables, stream: DataFrame, mode: str, sink) -> None:
    """Runs a stream over what is there and waits for its end."""
    sink(stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(t.spark, "offsets")).trigger(availableNow=True)).start().awaitTermination()


@contextlib.contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, so that it need not fit into memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(name, None)
    spark.conf.set(name, STATES)
    try:
        yield
    finally:
        spark.conf.unset(name) if had is None else spark.conf.set(name, had)


def daily_usage(events: DataFrame) -> DataFrame:
    """Calls of each user and operation by day; a day is put out once the watermark has passed it."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", "1 hour").groupBy(day.alias("w"), "user_id", F.col("event_type").alias("operation")).agg(F.count(F.lit(1)).alias("calls"))


@R.add("str05_daily_usage", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, event_type AS operation, count(*) AS calls FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "usage")
    put = lambda batch, _id: batch.select(F.to_date("w.start").cast("string").alias("day"), "user_id", "operation", "calls", F.lit(_id).alias("batch")).write.mode("append").parquet(path)
    drained(t, daily_usage(event_stream(t)), "update", lambda w: w.foreachBatch(put))
    rows = t.spark.read.parquet(path)
    last = F.row_number().over(W.partitionBy("day", "user_id", "operation").orderBy(F.desc("batch")))
    return rows.withColumn("rn", last).where("rn = 1").select("day", "user_id", "operation", "calls")


#: Files of a micro-batch; rows are dealt evenly, so that none is empty.
FILES = 4


def arrivals(t: Tables, batches: int = 4, in_order: bool = False) -> DataFrame:
    """The events as a stream of several micro-batches, FILES files each: by event_id % batches, so that older events come late, or in order of time."""
    path = scratch(t.spark, "arrivals")
    events = t.raw("events")
    if in_order:
        cuts = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [(k + 1) / batches for k in range(batches - 1)]).alias("c")).first()["c"]
        part = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.unix_micros(F.col("ts").cast("timestamp"))))
    else:
        part = (F.col("event_id") % batches).cast("int")
    for k in range(batches):
        events.where(part == k).repartition(FILES).write.mode("append").parquet(path)
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(path)


FACTS = [
    "event_id id", "user_id", "'user' subject", "event_type predicate", "cast(cast(get_json_object(props, '$.k') as bigint) % 5 as string) object",
    "case event_id % 5 when 0 then 'removes' when 1 then 'replaces' when 2 then 'replaces' else 'coexists' end update_op", "ts occurred_at",
    "case when event_id % 7 = 0 then cast(cast(get_json_object(props, '$.k') as bigint) % 5 as string) end target", "concat(event_type, ' ', event_id % 97) content",
]


@R.add("str01_live_turn_write", FOLDED + " SELECT id, status, r.by FROM resolved r")
def _(t: Tables) -> DataFrame:
    """Each batch of turns is appended, its facts derived and put in by id, and the keys it touches resolved again from the log.

    The table of states holds a row a fact and batch; the last one counts.
    """
    log, states = scratch(t.spark, "log"), scratch(t.spark, "states")

    def write(batch: DataFrame, number: int) -> None:
        facts = batch.selectExpr(*FACTS)
        facts.write.mode("append").parquet(log)
        touched = facts.select(*KEY).distinct()
        history = batch.sparkSession.read.schema(facts.schema).parquet(log).dropDuplicates(["id"]).join(touched, KEY, "left_semi")
        resolved(history).withColumn("batch", F.lit(number)).write.mode("append").parquet(states)

    drained(t, arrivals(t), "append", lambda w: w.foreachBatch(write))
    last = t.spark.read.parquet(states).groupBy("id").agg(F.max_by(F.struct("status", "until", "by"), "batch").alias("live"))
    return last.select("id", "live.status", "live.by")


def _refold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the keys' histories, one a row: a list of facts (at, id, object, update_op, target) in any order, of which an id counts once."""
    for batch in batches:
        out = []
        for facts in batch.column("facts"):
            fold, held = KeyState(), {x["id"]: (x["at"], x["id"], x["object"], x["update_op"], x["target"]) for x in facts.as_py()}
            rows = [row for fact in sorted(held.values(), key=lambda x: x[:2]) for row in fold.step(*fact)] + fold.rest()
            out += [(r[0], r[1], r[3], len(held)) for r in rows]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["id", "status", "by", "known"])


@R.add("str02_live_timeline", FOLDED + " SELECT id, status, r.by FROM resolved r")
def _(t: Tables) -> DataFrame:
    """Keyed state in a stream: what a key has so far is folded again when more of it arrives, so that the order of arrival makes no difference.

    State is a list of facts a key, kept by Spark itself; it grows with a key's history; a watermark may bound it where late
    facts need no care.
    """
    out = scratch(t.spark, "timeline")
    facts = arrivals(t).selectExpr(*FACTS).withColumn("at", F.unix_micros(F.col("occurred_at").cast("timestamp")))
    histories = facts.groupBy(*KEY).agg(F.collect_list(F.struct("at", "id", "object", "update_op", "target")).alias("facts"))
    put = lambda batch, n: batch.select("facts").mapInArrow(_refold, "id long, status string, by long, known long").write.mode("append").parquet(out)
    with state_on_disk(t.spark):
        drained(t, histories, "update", lambda w: w.foreachBatch(put))
    # a later batch knows more of the key
    return t.spark.read.parquet(out).groupBy("id").agg(F.max_by(F.struct("status", "by"), "known").alias("x")).select("id", "x.status", "x.by")


@R.add("str03_late_facts", FOLDED + ", l AS (SELECT m.id FROM memories m WHERE EXISTS (SELECT 1 FROM memories o WHERE o.user_id = m.user_id AND o.predicate = m.predicate AND o.id % 4 < m.id % 4 AND o.occurred_at > m.occurred_at)) SELECT r.status, count(*) AS late FROM resolved r JOIN l USING (id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Facts that come after a newer one of their key, by what becomes of them: each takes the place its time gives it."""
    log = scratch(t.spark, "log")
    drained(t, arrivals(t).selectExpr(*FACTS), "append", lambda w: w.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(log)))
    facts = t.spark.read.parquet(log)
    newest = F.max("occurred_at").over(W.partitionBy(*KEY).orderBy("batch").rangeBetween(W.unboundedPreceding, -1))
    late = facts.withColumn("newest", newest).where("newest > occurred_at").select("id")
    return resolved(facts).join(late, "id").groupBy("status").agg(F.count(F.lit(1)).alias("late"))


STALE_S = 86_400


def _claims(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The claim that stands for a key, and what each write is against it."""
    held = state.get if state.exists else (None, None)
    rows = pd.concat(list(batches)).sort_values(["s", "event_id"])
    out = []
    for s, event_id, fingerprint in zip(rows["s"], rows["event_id"], rows["fingerprint"], strict=True):
        if held[0] is None or s - held[0] > STALE_S:
            out.append((event_id, "taken over" if held[0] is not None else "accepted"))
            held = (float(s), fingerprint)
        else:
            out.append((event_id, "replay" if fingerprint == held[1] else "conflict"))
    state.update(held)
    yield pd.DataFrame(out, columns=["event_id", "outcome"])


@R.add("str04_idempotent_writes", """w AS (SELECT event_id, user_id, event_type, epoch(ts) AS s, sha256(props) AS fp, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
o AS (SELECT * FROM (WITH RECURSIVE f AS (SELECT user_id, event_type, rn, event_id, s AS since, fp AS held, 'accepted' AS outcome FROM w WHERE rn = 1 UNION ALL
  SELECT w.user_id, w.event_type, w.rn, w.event_id, CASE WHEN w.s - since > 86400 THEN w.s ELSE since END, CASE WHEN w.s - since > 86400 THEN w.fp ELSE held END, CASE WHEN w.s - since > 86400 THEN 'taken over' WHEN w.fp = held THEN 'replay' ELSE 'conflict' END
  FROM f JOIN w ON w.user_id = f.user_id AND w.event_type = f.event_type AND w.rn = f.rn + 1) SELECT * FROM f)) SELECT event_id, outcome FROM o""")
def _(t: Tables) -> DataFrame:
    """One claim a user and kind: the same content replays it, another conflicts, and after a day a write takes it over."""
    path = scratch(t.spark, "writes")
    w = arrivals(t, 3, in_order=True).select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"), F.sha2("props", 256).alias("fingerprint"))
    out = w.groupBy("user_id", "event_type").applyInPandasWithState(_claims, "event_id long, outcome string", "since double, fingerprint string", "append", GroupStateTimeout.NoTimeout)
    drained(t, out, "append", lambda x: x.format("parquet").option("path", path))
    return t.spark.read.parquet(path)


@R.add("str06_sliding_counters", "c AS (SELECT event_id, count(*) OVER w AS requests, CAST(sum(floor(value)) OVER w AS BIGINT) AS tokens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)) SELECT event_id, requests, tokens, requests > 4 OR tokens > 400 AS over_limit FROM c")
def _(t: Tables) -> DataFrame:
    """Requests and tokens of the last day at each request, against their limits; in a stream use window(ts, '1 day', '1 hour')."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    by = W.partitionBy("user_id").orderBy("s").rangeBetween(-86400, 0)
    c = t.raw("events").withColumn("s", seconds).select("event_id", F.count(F.lit(1)).over(by).alias("requests"), F.sum(F.floor("value")).over(by).cast("long").alias("tokens"))
    return c.withColumn("over_limit", (F.col("requests") > 4) | (F.col("tokens") > 400))


@R.add("str07_resumable_batches", "SELECT CASE WHEN event_type = 'error' THEN 'blocked' ELSE 'done' END AS state, count(*) AS n, CAST(count(DISTINCT event_id % 4) AS INTEGER) AS batches FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """A job that stops after each batch and goes on from its checkpoint; what cannot be taken in goes to a table of its own, for good.

    A batch that runs again writes under its number, so nothing is there twice.
    """
    done, blocked, at = scratch(t.spark, "done"), scratch(t.spark, "blocked"), scratch(t.spark, "offsets")
    stream = arrivals(t)

    def write(batch: DataFrame, number: int) -> None:
        for rows, path in ((batch.where("event_type <> 'error'"), done), (batch.where("event_type = 'error'"), blocked)):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    for _ in range(2):  # the second run finds nothing left to do
        stream.writeStream.option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = t.spark.read.parquet(done).select("batch", F.lit("done").alias("state")).union(t.spark.read.parquet(blocked).select("batch", F.lit("blocked").alias("state")))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("batch").cast("int").alias("batches"))


@R.add("str08_anchored_decay", "SELECT id, round(strength * pow(2.0, -greatest(0, epoch(TIMESTAMP '2024-02-20') - epoch(last_accessed_at)) / 86400.0 / 30), 6) AS strength FROM memories")
def _(t: Tables) -> DataFrame:
    """Strength written down three times, twice for the same day: the anchor that moves with it keeps decay from counting twice."""
    table = Stored(t.spark, "strengths")
    table.write(t.memories.select("id", "strength", F.col("last_accessed_at").alias("anchor")))
    for now in ("2024-02-05", "2024-02-20", "2024-02-20"):
        at = F.lit(now).cast("timestamp_ntz")
        table.write(table.read().select("id", decayed(F.col("strength"), F.col("anchor"), now, 30.0).alias("strength"), F.greatest("anchor", at).alias("anchor")))
    return table.read().select("id", F.round("strength", 6).alias("strength"))


@R.add("str09_sessions", "SELECT session_id, count(*) AS turns, sha256(string_agg(role || ': ' || content, chr(10) ORDER BY turn_index)) AS digest FROM turns GROUP BY session_id")
def _(t: Tables) -> DataFrame:
    """Turns gathered by their session's id in a stream, in order of their index whatever the order of arrival."""
    path, out = scratch(t.spark, "turns"), scratch(t.spark, "sessions")
    for k in (1, 0):
        t.turns.where(F.col("turn_index") % 2 == k).repartition(FILES).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(t.turns.schema).option("maxFilesPerTrigger", FILES).parquet(path)
    line = F.struct("turn_index", F.concat_ws(": ", "role", "content").alias("x"))
    s = stream.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.sha2(F.array_join(F.array_sort(F.collect_list(line))["x"], "\n"), 256).alias("digest"))
    drained(t, s, "update", lambda w: w.foreachBatch(lambda batch, n: batch.write.mode("append").parquet(out)))
    return t.spark.read.parquet(out).groupBy("session_id").agg(F.max("turns").alias("turns"), F.max_by("digest", "turns").alias("digest"))


@R.add("str09_derived_sessions", "g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 21600 THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS events FROM n GROUP BY user_id, s")
def _(t: Tables) -> DataFrame:
    """An extension, where no ids are given: sessions that end after six hours without an event."""
    e = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("began"))
    return s.select("user_id", F.date_format("began", "yyyy-MM-dd HH:mm:ss").alias("began"), "events")
