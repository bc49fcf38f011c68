"""Timelines kept up by a stream: keyed state, a bound for late facts, and their repair.

Facts come in order of arrival, not of time. A key's facts wait in its state until the watermark, which
follows arrival, is `grace` past their time; then they are folded in order into what stands. A fact that
comes when its time is over by more than that is put out at once as late; a repair job folds the keys that
late facts touch anew from the log.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stratamem.operators.timeline import FOLD, KEY, resolved
from stratamem.plans.fixtures import Registry, Tables
from stratamem.sources.tables import scratch
from stratamem.streaming.jobs import FACTS, state_on_disk

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

DAY_MS = 86_400_000


#: Slots that keys are dealt over by hash, and parts of what stands in a slot.
SLOTS, PARTS = 512, 32
DAY_US = DAY_MS * 1000


class KeyTimeline(StatefulProcessor):
    """The histories of a slot of keys: facts that wait for their time, and those that stand.

    State is a map entry a day of waiting facts and a map entry a part of the slot's keys with what stands of them, so that
    a call to the store serves many facts and keys. A fact leaves `waiting` when it is folded and `standing` when it is
    closed, and a batch reads and writes the days that it adds to, those that fall due, and the parts that these touch.
    """

    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day long", "facts string")
        self.standing = handle.getMapState("standing", "part int", "keys string")

    def _due(self, at: int, watermark_ms: int) -> bool:
        return at // 1000 + self.grace_ms <= watermark_ms

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        watermark, first, days = timerValues.getCurrentWatermarkInMs(), None, defaultdict(list)
        late = []
        for line, (_, at, id_, *_) in ((line, fact) for r in rows for line, fact in zip(r.lines.split("\n"), _parsed(r.lines), strict=True)):
            if id_ is None:  # only moves the watermark
                continue
            if watermark > 0 and self._due(at, watermark):
                late.append({"kind": "late", "id": id_})
                continue
            days[at // DAY_US].append(line)
            first = at if first is None else min(first, at)
        if late:
            yield _sent(late)
        for day, lines in days.items():
            if self.waiting.containsKey((day,)):
                lines.insert(0, self.waiting.getValue((day,))[0])
            self.waiting.updateValue((day,), ("\n".join(lines),))
        if first is not None:
            self.handle.registerTimer(first // 1000 + self.grace_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        watermark = timerValues.getCurrentWatermarkInMs()
        days, due, rest = sorted(k[0] for k in self.waiting.keys()), defaultdict(dict), None
        for day in days:
            if not self._due(day * DAY_US, watermark):
                rest = min(at for _, at, *_ in self._facts(day)) if rest is None else rest
                break
            left = []
            for line, fact in zip(self.waiting.getValue((day,))[0].split("\n"), self._facts(day), strict=True):
                if self._due(fact[1], watermark):
                    due[tuple(fact[0])][fact[1], fact[2]] = fact[3:]  # one that was sent again while it waited counts once
                else:
                    left.append(line)
                    rest = fact[1] if rest is None else min(rest, fact[1])
            self.waiting.updateValue((day,), ("\n".join(left),)) if left else self.waiting.removeKey((day,))
        parts = defaultdict(list)
        for of in due:
            parts[zlib.crc32(json.dumps(of).encode()) % PARTS].append(of)
        for part, keys in parts.items():
            made: list[dict] = []
            held = {tuple(k): (dict(map(tuple, stands)), last) for k, stands, last in json.loads(self.standing.getValue((part,))[0])} if self.standing.containsKey((part,)) else {}
            for of in keys:
                open_, last = held.get(of, ({}, None))
                for (at, id_), (value, op, target) in sorted(due[of].items()):
                    changes, last = self._step(open_, last, at, id_, value, op, target)
                    made += changes
                held[of] = open_, last
            if made:
                yield _sent(made)
            stands = [[k, list(open_.items()), last] for k, (open_, last) in held.items() if open_ or last]
            self.standing.updateValue((part,), (json.dumps(stands),)) if stands else self.standing.removeKey((part,))
        if rest is not None:
            self.handle.registerTimer(rest // 1000 + self.grace_ms)

    def _facts(self, day: int) -> list[list]:
        """The facts that wait in a day."""
        return _parsed(self.waiting.getValue((day,))[0])

    def _step(self, open_: dict, last: list | None, at: int, id_: int, value: str | None, op: str | None, target: str | None) -> tuple[list[dict], list | None]:
        """The changes that a fact makes, in open_ as well, and the last fact that may be repeated then."""
        if last and last[0] in open_ and value is not None and last[1] == value and op != "removes":
            return [{"kind": "folded", "id": id_, "status": "superseded", "by": last[0]}], last
        out = []
        if op in ("replaces", "removes"):
            named = list(open_) if target is None else [k for k, v in open_.items() if v == target]
            if len(named) == 1:
                del open_[named[0]]
                out.append({"kind": "closed", "id": named[0], "status": "superseded", "until": at, "by": id_})
        if op == "removes":
            return [*out, {"kind": "closed", "id": id_, "status": "historical", "until": at}], None
        open_[id_] = value
        return [*out, {"kind": "standing", "id": id_, "status": "active"}], [id_, value]

    def close(self) -> None:
        pass


def _parsed(lines: str) -> list:
    """The values of several lines of JSON."""
    return json.loads("[" + lines.replace("\n", ",") + "]")


def _sent(values: list) -> Row:
    return Row(lines="\n".join(map(json.dumps, values)))


def packed(rows: DataFrame, by: list[str], line: Column) -> DataFrame:
    """slot, arrived, lines: the lines of JSON of many rows of a slot as one, with the latest arrival; by is what slots are dealt by.

    Python then gets a row for many, in a stream as in a table.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch]).group_by("slot").aggregate([("arrived", "max"), ("line", "list")])
                columns = [t.column("slot"), t.column("arrived_max"), pa.chunked_array([["\n".join(x) for x in t.column("line_list").to_pylist()]], pa.string())]
                yield from pa.table(columns, ["slot", "arrived", "lines"]).to_batches()

    slim = rows.select(F.pmod(F.xxhash64(*by), F.lit(SLOTS)).alias("slot"), "arrived", line.alias("line"))
    return slim.repartition("slot").mapInArrow(pack, "slot long, arrived timestamp, lines string")


def unpacked(sent: DataFrame, schema: str) -> DataFrame:
    """The values in lines of JSON, a row each."""
    return sent.select(F.explode(F.split("lines", "\n")).alias("line")).select(F.from_json("line", schema).alias("x")).select("x.*")


class TurnNumbers(StatefulProcessor):
    """Numbers a session's turns on from where the last batch ended: one number is the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        n = self.next.get()[0] if self.next.exists() else 0
        for _, id_ in sorted((r.arrived, r.id) for r in rows):
            yield Row(id=id_, turn_index=n)
            n += 1
        self.next.update((n,))

    def close(self) -> None:
        pass


class SlotTurnNumbers(StatefulProcessor):
    """TurnNumbers of a slot of sessions: a map entry a part of them is the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getMapState("next", "part int", "sessions string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        parts = defaultdict(lambda: defaultdict(list))
        for r in rows:
            for session, arrived, id_ in _parsed(r.lines):
                parts[zlib.crc32(json.dumps(session).encode()) % PARTS][session].append((arrived, id_))
        for part, sessions in parts.items():
            held = dict(map(tuple, json.loads(self.next.getValue((part,))[0]))) if self.next.containsKey((part,)) else {}
            made = []
            for session, turns in sessions.items():
                n = held.get(session, 0)
                made += [{"id": id_, "turn_index": n + k} for k, (_, id_) in enumerate(sorted(turns))]
                held[session] = n + len(turns)
            self.next.updateValue((part,), (json.dumps(list(held.items())),))
            yield _sent(made)

    def close(self) -> None:
        pass


def _json(*columns: Column) -> Column:
    """A JSON list of columns, whatever their kinds; a null is a null."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(x, F.lit("null")) for x in columns]), F.lit("]"))


def _string(name: str) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(F.col(name).cast("string")))
    return F.when(F.col(name).isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def _value(rows: DataFrame, name: str) -> Column:
    """A number or a string as JSON."""
    return F.col(name).cast("string") if dict(rows.dtypes)[name] in ("bigint", "int", "smallint", "tinyint") else _string(name)


def numbered(turns: DataFrame) -> DataFrame:
    """id, turn_index of a stream of turns (user_id, id, arrived): each session's turns by arrival, then id, on from where the last batch ended."""
    line = _json(_value(turns, "user_id"), F.unix_micros("arrived").cast("string"), F.col("id").cast("string"))
    sent = packed(turns, ["user_id"], line).groupBy("slot").transformWithState(SlotTurnNumbers(), "lines string", "append", "none")
    return unpacked(sent, "id long, turn_index long")


def live(facts: DataFrame, grace_ms: int) -> DataFrame:
    """kind, id, status, until, by: changes of the facts' states as a stream; kind is one of standing, closed, folded and late.

    facts: KEY, at (microseconds), id, object, update_op, target, arrived; a row with a null id only moves the
    watermark on. A fact is late if its time and `grace_ms` are over by the watermark of its batch. A fact that
    is sent again while it waits counts once, after that it is late.
    """
    line = _json(_json(*[_value(facts, k) for k in KEY]), F.col("at").cast("string"), F.col("id").cast("string"), *[_string(c) for c in ("object", "update_op", "target")])
    slots = packed(facts, KEY, line).withWatermark("arrived", "0 seconds").groupBy("slot")
    sent = unpacked(slots.transformWithState(KeyTimeline(grace_ms), "lines string", "append", "eventTime"), "kind string, id long, status string, until long, by long")
    until = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(cast(until as decimal(20, 0)) / 1000000 as decimal(18, 6)))")
    return sent.select("kind", "id", "status", until.alias("until"), "by")


def states(changes: DataFrame) -> DataFrame:
    """id, status, until, by of all facts folded so far; a repeat ends with its owner."""
    done = changes.where("kind <> 'late'").groupBy("id").agg(F.max_by(F.struct("kind", "status", "until", "by"), F.col("status") != "active").alias("x")).select("id", "x.*")
    owners = done.select(F.col("id").alias("by"), F.col("until").alias("end"))
    both = done.join(owners, "by", "left")
    return both.select("id", "status", F.when(F.col("kind") == "folded", F.col("end")).otherwise(F.col("until")).alias("until"), "by")


def repaired(changes: DataFrame, log: DataFrame) -> DataFrame:
    """id, status, until, by with late facts in their places: the keys that they touch are folded anew from the log, the others stay as they are."""
    facts = log.where("id IS NOT NULL").dropDuplicates(["id"])
    touched = facts.join(changes.where("kind = 'late'").select("id"), "id", "left_semi").select(*KEY).distinct()
    anew = resolved(facts.join(touched, KEY, "left_semi"))
    return states(changes).join(anew.select("id"), "id", "left_anti").unionByName(anew)


class Feed:
    """A folder that a stream reads, and the stream's sink; each push is one batch of arrivals."""

    def __init__(self, spark: SparkSession, schema, start: Callable[[DataFrame], DataFrame], by: tuple[str, ...] = ()):
        self.spark, self.schema, self.start, self.by = spark, schema, start, by
        self.source, self.sink, self.at = (scratch(spark, k) for k in ("arrivals", "changes", "offsets"))
        self.progress: list = []

    def push(self, rows: DataFrame) -> None:
        """Appends rows to the folder and runs the stream, which goes on from its checkpoint, until it has read them."""
        rows.write.mode("append").parquet(self.source)
        self.run()

    def run(self) -> None:
        with state_on_disk(self.spark):
            out = self.start(self.spark.readStream.schema(self.schema).parquet(self.source)).writeStream.outputMode("append").option("checkpointLocation", self.at).trigger(availableNow=True)
            query = (out.partitionBy(*self.by) if self.by else out).format("parquet").start(self.sink)
            query.awaitTermination()
            self.progress += query.recentProgress

    def read(self, name: str = "sink") -> DataFrame:
        return self.spark.read.parquet(getattr(self, name))


#: Facts arrive within a day, one in sixteen within six; a batch is the arrivals of eight days.
DELAY = "pmod(event_id * 7919, 86400) * if(event_id % 16 = 3, 6, 1)"
ARRIVED = f"""arrived AS (SELECT event_id AS id, user_id, ts + to_seconds((event_id * 7919) % 86400 * CASE WHEN event_id % 16 = 3 THEN 6 ELSE 1 END) AS came, ts FROM events),
batched AS (SELECT *, CAST(floor((epoch(came) - epoch(TIMESTAMP '2024-01-01')) / (8 * 86400)) AS INTEGER) AS batch FROM arrived)"""


def arriving(t: Tables) -> DataFrame:
    """FACTS of the events with KEY, at, and when they arrived, in batches."""
    came = t.raw("events").withColumn("arrived", F.expr(f"cast(ts as timestamp) + make_dt_interval(0, 0, 0, {DELAY})"))
    facts = came.selectExpr(*FACTS, "arrived", "cast(unix_micros(cast(ts as timestamp)) as long) at")
    return facts.withColumn("batch", F.floor((F.unix_seconds("arrived") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / (8 * 86400)).cast("int"))


def ticks(rows: DataFrame, days: int) -> DataFrame:
    """One row without a fact that arrives `days` after all rows."""
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "arrived"]
    return rows.agg(F.max("arrived").alias("arrived")).select(*nulls, (F.col("arrived") + F.make_dt_interval(F.lit(days))).alias("arrived")).select(rows.columns)


def _through(t: Tables, start: Callable[[DataFrame], DataFrame], by: tuple[str, ...] = (), tick: bool = True) -> Feed:
    rows = arriving(t)
    feed = Feed(t.spark, rows.schema, start, by)
    for k in sorted(r[0] for r in rows.select("batch").distinct().collect()):  # a row for each eight days
        feed.push(rows.where(F.col("batch") == k))
    if tick:
        feed.push(ticks(rows, 30))
    return feed


def shown(rows: DataFrame, until: str = "until") -> Column:
    return F.date_format(until, "yyyy-MM-dd HH:mm:ss").alias("until")


@R.add("str02_map_state_timeline", FOLD.format(op="update_op", where="") + " SELECT id, status, strftime(until, '%Y-%m-%d %H:%M:%S') AS until, r.by FROM resolved r")
def _(t: Tables) -> DataFrame:
    """Facts up to six days late, all within the grace: the stream ends where a fold over everything does."""
    feed = _through(t, lambda s: live(s, 6 * DAY_MS))
    out = states(feed.read())
    return out.select("id", "status", shown(out), "by")


#: A batch's watermark is the latest arrival of the batches before it; two days of grace.
LATE = ARRIVED + """,
marks AS (SELECT b.batch, max(epoch_ms(p.came)) AS mark FROM (SELECT DISTINCT batch FROM batched) b JOIN batched p ON p.batch < b.batch GROUP BY 1),
late AS (SELECT id FROM batched JOIN marks USING (batch) WHERE epoch_ms(ts) + 2 * 86400000 <= mark)"""


@R.add(
    "str03_watermark_and_side_output",
    LATE + ",\none AS (WITH " + FOLD.format(op="update_op", where=" WHERE id NOT IN (SELECT id FROM late)") + " SELECT * FROM resolved),\ntwo AS (WITH " + FOLD.format(op="update_op", where="")
    + " SELECT * FROM resolved)\nSELECT t.id, o.id IS NULL AS late, o.status AS on_time_status, o.by AS on_time_by, t.status, strftime(t.until, '%Y-%m-%d %H:%M:%S') AS until, t.by FROM two t LEFT JOIN one o ON o.id = t.id",
)
def _(t: Tables) -> DataFrame:
    """Two days of grace: what the stream says of facts in time, which it puts aside as late, and what the repair makes of both."""
    feed = _through(t, lambda s: live(s, 2 * DAY_MS), ("kind",))
    changes = feed.read().select("kind", "id", "status", "until", "by")
    on_time = states(changes).select("id", F.col("status").alias("on_time_status"), F.col("by").alias("on_time_by"), F.lit(False).alias("late"))
    whole = repaired(changes, feed.read("source").drop("batch"))
    return whole.join(on_time, "id", "left").select("id", F.coalesce("late", F.lit(True)).alias("late"), "on_time_status", "on_time_by", "status", shown(whole), "by")


@R.add("str01_turn_index_and_fold", ARRIVED + ",\n" + FOLD.format(op="update_op", where="") + " SELECT r.id, row_number() OVER (PARTITION BY user_id ORDER BY batch, came, b.id) - 1 AS turn_index, status, r.by FROM resolved r JOIN batched b ON b.id = r.id")
def _(t: Tables) -> DataFrame:
    """A live write: each turn is numbered in its session, logged, and its fact folded, all from state; no batch reads what earlier ones wrote."""
    turns = _through(t, numbered, tick=False)
    folded = _through(t, lambda s: live(s, 6 * DAY_MS))
    return turns.read().join(states(folded.read()), "id").select("id", "turn_index", "status", "by")


def sliding(requests: DataFrame, every: str = "10 seconds", length: str = "60 seconds", most: int = 2, tokens: int = 400) -> DataFrame:
    """operation, since, requests, tokens, over_limit of sliding windows over requests (ts, operation, tokens); works on streams and tables alike."""
    w = requests.groupBy(F.window("ts", length, every).alias("w"), "operation").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"))
    return w.select("operation", F.col("w.start").alias("since"), "requests", "tokens", ((F.col("requests") > most) | (F.col("tokens") > tokens)).alias("over_limit"))


@R.add("str06_sliding_minute", "w AS (SELECT event_type AS operation, CAST(floor(value) AS BIGINT) AS tokens, unnest(range(CAST(floor(epoch(ts) / 10) AS BIGINT) * 10 - 50, CAST(floor(epoch(ts) / 10) AS BIGINT) * 10 + 10, 10)) AS since FROM events) SELECT operation, since, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) > 2 OR sum(tokens) > 400 AS over_limit FROM w GROUP BY operation, since")
def _(t: Tables) -> DataFrame:
    """Requests and tokens of each minute, every ten seconds, put out once the watermark has passed the window."""
    rows = t.raw("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("operation"), F.floor("value").cast("long").alias("tokens"))
    feed = Feed(t.spark, rows.schema, lambda s: sliding(s.withWatermark("ts", "1 minute")))
    cut = F.dayofmonth("ts") <= 15
    feed.push(rows.where(cut))
    feed.push(rows.where(~cut))
    last = rows.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.make_dt_interval(F.lit(1))).alias("ts"), F.lit("tick").alias("operation"), F.lit(0).cast("long").alias("tokens"))
    feed.push(last)  # moves the watermark past the last window
    return feed.read().where("operation <> 'tick'").withColumn("since", F.unix_seconds("since"))
