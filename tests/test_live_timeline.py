"""Timelines in a stream: state that follows arrivals, late facts put aside, and their repair."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from stratamem.operators.timeline import resolved
from stratamem.streaming.timeline import DAY_MS, Feed, TurnNumbers, live, repaired, sliding, states, ticks

START = datetime(2024, 1, 1)
SCHEMA = "id long, user_id long, subject string, predicate string, object string, update_op string, occurred_at timestamp_ntz, target string, arrived timestamp, at long"


def facts(rnd, ids, day, back):
    """Facts that arrive on a day, up to `back` days after their time."""
    out = []
    for k in ids:
        arrived = START + timedelta(days=day, seconds=rnd.randrange(86_400))
        at = arrived - timedelta(seconds=rnd.randrange(int(back * 86_400)))
        micros = int((at - datetime(1970, 1, 1)).total_seconds() * 1e6)
        value, op = rnd.choice("abc"), rnd.choice(["replaces", "removes", "coexists", "coexists"])
        out.append((k, rnd.randrange(3), "user", "p", value, op, at, rnd.choice([None, None, "a", "b"]), arrived, micros))
    return out


def settled(df):
    return sorted((r["id"], r["status"], r["until"], r["by"]) for r in df.collect())


def test_state_follows_arrivals_and_late_facts_are_repaired(spark):
    rnd = random.Random(6)
    days = [facts(rnd, range(100 * d, 100 * d + 40), d, 1.5) for d in range(1, 5)]
    very_late = facts(rnd, range(1000, 1010), 4, 0.1)
    very_late = [(*r[:6], r[6] - timedelta(days=3), r[7], r[8], r[9] - 3 * DAY_MS * 1000) for r in very_late]
    again = days[2][:5]  # sent twice at once
    feed = Feed(spark, spark.createDataFrame([], SCHEMA).schema, lambda s: live(s, 2 * DAY_MS), ("kind",))
    everything = []
    for d, rows in enumerate(days):
        rows = rows + (again if d == 2 else []) + (very_late if d == 3 else [])
        everything += rows
        feed.push(spark.createDataFrame(rows, SCHEMA))
    feed.push(ticks(spark.createDataFrame(everything, SCHEMA), 10))
    changes = feed.read().select("kind", "id", "status", "until", "by")
    late = {r["id"] for r in changes.where("kind = 'late'").collect()}
    assert late == set(range(1000, 1010))
    whole = spark.createDataFrame(everything, SCHEMA).dropDuplicates(["id"])
    assert settled(states(changes)) == settled(resolved(whole.where("id < 1000")))
    assert settled(repaired(changes, feed.read("source"))) == settled(resolved(whole))

    # a batch touches its own facts, those that fall due, and a few entries a key (standing, last, timers)
    steps = [(p["numInputRows"], p["stateOperators"][0]) for p in feed.progress]
    assert len(steps) > 5
    for arrived, state in steps:
        assert state["numRowsUpdated"] <= 3 * (arrived + 60) + 30
    waiting_and_standing = steps[-1][1]["numRowsTotal"]
    assert waiting_and_standing < len(everything) + 20


def test_turn_numbers_go_on(spark):
    schema = "id long, user_id long, arrived timestamp"
    feed = Feed(spark, spark.createDataFrame([], schema).schema, lambda s: s.groupBy("user_id").transformWithState(TurnNumbers(), "id long, turn_index long", "append", "none"))
    at = lambda k: START + timedelta(minutes=k)
    feed.push(spark.createDataFrame([(1, 7, at(2)), (2, 7, at(1)), (3, 8, at(0))], schema))
    feed.push(spark.createDataFrame([(4, 7, at(0)), (5, None, at(9))], schema))
    feed.run()  # nothing new
    assert sorted((r["id"], r["turn_index"]) for r in feed.read().collect()) == [(1, 1), (2, 0), (3, 0), (4, 2), (5, 0)]


def test_sliding_windows_of_a_stream_and_of_a_table(spark):
    rnd = random.Random(7)
    rows = [(START + timedelta(seconds=rnd.randrange(600)), rnd.choice("xy"), rnd.choice([1, 300])) for _ in range(80)]
    schema = "ts timestamp, operation string, tokens long"
    table = spark.createDataFrame(rows, schema)
    feed = Feed(spark, table.schema, lambda s: sliding(s.withWatermark("ts", "10 minutes")))
    feed.push(table.where("tokens = 1"))
    feed.push(table.where("tokens > 1"))
    feed.push(spark.createDataFrame([(START + timedelta(days=1), "tick", 0)], schema))
    key = lambda df: sorted(map(str, df.where("operation <> 'tick'").collect()))
    assert key(feed.read()) == key(sliding(table))
    assert feed.read().where("over_limit").count() == sum(r["requests"] > 2 or r["tokens"] > 400 for r in sliding(table).collect()) > 0
    assert sliding(table).agg(F.sum("requests")).first()[0] == 6 * len(rows)


def test_state_is_called_by_the_slot_and_not_by_the_fact(spark):
    rnd = random.Random(8)
    rows = [(k, k % 400, "user", "p", rnd.choice("abc"), rnd.choice(["replaces", "removes", "coexists"]), START, rnd.choice([None, "a"]), START + timedelta(seconds=k), int((START - datetime(1970, 1, 1)).total_seconds() * 1e6) + k) for k in range(2000)]
    rows = [(*r[:6], START + timedelta(microseconds=r[0]), *r[7:]) for r in rows]
    log = spark.createDataFrame(rows, SCHEMA)
    feed = Feed(spark, log.schema, lambda s: live(s, 2 * DAY_MS))
    feed.push(log)
    feed.push(ticks(log, 10))
    assert settled(states(feed.read())) == settled(resolved(log))
    # 2,000 facts of 400 keys wait in at most a row a slot, and then stand in at most a row a part of a slot
    assert feed.progress[0]["stateOperators"][0]["numRowsTotal"] <= 4 * 400


def test_histories_are_kept_without_python(spark):
    from stratamem.streaming import jobs

    table = pa.table({"facts": [[{"at": 2, "id": 2, "object": "a", "update_op": "replaces", "target": None}, {"at": 1, "id": 1, "object": "b", "update_op": "coexists", "target": None}, {"at": 2, "id": 2, "object": "a", "update_op": "replaces", "target": None}], []]})
    out = [r for b in jobs._refold(iter(table.to_batches())) for r in b.to_pylist()]
    assert sorted((r["id"], r["status"], r["by"], r["known"]) for r in out) == [(1, "superseded", 2, 2), (2, "active", None, 2)]


def test_packed_lines_keep_any_text_and_numbers_go_on_by_slot(spark):
    from stratamem.streaming.timeline import numbered

    odd = ['say "a\\b"', "line\nbreak", "comma, [x]", "", None, "é "]
    rows = [(k, k % 2, "user", 'p"\n', odd[k % 6], "replaces" if k % 3 else "coexists", START + timedelta(seconds=k), odd[(k // 2) % 6], START + timedelta(seconds=k), int((START - datetime(1970, 1, 1)).total_seconds() * 1e6) + 1_000_000 * k) for k in range(60)]
    log = spark.createDataFrame(rows, SCHEMA)
    feed = Feed(spark, log.schema, lambda s: live(s, 2 * DAY_MS))
    feed.push(log)
    feed.push(ticks(log, 10))
    assert settled(states(feed.read())) == settled(resolved(log))
    schema = "id long, user_id long, arrived timestamp"
    feed = Feed(spark, spark.createDataFrame([], schema).schema, numbered)
    at = lambda k: START + timedelta(minutes=k)
    feed.push(spark.createDataFrame([(1, 7, at(2)), (2, 7, at(1)), (3, 8, at(0))], schema))
    feed.push(spark.createDataFrame([(4, 7, at(0)), (5, None, at(9))], schema))
    assert sorted((r["id"], r["turn_index"]) for r in feed.read().collect()) == [(1, 1), (2, 0), (3, 0), (4, 2), (5, 0)]
