"""Timeline resolution, strength, budgeted selection, and writes: folds over ordered histories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.operators.facts import KEY, day_time
from stratamem.plans.fixtures import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def normalised_op(facts: DataFrame) -> DataFrame:
    """`replaces` without a target in a text that says what was replaced but not with what becomes `removes`."""
    lone = (F.col("update_op") == "replaces") & F.col("target").isNull() & F.col("content").rlike("replaced my") & ~F.col("content").contains(" with ")
    return facts.withColumn("update_op", F.when(lone, "removes").otherwise(F.col("update_op")))


class KeyState:
    """What a key's history has left standing: facts by id with those folded into them, and the last fact that was not folded."""

    def __init__(self):
        self.open: dict[int, tuple[str | None, list[int]]] = {}
        self.by_value: dict[str | None, dict[int, None]] = {}
        self.last: tuple[int, str | None] | None = None  # null once it cannot be repeated

    def step(self, at: int, id_: int, value: str | None, op: str | None, target: str | None) -> list[tuple]:
        """Takes the next fact; returns the rows (id, status, until, by) that are settled by it."""
        if self.last and self.last[0] in self.open and value is not None and self.last[1] == value and op != "removes":
            self.open[self.last[0]][1].append(id_)
            return []
        out = []
        if op in ("replaces", "removes"):
            named = self.by_value.get(target, {}) if target is not None else self.open
            if len(named) == 1:
                closed = next(iter(named))
                was, folded = self.open.pop(closed)
                del self.by_value[was][closed]
                out = [(closed, "superseded", at, id_), *[(x, "superseded", at, closed) for x in folded]]
        if op == "removes":
            self.last = None
            return [*out, (id_, "historical", at, None)]
        self.open[id_] = (value, [])
        self.by_value.setdefault(value, {})[id_] = None
        self.last = (id_, value)
        return out

    def rest(self) -> list[tuple]:
        """Rows of what still stands."""
        return [row for id_, (_, folded) in self.open.items() for row in ((id_, "active", None, None), *[(x, "superseded", None, id_) for x in folded])]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key, then in order of time and id; a key may go on in the next batch."""
    key, state = None, KeyState()

    def rows(out: list[tuple]) -> pa.RecordBatch:
        ids, status, until, by = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(status, pa.string()), pa.array(until, pa.int64()).cast(pa.timestamp("us")), pa.array(by, pa.int64())], ["id", "status", "until", "by"])

    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in (*KEY, "id", "object", "update_op", "target")]
        at = batch.column("occurred_at").cast(pa.int64()).to_pylist()
        for i, (user, subject, predicate, id_, value, op, target) in enumerate(zip(*columns, strict=True)):
            if key != (user, subject, predicate):
                out += state.rest()
                key, state = (user, subject, predicate), KeyState()
            out += state.step(at[i], id_, value, op, target)
        yield rows(out)
    yield rows(state.rest())


def resolved(facts: DataFrame) -> DataFrame:
    """id, status, until, by: what each dated fact's key says of it once its history is folded.

    Facts of a key are taken in order of time, then id. A repeat of the value that stands, with no
    removal between, is folded into its owner (superseded, by the owner, until the owner's end). `replaces`
    closes its target and stands; `removes` closes its target and is historical; `coexists` stands beside the
    others. The target is the one standing fact with the named value, or without a name the only one that
    stands; several or none leave all open. Undated facts are left out. Folding is independent of the order in
    which facts arrive, and folding again changes nothing.

    One shuffle by key and a sort; a task reads its keys' facts in order and holds only what stands in the
    key at hand, with the ids folded into it. No key's history is gathered.
    """
    dated = facts.where("occurred_at is not null").select(*KEY, "occurred_at", "id", "object", "update_op", "target")
    ordered = dated.repartition(*[F.col(c) for c in KEY]).sortWithinPartitions(*KEY, "occurred_at", "id")
    return ordered.mapInArrow(_fold, "id long, status string, until timestamp_ntz, by long")


def facts_of(t: Tables) -> DataFrame:
    return t.memories.select("id", *KEY, "object", "update_op", "occurred_at", "content", F.when(F.col("id") % 7 == 0, F.col("object")).alias("target"))


#: The fold as SQL: a step a fact, with the standing facts of its key as a list.
FOLD = """facts AS (SELECT id, user_id, subject, predicate, object, occurred_at, {op} AS op, CASE WHEN id % 7 = 0 THEN object END AS target FROM memories{where}),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id, subject, predicate ORDER BY occurred_at, id) AS rn FROM facts),
steps AS (SELECT * FROM (WITH RECURSIVE f AS (
  SELECT DISTINCT user_id, subject, predicate, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::TIMESTAMP AS moment, NULL::VARCHAR AS op, NULL::BIGINT AS owner, NULL::BIGINT AS closed,
    CAST([] AS STRUCT(id BIGINT, object VARCHAR)[]) AS open, NULL::BIGINT AS last_id, NULL::VARCHAR AS last_object FROM h
  UNION ALL
  SELECT user_id, subject, predicate, rn, id, moment, op, owner, closed,
    CASE WHEN owner IS NOT NULL THEN open ELSE list_concat(list_filter(open, lambda o: o.id IS DISTINCT FROM closed), CASE WHEN op = 'removes' THEN [] ELSE [{{'id': id, 'object': object}}] END) END,
    CASE WHEN owner IS NOT NULL THEN last_id WHEN op = 'removes' THEN NULL ELSE id END, CASE WHEN owner IS NOT NULL THEN last_object WHEN op = 'removes' THEN NULL ELSE object END
  FROM (SELECT *, CASE WHEN owner IS NOT NULL OR op NOT IN ('replaces', 'removes') THEN NULL WHEN target IS NOT NULL THEN CASE WHEN len(named) = 1 THEN named[1].id END WHEN len(open) = 1 THEN open[1].id END AS closed
    FROM (SELECT h.*, h.occurred_at AS moment, f.open, f.last_id, f.last_object, list_filter(f.open, lambda o: o.object = h.target) AS named,
        CASE WHEN len(list_filter(f.open, lambda o: o.id = f.last_id)) = 1 AND f.last_object = h.object AND h.op <> 'removes' THEN f.last_id END AS owner
      FROM f JOIN h ON h.user_id = f.user_id AND h.subject = f.subject AND h.predicate = f.predicate AND h.rn = f.rn + 1) x) y)
  SELECT id, moment, op, owner, closed FROM f WHERE id IS NOT NULL)),
ends AS (SELECT closed AS id, id AS by, moment AS until FROM steps WHERE closed IS NOT NULL),
resolved AS (SELECT s.id, CASE WHEN s.owner IS NOT NULL OR e.id IS NOT NULL THEN 'superseded' WHEN s.op = 'removes' THEN 'historical' ELSE 'active' END AS status,
  CASE WHEN s.owner IS NOT NULL THEN o.until WHEN s.op = 'removes' THEN s.moment ELSE e.until END AS until, coalesce(s.owner, e.by) AS by
  FROM steps s LEFT JOIN ends e ON e.id = s.id LEFT JOIN ends o ON o.id = s.owner)"""
FOLDED = FOLD.format(op="update_op", where="")


@R.add("tmp01_resolved_timeline", FOLD.format(op="CASE WHEN update_op = 'replaces' AND id % 7 <> 0 AND contains(content, 'replaced my') AND NOT contains(content, ' with ') THEN 'removes' ELSE update_op END", where="") + " SELECT id, status, strftime(until, '%Y-%m-%d %H:%M:%S') AS until, r.by FROM resolved r")
def _(t: Tables) -> DataFrame:
    out = resolved(normalised_op(facts_of(t)))
    return out.select("id", "status", day_time("until").alias("until"), "by")


@R.add("tmp02_touched_keys", FOLD.format(op="update_op", where=" WHERE (user_id, predicate) IN (SELECT (user_id, predicate) FROM memories WHERE id % 500 = 0)") + " SELECT id, status, r.by FROM resolved r")
def _(t: Tables) -> DataFrame:
    facts = facts_of(t)
    touched = facts.where("id % 500 = 0").select(*KEY).distinct()
    return resolved(facts.join(touched, KEY, "left_semi")).select("id", "status", "by")


@R.add("tmp03_key_gate", "SELECT user_id, predicate, bool_or(update_op = 'replaces' AND id % 9 = 0) OR predicate IN ('signup', 'error') AS resolved FROM memories GROUP BY user_id, subject, predicate")
def _(t: Tables) -> DataFrame:
    gate = F.bool_or((F.col("update_op") == "replaces") & (F.col("id") % 9 == 0)) | F.first("predicate").isin("signup", "error")
    return t.memories.groupBy(*KEY).agg(gate.alias("resolved")).drop("subject")


@R.add("tmp04_operation_normaliser", "SELECT line_id, CASE WHEN contains(text, 'replaced my') AND NOT contains(text, ' with ') THEN 'removes' WHEN contains(text, 'replaced my') THEN 'replaces' ELSE 'coexists' END AS op FROM lines")
def _(t: Tables) -> DataFrame:
    rows = t.lines.select("line_id", F.col("text").alias("content"), F.when(F.col("text").contains("replaced my"), "replaces").otherwise("coexists").alias("update_op"), F.lit(None).cast("string").alias("target"))
    return normalised_op(rows).select("line_id", F.col("update_op").alias("op"))


@R.add("agg21_resolution_counts", FOLDED + " SELECT status, count(*) AS n, count(r.by) AS closed_by_another FROM resolved r GROUP BY status")
def _(t: Tables) -> DataFrame:
    return resolved(facts_of(t)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("by").alias("closed_by_another"))


@R.add("dq27_rebuild_is_stable", FOLDED + " SELECT id, status, strftime(until, '%Y-%m-%d %H:%M:%S') AS until, r.by FROM resolved r")
def _(t: Tables) -> DataFrame:
    """What two folds of the facts, in other orders of arrival, agree on: all of it."""
    facts = facts_of(t)
    one, two = resolved(facts), resolved(facts.repartition(5, "object"))
    x, y = one.select("id", F.struct("status", "until", "by").alias("x")), two.select("id", F.struct("status", "until", "by").alias("y"))
    same = x.join(y, "id").where(F.col("x").eqNullSafe(F.col("y"))).select("id", "x.*")
    return same.select("id", "status", day_time("until").alias("until"), "by")


@R.add("tmp09_state_at", "SELECT id, user_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS since FROM memories WHERE occurred_at <= TIMESTAMP '2024-01-20' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-20')")
def _(t: Tables) -> DataFrame:
    at = F.lit("2024-01-20").cast("timestamp_ntz")
    return t.memories.where((F.col("occurred_at") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).select("id", "user_id", day_time("occurred_at").alias("since"))


@R.add("tmp10_comparison_clock", "SELECT id, strftime(coalesce(event_time, observed_at, valid_from, ingested_at), '%Y-%m-%d %H:%M:%S') AS clock FROM memories")
def _(t: Tables) -> DataFrame:
    return t.memories.select("id", day_time(F.coalesce("event_time", "observed_at", "valid_from", "ingested_at")).alias("clock"))


@R.add("life01_strength_decay", "SELECT id, round(strength * pow(2.0, -greatest(0, epoch(TIMESTAMP '2024-02-15') - epoch(last_accessed_at)) / 86400.0 / 14), 6) AS strength FROM memories")
def _(t: Tables) -> DataFrame:
    return t.memories.select("id", F.round(decayed(F.col("strength"), F.col("last_accessed_at"), "2024-02-15", 14.0), 6).alias("strength"))


def decayed(strength: Column, since: Column, now: str, half_life_days: float) -> Column:
    """Strength after exponential decay; a time that lies ahead decays nothing."""
    seconds = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_micros(since.cast("timestamp")) / 1_000_000
    return strength * F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), seconds) / 86400.0 / half_life_days)


@R.add("life02_reinforcement", "SELECT object, round(1 - (1 - avg(strength)) * pow(0.999, count(*)), 9) AS strength FROM memories GROUP BY object")
def _(t: Tables) -> DataFrame:
    g = t.memories.groupBy("object").agg(F.avg("strength").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("object", F.round(1 - (1 - F.col("s")) * F.pow(F.lit(0.999), "n"), 9).alias("strength"))


@R.add("life03_strength_clamp", "SELECT id, round(least(1.0, greatest(0.0, strength * 1.5 - 0.1)), 9) AS strength FROM memories")
def _(t: Tables) -> DataFrame:
    return t.memories.select("id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("strength") * 1.5 - 0.1)), 9).alias("strength"))


@R.add("life07_pairs_sharing_source", "s AS (SELECT id, user_id, scope, object, CAST(observed_at AS DATE) AS day FROM memories) SELECT x.id AS a, y.id AS b, x.scope <> y.scope AS escapes FROM s x JOIN s y ON x.user_id = y.user_id AND x.day = y.day AND x.object = y.object AND x.id < y.id")
def _(t: Tables) -> DataFrame:
    """Facts of one user, day and value in pairs, and whether a pair leaves its scope. A source is a user's day, so groups stay small."""
    m = t.memories.select("id", "user_id", "scope", "object", F.to_date("observed_at").alias("day"))
    y = m.select(F.col("id").alias("b"), "user_id", "day", "object", F.col("scope").alias("other"))
    return m.withColumnRenamed("id", "a").join(y, ["user_id", "day", "object"]).where("a < b").select("a", "b", (F.col("scope") != F.col("other")).alias("escapes"))


@R.add("life08_rollup_tree", """l AS (SELECT session_id, sha256(string_agg(content, '' ORDER BY turn_index)) AS d FROM turns GROUP BY 1),
w AS (SELECT * FROM (WITH RECURSIVE u AS (SELECT 0 AS level, list(d ORDER BY session_id) AS ds FROM l UNION ALL SELECT level + 1, list_transform(range(0, CAST(ceil(len(ds) / 4.0) AS BIGINT)), lambda i: sha256(array_to_string(ds[i * 4 + 1:i * 4 + 4], ''))) FROM u WHERE len(ds) > 1) SELECT * FROM u))
SELECT level, p - 1 AS p, ds[p] AS d FROM (SELECT level, ds, unnest(generate_series(1, len(ds))) AS p FROM w WHERE level > 0)""")
def _(t: Tables) -> DataFrame:
    """Leaves by fours into parents until one root is left; a node is the digest of its children's digests."""
    text = F.array_join(F.array_sort(F.collect_list(F.struct("turn_index", "content")))["content"], "")
    leaves = t.turns.groupBy("session_id").agg(F.sha2(text, 256).alias("d"))
    return rollup(numbered(leaves, "session_id").select("d", "p"))


def numbered(rows: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """rows with p, their place from 0 by a whole-number key: counted within ranges of `width` keys, after the rows of all ranges before."""
    part = F.floor(F.col(key) / width)
    ranges = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    nth = F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1
    out = rows.withColumn("_part", part).withColumn("_nth", nth).join(ranges.select("_part", before.alias("_before")), "_part")
    return out.withColumn("p", (F.col("_before") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_before")


def rollup(level: DataFrame, fan_out: int = 4) -> DataFrame:
    """level, p, d of all inner nodes over leaves (d, p); levels end at a single root."""
    out, k, n = None, 0, level.count()
    while n > 1:
        k, n = k + 1, -(-n // fan_out)
        child = F.struct("p", "d")
        up = level.groupBy(F.floor(F.col("p") / fan_out).alias("up")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(child))["d"], ""), 256).alias("d"))
        level = up.select("d", F.col("up").alias("p"))
        node = level.select(F.lit(k).alias("level"), "p", "d")
        out = node if out is None else out.union(node)
    return out if out is not None else level.select(F.lit(0).alias("level"), "p", "d").limit(0)


def streamed(rows: DataFrame, by: list[str], order: list[Column], start: Callable[[], dict], step: Callable[[dict, dict], dict | None], schema: str) -> DataFrame:
    """What step(state, row) puts out, if anything, for the rows of each group in order; start() makes a group's state.

    One shuffle by group and a sort; a task reads its groups as a stream of sorted rows and holds the state of the group
    at hand, so that no group is gathered. Columns of schema that rows have too keep their type there.
    """
    columns = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.bool_() if c.endswith(" boolean") else pa.string() if c.endswith(" string") else pa.int64() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                mine = tuple(row[c] for c in by)
                if mine != key:
                    key, state = mine, start()
                put = step(state, row)
                if put is not None:
                    out.append(put)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in zip(columns, kinds, strict=True)], columns)

    return rows.repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def _schema(rows: DataFrame, columns: list[str], more: str = "") -> str:
    return ", ".join(f"{c} {'string' if rows.schema[c].dataType.simpleString() == 'string' else 'long'}" for c in columns) + more


def filled(items: DataFrame, by: list[str], budget: int, *order: Column, cost: str = "cost", key: str = "id") -> DataFrame:
    """by, key of what a greedy fill takes: items in order, each taken if it still fits, else passed over.

    A running sum would stop at the first misfit; the state is what is used so far. by and key are strings or whole numbers.
    """

    def step(state: dict, row: dict) -> dict | None:
        if state["used"] + row[cost] > budget:
            return None
        state["used"] += row[cost]
        return row

    return streamed(items, by, list(order), lambda: {"used": 0}, step, _schema(items, [*by, key]))


GREEDY = """r AS (SELECT user_id, id, token_count AS c, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, id) AS rn FROM memories WHERE status = 'active'),
w AS (SELECT * FROM (WITH RECURSIVE f AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS used, NULL::BIGINT AS id, false AS taken FROM r UNION ALL
  SELECT r.user_id, r.rn, CASE WHEN used + c <= 400 THEN used + c ELSE used END, r.id, used + c <= 400 FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1) SELECT * FROM f))
SELECT user_id, id FROM w WHERE taken"""


@R.add("pack01_greedy_fill", GREEDY)
def _(t: Tables) -> DataFrame:
    items = t.memories.where("status = 'active'").withColumnRenamed("token_count", "cost")
    return filled(items, ["user_id"], 400, F.desc("importance"), F.col("id"))


@R.add("pack05_whole_sessions", """r AS (SELECT s.user_id, s.session_id, n AS c, row_number() OVER (PARTITION BY s.user_id ORDER BY s.session_id % 7, s.session_id) AS rn FROM sessions s JOIN (SELECT session_id, count(*) AS n FROM turns GROUP BY 1) x ON x.session_id = s.session_id),
w AS (SELECT * FROM (WITH RECURSIVE f AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS used, NULL::BIGINT AS session_id, false AS taken FROM r UNION ALL
  SELECT r.user_id, r.rn, CASE WHEN used + c <= 20 THEN used + c ELSE used END, r.session_id, used + c <= 20 FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1) SELECT * FROM f))
SELECT user_id, session_id FROM w WHERE taken""")
def _(t: Tables) -> DataFrame:
    n = t.turns.groupBy("session_id", "user_id").agg(F.count(F.lit(1)).alias("cost"))
    return filled(n, ["user_id"], 20, F.col("session_id") % 7, F.col("session_id"), key="session_id")


@R.add("pack07_page_packing", """r AS (SELECT user_id, session_id * 100 + turn_index AS id, greatest(1, CAST(floor(length(content) / 4.6) AS BIGINT)) AS c, row_number() OVER (PARTITION BY user_id ORDER BY session_id, turn_index) AS rn FROM turns),
w AS (SELECT * FROM (WITH RECURSIVE f AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS used, 0::BIGINT AS page, NULL::BIGINT AS id FROM r UNION ALL
  SELECT r.user_id, r.rn, CASE WHEN used + c <= 600 THEN used + c ELSE c END, CASE WHEN used + c <= 600 THEN page ELSE page + 1 END, r.id FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1) SELECT * FROM f))
SELECT user_id, id, page FROM w WHERE id IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    cost = F.greatest(F.lit(1), F.floor(F.length("content") / 4.6)).cast("long")
    return paged(t.turns.select("user_id", (F.col("session_id") * 100 + F.col("turn_index")).alias("id"), cost.alias("cost")), ["user_id"], 600, "id")


def paged(items: DataFrame, by: list[str], most: int, order: str) -> DataFrame:
    """by, id, page: items in order, a new page whenever the next does not fit."""

    def step(state: dict, row: dict) -> dict:
        if state["used"] + row["cost"] > most:
            state["used"], state["page"] = 0, state["page"] + 1
        state["used"] += row["cost"]
        return row | {"id": row[order], "page": state["page"]}

    return streamed(items, by, [F.col(order)], lambda: {"used": 0, "page": 0}, step, _schema(items, by, ", id long, page long"))


@R.add("pack02_two_lanes", """x AS (SELECT user_id, session_id * 100 + turn_index AS id, role = 'user' AS mine, greatest(1, CAST(floor(length(content) / 4.6) AS BIGINT)) AS c, row_number() OVER (PARTITION BY user_id ORDER BY session_id, turn_index) AS rn FROM turns),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lane, rn) AS o FROM (SELECT *, unnest(CASE WHEN mine THEN [0, 2] ELSE [1] END) AS lane FROM x)),
w AS (SELECT * FROM (WITH RECURSIVE f AS (SELECT DISTINCT user_id, 0::BIGINT AS o, 0::BIGINT AS used, CAST([] AS BIGINT[]) AS ids FROM r UNION ALL
  SELECT user_id, o, CASE WHEN ok THEN used + c ELSE used END, CASE WHEN ok THEN list_append(ids, id) ELSE ids END FROM (SELECT r.user_id, r.o, used, ids, id, c, used + c <= CASE WHEN lane = 0 THEN 900 ELSE 1200 END AND NOT list_contains(ids, id) AS ok FROM f JOIN r ON r.user_id = f.user_id AND r.o = f.o + 1)) SELECT user_id, max_by(ids, o) AS ids FROM f GROUP BY user_id))
SELECT user_id, unnest(ids) AS id FROM w""")
def _(t: Tables) -> DataFrame:
    """Three quarters of the budget for user turns, then others, then user turns again, in one ordered fold."""
    turns = t.turns.select("user_id", "session_id", "turn_index", (F.col("session_id") * 100 + F.col("turn_index")).alias("id"), (F.col("role") == "user").alias("mine"), F.greatest(F.lit(1), F.floor(F.length("content") / 4.6)).cast("long").alias("cost"))
    lanes = turns.select("*", F.explode(F.when(F.col("mine"), F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("lane"))
    return two_lanes(lanes, 900, 1200)


def two_lanes(lanes: DataFrame, first: int, whole: int) -> DataFrame:
    """user_id, id of what is taken: lane 0 up to `first`, then lanes 1 and 2 up to `whole`; what is taken once is not taken again."""

    def step(state: dict, row: dict) -> dict | None:
        if state["used"] + row["cost"] > (first if row["lane"] == 0 else whole) or row["id"] in state["taken"]:
            return None
        state["used"] += row["cost"]
        state["taken"].add(row["id"])  # no more than the budget holds
        return row

    return streamed(lanes, ["user_id"], [F.col("lane"), F.col("session_id"), F.col("turn_index")], lambda: {"used": 0, "taken": set()}, step, "user_id long, id long")


@R.add("pack10_grouped_rendering", "g AS (SELECT user_id, scope, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM memories GROUP BY user_id, scope) SELECT user_id, string_agg(scope || ': ' || ids, ' / ' ORDER BY CASE scope WHEN 'profile' THEN 1 WHEN 'event' THEN 2 ELSE 3 END) AS rendered FROM g GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    ids = F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",")
    parts = t.memories.groupBy("user_id", "scope").agg(ids.alias("ids"))
    o = F.when(F.col("scope") == "profile", 1).when(F.col("scope") == "event", 2).otherwise(3)
    return parts.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct(o.alias("o"), F.concat_ws(": ", "scope", "ids").alias("part"))))["part"], " / ").alias("rendered"))


@R.add("pack11_context_text", "SELECT s.session_id, sha256('[' || (DATE '2024-06-01' - s.started_on) || ' days before] ' || string_agg(role || ': ' || content, chr(10) ORDER BY turn_index)) AS digest FROM sessions s JOIN turns t ON t.session_id = s.session_id GROUP BY s.session_id, s.started_on")
def _(t: Tables) -> DataFrame:
    text = F.array_join(F.array_sort(F.collect_list(F.struct("turn_index", F.concat_ws(": ", "role", "content").alias("x"))))["x"], "\n")
    body = t.turns.groupBy("session_id").agg(text.alias("body"))
    head = F.concat(F.lit("["), F.datediff(F.lit("2024-06-01").cast("date"), "started_on"), F.lit(" days before] "))
    return t.sessions.join(body, "session_id").select("session_id", F.sha2(F.concat(head, "body"), 256).alias("digest"))


@R.add("pack12_full_history", "SELECT user_id, sha256(string_agg(content, chr(10) ORDER BY session_id, turn_index)) AS digest, count(*) AS turns FROM turns GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    item = F.struct("session_id", "turn_index", "content")
    return t.turns.groupBy("user_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item))["content"], "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("turns"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """base with the rows of changes put in by key; the last by version wins among changes of one key."""
    last = changes
    if version:
        last = changes.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(version)))).where("_rn = 1").drop("_rn")
    return base.join(last, keys, "left_anti").unionByName(last)


class Stored:
    """A table of Parquet versions in the shared folder: a write makes a new version and then points to it.

    The pointer is one small file that is written last, so readers see the old version or the new one, and a
    write that fails or runs again leaves nothing half done. Earlier versions stay until they are dropped, so
    a snapshot is a version's number.
    """

    def __init__(self, spark: SparkSession, name: str):
        from stratamem.sources.tables import scratch

        self.spark, self.root, self.version = spark, scratch(spark, name), -1

    def write(self, rows: DataFrame) -> int:
        """Makes rows the table's content; returns the version."""
        rows.write.parquet(f"{self.root}/v{self.version + 1}")
        self.spark.range(1).selectExpr(f"{self.version + 1}L version").coalesce(1).write.mode("append").json(f"{self.root}/pointer")
        self.version += 1
        return self.version

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the version pointed to last, or of an earlier one."""
        if version is None:
            version = self.spark.read.schema("version long").json(f"{self.root}/pointer").agg(F.max("version")).first()[0]
        return self.spark.read.parquet(f"{self.root}/v{version}")

    def restore(self, version: int) -> int:
        """Points to an earlier version's rows again."""
        return self.write(self.read(version))


@R.add("dml04_snapshot_restore", "SELECT status, count(*) AS n, 3 AS versions FROM memories GROUP BY status")
def _(t: Tables) -> DataFrame:
    """A batch that goes wrong half way is taken back: the states before it are what readers find again."""
    table = Stored(t.spark, "states")
    before = table.write(t.memories.select("id", "status"))
    table.write(table.read().withColumn("status", F.when(F.col("id") % 2 == 0, "superseded").otherwise(F.col("status"))))
    table.restore(before)
    return table.read().groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("versions", F.lit(table.version + 1))


@R.add("dml08_insert_edges", "SELECT DISTINCT a, b FROM (SELECT id % 50 AS a, id % 31 AS b FROM memories) WHERE a <> b")
def _(t: Tables) -> DataFrame:
    edges = t.memories.selectExpr("id % 50 a", "id % 31 b").where("a <> b").dropDuplicates()
    have = edges.where("a % 2 = 0")
    return have.union(edges.join(have, ["a", "b"], "left_anti"))


@R.add("dml09_schema_backfill", "SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN source_role END, CASE WHEN subject = 'user' THEN 'user' ELSE 'assistant' END) AS source_role, 0::BIGINT AS access_count FROM memories")
def _(t: Tables) -> DataFrame:
    old = t.memories.where("id % 2 = 1").select("id", "subject")
    new = t.memories.where("id % 2 = 0").select("id", "subject", "source_role")
    both = old.unionByName(new, allowMissingColumns=True)
    return both.select("id", F.coalesce("source_role", F.when(F.col("subject") == "user", "user").otherwise("assistant")).alias("source_role"), F.lit(0).cast("long").alias("access_count"))
