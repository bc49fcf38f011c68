"""Filters, joins and windows over dated facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.plans.fixtures import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
KEY = ["user_id", "subject", "predicate"]


def day_time(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def eligible(facts: DataFrame, user_id: int, active_only: bool = False) -> DataFrame:
    """Facts of one user that are not evicted, or only the active ones."""
    return facts.where((F.col("user_id") == user_id) & ((F.col("status") == "active") if active_only else (F.col("status") != "evicted")))


@R.add("flt01_eligible_facts", "SELECT id, status FROM memories WHERE user_id = 3 AND status <> 'evicted'")
def _(t: Tables) -> DataFrame:
    return eligible(t.memories, 3).select("id", "status")


@R.add("flt02_active_facts", "SELECT id, predicate FROM memories WHERE user_id = 5 AND status = 'active'")
def _(t: Tables) -> DataFrame:
    return eligible(t.memories, 5, True).select("id", "predicate")


@R.add("flt03_namespace_scan", "SELECT id, status, scope FROM memories WHERE user_id = 7")
def _(t: Tables) -> DataFrame:
    return t.memories.where("user_id = 7").select("id", "status", "scope")


def lookup(facts: DataFrame, keys: DataFrame, history: bool = False) -> DataFrame:
    """Facts of each wanted key; evicted ones never, superseded ones if history is asked for."""
    keep = F.col("status") != "evicted" if history else ~F.col("status").isin("evicted", "superseded")
    return facts.where(keep).join(keys, KEY, "left_semi")


@R.add("flt04_key_lookup", "SELECT id, user_id, predicate FROM memories WHERE status NOT IN ('evicted', 'superseded') AND subject = 'user' AND ((user_id % 10 = 1 AND predicate = 'purchase') OR (user_id % 10 = 2 AND predicate = 'signup'))")
def _(t: Tables) -> DataFrame:
    keys = t.memories.where("(user_id % 10 = 1 and predicate = 'purchase') or (user_id % 10 = 2 and predicate = 'signup')").select(*KEY).distinct()
    return lookup(t.memories, keys).select("id", "user_id", "predicate")


def page(facts: DataFrame, where: dict[str, str], offset: int, limit: int) -> DataFrame:
    """One page of the facts that match all given fields, by time then id, each with the number of all that match."""
    for field, value in where.items():
        facts = facts.where(F.col(field) == value)
    total = facts.agg(F.count(F.lit(1)).alias("total"))
    shown = facts.orderBy(F.coalesce("valid_from", "ingested_at"), "id").offset(offset).limit(limit)
    return shown.crossJoin(F.broadcast(total))  # the total is one row


@R.add("flt05_paged_listing", "SELECT id, (SELECT count(*) FROM memories WHERE status = 'active' AND scope = 'profile') AS total FROM (SELECT id FROM memories WHERE status = 'active' AND scope = 'profile' ORDER BY coalesce(valid_from, ingested_at), id LIMIT 25 OFFSET 50)")
def _(t: Tables) -> DataFrame:
    return page(t.memories, {"status": "active", "scope": "profile"}, 50, 25).select("id", "total")


@R.add("flt06_point_get", "SELECT id, user_id FROM memories WHERE id = 77 AND user_id = (SELECT user_id FROM memories WHERE id = 77)")
def _(t: Tables) -> DataFrame:
    owner = t.memories.where("id = 77").select(F.col("id").alias("wanted"), F.col("user_id").alias("owner"))
    return t.memories.join(owner, (F.col("id") == F.col("wanted")) & (F.col("user_id") == F.col("owner"))).select("id", "user_id")


def multi_get(facts: DataFrame, ids: list[int]) -> DataFrame:
    """Facts by id with the place each had in the caller's list; missing ids are left out."""
    wanted = facts.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ids)], "id long, pos long")
    return facts.join(wanted, "id")


@R.add("flt07_ordered_multi_get", "SELECT id, pos, predicate FROM memories JOIN (VALUES (90, 0::BIGINT), (12, 1), (555, 2), (-1, 3), (7, 4)) w(wid, pos) ON id = wid")
def _(t: Tables) -> DataFrame:
    return multi_get(t.memories, [90, 12, 555, -1, 7]).select("id", "pos", "predicate")


def as_of(facts: DataFrame, at: str | Column) -> DataFrame:
    """Facts in force at a time: start <= at < end, whatever their status; without a start none are."""
    start = F.coalesce("event_time", "observed_at", "valid_from")
    at = F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else at
    return facts.where((start <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


@R.add("flt08_as_of", "SELECT id, user_id, object FROM memories WHERE coalesce(event_time, observed_at, valid_from) <= TIMESTAMP '2024-01-12' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-12')")
def _(t: Tables) -> DataFrame:
    return as_of(t.memories, "2024-01-12").select("id", "user_id", "object")


@R.add("flt09_relation_members", "SELECT id FROM memories WHERE predicate IN ('purchase', 'click') AND subject = 'user' AND id NOT IN (SELECT id FROM memories WHERE id % 10 = 0)")
def _(t: Tables) -> DataFrame:
    relation = t.spark.createDataFrame([("purchase", "owns"), ("click", "owns"), ("view", "saw")], "predicate string, relation string")
    returned = t.memories.where("id % 10 = 0").select("id")
    wanted = t.memories.where("subject = 'user'").join(F.broadcast(relation.where("relation = 'owns'")), "predicate")
    return wanted.join(returned, "id", "left_anti").select("id")


@R.add("flt13_completed_acts", "SELECT id, scope, predicate FROM memories WHERE scope IN ('event', 'profile') AND NOT regexp_matches(predicate, 'plan|wish|view')")
def _(t: Tables) -> DataFrame:
    return t.memories.where(F.col("scope").isin("event", "profile") & ~F.col("predicate").rlike("plan|wish|view")).select("id", "scope", "predicate")


@R.add("flt14_trackable_keys", "SELECT predicate, count(*) FILTER (update_op <> 'coexists' AND predicate NOT IN ('', 'none')) AS trackable, count(*) AS facts FROM memories GROUP BY predicate")
def _(t: Tables) -> DataFrame:
    ok = (F.col("update_op") != "coexists") & ~F.col("predicate").isin("", "none")
    return t.memories.groupBy("predicate").agg(F.count_if(ok).alias("trackable"), F.count(F.lit(1)).alias("facts"))


@R.add("flt15_measurable_questions", "SELECT question_id FROM results WHERE question_type NOT IN ('es', 'fr') AND a IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.results.where(~F.col("question_type").isin("es", "fr") & F.col("a").isNotNull()).select("question_id")


@R.add("join01_fact_entities", "SELECT id, user_id, e AS entity FROM (SELECT id, user_id, unnest(entities) AS e FROM memories WHERE status = 'active')")
def _(t: Tables) -> DataFrame:
    facts = t.memories.where("status = 'active'")
    links = facts.select("user_id", F.col("id").alias("memory_id"), F.explode("entities").alias("entity"))
    entities = links.select("user_id", "entity").distinct()
    return links.join(entities, ["user_id", "entity"]).select(F.col("memory_id").alias("id"), "user_id", "entity")


@R.add("join02_turns_of_user", "SELECT t.session_id, turn_index, s.user_id FROM turns t JOIN sessions s ON t.session_id = s.session_id WHERE s.user_id = 2")
def _(t: Tables) -> DataFrame:
    return t.turns.drop("user_id").join(t.sessions.where("user_id = 2"), "session_id").select("session_id", "turn_index", "user_id")


def provenance(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """Each fact with its source turns: the one named, or all of the session where none is."""
    m = facts.select("id", F.col("source_session").alias("session_id"), F.col("source_turn"))
    return m.join(turns, "session_id").where(F.col("source_turn").isNull() | (F.col("source_turn") == F.col("turn_index"))).dropDuplicates(["id", "session_id", "turn_index"])


SOURCED = "SELECT id, user_id, content, importance, date_diff('day', DATE '2024-01-01', CAST(observed_at AS DATE)) AS source_session, CASE WHEN source_role = 'user' THEN hour(observed_at) // 3 END AS source_turn FROM memories"


def sourced(t: Tables) -> DataFrame:
    """Facts with their source: the session that began on the day they were said, and what a user said by three-hour turn."""
    return t.memories.selectExpr("id", "user_id", "content", "importance", "cast(datediff(observed_at, date'2024-01-01') as bigint) source_session", "case when source_role = 'user' then cast(hour(observed_at) div 3 as bigint) end source_turn")


@R.add("join03_provenance", f"m AS ({SOURCED}) SELECT DISTINCT m.id, session_id, turn_index FROM m JOIN turns ON session_id = source_session WHERE source_turn IS NULL OR source_turn = turn_index")
def _(t: Tables) -> DataFrame:
    return provenance(sourced(t), t.turns).select("id", "session_id", "turn_index")


@R.add("join04_span_text", f"m AS ({SOURCED}) SELECT m.id, substr(turns.content, 3, 10) AS span FROM m LEFT JOIN turns ON session_id = source_session AND turn_index = source_turn")
def _(t: Tables) -> DataFrame:
    m = sourced(t).withColumnsRenamed({"source_session": "session_id", "source_turn": "turn_index"}).drop("user_id", "content")
    return m.join(t.turns, ["session_id", "turn_index"], "left").select("id", F.substring("content", 3, 10).alias("span"))


@R.add("join05_session_has_fact", f"m AS ({SOURCED}) SELECT session_id, EXISTS (SELECT 1 FROM m WHERE m.source_session = s.session_id AND m.source_turn = 2) AS has_fact FROM sessions s")
def _(t: Tables) -> DataFrame:
    with_fact = sourced(t).where("source_turn = 2").select(F.col("source_session").alias("session_id"), F.lit(True).alias("found")).distinct()
    return t.sessions.join(with_fact, "session_id", "left").select("session_id", F.coalesce("found", F.lit(False)).alias("has_fact"))


def without_predecessor(facts: DataFrame) -> DataFrame:
    """Replacements that no earlier or simultaneous fact of the same key precedes: one window, no self join."""
    first = F.min("occurred_at").over(W.partitionBy(*KEY))
    alone = F.count(F.lit(1)).over(W.partitionBy(*KEY, "occurred_at"))
    return facts.withColumns({"_first": first, "_alone": alone}).where((F.col("update_op") == "replaces") & (F.col("occurred_at") == F.col("_first")) & (F.col("_alone") == 1)).drop("_first", "_alone")


@R.add("join06_replacement_without_predecessor", "SELECT id FROM memories m WHERE update_op = 'replaces' AND NOT EXISTS (SELECT 1 FROM memories o WHERE o.user_id = m.user_id AND o.subject = m.subject AND o.predicate = m.predicate AND o.id <> m.id AND o.occurred_at <= m.occurred_at)")
def _(t: Tables) -> DataFrame:
    return without_predecessor(t.memories).select("id")


@R.add("join07_superseded_pairs", "SELECT l.id AS loser, w.id AS winner, l.predicate AS was, w.predicate AS now FROM memories l JOIN memories w ON l.superseded_by = w.id")
def _(t: Tables) -> DataFrame:
    loser = t.memories.where("superseded_by is not null").select(F.col("id").alias("loser"), F.col("superseded_by").alias("winner"), F.col("predicate").alias("was"))
    return loser.join(t.memories.select(F.col("id").alias("winner"), F.col("predicate").alias("now")), "winner").select("loser", "winner", "was", "now")


@R.add("join09_below_rank", "SELECT id FROM memories WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM memories WHERE id % 3 = 0) AND id NOT IN (SELECT id FROM memories WHERE status = 'superseded')")
def _(t: Tables) -> DataFrame:
    m = t.memories
    return m.where("id % 2 = 0").select("id").join(m.where("id % 3 = 0").select("id"), "id", "left_anti").join(m.where("status = 'superseded'").select("id"), "id", "left_anti")


def overlaps(left: DataFrame, right: DataFrame, days: int = 8) -> DataFrame:
    """Rows of left [from, to] and right [lo, hi] whose days overlap, joined on shared buckets of days.

    Each interval is listed once for each bucket that it touches, and a pair is kept in the first
    bucket that both touch, so that it comes once.
    """
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01")).cast("int")
    bucket = lambda a, b: F.explode(F.sequence((number(a) / days).cast("int"), (number(b) / days).cast("int")))
    x = left.withColumn("_bucket", bucket("from_day", "to_day"))
    y = right.withColumn("_bucket", bucket("lo", "hi"))
    first = F.greatest((number("from_day") / days).cast("int"), (number("lo") / days).cast("int"))
    return x.join(y, "_bucket").where((F.col("from_day") <= F.col("hi")) & (F.col("lo") <= F.col("to_day")) & (F.col("_bucket") == first)).drop("_bucket")


WINDOWS = "(VALUES (1::BIGINT, DATE '2024-01-03', DATE '2024-01-04'), (2, DATE '2024-01-20', DATE '2024-01-29')) w(window_id, lo, hi)"


@R.add("join14_interval_overlap", f"SELECT id, window_id FROM memories, {WINDOWS} WHERE valid_to IS NOT NULL AND CAST(valid_from AS DATE) <= hi AND lo <= CAST(valid_to AS DATE)")
def _(t: Tables) -> DataFrame:
    spans = t.memories.where("valid_to is not null").selectExpr("id", "to_date(valid_from) from_day", "to_date(valid_to) to_day")
    windows = t.spark.createDataFrame([(1, "2024-01-03", "2024-01-04"), (2, "2024-01-20", "2024-01-29")], "window_id long, lo string, hi string").selectExpr("window_id", "to_date(lo) lo", "to_date(hi) hi")
    return overlaps(spans, windows).select("id", "window_id")


@R.add("join15_state_at_probes", "SELECT p.id AS probe, count(*) AS in_force FROM (SELECT id, user_id, predicate, observed_at AS at FROM memories WHERE id % 50 = 0) p JOIN memories m ON m.user_id = p.user_id AND m.predicate = p.predicate AND m.valid_from <= p.at AND (m.valid_to IS NULL OR m.valid_to > p.at) GROUP BY p.id")
def _(t: Tables) -> DataFrame:
    probes = t.memories.where("id % 50 = 0").select(F.col("id").alias("probe"), "user_id", "predicate", F.col("observed_at").alias("at"))
    m = t.memories.select("user_id", "predicate", "valid_from", "valid_to")
    hit = probes.join(m, ["user_id", "predicate"]).where("valid_from <= at and (valid_to is null or valid_to > at)")
    return hit.groupBy("probe").agg(F.count(F.lit(1)).alias("in_force"))


@R.add("join22_cross_tenant_leak", f"m AS ({SOURCED}) SELECT m.id, s.user_id AS session_owner FROM m JOIN sessions s ON s.session_id = m.source_session WHERE m.user_id <> s.user_id")
def _(t: Tables) -> DataFrame:
    s = t.sessions.select(F.col("session_id").alias("source_session"), F.col("user_id").alias("session_owner"))
    return sourced(t).join(s, "source_session").where("user_id <> session_owner").select("id", "session_owner")


CAPS = "(VALUES ('m0', 'click', 10::BIGINT), ('m0', '*', 20), ('*', 'click', 30), ('*', '*', 40)) c(cap_model, cap_op, cap)"


@R.add("join23_most_specific_cap", f"SELECT event_id, cap FROM (SELECT event_id, cap, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN cap_model <> '*' AND cap_op <> '*' THEN 0 WHEN cap_model <> '*' THEN 1 WHEN cap_op <> '*' THEN 2 ELSE 3 END) AS rn FROM usage, {CAPS} WHERE cap_model IN (model, '*') AND cap_op IN (operation, '*')) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    caps = t.spark.createDataFrame([("m0", "click", 10), ("m0", "*", 20), ("*", "click", 30), ("*", "*", 40)], "m string, o string, cap long")
    out = t.usage.select("event_id", "model", "operation")
    for k, (m, o) in enumerate((("model", "operation"), ("model", None), (None, "operation"), (None, None))):
        part = caps.where((F.col("m") != "*" if m else F.col("m") == "*") & (F.col("o") != "*" if o else F.col("o") == "*")).withColumnRenamed("cap", f"cap{k}")
        on = (F.col("model") == F.col("m") if m else F.lit(True)) & (F.col("operation") == F.col("o") if o else F.lit(True))
        out = out.join(F.broadcast(part), on, "left").drop("m", "o")
    return out.select("event_id", F.coalesce("cap0", "cap1", "cap2", "cap3").alias("cap"))


@R.add("join24_evidence_edges", "SELECT superseded_by AS memory_id, array_to_string(list_sort(list(id)), ',') AS sources FROM (SELECT id, superseded_by FROM memories WHERE superseded_by IS NOT NULL UNION SELECT id, id + 1 FROM memories WHERE status = 'active' AND update_op = 'coexists') GROUP BY superseded_by")
def _(t: Tables) -> DataFrame:
    closed = t.memories.where("superseded_by is not null").selectExpr("superseded_by memory_id", "id source_id")
    beside = t.memories.where("status = 'active' and update_op = 'coexists'").selectExpr("id + 1 memory_id", "id source_id")
    edges = closed.union(beside).distinct()
    return edges.groupBy("memory_id").agg(F.array_join(F.array_sort(F.collect_list("source_id")).cast("array<string>"), ",").alias("sources"))


@R.add("join25_nearest_in_time", "g AS (SELECT user_id, started_on AS gold FROM sessions WHERE session_id % 20 < 8), n AS (SELECT s.session_id, s.user_id, min(abs(s.started_on - g.gold)) AS gap FROM sessions s JOIN g ON g.user_id = s.user_id WHERE s.session_id % 20 >= 8 GROUP BY ALL) SELECT session_id, CAST(gap AS BIGINT) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap, session_id) AS rn FROM n) WHERE rn <= 3")
def _(t: Tables) -> DataFrame:
    # the nearest gold day before and after each session, by two running windows: no join
    gold = F.when(F.col("session_id") % 20 < 8, F.col("started_on"))
    by = W.partitionBy("user_id").orderBy("started_on", "session_id")
    s = t.sessions.withColumns({"_b": F.last(gold, True).over(by), "_a": F.first(gold, True).over(by.rowsBetween(0, W.unboundedFollowing))})
    gap = F.least(F.abs(F.datediff("started_on", "_b")), F.abs(F.datediff("_a", "started_on")))
    near = s.where("session_id % 20 >= 8").withColumn("gap", gap.cast("long")).where("gap is not null")
    return near.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy("gap", "session_id"))).where("rn <= 3").select("session_id", "gap")


TIMELINE = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@R.add("win01_timeline", "SELECT id, row_number() OVER (PARTITION BY user_id, subject, predicate ORDER BY coalesce(valid_from, ingested_at), id) AS place FROM memories WHERE status <> 'evicted'")
def _(t: Tables) -> DataFrame:
    by = W.partitionBy(*KEY).orderBy(F.coalesce("valid_from", "ingested_at"), "id")
    return t.memories.where("status <> 'evicted'").select("id", F.row_number().over(by).cast("long").alias("place"))


@R.add("win02_restatement_runs", "r AS (SELECT *, CASE WHEN object = lag(object) OVER w AND update_op <> 'removes' AND lag(update_op) OVER w <> 'removes' THEN 0 ELSE 1 END AS starts FROM memories WINDOW w AS (PARTITION BY user_id, subject, predicate ORDER BY occurred_at, id)), n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id, subject, predicate ORDER BY occurred_at, id) AS run FROM r) SELECT user_id, predicate, CAST(run AS BIGINT) AS run, min_by(id, (occurred_at, id)) AS owner, count(*) AS mentions FROM n GROUP BY user_id, subject, predicate, run")
def _(t: Tables) -> DataFrame:
    by = W.partitionBy(*KEY).orderBy("occurred_at", "id")
    same = (F.col("object") == F.lag("object").over(by)) & (F.col("update_op") != "removes") & (F.lag("update_op").over(by) != "removes")
    runs = t.memories.withColumn("starts", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("starts").over(by))
    return runs.groupBy(*KEY, "run").agg(F.min_by("id", F.struct("occurred_at", "id")).alias("owner"), F.count(F.lit(1)).alias("mentions")).drop("subject")


@R.add("win03_successor_end", "SELECT id, strftime(lead(occurred_at) OVER (PARTITION BY user_id, subject, predicate ORDER BY occurred_at, id), '%Y-%m-%d %H:%M:%S') AS valid_until FROM memories WHERE update_op = 'replaces'")
def _(t: Tables) -> DataFrame:
    by = W.partitionBy(*KEY).orderBy("occurred_at", "id")
    return t.memories.where("update_op = 'replaces'").select("id", day_time(F.lead("occurred_at").over(by)).alias("valid_until"))


@R.add("win04_chain_rendering", "SELECT user_id, predicate, string_agg(CASE WHEN status = 'active' THEN 'now ' ELSE 'was ' END || object, ' > ' ORDER BY occurred_at, id) AS chain FROM memories WHERE status <> 'evicted' GROUP BY user_id, subject, predicate HAVING count(*) >= 2")
def _(t: Tables) -> DataFrame:
    step = F.struct("occurred_at", "id", F.concat(F.when(F.col("status") == "active", "now ").otherwise("was "), "object").alias("text"))
    chains = t.memories.where("status <> 'evicted'").groupBy(*KEY).agg(F.array_sort(F.collect_list(step)).alias("steps")).where(F.size("steps") >= 2)
    return chains.select("user_id", "predicate", F.array_join(F.col("steps.text"), " > ").alias("chain"))


@R.add("win05_event_window_around_hits", "r AS (SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at, id) AS rn, id % 40 = 0 AS hit FROM memories), w AS (SELECT *, min(CASE WHEN hit THEN rn END) OVER (PARTITION BY user_id) AS lo, max(CASE WHEN hit THEN rn END) OVER (PARTITION BY user_id) AS hi FROM r) SELECT id, rn FROM w WHERE rn BETWEEN lo - 2 AND hi + 2")
def _(t: Tables) -> DataFrame:
    own = W.partitionBy("user_id")
    r = t.memories.select("id", "user_id", F.row_number().over(own.orderBy("occurred_at", "id")).cast("long").alias("rn"), (F.col("id") % 40 == 0).alias("hit"))
    hit = F.when(F.col("hit"), F.col("rn"))
    return r.withColumns({"lo": F.min(hit).over(own), "hi": F.max(hit).over(own)}).where("rn between lo - 2 and hi + 2").select("id", "rn")


@R.add("win06_neighbour_turns", "a AS (SELECT session_id, turn_index FROM turns WHERE turn_index = 2) SELECT DISTINCT t.session_id, t.turn_index FROM turns t JOIN a ON a.session_id = t.session_id AND abs(t.turn_index - a.turn_index) <= 1")
def _(t: Tables) -> DataFrame:
    near = t.turns.where("turn_index = 2").select("session_id", F.explode(F.sequence(F.col("turn_index") - 1, F.col("turn_index") + 1)).alias("turn_index"))
    return t.turns.select("session_id", "turn_index").join(near, ["session_id", "turn_index"], "left_semi")


@R.add("win07_day_runs", "d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d) SELECT user_id, CAST(min(day) AS VARCHAR) AS first_day, count(*) AS days FROM i GROUP BY user_id, island HAVING count(*) >= 3")
def _(t: Tables) -> DataFrame:
    days = t.raw("events").select("user_id", F.to_date("ts").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(W.partitionBy("user_id").orderBy("day")))
    return days.withColumn("island", island).groupBy("user_id", "island").agg(F.min("day").cast("string").alias("first_day"), F.count(F.lit(1)).alias("days")).where("days >= 3").drop("island")


@R.add("win08_latest_agrees", "r AS (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS rk FROM orders) SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS latest FROM r WHERE rk = 1 GROUP BY o_custkey")
def _(t: Tables) -> DataFrame:
    top = t.raw("orders").withColumn("rk", F.rank().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate")))).where("rk = 1")
    return top.groupBy("o_custkey").agg(F.when(F.count_distinct("o_orderpriority") == 1, F.min("o_orderpriority")).alias("latest"))


@R.add("win10_start_finish", "p AS (SELECT user_id, object, min(CASE WHEN predicate = 'signup' THEN CAST(ts AS DATE) END) AS s, max(CASE WHEN predicate = 'purchase' THEN CAST(ts AS DATE) END) AS f FROM (SELECT user_id, object, predicate, observed_at AS ts FROM memories) GROUP BY user_id, object) SELECT user_id, CAST(sum(f - s) AS BIGINT) AS days FROM p WHERE s IS NOT NULL AND f >= s GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    at = lambda kind: F.when(F.col("predicate") == kind, F.to_date("observed_at"))
    pairs = t.memories.groupBy("user_id", "object").agg(F.min(at("signup")).alias("s"), F.max(at("purchase")).alias("f")).where("f >= s")
    return pairs.groupBy("user_id").agg(F.sum(F.datediff("f", "s")).alias("days"))


@R.add("win11_nth_artefact", "SELECT session_id, turn_index FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) AS n FROM turns WHERE role = 'assistant') WHERE n = 2")
def _(t: Tables) -> DataFrame:
    n = F.row_number().over(W.partitionBy("session_id").orderBy("turn_index"))
    return t.turns.where("role = 'assistant'").withColumn("n", n).where("n = 2").select("session_id", "turn_index")


@R.add("win12_batch_position", "p AS (SELECT session_id, (row_number() OVER (PARTITION BY user_id ORDER BY session_id) - 1) % 5 AS position FROM sessions), n AS (SELECT session_id, count(*) AS turns FROM turns GROUP BY 1) SELECT position, count(*) AS sessions, count(*) FILTER (turns < 4) AS short FROM p JOIN n USING (session_id) GROUP BY position")
def _(t: Tables) -> DataFrame:
    place = ((F.row_number().over(W.partitionBy("user_id").orderBy("session_id")) - 1) % 5).cast("long")
    n = t.turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    return t.sessions.withColumn("position", place).join(n, "session_id").groupBy("position").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("turns") < 4).alias("short"))


@R.add("win13_fixed_batches", "SELECT session_id, (row_number() OVER (PARTITION BY user_id ORDER BY session_id) - 1) // 4 AS batch FROM sessions")
def _(t: Tables) -> DataFrame:
    return t.sessions.select("session_id", F.floor((F.row_number().over(W.partitionBy("user_id").orderBy("session_id")) - 1) / 4).alias("batch"))


@R.add("win14_gap_between_events", "SELECT id, CAST(CAST(lead(occurred_at) OVER w AS DATE) - CAST(occurred_at AS DATE) AS BIGINT) AS days FROM memories WHERE predicate = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY occurred_at, id) QUALIFY CAST(lead(occurred_at) OVER w AS DATE) - CAST(occurred_at AS DATE) > 0")
def _(t: Tables) -> DataFrame:
    nxt = F.lead("occurred_at").over(W.partitionBy("user_id").orderBy("occurred_at", "id"))
    gaps = t.memories.where("predicate = 'purchase'").select("id", F.datediff(nxt, "occurred_at").cast("long").alias("days"))
    return gaps.where("days > 0")


@R.add("win15_current_of_superseded", "SELECT user_id, predicate, CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day, max(CASE WHEN status = 'active' THEN object END) AS current FROM memories GROUP BY user_id, subject, predicate, CAST(occurred_at AS DATE) HAVING count(*) FILTER (status = 'active') = 1 AND count(*) FILTER (status = 'superseded') > 0")
def _(t: Tables) -> DataFrame:
    """The key is a day's, so that most keys have the one active value that the operator asks for."""
    active = F.col("status") == "active"
    keys = t.memories.groupBy(*KEY, F.to_date("occurred_at").cast("string").alias("day")).agg(F.count_if(active).alias("n"), F.count_if(F.col("status") == "superseded").alias("old"), F.max(F.when(active, F.col("object"))).alias("current"))
    return keys.where("n = 1 and old > 0").select("user_id", "predicate", "day", "current")
