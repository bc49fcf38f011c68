"""Views that give the driver's tables the shapes of the library: facts, turns, sessions, results, usage.

Each view is written once for Spark and once as a common table expression for the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The views over one folder of Parquet tables; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def turns(self) -> DataFrame:
        """session_id, turn_index, role, content, user_id"""
        c = F.col
        return self.raw("conversations").select(c("conv_id").alias("session_id"), c("turn").alias("turn_index"), "role", c("text").alias("content"), (c("conv_id") % 8).alias("user_id"))

    @cached_property
    def sessions(self) -> DataFrame:
        """session_id, user_id, started_on: one a conversation"""
        return self.turns.select("session_id", "user_id").distinct().withColumn("started_on", F.expr("date_add(date'2024-01-01', cast(session_id as int))"))

    @cached_property
    def memories(self) -> DataFrame:
        """Facts made of events: a key (user_id, subject, predicate), a value, two time axes, a status."""
        return self.raw("events").selectExpr(
            "event_id id", "user_id", "'user' subject", "event_type predicate",
            "cast(cast(get_json_object(props, '$.k') as bigint) % 5 as string) object",
            "case when event_id % 4 <> 0 then ts end event_time", "ts observed_at", "ts + interval 1 hour ingested_at",
            "ts occurred_at", "ts valid_from", "case when event_id % 11 = 0 then ts + interval 3 days end valid_to",
            "case when event_id % 13 = 0 then 'evicted' when event_id % 11 = 0 then 'superseded' else 'active' end status",
            "case when event_id % 11 = 0 then event_id + 1 end superseded_by",
            "case event_id % 5 when 0 then 'removes' when 1 then 'replaces' when 2 then 'replaces' else 'coexists' end update_op",
            "case event_id % 3 when 0 then 'event' when 1 then 'profile' else 'task' end scope",
            "case when event_id % 2 = 0 then 'user' else 'assistant' end source_role",
            "least(1.0D, value / 500) importance", "1.0D / (1 + event_id % 7) strength",
            "ts + make_dt_interval(cast(event_id % 20 as int)) last_accessed_at",
            "20 + event_id % 50 token_count", "array(concat('e', event_id % 7), concat('f', event_id % 5)) entities",
            "concat(event_type, ' ', event_id % 97) content",
        )

    @cached_property
    def results(self) -> DataFrame:
        """question_id, question_type, a, b: two arms' verdicts"""
        d = self.raw("documents").select("doc_id", "lang")
        return self.raw("labels").join(d, "doc_id").selectExpr("doc_id question_id", "lang question_type", "quality = 1 a", "toxic = 0 b")

    @cached_property
    def repeats(self) -> DataFrame:
        """question_id, question_type, arm, repeat, correct: each verdict three times, a few flipped by hash"""
        return self.results.selectExpr("question_id", "question_type", "stack(2, 'a', a, 'b', b) as (arm, verdict)", "explode(array(0, 1, 2)) repeat").selectExpr(
            "question_id", "question_type", "arm", "repeat",
            "if(substring(sha2(concat_ws(':', question_id, arm, repeat), 256), 1, 1) = '0', not verdict, verdict) correct",
        )

    @cached_property
    def usage(self) -> DataFrame:
        return self.raw("events").selectExpr("event_id", "user_id", "to_date(ts) day", "event_type operation", "concat('m', event_id % 3) model", "1L calls", "cast(event_type = 'error' as bigint) failed_calls", "cast(floor(value) as bigint) input_tokens", "event_id % 100 output_tokens")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").selectExpr("vec_id id", "cast(label as bigint) tenant", "embedding")

    @cached_property
    def lines(self) -> DataFrame:
        """What customers and an assistant say about orders: one English line an order, with its dates, amounts and names.

        The given conversations hold next to no English statements, dates or numbers; orders do, as columns.
        """
        month = "element_at(array({}), month({}))"
        months = ", ".join(f"'{m}'" for m in MONTHS)
        o = self.raw("orders").selectExpr("o_orderkey line_id", "o_custkey session_id", "o_orderkey turn_index", "cast(o_orderdate as date) day", "cast(floor(o_totalprice) as bigint) price", "o_orderkey + o_custkey pick")
        parts = o.selectExpr(
            "*", "date_sub(day, cast(pick % 40 as int)) earlier", "pick % 9 + 2 n",
            f"element_at(array({_quoted(CITIES)}), cast(pick % {len(CITIES)} as int) + 1) city", f"element_at(array({_quoted(NAMES)}), cast(pick % {len(NAMES)} as int) + 1) name",
            f"element_at(array({_quoted(NAMES)}), cast(session_id % {len(NAMES)} as int) + 1) other", f"element_at(array({_quoted(SPELLED)}), cast(pick % {len(SPELLED)} as int) + 1) spelled",
        ).selectExpr("*", f"concat({month.format(months, 'earlier')}, ' ', day(earlier), ', ', year(earlier)) named")
        return parts.selectExpr("line_id", "session_id", "turn_index", f"{SPEAKER} role", "cast(day as string) said_on", f"{SAYING} text")


MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
CITIES, NAMES = ("Lisbon", "Porto", "Oslo", "Kyoto", "Quito", "Bergen", "Turin"), ("Anna", "Ben", "Carla", "Dmitri", "Elif")
SPELLED = ("one", "two", "three", "five", "seven", "eleven", "thirteen", "seventeen", "forty")
#: What is said, by the line's number; {x} stands for a column. Lines that begin with @ are the assistant's.
SAYINGS = (
    "I moved to {city} on {earlier}. It rained for {n} days!",
    "@{city} is lovely. Shall I list {n} cafes?",
    "I bought a Nikon camera yesterday for ${price}. How much is a lens?",
    "I visited {city} {spelled} weeks ago with {name} and {other}.",
    "@1. Walk the bridge. 2. Visit the cellar. 3. See the museum.",
    "Suppose I sold the camera today. What would I get?",
    "I switched from TensorFlow to PyTorch on {named}.",
    "How many cities did I visit in total?",
    "How many days ago did I buy the camera?",
    "I replaced my bike with a scooter. My rent is $1,{n}00 now.",
    "@Your rent rose by {n} percent. Is that right?",
    "I recommend tea; I prefer green tea over coffee.",
    "My sister {name} finished the course on {earlier} after {spelled} weeks.",
    "What is my current city?",
    "When did I start the course, last month or in {city}?",
    "I ran {n} km today and 12 km on {earlier}.",
    "@Great. {n} km in total is a lot.",
    "Which phone do you suggest, given that I like small ones?",
    "I replaced my phone. It cost ${price}, not ${n}.",
    "{name} and {other} came {n} days ago; we ate at Simon & Sons in {city}.",
    "I do not own {spelled} bikes, but I own {n}.",
    "@You said that it cost ${price}. I noted that on {said}.",
    "I have read \"Yesterday\" by {other}. We met last Friday in {city}.",
    "My {spelled} plants and {n} cats moved with me {spelled} months ago.",
)


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _saying(text: str) -> str:
    """A template as an SQL expression that both engines read."""
    columns = {"earlier": "CAST(earlier AS STRING)", "n": "CAST(n AS STRING)", "price": "CAST(price AS STRING)", "said": "CAST(day AS STRING)"}
    out = ["'" + part.replace("'", "''") + "'" if i % 2 == 0 else columns.get(part, part) for i, part in enumerate(re.split(r"[{}]", text.lstrip("@")))]
    return " || ".join(x for x in out if x != "''")


SAYING = f"CASE pick % {len(SAYINGS)} " + " ".join(f"WHEN {k} THEN {_saying(x)}" for k, x in enumerate(SAYINGS)) + " END"
SPEAKER = f"CASE WHEN pick % {len(SAYINGS)} IN ({', '.join(str(k) for k, x in enumerate(SAYINGS) if x.startswith('@'))}) THEN 'assistant' ELSE 'user' END"


VIEWS = f"""WITH turns AS (SELECT conv_id AS session_id, turn AS turn_index, role, text AS content, conv_id % 8 AS user_id FROM conversations),
sessions AS (SELECT DISTINCT session_id, user_id, DATE '2024-01-01' + CAST(session_id AS INTEGER) AS started_on FROM turns),
memories AS (SELECT event_id AS id, user_id, 'user' AS subject, event_type AS predicate,
  CAST(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 5 AS VARCHAR) AS object,
  CASE WHEN event_id % 4 <> 0 THEN ts END AS event_time, ts AS observed_at, ts + INTERVAL 1 HOUR AS ingested_at,
  ts AS occurred_at, ts AS valid_from, CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL 3 DAY END AS valid_to,
  CASE WHEN event_id % 13 = 0 THEN 'evicted' WHEN event_id % 11 = 0 THEN 'superseded' ELSE 'active' END AS status,
  CASE WHEN event_id % 11 = 0 THEN event_id + 1 END AS superseded_by,
  CASE event_id % 5 WHEN 0 THEN 'removes' WHEN 1 THEN 'replaces' WHEN 2 THEN 'replaces' ELSE 'coexists' END AS update_op,
  CASE event_id % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'profile' ELSE 'task' END AS scope,
  CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS source_role,
  least(1.0::DOUBLE, value / 500) AS importance, 1.0::DOUBLE / (1 + event_id % 7) AS strength,
  ts + to_days(CAST(event_id % 20 AS INTEGER)) AS last_accessed_at,
  20 + event_id % 50 AS token_count, ['e' || (event_id % 7), 'f' || (event_id % 5)] AS entities,
  event_type || ' ' || (event_id % 97) AS content FROM events),
results AS (SELECT l.doc_id AS question_id, d.lang AS question_type, quality = 1 AS a, toxic = 0 AS b FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
repeats AS (SELECT question_id, question_type, arm, rep AS repeat,
  CASE WHEN sha256(question_id || ':' || arm || ':' || rep)[1] = '0' THEN NOT verdict ELSE verdict END AS correct
  FROM (SELECT question_id, question_type, 'a' AS arm, a AS verdict FROM results UNION ALL SELECT question_id, question_type, 'b', b FROM results), (VALUES (0), (1), (2)) r(rep)),
usage AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type AS operation, 'm' || (event_id % 3) AS model, 1::BIGINT AS calls,
  CAST(event_type = 'error' AS BIGINT) AS failed_calls, CAST(floor(value) AS BIGINT) AS input_tokens, event_id % 100 AS output_tokens FROM events),
vectors AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS tenant, embedding FROM embeddings),
said AS (SELECT *, day - CAST(pick % 40 AS INTEGER) AS earlier, pick % 9 + 2 AS n, [{_quoted(CITIES)}][pick % {len(CITIES)} + 1] AS city,
  [{_quoted(NAMES)}][pick % {len(NAMES)} + 1] AS name, [{_quoted(NAMES)}][session_id % {len(NAMES)} + 1] AS other, [{_quoted(SPELLED)}][pick % {len(SPELLED)} + 1] AS spelled
  FROM (SELECT o_orderkey AS line_id, o_custkey AS session_id, o_orderkey AS turn_index, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderkey + o_custkey AS pick FROM orders)),
lines AS (SELECT line_id, session_id, turn_index, {SPEAKER} AS role, CAST(day AS STRING) AS said_on, {SAYING} AS text
  FROM (SELECT *, [{_quoted(MONTHS)}][month(earlier)] || ' ' || day(earlier) || ', ' || year(earlier) AS named FROM said))"""

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of a module with their oracles."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: bool = True):
        """Decorates a function of Tables; sql follows the views, as further expressions or a SELECT."""

        def keep(fn: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            if sql:
                body = sql.strip()
                self.oracles[name] = body if not views else VIEWS + (" " if body.upper().startswith("SELECT") else ",\n") + body
            return fn

        return keep
