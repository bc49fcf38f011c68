"""Places for models of the user's own: encoders, scorers, judges and extractors over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.functions.text import sentences
from stratamem.operators.retrieval import BM25, bm25, top_k
from stratamem.plans.fixtures import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A column function from text to a unit vector; the model is loaded once for each worker's stream of batches."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out = np.asarray(model(texts.fillna("").tolist()), np.float32)
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(out))

    return encode


def hashing_encoder(dim: int = 32) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a model: words counted by hash."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for w in text.lower().split():
                out[i, zlib.crc32(w.encode()) % dim] += 1
        return out

    return encode


@R.add("udf01_encoder")
def _(t: Tables) -> DataFrame:
    encode = encoder(hashing_encoder)
    return t.raw("benchmark").select("item_id", F.transform(encode("text"), lambda x: F.round(x.cast("double"), 5)).cast("string").alias("vector"))


def scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]):
    """A column function (query, text) to a score; the model is loaded once for each worker's stream of batches."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            yield pd.Series(model(queries.fillna("").tolist(), texts.fillna("").tolist()), dtype="float64")

    return score


def judge(load: Callable[[], Callable[[list[str], list[str]], list[str]]], verdicts: tuple[str, ...], otherwise: str):
    """A column function (earlier, later) to one of the verdicts: the first that the model's answer names, else `otherwise`."""
    import re

    known = re.compile(r"\b(" + "|".join(verdicts) + r")\b", re.IGNORECASE)

    @F.pandas_udf("string")
    def verdict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for earlier, later in batches:
            answers = model(earlier.fillna("").tolist(), later.fillna("").tolist())
            found = [known.search(x or "") for x in answers]
            by_name = {v.lower(): v for v in verdicts}
            yield pd.Series([by_name[m[1].lower()] if m else otherwise for m in found], dtype="object")

    return verdict


def word_share() -> Callable[[list[str], list[str]], list[float]]:
    """A stand-in for a cross-encoder: the share of the query's distinct words that the text holds."""
    import re

    words = lambda x: set(re.findall(r"[a-z0-9]+", x.lower()))
    return lambda queries, texts: [len(words(q) & words(d)) / max(1, len(words(q))) for q, d in zip(queries, texts, strict=True)]


def rule_judge() -> Callable[[list[str], list[str]], list[str]]:
    """A stand-in for a model that compares two facts, each `predicate|value|operation`; it does not answer in one form."""

    def one(earlier: str, later: str) -> str:
        (p, v, _), (q, w, op) = earlier.split("|"), later.split("|")
        if p != q:
            return "These are UNRELATED."
        if op == "removes":
            return "verdict: terminate"
        if v == w:
            return "I cannot tell."
        return "Replace" if op == "replaces" else "they coexist"

    return lambda earlier, later: [one(a, b) for a, b in zip(earlier, later, strict=True)]


def duplicate_rule() -> Callable[[list[str], list[str]], list[str]]:
    """A stand-in for a duplicate check of two facts, each `predicate|value|operation`."""

    def one(earlier: str, later: str) -> str:
        (p, v, _), (q, w, _) = earlier.split("|"), later.split("|")
        return "DISTINCT" if p != q else "DUPLICATE" if v == w else "UPDATE"

    return lambda earlier, later: [one(a, b) for a, b in zip(earlier, later, strict=True)]


@R.add("udf02_pair_score", BM25 + " SELECT r.query_id, r.doc_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')))) / len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+'))), 9) AS score FROM ranked r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 20")
def _(t: Tables) -> DataFrame:
    """The 20 best documents of each benchmark text, scored in pairs by a model of the user's own."""
    queries = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    first = top_k(bm25(t.raw("documents").select("doc_id", "text"), queries.withColumnRenamed("q", "text")), ["query_id"], 20, F.desc("score"), F.col("doc_id"))
    pairs = first.select("query_id", "doc_id").join(queries, "query_id").join(t.raw("documents").select("doc_id", "text"), "doc_id")
    return pairs.select("query_id", "doc_id", F.round(scorer(word_share)("q", "text"), 9).alias("score"))


def _fact() -> Column:
    return F.concat_ws("|", "predicate", "object", "update_op")


@R.add("udf03_pair_judge", "p AS (SELECT id, predicate, object, lead(id) OVER w AS later, lead(predicate) OVER w AS p, lead(object) OVER w AS o, lead(update_op) OVER w AS op FROM memories WINDOW w AS (PARTITION BY user_id ORDER BY occurred_at, id)) SELECT id AS earlier, later, CASE WHEN predicate <> p THEN 'unrelated' WHEN op = 'removes' THEN 'terminate' WHEN object = o THEN 'uncertain' WHEN op = 'replaces' THEN 'replace' ELSE 'coexist' END AS verdict FROM p WHERE later IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """Each fact of a user with the next one, before a judge of the user's own; an answer that names no verdict is `uncertain`."""
    by = W.partitionBy("user_id").orderBy("occurred_at", "id")
    pairs = t.memories.select(F.col("id").alias("earlier"), _fact().alias("a"), F.lead("id").over(by).alias("later"), F.lead(_fact()).over(by).alias("b")).where("later is not null")
    verdict = judge(rule_judge, ("replace", "terminate", "coexist", "unrelated"), "uncertain")
    return pairs.select("earlier", "later", verdict("a", "b").alias("verdict"))


@R.add("udf04_duplicate_judge", "n AS (SELECT id, predicate, object, p.pos, lag(predicate, p.pos) OVER w AS p, lag(object, p.pos) OVER w AS o FROM memories, (VALUES (1), (2), (3)) p(pos) WINDOW w AS (PARTITION BY user_id, p.pos ORDER BY occurred_at, id)), v AS (SELECT id, pos, CASE WHEN p IS NULL OR p <> predicate THEN 'DISTINCT' WHEN o = object THEN 'DUPLICATE' ELSE 'UPDATE' END AS verdict FROM n) SELECT id, coalesce(min_by(verdict, pos) FILTER (verdict <> 'DISTINCT'), 'DISTINCT') AS verdict FROM v GROUP BY id")
def _(t: Tables) -> DataFrame:
    """Each fact against the three of its user before it; the first neighbour that is no DISTINCT decides."""
    by = W.partitionBy("user_id").orderBy("occurred_at", "id")
    before = F.array(*[F.struct(F.lit(k).alias("pos"), F.lag("f", k).over(by).alias("other")) for k in (1, 2, 3)])
    facts = t.memories.select("id", "user_id", "occurred_at", _fact().alias("f"))
    n = facts.withColumn("x", before).select("id", "f", F.explode("x").alias("x")).select("id", "f", "x.*")
    verdict = judge(duplicate_rule, ("DUPLICATE", "UPDATE", "DISTINCT"), "DISTINCT")
    v = n.where("other is not null").select("id", "pos", verdict("other", "f").alias("v"))
    decided = v.where("v <> 'DISTINCT'").groupBy("id").agg(F.min_by("v", "pos").alias("v"))
    return t.memories.select("id").join(decided, "id", "left").select("id", F.coalesce("v", F.lit("DISTINCT")).alias("verdict"))


def group_fold(rows: DataFrame, by: list[str], order: list[str], zero: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> DataFrame:
    """by, value: a fold of the user's own over each group's rows in order, with a struct for state, as one SQL expression.

    step takes the state and a row (a struct of `order` and the other columns); the state should stay small.
    """
    item = F.struct(*order, *[c for c in rows.columns if c not in (*by, *order)])
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    return lists.select(*by, F.aggregate("xs", zero, step, finish).alias("value"))


@R.add("udf06_longest_streak", "r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events), s AS (SELECT user_id, event_type, count(*) AS n FROM r GROUP BY user_id, event_type, island) SELECT user_id, max(n) AS value FROM s GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    """The longest run of one kind of event of each user."""
    e = t.raw("events").select("user_id", "ts", "event_id", "event_type")
    zero = F.struct(F.lit("").alias("kind"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["kind"] == x["event_type"], s["run"] + 1).otherwise(1).cast("long")
        return F.struct(x["event_type"].alias("kind"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return group_fold(e, ["user_id"], ["ts", "event_id"], zero, step, lambda s: s["best"])


@R.add("udf05_rule_extractor", "SELECT line_id, s AS fact FROM (SELECT line_id, unnest(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)')) AS s FROM lines WHERE role = 'user') WHERE regexp_matches(s, 'I (moved|bought|visited|switched|replaced|ran)')")
def _(t: Tables) -> DataFrame:
    s = t.lines.where("role = 'user'").select("line_id", F.explode(sentences("text")).alias("fact"))
    return s.where(F.col("fact").rlike("I (moved|bought|visited|switched|replaced|ran)"))


_loaded: dict = {}


def session_extractor(name: str, load: Callable[[], Callable[[list[dict]], Iterator[dict]]], columns: str):
    """A table function from the ordered turns of one session to facts, for a model of the user's own.

    load() gives a function from a session's turns (dicts, in order) to facts (dicts with `columns`); it is called
    once a worker process and name. Use it over a table parted by session: facts_by(df, extractor, by, order).
    Spark brings each session's turns together and in order; a task holds one session at a time.
    """
    from pyspark.sql.functions import udtf

    names = [c.split()[0] for c in columns.split(", ")]

    class Extract:
        def __init__(self):
            if name not in _loaded:
                _loaded[name] = load()
            self.turns: list[dict] = []

        def eval(self, row):
            self.turns.append(row.asDict())

        def terminate(self):
            for fact in _loaded[name](self.turns):
                yield tuple(fact[k] for k in names)

    return udtf(Extract, returnType=columns)


def facts_by(turns: DataFrame, extract, by: list[str], order: list[str]) -> DataFrame:
    """What a session_extractor finds in turns, parted by `by` and ordered by `order`."""
    return extract(turns.asTable().partitionBy(*by).orderBy(*order))


def answers() -> Callable[[list[dict]], Iterator[dict]]:
    """A stand-in for a model that needs a session's order: the first sentence of each answer, with the length in words of what it answers."""
    import re

    def extract(turns: list[dict]) -> Iterator[dict]:
        for asked, said in zip(turns, turns[1:], strict=False):
            if asked["role"] == "user" and said["role"] == "assistant":
                first = re.search(r"[^.!?]+(?:[.!?]+|$)", said["content"] or "")
                yield {"session_id": said["session_id"], "turn_index": said["turn_index"], "asked_words": len((asked["content"] or "").split(" ")), "fact": first[0] if first else None}

    return extract


@R.add("udf05_session_extractor", "x AS (SELECT *, lag(role) OVER w AS before, lag(content) OVER w AS asked FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn_index)) SELECT session_id, turn_index, CAST(len(string_split(coalesce(asked, ''), ' ')) AS BIGINT) AS asked_words, nullif(regexp_extract(content, '[^.!?]+(?:[.!?]+|$)'), '') AS fact FROM x WHERE role = 'assistant' AND before = 'user'")
def _(t: Tables) -> DataFrame:
    extract = session_extractor("answers", answers, "session_id long, turn_index long, asked_words long, fact string")
    return facts_by(t.turns.select("session_id", "turn_index", "role", "content"), extract, ["session_id"], ["turn_index"])
