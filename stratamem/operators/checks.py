"""Projections of the timeline fold, citation and number checks, value packing, and small tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.functions.text import NUMBER_WORDS, all_of
from stratamem.operators.context import TURNS_BM25, turns_given
from stratamem.operators.evaluation import binomial_tail
from stratamem.operators.facts import SOURCED, sourced
from stratamem.operators.retrieval import containing, top_k
from stratamem.operators.timeline import FOLD, FOLDED, day_time, facts_of, resolved
from stratamem.plans.fixtures import Registry, Tables
from stratamem.sources.tables import scratch

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("src09_predicate_map", "SELECT id, arity FROM memories JOIN (VALUES ('view', 'many'), ('click', 'many'), ('signup', 'one')) m(p, arity) ON p = predicate")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "map")
    t.spark.createDataFrame([("view", "many"), ("click", "many"), ("signup", "one")], "predicate string, arity string").write.option("header", True).csv(path)
    table = t.spark.read.option("header", True).schema("predicate string, arity string").csv(path)
    return t.memories.join(table, "predicate").select("id", "arity")


@R.add("src16_metric_report", "SELECT question_type, count(*) AS n, count(*) FILTER (a) AS correct FROM results GROUP BY question_type")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "report")
    t.results.groupBy("question_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("a").alias("correct")).write.json(path)
    return t.spark.read.schema("question_type string, n long, correct long").json(path)


@R.add("set04_coverage_fraction", "SELECT session_id, round(count(*) FILTER (role = 'user' AND turn_index < 3) / nullif(count(*) FILTER (role = 'user'), 0), 9) AS share FROM turns GROUP BY session_id")
def _(t: Tables) -> DataFrame:
    mine = F.col("role") == "user"
    g = t.turns.groupBy("session_id").agg(F.count_if(mine & (F.col("turn_index") < 3)).alias("got"), F.count_if(mine).alias("gold"))
    return g.select("session_id", F.round(F.try_divide("got", "gold"), 9).alias("share"))


@R.add("ret11_source_level", TURNS_BM25 + f""", m AS ({SOURCED}), found AS (SELECT DISTINCT r.query_id, m.source_session AS session_id FROM (SELECT query_id, turn_id FROM turn_rank WHERE rank BETWEEN 2 AND 6) r JOIN m ON m.source_session * 1000 + m.source_turn = r.turn_id),
asked AS (SELECT item_id AS query_id FROM benchmark) SELECT asked.query_id, CASE WHEN b.turn_id IS NULL THEN 'none' WHEN f.session_id IS NOT NULL THEN 'local' ELSE 'archive' END AS level FROM asked LEFT JOIN (SELECT query_id, turn_id FROM turn_rank WHERE rank = 1) b USING (query_id) LEFT JOIN found f ON f.query_id = asked.query_id AND f.session_id = b.turn_id // 1000""")
def _(t: Tables) -> DataFrame:
    """Where a query's source is sought: in the sessions of the facts retrieved for it if its best turn lies there, else in the whole archive, else nowhere.

    Facts retrieved are those that come from the query's next best turns.
    """
    ranked = turns_given(t)
    facts = sourced(t).select((F.col("source_session") * 1000 + F.col("source_turn")).alias("turn_id"), F.col("source_session").alias("session_id"))
    found = ranked.where("rank BETWEEN 2 AND 6").join(facts, "turn_id").select("query_id", "session_id", F.lit("local").alias("found")).distinct()
    best = ranked.where("rank = 1").select("query_id", F.floor(F.col("turn_id") / 1000).alias("session_id"))
    both = t.raw("benchmark").select(F.col("item_id").alias("query_id")).join(best.join(found, ["query_id", "session_id"], "left"), "query_id", "left")
    return both.select("query_id", F.when(F.col("session_id").isNull(), "none").otherwise(F.coalesce("found", F.lit("archive"))).alias("level"))


def density_pack(items: DataFrame, by: list[str], budget: int, overlap: float = 0.6, discount: float = 0.7) -> DataFrame:
    """by, id, place of a greedy pack by value a token; a value drops where most words were chosen already.

    Quadratic in a group, whose size the caller bounds (a candidate list); one Arrow group a task.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        left, used, out, chosen = pdf.sort_values("id").to_dict("records"), 0, [], []
        words = {r["id"]: set(r["words"]) for r in left}
        while True:
            best = None
            for r in left:
                if used + r["cost"] > budget or r["value"] <= 0:
                    continue
                like = max((len(words[r["id"]] & words[c]) / max(1, len(words[r["id"]])) for c in chosen), default=0.0)
                d = r["value"] * (1 - discount if like >= overlap else 1.0) / r["cost"]
                if best is None or d > best[0]:
                    best = (d, r)
            if best is None:
                break
            chosen.append(best[1]["id"])
            used += best[1]["cost"]
            out.append({**{k: best[1][k] for k in by}, "id": best[1]["id"], "place": len(out)})
            left = [r for r in left if r["id"] != best[1]["id"]]
        return pd.DataFrame(out, columns=[*by, "id", "place"])

    schema = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in by) + ", id long, place long"
    return items.groupBy(*by).applyInPandas(pack, schema)


@R.add("pack04_density_pack")
def _(t: Tables) -> DataFrame:
    top = top_k(t.memories.where("status = 'active'"), ["user_id"], 50, F.desc("importance"), F.col("id"))
    return density_pack(top.select("user_id", "id", F.col("importance").alias("value"), F.col("token_count").alias("cost"), F.split("content", " ").alias("words")), ["user_id"], 300)


@R.add("tmp05_closed_by_target", FOLDED + " SELECT id, r.by, strftime(until, '%Y-%m-%d %H:%M:%S') AS until FROM resolved r WHERE status = 'superseded' AND until IS NOT NULL AND r.by IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """Superseded facts that have an end, with the fact that stands behind it."""
    return resolved(facts_of(t)).where("status = 'superseded' and until is not null and by is not null").select("id", "by", day_time("until").alias("until"))


@R.add("tmp06_restatements", FOLDED + " SELECT r.id, r.by FROM resolved r JOIN resolved o ON o.id = r.by WHERE r.status = 'superseded' AND r.until IS NOT DISTINCT FROM o.until")
def _(t: Tables) -> DataFrame:
    r = resolved(facts_of(t))
    owner = r.select(F.col("id").alias("by"), F.col("until").alias("owner_until"))
    return r.where("status = 'superseded'").join(owner, "by").where(F.col("until").eqNullSafe(F.col("owner_until"))).select("id", "by")


@R.add("tmp07_historical_removals", FOLDED + " SELECT id, strftime(until, '%Y-%m-%d %H:%M:%S') AS until FROM resolved WHERE status = 'historical'")
def _(t: Tables) -> DataFrame:
    return resolved(facts_of(t)).where("status = 'historical'").select("id", day_time("until").alias("until"))


@R.add("tmp08_revalidation", "b AS (SELECT * FROM (WITH " + FOLD.format(op="update_op", where=" WHERE id % 10 <> 3") + " SELECT * FROM resolved)), a AS (SELECT * FROM (WITH " + FOLDED + " SELECT * FROM resolved)) SELECT CASE WHEN b.id IS NULL THEN 'late' WHEN b.status <> 'active' AND a.status = 'active' THEN 'promoted' WHEN a.status = 'superseded' THEN 'superseded' ELSE 're-ended' END AS action, count(*) AS n FROM a LEFT JOIN b ON b.id = a.id WHERE b.id IS NULL OR (a.status, a.until, a.by) IS DISTINCT FROM (b.status, b.until, b.by) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """How the state of each fact changes when facts that came late are folded in."""
    facts = facts_of(t)
    before, after = resolved(facts.where("id % 10 <> 3")), resolved(facts)
    b, a = before.select("id", F.struct("status", "until", "by").alias("b")), after.select("id", F.struct("status", "until", "by").alias("a"))
    both = b.join(a, "id", "right").where(~F.col("b").eqNullSafe(F.col("a")))
    action = F.when(F.col("b").isNull(), "late").when((F.col("b.status") != "active") & (F.col("a.status") == "active"), "promoted").when(F.col("a.status") == "superseded", "superseded").otherwise("re-ended")
    return both.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@R.add("tmp12_update_suppression", "w AS (SELECT line_id, session_id, said_on, text, list_distinct(regexp_extract_all(lower(text), '[a-z]{2,}')) AS ws FROM lines WHERE role = 'user' AND text NOT LIKE '%?') SELECT DISTINCT o.line_id FROM w o JOIN w n ON n.session_id = o.session_id AND (n.said_on, n.line_id) > (o.said_on, o.line_id) WHERE regexp_matches(n.text, 'replaced|switched') AND len(list_intersect(o.ws, n.ws)) >= 3")
def _(t: Tables) -> DataFrame:
    """Older statements of a session that share three words with a newer explicit replacement."""
    words = F.array_distinct(all_of(F.lower("text"), "[a-z]{2,}"))
    w = t.lines.where((F.col("role") == "user") & ~F.col("text").endswith("?")).select("line_id", "session_id", F.struct("said_on", "line_id").alias("at"), words.alias("ws"), F.col("text").rlike("replaced|switched").alias("new"))
    n = w.where("new").select("session_id", F.col("at").alias("later"), F.col("ws").alias("said"))
    return w.join(n, "session_id").where((F.col("later") > F.col("at")) & (F.size(F.array_intersect("ws", "said")) >= 3)).select("line_id").distinct()


_DIGITS = "MAP {" + ", ".join(f"'{w}': '{n}'" for w, n in NUMBER_WORDS.items()) + "}"


@R.add("scl08_numeric_text", f"b AS (SELECT line_id, regexp_replace(regexp_replace(lower(text), '([0-9]),([0-9])', '\\1\\2', 'g'), '[.!?;,]+( |$)', '\\1', 'g') AS t FROM lines) SELECT line_id, array_to_string(list_transform(string_split(t, ' '), lambda w: coalesce({_DIGITS}[w], w)), ' ') AS text FROM b")
def _(t: Tables) -> DataFrame:
    """Number words as digits, thousands commas and end marks dropped."""
    table = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    bare = F.regexp_replace(F.regexp_replace(F.lower("text"), r"(?<=[0-9]),(?=[0-9])", ""), r"[.!?;,]+(?=\s|$)", "")
    return t.lines.select("line_id", F.array_join(F.transform(F.split(bare, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ").alias("text"))


@R.add("scl31_citation_labels", "t AS (SELECT line_id, 'see [M 0' || (line_id % 9) || '], [M' || (session_id % 12) || '] and [M ' || (line_id % 5) || ']' AS t FROM lines), c AS (SELECT line_id, list_transform(regexp_extract_all(t, 'M ?[0-9]+'), lambda x: 'M' || CAST(regexp_extract(x, '([0-9]+)$', 1) AS BIGINT)) AS c FROM t) SELECT line_id, len(list_filter(list_distinct(c), lambda x: x IN ('M1', 'M2', 'M3', 'M4', 'M5'))) AS known, len(list_filter(list_distinct(c), lambda x: x NOT IN ('M1', 'M2', 'M3', 'M4', 'M5'))) AS unknown, len(c) - len(list_distinct(c)) AS repeated, 5 - len(list_filter(list_distinct(c), lambda x: x IN ('M1', 'M2', 'M3', 'M4', 'M5'))) AS uncited FROM c")
def _(t: Tables) -> DataFrame:
    """Labels in an answer, `M 03` being `M3`: known, unknown, repeated, and known ones that are not cited."""
    text = F.expr("concat('see [M 0', line_id % 9, '], [M', session_id % 12, '] and [M ', line_id % 5, ']')")
    cited = F.transform(all_of("t", r"M ?[0-9]+"), lambda x: F.concat(F.lit("M"), F.regexp_extract(x, "([0-9]+)$", 1).cast("long").cast("string")))
    known = F.array(*[F.lit(f"M{k}") for k in range(1, 6)])
    r = t.lines.select("line_id", text.alias("t")).select("line_id", cited.alias("c"))
    n = lambda c: F.size(c).cast("long")
    inside = n(F.array_intersect("c", known))
    return r.select("line_id", inside.alias("known"), n(F.array_except("c", known)).alias("unknown"), (n("c") - n(F.array_distinct("c"))).alias("repeated"), (5 - inside).alias("uncited"))


@R.add("scl32_stated_months", "SELECT line_id, regexp_extract(text, '([0-9]{4}-[0-9]{2})-[0-9]{2}', 1) AS stated, regexp_extract(text, '([0-9]{4}-[0-9]{2})-[0-9]{2}', 1) <> said_on[1:7] AS conflict FROM lines WHERE regexp_matches(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')")
def _(t: Tables) -> DataFrame:
    month = F.regexp_extract("text", "([0-9]{4}-[0-9]{2})-[0-9]{2}", 1)
    return t.lines.where(month != "").select("line_id", month.alias("stated"), (month != F.substring("said_on", 1, 7)).alias("conflict"))


@R.add("dq03_answer_coverage", "w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ws FROM benchmark), e AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w FROM w), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM documents), h AS (SELECT item_id, doc_id, count(*) / max(n) AS share FROM e JOIN d ON d.w = e.w GROUP BY ALL), l AS (SELECT item_id, count(*) AS literal FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1) SELECT w.item_id, coalesce(literal, 0) AS literal, count(*) FILTER (share >= 0.8) AS by_words, round(max(share), 9) AS best FROM w LEFT JOIN h ON h.item_id = w.item_id LEFT JOIN l ON l.item_id = w.item_id GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """How many documents hold a benchmark text as it stands, and how many hold four fifths of its words."""
    found = lambda c: F.array_distinct(all_of(F.lower(c), "[a-z0-9]+"))
    w = t.raw("benchmark").select("item_id", found("text").alias("ws"))
    e = w.select("item_id", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    d = t.raw("documents").select("doc_id", F.explode(found("text")).alias("w")).join(e.select("w").distinct(), "w", "left_semi")
    h = e.join(d, "w").groupBy("item_id", "doc_id").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    by = h.groupBy("item_id").agg(F.count_if(F.col("share") >= 0.8).alias("by_words"), F.round(F.max("share"), 9).alias("best"))
    literal = containing(t).groupBy(F.col("query_id").alias("item_id")).agg(F.count(F.lit(1)).alias("literal"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return w.join(by, "item_id", "left").join(literal, "item_id", "left").select("item_id", zero("literal"), zero("by_words"), "best")


@R.add("dq08_position_pilot", "p AS (SELECT session_id, bool_or(role = 'user' AND turn_index < 2) AS front, bool_or(role = 'user' AND turn_index >= 4) AS back FROM turns GROUP BY 1), c AS (SELECT count(*) FILTER (front AND NOT back) AS w, count(*) FILTER (back AND NOT front) AS l FROM p), k AS (SELECT w, l, unnest(generate_series(0, least(w, l))) AS k FROM c) SELECT w AS wins, l AS losses, round(least(1.0, 2 * sum(exp(lgamma(w + l + 1) - lgamma(k + 1) - lgamma(w + l - k + 1) + (w + l) * ln(0.5)))), 6) AS p FROM k GROUP BY w, l")
def _(t: Tables) -> DataFrame:
    mine = F.col("role") == "user"
    p = t.turns.groupBy("session_id").agg(F.bool_or(mine & (F.col("turn_index") < 2)).alias("f"), F.bool_or(mine & (F.col("turn_index") >= 4)).alias("b"))
    c = p.agg(F.count_if(F.col("f") & ~F.col("b")).alias("wins"), F.count_if(F.col("b") & ~F.col("f")).alias("losses"))
    return c.select("wins", "losses", F.round(binomial_tail(F.col("wins"), F.col("losses")), 6).alias("p"))


@R.add("eval19_budget_policies", """c AS (SELECT session_id, role, turn_index, greatest(1, CAST(floor(length(content) / 4.6) AS BIGINT)) AS cost FROM turns),
r AS (SELECT session_id, role, p.policy, cost, sum(cost) OVER (PARTITION BY session_id, p.policy ORDER BY CASE p.policy WHEN 'oldest' THEN turn_index WHEN 'newest' THEN -turn_index ELSE cost END, turn_index) AS used FROM c, (VALUES ('oldest'), ('newest'), ('cheapest')) p(policy)),
g AS (SELECT session_id, policy, bool_and(role <> 'user' OR used <= 300) AS whole, sum(CASE WHEN used <= 300 THEN cost ELSE 0 END) AS shown FROM r GROUP BY ALL),
p AS (SELECT policy, round(avg(whole::INT), 9) AS coverage, median(shown) AS context FROM g GROUP BY policy)
SELECT policy, coverage, context, policy = (SELECT max_by(policy, (coverage, -context, policy)) FROM p) AS chosen FROM p""")
def _(t: Tables) -> DataFrame:
    """Orders in which a session's turns may fill 300 tokens: how often all user turns get in, the median filled, and the best."""
    cost = F.greatest(F.lit(1), F.floor(F.length("content") / 4.6)).cast("long")
    order = F.map_from_arrays(F.array(F.lit("oldest"), F.lit("newest"), F.lit("cheapest")), F.array(F.col("turn_index").cast("long"), -F.col("turn_index").cast("long"), cost))
    c = t.turns.select("session_id", "role", "turn_index", cost.alias("cost"), F.explode(order).alias("policy", "place"))
    used = F.sum("cost").over(W.partitionBy("session_id", "policy").orderBy("place", "turn_index"))
    g = c.withColumn("used", used).groupBy("session_id", "policy").agg(F.bool_and((F.col("role") != "user") | (F.col("used") <= 300)).alias("whole"), F.sum(F.when(F.col("used") <= 300, F.col("cost")).otherwise(0)).alias("shown"))
    p = g.groupBy("policy").agg(F.round(F.avg(F.col("whole").cast("int")), 9).alias("coverage"), F.median("shown").alias("context"))
    best = p.agg(F.max_by("policy", F.struct("coverage", -F.col("context"), "policy")).alias("best"))
    return p.crossJoin(F.broadcast(best)).select("policy", "coverage", "context", (F.col("policy") == F.col("best")).alias("chosen"))  # one row
