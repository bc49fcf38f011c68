"""Evidence and context: local turns, hydration, event timelines, probes, and the tables around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.functions.text import MONTHS, RELATIVE_SQL, all_of, relative_date, sentences
from stratamem.operators.facts import SOURCED, sourced
from stratamem.operators.retrieval import BM25, against, nearest, similar_pairs, top_k, unit
from stratamem.operators.timeline import filled
from stratamem.plans.fixtures import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("join08_superseded_rejects", "SELECT DISTINCT w.id AS hit, l.id AS rejected FROM memories w JOIN memories l ON l.superseded_by = w.id WHERE w.id % 3 = 0")
def _(t: Tables) -> DataFrame:
    hits = t.memories.where("id % 3 = 0").select(F.col("id").alias("hit"))
    return t.memories.where("superseded_by is not null").select(F.col("superseded_by").alias("hit"), F.col("id").alias("rejected")).join(hits, "hit").distinct()


@R.add("join13_dedup_neighbours", "c AS (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS s FROM vectors x JOIN vectors y ON x.tenant = y.tenant AND y.id < x.id), u AS (SELECT a, b, s FROM c WHERE s >= 0.25 UNION ALL SELECT id, id - 10, 1.0 FROM vectors WHERE id % 40 = 10), m AS (SELECT a, b, max(s) AS s FROM u GROUP BY ALL) SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rn FROM m) WHERE rn <= 3")
def _(t: Tables) -> DataFrame:
    close = similar_pairs(t.vectors.select("id", "tenant", unit("embedding").alias("v")), 0.25).select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("cosine").alias("s"))
    same_key = t.vectors.where("id % 40 = 10").select(F.col("id").alias("a"), (F.col("id") - 10).alias("b"), F.lit(1.0).alias("s"))
    best = close.union(same_key).groupBy("a", "b").agg(F.max("s").alias("s"))
    return top_k(best, ["a"], 3, F.desc("s"), F.col("b")).select("a", "b", "s")


@R.add("agg06_audit_by_type", f"m AS ({SOURCED}), g AS (SELECT t.session_id, t.role, bool_or(m.id IS NOT NULL) AS has FROM turns t LEFT JOIN m ON m.source_session = t.session_id AND m.source_turn = t.turn_index GROUP BY ALL) SELECT role, count(*) AS questions, count(*) FILTER (has) AS with_fact FROM g GROUP BY role")
def _(t: Tables) -> DataFrame:
    m = sourced(t).selectExpr("source_session session_id", "source_turn turn_index", "true hit").distinct()
    g = t.turns.join(m, ["session_id", "turn_index"], "left").groupBy("session_id", "role").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("has"))
    return g.groupBy("role").agg(F.count(F.lit(1)).alias("questions"), F.count_if("has").alias("with_fact"))


@R.add("agg23_gold_entities", "SELECT user_id, predicate, count(DISTINCT e) AS n FROM (SELECT user_id, predicate, lower(trim(unnest(entities))) AS e FROM memories) GROUP BY ALL HAVING count(DISTINCT e) BETWEEN 3 AND 15")
def _(t: Tables) -> DataFrame:
    e = t.memories.select("user_id", "predicate", F.explode("entities").alias("e"))
    return e.groupBy("user_id", "predicate").agg(F.count_distinct(F.lower(F.trim("e"))).alias("n")).where("n between 3 and 15")


@R.add("win09_next_numbered_item", "SELECT a.line_id, min(b.line_id) AS next_list FROM lines a JOIN lines b ON a.session_id = b.session_id AND b.turn_index > a.turn_index AND b.role = 'assistant' AND b.text LIKE '1.%' WHERE a.role = 'user' GROUP BY a.line_id HAVING count(*) = 1")
def _(t: Tables) -> DataFrame:
    later = W.partitionBy("session_id").orderBy("turn_index").rowsBetween(1, W.unboundedFollowing)
    item = F.when((F.col("role") == "assistant") & F.col("text").startswith("1."), F.col("line_id"))
    n = t.lines.withColumns({"next_list": F.min(item).over(later), "n": F.count(item).over(later)})
    return n.where("role = 'user' and n = 1").select("line_id", "next_list")


@R.add("topk05_within_sessions", "SELECT session_id, turn_index, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY len(regexp_extract_all(lower(content), '\\b(the|und|de)\\b')) DESC, session_id, turn_index) AS rank FROM turns WHERE session_id % 3 = 0) WHERE rank <= 5")
def _(t: Tables) -> DataFrame:
    hits = t.turns.where("session_id % 3 = 0").withColumn("h", F.size(all_of(F.lower("content"), r"\b(?:the|und|de)\b")))
    return top_k(hits, ["user_id"], 5, F.desc("h"), F.col("session_id"), F.col("turn_index")).select("session_id", "turn_index", "rank")


#: Turns by BM25 for each benchmark text, 50 at most.
TURNS_BM25 = """tok AS (SELECT session_id * 1000 + turn_index AS turn_id, regexp_extract_all(lower(content), '[a-z0-9]+') AS ts FROM turns),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM tok), tf AS (SELECT turn_id, len, term, count(*) AS tf FROM (SELECT turn_id, len(ts) AS len, unnest(ts) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
bm AS (SELECT query_id, turn_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term, st GROUP BY ALL),
turn_rank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, turn_id) AS rank FROM bm) WHERE rank <= 50)"""


def turns_given(t: Tables) -> DataFrame:
    """query_id, turn_id, rank: the 50 best turns of the archive for each benchmark text."""
    from stratamem.operators.retrieval import bm25

    archive = t.turns.select((F.col("session_id") * 1000 + F.col("turn_index")).alias("turn_id"), F.col("content").alias("text"))
    queries = t.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return top_k(bm25(archive, queries, "turn_id"), ["query_id"], 50, F.desc("score"), F.col("turn_id")).select("query_id", "turn_id", "rank")


@R.add("topk13_local_turns", TURNS_BM25 + """, best AS (SELECT query_id, turn_id // 1000 AS session_id FROM turn_rank WHERE rank = 1),
l AS (SELECT b.query_id, t.session_id, t.turn_index, coalesce(r.rank, 1000000) AS place FROM best b JOIN turns t ON t.session_id = b.session_id LEFT JOIN turn_rank r ON r.query_id = b.query_id AND r.turn_id = t.session_id * 1000 + t.turn_index)
SELECT query_id, session_id, turn_index FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, turn_index) AS rn FROM l) WHERE rn <= 3""")
def _(t: Tables) -> DataFrame:
    """Turns of the session that holds a query's best turn, by their rank in the archive, the unranked last."""
    ranked = turns_given(t)
    best = ranked.where("rank = 1").select("query_id", F.floor(F.col("turn_id") / 1000).alias("session_id"))
    local = t.turns.select("session_id", "turn_index", (F.col("session_id") * 1000 + F.col("turn_index")).alias("turn_id")).join(best, "session_id")
    both = local.join(ranked, ["query_id", "turn_id"], "left").withColumn("place", F.coalesce("rank", F.lit(1_000_000).cast("long"))).drop("rank")
    return top_k(both, ["query_id"], 3, F.col("place"), F.col("turn_index")).select("query_id", "session_id", "turn_index")


@R.add("topk18_candidate_choice", "SELECT question_type, min_by(question_id, (CASE WHEN b THEN 0 ELSE 1 END, coalesce(n_chars, 1000000000), question_id)) AS chosen FROM results JOIN documents ON doc_id = question_id WHERE a GROUP BY question_type")
def _(t: Tables) -> DataFrame:
    """Of the candidates that pass the gate the one that is right in the other arm too, then the cheapest, an unknown cost last, then the first."""
    cost = t.raw("documents").select(F.col("doc_id").alias("question_id"), F.coalesce("n_chars", F.lit(1_000_000_000)).alias("cost"))
    key = F.struct(F.when(F.col("b"), 0).otherwise(1), "cost", F.col("question_id"))
    return t.results.where("a").join(cost, "question_id").groupBy("question_type").agg(F.min_by("question_id", key).alias("chosen"))


@R.add("ret02_postings", "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tok GROUP BY term HAVING count(DISTINCT doc_id) >= 3")
def _(t: Tables) -> DataFrame:
    from stratamem.operators.retrieval import postings

    p = postings(t.raw("documents"), ["doc_id"])
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df")).where("df >= 3")


COS = "cos AS (SELECT x.id AS query_id, y.id AS id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine FROM vectors x, vectors y WHERE x.id % 100 = 0)"


def _near(t: Tables, k: int) -> DataFrame:
    v = t.vectors.select("id", unit("embedding").alias("v"))
    return nearest(v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), v, k)


@R.add("ret07_retrieval_trace", COS + " SELECT * FROM (SELECT query_id, id, id % 8 AS session_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM cos) WHERE rank <= 50")
def _(t: Tables) -> DataFrame:
    return _near(t, 50).select("query_id", "id", (F.col("id") % 8).alias("session_id"), "rank")


@R.add("ret10_nearest_label", COS + """, b AS (SELECT id, max_by(query_id, (cosine, -query_id)) AS label, max(cosine) AS s FROM cos GROUP BY id),
h AS (SELECT lower(regexp_extract(text, '[A-Za-z0-9]+')) AS head, min(item_id) AS item FROM benchmark GROUP BY 1)
SELECT b.id, CASE WHEN item IS NOT NULL THEN 'rule ' || item WHEN s >= 0.35 THEN b.label::VARCHAR ELSE 'other' END AS label FROM b LEFT JOIN documents d ON d.doc_id = b.id LEFT JOIN h ON h.head = lower(regexp_extract(d.text, '[A-Za-z0-9]+'))""")
def _(t: Tables) -> DataFrame:
    """A rule by the document's head word comes first, then the nearest labelled vector from 0.35 on, else `other`."""
    v = t.vectors.select("id", unit("embedding").alias("v"))
    best = nearest(v.select(F.col("id").alias("query_id"), F.col("v").alias("q")), v.where("id % 100 = 0"), 1)
    b = best.select(F.col("query_id").alias("id"), F.col("id").alias("label"), F.col("cosine").alias("s"))
    head = lambda: F.lower(F.regexp_extract("text", "([A-Za-z0-9]+)", 1)).alias("head")
    rules = t.raw("benchmark").select(head(), "item_id").groupBy("head").agg(F.min("item_id").alias("item"))
    texts = t.raw("documents").select(F.col("doc_id").alias("id"), head())
    found = b.join(texts, "id", "left").join(rules, "head", "left")
    label = F.when(F.col("item").isNotNull(), F.concat(F.lit("rule "), F.col("item").cast("string"))).when(F.col("s") >= 0.35, F.col("label").cast("string")).otherwise("other")
    return found.select("id", label.alias("label"))


@R.add("ret12_session_chunks", "SELECT session_id, sha256('[Session on ' || (DATE '2024-01-01' + session_id::INT) || ']' || chr(10) || string_agg(role || ': ' || content, chr(10) ORDER BY turn_index)) AS digest FROM turns GROUP BY session_id")
def _(t: Tables) -> DataFrame:
    line = F.struct("turn_index", F.concat_ws(": ", "role", "content").alias("x"))
    chunk = t.turns.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(line))["x"], "\n").alias("body")).join(t.sessions, "session_id")
    return chunk.select("session_id", F.sha2(F.concat(F.lit("[Session on "), F.col("started_on").cast("string"), F.lit("]\n"), F.col("body")), 256).alias("digest"))


@R.add("ret13_time_window", RELATIVE_SQL + " SELECT q.line_id, s.line_id AS found FROM relative r JOIN lines q ON q.line_id = r.line_id JOIN lines s ON s.session_id = q.session_id WHERE (r.exact IS NOT NULL OR r.estimate IS NOT NULL) AND CAST(s.said_on AS DATE) BETWEEN coalesce(r.exact - 1, r.estimate - 4) AND coalesce(r.exact + 1, r.estimate + 4)")
def _(t: Tables) -> DataFrame:
    """Lines of a customer said in the window of the customer's one relative date: a day around an exact one, four around an estimate."""
    d = relative_date("text", F.to_date("said_on"))
    q = t.lines.select("line_id", "session_id", d["exact"].alias("x"), d["estimate"].alias("e")).where("x is not null or e is not null")
    window = q.select("line_id", "session_id", F.coalesce(F.date_sub("x", 1), F.date_sub("e", 4)).alias("lo"), F.coalesce(F.date_add("x", 1), F.date_add("e", 4)).alias("hi"))
    said = t.lines.select("session_id", F.col("line_id").alias("found"), F.to_date("said_on").alias("day"))
    return window.join(said, "session_id").where("day between lo and hi").select("line_id", "found")


@R.add("ret15_probe_queries", "w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS w FROM benchmark), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) AS rn FROM w) SELECT item_id, string_agg(w, ' ' ORDER BY rn) AS query FROM r WHERE rn <= 8 GROUP BY item_id")
def _(t: Tables) -> DataFrame:
    w = F.array_distinct(all_of(F.lower("text"), "[a-z0-9]{3,}"))
    by = F.array_sort(F.transform(w, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w"))))
    return t.raw("benchmark").select("item_id", F.array_join(F.slice(by, 1, 8)["w"], " ").alias("query"))


@R.add("ret19_session_recall", BM25 + """, gold AS (SELECT DISTINCT item_id AS query_id, d.source FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
r AS (SELECT query_id, source, max(score) AS s FROM bm JOIN documents USING (doc_id) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, source) AS rank FROM r),
f AS (SELECT query_id, min(rank) AS first FROM gold LEFT JOIN k USING (query_id, source) GROUP BY 1)
SELECT m, round(avg((coalesce(first, 1000000) <= m)::INT), 9) AS recall FROM f, (VALUES (1), (2), (3), (5), (10)) x(m) GROUP BY m""")
def _(t: Tables) -> DataFrame:
    """Sources stand for sessions: ranked by their best document; gold is where a query's text stands."""
    from stratamem.operators.retrieval import bm25, containing, first_ranks

    queries = t.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")
    of = t.raw("documents").select("doc_id", "source")
    best = bm25(t.raw("documents").select("doc_id", "text"), queries).join(of, "doc_id").groupBy("query_id", "source").agg(F.max("score").alias("score"))
    first = first_ranks(containing(t).join(of, "doc_id").select("query_id", "source"), best, "source")
    m = first.select("first", F.explode(F.array(*[F.lit(x) for x in (1, 2, 3, 5, 10)])).alias("m"))
    return m.groupBy("m").agg(F.round(F.avg(F.coalesce(F.col("first") <= F.col("m"), F.lit(False)).cast("int")), 9).alias("recall"))


@R.add("ret21_pair_recall", COS + """, p AS (SELECT m.superseded_by AS query_id, m.id FROM memories m WHERE m.superseded_by % 100 = 0),
r AS (SELECT c.query_id, c.id, t.kind, row_number() OVER (PARTITION BY c.query_id, t.kind ORDER BY cosine DESC, c.id) AS rank FROM cos c JOIN vectors x ON x.id = c.query_id JOIN vectors y ON y.id = c.id, (VALUES ('all'), ('earlier'), ('tenant')) t(kind)
  WHERE c.id <> c.query_id AND (t.kind = 'all' OR (t.kind = 'earlier' AND c.id < c.query_id) OR (t.kind = 'tenant' AND x.tenant = y.tenant)))
SELECT t.kind, count(*) AS pairs, round(avg((coalesce(rank, 1000000) <= 50)::INT), 9) AS recall FROM (SELECT p.* FROM p JOIN vectors a ON a.id = p.query_id JOIN vectors b ON b.id = p.id) p CROSS JOIN (VALUES ('all'), ('earlier'), ('tenant')) t(kind) LEFT JOIN r ON r.query_id = p.query_id AND r.id = p.id AND r.kind = t.kind GROUP BY t.kind""")
def _(t: Tables) -> DataFrame:
    """How often the fact that a later one closed is among the later one's 50 nearest, under three candidate filters.

    The rank of a pair's earlier fact is one more than the candidates before it, so no list is sorted or kept.
    """
    from stratamem.operators.retrieval import dot

    v = t.vectors.select("id", "tenant", unit("embedding").alias("v"))
    pairs = t.memories.where("superseded_by % 100 = 0").select(F.col("superseded_by").alias("query_id"), F.col("id").alias("gold"))
    asked = pairs.join(v.select(F.col("id").alias("query_id"), F.col("tenant").alias("qt"), F.col("v").alias("q")), "query_id").join(v.select(F.col("id").alias("gold"), F.col("tenant").alias("gt"), F.col("v").alias("g")), "gold")
    asked = asked.select("query_id", "gold", "qt", "gt", "q", F.round(dot("q", "g"), 6).alias("mark"))
    s = against(v, asked).where("id <> query_id").withColumn("cosine", F.round(dot("q", "v"), 6))
    before = (F.col("cosine") > F.col("mark")) | ((F.col("cosine") == F.col("mark")) & (F.col("id") < F.col("gold")))
    kinds = {"all": F.lit(True), "earlier": F.col("id") < F.col("query_id"), "tenant": F.col("tenant") == F.col("qt")}
    n = s.groupBy("query_id", "gold", "gt", "qt").agg(*[F.count_if(before & ok).alias(k) for k, ok in kinds.items()])
    inside = {"all": F.lit(True), "earlier": F.col("gold") < F.col("query_id"), "tenant": F.col("gt") == F.col("qt")}
    each = n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (inside[k] & (F.col(k) < 50)).cast("int").alias("hit")) for k in kinds])).alias("x")).select("x.*")
    return each.groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("hit"), 9).alias("recall"))


@R.add("ret22_routing_confusion", "v AS (SELECT x.id, x.tenant AS truth, max_by(y.tenant, (round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6), -y.id)) AS predicted FROM vectors x, vectors y WHERE y.id < 10 AND x.id >= 10 GROUP BY ALL) SELECT truth, predicted, count(*) AS n FROM v GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    from stratamem.operators.retrieval import dot

    v = t.vectors.select("id", "tenant", unit("embedding").alias("v"))
    glosses = v.where("id < 10").select(F.col("id").alias("g"), F.col("tenant").alias("label"), F.col("v").alias("q"))  # ten rows
    s = v.where("id >= 10").crossJoin(F.broadcast(glosses)).withColumn("s", F.round(dot("q", "v"), 6))
    best = s.groupBy("id", F.col("tenant").alias("truth")).agg(F.max_by("label", F.struct("s", -F.col("g"))).alias("predicted"))
    return best.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def fill_sql(items: str, budget: int) -> str:
    """The greedy fill as SQL; items: expressions that end with r (user_id, id, c, rn)."""
    return items + f""", w AS (SELECT * FROM (WITH RECURSIVE f AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS used, NULL::BIGINT AS id, false AS taken FROM r UNION ALL
  SELECT r.user_id, r.rn, CASE WHEN used + c <= {budget} THEN used + c ELSE used END, r.id, used + c <= {budget} FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1) SELECT * FROM f))
SELECT user_id, id FROM w WHERE taken"""


@R.add("pack03_window_lane", fill_sql("r AS (SELECT t.user_id, t.session_id * 100 + turn_index AS id, greatest(1, CAST(floor(length(content) / 4.6) AS BIGINT)) AS c, row_number() OVER (PARTITION BY t.user_id ORDER BY t.session_id * 100 + turn_index) AS rn FROM turns t JOIN sessions s ON s.session_id = t.session_id WHERE started_on BETWEEN DATE '2024-01-21' AND DATE '2024-03-01')", 600))
def _(t: Tables) -> DataFrame:
    """At most half of the budget for turns of the asked period, by place in the archive."""
    asked = t.sessions.where("started_on between date'2024-01-21' and date'2024-03-01'").select("session_id")
    inside = t.turns.join(asked, "session_id", "left_semi").withColumn("cost", F.greatest(F.lit(1), F.floor(F.length("content") / 4.6)).cast("long"))
    items = inside.select("user_id", (F.col("session_id") * 100 + F.col("turn_index")).alias("id"), "cost")
    return filled(items, ["user_id"], 600, F.col("id"))


@R.add("pack06_hydration", fill_sql(TURNS_BM25 + ", s AS (SELECT user_id, session_id, turn_index, unnest(regexp_extract_all(content, '[^.!?]+(?:[.!?]+|$)')) AS s, generate_subscripts(regexp_extract_all(content, '[^.!?]+(?:[.!?]+|$)'), 1) - 1 AS i FROM turns), a AS (SELECT DISTINCT user_id, session_id, turn_index, unnest([i - 1, i, i + 1]) AS i FROM s WHERE session_id * 1000 + turn_index IN (SELECT turn_id FROM turn_rank WHERE rank <= 3) AND i = 0), r AS (SELECT user_id, (session_id * 100 + turn_index) * 1000 + i AS id, greatest(1, CAST(floor(length(s) / 4.6) AS BIGINT)) AS c, row_number() OVER (PARTITION BY user_id ORDER BY (session_id * 100 + turn_index) * 1000 + i) AS rn FROM s JOIN a USING (user_id, session_id, turn_index, i))", 300))
def _(t: Tables) -> DataFrame:
    """The first sentences of each query's three best turns, each with its neighbours, under a budget of 300 for each user."""
    s = t.turns.select("user_id", "session_id", "turn_index", F.posexplode(sentences("content")).alias("i", "s"))
    hits = turns_given(t).where("rank <= 3").select("turn_id").distinct()
    anchor = s.where("i = 0").withColumn("turn_id", F.col("session_id") * 1000 + F.col("turn_index")).join(hits, "turn_id", "left_semi").select("user_id", "session_id", "turn_index", F.explode(F.array(F.col("i") - 1, F.col("i"), F.col("i") + 1)).alias("i")).distinct()
    found = s.join(anchor, ["user_id", "session_id", "turn_index", "i"])
    items = found.select("user_id", ((F.col("session_id") * 100 + F.col("turn_index")) * 1000 + F.col("i")).alias("id"), F.greatest(F.lit(1), F.floor(F.length("s") / 4.6)).cast("long").alias("cost"))
    return filled(items, ["user_id"], 300, F.col("id"))


@R.add("pack08_split_oversized", """c AS (SELECT * FROM (WITH RECURSIVE f AS (SELECT session_id, turn_index, content, length(content) AS n, 0::BIGINT AS start, 0::BIGINT AS pos FROM turns UNION ALL
  SELECT session_id, turn_index, content, n, pos, CASE WHEN pos + 400 >= n THEN n WHEN back > 200 AND back <= 400 THEN pos + back ELSE pos + 400 END
  FROM (SELECT *, 401 - instr(reverse(substr(content, pos + 1, 400)), ' ') AS back FROM f WHERE pos < n)) SELECT * FROM f WHERE pos > start))
SELECT session_id, turn_index, CAST(start AS INTEGER) AS start, CAST(pos AS INTEGER) AS end, sha256(substr(content, start + 1, pos - start)) AS digest FROM c""")
def _(t: Tables) -> DataFrame:
    """Texts cut into spans of at most 400 characters at a space in the second half; offsets and digest of each."""
    n = F.col("n")
    cut = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(n / 200).cast("int"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda a, _i: F.when(a["at"] >= n, a).otherwise(_next_span(a)),
    )
    d = t.turns.select("session_id", "turn_index", "content", F.length("content").alias("n"))
    spans = d.select("session_id", "turn_index", "content", F.explode(cut["out"]).alias("s"))
    return spans.select("session_id", "turn_index", "s.start", "s.end", F.sha2(F.substring("content", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")), 256).alias("digest"))


def _next_span(a: Column) -> Column:
    window = F.substring(F.col("content"), a["at"] + 1, F.lit(400))
    back = F.length(window) - F.locate(" ", F.reverse(window)) + 1
    end = F.when(a["at"] + 400 >= F.col("n"), F.col("n")).when((F.locate(" ", F.reverse(window)) > 0) & (back > 200), a["at"] + back).otherwise(a["at"] + 400)
    return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), end.alias("end")))).alias("out"))


@R.add("pack09_evidence_ledger", TURNS_BM25 + """, c AS (SELECT turn_id, content, greatest(1, CAST(floor(length('[' || turn_id || '] ' || content) / 4.6) AS BIGINT)) AS c FROM (SELECT session_id * 1000 + turn_index AS turn_id, content FROM turns)),
u AS (SELECT query_id, c.content, min(rank) AS rank, min_by(c.turn_id, rank) AS id FROM turn_rank r JOIN c ON c.turn_id = r.turn_id GROUP BY ALL), r AS (SELECT u.query_id, id, c, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS o FROM u JOIN c ON c.turn_id = u.id),
w AS (SELECT * FROM (WITH RECURSIVE f AS (SELECT DISTINCT query_id, 0::BIGINT AS o, 0::BIGINT AS used, NULL::BIGINT AS id, false AS taken FROM r UNION ALL SELECT r.query_id, r.o, CASE WHEN used + c <= 500 THEN used + c ELSE used END, r.id, used + c <= 500 FROM f JOIN r ON r.query_id = f.query_id AND r.o = f.o + 1) SELECT * FROM f))
SELECT query_id, id FROM w WHERE taken""")
def _(t: Tables) -> DataFrame:
    """A query's turns in rank order, each text once, as long as what they take when written with their label fits 500 tokens."""
    turns = t.turns.select((F.col("session_id") * 1000 + F.col("turn_index")).alias("turn_id"), "content")
    cost = F.greatest(F.lit(1), F.floor(F.length(F.concat(F.lit("["), F.col("turn_id").cast("string"), F.lit("] "), "content")) / 4.6)).cast("long")
    hits = turns_given(t).join(turns.withColumn("cost", cost), "turn_id")
    once = hits.groupBy("query_id", "content").agg(F.min(F.struct("rank", "turn_id", "cost")).alias("x"))
    return filled(once.select("query_id", "x.rank", F.col("x.turn_id").alias("id"), "x.cost"), ["query_id"], 500, F.col("rank"))


@R.add("tmp13_event_timeline", "SELECT line_id, regexp_extract(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS day FROM lines WHERE role = 'user' AND regexp_matches(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')")
def _(t: Tables) -> DataFrame:
    day = F.try_element_at(all_of("text", "[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(1))
    return t.lines.where("role = 'user'").select("line_id", day.alias("day")).where(F.col("day").isNotNull())


@R.add("tmp14_backfill_classes", "x AS (SELECT line_id, text, nullif(regexp_extract(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') AS old, nullif(regexp_extract(text, '(?:" + MONTHS + ") [0-9]{1,2}, [0-9]{4}'), '') AS named, said_on FROM lines), y AS (SELECT old, CASE WHEN contains(text, 'noted that on') THEN NULL WHEN named IS NOT NULL THEN strftime(strptime(named, '%B %-d, %Y'), '%Y-%m-%d') WHEN contains(text, ' after ') THEN CAST(CAST(old AS DATE) - 1 AS VARCHAR) ELSE old END AS new FROM x) SELECT CASE WHEN old IS NOT DISTINCT FROM new THEN 'unchanged' WHEN new IS NULL THEN 'withdrawn' WHEN old IS NULL THEN 'recovered' ELSE 'corrected' END AS change, count(*) AS n FROM y GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Event days worked out anew: dates by name are found, a date of saying is withdrawn, `after` moves to the day before."""
    old = F.try_to_date(F.try_element_at(all_of("text", "[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(1)), "yyyy-MM-dd")
    named = F.try_to_date(F.try_element_at(all_of("text", rf"(?:{MONTHS}) [0-9]{{1,2}}, [0-9]{{4}}"), F.lit(1)), "MMMM d, yyyy")
    new = F.when(F.col("text").contains("noted that on"), None).when(named.isNotNull(), named).when(F.col("text").contains(" after "), F.date_sub(old, 1)).otherwise(old)
    r = t.lines.select(old.alias("old"), new.alias("new"))
    change = F.when(F.col("old").eqNullSafe(F.col("new")), "unchanged").when(F.col("new").isNull(), "withdrawn").when(F.col("old").isNull(), "recovered").otherwise("corrected")
    return r.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@R.add("life05_cluster_summary", """e AS (SELECT x.id AS a, y.id AS b FROM vectors x JOIN vectors y ON x.tenant = y.tenant AND x.id <> y.id WHERE round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) >= 0.3),
r AS (SELECT * FROM (WITH RECURSIVE w AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id) SELECT id, min(root) AS root FROM w GROUP BY id)),
n AS (SELECT root, list_sort(list_distinct(flatten(list(entities)))) AS entities FROM r JOIN memories USING (id) GROUP BY root)
SELECT r.root, left(sha256(r.root || ':' || string_agg(r.id::VARCHAR, ',' ORDER BY r.id)), 20) AS id, round(max(importance), 9) AS importance, array_to_string(any_value(n.entities), ' ') AS entities, count(*) AS edges, round(sum(strength * 0.5), 6) AS left_strength
FROM r JOIN memories m ON m.id = r.id JOIN n ON n.root = r.root GROUP BY r.root""")
def _(t: Tables) -> DataFrame:
    """One summary row a similarity cluster: its id from its members, the greatest importance, all entities; an edge to each source, whose strength halves."""
    from stratamem.operators.retrieval import connected, similar_links

    labels = connected(similar_links(t.vectors.select("id", "tenant", unit("embedding").alias("v")), 0.3).select("a", "b"))
    c = labels.join(t.memories.select("id", "importance", "strength", "entities"), "id")
    ids = F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",")
    named = F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities"))))
    return c.groupBy("root").agg(F.left(F.sha2(F.concat(F.col("root").cast("string"), F.lit(":"), ids), 256), F.lit(20)).alias("id"), F.round(F.max("importance"), 9).alias("importance"), F.array_join(named, " ").alias("entities"), F.count(F.lit(1)).alias("edges"), F.round(F.sum(F.col("strength") * 0.5), 6).alias("left_strength"))


@R.add("scl07_entity_splitter", "SELECT line_id, array_to_string(regexp_split_to_array(regexp_extract(text, 'with ([A-Z][a-z]+ and [A-Z][a-z]+)', 1), ' and '), '|') AS parts FROM lines WHERE regexp_matches(text, 'with [A-Z][a-z]+ and [A-Z][a-z]+')")
def _(t: Tables) -> DataFrame:
    p = "with ([A-Z][a-z]+ and [A-Z][a-z]+)"
    return t.lines.where(F.col("text").rlike(p)).select("line_id", F.array_join(F.split(F.regexp_extract("text", p, 1), " and "), "|").alias("parts"))


@R.add("scl09_span_locate", "x AS (SELECT session_id, turn_index, content, translate(regexp_extract(content, '^[^ ]+ +([^ ]+) +([^ ]+)', 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '  ' || regexp_extract(content, '^[^ ]+ +([^ ]+) +([^ ]+)', 2) AS span FROM turns WHERE regexp_matches(content, '^[^ ]+ +[^ ]+ +[^ ]+')) SELECT session_id, turn_index, instr(content, span) - 1 AS exact, instr(trim(regexp_replace(lower(content), '[ ]+', ' ', 'g')), trim(regexp_replace(lower(span), '[ ]+', ' ', 'g'))) - 1 AS found FROM x")
def _(t: Tables) -> DataFrame:
    """Where a quoted span stands: as it is, else by a match without regard to case and runs of white space; -1 if nowhere."""
    p = "^[^ ]+ +([^ ]+) +([^ ]+)"
    span = F.concat(F.translate(F.regexp_extract("content", p, 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("  "), F.regexp_extract("content", p, 2))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[ ]+", " "))
    x = t.turns.where(F.col("content").rlike(p)).withColumn("span", span)
    return x.select("session_id", "turn_index", (F.instr("content", F.col("span")) - 1).cast("long").alias("exact"), (F.instr(plain("content"), plain("span")) - 1).cast("long").alias("found"))


@R.add("scl12_first_number", "SELECT line_id, try_cast(replace(rtrim(nullif(regexp_extract(text, '[0-9][0-9,]*(?:\\.[0-9]+)?'), ''), ','), ',', '') AS DECIMAL(18, 2)) AS number FROM lines")
def _(t: Tables) -> DataFrame:
    """The first number of a text as an exact one, thousands commas dropped; null without any."""
    first = F.nullif(F.regexp_extract("text", r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(""))
    return t.lines.select("line_id", F.replace(F.rtrim(first, F.lit(",")), F.lit(","), F.lit("")).try_cast("decimal(18,2)").alias("number"))


@R.add("scl15_rule_importance", "SELECT line_id, round(least(1.0, 0.4 + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, ' [A-Z][a-z]+') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'replaced|switched') THEN 0.15 ELSE 0 END)::DOUBLE, 6) AS importance FROM lines")
def _(t: Tables) -> DataFrame:
    part = lambda c, p, x: F.when(c.rlike(p), x).otherwise(0.0)
    c = F.col("text")
    return t.lines.select("line_id", F.round(F.least(F.lit(1.0), 0.4 + part(c, "[0-9]", 0.2) + part(c, " [A-Z][a-z]+", 0.15) + part(F.lower("text"), "replaced|switched", 0.15)), 6).alias("importance"))


@R.add("scl19_timestamp_formats", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 7 IN (3, 4) THEN ' 09:05' ELSE ' 00:00' END AS at FROM orders WHERE o_orderkey % 7 < 6")
def _(t: Tables) -> DataFrame:
    """Six formats in turn, the week day's name being stripped first; a text that fits none is null."""
    formats = ("yyyy/MM/dd", "yyyy-MM-dd", "d MMM yyyy", "yyyy/MM/dd (EEE) HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "MMMM d, yyyy")
    k, at = F.col("o_orderkey") % 7, F.to_timestamp(F.to_date("o_orderdate")) + F.expr("make_dt_interval(0, 9, 5)")
    text = F.coalesce(*[F.when(k == i, F.date_format(at, f)) for i, f in enumerate(formats)], F.lit("soon"))
    x = t.raw("orders").select("o_orderkey", F.regexp_replace(text, r" *\([A-Za-z]+\) *", " ").alias("x"))
    found = F.coalesce(*[F.try_to_timestamp("x", F.lit(f.replace(" (EEE)", ""))) for f in formats])
    return x.select("o_orderkey", F.date_format(found, "yyyy-MM-dd HH:mm").alias("at")).where(F.col("at").isNotNull())


@R.add("scl34_json_arguments", "SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events")
def _(t: Tables) -> DataFrame:
    e = t.raw("events").select("event_id", F.from_json("props", "k long, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("p"))
    return e.where(F.col("p._bad").isNull()).select("event_id", "p.k")


@R.add("scl35_request_key", "SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || ',\"value\":' || CAST(floor(value) AS BIGINT) || '}') AS key FROM events")
def _(t: Tables) -> DataFrame:
    """A digest of a request as JSON with its keys in order."""
    e = t.raw("events").select("event_id", "user_id", "event_type", F.floor("value").alias("value"))
    return e.select("event_id", F.sha2(F.to_json(F.struct(*sorted(["event_type", "user_id", "value"]))), 256).alias("key"))


@R.add("dq07_batch_curve", "l AS (SELECT question_id, correct, arm FROM repeats WHERE repeat = 0) SELECT x.arm AS first, y.arm AS second, count(*) FILTER (x.correct AND NOT y.correct) AS only_first, count(*) FILTER (y.correct AND NOT x.correct) AS only_second FROM l x JOIN l y ON x.question_id = y.question_id AND x.arm < y.arm GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    x = t.repeats.where("repeat = 0").select("question_id", F.col("arm").alias("first"), F.col("correct").alias("c"))
    y = x.toDF("question_id", "second", "d")
    p = x.join(y, "question_id").where("first < second")
    return p.groupBy("first", "second").agg(F.count_if(F.col("c") & ~F.col("d")).alias("only_first"), F.count_if(F.col("d") & ~F.col("c")).alias("only_second"))


@R.add("dq23_gold_review", "SELECT session_id, count(*) FILTER (role = 'user') AS reviewed, count(DISTINCT CASE WHEN role = 'user' THEN sha256(content) END) AS distinct_quotes FROM turns GROUP BY session_id")
def _(t: Tables) -> DataFrame:
    mine = F.col("role") == "user"
    return t.turns.groupBy("session_id").agg(F.count_if(mine).alias("reviewed"), F.count_distinct(F.when(mine, F.sha2("content", 256))).alias("distinct_quotes"))


@R.add("eval17_gate_not_vacuous", "SELECT count(a) AS observed, round(avg(a::INT), 9) AS accuracy FROM results")
def _(t: Tables) -> DataFrame:
    seen = F.when(F.count("a") == 0, F.raise_error(F.lit("the gate's input was never observed"))).otherwise(F.count("a"))
    return t.results.agg(seen.cast("long").alias("observed"), F.round(F.avg(F.col("a").cast("int")), 9).alias("accuracy"))


@R.add("eval18_exposure_order", "SELECT question_id FROM (SELECT question_id, a, row_number() OVER (PARTITION BY question_type ORDER BY sha256('dev:' || question_id)) AS rn, count(*) OVER (PARTITION BY question_type) AS n FROM results) WHERE CASE WHEN a THEN 2 ELSE 1 END > CASE WHEN rn * 3 <= n THEN 1 ELSE 2 END")
def _(t: Tables) -> DataFrame:
    level = F.create_map(*[F.lit(x) for pair in (("none", 0), ("dev", 1), ("test", 2)) for x in pair])
    own = W.partitionBy("question_type")
    rn = F.row_number().over(own.orderBy(F.sha2(F.concat_ws(":", F.lit("dev"), "question_id"), 256)))
    noted = t.results.withColumns({"rn": rn, "n": F.count(F.lit(1)).over(own)})  # a third of each type was noted for dev only
    claim, recorded = F.when(F.col("a"), "test").otherwise("dev"), F.when(F.col("rn") * 3 <= F.col("n"), "dev").otherwise("test")
    return noted.where(F.element_at(level, claim) > F.element_at(level, recorded)).select("question_id")


@R.add("eval20_scan_gain", "g AS (SELECT user_id, count(*) FILTER (predicate = 'click') AS gold, count(*) FILTER (predicate = 'click' AND rn <= 20) AS found FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, id) AS rn FROM memories) GROUP BY user_id) SELECT round(avg(found / gold), 9) AS top_k_recall, round(avg((found = gold)::INT), 9) AS complete FROM g WHERE gold > 0")
def _(t: Tables) -> DataFrame:
    click = F.col("predicate") == "click"
    r = t.memories.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("importance"), "id")))
    g = r.groupBy("user_id").agg(F.count_if(click).alias("gold"), F.count_if(click & (F.col("rn") <= 20)).alias("found")).where("gold > 0")
    return g.agg(F.round(F.avg(F.col("found") / F.col("gold")), 9).alias("top_k_recall"), F.round(F.avg((F.col("found") == F.col("gold")).cast("int")), 9).alias("complete"))


@R.add("dml10_rekey_sessions", "SELECT user_id || ':' || session_id AS scoped, count(*) AS turns FROM turns GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    keys = t.sessions.select("session_id", F.concat_ws(":", "user_id", "session_id").alias("scoped"))
    return t.turns.join(keys, "session_id").groupBy("scoped").agg(F.count(F.lit(1)).alias("turns"))


@R.add("dml11_vector_maintenance", "SELECT id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) / greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 1e-12), 6) AS norm FROM vectors WHERE id % 25 <> 0")
def _(t: Tables) -> DataFrame:
    gone = t.vectors.where("id % 25 = 0").select("id")
    kept = t.vectors.join(gone, "id", "left_anti").select("id", unit("embedding").alias("v"))
    return kept.select("id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


@R.add("ret20_retention", """q AS (SELECT item_id AS query_id, 'original' AS variant, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark
  UNION ALL SELECT query_id, 'keywords', term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) AS rn FROM (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS term FROM benchmark)) WHERE rn <= 8),
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM tok),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, variant, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term, st GROUP BY ALL),
a AS (SELECT id AS doc_id, CAST(observed_at AS DATE) AS day, CAST(valid_to AS DATE) AS gone FROM memories),
gold AS (SELECT b.item_id AS query_id, d.doc_id, a.day, a.gone FROM benchmark b JOIN documents d ON contains(d.text, b.text) JOIN a ON a.doc_id = d.doc_id),
g AS (SELECT gold.*, v.variant, k.delay, gold.day + k.delay AS as_of FROM gold, (VALUES ('original'), ('keywords')) v(variant), (VALUES (1), (7), (30)) k(delay)),
r AS (SELECT g.query_id, g.variant, g.delay, g.doc_id, (g.gone IS NULL OR g.gone > g.as_of) AS durable, max(own.score) AS mark, count(o.doc_id) FILTER (x.day <= g.as_of AND (o.score > own.score OR (o.score = own.score AND o.doc_id < g.doc_id))) AS ahead
  FROM g LEFT JOIN bm own ON own.query_id = g.query_id AND own.variant = g.variant AND own.doc_id = g.doc_id LEFT JOIN bm o ON o.query_id = g.query_id AND o.variant = g.variant LEFT JOIN a x ON x.doc_id = o.doc_id GROUP BY ALL),
s AS (SELECT query_id, variant, delay, bool_or(durable) AS durable, bool_or(mark IS NOT NULL) AS candidate, bool_or(mark IS NOT NULL AND ahead < 20) AS top_any, bool_and(mark IS NOT NULL AND ahead < 20) AS top_all FROM r GROUP BY ALL)
SELECT variant, delay, count(*) AS questions, count(*) FILTER (durable) AS durable, count(*) FILTER (candidate) AS candidates, count(*) FILTER (top_any) AS top_any, count(*) FILTER (top_all) AS top_all FROM s GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    """Whether what a question asks for is still there, found, and among the first 20, by delay since it was said and by wording.

    A document is said on the day of the event with its number, and gone when that fact ends. As of a later
    day only documents said by then compete; their rank is one more than those ahead.
    """
    from stratamem.operators.retrieval import bm25, containing

    w = F.array_distinct(all_of(F.lower("text"), "[a-z0-9]{3,}"))
    by = F.array_sort(F.transform(w, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w"))))
    b = t.raw("benchmark").withColumn("words", F.array_join(F.slice(by, 1, 8)["w"], " "))
    asked = b.select(F.col("item_id").alias("query_id"), F.explode(F.create_map(F.lit("original"), "text", F.lit("keywords"), "words")).alias("variant", "text"))
    keyed = asked.withColumn("query", F.concat_ws(":", "variant", "query_id"))
    scored = bm25(t.raw("documents").select("doc_id", "text"), keyed.select("query", "text"), query="query").join(keyed.select("query", "query_id", "variant"), "query")
    a = t.memories.select(F.col("id").alias("doc_id"), F.to_date("observed_at").alias("day"), F.to_date("valid_to").alias("gone"))
    gold = containing(t).join(a, "doc_id").crossJoin(F.broadcast(asked.select("variant").distinct())).select("*", F.explode(F.array(F.lit(1), F.lit(7), F.lit(30))).alias("delay"))
    gold = gold.withColumn("as_of", F.date_add("day", F.col("delay"))).withColumnRenamed("day", "said")
    marked = gold.join(scored.select("query_id", "variant", "doc_id", F.col("score").alias("mark")), ["query_id", "variant", "doc_id"], "left")
    others = scored.join(a.drop("gone"), "doc_id").select("query_id", "variant", F.col("doc_id").alias("other"), "score", "day")
    ahead = (F.col("day") <= F.col("as_of")) & ((F.col("score") > F.col("mark")) | ((F.col("score") == F.col("mark")) & (F.col("other") < F.col("doc_id"))))
    r = marked.join(others, ["query_id", "variant"], "left").groupBy("query_id", "variant", "delay", "doc_id", "mark", (F.col("gone").isNull() | (F.col("gone") > F.col("as_of"))).alias("durable")).agg(F.count_if(ahead).alias("ahead"))
    top = F.col("mark").isNotNull() & (F.col("ahead") < 20)
    s = r.groupBy("query_id", "variant", "delay").agg(F.bool_or("durable").alias("durable"), F.bool_or(F.col("mark").isNotNull()).alias("candidates"), F.bool_or(top).alias("top_any"), F.bool_and(top).alias("top_all"))
    return s.groupBy("variant", "delay").agg(F.count(F.lit(1)).alias("questions"), *[F.count_if(c).alias(c) for c in ("durable", "candidates", "top_any", "top_all")])
