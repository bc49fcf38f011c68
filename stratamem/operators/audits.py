"""Data-quality audits of ingested conversations, extraction and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.functions.text import FACETS, all_of, facets, sentences
from stratamem.operators.context import TURNS_BM25, turns_given
from stratamem.operators.extraction import STATEMENT
from stratamem.operators.facts import SOURCED, sourced
from stratamem.operators.retrieval import BM25, containing, terms
from stratamem.plans.fixtures import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
#: Sentences that a store of first-person acts keeps, and those that a store of specifics keeps.
SPECIFIC = "[0-9]| [A-Z][a-z]+"
_SPEC = "spec AS (" + " UNION ".join(f"SELECT session_id, line_id, role, '{k}' AS facet, unnest(regexp_extract_all(text, '{p}')) AS value FROM lines" for k, p in FACETS.items()) + "), " + f"""facts AS (SELECT session_id, line_id, array_to_string(list_filter(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)'), lambda s: regexp_matches(s, '{STATEMENT}')), '') AS fact FROM lines WHERE role = 'user'),
more AS (SELECT session_id, line_id, array_to_string(list_filter(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)'), lambda s: regexp_matches(s, '{SPECIFIC}')), '') AS fact FROM lines),
kept AS (SELECT session_id, string_agg(fact, ' ' ORDER BY line_id) AS blob FROM facts WHERE fact <> '' GROUP BY 1), wider AS (SELECT session_id, string_agg(fact, ' ' ORDER BY line_id) AS blob2 FROM more WHERE fact <> '' GROUP BY 1)"""


def specifics(t: Tables) -> DataFrame:
    return facets(t.lines, FACETS).join(t.lines.select("line_id", "session_id", "role"), "line_id").distinct()


def kept_facts(t: Tables, pattern: str = STATEMENT, roles: tuple[str, ...] = ("user",)) -> DataFrame:
    """session_id, line_id, fact: what a store by rule keeps of each line; lines without a fact are left out."""
    fact = F.array_join(F.filter(sentences("text"), lambda s: s.rlike(pattern)), "")
    return t.lines.where(F.col("role").isin(*roles)).select("session_id", "line_id", fact.alias("fact")).where("fact <> ''")


def kept_text(t: Tables, name: str = "blob", **store) -> DataFrame:
    """What a store kept of each session."""
    facts = kept_facts(t, **store).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("line_id", "fact"))).alias("x"))
    return facts.select("session_id", F.array_join("x.fact", " ").alias(name))


@R.add("dq01_fidelity", _SPEC + " SELECT facet, count(*) AS stated, count(*) FILTER (contains(coalesce(blob, ''), value)) AS retained FROM (SELECT DISTINCT session_id, facet, value FROM spec) s LEFT JOIN kept USING (session_id) GROUP BY facet")
def _(t: Tables) -> DataFrame:
    s = specifics(t).select("session_id", "facet", "value").distinct().join(kept_text(t), "session_id", "left")
    return s.groupBy("facet").agg(F.count(F.lit(1)).alias("stated"), F.count_if(F.coalesce("blob", F.lit("")).contains(F.col("value"))).alias("retained"))


@R.add("dq02_support", _SPEC + ", src AS (SELECT session_id, string_agg(text, ' ' ORDER BY line_id) AS t FROM lines WHERE role = 'user' GROUP BY 1) SELECT facet, count(*) AS checkable, count(*) FILTER (NOT contains(coalesce(t, ''), value)) AS unsupported FROM (SELECT DISTINCT session_id, facet, value FROM spec) s LEFT JOIN src USING (session_id) GROUP BY facet")
def _(t: Tables) -> DataFrame:
    src = t.lines.where("role = 'user'").groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_id", "text")))["text"], " ").alias("t"))
    s = specifics(t).select("session_id", "facet", "value").distinct().join(src, "session_id", "left")
    return s.groupBy("facet").agg(F.count(F.lit(1)).alias("checkable"), F.count_if(~F.coalesce("t", F.lit("")).contains(F.col("value"))).alias("unsupported"))


@R.add("dq04_recall_cube", _SPEC + " SELECT coalesce(role, 'all') AS role, coalesce(facet, 'all') AS facet, count(*) AS stated, count(*) FILTER (contains(coalesce(blob, ''), value)) AS literal, count(*) FILTER (contains(lower(coalesce(blob, '')), lower(value))) AS normalised FROM (SELECT DISTINCT * FROM spec) s LEFT JOIN kept USING (session_id) GROUP BY CUBE (role, facet)")
def _(t: Tables) -> DataFrame:
    s = specifics(t).join(kept_text(t), "session_id", "left").withColumn("blob", F.coalesce("blob", F.lit("")))
    out = s.cube("role", "facet").agg(F.count(F.lit(1)).alias("stated"), F.count_if(F.col("blob").contains(F.col("value"))).alias("literal"), F.count_if(F.lower("blob").contains(F.lower("value"))).alias("normalised"))
    return out.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("role", "facet")})


@R.add("set05_uncovered_specifics", _SPEC + " SELECT DISTINCT s.session_id, facet, value FROM spec s LEFT JOIN kept USING (session_id) WHERE NOT contains(coalesce(blob, ''), value)")
def _(t: Tables) -> DataFrame:
    s = specifics(t).select("session_id", "facet", "value").distinct().join(kept_text(t), "session_id", "left")
    return s.where(~F.coalesce("blob", F.lit("")).contains(F.col("value"))).select("session_id", "facet", "value")


@R.add("dq05_paired_fidelity", _SPEC + ", v AS (SELECT DISTINCT session_id, facet, value, contains(coalesce(blob, ''), value) AS one, contains(coalesce(blob2, ''), value) AS two FROM spec LEFT JOIN kept USING (session_id) LEFT JOIN wider USING (session_id)) SELECT count(*) FILTER (two AND NOT one) AS gained, count(*) FILTER (one AND NOT two) AS lost, count(*) FILTER (one AND two) AS both FROM v")
def _(t: Tables) -> DataFrame:
    """What a store of specifics holds that a store of first-person acts does not, and the other way."""
    s = specifics(t).select("session_id", "facet", "value").distinct().join(kept_text(t), "session_id", "left").join(kept_text(t, "blob2", pattern=SPECIFIC, roles=("user", "assistant")), "session_id", "left")
    one, two = (F.coalesce(c, F.lit("")).contains(F.col("value")) for c in ("blob", "blob2"))
    return s.agg(F.count_if(two & ~one).alias("gained"), F.count_if(one & ~two).alias("lost"), F.count_if(one & two).alias("both"))


@R.add("dq06_standardisation", "r AS (SELECT source, lang, count(*) AS n, avg(quality) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY ALL), w AS (SELECT lang, count(*) AS target FROM documents GROUP BY 1) SELECT source, round(sum(target * rate) / sum(target), 9) AS standardised FROM r JOIN w USING (lang) GROUP BY source")
def _(t: Tables) -> DataFrame:
    """Labelled quality of each source, as if it had the corpus's mix of languages."""
    d = t.raw("documents")
    r = d.join(t.raw("labels").select("doc_id", "quality"), "doc_id").groupBy("source", "lang").agg(F.avg("quality").alias("rate"))
    w = d.groupBy("lang").agg(F.count(F.lit(1)).alias("target"))
    return r.join(w, "lang").groupBy("source").agg(F.round(F.sum(F.col("target") * F.col("rate")) / F.sum("target"), 9).alias("standardised"))


@R.add("dq09_zero_yield_classes", f"m AS ({SOURCED}), f AS (SELECT source_session AS session_id, count(*) AS facts, count(source_turn) AS said FROM m GROUP BY 1), n AS (SELECT session_id, count(*) AS turns, count(*) FILTER (role = 'user') AS mine, count(*) FILTER (role NOT IN ('user', 'assistant')) AS others, count(*) FILTER (trim(content) = '') AS blank, min(length(content)) AS shortest, max(length(content)) AS longest, count(DISTINCT turn_index) AS places, count(DISTINCT content) AS texts, max_by(role, turn_index) AS last FROM turns GROUP BY 1) SELECT CASE WHEN others = turns THEN 'policy' WHEN blank > 0 THEN 'format' WHEN places < turns THEN 'id collision' WHEN mine = 0 THEN 'no user turn' WHEN turns = 1 THEN 'single' WHEN facts IS NULL THEN 'no fact that day' WHEN said = 0 THEN 'evidence miss' WHEN texts < turns THEN 'repeated text' WHEN shortest < 40 THEN 'short turn' WHEN longest > 2000 THEN 'oversized turn' WHEN last = 'user' THEN 'unanswered' ELSE 'other' END AS category, count(*) AS n FROM n LEFT JOIN f USING (session_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """The first of twelve reasons, in this order, why a session gave little."""
    f = sourced(t).groupBy(F.col("source_session").alias("session_id")).agg(F.count(F.lit(1)).alias("facts"), F.count("source_turn").alias("said"))
    size = F.length("content")
    n = t.turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("mine"), F.count_if(~F.col("role").isin("user", "assistant")).alias("others"), F.count_if(F.trim("content") == "").alias("blank"),
        F.min(size).alias("shortest"), F.max(size).alias("longest"), F.count_distinct("turn_index").alias("places"), F.count_distinct(F.sha2("content", 256)).alias("texts"), F.max_by("role", "turn_index").alias("last"),
    ).join(f, "session_id", "left")
    ladder = [
        ("others = turns", "policy"), ("blank > 0", "format"), ("places < turns", "id collision"), ("mine = 0", "no user turn"), ("turns = 1", "single"), ("facts is null", "no fact that day"),
        ("said = 0", "evidence miss"), ("texts < turns", "repeated text"), ("shortest < 40", "short turn"), ("longest > 2000", "oversized turn"), ("last = 'user'", "unanswered"),
    ]
    category = F.coalesce(*[F.when(F.expr(test), name) for test, name in ladder], F.lit("other"))
    return n.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@R.add("dq10_format_checks", "SELECT session_id, bool_or(trim(content) = '') AS blank_turn, bool_or(role NOT IN ('user', 'assistant')) AS bad_role, NOT bool_or(role = 'user') AS no_user_turn FROM turns GROUP BY session_id")
def _(t: Tables) -> DataFrame:
    return t.turns.groupBy("session_id").agg(F.bool_or(F.trim("content") == "").alias("blank_turn"), F.bool_or(~F.col("role").isin("user", "assistant")).alias("bad_role"), (~F.bool_or(F.col("role") == "user")).alias("no_user_turn"))


@R.add("dq11_ingest_state", f"m AS ({SOURCED}), f AS (SELECT DISTINCT source_session AS session_id FROM m WHERE source_session IS NOT NULL), b AS (SELECT session_id FROM turns GROUP BY 1 HAVING bool_or(role NOT IN ('user', 'assistant'))) SELECT count(*) AS expected, count(*) FILTER (session_id IN (FROM f)) AS done, count(*) FILTER (session_id NOT IN (FROM f) AND session_id IN (FROM b)) AS blocked, count(*) FILTER (session_id NOT IN (FROM f) AND session_id NOT IN (FROM b)) AS pending FROM sessions")
def _(t: Tables) -> DataFrame:
    """Sessions with facts are done; of the others those with a role that cannot be taken in are blocked, the rest pending."""
    done = sourced(t).select(F.col("source_session").alias("session_id"), F.lit(True).alias("done")).where("session_id IS NOT NULL").distinct()
    bad = t.turns.groupBy("session_id").agg(F.bool_or(~F.col("role").isin("user", "assistant")).alias("bad"))
    s = t.sessions.join(done, "session_id", "left").join(bad, "session_id", "left")
    state = F.when(F.col("done"), "done").when(F.col("bad"), "blocked").otherwise("pending")
    return s.agg(F.count(F.lit(1)).alias("expected"), *[F.count_if(state == k).alias(k) for k in ("done", "blocked", "pending")])


@R.add("dq12_temporal_gate", "p AS (SELECT status = 'superseded' AS closed, predicate = lead(predicate) OVER w AS same, lead(update_op) OVER k AS expected FROM memories WINDOW w AS (PARTITION BY user_id ORDER BY occurred_at, id), k AS (PARTITION BY user_id, subject, predicate ORDER BY occurred_at, id)), g AS (SELECT round(avg(closed::INT) FILTER (expected = 'replaces'), 9) AS replace_recall, round(avg(closed::INT) FILTER (expected = 'removes'), 9) AS removal_recall, round(avg(closed::INT) FILTER (expected = 'coexists'), 9) AS false_supersede, round(avg(same::INT), 9) AS same_key FROM p) SELECT *, replace_recall >= 0.8 AND false_supersede <= 0.05 AS passes FROM g")
def _(t: Tables) -> DataFrame:
    """Pairs of facts that follow each other in a key: what the later one asks for, against what became of the earlier."""
    by, key = W.partitionBy("user_id").orderBy("occurred_at", "id"), W.partitionBy("user_id", "subject", "predicate").orderBy("occurred_at", "id")
    p = t.memories.select((F.col("status") == "superseded").cast("int").alias("closed"), (F.col("predicate") == F.lead("predicate").over(by)).cast("int").alias("same"), F.lead("update_op").over(key).alias("expected"))
    rate = lambda op: F.round(F.avg(F.when(F.col("expected") == op, F.col("closed"))), 9)
    g = p.agg(rate("replaces").alias("replace_recall"), rate("removes").alias("removal_recall"), rate("coexists").alias("false_supersede"), F.round(F.avg("same"), 9).alias("same_key"))
    return g.withColumn("passes", (F.col("replace_recall") >= 0.8) & (F.col("false_supersede") <= 0.05))


#: A few of the most frequent words of each language.
LANGUAGE_WORDS = {"de": "der|die|und|das", "en": "the|and|of|that", "es": "el|los|que|las", "fr": "les|des|que|une"}
_COUNTS = ", ".join(f"len(list_filter(regexp_extract_all(lower(text), '[^ \t\n.,;:!?]+'), lambda w: w IN ({', '.join(repr(w) for w in p.split('|'))}))) AS {k}" for k, p in LANGUAGE_WORDS.items())


@R.add("dq13_confusion", f"c AS (SELECT lang AS expected, {_COUNTS} FROM documents) SELECT expected, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'other' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS actual, count(*) AS n FROM c GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """The label a rule gives (most of a language's words) against the recorded one; no hit falls through to `other`."""
    words = all_of(F.lower("text"), r"[^ \t\n.,;:!?]+")
    hits = lambda p: F.size(F.filter(words, lambda w: w.isin(*p.split("|"))))
    c = t.raw("documents").select(F.col("lang").alias("expected"), *[hits(p).alias(k) for k, p in LANGUAGE_WORDS.items()])
    most = F.greatest(*LANGUAGE_WORDS)
    actual = F.coalesce(F.when(most == 0, "other"), *[F.when(F.col(k) == most, k) for k in LANGUAGE_WORDS])
    return c.groupBy("expected", actual.alias("actual")).agg(F.count(F.lit(1)).alias("n"))


@R.add("dq14_false_supersede", "v AS (SELECT user_id, predicate, count(DISTINCT object) AS n FROM memories WHERE status = 'active' GROUP BY ALL) SELECT CASE WHEN l.object IS NULL OR w.object IS NULL THEN 'missing object' WHEN l.predicate <> w.predicate OR l.user_id <> w.user_id THEN 'other key' WHEN v.n > 1 THEN 'multi-valued' WHEN l.object = w.object THEN 'same value' ELSE 'plausible' END AS reason, count(*) AS n FROM memories l JOIN memories w ON l.superseded_by = w.id LEFT JOIN v ON v.user_id = l.user_id AND v.predicate = l.predicate GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Structural reasons why a supersession may be false; a key with several active values is multi-valued."""
    values = t.memories.where("status = 'active'").groupBy("user_id", "predicate").agg(F.count_distinct("object").alias("n"))
    w = t.memories.select(F.col("id").alias("superseded_by"), F.col("object").alias("now"), F.col("predicate").alias("p"), F.col("user_id").alias("u"))
    pairs = t.memories.join(w, "superseded_by").join(values, ["user_id", "predicate"], "left")
    reason = F.when(F.col("object").isNull() | F.col("now").isNull(), "missing object").when((F.col("predicate") != F.col("p")) | (F.col("user_id") != F.col("u")), "other key").when(F.col("n") > 1, "multi-valued").when(F.col("object") == F.col("now"), "same value").otherwise("plausible")
    return pairs.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@R.add("dq15_anchor_sentence", BM25.split("ranked AS")[0].rstrip().rstrip(",") + """, g AS (SELECT item_id AS query_id, doc_id, d.text FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
s AS (SELECT query_id, doc_id, unnest(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)'), 1) AS i FROM g),
w AS (SELECT query_id, doc_id, i, unnest(list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+'))) AS term FROM s),
x AS (SELECT w.query_id, w.doc_id, i, round(sum(ln(1 + n / df) * CASE WHEN regexp_matches(w.term, '[0-9]') THEN 4 ELSE 1 END), 6) AS score FROM w JOIN q ON q.query_id = w.query_id AND q.term = w.term JOIN df ON df.term = w.term, st GROUP BY ALL)
SELECT query_id, doc_id, max_by(i, (score, -i)) AS anchor FROM x GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    """The sentence of a holding document that supports a benchmark text best: shared words by rarity, numbers four times; ties earliest."""
    q = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(terms("text"))).alias("term"))
    docs = t.raw("documents").select("doc_id", "text")
    asked = q.select("term").distinct()
    df = docs.select("doc_id", F.explode(F.array_distinct(terms("text"))).alias("term")).join(asked, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))).select("term", (F.log(1 + F.col("n") / F.col("df")) * F.when(F.col("term").rlike("[0-9]"), 4).otherwise(1)).alias("w"))
    s = containing(t).join(docs, "doc_id").select("query_id", "doc_id", F.posexplode(sentences("text")).alias("i", "s"))
    shared = s.select("query_id", "doc_id", (F.col("i") + 1).cast("long").alias("i"), F.explode(F.array_distinct(terms("s"))).alias("term")).join(q, ["query_id", "term"]).join(idf, "term")
    score = shared.groupBy("query_id", "doc_id", "i").agg(F.round(F.sum("w"), 6).alias("score"))
    return score.groupBy("query_id", "doc_id").agg(F.max_by("i", F.struct("score", -F.col("i"))).alias("anchor"))


@R.add("dq16_anchor_accuracy", _SPEC + ", u AS (SELECT session_id, value, min(line_id) AS only_line FROM spec GROUP BY ALL HAVING count(DISTINCT line_id) = 1), a AS (SELECT u.session_id, u.value, only_line, min(f.line_id) AS anchor FROM u LEFT JOIN facts f ON f.session_id = u.session_id AND contains(f.fact, u.value) GROUP BY ALL) SELECT count(*) AS checkable, count(anchor) AS anchored, count(*) FILTER (anchor = only_line) AS right_anchor FROM a")
def _(t: Tables) -> DataFrame:
    """Values that one line of a session holds: whether the store has a fact with the value, and whether that comes from this line."""
    u = specifics(t).groupBy("session_id", "value").agg(F.count_distinct("line_id").alias("n"), F.min("line_id").alias("only")).where("n = 1")
    facts = kept_facts(t).withColumnRenamed("line_id", "from")
    held = u.join(facts, "session_id").where(F.col("fact").contains(F.col("value"))).groupBy("session_id", "value").agg(F.min("from").alias("anchor"))
    both = u.join(held, ["session_id", "value"], "left")
    return both.agg(F.count(F.lit(1)).alias("checkable"), F.count("anchor").alias("anchored"), F.count_if(F.col("anchor") == F.col("only")).alias("right_anchor"))


@R.add("dq17_quote_grounding", _SPEC + ", l AS (SELECT *, max(CASE WHEN role = 'user' THEN turn_index END) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM lines) SELECT DISTINCT l.line_id, s.facet, s.value, CASE WHEN u.line_id IS NULL THEN 'no turn' WHEN contains(u.text, s.value) THEN 'grounded' ELSE 'quote not in turn' END AS reason FROM l JOIN spec s ON s.line_id = l.line_id AND s.role = 'assistant' LEFT JOIN lines u ON u.session_id = l.session_id AND u.turn_index = l.said")
def _(t: Tables) -> DataFrame:
    """Each specific that the assistant states, held against what the user said last before it."""
    before = W.partitionBy("session_id").orderBy("turn_index").rowsBetween(W.unboundedPreceding, -1)
    said = t.lines.withColumn("u", F.max(F.when(F.col("role") == "user", F.struct("turn_index", "text"))).over(before)).select("line_id", "u.text")
    s = specifics(t).where("role = 'assistant'").select("line_id", "facet", "value").distinct().join(said, "line_id")
    reason = F.when(F.col("text").isNull(), "no turn").when(F.col("text").contains(F.col("value")), "grounded").otherwise("quote not in turn")
    return s.select("line_id", "facet", "value", reason.alias("reason"))


@R.add("dq19_label_coverage", "w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS w FROM benchmark), v AS (SELECT w, bool_or(role = 'user') AS mine, bool_or(role <> 'user') AS theirs FROM (SELECT role, unnest(regexp_extract_all(lower(content), '[a-z0-9]{3,}')) AS w FROM turns) GROUP BY 1), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM documents), r AS (SELECT item_id, avg(coalesce(mine, false)::INT) AS mine, avg(coalesce(theirs, false)::INT) AS theirs, avg((v.w IS NOT NULL)::INT) AS any_turn, avg((d.w IS NOT NULL)::INT) AS corpus FROM w LEFT JOIN v ON v.w = w.w LEFT JOIN d ON d.w = w.w GROUP BY 1) SELECT CASE WHEN mine >= 0.8 THEN '1 user' WHEN theirs >= 0.8 THEN '2 others' WHEN any_turn >= 0.8 THEN '3 together' WHEN corpus >= 0.8 THEN '4 documents' ELSE '5 nowhere' END AS stage, count(*) AS n, round(avg(any_turn), 9) AS share FROM r GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Where four fifths of a label's words are first found: what users say, others, both, or the documents only."""
    found = lambda c: F.array_distinct(all_of(F.lower(c), "[a-z0-9]{3,}"))
    w = t.raw("benchmark").select("item_id", F.explode(found("text")).alias("w"))
    asked = w.select("w").distinct()
    v = t.turns.select("role", F.explode(found("content")).alias("w")).join(asked, "w", "left_semi").groupBy("w").agg(F.bool_or(F.col("role") == "user").alias("mine"), F.bool_or(F.col("role") != "user").alias("theirs"), F.lit(True).alias("any_turn"))
    d = t.raw("documents").select(F.explode(found("text")).alias("w")).join(asked, "w", "left_semi").distinct().withColumn("corpus", F.lit(True))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(c)
    r = w.join(v, "w", "left").join(d, "w", "left").groupBy("item_id").agg(*[share(c) for c in ("mine", "theirs", "any_turn", "corpus")])
    stage = F.when(F.col("mine") >= 0.8, "1 user").when(F.col("theirs") >= 0.8, "2 others").when(F.col("any_turn") >= 0.8, "3 together").when(F.col("corpus") >= 0.8, "4 documents").otherwise("5 nowhere")
    return r.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("any_turn"), 9).alias("share"))


@R.add("dq20_lineage", f"m AS ({SOURCED}) SELECT s.session_id, count(DISTINCT t.turn_index) AS turns, count(DISTINCT m.id) AS facts, count(DISTINCT CASE WHEN m.importance > 0.2 THEN m.id END) AS in_context FROM sessions s LEFT JOIN turns t ON t.session_id = s.session_id LEFT JOIN m ON m.source_session = s.session_id GROUP BY s.session_id")
def _(t: Tables) -> DataFrame:
    n = t.turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    m = sourced(t).groupBy(F.col("source_session").alias("session_id")).agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("importance") > 0.2).alias("in_context"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return t.sessions.join(n, "session_id", "left").join(m, "session_id", "left").select("session_id", zero("turns"), zero("facts"), zero("in_context"))


@R.add("dq21_first_loss", "SELECT CASE WHEN a AND b THEN 'correct' WHEN a THEN 'reader' WHEN b THEN 'retrieval' ELSE 'extraction' END AS stage, question_type, count(*) AS n FROM results GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    stage = F.when(F.col("a") & F.col("b"), "correct").when(F.col("a"), "reader").when(F.col("b"), "retrieval").otherwise("extraction")
    return t.results.groupBy(stage.alias("stage"), "question_type").agg(F.count(F.lit(1)).alias("n"))


@R.add("dq22_refusals", "SELECT event_type AS operation, regexp_extract(props, '\"k\": *([0-9]+)', 1) AS cause, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    e = t.raw("events").where(F.col("event_type").isin("error", "click"))
    return e.groupBy(F.col("event_type").alias("operation"), F.get_json_object("props", "$.k").alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@R.add("dq24_gold_overlay", "o AS (SELECT question_id, sum(correct::INT) >= 2 AS corrected FROM repeats WHERE arm = 'a' GROUP BY 1) SELECT question_type, count(*) FILTER (a) AS before, count(*) FILTER (coalesce(corrected, a)) AS after, count(*) FILTER (corrected <> a) AS changed FROM results LEFT JOIN o USING (question_id) GROUP BY question_type")
def _(t: Tables) -> DataFrame:
    """Verdicts rescored by the majority of three repeats, where there are any."""
    overlay = t.repeats.where("arm = 'a'").groupBy("question_id").agg((F.count_if("correct") >= 2).alias("corrected"))
    r = t.results.join(overlay, "question_id", "left")
    return r.groupBy("question_type").agg(F.count_if("a").alias("before"), F.count_if(F.coalesce("corrected", "a")).alias("after"), F.count_if(F.col("corrected") != F.col("a")).alias("changed"))


@R.add("dq25_hash_coverage", TURNS_BM25 + ", d AS (SELECT DISTINCT t.session_id, t.turn_index, sha256(t.content) AS h FROM turn_rank r JOIN turns t ON t.session_id * 1000 + t.turn_index = r.turn_id) SELECT t.session_id, bool_and(d.h IS NOT NULL) AS covered FROM turns t LEFT JOIN d ON d.session_id = t.session_id AND d.turn_index = t.turn_index AND d.h = sha256(t.content) WHERE role = 'assistant' GROUP BY t.session_id")
def _(t: Tables) -> DataFrame:
    """Whether all that the assistant said in a session, told by place and digest, is among the turns that some query was given."""
    key = ["session_id", "turn_index", "h"]
    rows = t.turns.select("session_id", "turn_index", F.sha2("content", 256).alias("h"), "role", (F.col("session_id") * 1000 + F.col("turn_index")).alias("turn_id"))
    given = turns_given(t).select("turn_id").distinct()
    delivered = rows.join(given, "turn_id").select(*key, F.lit(True).alias("there"))
    return rows.where("role = 'assistant'").join(delivered, key, "left").groupBy("session_id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("covered"))


@R.add("scl33_number_sets", "q AS (SELECT line_id, list_sort(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS q, lead(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+')))) OVER (PARTITION BY session_id ORDER BY turn_index) AS n, lead(text) OVER (PARTITION BY session_id ORDER BY turn_index) AS said FROM lines) SELECT line_id, q = n AS same, regexp_matches(lower(said), 'not sure|do not know|cannot') AS abstains FROM q WHERE said IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """Whether each line and the next of its session state the same numbers, and whether the next one abstains."""
    by = W.partitionBy("session_id").orderBy("turn_index")
    numbers = F.array_sort(F.array_distinct(all_of("text", "[0-9]+")))
    q = t.lines.withColumn("q", numbers).withColumns({"n": F.lead("q").over(by), "said": F.lead("text").over(by)}).where("said is not null")
    return q.select("line_id", (F.col("q") == F.col("n")).alias("same"), F.lower("said").rlike("not sure|do not know|cannot").alias("abstains"))


@R.add("dq18_numeric_echo", "n AS (SELECT line_id, session_id, role, list_distinct(regexp_extract_all(text, '[0-9]+')) AS q, regexp_matches(text, ' not ') AS neg FROM lines), p AS (SELECT a.line_id, u.line_id AS source, count(*) OVER (PARTITION BY a.line_id) AS c FROM n a JOIN n u ON u.session_id = a.session_id AND u.role = 'user' AND list_has_all(u.q, a.q) AND u.neg = a.neg WHERE a.role = 'assistant' AND len(a.q) > 0) SELECT line_id, source FROM p WHERE c = 1")
def _(t: Tables) -> DataFrame:
    """What an assistant says with numbers goes back to the one line of the user that holds all of them, denied alike."""
    n = t.lines.select("line_id", "session_id", "role", F.array_distinct(all_of("text", "[0-9]+")).alias("q"), F.col("text").contains(" not ").alias("neg"))
    u = n.where("role = 'user'").select("session_id", F.col("line_id").alias("source"), F.col("q").alias("said"), F.col("neg").alias("denied"))
    p = n.where("role = 'assistant' and size(q) > 0").join(u, "session_id").where((F.size(F.array_except("q", "said")) == 0) & (F.col("neg") == F.col("denied")))
    return p.groupBy("line_id").agg(F.min("source").alias("source"), F.count(F.lit(1)).alias("c")).where("c = 1").select("line_id", "source")


@R.add("dq26_personal_proxies", "f AS (SELECT id, user_id, scope = 'profile' AS preference, scope = 'profile' AND source_role = 'user' AS personal, regexp_extract(content, '([0-9]+)', 1) AS num FROM memories), alt AS (SELECT user_id, num, count(*) AS c FROM (SELECT user_id, num FROM (SELECT user_id, regexp_extract(content, '([0-9]+)', 1) AS num FROM memories WHERE source_role = 'user')) GROUP BY ALL), g AS (SELECT question_id, arm, bool_or(preference) AS preference, bool_or(personal) AS personal, bool_or(coalesce(c, 0) > 1) AS alternatives FROM repeats JOIN f ON f.id = question_id LEFT JOIN alt ON alt.user_id = f.user_id AND alt.num = f.num WHERE correct GROUP BY ALL) SELECT arm, count(*) AS questions, count(*) FILTER (preference) AS preference, count(*) FILTER (personal) AS personal, count(*) FILTER (alternatives) AS alternatives FROM g GROUP BY arm")
def _(t: Tables) -> DataFrame:
    """Of the questions an arm answers: how many rest on a preference, on what the user said of themselves, on a number said more than once."""
    number = F.regexp_extract("content", "([0-9]+)", 1)
    profile = F.col("scope") == "profile"
    f = t.memories.select(F.col("id").alias("question_id"), "user_id", profile.alias("preference"), (profile & (F.col("source_role") == "user")).alias("personal"), number.alias("num"))
    alt = t.memories.where("source_role = 'user'").groupBy("user_id", number.alias("num")).agg(F.count(F.lit(1)).alias("c"))
    rows = t.repeats.where("correct").join(f, "question_id").join(alt, ["user_id", "num"], "left").withColumn("alternatives", F.coalesce("c", F.lit(0)) > 1)
    flags = ("preference", "personal", "alternatives")
    g = rows.groupBy("question_id", "arm").agg(*[F.bool_or(c).alias(c) for c in flags])
    return g.groupBy("arm").agg(F.count(F.lit(1)).alias("questions"), *[F.count_if(c).alias(c) for c in flags])
