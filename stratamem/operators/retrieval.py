"""Lexical, vector and hybrid retrieval for many queries at once, rank fusion, and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.operators.facts import SOURCED, sourced
from stratamem.operators.quantiles import row_numbers
from stratamem.operators.vectors import Links, Nearest, Pairs, meeting
from stratamem.plans.fixtures import Registry, Tables
from stratamem.sources.tables import kept

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
K1, B = 1.2, 0.75


def terms(text: str | Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def postings(docs: DataFrame, key: list[str]) -> DataFrame:
    """key, term, tf, len: one row for each distinct term of a document.

    Terms are counted within a document before anything is shuffled.
    """
    t = docs.select(*key, terms("text").alias("ts")).select(*key, "ts", F.size("ts").alias("len"))
    return t.select(*key, "len", F.explode("ts").alias("term")).groupBy(*key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))


#: Terms that are sent to the documents as a list; more are joined.
SENT_TERMS = 20_000


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", query: str = "query_id", tenant: str | None = None) -> DataFrame:
    """query, key, score for each query and document that share a term.

    Okapi BM25 with k1 = 1.2, b = 0.75, idf = ln(1 + (n - df + .5) / (df + .5)), on distinct query
    terms. docs: key, text; queries: query, text; with tenant both carry it, and a query sees its own
    tenant's documents and statistics alone. Terms that no query asks for go before anything is counted or
    shuffled: by a broadcast of the asked ones while they are few, by a semi join of terms otherwise.
    """
    own = [tenant] if tenant else []
    q = queries.select(*own, query, F.explode(F.array_distinct(terms("text"))).alias("term"))
    asked = q.select("term").distinct()
    few = asked.limit(SENT_TERMS + 1).count() <= SENT_TERMS
    t = docs.select(*own, key, terms("text").alias("ts")).select(*own, key, F.size("ts").alias("len"), "ts")
    stats = t.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    each = t.select(*own, key, "len", F.explode("ts").alias("term")).join(F.broadcast(asked) if few else asked, "term", "left_semi")
    hits = each.groupBy(*own, key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy(*own, "term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(df, [*own, "term"]).join(F.broadcast(stats), own) if own else hits.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    each = scored.select(*own, key, "term", weight.alias("w"))
    return q.join(each, [*own, "term"]).groupBy(*own, query, key).agg(F.round(F.sum("w"), 6).alias("score"))


def top_k(scored: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


BM25 = """tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM tok),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term, st GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""


def _queries(t: Tables) -> DataFrame:
    return t.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")


def _ranked(t: Tables, k: int) -> DataFrame:
    return top_k(bm25(t.raw("documents").select("doc_id", "text"), _queries(t)), ["query_id"], k, F.desc("score"), F.col("doc_id"))


@R.add("ret01_bm25", BM25 + " SELECT query_id, doc_id, score FROM ranked WHERE rank <= 50")
def _(t: Tables) -> DataFrame:
    return _ranked(t, 50).select("query_id", "doc_id", "score")


@R.add("topk03_lexical_top_k", BM25 + " SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 10")
def _(t: Tables) -> DataFrame:
    return _ranked(t, 10).select("query_id", "doc_id", "rank")


@R.add("ret01_bm25_by_tenant", """tok AS (SELECT source, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents),
st AS (SELECT source, count(*) AS n, avg(len(ts)) AS avg_len FROM tok GROUP BY 1),
tf AS (SELECT source, doc_id, len, term, count(*) AS tf FROM (SELECT source, doc_id, len(ts) AS len, unnest(ts) AS term FROM tok) GROUP BY ALL),
df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT DISTINCT 'src' || (item_id % 20) AS source, item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
bm AS (SELECT q.source, query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM q JOIN tf ON tf.term = q.term AND tf.source = q.source JOIN df ON df.term = q.term AND df.source = q.source JOIN st ON st.source = q.source GROUP BY ALL)
SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 5""")
def _(t: Tables) -> DataFrame:
    q = _queries(t).withColumn("source", F.concat(F.lit("src"), F.col("query_id") % 20))
    scored = bm25(t.raw("documents").select("source", "doc_id", "text"), q, tenant="source")
    return top_k(scored, ["query_id"], 5, F.desc("score"), F.col("doc_id")).select("query_id", "doc_id", "rank")


@R.add("topk04_turns_top_k", """tok AS (SELECT session_id, turn_index, regexp_extract_all(lower(content), '[a-z0-9]+') AS ts FROM turns),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM tok),
tf AS (SELECT session_id, turn_index, len, term, count(*) AS tf FROM (SELECT session_id, turn_index, len(ts) AS len, unnest(ts) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
bm AS (SELECT query_id, session_id * 1000 + turn_index AS turn_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term, st GROUP BY ALL)
SELECT query_id, turn_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, turn_id) AS rank FROM bm) WHERE rank <= 8""")
def _(t: Tables) -> DataFrame:
    turns = t.turns.select((F.col("session_id") * 1000 + F.col("turn_index")).alias("turn_id"), F.col("content").alias("text"))
    return top_k(bm25(turns, _queries(t), "turn_id"), ["query_id"], 8, F.desc("score"), F.col("turn_id")).select("query_id", "turn_id", "rank")


@R.add("ret14_recall_and_mrr", BM25 + """, gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
f AS (SELECT query_id, min(rank) AS first FROM gold LEFT JOIN ranked USING (query_id, doc_id) GROUP BY query_id)
SELECT count(*) AS queries, round(avg((coalesce(first, 1000000) <= 1)::INT), 9) AS r1, round(avg((coalesce(first, 1000000) <= 5)::INT), 9) AS r5, round(avg(coalesce(1.0 / first, 0)), 9) AS mrr FROM f""")
def _(t: Tables) -> DataFrame:
    first = first_ranks(containing(t), bm25(t.raw("documents").select("doc_id", "text"), _queries(t)))
    at = lambda k: F.round(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("int")), 9)
    return first.agg(F.count(F.lit(1)).alias("queries"), at(1).alias("r1"), at(5).alias("r5"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 9).alias("mrr"))


def first_ranks(gold: DataFrame, scored: DataFrame, item: str = "doc_id") -> DataFrame:
    """query_id, first: the rank that a query's best gold item has among all scored ones (query_id, item, score), ties by item; null if none is scored.

    It is one more than the items ahead of it: these are counted where they are, no list is sorted.
    """
    scored = kept(scored.select("query_id", item, "score"), "scored")
    place = F.struct((-F.col("score")).alias("s"), F.col(item).alias("i"))
    best = scored.join(gold.select("query_id", item).distinct(), ["query_id", item]).groupBy("query_id").agg(F.min(place).alias("best"))
    ahead = scored.join(best, "query_id").groupBy("query_id").agg((F.count_if(place < F.col("best")) + 1).alias("first"))
    return gold.select("query_id").distinct().join(ahead, "query_id", "left")


def containing(t: Tables) -> DataFrame:
    """query_id, doc_id: documents that hold a benchmark text as it stands, even from within a word.

    A document that holds the text holds its longest inner word, the first of them if several are. A text of
    fewer than three words has none that is sure to stand alone; such texts are held against all documents.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    inner = F.slice(words(F.col("text")), 2, F.greatest(F.size(words(F.col("text"))) - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("w")))), 1)["w"]
    b = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"), F.when(F.size(inner) > 0, longest).alias("w"))
    asked = b.select("w").distinct()
    held = t.raw("documents").select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("w")).join(asked, "w", "left_semi")
    pairs = held.join(b, "w").select("query_id", "needle", "doc_id").distinct()
    # texts come to the pairs, once each, and not with every asked word that they hold
    found = pairs.join(t.raw("documents").select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("needle"))).select("query_id", "doc_id")
    short = t.raw("documents").join(b.where("w IS NULL"), F.col("text").contains(F.col("needle"))).select("query_id", "doc_id")
    return found.union(short).distinct()


def unit(v: str | Column) -> Column:
    """A vector of doubles with length 1; the norm is at least 1e-12."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Queries that are sent to every task as one set, and vectors of a group that a task holds at a time.
SENT_QUERIES, BLOCK = 4096, 16384


def against(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Each row with each of a stated set of queries (query_id, ...): sent to the rows while the set is small enough, dealt in blocks beyond that."""
    if queries.limit(SENT_QUERIES + 1).count() <= SENT_QUERIES:
        return rows.crossJoin(F.broadcast(queries))
    n = -(-queries.count() // SENT_QUERIES)
    part = F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")
    return rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(queries.withColumn("_part", part), "_part").drop("_part")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, within: list[str] | None = None, only: str | None = None) -> DataFrame:
    """query_id, id, cosine, rank: the k nearest vectors of each query, exactly.

    queries: query_id, q (unit); vectors: id, v (unit). With `within` the search stays in groups equal
    on these columns. only: `earlier` for ids below the query's, `other` for all but its own. The vectors are dealt
    over tasks in blocks, each of which all queries of its group go past; each task keeps its own k best, so
    that only these are shuffled.
    """
    by = within or ["_all"]
    whole = {} if within else {"_all": F.lit(0)}
    x = queries.withColumns(whole).select(*by, F.col("query_id").alias("_id"), F.col("q").alias("_v"))
    y = vectors.withColumns(whole).select(*by, F.col("id").alias("_id"), F.col("v").alias("_v"))
    kinds = dict(queries.dtypes) | dict(vectors.dtypes)
    scored = meeting(x, y, by, BLOCK, lambda: Nearest(k, only), f"query_id {kinds['query_id']}, id {kinds['id']}, cosine double")
    return top_k(scored.select("query_id", "id", "cosine"), ["query_id"], k, F.desc("cosine"), F.col("id"))


COS = "cos AS (SELECT x.id AS query_id, y.id AS id, x.tenant AS qt, y.tenant AS vt, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine FROM vectors x, vectors y)"


def _unit(t: Tables) -> DataFrame:
    return t.vectors.select("id", "tenant", unit("embedding").alias("v"))


def _asked(t: Tables, every: int = 100) -> DataFrame:
    return _unit(t).where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("tenant"), F.col("v").alias("q"))


@R.add("topk01_exact_cosine", COS + " SELECT query_id, id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM cos WHERE query_id % 100 = 0) WHERE rank <= 10")
def _(t: Tables) -> DataFrame:
    return nearest(_asked(t).drop("tenant"), _unit(t), 10).select("query_id", "id", "cosine", "rank")


@R.add("topk02_tenant_candidates", COS + " SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM cos WHERE query_id % 20 = 0 AND qt = vt AND id % 3 <> 0) WHERE rank <= 5")
def _(t: Tables) -> DataFrame:
    return nearest(_asked(t, 20), _unit(t).where("id % 3 <> 0"), 5, ["tenant"]).select("query_id", "id", "rank")


@R.add("join10_nearest_earlier", COS + " SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM cos WHERE qt = vt AND id < query_id) WHERE rank <= 3")
def _(t: Tables) -> DataFrame:
    return nearest(_asked(t, 1), _unit(t), 3, ["tenant"], "earlier").select("query_id", "id", "rank")


def similar_pairs(vectors: DataFrame, at_least: float) -> DataFrame:
    """a, b, cosine: each unordered pair of one tenant at or above the threshold, once. All of a tenant's pairs are compared, in blocks."""
    return _compared(vectors, lambda: Pairs(at_least), "cosine double")


def similar_links(vectors: DataFrame, at_least: float) -> DataFrame:
    """a, b: pairs at or above the threshold that have the same components as all of them, but grow with the vectors, not with their pairs."""
    return _compared(vectors, lambda: Links(at_least))


def _compared(vectors: DataFrame, work, *more: str) -> DataFrame:
    kind = dict(vectors.dtypes)["id"]
    rows = vectors.select("tenant", F.col("id").alias("_id"), F.col("v").alias("_v"))
    return meeting(rows, None, ["tenant"], BLOCK, work, ", ".join([f"a {kind}", f"b {kind}", *more]))


@R.add("join11_threshold_pairs", COS + " SELECT query_id AS a, id AS b, cosine FROM cos WHERE qt = vt AND query_id < id AND cosine >= 0.25")
def _(t: Tables) -> DataFrame:
    return similar_pairs(_unit(t), 0.25).select("a", "b", "cosine")


@R.add("join12_unordered_pairs", COS + " SELECT DISTINCT least(query_id, id) AS a, greatest(query_id, id) AS b FROM cos WHERE qt = vt AND query_id <> id AND cosine >= 0.3")
def _(t: Tables) -> DataFrame:
    return similar_pairs(_unit(t), 0.3).select("a", "b")


@R.add("life04_similarity_clusters", COS + """, e AS (SELECT query_id AS a, id AS b FROM cos WHERE qt = vt AND query_id <> id AND cosine >= 0.3),
r AS (SELECT * FROM (WITH RECURSIVE w AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id) SELECT id, min(root) AS root FROM w GROUP BY id))
SELECT root, count(*) AS members, CAST(max(id) AS BIGINT) AS last FROM r GROUP BY root HAVING count(*) >= 3""")
def _(t: Tables) -> DataFrame:
    labels = connected(similar_links(_unit(t), 0.3).select("a", "b"))
    return labels.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.max("id").alias("last")).where("members >= 3")


def connected(edges: DataFrame) -> DataFrame:
    """id, root: the least id of each node's component, by labels that jump to their label's label.

    Each round is written into the checkpoint folder, so that the plan stays short and a lost executor
    costs one round; rounds grow with the logarithm of a chain's length.
    """
    spark = edges.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    both = edges.union(edges.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("root")).checkpoint()
    while True:
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("seen"))
        said = labels.join(around, "id").groupBy("root").agg(F.min("seen").alias("said"))
        step = labels.join(around, "id").join(said, "root").select("id", F.col("root").alias("was"), F.least("root", "seen", "said").alias("via"))
        far = labels.select(F.col("id").alias("via"), F.col("root").alias("far"))
        moved = step.join(far, "via", "left").select("id", "was", F.least("via", F.coalesce("far", "via")).alias("root")).checkpoint()
        labels = moved.select("id", "root")
        if moved.where("was <> root").isEmpty():
            return labels


@R.add("life06_shared_key_components", """e AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON x.text = y.text AND x.doc_id <> y.doc_id),
r AS (SELECT * FROM (WITH RECURSIVE w AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id) SELECT id, min(root) AS root FROM w GROUP BY id))
SELECT root, sha256(string_agg(id::VARCHAR, ',' ORDER BY id)) AS digest FROM r GROUP BY root""")
def _(t: Tables) -> DataFrame:
    d = t.raw("documents").select("doc_id", F.sha2("text", 256).alias("k"))
    least = d.groupBy("k").agg(F.min("doc_id").alias("b"))
    labels = connected(d.join(least, "k").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b"))
    members = labels.groupBy("root").agg(F.array_sort(F.collect_list("id")).cast("array<string>").alias("ids"))
    return members.select("root", F.sha2(F.array_join("ids", ","), 256).alias("digest"))


def fuse(lists: DataFrame, c: float = 60.0) -> DataFrame:
    """query_id, id, score: reciprocal-rank fusion of ranked lists (query_id, list, id, rank)."""
    return lists.groupBy("query_id", "id").agg(F.round(F.sum(1 / (c + F.col("rank"))), 9).alias("score"), F.min(F.col("list") * 1_000_000 + F.col("rank")).alias("first"))


#: The candidates of each asked vector: the 20 nearest by cosine, and the 20 best by BM25 for its document's eight longest words.
HYBRID = COS.replace("FROM vectors x, vectors y)", "FROM vectors x, vectors y WHERE x.id % 100 = 0)") + """, own AS (SELECT d.doc_id, d.text FROM documents d JOIN vectors v ON v.id = d.doc_id),
pw AS (SELECT doc_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS term FROM own WHERE doc_id % 100 = 0),
q AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) AS rn FROM pw) WHERE rn <= 8),
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM own), st AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM tok),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
lx AS (SELECT query_id, doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS lexical
  FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term, st GROUP BY ALL),
v AS (SELECT * FROM (SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM cos) WHERE rank <= 20),
k AS (SELECT * FROM (SELECT query_id, id, lexical, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, id) AS rank FROM lx) WHERE rank <= 20),
c AS (SELECT u.query_id, u.id, cosine, coalesce(lexical, 0) AS lexical FROM (SELECT query_id, id FROM v UNION SELECT query_id, id FROM k) u JOIN cos ON cos.query_id = u.query_id AND cos.id = u.id LEFT JOIN k ON k.query_id = u.query_id AND k.id = u.id),
s AS (SELECT *, CASE WHEN max(lexical) OVER w - min(lexical) OVER w <= 1e-9 * greatest(abs(max(lexical) OVER w), abs(min(lexical) OVER w)) THEN 1.0 ELSE (lexical - min(lexical) OVER w) / (max(lexical) OVER w - min(lexical) OVER w) END AS lex FROM c WINDOW w AS (PARTITION BY query_id))"""


def _lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The two ranked lists of each asked vector: by cosine, and by BM25 for the longest words of its document."""
    near = nearest(_asked(t).drop("tenant"), _unit(t), 20)
    own = t.raw("documents").join(t.vectors.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    w = F.array_sort(F.transform(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{3,})"), F.lit(1))), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w"))))
    asked = own.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(w, 1, 8)["w"], " ").alias("text"))
    lexical = top_k(bm25(own, asked), ["query_id"], 20, F.desc("score"), F.col("doc_id"))
    return near.select("query_id", "id", "cosine", "rank"), lexical.select("query_id", F.col("doc_id").alias("id"), F.col("score").alias("lexical"), "rank")


def candidates(t: Tables) -> DataFrame:
    """query_id, id, cosine, lexical, lex: both lists as one, an id once, with BM25 scaled within the query."""
    near, lexical = _lists(t)
    both = near.select("query_id", "id").union(lexical.select("query_id", "id")).distinct()
    v = _unit(t).select("id", "v")
    scored = both.join(v, "id").join(_asked(t).drop("tenant"), "query_id").select("query_id", "id", F.round(dot("q", "v"), 6).alias("cosine"))
    c = scored.join(lexical.drop("rank"), ["query_id", "id"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    return c.withColumn("lex", min_max("lexical", ["query_id"]))


@R.add("topk07_rank_fusion", HYBRID + """,
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000000 + rank) AS first FROM (SELECT query_id, id, rank, 0 AS list FROM v UNION ALL SELECT query_id, id, rank, 1 FROM k) GROUP BY ALL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM f""")
def _(t: Tables) -> DataFrame:
    near, lexical = _lists(t)
    lists = near.select("query_id", "id", "rank", F.lit(0).alias("list")).union(lexical.select("query_id", "id", "rank", F.lit(1).alias("list")))
    return top_k(fuse(lists), ["query_id"], 40, F.desc("score"), F.col("first"), F.col("id")).select("query_id", "id", "score", "rank")


def hybrid_score(cosine: Column, lexical: Column, age_days: Column, importance: Column, entity: Column, half_life: float = 30.0, weights: tuple[float, ...] = (0.4, 0.25, 0.15, 0.1, 0.1)) -> Column:
    """Weighted sum of five signals, each clipped to [0, 1]; lexical is already scaled."""
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    signals = ((cosine + 1) / 2, lexical, F.pow(F.lit(2.0), -F.greatest(age_days, F.lit(0.0)) / half_life), importance, entity)
    out = F.lit(0.0)
    for w, x in zip(weights, signals, strict=True):
        out = out + F.lit(w) * clip(x)
    return out


def min_max(x: str, by: list[str]) -> Column:
    """x scaled to [0, 1] within each group; 1 where all are equal."""
    own = W.partitionBy(*by)
    lo, hi = F.min(x).over(own), F.max(x).over(own)
    return F.when(hi - lo <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo)), F.lit(1.0)).otherwise((F.col(x) - lo) / (hi - lo))


@R.add("ret05_min_max", "SELECT id, round(CASE WHEN hi - lo <= 1e-9 * greatest(abs(hi), abs(lo)) THEN 1.0 ELSE (importance - lo) / (hi - lo) END, 9) AS scaled FROM (SELECT *, min(importance) OVER (PARTITION BY user_id) AS lo, max(importance) OVER (PARTITION BY user_id) AS hi FROM memories)")
def _(t: Tables) -> DataFrame:
    return t.memories.select("id", F.round(min_max("importance", ["user_id"]), 9).alias("scaled"))


@R.add("ret04_hybrid_score", HYBRID + """
SELECT query_id, s.id, round(0.4 * least(1.0, greatest(0.0, (cosine + 1) / 2)) + 0.25 * lex + 0.15 * pow(2.0, -date_diff('day', CAST(m.observed_at AS DATE), DATE '2024-02-01') / 30.0) + 0.1 * least(1.0, m.importance) + 0.1 * len(list_intersect(m.entities, qm.entities)) / len(m.entities), 6) AS score
FROM s JOIN memories m ON m.id = s.id JOIN memories qm ON qm.id = query_id""")
def _(t: Tables) -> DataFrame:
    facts = t.memories.select("id", "observed_at", "importance", "entities")
    asked = facts.select(F.col("id").alias("query_id"), F.col("entities").alias("named"))
    c = candidates(t).join(facts, "id").join(asked, "query_id")
    age = F.datediff(F.lit("2024-02-01").cast("date"), "observed_at").cast("double")
    score = hybrid_score(F.col("cosine"), F.col("lex"), age, F.col("importance"), F.size(F.array_intersect("entities", "named")) / F.size("entities"))
    return c.select("query_id", "id", F.round(score, 6).alias("score"))


@R.add("topk06_hybrid_order", HYBRID + " SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * (cosine + 1) / 2 + 0.5 * lex, 6) DESC, cosine DESC, id) AS rank FROM s")
def _(t: Tables) -> DataFrame:
    scored = candidates(t).withColumn("score", F.round(0.5 * (F.col("cosine") + 1) / 2 + 0.5 * F.col("lex"), 6))
    return top_k(scored, ["query_id"], 40, F.desc("score"), F.desc("cosine"), F.col("id")).select("query_id", "id", "rank")


@R.add("ret06_entity_overlap", "b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS w FROM benchmark), e AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS e FROM documents), x AS (SELECT doc_id, len(e) AS n, unnest(e) AS w FROM e) SELECT item_id, doc_id, round(count(*) / max(n), 9) AS overlap FROM x JOIN b ON b.w = x.w GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{3,})"), F.lit(1)))
    b = t.raw("benchmark").select("item_id", F.explode(words(F.col("text"))).alias("w"))
    d = t.raw("documents").select("doc_id", words(F.col("text")).alias("e")).select("doc_id", F.size("e").alias("n"), F.explode("e").alias("w"))
    return d.join(b, "w").groupBy("item_id", "doc_id").agg(F.round(F.count(F.lit(1)) / F.first("n"), 9).alias("overlap"))


@R.add("topk08_session_scores", "r AS (SELECT user_id AS session_id, importance AS s, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, id) AS rn FROM memories) SELECT session_id, round(max(s), 6) AS best, round(sum(s), 6) AS total, round(avg(s), 6) AS mean, round(sum(s) FILTER (rn <= 3), 6) AS top3 FROM r GROUP BY session_id")
def _(t: Tables) -> DataFrame:
    r = t.memories.select(F.col("user_id").alias("session_id"), F.col("importance").alias("s"), F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("importance"), "id")).alias("rn"))
    x = lambda c, n: F.round(c, 6).alias(n)
    return r.groupBy("session_id").agg(x(F.max("s"), "best"), x(F.sum("s"), "total"), x(F.avg("s"), "mean"), x(F.sum(F.when(F.col("rn") <= 3, F.col("s"))), "top3"))


@R.add("topk09_session_dcg", BM25 + ", t AS (SELECT query_id, doc_id % 20 AS session_id, rank FROM ranked WHERE rank <= 50) SELECT query_id, session_id, round(sum(1 / log2(rank + 1)), 6) AS dcg, min(rank) AS first FROM t GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    r = _ranked(t, 50).withColumn("session_id", F.col("doc_id") % 20)
    return r.groupBy("query_id", "session_id").agg(F.round(F.sum(1 / F.log2(F.col("rank") + 1)), 6).alias("dcg"), F.min("rank").alias("first"))


@R.add("topk10_rerank", BM25 + """, n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1), p AS (SELECT r.query_id, r.doc_id, score, round(count(tf.term) / max(n), 9) AS second FROM (SELECT * FROM ranked WHERE rank <= 50) r JOIN q ON q.query_id = r.query_id JOIN n ON n.query_id = r.query_id LEFT JOIN tf ON tf.doc_id = r.doc_id AND tf.term = q.term GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY second DESC, score DESC, doc_id) AS place FROM p""")
def _(t: Tables) -> DataFrame:
    """The second score is any column of query and text; here the share of the query's terms that the document holds."""
    first = _ranked(t, 50).select("query_id", "doc_id", "score")
    pairs = first.join(_queries(t).select("query_id", F.array_distinct(terms("text")).alias("q")), "query_id").join(t.raw("documents").select("doc_id", F.array_distinct(terms("text")).alias("d")), "doc_id")
    again = pairs.withColumn("second", F.round(F.size(F.array_intersect("q", "d")) / F.size("q"), 9))
    return again.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("second"), F.desc("score"), "doc_id")).cast("long").alias("place"))


@R.add("topk11_eviction_list", "r AS (SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY round(strength * importance, 9), last_accessed_at, id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM memories WHERE status = 'active') SELECT id, user_id FROM r WHERE rn <= n - 40")
def _(t: Tables) -> DataFrame:
    rows = t.memories.where("status = 'active'").select("id", "user_id", F.round(F.col("strength") * F.col("importance"), 9).alias("worth"), "last_accessed_at")
    sizes = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return row_numbers(rows, ["user_id"], F.col("worth"), F.col("last_accessed_at"), F.col("id")).join(sizes, "user_id").where("rank <= n - 40").select("id", "user_id")


@R.add("topk12_round_robin", "r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS depth, min(doc_id) OVER (PARTITION BY source) AS seen, lang FROM documents) SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY depth, seen, doc_id) AS place FROM r")
def _(t: Tables) -> DataFrame:
    docs = t.raw("documents").select("doc_id", "lang", "source")
    seen = docs.groupBy("source").agg(F.min("doc_id").alias("seen"))
    r = row_numbers(docs, ["source"], F.col("doc_id"), name="depth").join(seen, "source")
    return row_numbers(r, ["lang"], F.col("depth"), F.col("seen"), F.col("doc_id"), name="place").select("doc_id", "place")


def stratified(df: DataFrame, id_col: str, stratum: str, n: int, seed: str) -> DataFrame:
    """n rows with strata in proportion: floors first, what is left to the largest remainders; rows by seeded hash."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    share = sizes.crossJoin(F.broadcast(total)).withColumn("exact", F.col("size") * n / F.col("total")).withColumn("floor", F.floor("exact"))
    left = F.lit(n) - F.sum("floor").over(W.partitionBy(F.lit(1)))
    quota = share.withColumn("order", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("exact") - F.col("floor"), 9)), stratum))).withColumn("left", left)
    quota = quota.select(stratum, (F.col("floor") + F.when(F.col("order") <= F.col("left"), 1).otherwise(0)).alias("quota"))
    draw = F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col)), 256)
    rn = F.row_number().over(W.partitionBy(stratum).orderBy(draw, id_col))
    return df.withColumn("_rn", rn).join(F.broadcast(quota), stratum).where("_rn <= quota").drop("_rn", "quota")


STRATA = "z AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), x AS (SELECT lang, size * {n} / (SELECT sum(size) FROM z) AS exact FROM z), f AS (SELECT lang, CAST(floor(exact) AS BIGINT) AS fl, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, lang) AS o FROM x), qu AS (SELECT lang, fl + CASE WHEN o <= {n} - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS quota FROM f), rr AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1:' || doc_id), doc_id) AS rn FROM documents)"


@R.add("topk15_stratified_sample", STRATA.format(n=100) + " SELECT doc_id, rr.lang FROM rr JOIN qu ON qu.lang = rr.lang WHERE rn <= quota")
def _(t: Tables) -> DataFrame:
    return stratified(t.raw("documents"), "doc_id", "lang", 100, "s1").select("doc_id", "lang")


@R.add("topk16_disjoint_split", STRATA.format(n=100) + ", dev AS (SELECT doc_id FROM rr JOIN qu ON qu.lang = rr.lang WHERE rn <= quota) SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('s2:' || doc_id)) AS rn FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dev)) WHERE rn <= 20")
def _(t: Tables) -> DataFrame:
    rest = t.raw("documents").join(stratified(t.raw("documents"), "doc_id", "lang", 100, "s1").select("doc_id"), "doc_id", "left_anti")
    return top_k(rest, ["lang"], 20, F.sha2(F.concat_ws(":", F.lit("s2"), "doc_id"), 256)).select("doc_id")


@R.add("topk17_hash_half_split", "r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s3:' || doc_id)) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, rn <= n // 2 AND doc_id % 10 <> 0 AS held_out FROM r")
def _(t: Tables) -> DataFrame:
    docs = t.raw("documents").select("doc_id", "lang", F.sha2(F.concat_ws(":", F.lit("s3"), "doc_id"), 256).alias("draw"))
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("doc_id") % 10 == 0
    return row_numbers(docs, ["lang"], F.col("draw")).join(sizes, "lang").select("doc_id", ((F.col("rank") <= F.floor(F.col("n") / 2)) & ~seen).alias("held_out"))


@R.add("topk19_pareto_frontier", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size >= p.p_size AND o.p_retailprice <= p.p_retailprice AND (o.p_size > p.p_size OR o.p_retailprice < p.p_retailprice))")
def _(t: Tables) -> DataFrame:
    return pareto(t.raw("part"), "p_size", "p_retailprice").select("p_partkey")


def pareto(df: DataFrame, more: str, less: str) -> DataFrame:
    """Rows that no row beats on both: the best of each value of `more`, kept where all greater ones cost more.

    One aggregate leaves a row for each value of `more`; only these are put in one order.
    """
    best = df.groupBy(more).agg(F.min(less).alias("_least"))
    above = F.min("_least").over(W.orderBy(F.desc(more)).rowsBetween(W.unboundedPreceding, -1))
    front = best.withColumn("_above", above).where(F.col("_above").isNull() | (F.col("_least") < F.col("_above"))).drop("_above")
    return df.join(front, more).where(F.col(less) == F.col("_least")).drop("_least")


@R.add("topk20_quota_by_votes", "v AS (SELECT question_id, question_type, sum(correct::INT) AS votes FROM repeats GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY votes, sha256('tag:' || question_id)) AS rn FROM v) SELECT question_id FROM r WHERE rn <= CASE question_type WHEN 'en' THEN 12 ELSE 4 END")
def _(t: Tables) -> DataFrame:
    v = t.repeats.groupBy("question_id", "question_type").agg(F.count_if("correct").alias("votes"))
    rn = F.row_number().over(W.partitionBy("question_type").orderBy("votes", F.sha2(F.concat_ws(":", F.lit("tag"), "question_id"), 256)))
    return v.withColumn("rn", rn).where(F.col("rn") <= F.when(F.col("question_type") == "en", 12).otherwise(4)).select("question_id")


@R.add("ret03_fact_expansion", f"m AS ({SOURCED}) SELECT t.session_id, t.turn_index, sha256(t.content || coalesce(' ' || f.facts, '')) AS digest FROM turns t LEFT JOIN (SELECT source_session, source_turn, string_agg(content, ' ' ORDER BY id) AS facts FROM m GROUP BY ALL) f ON f.source_session = t.session_id AND f.source_turn = t.turn_index")
def _(t: Tables) -> DataFrame:
    facts = sourced(t).selectExpr("source_session session_id", "source_turn turn_index", "struct(id, content) f").where("turn_index is not null").groupBy("session_id", "turn_index").agg(F.array_join(F.array_sort(F.collect_list("f"))["content"], " ").alias("facts"))
    return t.turns.join(facts, ["session_id", "turn_index"], "left").select("session_id", "turn_index", F.sha2(F.concat_ws(" ", "content", "facts"), 256).alias("digest"))


@R.add("ret08_capped_relation_scan", "SELECT user_id, id FROM (SELECT user_id, id, count(*) OVER (PARTITION BY user_id) AS n FROM memories WHERE predicate = 'purchase' AND status = 'active') WHERE n <= 12")
def _(t: Tables) -> DataFrame:
    n = F.count(F.lit(1)).over(W.partitionBy("user_id"))
    return t.memories.where("predicate = 'purchase' and status = 'active'").withColumn("n", n).where("n <= 12").select("user_id", "id")


@R.add("ret09_router_with_margin", COS + ", r AS (SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rn FROM cos WHERE id < 14 AND query_id >= 14) SELECT query_id, max(CASE WHEN rn = 1 THEN id END) AS label FROM r WHERE rn <= 2 GROUP BY query_id HAVING round(max(CASE WHEN rn = 1 THEN cosine END) - max(CASE WHEN rn = 2 THEN cosine END), 6) >= 0.05")
def _(t: Tables) -> DataFrame:
    glosses = _unit(t).where("id < 14").select(F.col("id").alias("query_id"), F.col("v").alias("q"))  # fourteen rows
    scored = _unit(t).where("id >= 14").crossJoin(F.broadcast(glosses)).select("id", "query_id", F.round(dot("q", "v"), 6).alias("cosine"))
    two = top_k(scored, ["id"], 2, F.desc("cosine"), F.col("query_id"))
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    out = two.groupBy(F.col("id").alias("question")).agg(at(1, "query_id").alias("label"), F.round(at(1, "cosine") - at(2, "cosine"), 6).alias("margin"))
    return out.where("margin >= 0.05").select(F.col("question").alias("query_id"), "label")


@R.add("ret16_probe_table", "SELECT session_id AS question_id, kind, array_to_string(list_sort(list(turn_index)), ',') AS gold FROM turns, (VALUES ('keyword'), ('natural')) k(kind) WHERE role = 'user' GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    gold = t.turns.where("role = 'user'").groupBy(F.col("session_id").alias("question_id")).agg(F.array_join(F.array_sort(F.collect_set("turn_index")).cast("array<string>"), ",").alias("gold"))
    return gold.select("question_id", F.explode(F.array(F.lit("keyword"), F.lit("natural"))).alias("kind"), "gold")


@R.add("ret17_depth_probe", BM25 + ", gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), f AS (SELECT query_id, min(rank) AS first FROM gold LEFT JOIN ranked USING (query_id, doc_id) GROUP BY 1) SELECT CASE WHEN first <= 3 THEN 'shown' WHEN first <= 20 THEN 'pool' WHEN first IS NOT NULL THEN 'deeper' ELSE 'absent' END AS bucket, count(*) AS n FROM f GROUP BY 1")
def _(t: Tables) -> DataFrame:
    first = first_ranks(containing(t), bm25(t.raw("documents").select("doc_id", "text"), _queries(t)))
    bucket = F.when(F.col("first") <= 3, "shown").when(F.col("first") <= 20, "pool").when(F.col("first").isNotNull(), "deeper").otherwise("absent")
    return first.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@R.add("ret18_depth_sweep", BM25 + ", gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), f AS (SELECT query_id, min(rank) AS first FROM gold LEFT JOIN ranked USING (query_id, doc_id) GROUP BY 1) SELECT k, round(avg((coalesce(first, 1000000) <= k)::INT), 9) AS recall FROM f, (VALUES (1), (3), (5), (10), (50)) x(k) GROUP BY k")
def _(t: Tables) -> DataFrame:
    first = first_ranks(containing(t), bm25(t.raw("documents").select("doc_id", "text"), _queries(t)))
    ks = first.select("first", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10, 50)])).alias("k"))
    return ks.groupBy("k").agg(F.round(F.avg(F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).cast("int")), 9).alias("recall"))


@R.add("life09_neighbour_leak", COS + " SELECT count(*) FILTER (qt = vt) AS same_tenant, count(*) FILTER (qt <> vt) AS other_tenant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rn FROM cos WHERE query_id <> id AND query_id % 50 = 0) WHERE rn <= 10")
def _(t: Tables) -> DataFrame:
    near = nearest(_asked(t, 50).withColumnRenamed("tenant", "qt"), _unit(t), 10, only="other")
    owner = t.vectors.select("id", "tenant")
    both = near.join(owner, "id").join(owner.toDF("query_id", "qt"), "query_id")
    return both.agg(F.count_if(F.col("tenant") == F.col("qt")).alias("same_tenant"), F.count_if(F.col("tenant") != F.col("qt")).alias("other_tenant"))
