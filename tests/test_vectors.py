"""Vectors that meet in blocks, against plain numpy: ties, missing and odd vectors, groups of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamem.operators import context, retrieval, vectors
from stratamem.operators.retrieval import connected, nearest, similar_links, similar_pairs


def rows(n=300, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.choice([-1.0, 0.0, 1.0], (n, dim))  # many ties
    v[v.any(axis=1) == 0, 0] = 1.0
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(k, k % 3 // 2, None if k % 50 == 7 else v[k].tolist()) for k in range(n)]


def cosine(a, b):
    return None if a is None or b is None else round(sum(x * y for x, y in zip(a, b, strict=True)), 6)


def operators(df):
    """The names of the plan's operators."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [16384, 40])
@pytest.mark.parametrize("only", [None, "earlier", "other"])
def test_nearest_with_ties_and_missing_vectors(spark, monkeypatch, block, only):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    given = rows()
    df = spark.createDataFrame(given, "id long, tenant long, v array<double>")
    asked = df.select(F.col("id").alias("query_id"), "tenant", F.col("v").alias("q"))
    allowed = {None: lambda q, i: True, "earlier": lambda q, i: i < q, "other": lambda q, i: i != q}[only]
    for k in (1, 7):
        got = {(r["query_id"], r["rank"]): (r["id"], r["cosine"]) for r in nearest(asked, df, k, ["tenant"], only).collect()}
        want = {}
        for q, t, a in given:
            near = [(i, cosine(a, b)) for i, u, b in given if u == t and allowed(q, i)]
            for rank, x in enumerate(sorted(near, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:k]):
                want[q, rank + 1] = x
        assert got == want


def test_nearest_takes_few_of_many_equal_ones():
    def held(m, same):
        out = object.__new__(vectors.Rows)
        out.id, out.v, out.null, out.nan, out.same = np.arange(len(m)), m, np.zeros(len(m), bool), np.zeros(len(m), bool), np.full(len(m), same)
        return out

    rng = np.random.default_rng(2)
    m = rng.normal(size=(3000, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[1000:2000] = m[0]
    for k in (1, 5, 300, 5000):
        work = vectors.Nearest(k)
        work.begin(held(m, False))
        c = np.round(m[:50] @ m.T, 6)
        got = [[], [], []]
        for out in work.step(held(m[:50], False)):
            for have, x in zip(got, out, strict=True):
                have += x.tolist()
        want = [(q, i) for q in range(50) for i in sorted(range(3000), key=lambda i: (-c[q, i], i))[:k]]
        assert list(zip(*got[:2], strict=True)) == want


@pytest.mark.parametrize("block", [16384, 40])
def test_each_pair_once_and_links_with_the_same_components(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    given = rows()
    df = spark.createDataFrame(given, "id long, tenant long, v array<double>")
    pairs = similar_pairs(df, 0.8).select("a", "b", "cosine")
    found = [tuple(r) for r in pairs.collect()]
    want = {(a, b): c for a, s, x in given for b, t, y in given if a < b and s == t and (c := cosine(x, y)) is not None and c >= 0.8}
    assert {(a, b): c for a, b, c in found} == want and len(found) == len(want) > 300
    links = similar_links(df, 0.8).select("a", "b")
    assert {tuple(r) for r in connected(links).collect()} == {tuple(r) for r in connected(pairs.select("a", "b")).collect()}
    assert links.count() < 2.5 * 300 * max(1, 200 // block)


def test_rounding_is_half_away_from_zero():
    assert vectors.rounded(np.array([1 / 128, -1 / 128, 0.25, -1e-9])).tolist() == [0.007813, -0.007813, 0.25, 0.0]


@pytest.mark.parametrize(
    "name", ["life04_similarity_clusters", "life05_cluster_summary", "join13_dedup_neighbours", "join12_unordered_pairs", "join11_threshold_pairs", "join10_nearest_earlier", "ret10_nearest_label", "topk01_exact_cosine", "ret07_retrieval_trace", "topk06_hybrid_order", "topk07_rank_fusion"]
)
def test_queries_multiply_in_blocks(spark, name, monkeypatch):
    """No query compares vectors pair by pair in rows."""
    seen = []
    for module in (retrieval, context):
        monkeypatch.setattr(module, "top_k", lambda rows, *a: seen.append(rows) or rows.limit(0).withColumn("rank", F.lit(1).cast("long")))
    monkeypatch.setattr(retrieval, "connected", lambda rows: seen.append(rows) or rows.select(F.col("a").alias("id"), F.col("b").alias("root")))
    q = (retrieval.QUERIES | context.QUERIES)[name]
    seen.append(q(spark, "/root/testdata/sf0.001"))
    assert any("MapInArrow" in operators(x) for x in seen)
