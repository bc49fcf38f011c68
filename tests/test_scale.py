"""Joins, order statistics and tests of significance that have to hold at any size, against plain ones."""

import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from stratamem.operators import similarity
from stratamem.operators.evaluation import binomial_tail, bootstrap, probability_ordered, sign_flip
from stratamem.operators.quantiles import at_ranks, half_even, row_numbers, upper_middle
from stratamem.operators.retrieval import connected, first_ranks, similar_pairs, unit
from stratamem.operators.timeline import filled, paged
from stratamem.plans.fixtures import Tables

SF = "/root/testdata/sf0.01"


def vectors(spark, n=600, dim=32):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((60, dim))
    v = centres[rng.integers(0, 60, n)] + rng.standard_normal((n, dim)) * rng.choice([0.2, 0.45, 1.0], (n, 1))
    v[:40] = v[0]  # a bucket of equal ones
    rows = [(k % 2, k, [float(x) for x in v[k]]) for k in range(n)] + [(1, n, None)]
    return spark.createDataFrame(rows, "tenant long, id long, e array<double>").select("tenant", "id", unit("e").alias("v"))


def test_hyperplanes_find_nearly_all_and_compare_few(spark):
    v = vectors(spark)
    for at_least in (0.65, 0.84, 0.92):
        exact = {(r["a"], r["b"]): r["cosine"] for r in similar_pairs(v.where("v IS NOT NULL"), at_least).collect()}
        found = {(r["a"], r["b"]): r["cosine"] for r in similarity.similar_pairs_lsh(v, at_least, recall=0.95).collect()}
        assert all(exact[k] == c for k, c in found.items()) and len(found) >= 0.95 * len(exact) > 400
    spread = similarity.restated(Tables(spark, SF))
    n = spread.groupBy("tenant").count().selectExpr("sum(count * (count - 1) / 2) n").first()["n"]
    assert similarity.near_candidates(spread, 0.84, 0.99).count() < n / 10
    exact = {(r["a"], r["b"]) for r in similar_pairs(spread, 0.84).collect()}
    assert exact == {(r["a"], r["b"]) for r in similarity.similar_pairs_lsh(spread, 0.84, 0.999999).collect()}


def test_clusters_by_hyperplanes(spark):
    v = vectors(spark).where("v IS NOT NULL")
    for at_least in (0.84, 0.92):
        want = {tuple(r) for r in connected(similar_pairs(v, at_least).select("a", "b")).collect()}
        assert {tuple(r) for r in similarity.similar_clusters(v, at_least, recall=0.9999999).collect()} == want and len(want) > 200


def test_shape_for_a_low_threshold_is_refused():
    assert similarity.lsh_shape(0.92, 0.95)[1] < similarity.lsh_shape(0.65, 0.95)[1] <= similarity.MOST_TABLES
    try:
        similarity.lsh_shape(0.05, 0.999999)
        raise AssertionError
    except ValueError:
        pass


def test_containment_by_rare_words(spark):
    rnd = random.Random(10)
    words = [f"word{k}" for k in range(80)]
    text = lambda n: " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(80)], k=n))
    docs = [(k, text(rnd.choice([3, 20, 100]))) for k in range(300)] + [(300, ""), (301, None)]
    items = [(k, text(rnd.choice([1, 3, 8, 15]))) for k in range(40)] + [(40, ""), (41, None), (42, "unseen words only here"), (43, "common common")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: {w for w in (t or "").split() if len(w) > 2}
    for share in (0.5, 0.8, 1.0):
        want = {(i, j, len(split(s) & split(q))) for i, s in docs for j, q in items if split(q) and len(split(s) & split(q)) >= share * len(split(q))}
        assert {tuple(r) for r in similarity.contained(d, b, share).collect()} == want and want


def test_ranks_against_sorting(spark):
    rnd = random.Random(11)
    groups = {
        "ties": [5] * 500, "one": [-7], "wide": [rnd.choice([-1, 1]) * (1 << rnd.randrange(62)) for _ in range(400)], "near": [(1 << 60) + k for k in range(300)],
        None: [rnd.randrange(1000) for _ in range(999)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("ties", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, x long")
    ranks = {"least": lambda n: F.lit(1), "p50": upper_middle, "p95": half_even(0.95), "most": lambda n: n}
    pick = lambda xs: (xs[0], xs[len(xs) // 2], xs[round(0.95 * (len(xs) - 1))], xs[-1])
    got = {r["g"]: tuple(r)[1:] for r in at_ranks(df, ["g"], "x", ranks, probes=8).collect()}
    assert got == {g: pick(sorted(xs)) for g, xs in groups.items()}
    real = [rnd.choice([rnd.gauss(0, 1), 1e308, -1e308, 1e-300, 0.0, rnd.expovariate(1) * 1e9]) for _ in range(777)]
    df = spark.createDataFrame([(x,) for x in [*real, None, float("nan")]], "x double")
    assert tuple(at_ranks(df, [], "x", ranks, probes=16).first()) == pick(sorted(real))
    plan = at_ranks(df, [], "x", ranks)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_tails_at_small_and_large_n(spark):
    pmf = lambda n, k, p: math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    pairs = [(w, x) for w in (0, 1, 2, 7, 15, 16, 17, 40) for x in (0, 1, 3, 16, 33, 120)]
    df = spark.createDataFrame(pairs, "w long, l long")
    for r in df.select("w", "l", binomial_tail(F.col("w"), F.col("l")).alias("p")).collect():
        n = r["w"] + r["l"]
        assert abs(r["p"] - min(1, 2 * sum(pmf(n, k, 0.5) for k in range(min(r["w"], r["l"]) + 1)))) < 1e-10
    for p in (0.4, 0.05, 0.9):
        for r in df.select("w", "l", probability_ordered(F.col("w") + F.col("l"), F.col("w"), p).alias("p")).collect():
            n, seen = r["w"] + r["l"], pmf(r["w"] + r["l"], r["w"], p)
            assert abs(r["p"] - min(1, sum(x for k in range(n + 1) if (x := pmf(n, k, p)) <= seen * (1 + 1e-7)))) < 1e-9, (p, r)
    began = time.time()
    big = spark.createDataFrame([(50_000_000, 50_010_000), (49_990_000, 50_010_000)], "w long, l long")
    normal = lambda w, x: math.erfc((abs(w - x) - 1) / math.sqrt(w + x) / math.sqrt(2))
    for r in big.select("w", "l", binomial_tail(F.col("w"), F.col("l")).alias("p"), probability_ordered(F.col("w") + F.col("l"), F.col("w"), 0.5).alias("q")).collect():
        assert abs(r["p"] / normal(r["w"], r["l"]) - 1) < 1e-4 and abs(r["q"] / r["p"] - 1) < 1e-6
    assert time.time() - began < 20


def test_bootstrap_draws_counts(spark):
    counts = spark.createDataFrame([("a", 100, 30), ("b", 100_000_000, 50_000_000), ("c", 5, 5)], "g string, n long, h long")
    got = {r["g"]: (r["lower"], r["upper"]) for r in bootstrap(counts, "g", 4000, 3).collect()}
    assert got == {r["g"]: (r["lower"], r["upper"]) for r in bootstrap(counts, "g", 4000, 3).collect()}
    for g, n, p in (("a", 100, 0.3), ("b", 10**8, 0.5)):
        half = 1.96 * math.sqrt(p * (1 - p) / n)
        assert abs(got[g][0] - (p - half)) < 0.15 * half + 0.5 / n and abs(got[g][1] - (p + half)) < 0.15 * half + 0.5 / n
    assert got["c"] == (1.0, 1.0)


def test_first_ranks_by_counting_ahead(spark):
    rnd = random.Random(14)
    scored = [(q, d, rnd.choice([1.0, 2.5, 3.0])) for q in range(20) for d in range(60) if rnd.random() < 0.7]
    gold = [(q, d) for q in range(22) for d in rnd.sample(range(70), 3)]
    order = {q: [d for _, d in sorted((-s, d) for x, d, s in scored if x == q)] for q in range(22)}
    want = {q: min((order[q].index(d) + 1 for x, d in gold if x == q and d in order[q]), default=None) for q in range(22)}
    got = first_ranks(spark.createDataFrame(gold, "query_id long, doc_id long"), spark.createDataFrame(scored, "query_id long, doc_id long, score double"))
    assert {r["query_id"]: r["first"] for r in got.collect()} == want


def test_sign_flips_by_draw_come_near_all_flips(spark):
    rnd = random.Random(15)
    rows = spark.createDataFrame([(k, rnd.choice([-2.0, -1.0, 1.0, 3.0])) for k in range(13)], "k long, d double").repartition(3)
    exact, drawn = sign_flip(rows, "d").first(), sign_flip(rows, "d", exact_most=2, flips=20_000).first()
    assert exact["clusters"] == drawn["clusters"] == 13 and abs(exact["p"] - drawn["p"]) < 0.02
    assert drawn == sign_flip(rows.repartition(5), "d", exact_most=2, flips=20_000).first()


def test_streamed_folds_on_one_hot_group(spark):
    rnd = random.Random(16)
    items = [(None if k % 9 == 0 else 1, k, rnd.randrange(1, 9)) for k in range(3000)]
    df = spark.createDataFrame(items, "g long, id long, cost long").repartition(6)
    taken, page = {}, {}
    for g, k, c in items:
        if taken.get(g, 0) + c <= 500:
            taken[g] = taken.get(g, 0) + c
            page.setdefault("taken", []).append((g, k))
    assert sorted(map(tuple, filled(df, ["g"], 500, F.col("id")).collect()), key=str) == sorted(page["taken"], key=str)
    used, at, want = {}, {}, []
    for g, k, c in items:
        if used.get(g, 0) + c > 20:
            used[g], at[g] = 0, at.get(g, 0) + 1
        used[g] = used.get(g, 0) + c
        want.append((g, k, at.get(g, 0)))
    assert sorted(map(tuple, paged(df, ["g"], 20, "id").collect()), key=str) == sorted(want, key=str)


def test_row_numbers_of_hot_and_null_groups(spark):
    rnd = random.Random(17)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(40), k) for k in range(4000)]
    got = row_numbers(spark.createDataFrame(rows, "g string, x long, k long").repartition(6), ["g"], F.desc("x"), F.col("k")).collect()
    want, seen = {}, {}
    for g, x, k in sorted(rows, key=lambda r: (-r[1], r[2])):
        seen[g] = want[k] = seen.get(g, 0) + 1
    assert {r["k"]: r["rank"] for r in got} == want and len(got) == 4000
    assert row_numbers(spark.createDataFrame([], "g string, x long"), ["g"], F.col("x")).count() == 0
    assert [r["rank"] for r in row_numbers(spark.range(9).toDF("x"), [], F.desc("x")).orderBy("x").collect()] == list(range(9, 0, -1))


def plain(v, at_least, earlier=None):
    """Pairs a < b of one tenant by numpy alone."""
    rows = [r for r in v.collect() if r["v"] is not None]
    m = np.array([r["v"] for r in rows])
    c = m @ m.T
    return {(rows[i]["id"], rows[j]["id"]): round(float(c[i, j]), 6) for i in range(len(rows)) for j in range(len(rows)) if rows[i]["id"] < rows[j]["id"] and rows[i]["tenant"] == rows[j]["tenant"] and round(float(c[i, j]), 6) >= at_least}


def shuffled_rows(df):
    """The rows that the query's exchanges write."""
    df.collect()
    plan, n = df._jdf.queryExecution().executedPlan(), 0
    walk = [plan]
    while walk:
        p = walk.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            walk.append(p.executedPlan())
            continue
        if "QueryStage" in p.nodeName():
            walk.append(p.plan())
        if p.nodeName() == "Exchange":
            n += p.metrics().apply("shuffleRecordsWritten").value()
        walk += [p.children().apply(k) for k in range(p.children().size())]
    return n


def test_hyperplane_pairs_do_not_shuffle_buckets_or_candidates(spark, monkeypatch):
    v = vectors(spark)
    for block in (16384, 37):
        monkeypatch.setattr("stratamem.operators.retrieval.BLOCK", block)
        pairs = similarity.similar_pairs_lsh(v, 0.84, recall=1 - 1e-9)
        assert {(r["a"], r["b"]): r["cosine"] for r in pairs.collect()} == plain(v, 0.84)
    monkeypatch.setattr("stratamem.operators.retrieval.BLOCK", 16384)
    assert shuffled_rows(similarity.similar_pairs_lsh(v, 0.84, recall=1 - 1e-9)) < 10 * 601


def test_hyperplane_neighbours_do_not_shuffle_buckets(spark):
    v = vectors(spark)
    near = similarity.earlier_neighbours(v, 0.84, 3, recall=1 - 1e-9)
    want = {}
    for (a, b), c in sorted(plain(v, 0.84).items(), key=lambda x: (-x[1], x[0][0])):
        if sum(q == b for q, _ in want) < 3:
            want[b, a] = c
    assert {(r["query_id"], r["id"]): r["cosine"] for r in near.collect()} == want
    assert shuffled_rows(near) < 10 * 601 + len(plain(v, 0.84))


def test_clusters_leave_links_in_proportion_to_vectors(spark, monkeypatch):
    v = vectors(spark).where("v IS NOT NULL").withColumn("v", F.when(F.col("id") < 400, F.array(*[F.lit(1.0 if k == 0 else 0.0) for k in range(32)])).otherwise(F.col("v")))
    v = v.withColumn("tenant", F.lit(1).cast("long"))
    asked = []
    monkeypatch.setattr(similarity, "connected", lambda e: asked.append(e) or connected(e))
    for block in (16384, 100):
        monkeypatch.setattr("stratamem.operators.retrieval.BLOCK", block)
        got = {tuple(r) for r in similarity.similar_clusters(v, 0.84, recall=1 - 1e-9).collect()}
        assert got == {tuple(r) for r in connected(similar_pairs(v, 0.84).select("a", "b")).collect()}
        blocks = -(-600 // block)
        assert asked[-1].count() <= 600 * (blocks + 2) and len(plain(v, 0.84)) > 79_000
        assert shuffled_rows(asked[-1]) < 10 * 601 * blocks
