"""Statistics over paired verdicts: exact tests, intervals, clustered permutation, folds, regression."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.operators.quantiles import at_ranks, row_numbers
from stratamem.operators.retrieval import HYBRID, candidates
from stratamem.plans.fixtures import Registry, Tables
from stratamem.sources.tables import kept

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stirling(x: Column) -> Column:
    """What ln x! exceeds Stirling's first terms by, x > 0."""
    few = F.log(F.factorial(F.least(x, F.lit(15)).cast("int")).cast("double")) - ((x + 0.5) * F.log(x) - x + 0.5 * float(np.log(2 * np.pi)))
    return F.when(x < 16, few).otherwise(1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))))


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, x > 0."""
    return x * F.log1p((x - mean) / mean) - (x - mean)


def log_binomial(n: Column, k: Column, p: float) -> Column:
    """ln of the probability of k hits in n by the saddle-point form, so that no large numbers cancel at any n."""
    q, left = 1 - p, n - k
    inner = _stirling(n) - _stirling(k) - _stirling(left) - _deviance(k, n * p) - _deviance(left, n * q) + 0.5 * F.log(n / (float(2 * np.pi) * k * left))
    return F.when(k <= 0, n * float(np.log1p(-p))).when(k >= n, n * float(np.log(p))).otherwise(inner)


def _tail(n: Column, k: Column, p: float, up: bool) -> Column:
    """Probability of k or fewer hits, or of k or more, for a k on that side of the mode: each term from the one before, down to where none counts."""
    odds = p / (1 - p)
    ratio = (lambda at: (n - at) / (at + 1) * odds) if up else (lambda at: at / (n - at + 1) / odds)
    # 24 deviations at least, beyond which a term is below 1e-100 of the first
    terms = F.least(n - k if up else k, 12 * F.ceil(F.sqrt(n)) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(s: Column, i: Column) -> Column:
        at = k + (i - 1) if up else k - (i - 1)
        return F.struct((s["sum"] + s["term"] * ratio(at)).alias("sum"), (s["term"] * ratio(at)).alias("term"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    return F.exp(log_binomial(n, k, p)) * F.aggregate(steps, start, add, lambda s: s["sum"])


def binomial_tail(wins: Column, losses: Column) -> Column:
    """Exact two-sided McNemar p: twice the lower binomial tail at the smaller count, at most 1; 1 without discordant pairs.

    Work grows with the root of the pairs.
    """
    n, m = (wins + losses).cast("double"), F.least(wins, losses).cast("double")
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * _let(n, lambda n: _let(m, lambda m: _tail(n, m, 0.5, up=False)))))


def probability_ordered(n: Column, hits: Column, p: float) -> Column:
    """Exact two-sided binomial p: the probability of all outcomes no likelier than the one observed.

    These are a tail from the hits outwards, and one on the mode's other side whose edge is found by bisection.
    """

    def value(n: Column, h: Column) -> Column:
        mode = F.least(F.floor((n + 1) * p), n).cast("double")
        limit = log_binomial(n, h, p) + float(np.log1p(1e-7))
        low = h < mode

        def halve(s: Column, _i: Column) -> Column:
            # the edge is in (in_, out]: in_ is too likely, out is not
            mid = F.floor((s["in_"] + s["out"]) / 2).cast("double")
            ok = log_binomial(n, mid, p) <= s["limit"]
            move = F.abs(s["out"] - s["in_"]) > 1
            return F.struct(F.when(move & ~ok, mid).otherwise(s["in_"]).alias("in_"), F.when(move & ok, mid).otherwise(s["out"]).alias("out"), s["limit"].alias("limit"))

        def edge(up: bool) -> Column:
            out = n + 1 if up else F.lit(-1.0)
            start = F.struct(mode.alias("in_"), out.cast("double").alias("out"), limit.alias("limit"))
            return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, halve, lambda s: s["out"])

        above, below = edge(True), edge(False)
        upper = lambda k: F.when(k > n, F.lit(0.0)).otherwise(_tail(n, k, p, up=True))
        lower = lambda k: F.when(k < 0, F.lit(0.0)).otherwise(_tail(n, k, p, up=False))
        # two neighbours may be likeliest alike
        return F.when(log_binomial(n, mode, p) <= limit, F.lit(1.0)).when(low, lower(h) + _let(above, upper)).otherwise(upper(h) + _let(below, lower))

    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), _let(n.cast("double"), lambda n: _let(hits.cast("double"), lambda h: value(n, h)))))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a proportion."""
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def win_loss(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """wins (only a), losses (only b), ties and net of each group."""
    wins, losses = F.count_if(F.col(a) & ~F.col(b)), F.count_if(~F.col(a) & F.col(b))
    return pairs.groupBy(*by).agg(wins.alias("wins"), losses.alias("losses"), F.count_if(F.col(a) == F.col(b)).alias("ties"), (wins - losses).alias("net"))


WL = "wl AS (SELECT question_type, count(*) FILTER (a AND NOT b) AS w, count(*) FILTER (b AND NOT a) AS l, count(*) FILTER (a = b) AS t FROM results GROUP BY 1)"
LOGC = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


@R.add("eval01_mcnemar", WL + ", k AS (SELECT question_type, w, l, unnest(generate_series(0, least(w, l))) AS k FROM wl) SELECT question_type, round(least(1.0, 2 * sum(exp(" + LOGC.format(n="(w + l)", k="k") + " + (w + l) * ln(0.5)))), 6) AS p FROM k GROUP BY question_type, w, l")
def _(t: Tables) -> DataFrame:
    return win_loss(t.results, ["question_type"]).select("question_type", F.round(binomial_tail(F.col("wins"), F.col("losses")), 6).alias("p"))


@R.add("eval02_exact_binomial", WL + ", k AS (SELECT question_type, w + l AS n, w, unnest(generate_series(0, w + l)) AS k FROM wl), p AS (SELECT *, exp(" + LOGC.format(n="n", k="k") + " + k * ln(0.4) + (n - k) * ln(0.6)) AS pk, exp(" + LOGC.format(n="n", k="w") + " + w * ln(0.4) + (n - w) * ln(0.6)) AS p0 FROM k) SELECT question_type, round(least(1.0, sum(CASE WHEN pk <= p0 * (1 + 1e-7) THEN pk ELSE 0 END)), 6) AS p FROM p GROUP BY question_type")
def _(t: Tables) -> DataFrame:
    wl = win_loss(t.results, ["question_type"])
    return wl.select("question_type", F.round(probability_ordered(F.col("wins") + F.col("losses"), F.col("wins"), 0.4), 6).alias("p"))


@R.add("eval03_win_loss", WL + " SELECT question_type, w AS wins, l AS losses, t AS ties, w - l AS net FROM wl")
def _(t: Tables) -> DataFrame:
    return win_loss(t.results, ["question_type"])


MAJ = "m AS (SELECT question_id, question_type, arm, sum(correct::INT) * 2 > count(*) AS yes FROM repeats GROUP BY ALL), p AS (SELECT question_id, question_type, bool_or(yes) FILTER (arm = 'a') AS a, bool_or(yes) FILTER (arm = 'b') AS b FROM m GROUP BY ALL)"


def majority_pairs(repeats: DataFrame) -> DataFrame:
    votes = repeats.groupBy("question_id", "question_type", "arm").agg((F.count_if("correct") * 2 > F.count(F.lit(1))).alias("yes"))
    return votes.groupBy("question_id", "question_type").pivot("arm", ["a", "b"]).agg(F.bool_or("yes"))


@R.add("eval04_majority_pairs", MAJ + ", c AS (SELECT count(*) FILTER (a AND NOT b) AS w, count(*) FILTER (b AND NOT a) AS l FROM p), k AS (SELECT w, l, unnest(generate_series(0, least(w, l))) AS k FROM c) SELECT w AS wins, l AS losses, round(least(1.0, 2 * sum(exp(" + LOGC.format(n="(w + l)", k="k") + " + (w + l) * ln(0.5)))), 6) AS p FROM k GROUP BY w, l")
def _(t: Tables) -> DataFrame:
    wl = win_loss(majority_pairs(t.repeats), [])
    return wl.select("wins", "losses", F.round(binomial_tail(F.col("wins"), F.col("losses")), 6).alias("p"))


def sign_flip(clusters: DataFrame, value: str, exact_most: int = 16, flips: int = 100_000, seed: int = 7) -> DataFrame:
    """p of the total under flips of whole clusters' signs: all 2^k of at most exact_most clusters, else seeded ones.

    clusters: one row a cluster, told by its columns. Few clusters are numbered and sent to the flips. Of more, each task adds up
    the flipped values of its own clusters for all flips, with signs from the seed and a hash of the row, so what
    is shuffled is a row a flip and task.
    """
    k = clusters.count()
    spark = clusters.sparkSession
    total = abs(clusters.agg(F.sum(value).alias("s")).first()["s"] or 0.0)
    if k <= exact_most:
        numbered = clusters.withColumn("i", (F.row_number().over(W.orderBy(value)) - 1).cast("int"))  # exact_most rows at most
        sign = F.when(F.expr("shiftright(id, i) & 1") == 1, 1).otherwise(-1)
        sums = spark.range(1 << k).crossJoin(F.broadcast(numbered)).groupBy("id").agg(F.sum(F.col(value) * sign).alias("x"))
    else:

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(flips)
            for pdf in batches:
                for x, h in zip(pdf["x"], pdf["h"], strict=True):
                    rng = np.random.Generator(np.random.Philox(key=[seed, int(h) & (2**64 - 1)]))
                    out += float(x) * (2.0 * rng.integers(0, 2, flips) - 1)
            yield pd.DataFrame({"id": np.arange(flips), "x": out})

        rows = clusters.select(F.col(value).cast("double").alias("x"), F.xxhash64(*clusters.columns).alias("h"))
        sums = rows.mapInPandas(add, "id long, x double").groupBy("id").agg(F.sum("x").alias("x"))
    hits = sums.agg(F.count_if(F.abs("x") >= F.lit(total) - 1e-9).alias("h"), F.count(F.lit(1)).alias("n"))
    p = F.col("h") / F.col("n") if k <= exact_most else (F.col("h") + 1) / (F.col("n") + 1)
    return hits.select(F.lit(k).cast("long").alias("clusters"), F.round(p, 9).alias("p"))


@R.add("eval05_sign_flip", "c AS (SELECT question_type, sum(a::INT - b::INT)::DOUBLE AS d FROM results GROUP BY 1), n AS (SELECT d, row_number() OVER (ORDER BY d, question_type) - 1 AS i FROM c), f AS (SELECT g AS id, abs(sum(d * CASE WHEN (g >> i::INT) & 1 = 1 THEN 1 ELSE -1 END)) AS s FROM n, generate_series(0, (1 << (SELECT count(*) FROM c)::INT) - 1) x(g) GROUP BY g) SELECT (SELECT count(*) FROM c) AS clusters, round(avg((s >= (SELECT abs(sum(d)) FROM c) - 1e-9)::INT), 9) AS p FROM f")
def _(t: Tables) -> DataFrame:
    c = t.results.groupBy("question_type").agg(F.sum(F.col("a").cast("int") - F.col("b").cast("int")).cast("double").alias("d"))
    return sign_flip(c, "d")


@R.add("eval06_design_effect", "c AS (SELECT question_type, count(*) AS m, avg(a::INT) AS acc FROM results GROUP BY 1) SELECT question_type, round(1 + (m - 1) * 0.1::DOUBLE, 9) AS deff, round(1.96 * sqrt(m * acc * (1 - acc) * (1 + (m - 1) * 0.1)) / m, 9) AS detectable FROM c")
def _(t: Tables) -> DataFrame:
    c = t.results.groupBy("question_type").agg(F.count(F.lit(1)).alias("m"), F.avg(F.col("a").cast("int")).alias("acc"))
    deff = 1 + (F.col("m") - 1) * 0.1
    return c.select("question_type", F.round(deff, 9).alias("deff"), F.round(1.96 * F.sqrt(F.col("m") * F.col("acc") * (1 - F.col("acc")) * deff) / F.col("m"), 9).alias("detectable"))


@R.add("eval07_bootstrap")
def _(t: Tables) -> DataFrame:
    """Bounds of the mean over 10,000 resamples.

    A resample of n verdicts of which h are right is its number of right ones, which is binomial: it is drawn
    as one number, whatever n is. Draws are made by blocks of replicates, each from its own seed.
    """
    counts = t.results.groupBy("question_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("a").alias("h"))
    return bootstrap(counts, "question_type", 10_000, 11)


def bootstrap(counts: DataFrame, by: str, replicates: int, seed: int, share: float = 0.95) -> DataFrame:
    """by, lower, upper: the middle `share` of the means of resamples, from counts (by, n, h)."""
    block = 500

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                rng = np.random.Generator(np.random.Philox(key=[seed, zlib.crc32(f"{x[0]}:{x.block}".encode())]))
                hits = rng.binomial(x.n, x.h / x.n, min(block, replicates - x.block * block))
                yield pd.DataFrame({by: x[0], "mean": hits / x.n})

    blocks = counts.select(by, "n", "h", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // block) - 1))).alias("block"))
    means = blocks.mapInPandas(draw, f"{by} {counts.schema[by].dataType.simpleString()}, mean double")
    cut = round((1 - share) / 2 * replicates)
    return at_ranks(kept(means, "means"), [by], "mean", {"lower": lambda n: F.lit(cut + 1), "upper": lambda n: n - cut})


@R.add("eval08_wilson", "c AS (SELECT question_type, count(*)::DOUBLE AS n, avg(a::INT) AS p FROM results GROUP BY 1) SELECT question_type, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS lower, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS upper FROM c")
def _(t: Tables) -> DataFrame:
    c = t.results.groupBy("question_type").agg(F.count_if("a").alias("h"), F.count(F.lit(1)).alias("n"))
    lo, hi = wilson(F.col("h"), F.col("n"))
    return c.select("question_type", F.round(lo, 9).alias("lower"), F.round(hi, 9).alias("upper"))


@R.add("eval09_spearman", "r AS (SELECT p_size % 7 AS g, row_number() OVER (PARTITION BY p_size % 7 ORDER BY p_size, p_partkey) AS x, row_number() OVER (PARTITION BY p_size % 7 ORDER BY p_retailprice, p_partkey) AS y FROM part) SELECT g, round(corr(x, y), 9) AS rho FROM r GROUP BY g", views=True)
def _(t: Tables) -> DataFrame:
    parts = t.raw("part").select((F.col("p_size") % 7).alias("g"), "p_size", "p_retailprice", "p_partkey")
    x = row_numbers(parts, ["g"], F.col("p_size"), F.col("p_partkey"), name="x")
    r = row_numbers(x, ["g"], F.col("p_retailprice"), F.col("p_partkey"), name="y")
    return r.groupBy("g").agg(F.round(F.corr("x", "y"), 9).alias("rho"))


def ridge(df: DataFrame, target: str, features: list[str], alpha: float = 1.0) -> tuple[list[float], list[float], list[float]]:
    """Weights (intercept first), means and deviations of a ridge fit on standardised features.

    One aggregation gives all sums of products; what reaches the driver has (features + 2) squared
    numbers, however many rows there are.
    """
    names = [*features, target]
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)]]
    sums += [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    got = df.agg(*sums).first()
    k, n = len(features), got["n"] or 1
    s = np.array([got[f"s{i}"] or 0.0 for i in range(k + 1)])
    p = np.array([[got[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)])
    mean = s / n
    cov = p - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diagonal(cov)[:k] / n, 0))
    sd = np.where(sd < 1e-9, 1.0, sd)
    w = np.linalg.solve(cov[:k, :k] / np.outer(sd, sd) + alpha * np.eye(k), cov[:k, k] / sd)
    return [float(mean[k]), *map(float, w)], [float(x) for x in mean[:k]], [float(x) for x in sd]


def predicted(features: list[str], fit: tuple[list[float], list[float], list[float]]) -> Column:
    w, mean, sd = fit
    out = F.lit(w[0])
    for c, b, m, s in zip(features, w[1:], mean, sd, strict=True):
        out = out + F.lit(b) * (F.col(c).cast("double") - m) / s
    return out


@R.add("eval10_ridge", "z AS (SELECT (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS x, CAST(p_retailprice AS DOUBLE) AS y, p_partkey FROM part), g AS (SELECT sum(x * y) / (sum(x * x) + 1) AS b, avg(y) AS m FROM z) SELECT p_partkey, round(m + b * x, 4) AS predicted FROM z, g")
def _(t: Tables) -> DataFrame:
    part = t.raw("part")
    return part.select("p_partkey", F.round(predicted(["p_size"], ridge(part, "p_retailprice", ["p_size"])), 4).alias("predicted"))


@R.add("eval11_grouped_folds")
def _(t: Tables) -> DataFrame:
    """Error of the ridge fit and of the mean, in five folds over whole brands."""
    part = _with_fold(t.raw("part"), "p_brand", 5)
    out = None
    for fold in range(5):
        train, test = part.where(F.col("fold") != fold), part.where(F.col("fold") == fold)
        fit = ridge(train, "p_retailprice", ["p_size"])
        y = F.col("p_retailprice").cast("double")
        row = test.agg(F.lit(fold).alias("fold"), F.sqrt(F.avg((y - predicted(["p_size"], fit)) ** 2)).alias("rmse"), F.sqrt(F.avg((y - F.lit(fit[0][0])) ** 2)).alias("rmse_mean"))
        out = row if out is None else out.union(row)
    return out


def _with_fold(df: DataFrame, group: str, folds: int) -> DataFrame:
    """Folds of whole groups, by a hash of the group's name."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), group), F.lit(folds)).cast("int"))


@R.add("eval13_influence_label", "SELECT question_id, CASE WHEN a AND NOT b THEN 1.0 WHEN NOT a AND b THEN -1.0 WHEN a THEN 0.3 ELSE 0.0 END::DOUBLE AS utility FROM results")
def _(t: Tables) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return t.results.select("question_id", F.when(a & ~b, 1.0).when(~a & b, -1.0).when(a, 0.3).otherwise(0.0).alias("utility"))


@R.add("eval14_ablation_design", "t3 AS (SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, id) AS rn FROM memories) WHERE rn <= 3) SELECT x.user_id, x.id AS removed, string_agg(y.id::VARCHAR, ',' ORDER BY y.id) AS without FROM t3 x JOIN t3 y ON x.user_id = y.user_id AND x.id <> y.id GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    top = t.memories.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("importance"), "id"))).where("rn <= 3")
    lists = top.groupBy("user_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    each = lists.select("user_id", "ids", F.explode("ids").alias("removed"))
    return each.select("user_id", "removed", F.array_join(F.array_remove("ids", F.col("removed")).cast("array<string>"), ",").alias("without"))


@R.add("eval15_agreement", "SELECT count(*) AS n, count(*) FILTER (a = b) AS agree, count(*) FILTER (a AND NOT b) AS lenient, count(*) FILTER (b AND NOT a) AS strict FROM results")
def _(t: Tables) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return t.results.agg(F.count(F.lit(1)).alias("n"), F.count_if(a == b).alias("agree"), F.count_if(a & ~b).alias("lenient"), F.count_if(b & ~a).alias("strict"))


@R.add("eval16_unanimous_reuse", "SELECT question_id, arm, CASE WHEN count(DISTINCT correct) = 1 THEN bool_and(correct) END AS reused FROM repeats GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return t.repeats.groupBy("question_id", "arm").agg(F.when(F.count_distinct("correct") == 1, F.bool_and("correct")).alias("reused"))


@R.add("eval21_mean_net", "m AS (SELECT question_id, question_type, avg(correct::INT) FILTER (arm = 'a') - avg(correct::INT) FILTER (arm = 'b') AS net FROM repeats GROUP BY ALL) SELECT coalesce(question_type, 'all') AS question_type, round(sum(net), 6) AS net, count(*) FILTER (net > 0) AS up, count(*) FILTER (net < 0) AS down FROM m GROUP BY ROLLUP (question_type)")
def _(t: Tables) -> DataFrame:
    m = t.repeats.groupBy("question_id", "question_type").pivot("arm", ["a", "b"]).agg(F.avg(F.col("correct").cast("int")))
    m = m.withColumn("d", F.col("a") - F.col("b"))
    out = m.rollup("question_type").agg(F.round(F.sum("d"), 6).alias("net"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    return out.withColumn("question_type", F.coalesce("question_type", F.lit("all")))


@R.add("eval22_control_majority", MAJ + " SELECT question_type, count(*) FILTER (a) AS control, count(*) FILTER (b AND NOT a) - count(*) FILTER (a AND NOT b) AS net FROM p GROUP BY question_type")
def _(t: Tables) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return majority_pairs(t.repeats).groupBy("question_type").agg(F.count_if(a).alias("control"), (F.count_if(b & ~a) - F.count_if(a & ~b)).alias("net"))


@R.add("eval23_difference_interval", WL + ", c AS (SELECT question_type, w / (w + l + t)::DOUBLE AS pw, l / (w + l + t)::DOUBLE AS pl, (w + l + t)::DOUBLE AS n FROM wl), z AS (SELECT *, 2.2414::DOUBLE AS z FROM c), b AS (SELECT question_type, (pw + z*z/(2*n) - z * sqrt(pw*(1-pw)/n + z*z/(4*n*n))) / (1 + z*z/n) AS wlo, (pw + z*z/(2*n) + z * sqrt(pw*(1-pw)/n + z*z/(4*n*n))) / (1 + z*z/n) AS whi, (pl + z*z/(2*n) - z * sqrt(pl*(1-pl)/n + z*z/(4*n*n))) / (1 + z*z/n) AS llo, (pl + z*z/(2*n) + z * sqrt(pl*(1-pl)/n + z*z/(4*n*n))) / (1 + z*z/n) AS lhi FROM z) SELECT question_type, round(wlo - lhi, 9) AS lower, round(whi - llo, 9) AS upper FROM b")
def _(t: Tables) -> DataFrame:
    wl = win_loss(t.results, ["question_type"]).withColumn("n", F.col("wins") + F.col("losses") + F.col("ties"))
    (wlo, whi), (llo, lhi) = wilson(F.col("wins"), F.col("n"), 2.2414), wilson(F.col("losses"), F.col("n"), 2.2414)
    return wl.select("question_type", F.round(wlo - lhi, 9).alias("lower"), F.round(whi - llo, 9).alias("upper"))


@R.add("eval24_flip_rate", "x AS (SELECT question_id, question_type, arm, bool_or(correct) FILTER (repeat = 0) AS c0, bool_or(correct) FILTER (repeat = 1) AS c1 FROM repeats GROUP BY ALL), r AS (SELECT question_type, avg((c0 <> c1)::INT) AS f, count(*) AS n FROM x GROUP BY 1), p AS (SELECT question_type, n, (1 - sqrt(greatest(0.0, 1 - 2 * f))) / 2 AS p FROM r), m AS (SELECT question_type, n, 3 * p * p * (1 - p) + p * p * p AS m FROM p) SELECT question_type, round(2 * m * (1 - m), 9) AS majority_flip, round(2 * sqrt(2 * m * (1 - m) * n), 9) AS detectable FROM m")
def _(t: Tables) -> DataFrame:
    """How often two majorities of three would differ, from how often two single runs did, and the difference that this hides."""
    run = lambda k: F.bool_or(F.when(F.col("repeat") == k, F.col("correct")))
    x = t.repeats.groupBy("question_id", "question_type", "arm").agg((run(0) != run(1)).cast("int").alias("flip"))
    r = x.groupBy("question_type").agg(F.avg("flip").alias("f"), F.count(F.lit(1)).alias("n"))
    p = (1 - F.sqrt(F.greatest(F.lit(0.0), 1 - 2 * F.col("f")))) / 2
    m = r.withColumn("p", p).withColumn("m", 3 * F.col("p") ** 2 * (1 - F.col("p")) + F.col("p") ** 3)
    rate = 2 * F.col("m") * (1 - F.col("m"))
    return m.select("question_type", F.round(rate, 9).alias("majority_flip"), F.round(2 * F.sqrt(rate * F.col("n")), 9).alias("detectable"))


@R.add("eval12_utility_features", HYBRID + """, w AS (SELECT s.query_id, s.id, cosine, lexical, lex, row_number() OVER (PARTITION BY s.query_id ORDER BY cosine DESC, s.id) AS rank, m.importance, m.strength, m.token_count, date_diff('day', CAST(m.observed_at AS DATE), DATE '2024-02-01') AS age, m.source_role = 'user' AS said, m.scope = 'profile' AS profile, m.status = 'active' AS active, m.valid_to IS NOT NULL AS ended, string_split(m.content, ' ') AS ws FROM s JOIN memories m ON m.id = s.id),
d AS (SELECT a.query_id, a.id, max(len(list_intersect(a.ws, b.ws)) / len(a.ws)) AS repeated FROM w a JOIN w b ON b.query_id = a.query_id AND b.id <> a.id GROUP BY ALL)
SELECT w.query_id, w.id, cosine, lexical, round(lex, 9) AS lex, rank, round(importance, 9) AS importance, round(strength, 9) AS strength, token_count, age, said, profile, active, ended, coalesce(repeated, 0) AS repeated FROM w LEFT JOIN d ON d.query_id = w.query_id AND d.id = w.id""")
def _(t: Tables) -> DataFrame:
    """Thirteen features of each candidate of a query; `repeated` is the greatest share of its words that another candidate has."""
    m = t.memories.select(
        "id", F.round("importance", 9).alias("importance"), F.round("strength", 9).alias("strength"), "token_count", F.datediff(F.lit("2024-02-01").cast("date"), "observed_at").cast("long").alias("age"),
        (F.col("source_role") == "user").alias("said"), (F.col("scope") == "profile").alias("profile"), (F.col("status") == "active").alias("active"), F.col("valid_to").isNotNull().alias("ended"), F.split("content", " ").alias("ws"),
    )
    w = candidates(t).join(m, "id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "id")).cast("long"))
    other = w.select("query_id", F.col("id").alias("b"), F.col("ws").alias("bs"))  # a query has 40 candidates at most
    d = w.join(other, "query_id").where("id <> b").groupBy("query_id", "id").agg(F.max(F.size(F.array_intersect("ws", "bs")) / F.size("ws")).alias("repeated"))
    out = w.join(d, ["query_id", "id"], "left")
    return out.select("query_id", "id", "cosine", "lexical", F.round("lex", 9).alias("lex"), "rank", "importance", "strength", "token_count", "age", "said", "profile", "active", "ended", F.coalesce("repeated", F.lit(0.0)).alias("repeated"))
