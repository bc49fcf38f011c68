"""Similarity joins that look at few pairs: random hyperplanes for vectors, rare words for containment."""

from __future__ import annotations

import math
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.operators import retrieval
from stratamem.operators.measures import content_words
from stratamem.operators.retrieval import connected, top_k, unit
from stratamem.operators.vectors import Links, Met, Pairs, Rows, meeting
from stratamem.plans.fixtures import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

SEED = 20
#: Tables that a search may use.
MOST_TABLES = 64


def lsh_shape(at_least: float, recall: float) -> tuple[int, int]:
    """Bits and tables that find a pair at the threshold with probability `recall` and meet the fewest pairs at random.

    A bit agrees with probability 1 - angle / pi. Buckets that differ in one bit are probed too, so a
    table finds a pair if no more than one bit differs, and meets bits + 1 of 2^bits buckets.
    """
    agrees = 1 - math.acos(at_least) / math.pi
    shapes = []
    for bits in range(2, 25):
        found = agrees**bits + bits * agrees ** (bits - 1) * (1 - agrees)
        tables = 1 if found >= recall else math.ceil(math.log(1 - recall) / math.log(1 - found))
        met_at_random = tables * (bits + 1) / 2**bits
        if tables <= MOST_TABLES and met_at_random < 0.5:
            shapes.append((met_at_random, bits, tables))
    if not shapes:
        raise ValueError("the threshold is too low for hyperplanes; compare all pairs (similar_pairs)")
    return min(shapes)[1:]


class Sketch:
    """Buckets of vectors in several tables of random hyperplanes. The planes come from the seed, so every task has the same ones."""

    def __init__(self, bits: int, tables: int, seed: int = SEED):
        self.bits, self.tables, self.seed = bits, tables, seed
        self.planes = None
        self.flips = (1 << np.arange(bits)).astype(np.int64)

    def codes(self, v: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        if self.planes is None:
            self.planes = np.random.default_rng(self.seed).standard_normal((v.shape[1], self.tables * self.bits))
        out = np.empty((len(v), self.tables), np.int64)
        for k in range(0, len(v), 2048):
            on = (v[k : k + 2048] @ self.planes > 0).reshape(-1, self.tables, self.bits)
            out[k : k + 2048] = on @ self.flips
        return out

    def begin(self, y: Rows) -> None:
        """Orders a block of vectors by bucket, in each table."""
        codes = self.codes(y.v).T
        self.n = len(y)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)
        self.starts = None
        if self.bits <= 14:  # else looked up in order
            self.starts = np.zeros((self.tables, (1 << self.bits) + 1), np.int64)
            for t in range(self.tables):
                np.cumsum(np.bincount(codes[t], minlength=1 << self.bits), out=self.starts[t, 1:])

    def seen(self, x: Rows, whole: bool = False) -> np.ndarray | None:
        """A cell for each of x and each of the block: whether they share a bucket of a table, but for one bit at most.

        None where vectors are so alike that buckets hold more pairs than there are, unless asked for as a whole.
        """
        codes, probes, total = self.codes(x.v), [], 0
        for t in range(self.tables):
            at = codes[:, t, None] ^ np.concatenate([[0], self.flips])
            low, high = (self.starts[t][at], self.starts[t][at + 1]) if self.starts is not None else (np.searchsorted(self.sorted[t], at), np.searchsorted(self.sorted[t], at, side="right"))
            probes.append((low, high - low))
            total += int((high - low).sum())
        if total > len(x) * self.n and not whole:
            return None
        out = np.zeros(len(x) * self.n, bool)
        for t, (low, many) in enumerate(probes):
            row = np.repeat(np.arange(len(x)) * self.n, many.sum(axis=1))
            flat = many.ravel()
            place = np.repeat(low.ravel() - np.cumsum(flat) + flat, flat) + np.arange(len(row))
            out[row + self.order[t][place]] = True
        return out.reshape(len(x), self.n)


def near_candidates(vectors: DataFrame, at_least: float, recall: float = 0.999, seed: int = SEED) -> DataFrame:
    """tenant, a, b (a < b): pairs of one tenant that share a bucket, once each."""
    kind = dict(vectors.dtypes)["id"]
    shape = lsh_shape(at_least, recall)
    return _sketched(vectors, lambda: Met(at_least, Sketch(*shape, seed)), f"a {kind}, b {kind}")


def similar_pairs_lsh(vectors: DataFrame, at_least: float, recall: float = 0.999, seed: int = SEED) -> DataFrame:
    """a, b, cosine: pairs of one tenant at or above the threshold, found by hyperplanes and then compared exactly.

    vectors: tenant, id, v (unit). No pair below the threshold is returned; one at it is missed with probability
    1 - recall, one above it less often. For a low threshold or all pairs whatever happens use similar_pairs.
    Vectors meet in blocks, two of them in one task only, and what shares a bucket is found and compared there: neither
    buckets nor candidates are shuffled. Where buckets hold so many that a product of the blocks is cheaper, it is made.
    """
    kind = dict(vectors.dtypes)["id"]
    shape = lsh_shape(at_least, recall)
    return _sketched(vectors, lambda: Pairs(at_least, Sketch(*shape, seed)), f"a {kind}, b {kind}, cosine double").drop("tenant")


def _sketched(vectors: DataFrame, work, columns: str) -> DataFrame:
    rows = vectors.where("v IS NOT NULL").select("tenant", F.col("id").alias("_id"), F.col("v").alias("_v"))
    return meeting(rows, None, ["tenant"], retrieval.BLOCK, work, columns)


def similar_clusters(vectors: DataFrame, at_least: float, recall: float = 0.999, seed: int = SEED) -> DataFrame:
    """id, root: components of the pairs of one tenant at or above the threshold; ids alone in theirs are left out.

    The pairs are those of similar_pairs_lsh. A task joins what it finds into components at once, so that very many
    vectors that are alike leave links in proportion to their number, not to their pairs.
    """
    kind = dict(vectors.dtypes)["id"]
    shape = lsh_shape(at_least, recall)
    links = _sketched(vectors, lambda: Links(at_least, Sketch(*shape, seed)), f"a {kind}, b {kind}")
    return connected(links.select("a", "b"))


def restated(t: Tables) -> DataFrame:
    """tenant, id, v: each vector, and beside it one that says about the same: itself with three tenths of its own rotation by seven places."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    turned = F.zip_with(e, F.concat(F.slice(e, 8, 1000), F.slice(e, 1, 7)), lambda a, b: a + b * 0.3)
    both = F.explode(F.array(F.struct((F.col("id") * 2).alias("id"), e.alias("e")), F.struct((F.col("id") * 2 + 1).alias("id"), turned.alias("e"))))
    return t.vectors.select("tenant", both.alias("x")).select("tenant", "x.id", unit(F.col("x.e")).alias("v"))


#: The same vectors in SQL.
TWO = """w AS (SELECT id, tenant, embedding::DOUBLE[] AS e FROM vectors),
two AS (SELECT tenant, id * 2 AS id, e FROM w UNION ALL SELECT tenant, id * 2 + 1, list_transform(e, lambda x, i: x + list_concat(e[8:], e[:7])[i] * 0.3::DOUBLE) FROM w)"""


@R.add("join11_hyperplane_pairs", TWO + """ SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.e, y.e), 6) AS cosine FROM two x JOIN two y ON x.tenant = y.tenant AND x.id < y.id WHERE round(list_cosine_similarity(x.e, y.e), 6) >= 0.84""")
def _(t: Tables) -> DataFrame:
    return similar_pairs_lsh(restated(t), 0.84, recall=1 - 1e-9)


def earlier_neighbours(vectors: DataFrame, at_least: float, k: int, recall: float = 0.999) -> DataFrame:
    """query_id, id, cosine, rank: of each vector the k nearest of its tenant with a lesser id, at or above the threshold; found by hyperplanes, compared exactly."""
    pairs = similar_pairs_lsh(vectors, at_least, recall)
    return top_k(pairs.select(F.col("b").alias("query_id"), F.col("a").alias("id"), "cosine"), ["query_id"], k, F.desc("cosine"), F.col("id"))


@R.add("join13_hyperplane_neighbours", TWO + """ SELECT query_id, id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM (SELECT x.id AS query_id, y.id AS id, round(list_cosine_similarity(x.e, y.e), 6) AS cosine FROM two x JOIN two y ON x.tenant = y.tenant AND y.id < x.id) WHERE cosine >= 0.84) WHERE rank <= 3""")
def _(t: Tables) -> DataFrame:
    return earlier_neighbours(restated(t), 0.84, 3, recall=1 - 1e-9)


@R.add("life04_hyperplane_clusters", TWO + """, e AS (SELECT x.id AS a, y.id AS b FROM two x JOIN two y ON x.tenant = y.tenant AND x.id <> y.id WHERE round(list_cosine_similarity(x.e, y.e), 6) >= 0.84),
r AS (SELECT * FROM (WITH RECURSIVE c AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id) SELECT id, min(root) AS root FROM c GROUP BY id)) SELECT id, root FROM r""")
def _(t: Tables) -> DataFrame:
    return similar_clusters(restated(t), 0.84, recall=1 - 1e-9)


def contained(docs: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """doc_id, item_id, shared: documents that hold at least `share` of the distinct words of an item.

    Such a document holds one of any n - ceil(share n) + 1 words of the item, so also one of its rarest:
    only these are joined on, and the pairs found are compared whole. What words are rare the documents
    themselves say. An item without words is held by none.
    """
    d = docs.select("doc_id", content_words("text").alias("ws"))
    b = items.select("item_id", content_words("text").alias("asked")).where(F.size("asked") > 0)
    words = b.select("item_id", F.size("asked").alias("n"), F.explode("asked").alias("w"))
    held = d.select(F.explode("ws").alias("w")).join(words.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    needed = F.ceil(F.lit(share) * F.col("n") - 1e-9)
    rare = words.join(held, "w", "left").withColumn("at", F.row_number().over(W.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "w")))
    prefix = rare.where((F.col("at") <= F.col("n") - needed + 1) & F.col("df").isNotNull()).select("item_id", "w")
    pairs = d.select("doc_id", F.explode("ws").alias("w")).join(prefix, "w").select("doc_id", "item_id").distinct()
    both = pairs.join(b, "item_id").join(d, "doc_id").withColumn("shared", F.size(F.array_intersect("ws", "asked")).cast("long"))
    return both.where(F.col("shared") >= F.lit(share) * F.size("asked")).select("doc_id", "item_id", "shared")
