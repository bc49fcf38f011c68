"""Near duplicates by ProbMinHash: weighted shingles, banding, exact verification, components.

1. Every text gets a signature of its five-word shingles, weighted 1 + ln of their number (ProbMinHash: an
   element arrives by a Poisson process whose rate is its weight, each arrival falls on a random register, and
   arrivals stop once no register can still change). Two signatures agree at a register with the
   probability Jaccard likeness of the weighted shingles. A text that repeats shingles gets a second one in which
   all weights are one, whose registers agree with the Jaccard likeness of the sets; for all other texts the two
   are the same.
2. Equal texts are folded into one, before anything is compared.
3. Registers are cut into bands. Texts that agree on a band of either signature are candidates; each is held
   against one centre of its bucket. Where a bucket then still holds several classes, the texts outside its
   largest class are compared with all others in blocks, and a block reports a spanning forest of its links
   rather than all of them.
4. A pair is a link when the probability Jaccard likeness of its weighted shingles, or the Jaccard likeness of its
   shingle sets, worked out exactly, is 0.8 or more: neither does a shingle's number of repeats part texts whose sets
   are alike, nor do rare odd shingles part texts that mostly say the same again and again.
5. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.llm import common
from stratamem.llm.wordhash import Words, grams, mix, slices

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 6
#: Share of equal registers below which a pair is no link: six standard deviations under the threshold.
LIKELY = 0.645
#: Texts of a block, and elements in a slice of an incidence matrix.
BLOCK, SLICE = 384, 4096


def doc_shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text index, shingle hash) of each shingle; a text of fewer than k words is one shingle, if it has any."""
    n = np.diff(w.first)
    g = grams(w.hash, k)
    doc = w.doc_of()
    whole = np.flatnonzero(doc[: len(g)] == doc[k - 1 :]) if len(g) else np.zeros(0, np.int64)
    at, h = doc[whole], g[whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.array([mix(np.array([hash_of(w.hash[w.first[i] : w.first[i + 1]])], np.uint64))[0] for i in short], np.uint64)
        at, h = np.concatenate([at, short]), np.concatenate([h, extra])
    return at, h


def hash_of(words: np.ndarray) -> int:
    out = len(words)
    for x in words.tolist():
        out = (out * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
        out ^= out >> 29
    return out


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, h, n): the distinct shingles of each text in order, and how often it has them."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def weights(n: np.ndarray) -> np.ndarray:
    """The weight of a shingle that occurs n times."""
    return 1 + np.log(n)


def signatures(doc: np.ndarray, h: np.ndarray, n: int, registers: int, weight: np.ndarray | None = None) -> np.ndarray:
    """ProbMinHash signatures, n x registers, of the distinct shingles (doc, h) with their weights, or all of weight one.

    All elements of all texts take their next arrival together; an element leaves as soon as its
    arrival lies beyond the largest value that a register of its text still holds.
    """
    if not len(h):
        return np.zeros((n, registers), np.uint64)
    rate = np.ones(len(h)) if weight is None else weight
    value = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    worst = np.full(n, np.inf)
    arrived, state = np.zeros(len(h)), h.copy()
    while len(h):
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        arrived = arrived - np.log1p(-((state >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
        register = (mix(state ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64)
        cell = doc * registers + register
        by = np.lexsort((h, arrived, cell))
        first = by[np.append(True, cell[by][1:] != cell[by][:-1])]
        better = first[arrived[first] < value[cell[first]]]
        value[cell[better]], winner[cell[better]] = arrived[better], h[better]
        worst = value.reshape(n, registers).max(axis=1)
        stay = arrived < worst[doc]
        doc, h, arrived, state, rate = doc[stay], h[stay], arrived[stay], state[stay], rate[stay]
    return winner.reshape(n, registers)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, n x bands; keys of different bands differ."""
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ parts[:, :, r])
    return key


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands and registers of each text: of all weights one, then, if it repeats shingles, of the weights as well."""
    for batch in batches:
        text = batch.column("text")
        for i, j in slices(text):
            w = Words(text.slice(i, j - i))
            doc, h, n = counted(*doc_shingles(w))
            heavy = np.unique(doc[n > 1])
            mine = np.isin(doc, heavy)
            sigs = signatures(doc, h, j - i, BANDS * ROWS), signatures(np.searchsorted(heavy, doc[mine]), h[mine], len(heavy), BANDS * ROWS, weights(n[mine]))
            keys, regs = [band_keys(x, BANDS, ROWS).view(np.int64) for x in sigs], [(x & np.uint64(255)).astype(np.uint8) for x in sigs]
            place = dict(zip(heavy.tolist(), range(len(heavy)), strict=True))
            some = np.diff(w.first) > 0
            cell = lambda x, k: (x[0][k].tobytes() + (x[1][place[k]].tobytes() if k in place else b"")) if some[k] else None  # noqa: B023, E731
            out = [[cell(x, k) for k in range(j - i)] for x in (keys, regs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("tk").slice(i, j - i), *[pa.array(x, pa.binary()) for x in out]], ["doc_id", "tk", "keys", "regs"])


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("keys")
        for i in range(0, len(keys), 2000):
            part = keys.slice(i, 2000).to_pylist()
            flat = np.frombuffer(b"".join(part), np.int64)
            owner = np.repeat(np.arange(len(part)), [len(x) // 8 for x in part])
            tk = batch.column("tk").slice(i, 2000)
            yield pa.RecordBatch.from_arrays([pa.array(flat), tk.take(pa.array(owner))], ["band", "tk"])


class Shingles:
    """A text's distinct shingles in order, and their weights."""

    def __init__(self, packed: bytes):
        n = int(np.frombuffer(packed, np.uint64, 1)[0])
        self.h = np.frombuffer(packed, np.uint64, n, 8)
        again = np.frombuffer(packed, np.uint32, offset=8 + 8 * n).reshape(-1, 2)
        self.heavy = len(again) > 0
        self.w = np.ones(n)
        self.w[again[:, 0]] = weights(again[:, 1])

    @staticmethod
    def packed(h: np.ndarray, n: np.ndarray) -> bytes:
        """How many there are, their hashes, then place and number of those that occur more than once."""
        again = np.flatnonzero(n > 1)
        return np.uint64(len(h)).tobytes() + h.tobytes() + np.column_stack([again, n[again]]).astype(np.uint32).tobytes()


def probability_jaccard(x: Shingles, y: Shingles) -> float:
    """The sum over shared elements i of 1 / (sum over all j of max(x_j / x_i, y_j / y_i)).

    In order of y / x, the first of the two is the greater for all elements up to i, the second for those after it.
    """
    _, at, to = np.intersect1d(x.h, y.h, assume_unique=True, return_indices=True)
    a, b = x.w[at], y.w[to]
    order = np.argsort(b / a)
    a, b = a[order], b[order]
    only_x, only_y = x.w.sum() - a.sum(), y.w.sum() - b.sum()
    return float((1 / ((only_x + np.cumsum(a)) / a + (only_y + b.sum() - np.cumsum(b)) / b)).sum())


def linked(x: Shingles, y: Shingles) -> bool:
    """Whether one of the two likenesses is at the threshold; whole numbers decide that of the sets."""
    both = len(np.intersect1d(x.h, y.h, assume_unique=True))
    if 10 * both >= 8 * (len(x.h) + len(y.h) - both):
        return True
    return (x.heavy or y.heavy) and both > 0 and probability_jaccard(x, y) >= THRESHOLD - 1e-12


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        for i, j in slices(text):
            doc, h, n = counted(*doc_shingles(Words(text.slice(i, j - i))))
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            sets = [Shingles.packed(h[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]]) for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column("tk").slice(i, j - i), pa.array(sets, pa.binary())], ["tk", "shingles"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = BANDS * ROWS
    for batch in batches:
        for i in range(0, len(batch), 1000):
            part = batch.slice(i, 1000)
            # a text without a second signature has the first for both
            x, y = (np.frombuffer(b"".join(r if len(r) == 2 * m else r + r for r in part.column(c).to_pylist()), np.uint8).reshape(len(part), 2, m) for c in ("a_regs", "b_regs"))
            take = pa.array(np.flatnonzero((x == y).mean(axis=2).max(axis=1) >= LIKELY))
            yield pa.RecordBatch.from_arrays([part.column("a").take(take), part.column("b").take(take)], ["a", "b"])


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs whose signatures do not rule a link out."""
    regs = nodes.where("regs IS NOT NULL")
    both = pairs.join(regs.select(F.col("tk").alias("b"), F.col("regs").alias("b_regs")), "b").join(regs.select(F.col("tk").alias("a"), F.col("regs").alias("a_regs")), "a")
    return both.select("a", "b", "a_regs", "b_regs").mapInArrow(_likely, "a binary, b binary")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a_set"), batch.column("b_set")
        take = pa.array([k for k in range(len(a)) if linked(Shingles(a[k].as_py()), Shingles(b[k].as_py()))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], ["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are links."""
    with_b = pairs.join(sets.select(F.col("tk").alias("b"), F.col("shingles").alias("b_set")), "b")
    both = with_b.join(sets.select(F.col("tk").alias("a"), F.col("shingles").alias("a_set")), "a")
    return both.select("a", "b", "a_set", "b_set").mapInArrow(_alike, "a binary, b binary")


def common_counts(sets: list[np.ndarray], weight: list[np.ndarray] | None = None) -> np.ndarray:
    """How many elements each two sets share, or what those weigh in the first, by products of slices of their incidence matrix."""
    n = len(sets)
    member = np.repeat(np.arange(n), [len(x) for x in sets])
    _, element, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1  # the others are in no two sets
    number = np.cumsum(shared) - 1
    keep = shared[element]
    mass = np.ones(len(element), np.float32) if weight is None else np.concatenate(weight).astype(np.float32)
    member, element, mass = member[keep], number[element[keep]], mass[keep]
    order = np.argsort(element, kind="stable")
    member, element, mass = member[order], element[order], mass[order]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), SLICE):
        i, j = np.searchsorted(element, [lo, lo + SLICE])
        part = np.zeros((n, SLICE), np.float32)
        part[member[i:j], element[i:j] - lo] = 1
        first = part
        if weight is not None:
            first = np.zeros((n, SLICE), np.float32)
            first[member[i:j], element[i:j] - lo] = mass[i:j]
        out += first @ part.T
    return out


def _forest(group: pa.Table) -> pa.Table:
    """Links between the classes that meet in a block, as few as join what can be joined."""
    tk, root = group.column("tk").to_pylist(), group.column("root").to_pylist()
    sets = [Shingles(x) for x in group.column("shingles").to_pylist()]
    size = np.array([len(x.h) for x in sets], np.float32)
    both = common_counts([x.h for x in sets])
    alike = both >= np.float32(THRESHOLD) * (size[:, None] + size[None, :] - both) - np.float32(1e-3)
    heavy = np.array([x.heavy for x in sets])
    if heavy.any():
        # probability Jaccard is at most what the shared elements weigh in either text
        held = common_counts([x.h for x in sets], [x.w / x.w.sum() for x in sets]) >= np.float32(THRESHOLD) - np.float32(1e-3)
        alike |= held & held.T & (heavy[:, None] | heavy[None, :])
    _, label = np.unique(np.array(root, object), return_inverse=True)
    x, y = np.nonzero(alike & (label[:, None] < label[None, :]))
    found = []
    while len(x):
        i, j = x[0], y[0]
        # float32 only proposes
        if linked(sets[i], sets[j]):
            found.append((tk[i], tk[j]))
            label[label == label[j]] = label[i]
        else:
            x, y = x[1:], y[1:]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})


def block_links(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join all classes which can be joined within a bucket. rest: band, tk, root.

    Texts of one class need not meet. So a bucket is parted into its largest class and all others, each
    is cut into blocks of about BLOCK texts, and each block of the others meets every block of the bucket in
    one task, which counts what every two sets share and reports a spanning forest of the links: the
    class needs no more, and so no task puts out more rows than it has texts. A bucket of very many
    texts that a few odd ones share costs in proportion to its size.
    """
    by_class = rest.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    parts = by_class.groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    parts = parts.select("band", F.col("most.root").alias("big"), blocks(F.col("most.n")).alias("m"), blocks(F.col("all") - F.col("most.n")).alias("r"))
    in_big, draw = F.col("root") == F.col("big"), F.xxhash64("tk")
    own = F.when(in_big, F.pmod(draw, F.col("m"))).otherwise(F.col("m") + F.pmod(draw, F.col("r"))).cast("int")
    first = F.when(in_big, F.col("m")).otherwise(F.lit(0))
    dealt = rest.join(parts, "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(first, F.col("m") + F.col("r") - 1)))
    dealt = dealt.select("band", "tk", "root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return dealt.join(sets, "tk").groupBy("band", "lo", "hi").applyInArrow(_forest, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(tk, root) for each end of a link; root is the least key of its component.

    Each round every node takes the least label around it, then its label's label; what a round
    makes is written, and rounds end when none changes a label. Rounds grow with the logarithm of a
    chain's length.
    """
    edges = common.written(links.union(links.select("b", "a")).distinct(), "edges")
    labels = common.written(edges.groupBy(F.col("a").alias("tk")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("tk", "b"), "b").groupBy(F.col("a").alias("tk")).agg(F.min("root").alias("seen"))
        # what a node's root hears reaches all that point at it
        heard = labels.join(near, "tk").groupBy("root").agg(F.min("seen").alias("said"))
        least = labels.join(near, "tk").join(heard, "root").select("tk", F.col("root").alias("was"), F.least("root", "seen", "said").alias("via"))
        jump = labels.select(F.col("tk").alias("via"), F.col("root").alias("far"))
        done = common.written(least.join(jump, "via", "left").select("tk", "was", F.least("via", F.coalesce("far", "via")).alias("root")), "labels")
        moved = done.where("was <> root").limit(1).count()
        labels = done.select("tk", "root")
        if not moved:
            return labels


def rooted(docs: DataFrame) -> DataFrame:
    """One row for each distinct text of docs: tk, least (its least doc_id), copies, root (the key of its class)."""
    base = docs.select("doc_id", common.text_or_empty().alias("text"), common.text_key().alias("tk"))
    signed = base.mapInArrow(_sign, "doc_id long, tk binary, keys binary, regs binary")
    nodes = common.written(signed.groupBy("tk").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("regs").alias("regs")), "nodes")

    bands = nodes.where("keys IS NOT NULL").select("tk", "keys").mapInArrow(_explode_keys, "band long, tk binary")
    centres = bands.groupBy("band").agg(F.min("tk").alias("b"), F.max("tk").alias("_most")).where("b <> _most").select("band", "b")
    # what shares a bucket with others; a bucket of one text takes no further part
    shared = common.written(bands.join(centres, "band"), "buckets")
    asked = shared.select("tk").distinct().join(nodes.select("tk", F.col("least").alias("doc_id")), "tk")
    texts = base.join(asked, (base["tk"] == asked["tk"]) & base["doc_id"].eqNullSafe(asked["doc_id"]), "left_semi").select("tk", "text")
    sets = common.written(texts.mapInArrow(_shingle_sets, "tk binary, shingles binary").dropDuplicates(["tk"]), "shingles")

    pairs = common.written(likely(shared.select(F.col("tk").alias("a"), "b").where("a <> b").distinct(), nodes), "pairs")
    roots = components(verified(pairs, sets))
    spread = shared.join(roots, "tk", "left").select("band", "tk", F.coalesce("root", "tk").alias("root"))
    apart = spread.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    found = common.written(block_links(spread.join(apart, "band", "left_semi"), sets), "found")
    tied = roots.where("tk <> root").select(F.col("tk").alias("a"), F.col("root").alias("b"))
    roots = components(tied.union(found))
    return nodes.join(roots, "tk", "left").select("tk", "least", "copies", F.coalesce("root", "tk").alias("root"))


def classes(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, class_rows, copies.

    class_id is the least doc_id of the class, class_rows its rows, copies the rows with the very same
    text. Equal texts share a class whatever they hold; null counts as empty. Texts without a word are
    alike only when equal. Rows repeated as a whole are kept. A null doc_id is returned as null; it never
    is a class_id unless all of its class are null. Other columns of docs are left out.
    """
    base = docs.select("doc_id", common.text_key().alias("tk"))
    known = rooted(docs)
    whole = known.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_rows"))
    member = known.join(whole, "root").select("tk", "class_id", "class_rows", "copies")
    return base.join(member, "tk").select("doc_id", "class_id", "class_rows", "copies")


def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.documents(spark, sf_dir).select("doc_id", "text"))


@common.other_columns_apart
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that with the least doc_id, null last, and among its texts the least key.

    A doc_id does not tell a row: nulls and repeated ids with texts of different classes all stay. All columns stay,
    whatever their names; an empty table gives an empty table.
    """
    own = docs.columns
    # text comes with its key, so that an id which several classes hold picks each class's own text
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "tk")).alias("pick")
    found = rooted(docs).groupBy("root").agg(first).select(F.col("pick.least").alias("_id"), F.col("pick.tk").alias("_of"))
    keyed = docs.withColumn("_tk", common.text_key())
    kept = keyed.join(found, (keyed["_tk"] == found["_of"]) & keyed["doc_id"].eqNullSafe(found["_id"]), "left_semi")
    # rows equal in id and text are alike; one of them stays
    return kept.dropDuplicates(["doc_id", "_tk"]).select(*own)
