"""A class-based bigram language model with classes from exchange clustering.

P(w | v) = lam * P(class(w) | class(v)) * P(w | class(w)) + (1 - lam) * P0(w), where P0 is the
smoothed unigram model. The most frequent words are exchanged between classes, round by round, as long as
that raises the likelihood of the training bigrams; every other word that occurs often enough to have
a context worth the name then joins the class that makes its own occurrences most likely. The words left, the
unseen one among them, share one class, and the end of a text is a class of its own. All probabilities sum to
one over the known words and one word for all unknown ones.

Counts of words, of word pairs and of classes around a word are gathered over all training texts by Spark,
and the table of words and classes grows with the corpus: it is joined, not broadcast. Only the
head of it (a number of words that is a parameter) and the tables of class pairs travel to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.llm import common
from stratamem.llm.wordhash import Words, mix, slices

#: Words that are sent to the tasks with their counts and classes, about: 17 bytes each. The others are joined.
FREQUENT = 1 << 17
#: Words that exchange clustering assigns, about; 8 + K * 16 bytes of context counts each. The others are assigned by likelihood.
CLUSTERED = 1 << 13
CLASSES = 64
#: A word seen less often shares the class of unseen words.
LEAST_COUNT = 3
#: Parts of the table of clustered words.
PARTS = 64
#: Exchange ends when two half-rounds in a row raise the likelihood by less than this part of what classes win.
CONVERGED = 5e-3
ADD = 0.1
#: Share of the class model in the mixture.
LAM = 0.9
#: The hash that stands for the end of a text; no word is given it (words hash to 64 mixed bits).
END = np.uint64(0x5EED0FE2D)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 10; a null id counts as an empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


class Tokens:
    """Word hashes of a slice of texts with an end token after each text, and each token's predecessor."""

    def __init__(self, text: pa.Array):
        w = Words(text, lower=True)
        n = len(w.first) - 1
        ends = w.first[1:] + np.arange(n)
        self.hash = np.empty(len(w.hash) + n, np.uint64)
        is_end = np.zeros(len(self.hash), bool)
        is_end[ends] = True
        self.hash[is_end], self.hash[~is_end] = END, w.hash
        self.before = np.empty_like(self.hash)
        self.before[1:], self.before[:1] = self.hash[:-1], END
        self.doc = np.repeat(np.arange(n), np.diff(w.first) + 1)
        self.n = np.diff(w.first) + 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words within each few megabytes; Spark adds them up."""
    held: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        h, n = np.concatenate(held), np.concatenate(counts)
        u, where = np.unique(h, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(where, n, len(u)).astype(np.int64))], ["h", "n"])

    for batch in batches:
        text = batch.column("text")
        for i, j in slices(text):
            u, n = np.unique(Tokens(text.slice(i, j - i)).hash, return_counts=True)
            held.append(u)
            counts.append(n)
            if sum(map(len, held)) > 1 << 21:
                yield out()
                held, counts = [], []
    if held:
        yield out()


@dataclass
class Frequent:
    """The frequent words by ascending hash, with their counts, and a number for each: 0 the end, -1 not clustered."""

    hash: np.ndarray
    count: np.ndarray
    index: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in `hash`, -1 where a word is not among them."""
        return found(self.hash, h)


def found(among: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of h in the ascending `among`, -1 where it is not there."""
    if not len(among):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(among, h), len(among) - 1)
    return np.where(among[at] == h, at, -1)


def word_counts(train: DataFrame) -> DataFrame:
    """(h, n): how often each token occurs in the training texts."""
    return train.select(common.text_or_empty().alias("text")).mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def head(counts: DataFrame, limit: int) -> Column:
    """Whether a word is among about `limit` most frequent; the end of a text always is.

    The cut is found on how many words have each count. Of the words at the cut those with the least
    hashes are in, as many as there is room for (hashes are uniform, so their share is met nearly).
    """
    by = counts.where(F.col("h") != int(END)).groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(limit + 1).collect()
    total, inside = 0, F.col("h") == int(END)
    for x in by:
        if total + x["words"] > limit:
            tied = (F.col("n") == x["n"]) & (F.col("h").cast("double") / 2.0**64 + 0.5 < (limit - total) / x["words"])
            return inside | (F.col("n") > x["n"]) | tied
        total += x["words"]
    return inside | F.lit(True)


def frequent_words(counts: DataFrame, most: int = FREQUENT, clustered: int = CLUSTERED) -> Frequent:
    """About `most` words, of which about `clustered` are numbered from 1; the end of a text is 0."""
    pdf = counts.where(head(counts, most)).select("h", "n", head(counts, clustered).alias("c")).toPandas()
    h, n, c = pdf["h"].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy(np.int64), pdf["c"].to_numpy(bool)
    order = np.argsort(h, kind="stable")
    h, n, c = h[order], n[order], c[order]
    index = np.full(len(h), -1, np.int64)
    numbered = np.flatnonzero(c & (h != END))
    index[numbered] = np.arange(1, len(numbered) + 1)
    index[h == END] = 0
    return Frequent(h, n, index)


def pair_lists(train: DataFrame, words: Frequent) -> DataFrame:
    """(id, after, n_after, before, n_before): what follows each clustered word, what it follows, and how often.

    0 is the end of a text, the number after the last word all others. Lists are bytes of int32 ids and int64 counts;
    they are no longer than the number of clustered words, and so is the table.
    """
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(words)
    other = int(words.index.max(initial=0)) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            pairs, n = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            u, where = np.unique(pairs, return_inverse=True)
            n = np.bincount(where, n, len(u)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array((u // (other + 1)).astype(np.int32)), pa.array((u % (other + 1)).astype(np.int32)), pa.array(n)], ["v", "w", "n"])

        for batch in batches:
            text = batch.column("text")
            for i, j in slices(text):
                t = Tokens(text.slice(i, j - i))
                at = known.find(t.hash)
                ids = np.where(at >= 0, known.index[at] if len(known.index) else -1, -1)
                ids = np.where(ids < 0, other, ids)
                prev = np.append(0, ids[:-1])
                held.append(np.unique(prev * (other + 1) + ids, return_counts=True))
                if sum(len(x) for x, _ in held) > 1 << 20:
                    yield out()
                    held = []
        if held:
            yield out()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[(np.asarray(x.values.field(0)).astype(np.int32).tobytes(), np.asarray(x.values.field(1)).astype(np.int64).tobytes()) if x.is_valid else (b"", b"") for x in batch.column(c)] for c in ("a", "b")]
            columns = [pa.array([x[i] for x in side], pa.binary()) for side in lists for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "after", "n_after", "before", "n_before"])

    rows = train.select(common.text_or_empty().alias("text")).mapInArrow(count, "v int, w int, n long")
    # added up by pair first: `others` goes before very many words, and only then stands for one row
    each = rows.groupBy("v", "w").agg(F.sum("n").alias("n")).repartition(PARTS, "v")
    after = common.written(each.groupBy("v").agg(F.collect_list(F.struct("w", "n")).alias("a")), "after")
    turned = after.select("v", F.explode("a").alias("x")).select(F.col("x.w").alias("id"), F.struct("v", F.col("x.n").alias("n")).alias("x"))
    before = turned.repartition(PARTS, "id").groupBy("id").agg(F.collect_list("x").alias("b"))
    both = after.withColumnRenamed("v", "id").repartition(PARTS, "id").join(before, "id", "full")
    return common.written(both.select("id", "a", "b").mapInArrow(pack, "id int, after binary, n_after binary, before binary, n_before binary"), "lists")


def _gain(table: np.ndarray) -> np.ndarray:
    return table * np.log(np.maximum(table, 1.0))


def likelihood(transitions: np.ndarray) -> float:
    """The part of the class model's log likelihood that classes change."""
    return float(_gain(transitions).sum() - _gain(transitions.sum(1)).sum() - _gain(transitions.sum(0)).sum())


def best_classes(left: np.ndarray, right: np.ndarray, own: np.ndarray, now: np.ndarray, transitions: np.ndarray, fixed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the class to move to and the likelihood it gains, all else staying.

    left[i, c]: how often word i follows class c; right[i, c]: how often class c follows it; own: how
    often it follows itself; transitions: counts of class pairs. The last `fixed` classes take no words.
    """
    k = len(transitions)
    to, gains = now.copy(), np.zeros(len(now))
    t = transitions.astype(float)
    row, col, g = t.sum(1), t.sum(0), _gain(t)
    for i, a in enumerate(now):
        out, into, s = right[i].astype(float), left[i].astype(float), float(own[i])
        kept = [z.copy() for z in (t[a, :], t[:, a], g[a, :], g[:, a])]
        # counts of class pairs without the word; its own pair lies at (a, a)
        t[a, :] -= out
        t[:, a] -= into
        t[a, a] += s
        g[a, :], g[:, a] = _gain(t[a, :]), _gain(t[:, a])
        x, y = out.copy(), into.copy()
        x[a] -= s
        y[a] -= s
        n_out, n_in = out.sum(), into.sum()
        r, c = row.copy(), col.copy()
        r[a] -= n_out
        c[a] -= n_in
        # joining class b adds x to row b, y to column b, and s to (b, b); only classes beside the word change
        after, before = np.flatnonzero(x), np.flatnonzero(y)
        rows = _gain(t[:, after] + x[after]) - g[:, after]
        cols = _gain(t[before, :] + y[before, None]) - g[before, :]
        score = rows.sum(1) + cols.sum(0)
        score[after] -= rows[after, np.arange(len(after))]
        score[before] -= cols[np.arange(len(before)), before]
        diag = np.diagonal(t)
        score += _gain(diag + x + y + s) - np.diagonal(g)
        score -= (_gain(r + n_out) - _gain(r)) + (_gain(c + n_in) - _gain(c))
        score[k - fixed :] = -np.inf
        b = int(np.argmax(score))
        if score[b] > score[a] + 1e-9:
            to[i], gains[i] = b, score[b] - score[a]
        t[a, :], t[:, a], g[a, :], g[:, a] = kept[0], kept[1], kept[2], kept[3]
    return to, gains


def exchange(lists: DataFrame, words: Frequent, classes: int = CLASSES, converged: float = CONVERGED) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of each clustered word (the end token first, all `others` last), counts of class pairs, and the likelihoods.

    lists: see pair_lists. Each half-round tasks work out each word's best move, and half of the words, the other
    half next time, make theirs. Where the moves together do harm, those that gain most are tried alone, fewer
    and fewer. The likelihood never falls; it ends when two half-rounds in a row raise it by less than `converged`
    of what has been won so far.
    """
    spark = lists.sparkSession
    n = int(words.index.max(initial=0))
    k = classes + 2  # one for the end of a text, one for all other words
    by_count = np.zeros(n + 2, np.int64)
    inside = words.index >= 0
    by_count[words.index[inside]] = words.count[inside]
    order = np.argsort(-by_count[1 : n + 1], kind="stable")
    cls = np.empty(n + 2, np.int64)
    cls[0], cls[n + 1] = classes, classes + 1
    cls[1 + order] = np.arange(n) % classes  # the most frequent words start apart

    def beside(batch: pa.RecordBatch, side: str, c: np.ndarray) -> np.ndarray:
        ids, often = batch.column(side), batch.column(f"n_{side}")
        return np.array([np.bincount(c[np.frombuffer(x.as_py(), np.int32)], np.frombuffer(y.as_py(), np.int64), k) for x, y in zip(ids, often, strict=True)]).reshape(-1, k)

    def class_pairs(c: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(c)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k))
            for batch in batches:
                np.add.at(total, shared.value[np.asarray(batch.column("id"))], beside(batch, "after", shared.value))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.reshape(-1)[at].astype(np.int64))], ["pair", "n"])

        t = np.zeros(k * k)
        for x in lists.select("id", "after", "n_after").mapInArrow(add, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
            t[x["pair"]] = x["n"]
        return t.reshape(k, k)

    now = class_pairs(cls)
    course, still, r = [likelihood(now)], 0, -1
    while still < 2 and n:
        r += 1
        shared = spark.sparkContext.broadcast((cls, now))

        def move(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c, table = shared.value
            for batch in batches:
                ids = np.asarray(batch.column("id"))
                own = [np.frombuffer(y.as_py(), np.int64)[np.frombuffer(x.as_py(), np.int32) == i].sum() for i, x, y in zip(ids.tolist(), batch.column("after"), batch.column("n_after"), strict=True)]
                to, gain = best_classes(beside(batch, "before", c), beside(batch, "after", c), np.array(own), c[ids], table, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(to.astype(np.int32)), pa.array(gain)], ["id", "to", "gain"])

        half = lists.where(F.col("id").between(1, n) & (F.col("id") % 2 == r % 2))
        moved = half.mapInArrow(move, "id int, to int, gain double").where("gain > 0").toPandas()
        moved = moved.sort_values(["gain", "id"], ascending=[False, True])
        won, tries = 0.0, len(moved)
        while tries:
            tried = cls.copy()
            tried[moved["id"].to_numpy()[:tries]] = moved["to"].to_numpy()[:tries]
            then = class_pairs(tried)
            won = likelihood(then) - course[-1]
            if won > 0:
                cls, now = tried, then
                course.append(course[-1] + won)
                break
            tries //= 8
        # measured against all that moving has won; nothing won at all ends it as well
        still = still + 1 if won <= converged * (course[-1] - course[0]) else 0
    return cls, now, course


def _contexts(words: Frequent, cls: np.ndarray, k: int):
    """(h, ctx, n): each word that is not clustered with the classes before and after it, as before * k + after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((c, h))
            h, c, n = h[order], c[order], n[order]
            at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(c[at].astype(np.int32)), pa.array(np.add.reduceat(n, at))], ["h", "ctx", "n"])

        for batch in batches:
            text = batch.column("text")
            for i, j in slices(text):
                t = Tokens(text.slice(i, j - i))
                at = words.find(t.hash)
                idx = np.where(at >= 0, words.index[at], -1)
                c = np.where(idx >= 0, cls[np.maximum(idx, 0)], k - 1)
                free = np.flatnonzero(idx < 0)  # never the last token, which ends a text
                if len(free):
                    before = np.append(k - 2, c[:-1])
                    held.append((t.hash[free], before[free] * k + c[free + 1], np.ones(len(free), np.int64)))
                if sum(len(x[0]) for x in held) > 1 << 20:
                    yield out()
                    held = []
        if held:
            yield out()

    return run


def likeliest(left: np.ndarray, right: np.ndarray, trans: np.ndarray, mass: np.ndarray, fixed: int = 2) -> np.ndarray:
    """For each word the class under which its occurrences are most likely, all else as it is.

    left[i, c]: how often word i follows class c; right[i, c]: how often class c follows it; trans: P(class | class
    before); mass: tokens of each class. The last `fixed` classes take no words.
    """
    n = left.sum(1, keepdims=True)
    log = np.log(trans)
    score = left @ log + right @ log.T - n * np.log(mass[None, :] + n)
    score[:, len(trans) - fixed :] = -np.inf
    return np.argmax(score, axis=1)


def assigned(train: DataFrame, words: Frequent, cls: np.ndarray, table: np.ndarray, least: int = LEAST_COUNT) -> DataFrame:
    """(h, c): the class of each word that is not clustered and occurs at least `least` times."""
    spark, k = train.sparkSession, len(table)
    shared = spark.sparkContext.broadcast((words, cls))
    trans = (table + 1.0) / (table.sum(1, keepdims=True) + k)
    mass = np.maximum(table.sum(0), 1.0)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _contexts(*shared.value, k)(batches)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                x = part.column("x")
                owner = np.repeat(np.arange(len(part)), np.diff(np.asarray(x.offsets)))
                flat = x.flatten()
                ctx, n = (np.asarray(flat.field(f)) for f in ("ctx", "n"))
                left, right = np.zeros((len(part), k)), np.zeros((len(part), k))
                np.add.at(left, (owner, ctx // k), n)
                np.add.at(right, (owner, ctx % k), n)
                yield pa.RecordBatch.from_arrays([part.column("h"), pa.array(likeliest(left, right, trans, mass).astype(np.int32))], ["h", "c"])

    rows = train.select(common.text_or_empty().alias("text")).mapInArrow(gather, "h long, ctx int, n long")
    # dealt by word once; a word that is not clustered is too rare to fill a task, and has at most k * k contexts
    each = rows.repartition("h").groupBy("h", "ctx").agg(F.sum("n").alias("n"))
    lists = each.groupBy("h").agg(F.collect_list(F.struct("ctx", "n")).alias("x"), F.sum("n").alias("n")).where(F.col("n") >= least)
    return lists.select("h", "x").mapInArrow(choose, "h long, c int")


@dataclass
class Vocabulary:
    """Words with counts and classes: the frequent ones as arrays by ascending hash, the others as a table (h, n, c)."""

    hash: np.ndarray
    count: np.ndarray
    cls: np.ndarray
    rest: DataFrame
    mass: np.ndarray  # tokens of each class
    size: np.ndarray  # words of each class; the last has the unknown word as well
    tokens: int
    types: int
    course: list[float]

    @property
    def z(self) -> float:
        return self.tokens + ADD * (self.types + 1)


def vocabulary(train: DataFrame, classes: int = CLASSES, most: int = FREQUENT, clustered: int = CLUSTERED, least: int = LEAST_COUNT, converged: float = CONVERGED) -> Vocabulary:
    """Counts and classes of all words of the training texts (text; null counts as empty)."""
    counts = common.written(word_counts(train), "counts")
    all_ = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types, k = all_["n"] or 0, all_["v"] or 0, classes + 2
    words = frequent_words(counts, most, clustered)
    cls, table, course = exchange(pair_lists(train, words), words, classes, converged)
    tail = assigned(train, words, cls, table, least)
    lexicon = common.written(counts.join(tail, "h", "left").select("h", "n", F.coalesce("c", F.lit(k - 1)).alias("c"), head(counts, most).alias("frequent")), "lexicon")
    pdf = lexicon.where("frequent").toPandas()
    h = pdf["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h, kind="stable")
    h, n, c = h[order], pdf["n"].to_numpy(np.int64)[order], pdf["c"].to_numpy(np.int64)[order]
    at = words.find(h)
    index = np.where(at >= 0, words.index[at] if len(words.index) else -1, -1)
    c = np.where(index >= 0, cls[np.maximum(index, 0)], c)
    mass, size = np.bincount(c, n, k), np.bincount(c, minlength=k).astype(float)
    rest = lexicon.where("not frequent").select("h", "n", "c")
    for x in rest.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[x["c"]] += x["n"]
        size[x["c"]] += x["v"]
    size[k - 1] += 1
    return Vocabulary(h, n, c.astype(np.uint8), rest, mass, size, tokens, types, course)


def coded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_tokens, n_known, own, cls.

    own: the sum over tokens of log10(count + ADD); cls: the class of each token, a byte each. Words that are
    not frequent are looked up by a join of each text's own distinct ones, which come back to the text as a
    list. Rows equal in id and text are alike. Other columns are left out.
    """
    spark, other = docs.sparkSession, len(words.mass) - 1
    shared = spark.sparkContext.broadcast((words.hash, words.count, words.cls))
    rows = docs.select("doc_id", common.row_key().alias("rk"), common.text_or_empty().alias("text"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[0]
        for batch in batches:
            text = batch.column("text")
            for i, j in slices(text):
                t = Tokens(text.slice(i, j - i))
                free = np.flatnonzero(found(known, t.hash) < 0)
                doc, h = t.doc[free], t.hash[free]
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([batch.column("rk").slice(i, j - i).take(pa.array(doc[new])), pa.array(h[new].view(np.int64))], ["rk", "h"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, classes = shared.value
        fold = lambda d, x: mix(x + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            text = batch.column("text")
            for i, j in slices(text):
                t, n = Tokens(text.slice(i, j - i)), j - i
                at = found(known, t.hash)
                hit = at >= 0
                count = np.where(hit, counts[at] if len(counts) else 0, 0)
                cls = np.where(hit, classes[at] if len(classes) else other, other)
                lists = batch.column("x").slice(i, n)
                sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
                if sizes.sum():
                    flat = lists.flatten()
                    key = fold(np.repeat(np.arange(n), sizes), np.asarray(flat.field("h")).view(np.uint64))
                    order = np.argsort(key, kind="stable")
                    free = np.flatnonzero(~hit)
                    where = found(key[order], fold(t.doc[free], t.hash[free]))
                    free, where = free[where >= 0], order[where[where >= 0]]
                    count[free], cls[free] = np.asarray(flat.field("n"))[where], np.asarray(flat.field("c"))[where]
                raw, ends = cls.astype(np.uint8).tobytes(), np.cumsum(t.n)
                own = np.bincount(t.doc, np.log10(count + ADD), n)
                seen = np.bincount(t.doc, count > 0, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), pa.array(t.n), pa.array(seen), pa.array(own), pa.array([raw[e - m : e] for e, m in zip(ends.tolist(), t.n.tolist(), strict=True)], pa.binary())],
                    ["doc_id", "n_tokens", "n_known", "own", "cls"],
                )

    asked = rows.select("rk", "text").mapInArrow(ask, "rk binary, h long").join(words.rest, "h")
    # a text's list is no longer than the text; equal rows fold in the set
    lists = asked.repartition("rk").groupBy("rk").agg(F.collect_set(F.struct("h", "n", "c")).alias("x"))
    return rows.join(lists, "rk", "left").select("doc_id", "text", "x").mapInArrow(code, "doc_id long, n_tokens long, n_known long, own double, cls binary")


@dataclass
class Model:
    """What it takes to score coded texts."""

    trans: np.ndarray  # P(class | class before), smoothed
    emit_base: np.ndarray  # of each class: its tokens and ADD for each of its words
    z: float
    lam: float


def _pairs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for x in batch.column("cls"):
                c = np.frombuffer(x.as_py(), np.uint8).astype(np.int64)
                total += np.bincount(np.append(k - 2, c[:-1]) * k + c, minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    return run


def fit(train: DataFrame, words: Vocabulary, lam: float = LAM) -> Model:
    """train: coded training texts. Class pairs are counted over all of them, with the classes of all words."""
    k = len(words.mass)
    table = np.zeros(k * k)
    for x in train.select("cls").mapInArrow(_pairs(k), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[x["pair"]] = x["n"]
    table = table.reshape(k, k)
    # add-one over classes
    trans = (table + 1.0) / (table.sum(1, keepdims=True) + k)
    # a class without words keeps its share of the transitions out of reach; it is given to the class of all others
    empty = (words.size[: k - 1] == 0).nonzero()[0]
    trans[:, k - 1] += trans[:, empty].sum(1)
    trans[:, empty] = 0
    return Model(trans, words.mass + ADD * words.size, words.z, lam)


def score(texts: DataFrame, model: Model) -> DataFrame:
    """texts (coded) with base_score and score, log10 probabilities of the whole text with its end, for cls and own."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_tokens", "n_known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.trans)
        with np.errstate(divide="ignore", invalid="ignore"):
            mixed = np.log10(m.lam * m.trans / m.emit_base[None, :] + (1 - m.lam) / m.z)
        for batch in batches:
            own, n = np.asarray(batch.column("own")), np.asarray(batch.column("n_tokens"))
            more = np.empty(len(batch))
            for i, x in enumerate(batch.column("cls")):
                c = np.frombuffer(x.as_py(), np.uint8).astype(np.int64)
                more[i] = mixed[np.append(k - 2, c[:-1]), c].sum()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(own - n * np.log10(m.z)), pa.array(own + more)], [*names, "base_score", "score"])

    return texts.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op1_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    words = vocabulary(docs.where(~held_out()))
    texts = common.written(coded(docs, words), "coded")
    out = score(texts, fit(texts.where(~held_out()), words))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score")
