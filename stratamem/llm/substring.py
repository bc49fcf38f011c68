"""Exact removal of repeated passages, by level-wise doubling.

A passage of 35 words that occurs twice holds a passage of 18 words that occurs twice, and that one of 9
words. So the corpus is asked first at the shortest length, and for a few windows of it only: of the 18-word
windows inside each 35-word window, that with the least hash stands for it, which is the same wherever the 35
words stand; a 9-word window stands for each of these in the same way. Windows whose representative is found
once are settled. The others are extended to twice the length and counted there, until the full length is
reached or no candidate survives.

Equal texts are folded before; a text that occurs twice is repeated as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.llm import common
from stratamem.llm.wordhash import Words, mix, rolling, slices

WINDOW = 35
#: Doubling starts at the first half of a half that is no longer than this.
SHORTEST = 9
COUNTED = "tk binary, h long, n long"
#: At the full length a second hash goes along, so that 128 bits tell windows apart.
COUNTED_TWICE = "tk binary, h long, g long, n long"
_SECOND = np.uint64(0x2545F4914F6CDD1D)


def lengths(window: int, shortest: int = SHORTEST) -> list[int]:
    """Ascending lengths, each at most twice the one before, that end with the window."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def _slide(x: np.ndarray, k: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each k neighbours, by doubling."""
    size = 1
    while size < k:
        step = min(size, k - size)
        x = best(x[: len(x) - step], x[step:])
        size += step
    return x


class Windows:
    """The windows of a slice of texts at each length: hashes, which of them matter, and their representatives' hashes.

    hash[i][p]: the window of length[i] words from word p. matters[i]: whether it lies in one text and, below
    the full length, stands for a longer window. least[i][p]: the hash of what stands for it one length below.
    """

    def __init__(self, w: Words, window: int, shortest: int = SHORTEST):
        self.words, self.doc, self.length = w, w.doc_of(), lengths(window, shortest)
        self.hash = [rolling(w.hash, k) for k in self.length]
        n = len(self.hash[-1])
        self.matters = [self.doc[:n] == self.doc[window - 1 :] if n else np.zeros(0, bool)]
        self.least: list[np.ndarray] = []
        for i in range(len(self.length) - 1, 0, -1):
            reach = self.length[i] - self.length[i - 1] + 1
            low = _slide(self.hash[i - 1], reach, np.minimum) if len(self.hash[i]) else self.hash[i]
            self.least.insert(0, low)
            if not len(low):
                self.matters.insert(0, np.zeros(len(self.hash[i - 1]), bool))
                continue
            pad = np.zeros(reach - 1, np.uint64)
            top = _slide(np.concatenate([pad, np.where(self.matters[0], low, np.uint64(0)), pad]), reach, np.maximum)
            self.matters.insert(0, self.hash[i - 1] == top)

    def candidates(self, level: int, lists: pa.Array | None) -> np.ndarray:
        """Places of the windows to count at a level: those whose representative is in its text's list."""
        at = np.flatnonzero(self.matters[level])
        return at if not level else at[_member(self.doc[at], self.least[level - 1][at], lists)]

    def second(self) -> np.ndarray:
        """Another hash of each full window, from other word hashes."""
        return rolling(mix(self.words.hash * _SECOND + np.uint64(1)), self.length[-1])


def _counted(doc: np.ndarray, h: np.ndarray, tk: pa.Array, g: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each hash (or pair of hashes) of each text, with how often it occurs there."""
    order = np.lexsort((h, doc) if g is None else (g, h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    if g is not None:
        g = g[order]
        new[1:] |= g[1:] != g[:-1]
    at = np.flatnonzero(new)
    n = pa.array(np.diff(np.append(at, len(h))))
    keys = [tk.take(pa.array(doc[at])), *[pa.array(x[at].view(np.int64)) for x in (h, g) if x is not None]]
    return pa.RecordBatch.from_arrays([*keys, n], ["tk", "h", "n"] if g is None else ["tk", "h", "g", "n"])


def _member(doc: np.ndarray, h: np.ndarray, lists: pa.Array) -> np.ndarray:
    """For each (doc, h): whether the doc's list holds h."""
    sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
    if not sizes.sum():
        return np.zeros(len(h), bool)
    flat = np.concatenate([np.asarray(x.values) for x in lists if x.is_valid]).view(np.uint64)
    owner = np.repeat(np.arange(len(lists)), sizes)
    # within a text equality of hashes decides, so text and hash are folded into one number to search by
    fold = lambda d, x: mix(x + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    known = np.sort(fold(owner, flat))
    out = np.zeros(len(h), bool)
    ask = np.flatnonzero(sizes[doc] > 0)
    key = fold(doc[ask], h[ask])
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    out[ask] = known[at] == key
    return out


def _count_level(window: int, level: int):
    last = level == len(lengths(window)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text")):
                x = Windows(Words(batch.column("text").slice(i, j - i)), window)
                at = x.candidates(level, batch.column("hs").slice(i, j - i) if level else None)
                if len(at):
                    yield _counted(x.doc[at], x.hash[level][at], batch.column("tk").slice(i, j - i), x.second()[at] if last else None)

    return run


def repeated(counted: DataFrame) -> DataFrame:
    """(tk, hs): for each text those of its hashes that occur twice or more in all texts together."""
    keys = [c for c in ("h", "g") if c in counted.columns]
    often = counted.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 1").select(*keys)
    # dealt before they are collected: lists of one hash each would be moved otherwise
    return counted.select("tk", *keys).join(often, keys).select("tk", "h").repartition("tk").groupBy("tk").agg(F.collect_list("h").alias("hs"))


def _finish(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text")):
                text = batch.column("text").slice(i, j - i)
                w = Words(text)
                x = Windows(w, window)
                copies = np.asarray(batch.column("copies").slice(i, j - i))
                gone = np.zeros(len(w.hash) + 1, np.int64)
                full = x.hash[-1]
                if len(full):
                    own = x.doc[: len(full)]
                    hit = np.flatnonzero(x.matters[-1] & ((copies[own] > 1) | _member(own, full, batch.column("hs").slice(i, j - i))))
                    np.add.at(gone, hit, 1)
                    np.add.at(gone, hit + window, -1)
                covered = np.cumsum(gone)[:-1] > 0
                n, removed, kept = np.diff(w.first), [], []
                for k in range(j - i):
                    out = covered[w.first[k] : w.first[k + 1]]
                    own = text[k].as_py().encode().split()
                    cut = int(out.sum())
                    removed.append(cut)
                    kept.append(b" ".join([y for y, z in zip(own, out.tolist(), strict=True) if not z] if cut else own))
                columns = [batch.column("tk").slice(i, j - i), pa.array(n), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(y).hexdigest() for y in kept])]
                names = ["tk", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array([y.decode() for y in kept])], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    A word goes if a window of `window` consecutive words of its text covers it whose words also start
    anywhere else, in the same text or another; all windows are judged on the input. A null text has no
    words; a text shorter than the window loses none. Rows repeated as a whole count as often as they
    occur. Kept words are joined by one space. Other columns of docs are left out. An empty table gives an
    empty table.

    Texts are shuffled once, equal ones folded before the shuffle; all later steps read that shuffle
    again. Counts are pre-aggregated within each text. Below the full length 64-bit hashes only
    propose; at the full length 128 bits decide. A level at which no candidate survives leaves
    an empty table, and what would follow it is not run (adaptive execution drops joins with it).
    """
    # the same condition wherever the texts are read, so that their shuffle is one and the same
    base = docs.select("doc_id", common.text_or_empty().alias("text"), common.text_key().alias("tk")).where("tk IS NOT NULL")
    texts = base.groupBy("tk").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    levels = len(lengths(window))
    lists = None
    for level in range(levels):
        rows = texts if lists is None else texts.join(lists.hint("merge"), "tk")
        lists = repeated(rows.mapInArrow(_count_level(window, level), COUNTED_TWICE if level == levels - 1 else COUNTED))
    schema = "tk binary, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    done = texts.join(lists.hint("merge"), "tk", "left").mapInArrow(_finish(window, with_text), schema)
    return base.select("doc_id", "tk").join(done, "tk").drop("tk")


def longest_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(tk, words): for each text with a repeat, the greatest length window * 2**k at which one of its windows still repeats.

    Doubles the length from `window` on, each time over the texts alone that had a repeat at the length
    before, until none is left.
    """
    base = docs.select(common.text_or_empty().alias("text"), common.text_key().alias("tk"))
    left = base.groupBy("tk").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    found: DataFrame | None = None
    while True:
        counted = left.mapInArrow(_full(window), COUNTED_TWICE)
        often = counted.groupBy("h", "g").agg(F.sum("n").alias("n")).where("n > 1").select("h", "g")
        level = common.written(counted.join(often, ["h", "g"]).select("tk").union(counted.join(left.where("copies > 1"), "tk", "left_semi").select("tk")).distinct(), "level")
        if not level.limit(1).count():
            return found if found is not None else level.select("tk", F.lit(0).alias("words")).limit(0)
        step = level.select("tk", F.lit(window).alias("words"))
        found = step if found is None else found.union(step).groupBy("tk").agg(F.max("words").alias("words"))
        left, window = left.join(level, "tk", "left_semi"), window * 2


def _full(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text")):
                x = Windows(Words(batch.column("text").slice(i, j - i)), window, window)
                at = np.flatnonzero(x.matters[-1])
                if len(at):
                    yield _counted(x.doc[at], x.hash[-1][at], batch.column("tk").slice(i, j - i), x.second()[at])

    return run


def op5_levelwise_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir).select("doc_id", "text"))
