"""Words of a batch of texts as arrays: byte bounds and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are handled in slices of about so many bytes, so that memory does not follow the batch.
SLICE_BYTES = 2 << 20
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES each, one row at least."""
    n = len(text)
    if not n:
        return
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    first = 0
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + SLICE_BYTES, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


class Words:
    """The words of a slice of texts.

    data: the bytes; start, end: byte bounds of each word; first: index of each text's first
    word, with the number of words at the end; hash: a 64-bit hash of each word.
    """

    def __init__(self, text: pa.Array, lower: bool = False):
        n = len(text)
        off = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
        raw = text.buffers()[2]
        size = int(off[-1] - off[0])
        data = np.zeros(size + 8, np.uint8)
        if size:
            data[:size] = np.frombuffer(raw, np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        if lower:
            data[(data >= 65) & (data <= 90)] += 32
        body = data[:size]
        in_word = ~((body == 32) | ((body >= 9) & (body <= 13)))
        edge = np.zeros(size + 1, bool)
        edge[off] = True
        before = np.zeros(size, bool)
        before[1:] = in_word[:-1]
        after = np.zeros(size, bool)
        after[:-1] = in_word[1:]
        self.data, self.size = data, size
        self.start = np.flatnonzero(in_word & (~before | edge[:-1]))
        self.end = np.flatnonzero(in_word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        length = self.end - self.start
        if not len(length):
            return np.zeros(0, np.uint64)
        eight = np.lib.stride_tricks.as_strided(self.data.view(np.uint8)[:8].view(np.uint64), shape=(self.size + 1,), strides=(1,))
        keep = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
        out = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        left = np.arange(len(length))
        at = 0
        while len(left) and at < _LONG:
            out[left] = mix(out[left] ^ (eight[self.start[left] + at] & keep[np.minimum(length[left] - at, 8)]))
            at += 8
            left = left[length[left] > at]
        for k in left:
            out[k] = xxhash.xxh64_intdigest(self.data[self.start[k] : self.end[k]].tobytes())
        return out

    def doc_of(self) -> np.ndarray:
        """The index of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, at each place where k words follow; texts are not told apart."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return out


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """As grams, in time that does not depend on k: doubles the length, then overlaps two windows."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    size, out = 1, mix(h + np.uint64(1))
    while size < k:
        step = min(size, k - size)
        out = mix(out[: len(out) - step] * np.uint64(0x9E3779B97F4A7C15) + (out[step:] ^ np.uint64(size + step)))
        size += step
    return out
