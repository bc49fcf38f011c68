"""Vectors against vectors in blocks: matrix products inside tasks, of which only what is asked for comes out.

Of each group one side is cut into blocks of a bounded number of vectors, a cell each. A task holds one block
and has the rows of the other side stream past it, so its memory does not grow with the group, and a large
group is spread over as many tasks as it has blocks. Rows are compared where they meet: pairs are not
shuffled, only results are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a product that a task holds at a time (8 bytes each), and tasks that a join is dealt over at most.
CELLS, MOST_TASKS = 1 << 22, 2048
#: What rounding to six digits and the order of a sum may make of a value.
SLACK = 2e-6
#: Values that stand for a cosine in the order of results: of a NaN, of a missing vector, and of a pair that is not asked for.
NAN, NULL, OUT = 2.0, -2.0, -3.0


def rounded(c: np.ndarray) -> np.ndarray:
    """c at six digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(c) * 1e6 + 0.5), c) / 1e6 + 0.0


class Rows:
    """Ids and vectors of some rows. same: whether a row belongs to the block that is held."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        chunked = isinstance(batch, pa.Table)
        column = lambda name: batch.column(name).combine_chunks() if chunked else batch.column(name)
        self.id = column("_id").to_numpy(zero_copy_only=False)
        v = column("_v")
        self.null = v.is_null().to_numpy(zero_copy_only=False)
        flat = v.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        there = len(v) - v.null_count
        self.v = flat.reshape(there, -1 if there else 0)
        if v.null_count:
            whole = np.zeros((len(v), self.v.shape[1]))
            whole[~self.null] = self.v
            self.v = whole
        self.nan = ~np.isfinite(self.v).all(axis=1) if len(v) else np.zeros(0, bool)
        if self.nan.any():
            self.v = np.where(self.nan[:, None], 0.0, self.v)
        self.same = column("_same").to_numpy(zero_copy_only=False)

    def take(self, at) -> Rows:
        """Some of the rows, by a slice or positions."""
        out = object.__new__(Rows)
        out.id, out.v, out.null, out.nan, out.same = self.id[at], self.v[at], self.null[at], self.nan[at], self.same[at]
        return out

    def __len__(self) -> int:
        return len(self.id)


class Work:
    """What a cell does: `begin` gets the block that is held, `step` some rows that meet it, `end` comes after the last of them.

    step and end give tuples of columns.
    """

    def begin(self, y: Rows) -> None:
        self.y = y

    def step(self, x: Rows) -> Iterator[tuple]:
        raise NotImplementedError

    def end(self) -> Iterator[tuple]:
        return iter(())


def products(x: Rows, y: Rows) -> np.ndarray:
    """Cosines of all x with all y, with NULL and NAN in their places."""
    if not x.v.size or not y.v.size:
        return np.full((len(x), len(y)), NULL)
    c = x.v @ y.v.T
    for bad, value in (("nan", NAN), ("null", NULL)):
        if (rows := getattr(x, bad)).any():
            c[rows] = value
        if (columns := getattr(y, bad)).any():
            c[:, columns] = value
    return c


class Pairs(Work):
    """The pairs at or above a threshold: least id, greatest id, cosine. `sketch` leaves out what shares no bucket."""

    def __init__(self, at_least: float, sketch=None):
        self.at_least, self.sketch = at_least, sketch

    def begin(self, y: Rows) -> None:
        super().begin(y)
        if self.sketch:
            self.sketch.begin(y)

    def found(self, x: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in x and y of the pairs, and their cosines at six digits."""
        y = self.y
        seen = self.sketch.seen(x) if self.sketch else None  # none if all pairs have to be compared
        if seen is not None and np.count_nonzero(seen) * 20 < seen.size:  # then it is cheaper to pick than to multiply
            i, j = np.divmod(np.flatnonzero(seen), len(y))
            good = ~(x.null | x.nan)[i] & ~(y.null | y.nan)[j]
            i, j = i[good], j[good]
            step = max(1, CELLS // max(1, x.v.shape[1]))
            c = [np.einsum("ij,ij->i", x.v[i[k : k + step]], y.v[j[k : k + step]]) for k in range(0, len(i), step)]
            c = np.concatenate(c) if c else np.zeros(0)
        else:
            tile = products(x, y)
            hit = tile >= self.at_least - SLACK
            if seen is not None:
                hit &= seen
            i, j = np.divmod(np.flatnonzero(hit), max(1, len(y)))
            c = tile[i, j]
        c = rounded(c)
        if (c > 1.5).any():
            c = np.where(c > 1.5, np.nan, c)
        # in the block that is held itself a pair would come up from both of its sides
        after = np.searchsorted(y.id, x.id, side="right")
        ok = ~(c < self.at_least) & (~x.same[i] | (j >= after[i]))
        return i[ok], j[ok], c[ok]

    def step(self, x: Rows) -> Iterator[tuple]:
        i, j, c = self.found(x)
        if len(i):
            a, b = x.id[i], self.y.id[j]
            less = a < b
            yield np.where(less, a, b), np.where(less, b, a), c


class Met(Pairs):
    """All pairs that share a bucket, whatever their cosine."""

    def step(self, x: Rows) -> Iterator[tuple]:
        i, j = np.divmod(np.flatnonzero(self.sketch.seen(x, whole=True)), max(1, len(self.y)))
        after = np.searchsorted(self.y.id, x.id, side="right")
        ok = (~x.same[i] | (j >= after[i])) & ~x.null[i] & ~self.y.null[j]
        a, b = x.id[i[ok]], self.y.id[j[ok]]
        if len(a):
            yield np.where(a < b, a, b), np.where(a < b, b, a)


class Links(Pairs):
    """A link from each row to one of those that it pairs with, and links that hold together what pairs with one row.

    The components are those of all pairs, from no more links than there are rows.
    """

    def begin(self, y: Rows) -> None:
        super().begin(y)
        self.root = np.arange(len(y))

    def step(self, x: Rows) -> Iterator[tuple]:
        i, j, _ = self.found(x)
        if len(i):
            rows, first = np.unique(i, return_index=True)
            one = np.zeros(len(x), np.int64)
            one[rows] = j[first]
            unite(self.root, one[i], j)
            yield x.id[rows], self.y.id[j[first]]

    def end(self) -> Iterator[tuple]:
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        if len(moved):
            yield self.y.id[moved], self.y.id[self.root[moved]]


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Puts i and j into one component each; root[k] is the least of k's component, before and after."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


class Nearest(Work):
    """Of each row the k nearest in the block: query id, id, cosine at six digits. By cosine, then the lesser id.

    only: `earlier` for ids below the query's, `other` for all but its own.
    """

    def __init__(self, k: int, only: str | None = None):
        self.k, self.only = k, only

    def step(self, x: Rows) -> Iterator[tuple]:
        y, n = self.y, len(self.y)
        c = products(x, y)
        if self.only:
            at = np.searchsorted(y.id, x.id, side="left")
            if self.only == "earlier":
                c[np.arange(n) >= at[:, None]] = OUT
            else:
                past = np.searchsorted(y.id, x.id, side="right")
                own = np.arange(n)
                c[(own >= at[:, None]) & (own < past[:, None])] = OUT
        floor = np.maximum(self.floor(c), (NULL + OUT) / 2)
        i, j = np.divmod(np.flatnonzero(c >= floor[:, None]), n)
        r = rounded(c[i, j])
        # one number orders all: row, then cosine from above, then place, which is the order of ids
        key = np.sort((i * 8_000_000 + np.rint((NAN - r) * 1e6).astype(np.int64)) * n + j)
        i, j = key // n // 8_000_000, key % n
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[nth < self.k], j[nth < self.k]
        r = rounded(c[i, j])
        value = pa.array(np.where(r > 1.5, np.nan, r), mask=r < -1.5)
        if len(i):
            yield x.id[i], y.id[j], value

    def floor(self, c: np.ndarray) -> np.ndarray:
        """Of each row a value that k of its cells reach, less what rounding may bring up to it: the k-th greatest of the greatest of equal parts."""
        m, n = c.shape
        parts = max(self.k, 256)
        if n < 2 * parts:
            best = c
        else:
            width = n // parts
            best = c[:, : parts * width].reshape(m, parts, width).max(axis=2)
        if best.shape[1] <= self.k:
            return np.full(m, OUT)
        return np.partition(best, best.shape[1] - self.k, axis=1)[:, best.shape[1] - self.k] - SLACK


def meeting(x: DataFrame, y: DataFrame | None, by: list[str], block: int, work: Callable[[], Work], columns: str) -> DataFrame:
    """by, columns: what `work` makes of the rows of x and those of y of the same group.

    x, y: by, _id, _v (an array, of one length, or null). Without y the rows of x meet each other, each unordered
    pair of rows once; block i goes past half of the other blocks, so that all cells have about as much to do.
    """
    sizes = (x if y is None else y).groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_m"))
    cells = sizes.agg(F.sum("_m").alias("n")).first()["n"] or 0
    part = F.pmod(F.xxhash64("_id"), F.col("_m")).cast("int")  # the same when a task runs again
    layout = [*by, "_block", "_streamed", "_same", "_id", "_v"]
    if y is None:
        own = x.join(sizes, by).withColumn("_own", part)
        held = own.withColumns({"_block": F.col("_own"), "_streamed": F.lit(False), "_same": F.lit(True)})
        ahead = F.pmod(F.col("_block") - F.col("_own"), F.col("_m"))
        half = (ahead * 2 < F.col("_m")) | ((ahead * 2 == F.col("_m")) & (F.col("_own") < F.col("_block")))
        sent = own.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).where(half)
        sent = sent.withColumns({"_streamed": F.lit(True), "_same": F.col("_own") == F.col("_block")})
    else:
        held = y.join(sizes, by).withColumns({"_block": part, "_streamed": F.lit(False), "_same": F.lit(False)})
        sent = x.join(sizes, by).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        sent = sent.withColumns({"_streamed": F.lit(True), "_same": F.lit(False)})
    keys = [*by, "_block"]
    # more tasks than cells, since a hash deals them
    dealt = held.select(layout).union(sent.select(layout)).repartition(max(1, min(4 * cells, MOST_TASKS)), *keys).sortWithinPartitions(*keys, "_streamed")
    kinds = dict(x.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), columns])
    return dealt.mapInArrow(_cells(keys, by, work, [*by, *(c.split()[0] for c in columns.split(", "))]), schema)


def _cells(keys: list[str], by: list[str], work: Callable[[], Work], names: list[str]):
    """Goes through rows in order of their cells, first the rows that are held, then those that meet them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, does, held, group = None, None, [], ()

        def out(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for columns in found:
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns]
                arrays = [pa.array([g.as_py()] * len(arrays[0]), g.type) for g in group] + arrays
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(max(0, n - 1), bool)
            for k in (*keys, "_streamed"):
                c = batch.column(k)
                change |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                piece = batch.slice(start, stop - start)
                key = tuple(piece.column(k)[0].as_py() for k in keys)
                if key != now:
                    if does is not None:
                        yield from out(does.end())
                    now, does, held, group = key, None, [], tuple(piece.column(k)[0] for k in by)
                if not piece.column("_streamed")[0].as_py():
                    held.append(piece)
                    continue
                if not held:  # nothing to meet
                    continue
                if does is None:
                    y = Rows(pa.Table.from_batches(held))
                    does = work()
                    does.begin(y.take(np.argsort(y.id, kind="stable")))
                x, rows = Rows(piece), max(1, CELLS // len(does.y))
                for k in range(0, len(x), rows):
                    yield from out(does.step(x.take(slice(k, k + rows))))
        if does is not None:
            yield from out(does.end())

    return run
