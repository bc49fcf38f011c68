"""Source divergence audit: how each source's words differ from its language's and from each other source's.

Counting is an Arrow compute pipeline inside mapInArrow: ascii_lower, split_pattern_regex,
dictionary_encode and hash group_by turn a batch of texts into partial counts, which Spark adds up. The
kept counts then go to shards by term; in a shard a term is a column over the sources of its language, and
the differences of all sources are worked out from columns, many terms at once.

All arithmetic is exact: a source gives a term p = 1 + floor(SCALE (count + PRIOR) / (N + PRIOR V)) with
N its kept words and V the language's kept terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamem.llm import common

SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term occurs in, at least.
LEAST_DOCUMENTS = 30
SCALE, PRIOR = 1_000_000_000, 5
#: Ranks of part `term`.
TERM_RANKS = 50
#: Bytes of text counted at once, about, and partial counts held before they are handed on.
_SLICE_BYTES, _HELD = 4 << 20, 250_000
#: Sources that meet in one block of pairs, and cells of a matrix.
BLOCK, _CELLS = 256, 1 << 20

_COUNTS = "lang string, source string, term string, n long, docs long"
_PAIRS = "lang string, a int, b int, value long"


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about _SLICE_BYTES of text, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n (occurrences), docs (texts) of a few texts."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), SEPARATORS)
    rows, terms = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    real = pc.not_equal(terms, "")
    terms = pc.filter(terms, real).dictionary_encode()
    by_text = pa.table({"row": pc.filter(rows, real), "code": terms.indices}).group_by(["row", "code"]).aggregate([([], "count_all")]).combine_chunks()
    at = by_text["row"]
    named = pa.table({"lang": pc.take(batch.column("lang"), at), "source": pc.take(batch.column("source"), at), "code": by_text["code"], "n": by_text["count_all"]})
    summed = named.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    return pa.table({"lang": summed["lang"], "source": summed["source"], "term": pc.take(terms.dictionary, summed["code"]), "n": summed["n_sum"], "docs": summed["count_all"]})


def _merged(parts: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table({"lang": summed["lang"], "source": summed["source"], "term": summed["term"], "n": summed["n_sum"], "docs": summed["docs_sum"]})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a partition's texts; what is held is merged when it grows, and handed on when merging no longer shrinks it."""
    parts: list[pa.Table] = []
    for batch in batches:
        for some in _slices(batch):
            parts.append(_counted(some))
            if sum(x.num_rows for x in parts) > _HELD:
                parts = [_merged(parts)]
                if parts[0].num_rows > _HELD // 2:
                    yield from parts.pop().combine_chunks().to_batches()
    if parts:
        yield from _merged(parts).combine_chunks().to_batches()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: how often a source has a term, and in how many of its documents."""
    said = docs.select(*[F.coalesce(F.col(k), F.lit("")).alias(k) for k in ("lang", "source", "text")])
    return said.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class _Columns:
    """Sums of differences between the sources of two blocks x <= y of a language, over columns of terms."""

    def __init__(self, x: int, y: int, s: np.ndarray, zeros: np.ndarray):
        self.x, self.y = x, y
        self.sources = np.sort(s)
        self.zeros = zeros[np.argsort(s)]
        self.split = 0 if x == y else int(np.searchsorted(self.sources, y * BLOCK))
        self.sums = np.zeros((len(s), len(s)), np.int64)

    def _gaps(self, a: int, m: np.ndarray) -> np.ndarray:
        """Absolute differences of row a to the rows it is paired with."""
        return np.abs(m[max(a + 1, self.split) :] - m[a])

    def rows(self) -> range:
        return range(self.split or len(self.sources))

    def add(self, term: np.ndarray, s: np.ndarray, p: np.ndarray) -> None:
        """Terms as numbers 0, 1, ... in order; a source that lacks one has its zero there."""
        for lo in range(0, int(term[-1]) + 1, step := max(1, _CELLS // len(self.sources))):
            a, b = np.searchsorted(term, [lo, lo + step])
            n = min(step, int(term[-1]) + 1 - lo)
            m = np.repeat(self.zeros[:, None], n, axis=1)
            m[np.searchsorted(self.sources, s[a:b]), term[a:b] - lo] = p[a:b]
            for k in self.rows():
                self.sums[k, max(k + 1, self.split) :] += self._gaps(k, m).sum(axis=1) - n * self._gaps(k, self.zeros)

    def pairs(self, lang: str, everywhere: int) -> pa.RecordBatch:
        """lang, a, b, value; `everywhere` terms count as if no source had them."""
        a, b, value = [], [], []
        for k in self.rows():
            first = max(k + 1, self.split)
            a.append(np.full(len(self.sources) - first, self.sources[k]))
            b.append(self.sources[first:])
            value.append(self.sums[k, first:] + everywhere * self._gaps(k, self.zeros))
        cat = lambda v, t: pa.array(np.concatenate(v) if v else np.empty(0), t)
        return pa.RecordBatch.from_arrays([pa.array([lang] * sum(map(len, a)), pa.string()), cat(a, pa.int32()), cat(b, pa.int32()), cat(value, pa.int64())], ["lang", "a", "b", "value"])


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of each (lang, x, y, shard), rows sorted by these and term; rows without a term come first and say what a missing count gives."""
    key, cols, held, everywhere = None, None, None, 0

    def flush(keep: bool) -> None:
        """Adds what is held up; the last term's rows are kept where more of them may follow."""
        nonlocal held
        if held is None:
            return
        at = pc.not_equal(held["term"][1:], held["term"][:-1]).to_numpy(zero_copy_only=False) if held.num_rows > 1 else np.empty(0, bool)
        term = np.concatenate([[0], np.cumsum(at)])
        upto = int(np.searchsorted(term, term[-1])) if keep else held.num_rows
        if upto:
            cols.add(term[:upto], held["s"].to_numpy()[:upto], held["p"].to_numpy()[:upto])
        held = pa.Table.from_batches(held.slice(upto).combine_chunks().to_batches(), held.schema) if upto < held.num_rows else None

    for batch in batches:
        names = ["lang", "x", "y", "shard"]
        changed = np.zeros(batch.num_rows, bool)
        for k in names if batch.num_rows > 1 else ():
            changed[1:] |= pc.not_equal(batch.column(k)[1:], batch.column(k)[:-1]).to_numpy(zero_copy_only=False)
        changed[:1] = True
        cuts = [*np.flatnonzero(changed).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            run = batch.slice(lo, hi - lo)
            found = tuple(run.column(k)[0].as_py() for k in names)
            if found != key:
                if cols is not None:
                    flush(False)
                    yield cols.pairs(key[0], everywhere if key[3] == 0 else 0)
                key, cols, held, header = found, None, None, []
            heads = run.column("term").null_count
            if heads:  # may go on in the next batch
                header.append(run.slice(0, heads))
                all_of = pa.Table.from_batches(header)
                cols = _Columns(key[1], key[2], all_of["s"].to_numpy(), all_of["p"].to_numpy())
                everywhere = all_of["v"][0].as_py()
            if heads < run.num_rows:
                more = pa.Table.from_batches([run.slice(heads)])
                held = more if held is None else pa.concat_tables([held, more])
                flush(True)
    if cols is not None:
        flush(False)
        yield cols.pairs(key[0], everywhere if key[3] == 0 else 0)


def _share(n: str, total: str) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR v)), exact; null where the language keeps no term."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + {PRIOR} AS DECIMAL(20, 0))) div nullif(CAST({total} + {PRIOR} * v AS DECIMAL(20, 0)), 0)")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: how far a source is from each other source of its language, summed over all kept terms,
    farthest first. Part `term`: the terms that it uses more than its language does, the first `ranks` of them.
    Ties go by item in UTF-8 order. A term is kept if it is in `least` documents of the language.

    Null lang, source and text count as empty strings; rows equal in all count each. A language without kept terms
    gives pairs of value 0, a language of one source no pairs, an empty table nothing. Other columns of
    docs, whatever their names, are not read.

    Texts are not shuffled, only partial counts. The table of groups (a row a source of a language) is written,
    so that Spark knows its size when it joins it; pairs are worked out in blocks of BLOCK sources.
    """
    spark = docs.sparkSession
    found = common.written(counts(docs), "term-counts")
    terms = found.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n")).where(F.col("in_docs") >= least).drop("in_docs")
    kept = common.written(found.drop("docs").join(terms, ["lang", "term"]), "kept-counts")

    every = docs.select(*[F.coalesce(F.col(k), F.lit("")).alias(k) for k in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    by_lang = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("whole"))
    numbered = every.join(own, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["own", "v", "whole"])
    groups = common.written(numbered.withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("zero", F.coalesce(_share("0", "own"), F.lit(0))), "groups")

    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "s", _share("n", "own").alias("p"), _share("lang_n", "whole").alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = F.floor(F.col("s") / BLOCK).cast("int")
    blocks = groups.groupBy("lang").agg(F.floor(F.max("s") / BLOCK).cast("int").alias("last"))
    met = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    heads = groups.join(blocks, "lang").select("lang", F.lit(None).cast("string").alias("term"), "s", F.col("zero").alias("p"), "v", met).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    cells = shares.join(blocks, "lang").select("lang", "term", "s", "p", F.lit(0).cast("long").alias("v"), met).withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int"))
    rows = heads.unionByName(cells).select("lang", F.least(block, "other").alias("x"), F.greatest(block, "other").alias("y"), "shard", "term", "s", "p", "v")
    at = ["lang", "x", "y", "shard"]
    sums = rows.repartition(*at).sortWithinPartitions(*at, F.asc_nulls_first("term")).mapInArrow(_differ, _PAIRS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t")))).alias("e"), "value").select("lang", "e.s", "e.t", "value")
    name = lambda number, new: groups.select("lang", F.col("s").alias(number), F.col("source").alias(new))
    pairs = both.join(name("s", "source"), ["lang", "s"]).join(name("t", "item"), ["lang", "t"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(more)


#: The same in SQL. Characters below U+0080 that are no letters part terms; only A-Z has a lower-case form here.
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_P = f"1 + ({SCALE}::HUGEINT * ({{n}} + {PRIOR})) // ({{total}} + {PRIOR} * v)"
ORACLE = {
    "op13_source_divergence": rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_AZ}', '{_AZ.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM counted GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCUMENTS}),
cells AS (SELECT k.lang, k.term, g.source, coalesce(c.n, 0) AS n, k.lang_n FROM kept k JOIN (SELECT DISTINCT lang, source FROM d) g ON g.lang = k.lang
  LEFT JOIN counted c ON c.lang = k.lang AND c.source = g.source AND c.term = k.term),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own, sum(n) OVER (PARTITION BY lang) AS whole, count(*) OVER (PARTITION BY lang, source) AS v FROM cells),
shares AS (SELECT lang, source, term, n, {_P.format(n="n", total="own")} AS p, {_P.format(n="lang_n", total="whole")} AS q FROM sized),
g AS (SELECT DISTINCT lang, source FROM d),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= {TERM_RANKS}"""
}


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir).select("lang", "source", "text"))
