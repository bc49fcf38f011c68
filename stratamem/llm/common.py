"""Shared helpers: reading tables, row keys, and tables written between steps."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir).

    A folder of our own is made only where the setting is absent, as in local tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again.

    This cuts the lineage: what was written outlives the executors that made it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The columns of documents, which stages read and write.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def other_columns_apart(stage: Stage) -> Stage:
    """A stage that hands on columns other than COLUMNS as they came, in one struct while it works, so that their names meet none of its own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        own = [c for c in docs.columns if c in COLUMNS]
        found = stage(spark, docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in others]).alias("other_columns")), sf_dir)
        return found.select(*[F.col(c) if c in own else F.col(f"other_columns.`{c}`").alias(c) for c in docs.columns])

    return run


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text") -> Column:
    """16 bytes that tell texts apart; a null text counts as an empty one."""
    return F.unhex(F.md5(text_or_empty(name)))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """16 bytes that tell rows apart by id and text; only rows equal in both share a key."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.lit(":"), text_or_empty(text_col))))


def words(col: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value worked out once however often body uses it, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements that a prefix is folded over before it is looked up.
_BLOCK = 64


def prefixes(x: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of ints what merge makes of all elements before it, from 0: running sums or maxima.

    Blocks are folded once, so that a long array costs little more than its length (an aggregate that
    appends to an array would copy it each time).
    """
    fold = lambda part: F.aggregate(part, F.lit(0), merge)
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    whole = lambda xs: F.transform(F.sequence(F.lit(0), block(F.size(xs))), lambda b: fold(F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK))))
    starts = lambda s: F.transform(s, lambda _v, b: fold(F.slice(s, F.lit(1), b)))
    each = lambda xs, o: F.transform(xs, lambda _v, i: merge(F.get(o, block(i)), fold(F.slice(xs, block(i) * _BLOCK + 1, i % _BLOCK))))
    return let(x, lambda xs: let(whole(xs), lambda s: let(starts(s), lambda o: each(xs, o))))


#: Characters of a block of a long text, so that a piece is not sought from the text's beginning.
_CHARS = 8192


def patched(text: Column, spans: Column, new: Callable[[Column], Column]) -> Column:
    """text with each span (start, end in code points, ascending by start) replaced by new(span).

    A span that starts inside an earlier one is not replaced, but reaches as far as it does.
    """

    def put(xs: Column, upto: Column, blocks: Column) -> Column:
        near = lambda at: F.concat(F.get(blocks, F.floor(at / _CHARS).cast("int")), F.coalesce(F.get(blocks, F.floor(at / _CHARS).cast("int") + 1), F.lit("")))
        cut = lambda at, n: F.when(n == 0, "").when(n <= _CHARS, F.substring(near(at), at % _CHARS + 1, n)).otherwise(F.substring(text, at + 1, n))
        piece = lambda x, at: F.when(x["start"] >= at, F.concat(cut(at, x["start"] - at), new(x))).otherwise(F.lit(""))
        pieces = F.transform(xs, lambda x, i: piece(x, F.get(upto, i)))
        last = F.array_max(F.transform(xs, lambda x: x["end"]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))

    ends = lambda xs: prefixes(F.transform(xs, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / _CHARS).cast("int")), lambda b: F.substring(text, b * _CHARS + 1, F.lit(_CHARS)))
    return F.when(F.size(spans) == 0, text).otherwise(let(spans, lambda xs: let(ends(xs), lambda upto: let(blocks, lambda b: put(xs, upto, b)))))
