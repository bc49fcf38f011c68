"""Document fingerprints by winnowing, in DataFrame operations alone.

A text's tokens are its words, cut after 16 characters. Hashes of each K consecutive tokens roll over
the text; of each WINDOW consecutive hashes the least is chosen, the rightmost if several are, and kept
with its place. Two texts that share a run of K + WINDOW - 1 tokens share a chosen hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.llm import common

K = 5
WINDOW = 16
_TOKEN = r"([^\x20\x09-\x0D]{1,16})"
#: Hash bits and place bits of a packed value; places are kept modulo 2 ** _PLACE.
_HASH, _PLACE = 40, 23
_MASK = (1 << _PLACE) - 1


def _ahead(x: Column, n: int) -> Column:
    """x without its first n elements."""
    return F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))


def _but(x: Column, n: int) -> Column:
    """x without its last n elements."""
    return F.slice(x, 1, F.greatest(F.size(x) - n, F.lit(0)))


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: array<struct<hash, place>>, by place.

    A text of fewer than K tokens has one hash, of all its tokens, at place 0; one without tokens, or a
    null, has an empty fingerprint. A text of fewer than WINDOW hashes has its least one. Hashes have 40 bits.
    Equal hashes more than 2**23 tokens into a text, on either side of a multiple of 2**23, are told
    apart leftmost first. Each step is a column of its own, so that none is worked out twice.
    """
    c = lambda n: F.col(f"_{n}")
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_TOKEN), F.lit(1))
    df = df.withColumn("_1", F.transform(tokens, lambda t: F.xxhash64(t)))
    # windows of 1, 2, 4, then 5 tokens
    two = F.zip_with(_but(c(1), 1), _ahead(c(1), 1), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_2", two)
    four = F.zip_with(_but(c(2), 2), _ahead(c(2), 2), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_4", four)
    five = F.zip_with(_but(c(4), 1), _ahead(c(1), 4), lambda a, b: F.xxhash64(a, b))
    whole = F.when(F.size(c(1)) > 0, F.array(F.xxhash64(c(1)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_g", F.when(F.size(c(1)) < K, whole).otherwise(five))
    # hash in the high bits, then the place counted down, so that the least value is rightmost
    pack = F.transform(c("g"), lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 64 - _HASH), _PLACE).bitwiseOR(F.lit(_MASK).cast("long") - i.bitwiseAND(_MASK).cast("long")))
    df = df.withColumn("_m1", pack)
    size = 1
    while size < WINDOW:
        x = F.col(f"_m{size}")
        least = F.zip_with(_but(x, size), _ahead(x, size), lambda a, b: F.least(a, b))
        # too short a text: the least of all it has, found once by array_min below
        df = df.withColumn(f"_m{size * 2}", least)
        size *= 2
    chosen = F.when(F.size(c("g")) == 0, F.array().cast("array<bigint>")).when(F.size(c("g")) < WINDOW, F.array(F.array_min(c("m1")))).otherwise(F.array_distinct(c(f"m{WINDOW}")))
    df = df.withColumn("_c", chosen)
    found = F.transform(c("c"), lambda v: F.struct(F.shiftrightunsigned(v, _PLACE).alias("hash"), (F.lit(_MASK).cast("long") - v.bitwiseAND(_MASK)).alias("place")))
    return df.withColumn(out, found).drop("_1", "_2", "_4", "_g", "_c", *[f"_m{1 << k}" for k in range(WINDOW.bit_length()) if 1 << k <= WINDOW])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of the hashes; two empty fingerprints are alike, one alone is like no other."""
    x, y = F.array_distinct(a["hash"]), F.array_distinct(b["hash"])
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(x) + F.size(y) - both)).cast("double")


def listed(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit("@"), x["place"].cast("string"))), ",")


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """docs with next_<c> for each of columns: its value in the row with the next id, after the last the first.

    Rows are dealt by ranges of ids, at boundaries that one aggregate over the ids gives; an id (or null) that
    fills several ranges is parted among them by its texts' checksums. Within a range the next row stands
    beside. The row that begins each range is put at the end of the range before as well, so that no row has to
    look into another task. Ties of the id are ordered by the text's checksum, then by text; a null id comes
    first. Rows equal in id and text are alike, and stay in one range.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx(id_col, [(i + 1) / n for i in range(n - 1)], 10 * n).alias("c"), F.count_if(F.col(id_col).isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows")).first()
    if not found["rows"]:
        return docs.withColumns({f"next_{c}": F.col(c) for c in columns})
    cuts = found["c"] or []
    # how many ranges a value fills: one, but for ids that are cuts several times, and for null
    fills = {x: cuts.count(x) for x in sorted(set(cuts))}
    no_id = max(1, -(-found["nulls"] * n // found["rows"]))
    most = max([no_id, *fills.values()])
    bounds = list(fills)
    many = [x for x in bounds if fills[x] > 1]
    at = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in bounds]), lambda x: x < F.col(id_col))) if bounds else F.lit(0)
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for x in many for v in (x, fills[x])]), F.col(id_col)), F.lit(1)) if many else F.lit(1)
    part = lambda k: F.floor(F.col("_check") * k / 2**32).cast("int")
    bucket = F.when(F.col(id_col).isNull(), part(F.lit(no_id)) - most).otherwise(at * most + part(share))
    rows = docs.withColumn("_check", F.crc32(F.col("text").cast("binary"))).withColumn("_bucket", bucket)
    order = [F.col(id_col).asc_nulls_first(), "_check", "text"]
    # the first row of each range goes to the range before it as well, that of the first to the last
    least = F.min(F.struct(F.col(id_col).isNotNull().alias("some"), F.col(id_col).alias("id"), F.col("_check").alias("check"))).alias("least")
    starts = rows.groupBy("_bucket").agg(least).orderBy("_bucket").collect()
    goes = [(b["_bucket"], a["_bucket"], b["least"]["id"], b["least"]["check"]) for a, b in zip([starts[-1], *starts[:-1]], starts, strict=True)]
    first = spark.createDataFrame(goes, "_bucket int, _to int, _id long, _first long")  # a row a range
    # told by id and checksum before anything else of a row is worked out
    maybe = (F.col(id_col).isin([x[2] for x in goes if x[2] is not None]) | F.col(id_col).isNull()) & F.col("_check").isin([x[3] for x in goes])
    opens = rows.where(maybe).join(F.broadcast(first), "_bucket").where(F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_check") == F.col("_first")))
    opens = opens.withColumn("_n", F.row_number().over(W.partitionBy("_bucket").orderBy("text"))).where("_n = 1")
    opens = opens.withColumn("_bucket", F.col("_to")).withColumn("_extra", F.lit(1)).drop("_to", "_id", "_first", "_n")
    both = rows.withColumn("_extra", F.lit(0)).unionByName(opens)
    beside = W.partitionBy("_bucket").orderBy("_extra", *order)
    return both.withColumns({f"next_{c}": F.lead(c).over(beside) for c in columns}).where("_extra = 0").drop("_bucket", "_extra", "_check")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", common.text_or_empty().alias("text"))
    found = with_next(fingerprinted(docs, "text", "fp"), ["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = found.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    out = fingerprinted(edited, "edited", "edited_fp")
    return out.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        listed(F.col("fp")).alias("fingerprint"), listed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
