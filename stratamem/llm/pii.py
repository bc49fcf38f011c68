"""Personal data: patterns, and terms that reveal what the patterns protect, in DataFrame operations alone.

Addresses and numbers are found by pattern. Each distinct value is a protected entity. A term discloses
an entity as far as the corpus ties the two together: the pointwise mutual information of both in whole
documents, held against the information content of the entity. At 1 the term occurs only with the entity
and gives it away; terms above a threshold are generalised, and those above a higher one removed,
wherever they stand and in every document, with the entity or without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.llm import common

_LOCAL = "[A-Za-z0-9._%+-]"
#: Each matches what the plain pattern matches, leftmost and without overlap, in time linear in the text.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
TERM = r"[\p{L}\p{M}\p{N}]++"
#: Bits of the filter that terms pass before they are shuffled, and of one row of it; 8 MB are sent in all, whatever
#: the corpus. More disclosing terms than bits only let more pass.
BITS, ROW_BITS = 1 << 26, 1 << 15
#: Share of an entity's information that a term may carry; above REMOVE the term goes as a whole.
GENERALISE, REMOVE = 0.9, 0.97
_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


_FOUND = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the matches, in code points, end exclusive."""

    def placed(found: Column, between: Column) -> Column:
        size = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, v: F.length(g) + F.length(v))
        at = lambda x, i, before: F.struct((before + F.length(F.get(between, i))).alias("start"), (before + F.length(F.get(between, i)) + F.length(x)).alias("end"), x.alias("value"))
        return common.let(common.prefixes(size, lambda a, b: a + b), lambda before: F.transform(found, lambda x, i: at(x, i, F.get(before, i))))

    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    inside = common.let(found, lambda x: F.when(F.size(x) > 0, common.let(F.split(text, pattern, -1), lambda y: placed(x, y))))
    return F.coalesce(inside, F.array().cast(_FOUND))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a run of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _of_kind(found: Column, rank: int, kind: str) -> Column:
    good = F.filter(found, lambda x: _valid(kind, x["value"]))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """All spans of the four patterns by start, then in the order of KINDS."""
    each = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        each.append(_of_kind(matches(text, pattern), rank, kind))
    return F.sort_array(F.concat(*each)).cast(f"array<{_SPAN}>")


def _entity(x: Column) -> Column:
    """A value's identity: its digits, or for addresses its lower case."""
    return F.concat(x["kind"], F.lit(":"), F.when(x["kind"].isin("email", "ip"), F.lower(x["value"])).otherwise(_digits(x["value"])))


def _terms(text: Column, spans: Column) -> Column:
    """The distinct terms of a text in lower case; words that touch a span are left out."""
    mark = "\uffff"
    free = F.regexp_replace(common.patched(text, spans, lambda _x: F.lit(mark)), rf"(?:{TERM})?{mark}(?:{TERM}|{mark})*+", " ")
    found = F.regexp_extract_all(F.when(F.size(spans) == 0, text).otherwise(free), F.lit(f"({TERM})"), F.lit(1))
    return F.array_distinct(F.transform(F.array_distinct(found), F.lower))


def disclosing(held: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, share): terms that carry at least `generalise` of an entity's information.

    held: one row a document: tk, base, terms. Counts are of documents, all of them. A pair counts only
    if two different texts hold it: in one text alone, and its copies, everything occurs with everything.
    """
    total = held.count()
    n = F.lit(float(total))
    some = held.where(F.size("base") > 0)
    # equal texts hold the same pairs; they are counted, not repeated
    owners = some.select("tk", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity")).groupBy("tk", "entity").agg(F.count(F.lit(1)).alias("copies"))
    owners = common.written(owners, "owners")
    entities = owners.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.min("tk").alias("_a"), F.max("tk").alias("_b")).where((F.col("_a") != F.col("_b")) & (F.col("n_e") < total)).select("entity", "n_e")
    entities = common.written(entities, "entities")
    # n_et is at most n_e, so a term in more documents than this cannot reach the share
    limit = lambda n_e: n * F.pow(n_e / n, F.lit(generalise)) * F.lit(1 + 1e-9)
    most = entities.agg(F.max("n_e").alias("most"))
    terms = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).where("n_t > 1")
    terms = terms.join(F.broadcast(most), F.col("n_t") <= limit(F.col("most"))).select("term", "n_t")
    shared = common.written(owners.join(entities, "entity"), "shared")
    texts = some.select("tk", "terms").join(shared.select("tk").distinct(), "tk", "left_semi").dropDuplicates(["tk"])
    rare = texts.select("tk", F.explode("terms").alias("term")).join(terms, "term")
    pairs = shared.join(rare, "tk").where(F.col("n_t") <= limit(F.col("n_e")))
    known = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"), F.min("tk").alias("_a"), F.max("tk").alias("_b")).where("_a <> _b")
    share = F.log2(F.col("n_et") * n / (F.col("n_e") * F.col("n_t"))) / F.log2(n / F.col("n_e"))
    return known.withColumn("share", share).where(F.col("share") >= generalise).select("entity", "term", "share")


def _occurrences(text: Column, shares: Column) -> Column:
    """Spans of all terms of a text that `shares` (term to share) has."""
    value = lambda t, share: F.when(share >= REMOVE, F.lit("")).otherwise(F.concat(F.substring(t, 1, 1), F.lit("…")))
    span = lambda x, share: F.struct(x["start"].alias("start"), F.lit(4).alias("rank"), x["end"].alias("end"), F.lit("term").alias("kind"), value(F.lower(x["value"]), share).alias("value"))
    known = F.filter(matches(text, TERM), lambda x: F.try_element_at(shares, F.lower(x["value"])).isNotNull())
    return F.transform(known, lambda x: span(x, F.try_element_at(shares, F.lower(x["value"])))).cast(f"array<{_SPAN}>")


def _slot(term: Column) -> list[Column]:
    """Where a term's bit stands in the filter: row, word of 64 bits in the row, bit of the word."""
    slot = F.pmod(F.xxhash64(term), F.lit(BITS))
    return [F.floor(slot / ROW_BITS).cast("int").alias("row"), F.floor(slot / 64 % (ROW_BITS // 64)).cast("int").alias("word"), (slot % 64).cast("int").alias("bit")]


def term_filter(reveal: DataFrame) -> DataFrame:
    """(filter_row, bits): a bit for the hash of each term, as at most BITS / ROW_BITS rows of 64-bit words."""
    words = reveal.select(*_slot(F.col("term"))).groupBy("row", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("x"))
    held = words.groupBy(F.col("row").alias("filter_row")).agg(F.map_from_entries(F.collect_list(F.struct("word", "x"))).alias("m"))
    all_words = F.sequence(F.lit(0), F.lit(ROW_BITS // 64 - 1))
    return held.select("filter_row", F.transform(all_words, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("bits"))


def sanitise(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, spans (start, rank, end, kind, value), and with_text: sanitised.

    Spans come by start, then in the order of KINDS. A null text counts as empty. Patterned values are
    replaced by their kind in brackets, terms to remove by nothing, others by their first letter and
    an ellipsis; of spans that overlap the first is replaced and the rest of the others dropped. A
    protected entity in every document carries no information and reveals none. A term goes by its
    highest share over all entities. Rows repeated as a whole are kept; other columns of docs are left out.
    """
    rows = docs.select("doc_id", common.text_or_empty().alias("text"))
    based = rows.select("doc_id", "text", common.row_key().alias("rk"), common.text_key().alias("tk"), base_spans(F.col("text")).alias("base"))
    held = common.written(based.select("doc_id", "rk", "tk", "base", _terms(F.col("text"), F.col("base")).alias("terms")), "spans")
    reveal = common.written(disclosing(held.select("tk", "base", "terms")).groupBy("term").agg(F.max("share").alias("share")), "disclosing")
    known = F.broadcast(term_filter(reveal))
    passes = (F.col("row") == F.col("filter_row")) & (F.expr("shiftrightunsigned(get(bits, word), bit) & 1L") == 1)
    # rows equal in id and text have the same terms; they are found once
    hits = held.select("rk", F.explode("terms").alias("term")).select("rk", "term", *_slot(F.col("term"))).join(known, passes).select("rk", "term").join(reveal.hint("merge"), "term").groupBy("rk", "term").agg(F.max("share").alias("share"))
    shares = common.written(hits.groupBy("rk").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares")), "shares")
    added = rows.select(common.row_key().alias("rk"), "text").join(shares.hint("merge"), "rk").select("rk", _occurrences(F.col("text"), F.col("shares")).alias("terms")).dropDuplicates(["rk"])
    # these sides grow with the corpus: they are joined by shuffle at every size, so that no size is a switch
    out = held.drop("terms").join(added.hint("merge"), "rk", "left")
    apart = F.filter(F.coalesce("terms", F.array().cast(f"array<{_SPAN}>")), lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    spans = F.sort_array(F.concat("base", apart))
    if not with_text:
        return out.select("doc_id", spans.alias("spans"))
    texts = rows.withColumn("rk", common.row_key()).dropDuplicates(["rk"]).select("rk", "text")
    return out.withColumn("spans", spans).join(texts, "rk").select("doc_id", "spans", replaced(F.col("text"), F.col("spans")).alias("sanitised"))


def replaced(text: Column, spans: Column) -> Column:
    return common.patched(text, spans, lambda x: F.when(x["kind"] == "term", x["value"]).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(common.documents(spark, sf_dir).select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "term")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
