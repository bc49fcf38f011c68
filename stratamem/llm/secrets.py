"""Secret scans over an incremental ledger of blobs.

Each version of each path is addressed by the SHA-256 of its content. A ledger (a table in a shared
folder) records which blobs have met which version of which rule, with what was found. A scan reads
the content of those blobs alone that have a rule version still ahead of them, each blob once however
many paths or versions hold it, appends to the ledger, and joins the findings back to every path.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.llm import common

FINDING = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob binary, rules array<string>, findings {FINDING}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. hint: a cheap Java pattern without which `pattern` cannot match; ok: tests a match."""

    kind: str
    version: int
    pattern: str
    hint: str
    ok: Callable[[re.Match], bool] = lambda m: True
    flags: int = re.ASCII

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: A private key from BEGIN to the next END with no other BEGIN between, over any body. Where END is missing,
#: the header lines and the base64 lines that follow, with what escaping, quoting or indenting puts between
#: them; one line of under 16 characters may end them.
_BEGIN = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_END = r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_BODY = r"[^-]*+(?:-(?!----(?:BEGIN |END [A-Z0-9 ]{0,40}PRIVATE KEY))[^-]*+)*+"
_GAP = r"""(?:[\s"'`,;>#*|]|\\+(?:[nrt]|u000[aAdD])|\\(?=\s)|\+(?=\s)|<br\s?/?>|&\#1[03];)"""
_FIELD = r"(?:[A-Za-z]{1,20}(?:-[A-Za-z]{1,20}){1,4}|Version|Comment|Hash|Charset|MessageID):[^\r\n\\\"]*+"
_RUN = r"(?:\\?/|[A-Za-z0-9+=])"
_CUT = rf"(?:{_GAP}*+{_FIELD})*+(?:{_GAP}*+{_RUN}{{16,}}+)*+(?:{_GAP}++{_RUN}{{1,15}}+(?=\\|[\r\n\"'`]|\Z))?"

#: In the order in which spans with the same start are listed.
RULES = (
    Rule(
        "assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"(?i)(?:passw(?:or)?d|secret|token|api_?key)", lambda m: len(m[2]) >= 12, re.ASCII | re.IGNORECASE,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14}", lambda m: len(m[0]) >= 18),
    Rule("hex", 1, r"[0-9a-f]+", r"[0-9a-f]{16}", lambda m: len(m[0]) >= 16),
    Rule("pem", 2, rf"{_BEGIN}(?:{_BODY}{_END}|{_CUT})", _BEGIN),
    # a token starts no run of its letters but at the run's first, so that a long run is read once
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
)


def scan_text(text: str, rules: Sequence[Rule]) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points by start, then in the order of the rules; a kind's own do not overlap."""
    found = []
    for rank, rule in enumerate(rules):
        found += [(m.start(), rank, m.end(), rule.kind) for m in re.finditer(rule.pattern, text, rule.flags) if rule.ok(m)]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def blob_id(content: str = "text") -> Column:
    return F.unhex(F.sha2(common.text_or_empty(content), 256))


def new_ledger(spark: SparkSession) -> str:
    """An empty ledger in the shared folder."""
    path = f"{common.shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def update_ledger(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, content: str = "text") -> None:
    """Scans what the ledger lacks. versions: one row a historical version, with its content.

    A pair is unseen if no ledger row of the blob lists the rule's version. A blob is read once even
    where thousands of versions hold it. Writing is an append of whole files, so a scan that fails
    leaves the ledger as it was and can simply run again.
    """
    spark = versions.sparkSession
    wanted = F.array(*[F.lit(r.id) for r in rules])
    base = versions.select(F.col(content).alias("text"), blob_id(content).alias("blob"), version_key(versions, content).alias("pick"))
    # one version stands for the blob: keys alone are shuffled to choose it
    blobs = base.groupBy("blob").agg(F.min("pick").alias("pick"))
    seen = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("had"))
    todo = blobs.join(seen, "blob", "left").withColumn("todo", F.when(F.col("had").isNull(), wanted).otherwise(F.array_except(wanted, F.col("had"))))
    todo = todo.where(F.size("todo") > 0).select("blob", "pick", "todo")
    # a text goes on only if a rule could match it; the rest are recorded as clean without being moved
    maybe = F.lit(False)
    for r in rules:
        maybe = maybe | F.col("text").rlike(r.hint)
    read = base.withColumn("text", F.when(maybe, F.col("text"))).join(todo, ["blob", "pick"]).select("blob", "todo", "text").dropDuplicates(["blob"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {r.id: r for r in rules}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = []
            for text, todo in zip(batch.column("text"), batch.column("todo").to_pylist(), strict=True):
                t = text.as_py()
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in scan_text(t, [by_id[x] for x in todo])] if t else [])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("todo"), pa.array(found, kind)], ["blob", "rules", "findings"])

    read.mapInArrow(scan, LEDGER).write.mode("append").parquet(ledger)


def version_key(versions: DataFrame, content: str) -> Column:
    """Tells the versions of a blob apart, as far as their own columns do."""
    keys = [F.col(c).cast("string") for c, t in versions.dtypes if c != content and t in ("string", "bigint", "int")]
    return F.xxhash64(*keys) if keys else F.lit(0).cast("long")


def findings(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, content: str = "text") -> DataFrame:
    """versions with `findings`: spans of the given rule versions, by start, then in the order of the rules.

    Every row gets its blob's findings; a null content counts as empty and has none. Columns of
    versions stay, but for one named `findings`, which is replaced. An empty table gives an empty table.
    """
    spark = versions.sparkSession
    kinds = [r.kind for r in rules]
    rank = F.create_map(*[x for k, kind in enumerate(kinds) for x in (F.lit(kind), F.lit(k))])
    ids = F.array(*[F.lit(r.id) for r in rules])
    mine = lambda x: F.array_contains("rules", F.concat(x["kind"], F.lit("@"), F.element_at(version, x["kind"])))
    version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(str(r.version)))])
    known = spark.read.schema(LEDGER).parquet(ledger)
    # a ledger row lists the rule versions that its findings come from
    current = known.where(F.size("findings") > 0).where(F.arrays_overlap("rules", ids)).select("blob", F.filter("findings", mine).alias("f"))
    found = current.groupBy("blob").agg(F.flatten(F.collect_list("f")).alias("f"))
    order = F.transform("f", lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    spans = F.transform(F.sort_array(order), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    # written, so that a blob that very many rows hold can be split in the join
    found = common.written(found.select(F.col("blob").alias("_blob"), spans.alias("_f")), "findings")
    out = versions.drop("findings").withColumn("_blob", blob_id(content)).join(found, "_blob", "left")
    return out.withColumn("findings", F.coalesce("_f", F.array().cast(FINDING))).drop("_blob", "_f")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op3_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    ledger = new_ledger(spark)
    update_ledger(docs, ledger)
    found = findings(docs.select("doc_id", "text"), ledger)
    base = F.filter("findings", lambda x: x["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("findings")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each span, or each run of spans that overlap, replaced by [SECRET]."""
    return common.patched(text, spans, lambda _x: F.lit("[SECRET]"))


@common.other_columns_apart
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by [SECRET] and n_chars brought up to date; other columns stay, whatever their names."""
    ledger = new_ledger(spark)
    update_ledger(docs.select("doc_id", "text"), ledger)
    clean = findings(docs, ledger).withColumn("_text", redacted(F.col("text"), F.col("findings")))
    counts = {"n_chars": F.when(F.size("findings") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return clean.withColumns(counts).withColumn("text", F.col("_text")).select(*docs.columns)
