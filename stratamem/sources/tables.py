"""Sources and sinks: nested JSON corpora, JSON lines, CSV worksheets, vectors, exports.

What a query writes goes into the shared folder, and the query returns what it reads back.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.plans.fixtures import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
CORPUS = "user_id long, session_ids array<string>, dates array<string>, sessions array<array<struct<role:string,content:string>>>"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_made: dict[str, list[str]] = {}


def drop_scratch(spark: SparkSession) -> int:
    """Deletes what scratch() has named in this session, on whatever file system it is; returns how many there were.

    Results that are read from there have to be used or stored elsewhere first.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows written into the shared folder and read again: what follows does not work them out anew, and a lost executor costs none of them."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def corpus_sessions(raw: DataFrame) -> DataFrame:
    """user_id, session_id, date, turns of a corpus with parallel arrays; a missing id is sess_<i>, a missing date empty."""
    each = raw.select("user_id", F.posexplode(F.arrays_zip("session_ids", "dates", "sessions")).alias("i", "s"))
    return each.select("user_id", "i", F.coalesce("s.session_ids", F.concat(F.lit("sess_"), F.col("i").cast("string"))).alias("session_id"), F.coalesce("s.dates", F.lit("")).alias("date"), F.col("s.sessions").alias("turns"))


def corpus_turns(sessions: DataFrame) -> DataFrame:
    """One row a turn; a missing role is user, missing content empty."""
    t = sessions.select("user_id", "session_id", F.posexplode_outer("turns").alias("turn_index", "t"))
    return t.select("user_id", "session_id", F.col("turn_index").cast("long").alias("turn_index"), F.coalesce("t.role", F.lit("user")).alias("role"), F.coalesce("t.content", F.lit("")).alias("content"))


def nested(t: Tables) -> DataFrame:
    """Conversations as such a corpus: one row a user."""
    turn = F.struct("turn_index", "role", "content")
    s = t.turns.groupBy("user_id", "session_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("turns"))
    own = F.array_sort(F.collect_list(F.struct("session_id", "turns")))
    return s.groupBy("user_id").agg(own.alias("x")).select("user_id", F.col("x.session_id").cast("array<string>").alias("session_ids"), F.array_repeat(F.lit("2024-01-01"), F.size("x")).alias("dates"), F.col("x.turns").alias("sessions"))


@R.add("src01_nested_json_corpus", "SELECT user_id, session_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) - 1 AS turn_index, role, sha256(content) AS digest FROM turns")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "corpus")
    nested(t).write.json(path)
    turns = corpus_turns(corpus_sessions(t.spark.read.schema(CORPUS).json(path)))
    return turns.select("user_id", "session_id", "turn_index", "role", F.sha2("content", 256).alias("digest"))


@R.add("src02_first_occurrence", "SELECT user_id, session_id, min(turn_index) AS first FROM turns GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("user_id", "session_id").orderBy("turn_index"))
    return t.turns.withColumn("rn", rn).where("rn = 1").select("user_id", "session_id", F.col("turn_index").alias("first"))


def json_lines(spark: SparkSession, path: str, schema: str, key: str, strict: bool = False) -> DataFrame:
    """One record a line. Tolerant: lines that do not parse or lack the key are left out. Strict: they raise."""
    reader = spark.read.schema(schema)
    if strict:
        rows = reader.option("mode", "FAILFAST").json(path)
        twice = F.count(F.lit(1)).over(W.partitionBy(key)) > 1
        bad = F.when(F.col(key).isNull() | twice, F.raise_error(F.concat(F.lit("missing or repeated key: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
        return rows.withColumn(key, F.coalesce(bad, F.col(key)))
    return reader.option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())


@R.add("src03_tolerant_json_lines", "SELECT question_id, a AS correct FROM results WHERE question_id % 10 <> 0")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "lines")
    line = F.when(F.col("question_id") % 10 == 0, '{"question_id": 1, "corr').otherwise(F.to_json(F.struct("question_id", F.col("a").alias("correct"))))
    t.results.select(line.alias("value")).write.text(path)
    return json_lines(t.spark, path, "question_id long, correct boolean", "question_id")


@R.add("src04_strict_json_lines", "SELECT question_id, a AS correct FROM results")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "lines")
    t.results.select("question_id", F.col("a").alias("correct")).write.json(path)
    return json_lines(t.spark, path, "question_id long, correct boolean", "question_id", strict=True)


@R.add("src05_manifest", "SELECT question_id, question_type FROM results WHERE question_id % 9 = 4")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "manifest")
    ids = t.results.where("question_id % 9 = 4").select(F.col("question_id").cast("string").alias("value"))
    ids.union(t.spark.createDataFrame([("# a comment",)], "value string")).write.text(path)
    wanted = t.spark.read.text(path).where(~F.col("value").startswith("#")).select(F.col("value").cast("long").alias("question_id"))
    return t.results.join(wanted, "question_id", "left_semi").select("question_id", "question_type")


@R.add("src06_csv_worksheet", "SELECT doc_id, human FROM (SELECT doc_id, NULL::VARCHAR AS human, row_number() OVER (ORDER BY sha256('w:' || doc_id)) AS rn FROM documents) WHERE rn <= 30")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "sheet")
    drawn = t.raw("documents").select("doc_id", F.lit("").alias("human")).orderBy(F.sha2(F.concat_ws(":", F.lit("w"), "doc_id"), 256)).limit(30)
    drawn.orderBy("doc_id").write.option("header", True).option("emptyValue", "").csv(path)
    return t.spark.read.option("header", True).schema("doc_id long, human string").csv(path)


@R.add("src07_csv_labels", "SELECT question_id, CASE WHEN question_id % 5 = 0 THEN NULL ELSE a END AS human FROM results")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "labels")
    word = F.when(F.col("question_id") % 5 == 0, "?").when(F.col("a"), F.when(F.col("question_id") % 2 == 0, " Yes").otherwise("1")).otherwise("incorrect")
    t.results.select("question_id", word.alias("human")).write.option("header", True).csv(path)
    said = F.lower(F.trim("human"))
    human = F.when(said.isin("1", "true", "t", "y", "yes", "correct"), True).when(said.isin("0", "false", "f", "n", "no", "wrong", "incorrect"), False)
    return t.spark.read.option("header", True).schema("question_id long, human string").csv(path).select("question_id", human.alias("human"))


@R.add("src08_failure_sheet", "SELECT CASE WHEN n_chars < 300 THEN 'E1' WHEN NOT b AND question_type = 'en' THEN 'E2' WHEN NOT b THEN 'E3' WHEN question_type = 'en' THEN 'E4' WHEN n_chars > 5000 THEN 'E5' ELSE 'E6' END AS code, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM results JOIN documents ON doc_id = question_id WHERE NOT a GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Every wrong row with its diagnostics; the sheet is coded by them: little text, both arms wrong, long text, other."""
    path = scratch(t.spark, "failures")
    d = t.raw("documents").select(F.col("doc_id").alias("question_id"), "n_chars")
    t.results.where("not a").join(d, "question_id").select("question_id", F.to_json(F.struct("question_type", "b", "n_chars")).alias("diagnostics")).write.option("header", True).option("escape", '"').csv(path)
    x = t.spark.read.option("header", True).option("escape", '"').csv(path).select(F.from_json("diagnostics", "question_type string, b boolean, n_chars long").alias("x")).select("x.*")
    en = F.col("question_type") == "en"
    code = F.when(F.col("n_chars") < 300, "E1").when(~F.col("b") & en, "E2").when(~F.col("b"), "E3").when(en, "E4").when(F.col("n_chars") > 5000, "E5").otherwise("E6")
    return x.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@R.add("src10_partitioned_table", "SELECT id, user_id, predicate FROM memories WHERE user_id % 8 = 3")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "facts")
    t.memories.select("id", "user_id", "predicate", (F.col("user_id") % 8).alias("bucket")).write.partitionBy("bucket").parquet(path)
    return t.spark.read.parquet(path).where("bucket = 3").select("id", "user_id", "predicate")


@R.add("src11_vector_validation", "SELECT count(*) AS rows, count(*) FILTER (len(embedding) <> 64) AS wrong_dim, count(*) - count(DISTINCT id) AS repeated FROM vectors")
def _(t: Tables) -> DataFrame:
    by_id = t.vectors.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") != 64).alias("w"))
    return by_id.agg(F.sum("n").alias("rows"), F.sum("w").alias("wrong_dim"), F.sum(F.col("n") - 1).alias("repeated"))


@R.add("src12_influence_labels", "SELECT question_id, a AS without_correct, b AS alone_correct FROM results")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "influence")
    t.results.select("question_id", F.col("a").alias("without_correct"), F.col("b").alias("alone_correct")).write.json(path)
    return t.spark.read.schema("question_id long, without_correct boolean, alone_correct boolean").json(path)


@R.add("src13_ledger_append", "SELECT model, count(*) AS calls, CAST(sum(output_tokens) AS BIGINT) AS tokens FROM usage GROUP BY model")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "ledger")
    for half in (0, 1):
        t.usage.where(F.col("event_id") % 2 == half).write.mode("append").parquet(path)
    return t.spark.read.parquet(path).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("output_tokens").alias("tokens"))


@R.add("src14_namespace_export", "SELECT user_id, count(DISTINCT session_id) AS sessions, count(*) AS turns FROM turns GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "export")
    nested(t).withColumn("shard", F.col("user_id")).write.partitionBy("shard").json(path)
    doc = t.spark.read.schema(CORPUS).json(path)
    return doc.select("user_id", F.size("session_ids").cast("long").alias("sessions"), F.aggregate("sessions", F.lit(0).cast("long"), lambda s, x: s + F.size(x)).alias("turns"))


#: Who asked to be erased, and when: users whose last event was an error, at that time.
ERASED = "SELECT user_id, max(ts) AS gone_at FROM events GROUP BY user_id HAVING max_by(event_type, event_id) = 'error'"


def erasure_journal(t: Tables) -> str:
    """The path of an append-only journal of erasures: a JSON line each, some torn, some with a time that cannot be read."""
    path = scratch(t.spark, "journal")
    e = t.raw("events").groupBy("user_id").agg(F.max("ts").alias("at"), F.max_by("event_type", "event_id").alias("last")).where("last = 'error'")
    at = F.when(F.col("user_id") % 7 == 0, "when?").otherwise(F.date_format("at", "yyyy-MM-dd HH:mm:ss"))
    line = F.to_json(F.struct("user_id", at.alias("erased_at")))
    e.select(F.when(F.col("user_id") % 10 == 3, F.left(line, F.lit(14))).otherwise(line).alias("value")).write.text(path)
    return path


def erasures(spark: SparkSession, path: str, since: str) -> DataFrame:
    """user_id, line, still: whether a table restored as of `since` has to be rid of the user; an unreadable time counts so. A line that does not parse has no user_id."""
    j = spark.read.schema("user_id long, erased_at string, line string").option("columnNameOfCorruptRecord", "line").json(path)
    at = F.try_to_timestamp("erased_at", F.lit("yyyy-MM-dd HH:mm:ss"))
    return j.select("user_id", "line", (at.isNull() | (at >= F.lit(since).cast("timestamp"))).alias("still"))


@R.add("src15_erasure_journal", f"e AS ({ERASED}) SELECT CASE WHEN user_id % 10 <> 3 THEN user_id END AS user_id, user_id % 10 = 3 AS torn, CASE WHEN user_id % 10 <> 3 THEN user_id % 7 = 0 OR gone_at >= TIMESTAMP '2024-01-30' END AS still FROM e")
def _(t: Tables) -> DataFrame:
    j = erasures(t.spark, erasure_journal(t), "2024-01-30").cache()  # a query on the torn lines alone is not allowed on raw JSON
    return j.select("user_id", F.col("line").isNotNull().alias("torn"), F.when(F.col("user_id").isNotNull(), F.col("still")).alias("still"))
