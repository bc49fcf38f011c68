"""Quality rules as a short-circuit cascade.

Each rule is a column expression that is true for a text to reject. On a sample the cascade
measures what each rule costs and how many texts it rejects, then puts the rules in order of
rejection per cost; a text is tested by the next rule only if all earlier ones passed it. The
order changes the work and never the verdict, which is that no rule rejects.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.llm import common

#: Texts in the sample on which costs and rejections are measured, about, and its partitions.
SAMPLE_ROWS, SAMPLE_PARTS = 2_000, 8
SEED = 6_174
REPEATS = 2
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """name; the metrics it reads; a condition on them, given by name, that rejects."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]


def metrics(text: str = "text", w: Column | None = None) -> dict[str, Column]:
    """Each metric as an expression on the text and on its words."""
    t, w = common.text_or_empty(text), F.col("_words") if w is None else w
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size(w)
    inner = F.greatest(n - F.lit(2), F.lit(0))
    windows = F.sort_array(
        F.when(n < 3, F.array().cast("array<struct<a:string,b:string,c:string,at:int>>")).otherwise(
            F.arrays_zip(F.slice(w, 1, inner).alias("a"), F.slice(w, 2, inner).alias("b"), F.slice(w, 3, inner).alias("c"), F.sequence(F.lit(0), inner - 1).alias("at"))
        )
    )
    return {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "_windows": windows,
    }


def repeat_words(z: Column) -> Column:
    """Words that lie in a three-word window found twice or more; z: the windows, sorted, with their place.

    Windows that are equal stand side by side after the sort, so each is held against its two
    neighbours; the places of repeated ones, put in order again, cover three words each.
    """
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    n = F.size(z)
    twins = F.zip_with(F.slice(z, 1, F.greatest(n - 1, F.lit(0))), F.slice(z, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: F.when(same(x, y), F.array(x["at"], y["at"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda p: p.isNotNull()))))
    counted = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(acc["upto"], p)).alias("n"), (p + 3).alias("upto")),
        lambda acc: acc["n"],
    )
    return F.when(n < 2, F.lit(0)).otherwise(counted).cast("long")


def default_rules() -> list[Rule]:
    """Production thresholds; each is on a whole text."""
    return [
        Rule("too_short", ("n_words",), lambda m: m["n_words"] < 50),
        Rule("word_length", ("n_words", "word_chars"), lambda m: ~m["word_chars"].between(3 * m["n_words"], 10 * m["n_words"])),
        Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m["n_symbols"] > m["n_words"]),
        Rule("upper_case", ("word_chars", "n_upper"), lambda m: 2 * m["n_upper"] > m["word_chars"]),
        Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
        Rule("repeated_words", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ]


def _columns(rule: Rule) -> Column:
    """The rule's condition on columns that bear the metrics' names."""
    return rule.rejects({k: F.col(k) for k in rule.needs})


def _on_windows(rule: Rule, known: dict[str, Column]) -> Callable[[Column], Column]:
    return lambda z: rule.rejects(known | {"n_repeat_words": repeat_words(z)})


def _with(df: DataFrame, needs: Sequence[str], text: str, names: dict[str, str] | None = None) -> DataFrame:
    """df with the metrics in needs, under their names or those in names (name to metric); what several share is made once."""
    made = metrics(text)
    names = names or {k: k for k in dict.fromkeys(needs)}
    df = df.withColumn("_words", common.words(F.col(text)))
    if "n_repeat_words" in needs:
        df = df.withColumn("_windows", made["_windows"])
    return df.withColumns({c: repeat_words(F.col("_windows")) if k == "n_repeat_words" else made[k] for c, k in names.items()})


def order_rules(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules, those first that reject most for what they cost.

    About sample_rows texts are drawn by a seeded coin from all partitions alike; they alone are moved, into
    a few partitions. Cost: seconds to run the rule alone over the sample, less those of a pass that only finds
    the words; the least of a few runs. Rejection: the share of the sample that the rule rejects.
    """
    rows = docs.count()
    drawn = docs.select(F.col(text).alias("_text")).sample(min(1.0, sample_rows / max(1, rows)), SEED)
    sample = drawn.repartition(SAMPLE_PARTS).persist()
    total = max(1, sample.count())

    def timed(made: DataFrame, found: Column) -> tuple[float, int]:
        best, n = float("inf"), 0
        for _ in range(REPEATS):
            began = time.perf_counter()
            n = made.agg(F.count_if(found).alias("n")).first()["n"]
            best = min(best, time.perf_counter() - began)
        return best, n

    floor, _ = timed(sample.withColumn("_words", common.words(F.col("_text"))), F.size("_words") < 0)
    worth = {}
    for rule in rules:
        cost, rejected = timed(_with(sample, rule.needs, "_text"), _columns(rule))
        worth[rule.name] = (rejected / total) / max(cost - floor, 1e-3)
    sample.unpersist()
    return sorted(rules, key=lambda r: (-worth[r.name], [x.name for x in rules].index(r.name)))


def cascade(docs: DataFrame, rules: Sequence[Rule], text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """docs with the metrics named in keep, and `kept`; the rules are tested in the order given.

    Metrics in keep are worked out for every text. Any other metric is worked out only when the first rule that
    reads it is reached, so not for a text that an earlier rule rejected. A null text is judged as an empty
    one; an empty table gives an empty table. Columns of docs keep their values unless they bear the
    name of a metric in keep or `kept`, which are replaced; names starting with an underscore are dropped.
    """
    own = [c for c in docs.columns if not c.startswith("_") and c != "kept" and (c == text or c not in keep)]
    held = {f"_m_{k}": k for k in keep}

    def verdict(w: Column) -> Column:
        made = metrics(text, w) | {k: F.col(c) for c, k in held.items()}
        passed = F.lit(True)
        for r in reversed(rules):
            known = {k: made[k] for k in r.needs if k in made}
            test = common.let(made["_windows"], _on_windows(r, known)) if "n_repeat_words" in r.needs and "n_repeat_words" not in keep else r.rejects(known)
            passed = F.when(test, False).otherwise(passed)
        return passed

    if not keep:
        return docs.select(*own, common.let(common.words(F.col(text)), verdict).alias("kept"))
    # under names of their own, so that a metric's name in docs is still the column of docs until the end
    with_ = _with(docs.select(*own, F.col(text).alias("_text")), keep, "_text", held)
    return with_.select(*own, *[F.col(c).alias(k) for c, k in held.items()], verdict(F.col("_words")).alias("kept"))


#: The metrics that the query returns for every text.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = cascade(docs, order_rules(docs, default_rules()), keep=RETURNED)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *RETURNED, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


@common.other_columns_apart
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, with all columns they came with, whatever their names. An empty table gives an empty table."""
    return cascade(docs, order_rules(docs, default_rules())).where("kept").select(*docs.columns)


ORACLE = {
    "op6_quality_cascade": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (SELECT rid, i, [ws[i], ws[i+1], ws[i+2]] AS g
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(regexp_extract_all(t, '\p{Lu}')) AS BIGINT) AS n_upper,
    coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
  AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 10 * n_symbols <= n_words
  AND 2 * n_upper <= word_chars AND 10 * n_dup_lines <= 3 * n_lines AS kept
FROM m""",
}
