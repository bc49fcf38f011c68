"""Column functions on text, dates, numbers and values, with queries that apply them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.plans.fixtures import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Number words and what they stand for.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19",
    "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90", "hundred": "100",
}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def all_of(text: str | Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def snake(c: str | Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def token_estimate(c: str | Column) -> Column:
    """Length over 4.6, at least 1; 0 for an empty text."""
    n = F.length(c)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4.6).cast("int"))).cast("long")


def sentences(c: str | Column) -> Column:
    """Sentences with their end marks."""
    return all_of(c, r"[^.!?]+(?:[.!?]+|$)")


def quantities(c: str | Column) -> Column:
    """Numbers in a text, commas dropped, with number words as digits; distinct and sorted."""
    digits = F.transform(all_of(c, r"[0-9][0-9,]*(?:\.[0-9]+)?"), lambda x: F.regexp_replace(F.rtrim(x, F.lit(",")), ",", ""))
    table = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    named = F.filter(F.transform(all_of(F.lower(c), "[a-z]+"), lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(digits, named)))


def stated_dates(c: str | Column) -> Column:
    """ISO dates and `Month d, yyyy` in a text, as dates, distinct and sorted."""
    iso = F.transform(all_of(c, "[0-9]{4}-[0-9]{2}-[0-9]{2}"), lambda x: F.try_to_date(x, "yyyy-MM-dd"))
    named = F.transform(all_of(c, rf"(?:{MONTHS}) [0-9]{{1,2}}, [0-9]{{4}}"), lambda x: F.try_to_date(x, "MMMM d, yyyy"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(iso, named), lambda x: x.isNotNull())))


def relative_date(c: str | Column, said: Column) -> Column:
    """struct(exact, estimate, precision) of a text's one relative date.

    today, yesterday and `N days ago` are exact; weeks and months ago are estimates. Without any, or with
    more than one, all are null and the precision says `none` or `unresolved`.
    """
    number = "[0-9]+|one|two|three|four|five|six|seven|eight|nine|ten"
    found = all_of(F.lower(c), rf"\b(?:today|yesterday|(?:{number}) (?:day|week|month)s? ago)\b")
    only = F.element_at(found, 1)
    table = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    word = F.regexp_extract(only, r"^(\S+) ", 1)
    n = F.coalesce(F.try_element_at(table, word), word).cast("int")
    day = F.when(only == "today", said).when(only == "yesterday", F.date_sub(said, 1)).when(only.contains("day"), F.date_sub(said, F.try_subtract(n, F.lit(0))))
    about = F.when(only.contains("week"), F.date_sub(said, n * 7)).when(only.contains("month"), F.add_months(said, -n))
    one = F.size(found) == 1
    precision = F.when(F.size(found) == 0, "none").when(~one, "unresolved").when(only.contains("week") | only.contains("month"), "approximate_day").otherwise("day")
    return F.struct(F.when(one, day).alias("exact"), F.when(one, about).alias("estimate"), precision.alias("precision"))


def route(c: str | Column) -> Column:
    """The first kind of question whose pattern matches."""
    q = F.lower(c)
    return (
        F.when(q.rlike(r"\b(when|ago|before|after|last (week|month|year))\b"), "temporal").when(q.rlike(r"\b(how many|how much|total|sum)\b"), "aggregation")
        .when(q.rlike(r"\b(current|currently|now|latest)\b"), "current_state").when(q.rlike(r"\b(prefer|suggest|recommend|like)\b"), "preference").otherwise("direct")
    )


#: Words that say nothing about what a text is about.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "did", "do", "does", "for", "from", "had", "has", "have", "i", "in", "is", "it", "me", "my", "of", "on", "or", "s",
    "that", "the", "their", "them", "they", "this", "to", "was", "were", "what", "when", "which", "who", "why", "with", "you", "your", "user",
)
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@R.add("scl02_terms", f"w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, text FROM documents), v AS (SELECT doc_id, unnest([('word', w), ('long', list_filter(w, lambda x: length(x) > 2)), ('distinct', list_sort(list_distinct(w))), ('topic', list_filter(w, lambda x: x NOT IN ({_STOP}))), ('letters', regexp_extract_all(lower(text), '[a-z]+'))]) AS v FROM w) SELECT doc_id, v[1] AS variant, len(v[2]) AS terms, sha256(array_to_string(v[2], ' ')) AS digest FROM v")
def _(t: Tables) -> DataFrame:
    """Five ways to cut a text into terms: how many, and a digest of them in order."""
    w = all_of(F.lower("text"), "[a-z0-9]+")
    ways = {"word": w, "long": F.filter(w, lambda x: F.length(x) > 2), "distinct": F.array_sort(F.array_distinct(w)), "topic": F.filter(w, lambda x: ~x.isin(*STOP_WORDS)), "letters": all_of(F.lower("text"), "[a-z]+")}
    each = F.array(*[F.struct(F.lit(k).alias("variant"), F.size(x).cast("long").alias("terms"), F.sha2(F.array_join(x, " "), 256).alias("digest")) for k, x in ways.items()])
    return t.raw("documents").select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*")


@R.add("scl01_query_tokens", "SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: '\"' || x || '\"'), ' OR ') AS query FROM benchmark")
def _(t: Tables) -> DataFrame:
    return t.raw("benchmark").select("item_id", F.array_join(F.transform(all_of("text", "[A-Za-z0-9_]+"), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ").alias("query"))


@R.add("scl03_snake_case", "SELECT p_partkey, trim(regexp_replace(lower(trim(p_type || ' - ' || p_brand)), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM part")
def _(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", snake(F.concat_ws(" - ", "p_type", "p_brand")).alias("key"))


@R.add("scl04_value_normaliser", "SELECT id, lower(trim(coalesce(nullif(CASE WHEN id % 3 = 0 THEN '' ELSE object END, ''), content))) AS value FROM memories")
def _(t: Tables) -> DataFrame:
    value = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("object"))
    return t.memories.select("id", F.lower(F.trim(F.coalesce(F.nullif(value, F.lit("")), "content"))).alias("value"))


@R.add("scl05_member_normaliser", "SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '^ *(the|a|an) ', ''), ' +', ' ', 'g')) AS member FROM benchmark")
def _(t: Tables) -> DataFrame:
    bare = F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", " ")
    return t.raw("benchmark").select("item_id", F.trim(F.regexp_replace(F.regexp_replace(bare, "^ *(the|a|an) ", ""), " +", " ")).alias("member"))


@R.add("scl06_entity_canon", "SELECT DISTINCT user_id || ':' || lower(trim(e)) AS entity_id FROM (SELECT user_id, unnest(entities) AS e FROM memories)")
def _(t: Tables) -> DataFrame:
    return t.memories.select("user_id", F.explode("entities").alias("e")).select(F.concat_ws(":", "user_id", F.lower(F.trim("e"))).alias("entity_id")).distinct()


@R.add("scl10_sentences", "SELECT line_id, array_to_string(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)'), '|') AS parts FROM lines")
def _(t: Tables) -> DataFrame:
    return t.lines.select("line_id", F.array_join(sentences("text"), "|").alias("parts"))


@R.add("scl10_sentences_of_documents", "SELECT doc_id, len(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)'))::BIGINT AS sentences FROM documents")
def _(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.size(sentences("text")).cast("long").alias("sentences"))


_WORDS = ", ".join(f"('{w}', '{n}')" for w, n in NUMBER_WORDS.items())


@R.add("scl11_quantities", f"n(w, d) AS (VALUES {_WORDS}), a AS (SELECT line_id, replace(rtrim(unnest(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?')), ','), ',', '') AS q FROM lines UNION SELECT line_id, d FROM (SELECT line_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM lines) x JOIN n ON n.w = x.w) SELECT line_id, string_agg(DISTINCT q, ' ' ORDER BY q) AS quantities FROM a GROUP BY line_id")
def _(t: Tables) -> DataFrame:
    return t.lines.select("line_id", F.array_join(quantities("text"), " ").alias("quantities")).where("quantities <> ''")


@R.add("scl13_number_unit", "SELECT line_id, regexp_extract(text, '([0-9]+) (km|days|percent|weeks)', 1) AS n, regexp_extract(text, '([0-9]+) (km|days|percent|weeks)', 2) AS unit FROM lines WHERE regexp_matches(text, '[0-9]+ (km|days|percent|weeks)')")
def _(t: Tables) -> DataFrame:
    p = "([0-9]+) (km|days|percent|weeks)"
    return t.lines.where(F.col("text").rlike(p)).select("line_id", F.regexp_extract("text", p, 1).alias("n"), F.regexp_extract("text", p, 2).alias("unit"))


FACETS = {"money": r"\$[0-9][0-9,]*", "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "relative": "yesterday|today|[a-z0-9]+ (?:days|weeks) ago", "duration": "[a-z0-9]+ (?:days|weeks)", "name": "[A-Z][a-z]+"}


@R.add("scl14_facets", " UNION ALL ".join(f"SELECT line_id, '{k}' AS facet, unnest(regexp_extract_all(text, '{p}')) AS value FROM lines" for k, p in FACETS.items()))
def _(t: Tables) -> DataFrame:
    return facets(t.lines, FACETS)


def facets(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """line_id, facet, value: every match of every facet's pattern."""
    found = F.create_map(*[x for k, p in patterns.items() for x in (F.lit(k), all_of("text", p))])
    return lines.select("line_id", F.explode(found).alias("facet", "values")).select("line_id", "facet", F.explode("values").alias("value"))


@R.add("scl16_rule_keying", "SELECT line_id, CASE WHEN regexp_matches(lower(text), 'replaced|switched from|moved to') THEN 'replaces' ELSE 'coexists' END AS op FROM lines")
def _(t: Tables) -> DataFrame:
    return t.lines.select("line_id", F.when(F.lower("text").rlike("replaced|switched from|moved to"), "replaces").otherwise("coexists").alias("op"))


@R.add("scl17_deterministic_ids", "SELECT session_id, turn_index, 'mem_' || left(sha1(user_id || '|' || session_id || '|' || content), 16) AS id FROM turns")
def _(t: Tables) -> DataFrame:
    return t.turns.select("session_id", "turn_index", F.concat(F.lit("mem_"), F.left(F.sha1(F.concat_ws("|", "user_id", "session_id", "content")), F.lit(16))).alias("id"))


@R.add("scl18_digest", "SELECT doc_id, left(sha256(source || chr(1) || lang || chr(1) || text), 12) AS digest FROM documents")
def _(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.left(F.sha2(F.concat_ws("\x01", "source", "lang", "text"), 256), F.lit(12)).alias("digest"))


@R.add("scl20_stated_dates", "SELECT line_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), lambda x: x), list_transform(regexp_extract_all(text, '(?:" + MONTHS + ") [0-9]{1,2}, [0-9]{4}'), lambda x: strftime(strptime(x, '%B %-d, %Y'), '%Y-%m-%d'))))), ' ') AS dates FROM lines")
def _(t: Tables) -> DataFrame:
    return t.lines.select("line_id", F.array_join(F.transform(stated_dates("text"), lambda x: x.cast("string")), " ").alias("dates"))


#: What the relative date of each line says, as SQL: relative (line_id, exact, estimate, precision).
RELATIVE_SQL = f"n(w, v) AS (VALUES {_WORDS}), x AS (SELECT line_id, CAST(said_on AS DATE) AS d, regexp_extract_all(lower(text), '\\b(?:today|yesterday|(?:[0-9]+|one|two|three|four|five|six|seven|eight|nine|ten) (?:day|week|month)s? ago)\\b') AS f FROM lines), y AS (SELECT line_id, d, len(f) AS c, f[1] AS m FROM x), z AS (SELECT line_id, d, c, m, try_cast(coalesce(v, regexp_extract(m, '^([0-9]+) ', 1)) AS INTEGER) AS k FROM y LEFT JOIN n ON n.w = regexp_extract(m, '^([a-z]+) ', 1)), relative AS (SELECT line_id, CASE WHEN c <> 1 THEN NULL WHEN m = 'today' THEN d WHEN m = 'yesterday' THEN d - 1 WHEN contains(m, 'day') THEN d - k END AS exact, CASE WHEN c <> 1 THEN NULL WHEN contains(m, 'week') THEN d - 7 * k WHEN contains(m, 'month') THEN CAST(d - to_months(k) AS DATE) END AS estimate, CASE WHEN c = 0 THEN 'none' WHEN c > 1 THEN 'unresolved' WHEN contains(m, 'week') OR contains(m, 'month') THEN 'approximate_day' ELSE 'day' END AS precision FROM z)"


@R.add("scl21_relative_dates", RELATIVE_SQL + " SELECT * FROM relative")
def _(t: Tables) -> DataFrame:
    d = relative_date("text", F.to_date("said_on"))
    return t.lines.select("line_id", d["exact"].alias("exact"), d["estimate"].alias("estimate"), d["precision"].alias("precision"))


@R.add("scl24_month_shift", "SELECT o_orderkey, CAST(CAST(o_orderdate - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS before FROM orders")
def _(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_orderkey", F.add_months("o_orderdate", -1).cast("string").alias("before"))


@R.add("scl25_calendar_interval", "d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '2000-01-01' AS e FROM orders) SELECT o_orderkey, date_diff('day', d, e) AS days, CAST(floor(date_diff('day', d, e) / 7) AS BIGINT) AS weeks, date_diff('month', d, e) AS months, date_diff('month', d, e) - CASE WHEN day(e) < day(d) THEN 1 ELSE 0 END AS whole_months, CAST(floor((date_diff('month', d, e) - CASE WHEN day(e) < day(d) THEN 1 ELSE 0 END) / 12) AS BIGINT) AS years, (date_diff('month', d, e) - CASE WHEN day(e) < day(d) THEN 1 ELSE 0 END) % 12 AS rest FROM d WHERE d <= e")
def _(t: Tables) -> DataFrame:
    """Both ways to count: calendar months without a look at the day, and anniversaries with what is left over."""
    end, d = F.lit("2000-01-01").cast("date"), F.to_date("o_orderdate")
    days, months = F.datediff(end, d).cast("long"), ((F.year(end) - F.year(d)) * 12 + F.month(end) - F.month(d)).cast("long")
    whole = months - F.when(F.dayofmonth(end) < F.dayofmonth(d), 1).otherwise(0)
    return t.raw("orders").where(d <= end).select("o_orderkey", days.alias("days"), F.floor(days / 7).alias("weeks"), months.alias("months"), whole.alias("whole_months"), F.floor(whole / 12).alias("years"), (whole % 12).alias("rest"))


@R.add("scl26_partial_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'month' ELSE 'day' END AS precision FROM orders")
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    x = F.regexp_replace("x", "/", "-")
    day = F.try_to_date(F.when(F.length(x) == 10, x), "yyyy-MM-dd")
    return t.raw("orders").select("o_orderkey", text.alias("x")).select("o_orderkey", F.coalesce(day, F.try_to_date(F.left(x, F.lit(7)), "yyyy-MM")).cast("string").alias("day"), F.when(day.isNotNull(), "day").otherwise("month").alias("precision"))


@R.add("scl27_quota_day", "SELECT event_id, CAST(CAST(ts - INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS day FROM events")
def _(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Los_Angeles")).cast("string").alias("day"))


@R.add("scl28_token_estimate", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 4.6) AS BIGINT)) END AS tokens FROM documents")
def _(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", token_estimate("text").alias("tokens"))


@R.add("scl29_clip", "SELECT id, round(greatest(0.0, least(1.0, importance * 2 - 0.3)), 9) AS clipped FROM memories")
def _(t: Tables) -> DataFrame:
    return t.memories.select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("importance") * 2 - 0.3)), 9).alias("clipped"))


@R.add("scl30_unit_conversion", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) * f AS minutes FROM lineitem JOIN (VALUES (1, 1), (2, 60), (3, 1440), (4, 10080)) u(unit, f) ON unit = l_linenumber")
def _(t: Tables) -> DataFrame:
    units = t.spark.createDataFrame([(1, 1), (2, 60), (3, 1440), (4, 10080)], "l_linenumber int, f int")
    return t.raw("lineitem").join(F.broadcast(units), "l_linenumber").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") * F.col("f")).alias("minutes"))


@R.add("flt10_user_assertions", "SELECT line_id, array_to_string(list_filter(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)'), lambda x: x NOT LIKE '%?'), '|') AS said FROM lines WHERE role = 'user'")
def _(t: Tables) -> DataFrame:
    return t.lines.where("role = 'user'").select("line_id", F.array_join(F.filter(sentences("text"), lambda x: ~x.endswith("?")), "|").alias("said"))


@R.add("flt11_personal_sentences", "SELECT line_id, s FROM (SELECT line_id, unnest(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)')) AS s FROM lines WHERE role = 'user') WHERE regexp_matches(s, '(^| )(I|my|My) ') AND NOT regexp_matches(lower(s), 'suppose i|if i|imagine i')")
def _(t: Tables) -> DataFrame:
    s = t.lines.where("role = 'user'").select("line_id", F.explode(sentences("text")).alias("s"))
    return s.where(F.col("s").rlike("(^| )(I|my|My) ") & ~F.lower("s").rlike("suppose i|if i|imagine i"))


@R.add("flt12_event_candidates", "SELECT line_id FROM lines WHERE role = 'user' AND regexp_matches(text, 'moved|bought|visited|finished|ran') AND regexp_matches(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')")
def _(t: Tables) -> DataFrame:
    return t.lines.where((F.col("role") == "user") & F.col("text").rlike("moved|bought|visited|finished|ran") & (F.size(stated_dates("text")) > 0)).select("line_id")


@R.add("flt16_question_route", "SELECT line_id, CASE WHEN regexp_matches(lower(text), '\\b(when|ago|before|after|last (week|month|year))\\b') THEN 'temporal' WHEN regexp_matches(lower(text), '\\b(how many|how much|total|sum)\\b') THEN 'aggregation' WHEN regexp_matches(lower(text), '\\b(current|currently|now|latest)\\b') THEN 'current_state' WHEN regexp_matches(lower(text), '\\b(prefer|suggest|recommend|like)\\b') THEN 'preference' ELSE 'direct' END AS kind FROM lines")
def _(t: Tables) -> DataFrame:
    return t.lines.select("line_id", route("text").alias("kind"))


@R.add("flt17_question_flags", "SELECT line_id, regexp_matches(lower(text), 'how many|in total') AND NOT regexp_matches(lower(text), 'how many .*ago') AS aggregate, regexp_matches(lower(text), 'when|ago|month|day') AS about_time FROM lines")
def _(t: Tables) -> DataFrame:
    q = F.lower("text")
    return t.lines.select("line_id", (q.rlike("how many|in total") & ~q.rlike("how many .*ago")).alias("aggregate"), q.rlike("when|ago|month|day").alias("about_time"))


@R.add("topk14_best_window", "g AS (SELECT b.item_id, b.text AS q, d.doc_id, d.text FROM benchmark b JOIN documents d ON contains(d.text, b.text)), s AS (SELECT item_id, doc_id, q, unnest(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)'), 1) AS i, regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)') AS al FROM g), r AS (SELECT item_id, doc_id, i, al, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+')))) DESC, i) AS rn FROM s) SELECT item_id, doc_id, i AS best, sha256(left(array_to_string(al[greatest(i - 1, 1):i + 1], ''), 1200)) AS digest FROM r WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    """Of a document that holds a benchmark text the sentence that shares most words with it, with one on each side, at most 1,200 characters."""
    from stratamem.operators.retrieval import containing

    words = lambda c: F.array_distinct(all_of(F.lower(c), "[a-z0-9]+"))
    b = t.raw("benchmark").select(F.col("item_id").alias("query_id"), words("text").alias("q"))
    g = containing(t).join(b, "query_id").join(t.raw("documents").select("doc_id", sentences("text").alias("all")), "doc_id")
    shared = F.transform("all", lambda s, i: F.struct(F.size(F.array_intersect(words(s), "q")).alias("n"), (-i).alias("at")))
    best = (-F.array_max(shared)["at"] + 1).cast("int")
    near = F.slice("all", F.greatest(F.col("best") - 1, F.lit(1)), F.least(F.col("best"), F.lit(2)) + 1)
    return g.withColumn("best", best).select(F.col("query_id").alias("item_id"), "doc_id", F.col("best").cast("long").alias("best"), F.sha2(F.left(F.array_join(near, ""), F.lit(1200)), 256).alias("digest"))


#: A relative day: one word, or a number of days, weeks or months ago.
RELATIVE = "today|yesterday|(?:[0-9]+|" + "|".join(NUMBER_WORDS) + ") (?:day|week|month)s? ago"


def annotated(c: str | Column, said: Column) -> Column:
    """The text with `[= 2024-01-01 Mon]` after each exact relative day, `[~ 2024-01-01 Mon]` after each week or month count.

    Names of days of the week are ambiguous and left alone. So are words in quotes, and a capitalised
    day word in the middle of a sentence: a title, not a date.
    """
    pattern = rf"(?<![\"\u201c\w])(?:{RELATIVE})\b"
    table = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    found, gaps = all_of(c, pattern), F.split(c, pattern, -1)

    def note(m: Column) -> Column:
        word = F.regexp_extract(m, r"^(\S+) ", 1)
        n = F.coalesce(F.try_element_at(table, word), word).try_cast("int")
        day = F.when(m == "today", said).when(m == "yesterday", F.date_sub(said, 1)).when(m.contains("day"), F.date_sub(said, n)).when(m.contains("week"), F.date_sub(said, n * 7)).otherwise(F.add_months(said, -n))
        sign = F.when(m.contains("week") | m.contains("month"), "~").otherwise("=")
        return F.coalesce(F.concat(m, F.lit(" ["), sign, F.lit(" "), day.cast("string"), F.lit(" "), F.date_format(day, "EEE"), F.lit("]")), m)

    notes = F.concat(F.transform(found, note), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, notes, lambda g, n: F.concat(g, n)), "")


_DAY = "CASE WHEN m = 'today' THEN d WHEN m = 'yesterday' THEN d - 1 WHEN contains(m, 'day') THEN d - k WHEN contains(m, 'week') THEN d - 7 * k ELSE CAST(d - to_months(k) AS DATE) END"


@R.add("scl22_relative_annotation", f"n(w, v) AS (VALUES {_WORDS}), x AS (SELECT line_id, text, CAST(said_on AS DATE) AS d, regexp_extract(text, '(?:^|[^\"a-zA-Z0-9])({RELATIVE})\\b', 1) AS m FROM lines), y AS (SELECT line_id, text, d, m, CAST(coalesce(v, regexp_extract(m, '^([0-9]+) ', 1)) AS VARCHAR) AS k FROM x LEFT JOIN n ON n.w = regexp_extract(m, '^([a-z]+) ', 1)), z AS (SELECT line_id, text, m, d, try_cast(k AS INTEGER) AS k FROM y) SELECT line_id, CASE WHEN m = '' THEN text ELSE replace(text, m, m || ' [' || CASE WHEN contains(m, 'week') OR contains(m, 'month') THEN '~' ELSE '=' END || ' ' || CAST({_DAY} AS VARCHAR) || ' ' || strftime({_DAY}, '%a') || ']') END AS text FROM z")
def _(t: Tables) -> DataFrame:
    return t.lines.select("line_id", annotated("text", F.to_date("said_on")).alias("text"))


@R.add("scl23_title_guard", "SELECT line_id, regexp_matches(text, '\"(Yesterday|Today|Tomorrow)') OR regexp_matches(text, '[a-z,] (Yesterday|Today|Tomorrow)\\b') AS title, regexp_matches(text, '\\b(yesterday|today|tomorrow)\\b') AS day_word FROM lines WHERE regexp_matches(lower(text), '\\b(yesterday|today|tomorrow)\\b')")
def _(t: Tables) -> DataFrame:
    """Whether a day word is quoted or capitalised within a sentence, and so a title."""
    day = r"\b(yesterday|today|tomorrow)\b"
    title = F.col("text").rlike(r"(?:\"|[a-z,] )(?:Yesterday|Today|Tomorrow)\b")
    return t.lines.where(F.lower("text").rlike(day)).select("line_id", title.alias("title"), F.col("text").rlike(day).alias("day_word"))
