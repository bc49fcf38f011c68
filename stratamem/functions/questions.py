"""What a question asks for, what a user states of themself, and which words bind a number or a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratamem.functions.text import RELATIVE_SQL, STOP_WORDS, all_of, relative_date, stated_dates
from stratamem.plans.fixtures import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Patterns of the kinds of questions, the first that matches counts; letters in either case.
KINDS = (
    ("temporal", r"\b(?:how long|when did|elapsed|before|after|since|ago|(?:first|earlier|later)\b|older\b.*\bthan)\b"),
    ("multi_session_aggregation", r"\b(?:how many|total|count|average|mean|sum|combined|altogether|all (?:the|my)|different|each)\b"),
    ("current_state", r"\b(?:current(?:ly)?|right now|latest|most recent|still|switched|changed|prefer now|use now)\b"),
    ("preference_application", r"\b(?:recommend|suggest|advice|tips?|should i|what should|best for me)\b"),
)
AGGREGATE = r"\b(?:how\s+many|how\s+much|in\s+total|total|combined|altogether|sum\s+of|number\s+of)\b"
AGO = r"\bhow\s+(?:many|much)\b.*\bago\b"
WEEKDAY = r"(?:mon|tues|wednes|thurs|fri|satur|sun)day"
TIME = rf"\b(?:when|how\s+long|how\s+(?:many|much)\s+(?:days?|weeks?|months?|years?|hours?|minutes?|time)|ago|first|earlier|later|before|after|since|until|order|most\s+recent(?:ly)?|last\s+(?:week|weekend|month|year|{WEEKDAY})|this\s+(?:week|weekend|month|year)|past\s+(?:week|weekend|month|year|few)|yesterday|date|what\s+day)\b"
DATE_ARITHMETIC = r"\bhow\s+(?:many|much)\s+(?:days?|weeks?|months?|years?)\b.*\b(?:ago|before|after|between|since|passed|until|from|when)\b|\bhow\s+long\s+ago\b"
TOTAL = r"\b(?:in\s+total|total|combined|altogether|sum)\b"
AGE = r"\b(?:will\s+i\s+be|old)\b"
NOT_A_SUM = r"\b(?:more|less|fewer|than|left|remain\w*|need|difference|percent\w*|average|per|each|old|age|rate|ratio|will)\b"
ORDER = r"\b(?:first|earlier|before|after|later|most\s+recent(?:ly)?)\b"
ALTERNATIVES = r"\S\s+or\s+\S"
UNIT_COUNT = r"\bhow\s+many\s+(?:\w+\s+)?(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?)\b"
DERIVED = r"\b(?:exceed\w*|faster|slower|longer|shorter|since)\b"
PERSONAL = (
    r"\b(?:I|we)\s+(?:am|was|were|have|had|enjoy|like|love|prefer|want|need|attended|volunteered|bought|made|learned|started|finished|use|listen|live|work|"
    r"commute|moved|remember|already|recently|usually|currently|feel|do|did|don't|didn't|walked|got|participated|donated|spent|paid|own|replaced|fixed|noticed)\b|"
    "\\bI['\u2019](?:m|ve|d)\\b" + r"|\b(?:my|our)\b[^.!?]{0,90}\b(?:is|are|has|have|takes|lasts)\b"
)
HYPOTHETICAL = r"\b(?:if I|suppose I|imagine I)\b"
ACT = r"\b(?:started|began|finished|completed|received|bought|purchased|ordered|invested|attended|harvested|went)\b"
ASKS_ORDER = r"\b(?:order|sequence|chronological|first|then|next|last)\b"
#: A sentence with what white space follows it: up to an end mark that white space or the text's end follows.
PIECE = r"(?s).+?(?:[.!?]\s|$)"


def says(c: Column, pattern: str) -> Column:
    return c.rlike("(?i)" + pattern)


def kind(q: Column) -> Column:
    """The kind of a question, `direct` if none of the others."""
    out = F.lit("direct")
    for name, pattern in reversed(KINDS):
        out = F.when(says(q, pattern), name).otherwise(out)
    return out


def asks_aggregate(q: Column) -> Column:
    """A count or total to be put together; how many days ago is a date instead."""
    return says(q, AGGREGATE) & ~says(q, AGO)


def mode(q: Column) -> Column:
    """The computation that a question takes: date, count, order or null."""
    return (
        F.when(says(q, DATE_ARITHMETIC) & ~says(q, TOTAL) & ~says(q, AGE), "date").when(asks_aggregate(q) & ~says(q, NOT_A_SUM), "count").when(says(q, ORDER) & says(q, ALTERNATIVES), "order")
    )


def plain_count(q: Column) -> Column:
    """Whether a question counts things, not a duration or a difference."""
    return (mode(q) == "count") & says(q, r"\bhow\s+many\b") & ~says(q, UNIT_COUNT) & ~says(q, DERIVED)


def pieces(c: Column) -> Column:
    """array of struct(start, end, text): the sentences of a text without white space around them, and where they stand."""
    found = F.regexp_extract_all(c, F.lit(f"({PIECE})"), F.lit(1))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")

    def one(x: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda s, y: s + F.length(y)) + F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))
        return F.struct(start.cast("long").alias("start"), (start + F.length(bare(x))).cast("long").alias("end"), bare(x).alias("text"))

    return F.filter(F.transform(found, one), lambda x: x["text"] != "")


def personal(x: Column) -> Column:
    """Whether a sentence states something of the speaker and supposes nothing."""
    return says(x, PERSONAL) & ~says(x, HYPOTHETICAL)


def quantity_bound(quote: Column, value: Column, unit: Column) -> Column:
    """Whether a quote has a value right before its unit, or right after it if that is a currency sign; another number's unit does not count."""
    number = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
    quoted = F.concat(F.lit(r"\Q"), unit, F.lit(r"\E"))
    money = unit.isin("$", "£", "€", "¥")
    pattern = F.when(money, F.concat(quoted, F.lit(r"\s*" + number))).otherwise(F.concat(F.lit("(?i)" + number + r"\s*-?\s*"), quoted, F.lit(r"\b")))
    exact = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(20,6)")
    return (unit != "") & F.exists(F.regexp_extract_all(quote, pattern, F.lit(1)), lambda x: exact(x) == exact(value))


def title(c: Column) -> tuple[Column, Column]:
    """The first of yesterday, today and tomorrow in a text, and whether it is part of a title: in quotes, or capitalised within a sentence."""
    day = r"\b(yesterday|today|tomorrow)\b"
    before, word = F.regexp_extract(c, rf"(?is)^(.*?){day}", 1), F.regexp_extract(c, rf"(?is)^.*?{day}", 1)
    quoted = (F.length(before) - F.length(F.replace(before, F.lit('"'), F.lit("")))) % 2 == 1
    return word, quoted | (word.rlike("^[A-Z]") & ~before.rlike(r"(?:^|[.!?]\s+)$"))


def topic_words(c: Column) -> Column:
    """The distinct words of a text in lower case that say what it is about."""
    return F.array_distinct(F.filter(all_of(F.lower(c), "[a-z0-9]+"), lambda x: ~x.isin(*STOP_WORDS)))


def _i(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '(?i)" + pattern.replace("'", "''") + "')"


_KIND = "CASE " + " ".join(f"WHEN {_i('text', p)} THEN '{n}'" for n, p in KINDS) + " ELSE 'direct' END"
_AGGREGATE = f"({_i('text', AGGREGATE)} AND NOT {_i('text', AGO)})"
_MODE = f"CASE WHEN {_i('text', DATE_ARITHMETIC)} AND NOT {_i('text', TOTAL)} AND NOT {_i('text', AGE)} THEN 'date' WHEN {_AGGREGATE} AND NOT {_i('text', NOT_A_SUM)} THEN 'count' WHEN {_i('text', ORDER)} AND {_i('text', ALTERNATIVES)} THEN 'order' END"


@R.add("flt16_reasoning_kind", f"SELECT line_id, {_KIND} AS kind FROM lines UNION ALL SELECT -1 - session_id * 1000 - turn_index, {_KIND.replace('text', 'content')} FROM turns")
def _(t: Tables) -> DataFrame:
    """Lines, and turns of the conversations under negative numbers."""
    turns = t.turns.select((-1 - F.col("session_id") * 1000 - F.col("turn_index")).alias("line_id"), kind(F.col("content")).alias("kind"))
    return t.lines.select("line_id", kind(F.col("text")).alias("kind")).union(turns)


@R.add("flt17_question_modes", f"SELECT line_id, {_AGGREGATE} AS aggregate, {_i('text', TIME)} AS about_time, {_MODE} AS mode, coalesce({_MODE} = 'count', false) AND {_i('text', chr(92) + 'bhow' + chr(92) + 's+many' + chr(92) + 'b')} AND NOT {_i('text', UNIT_COUNT)} AND NOT {_i('text', DERIVED)} AS counts FROM lines")
def _(t: Tables) -> DataFrame:
    q = F.col("text")
    return t.lines.select("line_id", asks_aggregate(q).alias("aggregate"), says(q, TIME).alias("about_time"), mode(q).alias("mode"), F.coalesce(plain_count(q), F.lit(False)).alias("counts"))


@R.add("flt10_statements", "SELECT session_id, turn_index, sha256(array_to_string(list_filter(regexp_extract_all(content, '[^.!?]+[.!?]?'), lambda x: NOT ends_with(rtrim(x, ' ' || chr(9) || chr(10) || chr(13)), '?')), chr(10))) AS digest FROM turns WHERE role = 'user' UNION ALL SELECT session_id, line_id, sha256(array_to_string(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda x: NOT ends_with(rtrim(x, ' ' || chr(9) || chr(10) || chr(13)), '?')), chr(10))) FROM lines WHERE role = 'user'")
def _(t: Tables) -> DataFrame:
    """What users say in turns and lines but do not ask, a sentence a line, as a digest."""
    stated = lambda c: F.sha2(F.array_join(F.filter(all_of(c, "[^.!?]+[.!?]?"), lambda x: ~F.rtrim(x, F.lit(" \t\n\r")).endswith("?")), "\n"), 256).alias("digest")
    return t.turns.where("role = 'user'").select("session_id", "turn_index", stated("content")).union(t.lines.where("role = 'user'").select("session_id", F.col("line_id").alias("turn_index"), stated("text")))


_PIECES = "regexp_extract_all(text, '" + PIECE + "')"


@R.add("flt11_personal_spans", f"""p AS (SELECT line_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT line_id, {_PIECES} AS ps FROM lines WHERE role = 'user')),
x AS (SELECT line_id, CAST(coalesce(list_sum(list_transform(ps[1:i - 1], lambda y: length(y))), 0) + length(ps[i]) - length(regexp_replace(ps[i], '^\\s+', '')) AS BIGINT) AS start, regexp_replace(regexp_replace(ps[i], '^\\s+', ''), '\\s+$', '') AS text FROM p)
SELECT line_id, start, CAST(start + length(text) AS BIGINT) AS end, text FROM x WHERE text <> '' AND {_i('text', PERSONAL)} AND NOT {_i('text', HYPOTHETICAL)}""")
def _(t: Tables) -> DataFrame:
    s = t.lines.where("role = 'user'").select("line_id", F.explode(pieces(F.col("text"))).alias("x")).select("line_id", "x.*")
    return s.where(personal(F.col("text")))


@R.add("flt12_event_sources", RELATIVE_SQL + f" SELECT l.line_id FROM lines l JOIN relative r ON r.line_id = l.line_id WHERE role = 'user' AND {_i('text', ACT)} AND (regexp_matches(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{{1,2}}, [0-9]{{4}}') OR r.exact IS NOT NULL OR r.estimate IS NOT NULL)")
def _(t: Tables) -> DataFrame:
    """User lines with an act and a day that it can be put on."""
    d = relative_date("text", F.to_date("said_on"))
    dated = (F.size(stated_dates("text")) > 0) | d["exact"].isNotNull() | d["estimate"].isNotNull()
    return t.lines.where((F.col("role") == "user") & says(F.col("text"), ACT) & dated).select("line_id")


@R.add("scl13_quantity_bound", """n AS (SELECT line_id, text, lead(text) OVER (PARTITION BY session_id ORDER BY turn_index) AS said FROM lines),
q AS (SELECT line_id, text, regexp_extract(said, '([0-9][0-9,]*(?:\\.[0-9]+)?) ([a-z]+)', 1) AS value, regexp_extract(said, '([0-9][0-9,]*(?:\\.[0-9]+)?) ([a-z]+)', 2) AS unit FROM n WHERE said IS NOT NULL)
SELECT line_id, value, unit, unit <> '' AND len(list_filter(regexp_extract_all(text, '(?i)([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*-?\\s*' || unit || '\\b', 1), lambda x: try_cast(replace(x, ',', '') AS DECIMAL(20, 6)) = try_cast(replace(value, ',', '') AS DECIMAL(20, 6)))) > 0 AS bound FROM q""")
def _(t: Tables) -> DataFrame:
    """Whether a line holds the first quantity of the line after it, the number with that very unit."""
    p = r"([0-9][0-9,]*(?:\.[0-9]+)?) ([a-z]+)"
    n = t.lines.withColumn("said", F.lead("text").over(W.partitionBy("session_id").orderBy("turn_index"))).where("said IS NOT NULL")
    q = n.select("line_id", "text", F.regexp_extract("said", p, 1).alias("value"), F.regexp_extract("said", p, 2).alias("unit"))
    return q.select("line_id", "value", "unit", quantity_bound(F.col("text"), F.col("value"), F.col("unit")).alias("bound"))


@R.add("scl23_titles_and_days", """x AS (SELECT line_id, regexp_extract(text, '(?is)^(.*?)\\b(yesterday|today|tomorrow)\\b', 1) AS pre, regexp_extract(text, '(?is)^(.*?)\\b(yesterday|today|tomorrow)\\b', 2) AS word FROM lines)
SELECT line_id, word, (length(pre) - length(replace(pre, '"', ''))) % 2 = 1 OR (regexp_matches(word, '^[A-Z]') AND NOT regexp_matches(pre, '(?:^|[.!?]\\s+)$')) AS title FROM x WHERE word <> ''""")
def _(t: Tables) -> DataFrame:
    word, is_title = title(F.col("text"))
    return t.lines.select("line_id", word.alias("word"), is_title.alias("title")).where("word <> ''")


def question_timeline(questions: DataFrame, events: DataFrame, least: int = 2) -> DataFrame:
    """question_id, place, id, day: for each question about an order the events of its user that share `least` topic words with it, in order of the day they name.

    questions: question_id, user_id, question; events: user_id, id, content, day (used where the content names none). Events
    without a day come last, ties go by id. A question with fewer than two such events has no timeline.
    """
    named = F.try_to_date(F.try_element_at(all_of("content", "[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(1)), "yyyy-MM-dd")
    e = events.select("user_id", "id", F.coalesce(named, "day").alias("day"), F.explode(topic_words(F.col("content"))).alias("w"))
    q = questions.where(says(F.col("question"), ASKS_ORDER)).select("question_id", "user_id", F.explode(topic_words(F.col("question"))).alias("w"))
    found = q.join(e, ["user_id", "w"]).groupBy("question_id", "id", "day").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    by = W.partitionBy("question_id")
    placed = found.withColumns({"place": F.row_number().over(by.orderBy(F.asc_nulls_last("day"), "id")).cast("long"), "all": F.count(F.lit(1)).over(by)})
    return placed.where("all >= 2").select("question_id", "place", "id", "day")


_TOPIC = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")))"


@R.add("tmp13_question_timeline", f"""e AS (SELECT session_id AS user_id, line_id AS id, text AS content, coalesce(try_cast(nullif(regexp_extract(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), '') AS DATE), CAST(said_on AS DATE)) AS day FROM lines WHERE role = 'user' AND {_i('text', ACT)}),
q AS (SELECT user_id AS question_id, user_id, 'In what order, from first to last: ' || min_by(content, id) AS question FROM e GROUP BY user_id),
m AS (SELECT question_id, id, day, count(*) AS n FROM (SELECT question_id, user_id, unnest({_TOPIC.format("question")}) AS w FROM q) x JOIN (SELECT user_id, id, day, unnest({_TOPIC.format("content")}) AS w FROM e) y USING (user_id, w) GROUP BY ALL HAVING count(*) >= 2)
SELECT question_id, place, id, CAST(day AS VARCHAR) AS day FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY day, id) AS place, count(*) OVER (PARTITION BY question_id) AS c FROM m) WHERE c >= 2""")
def _(t: Tables) -> DataFrame:
    """Each customer is asked in what order the likes of their first act happened."""
    events = t.lines.where((F.col("role") == "user") & says(F.col("text"), ACT)).select(F.col("session_id").alias("user_id"), F.col("line_id").alias("id"), F.col("text").alias("content"), F.to_date("said_on").alias("day"))
    asked = events.groupBy("user_id").agg(F.min_by("content", "id").alias("first"))
    questions = asked.select(F.col("user_id").alias("question_id"), "user_id", F.concat(F.lit("In what order, from first to last: "), "first").alias("question"))
    return question_timeline(questions, events).withColumn("day", F.col("day").cast("string"))


def first_day(c: Column, said: Column) -> Column:
    """The day that a first rule puts a text on: its first ISO date, else that of the first of yesterday and today in it, whatever they stand in."""
    iso = F.try_to_date(F.try_element_at(all_of(c, "[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(1)), "yyyy-MM-dd")
    word = F.lower(F.regexp_extract(c, r"(?is)^.*?\b(yesterday|today)\b", 1))
    return F.coalesce(iso, F.when(word == "yesterday", F.date_sub(said, 1)).when(word == "today", said))


def event_day(c: Column, said: Column) -> Column:
    """The day that a text's event is on: the least date that it states, in figures or with the month's name, else its one exact relative day, unless that word is part of a title."""
    word, is_title = title(c)
    relative = relative_date(c, said)["exact"]
    return F.coalesce(F.array_min(stated_dates(c)), F.when((word != "") & is_title, None).otherwise(relative))


def day_change(old: Column, new: Column) -> Column:
    """What becomes of a day that is worked out anew."""
    return F.when(old.eqNullSafe(new), "unchanged").when(new.isNull(), "withdrawn").when(old.isNull(), "recovered").otherwise("corrected")


_NAMED = "(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}"


@R.add("tmp14_event_day_backfill", RELATIVE_SQL + rf""", s AS (SELECT line_id, text, CAST(said_on AS DATE) AS said, regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS iso, regexp_extract_all(text, '{_NAMED}') AS named, lower(regexp_extract(text, '(?is)^.*?\b(yesterday|today)\b', 1)) AS word,
  regexp_extract(text, '(?is)^(.*?)\b(yesterday|today|tomorrow)\b', 1) AS pre, regexp_extract(text, '(?is)^.*?\b(yesterday|today|tomorrow)\b', 1) AS day_word FROM lines),
d AS (SELECT s.line_id, coalesce(try_cast(iso[1] AS DATE), CASE word WHEN 'yesterday' THEN said - 1 WHEN 'today' THEN said END) AS old,
  coalesce(list_min(list_concat(list_transform(iso, lambda x: try_cast(x AS DATE)), list_transform(named, lambda x: CAST(strptime(x, '%B %-d, %Y') AS DATE)))),
    CASE WHEN day_word <> '' AND ((length(pre) - length(replace(pre, '"', ''))) % 2 = 1 OR (regexp_matches(day_word, '^[A-Z]') AND NOT regexp_matches(pre, '(?:^|[.!?]\s+)$'))) THEN NULL ELSE r.exact END) AS new FROM s JOIN relative r ON r.line_id = s.line_id)
SELECT line_id, CAST(old AS VARCHAR) AS old, CAST(new AS VARCHAR) AS new, CASE WHEN old IS NOT DISTINCT FROM new THEN 'unchanged' WHEN new IS NULL THEN 'withdrawn' WHEN old IS NULL THEN 'recovered' ELSE 'corrected' END AS change FROM d""")
def _(t: Tables) -> DataFrame:
    """Days under a first rule and under the present one, line by line."""
    said = F.to_date("said_on")
    d = t.lines.select("line_id", first_day(F.col("text"), said).alias("old"), event_day(F.col("text"), said).alias("new"))
    return d.select("line_id", F.col("old").cast("string").alias("old"), F.col("new").cast("string").alias("new"), day_change(F.col("old"), F.col("new")).alias("change"))
