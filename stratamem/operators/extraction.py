"""Facts from sentences by rule: predicate, type, object, entities, importance; what an object names; where a quote stands."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.functions.text import all_of, sentences
from stratamem.operators.retrieval import bm25, top_k
from stratamem.operators.timeline import FOLD, KEY, resolved
from stratamem.plans.fixtures import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Names of predicates and types with the patterns that give them, the first that matches counts.
PREDICATES = (
    ("lives_in", r"\b(?:lives? in|moved to|relocated to|resides? in)\b"),
    ("works_as", r"\b(?:works? as|is an? .{0,20}(?:engineer|designer|teacher|nurse|lawyer|manager|developer|analyst))\b"),
    ("works_at", r"\bworks? (?:at|for)\b"),
    ("studies", r"\b(?:studies|studied|is studying|majors? in)\b"),
    ("dislikes", r"\b(?:dislikes?|hates?|no longer|stopped|gave up|does not (?:like|enjoy)|doesn't (?:like|enjoy))\b"),
    ("prefers", r"\b(?:prefers?|likes?|enjoys?|favou?rite|switched to)\b"),
    ("owns", r"\b(?:owns?|has|have|bought|purchased|acquired)\b"),
    ("plans_to", r"\b(?:plans? to|intends? to|is going to|will)\b"),
    ("completed", r"\b(?:completed|finished|attended|visited|went to|did|made|read|watched)\b"),
    ("spent", r"\b(?:spent|paid|cost)\b"),
    ("scheduled", r"\b(?:scheduled|books?|booked|appointment)\b"),
    ("has_relationship", r"\b(?:sister|brother|mother|father|wife|husband|partner|friend|daughter|son)\b"),
    ("has_health_condition", r"\b(?:diagnosed|allergic|condition|symptoms?)\b"),
    ("uses_tool", r"\b(?:uses?|using)\b"),
)
TYPES = (
    ("preference", r"\b(?:prefers?|likes?|dislikes?|hates?|enjoys?|favou?rite)\b"),
    ("procedural", r"\b(?:usually|always|every (?:morning|day|week)|routine|habitually)\b"),
    ("episodic", r"\b(?:attended|visited|went|bought|purchased|completed|finished|last (?:week|month|year)|ago|yesterday)\b"),
    ("profile", r"\b(?:lives? in|works? (?:as|at|for)|is [0-9]+ years old|name is|sister|brother|mother|father|wife|husband)\b"),
)
REPLACES = r"\b(?:no longer|stopped|switched (?:to|from)|moved (?:to|from)|used to|instead of|gave up|quit|replaced)\b"
PROPER_NOUN = r"\b(?:[A-Z][a-z']+\s+){0,3}[A-Z][a-z']{2,}\b"
SENTENCE_LEAD = ("The", "A", "An", "In", "On", "At", "For", "It", "They", "User")
SPLIT = r"\s*(?:,|;|\band\b)\s+"
MEASUREMENT = r"^[0-9]+(?:\.[0-9]+)?\s*(?:pages?|hours?|minutes?|days?|weeks?|months?|years?|km|miles?|kg|lbs?|percent|%)\b"
ARTICLE = r"^(?:the|a|an|some|several|various|my|their|his|her)\s+"
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b\.?"
NTH = r"(?:st|nd|rd|th)?"
DATE_PART = rf"^(?:{MONTH}\s*(?:[0-9]{{1,2}}{NTH},?\s*)?(?:(?:19|20)[0-9]{{2}})?|(?:19|20)[0-9]{{2}}|(?:19|20)[0-9]0s|[0-9]{{1,2}}{NTH}\s+(?:of\s+)?{MONTH}(?:\s*(?:19|20)[0-9]{{2}})?|(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}})$"
OCCASION = rf"\b{MONTH}\s*[0-9]{{1,2}}{NTH}\b|\b{MONTH},?\s*(?:19|20)[0-9]{{2}}\b|\b[0-9]{{1,2}}{NTH}\s+(?:of\s+)?{MONTH}|\b(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}\b|\b[0-9]{{1,2}}:[0-9]{{2}}\b|\b[0-9]{{1,2}}\s*(?:am|pm)\b|[$€£¥]\s?[0-9]"
CLAUSE = r"^(?:attended|held|hosted|visited|located|organi[sz]ed|purchased|bought|read|on|in|at|for|since|from|during|to|by)\b"
BYLINE = r"\bby\s+[A-Z]"
COMPANION = r"\bwith\s+\S"

#: What the rule extractor takes a sentence for a fact by; first-person acts.
STATEMENT = r"\bI (?:have |own |ran |read |moved|bought|visited|switched|replaced|prefer|recommend)|\bMy "


def has(c: Column, pattern: str) -> Column:
    """Whether a pattern matches somewhere, letters in either case."""
    return c.rlike("(?i)" + pattern)


def _first(c: Column, rules: tuple, value, other: Column) -> Column:
    out = other
    for name, pattern in reversed(rules):
        out = F.when(has(c, pattern), value(name, pattern)).otherwise(out)
    return out


def structured(text: Column) -> Column:
    """struct(predicate, type, object, entities, importance, replaces) of a sentence.

    The object is what follows the predicate's words, without blanks, stops and commas at its ends, 80
    characters at most. Entities are runs of up to four capitalised words, each once, a lone word that often leads
    a sentence not counted.
    """
    c = F.trim(text)
    after = lambda pattern: F.left(F.trim(F.regexp_extract(c, f"(?is)^.*?{pattern}(.*)$", 1), F.lit(" .,")), F.lit(80))
    names = F.transform(F.regexp_extract_all(c, F.lit(f"({PROPER_NOUN})"), F.lit(1)), lambda x: F.trim(x))
    real = F.array_distinct(F.filter(names, lambda x: ~x.isin(*SENTENCE_LEAD) & ~F.lower(x).startswith("the user") & ~F.lower(x).startswith("the assistant")))
    share = lambda condition, x: F.when(condition, x).otherwise(0.0)
    importance = F.least(F.lit(1.0), 0.4 + share(c.rlike("[0-9]"), 0.2) + share(F.size(real) > 0, 0.15) + share(has(c, REPLACES), 0.15))
    return F.struct(
        _first(c, PREDICATES, lambda n, _p: F.lit(n), F.lit("states")).alias("predicate"), _first(c, TYPES, lambda n, _p: F.lit(n), F.lit("semantic")).alias("type"),
        _first(c, PREDICATES, lambda _n, p: after(p), F.lit("")).alias("object"), real.alias("entities"), F.round(importance, 6).alias("importance"), has(c, REPLACES).alias("replaces"),
    )


def normal_name(c: Column) -> Column:
    """A name for comparison: case, one leading article and marks at its ends do not count."""
    plain = F.trim(F.regexp_replace(F.lower(c), r"[^\w\s'-]", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, ARTICLE, ""), r"\s+", " "))


def members(c: Column) -> Column:
    """What an object names: its parts at commas, semicolons and `and`; whole if a part would be under three letters; nothing if it is empty or a measurement."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    parts = F.filter(F.transform(F.split(raw, SPLIT), lambda x: F.trim(x)), lambda x: x != "")
    whole = (F.size(parts) == 0) | F.exists(parts, lambda x: F.length(normal_name(x)) < 3)
    return F.when((raw == "") | has(raw, MEASUREMENT), F.array().cast("array<string>")).when(whole, F.array(raw)).otherwise(parts)


def refusal(c: Column) -> Column:
    """Why the parts of an object are not to be trusted, or null."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    parts = members(c)
    single = F.when((F.size(parts) == 1) & has(F.get(parts, F.lit(0)), CLAUSE), "clause").when(has(raw, OCCASION), "occasion")
    several = (
        F.when(raw.rlike(BYLINE), "byline").when(has(raw, COMPANION), "companions").when(F.exists(parts, lambda x: has(x, DATE_PART)), "date among parts")
        .when(F.exists(parts, lambda x: has(x, CLAUSE)), "clause among parts").when(has(raw, OCCASION), "occasion")
    )
    return F.when(F.size(parts) < 2, single).otherwise(several)


def stated(t: Tables) -> DataFrame:
    """line_id, session_id, role, place, fact: the sentences of all lines, in order."""
    return t.lines.select("line_id", "session_id", "role", F.posexplode(F.transform(sentences("text"), lambda x: F.trim(x))).alias("place", "fact"))


def _sql(rules: tuple, value, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(fact, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN {value(n, p.replace(chr(39), chr(39) * 2))}" for n, p in rules) + f" ELSE {other} END"


_Q = lambda p: p.replace("'", "''")
STATED = f"""stated AS (SELECT line_id, session_id, role, place, trim(s[place + 1]) AS fact FROM (SELECT *, unnest(range(len(s))) AS place FROM (SELECT line_id, session_id, role, regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)') AS s FROM lines))),
made AS (SELECT *, {_sql(PREDICATES, lambda n, p: f"'{n}'", "'states'")} AS predicate, {_sql(TYPES, lambda n, p: f"'{n}'", "'semantic'")} AS type,
  {_sql(PREDICATES, lambda n, p: f"left(trim(regexp_extract(fact, '(?is)^.*?{p}(.*)$', 1), ' .,'), 80)", "''")} AS object,
  list_distinct(list_filter(list_transform(regexp_extract_all(fact, '{_Q(PROPER_NOUN)}'), lambda x: trim(x)), lambda x: x NOT IN ({", ".join(f"'{w}'" for w in SENTENCE_LEAD)}) AND NOT starts_with(lower(x), 'the user') AND NOT starts_with(lower(x), 'the assistant'))) AS entities,
  regexp_matches(fact, '(?i){REPLACES}') AS replaces FROM stated)"""


@R.add("scl15_rule_structure", STATED + """ SELECT line_id, place, predicate, type, object, array_to_string(list_sort(entities), '|') AS entities,
  round(least(1.0, 0.4 + CASE WHEN regexp_matches(fact, '[0-9]') THEN 0.2 ELSE 0 END + CASE WHEN len(entities) > 0 THEN 0.15 ELSE 0 END + CASE WHEN replaces THEN 0.15 ELSE 0 END)::DOUBLE, 6) AS importance, replaces FROM made""")
def _(t: Tables) -> DataFrame:
    s = stated(t).select("line_id", F.col("place").cast("long").alias("place"), structured(F.col("fact")).alias("s"))
    return s.select("line_id", "place", "s.predicate", "s.type", "s.object", F.array_join(F.array_sort("s.entities"), "|").alias("entities"), "s.importance", "s.replaces")


_NORMAL = "trim(regexp_replace(regexp_replace(trim(regexp_replace(lower({}), '[^\\w\\s''-]', ' ', 'g')), '" + ARTICLE + "', ''), '\\s+', ' ', 'g'))"


@R.add("scl07_members_and_refusals", STATED + f""", o AS (SELECT DISTINCT object AS raw FROM made WHERE object <> ''),
p AS (SELECT raw, list_filter(list_transform(string_split_regex(raw, '{SPLIT}'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM o),
m AS (SELECT raw, CASE WHEN regexp_matches(raw, '(?i){MEASUREMENT}') THEN [] WHEN len(ps) = 0 OR len(list_filter(ps, lambda x: length({_NORMAL.format("x")}) < 3)) > 0 THEN [raw] ELSE ps END AS parts FROM p)
SELECT raw AS object, array_to_string(parts, '|') AS parts, CASE WHEN len(parts) < 2 THEN CASE WHEN len(parts) = 1 AND regexp_matches(parts[1], '(?i){CLAUSE}') THEN 'clause' WHEN regexp_matches(raw, '(?i){OCCASION}') THEN 'occasion' END
  WHEN regexp_matches(raw, '{BYLINE}') THEN 'byline' WHEN regexp_matches(raw, '(?i){COMPANION}') THEN 'companions' WHEN len(list_filter(parts, lambda x: regexp_matches(x, '(?i){DATE_PART}'))) > 0 THEN 'date among parts'
  WHEN len(list_filter(parts, lambda x: regexp_matches(x, '(?i){CLAUSE}'))) > 0 THEN 'clause among parts' WHEN regexp_matches(raw, '(?i){OCCASION}') THEN 'occasion' END AS refused FROM m""")
def _(t: Tables) -> DataFrame:
    """The objects of all facts, what they name, and why some are not to be split."""
    objects = stated(t).select(structured(F.col("fact"))["object"].alias("object")).where("object <> ''").distinct()
    return objects.select("object", F.array_join(members(F.col("object")), "|").alias("parts"), refusal(F.col("object")).alias("refused"))


def locate(span: str | None, text: str | None, whole: bool = False) -> tuple[int, int] | None:
    """Start and end (exclusive) of a span in a text, in code points of the text as it is; None if it is not there.

    The first place where it stands exactly; else the first beginning of a word from which on the text is the
    span but for case and white space, the white space after it included. Each letter of the text keeps
    the place it came from, also where its lower-case form has another length. whole: it has to begin and end
    with a word of the text, so that `a th` is not found in `a the`.
    """
    if not span or not span.strip() or text is None:
        return None
    at = text.find(span)
    while whole and at >= 0 and not (_parted(text, at) and _parted(text, at + len(span))):
        at = text.find(span, at + 1)
    if at >= 0:
        return at, at + len(span)
    lowered, came, white = [], [], True
    for i, letter in enumerate(text):
        if letter.isspace():
            if not white:
                lowered.append(" ")
                came.append(i)
            white = True
        else:
            low = letter.lower()
            lowered.append(low)
            came += [i] * len(low)
            white = False
    plain, wanted = "".join(lowered), " ".join("".join(x.lower() for x in w) for w in span.split())
    at = plain.find(wanted)
    while at > 0 and plain[at - 1] != " " or whole and at >= 0 and not _parted(plain, at + len(wanted)):
        at = plain.find(wanted, at + 1)
    if at < 0:
        return None
    start, end = came[at], came[at + len(wanted) - 1] + 1
    while end < len(text) and text[end].isspace():
        end += 1
    return start, end


def _parted(text: str, at: int) -> bool:
    """Whether no word of a text goes on over a place in it."""
    return at in (0, len(text)) or text[at - 1].isspace() or text[at].isspace()


def located(span: Column, text: Column, whole: bool = False) -> Column:
    """struct(start, end) by locate(), in Arrow batches; both null where the span is not there."""

    def find(spans: pd.Series, texts: pd.Series) -> pd.DataFrame:
        found = [locate(s, x, whole) or (None, None) for s, x in zip(spans, texts, strict=True)]
        return pd.DataFrame({"start": pd.array([a for a, _ in found], "Int64"), "end": pd.array([b for _, b in found], "Int64")})

    return F.pandas_udf(find, "start long, end long")(span, text)


@R.add("scl09_true_span", """x AS (SELECT session_id, turn_index, content, regexp_extract(content, '^([^\\s]+ +)', 1) AS one, regexp_extract(content, '^[^\\s]+ +([^\\s]+)', 1) AS two, regexp_extract(content, '^[^\\s]+ +[^\\s]+( +)', 1) AS gap, regexp_extract(content, '^[^\\s]+ +[^\\s]+ +([^\\s]+)', 1) AS three, regexp_extract(content, '^[^\\s]+ +[^\\s]+ +[^\\s]+(\\s*)', 1) AS rest FROM turns WHERE regexp_matches(content, '^[^\\s]+ +[^\\s]+ +[^\\s]+')),
y AS (SELECT *, lower(trim(one)) = lower(two) AND starts_with(lower(two || gap || three), lower(two) || ' ' || lower(three)) AND lower(two) = lower(three) AS same FROM x)
SELECT session_id, turn_index, CASE WHEN same THEN 0 ELSE length(one) END AS start, CASE WHEN same THEN length(one) + length(two) + length(gap) ELSE length(one) + length(two) + length(gap) + length(three) + length(rest) END AS end FROM y""")
def _(t: Tables) -> DataFrame:
    """A turn's second and third word, quoted with other spacing and in capitals: where the turn has them as words."""
    p = r"^\S+ +(\S+) +(\S+)"
    quote = F.concat(F.translate(F.regexp_extract("content", p, 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("\t \n"), F.regexp_extract("content", p, 2))
    x = t.turns.where(F.col("content").rlike(p)).select("session_id", "turn_index", located(quote, F.col("content"), whole=True).alias("x"))
    return x.select("session_id", "turn_index", "x.start", "x.end")


#: The sessions of the three turns that a query scores best on; then turns by score in these alone.
WITHIN = """tok AS (SELECT session_id, turn_index, regexp_extract_all(lower(content), '[a-z0-9]+') AS ts FROM turns), st AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM tok),
tf AS (SELECT session_id, turn_index, len, term, count(*) AS tf FROM (SELECT session_id, turn_index, len(ts) AS len, unnest(ts) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
bm AS (SELECT query_id, session_id, turn_index, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term, st GROUP BY ALL),
best AS (SELECT DISTINCT query_id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id, turn_index) AS rn FROM bm) WHERE rn <= 3)
SELECT query_id, session_id, turn_index, score, rank FROM (SELECT bm.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id, turn_index) AS rank FROM bm JOIN best USING (query_id, session_id)) WHERE rank <= 5"""


@R.add("topk05_scored_within_sessions", WITHIN)
def _(t: Tables) -> DataFrame:
    """The filter on sessions comes before the limit; statistics are the archive's."""
    turns = t.turns.select(F.struct("session_id", "turn_index").alias("turn"), F.col("content").alias("text"))
    scored = bm25(turns, t.raw("benchmark").select(F.col("item_id").alias("query_id"), "text"), "turn").select("query_id", "turn.session_id", "turn.turn_index", "score")
    order = (F.desc("score"), F.col("session_id"), F.col("turn_index"))
    given = top_k(scored, ["query_id"], 3, *order).select("query_id", "session_id").distinct()
    return top_k(scored.join(given, ["query_id", "session_id"], "left_semi"), ["query_id"], 5, *order).select("query_id", "session_id", "turn_index", "score", "rank")


def update_pairs(facts: DataFrame) -> DataFrame:
    """earlier, later: facts of one user that name the same specific on different keys, next to each other in time, the later one said to replace something."""
    from pyspark.sql import Window as W

    by = W.partitionBy("user_id", "specific").orderBy("occurred_at", "id")
    x = facts.withColumn("specific", F.regexp_extract("content", "([0-9]+)", 1)).where("occurred_at IS NOT NULL AND specific <> ''")
    x = x.withColumns({"earlier": F.lag("id").over(by), "was": F.lag("predicate").over(by)})
    return x.where("earlier IS NOT NULL AND was <> predicate AND update_op = 'replaces'").select("earlier", F.col("id").alias("later"))


def apply_updates(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, status, until, by of all keys that confirmed pairs touch: the later fact goes to the earlier one's key and replaces its value."""
    theirs = facts.join(pairs.withColumnRenamed("earlier", "id"), "id").select(F.col("later").alias("id"), *[F.col(k).alias(f"to_{k}") for k in KEY], F.coalesce("object", "content").alias("to_value"))
    moved = facts.join(theirs, "id", "left")
    on = F.col("to_value").isNotNull()
    moved = moved.withColumns({k: F.when(on, F.col(f"to_{k}")).otherwise(F.col(k)) for k in KEY} | {"target": F.when(on, F.col("to_value")).otherwise(F.col("target")), "update_op": F.when(on, "replaces").otherwise(F.col("update_op")), "moved": on})
    touched = moved.where("moved").select(*KEY).distinct()
    return resolved(moved.join(touched, KEY, "left_semi"))


@R.add("tmp11_confirmed_update", """c AS (SELECT *, regexp_extract(content, '([0-9]+)', 1) AS specific FROM memories WHERE occurred_at IS NOT NULL),
l AS (SELECT *, lag(id) OVER w AS earlier, lag(predicate) OVER w AS was FROM c WHERE specific <> '' WINDOW w AS (PARTITION BY user_id, specific ORDER BY occurred_at, id)),
pairs AS (SELECT earlier, id AS later FROM l WHERE earlier IS NOT NULL AND was <> predicate AND update_op = 'replaces'),
moved AS (SELECT m.id, m.user_id, m.subject, coalesce(e.predicate, m.predicate) AS predicate, m.object, m.occurred_at, CASE WHEN e.id IS NULL THEN m.update_op ELSE 'replaces' END AS op,
  CASE WHEN e.id IS NULL THEN CASE WHEN m.id % 7 = 0 THEN m.object END ELSE coalesce(e.object, e.content) END AS target, e.id IS NOT NULL AS on_pair FROM memories m LEFT JOIN pairs ON pairs.later = m.id LEFT JOIN memories e ON e.id = pairs.earlier),
""" + FOLD.replace("SELECT id, user_id, subject, predicate, object, occurred_at, {op} AS op, CASE WHEN id % 7 = 0 THEN object END AS target FROM memories{where}", "SELECT * FROM moved WHERE (user_id, predicate) IN (SELECT (user_id, predicate) FROM moved WHERE on_pair)").replace("{{", "{").replace("}}", "}") + " SELECT r.id, status, strftime(until, '%Y-%m-%d %H:%M:%S') AS until, r.by FROM resolved r")
def _(t: Tables) -> DataFrame:
    from stratamem.operators.timeline import facts_of

    facts = facts_of(t)
    out = apply_updates(facts, update_pairs(facts))
    return out.select("id", "status", F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("until"), "by")
