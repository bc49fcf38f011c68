"""Rules for questions and statements on sentences that no table holds."""

from datetime import date

from pyspark.sql import functions as F

from stratamem.functions import questions as q


def applied(spark, texts, made):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    return [r["x"] for r in df.select("k", made(F.col("text")).alias("x")).orderBy("k").collect()]


def test_kinds_of_questions(spark):
    cases = {
        "How long did the trip take?": "temporal", "Did I call Bo after the party?": "temporal", "How many plants have I got?": "multi_session_aggregation",
        "What is the AVERAGE price?": "multi_session_aggregation", "Where do I currently work?": "current_state", "Am I still a member?": "current_state",
        "Any tips for the marathon?": "preference_application", "What should I cook?": "preference_application", "What is my dog called?": "direct", "": "direct",
    }
    assert applied(spark, cases, q.kind) == list(cases.values())


def test_modes_of_questions(spark):
    cases = {
        "How many weeks have passed since I moved?": (True, "date", False), "How long ago was that?": (False, "date", False), "How many days ago did we meet?": (False, "date", False),
        "How many concerts did I go to?": (True, "count", True), "How many hours did I sleep?": (True, "count", False), "How much more did I spend than Al?": (True, None, False),
        "Did I visit Rome or Pisa first?": (False, "order", False), "Who are you?": (False, None, False), "How many years old will I be in total?": (True, None, False),
    }
    made = lambda c: F.struct(q.asks_aggregate(c).alias("a"), q.mode(c).alias("m"), F.coalesce(q.plain_count(c), F.lit(False)).alias("c"))
    assert [tuple(r) for r in applied(spark, cases, made)] == list(cases.values())


def test_personal_spans_stand_in_the_text(spark):
    texts = ["Well. I've been in Oslo since 2.5 weeks ago!  If I go, I need a coat. My old car takes ages\nto start. Is it? we own 3.5 acres", "", "   ", "No facts here.\n\nWe walked home.  "]
    for text, found in zip(texts, applied(spark, texts, q.pieces), strict=True):
        assert all(text[x["start"] : x["end"]] == x["text"] == x["text"].strip() for x in found)
    kept = lambda c: F.transform(F.filter(q.pieces(c), lambda x: q.personal(x["text"])), lambda x: x["text"])
    assert applied(spark, texts, kept) == [["I've been in Oslo since 2.5 weeks ago!", "My old car takes ages\nto start.", "we own 3.5 acres"], [], [], ["We walked home."]]


def test_numbers_keep_their_own_units(spark):
    cases = [
        ("I ran 5 km and 30 minutes more", "5", "km", True), ("I ran 5 km and 30 minutes more", "30", "km", False), ("a 20-page book", "20", "page", True), ("cost $1,200.50 today", "1200.50", "$", True),
        ("cost $ 12", "12", "$", True), ("cost 12 $", "12", "$", False), ("12 KM", "12", "km", True), ("12 kmh", "12", "km", False), ("12 km", "12", "", False), ("120 km", "20", "km", False),
    ]
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k long, s string, v string, u string")
    got = [r["x"] for r in df.select("k", q.quantity_bound(F.col("s"), F.col("v"), F.col("u")).alias("x")).orderBy("k").collect()]
    assert got == [c[3] for c in cases]


def test_titles_are_no_days(spark):
    cases = {
        "We sang Yesterday all night": True, "Yesterday we sang": False, "Fine. Today I rest": False, 'She read "no day but today" twice': True, 'He said "hi". I left today': False, "See you tomorrow": False,
        "I like No Day But Today": True,
    }
    assert applied(spark, cases, lambda c: q.title(c)[1]) == list(cases.values())


def test_question_timelines(spark):
    events = [(1, 10, "I bought a red bike on 2023-05-02", None), (1, 11, "I sold the red bike", date(2024, 1, 1)), (1, 12, "The bike shop closed", date(2020, 1, 1)), (1, 13, "A red bike was stolen", None), (2, 14, "red bike", None)]
    asked = [(1, 1, "In what order did I get and lose the red bike?"), (2, 1, "Where is the red bike?"), (3, 2, "Which red bike came first?"), (4, 1, "What came next, the cat or the dog?")]
    e = spark.createDataFrame(events, "user_id long, id long, content string, day date")
    found = q.question_timeline(spark.createDataFrame(asked, "question_id long, user_id long, question string"), e).collect()
    assert sorted(tuple(r) for r in found if r["day"]) == [(1, 1, 10, date(2023, 5, 2)), (1, 2, 11, date(2024, 1, 1))]
    assert [tuple(r) for r in found if not r["day"]] == [(1, 3, 13, None)]


def test_days_worked_out_anew(spark):
    said = date(2024, 3, 10)
    cases = {
        "I left on 2024-03-01.": (date(2024, 3, 1), date(2024, 3, 1), "unchanged"), 'We watched "Yesterday" at home.': (date(2024, 3, 9), None, "withdrawn"),
        "We met on May 4, 2023.": (None, date(2023, 5, 4), "recovered"), "The bill of April 2, 2024 came today.": (said, date(2024, 4, 2), "corrected"),
        "It broke three days ago.": (None, date(2024, 3, 7), "recovered"), "Nothing to say.": (None, None, "unchanged"), "today or yesterday": (said, None, "withdrawn"),
    }
    df = spark.createDataFrame([(k, t, said) for k, t in enumerate(cases)], "k long, text string, said date")
    got = df.select("k", q.first_day(F.col("text"), F.col("said")).alias("old"), q.event_day(F.col("text"), F.col("said")).alias("new")).withColumn("c", q.day_change(F.col("old"), F.col("new")))
    assert [tuple(r)[1:] for r in got.orderBy("k").collect()] == list(cases.values())
