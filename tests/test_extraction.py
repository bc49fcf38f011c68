"""Rules on sentences of their own, spans in texts with odd letters, extractors swapped in, order-free digests."""

import random

from pyspark.sql import functions as F

from stratamem.operators import extraction, hooks, measures
from stratamem.operators.timeline import resolved
from stratamem.plans.fixtures import Tables

SF = "/root/testdata/sf0.001"


def test_structure_of_sentences(spark):
    cases = {
        "She lives in Lisbon.": ("lives_in", "profile", "Lisbon", ["She", "Lisbon"], 0.55, False),
        "My brother works for Acme Corp since 2019": ("works_at", "profile", "Acme Corp since 2019", ["Acme Corp"], 0.75, False),
        "The user no longer drinks coffee": ("dislikes", "semantic", "drinks coffee", [], 0.55, True),
        "He is a very patient teacher, they say": ("works_as", "semantic", "they say", [], 0.4, False),
        "They PAID $40 for a ticket yesterday!": ("spent", "episodic", "$40 for a ticket yesterday!", [], 0.6, False),
        "nothing here": ("states", "semantic", "", [], 0.4, False),
        "": ("states", "semantic", "", [], 0.4, False),
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string").select("text", extraction.structured(F.col("text")).alias("s"))
    got = {r["text"]: (r["s"]["predicate"], r["s"]["type"], r["s"]["object"], r["s"]["entities"], r["s"]["importance"], r["s"]["replaces"]) for r in df.collect()}
    assert got == cases
    long = spark.createDataFrame([("She owns " + "x" * 200,)], "text string").select(extraction.structured(F.col("text"))["object"]).first()[0]
    assert long == "x" * 80


def test_members_and_refusals(spark):
    cases = {
        "The Huffington Post and Politico": (["The Huffington Post", "Politico"], None),
        "Spaghetti Carbonara": (["Spaghetti Carbonara"], None),
        "Simon and A": (["Simon and A"], None),
        "55 pages per day": ([], None),
        "Milk and Filth by Carmen Smith": (["Milk", "Filth by Carmen Smith"], "byline"),
        "basketball with Tom and Alex": (["basketball with Tom", "Alex"], "companions"),
        "MoMA, Dec 2023": (["MoMA", "Dec 2023"], "date among parts"),
        "the museum, visited in spring": (["the museum", "visited in spring"], "clause among parts"),
        "attended a fair": (["attended a fair"], "clause"),
        "sneakers for $80": (["sneakers for $80"], "occasion"),
        "1984": (["1984"], None),
        "": ([], None),
        None: ([], None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "o string").select("o", extraction.members(F.col("o")).alias("m"), extraction.refusal(F.col("o")).alias("r"))
    assert {r["o"]: (r["m"], r["r"]) for r in df.collect()} == cases


def test_spans_are_those_of_the_text_as_it_is(spark):
    cases = [
        ("straße  ist", "Die Straße\n\tist lang", (4, 16)), ("İstanbul Is", "see  İSTANBUL   is it", (5, 19)), ("a b", "xa b a  B c", (1, 4)), ("A b", "xa b a  B c", (5, 10)),
        ("", "text", None), ("  ", "text", None), ("no", "text", None), (None, "text", None), ("x", None, None), ("end of", "the END   of", (4, 12)),
    ]
    df = spark.createDataFrame([(k, s, t) for k, (s, t, _) in enumerate(cases)], "k long, s string, t string")
    got = {r["k"]: r["x"] for r in df.select("k", extraction.located(F.col("s"), F.col("t")).alias("x")).collect()}
    for k, (_, _, want) in enumerate(cases):
        assert (None if got[k]["start"] is None else (got[k]["start"], got[k]["end"])) == want, cases[k]

    # against trying all spans
    rnd = random.Random(13)
    plain = lambda x: " ".join("".join(c.lower() for c in w) for w in x.split())
    for _ in range(400):
        text = "".join(rnd.choices(["a", "B", "İ", "ß", " ", "  ", "\n", "é"], k=12))
        span = "".join(rnd.choices(["A", "b", "İ", " ", "\t", "é"], k=3))
        want = None
        if span.strip():
            at = text.find(span)
            if at >= 0:
                want = at, at + len(span)
            else:
                starts = [i for i in range(len(text)) if not text[i].isspace() and (i == 0 or text[i - 1].isspace())]
                want = next(((i, j) for i in starts for j in range(len(text), i, -1) if plain(text[i:j]) == plain(span)), None)
        assert extraction.locate(span, text) == want, (span, text)


def test_words_are_found_as_words(spark, tmp_path):
    cases = [("THE\t \nth", "The the th ouinnd", (4, 11)), ("THE\t \nth", "The the the", None), ("a th", "a the a th", (6, 10)), ("the th", "xthe th the th", (8, 14)), ("ß", "ßa ß", (3, 4)), ("A B", "a  b", (0, 4))]
    for span, text, want in cases:
        assert extraction.locate(span, text, whole=True) == want, (span, text)
    turns = [(1, 0, "user", "The the th ouinnd"), (1, 1, "user", "one two three"), (2, 0, "user", "the The the end")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in extraction.QUERIES["scl09_true_span"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, 4, 11), (1, 1, 4, 13), (2, 0, 0, 8)}


def test_updates_move_facts_to_the_earlier_key(spark):
    t = Tables(spark, SF)
    from stratamem.operators.timeline import facts_of

    facts = facts_of(t).cache()
    pairs = extraction.update_pairs(facts).collect()
    out = {r["id"]: r for r in extraction.apply_updates(facts, extraction.update_pairs(facts)).collect()}
    by = {r["id"]: r for r in facts.collect()}
    assert pairs and all(by[p["earlier"]]["user_id"] == by[p["later"]]["user_id"] and by[p["earlier"]]["predicate"] != by[p["later"]]["predicate"] for p in pairs)
    assert all(by[p["earlier"]]["occurred_at"] <= by[p["later"]]["occurred_at"] for p in pairs) and {p["later"] for p in pairs} <= set(out)
    # two facts, each alone on its key
    one = spark.createDataFrame([(1, "shop 5", "buys", "a", "2024-01-01"), (2, "visit 5", "goes", "b", "2024-01-02")], "id long, content string, predicate string, object string, day string")
    two = one.selectExpr("id", "1L user_id", "'user' subject", "predicate", "object", "'replaces' update_op", "cast(day as timestamp_ntz) occurred_at", "content", "cast(null as string) target")
    got = {r["id"]: (r["status"], r["by"]) for r in extraction.apply_updates(two, extraction.update_pairs(two)).collect()}
    assert got == {1: ("superseded", 2), 2: ("active", None)}
    assert {r["status"] for r in resolved(two).collect()} == {"active"}


def test_an_extractor_of_ones_own(spark):
    def counter():
        return lambda turns: iter([{"session_id": turns[0]["session_id"], "n": len(turns), "order": ",".join(str(t["turn_index"]) for t in turns)}])

    turns = spark.createDataFrame([(k % 3, 9 - k, "user", "x") for k in range(10)] + [(7, 0, None, None)], "session_id long, turn_index long, role string, content string").repartition(4)
    extract = hooks.session_extractor("counter", counter, "session_id long, n long, order string")
    got = {tuple(r) for r in hooks.facts_by(turns, extract, ["session_id"], ["turn_index"]).collect()}
    assert got == {(0, 4, "0,3,6,9"), (1, 3, "2,5,8"), (2, 3, "1,4,7"), (7, 1, "0")}


def test_fingerprint_does_not_depend_on_order(spark, tmp_path):
    for name in ("orders", "customer", "nation"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        for folder, changed in (("same", rows.repartition(5).sort(F.rand(3))), ("other", rows.withColumn(rows.columns[1], F.lit(None).cast(rows.dtypes[1][1])) if name == "nation" else rows)):
            changed.write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
    found = [{r["table"]: tuple(r) for r in measures.QUERIES["agg30_table_fingerprint"](spark, d).collect()} for d in (SF, f"{tmp_path}/same", f"{tmp_path}/other")]
    assert found[0] == found[1] and len(found[0]) == 3
    assert {k for k in found[0] if found[0][k] != found[2][k]} == {"nation"}
