"""Operators and queries without SQL, and the ways that large inputs take, against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamem import registry
from stratamem.operators import hooks, measures, retrieval, timeline
from stratamem.plans.fixtures import Tables
from stratamem.sources import tables

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


def vectors(spark, n=120, dim=8):
    r = np.random.default_rng(3)
    v = r.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, 0 if i % 3 else i % 5, v[i].tolist()) for i in range(n)]  # most are of one tenant
    return v, rows, spark.createDataFrame(rows, "id long, tenant long, v array<double>")


def test_pairs_of_a_hot_tenant_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 10)
    v, rows, df = vectors(spark)
    got = {(r["a"], r["b"]) for r in retrieval.similar_pairs(df, 0.5).collect()}
    assert got == {(a, b) for a, s, _ in rows for b, t, _ in rows if a < b and s == t and round(float(v[a] @ v[b]), 6) >= 0.5} and got


@pytest.mark.parametrize("sent", [4096, 4])
def test_nearest_whatever_the_number_of_queries(spark, monkeypatch, sent):
    monkeypatch.setattr(retrieval, "SENT_QUERIES", sent)
    v, _, df = vectors(spark)
    asked = df.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.nearest(asked, df, 5).collect()}
    for q in range(0, 120, 7):
        want = sorted(range(120), key=lambda i: (-round(float(v[q] @ v[i]), 6), i))[:5]
        assert [got[q, k + 1] for k in range(5)] == want


def test_bm25_is_the_same_with_few_and_with_many_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "b c d"), (3, ""), (4, None), (5, "x y")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a d zz"), (2, "c")], "query_id long, text string")
    few = sorted(map(tuple, retrieval.bm25(docs, asked).collect()))
    monkeypatch.setattr(retrieval, "SENT_TERMS", 0)
    assert few == sorted(map(tuple, retrieval.bm25(docs, asked).collect())) and len(few) == 4


def test_containing_finds_texts_at_any_place(spark, tmp_path):
    needles = ["one two three four five", "b c", "x", "two  three\nfour", "aa bb cc"]
    docs = ["zero one two three four fives", "ab cd", "no", "two  three\nfour", "xaa bb ccx", "", None, "one two three four", "aa bb c c"]
    spark.createDataFrame(list(enumerate(needles)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["query_id"], r["doc_id"]) for r in retrieval.containing(Tables(spark, str(tmp_path))).collect()}
    assert got == {(i, k) for i, n in enumerate(needles) for k, d in enumerate(docs) if d and n in d}


def test_stored_table_keeps_versions(spark):
    table = timeline.Stored(spark, "t")
    one = table.write(spark.range(3))
    table.write(table.read().where("id > 0"))
    assert table.read().count() == 2
    table.restore(one)
    assert table.read().count() == 3 and table.read(1).count() == 2 and table.version == 2


def test_erasures_with_torn_lines(spark, tmp_path):
    lines = ['{"user_id": 1, "erased_at": "2024-03-01 00:00:00"}', '{"user_id": 2, "erased_at": "2020-01-01 00:00:00"}', '{"user_id": 3, "erased_at": "when?"}', "{torn"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{tmp_path}/j")
    got = {r["user_id"]: (r["still"], r["line"]) for r in tables.erasures(spark, f"{tmp_path}/j", "2024-01-01").cache().collect()}
    assert got[1] == (True, None) and got[2] == (False, None) and got[3] == (True, None) and got[None][1] == "{torn"


def test_judges_of_ones_own(spark):
    df = spark.createDataFrame([("a", "b"), (None, "c"), ("x", "x")], "e string, l string")
    said = hooks.judge(lambda: lambda e, l: ["It is a REPLACE, I think" if a != b else None for a, b in zip(e, l)], ("replace", "keep"), "uncertain")
    assert [r[0] for r in df.select(said("e", "l")).collect()] == ["replace", "replace", "uncertain"]
    score = hooks.scorer(lambda: lambda q, d: [len(a) + len(b) for a, b in zip(q, d)])
    assert [r[0] for r in df.select(score("e", "l")).collect()] == [2.0, 1.0, 2.0]


def test_encoder_query(spark):
    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for r in run(spark, "udf01_encoder"):
        v = hooks.hashing_encoder()([texts[r["item_id"]]])[0].astype(float)
        assert np.allclose(np.array(eval(r["vector"])), v / np.linalg.norm(v), atol=2e-5)


def test_split_of_oversized_texts(spark):
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    found = {}
    for r in run(spark, "pack08_split_oversized"):
        found.setdefault((r["session_id"], r["turn_index"]), []).append((r["start"], r["end"], r["digest"]))
    assert set(found) == {k for k, t in texts.items() if t}
    for key, spans in found.items():
        spans.sort()
        assert [s for s, _, _ in spans] == [0, *[e for _, e, _ in spans[:-1]]] and spans[-1][1] == len(texts[key])
        assert all(e - s <= 400 and hashlib.sha256(texts[key][s:e].encode()).hexdigest() == d for s, e, d in spans)


def test_two_lane_fill(spark):
    turns = sorted((r["conv_id"] % 8, r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect())
    want = set()
    for user in range(8):
        own = [(s * 100 + i, max(1, int(len(x) / 4.6)), role == "user") for u, s, i, role, x in turns if u == user]
        used, taken = 0, []
        for lane, most in ((0, 900), (1, 1200), (2, 1200)):
            for id_, cost, mine in own:
                if mine == (lane != 1) and id_ not in taken and used + cost <= most:
                    taken.append(id_)
                    used += cost
        want |= {(user, x) for x in taken}
    assert {(r["user_id"], r["id"]) for r in run(spark, "pack02_two_lanes")} == want


def test_density_pack_keeps_its_budget(spark):
    facts = {r["event_id"]: 20 + r["event_id"] % 50 for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    used = {}
    for r in run(spark, "pack04_density_pack"):
        used[r["user_id"]] = used.get(r["user_id"], 0) + facts[r["id"]]
    assert used and max(used.values()) <= 300


def test_density_pack_takes_the_densest_that_fits(spark):
    from stratamem.operators.checks import density_pack

    r = random.Random(2)
    items = [(1, k, r.random(), r.randrange(5, 40), [r.choice("abcdefgh") for _ in range(4)]) for k in range(25)]
    got = [x["id"] for x in sorted(density_pack(spark.createDataFrame(items, "u long, id long, value double, cost long, words array<string>"), ["u"], 100).collect(), key=lambda x: x["place"])]
    left, used, want = {i[1]: i for i in items}, 0, []
    while True:
        def worth(i):
            like = max((len(set(i[4]) & set(items[c][4])) / len(set(i[4])) for c in want), default=0)
            return i[2] * (0.3 if like >= 0.6 else 1.0) / i[3]
        fits = [i for i in left.values() if used + i[3] <= 100]
        if not fits:
            break
        best = max(fits, key=worth)
        want.append(best[1])
        used += best[3]
        del left[best[1]]
    assert len(got) == len(want) and got[:3] == want[:3]


def test_bootstrap_interval_holds_the_mean(spark):
    once, again = run(spark, "eval07_bootstrap"), run(spark, "eval07_bootstrap")
    assert sorted(map(str, once)) == sorted(map(str, again))
    for r in once:
        numbers = [x for x in r if isinstance(x, float)]
        assert len(numbers) == 2 and min(numbers) <= max(numbers) and 0 <= min(numbers) and max(numbers) <= 1


def test_folds_hold_whole_groups(spark):
    rows = run(spark, "eval11_grouped_folds")
    assert sorted(r["fold"] for r in rows) == list(range(5)) and all(r["rmse"] > 0 and r["rmse_mean"] > 0 for r in rows)


def test_orphans_whose_numbers_are_in_use_again(spark, tmp_path):
    ids = [1, 10, 51, 60, 100_001, 100_010, 100_051]
    spark.createDataFrame([(k, [1.0], 0) for k in ids], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["id"], r["state"]) for r in measures.QUERIES["set07_index_reconciliation"](spark, str(tmp_path)).collect())
    want = [(k, "missing") for k in ids if k % 10 == 0] + [(k + 100_000, "orphaned") for k in ids if k % 50 == 1]
    assert got == sorted(want)
