"""The timeline fold on cases with a known answer, and against a plain loop."""

import datetime as dt
import random

from stratamem.operators.timeline import resolved

SCHEMA = "id long, user_id long, subject string, predicate string, object string, update_op string, occurred_at timestamp_ntz, content string, target string"
T = dt.datetime(2023, 1, 1)


def rows(*facts):
    return [(i, 1, "user", "uses", o, op, T + dt.timedelta(days=d), "", target) for i, d, o, op, target in facts]


def run(spark, facts):
    return {r["id"]: (r["status"], r["until"] and (r["until"] - T).days, r["by"]) for r in resolved(spark.createDataFrame(facts, SCHEMA)).collect()}


def plain(facts):
    out = []
    for i, _, _, _, o, op, at, _, target in sorted(facts, key=lambda f: (f[6], f[0])):
        owners = [r for r in out if r["status"] != "folded"]
        last = owners[-1] if owners else None
        if last and last["status"] == "active" and last["until"] is None and last["o"] == o and last["op"] != "removes" and op != "removes":
            out.append(dict(id=i, o=o, op=op, until=None, by=last["id"], status="folded"))
            continue
        standing = [r for r in out if r["until"] is None and r["status"] == "active"]
        named = [r for r in standing if r["o"] == target]
        hit = named[0] if len(named) == 1 else standing[0] if target is None and len(standing) == 1 else None
        if op in ("replaces", "removes") and hit:
            hit.update(until=(at - T).days, by=i, status="superseded")
        out.append(dict(id=i, o=o, op=op, until=(at - T).days if op == "removes" else None, by=None, status="historical" if op == "removes" else "active"))
    ends = {r["id"]: r["until"] for r in out}
    return {r["id"]: ("superseded", ends[r["by"]], r["by"]) if r["status"] == "folded" else (r["status"], r["until"], r["by"]) for r in out}


def test_replacement_and_restatement(spark):
    got = run(spark, rows((1, 0, "TensorFlow", "coexists", None), (2, 59, "PyTorch", "replaces", None), (3, 212, "PyTorch", "replaces", None)))
    assert got == {1: ("superseded", 59, 2), 2: ("active", None, None), 3: ("superseded", None, 2)}


def test_ambiguous_target_closes_nothing(spark):
    got = run(spark, rows((1, 0, "a", "coexists", None), (2, 1, "b", "coexists", None), (3, 2, "c", "replaces", None)))
    assert all(status == "active" for status, _, _ in got.values())


def test_late_older_fact_does_not_win(spark):
    facts = rows((9, 5, "old", "replaces", None), (1, 10, "new", "replaces", None))
    assert run(spark, facts)[1] == ("active", None, None) and run(spark, facts)[9][0] == "superseded"


def test_lone_removal_is_historical(spark):
    assert run(spark, rows((1, 3, "a", "removes", None))) == {1: ("historical", 3, None)}


def test_against_a_plain_loop(spark):
    r = random.Random(5)
    facts = rows(*[(i, r.randrange(30), r.choice("abc"), r.choice(["replaces", "removes", "coexists"]), r.choice([None, None, "a"])) for i in range(60)])
    r.shuffle(facts)
    assert run(spark, facts) == plain(facts)


def test_empty(spark):
    assert resolved(spark.createDataFrame([], SCHEMA)).count() == 0
