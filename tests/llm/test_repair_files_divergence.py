"""Conversation repair, token files and source divergence against plain Python."""

import hashlib
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamem.llm import common, divergence, packing, repair, tokenfiles

SF = "/root/testdata/sf0.001"

# conversation repair


def cheapest(rows):
    """Cost and ASCII-least edits of rows (role, fault) by trying all."""
    follows = {("", "s"): "S", ("", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}

    @lru_cache(None)
    def best(i, q, put):
        out = [(0, "")] if i == len(rows) and q in ("", "A") else []
        turn = "A" if q == "U" else "U"
        add = lambda cost, letter, found: out.append((found[0] + cost, letter + found[1]))
        if put < 3:
            add(2, "I", best(i, turn, put + 1))
        if i < len(rows):
            role, fault = rows[i]
            add(3, "D", best(i + 1, q, 0))
            if fault not in (repair.BLANK, repair.DUPLICATE):
                extra = fault == repair.CUT_OFF
                if follows.get((q, role[:1])):
                    add(extra, "K", best(i + 1, follows[q, role[:1]], 0))
                add(2 + extra, "R", best(i + 1, turn, 0))
        return min(out) if out else (10**9, "")

    return best(0, "", 0)


def some_rows(rnd, most):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", ""]
    return [(rnd.choice(roles), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randrange(most + 1))]


def test_walk_is_the_ascii_least_cheapest():
    rnd = random.Random(1)
    for _ in range(1500):
        rows = some_rows(rnd, 10)
        codes = bytes(repair.row_code(*r) for r in rows)
        edits, _, cost = repair.walk(codes, repair.FINAL, repair.START, True)
        assert (cost, edits) == cheapest(tuple(rows))
        if len(rows) > 1:
            k = rnd.randrange(1, len(rows))
            behind = repair.through(repair.transfer(codes[k:]), repair.FINAL)
            a, state, x = repair.walk(codes[:k], behind, repair.START, False)
            b, _, y = repair.walk(codes[k:], repair.FINAL, state, True)
            assert (a + b, x + y) == (edits, cost)


def plain_repair(rows):
    """conv_id -> the result's columns, from rows (conv_id, turn, role, text)."""
    by_conv, out = defaultdict(list), {}
    for conv_id, turn, role, text in rows:
        by_conv[conv_id].append((turn, role or " " if role is None else role, " " if text is None else text))
    for conv_id, found in by_conv.items():
        check = lambda r: hashlib.md5(f"{' ' if conv_id is None else conv_id}:{len(r[1])}:{r[1]}{r[2]}".encode()).digest()  # noqa: B023, E731
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), check(r)))
        seen, faults = set(), []
        for _, role, text in found:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append(repair.BLANK if not bare else repair.DUPLICATE if (role, text) in seen else repair.CUT_OFF if bare[-1] not in ".!?" else repair.SOUND)
            seen.add((role, text))
        codes = bytes(repair.row_code(r[1], f) for r, f in zip(found, faults, strict=True))
        audit, _, cost = repair.walk(codes, repair.FINAL, repair.START, True) if len(found) > 14 else (lambda c: (c[1], 0, c[0]))(cheapest(tuple((r[1], f) for r, f in zip(found, faults, strict=True))))
        left, lines, expected = iter(found), [], "su"
        for e in audit:
            row = next(left) if e != "I" else (None, "", "")
            if e == "D":
                continue
            role = row[1] if e == "K" else ("user" if "u" in expected else "assistant")
            lines.append(f"{role}:{row[2]}")
            expected = "a" if role[0] == "u" else "u"
        turns = [r[0] for r in found if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def plain_damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv_id, turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def as_dict(df):
    found = df.collect()
    out = {r["conv_id"]: tuple(r[k] for k in COLUMNS) for r in found}
    assert len(out) == len(found)
    return out


def test_repair_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    want = dict.fromkeys({r[0] for r in rows}, NOTHING) | plain_repair(plain_damage(rows))
    assert as_dict(repair.op11_checkpointed_repair(spark, SF)) == want


def test_repair_of_odd_and_long_conversations(spark, monkeypatch, tmp_path):
    rnd = random.Random(2)
    text = lambda: rnd.choice(["Yes.", "No!", "cut", "", " \t", "Why?", "é.", "x" * 5000 + ".", None])
    role = lambda: rnd.choice(["user", "assistant", "system", "tool", "", None])
    rows = [(c, rnd.choice([None, 0, 1, 2, 5]), role(), text()) for c in (None, *range(40)) for _ in range(rnd.randrange(1, 9))]
    rows += [(100, k % 3000, rnd.choice(["user", "assistant"]), f"{k}." if k % 5 else "same.") for k in range(6000)]  # longer than a segment, turns twice
    rows += [(101, 7, "user", "again.")] * 700  # rows equal in all
    rows += [(102, k, "user" if k % 2 == 0 else "assistant", f"{k}!") for k in range(8200)]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).repartition(7).withColumn("fault", F.lit(9)).withColumn("who", F.lit("x")).withColumn("at", F.lit(None))
    df.write.parquet(str(tmp_path / "c"))
    segments = repair.repair(spark.read.parquet(str(tmp_path / "c"))).cache()
    assert segments.where("NOT whole AND conv_id = 100").count() > 1
    assert segments.agg(F.max("rows")).first()[0] <= repair.SEGMENT
    assert as_dict(repair.digest(segments)) == plain_repair(rows)
    kept = segments.where("conv_id = 102").orderBy("at").collect()
    assert [t for s in kept for t in s["texts"]] == [f"{k}!" for k in range(8200)]


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.digest(repair.repair(empty)).count() == 0
    hurt, gone = repair.damaged(empty)
    assert hurt.count() == 0 and gone.count() == 0
    # a conversation that the damage leaves nothing of
    k = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    hurt, gone = repair.damaged(spark.createDataFrame([(k, 0, "user", "Hi."), (k + 1, 0, None, None)], empty.schema))
    assert [r[0] for r in gone.collect()] == [k]


# token files


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 23, 31, 32])
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
        packed = tokenfiles.pack_ids(ids, bits)
        assert len(packed) == -(-n * bits // 8)
        assert (tokenfiles.unpack_ids(packed, n, bits) == ids).all()


@pytest.mark.parametrize("bits", [13, 16])
def test_shard_gives_any_span(bits, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", 64)
    rng = np.random.default_rng(0)
    docs = [(k if k % 5 else None, rng.integers(0, 1 << bits, int(n)).astype("<u4")) for k, n in enumerate(rng.integers(1, 300, 60))]
    writer = tokenfiles._Writer(bits)
    content = b"".join(r + b"\n" for d in docs for r in writer.add(*d)) + b"".join(r + b"\n" for r in writer.close())
    shard, everything = tokenfiles.Shard(content), np.concatenate([d[1] for d in docs])
    assert (shard.n_docs, shard.n_ids, shard.bits) == (60, len(everything), bits)
    for k, (_, ids) in enumerate(docs):
        assert (shard.document(k) == ids).all()
    for a, b in [(0, 0), (5, 6), (60, 70), (64, 128), (0, len(everything)), (len(everything) - 1, len(everything))]:
        assert (shard.ids(a, b) == everything[a:b]).all()
    rows = [r for batch in shard.batches(1000) for r in batch.to_pylist()]
    assert [r["doc_id"] for r in rows] == [d[0] for d in docs]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == [d[1].tolist() for d in docs]
    assert rows[0]["start"] == 1000 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.production_tokenizer())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in texts]


def test_token_files_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in common.documents(spark, SF).collect())
    start, want = 0, []
    for (doc_id, _), ids in zip(docs, encoded([d[1] for d in docs]), strict=True):
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = tokenfiles.op12_bit_packing(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_token_files_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SHARD_BYTES", 500)
    rows = [(None, "a"), (None, None), (3, ""), (3, "three words here"), (3, "three words here"), (-5, "x " * 3000), (2**60, "<|endoftext|> İ"), *[(9, "hot one")] * 400]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.lit("t")).withColumn("n", F.lit(1)).withColumn("ids", F.lit(2)).repartition(3)
    path = f"{common.shared_dir(spark)}/t-{uuid.uuid4().hex}"
    tokenfiles.write_ids(df, packing.production_tokenizer(), path)
    got = sorted(tokenfiles.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == sorted((str(d), ids.tobytes()) for (d, _), ids in zip(rows, encoded([r[1] for r in rows]), strict=True))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    manifest = spark.read.parquet(f"{path}/manifest")
    assert manifest.count() > 3 and manifest.where("bits <> 16").count() == 0
    everything = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got])
    for a, b in [(0, 1), (3, 3), (100, 4000), (0, len(everything)), (len(everything) - 2, len(everything))]:
        assert (tokenfiles.read_span(spark, path, a, b) == everything[a:b]).all()


def test_token_files_end_at_a_size(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE_BYTES", 3000, raising=False)
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(["one", "two", "three", "Four,", "5"], k=rnd.choice([0, 1, 30, 90]))) for _ in range(3000)]
    texts[700] = "long " * 20_000
    ids = encoded(texts)
    path = f"{common.shared_dir(spark)}/t-{uuid.uuid4().hex}"
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    tokenfiles.write_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), packing.production_tokenizer(), path)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids").select("path", "length").collect()
    sizes = sorted(r["length"] for r in files)
    # a file ends with the document that fills it
    assert sizes[-2] < 3000 + 17 + 2 * 200 + 200 and 2 * 20_000 < sizes[-1] < 3000 + 2 * 25_000
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert len(manifest) > 30 and {r["file"] for r in manifest} < {r["path"] for r in files}
    assert (sum(r["n_docs"] for r in manifest), sum(r["n_ids"] for r in manifest)) == (len(texts), sum(map(len, ids)))
    got = sorted(tokenfiles.read_ids(spark, path).collect(), key=lambda r: r["start"])
    starts = np.cumsum([0, *map(len, ids)])
    assert [(r["doc_id"], r["start"], bytes(r["ids"])) for r in got] == [(k, int(starts[k]), x.tobytes()) for k, x in enumerate(ids)]
    everything = np.concatenate(ids)
    for a, b in [(0, len(everything)), (1400, 1600), (int(starts[700]) - 2000, int(starts[701]) + 2000)]:
        assert (tokenfiles.read_span(spark, path, a, b) == everything[a:b]).all()


def test_ledger_looks_into_no_shard(spark, monkeypatch):
    path = f"{common.shared_dir(spark)}/t-{uuid.uuid4().hex}"
    docs = spark.createDataFrame([(k, "word " * 500) for k in range(400)], "doc_id long, text string")
    tokenfiles.write_ids(docs, packing.production_tokenizer(), path)
    want = spark.read.parquet(f"{path}/manifest").collect()
    monkeypatch.setattr(tokenfiles, "LEDGER_MOST", 4096)
    read = tokenfiles._files(spark, f"{path}/ids", tokenfiles.LEDGER_MOST).select("task").collect()
    assert len(read) == len({r["task"] for r in want}) and sorted(tokenfiles._ledgers(spark, path).collect()) == sorted(want)


def test_token_files_of_nothing(spark):
    path = f"{common.shared_dir(spark)}/t-{uuid.uuid4().hex}"
    tokenfiles.write_ids(spark.createDataFrame([], "doc_id long, text string"), packing.production_tokenizer(), path)
    assert tokenfiles.read_ids(spark, path).count() == 0


# source divergence


def plain_audit(docs, least, ranks):
    docs = [tuple("" if x is None else x for x in d) for d in docs]
    n, in_docs = Counter(), Counter()
    for lang, source, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
        for term, k in terms.items():
            n[lang, source, term] += k
            in_docs[lang, term] += 1
    out = []
    for lang in {d[0] for d in docs}:
        kept, sources = [t for (x, t), k in in_docs.items() if x == lang and k >= least], sorted({d[1] for d in docs if d[0] == lang}, key=str.encode)
        count = {s: [n[lang, s, t] for t in kept] for s in sources}
        count[None] = [sum(c) for c in zip(*count.values(), strict=True)]
        p = {s: [1 + 10**9 * (k + 5) // (sum(c) + 5 * len(kept)) for k in c] for s, c in count.items()}
        for s in sources:
            far = [(sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o) for o in sources if o != s]
            more = [(a - q, t) for a, q, t, k in zip(p[s], p[None], kept, count[s], strict=True) if k and a > q]
            for part, found, most in (("pair", far, None), ("term", more, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def test_divergence_of_odd_rows(spark):
    rnd = random.Random(3)
    words = ["The", "the", "THE", "éa", "Éa", "x-y", "a_b", "don't", "\x00nul\x00", "ß", "İ", "123", "𝔸b", "of", "rare"]
    text = lambda: rnd.choice([None, "", "1 2 3", " ".join(rnd.choices(words, k=rnd.randrange(1, 60)))])
    docs = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "S1", "é", None, ""]), text()) for _ in range(300)]
    docs += [("fr", "only", "un deux")] * 3 + [("it", f"s{k:03}", rnd.choice(["uno due", "due tre tre", "", "uno"])) for k in range(600)]  # more sources than a block
    docs += [("pt", "long", "ola " * 200_000), ("pt", "none", "")]
    df = spark.createDataFrame(docs, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("n", F.lit("n")).withColumn("s", F.lit(0)).repartition(5)
    got = sorted(tuple(r) for r in divergence.audit(df, least=3, ranks=4).collect())
    assert got == plain_audit(docs, 3, 4)


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert divergence.audit(empty).count() == 0
