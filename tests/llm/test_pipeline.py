"""The pipeline's stages keep what their operator says and hand on the columns of documents."""

import collections
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from stratamem.llm import common, neardup, quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.documents(spark, SF)
    before = docs.columns
    kinds = [name for name, _ in corpus_pipeline.STAGES]
    assert kinds == ["quality_rules", "near_duplicates", "secret_scan", "source_mix", "packing"]
    good = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    want = {r["doc_id"] for r in quality.cascade(docs, quality.default_rules(), keep=quality.RETURNED).where("kept").collect()}
    assert good.columns == before and {r["doc_id"] for r in good.collect()} == want
    good = common.written(good, "good")
    single = common.written(corpus_pipeline.STAGES[1][1](spark, good, SF), "single")
    classes = neardup.classes(good).collect()
    assert single.columns == before and {r["doc_id"] for r in single.collect()} == {r["class_id"] for r in classes}
    clean = common.written(corpus_pipeline.STAGES[2][1](spark, single, SF), "clean")
    assert clean.columns == before and clean.count() == single.count()
    assert not any(secrets.scan_text(r["text"] or "", secrets.RULES) for r in clean.collect())
    mixed = common.written(corpus_pipeline.STAGES[3][1](spark, clean, SF), "mixed")
    assert mixed.columns == before
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    assert packed.where("start = 0").count() == mixed.count()


def test_pipeline_against_brute_force(spark, tmp_path):
    from test_operators import brute_force_classes
    from tokenizers import Tokenizer

    from stratamem.llm import packing

    r = random.Random(31)
    vocabulary = ["river", "stone", "light", "over", "under", "house", "blue", "seven", "winter", "road", "paper", "garden", "morning", "table", "letter", "window"]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [prose(r.randrange(60, 200)) for _ in range(40)]
    texts += [texts[0], texts[1] + " again", prose(10), "", None, prose(90) + " password = 'abcdEFGH12345678' end", texts[2]]
    ids = [k if k % 6 else None for k in range(len(texts))]
    ids[20:23] = [7, 7, 7]  # ids that several texts share
    rows = [(i, t, "en", ("a", "b", None)[k % 3], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    good = [x for x in rows if len(words(x[1])) >= 50]
    of, _ = brute_force_classes([x[1] for x in good])
    classes = collections.defaultdict(list)
    for x, k in zip(good, of, strict=True):
        classes[k].append(x)
    # of a class the row with the least id, null last
    kept = [min(c, key=lambda x: (x[0] is None, x[0] or 0)) for c in classes.values()]
    clean = [(i, t.replace("password = 'abcdEFGH12345678'", "[SECRET]'").replace("[SECRET]''", "[SECRET]'"), s) for i, t, _, s, _ in kept]
    tokenizer = Tokenizer.from_file(packing.production_tokenizer())
    tokens = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    known = collections.Counter((i, tokens(t)) for i, t, _ in clean)
    size, by = collections.Counter(), {}
    for i, t, s in clean:
        size[s] += len(words(t))
        by[i, tokens(t)] = (s, len(words(t)))
    assert max(known.values()) == 1

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    took = collections.Counter((x["doc_id"], x["doc_tokens"]) for x in out if x["start"] == 0)
    assert set(took) <= set(known) and max(took.values()) <= 2
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s)), (3, 1, 2)))
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in full)) / sum(w for s, w in weights.items() if s not in full)
        more = {s for s in size if s not in full and weights[s] * level > 2 * size[s]}
        if not more:
            break
        full |= more
    got = collections.Counter()
    for key, times in took.items():
        got[by[key][0]] += by[key][1] * times
    for s in size:
        assert abs(got[s] - (2 * size[s] if s in full else weights[s] * level)) <= 3
    sequences = collections.defaultdict(list)
    for x in out:
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for x in sequences.values():
        x.sort()
        assert all(o == sum(n for _, n in x[:k]) for k, (o, _) in enumerate(x)) and sum(n for _, n in x) <= 4096
    assert sum(x["length"] for x in out) == sum(k[1] * n for k, n in took.items())


CLASHING = ("_words", "_text", "_tk", "_id", "_n", "_rk", "_times", "_copy", "_blob", "_f", "_m_n_words", "findings", "kept", "n_words", "tk", "least", "root", "copies", "blob", "src", "size", "part", "other.name", "class_id")


def test_stages_keep_columns_that_clash(spark):
    docs = common.documents(spark, SF)
    more = docs.select("*", *[F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")).alias(k) for k in CLASHING]).where("doc_id % 2 = 0 OR n_chars > 50")
    plain = more.select(*docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, more, SF), stage(spark, plain, SF)
        assert got.columns == more.columns, name
        rows = got.collect()
        assert sorted(str(tuple(r[c] for c in docs.columns)) for r in rows) == sorted(str(tuple(r)) for r in want.collect()), name
        assert rows and all(r[k] == f"{k}:{r['doc_id']}" for r in rows for k in CLASHING), name
    packed = corpus_pipeline.STAGES[-1][1](spark, more, SF)
    assert packed.where("start = 0").count() == more.count()


def test_stages_and_pipeline_on_nothing(spark, tmp_path):
    empty = common.documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
