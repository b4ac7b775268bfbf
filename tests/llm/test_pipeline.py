import random

from tests.llm.test_dedup import brute_components
from tests.llm.test_search import brute as brute_leaks

import corpus_pipeline
from radspark.llm import langid, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BAD = ["vile", "scumlike", "rotten", "hateful"]


def corpus(seed=5, n=500):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfghjklm" for b in "aeiou" for c in "nrstvwxz"]
    say = lambda m: [rng.choice(vocabulary) for _ in range(m)]
    items = [(i, " ".join(say(25))) for i in range(8)]
    docs, labels = [], []
    for d in range(n):
        w = say(rng.randint(20, 150))
        toxic = d % 4 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randint(0, len(w)), rng.choice(BAD))
        if d % 11 == 3:
            w[5:5] = items[d % 8][1].split()
        docs.append((d, " ".join(w), "en", None if d % 13 == 0 else f"s{d % 5}", 0))
        labels.append((d, 1, int(toxic)))
    for d in range(20):  # near copies and copies
        w = docs[d * 3 + 1][1].split()
        w[len(w) // 2] = "changed"
        docs += [(n + d, " ".join(w) if d % 2 else docs[d * 3 + 1][1], "en", "s1", 0)]
    docs += [(None, None, None, None, None), (2000, "", "en", "s1", 0)]
    return docs, labels, items


def test_pipeline(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frames = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, frames[-1], str(tmp_path)).write.parquet(f"{tmp_path}/out{i}")
        frames.append(spark.read.parquet(f"{tmp_path}/out{i}"))
        if i < 4:
            assert frames[-1].columns == frames[0].columns
    got = [[tuple(r)[:5] for r in f.collect()] for f in frames]
    kept = [d for d in docs if not set((d[1] or "").split()) & set(BAD)]
    assert sorted(got[1], key=str) == sorted(kept, key=str)
    group = brute_components(got[1])
    kept = [d for d, (i, n, c) in zip(got[1], group, strict=True) if not n or i == c]
    assert sorted(got[2], key=str) == sorted(kept, key=str)
    kept = [d for d in kept if not brute_leaks(d[1], items)]
    assert sorted(got[3], key=str) == sorted(kept, key=str)
    assert set(got[4]) <= set(kept) and max(got[4].count(d) for d in kept) <= 3
    assert sorted(got[5], key=str) == sorted(got[4], key=str)
    last = frames[5].groupBy("shard").count().collect()
    assert max(r["count"] for r in last) - min(r["count"] for r in last) <= 1 or len(got[4]) < 16
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got[5])


def test_stages_take_empty_tables(spark, tmp_path):
    docs, labels, items = corpus(n=40)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 score", "2 `row`").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, none, str(tmp_path)).count() == 0


def test_learning(spark):
    from pyspark.sql import functions as F

    docs, labels, _ = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, y.where(~toxicity.held_out()))
    rows = toxicity.score(df, model).join(y, "doc_id").where(toxicity.held_out()).collect()
    assert all((r["score"] >= toxicity.THRESHOLD) == (r["toxic"] == 1) for r in rows)
    assert toxicity.score(df, None).agg(F.max("score")).first()[0] == 0
    rng = random.Random(2)
    alphabets = {"aa": "abcdeab", "bb": "mnopqmn", "cc": "éüößä"}
    texts = [(i, "".join(rng.choice(alphabets[k] + " ") for _ in range(200)), k) for i in range(40) for k in alphabets]
    df = spark.createDataFrame([*texts, (900, None, "aa"), (901, "12 !", None), (None, "", "aa")], "doc_id long, text string, lang string")
    model = langid.learn(df, "lang", "text", F.xxhash64("text"), per_class=20)
    got = langid.predict(df, model, keep=("doc_id", "lang", "text")).collect()
    for r in got:
        assert r["lang_pred"] == (r["lang"] if r["text"] and r["text"][0] != "1" else "und") and 0 <= r["score"] <= 1
    assert langid.predict(df.limit(0), None).count() == 0


def maximal(v):
    """Segments whose proper parts all sum to less, and that lie in no longer such segment."""
    n, total = len(v), [0]
    for x in v:
        total.append(total[-1] + x)
    own = lambda a, b: total[b] - total[a]
    ok = {(a, b) for a in range(n) for b in range(a + 1, n + 1) if own(a, b) > 0 and all(own(c, d) < own(a, b) for c in range(a, b) for d in range(c + 1, b + 1) if (c, d) != (a, b))}
    return sorted((a, b) for a, b in ok if not any((c, d) != (a, b) and c <= a and b <= d for c, d in ok))


def test_segments():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 14):
        for _ in range(60):
            x = np.where(rng.random(n) < 0.5, rng.integers(1, 6, n), 0).astype(float)
            found = toxicity.segments(x, 1.25)  # sums are exact, so ties are
            assert [(a, b) for a, b, _ in found] == maximal((x - 1.25).tolist())
            assert all(v == (x - 1.25)[a:b].sum() for a, b, v in found)
    falling = np.tile([3.0, 0, 0, 0], 200_000)  # candidates that never join: a walk back over all of them would not end
    assert len(toxicity.segments(falling, 1.25)) == 200_000


def test_extreme_values():
    """In random text the best segment beats ln of the length plus x with a chance of about 1 - exp(-exp(-x))."""
    import numpy as np

    rng = np.random.default_rng(2)
    kinds, weight = np.array([-1.0, 2.0]), np.array([0.8, 0.2])
    rate = toxicity.decay(kinds, weight)
    assert abs((weight * np.exp(rate * kinds)).sum() - 1) < 1e-9
    best = lambda n: np.array([max((v for *_, v in toxicity.segments(rng.choice(kinds, n, p=weight), 0.0)), default=0.0) for _ in range(1500)])
    a, b = rate * best(500), rate * best(2000)  # long enough for the ends to matter little
    assert abs((b.mean() - a.mean()) - np.log(4)) < 0.15
    x = a - a.mean() + np.euler_gamma
    assert abs((x > 1.5).mean() - (1 - np.exp(-np.exp(-1.5)))) < 0.04


def test_classes_first_rows(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).selectExpr("id doc_id", "cast(id % 10 = 0 as int) _y").repartition(7)
    got = toxicity.first_of_each(df, "_y", "doc_id", 700).collect()
    rows = df.withColumn("h", F.xxhash64("doc_id")).collect()
    for y in (0, 1):
        want = sorted((r["h"], r["doc_id"]) for r in rows if r["_y"] == y)[:700]
        assert sorted(r["doc_id"] for r in got if r["_y"] == y) == sorted(i for _, i in want)
    assert toxicity.first_of_each(df.limit(0), "_y", "doc_id", 5).count() == 0


def test_held_out_on_documents(spark):
    """Held-out accuracy and recall on the smaller tables; equal rows get equal predictions."""
    sf = "/root/testdata/sf0.01"
    rows = langid.op1_langid(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    y = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic")
    rows = toxicity.op7_toxicity(spark, sf).where("held_out").join(y, "doc_id").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert len(toxic) >= 10 and sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_shared_folder(spark, monkeypatch):
    import pytest

    from radspark.llm import common

    class Cluster:
        master = "spark://a:7077"
        getConf = lambda self: {}

    class Session:
        sparkContext, conf = Cluster(), {}

    with pytest.raises(ValueError):
        common.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://a/b/"}
    assert common.shared_dir(Session()) == "hdfs://a/b"
