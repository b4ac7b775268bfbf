import random

import numpy as np
from pyspark.sql import functions as F

from radspark.llm import decontam, neighbours


def test_recall_and_edges(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 32))
    x[500:900] = x[500]
    x[5] *= 9
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(4000, None), (4020, [0.0] * 32), (4040, [float("nan")] * 32), (4060, [1.0, None] * 16), (None, x[0].tolist()), (4080, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 20))
    hit = total = 0
    for q, found in got.items():
        s = x @ x[q]
        want = sorted((-s[i], i) for i in range(3000) if i != q)[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
        hit += len({round(-w[0], 9) for w in want} & {round(f[2], 9) for f in found})
        total += len({round(-w[0], 9) for w in want})
    assert hit / total >= 0.9
    assert neighbours.search(df.limit(0)).count() == 0
    assert len(neighbours.search(spark.createDataFrame(rows[:7], df.schema)).collect()) == 6


def test_exact_on_few_distinct_and_skewed(spark):
    """Unit vectors with few distinct ones, a table of less than 40, and few long vectors among many: all equal the brute force."""
    rng = np.random.default_rng(4)
    unit = lambda z: z / np.sqrt((z * z).sum(1))[:, None]
    few = unit(rng.standard_normal((35, 16)))
    few = few[np.concatenate([np.arange(35), np.full(1965, 34)])]
    skewed = unit(rng.standard_normal((2000, 16)))
    skewed[rng.choice(2000, 40, replace=False)] *= 50
    for x in (unit(rng.standard_normal((30, 16))), few, skewed):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for r in neighbours.search(df).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        for q in range(0, len(x), 20):
            score = (x * x[q]).sum(1)
            assert got[q] == sorted((i for i in range(len(x)) if i != q), key=lambda i: (-score[i], i))[:20]


def test_forest_levels():
    """The candidates are those of the deepest common level that holds enough; the descent finds the longest prefixes."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 8))
    x /= np.sqrt((x * x).sum(1))[:, None]
    f = neighbours.Forests(x, trees=6).forests[0]
    shared = lambda a, b: 64 - (int(a) ^ int(b)).bit_length()
    for i in range(0, 400, 37):
        v = np.append(-x[i] * 0.5 + x[0], 0)[None]
        q = np.array([neighbours.codes(v, p)[0] for p in f.planes])
        depth = np.array([[shared(a, b) for a in c] for c, b in zip([c[np.argsort(o)] for c, o in zip(f.sorted, f.order, strict=True)], q, strict=True)])
        assert f.descend(q[None])[0].tolist() == depth.max(1).tolist()
        for enough in (1, 20, 150, 399, 400, 500):
            level = next((d for d in range(64, 0, -1) if (depth.max(0) >= d).sum() >= enough), 0)
            assert f.candidates(q[None], enough)[0].tolist() == np.flatnonzero(depth.max(0) >= level).tolist()


def test_copies_in_two_blocks_and_recall(spark, monkeypatch):
    """Several blocks and groups: equal vectors rank by id wherever they lie; recall on `embeddings` with a share of it scored."""
    monkeypatch.setattr(neighbours, "BLOCK", 700)
    monkeypatch.setattr(neighbours, "QUERIES_PER_GROUP", 40)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2100, 24))
    x[100:160] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in neighbours.search(df, least=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert [i for i, _ in got[100]] == list(range(101, 121)) and len({s for _, s in got[100]}) == 1
    assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for f in got.values() for a, b in zip(f, f[1:], strict=False))
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hit = total = 0
    for r in neighbours.search(df, least=64).groupBy("query_id").agg(F.collect_set("vec_id").alias("found")).collect():
        s = (x * x[np.flatnonzero(ids == r["query_id"])[0]]).sum(1)
        want = set(sorted((i for i in ids if i != r["query_id"]), key=lambda i: (-s[np.searchsorted(ids, i)], i))[:20])
        hit, total = hit + len(want & set(r["found"])), total + 20
    assert total == 2000 and hit / total >= 0.9


def words_of(t):
    import re

    return [w.lower() for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t or "")]


def brute(text, items):
    from collections import Counter

    w, out = words_of(text), set()
    for i, t in items:
        v = words_of(t)
        k = min(5, len(v))
        grams = lambda z: Counter(tuple(z[j : j + k]) for j in range(len(z) - k + 1))
        if v and any(decontam.similarity(grams(w[p : p + len(v)]), grams(v)) >= 0.8 for p in range(len(w) - len(v) + 1)):
            out.add(i)
    return sorted(out)


def test_decontam(spark):
    rng = random.Random(3)
    say = lambda n: [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([1, 3, 5, 12, 30, 60])) if i > 9 else say(40))) for i in range(24)] + [(50, None), (51, " ! "), (52, "Straße und Größe, immer wieder neu gebaut!")]
    items = [x for x in items if x[1] is None or len(words_of(x[1])) != 1]
    docs = []
    for d in range(120):
        w = say(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            p = words_of(rng.choice(items)[1])
            for _ in range(rng.randint(0, 2)):
                if p:
                    p[rng.randrange(len(p))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = p
        docs.append((d, ", ".join(w).upper() if d % 3 else " ".join(w), "c"))
    docs += [(None, None, "c"), (900, "", "c"), docs[0], (901, "immer STRASSE Straße und Größe immer wieder neu gebaut", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, hits string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(d), str(brute(t, items))) for d, t, _ in docs)
    for part in (decontam.PART, 900):
        got = decontam.find(df, bench, part=part).collect()
        assert sorted((str(r["doc_id"]), str(sorted(h["item_id"] for h in r["hits"]))) for r in got) == want
    assert decontam.find(df.limit(0), bench).count() == 0
    assert all(not r["hits"] for r in decontam.find(df, bench.limit(0)).collect())


def test_multi_index():
    """All fingerprints within the radius are found, and few others are looked at."""
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 1 << 32, (3000, 4), dtype=np.uint32)
    prints[2990:] = prints[:10]
    index = decontam.Index(prints)
    share = []
    for i in range(60):
        f = prints[i].copy()
        for bit in rng.choice(128, int(rng.integers(0, 60)), replace=False):
            f[bit // 32] ^= np.uint32(1 << bit % 32)
        near = set(np.flatnonzero(np.bitwise_count(prints ^ f).sum(1) <= decontam.RADIUS).tolist())
        assert {item for _, item in index.near(f[None])} == near
        share.append(index.looked_at(f[None]).mean())
    assert np.mean(share) < 0.12


def test_sliding_fingerprints():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    g[40] = g[33]
    at = np.arange(0, 50, 3)
    got = decontam.fingerprints(g, at, 9)
    assert all((got[i] == decontam.fingerprint(g[a : a + 9])).all() for i, a in enumerate(at))
    assert decontam.repetitive(g, at, 9).tolist() == [len(set(g[a : a + 9].tolist())) < 9 for a in at]


def test_fingerprint_distance():
    """At similarity 0.8 fingerprints stay within the radius."""
    rng = np.random.default_rng(6)
    far = []
    for n in (9, 18, 45, 90):
        for _ in range(300):
            a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            b = a.copy()
            b[: n // 9] = rng.integers(0, 1 << 64, n // 9, dtype=np.uint64)
            far.append(int(np.bitwise_count(decontam.fingerprint(a) ^ decontam.fingerprint(b)).sum()))
    assert max(far) <= decontam.RADIUS and np.mean(far) < 20


def test_decontam_repetitive_and_without_id(spark):
    say = lambda a, b: " ".join([a, b] * 6 + [a])
    plain = " ".join(f"w{i}" for i in range(20))
    items = [(i, say(f"a{i}", f"b{i}")) for i in range(8)] + [(None, plain), (9, plain + " more")]
    docs = [(i, say(f"b{i}", f"a{i}")) for i in range(8)] + [(20, "so " + plain + " more"), (21, "so " + plain), (22, "clean")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontam.find(df, bench).collect()}
    assert got == {i: [i] for i in range(8)} | {20: [9, None], 21: [9, None], 22: []}
