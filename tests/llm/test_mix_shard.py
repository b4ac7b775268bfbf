import math

from pyspark.sql import functions as F

from radspark.llm import mixing, sharding

DOCS = "doc_id long, text string, source string, extra int"


def corpus(spark, n=3000):
    return spark.range(n).selectExpr("id doc_id", "repeat('w ', cast(1 + id * 7919 % 97 as int)) text", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end source", "1 extra")


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        left = total - cap * sum(sizes[s] for s in stopped)
        free = sum(w[s] for s in names if s not in stopped)
        t = {s: cap * sizes[s] if s in stopped else left * w[s] / free for s in names}
        over = {s for s in names if t[s] > cap * sizes[s]}
        if not over:
            return t
        stopped |= over


def test_mix(spark):
    df = corpus(spark)
    rows = mixing.mix(df).collect()
    assert len(rows) == 3000
    src = {r["doc_id"]: r["source"] for r in df.collect()}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = src[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    want = brute_targets(sizes)
    for s in sizes:
        assert math.isclose(want[s], target[s], rel_tol=1e-9)
        assert abs(taken[s] - target[s]) <= 97
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()))


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, None, None, 0), (1, None, None, 0), (2, "a b", "x", 0), (2, "a b", "x", 0), (None, "a", "x", 0), (5, "", "y", 0)], DOCS)
    rows = mixing.mix(df).collect()
    assert len(rows) == 6 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert len(mixing.mix(df, keep=("doc_id", "text", "source", "extra")).collect()) == 6
    assert mixing.mix(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "w " * 300_000, "x", 0), (2, "w", "x", 0), (3, "w w", "y", 0)], DOCS)
    rows = {r["doc_id"]: r for r in mixing.mix(long).collect()}
    assert rows[1]["size"] == 300_000 and rows[3]["target"] == 6 and abs(rows[1]["target"] - (300_003 - 6)) < 1e-6


def test_shards(spark):
    for n in (1, 15, 17, 3001):
        rows = sharding.shard(corpus(spark, n)).collect()
        by = {}
        for r in rows:
            by.setdefault(r["shard"], []).append(r["slot"])
        assert sum(map(len, by.values())) == n
        counts = [len(by.get(i, ())) for i in range(16)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shard_edges(spark):
    df = spark.createDataFrame([(None, None, "a", 1)] * 40 + [(1, "é", None, 1)], DOCS)
    rows = sharding.shard(df).collect()
    assert len(rows) == 41 and {r["size"] for r in rows} == {1, 3}
    assert sharding.shard(df.limit(0)).count() == 0


def test_shards_are_uniform_and_deep(spark, monkeypatch):
    """A deeper tree of blocks; checksums; every shard gets its share of the rows that come first, and a second seed deals them otherwise."""
    import zlib

    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 8)
    df = spark.range(6000).selectExpr("id doc_id", "concat('é', id) text", "'s' source", "1 extra")
    rows = sharding.shard(df).collect()
    assert all(r["text_crc32"] == zlib.crc32(f"é{r['doc_id']}".encode()) and r["size"] == 3 + len(str(r["doc_id"])) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
    assert {len(v) for v in by.values()} == {375} and all(sorted(s for s, _ in v) == list(range(375)) for v in by.values())
    # 375 * 1000 / 6000 = 62.5 of the first thousand in a shard, with a deviation of 7.4; also among a shard's first slots
    early = [sum(i < 1000 for _, i in v) for v in by.values()]
    assert 30 < min(early) and max(early) < 96 and sum((x - 62.5) ** 2 for x in early) / (16 * 62.5 * 0.78) < 2.6
    first = sum(i < 1000 for v in by.values() for s, i in v if s < 100)
    assert abs(first - 266.7) < 75
    other = {r["doc_id"]: r["shard"] for r in sharding.shard(df, seed=5).collect()}
    assert 200 < sum(other[r["doc_id"]] == r["shard"] for r in rows) < 560


def test_rounding_keeps_words_and_chances(spark):
    """Fractions are rounded to 0 or 1, a source's words change by less than one document, and a document comes up as often as its fraction says."""
    n = 4000
    df = spark.range(n).selectExpr("'s' source", "xxhash64(id) k", "cast(1 + id % 40 as double) s", "(id % 10) / 10D + 0.05D x", "id")
    up = mixing.rounded(df.select("source", "k", "s", "x"), n)
    rows = df.join(up, "k").collect()
    assert len(rows) == n and {r["up"] for r in rows} == {0, 1}
    assert abs(sum(r["s"] * (r["up"] - r["x"]) for r in rows)) <= 40
    for c in range(10):
        share = [r["up"] for r in rows if r["id"] % 10 == c]
        assert abs(sum(share) / len(share) - (c / 10 + 0.05)) < 0.09


def test_hypergeometric_mean_and_variance(spark):
    e = sharding._hypergeometric("1000L", "300L", "200L", sharding._u("id"))
    r = spark.range(20000).select(F.expr(e).alias("x")).agg(F.mean("x"), F.var_samp("x")).first()
    assert abs(r[0] - 60) < 0.3
    assert abs(r[1] - 200 * 0.3 * 0.7 * 800 / 999) < 1.2
