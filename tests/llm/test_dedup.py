import hashlib
import random

from pyspark.sql import functions as F

from radspark.llm import jaccard, substrings, suffixes

DOCS = "doc_id long, text string, _key string, n long"


def corpus(rng, n):
    vocabulary = ["alpha", "beta", "Γάμμα", "delta", "x", "yy", "zzz", "\x0bq", "Ω"] + [f"w{i}" for i in range(300)]
    say = lambda m: [rng.choice(vocabulary) for _ in range(m)]
    passages = [say(m) for m in (34, 35, 36, 60, 120)]
    out = []
    for _ in range(n):
        w = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            w += p[: rng.randint(20, len(p))] if rng.random() < 0.4 else p
            w += say(rng.randint(0, 20))
        out.append(rng.choice([" ", "  ", "\n"]).join(w))
    out += [out[0], out[1], "", None, "ab" * 400, "-" * 199, "-" * 201, out[2] + " tail", "word " * 80]
    return [(i // 2 if i < 4 else i, t, None, 1) for i, t in enumerate(out)] + [(None, "null id", None, 1), (0, out[0], None, 1)]


def brute(items, size):
    seen = {}
    for s in items:
        for i in range(len(s) - size + 1):
            k = tuple(s[i : i + size]) if isinstance(s, list) else s[i : i + size]
            seen[k] = seen.get(k, 0) + 1
    marks = []
    for s in items:
        m = [False] * len(s)
        for i in range(len(s) - size + 1):
            if seen[tuple(s[i : i + size]) if isinstance(s, list) else s[i : i + size]] > 1:
                m[i : i + size] = [True] * size
        marks.append(m)
    return marks


def key(row):
    return tuple(str(x) for x in row)


def test_words(spark):
    rows = corpus(random.Random(1), 60)
    texts = [(t or "").encode().split() for _, t, _, _ in rows]
    want = []
    for (i, *_), w, m in zip(rows, texts, brute(texts, 35), strict=True):
        kept = b" ".join(x for x, g in zip(w, m, strict=True) if not g)
        want.append((i, len(w), sum(m), hashlib.sha256(kept).hexdigest()))
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = substrings.dedup(df, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert substrings.dedup(df.limit(0)).count() == 0
    assert substrings.dedup(df, keep=("doc_id", "n")).columns == ["doc_id", "n", "n_words", "n_removed", "kept"]


def test_bytes(spark):
    rows = corpus(random.Random(2), 60)
    texts = [(t or "").encode() for _, t, _, _ in rows]
    want = []
    for (i, *_), t, m in zip(rows, texts, brute(texts, 200), strict=True):
        kept = bytes(x for x, g in zip(t, m, strict=True) if not g)
        runs = sum(g and not (j and m[j - 1]) for j, g in enumerate(m))
        want.append((i, len(t), sum(m), runs, hashlib.sha256(kept).hexdigest()))
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = suffixes.dedup(df, digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert suffixes.dedup(df.limit(0)).count() == 0


def test_family_levels(monkeypatch):
    """Many small batches give what one batch gives."""
    import numpy as np

    rng = random.Random(3)
    base = [bytes(rng.choice(b"ab") for _ in range(suffixes.WIDTH)) for _ in range(4)]
    rows = []
    for _ in range(200):
        x = bytearray(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            x[rng.randrange(len(x))] = ord("c")
        rows.append(bytes(x))
    ctx = np.frombuffer(b"".join(sorted(set(rows), key=lambda r: hashlib.md5(r).digest())), np.uint8).reshape(-1, suffixes.WIDTH)
    la, ra = np.full(len(ctx), suffixes.LEFT, np.uint8), np.full(len(ctx), suffixes.LENGTH, np.uint8)
    one, many = suffixes.family(ctx, la, ra), suffixes.family(ctx, la, ra, batch=7)
    assert all((a == b).all() for a, b in zip(one, many, strict=True))


def test_levels_are_merged_not_sorted():
    """A merged level is the level of both, in both orders; sharing keeps what has its gram in the other."""
    import numpy as np

    rng = np.random.default_rng(5)
    make = lambda n: (rng.integers(97, 100, (n, suffixes.WIDTH)).astype(np.uint8), rng.integers(50, 100, n).astype(np.uint8), rng.integers(50, 100, n).astype(np.uint8), rng.integers(0, 10**6, n))
    for n, m in ((1, 1), (40, 3), (3, 40), (50, 50)):
        a, b = make(n), make(m)
        b[0][0] = a[0][0]
        x, y = suffixes.Level.sort(*a), suffixes.Level.sort(*b)
        got = x.merged(y)
        want = suffixes.Level.sort(*(np.concatenate(z) for z in zip(a, b, strict=True)))
        assert (got.ctx == want.ctx).all() and sorted(got.ids) == sorted(want.ids)
        assert (got.before() == want.before()).all() and sorted(got.back) == list(range(n + m))
        assert (got.ctx[got.back] == want.ctx[want.back]).all(axis=1).sum() >= n + m - 2  # equal ones may change places
        grams = {r[suffixes.LEFT : suffixes.LEFT + suffixes.GRAM].tobytes() for r in y.ctx}
        assert sorted(x.sharing(y).ids) == sorted(i for i, r in zip(x.ids, x.ctx, strict=True) if r[suffixes.LEFT : suffixes.LEFT + suffixes.GRAM].tobytes() in grams)


def test_sketch_merged_in_a_tree(spark):
    df = spark.range(400).selectExpr("repeat(concat('w', id % 150, ' '), cast(20 + id % 60 as int)) _text").repartition(9)
    found = lambda s: substrings._window_anchors(s, 35, 16)[3]
    one = substrings.sketch(df, found, 12)
    many = substrings.sketch(df, found, 12, expected=10**4, part_bytes=1000)
    assert one.twice.any() and one.hot.any() and (one.twice == many.twice).all() and (one.hot == many.hot).all()


def test_hot_passages_and_long_texts(spark):
    """Passages in over HOT documents, next to ever other words; a text much longer than a slice; a passage repeated in one text."""
    rng = random.Random(9)
    say = lambda m: [f"v{rng.randrange(5000)}" for _ in range(m)]
    hot = say(70)
    rows = [(i, " ".join(say(rng.randint(0, 40)) + hot[rng.randint(0, 3) : 66 + rng.randint(0, 4)] + say(rng.randint(0, 40))), None, 1) for i in range(150)]
    rows += [(900, " ".join(hot + say(3) + hot), None, 1), (901, " ".join(say(400_000) + hot), None, 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    texts = [t.encode().split() for _, t, _, _ in rows]
    want = [(i, len(w), sum(m)) for (i, *_), w, m in zip(rows, texts, brute(texts, 35), strict=True)]
    assert sorted(tuple(r) for r in substrings.dedup(df).select("doc_id", "n_words", "n_removed").collect()) == sorted(want)
    rows = rows[:-1]
    texts = [t.encode() for _, t, _, _ in rows]
    want = [(i, len(t), sum(m)) for (i, *_), t, m in zip(rows, texts, brute(texts, 200), strict=True)]
    got = suffixes.dedup(df.where("doc_id <> 901")).select("doc_id", "n_bytes", "n_removed").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_windows_over_many_flushes(spark, monkeypatch):
    """Windows settled in one flush and met again in others give the same spans."""
    import numpy as np
    import pyarrow as pa

    rows = [(i, t or "") for i, (_, t, _, _) in enumerate(corpus(random.Random(4), 40))]
    df = spark.createDataFrame([(t,) for _, t in rows], "_text string")
    sk = substrings.sketch(df, lambda s: substrings._window_anchors(s, 35, 16)[3], 14)
    shared = type("Shared", (), {"value": sk})
    batches = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([t])], names=["_key", "_text"]) for i, t in rows]
    results = []
    for flush in (1 << 20, 90, 1):
        monkeypatch.setattr(substrings, "FLUSH", flush)
        by = {}
        for out in substrings._windows(shared, 3, 35, 16)(iter(batches)):
            for b, data in zip(out.column("b").to_pylist(), out.column("data").to_pylist(), strict=True):
                by.setdefault(b, []).append(data)
        spans = [x for b, v in by.items() for x in substrings._exact(3)(pa.table({"b": pa.array([b] * len(v), pa.int32()), "data": pa.array(v, pa.binary())})).column("data").to_pylist()]
        marks = {i: np.zeros(len(t.split()), bool) for i, t in rows}
        for k, (p, m) in substrings.spans_by_key(pa.chunked_array([pa.array(spans, pa.binary())])).items():
            marks[k] |= substrings.covered(len(marks[k]), p, p + m - 1 + 35)
        results.append({k: v.tolist() for k, v in marks.items()})
    assert results[0] == results[1] == results[2]
    assert [results[0][i] for i, _ in rows] == brute([t.encode().split() for _, t in rows], 35)


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[i] and find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None) if sets[i] else r[0]))
    return out


def test_jaccard(spark):
    rng = random.Random(4)
    rows = []
    for c in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(1, 150))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["NEW", f"v{rng.randrange(99)}"])
            rows.append((len(rows) * 7 % 1000, " ".join(w), None, 1))
    rows += [(None, rows[0][1], None, 1), (1001, None, None, 1), (1002, " \t", None, 1), (1003, "A b", None, 1), (1004, "a B", None, 1), rows[3]]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = jaccard.join(df).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_components(rows)))
    assert jaccard.join(df.limit(0)).count() == 0


def test_jaccard_with_equal_keys(spark, monkeypatch):
    """Rows that share the first key by chance keep their own results, and no row comes out twice."""
    real = jaccard.row_key
    monkeypatch.setattr(jaccard, "row_key", lambda *c, second=False: real(*c, second=True) if second else F.pmod(real(*c), F.lit(3)))
    rows = [(i, " ".join(f"w{(i // 3) * 50 + k}" for k in range(20 + i % 2)), None, 1) for i in range(24)] + [(100, None, None, 1), (101, "", None, 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted(map(key, jaccard.join(df).collect())) == sorted(map(key, brute_components(rows)))
    assert jaccard.keep_one(df).count() == len({c for *_, c in map(key, brute_components(rows))})


def test_trie():
    import numpy as np

    rng = random.Random(6)
    for _ in range(50):
        base = sorted(rng.sample(range(10**6), 40))
        sets = [np.array(sorted(set(base) - set(rng.sample(base, rng.randint(0, 9))) | set(rng.sample(range(10**6), rng.randint(0, 6)))), np.uint64) for _ in range(30)]
        probe = np.array(base, np.uint64)
        want = [i for i, s in enumerate(sets) if 100 * len(set(base) & set(s.tolist())) >= 80 * len(set(base) | set(s.tolist()))]
        assert sorted(jaccard.Trie(sets).search(probe)) == want


def test_jaccard_pile(spark, monkeypatch):
    """A large group of near copies of which some link and some don't, by piles of several chunks."""
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "GROUP", 20)
    monkeypatch.setattr(jaccard, "PROBES", 1)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, 1))
    got = jaccard.join(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_components(rows)))
