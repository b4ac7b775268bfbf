import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from radspark.llm import codes, whitening
from radspark.llm.common import read

SF = "/root/testdata/sf0.001"


def frame(spark, x, ids=None, labels=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if c is None else float(c) for c in v], None if labels is None else labels[i]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def lloyd(x, ids, parts=4, entries=256, rounds=4):
    """Full searches in Python integers, for (id, vector) rows."""
    order = sorted(range(len(x)), key=lambda i: (ids[i] is None, ids[i] or 0, x[i]))[:entries]
    x = [[math.floor(1024 * c) for c in v] for v in x]
    cut = lambda v: [p.tolist() for p in np.array_split(np.array(v, object), parts)]
    xs = [cut(v) for v in x]
    books = [[xs[i][p] for i in order] for p in range(parts)]
    d2 = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    for r in range(rounds + 1):
        at = [[min(range(len(order)), key=lambda e: (d2(v[p], books[p][e]), e)) for p in range(parts)] for v in xs]
        if r == rounds:
            return books, {(ids[i], "".join(f"{e:02x}" for e in a), min(sum(d2(xs[i][p], books[p][e]) for p, e in enumerate(a)), (1 << 63) - 1)) for i, a in enumerate(at)}
        for p in range(parts):
            for e in range(len(order)):
                own = [v[p] for v, a in zip(xs, at, strict=True) if a[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]


@pytest.mark.parametrize("case", ["blobs", "ties", "few", "uneven", "huge"])
def test_codes_are_those_of_full_searches(spark, case):
    rng = np.random.default_rng(5)
    x = {
        "blobs": rng.standard_normal((6, 8))[rng.integers(0, 6, 90)] + rng.standard_normal((90, 8)) * 0.2,
        "ties": rng.integers(0, 3, (80, 8)) / 1024,  # many equal distances and repeated vectors
        "few": rng.standard_normal((3, 8)),
        "uneven": rng.standard_normal((40, 7)),
        "huge": rng.standard_normal((30, 8)) * 10.0 ** rng.integers(0, 8, (30, 1)),
    }[case].tolist()
    ids = [None if i % 17 == 5 else int(i // 2) for i in rng.permutation(len(x))]
    state, books = codes.fit(frame(spark, x, ids), entries=12)
    want_books, want = lloyd(x, ids, entries=12)
    assert [b.tolist() for b in books] == want_books
    got = codes.codes(state, books).collect()
    assert {(r["vec_id"], r["code"], r["error"]) for r in got} == want and len(got) == len(x)
    assert codes.digest(books) == hashlib.sha256(",".join(str(i) for b in want_books for e in b for i in e).encode()).hexdigest()
    if case == "blobs":
        r = got[0]
        assert np.abs(codes.decoded(r["code"], books) - np.floor(np.array(x) * 1024) / 1024).max(1).min() < 2


def test_bounds_hold_and_spare_searches(spark):
    """Bounds contain the true distances in every round, and most searches are spared on clustered data."""
    rng = np.random.default_rng(2)
    x = np.floor((rng.standard_normal((20, 6))[np.arange(600) % 20] + rng.standard_normal((600, 6)) * 0.03) * 1024).astype(np.int64)
    book, looked = x[:20].copy(), []
    at, upper, lower = np.zeros(600, np.int64), np.full(600, np.inf), np.full(600, -np.inf)
    old = book
    for _ in range(6):
        at, upper, lower, n = codes.assign(x, codes.Move(old, book), at, upper, lower)
        looked.append(n)
        d = codes.all_squares(x, book)
        assert (d.argmin(1) == at).all()
        true, other = np.sqrt(d[np.arange(600), at]), np.sqrt(np.partition(d, 1, axis=1)[:, 1])
        assert (upper >= true).all() and (lower <= other).all()
        old, book = book, np.array([x[at == e].sum(0) // max(1, (at == e).sum()) if (at == e).any() else book[e] for e in range(20)])
    assert looked[0] == 570 and looked[-1] < 300  # the first round spares the 30 rows that the first entry stands for


def test_codes_edges(spark):
    """Bad vectors take no part, no rows give none, a clashing column is not looked at."""
    good = [[0.5] * 8, [0.25] * 8, [0.5] * 8]
    df = frame(spark, [*good, None, [], [float("nan")] * 8, [float("inf")] + [0.0] * 7, [None] + [0.0] * 7, [1.0]], labels=[1, None, None] + [1] * 6).withColumn("x", F.lit("clash")).withColumn("part", F.lit(1))
    state, books = codes.fit(df)
    rows = codes.with_group_error(codes.codes(state, books)).collect()
    assert sorted((r["vec_id"], r["error"], r["label_error"]) for r in rows) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)] and [len(b) for b in books] == [3] * 4
    state, books = codes.fit(df.limit(0))
    assert books == [] and codes.with_group_error(codes.codes(state, books)).count() == 0
    with pytest.raises(ValueError):
        codes.fit(df, entries=300)


def test_group_errors_beyond_the_broadcast(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 11, i) for i in range(200)], "vec_id long, label int, error long")
    want = {}
    for i in range(200):
        want[None if i % 3 == 0 else i % 11] = want.get(None if i % 3 == 0 else i % 11, 0) + i
    for most in (2, 100):
        got = codes.with_group_error(rows, most).collect()
        assert len(got) == 200 and all(r["label_error"] == want[r["label"]] for r in got)


def brute(x, components):
    """Covariance and eigenvectors over distinct integer vectors, by another solver."""
    x = np.floor(np.array(x) * 64).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    s = u.sum(0)
    c = u - s / len(u)
    e, v = np.linalg.eigh(c.T @ c / len(u))
    e, v = e[::-1], v[:, ::-1]
    return x, len(u), s, e, (x - s / len(u)) @ v[:, :components] / np.sqrt(e[:components])


def test_whitening_against_another_solver(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 9)) * np.array([40, 20, 9, 5, 3, 2, 1, 0.5, 0.2])
    x[50:90] = x[50]  # repeated vectors count once in the fit
    rows, f = whitening.whiten(frame(spark, x.tolist()), components=9)
    xi, n, s, e, want = brute(x, 9)
    got = {r["vec_id"]: r for r in rows.collect()}
    assert len(got) == 400 and f.n == n == 361 and [int(i) for i in s] == f.sums
    assert np.abs(f.values / e - 1).max() < 1e-9 and f.identity_error < 1e-9
    for i in range(400):
        assert got[i]["deviation"] == int(((n * xi[i].astype(object) - s) ** 2).sum())
        assert np.abs(np.abs(got[i]["whitened"]) - np.abs(want[i])).max() < 1e-6


def test_jacobi_small_eigenvalues():
    """A graded matrix: eigenvalues over 16 orders of magnitude keep their relative accuracy."""
    d = 10.0 ** np.arange(0, -9, -1)
    a = (np.eye(9) + 0.3 * np.ones((9, 9))) * d[:, None] * d[None]
    e, v = whitening.jacobi(a)
    b, _ = whitening.jacobi((np.eye(9) + 0.3 * np.ones((9, 9)))[::-1, ::-1] * d[::-1][:, None] * d[::-1][None])
    assert np.abs(e / b - 1).max() < 1e-12 and (np.diff(e) < 0).all() and e[-1] > 1e-17
    assert np.abs(v.T @ v - np.eye(9)).max() < 1e-14
    pairs = [(i, j) for p, q in whitening.rounds_of(7) for i, j in zip(p.tolist(), q.tolist(), strict=True)]
    assert sorted(pairs) == [(i, j) for i in range(7) for j in range(i + 1, 7)]
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0] and whitening.jacobi(np.array([[2.0]]))[0].tolist() == [2]


def test_whitening_edges(spark):
    bad = [None, [], [float("nan"), 1.0, 2.0], [None, 1.0, 2.0], [1.0]]
    x = [[0.0, 1.0, 5.0], [1.0, 0.0, 5.0], [2.0, 2.0, 5.0], [2.0, 2.0, 5.0]]
    df = frame(spark, x + bad, ids=[7, 7, None, 3] + [1] * 5).withColumn("x", F.lit(1)).withColumn("whitened", F.lit(2))
    rows, f = whitening.whiten(df)
    got = rows.collect()
    assert f.n == 3 and len(got) == 4 and all(len(r["whitened"]) == 2 for r in got)  # the third dimension does not vary
    assert f.identity_error < 1e-12
    assert whitening.whiten(df.limit(0))[0].count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 5))[0].count() == 0  # one vector only
    big = [[1e300, 0.0], [-1e300, 1.0], [5.0, 2.0]]
    rows, f = whitening.whiten(frame(spark, big))
    assert max(r["deviation"] for r in rows.collect()) == (1 << 63) - 1 and f.n == 3


def test_query_columns(spark):
    out = whitening.op12_whitening(spark, SF)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.collect()
    assert len(rows) == 16 * read(spark, SF, "embeddings").count() and {r["component"] for r in rows} == set(range(1, 17)) and rows[0]["identity_error"] < 1e-4
