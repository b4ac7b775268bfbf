"""Toxic passages by maximum-scoring segment search.

Each word, and each word beginning of PREFIXES bytes, has log-odds between toxic and clean documents under a Dirichlet
prior (half a document, and its share of both classes together). A position of the text takes the log-odds, among its
word's and beginnings', that their standard error supports best, or 0 where none is supported, and pays a drift, so
that scores of clean text fall. The support asked for grows with the toxic documents learned from, to Z_MOST, as more words then reach
any level by chance. A linear scan finds all maximal segments of positive sum; their
sums follow an extreme-value law in clean text, which gives each document the chance that clean text of its length
holds such a segment. A logistic fit over that and the sum of significant segments gives the score.

Fitting uses at most per_class labelled documents of each class (least row hash); scoring covers all words of all
rows. Null and empty texts have no words and get the score of a text without segments. Without labelled documents
of both classes every score is 0. Repeated rows get equal scores, and count once in fitting. A caller's columns `score`, `segments`
or `_text` are not to be kept under these names; rename them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LETTER, LOWER, U, by_bucket, extended, mix, prefix_sums, read, slices, stretch_hashes, words, written

BITS = 20
SEGMENT = 14  # log2 of the words whose counts travel together
DRIFT = 0.35
Z_MOST = 3.0
SIGNIFICANT = 3.0  # -ln p from which a segment counts


PREFIXES = (4, 5, 6)


def word_ids(buf: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed lower-cased runs of letters and, of longer ones, beginnings (else the run again); each text's first run."""
    starts, ends, first = words(buf, off, ~LETTER)
    sums = prefix_sums(LOWER[buf])
    out = [(stretch_hashes(sums, starts, ends) >> U(64 - BITS)).astype(np.int64)]
    for n in PREFIXES:
        h = stretch_hashes(sums, starts, np.minimum(starts + n, ends))
        h = mix(h + U(n))
        out.append(np.where(ends - starts > n, (h >> U(64 - BITS)).astype(np.int64), out[0]))
    return out, first


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((2, 1 << BITS), np.int64)
    for s in slices(batches, "_text"):
        ids, first = word_ids(s.buf, s.off)
        doc = np.repeat(np.arange(s.n), np.diff(first)) << BITS
        seen = np.unique(np.concatenate([doc | i for i in ids]))  # a document counts a word once
        y = s.ints("_y")[seen >> BITS]
        for k in (0, 1):
            n[k] += np.bincount(seen[y == k] & ((1 << BITS) - 1), minlength=1 << BITS)
    at = np.flatnonzero(n.any(0))
    rows = [(seg, at[i].astype(np.uint32).tobytes() + n[:, at[i]].astype(np.int32).tobytes()) for seg, i in by_bucket(at >> SEGMENT)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["seg", "data"])


def _added(t: pa.Table) -> pa.Table:
    seg = t.column("seg")[0].as_py()
    n = np.zeros((2, 1 << SEGMENT), np.int32)
    for x in t.column("data"):
        raw = x.as_buffer()
        size = raw.size // 12
        n[:, np.frombuffer(raw, np.uint32, size) - (seg << SEGMENT)] += np.frombuffer(raw, np.int32, 2 * size, 4 * size).reshape(2, size)
    return pa.table({"seg": t.column("seg").slice(0, 1), "data": pa.array([n.tobytes()], pa.binary())})


def log_odds(n: np.ndarray, toxic: int, strength: float = 500.0) -> tuple[np.ndarray, np.ndarray]:
    """Scores of words, and their support, from their counts in clean (row 0) and toxic (row 1) documents, of which there are `toxic`."""
    prior = n.sum(0) / max(1, n.sum()) * strength + 0.5
    total, a0 = n.sum(1), prior.sum()
    lo = [np.log(n[k] + prior) - np.log(total[k] + a0 - n[k] - prior) for k in (0, 1)]
    delta = lo[1] - lo[0]
    z = delta / np.sqrt(1 / (n[0] + prior) + 1 / (n[1] + prior))
    ok = np.abs(z) >= min(Z_MOST, np.sqrt(np.log(max(2.0, toxic))))
    return np.where(ok, delta, 0.0).astype(np.float32), np.where(ok, np.abs(z), 0.0).astype(np.float32)


def decay(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum weight * exp(root * score) = 1: the rate of the extreme-value law."""
    p = weight / weight.sum()
    lo, hi = 1e-6, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * scores, 600))).sum()) - 1
    if not (scores > 0).any():
        return 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def segments(score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past last, sum), of score[i] - drift, in one scan.

    Only words above the drift can begin or end one, so the scan visits these, and what lies between is a sum. Each
    candidate knows the nearest one before it that starts lower, so that a new one jumps from there to there and
    never passes the same candidates twice: the work is linear in the words.
    """
    value = score - drift
    up = np.flatnonzero(value > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(value)])
    first, past, before, after, lower = [], [], [], [], []
    for i, lo, hi in zip(up.tolist(), total[up].tolist(), total[up + 1].tolist(), strict=True):
        start, j = i, len(first) - 1
        while j >= 0 and before[j] >= lo:
            j = lower[j]
        while j >= 0 and after[j] < hi:  # joins candidate j and all after it
            start, lo, to = first[j], before[j], lower[j]
            for x in (first, past, before, after, lower):
                del x[j:]
            j = to
        for x, v in ((first, start), (past, i + 1), (before, lo), (after, hi), (lower, j)):
            x.append(v)
    return [(a, b, y - x) for a, b, x, y in zip(first, past, before, after, strict=True)]


def features(buf: np.ndarray, off: np.ndarray, model: dict) -> Iterator[tuple[float, float, list]]:
    """For each text: ln of the odds against chance of its best segment, sum of the significant ones, and these as (first word, past last, sum)."""
    ids, first = word_ids(buf, off)
    score, support = model["score"][ids[0]], model["z"][ids[0]]
    for i in ids[1:]:
        z = model["z"][i]
        score = np.where(z > support, model["score"][i], score)
        support = np.maximum(support, z)
    rate, k = model["rate"], model["k"]
    for a, b in zip(first[:-1], first[1:], strict=True):
        found = segments(score[a:b], DRIFT) if b > a else []
        base = np.log(max(1, b - a)) + k
        strong = [(x, y, v) for x, y, v in found if rate * v - base >= SIGNIFICANT]
        best = max((v for _, _, v in found), default=0.0)
        yield rate * best - base, sum(rate * v - base for _, _, v in strong), strong


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "_text"):
            f = [(a, b) for a, b, _ in features(s.buf, s.off, shared.value)]
            yield pa.RecordBatch.from_arrays([s.column("_y"), pa.array([a for a, _ in f], pa.float64()), pa.array([b for _, b in f], pa.float64())], names=["y", "best", "more"])

    return run


def chance(best: np.ndarray) -> np.ndarray:
    """-ln of the chance that clean text holds as good a segment."""
    expected = np.exp(-np.clip(best, -30, 700))
    return -np.log(np.maximum(-np.expm1(-expected), 1e-300))


def inputs(best: np.ndarray, more: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(best), np.log1p(chance(best)), np.log1p(np.maximum(more, 0))], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; both classes weigh alike in sum."""
    w = np.zeros(x.shape[1])
    c = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (c * (p - y)) + ridge * w
        h = (x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def first_of_each(rows: DataFrame, cls: str, key: str, n: int) -> DataFrame:
    """At most n rows of each class, those of least hash of their key, which no two rows share.

    The hashes' range is cut into 256 parts. Parts are counted; those below the n-th row stay whole, and only the part that
    holds it is sorted, so that no task takes a class.
    """
    rows = rows.withColumn("_h", F.xxhash64(key)).withColumn("_part", F.shiftright("_h", 56))
    count = rows.groupBy(cls, "_part").agg(F.count("*").alias("_n"))  # 256 rows a class at most
    upto = F.sum("_n").over(Window.partitionBy(cls).orderBy("_part"))
    room = count.select(cls, "_part", "_n", (F.lit(n) - upto + F.col("_n")).alias("_room")).where("_room > 0")
    rows = rows.join(F.broadcast(room), [cls, "_part"])
    cut = rows.where("_room < _n").withColumn("_k", F.row_number().over(Window.partitionBy(cls, "_part").orderBy("_h", key)))
    return rows.where("_room >= _n").select(cls, key).union(cut.where("_k <= _room").select(cls, key))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 8000) -> dict | None:
    """docs (doc_id, text), labels (doc_id, toxic); a document with several labels counts as its largest."""
    spark = docs.sparkSession
    y = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    y = first_of_each(y, "_y", "doc_id", per_class)
    # 2 * per_class rows of 12 bytes at most
    rows = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(y), "doc_id").select("_y", "_text").dropDuplicates(["_y", "_text"])
    rows = written(rows, "labelled")  # read four times below
    n = np.zeros((2, 1 << BITS))
    for r in rows.mapInArrow(_counts, "seg int, data binary").groupBy("seg").applyInArrow(_added, "seg int, data binary").collect():  # 64 rows of 128 KB
        n[:, r["seg"] << SEGMENT : (r["seg"] + 1) << SEGMENT] = np.frombuffer(r["data"], np.int32).reshape(2, -1)
    if not n.sum(1).all():
        return None
    score, z = log_odds(n, rows.where("_y = 1").count())
    model = {"score": score, "z": z, "rate": decay(score.astype(float) - DRIFT, n[0] + 1e-9), "k": 0.0}
    f = rows.mapInArrow(_features(spark.sparkContext.broadcast(model)), "y int, best double, more double").toPandas()
    clean = f["best"][f["y"] == 0]
    model["k"] = float(clean.mean() - np.euler_gamma) if len(clean) else 0.0  # the law's location, from clean texts
    f = rows.mapInArrow(_features(spark.sparkContext.broadcast(model)), "y int, best double, more double").toPandas()
    model["w"] = logistic(inputs(f["best"].to_numpy(), f["more"].to_numpy()), f["y"].to_numpy())
    return model


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for s in slices(batches, "_text"):
            names = [n for n in s.batch.schema.names if n != "_text"]
            if model is None:
                score, spans = np.zeros(s.n), [[]] * s.n
            else:
                f = list(features(s.buf, s.off, model))
                x = inputs(np.array([a for a, _, _ in f]), np.array([b for _, b, _ in f]))
                score = 1 / (1 + np.exp(-np.clip(x @ model["w"], -30, 30)))
                spans = [[{"first": a, "past": b, "sum": v} for a, b, v in c] for _, _, c in f]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64()), ("sum", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(s.column(n) for n in names), pa.array(score, pa.float64()), pa.array(spans, kind)], names=[*names, "score", "segments"])

    return run


def score(docs: DataFrame, model: dict | None, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, score, and the significant segments as word positions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col(text).alias("_text"))
    return src.mapInArrow(_scorer(shared), extended(src, "score double, segments array<struct<first:bigint,past:bigint,sum:double>>"))


THRESHOLD = 0.7


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 3 == 1, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict | None:
    return learn(docs, read(spark, sf_dir, "labels").where(~held_out()))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, fitted(spark, docs, sf_dir), keep=("doc_id", held_out().alias("held_out")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("segments").cast("long").alias("n_segments"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
