"""Largest inner products by a forest of hash prefixes.

Vectors of like length (within a factor of 2) get one more component that makes their norms equal (the query's is 0), so
the largest inner product is the smallest angle. A tree keeps long hash strings (BITS signs of random projections) as a sorted
array. A query descends in every tree to the entries that share the longest prefix with it, found by one binary
search and a look at both neighbours; then all trees ascend together, a bit at a time, until the ranges of entries
that share that prefix hold enough distinct entries: WIDTH / n ** FALL of them, n being all vectors, or LEAST / n if that is
more, and never fewer than k besides the query's own. At the root a range is the whole array, so a small table is
searched in full. Every entry in the ranges is a candidate, with no cap. Products are taken in single precision first, and of
all that can be among the k largest by these, in double precision by a sum that does not depend on the other rows, so
that equal vectors get equal scores.

Lengths are searched from the longest down; a shorter one is left out only where its norms cannot reach the k-th best
product so far. Vectors are dealt to blocks of about BLOCK rows, each with a forest over its distinct vectors, and queries to
groups; every group meets every block, so candidates grow as queries x n ** (1 - FALL), and the best of the blocks are merged.
Copies of a vector share an entry, which lists the smallest ids first, so that a very common vector fills no range.
Vectors null, zero, of another length than most, or with null or non-finite components take no part, nor rows
without id. Ties go to the smaller id; a repeated (id, vector) query is answered once; no rows give no rows. Other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written

BLOCK = 8192
QUERIES_PER_GROUP = 4096
NEAREST = 20
MODULUS = 20
TREES = 64
BITS = 64
WIDTH, FALL = 2.6, 0.2
LEAST = 2048
SEED = 97
_ROWS = 256


def share(n: int, least: int = LEAST) -> float:
    """Of n vectors, the share that a query's candidates are at least."""
    return min(1.0, max(least / n, WIDTH / n**FALL)) if n else 1.0


def clean(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v double array) of rows that take part."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    v = v.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    n = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("v") == (n["n"] if n else 0))


def codes(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings of rows as numbers, the first sign being the highest bit."""
    return np.packbits(x @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of BITS-bit strings."""
    x = a ^ b
    n = np.full(x.shape, BITS)
    for step in (32, 16, 8, 4, 2, 1):
        high = x >= np.uint64(1 << step)
        n[high] -= step
        x = np.where(high, x >> np.uint64(step), x)
    return n - (x > 0)


class Forest:
    """Sorted arrays of hash strings over the rows of x, whose norms are alike."""

    def __init__(self, x: np.ndarray, planes: np.ndarray) -> None:
        norm = (x * x).sum(1)
        self.longest = float(np.sqrt(norm.max()))
        self.x, self.planes, self.small = x, planes, (x / self.longest).astype(np.float32)
        lifted = np.hstack([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]])
        each = [codes(lifted, p) for p in planes]
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in each]
        self.sorted = [c[o] for c, o in zip(each, self.order, strict=True)]

    def descend(self, q: np.ndarray) -> np.ndarray:
        """For queries (rows of q) and trees, the longest prefix that the query shares with an entry."""
        out = np.empty(q.shape, np.int64)
        for t, c in enumerate(self.sorted):
            i = np.searchsorted(c, q[:, t])
            out[:, t] = np.maximum(common_bits(c[np.maximum(i - 1, 0)], q[:, t]), common_bits(c[np.minimum(i, len(c) - 1)], q[:, t]))
        return out

    def ranges(self, q: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past last of the entries that share the query's first `depth` bits, by query and tree."""
        below = np.where(depth == 0, ~np.uint64(0), (np.uint64(1) << (BITS - np.maximum(depth, 1)).astype(np.uint64)) - np.uint64(1))
        lo, hi = np.empty(q.shape, np.int64), np.empty(q.shape, np.int64)
        for t, c in enumerate(self.sorted):
            lo[:, t] = np.searchsorted(c, q[:, t] & ~below)
            hi[:, t] = np.searchsorted(c, q[:, t] | below, "right")
        return lo, hi

    def entries(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Distinct entries of one query's ranges."""
        mark = np.zeros(len(self.x), bool)
        mark[np.concatenate([o[a:b] for o, a, b in zip(self.order, lo.tolist(), hi.tolist(), strict=True)])] = True
        return np.flatnonzero(mark)

    def candidates(self, q: np.ndarray, enough: int) -> list[np.ndarray]:
        """For each query, the entries of the deepest level, common to all trees, at which the ranges hold `enough` distinct ones. As
        a higher level holds all that a lower one does, the ascent halves the levels left instead of trying each."""
        root = np.arange(len(self.x))
        best = [root] * len(q)
        if enough >= len(self.x):
            return best
        high, low = np.zeros(len(q), np.int64), self.descend(q).max(1)
        while True:
            going = np.flatnonzero(high < low)
            if not len(going):
                return best
            depth = (high[going] + low[going] + 1) // 2
            lo, hi = self.ranges(q[going], depth)
            for i, d, a, b, n in zip(going.tolist(), depth.tolist(), lo, hi, (hi - lo).sum(1).tolist(), strict=True):
                found = self.entries(a, b) if n >= enough else root[:0]
                if len(found) >= enough:
                    high[i], best[i] = d, found
                else:
                    low[i] = d - 1


class Forests:
    """A forest for each range of norms, the longest vectors first."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = SEED) -> None:
        self.planes = np.random.default_rng(seed).standard_normal((trees, x.shape[1] + 1, BITS))
        # not cut at 1, so that unit vectors are one range
        size = np.floor(np.log2(np.sqrt((x * x).sum(1))) + 0.5)
        self.parts = [np.flatnonzero(size == s) for s in np.unique(size)[::-1]]
        self.forests = [Forest(x[i], self.planes) for i in self.parts]

    def nearest(self, q: np.ndarray, k: int, spread: float):
        """For each query, rows of x among the candidates with the k largest products, ties at the last included."""
        for first in range(0, len(q), _ROWS):
            yield from self._nearest(q[first : first + _ROWS], k, spread)

    def _nearest(self, q: np.ndarray, k: int, spread: float) -> list[tuple[np.ndarray, np.ndarray]]:
        lifted = np.hstack([q, np.zeros((len(q), 1))])
        hashed = np.stack([codes(lifted, p) for p in self.planes], 1)
        length = np.sqrt((q * q).sum(1))
        small = (q / length[:, None]).astype(np.float32)
        out = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        for rows, f in zip(self.parts, self.forests, strict=True):
            open_ = [i for i, (at, score) in enumerate(out) if len(at) < k or score.min() <= f.longest * length[i] * (1 + 1e-9)]
            if not open_:
                return out
            for i, c in zip(open_, f.candidates(hashed[open_], max(k, int(np.ceil(spread * len(rows))))), strict=True):
                if len(c) > 4 * k:
                    # far above the rounding of a product in single precision
                    rough, slack = f.small[c] @ small[i], 1e-6 * q.shape[1]
                    c = c[rough >= np.partition(rough, len(c) - k)[len(c) - k] - slack]
                at, score = np.concatenate([out[i][0], rows[c]]), np.concatenate([out[i][1], (f.x[c] * q[i]).sum(1)])
                if len(at) > k:
                    keep = score >= np.partition(score, len(at) - k)[len(at) - k]
                    at, score = at[keep], score[keep]
                out[i] = at, score
        return out


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy().reshape(len(col), -1)


def _search(k: int, spread: float):
    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if block.num_rows and queries.num_rows:
            x, ids = _matrix(block.column("v")), block.column("id").to_numpy()
            q, qid, qkey = _matrix(queries.column("v")), queries.column("id").to_numpy(), queries.column("qkey").to_numpy()
            uniq, inv = np.unique(x, axis=0, return_inverse=True)
            inv = inv.ravel()
            order = np.lexsort((ids, inv))
            start = np.searchsorted(inv[order], np.arange(len(uniq) + 1))
            for i, (at, score) in enumerate(Forests(uniq).nearest(q, k + 1, spread)):
                got = []
                for a, s in zip(at, score, strict=True):
                    held = ids[order[start[a] : start[a + 1]]]
                    own = np.searchsorted(held, qid[i], "right") - np.searchsorted(held, qid[i], "left")
                    # of an entry's ids in order, k and the query's own are all that can be among the k nearest
                    got += [(-float(s), int(v)) for v in held[: k + own] if v != qid[i]]
                for s, v in sorted(got)[:k]:
                    for col, value in zip(out, (qid[i], qkey[i], v, -s), strict=True):
                        col.append(value)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "qkey", "vec_id", "score"), out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return run


def search(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEAREST, modulus: int = MODULUS, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row whose id is divisible by modulus."""
    v = written(clean(vectors, vec_id, embedding), "vectors")
    q = v.where(F.col("id") % modulus == 0).withColumn("qkey", F.xxhash64("id", "v")).dropDuplicates(["id", "qkey"])
    n = v.count()
    blocks = max(1, -(-n // BLOCK))
    groups = max(1, -(-q.count() // QUERIES_PER_GROUP))
    x = v.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("xb"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("qb"))
    qs = q.select("id", "v", "qkey", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(groups)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("xb"))
    found = x.groupBy("xb", "qb").cogroup(qs.groupBy("xb", "qb")).applyInArrow(_search(k, share(n, least)), "query_id long, qkey long, vec_id long, score double")
    w = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))


QUERIES = {"op6_neighbours": op6_neighbours}
ORACLE_SQL: dict[str, str] = {}
