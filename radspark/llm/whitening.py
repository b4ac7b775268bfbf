"""Whitening of vectors: a distributed centred scatter, its eigenvectors by cyclic Jacobi rotations.

A component c counts as the integer x = floor(64 * c) + 1000000. The fit list holds each distinct x vector once. One pass over it
counts it and sums every dimension, exactly; a second adds up the products of vectors less their mean, so that the large offset is gone before anything
is multiplied. The scatter comes to the driver as one row for each place of its upper triangle (its size is that of a dimension squared,
whatever the rows). There, sweeps of Jacobi rotations over all pairs of dimensions bring every off-diagonal
element below what its diagonal elements can tell apart, which leaves small eigenvalues with the relative accuracy of
the large ones; pairs that share no dimension are rotated at once. The eigenvectors, in order of falling eigenvalue and each divided by the root of
its own, are the whitening matrix, and broadcast (dimensions x components). A third pass measures on the fit list how far the covariance
of whitened vectors is from the identity.

Rows whose vector is null, empty, of another length than most, or holds null or non-finite components take no part; no rows give no rows. Repeated
vectors count once in the fit and are whitened each; ids may be null or repeat, and no other column is looked at, whatever
its name. Dimensions that do not vary, or repeat others, have eigenvalue 0 within rounding: such components cannot be scaled and are left out, so a fit list
of one vector gives no rows. Of equal eigenvalues any order is right. Scaled components beyond 2**40 count as 2**40, deviations beyond 2**63 - 1 as that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, written
from .vectors import finite, packed, parts_of, scaled, total, unpacked

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues below this share of the largest are rounding.
ZERO = 1e-13
_LONG = (1 << 63) - 1


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), packed(scaled(b.column("embedding"), SCALE) + OFFSET)], names=["vec_id", "x"])


def per_task(name: str, kind: pa.DataType, of: Callable[[np.ndarray], np.ndarray]):
    """One row a task: the sum over its batches of what `of` makes of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for b in parts_of(batch):
                new = of(unpacked(b.column("x")))
                held = new if held is None else held + new
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tolist()], pa.list_(kind))], names=[name])

    return run


@dataclass
class Fit:
    """What whitening needs: rows and sums of the fit list, eigenvalues and -vectors (columns) in falling order, the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def __post_init__(self) -> None:
        self.base = np.array([s // self.n for s in self.sums], np.int64)  # a whole number near the mean
        # of the mean, what is left after it, to double precision
        self.left = np.array([(s - self.n * int(b)) / self.n for s, b in zip(self.sums, self.base, strict=True)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.left

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - sum)**2, exactly; beyond a long its largest value."""
        y, rest = x - self.base, [s - self.n * int(b) for s, b in zip(self.sums, self.base, strict=True)]
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))
        if most * most * len(rest) <= _LONG:
            d = self.n * y - np.array(rest, np.int64)
            return (d * d).sum(1)
        d = y.astype(object) * self.n - np.array(rest, object)
        return np.array([min(int(s), _LONG) for s in (d * d).sum(1)], np.int64)

    def matrix(self, components: int) -> np.ndarray:
        """Dimensions x components: centred vectors times this are whitened."""
        k = min(components, int((self.values > ZERO * max(self.values[0], 0)).sum()))
        return self.vectors[:, :k] / np.sqrt(self.values[:k])


def rounds_of(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of 0..n-1 once, in rounds of pairs that share no member."""
    m = n + n % 2
    ring, out = list(range(m)), []
    for _ in range(m - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: m // 2], ring[: m // 2 - 1 : -1], strict=True) if max(a, b) < n]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(a: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and eigenvectors (columns, the largest entry positive) of a symmetric matrix."""
    a, v = a.copy(), np.eye(len(a))
    eps = np.finfo(float).eps
    for _ in range(most_sweeps if len(a) > 1 else 0):
        turned = False
        for p, q in rounds_of(len(a)):
            apq, app, aqq = a[p, q], a[p, p], a[q, q]
            go = np.abs(apq) > eps * np.sqrt(np.abs(app * aqq))
            if not go.any():
                continue
            turned = True
            p, q, apq = p[go], q[go], apq[go]
            with np.errstate(over="ignore"):
                theta = (aqq[go] - app[go]) / (2 * apq)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.sqrt(theta * theta + 1))
            c = 1 / np.sqrt(t * t + 1)
            s = t * c
            for m in (a, v):
                x, y = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
            x, y = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(len(v))])
    return np.diag(a)[order], v * np.where(sign == 0, 1, sign)


def _square(flat: list, d: int) -> np.ndarray:
    """A symmetric matrix of its upper triangle, row by row."""
    out = np.zeros((d, d))
    i = np.triu_indices(d)
    out[i] = flat
    out.T[i] = flat
    return out


def fit(x: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """x (x: packed integers, each distinct vector once, a table) -> Fit; None without rows."""
    counted = x.mapInArrow(per_task("s", pa.string(), lambda v: _Text(np.append(v.sum(0), len(v)).astype(object))), "s array<string>")
    sums = [int(s) for s in total(counted, "s", "decimal(38,0)")]
    if not sums:
        return None
    n = sums.pop()
    d = len(sums)
    f = Fit(n, sums, np.zeros(d), np.eye(d), 0.0)
    upper = np.triu_indices(d)

    def scatter(v: np.ndarray) -> np.ndarray:
        c = f.centred(v)
        return (c.T @ c)[upper]

    cov = _square(total(x.mapInArrow(per_task("s", pa.float64(), scatter), "s array<double>"), "s", "double"), d) / n
    values, vectors = jacobi(cov)
    f = Fit(n, sums, values, vectors, float(np.trace(cov)))
    w = f.matrix(components)
    k = w.shape[1]
    if k:
        some = np.triu_indices(k)

        def whitened(v: np.ndarray) -> np.ndarray:
            c = f.centred(v) @ w
            return (c.T @ c)[some]

        after = _square(total(x.mapInArrow(per_task("s", pa.float64(), whitened), "s array<double>"), "s", "double"), k) / n
        f.identity_error = float(np.abs(after - np.eye(k)).max())
    return f


class _Text:
    """Whole numbers that a long need not hold: they add as numbers and are listed as strings."""

    def __init__(self, v: np.ndarray) -> None:
        self.v = v

    def __add__(self, other: _Text) -> _Text:
        return _Text(self.v + other.v)

    def tolist(self) -> list[str]:
        return [str(int(i)) for i in self.v]


def _whiten(schema: pa.Schema, f: Fit, w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts_of(batch):
                x = unpacked(b.column("x"))
                out = f.centred(x) @ w
                offsets = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(f.deviation(x), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), pa.float64()))], schema=schema)

    return run


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Fit | None]:
    """(vec_id, deviation, whitened array<double>) of every row that takes part, and the fit."""
    from pyspark.sql.pandas.types import to_arrow_schema

    v = finite(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")), "embedding")
    kept = v.select("vec_id", F.lit(None).cast("binary").alias("x")).schema
    x = written(v.mapInArrow(_vectors, kept), "integers")
    f = fit(written(x.select("x").distinct(), "fitlist"), components)
    schema = v.select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("whitened")).schema
    w = f.matrix(components) if f else np.zeros((0, 0))
    if not w.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema), f
    return x.mapInArrow(_whiten(to_arrow_schema(schema), f, w), schema), f


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, f = whiten(read(spark, sf_dir, "embeddings"))
    share = [float(e / f.trace) for e in f.values[:COMPONENTS]] if f else []
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(s) for s in share]), F.col("at") + 1) if share else F.lit(None).cast("double")
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(f.n if f else 0).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(f.identity_error if f else 0.0).alias("identity_error"))


QUERIES = {"op12_whitening": op12_whitening}
#: Eigenvectors have no SQL form; tests compare with brute force.
ORACLE_SQL: dict[str, str] = {}
