"""Vector columns as arrays: rows that take part, and sums over many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components beyond this count as it, so that they and their sums over a batch are exact as 64-bit integers.
LIMIT = 1 << 40


def finite(vectors: DataFrame, embedding: str) -> DataFrame:
    """Rows whose vector is not null nor empty, has no null or non-finite component, and is as long as most such vectors (of
    equally common lengths the longest)."""
    v = vectors.where(F.size(embedding) > 0)
    v = v.where(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    n = v.groupBy(F.size(embedding).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size(embedding) == (n["n"] if n else 0))


def scaled(col: pa.Array, factor: int) -> np.ndarray:
    """floor(factor * x) of a column of vectors, a row each; factor is a power of two, so that the product is exact."""
    x = matrix(col).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * factor), -LIMIT, LIMIT).astype(np.int64)


def matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def packed(x: np.ndarray) -> pa.Array:
    """Rows as bytes, for tables between steps."""
    raw = np.ascontiguousarray(x)
    width = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def unpacked(col: pa.Array, kind: type = np.int64) -> np.ndarray:
    """Inverse of packed()."""
    if not len(col):
        return np.zeros((0, 0), kind)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(col), -1)


def parts_of(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def total(partials: DataFrame, column: str, kind: str) -> list:
    """The sum of each place of an array column; as many rows reach the driver as the array has places. Longs are added as
    decimals, so that nothing overflows."""
    each = partials.select(F.posexplode(column).alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast(kind)).alias("value"))
    return [r["value"] for r in sorted(each.collect(), key=lambda r: r["at"])]


def clamped(total_: Column) -> Column:
    """A decimal as a long; values beyond a long's count as its largest."""
    return F.least(total_, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
