"""Shared pieces: vectorised tokenising and hashing of text slices, written tables, row keys.

Texts arrive as Arrow batches and are cut into slices of about SLICE bytes; all work on a slice is
vectorised, so memory is bounded by the slice (or by one document, where a document is longer).
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 1 << 21
U = np.uint64
_R = U(0x9E3779B97F4A7C15 | 1)
_RINV = U(pow(int(_R), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own with a local master, whose
    executors are this machine; an error on a cluster, where such a folder is out of the others' reach."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="radspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there. Removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/radspark/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(schema).parquet(path)
    out.table_path = path
    return out


def free(spark: SparkSession, *tables: DataFrame) -> None:
    """Lets Spark delete the shuffle files of finished steps, which stay until the driver collects its garbage, and removes tables
    made by written() that nothing will read any more."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    for t in tables:
        p = jvm.org.apache.hadoop.fs.Path(t.table_path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(*cols: str, second: bool = False) -> Column:
    """A 64-bit key of a row's own values. Equal rows share a key, and so a result. A second key, joined on as well, tells rows apart that share the first by chance."""
    return F.xxhash64(*([F.lit(0x5EED)] if second else []), *[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")) for c in cols])


def n_bytes(docs: DataFrame, col: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(F.col(col))).alias("n")).first()["n"] or 0)


def extended(src: DataFrame, more: str, without: tuple = ("_text", "_key", "_b")) -> T.StructType:
    """src's schema without some columns, then the columns of a DDL string."""
    return T.StructType([f for f in src.schema if f.name not in without] + T.StructType.fromDDL(more).fields)


def bits(n: float, low: int, high: int) -> int:
    """The b with 2**b >= n, within low..high."""
    return int(min(high, max(low, np.ceil(np.log2(max(2.0, n))))))


# ---------------------------------------------------------------- slices of Arrow batches


class Slice:
    """Some rows of a batch: buf holds their texts as bytes one after another, at their offsets."""

    __slots__ = ("batch", "buf", "n", "off", "row0")

    def __init__(self, batch, row0: int, buf: np.ndarray, off: np.ndarray) -> None:
        self.batch, self.row0, self.buf, self.off, self.n = batch, row0, buf, off, len(off) - 1

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name)).slice(self.row0, self.n)

    def ints(self, name: str) -> np.ndarray:
        return self.column(name).to_numpy(zero_copy_only=False)


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        arr = arr.chunk(0) if isinstance(arr, pa.ChunkedArray) and arr.num_chunks else arr
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def slices(batches: Iterator[pa.RecordBatch], col: str = "text", size: int = SLICE) -> Iterator[Slice]:
    for b in batches:
        if not b.num_rows:
            continue
        buf, off = text_buffers(b.column(b.schema.get_field_index(col)))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            to = min(to, b.num_rows)
            yield Slice(b, at, buf[off[at] : off[to]], off[at : to + 1] - off[at])
            at = to


# ---------------------------------------------------------------- hashing


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes, in place."""
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64; kept in the worker while slices are of usual size."""
    if len(_powers.get("r", ())) < n:
        m = max(n, SLICE + 1024)
        for name, r in (("r", _R), ("i", _RINV)):
            p = np.full(m, r, U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    out = _powers["r"][:n], _powers["i"][:n]
    if n > 4 * SLICE:
        _powers.clear()
    return out


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """Running sums of x[i] * r**i: from them comes the hash of any stretch."""
    out = np.zeros(len(x) + 1, U)
    p = x.astype(U)
    p += U(1)
    p *= powers(len(x))[0]
    np.cumsum(p, out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = sums[ends] - sums[starts]
    h *= powers(len(sums))[1][starts]
    return mix(h)


def gram_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all stretches of length k, by start."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, U)
    h = sums[k:] - sums[:n]
    h *= powers(len(sums))[1][:n]
    return mix(h)


# ---------------------------------------------------------------- words

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and for each text the index of its first word (one more entry at the end)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = sep[buf]
    before = np.empty(len(buf), bool)
    before[0] = True
    before[1:] = gap[:-1]
    before[off[:-1][off[:-1] < len(buf)]] = True
    after = np.empty(len(buf), bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after[off[1:][off[1:] > 0] - 1] = True
    np.logical_not(gap, out=gap)
    starts, ends = np.flatnonzero(gap & before), np.flatnonzero(gap & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return stretch_hashes(prefix_sums(buf), starts, ends)


def inside(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """For starts 0..n-1, whether a stretch of k stays within its text; first: texts' first elements, and the end."""
    ok = np.ones(max(n, 0), bool)
    last = np.repeat(first[1:], np.diff(first))[: max(n, 0)]
    return ok & (np.arange(max(n, 0)) + k <= last)


def slide(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """The least (or by op) of each w consecutive elements."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Least hash of each w consecutive grams, and which grams are the least of some such w.

    Equal stretches have equal least hashes at equal offsets, so a stretch occurs at most as often as its anchor.
    """
    low = slide(h, w)
    if not len(low):
        return low, np.zeros(len(h), bool)
    padded = np.concatenate([np.zeros(w - 1, h.dtype), low, np.zeros(w - 1, h.dtype)])
    return low, slide(padded, w, np.maximum) == h


def runs(ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of consecutive pos with equal id, of input in order: ids, first positions, lengths."""
    if not len(pos):
        return ids, pos, pos
    cut = np.flatnonzero((np.diff(pos) != 1) | (ids[1:] != ids[:-1])) + 1
    a = np.concatenate([[0], cut])
    return ids[a], pos[a], np.diff(np.concatenate([a, [len(pos)]]))


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    if len(b):
        cut = np.flatnonzero(np.diff(b)) + 1
        for part in np.split(order, cut):
            yield int(bucket[part[0]]), part


def rows_out(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


WORD_RE = r"[^\x20\x09-\x0D]+"


def sql_words(col: str) -> str:
    """DuckDB: the words of a text as a list."""
    return f"regexp_extract_all(coalesce({col}, ''), '{WORD_RE}')"


NAME_RE = re.compile(r"[^A-Za-z0-9_]")
