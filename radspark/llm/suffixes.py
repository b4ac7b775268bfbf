"""Exact removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

A string of LENGTH bytes is repeated if it starts at two places. Every such string has an anchor, the GRAM-byte gram of
least hash in it, at the same place in each occurrence; so suffixes that start at anchors suffice, each with the
bytes before it. A merged sketch of anchor counts (never too low) drops suffixes whose anchor occurs once.

The rest go by anchor to buckets. A bucket takes its suffixes in batches. Each batch gets a suffix array, its
contexts sorted by the bytes from the anchor on, and likewise the array of the bytes before the anchor read backwards,
and is scanned in itself: for each offset of the anchor in a string, suffixes match if they lie in one run of the first array
that shares LENGTH - offset bytes and in one run of the second that shares offset bytes. Then it is merge-scanned
against each level of the family: of both, the suffixes whose gram the other has too are merged, array with array, and
scanned. Levels of equal size merge, again array with array, so a suffix is merged a logarithmic number of times. Equal
contexts are one entry of an array.

A table without rows gives none; a text longer than a slice is worked on whole. A caller's columns n_bytes, n_removed, n_spans, kept, kept_sha256, _text,
_key or _b are not to be kept under these names; rename them. Texts count as UTF-8 bytes, null as none; matches never cross documents; strings are judged on the input. Equal
rows repeat each other's strings. Matches compare bytes, not hashes. A task holds a bucket's distinct contexts
(368 bytes each); contexts found twice within a flush of a task are settled there and sent once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Slice, U, anchors, bits, by_bucket, extended, gram_hashes, n_bytes, prefix_sums, read, row_key, slices, text_buffers
from .substrings import MAX_BITS, covered, sketch, spans_by_key

LENGTH = 200
GRAM = 32
LEFT = LENGTH - GRAM
WIDTH = LEFT + LENGTH
PIECE = 1 << 18  # bytes of a slice: its arrays stay in cache
FLUSH = 1 << 15
BATCH = 1 << 12
SETTLED = 0xFFFFFFFF
RECORD = np.dtype([("key", np.int64), ("pos", np.uint32), ("la", np.uint8), ("ra", np.uint8), ("ctx", np.uint8, (WIDTH,))])


def anchor_places(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Byte places of a slice that anchor some string, and their gram hashes."""
    g = gram_hashes(prefix_sums(s.buf), GRAM)
    if len(g) < LEFT + 1:
        return np.zeros(0, np.int64), np.zeros(0, U)
    _, chosen = anchors((g >> U(32)).astype(np.uint32), LEFT + 1)
    at = np.flatnonzero(chosen)
    return at, g[at]


def records(s: Slice, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of anchors, and which of the anchors have a whole string around them in their document."""
    doc = np.searchsorted(s.off, at, "right") - 1
    lo, hi = s.off[doc], s.off[doc + 1]
    la, ra = np.minimum(at - lo, LEFT), np.minimum(hi - at, LENGTH)
    ok = (la + ra >= LENGTH) & (ra >= GRAM)
    at, doc, lo, hi = at[ok], doc[ok], lo[ok], hi[ok]
    r = np.empty(len(at), RECORD)
    r["key"], r["pos"], r["la"], r["ra"] = s.ints("_key")[doc], at - lo, la[ok], ra[ok]
    padded = np.concatenate([np.full(LEFT, 255, np.uint8), s.buf, np.full(LENGTH, 255, np.uint8)])
    r["ctx"] = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
    place = np.arange(WIDTH) - LEFT
    short = np.flatnonzero((r["la"] < LEFT) | (r["ra"] < LENGTH))
    outside = (place < -r["la"][short, None].astype(np.int64)) | (place >= r["ra"][short, None].astype(np.int64))
    ctx = r["ctx"][short]
    ctx[outside] = 255  # no byte of UTF-8
    r["ctx"][short] = ctx
    return r, ok


def distinct(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First index of each distinct context, each record's context, and counts."""
    # the pads tell la and ra apart wherever they differ
    v = np.ascontiguousarray(r["ctx"]).view(f"S{WIDTH}").ravel()
    return np.unique(v, return_index=True, return_inverse=True, return_counts=True)[1:]


def spans_out(key: np.ndarray, first: np.ndarray, size: np.ndarray, n_buckets: int) -> list[tuple[int, bytes]]:
    return [(n_buckets + b, key[i].tobytes() + first[i].astype(np.uint32).tobytes() + size[i].astype(np.uint32).tobytes()) for b, i in by_bucket(key % n_buckets)]


def whole(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and length of all that a context covers."""
    return r["pos"].astype(np.int64) - r["la"], r["la"].astype(np.int64) + r["ra"]


def _send(shared, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            r = np.concatenate([x for x, _ in held])
            to = np.concatenate([x for _, x in held])
            index, inv, count = distinct(r)
            same = count[inv] > 1
            first, size = whole(r[same])
            rows = spans_out(r["key"][same], first, size, n_buckets)
            one = r[index]
            one["pos"][count > 1] = SETTLED
            rows += [(b, one[i].tobytes()) for b, i in by_bucket(to[index])]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], names=["b", "data"])

        for s in slices(batches, "_text", PIECE):
            at, h = anchor_places(s)
            keep = shared.value.repeated(h)
            if not keep.any():
                continue
            at, h = at[keep], h[keep]
            for a in range(0, len(at), FLUSH):
                r, ok = records(s, at[a : a + FLUSH])
                held.append((r, (h[a : a + FLUSH][ok] % U(n_buckets)).astype(np.int64)))
                n += len(r)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def strings(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as strings of equal length, which compare like them."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def merge_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of two sorted arrays' elements in the merged one, equal ones of the first before those of the second."""
    of_b = np.searchsorted(a, b, "right") + np.arange(len(b))
    mark = np.ones(len(a) + len(b), bool)
    mark[of_b] = False
    return np.flatnonzero(mark), of_b


class Level:
    """Contexts in suffix-array order; `back` lists them in order of the bytes before the anchor, read backwards."""

    FIELDS = ("ctx", "la", "ra", "ids")

    def __init__(self, ctx: np.ndarray, la: np.ndarray, ra: np.ndarray, ids: np.ndarray, back: np.ndarray) -> None:
        self.ctx, self.la, self.ra, self.ids, self.back = ctx, la, ra, ids, back

    @classmethod
    def sort(cls, ctx: np.ndarray, la: np.ndarray, ra: np.ndarray, ids: np.ndarray) -> Level:
        order = np.argsort(strings(ctx[:, LEFT:]), kind="stable")
        out = cls(ctx[order], la[order], ra[order], ids[order], np.arange(len(ids)))
        out.back = np.argsort(strings(out.before()), kind="stable")
        return out

    def __len__(self) -> int:
        return len(self.ids)

    def before(self) -> np.ndarray:
        """The bytes before the anchors, read backwards, in the order of `back`."""
        return self.ctx[self.back, LEFT - 1 :: -1][:, :LEFT]

    def where(self, keep: np.ndarray) -> Level:
        place = np.cumsum(keep) - 1
        return Level(*(getattr(self, x)[keep] for x in self.FIELDS), place[self.back[keep[self.back]]])

    def merged(self, other: Level) -> Level:
        """Both as one; sorted arrays are merged, nothing is sorted again."""
        at, to = merge_places(strings(self.ctx[:, LEFT:]), strings(other.ctx[:, LEFT:]))
        both = []
        for name in self.FIELDS:
            x, y = getattr(self, name), getattr(other, name)
            z = np.empty((len(x) + len(y), *x.shape[1:]), x.dtype)
            z[at], z[to] = x, y
            both.append(z)
        back = np.empty(len(both[0]), np.int64)
        at_back, to_back = merge_places(strings(self.before()), strings(other.before()))
        back[at_back], back[to_back] = at[self.back], to[other.back]
        return Level(*both, back)

    def sharing(self, other: Level) -> Level:
        """The contexts whose anchor gram the other level has too."""
        own, theirs = strings(self.ctx[:, LEFT : LEFT + GRAM]), strings(other.ctx[:, LEFT : LEFT + GRAM])
        return self.where(theirs[np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)] == own)


def shared_lengths(rows: np.ndarray) -> np.ndarray:
    """How many first bytes each row of sorted rows shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def scan(x: Level, low: np.ndarray, high: np.ndarray) -> None:
    """Lowers low and raises high of the ids to the anchor offsets at which a string of one context is one of another."""
    while True:
        n = len(x)
        if n < 2:
            return
        right, left = shared_lengths(x.ctx[:, LEFT:]), shared_lengths(x.before())
        most_r = np.maximum(right, np.append(right[1:], 0))
        most_l = np.empty(n, np.int64)
        most_l[x.back] = np.maximum(left, np.append(left[1:], 0))
        can = most_r + most_l >= LENGTH
        if can.all():
            break
        x = x.where(can)
    la, ra = x.la.astype(np.int64), x.ra.astype(np.int64)
    lid = np.empty(n, np.int64)
    for o in range(LEFT + 1):
        rid = np.cumsum(right < LENGTH - o)
        lid[x.back] = np.cumsum(left < o)
        at = np.flatnonzero((la >= o) & (ra >= LENGTH - o))
        if len(at) < 2:
            continue
        k = rid[at] * (n + 1) + lid[at]
        by = np.argsort(k, kind="stable")
        eq = k[by[1:]] == k[by[:-1]]
        if eq.any():
            hit = np.zeros(len(at), bool)
            hit[by[1:]] |= eq
            hit[by[:-1]] |= eq
            ids = x.ids[at[hit]]
            low[ids] = np.minimum(low[ids], o)
            high[ids] = np.maximum(high[ids], o)


def family(ctx: np.ndarray, la: np.ndarray, ra: np.ndarray, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """For distinct contexts, the least and the largest matching offset (LENGTH and -1 where none)."""
    low, high = np.full(len(ctx), LENGTH), np.full(len(ctx), -1)
    levels: list[Level] = []
    for a in range(0, len(ctx), batch):
        i = np.arange(a, min(a + batch, len(ctx)))
        new = Level.sort(ctx[i], la[i], ra[i], i)
        scan(new, low, high)
        for old in levels:
            near = old.sharing(new)
            if len(near):
                scan(near.merged(new.sharing(old)), low, high)
        levels.append(new)
        while len(levels) > 1 and len(levels[-2]) <= len(levels[-1]):
            last = levels.pop()
            levels[-1] = levels[-1].merged(last)
    return low, high


def _bucket(n_buckets: int):
    def run(t: pa.Table) -> pa.Table:
        if t.column("b")[0].as_py() >= n_buckets:
            return t
        r = np.concatenate([np.frombuffer(x.as_buffer(), RECORD) for x in t.column("data")])
        index, inv, count = distinct(r)
        full = count > 1
        full |= np.bincount(inv[r["pos"] == SETTLED], minlength=len(index)) > 0
        one = r[index]
        low, high = family(np.ascontiguousarray(one["ctx"]), one["la"], one["ra"])
        out = r["pos"] != SETTLED
        a, b = out & full[inv], out & ~full[inv] & (high[inv] >= 0)
        first, size = whole(r[a])
        first2 = r["pos"][b].astype(np.int64) - high[inv[b]]
        size2 = LENGTH + high[inv[b]] - low[inv[b]]
        rows = spans_out(np.concatenate([r["key"][a], r["key"][b]]), np.concatenate([first, first2]), np.concatenate([size, size2]), n_buckets)
        return pa.table({"b": pa.array([x[0] for x in rows], pa.int32()), "data": pa.array([x[1] for x in rows], pa.binary())})

    return run


def _finish(docs: pa.Table, found: pa.Table) -> pa.Table:
    spans = spans_by_key(found.column("data"))
    buf, off = text_buffers(docs.column("_text"))
    out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
    for i, key in enumerate(docs.column("_key").to_pylist()):
        text = buf[off[i] : off[i + 1]]
        gone, runs = 0, 0
        if key in spans:
            p, m = spans[key]
            cut = covered(len(text), p, p + m)
            gone, runs = int(cut.sum()), int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
            text = text[~cut]
        for name, v in zip(out, (int(off[i + 1] - off[i]), gone, runs, text.tobytes()), strict=True):
            out[name].append(v)
    t = docs.drop_columns(["_text", "_key", "_b"])
    for name, v in out.items():
        t = t.append_column(name, pa.array(v, pa.binary() if name == "kept" else pa.int64()))
    return t


def _finish_digest(docs: pa.Table, found: pa.Table) -> pa.Table:
    t = _finish(docs, found)
    digest = [hashlib.sha256(x.as_buffer()).hexdigest() for x in t.column("kept")]
    return t.drop_columns(["kept"]).append_column("kept_sha256", pa.array(digest, pa.string()))


def dedup(docs: DataFrame, text: str = "text", key: tuple = ("doc_id",), keep: tuple | None = None, digest: bool = False) -> DataFrame:
    """The kept columns, n_bytes, n_removed, n_spans and the kept bytes (`kept`, or `kept_sha256`), for every row."""
    keep = key if keep is None else keep
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"), row_key(*key, text).alias("_key"))
    size = n_bytes(docs, text)
    sk = sketch(rows, lambda s: anchor_places(s)[1], bits(size / 40 * 4, 12, MAX_BITS), expected=size / 40)
    shared = docs.sparkSession.sparkContext.broadcast(sk)
    n_buckets = max(16, -(-size // (3 << 20)))
    found = rows.select("_key", "_text").mapInArrow(_send(shared, n_buckets), "b int, data binary")
    found = found.groupBy("b").applyInArrow(_bucket(n_buckets), "b int, data binary")
    rows = rows.withColumn("_b", (F.lit(n_buckets) + F.pmod("_key", F.lit(n_buckets))).cast("int"))
    schema = extended(rows, "n_bytes bigint, n_removed bigint, n_spans bigint, " + ("kept_sha256 string" if digest else "kept binary"))
    return rows.groupBy("_b").cogroup(found.groupBy(F.col("b").alias("_b"))).applyInArrow(_finish_digest if digest else _finish, schema)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op5_suffixes": op5_suffixes}
ORACLE_SQL: dict[str, str] = {}
