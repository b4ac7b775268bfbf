"""Substring dedup of word windows behind a count-min prefilter.

Every window of WINDOW words has an anchor, the least hash of the GRAM-word grams in it; equal windows have
their anchors at equal places, so an anchor occurs at least as often as any window it stands for. First pass: each
partition sketches its anchors, the sketches are merged cell by cell, and the merged sketch is brought down to one bit a cell
(seen twice). Second pass: windows whose anchor may be repeated are grouped exactly by hash; none is lost, as the
sketch never underestimates. Windows found twice within one flush of a task are settled there and
only a token of them is sent, so the rows of a very frequent window are bounded by the number of flushes.

Windows are judged on the input and compared by 96 bits, two hashes of their words under different multipliers: among 1e13
windows (some 70 TB of text) a false pair is expected with a chance of 1 in 1000. Null texts have no words. Equal rows
repeat each other's windows, so both lose them. A table without rows gives none; a text longer than a slice is worked on whole. A caller's columns n_words,
n_removed, kept, kept_sha256, _text, _key or _b are not to be kept under these names; rename them. Sketch cells grow with the corpus up to 2**MAX_BITS a row (64 MB for
both rows): beyond that more windows pass the prefilter, and the result stays exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Slice, U, anchors, bits, by_bucket, extended, gram_hashes, inside, mix, n_bytes, powers, prefix_sums, read, row_key, runs, slices, text_buffers, word_hashes, words

WINDOW = 35
GRAM = 16
SEGMENT = 20  # log2 of the cells of a piece of the sketch
MAX_BITS = 28
HOT = 64  # anchors seen this often send their windows to buckets one by one
FLUSH = 1 << 20
SETTLED = 0xFFFFFFFF
PART_BYTES = 64 << 20  # of partial sketches merged by a task

_SECOND = U(0xD1342543DE82EF95)

# ---------------------------------------------------------------- the sketch


def cells(h: np.ndarray, b: int) -> list[np.ndarray]:
    """A cell in each of the two rows, for hashes."""
    return [(h >> U(64 - b)).astype(np.int64), ((h * U(0xC2B2AE3D27D4EB4F)) >> U(64 - b)).astype(np.int64) + (1 << b)]


class Sketch:
    """The merged sketch, brought down to the cells seen twice and those seen HOT times."""

    def __init__(self, b: int) -> None:
        self.b = b
        self.twice = np.zeros(max(1, 2 << b >> 3), np.uint8)
        self.hot = np.zeros(max(1, 2 << b >> 3), np.uint8)

    def _test(self, table: np.ndarray, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for c in cells(h, self.b):
            ok &= (table[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return ok

    def repeated(self, h: np.ndarray) -> np.ndarray:
        return self._test(self.twice, h)

    def frequent(self, h: np.ndarray) -> np.ndarray:
        return self._test(self.hot, h)


def _packed(seg: int, at: np.ndarray, count: np.ndarray) -> tuple[int, bytes]:
    return seg, (at & ((1 << SEGMENT) - 1)).astype(np.uint32).tobytes() + count.astype(np.uint8).tobytes()


def _partial(found, b: int):
    """Each task counts its own anchors; found(slice) gives their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, salt = [], 0, TaskContext.get().partitionId()

        def flush():
            at, count = np.unique(np.concatenate([c for h in held for c in cells(h, b)]), return_counts=True)
            rows = [_packed(seg, at[i], np.minimum(count[i], HOT)) for seg, i in by_bucket(at >> SEGMENT)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([salt] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["seg", "salt", "cells"])

        for s in slices(batches, "_text"):
            h = found(s)
            if len(h):
                held.append(h)
                n += len(h)
            if n >= FLUSH:
                yield flush()
                held, n, salt = [], 0, salt + 7919
        if n:
            yield flush()

    return run


def _added(t: pa.Table) -> np.ndarray:
    total = np.zeros(1 << SEGMENT, np.uint16)
    for x in t.column("cells"):
        raw = x.as_buffer()
        n = raw.size // 5
        at = np.frombuffer(raw, np.uint32, n)
        total[at] = np.minimum(total[at] + np.frombuffer(raw, np.uint8, n, 4 * n), HOT)
    return total


def _add(t: pa.Table) -> pa.Table:
    total = _added(t)
    at = np.flatnonzero(total)
    return pa.table({"seg": t.column("seg").slice(0, 1), "salt": t.column("salt").slice(0, 1), "cells": pa.array([_packed(0, at, total[at])[1]], pa.binary())})


def _merge(t: pa.Table) -> pa.Table:
    total = _added(t)
    return pa.table({"seg": t.column("seg").slice(0, 1), "twice": pa.array([np.packbits(total >= 2).tobytes()], pa.binary()), "hot": pa.array([np.packbits(total >= HOT).tobytes()], pa.binary())})


def sketch(texts: DataFrame, found, b: int, expected: float = 0, part_bytes: int = PART_BYTES) -> Sketch:
    """texts (_text). What comes to the driver is two bits a cell.

    Partial sketches are merged in a tree: where the partials of a segment would be more than part_bytes (5 bytes for each cell
    of the `expected` anchors), they are first added up in groups, and 64 groups at a time, so that no task gets all
    of them.
    """
    part = texts.select("_text").mapInArrow(_partial(found, b), "seg int, salt long, cells binary")
    groups = int(-(-expected * 2 * 5 // (max(1, (2 << b) >> SEGMENT) * part_bytes)))
    while groups > 1:
        part = part.withColumn("salt", F.pmod("salt", F.lit(groups))).groupBy("seg", "salt").applyInArrow(_add, "seg int, salt long, cells binary")
        groups = -(-groups // 64) if groups > 64 else 1
    out = Sketch(b)
    piece = 1 << SEGMENT >> 3
    for r in part.groupBy("seg").applyInArrow(_merge, "seg int, twice binary, hot binary").collect():
        for name in ("twice", "hot"):
            x = np.frombuffer(r[name], np.uint8)
            to = getattr(out, name)[r["seg"] * piece : (r["seg"] + 1) * piece]
            to[:] = x[: len(to)]
    return out


# ---------------------------------------------------------------- windows


def grams(s: Slice, window: int, gram: int):
    """Word grams of a slice: word hashes' sums, texts' first words, gram hashes, whether each lies in one text."""
    starts, ends, first = words(s.buf, s.off)
    sums = prefix_sums(word_hashes(s.buf, starts, ends))
    return sums, first, gram_hashes(sums, gram)


def _window_anchors(s: Slice, window: int, gram: int):
    """The sums windows are hashed by, their anchors, which windows lie in one text, the anchor grams, texts' first words."""
    sums, first, g = grams(s, window, gram)
    n = len(sums) - window  # windows in the slice
    if n <= 0:
        none = np.zeros(0, U)
        return sums, none, np.zeros(0, bool), none, first
    low, chosen = anchors(g, window - gram + 1)
    return sums, low[:n], inside(first, n, window), g[chosen], first


def second_hashes(sums: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """32 more bits of the windows that start at the given words, under a multiplier of their own."""
    p = powers(len(sums))[1][: len(sums) - 1]
    word = mix((sums[1:] - sums[:-1]) * p ^ _SECOND)  # the words' hashes, apart from their places
    h = np.zeros(len(at), U)
    for j in range(window):
        h = h * _SECOND + word[at + j]
    return (mix(h) >> U(32)).astype(np.uint32)


def _windows(shared, n_buckets: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = shared.value
        held, n = [], 0

        def flush():
            h, h2, key, pos, to = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((h2, h))
            hs, hs2 = h[order], h2[order]
            same = np.zeros(len(h), bool)
            eq = (hs[1:] == hs[:-1]) & (hs2[1:] == hs2[:-1])
            same[1:] |= eq
            same[:-1] |= eq
            head = np.ones(len(h), bool)
            head[1:] = ~eq
            settled = np.zeros(len(h), bool)
            settled[order[same]] = True
            rows = []
            k, p, m = runs(key[settled], pos[settled])
            for b, i in by_bucket(n_buckets + k % n_buckets):
                rows.append((b, k[i].tobytes() + p[i].astype(np.uint32).tobytes() + m[i].astype(np.uint32).tobytes()))
            p2 = pos.copy()
            p2[settled] = SETTLED
            send = np.zeros(len(h), bool)
            send[order[head]] = True
            h, h2, key, p2, to = h[send], h2[send], key[send], p2[send], to[send]
            for b, i in by_bucket(to):
                rows.append((b, h[i].tobytes() + key[i].tobytes() + h2[i].tobytes() + np.diff(p2[i], prepend=0).astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["b", "data"])

        for s in slices(batches, "_text"):
            sums, low, ok, _, first = _window_anchors(s, window, gram)
            at = np.flatnonzero(ok)
            at = at[sk.repeated(low[at])]
            if not len(at):
                continue
            doc = np.searchsorted(first, at, "right") - 1
            h = gram_hashes(sums, window)[at]
            route = np.where(sk.frequent(low[at]), h, low[at])
            held.append((h, second_hashes(sums, at, window), s.ints("_key")[doc], at - first[doc], (route % U(n_buckets)).astype(np.int64)))
            n += len(at)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _exact(n_buckets: int):
    """A bucket's windows by hash: the places of those that are there twice, or settled elsewhere. Settled places pass."""

    def run(t: pa.Table) -> pa.Table:
        b = t.column("b")[0].as_py()
        if b >= n_buckets:
            return t
        parts = []
        for x in t.column("data"):
            raw = x.as_buffer()
            n = raw.size // 24
            parts.append((np.frombuffer(raw, U, n), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.uint32, n, 16 * n), np.cumsum(np.frombuffer(raw, np.uint32, n, 20 * n).astype(np.int64)) & SETTLED))
        h, key, h2, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((h2, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        inv = np.empty(len(h), np.int64)
        inv[order] = np.cumsum(new) - 1
        count = np.bincount(inv)
        hit = np.bincount(inv[pos == SETTLED], minlength=len(count)) > 0
        hit |= count > 1
        keep = hit[inv] & (pos != SETTLED)
        key, pos = key[keep], pos[keep]
        order = np.lexsort((pos, key))
        k, p, m = runs(key[order], pos[order])
        rows = [(n_buckets + x, k[i].tobytes() + p[i].astype(np.uint32).tobytes() + m[i].astype(np.uint32).tobytes()) for x, i in by_bucket(k % n_buckets)]
        return pa.table({"b": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

    return run


def spans_by_key(data: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Key -> first positions and lengths, of packed (key, first, length)."""
    parts = []
    for x in data:
        raw = x.as_buffer()
        n = raw.size // 16
        parts.append((np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint32, n, 8 * n), np.frombuffer(raw, np.uint32, n, 12 * n)))
    if not parts:
        return {}
    key, pos, m = (np.concatenate(c) for c in zip(*parts, strict=True))
    return {int(key[i[0]]): (pos[i].astype(np.int64), m[i].astype(np.int64)) for _, i in by_bucket(np.unique(key, return_inverse=True)[1])}


def covered(n: int, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Which of n positions lie in some [first, past)."""
    d = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(past, n), minlength=n + 1)[: n + 1]
    return np.cumsum(d)[:n] > 0


def _finish(window: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        spans = spans_by_key(found.column("data"))
        buf, off = text_buffers(docs.column("_text"))
        out = {"n_words": [], "n_removed": [], "kept": []}
        for i, key in enumerate(docs.column("_key").to_pylist()):
            all_words = buf[off[i] : off[i + 1]].tobytes().split()
            gone = 0
            if key in spans:
                p, m = spans[key]
                keep = ~covered(len(all_words), p, p + m - 1 + window)
                gone = int(len(keep) - keep.sum())
                kept = list(compress(all_words, keep.tolist()))
            else:
                kept = all_words
            out["n_words"].append(len(all_words))
            out["n_removed"].append(gone)
            out["kept"].append(b" ".join(kept))
        t = docs.drop_columns(["_text", "_key", "_b"])
        for n, kind in (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())):
            t = t.append_column(n, pa.array(out[n], kind).cast(pa.string()) if n == "kept" else pa.array(out[n], kind))
        return t

    return run


def _finish_digest(window: int):
    full = _finish(window)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        t = full(docs, found)
        digest = [hashlib.sha256(x.as_buffer()).hexdigest() for x in t.column("kept").cast(pa.binary())]
        return t.drop_columns(["kept"]).append_column("kept_sha256", pa.array(digest, pa.string()))

    return run


def dedup(docs: DataFrame, text: str = "text", key: tuple = ("doc_id",), keep: tuple | None = None, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """The kept columns, n_words, n_removed and the kept words (`kept`, or `kept_sha256` where digest is set), for every row."""
    keep = key if keep is None else keep
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"), row_key(*key, text).alias("_key"))
    size = n_bytes(docs, text)
    b = bits(size / 6 * 0.4, 12, MAX_BITS)
    sk = sketch(rows, lambda s: _window_anchors(s, window, gram)[3], b, expected=size / 6 * 0.1)
    shared = docs.sparkSession.sparkContext.broadcast(sk)
    n_buckets = max(16, -(-size // (3 << 20)))
    found = rows.select("_key", "_text").mapInArrow(_windows(shared, n_buckets, window, gram), "b int, data binary")
    found = found.groupBy("b").applyInArrow(_exact(n_buckets), "b int, data binary")
    rows = rows.withColumn("_b", (F.lit(n_buckets) + F.pmod("_key", F.lit(n_buckets))).cast("int"))
    schema = extended(rows, "n_words bigint, n_removed bigint, " + ("kept_sha256 string" if digest else "kept string"))
    return rows.groupBy("_b").cogroup(found.groupBy(F.col("b").alias("_b"))).applyInArrow((_finish_digest if digest else _finish)(window), schema)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op2_substrings": op2_substrings}
ORACLE_SQL = {
    "op2_substrings": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, p, array_to_string(w[p + 1 : p + 35], ' ') AS s FROM (SELECT r, w, unnest(range(0, len(w) - 34)) AS p FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
word AS (SELECT r, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM d),
edge AS (SELECT r, i, sum(v) AS v FROM (SELECT r, p AS i, 1 AS v FROM rep UNION ALL SELECT r, p + 35, -1 FROM rep) GROUP BY r, i),
mark AS (SELECT word.r, word.i, word.x, sum(coalesce(edge.v, 0)) OVER (PARTITION BY word.r ORDER BY word.i) AS c
  FROM word LEFT JOIN edge ON word.r = edge.r AND word.i = edge.i),
agg AS (SELECT r, count(*) FILTER (c > 0) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (c = 0) AS kept FROM mark GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN agg ON d.r = agg.r"""
}
