"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased runs of letters and digits; an item of m words is compared with windows of m words. The
similarity of two word sequences is that of their SHINGLE-word shingles weighted by how often they occur:
sum of least weights over sum of greatest, at least 0.8. Sequences below a shingle's length are one shingle.

Such a window holds at least 8/9 of m - SHINGLE + 1 shingles that occur in some item, so windows with fewer are not
fingerprinted. The others' SimHash of BITS bits is looked up in a multi-index: fingerprints are cut into BLOCKS blocks, and
two within RADIUS differ in RADIUS // BLOCKS bits at most in one of them at least. A block keeps its distinct values, probed
by their distance, and the items of each; so the lookup finds all items within RADIUS, and looks at about a tenth
of unrelated ones. Exact similarity decides. At similarity 0.8 the expected distance is under 20 with a deviation of 4, if no
shingle repeats; a few heavy shingles decide all bits together, so items and windows with a repeated shingle are compared
exactly without the lookup.

Items without words match nothing; null and empty texts hold nothing, long ones are read whole. Equal items are all reported,
items without id under a null id; of windows of equal similarity the first is reported. Repeated rows get equal hits. Tables
without rows give no hits, or no rows. A caller's columns `hits`, `_text` or `_key` are not to be kept under these names; rename
them. Item text goes to tasks in parts of at most PART bytes, one pass over the documents for each part.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTER, LOWER, Slice, U, extended, gram_hashes, inside, mix, n_bytes, prefix_sums, read, row_key, slices, slide, word_hashes, words, written

SHINGLE = 5
PERCENT = 80
BITS = 128
RADIUS = 40
BLOCKS = 4  # of 32 bits
PART = 8 << 20
STRETCH = 1 << 12
_ALNUM = LETTER.copy()
_ALNUM[48:58] = True


def word_sums(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[buf]
    starts, ends, first = words(low, off, ~_ALNUM)
    return prefix_sums(word_hashes(low, starts, ends)), first


def _bits(shingle: np.ndarray) -> np.ndarray:
    """BITS bits of each shingle."""
    wide = np.stack([shingle, mix(shingle ^ U(0x9E3779B97F4A7C15))], 1)
    return np.unpackbits(wide.view(np.uint8).reshape(len(shingle), BITS // 8), axis=1)


def fingerprints(shingle: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SimHash in blocks, of the stretches of `size` shingles that start at the given places: each bit by the weighted majority of the
    shingles' bits; a tie is 0. The sums slide along."""
    total = np.zeros((len(shingle) + 1, BITS), np.int32)
    np.cumsum(_bits(shingle), axis=0, out=total[1:])
    return np.packbits(2 * (total[at + size] - total[at]) > size, axis=1).view(np.uint32)


def fingerprint(shingle: np.ndarray) -> np.ndarray:
    return fingerprints(shingle, np.zeros(1, np.int64), len(shingle))[0]


def repetitive(shingle: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Which of the stretches hold a shingle twice."""
    order = np.argsort(shingle, kind="stable")
    before = np.full(len(shingle), -1)
    same = shingle[order[1:]] == shingle[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return slide(before, size, np.maximum)[at] >= at


class Index:
    """Fingerprints of items of one size by block."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.blocks = [np.unique(prints[:, b], return_inverse=True) for b in range(BLOCKS)]

    def looked_at(self, f: np.ndarray) -> np.ndarray:
        """For fingerprints (rows of f), which items have a block within RADIUS // BLOCKS of theirs."""
        mark = np.zeros((len(f), len(self.prints)), bool)
        for b, (value, inv) in enumerate(self.blocks):
            mark |= (np.bitwise_count(value ^ f[:, b, None]) <= RADIUS // BLOCKS)[:, inv.ravel()]
        return mark

    def near(self, f: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row of f, item) of all whose fingerprints differ in RADIUS bits at most."""
        step = max(1, (1 << 20) // len(self.prints))
        for a in range(0, len(f), step):
            row, item = np.nonzero(self.looked_at(f[a : a + step]))
            ok = np.bitwise_count(self.prints[item] ^ f[a + row]).sum(1) <= RADIUS
            yield from zip((a + row[ok]).tolist(), item[ok].tolist(), strict=True)


def similarity(a: Counter, b: Counter) -> float:
    both = (a & b).total()
    return both / (a.total() + b.total() - both)


class Items:
    """The items of a part: shingles, fingerprints, and the multi-index."""

    def __init__(self, rows: list[tuple[int | None, str]]) -> None:
        self.by_size: dict[int, list[tuple[int | None, Counter, np.ndarray]]] = defaultdict(list)
        self.repetitive: dict[int, set[int]] = defaultdict(set)
        grams: dict[int, set[int]] = defaultdict(set)
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            sums, first = word_sums(raw, np.array([0, len(raw)]))
            m = len(sums) - 1
            if not m:
                continue
            g = gram_hashes(sums, min(SHINGLE, m))
            grams[min(SHINGLE, m)].update(g.tolist())
            if len(np.unique(g)) < len(g):
                self.repetitive[m].add(len(self.by_size[m]))
            self.by_size[m].append((item, Counter(g.tolist()), fingerprint(g)))
        self.grams = {k: np.array(sorted(v), U) for k, v in grams.items()}
        self.maps = {}
        for k, g in self.grams.items():
            t = np.zeros(1 << 20, bool)
            t[(g >> U(44)).astype(np.int64)] = True
            self.maps[k] = t
        self.index = {m: Index(np.stack([f for _, _, f in items])) for m, items in self.by_size.items()}

    def known(self, k: int, g: np.ndarray) -> np.ndarray:
        hit = self.maps[k][(g >> U(44)).astype(np.int64)]
        at = np.flatnonzero(hit)
        s = self.grams[k]
        hit[at] = s[np.minimum(np.searchsorted(s, g[at]), len(s) - 1)] == g[at]
        return hit

    def compared(self, part: np.ndarray, at: np.ndarray, m: int) -> Iterator[tuple[int, int]]:
        """(window, item) to be compared exactly, in order of the windows: by the lookup, or all where a shingle repeats."""
        w = max(m - SHINGLE, 0) + 1
        again = repetitive(part, at, w)
        pairs = set(self.index[m].near(fingerprints(part, at, w)))
        pairs |= {(i, item) for i in np.flatnonzero(again).tolist() for item in range(len(self.by_size[m]))}
        pairs |= {(i, item) for item in self.repetitive.get(m, ()) for i in range(len(at))}
        return iter(sorted(pairs))

    def hits(self, s: Slice, percent: int = PERCENT) -> dict[int, dict[int | None, tuple[float, int, int]]]:
        """Row of the slice -> item -> best similarity, first word and number of words of the window."""
        out: dict[int, dict[int | None, tuple[float, int, int]]] = defaultdict(dict)
        sums, first = word_sums(s.buf, s.off)
        for k in self.grams:
            g = gram_hashes(sums, k)
            if not len(g):
                continue
            known = self.known(k, g) & inside(first, len(g), k)
            at = np.flatnonzero(known)
            for doc in np.unique(np.searchsorted(first, at, "right") - 1):
                lo, hi = first[doc], max(first[doc], first[doc + 1] - k + 1)  # grams of this text
                count = np.concatenate([[0], np.cumsum(known[lo:hi])])
                for m in self.by_size:
                    if min(m, SHINGLE) != k or m - k + 1 > hi - lo:
                        continue
                    w = m - k + 1
                    least = -(-2 * percent * w // (100 + percent))
                    places = np.flatnonzero(count[w:] - count[:-w] >= least)
                    while len(places):  # a stretch at a time, so that a long text needs no more than a short one
                        some = places[places < places[0] + STRETCH]
                        places = places[len(some) :]
                        part = g[lo + some[0] : lo + some[-1] + w]
                        for i, item in self.compared(part, some - some[0], m):
                            name, weights, _ = self.by_size[m][item]
                            window = part[some[i] - some[0] : some[i] - some[0] + w]
                            sim = similarity(Counter(window.tolist()), weights)
                            if 100 * sim >= percent and sim > out[doc].get(name, (0,))[0]:
                                out[doc][name] = (sim, int(some[i]), m)
        return out


_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first", pa.int64()), ("size", pa.int64())]))


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "_text"):
            hits = shared.value.hits(s)
            names = [n for n in s.batch.schema.names if n != "_text"]
            col = [[{"item_id": i, "similarity": v, "first": a, "size": m} for i, (v, a, m) in sorted(hits[r].items(), key=lambda h: (h[0] is None, h[0] or 0))] if hits.get(r) else [] for r in range(s.n)]
            yield pa.RecordBatch.from_arrays([*(s.column(n) for n in names), pa.array(col, _HIT)], names=[*names, "hits"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple = ("doc_id",), part: int = PART) -> DataFrame:
    """The kept columns and `hits` (item_id, similarity, first word, words), for every row."""
    spark = docs.sparkSession
    parts = max(1, -(-2 * n_bytes(benchmark) // part))
    items = benchmark.select(F.col("item_id").cast("long"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).alias("p"))
    src = docs.select(*keep, F.col(text).alias("_text"))
    out, sent = None, []
    for p in range(parts):
        shared = spark.sparkContext.broadcast(Items(sorted(((r["item_id"], r["text"]) for r in items.where(F.col("p") == p).collect()), key=str)))
        schema = "hits array<struct<item_id:bigint,similarity:double,first:bigint,size:bigint>>"
        if parts == 1:
            return src.mapInArrow(_scan(shared), extended(src, schema))
        keyed = docs.select(row_key(*docs.columns).alias("_key"), F.col(text).alias("_text"))
        sent.append(shared)
        one = keyed.mapInArrow(_scan(shared), f"_key long, {schema}").where(F.size("hits") > 0).dropDuplicates(["_key"])
        out = one if out is None else out.unionByName(one)
    every = written(out.groupBy("_key").agg(F.flatten(F.collect_list("hits")).alias("hits")), "hits")
    for shared in sent:
        shared.unpersist()
    keyed = docs.select(*keep, row_key(*docs.columns).alias("_key")).join(every, "_key", "left")
    return keyed.drop("_key").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<item_id:bigint,similarity:double,first:bigint,size:bigint>>")))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it holds a benchmark item, the items, and the best similarity (null without)."""
    out = find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.col("hits.item_id").alias("item_ids"), F.array_max("hits.similarity").alias("similarity"))


QUERIES = {"op3_decontam": op3_decontam}
ORACLE_SQL: dict[str, str] = {}
