"""K-mers of reads: their frequencies, and reads kept or dropped by them.

K-mers (up to 31 letters) are numbers. Counting adds them up within each batch before anything is shuffled. For the filters
every read gets the frequencies of its k-mers as an array: reads are dealt to groups, a group sends each distinct k-mer once to
the k-mer's bucket, which adds up and answers, and the group looks its reads' k-mers up in the answers. All rows are packed, and
a k-mer that is everywhere is one entry a group. What is shuffled is small: reads go once, four bases a byte; a group's k-mers go
scrambled and in order, as distances (some 1.5 bytes); answers are numbers alone, in the order the group had sent, which it makes anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graphs
from .packing import buffers, kmer_codes, packed_counts, packed_sequences, packed_set, slices, unpacked_counts, unpacked_sequences, unpacked_set

K = 15
GROUP = 2 << 20  # letters of the reads of a group
BUCKET = 4 << 20  # letters whose k-mers a bucket counts, on average


def _counter(k: int, buckets: int):
    """A slice's k-mers and their counts, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = buffers(b.column(0))
            for lo, hi in slices(off):
                kind, n = np.unique(kmer_codes(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)[0], return_counts=True)
                to = _bucket(kind, buckets)
                order = np.argsort(to, kind="stable")
                kind, n, to = kind[order], n[order].astype(np.int64), to[order]
                spans = _spans(to)
                yield pa.RecordBatch.from_arrays([pa.array([int(to[x]) for x, _ in spans], pa.int32()), *(pa.array([v[x:y].tobytes() for x, y in spans], pa.binary()) for v in (kind, n))], names=["b", "codes", "counts"])

    return run


def spelled(codes: np.ndarray, k: int) -> pa.Array:
    """Codes as their bases."""
    out = np.empty((len(codes), k), np.uint8)
    base = np.frombuffer(b"ACGT", np.uint8)
    for i in range(k):
        out[:, i] = base[(codes >> (2 * (k - 1 - i))) & 3]
    return pa.LargeStringArray.from_buffers(len(codes), pa.py_buffer(np.arange(0, (len(codes) + 1) * k, k, dtype=np.int64)), pa.py_buffer(out)).cast(pa.string())


def _summed(k: int, text: bool):
    def run(t: pa.Table) -> pa.Table:
        codes, counts = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t.column(c)]) for c in ("codes", "counts"))
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
        n = np.add.reduceat(counts[order], first) if len(first) else counts
        return pa.table({"kmer" if text else "code": spelled(codes[first], k) if text else pa.array(codes[first]), "n": pa.array(n)})

    return run


def _letters(reads: DataFrame) -> int:
    return reads.agg(F.sum(F.length("seq"))).first()[0] or 0


def _bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)


def _spans(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Where each stretch of equal values begins and ends."""
    ends = [*(np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1).tolist(), len(sorted_)] if len(sorted_) else []
    return list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []


def _counts(reads: DataFrame, k: int, text: bool) -> DataFrame:
    """Packed counts meet in buckets, several to a shuffle partition and as many as the letters need, so that a bucket stays small."""
    buckets = max(8 * int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_letters(reads) // BUCKET))
    sent = reads.select("seq").mapInArrow(_counter(k, buckets), "b int, codes binary, counts binary")
    return sent.groupBy("b").applyInArrow(_summed(k, text), "kmer string, n long" if text else "code long, n long")


def coded_counts(reads: DataFrame, k: int = K) -> DataFrame:
    return _counts(reads, k, False)


def count(reads: DataFrame, k: int = K) -> DataFrame:
    """(kmer, n)"""
    return _counts(reads, k, True)


def histogram(reads: DataFrame, k: int = K) -> DataFrame:
    """(n, kmers): how many k-mers occur n times."""
    return coded_counts(reads, k).groupBy("n").agg(F.count("*").alias("kmers"))


def median_of(sorted_values: Column) -> Column:
    """Of an even number of values the mean of the middle two; of an odd one the element before the middle (the first of one)."""
    n = F.size(sorted_values)
    at = lambda i: F.get(sorted_values, F.greatest(F.lit(0), i))
    half = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 0, (at(half - 1) + at(half)) / 2).otherwise(at(half - 1).cast("double"))


def _at_rank(histo: DataFrame, value: str) -> DataFrame:
    """The median (as median_of) of values with counts, from the few distinct values and their running counts."""
    total = histo.agg(F.sum("kmers").alias("all"))
    h = histo.groupBy(F.col(value).alias("v")).agg(F.sum("kmers").alias("c")).join(F.broadcast(total))
    h = h.withColumn("upto", F.sum("c").over(_ordered("v")))  # a row for each distinct frequency
    pick = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    half = F.expr("all div 2")
    even = F.col("all") % 2 == 0
    return h.agg(pick(F.greatest(F.lit(0), half - 1)).alias("a"), pick(half).alias("b"), F.first(even).alias("even")).select(F.when(F.col("even"), (F.col("a") + F.col("b")) / 2).otherwise(F.col("a").cast("double")).alias("m"))


def _ordered(col: str):
    return Window.orderBy(col)


def spread(reads: DataFrame, k: int = K) -> DataFrame:
    """(median, mad): of all distinct k-mers' frequencies the median, and the median distance from its whole part."""
    histo = histogram(reads, k)
    med = _at_rank(histo, "n").withColumnRenamed("m", "median")
    far = histo.join(F.broadcast(med)).select(F.abs(F.col("n") - F.col("median").cast("long")).alias("d"), "kmers")
    return med.join(F.broadcast(_at_rank(far, "d").withColumnRenamed("m", "mad")))


def _scrambled(code: np.ndarray, k: int) -> np.ndarray:
    """Codes spread over all numbers of 2 k bits, none twice."""
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << 2 * k) - 1)).astype(np.int64)


def _range(scrambled: np.ndarray, buckets: int, k: int) -> np.ndarray:
    """The bucket of scrambled codes: stretches of them."""
    bits = min(2 * k, 31)
    return ((scrambled >> (2 * k - bits)) * buckets) >> bits


def _kinds(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scrambled codes of the distinct k-mers, in order, and how often they occur."""
    kind, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo, hi in slices(off):
        more, times = np.unique(_scrambled(kmer_codes(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)[0], k), return_counts=True)
        if len(kind):
            more, inv = np.unique(np.concatenate([kind, more]), return_inverse=True)
            times = np.bincount(inv, np.concatenate([n, times]), len(more))
        kind, n = more, times.astype(np.int64)
    return kind, n


def _distinct(n_buckets: int, k: int):
    def run(t: pa.Table) -> pa.Table:
        kind, n = _kinds(*unpacked_sequences(t), k)
        to, g = _range(kind, n_buckets, k), t.column("g")[0].as_py()
        rows = [(int(to[x]), g, packed_set(kind[x:y]), packed_counts(n[x:y])) for x, y in _spans(to)]
        return pa.table({name: pa.array([r[j] for r in rows], t) for j, (name, t) in enumerate((("b", pa.int32()), ("g", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())))})

    return run


def _totals(t: pa.Table) -> pa.Table:
    """For each group's k-mers, in order, how often the other groups have them."""
    codes = [unpacked_set(x.as_buffer()) for x in t.column("codes")]
    own = np.concatenate([unpacked_counts(x.as_buffer()) for x in t.column("counts")])
    kind, inv = np.unique(np.concatenate(codes), return_inverse=True)
    n = np.bincount(inv, own, len(kind)).astype(np.int64)
    parts = np.split(n[inv] - own, np.cumsum([len(c) for c in codes])[:-1])
    return t.select(["b", "g"]).append_column("counts", pa.array([packed_counts(p) for p in parts], pa.binary()))


def _told(t: pa.Table) -> np.ndarray:
    """The answers of all buckets, in the order of the k-mers."""
    return np.concatenate([np.zeros(0, np.int64)] + [unpacked_counts(x.as_buffer()) for x in t.sort_by("b").column("counts")])


def _look_up(k: int):
    def run(reads: pa.Table, told: pa.Table) -> pa.Table:
        buf, off = unpacked_sequences(reads)
        code, n = _kinds(buf, off, k)
        n = n + _told(told)
        values, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in slices(off):
            own, row, _ = kmer_codes(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
            own = _scrambled(own, k)
            order = np.argsort(own)  # looked up in order, not all over the codes
            found = np.empty(len(own), np.int64)
            found[order] = n[np.searchsorted(code, own[order])]
            values.append(found)
            sizes.append(np.bincount(row, minlength=hi - lo))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        freq = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(values), pa.int64())).cast(pa.list_(pa.int64()))
        return reads.drop_columns(["g", "seq", "letters"]).append_column("freq", freq)

    return run


def _packed(reads: DataFrame) -> DataFrame:
    """Reads with packed sequences."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "seq" else f for f in reads.schema]).add("letters", T.LongType())
    return reads.mapInArrow(packed_sequences, schema)


def frequencies(reads: DataFrame, k: int = K, keep: tuple = ("read_id",)) -> DataFrame:
    """The kept columns and `freq`: how often each k-mer of the read, in order, occurs in all reads."""
    groups = max(1, -(-_letters(reads) // GROUP))
    r = _packed(reads.select(*keep, "seq", F.pmod(F.xxhash64(*keep, "seq"), F.lit(groups)).cast("int").alias("g")))
    # both sides take all columns of the reads, so that Spark shuffles them once
    told = r.groupBy("g").applyInArrow(_distinct(-(-groups * GROUP // BUCKET), k), "b int, g int, codes binary, counts binary").groupBy("b").applyInArrow(_totals, "b int, g int, counts binary")
    schema = T.StructType([f for f in r.schema if f.name in keep]).add("freq", T.ArrayType(T.LongType()))
    return r.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_look_up(k), schema)


def abundant_filter(reads: DataFrame, k: int = K, max_k_freq: int = 20_000, max_k_pct: float = 0.8, max_lim: int = 0) -> DataFrame:
    """(read_id, kmers, abundant) of the reads kept: those with at most max_lim (or the share max_k_pct) k-mers that occur max_k_freq times or more."""
    f = frequencies(reads, k).select("read_id", F.size("freq").alias("kmers"), F.size(F.filter("freq", lambda x: x >= max_k_freq)).alias("abundant"))
    return f.where(F.col("abundant") <= (F.lit(max_lim) if max_lim else F.floor(F.col("kmers") * max_k_pct + 0.5)))


def _rare(k: int, min_k_pct: float, min_lim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.schema.get_field_index("freq"))
            keep = []
            for f in col:
                x = np.asarray(f.as_py(), np.int64)
                s = np.sort(x)
                h = len(s) // 2
                med = 0.0 if not len(s) else (s[h - 1] + s[h]) / 2 if len(s) % 2 == 0 else float(s[max(0, h - 1)])
                low = (x <= np.floor(med * min_k_pct + 0.5)).astype(np.int64)
                run_ = np.cumsum(low)
                window = run_.copy()
                if len(x) > k:
                    window[k:] -= run_[1 : len(x) - k + 1] - run_[0]
                keep.append(not (window >= min_lim).any())
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def rare_filter(reads: DataFrame, k: int = K, min_k_pct: float = 0.15, min_lim: int = 12) -> DataFrame:
    """(read_id, sample) of the reads kept: those without min_lim k-mers, in a window as long as a k-mer, that occur at most min_k_pct of the read's median.

    The window's count, as defined, never gives back the read's first k-mer.
    """
    f = frequencies(reads, k, ("read_id", "sample"))
    return f.mapInArrow(_rare(k, min_k_pct, min_lim), f.schema).select("read_id", "sample")


def medians(reads: DataFrame, k: int = K) -> DataFrame:
    """(read_id, kmers, median) of reads with k-mers."""
    f = frequencies(reads, k).where("size(freq) > 0").withColumn("freq", F.array_sort("freq"))
    return f.select("read_id", F.size("freq").alias("kmers"), median_of(F.col("freq")).alias("median"))


def _own_kmers(n_buckets: int, k: int):
    """Of a group, each sample's k-mers and their counts, packed by bucket."""

    def run(t: pa.Table) -> pa.Table:
        g, rows = t.column("g")[0].as_py(), []
        for name in t.column("sample").unique().to_pylist():
            kind, n = _kinds(*unpacked_sequences(_of(t, name)), k)
            to = _range(kind, n_buckets, k)
            rows += [(int(to[x]), g, name, packed_set(kind[x:y]), packed_counts(n[x:y])) for x, y in _spans(to)]
        kinds = (("b", pa.int32()), ("g", pa.int32()), ("sample", pa.string()), ("codes", pa.binary()), ("counts", pa.binary()))
        return pa.table({name: pa.array([r[j] for r in rows], t) for j, (name, t) in enumerate(kinds)})

    return run


def _of(t: pa.Table, sample: str | None) -> pa.Table:
    at = t.column("sample")
    return t.filter(pc.is_null(at) if sample is None else pc.fill_null(pc.equal(at, sample), False))


def _before(t: pa.Table) -> pa.Table:
    """A sample's bucket: in place of a group's counts, how often the groups before it hold each k-mer."""
    t = t.sort_by("g")
    codes = [unpacked_set(x.as_buffer()) for x in t.column("codes")]
    upto = _running(np.concatenate(codes), np.concatenate([unpacked_counts(x.as_buffer()) for x in t.column("counts")]))
    parts = np.split(upto, np.cumsum([len(c) for c in codes])[:-1])
    return t.select(["b", "g", "sample"]).append_column("counts", pa.array([packed_counts(p) for p in parts], pa.binary()))


def _running(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each entry, the sum of n of the same code before it."""
    order = np.argsort(code, kind="stable")
    total = np.cumsum(n[order]) - n[order]
    first = np.flatnonzero(np.append(True, np.diff(code[order]) != 0)) if len(code) else np.zeros(0, np.int64)
    out = np.empty(len(code), np.int64)
    out[order] = total - np.repeat(total[first], np.diff(np.append(first, len(code))))
    return out


def _normalise(k: int, limit: float):
    def run(reads: pa.Table, told: pa.Table) -> pa.Table:
        out = [reads.slice(0, 0)]
        for name in reads.column("sample").unique().to_pylist():
            t, own = _of(reads, name).sort_by("read_id"), _of(told, name)
            buf, off = unpacked_sequences(t)
            known, base = _kinds(buf, off, k)[0], _told(own)
            code, row, _ = kmer_codes(buf, off, k)
            code = _scrambled(code, k)
            # a k-mer's occurrences in the read itself do not count for it, so all of a read's are as its first
            at = np.lexsort((np.arange(len(code)), row, code))
            new = np.append(True, (np.diff(code[at]) != 0) | (np.diff(row[at]) != 0)) if len(code) else np.zeros(0, bool)
            seen = np.empty(len(code), np.int64)
            seen[at] = _running(code, np.ones(len(code), np.int64))[at[new]][np.cumsum(new) - 1]
            seen += base[np.searchsorted(known, code)]
            ends = np.searchsorted(row, np.arange(len(t) + 1))
            keep = []
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                n, h = np.sort(seen[lo:hi]), (hi - lo) // 2
                keep.append(lo == hi or ((n[h - 1] + n[h]) / 2 if len(n) % 2 == 0 else n[max(0, h - 1)]) <= limit)
            out.append(t.filter(pa.array(keep, pa.bool_())))
        return pa.concat_tables(out).select(["read_id", "sample"])

    return run


def normalise(reads: DataFrame, k: int = K, limit: float = 2.0) -> DataFrame:
    """(read_id, sample) of the reads kept in digital normalisation: one after another by read_id within a sample, a read goes if the median of its k-mers' counts so far is above the limit.

    Reads that go count too, so a k-mer's count so far is that of the reads before, whatever became of them: groups are stretches of the
    reads in order, and a k-mer's bucket tells each group how often those before it hold the k-mer.
    """
    src = reads.select("read_id", "sample", "seq")
    groups = max(1, -(-_letters(src) // GROUP))
    # written, as stretches could be cut elsewhere when made anew
    r = graphs.written(_packed(src).repartitionByRange(groups, "sample", "read_id").withColumn("g", F.spark_partition_id()), "stretches")[0]
    told = r.groupBy("g").applyInArrow(_own_kmers(-(-groups * GROUP // BUCKET), k), "b int, g int, sample string, codes binary, counts binary")
    told = told.groupBy("b", "sample").applyInArrow(_before, "b int, g int, sample string, counts binary")
    return r.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_normalise(k, limit), "read_id long, sample string")
