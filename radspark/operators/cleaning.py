"""Cleaning of raw reads: barcodes, cut sites, quality windows, adapters, pairs, duplicates; a read keeps why it went.

Reads are (read_id, sample, seq, qual); further columns pass through where `keep` says so. One Arrow pass does all of a read's checks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hamming, reverse_complement
from ..functions.enzymes import sites


@dataclass(frozen=True)
class Checks:
    """Settings of the chain; None or 0 switches a check off. `offset` is the length of an inline barcode."""

    min_length: int = 0
    enzyme: str | None = None
    rescue: bool = True
    uncalled: bool = True
    window: float = 0.15
    min_quality: float = 10
    quality_base: int = 33
    adapter: str | None = None
    adapter_kmer: int = 5
    adapter_mismatches: int = 1
    offset: int = 0
    trim: bool = False  # cut reads where quality or adapter begins, rather than dropping them


def low_quality_at(scores: np.ndarray, window: int, least: float, offset: int = 0) -> int | None:
    """The first window start, from offset on, whose mean score is below `least`; windows end within the read."""
    window = max(1, window)
    if len(scores) - offset < window:
        return None
    total = np.concatenate([[0], np.cumsum(scores)])
    low = np.flatnonzero(total[offset + window :] - total[offset : len(scores) - window + 1] < least * window)
    return int(low[0]) + offset if len(low) else None


def adapter_at(seq: str, adapter: str, k: int, mismatches: int) -> int | None:
    """Where an adapter starts: a shared k-mer, extended both ways to the ends of adapter or read with few enough mismatches."""
    places: dict[str, list[int]] = {}
    for j in range(len(adapter) - k + 1):
        places.setdefault(adapter[j : j + k], []).append(j)
    for i in range(len(seq) - k + 1):
        for j in places.get(seq[i : i + k], ()):
            back = min(i, j)
            start = i - back
            n = min(len(seq) - start, len(adapter) - (j - back))
            if sum(x != y for x, y in zip(seq[start : start + n], adapter[j - back :], strict=False)) <= mismatches:
                return start
    return None


def cut_site(seq: str, remnants: tuple[str, ...], offset: int, rescue: bool) -> str | None:
    """The read with its cut site, mended where one mismatch away from the first such remnant; None without."""
    for r in remnants:
        if seq.startswith(r, offset):
            return seq
    for r in remnants if rescue else ():
        own = seq[offset : offset + len(r)]
        if len(own) == len(r) and sum(x != y for x, y in zip(own, r, strict=True)) <= 1:
            return seq[:offset] + r + seq[offset + len(r) :]
    return None


def checked(seq: str, qual: str, filtered: bool, c: Checks) -> tuple[str, str, str]:
    """(verdict, seq, qual): the first check that fails, or `retained`."""
    if filtered:
        return "chastity", seq, qual
    if c.min_length and len(seq) - c.offset < c.min_length:
        return "short", seq, qual
    if c.enzyme:
        mended = cut_site(seq, sites(c.enzyme)[0], c.offset, c.rescue)
        if mended is None:
            return "no_cutsite", seq, qual
        seq = mended
    if c.uncalled and any(b in seq[c.offset :] for b in "N."):
        return "uncalled", seq, qual
    if c.min_quality and qual:
        at = low_quality_at(np.frombuffer(qual.encode(), np.uint8).astype(np.int64) - c.quality_base, int(c.window * len(seq) + 0.5), c.min_quality, c.offset)
        if at is not None:
            if not c.trim or at < c.min_length:
                return "low_quality", seq, qual
            seq, qual = seq[:at], qual[:at]
    if c.adapter:
        at = adapter_at(seq, c.adapter, c.adapter_kmer, c.adapter_mismatches)
        if at is not None:
            if not c.trim or at < c.min_length:
                return "adapter", seq, qual
            seq, qual = seq[:at], qual[:at]
    return "retained", seq, qual


def _checked(c: Checks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, q, f = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("_s", "_q", "_f"))
            out = [checked(x or "", y or "", bool(z), c) for x, y, z in zip(s, q, f, strict=True)]
            keep = [n for n in b.schema.names if n not in ("_s", "_q", "_f")]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in keep), *(pa.array([o[i] for o in out], pa.string()) for i in range(3))], names=[*keep, "verdict", "seq", "qual"])

    return run


def clean(reads: DataFrame, checks: Checks, keep: tuple = ("read_id", "sample"), filtered: str | None = None) -> DataFrame:
    """The kept columns, verdict, seq and qual of every read."""
    src = reads.select(*keep, F.col("seq").alias("_s"), F.col("qual").alias("_q"), (F.col(filtered) if filtered else F.lit(False)).alias("_f"))
    schema = src.drop("_s", "_q", "_f").schema
    for n in ("verdict", "seq", "qual"):
        schema = schema.add(n, "string")
    return src.mapInArrow(_checked(checks), schema)


def quality_trim(reads: DataFrame, window: float = 0.15, least: float = 10, base: int = 33, min_length: int = 0) -> DataFrame:
    """(read_id, verdict, cut): where reads are cut, their whole length if nowhere; reads cut before min_length are discarded."""
    c = Checks(uncalled=False, window=window, min_quality=least, quality_base=base, min_length=min_length, trim=True)
    return clean(reads, c, ("read_id",)).select("read_id", "verdict", F.when(F.col("verdict") == "retained", F.length("seq")).alias("cut"))


def routed(pairs: DataFrame) -> DataFrame:
    """Pairs with a verdict for each mate (verdict1, verdict2): `paired`, `rem1`, `rem2` (one mate kept), or `discards`."""
    a, b = F.col("verdict1") == "retained", F.col("verdict2") == "retained"
    return pairs.withColumn("route", F.when(a & b, "paired").when(a, "rem1").when(b, "rem2").otherwise("discards"))


def transposed(pairs: DataFrame, enzyme: str, barcodes: tuple[int, ...] = (0,)) -> DataFrame:
    """Pairs of mates: those whose cut site is on the second mate change places; `swapped` says which. The site is sought on both after barcodes of any of the lengths given: a whole one on the
    first mate keeps the pair, else a whole one on the second turns it, else the mate that agrees in more letters has it, the first if both agree in as many. All columns of a mate
    (seq1 and seq2, qual1 and qual2, and so on) change places together."""
    forward = sites(enzyme)[0]
    agree = lambda c, at, site: sum(((F.substring(c, at + 1 + i, 1) == x).cast("int") for i, x in enumerate(site)), F.lit(0))
    best = lambda c: F.coalesce(F.greatest(F.lit(0), F.lit(0), *[agree(c, at, site) for at in barcodes for site in forward]), F.lit(0))
    whole = len(forward[0])
    first, second = best("seq1"), best("seq2")
    swap = (first < whole) & (second > first)
    names = [c[:-1] for c in pairs.columns if c.endswith("1") and c[:-1] + "2" in pairs.columns]
    out = pairs.withColumn("swapped", swap)
    turned = {f"{n}{k}": F.when(F.col("swapped"), F.col(f"{n}{3 - k}")).otherwise(F.col(f"{n}{k}")) for n in names for k in (1, 2)}
    return out.select(*[turned.get(c, F.col(c)).alias(c) for c in out.columns])


def mate_sense(pairs: DataFrame) -> DataFrame:
    """The second mates read in the direction of the first."""
    return pairs.withColumn("seq2", reverse_complement(F.col("seq2")))


def demultiplex(reads: DataFrame, codes: DataFrame, errors: int = 1) -> DataFrame:
    """reads (observed, ...) joined with the barcode they carry (codes: barcode): the same, or else the first by letters within `errors` mismatches. Unknown
    ones have none. Only distinct observed barcodes are compared, and codes are a file's."""
    known = F.broadcast(codes.select("barcode").distinct())
    seen = reads.select("observed").distinct()
    near = seen.join(known, F.length("observed") == F.length("barcode")).withColumn("distance", hamming(F.col("observed"), F.col("barcode"))).where(F.col("distance") <= errors)
    best = near.groupBy("observed").agg(F.min(F.struct((F.col("distance") > 0).alias("other"), "barcode", "distance")).alias("b"))
    return reads.join(best, "observed", "left").select(*reads.columns, F.col("b.barcode").alias("barcode"), F.col("b.distance").alias("distance"))


def unknown_barcodes(assigned: DataFrame) -> DataFrame:
    return assigned.where("barcode is null").groupBy("observed").agg(F.count("*").alias("n"))


def first_pairs(pairs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, first, copies): of pairs with equal keys (sequences, random oligos) the first by `order`."""
    return pairs.groupBy(*keys).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def merged_pairs(pairs: DataFrame, overlap: int = 10) -> DataFrame:
    """Pairs whose first mate's end is the start of the second (in the first's direction): seq is both as one, by their longest overlap of at least `overlap`."""

    @F.udf("string", useArrow=True)
    def join(a, b):
        for n in range(min(len(a or ""), len(b or "")), overlap - 1, -1):
            if a[-n:] == b[:n]:
                return a + b[n:]
        return None

    return pairs.withColumn("seq", join("seq1", "seq2")).where("seq is not null")


def pcr_duplicates(inserts: DataFrame, keys: list[str]) -> DataFrame:
    """inserts (keys, insert_, name): one pair a key and insert length, the least by name, and how many there were."""
    return inserts.groupBy(*keys, "insert_").agg(F.min("name").alias("name"), F.count("*").alias("pairs"))
