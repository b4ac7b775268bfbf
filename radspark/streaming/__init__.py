"""Reads as a stream: clone filter within a watermark, windowed counts, normalisation with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READS = "read_id long, sample string, seq string, qual string, ts timestamp"


def arriving(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """Parquet files of reads as they come into a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def clone_filter(reads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One read a sample and sequence among those that arrive within the delay of each other; state is kept no longer than that."""
    return reads.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sample", "seq"])


def retained(reads: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Reads and bases of each sample by time of arrival."""
    return reads.withWatermark("ts", delay).groupBy(F.window("ts", window), "sample").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"))


def normalise(reads: DataFrame, k: int = 15, limit: float = 2.0, width: int = 1 << 16) -> DataFrame:
    """(read_id, sample): reads go whose k-mers' median count so far in their sample is above the limit.

    A sample's counts are a sketch of `width` cells in each of two rows (never too low, so that a read may go too early, but none stays too
    long): state is bounded however much arrives. Reads of a batch are taken in order of read_id.
    """
    import zlib

    def cells(kmer: str) -> tuple[int, int]:
        raw = kmer.encode()
        return zlib.crc32(raw) % width, width + zlib.adler32(raw[::-1]) * 2654435761 % width

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        counts = list(state.get[0]) if state.exists else [0] * (2 * width)
        t = pd.concat(list(batches)).sort_values("read_id")
        keep = []
        for seq in t["seq"]:
            at = [cells(seq[i : i + k]) for i in range(len(seq or "") - k + 1)]
            n = sorted(min(counts[a], counts[b]) for a, b in at)
            h = len(n) // 2
            median = 0 if not n else (n[h - 1] + n[h]) / 2 if len(n) % 2 == 0 else n[max(0, h - 1)]
            for a, b in at:
                counts[a] += 1
                counts[b] += 1
            keep.append(median <= limit)
        state.update((counts,))
        yield t[keep][["read_id", "sample"]]

    return reads.groupBy("sample").applyInPandasWithState(run, "read_id long, sample string", "counts array<int>", "append", "NoTimeout")
