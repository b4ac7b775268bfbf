"""A locus from its reads: contigs of both ends joined, reads aligned to the contig, base counts, genotypes, phases.

Reads are (locus, sample, read, mate, seq): mate 1 begins at the locus' start, mate 2 lies further on and is written in the same direction; mates share their
read. A contig is made from a locus' reads in one task; all other steps work on reads, sites or samples of a locus.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar
from ..plans.dialect import Fn
from . import alignment, assembly, graphs, models
from .packing import buffers

_BASE = np.full(256, 4, np.uint8)
_BASE[[65, 67, 71, 84]] = [0, 1, 2, 3]
TREES = 128  # suffix trees that a task keeps

# ---------------------------------------------------------------- contigs


def _contigs(k: int, least: int, seed: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for forward, reads in zip(b.column("forward").to_pylist(), b.column("paired").to_pylist(), strict=True):
                paired = graphs.contig(sorted(reads), k, least) if reads else None
                out.append(("forward", forward, 0) if not paired else ("overlap" if (n := alignment.joined(forward, paired, seed, share=share))[1] else "apart", *n))
            yield pa.RecordBatch.from_arrays([b.column("locus"), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[0] for r in out], pa.string())], names=["locus", "contig", "overlap", "kind"])

    return run


def contigs(reads: DataFrame, k: int = 21, least: int = 2, seed: int = 12, share: float = 0.8) -> DataFrame:
    """(locus, contig, overlap, kind): the consensus of a locus' forward reads, joined with the contig of its paired reads' graph.

    kind is `overlap` where the two overlap, exactly or not; `apart` where they don't, with a run of N between; `forward` where the paired reads give no contig.
    """
    forward = assembly.consensus(reads.where("mate = 1").select("locus", "seq"), "locus").withColumnRenamed("consensus", "forward")
    paired = reads.where("mate = 2 and seq is not null").groupBy("locus").agg(F.collect_list("seq").alias("paired"))
    both = forward.join(paired, "locus", "left").select("locus", "forward", F.coalesce("paired", F.array().cast("array<string>")).alias("paired"))
    return both.mapInArrow(_contigs(k, least, seed, share), "locus long, contig string, overlap int, kind string")


# ---------------------------------------------------------------- alignment


def placed(contig: str, read: str, tree: alignment.SuffixTree, seed: int, share: float) -> tuple[int, str] | None:
    """Where a read lies in a contig, and how (clipped ends as S); None if it agrees in less than a share of what is aligned, or aligned is less of it than that."""
    got = alignment.align_by_matches(contig, read, seed, tree)
    if not got:
        return None
    c, start = got
    at = c[0][1] if c[0][0] == "S" else 0
    inside = [x for x in c if x[0] != "S"]
    agree, _ = alignment.identity(contig[start:], read[at:], inside)
    used = sum(n for op, n in inside if op in "MI")
    return (start, cigar.text(c)) if agree >= share and used >= share * len(read) else None


def _aligned(seed: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: OrderedDict[str, alignment.SuffixTree] = OrderedDict()
        known: dict[tuple[str, str], tuple[int, str] | None] = {}
        for b in batches:
            out = []
            for i, (contig, seq) in enumerate(zip(b.column("contig").to_pylist(), b.column("seq").to_pylist(), strict=True)):
                at = contig.find(seq)
                if at >= 0:
                    out.append((i, at, f"{len(seq)}M"))
                    continue
                if (contig, seq) not in known:
                    if contig not in trees:
                        trees[contig] = alignment.SuffixTree(contig)
                        if len(trees) > TREES:
                            trees.popitem(last=False)
                    if len(known) > 1 << 14:
                        known.clear()
                    known[contig, seq] = placed(contig, seq, trees[contig], seed, share)
                if known[contig, seq]:
                    out.append((i, *known[contig, seq]))
            at = pa.array([r[0] for r in out], pa.int64())
            kept = [b.column(n).take(at) for n in b.schema.names if n != "contig"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string())], names=[*(n for n in b.schema.names if n != "contig"), "start", "cigar"])

    return run


def align_reads(reads: DataFrame, contigs_: DataFrame, seed: int = 12, share: float = 0.8) -> DataFrame:
    """reads with start and cigar along their locus' contig, by a chain of exact matches with gaps between; reads that don't align are left out."""
    r = reads.where("length(seq) > 0").join(contigs_.select("locus", "contig"), "locus")
    schema = r.drop("contig").schema.add("start", "integer").add("cigar", "string")
    return r.mapInArrow(_aligned(seed, share), schema)


def _blocks(text: str, held: dict[str, list[tuple[int, int, int]]]) -> list[tuple[int, int, int]]:
    """Aligned stretches: (place in read, place from the read's start on the contig, letters)."""
    if text not in held:
        out, q, t = [], 0, 0
        for op, n in cigar.parse(text):
            if op in "M=X":
                out.append((q, t, n))
            q += n if op in "M=XIS" else 0
            t += n if op in "M=XDN" else 0
        held[text] = out
    return held[text]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[int, int, int]]] = {}
    for b in batches:
        if not b.num_rows:
            continue
        buf, off = buffers(b.column("seq"))
        spans = [(i, s + t, q, n) for i, (s, c) in enumerate(zip(b.column("start").to_pylist(), b.column("cigar").to_pylist(), strict=True)) for q, t, n in _blocks(c, held)]
        row, to, q, n = np.array(spans, np.int64).T if spans else np.zeros((4, 0), np.int64)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        base = _BASE[buf[np.repeat(off[row] + q, n) + within]]
        col, read = np.repeat(to, n) + within, np.repeat(row, n)
        kinds = b.column("sample").dictionary_encode()
        locus, inverse = np.unique(b.column("locus").to_numpy(), return_inverse=True)
        sample = kinds.indices.to_numpy(zero_copy_only=False)
        ok = base < 4
        width = int(col.max(initial=0)) + 1
        key = (inverse[read] * len(kinds.dictionary) + sample[read]) * width + col
        weight = b.column("depth").to_numpy()[read]
        cell, at = np.unique(key[ok], return_inverse=True)
        counts = np.zeros((len(cell), 4), np.int64)
        np.add.at(counts, (at, base[ok]), weight[ok])
        group = cell // width
        cols = [pa.array(locus[group // len(kinds.dictionary)]), pa.array((cell % width).astype(np.int32)), kinds.dictionary.take(pa.array(group % len(kinds.dictionary))), *(pa.array(counts[:, j]) for j in range(4))]
        yield pa.RecordBatch.from_arrays(cols, names=["locus", "col", "sample", "na", "nc", "ng", "nt"])


def pileup(aligned: DataFrame) -> DataFrame:
    """aligned reads (locus, sample, seq, start, cigar, and depth, 1 if there is none) -> base counts (locus, col, sample, na, nc, ng, nt). A task adds up the reads of a batch before anything is sent; gaps and clipped ends count nowhere."""
    depth = F.col("depth").cast("long") if "depth" in aligned.columns else F.lit(1).cast("long")
    a = aligned.select("locus", "sample", "seq", "start", "cigar", depth.alias("depth")).sortWithinPartitions("locus", "sample")
    kind = a.schema["sample"].dataType.simpleString()
    part = a.mapInArrow(_counts, f"locus long, col int, sample {kind}, na long, nc long, ng long, nt long")
    return part.groupBy("locus", "col", "sample").agg(*[F.sum(c).alias(c) for c in ("na", "nc", "ng", "nt")])


def _bases_at():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[int, int, int]]] = {}
        for b in batches:
            rows = []
            for i, (seq, start, c, cols) in enumerate(zip(*(b.column(n).to_pylist() for n in ("seq", "start", "cigar", "cols")), strict=True)):
                for q, t, n in _blocks(c, held):
                    rows += [(i, col, seq[q + col - start - t]) for col in cols if start + t <= col < start + t + n]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in ("locus", "sample", "read")), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["locus", "sample", "read", "col", "base"])

    return run


def phases(aligned: DataFrame, calls: DataFrame, least: int = 1) -> DataFrame:
    """(locus, sample, status, cols, h1, h2): which bases of a sample's heterozygous sites its reads show together; mates count as one read."""
    het = calls.where("variable and a1 <> a2").select("locus", "sample", "col", "a1", "a2")
    cols = het.groupBy("locus", "sample").agg(F.array_sort(F.collect_list("col")).alias("cols"))
    r = aligned.select("locus", "sample", "read", "seq", "start", "cigar").join(cols, ["locus", "sample"])
    kind = aligned.schema["sample"].dataType.simpleString()
    bases = r.mapInArrow(_bases_at(), f"locus long, sample {kind}, read long, col int, base string")
    seen = het.join(bases, ["locus", "sample", "col"], "left").select("locus", F.col("sample").cast("int").alias("sample"), "read", "col", "base", "a1", "a2")
    return assembly.phased(seen, least)


def genotype(reads: DataFrame, model: str = "low", k: int = 21, least: int = 2, seed: int = 12, share: float = 0.8) -> dict[str, DataFrame]:
    """Contigs, aligned reads, calls and phases of paired reads whose samples are numbers."""
    ctg = graphs.written(contigs(reads, k, least, seed, share), "contigs")[0]
    aligned = graphs.written(align_reads(reads, ctg, seed, share), "aligned")[0]
    calls = graphs.written(models.call(pileup(aligned), model), "calls")[0]
    return {"contigs": ctg, "aligned": aligned, "calls": calls, "phases": phases(aligned, calls)}


# ---------------------------------------------------------------- queries


def _both_ends(piles: DataFrame) -> DataFrame:
    """Forward reads of each group's first variant with an error near their end, and paired reads along the rest, which overlap there."""
    p = piles.where("v = 0").select(F.col("g").cast("long").alias("locus"), "seq")
    forward = F.concat(F.substring("seq", 1, 35), F.translate(F.substring("seq", 36, 1), "ACGT", "CGTA"), F.substring("seq", 37, 4))
    read = lambda mate, seq, no: F.struct(F.lit(mate).alias("mate"), seq.alias("seq"), F.lit(no).cast("long").alias("read"))
    every = F.array(*[read(1, forward, i) for i in range(2)], *[read(2, F.substring("seq", 25 + 5 * i, 25), j) for i in range(4) for j in range(2)])
    return p.select("locus", F.lit(0).alias("sample"), F.explode(every).alias("r")).select("locus", "sample", "r.read", "r.mate", "r.seq")


def joined_contigs(spark, piles):
    return contigs(_both_ends(piles), k=15, seed=8)


def contig_pileup(spark, piles):
    """The variants of a group counted along its first variant's sequence, the second half of each as a read of its own."""
    contig = piles.where("v = 0").select(F.col("g").cast("long").alias("locus"), F.col("seq").alias("contig"))
    half = F.explode(F.array("seq", F.substring("seq", 33, 32))).alias("seq")
    reads = piles.select(F.col("g").cast("long").alias("locus"), F.col("v").alias("sample"), F.col("stack").cast("long").alias("read"), F.col("depth").cast("long").alias("depth"), half)
    return pileup(align_reads(reads, contig, seed=8))


_CHECK = {
    "joined_contigs": "SELECT CAST(g AS BIGINT) AS locus, concat(left(seq, 35), translate(seq[36], 'ACGT', 'CGTA'), substr(seq, 37)) AS contig, CAST(16 AS INT) AS overlap, 'overlap' AS kind FROM @piles WHERE v = 0",
    "contig_pileup": "WITH c_b AS (SELECT p.g, p.v, i - 1 AS col, p.seq[i] AS b, p.depth * if(i > 32, 2, 1) AS d FROM @piles p JOIN (SELECT g FROM @piles WHERE v = 0) z USING (g), range(1, 65) AS r(i)) SELECT CAST(g AS BIGINT) AS locus, CAST(col AS INT) AS col, v AS sample, "
    + ", ".join(f"CAST(coalesce(sum(d) FILTER (b = '{x}'), 0) AS BIGINT) AS n{x.lower()}" for x in "ACGT") + " FROM c_b GROUP BY g, col, v",
}
PILES = ("piles",)
OPS = {"joined_contigs": Fn(PILES, joined_contigs, _CHECK["joined_contigs"]), "contig_pileup": Fn(PILES, contig_pileup, _CHECK["contig_pileup"])}
