"""Loci of samples and the catalog: similar sequences joined, grouped and merged, alleles called, samples matched.

Piles are (stack, sample, seq, depth): identical reads of a sample. Candidate pairs share k-mers as numbers; a distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cigar
from . import alignment, graphs
from .packing import buffers, kmer_codes, slices

# ---------------------------------------------------------------- similar sequences


def _distinct_kmers(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = buffers(b.column(b.schema.get_field_index("seq")))
            names = [n for n in b.schema.names if n != "seq"]
            for lo, hi in slices(off):
                code, row, _ = kmer_codes(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                order = np.lexsort((code, row))
                code, row = code[order], row[order]
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
                at = pa.array(row[new] + lo)
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)).take(at) for n in names), pa.array(code[new])], names=[*names, "code"])

    return run


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df over all shuffle partitions, however few tasks its small files or joins leave it in; for steps that make much of a row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def distinct_kmers(seqs: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """The kept columns and code, a row for each distinct k-mer of a sequence."""
    src = dealt(seqs.select(*keep, "seq"))
    return src.mapInArrow(_distinct_kmers(k), src.drop("seq").schema.add("code", T.LongType()))


def kmer_size(length: int, distance: int) -> int:
    if not distance:
        return min(31, length)
    k = -(-(length + 1) // (distance + 1)) - 1
    return min(31, max(7, k - (k % 2 == 0)))


def similar_pairs(seqs: DataFrame, distance: int, length: int, within: list[str], sequence: str = "seq", across: str | None = None) -> DataFrame:
    """(within, a, b, dist): pairs of sequences (id, seq) of equal length at 1 to `distance` differing places, that share as many distinct k-mers as that
    distance leaves, k by `length`, the usual one. across: a boolean column; a is then of the rows where it is false, b of those where it is true.

    Lossless for sequences of at least `length` letters. A k-mer that most sequences hold pairs them all, and only here the join on one
    k-mer would be quadratic: so pairs are counted from all shared k-mers but formed from a sequence's rarest ones, as many as
    distance * k + 1 places cannot spoil.
    """
    k = kmer_size(length, distance)
    side = [across] if across else []
    base = seqs.select("id", *within, *side, F.length(sequence).alias("n"), F.col(sequence).alias("seq"))
    marks = distinct_kmers(base, k, ["id", "n", *within, *side])
    key = ["n", *within, "code"]
    common = marks.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1")
    # a pair differs in at most distance * k of a sequence's k-mers, so any distance * k + 1 of them share one: the rarest do
    rare = Window.partitionBy("id", "n", *within).orderBy("c", "code")
    # sizes are guessed from the files, of which k-mers are many times as large: sorted joins, so that none goes through the driver
    few = marks.join(common.hint("merge"), key, "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("r", F.row_number().over(rare)).where(F.col("r") <= distance * k + 1).where("c > 1")
    x, y = few.select(*key, *side, F.col("id").alias("a")), few.select(*key, *side, F.col("id").alias("b"))
    pairs = x.where(~F.col(across)).drop(across).join(y.where(across).drop(across).hint("merge"), key) if across else x.join(y.hint("merge"), key).where("a < b")
    pairs = pairs.select("n", *within, "a", "b").distinct()
    left, right = base.select(F.col("id").alias("a"), "n", *within, F.col("seq").alias("sa")), base.select(F.col("id").alias("b"), "n", *within, F.col("seq").alias("sb"))
    found = pairs.join(left.hint("merge"), ["a", "n", *within]).join(right.hint("merge"), ["b", "n", *within])
    return found.withColumn("dist", distance_of("sa", "sb")).where((F.col("dist") >= 1) & (F.col("dist") <= distance)).select(*within, "a", "b", "dist")


def distance_of(a: str, b: str):
    """Differing places of two strings of equal length, compared as bytes, a batch at a time."""

    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        bx, ox = buffers(x)
        by, oy = buffers(y)
        out = np.zeros(len(x), np.int32)
        for lo, hi in slices(ox):
            differ = np.concatenate([[0], np.cumsum(bx[ox[lo] : ox[hi]] != by[oy[lo] : oy[hi]])])
            out[lo:hi] = differ[ox[lo + 1 : hi + 1] - ox[lo]] - differ[ox[lo:hi] - ox[lo]]
        return pa.array(out)

    return run(F.col(a), F.col(b))


def similar_by_parts(seqs: DataFrame, distance: int = 6) -> DataFrame:
    """(id1, id2, dist): pairs of distinct sequences of equal length, any length, at 1 to `distance` differing places: two such share one of
    distance + 1 parts of their bases. Parts are hashes in a list, so that the sequences are not copied for each; a pair comes from its first shared part only.
    Below distance + 1 letters a part is empty, so that all sequences of a length are compared."""
    parts = distance + 1
    u = seqs.where("length(seq) > 0").groupBy("seq").agg(F.min("read_id").alias("id")).withColumn("n", F.length("seq"))
    cut = lambda p: F.floor(F.col("n") * p / parts).cast("int")
    # read for the parts and for both sides' sequences, so written once
    u = graphs.written(u.withColumn("h", F.array(*[F.xxhash64(F.substring("seq", cut(p) + 1, cut(p + 1) - cut(p))) for p in range(parts)])), "sequences")[0]
    p = u.select("id", "n", "h", F.posexplode("h").alias("part", "code"))
    key = ["n", "part", "code"]
    x, y = p.select(*key, F.col("id").alias("id1"), F.col("h").alias("h1")), p.select(*key, F.col("id").alias("id2"), F.col("h").alias("h2"))
    first = F.array_position(F.zip_with("h1", "h2", lambda a, b: (a == b).cast("int")), F.lit(1)) == F.col("part") + 1
    pairs = x.join(y, key).where("id1 < id2").where(first).select("id1", "id2")
    found = pairs.join(u.select(F.col("id").alias("id1"), F.col("seq").alias("sa")), "id1").join(u.select(F.col("id").alias("id2"), F.col("seq").alias("sb")), "id2")
    return found.withColumn("dist", distance_of("sa", "sb")).where(F.col("dist") <= distance).select("id1", "id2", "dist")


# ---------------------------------------------------------------- columns of reads


CHUNK = 4096


def _column_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = np.full(256, 4, np.uint8)
    code[[65, 67, 71, 84]] = [0, 1, 2, 3]
    for b in batches:
        buf, off = buffers(b.column(b.schema.get_field_index("seq")))
        names = b.column(b.schema.get_field_index("sample"))
        weight = b.column(b.schema.get_field_index("depth")).to_numpy(zero_copy_only=False).astype(np.int64)
        kinds = names.dictionary_encode() if not isinstance(names, pa.DictionaryArray) else names
        group = kinds.indices.fill_null(len(kinds.dictionary)).to_numpy(zero_copy_only=False)
        values = kinds.dictionary.to_pylist() + [None]
        rows = []
        for lo, hi in slices(off):
            base = code[buf[off[lo] : off[hi]]]
            size = np.diff(off[lo : hi + 1])
            row = np.repeat(np.arange(lo, hi), size)
            col = np.arange(len(base)) - np.repeat(off[lo:hi] - off[lo], size)
            ok = base < 4
            row, col, base = row[ok], col[ok], base[ok]
            # stretches are a group's columns of a part, one after another; each as wide as its last column seen
            key, at = np.unique(group[row].astype(np.int64) << 32 | col // CHUNK, return_inverse=True)
            width = np.zeros(len(key), np.int64)
            np.maximum.at(width, at, col % CHUNK + 1)
            start = np.concatenate([[0], np.cumsum(width * 4)])
            n = np.bincount(start[at] + col % CHUNK * 4 + base, weight[row], start[-1]).astype(np.int64)
            rows += [(values[k >> 32], k & 0xFFFFFFFF, n[x:y].tobytes()) for k, x, y in zip(key.tolist(), start[:-1].tolist(), start[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], names.type if not isinstance(names, pa.DictionaryArray) else names.type.value_type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["sample", "part", "counts"])


def _commonest(t: pa.Table) -> pa.Table:
    flat = np.zeros(CHUNK * 4, np.int64)
    for x in t.column("counts"):
        own = np.frombuffer(x.as_buffer(), np.int64)
        flat[: len(own)] += own
    n = flat.reshape(CHUNK, 4)
    seen = np.flatnonzero(n.sum(1))
    text = np.where(n.sum(1) > 0, np.frombuffer(b"ACGT", np.uint8)[n.argmax(1)], 78)[: seen[-1] + 1 if len(seen) else 0].astype(np.uint8).tobytes().decode()
    return pa.table({"sample": t.column("sample").slice(0, 1), "part": t.column("part").slice(0, 1), "text": pa.array([text])})


def consensus(reads: DataFrame, group: str = "sample", depth: str | None = None) -> DataFrame:
    """(group, consensus): the commonest base of every column up to the group's longest sequence, ties to the first letter; counts are added up in batches, by stretches of columns."""
    r = reads.select(F.col(group).alias("sample"), "seq", (F.col(depth) if depth else F.lit(1)).cast("long").alias("depth")).where("length(seq) > 0")
    kind = r.schema["sample"].dataType.simpleString()
    c = r.mapInArrow(_column_counts, f"sample {kind}, part int, counts binary").groupBy("sample", "part").applyInArrow(_commonest, f"sample {kind}, part int, text string")
    return c.groupBy("sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("consensus")).withColumnRenamed("sample", group)


# ---------------------------------------------------------------- loci of a sample


def lumberjack(piles: DataFrame, scale: float = 3.0) -> DataFrame:
    """piles with `lumberjack`: those deeper than floor(mean + scale * deviation + 1) of their sample, and those one mismatch from such a one."""
    stat = piles.groupBy("sample").agg(F.floor(F.avg("depth") + scale * F.stddev_pop("depth") + 1).alias("limit"))
    deep = piles.join(F.broadcast(stat), "sample").where("depth > limit").select("sample", "seq").distinct()
    # two sequences one mismatch apart share their first half or their second one
    half = F.floor(F.length("seq") / 2).cast("int")
    keyed = lambda d, *keep: d.select("sample", *keep, "seq", F.length("seq").alias("n"), F.posexplode(F.array(F.xxhash64(F.substring("seq", F.lit(1), half)), F.xxhash64(F.substring("seq", half + 1, F.length("seq"))))).alias("part", "code"))
    pairs = keyed(piles, "stack").join(keyed(deep).withColumnRenamed("seq", "other").hint("merge"), ["sample", "n", "part", "code"])
    near = pairs.where((F.col("seq") == F.col("other")) | (distance_of("seq", "other") <= 1)).select("stack").distinct().withColumn("lumberjack", F.lit(True))
    return piles.join(near.hint("merge"), "stack", "left").withColumn("lumberjack", F.coalesce("lumberjack", F.lit(False)))


def loci(piles: DataFrame, distance: int = 2, length: int = 64, most: int = 3) -> DataFrame:
    """(stack, sample, locus, blacklisted): connected piles of a sample within the distance make a locus (least stack's number); those of more than `most` piles are blacklisted."""
    pairs = similar_pairs(piles.withColumnRenamed("stack", "id"), distance, length, ["sample"])
    roots = graphs.components(pairs.select("a", "b"))
    s = piles.join(roots.hint("merge"), piles["stack"] == roots["v"], "left").withColumn("locus", F.coalesce("root", "stack"))
    size = s.groupBy("locus").agg((F.count("*") > most).alias("blacklisted"))
    return s.join(size.hint("merge"), "locus").select("stack", "sample", "locus", "blacklisted")


def _tree(limit: int):
    def run(t: pd.DataFrame) -> pd.DataFrame:
        tree = graphs.spanning_tree(list(zip(t["a"].tolist(), t["b"].tolist(), t["dist"].tolist(), strict=True)))
        rows = [(int(t["locus"].iloc[0]), int(a), int(b), int(w), w > limit) for a, b, w in tree]
        return pd.DataFrame(rows, columns=["locus", "a", "b", "dist", "cut"])

    return run


def spanning_trees(pairs: DataFrame, limit: int = 1) -> DataFrame:
    """pairs (locus, a, b, dist) -> a minimum spanning tree of each locus; edges longer than `limit` are marked to be cut."""
    return pairs.groupBy("locus").applyInPandas(_tree(limit), "locus long, a long, b long, dist int, cut boolean")


def secondary_matches(primary: DataFrame, secondary: DataFrame, distance: int = 4) -> DataFrame:
    """(read, stack, dist): secondary reads of a sample joined with the nearest primary stack within the distance, if only one is nearest.

    Both sides are cut into distance + 1 parts, of which one is shared."""
    parts = distance + 1
    cut = lambda p: F.floor(F.length("seq") * p / parts).cast("int")
    keyed = lambda d, name: d.select("sample", F.col(name), "seq", F.length("seq").alias("n"), F.posexplode(F.array(*[F.xxhash64(F.substring("seq", cut(p) + 1, cut(p + 1) - cut(p))) for p in range(parts)])).alias("part", "code"))
    s, p = keyed(secondary, "read"), keyed(primary, "stack").withColumnRenamed("seq", "other")
    found = s.join(p, ["sample", "n", "part", "code"]).select("sample", "read", "stack", "seq", "other").distinct().withColumn("dist", distance_of("seq", "other")).where(F.col("dist") <= distance)
    least = Window.partitionBy("sample", "read")
    best = found.withColumn("least", F.min("dist").over(least)).where("dist = least").withColumn("ties", F.count("*").over(least))
    return best.where("ties = 1").select("sample", "read", "stack", "dist")


def locus_snps(members: DataFrame, critical: float = 3.84) -> DataFrame:
    """members (locus, seq, depth) -> (locus, col, type, lratio, rank_1, rank_2): the multinomial call of every column."""
    b = dealt(members.select("locus", "depth", "seq"), "locus").select("locus", "depth", F.posexplode(F.split("seq", "")).alias("col", "b")).where("b in ('A', 'C', 'G', 'T')").groupBy("locus", "col", "b").agg(F.sum("depth").alias("c"))
    ranked = b.groupBy("locus", "col").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("m"), "b"))).alias("r"), F.sum("c").alias("n"))
    c = lambda i: F.coalesce(-F.get("r", F.lit(i))["m"], F.lit(0))
    n, xl = F.col("n"), lambda x, p: F.when(x > 0, x * F.ln(p)).otherwise(0.0)
    lr = 2 * (xl(c(0), c(0) / n) + xl(n - c(0), (n - c(0)) / (3 * n)) - xl(c(0) + c(1), (c(0) + c(1)) / (2 * n)) - xl(n - c(0) - c(1), (n - c(0) - c(1)) / (2 * n)))
    t = ranked.withColumn("lratio", lr)
    return t.select("locus", "col", F.when(lr <= -critical, "E").when(lr >= critical, "O").otherwise("U").alias("type"), "lratio", F.get("r", F.lit(0))["b"].alias("rank_1"), F.get("r", F.lit(1))["b"].alias("rank_2"))


def locus_alleles(members: DataFrame, snps: DataFrame) -> DataFrame:
    """(locus, haplotype, count): the reads' bases at heterozygous columns; a read counts if each is one of the two commonest there."""
    het = snps.where("type = 'E'").groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("col", "rank_1", "rank_2"))).alias("s"))
    m = dealt(members, "locus").join(het.hint("merge"), "locus").withColumn("bases", F.transform("s", lambda x: F.col("seq").substr(x["col"] + 1, F.lit(1))))
    ok = F.forall(F.arrays_zip("s", "bases"), lambda z: (z["bases"] == z["s"]["rank_1"]) | (z["bases"] == z["s"]["rank_2"]))
    return m.where(ok).groupBy("locus", F.array_join("bases", "").alias("haplotype")).agg(F.sum("depth").alias("count"))


# ---------------------------------------------------------------- gapped alignment


def gapped_candidates(a: DataFrame, b: DataFrame, k: int = 15) -> DataFrame:
    """(id, other, hits): for each sequence of a (id, seq) those of b (other, seq) that share the most distinct k-mers, all that tie."""
    hits = distinct_kmers(a, k, ["id"]).join(distinct_kmers(b, k, ["other"]).hint("merge"), "code").where("id <> other").groupBy("id", "other").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("id")
    return hits.withColumn("most", F.max("hits").over(w)).where("hits = most").select("id", "other", "hits")


def with_sequences(candidates: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """candidates (id, other) of a (id, seq) and b (other, seq) with their sequences sb and sa, by sorted joins."""
    return candidates.join(a.withColumnRenamed("seq", "sb").hint("merge"), "id").join(b.withColumnRenamed("seq", "sa").hint("merge"), "other")


def aligned_pairs(pairs: DataFrame, max_gaps: int = 2, min_identity: float = 0.8) -> DataFrame:
    """pairs (id, other, sa, sb) -> (id, other, cigar, gaps, identity, dist) of global alignments with few gaps and enough agreement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, o, x, y in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("id", "other", "sa", "sb")), strict=True):
                _, c, _, _ = alignment.align(x, y)
                share, gaps = alignment.identity(x, y, c)
                if gaps <= max_gaps + 1 and share >= min_identity:
                    out.append((i, o, cigar.text(c), gaps, share, cigar.mismatches(y, x, c)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=["id", "other", "cigar", "gaps", "identity", "dist"])

    return dealt(pairs.select("id", "other", "sa", "sb")).mapInArrow(run, "id long, other long, cigar string, gaps int, identity double, dist int")


def best_alignments(aligned: DataFrame) -> DataFrame:
    """The best alignment of each id: fewest gaps, then most agreement; none where two tie."""
    w = Window.partitionBy("id").orderBy("gaps", F.desc("identity"))
    ranked = aligned.withColumn("r", F.rank().over(w)).where("r = 1").withColumn("ties", F.count("*").over(Window.partitionBy("id")))
    return ranked.where("ties = 1").drop("r", "ties")


def mutual_best(best: DataFrame) -> DataFrame:
    """Pairs that are each other's best alignment."""
    back = best.select(F.col("id").alias("other"), F.col("other").alias("id"))
    return best.join(back, ["id", "other"]).where("id < other")


# ---------------------------------------------------------------- catalog


def allele_strings(loci_: DataFrame) -> DataFrame:
    """loci (locus, consensus, cols, alleles: array of haplotypes) -> (locus, allele, seq): the consensus with each haplotype put in; the consensus itself for loci without."""
    from ..functions.columns import with_bases

    none = F.coalesce(F.size("alleles"), F.lit(0)) < 1
    e = loci_.select("locus", "consensus", "cols", F.explode(F.when(none, F.array(F.lit(""))).otherwise(F.col("alleles"))).alias("allele"))
    return e.select("locus", F.when(F.col("allele") == "", "consensus").otherwise(F.col("allele")).alias("allele"), F.when(F.col("allele") == "", F.col("consensus")).otherwise(with_bases(F.col("consensus"), F.col("cols"), F.col("allele"))).alias("seq"))


def exact_matches(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """samples (sample, locus, allele, seq, depth) joined with the catalog's allele strings (catalog, allele, seq): (catalog, sample, locus, allele, depth); loci that match two catalog loci are left out."""
    m = samples.join(catalog.select(F.col("locus").alias("catalog"), F.col("seq").alias("seq")), "seq").select("catalog", "sample", "locus", "allele", "depth").distinct()
    n = F.size(F.collect_set("catalog").over(Window.partitionBy("sample", "locus")))
    return m.withColumn("_n", n).where("_n = 1").drop("_n")


def one_to_one(matches: DataFrame) -> DataFrame:
    """Matches of sample loci and catalog loci that have no other partner within the sample."""
    a = F.size(F.collect_set("catalog").over(Window.partitionBy("sample", "locus")))
    b = F.size(F.collect_set("locus").over(Window.partitionBy("sample", "catalog")))
    return matches.withColumn("_a", a).withColumn("_b", b).where("_a = 1 and _b = 1").drop("_a", "_b")


def merged_snps(a: list[tuple[int, str, str]], b: list[tuple[int, str, str]], con_a: str, con_b: str) -> list[tuple[int, list[str]]]:
    """SNPs (col, rank_1, rank_2) of two loci by column, with up to four bases; columns where the consensus differ and neither is N become SNPs."""
    bases: dict[int, list[str]] = {}
    own = [(c, x) for c, *r in a for x in r if x] + [(c, x) for c, *r in b for x in r if x]
    own += [(i, z) for i, (x, y) in enumerate(zip(con_a, con_b, strict=False)) if x != y and "N" not in (x, y) for z in (x, y)]
    for c, x in sorted(own, key=lambda t: t[0]):
        if x not in bases.setdefault(c, []):
            bases[c].append(x)
    return sorted(bases.items())


def expanded_alleles(haplotypes: list[str], cols: list[int], merged_cols: list[int], consensus: str) -> list[str]:
    """A side's haplotypes over the merged columns: its own bases, and its consensus elsewhere (N past the end)."""
    at = {c: i for i, c in enumerate(cols)}
    base = lambda h, c: h[at[c]] if c in at and h else consensus[c] if c < len(consensus) else "N"
    return sorted({"".join(base(h, c) for c in merged_cols) for h in haplotypes or [""]})


# ---------------------------------------------------------------- contigs


def _contig(k: int, least: int):
    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq")
        return pd.DataFrame([(int(t["locus"].iloc[0]), len(t), graphs.contig(t["seq"].tolist(), k, least))], columns=["locus", "reads", "contig"])

    return run


def contigs(reads: DataFrame, k: int = 21, least: int = 2) -> DataFrame:
    """reads (locus, seq) -> (locus, reads, contig): the heaviest path of each locus' graph; null where it has cycles or nothing. A task holds a locus' reads."""
    return reads.select("locus", "seq").where("seq is not null").groupBy("locus").applyInPandas(_contig(k, least), "locus long, reads long, contig string")


# ---------------------------------------------------------------- phasing


def phase_sets(reads: list[dict[int, str]], het: dict[int, tuple[str, str]], least: int = 1) -> list[dict[int, tuple[str, str]]] | None:
    """A sample's phase sets at a locus: SNPs (col -> its two bases) joined where reads show which bases go together; None if they contradict each other.

    A pair of bases counts from `least` reads on; two SNPs must come in exactly two complementary pairs to be joined.
    """
    seen: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
    for r in reads:
        own = [(c, het[c].index(b)) for c, b in sorted(r.items()) if c in het and b in het[c]]
        for i, (c, x) in enumerate(own):
            for d, y in own[i + 1 :]:
                n = seen.setdefault((c, d), {})
                n[x, y] = n.get((x, y), 0) + 1
    root = {c: (c, 0) for c in het}  # parent and whether its bases are swapped

    def find(c):
        swap = 0
        while root[c][0] != c:
            c, swap = root[c][0], swap ^ root[c][1]
        return c, swap

    for (c, d), pairs in sorted(seen.items()):
        kinds = {x ^ y for (x, y), n in pairs.items() if n >= least}
        if len(kinds) > 1:
            return None
        if kinds:
            k = kinds.pop()
            (a, s), (b, t) = find(c), find(d)
            if a == b:
                if s ^ t != k:
                    return None
            else:
                root[max(a, b)] = (min(a, b), s ^ t ^ k)
    sets: dict[int, dict[int, tuple[str, str]]] = {}
    for c in sorted(het):
        a, s = find(c)
        sets.setdefault(a, {})[c] = het[c][::-1] if s else het[c]
    return sorted(sets.values(), key=lambda x: (-len(x), min(x)))


def _phase_of(rows: list[tuple], least: float) -> tuple[str, str, str, str]:
    """(status, cols, h1, h2) of a sample's rows (read, col, base, a1, a2) at a locus."""
    het = {c: (a, b) for _, c, _, a, b in rows if a and b and a != b}
    by: dict[int, dict[int, str]] = {}
    for r, c, b, _, _ in rows:
        if b:
            by.setdefault(r, {})[c] = b
    sets = phase_sets(list(by.values()), het, least) if het else [{}]
    best = sets[0] if sets else {}
    h1, h2 = ("".join(best[c][i] for c in sorted(best)) for i in (0, 1))
    status = "no_hets" if not het else "inconsistent" if sets is None else "phased" if len(best) == len(het) else "partly"
    return status, ",".join(map(str, sorted(best))), *sorted((h1, h2))


def _phase(least: float):
    keys = ("locus", "sample")
    names = ("read", "col", "base", "a1", "a2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[str, str, str, str]] = {}  # many samples have the same genotypes and reads

        def done(t: pa.Table) -> pa.RecordBatch:
            locus, sample = (t.column(k).to_numpy() for k in keys)
            first = np.flatnonzero(np.append(True, (locus[1:] != locus[:-1]) | (sample[1:] != sample[:-1])))
            rows = list(zip(*(t.column(n).to_pylist() for n in names), strict=True))
            out = []
            for x, y in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
                own = tuple(rows[x:y])
                if own not in known:
                    if len(known) > 1 << 14:
                        known.clear()
                    known[own] = _phase_of(own, least)
                out.append(known[own])
            return pa.RecordBatch.from_arrays([pa.array(locus[first]), pa.array(sample[first]), *(pa.array([r[j] for r in out], pa.string()) for j in range(4))], names=[*keys, "status", "cols", "h1", "h2"])

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not t.num_rows:
                continue
            locus, sample = (t.column(k).to_numpy() for k in keys)
            last = np.flatnonzero((locus != locus[-1]) | (sample != sample[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield done(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    return run


def phased(bases: DataFrame, least: int = 1) -> DataFrame:
    """bases (locus, sample, read, col, base, a1, a2): a read's base at a site and the sample's genotype there -> (locus, sample, status, cols, h1, h2): the largest phase set's haplotypes.
    Rows are sorted, and a task reads one sample's locus after another from its batches."""
    b = bases.select(F.col("locus").cast("long").alias("locus"), F.col("sample").cast("int").alias("sample"), F.col("read").cast("long").alias("read"), F.col("col").cast("int").alias("col"), "base", "a1", "a2")
    b = dealt(b, "locus", "sample").sortWithinPartitions("locus", "sample", "read", "col")
    return b.mapInArrow(_phase(least), "locus long, sample int, status string, cols string, h1 string, h2 string")
