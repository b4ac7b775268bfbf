"""Whole runs over files and frames, step after step: what a user starts from a folder of reads, or of genotypes.

Every run takes and returns frames, so that a step's result can be written, looked at and taken up again; `save` writes
one as Parquet in a folder that all executors share.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import assembly, catalogs, cleaning, genotyping, graphs, kmers, models, popgen, populations, sinks
from .operators import linkage as ld
from .operators.populations import Filters
from .sources import formats


def save(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def load_reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(read_id, sample, name, seq, qual) of FASTQ or FASTA files, named after their files; read_id orders a file's reads."""
    frames = []
    for kind, parse in (("fast?q|fq", formats.fastq), ("fasta|fa", formats.fasta)):
        own = [p for p in paths if re.search(rf"\.({kind})(\.gz)?$", p)]
        if own:
            r = parse(formats.lines(spark, own))
            frames.append(r.select(F.regexp_extract("file", r"([^/]+?)\.(?:fastq|fq|fasta|fa)(?:\.gz)?$", 1).alias("sample"), F.col("read").cast("long").alias("read_id"), "name", "seq", F.col("qual") if "qual" in r.columns else F.lit("").alias("qual")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def process_reads(reads: DataFrame, codes: DataFrame, checks: cleaning.Checks, length: int, errors: int = 1) -> dict[str, DataFrame]:
    """Demultiplexing and cleaning: an inline barcode of `length` names the sample, and is cut off what is kept. With reads kept and discarded,
    the log by barcode, and unknown barcodes."""
    src = reads.withColumn("observed", F.substring("seq", 1, length))
    a = cleaning.demultiplex(src, codes, errors)
    named = a.join(F.broadcast(codes.select("barcode", F.col("sample").alias("_name"))), "barcode")  # a row a sample
    done = cleaning.clean(named.withColumn("sample", F.col("_name")), checks, ("read_id", "sample", "barcode"))
    kept = done.where("verdict = 'retained'").withColumn("seq", F.expr(f"substring(seq, {length + 1})")).withColumn("qual", F.expr(f"substring(qual, {length + 1})"))
    return {"retained": kept, "discards": done.where("verdict <> 'retained'"), "log": done.groupBy("barcode", "verdict").count(), "unknown": cleaning.unknown_barcodes(a)}


def clone_filter(reads: DataFrame) -> DataFrame:
    """The first read of each sample and sequence."""
    return reads.groupBy("sample", "seq").agg(F.min_by(F.struct("read_id", "qual"), "read_id").alias("r"), F.count("*").alias("clones")).select("r.read_id", "sample", "seq", "r.qual", "clones")


def kmer_filter(reads: DataFrame, k: int = kmers.K, rare: bool = True, abundant: bool = True, **limits) -> DataFrame:
    out = reads
    if rare:
        out = out.join(kmers.rare_filter(reads, k).select("read_id"), "read_id", "left_semi")
    if abundant:
        out = out.join(kmers.abundant_filter(reads, k, **limits).select("read_id"), "read_id", "left_semi")
    return out


def assemble(reads: DataFrame, depth: int = 3, distance: int = 2, secondary: int | None = None, most: int = 3) -> dict[str, DataFrame]:
    """Loci of each sample: identical reads make piles, near piles loci, other reads join their only nearest stack; with consensus, SNPs and alleles."""
    length = int(reads.agg(F.max(F.length("seq"))).first()[0] or 0)
    g = reads.groupBy("sample", "seq").agg(F.count("*").alias("depth"), F.shiftrightunsigned(F.xxhash64("sample", "seq"), 2).alias("stack"))
    primary, rest = g.where(F.col("depth") >= depth), g.where(F.col("depth") < depth).withColumnRenamed("stack", "read")
    primary = assembly.lumberjack(primary).where("not lumberjack").drop("lumberjack")
    loci = assembly.loci(primary, distance, length, most).where("not blacklisted")
    members = primary.join(loci.select("stack", "locus"), "stack")
    extra = assembly.secondary_matches(primary, rest, secondary if secondary is not None else distance + 2)
    extra = rest.join(extra.select("read", "stack"), "read").join(loci.select("stack", "locus"), "stack").select("sample", "locus", "seq", "depth")
    every = members.select("sample", "locus", "seq", "depth").unionByName(extra)
    return {"members": every, "loci": catalogs.loci_of(every, alleles_from=members)}


def catalog(loci: DataFrame, distance: int = 1, gapped_k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A sample's loci (as `assemble` makes them) -> the catalog and its sources (catalog, sample, locus), samples in order."""
    length = int(loci.agg(F.max(F.length("consensus"))).first()[0] or 0)
    return catalogs.build(loci, distance, length, gapped_k)


def match(loci: DataFrame, known: DataFrame, gapped_k: int | None = None) -> DataFrame:
    """Loci of samples, in the catalog or not, matched to it: (catalog, sample, locus, haplotype, depth, cigar) of verified haplotypes."""
    return catalogs.matches(loci, known, gapped_k)


def by_locus(members: DataFrame, matched: DataFrame) -> DataFrame:
    """Reads of all samples by catalog locus: (locus, sample, seq, depth); only one-to-one matches."""
    m = assembly.one_to_one(matched.select("sample", "locus", "catalog").distinct())
    return members.join(m.select("sample", "locus", "catalog"), ["sample", "locus"]).select(F.col("catalog").alias("locus"), "sample", "seq", "depth")


def genotype(reads: DataFrame, model: str = "low") -> DataFrame:
    """reads (locus, sample, seq, depth) -> genotypes of every site, by pileup of reads that begin at the same place."""
    numbers = reads.select("sample").distinct().withColumn("number", (F.dense_rank().over(Window.orderBy("sample")) - 1).cast("int"))  # a row a sample
    whole = reads.where("length(seq) > 0").select("locus", "sample", "seq", "depth", F.lit(0).alias("start"), F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"))
    depths = genotyping.pileup(whole.repartition("locus")).join(F.broadcast(numbers), "sample").drop("sample").withColumnRenamed("number", "sample")
    return models.call(depths, model)


def genotype_pairs(reads: DataFrame, folder: str | None = None, model: str = "low", **limits) -> dict[str, DataFrame]:
    """Paired reads of loci (locus, sample, read, mate, seq; mate 2 in the locus' direction, samples as numbers) -> contigs of both ends, aligned reads, calls and phases; where a folder is given also
    catalog.calls.vcf (GT:PS:FT:GQ:DP:AD:GL) and catalog.fa."""
    out = genotyping.genotype(reads, model, **limits)
    if folder:
        samples = reads.select("sample").distinct()
        sinks.write(sinks.vcf_head(samples).unionByName(sinks.called_lines(out["calls"], samples, out["phases"])), f"{folder}/catalog.calls.vcf")
        sinks.write(sinks.fasta_lines(out["contigs"], F.col("locus").cast("string"), F.col("contig"), F.col("locus"), F.lit(0).cast("long")), f"{folder}/catalog.fa")
    return out


def population_run(spark: SparkSession, calls: DataFrame, filters: Filters, folder: str | None = None) -> dict[str, DataFrame]:
    """Filters, statistics, and where a folder is given the files: genotypes as VCF, GenePop, PLINK, STRUCTURE pieces and Phylip, tables as Parquet."""
    out = populations.populations(spark, calls, filters)
    if folder:
        c = save(out["calls"], folder, "calls")
        samples = calls.select("sample").distinct()
        sinks.write(sinks.vcf_head(samples).unionByName(sinks.vcf_lines(c, samples)), f"{folder}/calls.vcf")
        sinks.write(sinks.genepop_lines(sinks.genepop(c), c), f"{folder}/genepop")
        sinks.write(sinks.plink_ped_lines(sinks.plink_ped(c)), f"{folder}/plink.ped")
        sinks.write(sinks.phylip_lines(sinks.phylip_variable(c)), f"{folder}/phylip")
        for name, df in out.items():
            if name != "calls":
                save(df, folder, name)
    return out


def linkage(spark: SparkSession, haps: DataFrame, positions: DataFrame | None = None, most: int = 500_000, least: float = 0.05) -> dict[str, DataFrame]:
    """Linkage of phased haplotypes: pairs within loci, distance buckets, four-gamete blocks; with places of the loci also intervals of D' of sites within `most`, the blocks that strong
    linkage makes, and their haplotypes by population."""
    out = {"pairs": popgen.OPS["dprime_pairs"](spark, haps=haps), "buckets": popgen.OPS["dprime_buckets"](spark, haps=haps), "blocks": populations.fgt_blocks(spark, haps)}
    if positions is not None:
        each = ld.copies(haps, positions)
        sites = graphs.written(ld.packed_sites(each, least), "sites")[0]
        told = graphs.written(ld.intervals(ld.near_pairs(sites, most)), "intervals")[0]
        found = graphs.written(ld.blocks(told, sites, most), "blocks")[0]
        out |= {"intervals": told, "strong_blocks": found, "block_haplotypes": ld.block_haplotypes(found, sites, each, most)}
    return out


def de_novo(spark: SparkSession, reads: DataFrame, popmap: DataFrame, filters: Filters, folder: str, files: bool = True) -> dict[str, DataFrame]:
    """From clean reads (read_id, sample, seq, qual) without a reference to population statistics; popmap (sample, pop). Each step is written in the folder."""
    a = assemble(reads)
    members = save(a["members"], folder, "members")
    loci = save(a["loci"], folder, "loci")
    known, sources = catalog(loci)
    save(sources, folder, "sources")
    matched = save(match(loci, save(known, folder, "catalog")), folder, "matches")
    grouped = save(by_locus(members, matched), folder, "reads_by_locus")
    calls = save(genotype(grouped), folder, "genotypes")
    names = grouped.select(F.col("sample").alias("name")).distinct().withColumn("sample", (F.dense_rank().over(Window.orderBy("name")) - 1).cast("int"))  # a row a sample
    pops = names.join(popmap.select(F.col("sample").alias("name"), "pop"), "name").select("sample", F.col("pop").cast("int").alias("pop"))
    variable = calls.where("variable").join(F.broadcast(pops), "sample").select("locus", "col", "sample", "pop", "a1", "a2", F.col("depth").cast("int").alias("dp"))
    return population_run(spark, variable, filters, folder if files else None)


__all__ = ["assemble", "by_locus", "catalog", "clone_filter", "de_novo", "genotype", "genotype_pairs", "kmer_filter", "linkage", "load_reads", "match", "population_run", "process_reads", "save"]
