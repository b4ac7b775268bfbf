"""Readers of sequence, alignment, variant and locus files as frames.

Files are read by spark.read, so any path Spark reads will do, and .gz files are unpacked on the way (one task a file).
`lines` gives (file, block, line, value): the block is a split of the file, the line counts from 0 over the whole file, from the
lines of each split and a small table of their numbers. The parsers take such frames, whatever they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bam as split_bam

# ---------------------------------------------------------------- lines


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line of the files, without its end (CR included)."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("value")
    )
    split = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))  # a row a split
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    split = split.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return raw.join(F.broadcast(split), ["file", "block"]).select("file", "block", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def rows(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A tab-separated file with # comments; empty and missing fields are null, and what is no number where one is due an error."""
    fields = T.StructType.fromDDL(schema).fields
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    text = spark.read.text(path).where("value <> '' and value not like '#%'")
    return text.select(*[F.nullif(F.get(cells, F.lit(i)), F.lit("")).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def require(ok: Column, value: Column, message: str) -> Column:
    """value, or an error where the check does not hold."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(value.cast("string"), F.lit("null")))))


# ---------------------------------------------------------------- reads


def fastq(text: DataFrame) -> DataFrame:
    """(file, read, name, comment, seq, qual) of records of four lines. Raises on records that don't begin with @ and +, or whose
    qualities are not as many as the bases."""
    at = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value"))).alias(f"l{i}")
    r = text.where("not (line % 4 = 0 and value = '')").groupBy("file", F.expr("line div 4").alias("read")).agg(*(at(i) for i in range(4)))
    name = require(F.col("l0").startswith("@"), F.col("l0"), "not a FASTQ name")
    seq = require(F.col("l2").startswith("+") & (F.length("l1") == F.length(F.coalesce("l3", F.lit("")))), F.coalesce(F.col("l1"), F.lit("")), "not a FASTQ record")
    return r.select("file", "read", F.regexp_extract(name, r"^@(\S*)", 1).alias("name"), F.regexp_extract(name, r"^@\S*\s+(.*)$", 1).alias("comment"), seq.alias("seq"), F.coalesce("l3", F.lit("")).alias("qual"))


def fasta(text: DataFrame) -> DataFrame:
    """(file, read, name, comment, seq) of records of a > line and any number of sequence lines; read is the > line's number."""
    mark = F.when(F.col("value").startswith(">"), F.col("line"))
    within = Window.partitionBy("file", "block").orderBy("line")
    last = text.groupBy("file", "block").agg(F.max(mark).alias("last"))  # a row a split
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("file", "block", F.max("last").over(before).alias("carried"))
    t = text.withColumn("own", F.max(mark).over(within)).join(F.broadcast(last), ["file", "block"])
    t = t.withColumn("read", F.coalesce("own", "carried")).where("read is not null or trim(value) <> ''")
    head, body = F.max(F.when(F.col("value").startswith(">"), F.col("value"))), F.array_sort(F.collect_list(F.when(~F.col("value").startswith(">"), F.struct("line", F.trim("value").alias("s")))))
    g = t.groupBy("file", "read").agg(head.alias("head"), F.array_join(F.transform(body, lambda x: x["s"]), "").alias("seq"))
    name = require(F.col("read").isNotNull(), F.col("head"), "sequence before the first name")
    return g.select("file", "read", F.regexp_extract(name, r"^>(\S*)", 1).alias("name"), F.regexp_extract(name, r"^>\S*\s+(.*)$", 1).alias("comment"), "seq")


def bustard(spark: SparkSession, path) -> DataFrame:
    """Instrument TSV of eleven columns; dots are uncalled bases."""
    raw = rows(spark, path, "machine string, run string, lane int, tile int, x int, y int, idx string, read int, seq string, qual string, filter int")
    return raw.withColumn("seq", F.translate("seq", ".", "N"))


def read_table(spark: SparkSession, path) -> DataFrame:
    return rows(spark, path, "id string, chr string, bp long, strand string, seq string")


# ---------------------------------------------------------------- alignments


def sam(text: DataFrame) -> DataFrame:
    """Alignment lines: the eleven columns, and from flags and CIGAR the strand, mapped/secondary/supplementary, the bases clipped at the read's
    5' end, the share clipped, and the 0-based place of that end."""
    cols = F.split("value", "\t")
    c = [F.get(cols, F.lit(i)) for i in range(11)]
    t = text.where(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        "file", "line", c[0].alias("name"), c[1].cast("int").alias("flag"), c[2].alias("chr"), (c[3].cast("long") - 1).alias("pos"), c[4].cast("int").alias("mapq"), c[5].alias("cigar"),
        c[6].alias("mate_chr"), (c[7].cast("long") - 1).alias("mate_pos"), c[8].cast("int").alias("insert_"), c[9].alias("seq"), c[10].alias("qual"), F.slice(cols, 12, 1 << 20).alias("tags"),
    )
    return aligned(t)


def _sum(kinds: str) -> Column:
    return F.aggregate(F.regexp_extract_all("cigar", F.lit(rf"([0-9]+)[{kinds}]"), F.lit(1)), F.lit(0), lambda s, x: s + x.cast("int"))


def aligned(t: DataFrame) -> DataFrame:
    """The derived columns of alignments (flag, pos, cigar, seq)."""
    bit = lambda b: (F.col("flag").bitwiseAND(b) != 0)
    clip = lambda p: F.coalesce(F.regexp_extract("cigar", p, 1).try_cast("int"), F.lit(0))
    t = t.withColumn("strand", F.when(bit(16), "-").otherwise("+")).withColumn("mapped", ~bit(4)).withColumn("secondary", bit(256)).withColumn("supplementary", bit(2048))
    t = t.withColumn("ref_length", _sum("M=XDN")).withColumn("clipped5", F.when(bit(16), clip(r"([0-9]+)S$")).otherwise(clip(r"^([0-9]+)S")))
    t = t.withColumn("clipped_share", F.when(F.length("seq") > 0, _sum("S") / F.length("seq")).otherwise(0.0))
    return t.withColumn("pos5", F.when(bit(16), F.col("pos") + F.col("ref_length") - 1).otherwise(F.col("pos")))


def usable_alignments(t: DataFrame, min_mapq: int = 10, max_clipped: float = 0.2) -> DataFrame:
    """Primary alignments of enough quality, no clipping at the 5' end, and little elsewhere."""
    return t.where("mapped and not secondary and not supplementary").where((F.col("mapq") >= min_mapq) & (F.col("clipped5") == 0) & (F.col("clipped_share") <= max_clipped))


def bam(spark: SparkSession, path) -> DataFrame:
    """Alignments of BAM files, each read by as many tasks as it has splits."""
    return aligned(split_bam.records(spark, path))


def sorted_alignments(t: DataFrame) -> DataFrame:
    """Raises if a file's mapped records are not ordered by place within each chromosome's run. Records are compared with those before within their split (block), and
    splits by their first and last records."""
    own = ["file", *(["block"] if "block" in t.columns else [])]
    before = Window.partitionBy(*own).orderBy("line")
    last = lambda c: F.lag(c).over(before)
    fine = lambda chr_, pos, chr0, pos0: (pos < 0) | (pos0 < 0) | (chr_ != chr0) | (pos >= pos0)
    t = t.withColumn("pos", require(F.coalesce(fine(F.col("chr"), F.col("pos"), last("chr"), last("pos")), F.lit(True)), F.col("pos"), "unsorted alignments"))
    if len(own) == 1:
        return t
    ends = t.groupBy(*own).agg(F.min_by(F.struct("chr", "pos"), "line").alias("first"), F.max_by(F.struct("chr", "pos"), "line").alias("last"))  # a row a split
    prior = F.lag("last").over(Window.partitionBy("file").orderBy("block"))
    ends = ends.withColumn("prior", prior).withColumn("whole", F.coalesce(fine(F.col("first.chr"), F.col("first.pos"), F.col("prior.chr"), F.col("prior.pos")), F.lit(True)))
    t = t.join(F.broadcast(ends.select(*own, "whole")), own)
    return t.withColumn("pos", require(F.col("whole"), F.col("pos"), "unsorted alignments")).drop("whole")


def merged_alignments(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The sorted files of samples (by name) as one frame in order of place: ranges of chromosomes and places are dealt to tasks and sorted there, so that a locus' records
    of all samples are together."""
    out = None
    for sample, path in sorted(paths.items()):
        own = sorted_alignments(bam(spark, path)).where("mapped").withColumn("sample", F.lit(sample))
        out = own if out is None else out.unionByName(own)
    return out.repartitionByRange("chr", "pos5", "strand").sortWithinPartitions("chr", "pos5", "strand", "sample", "line")


def unaligned(t: DataFrame) -> DataFrame:
    """Reads from alignment records, as the machine gave them: (file, name, mate, seq, qual)."""
    back = F.col("strand") == "-"
    flip = lambda s: F.reverse(F.translate(s, "ACGT", "TGCA"))
    mate = F.when(F.col("flag").bitwiseAND(128) != 0, 2).when(F.col("flag").bitwiseAND(64) != 0, 1).otherwise(0)
    return t.where("not secondary and not supplementary").select("file", "name", mate.alias("mate"), F.when(back, flip(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def bowtie(spark: SparkSession, path) -> DataFrame:
    """Legacy alignments, 0-based: on the reverse strand the place is the read's 5' end."""
    raw = rows(spark, path, "name string, strand string, chr string, pos long, seq string, qual string, other int, mismatches string")
    return raw.withColumn("pos5", F.when(F.col("strand") == "-", F.col("pos") + F.length("seq") - 1).otherwise(F.col("pos")))


def loci_by_start(t: DataFrame) -> DataFrame:
    """Loci from alignments to a reference: forward reads that start at one place and strand, (chr, pos5, strand, reads)."""
    return t.where("mapped").groupBy("chr", "pos5", "strand").agg(F.count("*").alias("reads"), F.array_sort(F.collect_list("name")).alias("names"))


def mates_within(t: DataFrame, max_insert: int = 1000) -> DataFrame:
    """Pairs of first and second reads by name, on one chromosome, facing each other within an insert of at most max_insert: (name, chr, pos5, insert_)."""
    a = t.where("mapped and flag & 128 = 0").select("name", "chr", "pos5", "strand")
    b = t.where("mapped and flag & 128 <> 0").select("name", F.col("chr").alias("chr2"), F.col("pos5").alias("end"), F.col("strand").alias("strand2"))
    p = a.join(b, "name").where("chr = chr2 and strand <> strand2")
    p = p.withColumn("insert_", F.when(F.col("strand") == "+", F.col("end") - F.col("pos5")).otherwise(F.col("pos5") - F.col("end")) + 1)
    return p.where((F.col("insert_") > 0) & (F.col("insert_") <= max_insert)).select("name", "chr", "pos5", "strand", "insert_")


# ---------------------------------------------------------------- variants


def vcf_header(text: DataFrame) -> DataFrame:
    """(file, meta, samples): the ## lines, and the names after FORMAT."""
    h = text.where(F.col("value").startswith("#"))
    names = F.max(F.when(F.col("value").startswith("#CHROM"), F.slice(F.split("value", "\t"), 10, 1 << 20)))
    meta = F.transform(F.array_sort(F.collect_list(F.when(F.col("value").startswith("##"), F.struct("line", "value")))), lambda x: F.substring(x["value"], 3, 1 << 20))
    return h.groupBy("file").agg(meta.alias("meta"), names.alias("samples"))


def vcf_sites(text: DataFrame) -> DataFrame:
    """(file, line, chrom, pos 0-based, id, ref, alt, alleles, qual, filter, info, format, calls) of record lines."""
    cols = F.split("value", "\t")
    c = [F.get(cols, F.lit(i)) for i in range(8)]
    t = text.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        "file", "line", c[0].alias("chrom"), (c[1].cast("long") - 1).alias("pos"), c[2].alias("id"), F.upper(c[3]).alias("ref"), F.upper(c[4]).alias("alt"), c[5].alias("qual"), c[6].alias("filter"),
        c[7].alias("info"), F.get(cols, F.lit(8)).alias("format"), F.slice(cols, 10, 1 << 20).alias("calls"),
    )
    return t.withColumn("alleles", F.when(F.col("alt") == ".", F.array("ref")).otherwise(F.concat(F.array("ref"), F.split("alt", ","))))


def vcf_calls(text: DataFrame) -> DataFrame:
    """A row a site and sample: the site's columns, sample, a1, a2 (letters; null uncalled), gt, dp, gq, ad, gl (natural logarithms), ps."""
    sites = vcf_sites(text).join(F.broadcast(vcf_header(text).select("file", "samples")), "file")  # a row a file
    t = sites.select("*", F.posexplode("calls").alias("i", "call")).withColumn("sample", F.get("samples", F.col("i")))
    keys, values = F.split("format", ":"), F.split("call", ":")
    field = lambda k: F.get(values, F.array_position(keys, k).cast("int") - 1)
    known = lambda k: F.when((F.array_position(keys, k) > 0) & (field(k) != "."), field(k))
    t = t.withColumn("gt", F.coalesce(known("GT"), F.lit("./."))).withColumn("dp", known("DP").cast("int")).withColumn("gq", known("GQ").cast("int")).withColumn("ps", known("PS"))
    t = t.withColumn("ad", F.transform(F.split(known("AD"), ","), lambda x: x.cast("int"))).withColumn("gl", F.transform(F.split(known("GL"), ","), lambda x: x.cast("double") * F.ln(F.lit(10.0))))
    allele = lambda i: F.get("alleles", F.regexp_extract("gt", r"^([0-9]+)[/|]([0-9]+)$", i).try_cast("int"))
    return t.withColumn("a1", allele(1)).withColumn("a2", allele(2)).drop("calls", "call", "samples", "i")


def is_snp_site() -> Column:
    return (F.size("alleles") >= 2) & F.forall("alleles", lambda a: F.length(a) == 1)


def external_loci(text: DataFrame) -> DataFrame:
    """Single-base variants that passed their filter, up to four alleles, as loci of one base (locus numbered by file and line); genotypes with the allele * are dropped."""
    t = vcf_calls(text).where(is_snp_site() & F.col("filter").isin(".", "PASS") & (F.size("alleles") <= 4))
    ok = (F.col("a1") != "*") & (F.col("a2") != "*")
    return t.select("file", F.col("line").alias("locus"), "chrom", "pos", F.lit(0).alias("col"), "sample", F.when(ok, F.col("a1")).alias("a1"), F.when(ok, F.col("a2")).alias("a2"), "dp", "gq")


def locus_variants(text: DataFrame) -> DataFrame:
    """Rows of a locus together: (chrom, sites)."""
    return vcf_sites(text).groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "alt", "filter"))).alias("sites"))


def locus_genotypes(text: DataFrame, loci: DataFrame) -> DataFrame:
    """Genotypes joined with their locus' sequence (loci: fasta()). Heterozygotes without a phase set count as missing."""
    calls = vcf_calls(text)
    unphased = (F.col("a1") != F.col("a2")) & F.col("ps").isNull() & F.array_contains(F.split("format", ":"), "PS")
    calls = calls.withColumn("_known", ~F.coalesce(unphased, F.lit(False)))
    calls = calls.withColumn("a1", F.when(F.col("_known"), F.col("a1"))).withColumn("a2", F.when(F.col("_known"), F.col("a2"))).drop("_known")
    return calls.join(loci.select(F.col("name").alias("chrom"), F.col("seq").alias("consensus"), F.col("comment").alias("about")), "chrom")


def haplotypes(genotypes: DataFrame) -> DataFrame:
    """(chrom, sample, h1, h2, depths) of a locus: its sites' alleles in order, N where uncalled."""
    site = F.struct("pos", F.coalesce("a1", F.lit("N")).alias("a1"), F.coalesce("a2", F.lit("N")).alias("a2"), "dp")
    g = genotypes.groupBy("chrom", "sample").agg(F.array_sort(F.collect_list(site)).alias("s"))
    return g.select("chrom", "sample", F.array_join("s.a1", "").alias("h1"), F.array_join("s.a2", "").alias("h2"), F.col("s.dp").alias("depths"))


# ---------------------------------------------------------------- loci of samples

# Columns of the locus tables.
TAGS = "sample long, locus long, kind string, component int, read string, seq string, deleveraged int, blacklisted int, lumberjack int"
SNPS = "sample long, locus long, col int, type string, lratio double, rank_1 string, rank_2 string, rank_3 string, rank_4 string"
ALLELES = "sample long, locus long, haplotype string, pct double, count int"
MATCHES = "catalog long, sample long, locus long, haplotype string, depth int, cigar string"


def tags(spark: SparkSession, path) -> DataFrame:
    return rows(spark, path, TAGS)


def snps(spark: SparkSession, path) -> DataFrame:
    return rows(spark, path, SNPS)


def alleles(spark: SparkSession, path) -> DataFrame:
    return rows(spark, path, ALLELES)


def matches(spark: SparkSession, path) -> DataFrame:
    return rows(spark, path, MATCHES)


def models(tag_rows: DataFrame) -> DataFrame:
    """The model strings alone: (sample, locus, model)."""
    return tag_rows.where("kind = 'model'").select("sample", "locus", F.col("seq").alias("model"))


def loci(tag_rows: DataFrame, snp_rows: DataFrame, allele_rows: DataFrame, all_calls: bool = False) -> DataFrame:
    """(sample, locus, consensus, model, depth, snps, alleles): blacklisted loci left out; of SNP rows the heterozygous ones, or all."""
    key = ["sample", "locus"]
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("seq"))).alias(k)
    t = tag_rows.groupBy(*key).agg(pick("consensus"), pick("model"), F.sum(F.col("kind").isin("primary", "secondary").cast("int")).alias("depth"), F.max("blacklisted").alias("bad")).where("coalesce(bad, 0) = 0").drop("bad")
    s = (snp_rows if all_calls else snp_rows.where("type = 'E'")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("col", "type", "lratio", "rank_1", "rank_2"))).alias("snps"))
    a = allele_rows.where("haplotype is not null").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("haplotype", "count"))).alias("alleles"))
    return t.join(s, key, "left").join(a, key, "left")


# ---------------------------------------------------------------- lists


def population_map(spark: SparkSession, path) -> DataFrame:
    """(sample, pop, grp, place): group `defaultgrp` where none is given. Raises if a population is in two groups."""
    raw = rows(spark, path, "sample string, pop string, grp string").withColumn("grp", F.coalesce("grp", F.lit("defaultgrp")))
    one = F.size(F.collect_set("grp").over(Window.partitionBy("pop"))) == 1
    return raw.withColumn("grp", require(one, F.col("grp"), "population in two groups")).withColumn("place", F.row_number().over(Window.orderBy("pop", "sample")) - 1)  # a row a sample


def default_population(samples: DataFrame) -> DataFrame:
    return samples.select("sample", F.lit("defaultpop").alias("pop"), F.lit("defaultgrp").alias("grp"))


def samples_in(spark: SparkSession, folder: str) -> DataFrame:
    """Samples by the <sample>.tags.tsv[.gz] files of a folder; the catalog's file is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tags.tsv*").load(folder).select(F.regexp_extract("path", r"([^/]+)\.tags\.tsv(\.gz)?$", 1).alias("sample"))
    return files.where("sample <> '' and sample not rlike '(^|[.])catalog$'").distinct()


def barcodes(spark: SparkSession, path) -> DataFrame:
    """(barcode, barcode2, sample) of one to three columns: barcode; barcode and name; or two barcodes and name. Raises on other
    letters than ACGT, and on barcodes or second barcodes of a file where some have one and others none."""
    raw = rows(spark, path, "c1 string, c2 string, c3 string")
    dna = lambda c: F.col(c).rlike("^[ACGTacgt]+$")
    two = F.col("c3").isNotNull() | (F.col("c2").isNotNull() & dna("c2"))
    out = raw.select(F.upper(require(dna("c1"), F.col("c1"), "not a barcode")).alias("barcode"), F.upper(F.when(two, require(dna("c2"), F.col("c2"), "not a barcode"))).alias("barcode2"), F.coalesce(F.col("c3"), F.when(~two, F.col("c2")), F.concat_ws("-", "c1", F.when(two, F.col("c2")))).alias("sample"))
    n = F.count("barcode2").over(Window.partitionBy(F.lit(1)))  # a row a sample
    return out.withColumn("_n", n).withColumn("barcode", require((F.col("_n") == 0) | F.col("barcode2").isNotNull(), F.col("barcode"), "a second barcode is missing")).drop("_n")


def read_pairs(files: DataFrame) -> DataFrame:
    """(stem, first, second) of file names (path): <stem>_1. and _2., or <stem>_R1_ and _R2_; single files have no second."""
    p = r"^(.*?)(?:_R?([12])([_.]))([^/]*)$"
    f = files.withColumn("mate", F.regexp_extract("path", p, 2)).withColumn("stem", F.when(F.col("mate") == "", F.col("path")).otherwise(F.concat(F.regexp_extract("path", p, 1), F.regexp_extract("path", p, 3), F.regexp_extract("path", p, 4))))
    return f.groupBy("stem").agg(F.max(F.when(F.col("mate") != "2", F.col("path"))).alias("first"), F.max(F.when(F.col("mate") == "2", F.col("path"))).alias("second"))


def marker_list(spark: SparkSession, path) -> DataFrame:
    """(locus): a whitelist, blacklist or bootstrap list."""
    return rows(spark, path, "locus long, col int").select("locus").where("locus is not null").distinct()


def marker_columns(spark: SparkSession, path) -> DataFrame:
    """(locus, cols): columns of each locus, an empty set meaning all."""
    return rows(spark, path, "locus long, col int").groupBy("locus").agg(F.array_sort(F.collect_set("col")).alias("cols"))


def kmer_table(spark: SparkSession, path) -> DataFrame:
    return rows(spark, path, "kmer string, n long")


def corrections(spark: SparkSession, path) -> DataFrame:
    """(locus, sample, genotype) set by hand."""
    return rows(spark, path, "locus long, sample string, genotype string")


def blast_hits(spark: SparkSession, path) -> DataFrame:
    return rows(spark, path, "query string, subject string, identity double, length int, mismatches int, gaps int, q_start int, q_end int, s_start int, s_end int, evalue double, bits double")


def saved(df: DataFrame, table: str, partition: str | None = None) -> None:
    """A frame as a table of the session's catalog, for the relational surface."""
    w = df.write.mode("overwrite").format("parquet")
    (w.partitionBy(partition) if partition else w).saveAsTable(table)


# ---------------------------------------------------------------- phased haplotypes


def beagle(text: DataFrame) -> DataFrame:
    """(file, marker, sample, copy, allele) of phased markers: an I line with each sample twice, and M lines with a marker's alleles."""
    c = F.split(F.trim("value"), r"\s+")
    names = text.where(F.col("value").startswith("I ")).select("file", F.slice(c, 3, 1 << 20).alias("names"))
    t = text.where(F.col("value").startswith("M ")).select("file", c[1].alias("marker"), F.posexplode(F.slice(c, 3, 1 << 20)).alias("i", "allele")).join(F.broadcast(names), "file")  # a row a file
    return t.select("file", "marker", F.get("names", F.col("i")).alias("sample"), (F.col("i") % 2).alias("copy"), "allele")


def beagle_haplotypes(text: DataFrame) -> DataFrame:
    """(file, locus, sample, h1, h2): markers named locus_column make up a locus' haplotypes."""
    m = beagle(text).withColumn("locus", F.regexp_extract("marker", r"^(.*)_([0-9]+)$", 1)).withColumn("col", F.regexp_extract("marker", r"^(.*)_([0-9]+)$", 2).cast("int"))
    hap = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("copy") == k, F.struct("col", "allele")))), lambda x: x["allele"]), "")
    return m.groupBy("file", "locus", "sample").agg(hap(0).alias("h1"), hap(1).alias("h2"))


def fastphase(text: DataFrame) -> DataFrame:
    """(file, sample, h1, h2): between BEGIN GENOTYPES and END GENOTYPES, a name line and two lines of alleles a sample."""
    edge = text.where("trim(value) in ('BEGIN GENOTYPES', 'END GENOTYPES')").groupBy("file").agg(F.min("line").alias("a"), F.max("line").alias("b"))
    t = text.join(F.broadcast(edge), "file").where("line > a and line < b").withColumn("i", F.col("line") - F.col("a") - 1)  # a row a file
    at = lambda k: F.max(F.when(F.col("i") % 3 == k, F.trim("value")))
    g = t.groupBy("file", F.expr("i div 3").alias("n")).agg(at(0).alias("name"), at(1).alias("h1"), at(2).alias("h2"))
    return g.select("file", F.regexp_replace("name", r"^#\s*(?:id\s+)?", "").alias("sample"), F.regexp_replace("h1", r"\s+", "").alias("h1"), F.regexp_replace("h2", r"\s+", "").alias("h2"))


# ---------------------------------------------------------------- logs


def sections(text: DataFrame, name: str | None = None) -> DataFrame:
    """(file, section, line, value): the lines between BEGIN <name> and END <name> of log files, of one section or of all."""
    mark = text.where("value like 'BEGIN %' or value like 'END %'").select("file", "line", F.split("value", " ", 2)[0].alias("kind"), F.split("value", " ", 2)[1].alias("section"))
    span = mark.groupBy("file", "section").agg(F.min(F.when(F.col("kind") == "BEGIN", F.col("line"))).alias("a"), F.max(F.when(F.col("kind") == "END", F.col("line"))).alias("b"))
    span = span if name is None else span.where(F.col("section") == name)
    return text.join(F.broadcast(span), "file").where("line > a and line < b").select("file", "section", "line", "value")  # a row a section
