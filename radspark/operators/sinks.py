"""File formats as frames of lines: (part, line, value), in order of `part` and `line`, and how to write them.

Formats with a line a sample and a column a site come in blocks of loci, so that no row holds a whole genome: `joined`
puts a sample's pieces together where one row can hold them, `write` writes a block after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import iupac, with_bases

BLOCK = 1000  # loci
# Allele codes of the formats.
GENEPOP = {"A": "01", "C": "02", "G": "03", "T": "04"}
STRUCTURE = {"A": "1", "C": "2", "G": "3", "T": "4"}


def coded(base: Column, codes: dict[str, str], missing: str) -> Column:
    out = F.when(base.isNull(), missing)
    for letter, code in codes.items():
        out = out.when(base == letter, code)
    return out.otherwise(missing)


def write(lines: DataFrame, path: str, compression: str = "none") -> None:
    """The lines as text files, each file a range of the order."""
    lines.repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("value").write.mode("overwrite").option("compression", compression).text(path)


def write_by(lines: DataFrame, key: str, path: str, compression: str = "none") -> None:
    """A folder of text files for each value of a column: a demultiplexing sink. Large keys are written by several tasks."""
    lines.select(key, "value").write.mode("overwrite").partitionBy(key).option("compression", compression).text(path)


def joined(pieces: DataFrame, keys: list[str], sep: str = "") -> DataFrame:
    """Pieces (keys, block, piece) put together in order of their blocks."""
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), sep).alias("line"))


def transposed(cells: DataFrame, row: str, col: str, value: str, chunk: int = BLOCK) -> DataFrame:
    """Cells (row, col number, value) column by column: (col, block, piece) with `chunk` rows, numbered from 0, in a piece."""
    c = cells.select(F.col(row).alias("r"), F.col(col).alias("c"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v"), F.expr(f"{row} div {chunk}").alias("block"))
    return c.groupBy(F.col("c").alias(col), "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]), "\t").alias("piece"))


# ---------------------------------------------------------------- reads


def fastq_lines(reads: DataFrame, name: Column, part: Column) -> DataFrame:
    """reads (read_id, seq, qual): four lines a read."""
    four = F.array(F.concat(F.lit("@"), name), F.col("seq"), F.lit("+"), F.col("qual"))
    return reads.select(part.alias("part"), F.col("read_id"), F.posexplode(four).alias("i", "value")).select("part", (F.col("read_id") * 4 + F.col("i")).alias("line"), "value")


def fasta_lines(sequences: DataFrame, name: Column, seq: Column, part: Column, order: Column, width: int = 0) -> DataFrame:
    """A name line and the sequence, in lines of `width` letters if that is not 0."""
    most = 1 << 20
    body = F.array(seq) if not width else F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(seq) - 1, F.lit(0)) / width).cast("int")), lambda i: F.substring(seq, i * width + 1, F.lit(width)))
    return sequences.select(part.alias("part"), order.alias("o"), F.posexplode(F.concat(F.array(F.concat(F.lit(">"), name)), body)).alias("i", "value")).select("part", (F.col("o") * most + F.col("i")).alias("line"), "value")


def sam_lines(alignments: DataFrame, part: Column) -> DataFrame:
    """alignments (line, name, flag, chr, pos 0-based, mapq, cigar, seq, qual)."""
    cols = ["name", "flag", "chr", F.col("pos") + 1, "mapq", "cigar", F.lit("*"), F.lit(0), F.lit(0), "seq", "qual"]
    return alignments.select(part.alias("part"), "line", F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]).alias("value"))


# ---------------------------------------------------------------- variants


def vcf_head(samples: DataFrame, source: str = "radspark") -> DataFrame:
    """samples (sample): meta lines and the column line, in order of the samples."""
    names = samples.agg(F.array_join(F.transform(F.array_sort(F.collect_set("sample")), lambda s: s.cast("string")), "\t").alias("names"))
    # Declarations of the fields written below.
    meta = [
        "##fileformat=VCFv4.2", f'##source="{source}"', '##INFO=<ID=NS,Number=1,Type=Integer,Description="Number of Samples With Data">', '##INFO=<ID=AF,Number=A,Type=Float,Description="Allele Frequency">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read Depth">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Allelic Depth">',
        '##INFO=<ID=DP,Number=1,Type=Integer,Description="Total Depth">', '##INFO=<ID=AD,Number=R,Type=Integer,Description="Total Depth of Each Allele">', '##FORMAT=<ID=PS,Number=1,Type=Integer,Description="Phase Set">', '##FORMAT=<ID=FT,Number=1,Type=String,Description="Genotype Filter">',
        '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype Quality">', '##FORMAT=<ID=GL,Number=G,Type=Float,Description="Genotype Likelihood">',
    ]
    head = F.array(*[F.lit(m) for m in meta], F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), F.col("names")))
    return names.select(F.lit(-1).cast("long").alias("part"), F.posexplode(head).alias("line", "value")).select("part", F.col("line").cast("long"), "value")


def vcf_lines(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """calls (locus, col, sample, a1, a2, dp): a line a site, its alleles from the commonest (ties: the first by letter), N where no sample has a call; a sample without a call has
    ./. there. These calls hold no depths by allele; called_lines() writes those of calls that do."""
    called = F.col("a1").isNotNull() & F.col("a2").isNotNull()
    copies = calls.select("locus", "col", F.explode(F.when(called, F.array("a1", "a2")).otherwise(F.array(F.lit(None).cast("string")))).alias("a")).groupBy("locus", "col", "a").count()
    known = F.col("a").isNotNull()
    order = F.array_sort(F.collect_list(F.when(known, F.struct((-F.col("count")).alias("n"), F.col("a")))))
    sites = copies.groupBy("locus", "col").agg(order.alias("o"), F.sum(F.when(known, F.col("count"))).alias("copies"))
    others = F.slice("o", 2, F.greatest(F.size("o") - 1, F.lit(0)))
    sites = sites.select("locus", "col", "copies", F.col("o.a").alias("alleles"), F.coalesce(F.get("o", F.lit(0))["a"], F.lit("N")).alias("ref"), F.when(F.size("o") > 1, F.array_join(others["a"], ",")).alias("alt"), others["n"].alias("less"))
    at = lambda a: (F.array_position("alleles", F.col(a)) - 1).cast("string")
    gt = F.concat_ws("/", F.array_sort(F.array(at("a1"), at("a2"))))
    own = calls.join(sites, ["locus", "col"]).select("locus", "col", "sample", F.when(called, F.concat_ws(":", gt, F.col("dp").cast("string"))).alias("call"))
    row = own.groupBy("locus", "col").agg(F.map_from_entries(F.collect_list(F.struct("sample", "call"))).alias("by"), F.count("call").alias("ns"))
    names = samples.agg(F.array_sort(F.collect_set("sample")).alias("names"))  # one row
    row = row.join(sites, ["locus", "col"]).join(F.broadcast(names))
    share = F.transform("less", lambda n: (F.floor(-n / F.col("copies") * 1000 + 0.5) / 1000).cast("string"))
    about = F.concat(F.lit("NS="), F.col("ns").cast("string"), F.lit(";AF="), F.when(F.size("less") > 0, F.array_join(share, ",")).otherwise("0.0"))
    return _records(row, about, F.lit("GT:DP"))


def _records(row: DataFrame, about: Column, fields: Column) -> DataFrame:
    """Lines of sites (locus, col, ref, alt, by: a map from sample to call, names: all samples in order)."""
    text = F.concat_ws(
        "\t", F.col("locus").cast("string"), (F.col("col") + 1).cast("string"), F.concat_ws(":", F.col("locus").cast("string"), F.col("col").cast("string")), "ref", F.coalesce("alt", F.lit(".")), F.lit("."), F.lit("PASS"),
        about, fields, F.array_join(F.transform("names", lambda s: F.coalesce(F.col("by")[s], F.lit("./."))), "\t"),
    )
    return row.select(F.col("locus").alias("part"), F.col("col").cast("long").alias("line"), text.alias("value"))


def _hundredths(x: Column) -> Column:
    """A number with two decimals, halves upwards."""
    n = F.floor(x * 100 + 0.5).cast("long")
    return F.concat(F.when(n < 0, "-").otherwise(""), F.floor(F.abs(n) / 100).cast("string"), F.lit("."), F.lpad((F.abs(n) % 100).cast("string"), 2, "0"))


def called_lines(called: DataFrame, samples: DataFrame, phases: DataFrame | None = None) -> DataFrame:
    """Calls of a genotype model (as models.call makes them): a line a site with reads.

    A site with one allele has its depths in INFO and each sample's depth. Others have GT:PS:FT:GQ:DP:AD:GL: depths by allele as counted, likelihoods (log10)
    of 0/0, 0/1 and 1/1. phases (locus, sample, status, cols, h1, h2), as assembly.phased makes them, give heterozygotes of a phase set as
    left|right and the set's first column; heterozygotes of a sample whose reads contradict each other are not called, and FT says `disc`.
    """
    of = lambda a: F.coalesce(F.get("counts", F.array_position(F.array(*map(F.lit, "ACGT")), F.col(a)).cast("int") - 1), F.lit(0))
    c = called.withColumn("x", of("allele")).withColumn("y", of("other"))
    if phases is not None:
        p = phases.select("locus", "sample", "status", F.transform(F.split("cols", ","), lambda v: v.try_cast("int")).alias("set"), "h1", "h2")
        c = c.join(p, ["locus", "sample"], "left")
    else:
        c = c.select("*", F.lit(None).cast("string").alias("status"), F.lit(None).cast("array<int>").alias("set"), F.lit(None).cast("string").alias("h1"), F.lit(None).cast("string").alias("h2"))
    at = lambda a: F.when(a == F.col("allele"), "0").otherwise("1")
    known, het = F.col("a1").isNotNull(), F.col("a1") != F.col("a2")
    place = F.array_position("set", F.col("col")).cast("int")
    left, right = (F.substr(h, place, F.lit(1)) for h in (F.col("h1"), F.col("h2")))
    discarded = het & (F.coalesce(F.col("status"), F.lit("")) == "inconsistent")
    phased = het & (F.coalesce(place, F.lit(0)) > 0)
    gt = F.when(discarded, "./.:.:disc:.").when(phased, F.concat(at(left), F.lit("|"), at(right), F.lit(":"), (F.array_min("set") + 1).cast("string"), F.lit(":.:"), F.col("gq").cast("string")))
    gt = gt.when(known, F.concat(F.concat_ws("/", F.array_sort(F.array(at(F.col("a1")), at(F.col("a2"))))), F.lit(":.:.:"), F.col("gq").cast("string"))).otherwise("./.:.:.:.")
    gl = F.array_join(F.transform("gl", lambda v: _hundredths(v / F.ln(F.lit(10.0)))), ",")
    many = F.concat_ws(":", gt, F.col("depth").cast("string"), F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string")), gl)
    call = F.when(F.col("depth") == 0, F.when(F.col("variable"), "./.").otherwise(".")).when(F.col("variable"), many).otherwise(F.col("depth").cast("string"))
    copies = F.when(known & ~discarded, (F.col("a1") == F.col("other")).cast("int") + (F.col("a2") == F.col("other")).cast("int"))
    row = c.select("locus", "col", "sample", "variable", "allele", "other", "depth", "x", "y", copies.alias("copies"), call.alias("call"))
    row = row.groupBy("locus", "col", "variable", F.col("allele").alias("ref"), F.col("other").alias("alt")).agg(
        F.map_from_entries(F.collect_list(F.struct("sample", "call"))).alias("by"), F.sum("depth").alias("dp"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("copies").alias("minor"), (2 * F.count("copies")).alias("copies"),
    )
    names = samples.agg(F.array_sort(F.collect_set("sample")).alias("names"))  # one row
    row = row.join(F.broadcast(names))
    share = F.when(F.col("copies") > 0, F.floor(F.col("minor") / F.col("copies") * 1000 + 0.5) / 1000).otherwise(0.0).cast("string")
    about = F.concat(F.lit("DP="), F.col("dp").cast("string"), F.lit(";AD="), F.col("x").cast("string"), F.when(F.col("variable"), F.concat(F.lit(","), F.col("y").cast("string"), F.lit(";AF="), share)).otherwise(""))
    missing = F.when(F.col("variable"), "./.").otherwise(".")
    row = row.withColumn("by", F.map_from_arrays("names", F.transform("names", lambda s: F.coalesce(F.col("by")[s], missing))))
    return _records(row, about, F.when(F.col("variable"), "GT:PS:FT:GQ:DP:AD:GL").otherwise("DP"))


def vcf_haplotypes(haps: DataFrame) -> DataFrame:
    """haps (locus, sample, h1, h2): a line a locus, its complete haplotypes as alleles by falling count, then by letters."""
    full = lambda h: F.when(F.instr(h, "N") == 0, F.col(h))
    h = haps.select("locus", "sample", full("h1").alias("h1"), full("h2").alias("h2"))
    n = h.select("locus", F.explode(F.array("h1", "h2")).alias("h")).where("h is not null").groupBy("locus", "h").count()
    order = n.groupBy("locus").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("h")))), lambda x: x["h"]).alias("o"))
    at = lambda c: F.array_position("o", F.col(c)) - 1
    gt = F.when(F.col("h1").isNull() | F.col("h2").isNull(), "./.").otherwise(F.concat_ws("/", F.least(at("h1"), at("h2")).cast("string"), F.greatest(at("h1"), at("h2")).cast("string")))
    row = h.join(order, "locus").groupBy("locus", "o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", gt.alias("g")))), lambda x: x["g"]), "\t").alias("calls"))
    return row.select("locus", F.element_at("o", 1).alias("ref"), F.when(F.size("o") > 1, F.array_join(F.slice("o", 2, 1 << 20), ",")).otherwise(".").alias("alt"), "calls")


# ---------------------------------------------------------------- populations


def _grid(calls: DataFrame) -> DataFrame:
    """Every site of every sample, in blocks; sites come from the calls, samples are few."""
    sites = calls.select("locus", "col").distinct()
    samples = calls.select("sample", "pop").distinct()  # a row a sample
    g = sites.crossJoin(F.broadcast(samples)).join(calls.select("locus", "col", "sample", "a1", "a2"), ["locus", "col", "sample"], "left")
    return g.withColumn("block", F.expr(f"locus div {BLOCK}"))


def _by_sample(grid: DataFrame, keys: list[str], cell: Column, sep: str) -> DataFrame:
    return grid.groupBy(*keys, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("locus", "col", cell.alias("v")))), lambda x: x["v"]), sep).alias("piece"))


def genepop(calls: DataFrame) -> DataFrame:
    """(pop, sample, block, piece): two-digit codes, 0000 for what is missing."""
    return _by_sample(_grid(calls), ["pop", "sample"], F.concat(coded(F.col("a1"), GENEPOP, "00"), coded(F.col("a2"), GENEPOP, "00")), "\t")


def genepop_lines(pieces: DataFrame, calls: DataFrame, title: str = "radspark") -> DataFrame:
    """A whole GenePop file: title, site names, and each population's samples under a `pop` line."""
    names = calls.select("locus", "col").distinct().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("locus", "col"))), lambda x: F.concat_ws("_", x["locus"].cast("string"), x["col"].cast("string"))), ",").alias("value"))
    head = names.select(F.lit(-2).cast("long").alias("part"), F.posexplode(F.array(F.lit(title), F.col("value"))).alias("line", "value"))
    body = joined(pieces, ["pop", "sample"], "\t").select(F.col("pop").cast("long").alias("part"), F.col("sample").cast("long").alias("line"), F.concat(F.col("sample").cast("string"), F.lit(",\t"), F.col("line")).alias("value"))
    marks = calls.select(F.col("pop").cast("long").alias("part")).distinct().select("part", F.lit(-1).cast("long").alias("line"), F.lit("pop").alias("value"))
    return head.select("part", F.col("line").cast("long"), "value").union(marks).union(body)


def genepop_haplotypes(haps: DataFrame) -> DataFrame:
    """(locus, pop, sample, code): rank of each complete haplotype by falling count from 1, in two digits, or three where a locus has more than 99; 0 if missing."""
    full = lambda h: F.when(F.instr(h, "N") == 0, F.col(h))
    h = haps.select("locus", "pop", "sample", full("h1").alias("h1"), full("h2").alias("h2"))
    n = h.select("locus", F.explode(F.array("h1", "h2")).alias("h")).where("h is not null").groupBy("locus", "h").count()
    order = n.groupBy("locus").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("h")))), lambda x: x["h"]).alias("o"))
    digits = F.when(F.size("o") > 99, 3).otherwise(2)
    at = lambda c: F.lpad(F.coalesce(F.array_position("o", F.col(c)), F.lit(0)).cast("string"), digits, F.lit("0"))
    both = F.col("h1").isNotNull() & F.col("h2").isNotNull()
    return h.join(order, "locus").select("locus", "pop", "sample", F.when(both, F.concat(at("h1"), at("h2"))).otherwise(F.repeat(F.lit("0"), 2 * digits)).alias("code"))


def structure(calls: DataFrame) -> DataFrame:
    """(pop, sample, copy, block, piece): two rows a sample."""
    g = _grid(calls).select("*", F.posexplode(F.array("a1", "a2")).alias("copy", "a"))
    return _by_sample(g, ["pop", "sample", "copy"], coded(F.col("a"), STRUCTURE, "0"), "\t")


def plink_ped(calls: DataFrame) -> DataFrame:
    """(pop, sample, block, piece): allele letters, 0 for what is missing; family, sample and four unknowns lead a line."""
    return _by_sample(_grid(calls), ["pop", "sample"], F.concat_ws("\t", F.coalesce("a1", F.lit("0")), F.coalesce("a2", F.lit("0"))), "\t")


def plink_ped_lines(pieces: DataFrame) -> DataFrame:
    return joined(pieces, ["pop", "sample"], "\t").select(F.col("pop").cast("long").alias("part"), F.col("sample").cast("long").alias("line"), F.concat_ws("\t", F.col("pop").cast("string"), F.col("sample").cast("string"), F.lit("0\t0\t0\t0"), "line").alias("value"))


def plink_map(calls: DataFrame, positions: DataFrame, step: int = 20) -> DataFrame:
    """(locus, col, value): chromosome, site name, 0, place from 1."""
    s = calls.select("locus", "col").distinct().join(positions, "locus")
    bp = F.col("bp") + F.when(F.col("strand") == "-", -F.col("col")).otherwise(F.col("col")) * step + 1
    return s.select("locus", "col", F.concat_ws("\t", F.col("chr").cast("string"), F.concat_ws("_", F.col("locus").cast("string"), F.col("col").cast("string")), F.lit("0"), bp.cast("string")).alias("value"))


def hzar(calls: DataFrame) -> DataFrame:
    """(pop, locus, col, a, b, n): frequencies of the first and second allele by letter at biallelic sites, and allele copies."""
    c = calls.where("a1 is not null and a2 is not null").select("locus", "col", "pop", F.explode(F.array("a1", "a2")).alias("x"))
    two = c.groupBy("locus", "col").agg(F.min("x").alias("lo"), F.countDistinct("x").alias("k")).where("k = 2")
    return c.join(two, ["locus", "col"]).groupBy("pop", "locus", "col").agg(F.avg((F.col("x") == F.col("lo")).cast("double")).alias("a"), F.avg((F.col("x") != F.col("lo")).cast("double")).alias("b"), F.count("*").alias("n"))


def radpainter(haps: DataFrame) -> DataFrame:
    """(locus, line): a cell a sample in order: both haplotypes sorted, one if they are equal, empty if missing."""
    ok = (F.instr("h1", "N") == 0) & (F.instr("h2", "N") == 0)
    cell = F.when(~ok, "").when(F.col("h1") == F.col("h2"), F.col("h1")).otherwise(F.concat_ws("/", F.least("h1", "h2"), F.greatest("h1", "h2")))
    return haps.groupBy("locus").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", cell.alias("v")))), lambda x: x["v"]), "\t").alias("line"))


def _letters(calls: DataFrame) -> DataFrame:
    """(locus, col, pop, x, y): least and greatest letter of a population at sites with two alleles in all and data in every population."""
    c = calls.where("a1 is not null and a2 is not null").select("locus", "col", "pop", F.explode(F.array("a1", "a2")).alias("a"))
    pops = calls.select("pop").distinct().agg(F.count("*").alias("all_pops"))
    p = c.groupBy("locus", "col", "pop").agg(F.min("a").alias("x"), F.max("a").alias("y"), F.countDistinct("a").alias("k"))
    s = c.groupBy("locus", "col").agg(F.countDistinct("a").alias("kinds"), F.countDistinct("pop").alias("pops")).join(F.broadcast(pops)).where("kinds = 2 and pops = all_pops")
    return p.join(s.select("locus", "col"), ["locus", "col"])


def phylip_fixed(calls: DataFrame) -> DataFrame:
    """(pop, block, piece): sites fixed within every population and not alike in all."""
    p = _letters(calls)
    fixed = p.groupBy("locus", "col").agg(F.max("k").alias("most")).where("most = 1").select("locus", "col")
    return _by_sample(p.join(fixed, ["locus", "col"]).withColumn("block", F.expr(f"locus div {BLOCK}")), ["pop"], F.col("x"), "")


def phylip_variable(calls: DataFrame) -> DataFrame:
    """(pop, block, piece): a nucleotide code for each population at every variable site."""
    return _by_sample(_letters(calls).withColumn("block", F.expr(f"locus div {BLOCK}")), ["pop"], iupac(F.col("x"), F.col("y")), "")


def phylip_lines(pieces: DataFrame) -> DataFrame:
    """The alignment: number of populations and length, then names padded to ten letters."""
    rows = joined(pieces, ["pop"])
    head = rows.agg(F.concat_ws("\t", F.count("*").cast("string"), F.max(F.length("line")).cast("string")).alias("value")).select(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("line"), "value")
    return head.union(rows.select(F.lit(1).cast("long"), F.col("pop").cast("long"), F.concat(F.rpad(F.col("pop").cast("string"), 10, " "), F.col("line"))))


def sequences(haps: DataFrame, loci: DataFrame, step: int = 20) -> DataFrame:
    """(locus, sample, allele, seq): each haplotype put into its locus' consensus (loci: locus, consensus, cols: columns of its sites)."""
    h = haps.join(loci, "locus").select("locus", "sample", "consensus", F.transform("cols", lambda c: c * step).alias("at"), F.posexplode(F.array("h1", "h2")).alias("allele", "h"))
    return h.select("locus", "sample", "allele", with_bases(F.col("consensus"), F.col("at"), F.col("h")).alias("seq"))


def observed_sequences(haps: DataFrame, loci: DataFrame, step: int = 20) -> DataFrame:
    """As sequences, a sample's equal haplotypes once."""
    return sequences(haps, loci, step).groupBy("locus", "sample", "seq").agg(F.min("allele").alias("allele"))


def phase_lines(haps: DataFrame) -> DataFrame:
    """PHASE and fastPHASE input of a locus: a name line and two lines of alleles, ? where uncalled."""
    three = F.array(F.concat(F.lit("# "), F.col("sample").cast("string")), F.translate("h1", "N", "?"), F.translate("h2", "N", "?"))
    return haps.select(F.col("locus").alias("part"), F.col("sample"), F.posexplode(three).alias("i", "value")).select("part", (F.col("sample") * 3 + F.col("i")).cast("long").alias("line"), "value")


def locus_tables(spark_rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the locus tables as text, nulls empty."""
    return spark_rows.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))


# ---------------------------------------------------------------- whole sequences, interleaved

WIDTH = 120
_MANY = 10_000  # loci of a stretch of the running offset


def offsets(loci: DataFrame) -> DataFrame:
    """loci (locus, consensus) -> (locus, consensus, no, offset): rank from 1 and letters before, in order of the loci. Stretches of loci are summed up first, so that no task sees them all."""
    part = F.expr(f"locus div {_MANY}")
    own = Window.partitionBy("part").orderBy("locus")
    r = loci.select("locus", "consensus", F.length("consensus").cast("long").alias("size"), part.alias("part"))
    totals = r.groupBy("part").agg(F.sum("size").alias("all"), F.count("*").alias("many"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    totals = totals.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("letters"), F.coalesce(F.sum("many").over(before), F.lit(0)).alias("loci"))
    r = r.withColumn("no", F.row_number().over(own)).withColumn("offset", F.sum("size").over(own) - F.col("size")).join(totals, "part")
    return r.select("locus", "consensus", (F.col("no") + F.col("loci")).cast("long").alias("no"), (F.col("offset") + F.col("letters")).alias("offset"))


def population_sequences(calls: DataFrame, loci: DataFrame, step: int = 20) -> DataFrame:
    """(pop, locus, seq): a locus' consensus with each population's nucleotide code put in at its sites; N where a population has no call or more than two bases."""
    seen = calls.where("a1 is not null and a2 is not null").select("locus", "col", "pop", F.explode(F.array("a1", "a2")).alias("a"))
    seen = seen.groupBy("locus", "col", "pop").agg(F.min("a").alias("x"), F.max("a").alias("y"), F.countDistinct("a").alias("k"))
    letters = seen.select("locus", "pop", "col", F.when(F.col("k") > 2, "N").otherwise(iupac(F.col("x"), F.col("y"))).alias("code"))
    by = letters.groupBy("locus", "pop").agg(F.map_from_entries(F.collect_list(F.struct("col", "code"))).alias("by"))
    sites = calls.select("locus", "col").distinct().groupBy("locus").agg(F.array_sort(F.collect_list("col")).alias("cols"))
    pops = calls.agg(F.array_sort(F.collect_set("pop")).alias("pops"))  # one row
    every = loci.select("locus", "consensus").join(sites, "locus", "left").join(F.broadcast(pops)).select("locus", "consensus", F.coalesce("cols", F.array().cast("array<int>")).alias("cols"), F.explode("pops").alias("pop"))
    j = every.join(by, ["locus", "pop"], "left")
    codes = F.array_join(F.transform("cols", lambda c: F.coalesce(F.col("by")[c], F.lit("N"))), "")
    seq = F.when(F.size("cols") == 0, F.col("consensus")).otherwise(with_bases(F.col("consensus"), F.transform("cols", lambda c: c * step), codes))
    return j.select("pop", "locus", seq.alias("seq"))


def phylip_all(calls: DataFrame, loci: DataFrame, step: int = 20, width: int = WIDTH) -> DataFrame:
    """The whole sequence of each population, all loci in order, interleaved: number of populations and letters, then blocks of `width` columns, a line a population and an empty line
    after each full block; names take the first ten columns.

    A locus knows its offset, so it is cut where blocks end, and a line is put together from the few pieces that fall into it.
    """
    at = offsets(loci).select("locus", "offset")
    s = population_sequences(calls, loci, step).join(at, "locus").select("pop", (F.col("offset") + 10).alias("start"), "seq")
    name = calls.select("pop").distinct().select("pop", F.lit(0).cast("long").alias("start"), F.rpad(F.col("pop").cast("string"), 10, " ").alias("seq"))
    s = s.unionByName(name).where("length(seq) > 0")
    first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.length("seq") - 1) / width)
    s = s.select("pop", "start", "seq", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * width - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * width - F.col("start"), F.length("seq").cast("long"))
    s = s.select("pop", "block", (F.col("start") + begin).alias("start"), F.substr("seq", (begin + 1).cast("int"), (end - begin).cast("int")).alias("piece"))
    lines = s.groupBy("block", "pop").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "").alias("value"))
    numbers = calls.select("pop").distinct().withColumn("no", F.row_number().over(Window.orderBy("pop")).cast("long"))  # a row a population
    lines = lines.join(F.broadcast(numbers), "pop")
    gaps = lines.where((F.col("no") == 1) & (F.length("value") == width)).select((F.col("block") + 1).alias("part"), F.lit(1 << 40).cast("long").alias("line"), F.lit("").alias("value"))
    sizes = loci.agg(F.coalesce(F.sum(F.length("consensus")), F.lit(0)).alias("letters")).join(numbers.agg(F.count("*").alias("pops")))  # one row
    head = sizes.select(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("line"), F.concat(F.col("pops").cast("string"), F.lit(" "), F.lpad(F.col("letters").cast("string"), 11, " ")).alias("value"))
    return head.unionByName(lines.select((F.col("block") + 1).alias("part"), F.col("no").alias("line"), "value")).unionByName(gaps)


def phylip_partitions(loci: DataFrame) -> DataFrame:
    """A line a locus: its number and columns in the whole sequence, from 1."""
    o = offsets(loci)
    return o.select("no", F.lit(0).cast("long").alias("line"), F.concat(F.lit("DNA, p"), F.col("no").cast("string"), F.lit("="), (F.col("offset") + 1).cast("string"), F.lit("-"), (F.col("offset") + F.length("consensus")).cast("string")).alias("value")).withColumnRenamed("no", "part")
