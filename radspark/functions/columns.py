"""Column functions over names, sequences, numbers and call fields; all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complement(seq: Column) -> Column:
    """Each base's complement; other letters stay."""
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column, offset: int = 0) -> Column:
    """Of the sequence from `offset` on."""
    return F.reverse(complement(F.substring(seq, offset + 1, 1 << 30)))


def reverse_quality(qual: Column, offset: int = 0) -> Column:
    return F.reverse(F.substring(qual, offset + 1, 1 << 30))


def hamming(a: Column, b: Column) -> Column:
    """Differing places over the common length."""
    n = F.least(F.length(a), F.length(b))
    return F.length(F.array_join(F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: F.when(x.eqNullSafe(y), "").otherwise("x")), ""))


def padded_hamming(a: Column, b: Column) -> Column:
    """Differing places, what one has more than the other included."""
    return hamming(a, b) + F.abs(F.length(a) - F.length(b))


def frameshift(a: Column, b: Column, mismatches: Column) -> Column:
    """Differing places among the last `mismatches`, less the places that one has more: a shifted frame shows as many."""
    gap = F.abs(F.length(a) - F.length(b))
    n = F.greatest(F.lit(0), F.least(mismatches.cast("int") - gap, F.length(a), F.length(b)))
    tail = lambda x: F.substring(x, F.least(F.length(a), F.length(b)) - n + 1, n)
    return F.when(n == 0, 0).otherwise(hamming(tail(a), tail(b)))


def kmers(seq: Column, k: int) -> Column:
    """All stretches of k letters, by start; null for shorter ones."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k))))


def without_n(seq: Column) -> Column:
    return F.translate(seq, "Nn", "")


def n_last(seq: Column) -> Column:
    """The uncalled bases moved behind the others."""
    return F.concat(without_n(seq), F.repeat(F.lit("N"), F.length(seq) - F.length(without_n(seq))))


def has_n(seq: Column) -> Column:
    return F.coalesce(seq.rlike("[Nn]"), F.lit(False))


def packed(seq: Column, bits: int = 4) -> Column:
    """A DNA sequence in `bits` (4, or 3 as octal digits) a base: hexadecimal digits, A 1, C 2, G 4, T 8, N 15; or octal 0 to 4."""
    return F.translate(F.upper(seq), "ACGTN", "1248f" if bits == 4 else "01234")


def unpacked(code: Column, bits: int = 4) -> Column:
    return F.translate(code, "1248f" if bits == 4 else "01234", "ACGTN")


def is_integer(text: Column) -> Column:
    """The number, or -1 for what is no plain non-negative integer."""
    return F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int")).otherwise(-1)


def is_double(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), F.lit(False))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def product(lo: Column, hi: Column) -> Column:
    """lo * (lo + 1) * ... * hi; 1 where hi < lo."""
    return F.aggregate(F.when(hi >= lo, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda s, i: s * i)


def factorial(n: Column) -> Column:
    return product(F.lit(1), n)


def reduced_factorial(n: Column, d: Column) -> Column:
    """n! / d!"""
    return product(d + 1, n)


def log_sum(lo: Column, hi: Column) -> Column:
    return F.aggregate(F.when(hi >= lo, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double")))


def log_factorial(n: Column) -> Column:
    return log_sum(F.lit(1), n)


def reduced_log_factorial(n: Column, d: Column) -> Column:
    return log_sum(d + 1, n)


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient; 0 where n < k."""
    return F.when(n < k, F.lit(0.0)).otherwise(reduced_factorial(n, F.greatest(k, n - k)) / factorial(F.least(k, n - k)))


def kmer_length(length: Column, distance: Column) -> Column:
    """The largest odd k from 7 on with more than no k-mer shared at that distance; the whole length at distance 0."""
    most = F.ceil((length + 1) / (distance + 1)) - 1  # k * (distance + 1) < length + 1
    odd = most - F.when(most % 2 == 0, 1).otherwise(0)
    return F.when(distance == 0, length).otherwise(F.greatest(odd, F.lit(7))).cast("int")


def least_matches(length: Column, k: Column, distance: Column) -> Column:
    """K-mers that two sequences of that length and distance share at least; 1 where none is sure."""
    return F.greatest(length - (k * (distance + 1) - 1), F.lit(1)).cast("int")


def header(name: Column) -> Column:
    """A read name as a struct (kind, machine, run, lane, tile, x, y, read, filter, index): ten fields by colons and one blank, the
    older five with #index/read, or unknown."""
    two = r"^([^:]*):([0-9]*):([^:]*):([0-9]*):([0-9]*):([0-9]*):([0-9]*) ([0-9]*):([YN]):([^:]*):(.*)$"
    one = r"^([^:]*):([0-9]*):([0-9]*):([0-9]*):([0-9]*)#([^/]*)/([0-9]*)$"
    new, old = name.rlike(two), name.rlike(one)
    pick = lambda i, j, t: F.when(new, F.regexp_extract(name, two, i) if i else None).when(old, F.regexp_extract(name, one, j) if j else None).cast(t)
    return F.struct(
        F.when(new, "v2").when(old, "v1").otherwise("unknown").alias("kind"), pick(1, 1, "string").alias("machine"), pick(2, 0, "int").alias("run"), pick(4, 2, "int").alias("lane"), pick(5, 3, "int").alias("tile"),
        pick(6, 4, "int").alias("x"), pick(7, 5, "int").alias("y"), pick(8, 7, "int").alias("read"), F.when(new, F.regexp_extract(name, two, 9) == "Y").alias("filter"), pick(11, 6, "string").alias("index"),
    )


def lane_file(name: Column) -> Column:
    """A file name s_<lane>_<read>_<tile>_qseq... as (lane, read, tile); or <sample>_L<lane>_R<read>_<part> as (lane, read, part)."""
    one, two = r"^s_([0-9]+)_([0-9]+)_([0-9]+)_", r"_L([0-9]+)_R([0-9]+)_([0-9]+)\."
    pick = lambda i: F.when(name.rlike(one), F.regexp_extract(name, one, i)).when(name.rlike(two), F.regexp_extract(name, two, i)).cast("int")
    return F.struct(pick(1).alias("lane"), pick(2).alias("read"), pick(3).alias("part"))


def inline_barcode(seq: Column, length: int) -> Column:
    return F.substring(seq, 1, length)


def place(text: Column) -> Column:
    """chr:bp:strand as a struct; no strand means forward."""
    p = r"^(.+):([0-9]+)(?::([+-]))?$"
    return F.struct(F.regexp_extract(text, p, 1).alias("chr"), F.regexp_extract(text, p, 2).cast("long").alias("bp"), F.when(F.regexp_extract(text, p, 3) == "-", "-").otherwise("+").alias("strand"))


def place_name(chrom: Column, bp: Column, strand: Column) -> Column:
    return F.concat_ws(":", chrom, bp.cast("string"), strand)


def site_bp(bp: Column, col: Column, strand: Column) -> Column:
    """A column's place: counted down on the reverse strand."""
    return bp + F.when(strand == "-", -col).otherwise(col)


#: The letters of nucleotide codes.
IUPAC = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}


def iupac(p: Column, q: Column) -> Column:
    """The letter for one or two bases, in any order; N for others."""
    two = F.concat(F.least(p, q), F.greatest(p, q))
    out = F.when(q.isNull() | (p == q), p)
    for bases, letter in IUPAC.items():
        out = out.when(two == bases, letter)
    return out.otherwise("N")


def file_kind(path: Column) -> Column:
    """Format by extension, .gz aside."""
    out = F.when(F.lit(False), "")
    for ending, kind in ((r"\.(fq|fastq)", "fastq"), (r"\.(fa|fasta)", "fasta"), (r"\.sam", "sam"), (r"\.bam", "bam"), (r"\.vcf", "vcf"), (r"\.tsv", "tsv")):
        out = out.when(path.rlike(rf"(?i){ending}$"), kind).when(path.rlike(rf"(?i){ending}\.gz$"), F.lit(f"gz{kind}"))
    return out.otherwise("unknown")


def with_bases(consensus: Column, cols: Column, bases: Column) -> Column:
    """The consensus with bases (a string) put in at columns (an ascending array of ints from 0): an allele's sequence."""
    return F.aggregate(F.arrays_zip(cols.alias("c"), F.split(bases, "").alias("b")), consensus, lambda s, x: F.overlay(s, x["b"], x["c"] + 1, F.lit(1)))


def phred(likelihood: Column, other: Column) -> Column:
    """The genotype's quality, 0 to 40: -10 log10 of the chance of so large a likelihood ratio (natural logarithms in) under chi-square with one degree."""
    return F.least(F.lit(40), F.floor(-10 * F.log10(chisq1_tail(2 * (likelihood - other))))).cast("int")


def chisq1_tail(x: Column) -> Column:
    """Upper tail of chi-square with one degree, erfc(sqrt(x / 2)), by the continued fraction of the normal's tail beyond 9 and a series below."""
    z = F.sqrt(F.greatest(x, F.lit(0.0)))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(z.alias("t"), z.alias("s")), lambda a, k: F.struct((a["t"] * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * z * z / (2 * k + 1)).alias("s")))["s"]
    low = 1 - 2 * series * F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793))
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda a, k: z + k / a)
    return F.when(x <= 0, F.lit(1.0)).when(x < 9, low).otherwise(2 * F.exp(-z * z / 2) / (F.sqrt(F.lit(2 * 3.141592653589793)) * fraction))


def is_snp(ref: Column, alt: Column) -> Column:
    """All alleles one letter (or *), two at least."""
    return (F.length(ref) == 1) & F.coalesce(alt.rlike(r"^[A-Za-z*](,[A-Za-z*])*$"), F.lit(False))
