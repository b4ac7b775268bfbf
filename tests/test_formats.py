import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from radspark.operators import sinks
from radspark.sources import formats


def put(path, text, packed=False):
    (gzip.open if packed else open)(path, "wt", newline="").write(text)
    return str(path)


def test_fastq_and_fasta_over_splits(spark, tmp_path):
    """Records cut by splits, CR ends, gzip, sequences over many lines, and records that are none."""
    rng = random.Random(1)
    reads = [(f"r{i}", f"c {i}" if i % 3 else "", "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 90)))) for i in range(700)]
    head = lambda m, n, c: m + n + (f" {c}" if c else "")
    fq = "".join(f"{head('@', n, c)}\r\n{s}\r\n+\r\n{'@' * len(s)}\r\n" for n, c, s in reads)
    fa = "".join(head(">", n, c) + "\n" + "".join(s[j : j + 20] + "\n" for j in range(0, len(s), 20)) for n, c, s in reads)
    put(tmp_path / "a.fq", fq), put(tmp_path / "b.fq.gz", fq, True), put(tmp_path / "a.fa", fa), put(tmp_path / "b.fa.gz", fa, True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        for name in ("a.fq", "b.fq.gz"):
            got = formats.fastq(formats.lines(spark, str(tmp_path / name))).orderBy("read").collect()
            assert [(r["name"], r["comment"], r["seq"]) for r in got] == reads
        for name in ("a.fa", "b.fa.gz"):
            text = formats.lines(spark, str(tmp_path / name))
            assert name.endswith("gz") or text.select("block").distinct().count() > 3
            assert [(r["name"], r["comment"], r["seq"]) for r in formats.fasta(text).orderBy("read").collect()] == reads
        both = formats.fastq(formats.lines(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq.gz")]))
        assert both.groupBy("file").count().count() == 2 and both.count() == 1400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    bad = put(tmp_path / "bad.fq", "@a\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        formats.fastq(formats.lines(spark, bad)).collect()


def test_writing_and_reading_back(spark, tmp_path):
    reads = spark.range(300).selectExpr("id read_id", "concat('s', id % 3) sample", "repeat('ACGT', cast(id % 9 as int)) seq", "repeat('IIII', cast(id % 9 as int)) qual")
    lines = sinks.fastq_lines(reads, F.col("read_id").cast("string"), F.col("sample"))
    sinks.write(lines, str(tmp_path / "out"), "gzip")
    back = formats.fastq(formats.lines(spark, str(tmp_path / "out")))
    assert sorted((int(r["name"]), r["seq"], r["qual"]) for r in back.collect()) == sorted((r["read_id"], r["seq"], r["qual"]) for r in reads.collect())
    sinks.write_by(lines.withColumnRenamed("part", "barcode"), "barcode", str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"barcode=s0", "barcode=s1", "barcode=s2"}


VCF = """##fileformat=VCFv4.2
##source="x"
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
1\t5\t.\ta\tg,t\t.\tPASS\tNS=3\tGT:DP:AD:GQ:GL\t0/1:7:4,3,0:20:-1.0,-0.5,-2.0\t2|2:3:.:.:.\t./.
1\t9\t.\tC\t*\t.\t.\tNS=1\tGT:DP\t0/1:2\t0/0:1\t.
2\t1\t.\tC\tCT\t.\tPASS\t.\tGT\t0/1\t0/0\t1/1
2\t2\t.\tC\tT\t.\tlow\t.\tGT\t0/1\t0/0\t1/1
3\t2\t.\tC\tT\t.\tPASS\t.\tGT:PS\t0/1:.\t0|1:2\t1/1:.
"""


def test_vcf(spark, tmp_path):
    text = formats.lines(spark, put(tmp_path / "a.vcf", VCF))
    assert formats.vcf_header(text).first()["samples"] == ["s1", "s2", "s3"] and len(formats.vcf_header(text).first()["meta"]) == 2
    calls = {(r["chrom"], r["pos"], r["sample"]): r for r in formats.vcf_calls(text).collect()}
    r = calls["1", 4, "s1"]
    assert (r["a1"], r["a2"], r["dp"], r["gq"], r["ad"]) == ("A", "G", 7, 20, [4, 3, 0]) and abs(r["gl"][1] + 0.5 * 2.302585) < 1e-5
    assert [calls["1", 4, s]["a1"] for s in ("s2", "s3")] == ["T", None] and calls["1", 4, "s2"]["gq"] is None
    ext = {(r["chrom"], r["pos"], r["sample"]): r["a1"] for r in formats.external_loci(text).collect()}
    assert {k[:2] for k in ext} == {("1", 4), ("1", 8), ("3", 1)} and ext["1", 8, "s1"] is None and ext["1", 8, "s2"] == "C"
    fa = formats.fasta(formats.lines(spark, put(tmp_path / "a.fa", ">3 pos=chr1:7:+\nACGT\n")))
    got = {r["sample"]: (r["h1"], r["h2"]) for r in formats.haplotypes(formats.locus_genotypes(text, fa)).collect()}
    assert got == {"s1": ("N", "N"), "s2": ("C", "T"), "s3": ("T", "T")}  # a heterozygote without phase set is missing


def blocked(raw):
    out = b""
    for i in range(0, len(raw) + 1, 300):
        d = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = d.compress(raw[i : i + 300]) + d.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw[i : i + 300]), len(raw[i : i + 300]))
    return out


def test_bam_and_sam(spark, tmp_path):
    rows = [("q1", 0, 0, 10, 60, "4M", "ACGT", "IIII"), ("q2", 16, 0, 20, 60, "1S3M", "ACGTA"[:4], "IIIH"), ("q3", 4, -1, -1, 0, "*", "ACGTN", "IIIII")] + [(f"z{i}", 0, 1, 100 + i, 30, "2M1I2M", "GGTCA", "ABCDE") for i in range(60)]
    raw = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2)
    for n in (b"chr1", b"chr2"):
        raw += struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", 1000)
    for name, flag, ref, pos, mapq, cig, seq, qual in rows:
        ops = [] if cig == "*" else [int(n) << 4 | "MIDNSHP=X".index(o) for n, o in __import__("re").findall(r"(\d+)(\D)", cig)]
        packed = bytes("=ACMGRSVTWYHKDBN".index(seq[i]) << 4 | ("=ACMGRSVTWYHKDBN".index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        rec = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + bytes(ord(c) - 33 for c in qual)
        raw += struct.pack("<i", len(rec)) + rec
    (tmp_path / "a.bam").write_bytes(blocked(raw))
    sam = "@HD\n" + "".join("\t".join(map(str, (n, f, "*" if r < 0 else f"chr{r + 1}", p + 1, m, c, "*", 0, 0, s, q))) + "\n" for n, f, r, p, m, c, s, q in rows)
    one = formats.bam(spark, str(tmp_path / "a.bam"))
    two = formats.sam(formats.lines(spark, put(tmp_path / "a.sam", sam)))
    cols = ["name", "flag", "chr", "pos", "mapq", "cigar", "seq", "qual", "strand", "mapped", "clipped5", "pos5", "ref_length"]
    assert [tuple(r) for r in one.orderBy("line").select(cols).collect()] == [tuple(r) for r in two.orderBy("line").select(cols).collect()]
    assert formats.usable_alignments(one).count() == 61
    assert {r["name"]: r["seq"] for r in formats.unaligned(one).collect()}["q2"] == "ACGT"
    assert formats.sorted_alignments(one).count() == 63
    late = one.unionByName(one.limit(1).withColumn("chr", F.lit("chr2")).withColumn("line", F.lit(999).cast("long")))
    with pytest.raises(Exception, match="unsorted"):
        formats.sorted_alignments(late).collect()


def bam_bytes(rows, names, size, extra=b""):
    """A file of records (name, flag, ref, pos, mapq, ops, seq, qual) in blocks of `size` bytes of content, which records straddle; and the records as text."""
    raw = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(names))
    for n in names:
        raw += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 10**6)
    for name, flag, ref, pos, mapq, cig, seq, qual in rows:
        ops = [n << 4 | "MIDNSHP=X".index(o) for o, n in cig]
        packed = bytes("=ACMGRSVTWYHKDBN".index(seq[i]) << 4 | ("=ACMGRSVTWYHKDBN".index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        rec = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + bytes(ord(c) - 33 for c in qual) + extra
        raw += struct.pack("<i", len(rec)) + rec
    out = b""
    for i in [*range(0, len(raw), size), len(raw)]:
        part = raw[i : i + size] if i < len(raw) else b""
        d = zlib.compressobj(6 if i % 3 else 0, zlib.DEFLATED, -15)
        body = d.compress(part) + d.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam_in_many_splits(spark, tmp_path):
    """Files cut into many splits, records straddling blocks and splits, a mark within a stored block; order checked over splits, samples merged by place."""
    rng = random.Random(4)
    files = {}
    for f in range(3):
        rows = []
        for i in range(900):
            n = rng.randint(5, 60)
            seq = "".join(rng.choice("ACGT") for _ in range(n))
            rows.append((f"read{f}_{i}", rng.choice((0, 16, 4 if i % 50 == 49 else 0)), i // 450, 10 * (i % 450) + rng.randint(0, 9), rng.randint(0, 60), [("M", n)], seq, "".join(chr(33 + rng.randint(0, 40)) for _ in range(n))))
        files[f] = rows
        (tmp_path / f"s{f}.bam").write_bytes(bam_bytes(rows, ["chrA", "chrB"], 700, b"XXZ\x06\x00BC\x02\x00" if f == 1 else b""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = formats.bam(spark, [str(tmp_path / f"s{f}.bam") for f in range(3)])
        for f, rows in files.items():
            own = got.where(F.col("file").endswith(f"s{f}.bam")).orderBy("line").collect()
            assert [(r["name"], r["flag"], r["chr"], r["pos"], r["mapq"], r["cigar"], r["seq"], r["qual"]) for r in own] == [(n, fl, ("chrA", "chrB")[ref], p, m, f"{c[0][1]}M", s, q) for n, fl, ref, p, m, c, s, q in rows]
            assert [r["line"] for r in own] == list(range(900)) and len({r["block"] for r in own}) > 5
        assert formats.sorted_alignments(got).count() == 2700
        both = formats.merged_alignments(spark, {f"s{f}": str(tmp_path / f"s{f}.bam") for f in range(3)})
        rows = both.select(F.spark_partition_id().alias("p"), "chr", "pos5", "strand", "sample").collect()
        keys = [(r["chr"], r["pos5"], r["strand"], r["sample"]) for r in sorted(rows, key=lambda r: r["p"])]
        assert keys == sorted(keys) and len(keys) == sum(r[1] != 4 for v in files.values() for r in v)
        rows = list(files[0])
        rows[400], rows[401] = rows[401], (*rows[400][:3], 5, *rows[400][4:])
        (tmp_path / "bad.bam").write_bytes(bam_bytes(rows, ["chrA", "chrB"], 700))
        with pytest.raises(Exception, match="unsorted"):
            formats.sorted_alignments(formats.bam(spark, str(tmp_path / "bad.bam"))).collect()
        (tmp_path / "none.bam").write_bytes(bam_bytes([], ["chrA"], 700))
        assert formats.bam(spark, str(tmp_path / "none.bam")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    with pytest.raises(Exception, match="not a BAM"):
        (tmp_path / "x.bam").write_bytes(blocked(b"some other content"))
        formats.bam(spark, str(tmp_path / "x.bam")).collect()


def test_phylip_of_whole_sequences(spark, tmp_path):
    """Written and taken apart again: each population's sequence with its codes, blocks of 120 columns, partitions that say where a locus lies."""
    rng = random.Random(2)
    loci = [(i * 7, "".join(rng.choice("ACGT") for _ in range(rng.randint(30, 140)))) for i in range(9)]
    calls, want = [], {p: "" for p in range(3)}
    for locus, con in loci:
        codes = {p: list(con) for p in want}
        for col in (0, 20):
            for p in want:
                kind = rng.choice(("AA", "AC", "GG", None, "AG"))
                codes[p][col] = {"AA": "A", "AC": "M", "GG": "G", None: "N", "AG": "R"}[kind]
                calls.append((locus, col // 20, p, p, kind and kind[0], kind and kind[1], 5))
        for p in want:
            want[p] += "".join(codes[p])
    c = spark.createDataFrame(calls, "locus long, col int, sample int, pop int, a1 string, a2 string, dp int").repartition(4)
    frame = spark.createDataFrame(loci, "locus long, consensus string")
    sinks.write(sinks.phylip_all(c, frame), str(tmp_path / "all"))
    text = [r["value"] for r in formats.lines(spark, str(tmp_path / "all")).orderBy("file", "line").collect()]
    total = sum(len(s) for _, s in loci)
    assert text[0] == f"3 {total:11d}"
    got, k = {p: "" for p in want}, 0
    for line in text[1:]:
        if not line:
            assert k % 3 == 0
            continue
        got[k % 3] += line
        assert len(line) == 120 or k >= 3 * ((total + 10) // 120)
        k += 1
    assert {p: s[10:] for p, s in got.items()} == want and [s[:10].strip() for s in got.values()] == ["0", "1", "2"]
    at = 1
    for (_, con), r in zip(loci, sinks.phylip_partitions(frame).orderBy("part").collect(), strict=True):
        assert r["value"] == f"DNA, p{r['part']}={at}-{at + len(con) - 1}"
        at += len(con)


def test_locus_tables_and_lists(spark, tmp_path):
    tags = put(tmp_path / "s1.tags.tsv", "# comment\n1\t5\tconsensus\t\t\tACGT\t0\t0\t0\n1\t5\tmodel\t\t\tOOEO\t\t\t\n1\t5\tprimary\t0\tr1\tACGT\t\t\t\n1\t5\tsecondary\t\tr2\tACTT\t\t\t\n1\t6\tconsensus\t\t\tTTTT\t0\t1\t0\n")
    snps = put(tmp_path / "s1.snps.tsv", "1\t5\t2\tE\t-9.5\tG\tT\t\t\n1\t5\t3\tO\t3.9\tT\t\t\t\n")
    alleles = put(tmp_path / "s1.alleles.tsv", "1\t5\tG\t50\t1\n1\t5\tT\t50\t1\n")
    got = formats.loci(formats.tags(spark, tags), formats.snps(spark, snps), formats.alleles(spark, alleles)).collect()
    assert len(got) == 1 and (got[0]["consensus"], got[0]["model"], got[0]["depth"], [s["col"] for s in got[0]["snps"]], [a["haplotype"] for a in got[0]["alleles"]]) == ("ACGT", "OOEO", 2, [2], ["G", "T"])
    put(tmp_path / "catalog.tags.tsv", "")
    assert [r["sample"] for r in formats.samples_in(spark, str(tmp_path)).collect()] == ["s1"]
    m = formats.matches(spark, put(tmp_path / "m.tsv", "7\t1\t5\tG\t12\t4M\n")).first()
    assert (m["catalog"], m["haplotype"], m["depth"]) == (7, "G", 12)
    pm = formats.population_map(spark, put(tmp_path / "pm.tsv", "#c\nb\t2\nа\t1\tg\n")).orderBy("place").collect()
    assert [(r["pop"], r["grp"]) for r in pm] == [("1", "g"), ("2", "defaultgrp")]
    with pytest.raises(Exception, match="two groups"):
        formats.population_map(spark, put(tmp_path / "pm2.tsv", "a\t1\tx\nb\t1\ty\n")).collect()
    bc = formats.barcodes(spark, put(tmp_path / "b1.tsv", "ACGT\tGGTT\tone\nTTTT\tCCAA\n")).collect()
    assert [(r["barcode"], r["barcode2"], r["sample"]) for r in bc] == [("ACGT", "GGTT", "one"), ("TTTT", "CCAA", "TTTT-CCAA")]
    assert formats.barcodes(spark, put(tmp_path / "b2.tsv", "ACGT\tsample_1\n")).first()["sample"] == "sample_1"
    for text in ("AXGT\n", "ACGT\tGGTT\tone\nTTTT\n"):
        with pytest.raises(Exception, match="barcode"):
            formats.barcodes(spark, put(tmp_path / "b3.tsv", text)).collect()
    cols = formats.marker_columns(spark, put(tmp_path / "w.tsv", "3\t1\n3\t0\n4\n")).collect()
    assert {r["locus"]: r["cols"] for r in cols} == {3: [0, 1], 4: []}
    files = spark.createDataFrame([("x_1.fq.gz",), ("x_2.fq.gz",), ("y_R1_001.fq",), ("y_R2_001.fq",), ("z.fq",)], "path string")
    assert sorted((r["first"], r["second"]) for r in formats.read_pairs(files).collect()) == [("x_1.fq.gz", "x_2.fq.gz"), ("y_R1_001.fq", "y_R2_001.fq"), ("z.fq", None)]


def test_phased_files_and_logs(spark, tmp_path):
    bgl = formats.lines(spark, put(tmp_path / "a.bgl", "I id s1 s1 s2 s2\nM 4_7 A G A A\nM 4_2 C C T C\n"))
    assert {r["sample"]: (r["h1"], r["h2"]) for r in formats.beagle_haplotypes(bgl).collect()} == {"s1": ("CA", "CG"), "s2": ("TA", "CA")}
    fp = formats.lines(spark, put(tmp_path / "a.out", "x\nBEGIN GENOTYPES\n# id s1\nA C\nG C\ns2\nA A\nT C\nEND GENOTYPES\n"))
    assert sorted((r["sample"], r["h1"], r["h2"]) for r in formats.fastphase(fp).collect()) == [("s1", "AC", "GC"), ("s2", "AA", "TC")]
    log = formats.lines(spark, put(tmp_path / "a.log", "a\nBEGIN one\n1\t2\nEND one\nBEGIN two\n3\nEND two\n"))
    assert [r["value"] for r in formats.sections(log, "two").collect()] == ["3"] and formats.sections(log).count() == 2
