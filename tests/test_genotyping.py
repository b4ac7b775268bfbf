import random

from radspark import runs
from radspark.functions import cigar
from radspark.operators import alignment, genotyping, sinks
from radspark.sources import formats

READS = "locus long, sample int, read long, mate int, seq string"


def letters(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def swap(s, i):
    return s[:i] + ("A" if s[i] != "A" else "C") + s[i + 1 :]


def test_overlaps():
    """Exact, with errors, with a gap, short and found by the tails alone, none, and the second contig within the first."""
    rng = random.Random(5)
    for _ in range(40):
        s = letters(rng, 140)
        left, right = s[:90], s[60:]
        assert alignment.overlap(left, right) == 30
        assert alignment.overlap(swap(left, 75), right) == 30
        assert alignment.overlap(left[:74] + left[75:], right) == 30 and alignment.overlap(left, right[:14] + right[15:]) == 29
        assert alignment.joined(swap(left, 75), right)[0] == swap(s, 75)
        assert alignment.overlap(left, s[80:]) == 10  # no seed of 12
        assert alignment.overlap(left, swap(s[78:], 5)) == 12
    far = [alignment.overlap(letters(rng, 90), letters(rng, 80)) for _ in range(60)]
    assert sum(n == 0 for n in far) > 50
    assert alignment.joined("ACGT" * 5, "GGTTAACC" * 4)[1] == 0


def test_placed_reads():
    """Reads with substitutions, a base more, a base less, over the end, and of elsewhere."""
    rng = random.Random(1)
    contig = letters(rng, 200)
    tree = alignment.SuffixTree(contig)
    for _ in range(60):
        i = rng.randrange(0, 120)
        read = contig[i : i + 60]
        assert genotyping.placed(contig, swap(swap(read, 20), 45), tree, 12, 0.8) == (i, "60M")
        start, c = genotyping.placed(contig, read[:30] + read[31:], tree, 12, 0.8)
        assert start == i and cigar.lengths(cigar.parse(c))[1:] == (60, 59) and "1D" in c
        start, c = genotyping.placed(contig, read[:30] + rng.choice("ACGT") + read[30:], tree, 12, 0.8)
        assert start == i and cigar.lengths(cigar.parse(c))[1:] == (60, 61)
    assert genotyping.placed(contig, contig[170:] + letters(rng, 5), tree, 12, 0.8) == (170, "30M5S")
    assert genotyping.placed(contig, letters(rng, 60), tree, 12, 0.8) is None


def test_pileup_by_brute_force(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for n in range(300):
        locus, sample = rng.randrange(4), f"s{rng.randrange(3)}"
        c = [("S", rng.randint(1, 3))] if rng.random() < 0.2 else []
        c += [("M", rng.randint(5, 12))]
        if rng.random() < 0.5:
            c += [(rng.choice("ID"), rng.randint(1, 3)), ("M", rng.randint(4, 9))]
        seq = "".join(rng.choice("ACGTN") for _ in range(cigar.lengths(c)[2]))
        start, depth = rng.randrange(20), rng.randint(1, 3)
        rows.append((locus, sample, n, seq, depth, start, cigar.text(c)))
        q, t = 0, start
        for op, k in c:
            for j in range(k if op == "M" else 0):
                if seq[q + j] != "N":
                    cell = want.setdefault((locus, t + j, sample), [0, 0, 0, 0])
                    cell["ACGT".index(seq[q + j])] += depth
            q += k if op in "MIS" else 0
            t += k if op in "MD" else 0
    df = spark.createDataFrame(rows, "locus long, sample string, read long, seq string, depth long, start int, cigar string").repartition(3)
    got = {(r["locus"], r["col"], r["sample"]): [r["na"], r["nc"], r["ng"], r["nt"]] for r in genotyping.pileup(df).collect()}
    assert got == want
    assert genotyping.pileup(df.limit(0)).count() == 0


def test_locus_run_and_its_files(spark, tmp_path):
    """Paired reads of six samples at three loci, with errors and, in some samples, a lacking base: contigs whole, calls right, sites of both mates phased, and the file read back equal."""
    rng = random.Random(12)
    rows, truth, full = [], {}, {}
    for locus in range(3):
        s = letters(rng, 150)
        full[locus] = s
        sites = {25: swap(s, 25)[25], 120: swap(s, 120)[120]}
        for sample in range(6):
            pair = []
            for k in range(2):
                alt = {0: (0, 0), 1: (0, 1), 2: (1, 1), 3: (0, 1), 4: (1, 0), 5: (0, 0)}[sample][k]
                h = s
                for i, x in sites.items():
                    h = h[:i] + x + h[i + 1 :] if alt else h
                pair.append(h)
            truth[locus, sample] = pair
            for n in range(36):
                h = pair[n % 2]
                ends = h[:80], h[70 - n % 3 * 5 :][: 80 + n % 3 * 5]
                if sample == 5 and n % 6 == 0:
                    ends = ends[0], ends[1][:40] + ends[1][41:]  # a base less
                for mate, seq in zip((1, 2), ends, strict=True):
                    if rng.random() < 0.05:
                        seq = swap(seq, rng.randrange(len(seq)))
                    rows.append((locus, sample, (locus * 6 + sample) * 100 + n, mate, seq))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, READS).repartition(4)
    out = runs.genotype_pairs(df, str(tmp_path / "run"))
    ctg = {r["locus"]: (r["contig"], r["kind"]) for r in out["contigs"].collect()}
    for locus, s in full.items():
        # at a site of two bases either may stand in the contig
        got, kind = ctg[locus]
        assert kind == "overlap" and len(got) == len(s) and {i for i in range(150) if got[i] != s[i]} <= {25, 120}
    assert out["aligned"].count() > 0.97 * len(rows)
    calls = {(r["locus"], r["col"], r["sample"]): r for r in out["calls"].where("variable").collect()}
    assert {c for _, c, _ in calls} == {25, 120}
    for (locus, col, sample), r in calls.items():
        assert sorted((r["a1"], r["a2"])) == sorted(h[col] for h in truth[locus, sample])
    phased = {(r["locus"], r["sample"]): r for r in out["phases"].collect()}
    for (locus, sample), pair in truth.items():
        if sample in (1, 3, 4):
            r = phased[locus, sample]
            assert (r["status"], r["cols"]) == ("phased", "25,120") and {r["h1"], r["h2"]} == {h[25] + h[120] for h in pair}
    back = formats.vcf_calls(formats.lines(spark, str(tmp_path / "run" / "catalog.calls.vcf")))
    seen = 0
    for r in back.where("array_contains(split(format, ':'), 'GT')").collect():
        c = calls[int(r["chrom"]), r["pos"], int(r["sample"])]
        seen += 1
        assert sorted((r["a1"], r["a2"])) == [c["a1"], c["a2"]] and (r["gq"], r["dp"]) == (c["gq"], c["depth"])
        assert r["ad"] == [c["counts"]["ACGT".index(c["allele"])], c["counts"]["ACGT".index(c["other"])]]
        assert all(abs(x - y) < 0.012 for x, y in zip(r["gl"], c["gl"], strict=True))
        if c["a1"] != c["a2"]:
            assert r["ps"] == "26" and r["gt"] in ("0|1", "1|0")
            i = (25, 120).index(r["pos"])
            assert [r["a1"], r["a2"]] == [phased[int(r["chrom"]), int(r["sample"])][h][i] for h in ("h1", "h2")]
    assert seen == len(calls) == 36
    fixed = back.where("format = 'DP'").where("pos = 10").collect()
    assert len(fixed) == 18 and all(r["gt"] == "./." and r["dp"] == 36 for r in fixed)
    fa = {r["name"]: r["seq"] for r in formats.fasta(formats.lines(spark, str(tmp_path / "run" / "catalog.fa"))).collect()}
    assert fa == {str(k): v for k, (v, _) in ctg.items()}


def test_discarded_phases(spark):
    """Reads that contradict each other: the sample's heterozygotes are not called, and FT says so."""
    called = spark.createDataFrame(
        [(1, c, s, True, "A", "G", 0.5, *g, 30, 8, [-5.0, -1.0, -6.0], [4, 0, 4, 0]) for c in (2, 5) for s, g in ((0, ("A", "G")), (1, ("A", "A")), (2, (None, None)))],
        "locus long, col int, sample int, variable boolean, allele string, other string, freq double, a1 string, a2 string, gq int, depth long, gl array<double>, counts array<int>",
    )
    p = spark.createDataFrame([(1, 0, "inconsistent", "", "", "")], "locus long, sample int, status string, cols string, h1 string, h2 string")
    lines = [r["value"].split("\t") for r in sinks.called_lines(called, called.select("sample"), p).orderBy("line").collect()]
    assert [x[9].split(":")[:4] for x in lines] == [["./.", ".", "disc", "."]] * 2 and lines[0][10].startswith("0/0:.:.:30:8:4,4:-2.17,-0.43,-2.61") and lines[0][11].startswith("./.:.:.:.:8")
    assert lines[0][7] == "DP=24;AD=12,12;AF=0.0"


def test_repeats_beside_an_error():
    """An error among repeated letters is a mismatch where that scores more than a gap, or than a shorter exact overlap."""
    for s in ("ATCATGATCTTAAAAAACCCACCAGTAAGGGGGGGTTGAATGTATGGTTTCATGCTACTACTGC", "ATGCGCTGTAATTGAGGGTTCAGGTTGCGTTGCGTTGCGGGGGCGATCTGGATGTGCGGACAGA", "CTTGTCTATCCATCCCAGGAGTGTATAGACGTATACACGTAATCCCCGCTGCCTAACACTAAAG"):
        forward = s[:35] + s[35].translate(str.maketrans("ACGT", "CGTA")) + s[36:40]
        assert alignment.joined(forward, s[24:], 8) == (forward + s[40:], 16)


def test_placed_among_repeats():
    """A mismatch among repeated letters is no gap."""
    contig, read = "CAATGAGGTTGGGCTTTAGTGTAGTATACGGTTGGGGGGGCATGTGTCTCAACCCGGAACGGGT", "TTGGGGGGCATGTGTCTCAACCCGGAACGGGT"
    assert genotyping.placed(contig, read, alignment.SuffixTree(contig), 8, 0.8) == (32, "32M")
