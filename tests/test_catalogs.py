import random

import pytest
from pyspark.sql import functions as F

from radspark.functions import cigar
from radspark.operators import alignment, assembly, catalogs
from radspark.operators.catalogs import Locus

LOCI = f"sample string, locus long, {catalogs.LOCUS}"


def loci(spark, rows):
    """rows (sample, locus, consensus, {col: bases}, {haplotype: depth}, depth)"""
    return spark.createDataFrame([(s, n, con, sorted(snps.items()), sorted(al.items()), d) for s, n, con, snps, al, d in rows], LOCI)


def catalog(spark, rows):
    return spark.createDataFrame([(n, con, sorted(snps.items()), al) for n, con, snps, al in rows], catalogs.CATALOG)


def told(df):
    return {r["catalog"]: (r["consensus"], {s["col"]: "".join(sorted(s["bases"])) for s in r["snps"]}, r["alleles"]) for r in df.collect()}


def test_merging_two_loci():
    a = Locus("ACGTACGTAC", [(2, "GA")], ["A", "G"])
    b = Locus("ACGTACTTAC", [(4, "AC")], ["A", "C"])
    m = catalogs.merged(a, b)
    assert (m.consensus, m.snps) == ("ACGTACGTAC", [(2, "GA"), (4, "AC"), (6, "GT")])
    assert m.alleles == ["AAG", "GAG", "GAT", "GCT"]
    # neither varies: the difference of the two is the only SNP; equal ones have none
    assert catalogs.merged(Locus("ACGT"), Locus("ACTT")) == Locus("ACGT", [(2, "GT")], ["G", "T"])
    assert catalogs.merged(Locus("ACGT"), Locus("ACGT")) == Locus("ACGT", [], [])
    # N is no difference, and the longer one's bases come in where the shorter has a gap
    assert catalogs.merged(Locus("ACNT"), Locus("ACGT")) == Locus("ACGT", [], [])
    long = "ACGTTGCATTGACCATGAGGACTTACCATG"
    m = catalogs.merged(Locus(long[:12] + long[13:], [(20, "TC")], ["C", "T"]), Locus(long))
    assert m.consensus == long and m.snps == [(21, "TC")] and m.alleles == ["C", "T"]
    assert catalogs.reduced_alleles(["ACN", "ACG", "ATN", "NNG"]) == ["ACG", "ATN"]


def test_merging_any_two_loci():
    """Every column that varies in either or between them is a SNP, and every haplotype of either is one of the union."""
    rng = random.Random(6)
    for _ in range(300):
        con = [rng.choice("ACGT") for _ in range(12)]
        sides = []
        for _ in range(2):
            own = [rng.choice("ACGT") if rng.random() < 0.15 else x for x in con]
            cols = sorted(rng.sample(range(12), rng.randint(0, 3)))
            alleles = {"".join(own[c] for c in cols)} | {"".join(rng.choice("ACGT") for _ in cols) for _ in range(2)} if cols else set()
            sides.append(Locus("".join(own), [(c, "".join(sorted({h[i] for h in alleles}))) for i, c in enumerate(cols)], sorted(alleles)))
        m = catalogs.merged(*sides)
        seqs = set()
        for s in sides:
            for h in s.alleles or [""]:
                seq = list(s.consensus)
                for (c, _), x in zip(s.snps, h, strict=False):
                    seq[c] = x
                seqs.add("".join(seq))
        cols = [c for c, _ in m.snps]
        vary = {c for s in sides for c, _ in s.snps} | {i for i in range(12) if sides[0].consensus[i] != sides[1].consensus[i]}
        assert cols == sorted(vary) and m.alleles == (sorted({"".join(x[c] for c in cols) for x in seqs}) if cols else [])
        assert all(len(set(x)) == len(x) and {h[i] for h in m.alleles} <= set(x) for i, (_, x) in enumerate(m.snps))


def test_catalog_by_order(spark):
    """Samples in order: exact, near, chained by an allele, new; two catalog loci linked by one locus' alleles become one, and earlier sources follow."""
    a, b, c = "ACGTACGTAC" * 4, "TTGACCATGA" * 4, "GGGTTACAAC" * 4
    put = lambda s, i, x: s[:i] + x + s[i + 1 :]
    rows = [
        ("a", 1, a, {}, {}, 9), ("a", 2, b, {}, {}, 9), ("a", 8, put(put(a, 3, "G"), 5, "G"), {}, {}, 5),
        ("b", 3, a, {}, {}, 4), ("b", 4, put(b, 39, "C"), {}, {}, 4),
        ("c", 5, put(put(b, 39, "C"), 37, "C"), {}, {}, 4), ("c", 6, c, {1: "GT"}, {"G": 3, "T": 2}, 5),
        ("d", 7, a, {3: "TG", 5: "CG"}, {"TC": 4, "GG": 3}, 7),
    ]
    known, sources = catalogs.build(loci(spark, rows), 1, 40)
    assert told(known) == {
        1: (a, {3: "GT", 5: "CG"}, ["GG", "TC"]),
        2: (b, {37: "CT", 39: "AC"}, ["CC", "TA", "TC"]),
        6: (c, {1: "GT"}, ["G", "T"]),
    }
    assert sorted(map(tuple, sources.collect())) == [(1, "a", 1), (1, "a", 8), (1, "b", 3), (1, "d", 7), (2, "a", 2), (2, "b", 4), (2, "c", 5), (6, "c", 6)]
    empty, none = catalogs.build(loci(spark, rows).limit(0), 1, 40)
    assert empty.count() == none.count() == 0
    more, again = catalogs.build(loci(spark, [("e", 20, c, {}, {}, 4), ("e", 21, "CATTAGACCA" * 4, {}, {}, 4)]), 1, 40, seed=known)
    assert set(told(more)) == {1, 2, 6, 21} and sorted(map(tuple, again.collect())) == [(6, "e", 20), (21, "e", 21)]


def test_catalog_with_gaps(spark):
    rng = random.Random(2)
    a = "".join(rng.choice("ACGT") for _ in range(60))
    cut = a[:30] + a[31:]
    rows = [("a", 1, a, {40: a[40] + "N"}, {}, 9), ("b", 2, cut, {}, {}, 9), ("b", 3, "".join(rng.choice("ACGT") for _ in range(60)), {}, {}, 9)]
    rows[0] = ("a", 1, a, {}, {}, 9)
    known, sources = catalogs.build(loci(spark, rows), 1, 60, gapped_k=11)
    assert sorted(map(tuple, sources.collect())) == [(1, "a", 1), (1, "b", 2), (3, "b", 3)]
    assert told(known)[1] == (a, {}, [])
    assert set(told(catalogs.build(loci(spark, rows), 1, 60)[0])) == {1, 2, 3}


def test_sequence_matches_by_brute_force(spark):
    """Random loci with alleles against a random catalog, by the rules one after another."""
    rng = random.Random(11)
    cons = ["".join(rng.choice("AC") for _ in range(6)) for _ in range(14)]
    def some(con):
        cols = sorted(rng.sample(range(6), rng.choice((0, 0, 1, 2))))
        alleles = sorted({"".join(rng.choice("AC") for _ in cols) for _ in range(3)}) if cols else []
        return con, {c: "AC" for c in cols}, alleles
    own = [(f"s{i % 3}", i, con, snps, {h: rng.randint(1, 9) for h in al}, rng.randint(1, 9)) for i, (con, snps, al) in enumerate(some(rng.choice(cons)) for _ in range(120))]
    known = [(n, *some(con)) for n, con in enumerate(cons)]
    spelled = lambda con, snps, h: "".join(h[sorted(snps).index(i)] if i in snps and h != "consensus" else x for i, x in enumerate(con))
    want = set()
    for s, n, con, snps, al, depth in own:
        hits = [(h, c, k) for h in (al or ["consensus"]) for c, ccon, csnps, cal in known for k in (cal or ["consensus"]) if spelled(con, snps, h) == spelled(ccon, csnps, k)]
        found = {c for _, c, _ in hits}
        if not hits:
            continue
        if len(found) > 1:
            want |= {(c, s, n, "multi", None, None) for c in found}
            continue
        c = found.pop()
        if set(snps) - set(known[c][2]):
            want.add((c, s, n, "extra_snp", None, None))
            continue
        good = [(h, k) for h, _, k in hits if sum(x == h for x, _, _ in hits) == 1 and sum(x == k for _, _, x in hits) == 1]
        want |= {(c, s, n, k, al[h] if al else depth, "6M") for h, k in good} or {(c, s, n, "none_verified", None, None)}
    got = catalogs.matches(loci(spark, own), catalog(spark, known), every=True).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {w[3] for w in want} >= {"multi", "extra_snp", "consensus"} and len(want) > 60


def test_haplotypes_over_columns(spark):
    df = spark.createDataFrame([("ACGTAC", [1, 4], "GT", [0, 1, 3, 8])], "con string, cols array<int>, h string, theirs array<int>")
    assert df.select(catalogs.over_columns("con", F.col("cols"), F.col("h"), F.col("theirs"))).first()[0] == "AGTTN"
    for h, want in (("ANT", "ACT"), ("NNN", None), ("AGT", None), ("GCT", "GCT"), ("ACTT", None)):
        got = spark.range(1).select(catalogs.only_compatible(F.lit(h), F.array(*map(F.lit, ("ACT", "GCT", "GGG"))))).first()[0]
        assert got == want


def test_place_matches(spark):
    rows = [
        ("s", 1, "ACGTACGT", {}, {}, 5),  # equal as far as both go
        ("s", 2, "ACGTACGA", {}, {}, 5),  # differs
        ("s", 3, "ACGTACGT", {2: "GT"}, {"G": 3, "T": 4}, 7),  # its SNP and another of the catalog
        ("s", 4, "ACGTACGT", {5: "CT"}, {"C": 3, "T": 4}, 7),  # a SNP that the catalog has not
        ("s", 5, "ACGT", {}, {}, 6),  # short: N past its end, compatible with one allele
        ("s", 6, "ACGT", {}, {}, 6),  # compatible with two
    ]
    known = [(11, "ACGTACGTTT", {}, []), (12, "ACGTACGT", {}, []), (13, "ACGTACGT", {2: "GT", 6: "GA"}, ["GG", "TA", "TG"]), (14, "ACGTACGT", {2: "GT"}, ["G", "T"]), (15, "ACGTACGT", {2: "GT", 6: "GA"}, ["GA", "TG"]), (16, "ACGTACGT", {2: "GT", 6: "GA"}, ["GA", "GG"])]
    at = F.col("locus") % 10
    own, cat = loci(spark, rows).withColumn("bp", at), catalog(spark, known).withColumn("bp", F.col("catalog") % 10)
    got = sorted((r["locus"], r["haplotype"], r["depth"], r["verdict"]) for r in catalogs.place_matches(own, cat, ["bp"]).collect())
    assert got == [(1, "consensus", 5, "verified"), (2, None, None, "none_verified"), (3, "GG", 3, "verified"), (3, "TG", 4, "verified"), (4, None, None, "extra_snp"), (5, "GA", 6, "verified"), (6, None, None, "none_verified")]
    plain = {(r["locus"], r["haplotype"]) for r in catalogs.place_matches(own, cat, ["bp"], impute=False).collect()}
    assert (5, None) in plain and (3, "GG") in plain


def test_gapped_matches(spark):
    """A locus that lacks a base of the catalog's matches allele by allele, its SNPs moved; one with a base more, or with a SNP elsewhere, does not."""
    rng = random.Random(9)
    a, b = ("".join(rng.choice("ACGT") for _ in range(60)) for _ in range(2))
    put = lambda s, i, x: s[:i] + x + s[i + 1 :]
    other = "A" if a[45] != "A" else "G"
    cut = a[:20] + a[21:]
    rows = [
        ("s", 1, cut, {44: a[45] + other}, {a[45]: 6, other: 4}, 10),
        ("s", 2, a[:20] + ("A" if a[20] != "A" else "C") + a[20:], {}, {}, 5),
        ("s", 3, cut, {40: cut[40] + "N"}, {cut[40]: 5}, 5),
        ("s", 4, b[:30] + b[31:], {}, {}, 7),
    ]
    known = catalog(spark, [(1, a, {45: a[45] + other}, sorted([a[45], other])), (2, b, {}, [])])
    got = {(r["locus"], r["catalog"], r["haplotype"], r["depth"], r["cigar"], r["verdict"]) for r in catalogs.gapped_matches(loci(spark, rows), known, 11).collect()}
    where = alignment.align(a, cut)[1]
    whole = cigar.text(where)
    assert got == {
        (1, 1, a[45], 6, whole, "verified"), (1, 1, other, 4, cigar.text(alignment.align(put(a, 45, other), put(cut, 44, other))[1]), "verified"),
        (3, 1, None, None, None, "extra_snp"), (4, 2, "consensus", 7, cigar.text(alignment.align(b, b[:30] + b[31:])[1]), "verified"),
    }
    assert "D" in whole and "I" not in whole
    every = catalogs.matches(loci(spark, rows), known, gapped_k=11)
    assert {(r["locus"], r["haplotype"]) for r in every.collect()} == {(1, a[45]), (1, other), (4, "consensus")}


@pytest.mark.parametrize("distance", [1, 2])
def test_pairs_across(spark, distance):
    rng = random.Random(distance)
    base = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(10)]
    seqs = []
    for b in base:
        for _ in range(4):
            t = list(b)
            for i in rng.sample(range(40), rng.randint(0, 2)):
                t[i] = rng.choice("ACGT")
            seqs.append("".join(t))
    df = spark.createDataFrame([(i, s, i % 2 == 1) for i, s in enumerate(seqs)], "id long, seq string, known boolean")
    dist = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True))
    want = sorted((i, j, dist(x, y)) for i, x in enumerate(seqs) for j, y in enumerate(seqs) if i % 2 == 0 and j % 2 == 1 and 1 <= dist(x, y) <= distance)
    assert sorted(map(tuple, assembly.similar_pairs(df, distance, 40, [], across="known").collect())) == want


def test_phases_over_batches(spark):
    """A sample's rows at a locus may be cut anywhere by batches."""
    from radspark.operators import assembly

    rows = [(l, s, r, c, "AC"[(r + l * c) % 2], "A", "C") for l in range(5) for s in range(3) for r in range(2) for c in range(3)]
    bases = spark.createDataFrame(rows, "locus long, sample int, read long, col int, base string, a1 string, a2 string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = sorted(tuple(r) for r in assembly.phased(bases).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == [(l, s, "phased", "0,1,2", *(("AAA", "CCC") if l % 2 == 0 else ("ACA", "CAC"))) for l in range(5) for s in range(3)]
    assert "Pandas" not in assembly.phased(bases)._jdf.queryExecution().executedPlan().toString()


def test_one_chain_for_a_table(spark):
    """Groups whose genotypes differ in names and order only have one chain, and one P."""
    from radspark.operators import models

    one, two = [("AA", "AC"), ("AC", "AC"), ("AA", "AA"), ("AA", "AC")], [("TT", "GG"), ("TT", "TT"), ("GG", "GG"), ("GG", "TT")]
    haps = spark.createDataFrame([(l, 0, i, *h) for l, g in ((1, one), (2, two)) for i, h in enumerate(g)], "locus long, pop int, sample int, h1 string, h2 string")
    a, b = models.guo_thompson(haps, 100, 4, 500).collect()
    assert (a["hwe_p"], a["se"]) == (b["hwe_p"], b["se"]) and 0 < a["hwe_p"] <= 1


@pytest.mark.parametrize("distance", [1, 3])
def test_pairs_by_parts(spark, distance):
    """Every pair of two sides within the distance, once, sequences shorter than a k-mer included; a row a part, not one a k-mer."""
    rng = random.Random(distance)
    seqs = ["".join(rng.choice("AC") for _ in range(rng.choice([2, 3, 9, 40]))) for _ in range(60)]
    seqs += ["".join(rng.choice("ACGT") if rng.random() < 0.05 else c for c in s) for s in seqs for _ in range(3)]
    one, other = seqs[::2], seqs[1::2]
    made = catalogs.pairs_across(spark.createDataFrame([(s,) for s in one], "sa string"), spark.createDataFrame([(s,) for s in other], "sb string"), distance)
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    want = {(a, b, far(a, b)) for a in one for b in other if len(a) == len(b) and 1 <= far(a, b) <= distance}
    got = [tuple(r) for r in made.collect()]
    assert set(got) == want and len(got) == len(want) > 50
