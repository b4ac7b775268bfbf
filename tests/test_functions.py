import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from radspark.functions import cigar, cross, enzymes
from radspark.operators import alignment, assembly, graphs, models, populations


def test_cigars():
    c = cigar.parse("2S3M1I2M2D4M")
    assert cigar.text(c) == "2S3M1I2M2D4M" and cigar.lengths(c) == (14, 11, 12)
    assert cigar.text(cigar.invert(c)) == "2S3M1D2M2I4M" and cigar.text(cigar.simplified(cigar.parse("2=1X1S2N1H"))) == "3M1I3D"
    assert cigar.text(cigar.ordered(cigar.parse("2M1I3D2M"))) == "2M3D1I2M"
    assert cigar.padded("AACGTTTGGGCC", c) == "NNCGTTTGNNGGCC"
    plain = cigar.parse("3M2D2M1I1M")
    pad = cigar.padded("ACGTTAC", plain)
    assert pad == "ACGNNTTAC" and cigar.unpadded(pad, plain) == "ACGTTAC"
    assert cigar.gap_columns(plain) == [3, 4] and cigar.shift_columns([0, 3, 6], plain) == [0, 5, 8] and cigar.remove_columns([0, 3, 5, 8], plain) == [0, 3, 6]
    assert cigar.text(cigar.extend(cigar.parse("1D3M"), 2, 1)) == "3D3M1D"
    assert cigar.text(cigar.trim_left(cigar.parse("2D3M1I2M"), 4)) == "2I1M1I2M" and cigar.text(cigar.trim_right(cigar.parse("4M2D"), 3)) == "3M1I"
    assert cigar.mismatches("ACGTA", "ACTA", cigar.parse("2M1I2M")) == 0 and cigar.mismatches("ANGT", "ACTT", cigar.parse("4M")) == 1
    for bad in ("", "3", "M3", "3Q"):
        with pytest.raises(ValueError):
            cigar.parse(bad)


def test_enzymes():
    assert enzymes.sites("sbfI") == (("TGCAGG",), ("CCTGCA",)) and enzymes.sites("apeKI")[0] == ("CAGC", "CTGC")
    assert len(enzymes.sites("mslI")[0]) == 32 and enzymes.sites("ddeI")[0] == ("TAAG", "TCAG", "TGAG", "TTAG")
    with pytest.raises(ValueError):
        enzymes.sites("none")


def test_crosses():
    f = frozenset
    kinds = {("A", "B"): "aa/bb", ("AB", "AB"): "ab/ab", ("AB", "AC"): "ab/ac", ("AB", "CD"): "ab/cd", ("AB", "A"): "ab/aa", ("A", "AB"): "aa/ab", ("AB", "C"): "ab/cc", ("C", "AB"): "cc/ab", ("A", "A"): None, ("AB", ""): "ab/--", ("", "AB"): "--/ab", ("", "A"): None}
    assert all(cross.marker_type(f(m) or None, f(d) or None) == k for (m, d), k in kinds.items())
    names = cross.letters(f({"X", "Y"}), f({"Y", "Z"}))
    assert names == {"Y": "a", "X": "b", "Z": "c"} and cross.genotype("Z", "Y", names) == "ac" and cross.genotype("Q", "Y", names) == "--"
    assert cross.segregation_chisq({"aa": 10, "ab": 10}, {"aa": 0.5, "ab": 0.5}) == (0.0, 1) and cross.chisq_p(4.0, 1) == 0.05


def test_alignment():
    rng = random.Random(2)
    score, c, _, _ = alignment.align("ACGTACGTAC", "ACGTCGTAC")
    assert cigar.text(c) in ("4M1D5M", "3M1D6M") and score == 9 * 5 - 10
    for _ in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 12)))
        b = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 12)))
        score, c, _, _ = alignment.align(a, b)
        assert cigar.lengths(c)[1:] == (len(a), len(b))
        i = j = 0
        own = 0.0
        for op, n in c:
            own += sum(5 if x == y else -4 for x, y in zip(a[i : i + n], b[j : j + n], strict=True)) if op == "M" else -10 - 0.5 * (n - 1)
            i, j = i + (n if op in "MD" else 0), j + (n if op in "MI" else 0)
        assert math.isclose(own, score)
        local, c, i, j = alignment.align(a, b, local=True)
        assert local >= max(0, score)
    text = "".join(rng.choice("ACGT") for _ in range(300))
    for _ in range(100):
        i = rng.randrange(280)
        q = text[i : i + rng.randint(1, 20)] + "N" + text[:5]
        n, place = alignment.SuffixTree(text[:150]).longest(q)
        want = max((m for m in range(len(q) + 1) if q[:m] in text[:150]), default=0)
        assert n == want and text[:150][place : place + n] == q[:n]
    read = text[40:70] + "A" + text[70:100]
    got, start = alignment.align_by_matches(text, read)
    assert start == 40 and sum(n for op, n in got if op == "I") == 1 and cigar.lengths(got)[2] == 61
    assert alignment.joined("AAACCCGGGTTTACG", "GGGTTTACGCCA", 5) == ("AAACCCGGGTTTACGCCA", 9) and alignment.joined("AAAA", "CCCC", 3) == ("AAAANNNNNNNNNNCCCC", 0)


def test_graphs():
    tree = graphs.spanning_tree([(1, 2, 1), (2, 3, 1), (1, 3, 2), (4, 5, 3)])
    assert sorted(tree) == [(1, 2, 1), (2, 3, 1), (4, 5, 3)] and not graphs.connected({1, 2, 4}, tree) and graphs.connected({1, 2, 3}, tree)
    assert len(graphs.cut_partitions({1, 2, 3}, [(1, 2, 1), (2, 3, 1)])) == 4
    rng = random.Random(5)
    text = "".join(rng.choice("ACGT") for _ in range(120))
    reads = [text[i : i + 40] for i in range(0, 81, 4)] * 2 + [text[:20] + "ACCA" + text[24:40]]
    assert graphs.contig(reads, 21) == text
    assert graphs.contig(["ACACACACACAC"] * 3, 5) is not None and graphs.DeBruijn(["ACGTACGTACGT"] * 2, 5).best_path() is None
    g = graphs.DeBruijn(["ACGTTGCA"] * 2, 4)
    assert g.gfa()[0].startswith("H") and len(g.parts()) == 1


def test_phasing():
    het = {1: ("A", "G"), 5: ("C", "T"), 9: ("A", "T")}
    reads = [{1: "A", 5: "T"}, {1: "G", 5: "C"}, {5: "C", 9: "T"}]
    assert assembly.phase_sets(reads, het) == [{1: ("A", "G"), 5: ("T", "C"), 9: ("A", "T")}]
    assert assembly.phase_sets([*reads, {1: "A", 5: "C"}], het) is None and len(assembly.phase_sets([*reads, {1: "A", 5: "C"}], het, 2)) == 3
    assert assembly.phase_sets(reads[:1], het) == [{1: ("A", "G"), 5: ("T", "C")}, {9: ("A", "T")}]
    assert assembly.merged_snps([(2, "A", "C")], [(2, "A", "G")], "ACATTT", "ACATGT") == [(2, ["A", "C", "G"]), (4, ["T", "G"])]
    assert assembly.expanded_alleles(["A", "C"], [2], [2, 4, 9], "ACATTT") == ["ATN", "CTN"]


def test_models():
    rng = np.random.default_rng(1)
    truth = rng.choice(3, 40, p=[0.49, 0.42, 0.09])
    counts = np.zeros((40, 4), int)
    for i, g in enumerate(truth):
        counts[i, 0] = rng.binomial(25, [0.995, 0.5, 0.005][g])
        counts[i, 2] = 25 - counts[i, 0]
    major, minor, freq, calls = models.low_coverage(counts)
    assert (major, minor) == (0, 2) and abs(freq - 0.7) < 0.12 and sum(c == g for (c, _), g in zip(calls, truth, strict=True)) >= 39
    kinds, high = models.high_coverage(counts)
    assert kinds == [0, 2] and sum(((a, b) == [(0, 0), (0, 2), (2, 2)][g]) for (a, b, _), g in zip(high, truth, strict=True)) >= 39
    fixed = np.zeros((10, 4), int)
    fixed[:, 1] = 20
    assert models.low_coverage(fixed)[1] is None and models.high_coverage(fixed)[0] == [1] and models.low_coverage(np.zeros((3, 4), int)) is None
    # many sites at once are what they are one by one
    sites = [counts, fixed, rng.integers(0, 9, (7, 4)), rng.integers(0, 2, (5, 4)), np.zeros((3, 4), int), counts[:1]]
    flat, starts = np.concatenate(sites), np.cumsum([0, *map(len, sites)])[:-1]
    site = np.repeat(np.arange(len(sites)), [len(c) for c in sites])
    low_all, high_all = models._low(flat, site, starts), models._high(flat, site, starts)
    for i, c in enumerate(sites):
        own = slice(starts[i], starts[i] + len(c))
        one, many = models.low_coverage(c), models.high_coverage(c)
        assert bool(low_all["read"][i]) == (one is not None) == (many is not None)
        if one:
            pairs = [(one[0], one[0]), tuple(sorted((one[0], one[1] or 0))), (one[1], one[1])]
            assert (low_all["allele"][i], low_all["variable"][i]) == (one[0], one[1] is not None)
            assert list(zip(low_all["a1"][own], low_all["a2"][own], low_all["gq"][own], strict=True)) == [(*pairs[g], q) if g is not None else (-1, -1, 0) for g, q in one[3]]
            assert list(zip(high_all["a1"][own], high_all["a2"][own], high_all["gq"][own], strict=True)) == [(x, y, q) if x is not None else (-1, -1, 0) for x, y, q in many[1]]
    # any genotype frequencies on the grid do no better
    ln = models.likelihoods(counts, 0, 2, 0.01)
    best, top = models.genotype_frequencies(ln, 0.7, 40)
    assert all(models.mixture(np.array((a, b, 40 - a - b)) / 40, ln).sum() <= top + 0.35 for a in range(1, 40) for b in range(1, 40 - a))
    assert models.quality(0, -100) == 40 and models.quality(-3, -3) == 0


def test_guo_thompson():
    def exact(genotypes):
        """The chance of all tables of two alleles no likelier than this one."""
        n, het = len(genotypes), sum(a != b for a, b in genotypes)
        a = sum(g.count(0) for g in genotypes)
        w = {h: 2**h * math.factorial(n) / math.factorial((a - h) // 2) / math.factorial(h) / math.factorial((2 * n - a - h) // 2) for h in range(a % 2, min(a, 2 * n - a) + 1, 2)}
        return sum(v for v in w.values() if v <= w[het] * (1 + 1e-9)) / sum(w.values())

    for g in ([(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 5, [(0, 0)] * 4 + [(0, 1)] * 6 + [(1, 1)] * 2, [(0, 1)] * 8):
        ((p, se),) = models.switched([g], 500, 10, 2000)
        assert abs(p - exact(g)) < max(0.03, 5 * se)
    assert models.switched([[(0, 0)] * 4]) == [(1.0, 0.0)]
    # chains beside others are what they are alone
    groups = [[(0, 1), (1, 2), (0, 0), (2, 2)], [(0, 0)] * 3, [(0, 1)] * 5]
    both = models.switched(groups, 50, 3, 200, [4, 5, 6])
    assert both == [models.switched([g], 50, 3, 200, [s])[0] for g, s in zip(groups, (4, 5, 6), strict=True)]


def test_blocks():
    assert populations.four_gamete_blocks({(1, 2): 3, (1, 3): 4, (2, 3): 4, (3, 4): 2}, 4) == [(1, 2), (3, 4)]


def test_cigar_columns_together(spark):
    """Several functions of CIGAR texts in one pass, each text of a task parsed once."""
    from radspark.operators import files

    texts = ["3M1D2M", None, "7M", "x", "2I3M", "3M1D2M", ""]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, cigar string").coalesce(1)
    made = files.cigar_functions(spark, t)
    got = {r["id"]: tuple(r)[1:] for r in made.collect()}
    assert got[0] == got[5] == (6, 6, 5, "3M1I2M", "3M1D2M", "2D3M1D2M3D", 1)
    assert got[4] == (5, 3, 5, "2D3M", "2I3M", "2D2I3M3D", 0) and all(got[i] == (None,) * 7 for i in (1, 3, 6))
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    seen = []
    spread = cigar.on_texts({"n": (lambda c: seen.append(1) or len(seen), "int")}, F.col("cigar"))
    assert [r[0] for r in t.select(spread["n"]).orderBy("id").collect()] == [1, None, 2, None, 3, 1, None]
