import random

from radspark.operators import cleaning, crosses

GENOTYPES = "locus long, marker string, sample int, genotype string"


def test_site_states_by_the_rules(spark):
    def state(counts, bases):
        r = sorted(((-n, b) for b, n in counts.items() if n), key=lambda x: x)
        n = [-x for x, _ in r] + [0, 0, 0]
        height = sum(counts.values())
        if height < 5 or n[2] > 0 and n[1] <= n[2]:
            return "unknown"
        if len(r) < 2 or r[0][1] not in bases or r[1][1] not in bases or n[1] / height < 0.05:
            return "hom"
        return "unknown" if n[1] / height < 0.1 else "het"

    rng = random.Random(4)
    rows, want = [], {}
    for s in range(200):
        counts = {b: n for b, n in zip("ACGT", (rng.choice((0, 3, 30, 60)), rng.choice((0, 1, 3, 5, 20)), rng.choice((0, 0, 1, 3)), 0), strict=True)}
        rows += [(1, s, b, n) for b, n in counts.items() if n]
        if sum(counts.values()):
            want[s] = state(counts, "AC")
    got = crosses.site_states(spark.createDataFrame(rows, "locus long, sample int, haplotype string, count long"), spark.createDataFrame([(1, 0, "AC")], "locus long, i int, bases string"))
    assert {r["sample"]: r["state"] for r in got.collect()} == want and set(want.values()) == {"het", "hom", "unknown"}


def test_corrected_genotypes(spark):
    markers = spark.createDataFrame([(1, "ab/ab", {"AC": "a", "GT": "b"}), (2, "ab/aa", {"A": "a", "C": "b"})], "locus long, marker string, letters map<string,string>")
    sites = spark.createDataFrame([(1, 0, "AG"), (1, 1, "CT"), (2, 0, "AC")], "locus long, i int, bases string")
    seen = [
        (1, 0, "AC", 20), (1, 0, "GT", 8),  # a heterozygote called homozygous
        (1, 1, "AC", 20), (1, 1, "GC", 8),  # one site varies only
        (1, 2, "AC", 3),  # too few reads
        (1, 3, "AC", 20), (1, 3, "GT", 8),  # called heterozygous already
        (1, 4, "AC", 20), (1, 4, "GT", 6), (1, 4, "AT", 4),  # a third haplotype
        (1, 5, "AC", 20), (1, 5, "GT", 8),  # not called
        (2, 0, "C", 20), (2, 0, "A", 5),
    ]
    calls = [(1, 0, "aa"), (1, 1, "aa"), (1, 2, "aa"), (1, 3, "ab"), (1, 4, "aa"), (1, 5, "--"), (2, 0, "bb")]
    got = crosses.corrected(spark.createDataFrame(calls, "locus long, sample int, genotype string"), spark.createDataFrame(seen, "locus long, sample int, haplotype string, count long"), sites, markers)
    assert {(r["locus"], r["sample"]): (r["genotype"], r["corrected"]) for r in got.collect()} == {
        (1, 0): ("ab", True), (1, 1): ("aa", False), (1, 2): ("-", True), (1, 3): ("ab", False), (1, 4): ("--", True), (1, 5): ("--", False), (2, 0): ("ab", True),
    }


def test_null_alleles(spark):
    """Shares that only a lacking allele gives change marker and genotypes; those of a whole cross, and none at all, don't."""
    loci = {
        (1, "ab/aa"): ["aa"] * 20 + ["ab"] * 10 + ["bb"] * 10, (2, "ab/aa"): ["aa"] * 20 + ["ab"] * 20, (3, "cc/ab"): ["ac"] * 10 + ["bc"] * 10 + ["aa"] * 10 + ["bb"] * 10,
        (4, "aa/bb"): ["aa"] * 20 + ["ab"] * 20, (5, "aa/bb"): ["bb"] * 20 + ["ab"] * 20, (6, "aa/bb"): ["ab"] * 40, (7, "ab/cc"): ["--"] * 9, (8, "ab/ab"): ["aa"] * 10 + ["ab"] * 20 + ["bb"] * 10,
        (9, "ab/cc"): ["ac"] * 10 + ["bc"] * 9 + ["aa"] * 11 + ["bb"] * 10 + ["--"] * 5,
    }
    rows = [(n, kind, i, g) for (n, kind), calls in loci.items() for i, g in enumerate(calls)]
    got = {}
    for r in crosses.null_alleles(spark.createDataFrame(rows, GENOTYPES)).collect():
        got.setdefault((r["locus"], r["new_marker"]), set()).add((r["genotype"], r["new_genotype"]))
    same = lambda *g: {(x, x) for x in g}
    assert got == {
        (1, "ab/a-"): {*same("aa", "ab"), ("bb", "ab")}, (2, "ab/aa"): same("aa", "ab"), (3, "-c/ab"): {("ac", "bc"), ("bc", "bd"), ("aa", "ac"), ("bb", "ad")}, (4, "aa/b-"): {*same("aa"), ("ab", "bb")},
        (5, "-a/bb"): {*same("bb"), ("ab", "aa")}, (6, "aa/bb"): same("ab"), (7, "ab/cc"): same("--"), (8, "ab/ab"): same("aa", "ab", "bb"), (9, "ab/c-"): {*same("ac", "bc", "--"), ("aa", "ad"), ("bb", "bd")},
    }


def test_mates_turned(spark):
    """Both orders, with errors and barcodes of several lengths; qualities and names go with their mate."""
    site = "TGCAGG"
    rows = [
        (0, "AC" + site + "AAA", "TTTTTTTTTTT", "I1", "J1"), (1, "TTTTTTTTTTT", "AC" + site + "AAA", "I2", "J2"),
        (2, "GGG" + site, "AC" + site, "I3", "J3"),  # both: stays
        (3, "ACTGCATTAAA", "ACTGCAGTAAA", "I4", "J4"),  # 4 and 5 letters
        (4, "ACTGCATTAAA", "GGTGCATTAAA", "I5", "J5"),  # as many: stays
        (5, "T", None, "I6", "J6"), (6, None, "GGG" + site, "I7", "J7"),
    ]
    df = spark.createDataFrame(rows, "id int, seq1 string, seq2 string, qual1 string, qual2 string")
    got = {r["id"]: r for r in cleaning.transposed(df, "sbfI", (2, 3)).collect()}
    for i, a, b, q, p in rows:
        turned = i in (1, 3, 6)
        assert (got[i]["swapped"], got[i]["seq1"], got[i]["seq2"], got[i]["qual1"], got[i]["qual2"]) == ((True, b, a, p, q) if turned else (False, a, b, q, p)), i


def test_progeny_by_rows(spark):
    """Genotypes and segregation of every kind of cross, against the functions over one locus at a time; no group of rows goes to Python."""
    import random

    from radspark.functions import cross
    from radspark.operators import crosses, loci

    rng = random.Random(8)
    rows = []
    for locus in range(120):
        kinds = ["AC", "AG", "CC", "GT"][: rng.choice([1, 2, 3, 4])]
        for s in range(12):
            if s > 1 or rng.random() < 0.85:
                rows.append((locus, s, s % 3, 0, *(rng.choice([*kinds, "NA"] if rng.random() < 0.1 else kinds) for _ in range(2))))
    haps = spark.createDataFrame(rows, "locus long, sample int, pop int, grp int, h1 string, h2 string")
    made = crosses.progeny_genotypes(haps)
    want, tests = set(), set()
    for locus in range(120):
        own = {r[1]: r[4:] for r in rows if r[0] == locus and "N" not in r[4] + r[5]}
        m, f = (frozenset(own.get(s, ())) for s in (0, 1))
        kind = cross.marker_type(m or None, f or None)
        if not kind:
            continue
        names = cross.letters(m, f) if m and f else {}
        calls = {s: cross.translated(kind, "cp", cross.genotype(*h, names)) for s, h in own.items() if s > 1}
        want |= {(locus, kind, s, g) for s, g in calls.items()}
        shares = cross.SEGREGATION["cp"].get(cross.MAP_TYPES["cp"].get(kind, ""))
        if shares and calls:
            n = {g: list(calls.values()).count(g) for g in shares}
            x, df = cross.segregation_chisq(n, shares)
            tests.add((locus, kind, sum(n.values()), round(x, 6), df, cross.chisq_p(x, df)))
    assert {tuple(r) for r in made.collect()} == want and len({k for _, k, _, _ in want}) == 10
    got = loci.segregation(spark, haps)
    assert {tuple(r) for r in got.collect()} == tests
    assert not any("Pandas" in d._jdf.queryExecution().executedPlan().toString() for d in (made, got))
