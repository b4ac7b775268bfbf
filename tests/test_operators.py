import math

import duckdb
import pytest

from radspark import catalog
from radspark.operators import popgen

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def check():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in ("supplier", "lineitem", "events", "documents", "conversations", "customer", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", list(catalog.OPS))
def test_against_sql(spark, check, name):
    df = catalog.queries()[name](spark, SF)
    if name not in catalog.oracle_sql():
        # random or sequential ones, whose parts are held against brute force elsewhere: at least they must not depend on how rows are dealt
        rows = plain(df.collect(), df.columns)
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        try:
            again = catalog.queries()[name](spark, SF)
            assert rows and plain(again.collect(), again.columns) == rows
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        return
    got = check.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert plain(df.collect(), df.columns) == plain(got.fetchall(), got.columns)


def genotypes(spark, pairs):
    rows = [(3, 23, i, 0, a, b, 9) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "locus long, col int, sample int, pop int, a1 string, a2 string, dp int")


def test_hand_checked_site(spark):
    """9 samples, p = 0.5, one heterozygote: the tie gives P the alphabetically second allele."""
    calls = genotypes(spark, [("G", "T")] + [("G", "G")] * 4 + [("T", "T")] * 4)
    r = popgen.OPS["site_pop_stats"](spark, calls=calls).first()
    assert (r["n"], r["p_nuc"], r["q_nuc"]) == (9, "T", "G")
    for name, want in (("p", 0.5), ("obs_het", 0.1111), ("exp_het", 0.5), ("pi", 0.5294), ("fis", 0.7901)):
        assert math.isclose(r[name], want, abs_tol=6e-5)


# Haplotypes of nine samples at two loci, and the statistics known for them.
KNOWN = {4: "A A A G AG AG G G G".split(), 5: "G G G C CG CG G G G".split()}
STATS = {4: ("G", "A", 0.5556, 0.2222, 0.4938, 0.5229, 0.5750), 5: ("G", "C", 0.7778, 0.2222, 0.3457, 0.3660, 0.3929)}


def test_known_sites_and_loci(spark):
    calls = spark.createDataFrame([(locus, 0, i, 0, x[0], x[-1], 9) for locus, g in KNOWN.items() for i, x in enumerate(g)], CALLS)
    for r in popgen.OPS["site_pop_stats"](spark, calls=calls).collect():
        want = STATS[r["locus"]]
        assert (r["p_nuc"], r["q_nuc"]) == want[:2]
        assert all(math.isclose(r[n], w, abs_tol=6e-5) for n, w in zip(("p", "obs_het", "exp_het", "pi", "fis"), want[2:], strict=True))
    haps = spark.createDataFrame([(locus, i, 0, 0, x[0], x[-1]) for locus, g in KNOWN.items() for i, x in enumerate(g)], HAPS)
    for name, col in (("gene_diversity", "gene_diversity"), ("haplotype_diversity", "hapl_diversity")):
        got = {r["locus"]: round(r[col], 4) for r in popgen.OPS[name](spark, haps=haps).collect()}
        assert got == {4: 0.5229, 5: 0.3660}


CALLS = "locus long, col int, sample int, pop int, a1 string, a2 string, dp int"
HAPS = "locus long, sample int, pop int, grp int, h1 string, h2 string"


def brute_site(pairs):
    copies = [a for p in pairs for a in p]
    kinds = sorted(set(copies))
    if not pairs or len(kinds) > 2:
        return None
    x, y = kinds[0], kinds[-1]
    nx = copies.count(x)
    p, q = (x, None) if x == y else (x, y) if nx > len(copies) - nx else (y, x)
    n, m = copies.count(p), len(copies)
    pi = 1 - (n * (n - 1) + (m - n) * (m - n - 1)) / (m * (m - 1))
    het = sum(a != b for a, b in pairs) / len(pairs)
    return len(pairs), p, q, n / m, het, pi, -7 if pi == 0 else (pi - het) / pi


def test_sites_with_gaps_and_third_alleles(spark):
    """NULLs, three alleles in a population or over populations, fixed sites, one population, no rows."""
    import random

    rng = random.Random(4)
    rows = []
    for locus in range(60):
        kinds = "ACGT"[: rng.choice([1, 2, 2, 2, 3])]
        for s in range(9):
            g = [rng.choice(kinds[:2] if s % 3 else kinds) for _ in range(2)]
            if rng.random() < 0.2:
                g[rng.randrange(2)] = None
            if locus % 7 or s % 3 == 0:
                rows.append((locus, 0, s, s % 3, *g, rng.randint(0, 9)))
    calls = spark.createDataFrame(rows, CALLS)
    got = {(r["locus"], r["pop"]): (r["n"], r["p_nuc"], r["q_nuc"], r["p"], r["obs_het"], r["pi"], r["fis"]) for r in popgen.OPS["site_pop_stats"](spark, calls=calls).collect()}
    want = {}
    for locus in range(60):
        for pop in range(3):
            v = brute_site([(a, b) for lo, _, _, p, a, b, _ in rows if (lo, p) == (locus, pop) and a and b])
            if v:
                want[locus, pop] = v
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k][:3] == w[:3] and all(math.isclose(a, b, abs_tol=2e-9) for a, b in zip(got[k][3:], w[3:], strict=True))
    for r in popgen.OPS["site_meta_stats"](spark, calls=calls).collect():
        here = {p: want[r["locus"], p] for p in range(3) if (r["locus"], p) in want}
        letters = {x for v in here.values() for x in v[1:3] if x}
        assert r["allele_cnt"] == len(letters)
        if len(letters) > 2:
            assert r["p_allele"] is None and r["p_freq"] is None and r["priv_allele"] == -1
        else:
            freq = sum((v[3] if v[1] == r["p_allele"] else 1 - v[3]) * v[0] for v in here.values()) / sum(v[0] for v in here.values())
            assert math.isclose(r["p_freq"], freq, abs_tol=2e-9) and r["p_freq"] >= 0.5
    for name in ("fst_pairwise", "fisher_exact", "hwe_exact", "sumstats_summary", "missing_per_sample", "keep_first_snp", "export_genepop", "export_vcf_rows", "export_phylip"):
        op = catalog.OPS[name]
        assert op(spark, calls=calls).count() >= 0
        assert op(spark, calls=calls.where("pop = 0")).count() >= 0
        assert op(spark, calls=calls.limit(0)).count() == 0


def test_fisher():
    from itertools import product

    comb = math.comb
    for a, b, c, d in product(range(5), repeat=4):
        if a + b and c + d:
            r1, r2, c1 = a + b, c + d, a + c
            w = {k: comb(r1, k) * comb(r2, c1 - k) for k in range(max(0, c1 - r2), min(r1, c1) + 1)}
            low = a * d < c * b
            tail = sum(v for k, v in w.items() if (k <= a if low else k >= a))
            far = 0
            for k in sorted(w, reverse=low):
                if far + w[k] >= tail:
                    break
                far += w[k]
            assert math.isclose(popgen.fisher_p(a, b, c, d), min(1, (tail + far) / comb(r1 + r2, c1)), rel_tol=1e-9)


def test_entry_without_llm(tmp_path):
    """Without the text operators the rest still imports."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "radspark", tmp_path / "radspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.catalog.OPS) and 'site_pop_stats' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nulls_and_empty(spark):
    calls = genotypes(spark, [("A", "C"), (None, None), ("A", "A")])
    assert popgen.OPS["site_pop_stats"](spark, calls=calls).first()["n"] == 2
    assert popgen.OPS["site_pop_stats"](spark, calls=calls.limit(0)).count() == 0


def test_phi_sc_without_variance(spark):
    """Two populations in two groups, each of one haplotype: nothing varies but the groups, and Phi_sc is 0 / 0, as in the checking engine."""
    haps = spark.createDataFrame([(1, i, i // 2, i // 2, "AC"[i // 2], "AC"[i // 2]) for i in range(4)], "locus long, sample int, pop int, grp int, h1 string, h2 string")
    r = popgen.OPS["phi_st_pairs"](spark, haps=haps).first()
    assert r["phi_st"] == r["phi_ct"] == 1 and math.isnan(r["phi_sc"])


def test_complete_haplotypes_before_sites_go(spark, check):
    """A site that one population lacks makes the haplotypes of a locus incomplete; the query's SQL erases it in its turn, not before."""
    have = {0: {4}, 1: set(), 2: {1, 4, 9}, 3: {2, 8, 11}}
    rows = [(566, c, s, s % 3, "A", "C", 2) for c, lack in have.items() for s in range(12) if s not in lack]
    calls = spark.createDataFrame(rows, "locus long, col int, sample int, pop int, a1 string, a2 string, dp int")
    from radspark.operators import populations

    got = populations.OPS["populations_haplotypes"](spark, calls=calls)
    assert sorted((r["col"], r["called"], r["pops"]) for r in got.collect()) == [(0, 11, 3), (1, 12, 3)]


def test_vcf_line_for_every_site(spark):
    """Sites with a third allele, and those that no sample has a call at, have their lines, here and in the SQL."""
    rows = [(1, 0, 0, 0, "A", "C", 5), (1, 0, 1, 0, "G", "C", 4), (1, 0, 2, 1, "C", "C", 2), (2, 1, 0, 0, None, None, 3), (2, 1, 1, 0, "T", None, 1), (3, 0, 0, 0, "T", "T", 7), (3, 0, 2, 1, "A", "T", 6)]
    got = {(r["part"], r["line"]): r["value"] for r in catalog.OPS["export_vcf_rows"](spark, calls=spark.createDataFrame(rows, CALLS)).collect()}
    line = lambda *x: "\t".join(x)
    want = {
        (1, 0): line("1", "1", "1:0", "C", "A,G", ".", "PASS", "NS=3;AF=0.167,0.167", "GT:DP", "0/1:5", "0/2:4", "0/0:2"),
        (2, 1): line("2", "2", "2:1", "N", ".", ".", "PASS", "NS=0;AF=0.0", "GT:DP", "./.", "./.", "./."),
        (3, 0): line("3", "1", "3:0", "T", "A", ".", "PASS", "NS=2;AF=0.25", "GT:DP", "0/0:7", "./.", "0/1:6"),
    }
    assert got == want
    values = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)
    made = catalog.OPS["export_vcf_rows"].check_sql({"calls": f"SELECT * FROM (VALUES {values}) t(locus, col, sample, pop, a1, a2, dp)"})
    assert {(r[0], r[1]): r[2] for r in duckdb.sql(made).fetchall()} == want
