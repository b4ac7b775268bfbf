"""Population statistics over calls and haplotypes in long form: every one a plan of aggregates, joins and windows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Fn, Op
from . import smoothing

CALLS = ("calls",)


def _long(d: Dialect) -> str:
    """One row an allele copy of a called genotype."""
    called = "a1 IS NOT NULL AND a2 IS NOT NULL"
    return f"SELECT locus, col, pop, sample, a1 AS a FROM @calls WHERE {called} UNION ALL SELECT locus, col, pop, sample, a2 FROM @calls WHERE {called}"


def _site(d: Dialect) -> dict[str, str]:
    """Per site and population, from one aggregate: counts, the two alleles (p >= q, ties to the alphabetically second), frequencies.

    Genotypes without both alleles are not called. A population with three or four alleles at a site has no row there.
    """
    copies = ", ".join(f"sum(CASE WHEN a1 = '{x}' THEN 1 ELSE 0 END + CASE WHEN a2 = '{x}' THEN 1 ELSE 0 END) AS n{x}" for x in "ACGT")
    kinds = " + ".join(f"CASE WHEN n{x} > 0 THEN 1 ELSE 0 END" for x in "ACGT")
    present = lambda order, what: "CASE " + " ".join(f"WHEN n{x} > 0 THEN {what.format(x)}" for x in order) + " END"
    first, last, least = present("ACGT", "'{}'"), present("TGCA", "'{}'"), present("ACGT", "n{}")
    return {
        "tally": f"SELECT locus, col, pop, count(*) AS n, sum(CASE WHEN a1 <> a2 THEN 1 ELSE 0 END) AS het, {copies} FROM @calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL GROUP BY locus, col, pop",
        "counted": f"SELECT locus, col, pop, n, het, {first} AS x, {last} AS y, {least} AS nx FROM tally WHERE {kinds} <= 2",
        "site": """SELECT locus, col, pop, n, het, nx, 2 * n - nx AS ny, CASE WHEN x = y THEN x WHEN nx > 2 * n - nx THEN x ELSE y END AS p_nuc, CASE WHEN x = y THEN NULL WHEN nx > 2 * n - nx THEN y ELSE x END AS q_nuc,
          greatest(nx, 2 * n - nx) AS np, least(nx, 2 * n - nx) AS nq FROM counted""",
        "stats": """SELECT site.*, np / (2.0E0 * n) AS p, het / (1.0E0 * n) AS obs_het, 1E0 - (np * (np - 1) + nq * (nq - 1)) / (2.0E0 * n * (2 * n - 1)) AS pi FROM site""",
    }


def _meta(d: Dialect) -> dict[str, str]:
    """Over populations: with more than two alleles a site has no P and Q and no frequency."""
    return _site(d) | {
        "alleles": "SELECT locus, col, count(DISTINCT a) AS allele_cnt, min(a) AS x, max(a) AS y FROM (SELECT locus, col, p_nuc AS a FROM stats UNION ALL SELECT locus, col, q_nuc FROM stats WHERE q_nuc IS NOT NULL) l GROUP BY locus, col",
        "oriented": """SELECT s.locus, s.col, m.allele_cnt, m.x, m.y, sum(s.n) AS n, sum(s.het) AS het, sum(CASE WHEN s.p_nuc = m.x THEN s.np WHEN s.q_nuc = m.x THEN s.nq ELSE 0 END) AS nx,
          sum(CASE WHEN s.p_nuc = m.x OR s.q_nuc = m.x THEN 1 ELSE 0 END) AS x_cnt, sum(CASE WHEN s.p_nuc = m.y OR s.q_nuc = m.y THEN 1 ELSE 0 END) AS y_cnt,
          max(CASE WHEN s.p_nuc = m.x OR s.q_nuc = m.x THEN s.pop END) AS x_pop, max(CASE WHEN s.p_nuc = m.y OR s.q_nuc = m.y THEN s.pop END) AS y_pop, count(*) AS pops
          FROM stats s JOIN alleles m ON s.locus = m.locus AND s.col = m.col GROUP BY s.locus, s.col, m.allele_cnt, m.x, m.y""",
        "meta": """SELECT locus, col, allele_cnt, n, het, pops, CASE WHEN allele_cnt > 2 THEN NULL WHEN nx < 2 * n - nx THEN y ELSE x END AS p_allele,
          CASE WHEN allele_cnt <> 2 THEN NULL WHEN nx < 2 * n - nx THEN x ELSE y END AS q_allele,
          CASE WHEN allele_cnt <= 2 THEN greatest(nx, 2 * n - nx) / (2.0E0 * n) END AS p_freq, het / (1.0E0 * n) AS obs_het, allele_cnt = 1 AS fixed,
          CASE WHEN allele_cnt <> 2 THEN -1 WHEN y_cnt = 1 AND x_cnt > 1 THEN y_pop WHEN x_cnt = 1 AND y_cnt > 1 THEN x_pop ELSE -1 END AS priv_allele FROM oriented""",
    }


#: Site and metapopulation statistics once more, from ranked allele counts instead of letters' sums: for checks only.
_CHECK_SITE = """WITH c_copy AS (SELECT locus, col, pop, sample, a1 <> a2 AS h, unnest([a1, a2]) AS a FROM @calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL),
  c_rank AS (SELECT locus, col, pop, a, count(*) AS c, row_number() OVER (PARTITION BY locus, col, pop ORDER BY count(*) DESC, a DESC) AS k FROM c_copy GROUP BY locus, col, pop, a),
  c_pop AS (SELECT locus, col, pop, CAST(sum(c) // 2 AS BIGINT) AS n, max(a) FILTER (k = 1) AS p_nuc, max(a) FILTER (k = 2) AS q_nuc, max(c) FILTER (k = 1) AS np, coalesce(max(c) FILTER (k = 2), 0) AS nq FROM c_rank GROUP BY locus, col, pop HAVING max(k) <= 2),
  c_het AS (SELECT locus, col, pop, count(*) FILTER (h) // 2 AS het FROM c_copy GROUP BY locus, col, pop),
  c_site AS (SELECT c_pop.*, het, np / (2.0 * n) AS p, het / (1.0 * n) AS obs_het, 2 * (np / (2.0 * n)) * (nq / (2.0 * n)) AS exp_het,
    1 - (np * (np - 1) / 2 + nq * (nq - 1) / 2) / (n * (2 * n - 1)) AS pi FROM c_pop JOIN c_het USING (locus, col, pop)),
  c_letter AS (SELECT locus, col, pop, n, unnest([p_nuc, q_nuc]) AS a, unnest([np, nq]) AS c FROM c_site),
  c_allele AS (SELECT locus, col, a, sum(c) AS c, count(*) AS pops, max(pop) AS some_pop, row_number() OVER (PARTITION BY locus, col ORDER BY sum(c) DESC, a) AS k FROM c_letter WHERE a IS NOT NULL GROUP BY locus, col, a),
  c_kinds AS (SELECT locus, col, count(*) AS allele_cnt, max(a) FILTER (k = 1) AS a1, max(a) FILTER (k = 2) AS a2, max(c) FILTER (k = 1) AS c1, sum(c) AS copies, max(pops) FILTER (k = 1) AS pops1, max(pops) FILTER (k = 2) AS pops2,
    max(some_pop) FILTER (k = 1) AS pop1, max(some_pop) FILTER (k = 2) AS pop2 FROM c_allele GROUP BY locus, col),
  c_meta AS (SELECT locus, col, allele_cnt, copies // 2 AS n, CASE WHEN allele_cnt < 3 THEN a1 END AS p_allele, CASE WHEN allele_cnt = 2 THEN a2 END AS q_allele, CASE WHEN allele_cnt < 3 THEN c1 / copies END AS p_freq,
    (SELECT sum(het) FROM c_site s WHERE s.locus = c_kinds.locus AND s.col = c_kinds.col) * 2 / copies AS obs_het, allele_cnt = 1 AS fixed,
    CASE WHEN allele_cnt = 2 AND pops1 = 1 AND pops2 > 1 THEN pop1 WHEN allele_cnt = 2 AND pops2 = 1 AND pops1 > 1 THEN pop2 ELSE -1 END AS priv_allele FROM c_kinds)"""


def _r(x: str, digits: int = 9) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def site_pop_stats(d):
    return _site(d), f"""SELECT locus, col, pop, n, p_nuc, q_nuc, {d.r('p')} AS p, {d.r('obs_het')} AS obs_het, {d.r('1 - obs_het')} AS obs_hom, {d.r('2 * p * (1 - p)')} AS exp_het,
      {d.r('1 - 2 * p * (1 - p)')} AS exp_hom, {d.r('pi')} AS pi, {d.r('CASE WHEN pi = 0 THEN -7 ELSE (pi - obs_het) / pi END')} AS fis FROM stats"""


def site_meta_stats(d):
    return _meta(d), f"SELECT locus, col, allele_cnt, n, p_allele, q_allele, {d.r('p_freq')} AS p_freq, {d.r('obs_het')} AS obs_het, fixed, priv_allele FROM meta"


def private_alleles(d):
    return _meta(d), "SELECT priv_allele AS pop, count(*) AS n_private FROM meta WHERE priv_allele >= 0 GROUP BY priv_allele"


def sumstats_summary(d):
    var = lambda x: f"(sum(({x}) * ({x})) - sum({x}) * sum({x}) / count(*)) / nullif(count(*) - 1, 0)"
    cols = []
    for name, x in (("num_indv", "1E0 * n"), ("p", "p"), ("obs_het", "obs_het"), ("exp_het", "2 * p * (1 - p)"), ("pi", "pi")):
        cols += [f"{d.r(f'avg({x})')} AS {name}_mean", f"{d.r(var(x))} AS {name}_var"]
    return _site(d), "SELECT pop, count(*) AS sites, sum(CASE WHEN pi > 0 THEN 1 ELSE 0 END) AS var_sites, " + ", ".join(cols) + " FROM stats GROUP BY pop"


def locus_filter(d, r=0.5, p=2, R=0.6):
    """Populations with at least the share r of their samples keep theirs; loci need p such populations and the share R of all samples."""
    return {
        "size": "SELECT pop, count(DISTINCT sample) AS size FROM @calls GROUP BY pop",
        "total": "SELECT sum(size) AS total FROM size",
        "present": "SELECT locus, pop, count(DISTINCT sample) AS n FROM @calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL GROUP BY locus, pop",
        "kept": f"SELECT p.locus, p.pop, p.n FROM present p JOIN size s ON p.pop = s.pop WHERE p.n / (1E0 * s.size) >= {r}",
    }, f"SELECT locus, count(*) AS pops, sum(n) AS samples FROM kept GROUP BY locus HAVING count(*) >= {p} AND sum(n) / (SELECT 1E0 * max(total) FROM total) >= {R}"


def snp_filter(d, min_maf=0.05, min_mac=3, max_obs_het=0.7):
    """Minor allele frequency and count, heterozygosity; fixed sites pass, sites with three alleles don't."""
    return _meta(d), f"SELECT locus, col, {d.r('1 - p_freq')} AS maf, floor((1 - p_freq) * 2 * n + 0.5) AS mac FROM meta WHERE allele_cnt = 1 OR (allele_cnt = 2 AND 1 - p_freq >= {min_maf} AND floor((1 - p_freq) * 2 * n + 0.5) >= {min_mac} AND obs_het <= {max_obs_het})"


def depth_mask(d, least=2):
    return {}, f"SELECT locus, col, sample, CASE WHEN dp >= {least} THEN a1 END AS a1, CASE WHEN dp >= {least} THEN a2 END AS a2, dp FROM @calls"


def keep_first_snp(d):
    return _meta(d), "SELECT locus, min(col) AS col FROM meta WHERE allele_cnt = 2 GROUP BY locus"


def ordered_snp_letters(d):
    """Complete haplotypes of a locus by count, as letters; no letters with more than 26."""
    return {
        "h": "SELECT locus, h1 AS h FROM @haps WHERE position('N' IN h1) = 0 UNION ALL SELECT locus, h2 FROM @haps WHERE position('N' IN h2) = 0",
        "c": "SELECT locus, h, count(*) AS n FROM h GROUP BY locus, h",
        "k": "SELECT locus, h, n, row_number() OVER (PARTITION BY locus ORDER BY n DESC, h) AS k, count(*) OVER (PARTITION BY locus) AS m FROM c",
    }, "SELECT locus, h AS haplotype, n, CASE WHEN m > 26 THEN NULL ELSE substring('abcdefghijklmnopqrstuvwxyz', cast(k as int), 1) END AS letter FROM k"


def _pairs(d: Dialect) -> dict[str, str]:
    """Pairs of populations with data at a site that is not fixed alike in both and has two alleles in the two: np2 counts pop 1's P in pop 2."""
    letters = " + ".join(f"CASE WHEN '{x}' IN (a.p_nuc, coalesce(a.q_nuc, a.p_nuc), b.p_nuc, coalesce(b.q_nuc, b.p_nuc)) THEN 1 ELSE 0 END" for x in "ACGT")
    return _site(d) | {
        "pair": f"""SELECT a.locus, a.col, a.pop AS pop1, b.pop AS pop2, a.n AS n1, b.n AS n2, a.pi AS pi1, b.pi AS pi2, a.np AS np1, a.nq AS nq1, CASE WHEN a.p_nuc = b.p_nuc THEN b.np ELSE b.nq END AS np2
          FROM stats a JOIN stats b ON a.locus = b.locus AND a.col = b.col AND a.pop < b.pop
          WHERE NOT (a.pi = 0 AND b.pi = 0 AND a.p_nuc = b.p_nuc)
            AND {letters} <= 2""",
        "fst": "SELECT pair.*, np1 / (2E0 * n1) AS p1, np2 / (2E0 * n2) AS p2, np1 + np2 AS np, 2 * (n1 + n2) - np1 - np2 AS nq, n1 * (2E0 * n1 - 1) AS c1, n2 * (2E0 * n2 - 1) AS c2, (np1 + np2) / (2E0 * (n1 + n2)) AS pbar FROM pair",
        "pooled": """SELECT fst.*, 1E0 - (np * (np - 1E0) + nq * (nq - 1E0)) / (2E0 * (n1 + n2) * (2E0 * (n1 + n2) - 1)) AS pi_all FROM fst""",
        "values_": """SELECT pooled.*, 1 - (c1 * pi1 + c2 * pi2) / (pi_all * (c1 + c2)) AS fst, ((1E0 * n1 * (p1 - pbar) * (p1 - pbar) + 1E0 * n2 * (p2 - pbar) * (p2 - pbar)) / (n1 + n2)) / (pbar * (1 - pbar)) AS amova_fst
          FROM pooled WHERE pi_all <> 0""",
    }


_CHECK_PAIRS = _CHECK_SITE + """,
  c_both AS (SELECT x.locus, x.col, x.pop AS pop1, y.pop AS pop2, x.n AS n1, y.n AS n2, x.pi AS pi1, y.pi AS pi2, x.p_nuc AS letter, list_distinct(list_filter([x.p_nuc, x.q_nuc, y.p_nuc, y.q_nuc], lambda z: z IS NOT NULL)) AS letters
    FROM c_site x JOIN c_site y ON x.locus = y.locus AND x.col = y.col AND x.pop < y.pop),
  c_of AS (SELECT b.*, coalesce((SELECT max(c) FROM c_letter l WHERE l.locus = b.locus AND l.col = b.col AND l.pop = b.pop1 AND l.a = b.letter), 0) AS k1,
    coalesce((SELECT max(c) FROM c_letter l WHERE l.locus = b.locus AND l.col = b.col AND l.pop = b.pop2 AND l.a = b.letter), 0) AS k2 FROM c_both b WHERE len(letters) = 2),
  c_fst AS (SELECT *, 2 * n1 + 2 * n2 AS m, 1 - ((k1 + k2) * (k1 + k2 - 1) + (2 * n1 + 2 * n2 - k1 - k2) * (2 * n1 + 2 * n2 - k1 - k2 - 1)) / ((2 * n1 + 2 * n2) * (2 * n1 + 2 * n2 - 1.0)) AS pi_all,
    (k1 + k2) / (2.0 * n1 + 2 * n2) AS pm FROM c_of),
  c_value AS (SELECT *, 1 - (n1 * (2 * n1 - 1) * pi1 + n2 * (2 * n2 - 1) * pi2) / (pi_all * (n1 * (2 * n1 - 1) + n2 * (2 * n2 - 1))) AS fst,
    (n1 * (k1 / (2.0 * n1) - pm) ** 2 + n2 * (k2 / (2.0 * n2) - pm) ** 2) / (n1 + n2) / (pm - pm * pm) AS amova_fst FROM c_fst WHERE pi_all <> 0)"""


def fst_pairwise(d):
    return _pairs(d), f"SELECT locus, col, pop1, pop2, {d.r('pi_all')} AS pi, {d.r('fst')} AS fst, {d.r('amova_fst')} AS amova_fst FROM values_"


def fst_summary(d):
    return _pairs(d), f"SELECT pop1, pop2, count(*) AS sites, {d.r('avg(amova_fst)')} AS mean_fst FROM values_ GROUP BY pop1, pop2"


def fisher_table(d):
    """Odds ratio of the pooled 2 x 2 allele table (+1 everywhere if a cell is 0), its log's error and interval, and the table itself."""
    return _pairs(d) | {
        "t": "SELECT locus, col, pop1, pop2, np1 AS k1, nq1 AS l1, np2 AS k2, 2 * n2 - np2 AS l2, np1 AS a, nq1 AS b, np2 AS c, 2 * n2 - np2 AS e FROM values_",
        "u": "SELECT locus, col, pop1, pop2, k1, l1, k2, l2, CASE WHEN a * b * c * e = 0 THEN 1 ELSE 0 END + a AS a, CASE WHEN a * b * c * e = 0 THEN 1 ELSE 0 END + b AS b, CASE WHEN a * b * c * e = 0 THEN 1 ELSE 0 END + c AS c, CASE WHEN a * b * c * e = 0 THEN 1 ELSE 0 END + e AS e FROM t",
        "v": "SELECT u.*, (a * 1E0 * e) / (b * 1E0 * c) AS o, sqrt(1E0 / a + 1E0 / b + 1E0 / c + 1E0 / e) AS se FROM u",
    }, f"SELECT locus, col, pop1, pop2, k1, l1, k2, l2, {d.r('o', 6)} AS odds_ratio, {d.r('exp(ln(o) - 1.96 * se)', 4)} AS ci_low, {d.r('exp(ln(o) + 1.96 * se)', 4)} AS ci_high, {d.r('abs(log10(o))', 6)} AS lod FROM v"


def fisher_p(k1: int, l1: int, k2: int, l2: int) -> float:
    """Fisher's exact P of a 2 x 2 table: the tail the table lies in, and the other one from its end on, as long as it weighs less."""
    r1, r2, c1 = k1 + l1, k2 + l2, k1 + k2
    lo, hi = max(0, c1 - r2), min(r1, c1)
    ln = math.lgamma
    weight = [math.exp(ln(r1 + 1) - ln(k + 1) - ln(r1 - k + 1) + ln(r2 + 1) - ln(c1 - k + 1) - ln(r2 - c1 + k + 1) - ln(r1 + r2 + 1) + ln(c1 + 1) + ln(r1 + r2 - c1 + 1)) for k in range(lo, hi + 1)]
    at = k1 - lo
    tail, other = (weight[: at + 1], weight[::-1]) if k1 * l2 < k2 * l1 else (weight[at:], weight)
    first, second = math.fsum(tail), 0.0
    for w in other:
        if second + w >= first * (1 - 1e-9):
            break
        second += w
    return min(1.0, first + second)


def fisher(spark, calls):
    """The interval of the odds ratio and the exact P, computed once for each distinct table of a batch."""

    @F.pandas_udf("double")
    def p(k1: pd.Series, l1: pd.Series, k2: pd.Series, l2: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        return pd.Series([known[t] if t in known else known.setdefault(t, fisher_p(*t)) for t in zip(k1.tolist(), l1.tolist(), k2.tolist(), l2.tolist(), strict=True)], dtype=float)

    t = Op(CALLS, fisher_table)(spark, calls=calls)
    return t.withColumn("fet_p", F.floor(p("k1", "l1", "k2", "l2") * 1e6 + 0.5) / 1e6)


_CHECK_FISHER = _CHECK_PAIRS + """,
  c_table AS (SELECT locus, col, pop1, pop2, k1, 2 * n1 - k1 AS l1, k2, 2 * n2 - k2 AS l2 FROM c_value),
  c_kind AS (SELECT DISTINCT k1, l1, k2, l2 FROM c_table),
  c_cell AS (SELECT c.*, k, exp(lgamma(k1 + l1 + 1) - lgamma(k + 1) - lgamma(k1 + l1 - k + 1) + lgamma(k2 + l2 + 1) - lgamma(k1 + k2 - k + 1) - lgamma(l2 - k1 + k + 1)
    - lgamma(k1 + l1 + k2 + l2 + 1) + lgamma(k1 + k2 + 1) + lgamma(l1 + l2 + 1)) AS w FROM c_kind c, unnest(range(greatest(0, k1 - l2), least(k1 + l1, k1 + k2) + 1)) AS z(k)),
  c_tail AS (SELECT *, k1 * l2 < k2 * l1 AS low, sum(w) FILTER (CASE WHEN k1 * l2 < k2 * l1 THEN k <= k1 ELSE k >= k1 END) OVER (PARTITION BY k1, l1, k2, l2) AS first,
    CASE WHEN k1 * l2 < k2 * l1 THEN sum(w) OVER (PARTITION BY k1, l1, k2, l2 ORDER BY k DESC) ELSE sum(w) OVER (PARTITION BY k1, l1, k2, l2 ORDER BY k) END AS upto FROM c_cell),
  c_p AS (SELECT k1, l1, k2, l2, least(1, max(first) + coalesce(max(upto) FILTER (upto < first * (1 - 1e-9)), 0)) AS fet_p FROM c_tail GROUP BY k1, l1, k2, l2),
  c_odds AS (SELECT t.*, p.fet_p, CASE WHEN least(t.k1, t.l1, t.k2, t.l2) = 0 THEN 1 ELSE 0 END AS z FROM c_table t JOIN c_p p USING (k1, l1, k2, l2)),
  c_ratio AS (SELECT *, (k1 + z) * (l2 + z) * 1.0 / ((l1 + z) * (k2 + z)) AS o, 1.96 * sqrt(1.0 / (k1 + z) + 1.0 / (l1 + z) + 1.0 / (k2 + z) + 1.0 / (l2 + z)) AS half FROM c_odds)
  SELECT locus, col, pop1, pop2, CAST(k1 AS BIGINT) AS k1, CAST(l1 AS BIGINT) AS l1, CAST(k2 AS BIGINT) AS k2, CAST(l2 AS BIGINT) AS l2, """ + f"{_r('o', 6)} AS odds_ratio, {_r('exp(ln(o) - half)', 4)} AS ci_low, {_r('exp(ln(o) + half)', 4)} AS ci_high, {_r('abs(log10(o))', 6)} AS lod, {_r('fet_p', 6)} AS fet_p FROM c_ratio"


def _freqs(d: Dialect, complete: bool = True) -> dict[str, str]:
    """Haplotype counts and frequencies of a population; those with an uncalled site only where `complete` is off."""
    only = lambda h: f" WHERE position('N' IN {h}) = 0" if complete else ""
    return {
        "h": f"SELECT locus, pop, grp, h1 AS h FROM @haps{only('h1')} UNION ALL SELECT locus, pop, grp, h2 FROM @haps{only('h2')}",
        "c": "SELECT locus, pop, grp, h, count(*) AS n FROM h GROUP BY locus, pop, grp, h",
        "t": "SELECT locus, pop, sum(n) AS total, count(*) AS kinds FROM c GROUP BY locus, pop",
        "f": "SELECT c.locus, c.pop, c.grp, c.h, c.n, t.total, t.kinds, c.n / (1E0 * t.total) AS f FROM c JOIN t ON c.locus = t.locus AND c.pop = t.pop",
    }


#: Haplotype copies of a locus one by one, for checks only.
_CHECK_HAPS = """WITH c_hap AS (SELECT locus, pop, grp, unnest([h1, h2]) AS h FROM @haps),
  c_full AS (SELECT *, row_number() OVER (PARTITION BY locus, pop ORDER BY h) AS i FROM c_hap WHERE NOT contains(h, 'N'))"""


def gene_diversity(d):
    return _freqs(d), f"SELECT locus, pop, max(total) AS n, count(*) AS haplotypes, {d.r('max(total) / (max(total) - 1E0) * (1 - sum(n * n) / (1E0 * max(total) * max(total)))')} AS gene_diversity FROM f WHERE total > 1 GROUP BY locus, pop"


def haplotype_diversity(d):
    return _freqs(d), f"""SELECT a.locus, a.pop, {d.r(f"max(a.total) / (max(a.total) - 1E0) * sum(a.n * b.n * {d.hamming('a.h', 'b.h')}) / (1E0 * max(a.total) * max(a.total))")} AS hapl_diversity
      FROM f a JOIN f b ON a.locus = b.locus AND a.pop = b.pop WHERE a.total > 1 GROUP BY a.locus, a.pop"""


def d_est(d):
    """1 - x / y over all populations of a locus: x from frequency sums, y from pairs drawn within a population. Uncalled sites count as letters here."""
    return _freqs(d, complete=False) | {
        "k": "SELECT locus, count(*) AS k FROM t GROUP BY locus",
        "x": "SELECT locus, h, sum(f) AS sf, sum(f * f) AS sff FROM f GROUP BY locus, h",
        "xs": "SELECT x.locus, sum((sf * sf - sff) / (k - 1E0)) AS x FROM x JOIN k ON x.locus = k.locus WHERE k > 1 GROUP BY x.locus",
        "y": "SELECT locus, sum(n * (n - 1) / (total * (total - 1E0))) AS y FROM f WHERE total > 1 GROUP BY locus",
    }, f"SELECT xs.locus, {d.r('1 - x / y')} AS d_est FROM xs JOIN y ON xs.locus = y.locus WHERE y > 0"


def dxy(d):
    """Mean Jukes-Cantor distance of haplotypes of two populations; differences are a share of the locus' own length, not of its sites. Uncalled sites count as letters here."""
    return _freqs(d, complete=False) | {
        "p": f"SELECT a.locus, a.pop AS pop1, b.pop AS pop2, a.f * b.f AS w, {d.hamming('a.h', 'b.h')} / (1E0 * l.size) AS x FROM f a JOIN f b ON a.locus = b.locus AND a.pop < b.pop JOIN (SELECT locus, length(consensus) AS size FROM @loci) l ON l.locus = a.locus",
    }, f"SELECT locus, pop1, pop2, {d.r('sum(w * -0.75 * ln(1 - 4 * x / 3))')} AS dxy FROM p GROUP BY locus, pop1, pop2"


def _amova(d: Dialect, unit: str) -> dict[str, str]:
    """Variance components of haplotypes by populations in groups; unit: the columns that `sums` has one row of each population pair for.

    sums: s, i, m: distances between all copies of population pa and all of pb: substitutions, 0/1, and 1 for all across populations.
    """
    same = "CASE WHEN pa = pb THEN {} ELSE 0 END"
    both = "CASE WHEN ga = gb THEN {} ELSE 0 END"
    part = lambda x: f"sum({both.format(f'1E0 * {x} / (2 * ng)')}) - sum({same.format(f'1E0 * {x} / (2 * na)')})"
    return {
        "grouped": f"SELECT sums.*, sum({same.format('na')}) OVER (PARTITION BY {unit}, ga) AS ng, sum({same.format('na')}) OVER (PARTITION BY {unit}) AS nt FROM sums",
        "ssd": f"""SELECT {unit}, max(nt) AS nt, count(DISTINCT pa) AS pops, count(DISTINCT ga) AS groups,
          sum(1E0 * s / (2 * nt)) AS total, sum({same.format('1E0 * s / (2 * na)')}) AS wp, sum({same.format('1E0 * i / (2 * na)')}) AS wp_i, {part('s')} AS ap, {part('i')} AS ap_i, {part('m')} AS ap_m,
          sum({both.format('1E0 * s / (2 * ng)')}) AS in_groups, sum({same.format('1E0 * na * na / ng')}) AS sg, sum({same.format('1E0 * na * na / nt')}) AS sn, sum({same.format('1E0 * na * ng / nt')}) AS gn, sum(i) AS different
          FROM grouped GROUP BY {unit}""",
        "msd": """SELECT ssd.*, wp / (nt - pops) AS sc, wp_i / (nt - pops) AS sc_i, CASE WHEN pops > groups THEN (nt - sg) / (pops - groups) END AS n0, CASE WHEN groups > 1 THEN (sg - sn) / (groups - 1E0) ELSE 0 END AS n1,
          CASE WHEN groups > 1 THEN (nt - gn) / (groups - 1E0) END AS n2, CASE WHEN groups > 1 THEN (total - in_groups) / (groups - 1E0) END AS ag FROM ssd WHERE pops > 1 AND nt > pops AND different > 0""",
        "sig_b": """SELECT msd.*, coalesce((ap / (pops - groups) - sc) / n0, 0) AS sb, coalesce((ap_i / (pops - groups) - sc_i) / n0, 0) AS sb_i, coalesce((ap_m / (pops - groups) - sc_i) / n0, 0) AS sb_m FROM msd""".replace("(pops - groups)", "nullif(pops - groups, 0)"),
        "sig": "SELECT sig_b.*, CASE WHEN groups > 1 THEN (ag - sc - n1 * sb) / n2 ELSE 0E0 END AS sa FROM sig_b",
        "phi": f"""SELECT {unit}, nt, pops, groups, CASE WHEN sa + sb + sc > 1e-12 THEN (sa + sb) / (sa + sb + sc) ELSE 0E0 END AS phi_st, CASE WHEN groups > 1 AND sa + sb + sc > 1e-12 THEN sa / (sa + sb + sc) ELSE 0E0 END AS phi_ct,
          CASE WHEN groups > 1 AND sa + sb > 1e-12 THEN coalesce(sb / nullif(sb + sc, 0), cast('NaN' AS DOUBLE)) ELSE 0E0 END AS phi_sc, CASE WHEN sb_i + sc_i > 1e-12 AND sb_m > 1e-12 THEN sb_i / sb_m ELSE 0E0 END AS fst_prime FROM sig""",
    }


def _between(d: Dialect) -> dict[str, str]:
    """Distances between the haplotype copies of two populations of a locus. As soon as its first haplotype is not complete, a sample is left out."""
    return {
        "h": "SELECT locus, pop, grp, h1 AS h FROM @haps WHERE position('N' IN h1) = 0 UNION ALL SELECT locus, pop, grp, h2 FROM @haps WHERE position('N' IN h1) = 0",
        "c": "SELECT locus, pop, grp, h, count(*) AS n FROM h GROUP BY locus, pop, grp, h",
        "t": "SELECT locus, pop, sum(n) AS total FROM c GROUP BY locus, pop",
        "far": f"SELECT a.locus, a.pop AS pa, b.pop AS pb, a.grp AS ga, b.grp AS gb, sum(a.n * b.n * {d.hamming('a.h', 'b.h')}) AS s, sum(CASE WHEN a.h <> b.h THEN a.n * b.n ELSE 0 END) AS i FROM c a JOIN c b ON a.locus = b.locus GROUP BY a.locus, a.pop, b.pop, a.grp, b.grp",
        "every": "SELECT far.*, x.total AS na, CASE WHEN pa = pb THEN i ELSE x.total * y.total END AS m FROM far JOIN t x ON far.locus = x.locus AND pa = x.pop JOIN t y ON far.locus = y.locus AND pb = y.pop",
    }


_PHI = "{} AS phi_st, {} AS phi_ct, {} AS phi_sc, {} AS fst_prime"


def _rounded_phi(d: Dialect) -> list[str]:
    """Phi_sc is not a number where populations and copies within them vary in nothing but their groups."""
    return [d.r("phi_st"), d.r("phi_ct"), f"CASE WHEN isnan(phi_sc) THEN phi_sc ELSE {d.r('phi_sc')} END", d.r("fst_prime")]


def phi_st(d):
    """AMOVA over all populations of a locus in their groups: Phi_st, Phi_ct, Phi_sc and Fst / Fst_max; without groups Phi_ct and Phi_sc are 0."""
    return _between(d) | {"sums": "SELECT * FROM every"} | _amova(d, "locus"), "SELECT locus, pops, groups, " + _PHI.format(*_rounded_phi(d)) + " FROM phi"


def phi_st_pairs(d):
    """AMOVA of each two populations of a locus."""
    return _between(d) | {
        "two": "SELECT a.locus, a.pop AS pop1, b.pop AS pop2 FROM t a JOIN t b ON a.locus = b.locus AND a.pop < b.pop",
        "sums": "SELECT e.*, two.pop1, two.pop2 FROM every e JOIN two ON e.locus = two.locus WHERE pa IN (pop1, pop2) AND pb IN (pop1, pop2)",
    } | _amova(d, "locus, pop1, pop2"), "SELECT locus, pop1, pop2, groups, " + _PHI.format(*_rounded_phi(d)) + " FROM phi"


def _check_amova(unit: str, where: str) -> str:
    """The sums of squares over pairs of single copies, as defined."""
    return (
        """WITH c_copy AS (SELECT locus, pop, grp, unnest([h1, h2]) AS h FROM @haps WHERE NOT contains(h1, 'N')), c_unit AS (SELECT * FROM """
        + where
        + f"""),
  c_size AS (SELECT {unit}, count(*) AS nt, count(DISTINCT pop) AS p, count(DISTINCT grp) AS g FROM c_unit GROUP BY {unit}),
  c_pop AS (SELECT {unit}, pop, grp, count(*) AS np FROM c_unit GROUP BY {unit}, pop, grp),
  c_grp AS (SELECT {unit}, grp, sum(np) AS ng, sum(np * np) AS sq FROM c_pop GROUP BY {unit}, grp),
  c_const AS (SELECT {unit}, sum(sq / ng) AS sg, sum(sq) AS sq, sum(ng * ng) AS gg FROM c_grp GROUP BY {unit}),
  c_pair AS (SELECT {unit}, x.pop AS pop, x.grp AS grp, x.pop = y.pop AS sp, x.grp = y.grp AS sg, hamming(x.h, y.h) AS s, CAST(x.h <> y.h AS INT) AS i, CASE WHEN x.pop = y.pop THEN CAST(x.h <> y.h AS INT) ELSE 1 END AS m FROM c_unit x JOIN c_unit y USING ({unit})),
  c_in AS (SELECT {unit}, pop, sum(s) / (2.0 * max(np)) AS s, sum(i) / (2.0 * max(np)) AS i FROM c_pair JOIN c_pop USING ({unit}, pop) WHERE sp GROUP BY {unit}, pop),
  c_ins AS (SELECT {unit}, sum(s) AS wp, sum(i) AS wpi FROM c_in GROUP BY {unit}),
  c_mid AS (SELECT {unit}, grp, sum(s) / (2.0 * max(ng)) AS s, sum(i) / (2.0 * max(ng)) AS i, sum(m) / (2.0 * max(ng)) AS m FROM c_pair JOIN c_grp USING ({unit}, grp) WHERE c_pair.sg GROUP BY {unit}, grp),
  c_mids AS (SELECT {unit}, sum(s) AS gs, sum(i) AS gi, sum(m) AS gm FROM c_mid GROUP BY {unit}),
  c_all AS (SELECT {unit}, sum(s) AS s, sum(i) AS i FROM c_pair GROUP BY {unit}),
  c_var AS (SELECT *, wp / (nt - p) AS vc, wpi / (nt - p) AS vci, CASE WHEN p > g THEN ((gs - wp) / (p - g) - wp / (nt - p)) / ((nt - sg) / (p - g)) ELSE 0 END AS vb,
    CASE WHEN p > g THEN ((gi - wpi) / (p - g) - wpi / (nt - p)) / ((nt - sg) / (p - g)) ELSE 0 END AS vbi, CASE WHEN p > g THEN ((gm - wpi) / (p - g) - wpi / (nt - p)) / ((nt - sg) / (p - g)) ELSE 0 END AS vbm
    FROM c_size JOIN c_const USING ({unit}) JOIN c_ins USING ({unit}) JOIN c_mids USING ({unit}) JOIN c_all USING ({unit}) WHERE p > 1 AND nt > p AND c_all.i > 0),
  c_top AS (SELECT *, CASE WHEN g > 1 THEN ((s / (2.0 * nt) - gs) / (g - 1) - vc - (sg - sq / nt) / (g - 1) * vb) / ((nt - gg / nt) / (g - 1)) ELSE 0 END AS va FROM c_var)
  SELECT {unit}, {"p AS pops, " if unit == "locus" else ""}g AS groups, """
        + _PHI.format(
            _r("CASE WHEN va + vb + vc > 1e-12 THEN (va + vb) / (va + vb + vc) ELSE 0 END"),
            _r("CASE WHEN g > 1 AND va + vb + vc > 1e-12 THEN va / (va + vb + vc) ELSE 0 END"),
            _r("CASE WHEN g > 1 AND va + vb > 1e-12 THEN vb / (vb + vc) ELSE 0 END"),
            _r("CASE WHEN vbi + vci > 1e-12 AND vbm > 1e-12 THEN vbi / vbm ELSE 0 END"),
        )
        + " FROM c_top"
    )


_CHECK_PHI = _check_amova("locus", "c_copy")
_CHECK_PHI_PAIRS = _check_amova("locus, pop1, pop2", "(SELECT c.*, z.pop1, z.pop2 FROM c_copy c JOIN (SELECT DISTINCT a.locus, a.pop AS pop1, b.pop AS pop2 FROM c_copy a JOIN c_copy b ON a.locus = b.locus AND a.pop < b.pop) z ON c.locus = z.locus AND c.pop IN (z.pop1, z.pop2)) u")


def hwe_exact(d):
    """Exact test: the chance of a heterozygote count no likelier than the one observed, from the ratios of neighbouring counts' chances."""
    # weights of the counts above and below the observed one, relative to it
    down = "aggregate(sequence(1, greatest(1, cast(het div 2 as int))), named_struct('w', 1E0, 'a', 0E0, 'l', 0E0), (s, k) -> if(2 * k > het, s, named_struct('w', s.w * {down}, 'a', s.a + s.w * {down}, 'l', s.l + if(s.w * {down} <= 1 + 1e-9, s.w * {down}, 0E0))))"
    up = "aggregate(sequence(1, greatest(1, cast((nq - het) div 2 as int))), named_struct('w', 1E0, 'a', 0E0, 'l', 0E0), (s, k) -> if(2 * k > nq - het, s, named_struct('w', s.w * {up}, 'a', s.a + s.w * {up}, 'l', s.l + if(s.w * {up} <= 1 + 1e-9, s.w * {up}, 0E0))))"
    h = "(het - 2 * k + 2E0)"
    down = down.replace("{down}", f"({h} * ({h} - 1) / (4E0 * ((np - {h}) / 2 + 1) * ((nq - {h}) / 2 + 1)))")
    g = "(het + 2 * k - 2E0)"
    up = up.replace("{up}", f"(4E0 * ((np - {g}) / 2) * ((nq - {g}) / 2) / (({g} + 2) * ({g} + 1)))")
    return _site(d) | {"w": f"SELECT locus, col, pop, {down} AS down, {up} AS up FROM stats WHERE nq > 0"}, f"SELECT locus, col, pop, {d.r('(1 + down.l + up.l) / (1 + down.a + up.a)', 6)} AS hwe_p FROM w"


_CHECK_HWE = _CHECK_SITE + """,
  c_conf AS (SELECT locus, col, pop, n, het, np, nq, h FROM c_site, unnest(range(0, nq + 1)) AS z(h) WHERE nq > 0 AND (nq - h) % 2 = 0),
  c_ln AS (SELECT *, h * ln(2.0) - lgamma(h + 1) - lgamma((nq - h) / 2 + 1) - lgamma((np - h) / 2 + 1) + lgamma(n + 1) + lgamma(np + 1) + lgamma(nq + 1) - lgamma(2 * n + 1) AS l FROM c_conf),
  c_own AS (SELECT *, max(l) FILTER (h = het) OVER (PARTITION BY locus, col, pop) AS o FROM c_ln)
  SELECT locus, col, pop, """ + _r("sum(exp(l)) FILTER (l <= o + 1e-9)", 6) + " AS hwe_p FROM c_own GROUP BY locus, col, pop"


def _celled(sites, sigma, most=96):
    """Sites by chromosome, population and stretch of `most` sigma, with those within 3 sigma of a stretch; `own` are those in it."""
    cell = lambda x: F.floor(x / (most * sigma))
    near = F.array_distinct(F.array(*[cell(F.col("bp") + o * sigma) for o in (-3, 0, 3)]))
    return sites.select("*", F.explode(near).alias("cell")).withColumn("own", F.col("cell").eqNullSafe(cell(F.col("bp"))))


def _smooth(sigma):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bp")
        bp, n, w, v = (t.column(c).to_numpy() for c in ("bp", "n", "w", "v"))
        mine = t.filter(t.column("centre"))
        where = mine.column("bp").to_numpy()
        seen = np.flatnonzero(n)
        first = smoothing.firsts(bp[seen])
        at = bp[seen][first]
        c = np.unique(where)
        lo, hi = np.searchsorted(at, c - 3 * sigma), np.searchsorted(at, c + 3 * sigma)
        c, lo, hi = (x[lo < hi] for x in (c, lo, hi))
        sums = smoothing.gaussian_sums(at, np.array([np.add.reduceat(x[seen], first) if len(first) else x[:0] for x in (v, w)]), c, sigma)
        upto = np.append(first, len(seen))
        with np.errstate(all="ignore"):
            smoothed = np.floor(sums[:, 0] / sums[:, 1] * 1e4 + 0.5) / 1e4
        k = np.searchsorted(c, where)
        found = np.append(c, 0)[k] == where if len(c) else np.zeros(len(where), bool)
        found &= k < len(c)
        told = mine.filter(pa.array(found)).select(["event_id", "chr", "pop", "bp"])
        return told.append_column("n", pa.array((upto[hi] - upto[lo])[k[found]], pa.int64())).append_column("smoothed", pa.array(smoothed[k[found]]))

    return run


def kernel_smooth(spark, sites, sigma=3600):
    """Gaussian average over [c - 3 sigma, c + 3 sigma) of each chromosome and population, alleles - 1 as weight: around sites that are not fixed, over values above -7."""
    kind = dict(sites.dtypes)
    used = F.coalesce(F.col("stat") > -7, F.lit(False))
    weight = F.coalesce((F.col("alleles") - 1).cast("double"), F.lit(0.0))
    t = _celled(sites.where("bp is not null and chr is not null and pop is not null"), sigma)
    t = t.select("event_id", "chr", "pop", "cell", "bp", (F.col("own") & F.coalesce(~F.col("fixed"), F.lit(False))).alias("centre"), used.cast("int").alias("n"), weight.alias("w"), F.when(used, weight * F.col("stat")).otherwise(0.0).alias("v"))
    return t.groupBy("chr", "pop", "cell").applyInArrow(_smooth(sigma), f"event_id {kind['event_id']}, chr {kind['chr']}, pop {kind['pop']}, bp {kind['bp']}, n long, smoothed double")


_CHECK_SMOOTH = f"""SELECT c.event_id, c.chr, c.pop, c.bp, count(*) AS n, {_r("sum(s.stat * (s.alleles - 1) * exp(-0.5 * ((s.bp - c.bp) / 3600.0) ** 2)) / sum((s.alleles - 1) * exp(-0.5 * ((s.bp - c.bp) / 3600.0) ** 2))", 4)} AS smoothed
  FROM @sites c JOIN @sites s ON s.chr = c.chr AND s.pop = c.pop AND s.bp BETWEEN c.bp - 10800 AND c.bp + 10799 WHERE NOT c.fixed AND s.stat <> -7 GROUP BY c.event_id, c.chr, c.pop, c.bp"""


def bonferroni(spark, sites, sigma=3600, alpha=0.05):
    """The level a site's P must be under: alpha over the sites in its window, as many as there are up to its end but for those before it."""
    w = Window.partitionBy("chr", "pop", "cell").orderBy("bp")
    upto = F.count("*").over(w.rangeBetween(Window.unboundedPreceding, 3 * sigma - 1))
    before = F.count("*").over(w.rangeBetween(Window.unboundedPreceding, -3 * sigma - 1))
    # rows without a place are each other's window
    n = F.when(F.col("bp").isNull(), upto).otherwise(upto - before)
    t = _celled(sites.select("event_id", "chr", "pop", "bp"), sigma, 24).withColumn("sites", n).where("own")
    return t.select("event_id", "chr", "pop", "bp", "sites", (F.floor(alpha / F.col("sites") * 1e9 + 0.5) / 1e9).alias("level"))


_CHECK_BONFERRONI = f"SELECT event_id, chr, pop, bp, count(*) OVER w AS sites, {_r('0.05 / count(*) OVER w')} AS level FROM @sites WINDOW w AS (PARTITION BY chr, pop ORDER BY bp RANGE BETWEEN 10800 PRECEDING AND 10799 FOLLOWING)"


#: Columns of a locus lie STEP apart; loci on the reverse strand count down from their position.
STEP = 20
_PLACED = f"SELECT c.locus, c.col, p.chr, p.bp AS start, p.bp + {STEP} * CASE WHEN p.strand = '-' THEN -c.col ELSE c.col END AS bp FROM (SELECT DISTINCT locus, col FROM @calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL) c JOIN @positions p ON c.locus = p.locus"


def ordered_unique_sites(d):
    """One site a base pair of a chromosome: that of the first locus, by position and id."""
    return {"s": _PLACED, "k": "SELECT s.*, row_number() OVER (PARTITION BY chr, bp ORDER BY start, locus) AS k FROM s"}, "SELECT chr, bp, locus, col FROM k WHERE k = 1"


_CHECK_ORDERED = f"WITH c_s AS ({_PLACED}) SELECT chr, bp, arg_min(locus, (start, locus)) AS locus, arg_min(col, (start, locus)) AS col FROM c_s GROUP BY chr, bp"


def locus_overlap(d):
    """Base pairs with a site, and those with sites of more than one locus."""
    return {"s": _PLACED, "k": "SELECT chr, bp, count(DISTINCT locus) AS loci FROM s GROUP BY chr, bp"}, "SELECT chr, count(*) AS sites, sum(CASE WHEN loci > 1 THEN 1 ELSE 0 END) AS overlapping FROM k GROUP BY chr"


def samples_per_locus(d):
    return {"k": "SELECT locus, count(DISTINCT sample) AS samples FROM @calls GROUP BY locus"}, "SELECT samples, count(*) AS loci FROM k GROUP BY samples"


def missing_per_sample(d, least=2):
    """Called and missing sites of a sample after genotypes below the least depth are masked, and the mean depth of those left."""
    return {
        "all_": "SELECT count(*) AS sites FROM (SELECT DISTINCT locus, col FROM @calls) s",
        "m": f"SELECT sample, dp, CASE WHEN dp >= {least} AND a1 IS NOT NULL AND a2 IS NOT NULL THEN 1 ELSE 0 END AS called FROM @calls",
    }, f"SELECT sample, sum(called) AS called, max(sites) - sum(called) AS missing, {d.r('sum(called * dp) / (1E0 * nullif(sum(called), 0))')} AS mean_depth FROM m CROSS JOIN all_ GROUP BY sample"


_CHECK_MISSING = f"WITH c_ok AS (SELECT * FROM @calls WHERE dp >= 2) SELECT sample, count(k.sample) AS called, (SELECT count(DISTINCT locus * 4 + col) FROM @calls) - count(k.sample) AS missing, {_r('avg(k.dp)')} AS mean_depth FROM (SELECT DISTINCT sample FROM @calls) s LEFT JOIN c_ok k USING (sample) GROUP BY sample"


def _linked(d: Dialect) -> dict[str, str]:
    """Counts of the four gametes at each two biallelic sites of a locus, over haplotypes called at both."""
    return {
        "hap": "SELECT locus, h1 AS h FROM @haps UNION ALL SELECT locus, h2 FROM @haps",
        "one": f"SELECT locus, h, {d.unnest('1', 'length(h)', 'i')} FROM hap WHERE length(h) > 1",
        "g": f"SELECT locus, i, j, substring(h, i, 1) AS x, substring(h, j, 1) AS y FROM (SELECT locus, h, i, {d.unnest('i + 1', 'length(h)', 'j')} FROM one WHERE i < length(h)) z",
        "m": "SELECT locus, i, j, min(x) AS a, min(y) AS b, count(*) AS n, count(DISTINCT concat(x, y)) AS gametes FROM g WHERE x <> 'N' AND y <> 'N' GROUP BY locus, i, j HAVING count(DISTINCT x) = 2 AND count(DISTINCT y) = 2",
        "f": "SELECT m.locus, m.i, m.j, m.n, m.gametes, avg(CASE WHEN x = a THEN 1E0 ELSE 0E0 END) AS fa, avg(CASE WHEN y = b THEN 1E0 ELSE 0E0 END) AS fb, avg(CASE WHEN x = a AND y = b THEN 1E0 ELSE 0E0 END) AS fab FROM g JOIN m ON g.locus = m.locus AND g.i = m.i AND g.j = m.j WHERE x <> 'N' AND y <> 'N' GROUP BY m.locus, m.i, m.j, m.n, m.gametes",
        "v": "SELECT f.*, fab - fa * fb AS dd FROM f",
        "ld": f"SELECT v.*, {d.r('CASE WHEN dd > 0 THEN dd / least(fa * (1 - fb), (1 - fa) * fb) ELSE -dd / least(fa * fb, (1 - fa) * (1 - fb)) END')} AS d_prime FROM v",
    }


def dprime(d):
    """Linkage of biallelic sites of a locus from phased haplotypes: D, D', chi-square, and the four-gamete rule."""
    return _linked(d), f"SELECT locus, i, j, n, {d.r('dd')} AS d, d_prime, {d.r('n * dd * dd / (fa * (1 - fa) * fb * (1 - fb))')} AS chisq, gametes = 3 AS no_recombination FROM ld"


def dprime_buckets(d):
    """Pairs of sites and mean D' by the distance of the sites."""
    return _linked(d), f"SELECT (j - i) * {STEP} AS distance, count(*) AS pairs, {d.r('avg(d_prime)', 6)} AS mean_d_prime FROM ld GROUP BY j - i"


_CHECK_LD = """WITH c_h AS (SELECT locus, unnest([h1, h2]) AS h FROM @haps),
  c_g AS (SELECT locus, i, j, h[i] AS x, h[j] AS y FROM c_h, unnest(range(1, 5)) AS a(i), unnest(range(2, 5)) AS b(j) WHERE i < j AND j <= len(h) AND h[i] <> 'N' AND h[j] <> 'N'),
  c_c AS (SELECT locus, i, j, x, y, count(*) AS c FROM c_g GROUP BY locus, i, j, x, y),
  c_t AS (SELECT locus, i, j, sum(c) AS n, count(*) AS gametes, min(x) AS a, max(x) AS a2, min(y) AS b, max(y) AS b2 FROM c_c GROUP BY locus, i, j HAVING count(DISTINCT x) = 2 AND count(DISTINCT y) = 2),
  c_f AS (SELECT t.locus, t.i, t.j, max(t.n) AS n, max(gametes) AS gametes, coalesce(sum(c) FILTER (x = a AND y = b), 0) AS ab, sum(c) FILTER (x = a) AS na, sum(c) FILTER (y = b) AS nb FROM c_t t JOIN c_c USING (locus, i, j) GROUP BY t.locus, t.i, t.j),
  c_d AS (SELECT *, (ab * n - na * nb) / (1.0 * n * n) AS dd, na / n AS pa, nb / n AS pb FROM c_f),
  c_ld AS (SELECT *, """ + _r("CASE WHEN dd > 0 THEN dd / least(pa - pa * pb, pb - pa * pb) ELSE -dd / least(pa * pb, 1 - pa - pb + pa * pb) END") + " AS d_prime FROM c_d)"
_CHECK_DPRIME = _CHECK_LD + f" SELECT locus, i, j, CAST(n AS BIGINT) AS n, {_r('dd')} AS d, d_prime, {_r('n * dd * dd / (pa * (1 - pa) * pb * (1 - pb))')} AS chisq, gametes = 3 AS no_recombination FROM c_ld"
_CHECK_BUCKETS = _CHECK_LD + f" SELECT (j - i) * 20 AS distance, count(*) AS pairs, {_r('avg(d_prime)', 6)} AS mean_d_prime FROM c_ld GROUP BY j - i"


def _ranked(d: Dialect) -> dict[str, str]:
    """A sample's read counts at a site, most frequent base first, ties by letter: c1..c4, their bases, n."""
    long = " UNION ALL ".join(f"SELECT locus, col, sample, '{x}' AS a, n{x.lower()} AS c FROM @depths" for x in "ACGT")
    place = ", ".join(f"max(CASE WHEN k = {i} THEN c END) AS c{i}, max(CASE WHEN k = {i} THEN a END) AS b{i}" for i in (1, 2, 3, 4))
    return {
        "long": long,
        "k": "SELECT locus, col, sample, a, c, row_number() OVER (PARTITION BY locus, col, sample ORDER BY c DESC, a) AS k FROM long",
        "s": f"SELECT locus, col, sample, sum(c) AS n, {place} FROM k GROUP BY locus, col, sample HAVING sum(c) > 0",
    }


def _xlnx(c: str, p: str) -> str:
    return f"CASE WHEN {c} > 0 THEN ({c}) * ln({p}) ELSE 0 END"


def snp_call(d, critical=3.84):
    """Multinomial model of a sample's base counts at a site: 2 (lnL_hom - lnL_het) against the critical value."""
    hom = f"{_xlnx('c1', 'c1 / (1E0 * n)')} + {_xlnx('n - c1', '(n - c1) / (3E0 * n)')}"
    het = f"{_xlnx('c1 + c2', '(c1 + c2) / (2E0 * n)')} + {_xlnx('n - c1 - c2', '(n - c1 - c2) / (2E0 * n)')}"
    return _ranked(d) | {"l": f"SELECT s.*, 2 * (({hom}) - ({het})) AS lr FROM s"}, f"SELECT locus, col, sample, n, b1 AS rank_1, CASE WHEN c2 > 0 THEN b2 END AS rank_2, {d.r('lr', 6)} AS lratio, CASE WHEN lr <= -{critical} THEN 'E' WHEN lr >= {critical} THEN 'O' ELSE 'U' END AS type FROM l"


def snp_call_bounded(d, critical=3.84, low=0.0, high=0.1):
    """As snp_call, the error rates of both hypotheses estimated and held within bounds."""
    clamp = lambda x: f"least(greatest({x}, {low}E0), {high}E0)".replace("E0E0", "E0")
    return _ranked(d) | {
        "e": f"SELECT s.*, {clamp('4 * (n - c1) / (3E0 * n)')} AS eh, {clamp('2 * (c3 + c4) / (1E0 * n)')} AS et FROM s",
        "l": f"SELECT e.*, 2 * (({_xlnx('c1', '1 - 0.75 * eh')} + {_xlnx('n - c1', 'eh / 4')}) - ({_xlnx('c1 + c2', '0.5 - et / 4')} + {_xlnx('c3 + c4', 'et / 4')})) AS lr FROM e",
    }, f"SELECT locus, col, sample, n, b1 AS rank_1, {d.r('lr', 6)} AS lratio, CASE WHEN lr <= -{critical} THEN 'E' WHEN lr >= {critical} THEN 'O' ELSE 'U' END AS type FROM l"


def snp_call_fixed(d, critical=3.84, epsilon=0.01):
    """As snp_call, with one error rate given."""
    return _ranked(d) | {
        "l": f"SELECT s.*, 2 * ((c1 * ln(1 - 0.75 * {epsilon}) + (n - c1) * ln({epsilon} / 4)) - ((c1 + c2) * ln(0.5 - {epsilon} / 4) + (c3 + c4) * ln({epsilon} / 4))) AS lr FROM s",
    }, f"SELECT locus, col, sample, n, b1 AS rank_1, {d.r('lr', 6)} AS lratio, CASE WHEN lr <= -{critical} THEN 'E' WHEN lr >= {critical} THEN 'O' ELSE 'U' END AS type FROM l"


_CHECK_RANK = """WITH c_l AS (SELECT *, na + nc + ng + nt AS n, list_sort([{'c': -na, 'a': 'A'}, {'c': -nc, 'a': 'C'}, {'c': -ng, 'a': 'G'}, {'c': -nt, 'a': 'T'}]) AS l FROM @depths WHERE na + nc + ng + nt > 0),
  c_s AS (SELECT locus, col, sample, CAST(n AS BIGINT) AS n, -l[1].c AS c1, -l[2].c AS c2, -l[3].c - l[4].c AS c34, l[1].a AS b1, l[2].a AS b2 FROM c_l),"""


def _check_call(lr: str, second: bool = False) -> str:
    return _CHECK_RANK + f" c_r AS (SELECT *, 2 * ({lr}) AS lr FROM c_s) SELECT locus, col, sample, n, b1 AS rank_1, {'CASE c2 WHEN 0 THEN NULL ELSE b2 END AS rank_2, ' if second else ''}{_r('lr', 6)} AS lratio, CASE WHEN abs(lr) < 3.84 THEN 'U' WHEN lr < 0 THEN 'E' ELSE 'O' END AS type FROM c_r"


_CHECK_MULTINOMIAL = _check_call("c1 * ln(c1 / n) + coalesce((n - c1) * ln(nullif(n - c1, 0) / (3 * n)), 0) - (c1 + c2) * ln((c1 + c2) / (2 * n)) - coalesce(c34 * ln(nullif(c34, 0) / (2 * n)), 0)", True)
_CHECK_BOUNDED = _check_call("c1 * ln(1 - 0.75 * least(0.1, 4 / 3 * (n - c1) / n)) + coalesce((n - c1) * ln(nullif(least(0.1, 4 / 3 * (n - c1) / n), 0) / 4), 0) - (c1 + c2) * ln(0.5 - least(0.1, 2 * c34 / n) / 4) - coalesce(c34 * ln(nullif(least(0.1, 2 * c34 / n), 0) / 4), 0)")
_CHECK_FIXED = _check_call("c1 * ln(0.9925) + (n - c1) * ln(0.0025) - (c1 + c2) * ln(0.4975) - c34 * ln(0.0025)")


def inbreeding(d, parents=(0, 1)):
    """Per locus (h0 - h) / h0 of its first site over samples that are not parents: h the share of samples with two haplotypes, h0 = 2pq from the haplotypes seen in samples, each once a sample."""
    who = f"sample NOT IN ({', '.join(map(str, parents))})" if parents else "1 = 1"
    return {
        "s": f"SELECT locus, h1, h2, CASE WHEN h1 <> h2 THEN 1 ELSE 0 END AS het FROM @haps WHERE {who}",
        "a": "SELECT locus, substring(h1, 1, 1) AS x FROM s UNION ALL SELECT locus, substring(h2, 1, 1) FROM s WHERE het = 1",
        "c": "SELECT locus, x, count(*) AS c FROM a GROUP BY locus, x",
        "pq": "SELECT locus, min(c) AS p, max(c) AS q, sum(c) AS all_ FROM c GROUP BY locus HAVING count(*) = 2",
        "t": "SELECT locus, count(*) AS tot, sum(het) AS hets FROM s GROUP BY locus",
        "v": "SELECT t.locus, tot, hets / (1E0 * tot) AS h, 2E0 * p * q / (1E0 * tot * tot) AS h0 FROM t JOIN pq ON t.locus = pq.locus",
    }, f"SELECT locus, tot AS samples, {d.r('(h0 - h) / h0')} AS f FROM v"


_CHECK_INBREEDING = f"""WITH c_s AS (SELECT locus, h1, h2 FROM @haps WHERE sample > 1), c_a AS (SELECT locus, unnest(list_distinct([h1, h2]))[1] AS x FROM c_s),
  c_c AS (SELECT locus, histogram(x) AS m FROM c_a GROUP BY locus), c_t AS (SELECT locus, count(*) AS tot, count(*) FILTER (h1 <> h2) AS het FROM c_s GROUP BY locus)
  SELECT locus, tot AS samples, {_r('1 - het * tot / (2.0 * map_values(m)[1] * map_values(m)[2])')} AS f FROM c_t JOIN c_c USING (locus) WHERE len(map_keys(m)) = 2"""

_CHECK_POP = _CHECK_SITE + f""" SELECT locus, col, pop, n, p_nuc, q_nuc, {_r('p')} AS p, {_r('obs_het')} AS obs_het, {_r('1 - obs_het')} AS obs_hom, {_r('exp_het')} AS exp_het, {_r('1 - exp_het')} AS exp_hom, {_r('pi')} AS pi,
  {_r('CASE WHEN pi = 0 THEN -7 ELSE 1 - obs_het / pi END')} AS fis FROM c_site"""
_CHECK_META = _CHECK_SITE + f" SELECT locus, col, allele_cnt, CAST(n AS BIGINT) AS n, p_allele, q_allele, {_r('p_freq')} AS p_freq, {_r('obs_het')} AS obs_het, fixed, priv_allele FROM c_meta"
_CHECK_PRIVATE = _CHECK_SITE + " SELECT priv_allele AS pop, count(*) AS n_private FROM c_meta WHERE priv_allele >= 0 GROUP BY ALL"
_CHECK_SNPS = _CHECK_SITE + f" SELECT locus, col, {_r('1 - p_freq')} AS maf, round((1 - p_freq) * 2 * n) AS mac FROM c_meta WHERE allele_cnt = 1 OR (1 - p_freq >= 0.05 AND round((1 - p_freq) * 2 * n) >= 3 AND obs_het <= 0.7)"
_CHECK_FIRST = _CHECK_SITE + " SELECT DISTINCT ON (locus) locus, col FROM c_meta WHERE allele_cnt = 2 ORDER BY locus, col"
_CHECK_FST = _CHECK_PAIRS + f" SELECT locus, col, pop1, pop2, {_r('pi_all')} AS pi, {_r('fst')} AS fst, {_r('amova_fst')} AS amova_fst FROM c_value"
_CHECK_FST_MEAN = _CHECK_PAIRS + f" SELECT pop1, pop2, count(*) AS sites, {_r('sum(amova_fst) / count(*)')} AS mean_fst FROM c_value GROUP BY pop1, pop2"
_CHECK_SUMMARY = _CHECK_SITE + " SELECT pop, count(*) AS sites, CAST(sum(CAST(pi > 0 AS INT)) AS BIGINT) AS var_sites, " + ", ".join(f"{_r(f'avg({x})')} AS {name}_mean, {_r(f'var_samp({x})')} AS {name}_var" for name, x in (("num_indv", "n"), ("p", "p"), ("obs_het", "obs_het"), ("exp_het", "exp_het"), ("pi", "pi"))) + " FROM c_site GROUP BY pop"
_CHECK_LETTERS = """WITH c_h AS (SELECT locus, unnest([h1, h2]) AS h FROM @haps), c_c AS (SELECT locus, h, count(*) AS n FROM c_h WHERE NOT contains(h, 'N') GROUP BY ALL)
  SELECT locus, h AS haplotype, n, CASE WHEN count(*) OVER (PARTITION BY locus) <= 26 THEN chr(CAST(96 + row_number() OVER (PARTITION BY locus ORDER BY n DESC, h) AS INT)) END AS letter FROM c_c"""
_CHECK_GENE = _CHECK_HAPS + f", c_n AS (SELECT locus, pop, h, count(*) AS n FROM c_full GROUP BY ALL) SELECT locus, pop, CAST(sum(n) AS BIGINT) AS n, count(*) AS haplotypes, {_r('1 - sum(n * (n - 1)) / (sum(n) * (sum(n) - 1))')} AS gene_diversity FROM c_n GROUP BY locus, pop HAVING sum(n) > 1"
_CHECK_HAPL = _CHECK_HAPS + f" SELECT x.locus, x.pop, {_r('avg(hamming(x.h, y.h)) FILTER (x.i <> y.i)')} AS hapl_diversity FROM c_full x JOIN c_full y USING (locus, pop) GROUP BY x.locus, x.pop HAVING count(*) > 1"
_CHECK_DEST = _CHECK_HAPS + f""", c_t AS (SELECT locus, pop, count(*) AS t FROM c_hap GROUP BY ALL), c_f AS (SELECT locus, pop, h, count(*) AS c, any_value(t) AS t, count(*) / any_value(t) AS f FROM c_hap JOIN c_t USING (locus, pop) GROUP BY ALL),
  c_x AS (SELECT a.locus, sum(a.f * b.f) AS x FROM c_f a JOIN c_f b ON a.locus = b.locus AND a.h = b.h AND a.pop <> b.pop GROUP BY a.locus), c_k AS (SELECT locus, count(*) AS k FROM c_t GROUP BY locus),
  c_y AS (SELECT locus, sum(c * (c - 1) / (t * (t - 1))) AS y FROM c_f WHERE t > 1 GROUP BY locus)
  SELECT locus, {_r('1 - coalesce(x, 0) / (k - 1) / y')} AS d_est FROM c_k JOIN c_y USING (locus) LEFT JOIN c_x USING (locus) WHERE k > 1 AND y > 0"""
_CHECK_DXY = _CHECK_HAPS + f" SELECT x.locus, x.pop AS pop1, y.pop AS pop2, {_r('-0.75 * avg(ln(1 - hamming(x.h, y.h) / len(l.consensus) / 0.75))')} AS dxy FROM c_hap x JOIN c_hap y ON x.locus = y.locus AND x.pop < y.pop JOIN @loci l ON l.locus = x.locus GROUP BY ALL"
_CHECK_MASK = "SELECT locus, col, sample, if(dp < 2, NULL, a1) AS a1, if(dp < 2, NULL, a2) AS a2, dp FROM @calls"
_CHECK_RPR = """WITH c_n AS (SELECT locus, pop, count(DISTINCT sample) AS n FROM @calls WHERE a1 IS NOT NULL GROUP BY ALL), c_size AS (SELECT pop, count(DISTINCT sample) AS size FROM @calls GROUP BY pop)
  SELECT locus, count(*) AS pops, CAST(sum(n) AS BIGINT) AS samples FROM c_n JOIN c_size USING (pop) WHERE n >= 0.5 * size GROUP BY locus HAVING count(*) > 1 AND sum(n) >= 0.6 * (SELECT sum(size) FROM c_size)"""

HAPS = ("haps",)
OPS = {
    "site_pop_stats": Op(CALLS, site_pop_stats, _CHECK_POP), "site_meta_stats": Op(CALLS, site_meta_stats, _CHECK_META), "private_alleles": Op(CALLS, private_alleles, _CHECK_PRIVATE), "sumstats_summary": Op(CALLS, sumstats_summary, _CHECK_SUMMARY),
    "locus_filter_rpR": Op(CALLS, locus_filter, _CHECK_RPR), "snp_filter_maf_mac": Op(CALLS, snp_filter, _CHECK_SNPS), "depth_mask": Op(CALLS, depth_mask, _CHECK_MASK), "keep_first_snp": Op(CALLS, keep_first_snp, _CHECK_FIRST), "genotype_letters": Op(HAPS, ordered_snp_letters, _CHECK_LETTERS),
    "fst_pairwise": Op(CALLS, fst_pairwise, _CHECK_FST), "fst_summary": Op(CALLS, fst_summary, _CHECK_FST_MEAN), "fisher_exact": Fn(CALLS, fisher, _CHECK_FISHER), "gene_diversity": Op(HAPS, gene_diversity, _CHECK_GENE),
    "haplotype_diversity": Op(HAPS, haplotype_diversity, _CHECK_HAPL), "d_est": Op(HAPS, d_est, _CHECK_DEST), "dxy_jc": Op(("haps", "loci"), dxy, _CHECK_DXY), "phi_st": Op(HAPS, phi_st, _CHECK_PHI), "phi_st_pairs": Op(HAPS, phi_st_pairs, _CHECK_PHI_PAIRS),
    "hwe_exact": Op(CALLS, hwe_exact, _CHECK_HWE), "kernel_smooth": Fn(("sites",), kernel_smooth, _CHECK_SMOOTH), "bonferroni_window": Fn(("sites",), bonferroni, _CHECK_BONFERRONI),
    "ordered_unique_sites": Op(("calls", "positions"), ordered_unique_sites, _CHECK_ORDERED), "locus_overlap": Op(("calls", "positions"), locus_overlap), "dist_samples_per_locus": Op(CALLS, samples_per_locus),
    "missing_per_sample": Op(CALLS, missing_per_sample, _CHECK_MISSING), "dprime_pairs": Op(HAPS, dprime, _CHECK_DPRIME), "dprime_buckets": Op(HAPS, dprime_buckets, _CHECK_BUCKETS),
    "snp_call_multinomial": Op(("depths",), snp_call, _CHECK_MULTINOMIAL), "snp_call_bounded": Op(("depths",), snp_call_bounded, _CHECK_BOUNDED), "snp_call_fixed": Op(("depths",), snp_call_fixed, _CHECK_FIXED), "inbreeding_f": Op(HAPS, inbreeding, _CHECK_INBREEDING),
}
