"""Genotype models over the base counts of all samples of a site: (locus, col, sample, na, nc, ng, nt).

Loci are dealt to tasks and their rows sorted, so that a task reads one site after another, as arrays over all sites of a batch; it holds a batch and the
samples of one more site.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphs

BASES = "ACGT"
CALLS = "locus long, col int, sample int, variable boolean, allele string, other string, freq double, a1 string, a2 string, gq int, depth long, gl array<double>, counts array<int>"
PAIRS = [(a, b) for a in range(4) for b in range(a, 4)]


def quality(ln: float, other: float) -> int:
    """0 to 40, from the chance of the likelihood ratio under chi-square with one degree."""
    x = max(0.0, 2 * (ln - other))
    tail = math.erfc(math.sqrt(x / 2))
    return 40 if tail <= 1e-4 else min(40, int(-10 * math.log10(tail) + 1e-9))


def _least_ratio(q: int) -> float:
    """The least x with quality q: where the tail comes to 10 ** (-q / 10)."""
    lo, hi = 0.0, 60.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if -10 * math.log10(math.erfc(math.sqrt(mid / 2))) + 1e-9 < q else (lo, mid)
    return hi


QUALITIES = np.array([_least_ratio(q) for q in range(1, 41)])


def ranked(counts: np.ndarray) -> list[int]:
    return sorted(range(4), key=lambda i: (-counts[i], i))


def fixed_likelihood(n: float, major: float) -> float:
    """ln L of a site with one allele and errors."""
    return 0.0 if major == n else major * math.log(major / n) + (n - major) * math.log((n - major) / n / 3)


def likelihoods(counts: np.ndarray, major: int, minor: int, e: float) -> np.ndarray:
    """ln L of the reads of each sample (rows of counts) for the genotypes MM, Mm, mm; error rate e."""
    n, a, b = counts.sum(1), counts[:, major], counts[:, minor]
    miss, hit, half = math.log(e / 3), math.log(1 - e), math.log(0.5 - e / 3)
    return np.stack([a * hit + (n - a) * miss, (a + b) * half + (n - a - b) * miss, b * hit + (n - b) * miss], 1)


def mixture(freq, ln: np.ndarray) -> np.ndarray:
    """ln of the likelihoods' mean, weighted by genotype frequencies, for each sample."""
    top = ln.max(1)
    with np.errstate(divide="ignore"):
        return top + np.log((np.exp(ln - top[:, None]) * np.asarray(freq)).sum(1))


def genotype_frequencies(ln: np.ndarray, p: float, n_samples: int) -> tuple[np.ndarray, float]:
    """The frequencies of MM, Mm, mm of greatest likelihood: the best disequilibrium on a grid of 1 / samples, then uphill in such steps."""
    x = 1 / n_samples

    def near(f):
        f = np.asarray(f)
        return np.where(f < 1e-12, 0.0, np.where(f > 1 - 1e-12, 1.0, f))

    def value(f):
        out = mixture(f, ln).sum()
        return out if np.isfinite(out) else -np.inf

    lo, hi = max(-p * p, -((1 - p) ** 2)), p * (1 - p)
    d = lo + x * np.arange(int((hi - lo + 1e-12) / x) + 1)
    grid = near(np.stack([p * p + d, 2 * (p * (1 - p) - d), (1 - p) ** 2 + d], 1))
    most = ln.max(1)
    with np.errstate(divide="ignore"):
        values = (most[:, None] + np.log(np.exp(ln - most[:, None]) @ grid.T)).sum(0)
    best = grid[int(np.where(np.isfinite(values), values, -np.inf).argmax())]
    top = value(best)
    moves = [np.array(m) * x for m in ((1, -1, 0), (-1, 1, 0), (1, 0, -1), (-1, 0, 1), (0, 1, -1), (0, -1, 1))]
    while True:
        before = top
        for m in moves:
            f = best + m
            if (f < -1e-12).any() or (f > 1 + 1e-12).any():
                continue
            v = value(near(f))
            if v > top:
                best, top = near(f), v
        if top <= before:
            return best, top


def low_coverage(counts: np.ndarray, site_limit: float = 6.63489660102121, genotype_limit: float = 3.84):
    """A site by the low-coverage model: (major, minor or None, frequency of the major, calls), a call being (genotype 0 to 2 or None, quality)."""
    n_samples, total = len(counts), counts.sum(0)
    n, none = int(total.sum()), [(None, 0)] * len(counts)
    if not n:
        return None
    major, minor = ranked(total)[:2]
    fixed = fixed_likelihood(n, total[major])
    if -2 * fixed <= site_limit:
        return major, None, 1.0, none
    e = 1.5 * (n - total[major] - total[minor] + 0.1) / (n + 0.1)
    ln = likelihoods(counts, major, minor, e)
    ln[counts.sum(1) == 0] = 0
    known = 2 * total[major] + 2 * total[minor] - n
    p = 0.5 * (3 * total[major] + total[minor] - n) / known if known > 0 else 0.5
    freq, two = genotype_frequencies(ln, min(1.0, max(0.0, p)), n_samples)
    if 2 * (two - fixed) <= site_limit:
        return major, None, 1.0, none
    x = 1 / n_samples
    prior = (freq + x) / (1 + 3 * x)
    post = np.minimum(ln + np.log(prior) - mixture(prior, ln)[:, None], 0)
    calls = []
    for row in post:
        order = sorted(range(3), key=lambda g: -row[g])
        sure = 2 * (row[order[0]] - row[order[1]]) > genotype_limit
        calls.append((order[0] if sure else None, quality(row[order[0]], row[order[1]]) if sure else 0))
    return major, minor, float(freq[0] + freq[1] / 2), calls


def high_coverage(counts: np.ndarray, site_limit: float = 3.84, genotype_limit: float = 3.84):
    """A site by the high-coverage model: alleles are bases that a sample's best genotype needs, significantly better than that of the commonest base alone. (alleles, calls)."""
    total = counts.sum(0)
    if not total.sum():
        return None
    ref = ranked(total)[0]

    def ln(c, genotype):
        n = c.sum()
        hit = sum(c[b] for b in set(genotype))
        het = len(set(genotype)) == 2
        miss = n - hit
        return (hit * math.log(hit / ((2 if het else 1) * n)) if hit else 0.0) + (miss * math.log(miss / ((2 if het else 3) * n)) if miss else 0.0)

    alleles = {ref}
    for c in counts:
        if not c.sum():
            continue
        a, b = ranked(c)[:2]
        hom, het = ln(c, (a, a)), ln(c, (a, b))
        if 2 * abs(hom - het) <= genotype_limit or 2 * (max(hom, het) - ln(c, (ref, ref))) <= site_limit:
            continue
        alleles |= {a} if hom > het else {a, b}
    kinds = sorted(alleles)
    calls = []
    for c in counts:
        if not c.sum():
            calls.append((None, None, 0))
            continue
        every = sorted(((ln(c, (a, b)), a, b) for i, a in enumerate(kinds) for b in kinds[i:]), key=lambda t: (-t[0], t[1], t[2]))
        second = every[1][0] if len(every) > 1 else -math.inf
        sure = len(every) > 1 and 2 * (every[0][0] - second) > genotype_limit
        calls.append((*every[0][1:], quality(every[0][0], second)) if sure else (None, None, 0))
    return kinds, calls


def _xlog(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """x * ln(of), 0 where x is."""
    return np.where(x > 0, x * np.log(np.where(x > 0, of, 1.0)), 0.0)


def pair_likelihoods(counts: np.ndarray) -> np.ndarray:
    """ln L of each row of counts for the ten PAIRS of bases, errors as common as the row has them."""
    n = counts.sum(1).astype(float)
    out = np.empty((len(counts), len(PAIRS)))
    with np.errstate(divide="ignore", invalid="ignore"):
        for i, (a, b) in enumerate(PAIRS):
            hit = counts[:, a] + (counts[:, b] if a != b else 0)
            out[:, i] = _xlog(hit, hit / ((2 if a != b else 1) * n)) + _xlog(n - hit, (n - hit) / ((2 if a != b else 3) * n))
    return out


_HOM = np.array([PAIRS.index((a, a)) for a in range(4)])
_PAIR = np.array([[PAIRS.index((min(a, b), max(a, b))) for b in range(4)] for a in range(4)])


def _high(counts: np.ndarray, site: np.ndarray, starts: np.ndarray, site_limit: float = 3.84, genotype_limit: float = 3.84) -> dict[str, np.ndarray]:
    """high_coverage over the rows of many sites at once; rows without reads have no genotype."""
    row = np.arange(len(counts))
    n, ln = counts.sum(1), pair_likelihoods(counts)
    total = np.add.reduceat(counts, starts)
    order = np.argsort(-total, axis=1, kind="stable")
    own = np.argsort(-counts, axis=1, kind="stable")
    a, b = own[:, 0], own[:, 1]
    hom, het, ref = ln[row, _HOM[a]], ln[row, _PAIR[a, b]], ln[row, _HOM[order[site, 0]]]
    needs = (n > 0) & (2 * np.abs(hom - het) > genotype_limit) & (2 * (np.maximum(hom, het) - ref) > site_limit)
    kinds = np.zeros((len(starts), 4), bool)
    kinds[np.arange(len(starts)), order[:, 0]] = True
    kinds[site[needs], a[needs]] = True
    both = needs & (hom <= het)
    kinds[site[both], b[both]] = True
    left, right = np.array(PAIRS).T
    allowed = kinds[site][:, left] & kinds[site][:, right]
    may = np.where(allowed, ln, -np.inf)
    best = may.argmax(1)
    top = may[row, best]
    may[row, best] = -np.inf
    ratio = 2 * (top - may.max(1))
    several = kinds.sum(1) > 1
    sure = (n > 0) & several[site] & (ratio > genotype_limit)
    # of each site's alleles by falling count, the first two
    ranks = np.argsort(np.where(np.take_along_axis(kinds, order, 1), 0, 1), axis=1, kind="stable")
    first, second = (np.take_along_axis(order, ranks[:, i : i + 1], 1)[:, 0] for i in (0, 1))
    return {
        "read": total.sum(1) > 0, "variable": several, "allele": first, "other": np.where(several, second, -1), "freq": np.full(len(starts), np.nan),
        "a1": np.where(sure, left[best], -1), "a2": np.where(sure, right[best], -1), "gq": np.where(sure, np.searchsorted(QUALITIES, ratio, "right"), 0),
        "gl": np.stack([ln[row, _HOM[first[site]]], ln[row, _PAIR[first[site], second[site]]], ln[row, _HOM[second[site]]]], 1),
    }


def _low(counts: np.ndarray, site: np.ndarray, starts: np.ndarray, site_limit: float = 6.63489660102121) -> dict[str, np.ndarray]:
    """low_coverage over the rows of many sites; only those that one allele with errors does not explain are looked at one by one."""
    total = np.add.reduceat(counts, starts)
    n = total.sum(1).astype(float)
    order = np.argsort(-total, axis=1, kind="stable")
    major = total[np.arange(len(starts)), order[:, 0]]
    with np.errstate(divide="ignore", invalid="ignore"):
        fixed = _xlog(major, major / n) + _xlog(n - major, (n - major) / n / 3)
    rows, sites = len(counts), len(starts)
    out = {
        "read": n > 0, "variable": np.zeros(sites, bool), "allele": order[:, 0], "other": np.full(sites, -1), "freq": np.ones(sites),
        "a1": np.full(rows, -1), "a2": np.full(rows, -1), "gq": np.zeros(rows, int), "gl": np.zeros((rows, 3)),
    }
    ends = np.append(starts[1:], rows)
    for i in np.flatnonzero((n > 0) & (-2 * fixed > site_limit)):
        own = slice(starts[i], ends[i])
        one, two, freq, calls = low_coverage(counts[own], site_limit)
        if two is None:
            continue
        out["variable"][i], out["other"][i], out["freq"][i] = True, two, freq
        pairs = [(one, one), tuple(sorted((one, two))), (two, two)]
        for j, (g, q) in zip(range(starts[i], ends[i]), calls, strict=True):
            if g is not None:
                out["a1"][j], out["a2"][j], out["gq"][j] = *pairs[g], q
        e = 1.5 * (n[i] - total[i, one] - total[i, two] + 0.1) / (n[i] + 0.1)
        out["gl"][own] = likelihoods(counts[own], one, two, e)
    return out


def _called(model: str):
    letters = pa.array(list(BASES))

    def named(x: np.ndarray) -> pa.Array:
        return letters.take(pa.array(x, pa.int64(), mask=x < 0))

    def done(t: pa.Table) -> pa.RecordBatch:
        locus, col = (t.column(c).to_numpy() for c in ("locus", "col"))
        counts = np.stack([t.column(c).to_numpy() for c in ("na", "nc", "ng", "nt")], 1).astype(np.int64)
        new = np.ones(len(locus), bool)
        new[1:] = (locus[1:] != locus[:-1]) | (col[1:] != col[:-1])
        site = np.cumsum(new) - 1
        r = (_low if model == "low" else _high)(counts, site, np.flatnonzero(new))
        keep = np.flatnonzero(r["read"][site])
        s = site[keep]
        variable = r["variable"][s]
        gl = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(variable, 3, 0))]), pa.int32(), mask=np.append(~variable, False)), pa.array(r["gl"][keep][variable].ravel()))
        freq = r["freq"][s]
        cols = [
            pa.array(locus[keep], pa.int64()), pa.array(col[keep], pa.int32()), t.column("sample").combine_chunks().take(pa.array(keep)), pa.array(variable), named(r["allele"][s]), named(r["other"][s]), pa.array(freq, pa.float64(), mask=np.isnan(freq)),
            named(r["a1"][keep]), named(r["a2"][keep]), pa.array(r["gq"][keep], pa.int32()), pa.array(counts[keep].sum(1), pa.int64()), gl,
            pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * 4, pa.int32()), pa.array(counts[keep].ravel(), pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in CALLS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not t.num_rows:
                continue
            locus, col = (t.column(c).to_numpy() for c in ("locus", "col"))
            last = np.flatnonzero((locus != locus[-1]) | (col != col[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield done(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    return run


def call(depths: DataFrame, model: str = "low") -> DataFrame:
    """Genotypes of every sample at every site with reads, by the `low` or `high` coverage model. gl: natural logarithms of the likelihoods of both copies
    the commoner allele, one of each, and both the other; null where only one is seen. counts: of A, C, G and T."""
    d = depths.select(F.col("locus").cast("long").alias("locus"), F.col("col").cast("int").alias("col"), F.col("sample").cast("int").alias("sample"), *[F.col(c).cast("int").alias(c) for c in ("na", "nc", "ng", "nt")])
    return d.repartition("locus").sortWithinPartitions("locus", "col", "sample").mapInArrow(_called(model), CALLS)


# ---------------------------------------------------------------- Hardy-Weinberg with many alleles


def switched(groups: list[list[tuple[int, int]]], burn_in: int = 10_000, batches: int = 20, steps: int = 10_000, seeds: list[int] | None = None) -> list[tuple[float, float]]:
    """For each group of genotypes, P of Hardy-Weinberg proportions for any number of alleles, and its standard error: alleles change places between random individuals, a chain over all tables with
    the same allele counts. Chains of all groups take their steps together, each with random numbers of its own seed, so that reruns agree whatever the groups beside it."""
    out = [(1.0, 0.0)] * len(groups)
    run = [i for i, g in enumerate(groups) if len(g) > 1 and len({a for x in g for a in x}) > 1]
    if not run:
        return out
    size = np.array([len(groups[i]) for i in run])
    kinds = 1 + max(a for i in run for x in groups[i] for a in x)
    m, at = len(run), np.arange(len(run))
    # both copies of individual i at 2 * i and 2 * i + 1
    g = np.zeros((m, 2 * int(size.max())), np.int64)
    count = np.zeros((m, kinds * kinds), np.int64)
    for r, i in enumerate(run):
        g[r, : 2 * len(groups[i])] = [a for x in groups[i] for a in x]
        for a, b in groups[i]:
            count[r, min(a, b) * kinds + max(a, b)] += 1
    log = np.concatenate([[0.0], np.log(np.arange(1, int(size.max()) + 2))])
    rngs = [np.random.default_rng((seeds or [0] * len(groups))[i]) for i in run]
    two = math.log(2)
    here, below, parts = np.zeros(m), np.zeros(m), []

    def told(a, b):
        return np.minimum(a, b) * kinds + np.maximum(a, b)

    for b in range(-1, batches):
        left = burn_in if b < 0 else steps
        below[:] = 0
        total = left
        while left:
            chunk = min(left, 1000)
            left -= chunk
            draws = np.stack([r.integers(0, [[n], [n], [2], [2]], (4, chunk)) for r, n in zip(rngs, size.tolist(), strict=True)], 2)
            for t in range(chunk):
                i, j, x, y = draws[:, t]
                p, q, p2, q2 = g[at, 2 * i + x], g[at, 2 * j + y], g[at, 2 * i + 1 - x], g[at, 2 * j + 1 - y]
                go = (i != j) & (p != q)
                if not go.any():
                    below += here <= 1e-9
                    continue
                delta = np.zeros(m)
                for a, c, sign in ((p, p2, -1), (q, q2, -1), (q, p2, 1), (p, q2, 1)):
                    k = told(a, c)
                    had = count[at, k]
                    delta -= sign * (log[had + (sign > 0)] - two * (a != c))
                    count[at, k] = had + np.where(go, sign, 0)
                here += np.where(go, delta, 0.0)
                g[at, 2 * i + x], g[at, 2 * j + y] = np.where(go, q, p), np.where(go, p, q)
                below += here <= 1e-9
        if b >= 0:
            parts.append(below / total)
    p = np.array(parts)
    se = p.std(0, ddof=1) / math.sqrt(batches) if batches > 1 else np.zeros(m)
    for r, i in enumerate(run):
        out[i] = float(p[:, r].mean()), float(se[r])
    return out


def genotype_table(pairs: list[tuple[str, str]]) -> str:
    """Genotypes as the chain sees them: alleles numbered by falling copies and homozygotes, individuals in order; equal for groups that differ in names only."""
    copies, same = Counter(x for p in pairs for x in p), Counter(a for a, b in pairs if a == b)
    no = {h: i for i, h in enumerate(sorted(copies, key=lambda h: (-copies[h], -same[h], h)))}
    return " ".join(f"{a}/{b}" for a, b in sorted(tuple(sorted((no[a], no[b]))) for a, b in pairs))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tables = [genotype_table([(p["h1"], p["h2"]) for p in pairs]) for pairs in b.column("pairs").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("locus"), b.column("pop"), pa.array(tables, pa.string())], names=["locus", "pop", "genotypes"])


def _switched(burn_in: int, batches: int, steps: int, together: int = 512):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            for lo in range(0, b.num_rows, together):
                tables = b.column("genotypes").slice(lo, together)
                groups = [[tuple(map(int, x.split("/"))) for x in t.split()] for t in tables.to_pylist()]
                p, se = zip(*switched(groups, burn_in, batches, steps, [zlib.crc32(t.encode()) for t in tables.to_pylist()]), strict=True)
                yield pa.RecordBatch.from_arrays([tables, pa.array(p, pa.float64()), pa.array(se, pa.float64())], names=["genotypes", "hwe_p", "se"])

    return run


def guo_thompson(haps: DataFrame, burn_in: int = 10_000, batches: int = 20, steps: int = 10_000) -> DataFrame:
    """(locus, pop, hwe_p, se) from complete haplotypes (locus, pop, sample, h1, h2). P is one of the genotypes' counts, so each distinct table has one chain, of its own seed."""
    full = haps.where("instr(h1, 'N') = 0 and instr(h2, 'N') = 0").select(F.col("locus").cast("long").alias("locus"), F.col("pop").cast("int").alias("pop"), "sample", "h1", "h2")
    g = full.groupBy("locus", "pop").agg(F.collect_list(F.struct("h1", "h2")).alias("pairs")).mapInArrow(_tables, "locus long, pop int, genotypes string")
    g = graphs.written(g, "tables")[0]  # read for the chains and for their groups
    # chains take their time, not their space: a part for each core, however small the table
    chains = g.select("genotypes").distinct().repartition(haps.sparkSession.sparkContext.defaultParallelism, "genotypes")
    return g.join(chains.mapInArrow(_switched(burn_in, batches, steps), "genotypes string, hwe_p double, se double"), "genotypes").select("locus", "pop", "hwe_p", "se")


# ---------------------------------------------------------------- bootstrap


_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def draws(pool: np.ndarray, bp: np.ndarray, times: range) -> Iterator[np.ndarray]:
    """For each of `times`, a value of the pool for each site, all sites of a place given, in order: told by the pool, the number, the place and the site's rank there, so that every
    window that holds a site sees the same values."""
    seed = np.uint64(zlib.crc32(np.ascontiguousarray(pool).tobytes()) * int(_STEP) % 2**64)
    rank = np.arange(len(bp)) - np.searchsorted(bp, bp)
    key = _mixed(_mixed(bp.astype(np.int64).view(np.uint64) + seed) + (rank + 1).astype(np.uint64) * _STEP)
    for t in times:
        u = (_mixed(key + np.uint64((t + 1) * int(_STEP) % 2**64)) >> np.uint64(11)) * 2.0**-53
        yield pool[(u * len(pool)).astype(np.int64)]


def resampled(centre: float, own_bp: int, bp: np.ndarray, weight: np.ndarray, value: np.ndarray, fixed: np.ndarray, pool: np.ndarray, times: int, seed: int) -> float:
    """The chance that a window of values drawn from the pool averages above the centre's; fixed sites keep theirs. One window by itself, as bootstrap() has it for all: the centre's average is that of
    the values, and draws are the sites' own, so neither it nor a seed is asked for."""
    return sum(float((weight * np.where(fixed, 0.0, d - value)).sum()) > 0 for d in draws(pool, bp, range(times))) / times
