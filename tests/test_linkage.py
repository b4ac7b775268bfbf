import math
import random

from radspark import runs

HAPS = "locus long, sample int, pop int, grp int, h1 string, h2 string"
PLACES = "locus long, chr int, bp long, strand string"


def world(seed, loci=14, samples=45):
    """Haplotypes of four sites a locus drawn from a few founders, so that near sites are linked; some bases unknown."""
    rng = random.Random(seed)
    founders = [[[rng.choice("AG") for _ in range(4)] for _ in range(loci)] for _ in range(4)]
    rows, copies = [], {}
    for s in range(samples):
        pair = []
        for k in range(2):
            at, mine = rng.randrange(4), []
            for lo in range(loci):
                if rng.random() < 0.12:
                    at = rng.randrange(4)
                mine.append(["N" if rng.random() < 0.02 else x for x in founders[at][lo]])
            pair.append(mine)
            copies[s, k] = mine
        rows += [(lo, s, s % 3, 0, "".join(pair[0][lo]), "".join(pair[1][lo])) for lo in range(loci)]
    places = [(lo, lo % 2, (lo // 2) * 70 + 100 + (3000 if lo > 9 else 0), "+" if lo % 3 else "-") for lo in range(loci)]
    return rows, places, copies


def brute(rows, places, copies, most, least):
    where = {lo: (c, bp, s) for lo, c, bp, s in places}
    sites = []
    for lo, (c, bp, strand) in where.items():
        for i in range(4):
            x = {k: m[lo][i] for k, m in copies.items() if m[lo][i] != "N"}
            kinds = sorted(set(x.values()))
            if len(kinds) == 2:
                share = sum(v == kinds[0] for v in x.values()) / len(x)
                if min(share, 1 - share) >= least:
                    sites.append((c, bp + 20 * (-i if strand == "-" else i), lo, i, {k: v == kinds[0] for k, v in x.items()}, x))
    sites.sort(key=lambda s: s[:4])
    told = {}
    for a, s in enumerate(sites):
        for b, t in enumerate(sites):
            if a < b and s[0] == t[0] and t[1] - s[1] + 1 <= most:
                both = s[4].keys() & t[4].keys()
                n, p, q = len(both), sum(s[4][k] for k in both) / len(both), sum(t[4][k] for k in both) / len(both)
                if not (0 < p < 1 and 0 < q < 1):
                    continue
                d = sum(s[4][k] and t[4][k] for k in both) / n - p * q
                dp = d / min(p * (1 - q), q * (1 - p)) if d > 0 else -d / min(p * q, (1 - p) * (1 - q))
                chisq = n * d * d / (p * q * (1 - p) * (1 - q))
                w = 1.96 * math.sqrt(max(0, p * q * (1 - p) * (1 - q) + (1 - 2 * p) * (1 - 2 * q) * d - d * d) / n)
                low, high = (dp - w, dp + w) if chisq >= 3.84 else (0, 0)
                told[a, b] = (n, d, dp, low, high, "strong" if low > 0.7 and high > 0.98 else "recombined" if high < 0.9 else "uninformative")
    return sites, told


def greedy(sites, told, share=0.9, most=0):
    """Adjacent blocks merged from the left, counting all pairs anew each time."""
    out = []
    for c in sorted({s[0] for s in sites}):
        own = [i for i, s in enumerate(sites) if s[0] == c]
        loci = sorted({i for p, v in told.items() for i in p if v[5] == "strong" and i in own})
        blocks = [[i, i] for i in loci]
        k = 0
        while k + 1 < len(blocks):
            a, b = blocks[k][0], blocks[k + 1][1]
            inside = [v[5] for p, v in told.items() if a <= p[0] and p[1] <= b and v[5] != "uninformative"]
            apart = any(sites[j + 1][1] - sites[j][1] + 1 > most for j in range(a, b))
            if inside and not apart and inside.count("strong") >= share * len(inside):
                blocks[k][1] = b
                del blocks[k + 1]
            else:
                k += 1
        out += [(c, own.index(a) + 1, own.index(b) + 1) for a, b in blocks]
    return out


def test_intervals_blocks_and_haplotypes(spark):
    rows, places, copies = world(3)
    most, least = 200, 0.05
    sites, told = brute(rows, places, copies, most, least)
    out = runs.linkage(spark, spark.createDataFrame(rows, HAPS), spark.createDataFrame(places, PLACES), most, least)
    key = {s[2:4]: i for i, s in enumerate(sites)}
    got = {(key[r["locus1"], r["i1"]], key[r["locus2"], r["i2"]]): r for r in out["intervals"].collect()}
    assert got.keys() == told.keys() and len(told) > 150
    for k, r in got.items():
        want = told[k]
        assert (r["n"], r["kind"]) == (want[0], want[5])
        assert all(math.isclose(r[n], w, abs_tol=1e-9) for n, w in zip(("d", "d_prime", "low", "high"), want[1:5], strict=True))
    assert {v[5] for v in told.values()} == {"strong", "recombined", "uninformative"}
    found = {(r["chr"], r["block"]): (r["first"], r["last"]) for r in out["strong_blocks"].collect()}
    want = greedy(sites, told, most=most)
    assert sorted((c, *v) for (c, _), v in found.items()) == want and any(b - a > 2 for _, a, b in want)
    counts = {}
    for (c, block), (first, last) in found.items():
        own = [s for s in sites if s[0] == c][first - 1 : last]
        for k in copies:
            h = "".join(s[5].get(k, "N") for s in own)
            if "N" not in h:
                at = c, block, h, k[0] % 3
                counts[at] = counts.get(at, 0) + 1
    got = {(r["chr"], r["block"], r["haplotype"], r["pop"]): (r["count"], r["share"]) for r in out["block_haplotypes"].collect()}
    assert {k: n for k, (n, _) in got.items()} == counts
    for c, b, _, p in counts:
        assert math.isclose(sum(s for k, (_, s) in got.items() if (k[0], k[1], k[3]) == (c, b, p)), 1)


def test_no_sites(spark):
    rows, places, _ = world(1, loci=2, samples=3)
    fixed = [(lo, s, p, g, "AAAA", "AAAN") for lo, s, p, g, *_ in rows]
    for r in (fixed, []):
        out = runs.linkage(spark, spark.createDataFrame(r, HAPS), spark.createDataFrame(places, PLACES))
        assert all(out[n].count() == 0 for n in ("intervals", "strong_blocks", "block_haplotypes"))


def test_bootstrap_draws_a_place_once(spark):
    """Copies of sites share their window and its draws; cells, stretches and borders between them change nothing."""
    import numpy as np

    from radspark.operators import models, populations

    rng = random.Random(5)
    rows = [(0, 0, bp, rng.choice([-7.0, rng.random(), rng.random()]), rng.random() < 0.2, rng.randrange(2, 6), 0) for bp in sorted(rng.randrange(0, 6000) for _ in range(150))]
    rows = [(*r[:6], i) for i, r in enumerate([*rows, *rows, *rows])]
    frame = spark.createDataFrame(rows, "chr int, pop int, bp long, stat double, fixed boolean, alleles int, event_id long")
    got = {r[0]: r[1] for r in populations.bootstrap(spark, frame, 10, 50, stretches=3).collect()}
    t = sorted(rows, key=lambda r: (r[2], r[6]))
    pool = np.array([r[3] for r in t if r[3] > -7 and not r[4]])
    want = {}
    for r in t:
        at = [x for x in t if r[2] - 30 <= x[2] < r[2] + 30 and x[3] > -7]
        if r[4] or not at:
            continue
        bp, v, f = (np.array([x[i] for x in at]) for i in (2, 3, 4))
        w = np.array([x[5] - 1 for x in at]) * np.exp(-((bp - r[2]) ** 2) / 200.0)
        seed = min(x[6] for x in t if x[2] == r[2] and not x[4])
        want[r[6]] = models.resampled(float((v * w).sum() / w.sum()), r[2], bp, w, v, f, pool, 50, seed)
    assert got == want and len({r[2] for r in rows if r[6] in got}) < len(got) / 2


def test_blocks_site_after_site():
    """What a stream of sites keeps is enough for the blocks of the whole segment, one segment after another."""
    from radspark.operators import linkage

    for seed in range(60):
        rng = random.Random(seed)
        merger, got, want = linkage.Merger(0.9), [], []
        for key in ((0, 0), (0, 1), (1, 0)):
            strong, told = {}, {}
            for y in range(1, 60):
                for x in range(max(0, y - 9), y):
                    kind = rng.choices(["strong", "recombined", ""], [6, 0.4, 5] if y // 15 % 2 else [2, 1, 9])[0]
                    if kind:
                        told.setdefault(y, []).append(x)
                    if kind == "strong":
                        strong.setdefault(y, []).append(x)
            linked = set(strong) | {x for v in strong.values() for x in v}
            want += [(key[0], *b) for b in linkage.merged_blocks(strong, told)]
            for y in sorted(linked | set(told)):
                got += merger.add(key, y, y in linked, told.get(y, []), strong.get(y, []))
        assert got + merger.end() == want


def test_gamete_blocks(spark):
    """Blocks of loci of any number of sites against the search over all pairs."""
    from itertools import combinations

    from radspark.operators import populations

    rng = random.Random(3)
    rows = [(lo, s, 0, 0, *("".join(rng.choice("AG" if rng.random() < 0.9 else "AN") for _ in range(2 + lo % 7)) for _ in range(2))) for lo in range(40) for s in range(1 + lo % 5)]
    want = set()
    for lo in range(40):
        hs, pairs = [h for r in rows if r[0] == lo for h in r[4:]], {}
        for i, j in combinations(range(1, 3 + lo % 7), 2):
            seen = {h[i - 1] + h[j - 1] for h in hs if "N" not in h[i - 1] + h[j - 1]}
            if len({x for x, _ in seen}) == 2 == len({y for _, y in seen}):
                pairs[i, j] = len(seen)
        want |= {(lo, *b) for b in populations.four_gamete_blocks(pairs, max(j for _, j in pairs))} if pairs else set()
    made = populations.fgt_blocks(spark, spark.createDataFrame(rows, HAPS))
    assert {tuple(r) for r in made.collect()} == want and len(want) > 60
    assert "Pandas" not in made._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_of_dense_places(spark):
    """Where a window holds many places, sums over shared draws are those of each window by itself, and draws of a site don't grow with the windows that hold it."""
    import numpy as np

    from radspark.operators import models, populations

    rng = random.Random(6)
    rows = [(0, 0, rng.randrange(0, 9000), rng.choice([-7.0, rng.random(), rng.random(), rng.random()]), rng.random() < 0.1, rng.randrange(2, 6), i) for i in range(4000)]
    frame = spark.createDataFrame(rows, "chr int, pop int, bp long, stat double, fixed boolean, alleles int, event_id long")
    cells, populations.CELLS = populations.CELLS, 40_000
    try:
        got = {r[0]: r[1] for r in populations.bootstrap(spark, frame, 1000, 20, stretches=2).collect()}
    finally:
        populations.CELLS = cells
    t = sorted(rows, key=lambda r: (r[2], r[6]))
    pool = np.array([r[3] for r in t if r[3] > -7 and not r[4]])
    assert set(got) == {r[6] for r in t if not r[4]}
    for r in t[::80]:
        if r[4]:
            continue
        at = [x for x in t if r[2] - 3000 <= x[2] < r[2] + 3000 and x[3] > -7]
        bp, v, f = (np.array([x[i] for x in at]) for i in (2, 3, 4))
        w = np.array([x[5] - 1 for x in at]) * np.exp(-((bp - r[2]) ** 2) / 2e6)
        assert got[r[6]] == models.resampled(0.0, r[2], bp, w, v, f, pool, 20, 0)
    # one pass of draws over all sites: as many numbers as sites, whatever the window
    bp = np.array([x[2] for x in t])
    one, part = next(iter(models.draws(pool, bp, range(1)))), next(iter(models.draws(pool, bp[1000 - (bp[:1000] == bp[1000]).sum() :], range(1))))
    assert len(one) == len(t) and (one[-len(part) :] == part).all() and abs(np.mean(one) - pool.mean()) < 0.03


def _crowd(spark, seed):
    """Sites at nearly every place of a stretch that several cells hold, copies and empty places among them."""
    rng = random.Random(seed)
    rows = [(c, 0, rng.randrange(-500, 2500) if c else rng.choice([-7, 7, 5000]), rng.choice([-7.0, rng.random(), 5 * rng.random()]), rng.random() < 0.1, rng.randrange(2, 6), i) for i in range(3000) for c in (i % 3 > 0,)]
    rows = [(int(c), *r) for c, *r in rows]
    return rows, spark.createDataFrame(rows, "chr int, pop int, bp long, stat double, fixed boolean, alleles int, event_id long")


def _no_pairs(frame):
    """Sites do not meet sites of their window one by one."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "explode(array(-1, 0, 1))" not in plan


def test_kernel_smooth_of_dense_places(spark):
    from radspark.operators import popgen

    rows, frame = _crowd(spark, 7)
    out = popgen.kernel_smooth(spark, frame, sigma=300)
    _no_pairs(out)
    got = {r.event_id: r for r in out.collect()}
    assert len(got) == out.count()
    for c, p, bp, _, fixed, _, i in rows:
        at = [x for x in rows if x[:2] == (c, p) and bp - 900 <= x[2] < bp + 900 and x[3] > -7]
        assert (i in got) == (not fixed and bool(at))
        if i in got and i % 20 == 0:
            w = [(x[5] - 1) * math.exp(-((x[2] - bp) ** 2) / 180000) for x in at]
            assert got[i].n == len(at) and math.isclose(got[i].smoothed, sum(a * x[3] for a, x in zip(w, at, strict=True)) / sum(w), abs_tol=6e-5)


def test_bonferroni_of_dense_places(spark):
    from radspark.operators import popgen

    rows, frame = _crowd(spark, 8)
    extra = spark.createDataFrame([(0, 0, None, 1.0, False, 3, 9001), (0, 0, None, 1.0, False, 3, 9002), (None, 0, 5, 1.0, False, 3, 9003)], frame.schema)
    out = popgen.bonferroni(spark, frame.union(extra), sigma=10)
    _no_pairs(out)
    got = {r.event_id: r.sites for r in out.collect()}
    want = {i: sum(1 for x in rows if x[:2] == (c, p) and bp - 30 <= x[2] < bp + 30) for c, p, bp, _, _, _, i in rows}
    assert got == want | {9001: 2, 9002: 2, 9003: 1}
