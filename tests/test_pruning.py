import math
import random

from pyspark.sql import functions as F

from radspark.operators import pruning


def brute(observed):
    """The rules, one sample at a time."""
    copies = {}
    by = {}
    for locus, sample, h, d in observed:
        by.setdefault((locus, sample), {})[h] = d
    for (locus, _), own in by.items():
        for h in own:
            copies[locus, h] = copies.get((locus, h), 0) + (2 if len(own) == 1 else 1)
    out = {}
    for (locus, sample), own in by.items():
        order = sorted(own, key=lambda h: (-own[h], h))
        depth, into = dict(own), {}
        if len(order) > 2:
            main = order[:2] if own[order[1]] > own[order[2]] else order[:1]
            for h in order:
                if h in main:
                    continue
                near = sorted(((round(copies[locus, t] * math.log(own[t]), 9), t) for t in main if sum(a != b for a, b in zip(h, t, strict=True)) == 1 and own[t] > 1), reverse=True)
                if near and (len(near) == 1 or near[0][0] > near[1][0]):
                    into[h] = near[0][1]
            for h, t in into.items():
                depth[t] += 1
                del depth[h]
        weight = {h: round(copies[locus, h] * math.log(d), 9) for h, d in depth.items()}
        ranked = sorted(weight, key=lambda h: (-weight[h], h))
        second = weight[ranked[1]] if len(ranked) > 1 else 0
        tied = [h for h in ranked if weight[h] == second]
        for r, h in enumerate(ranked):
            low = r > 1 and weight[h] < second
            alone = r > 0 and len(ranked) > 1 and len(tied) > 1 and h in tied and copies[locus, h] == 1 and sum(weight[x] >= second for x in ranked) > 2
            out[locus, sample, h] = ("rare" if low or alone else "kept", None)
        out |= {(locus, sample, h): ("merged", t) for h, t in into.items()}
    return out


def test_pruned_by_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for locus in range(40):
        pool = ["".join(rng.choice("AC") for _ in range(4)) for _ in range(6)]
        for sample in range(5):
            own = set(rng.sample(pool, rng.randint(1, 4)))
            rows += [(locus, sample, h, rng.choice((1, 1, 2, 5, 9))) for h in own]
    want = brute(rows)
    got = pruning.pruned(spark.createDataFrame(rows, "locus long, sample int, haplotype string, depth long").repartition(3)).collect()
    assert {(r["locus"], r["sample"], r["haplotype"]): (r["fate"], r["into"]) for r in got} == want and len(got) == len(want)
    assert {f for f, _ in want.values()} == {"kept", "merged", "rare"}


def test_to_sample(spark):
    df = spark.createDataFrame([("ACGTG", [1, 4, 9, 12, 30], [4, 12, 13])], "h string, theirs array<int>, own array<int>")
    assert df.select(pruning.to_sample(F.col("h"), F.col("theirs"), F.col("own"))).first()[0] == "CT"


def test_placed_and_routed(spark):
    a = [("1", "chrA", 7, "+", 30, 0.0, True, False), ("2", "chrA", 9, "-", 30, 0.0, True, False), ("2", "chrB", 5, "+", 30, 0.0, True, False), ("3", "chrA", 1, "+", 5, 0.0, True, False), ("4", "chrA", 1, "+", 30, 0.5, True, False), ("5", "*", -1, "+", 0, 0.0, False, False), ("1", "chrB", 2, "+", 30, 0.0, True, True)]
    al = spark.createDataFrame([(*r, False) for r in a], "name string, chr string, pos5 long, strand string, mapq int, clipped_share double, mapped boolean, secondary boolean, supplementary boolean")
    cat = spark.createDataFrame([(i, f"con{i}", "old") for i in range(1, 6)], "catalog long, consensus string, chr string")
    placed = pruning.placed_catalog(cat, al, 10, 0.8)
    assert [tuple(r) for r in placed.select("catalog", "consensus", "chr", "bp", "strand").collect()] == [(1, "con1", "chrA", 7, "+")]
    m = spark.createDataFrame([("s", 10, 1), ("s", 10, 1), ("s", 11, 2), ("t", 10, 1), ("t", 10, 2), ("u", 12, 3), ("u", 13, 3)], "sample string, locus long, catalog long")
    loci = spark.createDataFrame([("s", 10, "x"), ("s", 11, "y"), ("t", 10, "z")], "sample string, locus long, consensus string")
    assert [(r["sample"], r["locus"], r["chr"], r["bp"]) for r in pruning.placed_loci(loci, m, placed).collect()] == [("s", 10, "chrA", 7)]
    members = spark.createDataFrame([("s", 10, 1), ("s", 11, 2), ("t", 10, 1), ("u", 12, 5), ("u", 13, 6)], "sample string, locus long, read long")
    mates = spark.createDataFrame([(s, r, f"{s}{r}", "q") for s in "stu" for r in range(1, 7)], "sample string, read long, seq string, qual string")
    got = {tuple(r) for r in pruning.second_reads(members, m, mates).collect()}
    assert got == {(1, "s", 1, "s1", "q"), (2, "s", 2, "s2", "q")}
    assert {r["catalog"] for r in pruning.second_reads(members, m, mates, spark.createDataFrame([(2,)], "catalog long")).collect()} == {2}
