"""Linkage along chromosomes: intervals of D' by pair of sites, blocks of strong linkage, block haplotypes by population.

A site's haplotype copies are bits of 64-bit words, so that a pair of sites is a few ANDs and counts. Pairs are formed within a distance, by an equi-join on stretches of
that length: each site meets its own and the next stretch.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import Fn
from . import graphs, popgen

CRITICAL = 3.84
NEAR = 400  # the distance of the queries


def copies(haps: DataFrame, positions: DataFrame) -> DataFrame:
    """haps (locus, sample, pop, h1, h2), positions (locus, chr, bp, strand) -> a row a site and haplotype copy: (chr, place, locus, i, sample, pop, copy, base); N left out."""
    h = haps.select("locus", "sample", "pop", F.posexplode(F.array("h1", "h2")).alias("copy", "h"))
    h = h.select("locus", "sample", "pop", "copy", F.posexplode(F.split("h", "")).alias("i", "base")).where("base in ('A', 'C', 'G', 'T')")
    place = F.col("bp") + popgen.STEP * F.when(F.col("strand") == "-", -F.col("i")).otherwise(F.col("i"))
    return h.join(positions, "locus").select("chr", place.alias("place"), "locus", "i", "sample", "pop", "copy", "base")


def packed_sites(each: DataFrame, least: float = 0.05) -> DataFrame:
    """copies -> (chr, place, locus, i, a, b, share, first, known): sites with two bases, the rarer one of at least a share; words of bits say which copies hold base a, and which are known."""
    numbers = each.select("sample").distinct().withColumn("no", F.dense_rank().over(Window.orderBy("sample")) - 1)  # a row a sample
    site = ["chr", "place", "locus", "i"]
    kinds = each.groupBy(*site).agg(F.min("base").alias("a"), F.max("base").alias("b"), F.countDistinct("base").alias("kinds")).where("kinds = 2").drop("kinds")
    bit = F.col("no") * 2 + F.col("copy")
    e = each.join(F.broadcast(numbers), "sample").join(kinds, site).withColumn("word", F.floor(bit / 64).cast("int")).withColumn("bit", F.expr("shiftleft(1L, cast((no * 2 + copy) % 64 as int))"))
    w = e.groupBy(*site, "a", "b", "word").agg(F.bit_or(F.when(F.col("base") == F.col("a"), F.col("bit")).otherwise(0)).alias("first"), F.bit_or("bit").alias("known"), F.count("*").alias("n"), F.count(F.when(F.col("base") == F.col("a"), 1)).alias("na"))
    words = numbers.agg(F.ceil((F.max("no") + 1) * 2 / 64).cast("int").alias("words"))  # one row
    s = w.groupBy(*site, "a", "b").agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct("first", "known")))).alias("m"), F.sum("n").alias("n"), F.sum("na").alias("na"))
    s = s.withColumn("share", F.least(F.col("na"), F.col("n") - F.col("na")) / F.col("n")).where(F.col("share") >= least).join(F.broadcast(words))
    all_ = F.sequence(F.lit(0), F.col("words") - 1)
    of = lambda k: F.transform(all_, lambda x: F.coalesce(F.col("m")[x][k], F.lit(0).cast("long")))
    return s.select(*site, "a", "b", "share", of("first").alias("first"), of("known").alias("known"))


def _counted(x: pa.Array, kx: pa.Array, y: pa.Array, ky: pa.Array) -> pa.Array:
    """Of each pair of sites: copies known at both, those with the first's base a, with the second's, and with both."""
    words = [v.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(v), -1) if len(v) else np.zeros((0, 1), np.uint64) for v in (x, kx, y, ky)]
    a, ka, b, kb = words
    n = [np.bitwise_count(v).sum(1).astype(np.int64) for v in (ka & kb, a & kb, b & ka, a & b)]
    return pa.StructArray.from_arrays([pa.array(v) for v in n], names=["n", "na", "nb", "nab"])


def near_pairs(sites: DataFrame, most: int) -> DataFrame:
    """Pairs of sites of a chromosome whose places are within `most` (counted inclusively), with counts of copies."""
    kept = F.struct("place", "locus", "i", "first", "known")
    x = sites.select("chr", kept.alias("x"), F.explode(F.array(F.floor(F.col("place") / most), F.floor(F.col("place") / most) + 1)).alias("bin"))
    y = sites.select("chr", kept.alias("y"), F.floor(F.col("place") / most).alias("bin"))
    order = lambda s: F.struct(F.col(f"{s}.place"), F.col(f"{s}.locus"), F.col(f"{s}.i"))
    p = x.join(y, ["chr", "bin"]).where((order("x") < order("y")) & (F.col("y.place") - F.col("x.place") + 1 <= most))
    count = F.arrow_udf(_counted, "n long, na long, nb long, nab long")
    p = p.withColumn("c", count("x.first", "x.known", "y.first", "y.known"))
    side = lambda s, n: [F.col(f"{s}.place").alias(f"place{n}"), F.col(f"{s}.locus").alias(f"locus{n}"), F.col(f"{s}.i").alias(f"i{n}")]
    return p.select("chr", *side("x", 1), *side("y", 2), "c.*")


def intervals(pairs: DataFrame, critical: float = CRITICAL) -> DataFrame:
    """pairs with D, D', chi-square, and where that is significant the 95% interval of D' (0 to 0 elsewhere); kind is strong (above 0.7 to above 0.98), recombined (up to under 0.9)
    or uninformative; four says whether all four gametes occur. Pairs of which one site is fixed among the copies known at both are left out."""
    p = pairs.where("na > 0 and nb > 0 and na < n and nb < n")
    n, pa_, pb = F.col("n"), F.col("na") / F.col("n"), F.col("nb") / F.col("n")
    p = p.withColumn("d", (F.col("nab") * n - F.col("na") * F.col("nb")) / (n * n))
    d = F.col("d")
    top = F.when(d > 0, F.least(pa_ * (1 - pb), (1 - pa_) * pb)).otherwise(F.least(pa_ * pb, (1 - pa_) * (1 - pb)))
    p = p.withColumn("d_prime", F.abs(d) / top).withColumn("chisq", n * d * d / (pa_ * (1 - pa_) * pb * (1 - pb)))
    # where chi-square is at the bound but for rounding, it counts as reached
    sure = F.col("chisq") >= critical - 1e-9
    half = 1.96 * F.sqrt(F.greatest(F.lit(0.0), (pa_ * (1 - pa_) * pb * (1 - pb) + (1 - 2 * pa_) * (1 - 2 * pb) * d - d * d) / n))
    p = p.withColumn("low", F.when(sure, F.col("d_prime") - half).otherwise(0.0)).withColumn("high", F.when(sure, F.col("d_prime") + half).otherwise(0.0))
    kind = F.when((F.col("high") > 0.98) & (F.col("low") > 0.7), "strong").when(F.col("high") < 0.9, "recombined").otherwise("uninformative")
    four = (F.col("nab") > 0) & (F.col("na") > F.col("nab")) & (F.col("nb") > F.col("nab")) & (n - F.col("na") - F.col("nb") + F.col("nab") > 0)
    return p.withColumn("kind", kind).withColumn("four", four)


def merged_blocks(strong: dict[int, list[int]], told: dict[int, list[int]], share: float = 0.9) -> list[tuple[int, int]]:
    """Blocks (first, last) of sites that are strongly linked with any: from the left, a block takes the next such site as long as of all informative pairs then within it at least
    `share` are strong. strong, told: for a site the earlier ones it is strongly, or informatively, linked with, in order."""
    loci = sorted({j for j in strong} | {i for v in strong.values() for i in v})
    out: list[tuple[int, int]] = []
    later = sorted(told)
    for site in loci:
        if out:
            first, last = out[-1]
            between = later[bisect_left(later, last + 1) : bisect_left(later, site + 1)]
            more_told = sum(len(told[j]) - bisect_left(told[j], first) for j in between)
            more_strong = sum(len(strong[j]) - bisect_left(strong[j], first) for j in between if j in strong)
            if have_told + more_told and have_strong + more_strong >= share * (have_told + more_told) - 1e-12:
                out[-1] = first, site
                have_told, have_strong = have_told + more_told, have_strong + more_strong
                continue
        out.append((site, site))
        have_told = have_strong = 0
    return out


class Merger:
    """merged_blocks over sites that come one after another, of one segment after another: what it keeps is the block at hand and counts of the pairs since its last site."""

    def __init__(self, share: float = 0.9) -> None:
        self.share, self.key, self.first, self.last = share, None, None, None
        self.have = self.more = (0, 0)

    def end(self) -> list[tuple]:
        out = [] if self.first is None else [(self.key[0], self.first, self.last)]
        self.first = None
        return out

    def add(self, key: tuple, site: int, linked: bool, told: list[int], strong: list[int]) -> list[tuple]:
        """The blocks that end before a site; told, strong: as in merged_blocks, linked says whether it is strongly linked with any site, earlier or later."""
        out = self.end() if key != self.key else []
        self.key = key
        if self.first is not None:
            self.more = self.more[0] + len(told) - bisect_left(told, self.first), self.more[1] + len(strong) - bisect_left(strong, self.first)
        if not linked:
            return out
        n, s = self.have[0] + self.more[0], self.have[1] + self.more[1]
        if self.first is not None and n and s >= self.share * n - 1e-12:
            self.last, self.have = site, (n, s)
        else:
            out += self.end()
            self.first, self.last, self.have = site, site, (0, 0)
        self.more = 0, 0
        return out


def _merged(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, kind = Merger(share), None

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), *(pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2))], names=["chr", "first", "last"])

        for b in batches:
            kind, rows = b.schema.field("chr").type, []
            for chr_, segment, *site in zip(*(b.column(n).to_pylist() for n in ("chr", "segment", "rank", "linked", "told", "strong")), strict=True):
                rows += merger.add((chr_, segment), *site)
            yield made(rows)
        if kind is not None:
            yield made(merger.end())

    return run


def ranked_sites(sites: DataFrame, most: int) -> DataFrame:
    """sites with rank, their order on the chromosome, and segment: a new one begins where no site lies within `most` before."""
    w = Window.partitionBy("chr").orderBy("place", "locus", "i")
    s = sites.select("chr", "place", "locus", "i", F.row_number().over(w).alias("rank"), (F.col("place") - F.lag("place").over(w) + 1 > most).cast("int").alias("gap"))
    return s.withColumn("segment", F.sum(F.coalesce("gap", F.lit(0))).over(Window.partitionBy("chr").orderBy("rank"))).drop("gap")


def blocks(told: DataFrame, sites: DataFrame, most: int, share: float = 0.9) -> DataFrame:
    """intervals(...) of sites' near pairs -> (chr, block, first, last, place1, place2, snps): blocks of strong linkage, by their sites' ranks; snps counts the sites between.

    Only pairs within `most` are examined. No block spans a stretch of that length without a site, so segments between such stretches are worked on apart, each in a task, which reads its
    sites in order and keeps none.
    """
    r = graphs.written(ranked_sites(sites, most), "ranks")[0]
    one = r.select("chr", F.col("locus").alias("locus1"), F.col("i").alias("i1"), F.col("rank").alias("rank1"), "segment")
    two = r.select("chr", F.col("locus").alias("locus2"), F.col("i").alias("i2"), F.col("rank").alias("rank2"))
    p = told.where("kind <> 'uninformative'").join(one, ["chr", "locus1", "i1"]).join(two, ["chr", "locus2", "i2"]).select("chr", "segment", "rank1", "rank2", (F.col("kind") == "strong").alias("strong"))
    chr_type = told.schema["chr"].dataType.simpleString()
    # a row a site: the earlier sites it is linked with, in order; sites with later ones only have no such list
    side = lambda rank, earlier, strong: F.struct(F.col(rank).alias("rank"), earlier.alias("earlier"), strong.alias("strong"))
    none = F.lit(None).cast("int")
    e = p.select("chr", "segment", F.explode(F.array(side("rank2", F.col("rank1"), F.col("strong")), side("rank1", none, F.col("strong")))).alias("e")).select("chr", "segment", "e.*")
    listed = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("earlier"))))
    s = e.where("earlier is not null or strong").groupBy("chr", "segment", "rank").agg(F.max("strong").alias("linked"), listed(F.lit(True)).alias("told"), listed(F.col("strong")).alias("strong"))
    b = s.repartition("chr", "segment").sortWithinPartitions("chr", "segment", "rank").mapInArrow(_merged(share), f"chr {chr_type}, first int, last int")
    ends = lambda n, at: r.select("chr", F.col("rank").alias(at), F.col("place").alias(n))
    b = b.join(ends("place1", "first"), ["chr", "first"]).join(ends("place2", "last"), ["chr", "last"])
    return b.select("chr", F.row_number().over(Window.partitionBy("chr").orderBy("first")).alias("block"), "first", "last", "place1", "place2", (F.col("last") - F.col("first") + 1).alias("snps"))


def block_haplotypes(found: DataFrame, sites: DataFrame, each: DataFrame, most: int) -> DataFrame:
    """(chr, block, haplotype, pop, count, share): the haplotypes of each block's sites by population; copies unknown at one of them (N) are left out."""
    r = ranked_sites(sites, most).select("chr", "locus", "i", "rank")
    span = found.select("chr", "block", "snps", F.explode(F.sequence("first", "last")).alias("rank"))
    c = each.join(r.join(span, ["chr", "rank"]), ["chr", "locus", "i"])
    h = c.groupBy("chr", "block", "snps", "sample", "pop", "copy").agg(F.array_sort(F.collect_list(F.struct("rank", "base"))).alias("b"))
    h = h.where(F.size("b") == F.col("snps")).select("chr", "block", "pop", F.array_join("b.base", "").alias("haplotype"))
    n = h.groupBy("chr", "block", "haplotype", "pop").agg(F.count("*").alias("count"))
    return n.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("chr", "block", "pop")))


# ---------------------------------------------------------------- queries


def _nine(x: str | Column) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) * 1e6 + 0.5) / 1e6


def ld_intervals(spark, haps, positions):
    t = intervals(near_pairs(packed_sites(copies(haps, positions)), NEAR))
    return t.select("chr", "locus1", "i1", "locus2", "i2", "n", *[_nine(c).alias(c) for c in ("d", "d_prime", "chisq", "low", "high")], "kind", "four")


def _found(haps, positions):
    sites = graphs.written(packed_sites(copies(haps, positions)), "sites")[0]
    return sites, graphs.written(blocks(intervals(near_pairs(sites, NEAR)), sites, NEAR), "blocks")[0]


def ld_blocks(spark, haps, positions):
    return _found(haps, positions)[1].select("chr", "block", "first", "last", "place1", "place2", "snps")


def ld_block_haplotypes(spark, haps, positions):
    sites, found = _found(haps, positions)
    return block_haplotypes(found, sites, copies(haps, positions), NEAR).withColumn("share", _nine("share"))


_PAIRS = f"""WITH l_c AS (SELECT h.locus, sample, pop, k, i - 1 AS i, [h1, h2][k][i] AS base FROM @haps h, range(1, 3) AS a(k), range(1, 5) AS b(i) WHERE i <= len(h1) AND [h1, h2][k][i] <> 'N'),
  l_k AS (SELECT locus, i, min(base) AS a FROM l_c GROUP BY locus, i HAVING count(DISTINCT base) = 2),
  l_m AS (SELECT locus, i, any_value(a) AS a, least(count(*) FILTER (base = a), count(*) FILTER (base <> a)) / count(*) AS share FROM l_c JOIN l_k USING (locus, i) GROUP BY locus, i),
  l_s AS MATERIALIZED (SELECT chr, bp + 20 * CASE WHEN strand = '-' THEN -i ELSE i END AS place, locus, i, a FROM l_m JOIN @positions USING (locus) WHERE share >= 0.05),
  l_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY place, locus, i) AS r FROM l_s),
  l_x AS MATERIALIZED (SELECT n.chr, n.r, n.place, n.locus, n.i, c.sample, c.k, base = a AS f FROM l_n n JOIN l_c c ON c.locus = n.locus AND c.i = n.i),
  l_p AS MATERIALIZED (SELECT x.chr, x.r AS r1, y.r AS r2, any_value(x.locus) AS locus1, any_value(x.i) AS i1, any_value(y.locus) AS locus2, any_value(y.i) AS i2, count(*) AS n, count(*) FILTER (x.f) / count(*) AS p, count(*) FILTER (y.f) / count(*) AS q,
    count(*) FILTER (x.f AND y.f) AS c1, count(*) FILTER (x.f AND NOT y.f) AS c2, count(*) FILTER (y.f AND NOT x.f) AS c3, count(*) FILTER (NOT x.f AND NOT y.f) AS c4
    FROM l_x x JOIN l_x y ON x.chr = y.chr AND x.sample = y.sample AND x.k = y.k AND x.r < y.r AND y.place - x.place < {NEAR} GROUP BY x.chr, x.r, y.r HAVING p > 0 AND p < 1 AND q > 0 AND q < 1),
  l_d AS (SELECT *, (1.0 * c1 * c4 - 1.0 * c2 * c3) / (1.0 * n * n) AS d FROM l_p),
  l_e AS (SELECT *, CASE WHEN d > 0 THEN d / least(p * (1 - q), q * (1 - p)) ELSE -d / least(p * q, (1 - p) * (1 - q)) END AS dp, n * d * d / (p * q * (1 - p) * (1 - q)) AS chisq, 1.96 * sqrt(greatest(0, p * q * (1 - p) * (1 - q) + (1 - 2 * p) * (1 - 2 * q) * d - d * d) / n) AS w FROM l_d),
  l_i AS MATERIALIZED (SELECT *, CASE WHEN chisq >= 3.84 - 1e-9 THEN dp - w ELSE 0 END AS low, CASE WHEN chisq >= 3.84 - 1e-9 THEN dp + w ELSE 0 END AS high FROM l_e),
  l_t AS MATERIALIZED (SELECT *, CASE WHEN low > 0.7 AND high > 0.98 THEN 'strong' WHEN high < 0.9 THEN 'recombined' ELSE 'uninformative' END AS kind FROM l_i)"""
_R = lambda x: f"floor({x} * 1e6 + 0.5) / 1e6"
_BLOCKS = _PAIRS + f""", b_l AS MATERIALIZED (SELECT chr, r, place, row_number() OVER (PARTITION BY chr ORDER BY r) AS k FROM (SELECT chr, r1 AS r FROM l_t WHERE kind = 'strong' UNION SELECT chr, r2 FROM l_t WHERE kind = 'strong') z JOIN l_n USING (chr, r)),
  b_g AS (SELECT chr, r, place - lag(place) OVER (PARTITION BY chr ORDER BY r) >= {NEAR} AS gap FROM l_n), b_s AS MATERIALIZED (SELECT chr, r, sum(coalesce(gap, false)::INT) OVER (PARTITION BY chr ORDER BY r) AS segment FROM b_g),
  b_y AS (SELECT t.chr, t.r1, t.kind, l.k AS y FROM l_t t ASOF JOIN b_l l ON t.chr = l.chr AND t.r2 <= l.r WHERE t.kind <> 'uninformative'),
  b_c AS (SELECT a.chr, a.k AS x, y, count(*) AS told, count(*) FILTER (kind = 'strong') AS strong FROM b_l a JOIN b_y t ON t.chr = a.chr AND t.r1 >= a.r GROUP BY ALL),
  b_m AS MATERIALIZED (SELECT a.chr, a.k AS x, b.k AS y, sum(coalesce(told, 0)) OVER w AS told, sum(coalesce(strong, 0)) OVER w AS strong FROM b_l a JOIN b_l b ON a.chr = b.chr AND a.k < b.k LEFT JOIN b_c c ON c.chr = a.chr AND c.x = a.k AND c.y = b.k WINDOW w AS (PARTITION BY a.chr, a.k ORDER BY b.k)),
  b_w AS (SELECT chr, k, k AS s FROM b_l WHERE k = 1 UNION ALL SELECT w.chr, w.k + 1, CASE WHEN m.told > 0 AND m.strong >= 0.9 * m.told - 1e-12 AND p.segment = q.segment THEN w.s ELSE w.k + 1 END FROM b_w w JOIN b_l l ON l.chr = w.chr AND l.k = w.k + 1 JOIN b_l o ON o.chr = w.chr AND o.k = w.k
    JOIN b_s p ON p.chr = w.chr AND p.r = l.r JOIN b_s q ON q.chr = w.chr AND q.r = o.r LEFT JOIN b_m m ON m.chr = w.chr AND m.x = w.s AND m.y = w.k + 1),
  b_b AS (SELECT w.chr, w.s, min(r) AS first, max(r) AS last FROM b_w w JOIN b_l l ON l.chr = w.chr AND l.k = w.k GROUP BY w.chr, w.s),
  b_o AS MATERIALIZED (SELECT chr, CAST(row_number() OVER (PARTITION BY chr ORDER BY first) AS INT) AS block, CAST(first AS INT) AS first, CAST(last AS INT) AS last, CAST(last - first + 1 AS INT) AS snps FROM b_b)"""
_CHECK = {
    "ld_intervals": _PAIRS + f" SELECT chr, locus1, CAST(i1 AS INT) AS i1, locus2, CAST(i2 AS INT) AS i2, n, {_R('d')} AS d, {_R('dp')} AS d_prime, {_R('chisq')} AS chisq, {_R('low')} AS low, {_R('high')} AS high, kind, least(c1, c2, c3, c4) > 0 AS four FROM l_t",
    "ld_blocks": _BLOCKS + " SELECT o.*, x.place AS place1, y.place AS place2 FROM b_o o JOIN l_n x ON x.chr = o.chr AND x.r = o.first JOIN l_n y ON y.chr = o.chr AND y.r = o.last",
    "ld_block_haplotypes": _BLOCKS + f""", b_h AS (SELECT o.chr, block, any_value(snps) AS snps, c.sample, c.k, any_value(c.pop) AS pop, string_agg(base, '' ORDER BY n.r) AS haplotype FROM b_o o JOIN l_n n ON n.chr = o.chr AND n.r BETWEEN o.first AND o.last JOIN l_c c ON c.locus = n.locus AND c.i = n.i GROUP BY o.chr, block, c.sample, c.k)
      SELECT chr, block, haplotype, pop, count(*) AS count, {_R('count(*) / sum(count(*)) OVER (PARTITION BY chr, block, pop)')} AS share FROM b_h WHERE len(haplotype) = snps GROUP BY chr, block, haplotype, pop""",
}
PLACED = ("haps", "positions")
OPS = {"ld_intervals": Fn(PLACED, ld_intervals, _CHECK["ld_intervals"]), "ld_blocks": Fn(PLACED, ld_blocks, _CHECK["ld_blocks"]), "ld_block_haplotypes": Fn(PLACED, ld_block_haplotypes, _CHECK["ld_block_haplotypes"])}
