"""A sample's excess haplotypes pruned, the catalog put on a genome, second reads routed to their locus.

observed is (locus, sample, haplotype, depth): a sample's haplotypes at a catalog locus, spelled over its SNPs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hamming
from ..plans.dialect import Fn
from ..sources import formats
from . import graphs


def population_counts(observed: DataFrame) -> DataFrame:
    """(locus, haplotype, copies): 2 for each sample that has the haplotype alone, 1 for each that has it beside others."""
    own = Window.partitionBy("locus", "sample")
    one = observed.select("locus", "sample", "haplotype", F.when(F.count("*").over(own) == 1, 2).otherwise(1).alias("n"))
    return one.groupBy("locus", "haplotype").agg(F.sum("n").alias("copies"))


def to_sample(haplotype: Column, catalog_cols: Column, own_cols: Column) -> Column:
    """A catalog haplotype at those of its columns that a sample's locus has."""
    at = F.filter(F.transform(own_cols, lambda c: F.array_position(catalog_cols, c).cast("int")), lambda p: p > 0)
    return F.array_join(F.transform(at, lambda p: F.substr(haplotype, p, F.lit(1))), "")


def pruned(observed: DataFrame) -> DataFrame:
    """observed with `fate` and `into`: kept, merged or rare.

    Of a sample with more than two haplotypes, those beside the deepest and the second (if it is deeper than the third; ties by letters) are compared with these two, and where one letter
    differs merged into the one of greater weight, that is copies in the population times the logarithm of its depth here; of equal weight, or none, they stay. A merged haplotype
    adds 1 to the depth it goes to. Of what is left, all beyond the two of greatest weight go as rare unless they weigh as much as the second; and of several that do, those that no other sample has.
    """
    n = population_counts(observed)
    own = Window.partitionBy("locus", "sample")
    o = observed.join(n, ["locus", "haplotype"]).withColumn("k", F.row_number().over(own.orderBy(F.desc("depth"), "haplotype")))
    top = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c))).over(own)
    o = o.withColumn("all", F.count("*").over(own)).withColumn("h1", top(1, "haplotype")).withColumn("h2", F.when(top(2, "depth") > top(3, "depth"), top(2, "haplotype")))
    weight = lambda k: F.round(top(k, "copies") * F.ln(top(k, "depth")), 9)
    o = o.withColumn("w1", weight(1)).withColumn("w2", weight(2))
    near = lambda h, w: F.when((hamming(F.col("haplotype"), F.col(h)) == 1) & (F.length("haplotype") == F.length(h)), F.col(w)).otherwise(0.0)
    a, b = near("h1", "w1"), F.coalesce(near("h2", "w2"), F.lit(0.0))
    loose = (F.col("all") > 2) & (F.col("k") > 1) & ((F.col("k") > 2) | F.col("h2").isNull())
    o = o.withColumn("into", F.when(loose & (a > b), F.col("h1")).when(loose & (b > a), F.col("h2")))
    gained = o.where("into is not null").groupBy("locus", "sample", F.col("into").alias("haplotype")).agg(F.count("*").alias("more"))
    o = o.join(gained, ["locus", "sample", "haplotype"], "left").withColumn("left", F.col("into").isNull())
    o = o.withColumn("weight", F.when(F.col("left"), F.round(F.col("copies") * F.ln(F.col("depth") + F.coalesce("more", F.lit(0))), 9)))
    o = o.withColumn("r", F.row_number().over(own.orderBy(F.desc_nulls_last("weight"), "haplotype")))
    second = F.max(F.when(F.col("r") == 2, F.col("weight"))).over(own)
    o = o.withColumn("second", second).withColumn("tied", F.count(F.when(F.col("left") & (F.col("weight") == F.col("second")), 1)).over(own))
    low = F.col("left") & (F.col("r") > 2) & (F.col("weight") < F.col("second"))
    alone = F.col("left") & (F.col("r") > 1) & (F.col("tied") > 1) & (F.col("weight") == F.col("second")) & (F.col("copies") == 1) & (F.count(F.when(F.col("left") & (F.col("weight") >= F.col("second")), 1)).over(own) > 2)
    fate = F.when(~F.col("left"), "merged").when(low | alone, "rare").otherwise("kept")
    return o.select("locus", "sample", "haplotype", "depth", fate.alias("fate"), "into")


# ---------------------------------------------------------------- genome coordinates


def placed_catalog(catalog: DataFrame, alignments: DataFrame, min_mapq: int = 0, min_aligned: float = 0.0) -> DataFrame:
    """The catalog (catalog, ...) of loci that align once: with chr, bp (the 5' end) and strand of their consensus' primary alignment (alignments: name is the locus' number). Loci with more than
    one primary alignment, of less mapping quality, or of which less than a share is aligned, are left out."""
    a = alignments.where("mapped and not secondary and not supplementary").withColumn("catalog", F.col("name").try_cast("long"))
    a = a.where((F.col("mapq") >= min_mapq) & (1 - F.col("clipped_share") >= min_aligned) & F.col("catalog").isNotNull())
    one = a.groupBy("catalog").agg(F.count("*").alias("_n"), F.first("chr").alias("chr"), F.first("pos5").alias("bp"), F.first("strand").alias("strand")).where("_n = 1").drop("_n")
    return catalog.drop("chr", "bp", "strand").join(one, "catalog")


def placed_loci(loci: DataFrame, matches: DataFrame, placed: DataFrame) -> DataFrame:
    """A sample's loci (sample, locus, ...) with the coordinates of the catalog locus they match; those that match none, or several, are left out."""
    m = matches.select("sample", "locus", "catalog").distinct()
    m = m.withColumn("_n", F.count("*").over(Window.partitionBy("sample", "locus"))).where("_n = 1").drop("_n")
    return loci.drop("chr", "bp", "strand").join(m, ["sample", "locus"]).join(placed.select("catalog", "chr", "bp", "strand"), "catalog")


def second_reads(members: DataFrame, matches: DataFrame, mates: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """(catalog, sample, read, seq, qual): second mates (sample, read, seq, qual) of the reads in a sample's loci (members: sample, locus, read), by the catalog locus these match; loci
    that two loci of a sample match are left out, and those not in a whitelist (catalog) where there is one."""
    m = matches.select("sample", "locus", "catalog").distinct()
    own, theirs = Window.partitionBy("sample", "locus"), Window.partitionBy("sample", "catalog")
    m = m.withColumn("a", F.count("*").over(own)).withColumn("b", F.count("*").over(theirs)).where("a = 1 and b = 1").drop("a", "b")
    m = m.join(whitelist.select("catalog").distinct(), "catalog", "left_semi") if whitelist is not None else m
    return mates.join(members.select("sample", "locus", "read"), ["sample", "read"]).join(m, ["sample", "locus"]).select("catalog", "sample", "read", "seq", "qual")


# ---------------------------------------------------------------- queries


def _observed(haps: DataFrame) -> DataFrame:
    """A sample's two haplotypes, one with an error, and one of another's, by depths that differ."""
    full = haps.where("instr(h1, 'N') = 0 and instr(h2, 'N') = 0")
    other = full.select("locus", (F.col("sample") + 1).alias("sample"), F.col("h1").alias("h3"))
    j = full.join(other, ["locus", "sample"], "left")
    wrong = F.concat(F.translate(F.substring("h1", 1, 1), "ACGT", "GTAC"), F.expr("substring(h1, 2)"))
    lo, s = F.col("locus"), F.col("sample")
    read = lambda h, n: F.struct(h.alias("haplotype"), n.cast("long").alias("depth"))
    every = F.array(read(F.col("h1"), 6 + (lo + s) % 5), read(F.col("h2"), 3 + (lo * 3 + s) % 4), read(wrong, 1 + (lo + 2 * s) % 3), read(F.col("h3"), 1 + (lo * 5 + s) % 3))
    return j.select("locus", "sample", F.explode(every).alias("r")).where("r.haplotype is not null").groupBy("locus", "sample", "r.haplotype").agg(F.sum("r.depth").alias("depth"))


def pruned_haplotypes(spark, haps):
    return pruned(graphs.written(_observed(haps), "observed")[0])


def genome_catalog(spark, alignments, loci):
    a = formats.aligned(alignments).withColumn("name", F.substring("name", 2, 20))
    known = loci.select(F.col("locus").alias("catalog"), F.md5("consensus").alias("consensus"))
    return placed_catalog(known, a, 10, 0.9)


def routed_mates(spark, mates):
    """Even turns are a conversation's first reads, in loci by their first letters; each next turn is the second read."""
    first = mates.where("turn % 2 = 0").select(F.col("role").alias("sample"), (F.col("conv_id") * 1000 + F.col("turn")).alias("read"), F.substring("seq", 1, 3).alias("k"))
    members = first.where("length(k) = 3").withColumn("locus", F.xxhash64("k", "sample"))
    found = members.select("sample", "locus", F.when(F.col("k") < "C", 1).when(F.col("k") < "CG", F.ascii(F.substring("k", 3, 1))).otherwise(F.ascii(F.substring("k", 2, 1)) * 1000 + F.ascii(F.substring("k", 3, 1))).cast("long").alias("catalog"))
    both = mates.where("turn % 2 = 1").select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("read"), "seq")
    both = both.join(first.select("sample", "read"), "read").select("sample", "read", "seq", F.lit("").alias("qual"))
    return second_reads(members, found, both).select("catalog", "sample", "read", F.md5("seq").alias("seq"))


_STARTS = "CASE WHEN (flag & 16) > 0 THEN pos + CASE line % 7 WHEN 0 THEN 26 WHEN 1 THEN 33 WHEN 2 THEN 25 WHEN 3 THEN 23 ELSE 31 END ELSE pos END"
_CHECK = {
    "pruned_haplotypes": """WITH o_f AS (SELECT locus, sample, h1, h2 FROM @haps WHERE NOT contains(h1 || h2, 'N')), o_r AS (SELECT locus, sample, h1 AS h, 6 + (locus + sample) % 5 AS d FROM o_f UNION ALL SELECT locus, sample, h2, 3 + (locus * 3 + sample) % 4 FROM o_f
        UNION ALL SELECT locus, sample, translate(h1[1], 'ACGT', 'GTAC') || substr(h1, 2), 1 + (locus + 2 * sample) % 3 FROM o_f UNION ALL SELECT a.locus, a.sample, b.h1, 1 + (a.locus * 5 + a.sample) % 3 FROM o_f a JOIN o_f b ON a.locus = b.locus AND b.sample = a.sample - 1),
      o_o AS MATERIALIZED (SELECT locus, sample, h, CAST(sum(d) AS BIGINT) AS d FROM o_r GROUP BY ALL), o_m AS (SELECT locus, sample, count(*) AS m FROM o_o GROUP BY ALL), o_n AS (SELECT locus, h, sum(if(m = 1, 2, 1)) AS c FROM o_o JOIN o_m USING (locus, sample) GROUP BY ALL),
      o_k AS MATERIALIZED (SELECT o.*, c, m, row_number() OVER (PARTITION BY o.locus, o.sample ORDER BY d DESC, o.h) AS k FROM o_o o JOIN o_n n ON n.locus = o.locus AND n.h = o.h JOIN o_m x ON x.locus = o.locus AND x.sample = o.sample),
      o_e AS (SELECT x.locus, x.sample, x.h, y.h AS t, round(y.c * ln(y.d), 9) AS w FROM o_k x JOIN o_k y ON x.locus = y.locus AND x.sample = y.sample LEFT JOIN o_k z ON z.locus = x.locus AND z.sample = x.sample AND z.k = 3 LEFT JOIN o_k q ON q.locus = x.locus AND q.sample = x.sample AND q.k = 2
        WHERE x.m > 2 AND x.k > if(q.d > z.d, 2, 1) AND (y.k = 1 OR y.k = 2 AND q.d > z.d) AND hamming(x.h, y.h) = 1 AND y.d > 1),
      o_w AS (SELECT locus, sample, h, arg_max(t, w) AS t FROM o_e GROUP BY locus, sample, h HAVING count(*) = 1 OR max(w) > min(w)), o_g AS (SELECT locus, sample, t AS h, count(*) AS more FROM o_w GROUP BY ALL),
      o_l AS MATERIALIZED (SELECT k.locus, k.sample, k.h, round(c * ln(d + coalesce(more, 0)), 9) AS w, c FROM o_k k LEFT JOIN o_g g ON g.locus = k.locus AND g.sample = k.sample AND g.h = k.h ANTI JOIN o_w x ON x.locus = k.locus AND x.sample = k.sample AND x.h = k.h),
      o_s AS (SELECT *, row_number() OVER (PARTITION BY locus, sample ORDER BY w DESC, h) AS r FROM o_l), o_2 AS (SELECT s.*, t.w AS w2, (SELECT count(*) FROM o_l a WHERE a.locus = s.locus AND a.sample = s.sample AND a.w >= t.w) AS atleast, (SELECT count(*) FROM o_l a WHERE a.locus = s.locus AND a.sample = s.sample AND a.w = t.w) AS tied FROM o_s s LEFT JOIN o_s t ON t.locus = s.locus AND t.sample = s.sample AND t.r = 2),
      o_z AS (SELECT locus, sample, h, CASE WHEN r > 2 AND w < w2 OR r > 1 AND tied > 1 AND w = w2 AND c = 1 AND atleast > 2 THEN 'rare' ELSE 'kept' END AS fate FROM o_2)
      SELECT o.locus, o.sample, o.h AS haplotype, d AS depth, coalesce(fate, 'merged') AS fate, t AS into FROM o_o o LEFT JOIN o_z z ON z.locus = o.locus AND z.sample = o.sample AND z.h = o.h LEFT JOIN o_w w ON w.locus = o.locus AND w.sample = o.sample AND w.h = o.h""",
    "genome_catalog": f"WITH c_a AS (SELECT CAST(substr(name, 2) AS BIGINT) AS catalog, chr, {_STARTS} AS bp, if((flag & 16) > 0, '-', '+') AS strand FROM @alignments WHERE (flag & 2308) = 0 AND mapq >= 10 AND line % 7 NOT IN (0, 3) AND (line % 7 <> 2 OR 3 / 32 <= 0.1)), c_1 AS (SELECT catalog, any_value(chr) AS chr, any_value(bp) AS bp, any_value(strand) AS strand FROM c_a GROUP BY catalog HAVING count(*) = 1) SELECT locus AS catalog, md5(consensus) AS consensus, chr, bp, strand FROM @loci JOIN c_1 ON catalog = locus",
    "routed_mates": """WITH c_f AS (SELECT conv_id * 1000 + turn AS read, role, left(seq, 3) AS k FROM @mates WHERE turn % 2 = 0), c_m AS (SELECT read, role, k, CASE WHEN k < 'C' THEN 1 WHEN k < 'CG' THEN ord(k[3]) ELSE ord(k[2]) * 1000 + ord(k[3]) END AS catalog FROM c_f WHERE len(k) = 3),
      c_o AS (SELECT role, catalog FROM c_m GROUP BY ALL HAVING count(DISTINCT k) = 1) SELECT CAST(m.catalog AS BIGINT) AS catalog, m.role AS sample, m.read, md5(b.seq) AS seq FROM c_m m JOIN c_o o ON o.role = m.role AND o.catalog = m.catalog JOIN @mates b ON b.conv_id * 1000 + b.turn - 1 = m.read AND b.turn % 2 = 1""",
}
OPS = {"pruned_haplotypes": Fn(("haps",), pruned_haplotypes, _CHECK["pruned_haplotypes"]), "genome_catalog": Fn(("alignments", "loci"), genome_catalog, _CHECK["genome_catalog"]), "routed_mates": Fn(("mates",), routed_mates, _CHECK["routed_mates"])}
