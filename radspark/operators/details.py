"""Smaller operators: allele counts, markers, likelihoods of loci, positional joins, fixed differences, cross genotypes, mergeable moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cross
from ..plans.dialect import Fn, Op
from ..sources import formats
from . import assembly, crosses, kmers, popgen

CALLS, HAPS, DEPTHS = ("calls",), ("haps",), ("depths",)
CALLED = "a1 is not null and a2 is not null"


def _r(x, digits: int = 9):
    return F.floor(x * 10**digits + 0.5) / 10**digits


def allele_counts(spark, calls: DataFrame) -> DataFrame:
    """(locus, col, pop, allele, n, freq): copies of each allele, two of a homozygote."""
    n = calls.where(CALLED).select("locus", "col", "pop", F.explode(F.array("a1", "a2")).alias("allele")).groupBy("locus", "col", "pop", "allele").agg(F.count("*").alias("n"))
    return n.withColumn("freq", _r(F.col("n") / F.sum("n").over(Window.partitionBy("locus", "col", "pop"))))


def markers(spark, haps: DataFrame) -> DataFrame:
    """(locus, total, max_share, ratio): complete genotypes of a locus, as haplotype letters by falling count, how many, and the share of the commonest."""
    full = haps.where("instr(h1, 'N') = 0 and instr(h2, 'N') = 0")
    letters = popgen.OPS["genotype_letters"](spark, haps=haps).select("locus", F.col("haplotype").alias("h"), "letter").where("letter is not null")
    one = full.join(letters.withColumnsRenamed({"h": "h1", "letter": "x"}), ["locus", "h1"]).join(letters.withColumnsRenamed({"h": "h2", "letter": "y"}), ["locus", "h2"])
    g = one.groupBy("locus", F.concat(F.least("x", "y"), F.greatest("x", "y")).alias("g")).agg(F.count("*").alias("n"))
    return g.groupBy("locus").agg(F.sum("n").alias("total"), _r(F.max("n") / F.sum("n"), 6).alias("max_share"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "g", F.col("n").cast("string")))), ";").alias("ratio"))


def _lnl(d):
    hom = f"{popgen._xlnx('c1', 'c1 / (1E0 * n)')} + {popgen._xlnx('n - c1', '(n - c1) / (3E0 * n)')}"
    het = f"{popgen._xlnx('c1 + c2', '(c1 + c2) / (2E0 * n)')} + {popgen._xlnx('n - c1 - c2', '(n - c1 - c2) / (2E0 * n)')}"
    return popgen._ranked(d) | {"l": f"SELECT locus, col, sample, n, greatest({hom}, {het}) AS lnl FROM s", "t": "SELECT locus, sample, sum(lnl) AS lnl, sum(n) AS depth FROM l GROUP BY locus, sample"}


def locus_likelihoods(d):
    """The sum of each column's better model, of a sample's locus."""
    return _lnl(d), f"SELECT locus, sample, depth, {d.r('lnl', 6)} AS lnl FROM t"


def likelihood_filter(d, least_lnl=-10.0, least_depth=8):
    """Loci of samples deep and likely enough, and the mean and median likelihood of a locus over samples."""
    return _lnl(d), f"SELECT locus, count(*) AS samples, sum(CASE WHEN lnl >= {least_lnl} AND depth >= {least_depth} THEN 1 ELSE 0 END) AS kept, {d.r('avg(lnl)', 6)} AS mean_lnl, {d.r('median(lnl)', 6)} AS median_lnl FROM t GROUP BY locus"


def position_join(spark, alignments: DataFrame) -> DataFrame:
    """Loci of second reads matched with the catalog of first reads by chromosome, place and strand."""
    t = formats.aligned(alignments.where("flag & 2304 = 0"))
    a = formats.loci_by_start(t.where("flag & 64 <> 0")).select("chr", "pos5", "strand", F.col("reads").alias("catalog_reads"))
    return formats.loci_by_start(t.where("flag & 128 <> 0")).join(a, ["chr", "pos5", "strand"]).select("chr", "pos5", "strand", "reads", "catalog_reads")


def known_columns(spark, calls: DataFrame) -> DataFrame:
    """(sample, locus) of samples from 6 on whose heterozygous columns are all SNPs of the catalog, made of the samples before."""
    catalog = calls.where("sample < 6").where(CALLED).groupBy("locus", "col").agg(F.least(F.min("a1"), F.min("a2")).alias("x"), F.greatest(F.max("a1"), F.max("a2")).alias("y")).where("x <> y").select("locus", "col")
    het = calls.where("sample >= 6 and a1 <> a2").select("sample", "locus", "col")
    bad = het.join(catalog, ["locus", "col"], "left_anti").select("sample", "locus").distinct()
    return calls.where("sample >= 6").select("sample", "locus").distinct().join(bad, ["sample", "locus"], "left_anti")


def fixed_differences(spark, calls: DataFrame) -> DataFrame:
    """(pop1, pop2, sites, fixed): sites that both populations have, and those fixed in each for different alleles."""
    s = popgen.OPS["site_pop_stats"](spark, calls=calls).select("locus", "col", "pop", "p_nuc", (F.col("q_nuc").isNull()).alias("one"))
    b = s.select("locus", "col", F.col("pop").alias("pop2"), F.col("p_nuc").alias("other"), F.col("one").alias("one2"))
    j = s.withColumnRenamed("pop", "pop1").join(b, ["locus", "col"]).where("pop1 < pop2")
    return j.groupBy("pop1", "pop2").agg(F.count("*").alias("sites"), F.sum((F.col("one") & F.col("one2") & (F.col("p_nuc") != F.col("other"))).cast("int")).alias("fixed"))


def ordered_loci(d):
    """One locus a base pair of a chromosome: the last by id."""
    return {}, "SELECT chr, bp, max(locus) AS locus FROM @positions GROUP BY chr, bp"


def mapped_samples(d):
    """Samples of the genotypes that the population map knows, with their population there."""
    return {}, "SELECT p.sample, p.pop, count(*) AS calls FROM @calls c JOIN @popmap p ON c.sample = p.sample GROUP BY p.sample, p.pop"


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, m2) of a column: what merges with others of its kind by merged_moments."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merged_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial moments put together: (keys, n, mean, variance, stderr) of all values they stand for."""
    g = parts.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("raw"))
    var = (F.col("raw") - F.col("n") * F.col("mean") * F.col("mean")) / F.nullif(F.col("n") - 1, F.lit(0))
    return g.select(*keys, "n", "mean", var.alias("variance"), (F.sqrt(F.greatest(var, F.lit(0.0))) / F.sqrt("n")).alias("stderr"))


def mergeable_depths(spark, calls: DataFrame) -> DataFrame:
    m = merged_moments(moments(calls, ["pop", "sample"], "dp"), ["pop"])
    return m.select("pop", "n", _r(F.col("mean"), 7).alias("mean"), _r(F.col("variance"), 7).alias("variance"), _r(F.col("stderr"), 7).alias("stderr"))


def kmer_pairs(spark, mates: DataFrame) -> DataFrame:
    """Pairs by what a filter of abundant k-mers leaves of them: both mates, one, or none."""
    r = mates.select((F.col("conv_id") * 1000 + F.col("turn")).alias("read_id"), F.col("role").alias("sample"), "seq")
    kept = kmers.abundant_filter(r, max_k_freq=4, max_k_pct=0.3).select("read_id", F.lit(True).alias("ok"))
    v = r.join(kept, "read_id", "left").select("read_id", F.coalesce("ok", F.lit(False)).alias("ok"))
    p = v.where("read_id % 2 = 0").join(v.select((F.col("read_id") - 1).alias("read_id"), F.col("ok").alias("ok2")), "read_id")
    return p.groupBy(F.when(F.expr("ok and ok2"), "paired").when(F.expr("ok or ok2"), "remainder").otherwise("discards").alias("route")).agg(F.count("*").alias("n"))


def snp_union(spark, calls: DataFrame) -> DataFrame:
    """Bases of a site over two halves of the samples, as merging two loci joins their SNPs: those of the first half first, then what the second adds."""
    c = calls.where(CALLED).select("locus", "col", (F.col("sample") >= 6).cast("int").alias("half"), F.explode(F.array("a1", "a2")).alias("a"))
    first = c.groupBy("locus", "col", "a").agg(F.min("half").alias("half"))
    return first.groupBy("locus", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("half", "a"))), lambda x: x["a"]), "").alias("bases"))


def cross_genotypes(spark, haps: DataFrame) -> DataFrame:
    """(locus, marker, sample, genotype): progeny genotypes of a cross of samples 0 and 1, by letters."""
    return crosses.progeny_genotypes(haps)


def cross_lines(genotypes: DataFrame, map_type: str = "joinmap_cp") -> DataFrame:
    """A line a locus: name, the format's marker type, and a genotype for each progeny that has one, in order of the samples; loci of types the format has not are left out."""
    kinds = cross.MAP_TYPES[map_type]
    kind = F.when(F.lit(False), "")
    for own, name in kinds.items():
        kind = kind.when(F.col("marker") == own, name)
    g = genotypes.groupBy("locus", "marker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", "genotype"))), lambda x: x["genotype"]), " ").alias("calls"))
    return g.withColumn("kind", kind).where("kind is not null").select("locus", F.concat_ws("\t", F.col("locus").cast("string"), F.concat(F.lit("<"), F.col("kind"), F.lit(">")), "calls").alias("value"))


def export_cross(spark, haps: DataFrame) -> DataFrame:
    return cross_lines(crosses.progeny_genotypes(haps))


def export_rqtl(spark, haps: DataFrame) -> DataFrame:
    """(sample, block, piece): a sample's genotypes by comma, - where it has none, in blocks of loci."""
    from . import sinks

    g = crosses.progeny_genotypes(haps)
    return sinks._by_sample(g.withColumn("col", F.lit(0)).withColumn("block", F.expr(f"locus div {sinks.BLOCK}")), ["sample"], F.when(F.col("genotype") == "--", "-").otherwise(F.col("genotype")), ",")


def gapped_secondary(spark, piles: DataFrame) -> DataFrame:
    """Shallow piles, less a base, merged into the locus of their only best gapped alignment."""
    whole = piles.where("v = 0").select(F.col("stack").alias("other"), "seq")
    cut = piles.where("v > 0 and depth < 4").select(F.col("stack").alias("id"), F.concat(F.substring("seq", 1, 30), F.substring("seq", 32, 64)).alias("seq"))
    c = assembly.gapped_candidates(cut, whole, 11)
    pairs = assembly.with_sequences(c, cut, whole)
    return assembly.best_alignments(assembly.aligned_pairs(pairs)).select(F.col("id").alias("read"), F.col("other").alias("locus"), "gaps")


_R = popgen._r
_CROSS = crosses._MARKERS + f", x_g AS (SELECT locus, marker, sample, CASE WHEN list_contains({crosses._ALLOWED}[marker], least(l1, l2) || greatest(l1, l2)) AND l1 IS NOT NULL AND l2 IS NOT NULL THEN least(l1, l2) || greatest(l1, l2) ELSE '--' END AS genotype FROM m_g)"
_KINDS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in cross.MAP_TYPES["joinmap_cp"].items()) + "}"
_LN = popgen._CHECK_RANK + " c_m AS (SELECT locus, col, sample, n, greatest(c1 * ln(c1 / n) + coalesce((n - c1) * ln(nullif(n - c1, 0) / (3 * n)), 0), (c1 + c2) * ln((c1 + c2) / (2 * n)) + coalesce(c34 * ln(nullif(c34, 0) / (2 * n)), 0)) AS l FROM c_s), c_t AS (SELECT locus, sample, sum(l) AS lnl, CAST(sum(n) AS BIGINT) AS depth FROM c_m GROUP BY ALL)"
_STARTS = "CASE WHEN (flag & 16) > 0 THEN pos + CASE line % 7 WHEN 0 THEN 26 WHEN 1 THEN 33 WHEN 2 THEN 25 WHEN 3 THEN 23 ELSE 31 END ELSE pos END"
OPS = {
    "allele_counts": Fn(CALLS, allele_counts, f"SELECT locus, col, pop, allele, count(*) AS n, {_R('count(*) / any_value(m)')} AS freq FROM (SELECT locus, col, pop, unnest([a1, a2]) AS allele, 2 * count(*) OVER (PARTITION BY locus, col, pop) AS m FROM @calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL) z GROUP BY locus, col, pop, allele"),
    "locus_markers": Fn(HAPS, markers, """WITH c_h AS (SELECT locus, h, row_number() OVER (PARTITION BY locus ORDER BY count(*) DESC, h) AS k, count(*) OVER (PARTITION BY locus) AS m FROM (SELECT locus, unnest([h1, h2]) AS h FROM @haps) z WHERE NOT contains(h, 'N') GROUP BY locus, h),
      c_g AS (SELECT g.locus, chr(CAST(96 + least(x.k, y.k) AS INT)) || chr(CAST(96 + greatest(x.k, y.k) AS INT)) AS g, count(*) AS n FROM @haps g JOIN c_h x ON g.locus = x.locus AND g.h1 = x.h JOIN c_h y ON g.locus = y.locus AND g.h2 = y.h WHERE x.m <= 26 GROUP BY ALL)
      SELECT locus, CAST(sum(n) AS BIGINT) AS total, floor(max(n) / sum(n) * 1e6 + 0.5) / 1e6 AS max_share, string_agg(g || ':' || n, ';' ORDER BY g || ':' || n) AS ratio FROM c_g GROUP BY locus"""),
    "locus_likelihoods": Op(DEPTHS, locus_likelihoods, _LN + f" SELECT locus, sample, depth, {_R('lnl', 6)} AS lnl FROM c_t"),
    "likelihood_filter": Op(DEPTHS, likelihood_filter, _LN + f" SELECT locus, count(*) AS samples, count(*) FILTER (lnl >= -10 AND depth >= 8) AS kept, {_R('avg(lnl)', 6)} AS mean_lnl, {_R('quantile_cont(lnl, 0.5)', 6)} AS median_lnl FROM c_t GROUP BY locus"),
    "position_join": Fn(("alignments",), position_join, f"WITH c_a AS (SELECT chr, {_STARTS} AS pos5, if((flag & 16) > 0, '-', '+') AS strand, (flag & 64) > 0 AS one FROM @alignments WHERE (flag & 2308) = 0) SELECT chr, pos5, strand, count(*) FILTER (NOT one) AS reads, count(*) FILTER (one) AS catalog_reads FROM c_a GROUP BY ALL HAVING count(DISTINCT one) = 2"),
    "known_columns": Fn(CALLS, known_columns, "WITH c_k AS (SELECT locus, col FROM (SELECT locus, col, unnest([a1, a2]) AS a FROM @calls WHERE sample < 6) z GROUP BY ALL HAVING count(DISTINCT a) > 1) SELECT sample, locus FROM @calls c LEFT JOIN c_k USING (locus, col) WHERE sample >= 6 GROUP BY sample, locus HAVING count(*) FILTER (a1 <> a2 AND c_k.locus IS NULL) = 0"),
    "fixed_differences": Fn(CALLS, fixed_differences, popgen._CHECK_SITE + " SELECT x.pop AS pop1, y.pop AS pop2, count(*) AS sites, count(*) FILTER (x.nq = 0 AND y.nq = 0 AND x.p_nuc <> y.p_nuc) AS fixed FROM c_site x JOIN c_site y USING (locus, col) WHERE x.pop < y.pop GROUP BY ALL"),
    "ordered_loci": Op(("positions",), ordered_loci, "SELECT DISTINCT ON (chr, bp) chr, bp, locus FROM @positions ORDER BY chr, bp, locus DESC"),
    "mapped_samples": Op(("calls", "popmap"), mapped_samples),
    "mergeable_depths": Fn(CALLS, mergeable_depths, f"SELECT pop, count(dp) AS n, {_R('avg(dp)', 7)} AS mean, {_R('var_samp(dp)', 7)} AS variance, {_R('stddev_samp(dp) / sqrt(count(dp))', 7)} AS stderr FROM @calls GROUP BY pop"),
    "kmer_pairs": Fn(("mates",), kmer_pairs, """WITH c_k AS (SELECT conv_id * 1000 + turn AS id, substr(seq, i, 15) AS k FROM (SELECT *, unnest(range(1, len(seq) - 13)) AS i FROM @mates WHERE len(seq) >= 15) z), c_f AS (SELECT id, count(*) OVER (PARTITION BY k) AS n FROM c_k), c_v AS (SELECT id, count(*) FILTER (n >= 4) <= floor(count(*) * 0.3 + 0.5) AS ok FROM c_f GROUP BY id),
      c_w AS (SELECT conv_id * 1000 + turn AS id, coalesce(ok, true) AS ok FROM @mates LEFT JOIN c_v ON id = conv_id * 1000 + turn) SELECT CASE WHEN a.ok AND b.ok THEN 'paired' WHEN a.ok OR b.ok THEN 'remainder' ELSE 'discards' END AS route, count(*) AS n FROM c_w a JOIN c_w b ON b.id = a.id + 1 WHERE a.id % 2 = 0 GROUP BY ALL"""),
    "snp_union": Fn(CALLS, snp_union, "WITH c_a AS (SELECT locus, col, unnest([a1, a2]) AS a, sample FROM @calls), c_b AS (SELECT locus, col, a, min(sample) >= 6 AS late FROM c_a GROUP BY ALL) SELECT locus, col, string_agg(a, '' ORDER BY late, a) AS bases FROM c_b GROUP BY ALL"),
    "cross_genotypes": Fn(HAPS, cross_genotypes, _CROSS + " SELECT * FROM x_g"),
    "export_joinmap": Fn(HAPS, export_cross, _CROSS + f" SELECT locus, concat(locus, chr(9), '<', {_KINDS}[marker], '>', chr(9), string_agg(genotype, ' ' ORDER BY sample)) AS value FROM x_g WHERE {_KINDS}[marker] IS NOT NULL GROUP BY locus, marker"),
    "export_rqtl": Fn(HAPS, export_rqtl, _CROSS + " SELECT sample, locus // 1000 AS block, string_agg(if(genotype = '--', '-', genotype), ',' ORDER BY locus) AS piece FROM x_g GROUP BY ALL"),
    "gapped_secondary": Fn(("piles",), gapped_secondary, "SELECT x.stack AS read, y.stack AS locus, CAST(1 AS INT) AS gaps FROM @piles x JOIN @piles y ON x.g = y.g AND y.v = 0 WHERE x.v > 0 AND x.depth < 4"),
}
