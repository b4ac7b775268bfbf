"""The relational surface: tables by name, catalog pages with what belongs to a locus nested, corrections and annotations overlaid.

Tables live in the session's catalog as Parquet; a change writes a new version of the small table it concerns (corrections, annotations).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Fn
from ..sources import formats

# The relational tables and their columns.
TABLES = {
    "tags": formats.TAGS, "snps": formats.SNPS, "alleles": formats.ALLELES, "matches": formats.MATCHES, "catalog_tags": formats.TAGS, "catalog_snps": formats.SNPS, "catalog_alleles": formats.ALLELES,
    "batches": "id long, date date, description string, type string", "samples": "id long, batch long, sample string, pop string, grp string", "populations": "id long, batch long, pop string", "group_populations": "grp string, pop string",
    "markers": "locus long, type string, progeny int, max_share double, ratio string, f double", "genotypes": "locus long, sample long, genotype string", "genotype_corrections": "locus long, sample long, genotype string",
    "annotations": "locus long, note string", "sumstats": "locus long, chr string, bp long, col int, pop string, p_nuc string, q_nuc string, n int, p double, obs_het double, exp_het double, pi double, fis double",
    "fst": "locus long, col int, pop1 string, pop2 string, pi double, fst double, amova_fst double", "hapstats": "locus long, pop string, n int, haplotypes int, gene_diversity double, hapl_diversity double", "phist": "locus long, pop1 string, pop2 string, phi_st double, fst_prime double, d_est double",
    "pileup": "sample long, locus long, col int, nuc string", "sequence": "locus long, type string, name string, seq string", "sequence_blast": "locus long, name string, hit string, evalue double, identity double", "ref_radome": "locus long, chr string, bp long, strand string, type string",
    "catalog_index": "locus long, chr string, bp long, n_snps int, n_alleles int, parents int, progeny int, valid int, marker string, max_share double, ratio string, note string", "tag_index": "sample long, locus long, depth int, n_snps int, catalog long", "chr_index": "chr string, loci long",
}


def create(spark: SparkSession, database: str = "default") -> None:
    """Makes every table that is not there."""
    for name, schema in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")


def where(**rules) -> Column:
    """Predicates of the catalog views: <column>_from and _to, <column>_in, <column>_like, <column>_positive, and <column> for equality."""
    out = F.lit(True)
    for name, value in rules.items():
        for ending, test in (("_from", lambda c: c >= value), ("_to", lambda c: c <= value), ("_in", lambda c: c.isin(*value)), ("_like", lambda c: c.like(value)), ("_positive", lambda c: c > 0)):
            if name.endswith(ending):
                out = out & test(F.col(name[: -len(ending)]))
                break
        else:
            out = out & (F.col(name) == value)
    return out


def page(df: DataFrame, order: list[str], size: int, number: int = 1) -> DataFrame:
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def index(calls: DataFrame, haps: DataFrame, positions: DataFrame, annotations: DataFrame, parents: tuple = (0, 1)) -> DataFrame:
    """The catalog index: a row a locus, with counts and notes, 0 or empty where there are none."""
    s = calls.where("a1 is not null and a2 is not null").groupBy("locus", "col").agg(F.least(F.min("a1"), F.min("a2")).alias("x"), F.greatest(F.max("a1"), F.max("a2")).alias("y")).groupBy("locus").agg(F.sum((F.col("x") != F.col("y")).cast("int")).alias("n_snps"))
    a = haps.select("locus", F.explode(F.array("h1", "h2")).alias("h")).where("instr(h, 'N') = 0").groupBy("locus").agg(F.countDistinct("h").alias("n_alleles"))
    p = F.col("sample").isin(*parents)
    m = calls.groupBy("locus").agg(F.countDistinct(F.when(p, F.col("sample"))).alias("parents"), F.countDistinct(F.when(~p, F.col("sample"))).alias("progeny"))
    valid = haps.where("instr(h1, 'N') = 0 and instr(h2, 'N') = 0").groupBy("locus").agg(F.count("*").alias("valid"))
    t = positions.join(s, "locus", "left").join(a, "locus", "left").join(m, "locus", "left").join(valid, "locus", "left").join(annotations.groupBy("locus").agg(F.min("note").alias("note")), "locus", "left")
    return t.select("locus", "chr", "bp", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_snps", "n_alleles", "parents", "progeny", "valid")], F.coalesce("note", F.lit("")).alias("note"))


def nested(loci: DataFrame, calls: DataFrame, haps: DataFrame) -> DataFrame:
    """loci (locus, ...) with their SNPs, alleles and genotypes as arrays."""
    s = calls.where("a1 is not null and a2 is not null").select("locus", "col", F.explode(F.array("a1", "a2")).alias("a")).groupBy("locus", "col").agg(F.array_join(F.array_sort(F.collect_set("a")), "/").alias("bases")).where("length(bases) > 1")
    s = s.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("col", "bases"))).alias("snps"))
    h = haps.select("locus", F.explode(F.array("h1", "h2")).alias("h")).where("instr(h, 'N') = 0").groupBy("locus", "h").count().groupBy("locus").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "h"))).alias("alleles"))
    g = haps.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("sample", F.concat_ws("/", F.least("h1", "h2"), F.greatest("h1", "h2")).alias("genotype")))).alias("genotypes"))
    return loci.join(s, "locus", "left").join(h, "locus", "left").join(g, "locus", "left")


def corrected(genotypes: DataFrame, corrections: DataFrame) -> DataFrame:
    """genotypes (locus, sample, genotype) with those set by hand in their place, and a mark where they differ. A corrected genotype that was not called is added."""
    c = corrections.select("locus", "sample", F.col("genotype").alias("by_hand"))
    j = genotypes.join(c, ["locus", "sample"], "full")
    return j.select("locus", "sample", F.coalesce("by_hand", "genotype").alias("genotype"), F.coalesce(F.col("by_hand") != F.col("genotype"), F.col("by_hand").isNotNull()).alias("corrected"))


def correct(corrections: DataFrame, locus: int, sample: int, genotype: str | None) -> DataFrame:
    """The corrections with one set anew, or taken away where genotype is None."""
    kept = corrections.where(~((F.col("locus") == locus) & (F.col("sample") == sample)))
    if genotype is None:
        return kept
    return kept.unionByName(corrections.sparkSession.createDataFrame([(locus, sample, genotype)], "locus long, sample long, genotype string").select(*[F.col(f.name).cast(f.dataType) for f in corrections.schema]))


def annotate(annotations: DataFrame, locus: int, note: str | None) -> DataFrame:
    kept = annotations.where(F.col("locus") != locus)
    if note is None:
        return kept
    return kept.unionByName(annotations.sparkSession.createDataFrame([(locus, note)], "locus long, note string"))


# ---------------------------------------------------------------- queries

POSITIONS = ("calls", "haps", "positions", "annotations")


def _genotypes(haps: DataFrame) -> DataFrame:
    return haps.select("locus", "sample", F.concat_ws("/", F.least("h1", "h2"), F.greatest("h1", "h2")).alias("genotype"))


def genotype_corrections(spark, haps):
    """Every 7th genotype set by hand to the sample's first haplotype twice."""
    g = _genotypes(haps)
    c = haps.where("(locus + sample) % 7 = 0").select("locus", "sample", F.concat_ws("/", "h1", "h1").alias("genotype"))
    return corrected(g, c)


def nested_page(spark, calls, haps, positions, annotations):
    loci = page(index(calls, haps, positions, annotations).where(where(n_snps_from=2, chr_in=(1, 2, 3))), ["chr", "bp", "locus"], 20, 2).select("locus", "chr", "bp")
    n = nested(loci, calls, haps)
    return n.select("locus", "chr", "bp", F.array_join(F.transform("snps", lambda x: F.concat_ws(":", x["col"].cast("string"), x["bases"])), ",").alias("snps"), F.array_join("alleles.h", ",").alias("alleles"), F.array_join("genotypes.genotype", ",").alias("genotypes"))


def chromosome_index(spark, positions):
    return positions.groupBy("chr").agg(F.count("*").alias("loci"), F.min("bp").alias("first"), F.max("bp").alias("last"))


def tag_index(spark, piles):
    """A sample's loci with depth and catalog locus."""
    s = piles.groupBy(F.col("v").alias("sample"), F.col("stack").alias("locus")).agg(F.sum("depth").alias("depth"), F.min("seq").alias("seq"))
    catalog = piles.groupBy("seq").agg(F.min("stack").alias("catalog"))
    return s.join(catalog, "seq", "left").select("sample", "locus", "depth", "catalog")


def fst_matrix(spark, calls):
    """Mean Fst of each two populations, a column for each population there is."""
    from . import popgen

    t = popgen.OPS["fst_summary"](spark, calls=calls)
    both = t.select("pop1", "pop2", "mean_fst").union(t.select("pop2", "pop1", "mean_fst"))
    pops = sorted(r[0] for r in calls.select("pop").where("pop is not null").distinct().collect())  # a row a population
    means = [F.max(F.when(F.col("pop2") == p, F.col("mean_fst"))).alias(f"pop_{p}") for p in pops]
    return both.groupBy(F.col("pop1").alias("pop")).agg(*means) if means else both.select(F.col("pop1").alias("pop"))


def locus_view(spark, calls, haps):
    """Statistics of a locus and population: mean pi, mean Fis where there is one, gene diversity."""
    from . import popgen

    s = popgen.OPS["site_pop_stats"](spark, calls=calls).groupBy("locus", "pop").agg(F.avg("pi").alias("pi"), F.avg(F.when(F.col("fis") > -7, F.col("fis"))).alias("fis"))
    r = lambda c: F.floor(F.col(c) * 1e7 + 0.5) / 1e7
    return s.join(popgen.OPS["gene_diversity"](spark, haps=haps), ["locus", "pop"]).select("locus", "pop", r("pi").alias("pi"), r("fis").alias("fis"), "haplotypes", "gene_diversity")


def _checks() -> dict[str, str]:
    from . import popgen

    ix = """c_al AS (SELECT locus, col, unnest([a1, a2]) AS a FROM @calls WHERE a1 IS NOT NULL), c_sn AS (SELECT locus, col, string_agg(DISTINCT a, '/' ORDER BY a) AS bases FROM c_al GROUP BY ALL HAVING count(DISTINCT a) > 1),
      c_hp AS (SELECT locus, h, count(*) AS n FROM (SELECT locus, unnest([h1, h2]) AS h FROM @haps) z WHERE NOT contains(h, 'N') GROUP BY ALL),
      c_ix AS (SELECT p.locus, chr, bp, (SELECT count(*) FROM c_sn s WHERE s.locus = p.locus) AS n_snps, (SELECT count(*) FROM c_hp h WHERE h.locus = p.locus) AS n_alleles, (SELECT count(DISTINCT sample) FROM @calls c WHERE c.locus = p.locus AND sample < 2) AS parents,
        (SELECT count(DISTINCT sample) FROM @calls c WHERE c.locus = p.locus AND sample >= 2) AS progeny, (SELECT count(*) FROM @haps h WHERE h.locus = p.locus AND NOT contains(h1 || h2, 'N')) AS valid, coalesce((SELECT min(note) FROM @annotations a WHERE a.locus = p.locus), '') AS note FROM @positions p)"""
    return {
        "catalog_locus_index": f"WITH {ix} SELECT * FROM c_ix",
        "catalog_nested_page": f"""WITH {ix}, c_pg AS (SELECT locus, chr, bp FROM c_ix WHERE n_snps >= 2 AND chr IN (1, 2, 3) ORDER BY chr, bp, locus LIMIT 20 OFFSET 20)
          SELECT locus, chr, bp, (SELECT string_agg(col || ':' || bases, ',' ORDER BY col) FROM c_sn s WHERE s.locus = g.locus) AS snps, (SELECT string_agg(h, ',' ORDER BY n DESC, h) FROM c_hp h WHERE h.locus = g.locus) AS alleles,
          (SELECT string_agg(least(h1, h2) || '/' || greatest(h1, h2), ',' ORDER BY sample) FROM @haps h WHERE h.locus = g.locus) AS genotypes FROM c_pg g""",
        "genotype_corrections": "SELECT locus, sample, CASE WHEN (locus + sample) % 7 = 0 THEN h1 || '/' || h1 ELSE least(h1, h2) || '/' || greatest(h1, h2) END AS genotype, (locus + sample) % 7 = 0 AND h1 <> h2 AS corrected FROM @haps",
        "chromosome_index": "SELECT DISTINCT chr, count(*) OVER w AS loci, min(bp) OVER w AS first, max(bp) OVER w AS last FROM @positions WINDOW w AS (PARTITION BY chr)",
        "tag_index": "SELECT v AS sample, stack AS locus, depth, min(stack) OVER (PARTITION BY seq) AS catalog FROM @piles",
        "fst_matrix": popgen._CHECK_PAIRS + f", c_mm AS (SELECT pop1, pop2, {popgen._r('avg(amova_fst)')} AS m FROM c_value GROUP BY ALL), c_bb AS (SELECT pop1 AS pop, pop2 AS o, m FROM c_mm UNION ALL SELECT pop2, pop1, m FROM c_mm) SELECT pop, max(m) FILTER (o = 0) AS pop_0, max(m) FILTER (o = 1) AS pop_1, max(m) FILTER (o = 2) AS pop_2 FROM c_bb GROUP BY pop",
        "locus_view": popgen._CHECK_SITE + f""", c_lv AS (SELECT locus, pop, avg(pi) AS pi, avg(1 - obs_het / pi) FILTER (pi > 0) AS fis FROM c_site GROUP BY ALL), c_hh AS (SELECT locus, pop, h, count(*) AS k FROM (SELECT locus, pop, unnest([h1, h2]) AS h FROM @haps) z WHERE NOT contains(h, 'N') GROUP BY ALL),
          c_gd AS (SELECT locus, pop, count(*) AS haplotypes, {popgen._r('1 - sum(k * (k - 1)) / (sum(k) * (sum(k) - 1))')} AS gene_diversity FROM c_hh GROUP BY ALL HAVING sum(k) > 1) SELECT locus, pop, {popgen._r('pi', 7)} AS pi, {popgen._r('fis', 7)} AS fis, haplotypes, gene_diversity FROM c_lv JOIN c_gd USING (locus, pop)""",
    }


_CHECK = _checks()
OPS = {
    "catalog_locus_index": Fn(POSITIONS, lambda spark, calls, haps, positions, annotations: index(calls, haps, positions, annotations), _CHECK["catalog_locus_index"]), "catalog_nested_page": Fn(POSITIONS, nested_page, _CHECK["catalog_nested_page"]),
    "genotype_corrections": Fn(("haps",), genotype_corrections, _CHECK["genotype_corrections"]), "chromosome_index": Fn(("positions",), chromosome_index, _CHECK["chromosome_index"]), "tag_index": Fn(("piles",), tag_index, _CHECK["tag_index"]),
    "fst_matrix": Fn(("calls",), fst_matrix, _CHECK["fst_matrix"]), "locus_view": Fn(("calls", "haps"), locus_view, _CHECK["locus_view"]),
}
