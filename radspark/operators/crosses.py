"""Genotypes of a cross set right: re-called from reads, and markers whose parent lacks an allele.

markers are (locus, marker, letters): the marker type of two parents and a map from their haplotypes to letters; genotypes (locus, sample, genotype) in those letters, -- where
there is none; observed (locus, sample, haplotype, count) the reads' bases at the locus' SNPs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cross
from ..plans.dialect import Fn
from . import graphs

LEAST_READS, LOW, HIGH = 5, 0.05, 0.1


def markers(haps: DataFrame, mother: int = 0, father: int = 1) -> DataFrame:
    """haps (locus, sample, h1, h2) -> markers of loci at which one or both parents are complete."""
    ok = haps.where("instr(h1, 'N') = 0 and instr(h2, 'N') = 0")
    parent = lambda s, name: ok.where(F.col("sample") == s).select("locus", F.array_sort(F.array_distinct(F.array("h1", "h2"))).alias(name))
    both = parent(mother, "mother").join(parent(father, "father"), "locus", "full")
    kind = F.udf(lambda m, f: cross.marker_type(frozenset(m or ()) or None, frozenset(f or ()) or None), "string", useArrow=True)
    letters = F.udf(lambda m, f: cross.letters(frozenset(m), frozenset(f)) if m and f else {}, "map<string,string>", useArrow=True)
    return both.select("locus", kind("mother", "father").alias("marker"), letters("mother", "father").alias("letters")).where("marker is not null")


def _kinds() -> list[tuple]:
    """By 9 * haplotypes of the mother + 3 * of the father + shared ones: the marker type, and the letters of shared haplotypes, of the mother's others and the father's, each in order."""
    out = []
    for x, y, s in ((x, y, s) for x in range(3) for y in range(3) for s in range(3)):
        mother, father = ({f"s{i}" for i in range(min(s, n))} | {f"{side}{i}" for i in range(n - s)} for side, n in (("m", x), ("f", y)))
        kind = cross.marker_type(frozenset(mother) or None, frozenset(father) or None) if s <= min(x, y) else None
        names = cross.letters(frozenset(mother), frozenset(father)) if kind and mother and father else {}
        out.append((kind, *("".join(names.get(f"{side}{i}", "") for i in range(2)) for side in "smf")))
    return out


def progeny_genotypes(haps: DataFrame, mother: int = 0, father: int = 1) -> DataFrame:
    """haps (locus, sample, h1, h2) -> (locus, marker, sample, genotype): the complete progeny of loci whose parents make a marker, as genotype letters that its cross can give (else --)."""
    full = haps.where("instr(h1, 'N') = 0 and instr(h2, 'N') = 0").select("locus", "sample", "h1", "h2")
    locus, empty = Window.partitionBy("locus"), F.array().cast("array<string>")
    parent = lambda s: F.coalesce(F.max(F.when(F.col("sample") == s, F.array_sort(F.array_distinct(F.array("h1", "h2"))))).over(locus), empty)
    t = full.select("*", parent(mother).alias("m"), parent(father).alias("f")).where(~F.col("sample").isin(mother, father)).select("*", F.array_sort(F.array_intersect("m", "f")).alias("both"))
    table = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("marker", "ls", "lm", "lf"), row, strict=True)]) for row in _kinds()])
    t = t.select("*", F.get(table, 9 * F.size("m") + 3 * F.size("f") + F.size("both")).alias("k")).select("*", F.col("k.marker").alias("marker")).where("marker is not null")
    rest = lambda side: F.array_except(side, F.col("both"))
    of = lambda letters, among, h: F.nullif(F.substr(F.col(f"k.{letters}"), F.array_position(among, F.col(h)).cast("int"), F.lit(1)), F.lit(""))
    at = lambda among, h: F.array_contains(among, F.col(h))
    letter = lambda h: F.when(at(F.col("both"), h), of("ls", F.col("both"), h)).when(at(F.col("m"), h), of("lm", rest("m"), h)).when(at(F.col("f"), h), of("lf", rest("f"), h))
    t = t.select("locus", "marker", "sample", letter("h1").alias("x"), letter("h2").alias("y"))
    g = F.concat(F.least("x", "y"), F.greatest("x", "y"))
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & F.array_contains(allowed(F.col("marker")), F.coalesce(g, F.lit("")))
    return t.select("locus", "marker", "sample", F.when(ok, g).otherwise("--").alias("genotype"))


def segregation(genotypes_: DataFrame) -> DataFrame:
    """(locus, marker, genotype) -> (locus, marker, progeny, chisq, df, level) of markers with expected shares: their genotypes' chi-square, and the least listed level it reaches."""
    shares = {kind: cross.SEGREGATION["cp"][name] for kind, name in cross.MAP_TYPES["cp"].items() if name in cross.SEGREGATION["cp"]}
    every = sorted({g for want in shares.values() for g in want})
    t = genotypes_.where(F.col("marker").isin(*shares)).groupBy("locus", "marker").agg(*[F.count(F.when(F.col("genotype") == g, 1)).alias(g) for g in every])
    n, x, df = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("int")
    for kind, want in shares.items():
        here, all_ = F.col("marker") == kind, sum((F.col(g) for g in want), F.lit(0))
        sums = sum((F.pow(F.col(g) - all_ * e, F.lit(2)) / (all_ * e) for g, e in want.items()), F.lit(0.0))
        n, x, df = F.when(here, all_).otherwise(n), F.when(here, F.when(all_ == 0, 0.0).otherwise(sums)).otherwise(x), F.when(here, len(want) - 1).otherwise(df)
    t = t.select("locus", "marker", n.cast("long").alias("progeny"), x.alias("x"), df.alias("df"))
    level = F.lit(1.0)
    for d, rows in cross.CRITICAL.items():
        for p, least in sorted(rows, reverse=True):
            level = F.when((F.col("df") == d) & (F.col("x") >= least), p).otherwise(level)
    return t.select("locus", "marker", "progeny", F.round("x", 6).alias("chisq"), "df", level.alias("level"))


def genotypes(progeny: DataFrame, markers_: DataFrame) -> DataFrame:
    """progeny (locus, sample, h1, h2) in the letters of their locus' marker, untranslated."""
    j = progeny.join(markers_, "locus").withColumn("x", F.col("letters")[F.col("h1")]).withColumn("y", F.col("letters")[F.col("h2")])
    return j.select("locus", "marker", "sample", F.when(F.col("x").isNull() | F.col("y").isNull(), "--").otherwise(F.concat(F.least("x", "y"), F.greatest("x", "y"))).alias("genotype"))


def allowed(marker: Column) -> Column:
    """The genotypes that a marker type's cross can give."""
    out = F.lit(None).cast("array<string>")
    for kind, name in cross.MAP_TYPES["cp"].items():
        if name in cross.SEGREGATION["cp"]:
            out = F.when(marker == kind, F.array(*map(F.lit, sorted(cross.SEGREGATION["cp"][name])))).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>"))


def site_states(observed: DataFrame, sites: DataFrame, least: int = LEAST_READS, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(locus, sample, i, state): whether reads show a site (sites: locus, i, bases: its two) `het`, `hom`, or leave it `unknown`.

    Unknown are sites with fewer reads than `least`, with a third base as common as the second, or with a second base in less than `high` of the reads; below `low` it is an error.
    """
    e = observed.select("locus", "sample", "count", F.posexplode(F.split("haplotype", "")).alias("i", "base")).where("base <> ''")
    n = e.groupBy("locus", "sample", "i", "base").agg(F.sum("count").alias("n")).where("n > 0")
    r = n.groupBy("locus", "sample", "i").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "base"))).alias("r"), F.sum("n").alias("height")).join(sites, ["locus", "i"])
    c = lambda k: F.coalesce(-F.get("r", F.lit(k))["n"], F.lit(0))
    own = lambda k: F.coalesce(F.instr(F.col("bases"), F.get("r", F.lit(k))["base"]) > 0, F.lit(False))
    share = c(1) / F.col("height")
    state = F.when((F.col("height") < least) | ((c(2) > 0) & (c(1) <= c(2))), "unknown").when(~(own(0) & own(1)), "hom").when(share < low, "hom").when(share < high, "unknown").otherwise("het")
    return r.select("locus", "sample", "i", state.alias("state"))


def corrected(calls: DataFrame, observed: DataFrame, sites: DataFrame, markers_: DataFrame, **limits) -> DataFrame:
    """(locus, sample, genotype, corrected): homozygotes re-called from their reads. Where any site is unknown the call goes (-); where all sites are heterozygous the haplotypes that reads
    show make the genotype, if the marker's cross can give it (else --). Heterozygotes and missing calls stay."""
    per = site_states(observed, sites, **limits).groupBy("locus", "sample").agg(F.count(F.when(F.col("state") == "unknown", 1)).alias("unknown"), F.count(F.when(F.col("state") == "het", 1)).alias("het"))
    size = sites.groupBy("locus").agg(F.count("*").alias("sites"), F.transform(F.array_sort(F.collect_list(F.struct("i", "bases"))), lambda x: x["bases"]).alias("pairs"))
    fits = F.forall(F.arrays_zip(F.split("haplotype", "").alias("b"), F.col("pairs").alias("p")), lambda z: F.instr(z["p"], z["b"]) > 0)
    seen = observed.where("count > 0").select("locus", "sample", "haplotype").distinct().join(size, "locus").where(F.length("haplotype") == F.col("sites")).where(fits).join(markers_, "locus")
    made = seen.groupBy("locus", "sample").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce(F.col("letters")[F.col("haplotype")], F.lit("-")))), "").alias("made"))
    j = calls.join(markers_.select("locus", "marker"), "locus").join(per, ["locus", "sample"], "left").join(size.select("locus", "sites"), "locus").join(made, ["locus", "sample"], "left")
    g = F.col("genotype")
    stays = g.isNull() | (g == "--") | (F.substring(g, 1, 1) != F.substring(g, 2, 1)) | F.col("unknown").isNull()
    called = F.when(F.array_contains(allowed(F.col("marker")), F.coalesce("made", F.lit(""))), F.col("made")).otherwise("--")
    new = F.when(stays, g).when(F.col("unknown") > 0, "-").when(F.col("het") < F.col("sites"), g).otherwise(called)
    return j.select("locus", "sample", new.alias("genotype"), (~new.eqNullSafe(g)).alias("corrected"))


# Shares of genotypes that a parent's lacking allele gives, the marker it makes, and what its genotypes then are.
NULLS = [
    ("ab/aa", {"aa": 0.5, "ab": 0.25, "bb": 0.25}, "ab/a-", {"bb": "ab"}),
    ("aa/ab", {"aa": 0.5, "ab": 0.25, "bb": 0.25}, "-a/ab", {"bb": "ab"}),
    ("ab/cc", {"ac": 0.25, "bc": 0.25, "aa": 0.25, "bb": 0.25}, "ab/c-", {"bb": "bd", "aa": "ad"}),
    ("cc/ab", {"ac": 0.25, "bc": 0.25, "aa": 0.25, "bb": 0.25}, "-c/ab", {"bb": "ad", "aa": "ac", "bc": "bd", "ac": "bc"}),
    ("aa/bb", {"aa": 0.5, "ab": 0.5}, "aa/b-", {"ab": "bb"}),
    ("aa/bb", {"bb": 0.5, "ab": 0.5}, "-a/bb", {"ab": "aa"}),
]


def null_alleles(calls: DataFrame, level: float = 0.05) -> DataFrame:
    """calls (locus, marker, sample, genotype) -> the same with `new_marker` and `new_genotype`: where a locus' genotypes are as common as a parent without one of its alleles would make
    them (chi-square below the level's value), the marker says so, and genotypes are named by it. Of several such rules the first holds."""
    every = sorted({g for _, want, _, _ in NULLS for g in want})
    n = F.count(F.when(~F.col("genotype").isin("--", "-"), 1))
    t = calls.groupBy("locus", "marker").agg(n.alias("n"), *[F.count(F.when(F.col("genotype") == g, 1)).alias(f"n_{g}") for g in every])
    marker, genotype = F.col("marker"), F.col("genotype")
    for kind, want, new, names in reversed(NULLS):
        x = sum((F.pow(F.col(f"n_{g}") - F.col("n") * e, 2) / (F.col("n") * e) for g, e in want.items()), F.lit(0.0))
        bound = dict(cross.CRITICAL[len(want) - 1])[level]
        rule = (F.col("marker") == kind) & (F.col("n") > 0) & F.when(F.col("n") > 0, x < bound).otherwise(False)
        named = F.col("genotype")
        for old, name in names.items():
            named = F.when(F.col("genotype") == old, name).otherwise(named)
        marker, genotype = F.when(rule, new).otherwise(marker), F.when(rule, named).otherwise(genotype)
    return calls.join(t, ["locus", "marker"]).select("locus", "marker", "sample", "genotype", marker.alias("new_marker"), genotype.alias("new_genotype"))


# ---------------------------------------------------------------- queries


def _observed(haps: DataFrame) -> DataFrame:
    """Reads of both haplotypes, the second one's in a share that differs by locus and sample."""
    w1, w2 = (1 + (F.col("locus") * 5 + F.col("sample") * 3) % 12) * 3, (F.col("locus") + F.col("sample") * 7) % 5
    read = lambda h, w: F.struct(F.col(h).alias("haplotype"), w.alias("count"))
    return haps.select("locus", "sample", F.explode(F.array(read("h1", w1), read("h2", w2))).alias("r")).select("locus", "sample", "r.haplotype", "r.count")


def _sites(haps: DataFrame) -> DataFrame:
    b = haps.select("locus", F.explode(F.array("h1", "h2")).alias("h")).select("locus", F.posexplode(F.split("h", "")).alias("i", "b")).where("b not in ('N', '')")
    return b.groupBy("locus", "i").agg(F.concat(F.min("b"), F.max("b")).alias("bases"))


def corrected_genotypes(spark, haps):
    """Progeny called from their first haplotype alone, then set right from the reads of both."""
    m, _ = graphs.written(markers(haps), "markers")
    full = haps.where("sample > 1 and instr(h1, 'N') = 0 and instr(h2, 'N') = 0")
    calls = genotypes(full.select("locus", "sample", "h1", F.col("h1").alias("h2")), m).drop("marker")
    return corrected(calls, _observed(full), _sites(haps), m)


def null_allele_markers(spark, haps):
    full = haps.where("sample > 1 and instr(h1, 'N') = 0 and instr(h2, 'N') = 0")
    return null_alleles(genotypes(full, markers(haps)))


_MARKERS = """WITH m_p AS (SELECT locus, sample, list_sort(list_distinct([h1, h2])) AS h FROM @haps WHERE sample < 2 AND NOT contains(h1 || h2, 'N')), m_t AS (SELECT locus, max(h) FILTER (sample = 0) AS m, max(h) FILTER (sample = 1) AS f FROM m_p GROUP BY locus),
  m_k AS (SELECT *, len(m) AS x, len(f) AS y, list_sort(list_intersect(m, f)) AS s FROM m_t),
  m_v AS (SELECT *, CASE WHEN x IS NULL THEN CASE WHEN y = 2 THEN '--/ab' END WHEN y IS NULL THEN CASE WHEN x = 2 THEN 'ab/--' END WHEN x + y = 2 THEN CASE WHEN len(s) = 0 THEN 'aa/bb' END
    WHEN x + y = 4 THEN ['ab/cd', 'ab/ac', 'ab/ab'][len(s) + 1] WHEN x = 2 THEN if(len(s) = 1, 'ab/aa', 'ab/cc') ELSE if(len(s) = 1, 'aa/ab', 'cc/ab') END AS marker FROM m_k),
  m_l AS (SELECT locus, marker, CASE marker WHEN 'ab/ac' THEN 'a' WHEN 'ab/ab' THEN 'ab' WHEN 'ab/aa' THEN 'a' WHEN 'aa/ab' THEN 'a' ELSE '' END AS ls, s, CASE marker WHEN 'ab/cd' THEN 'ab' WHEN 'ab/ac' THEN 'b' WHEN 'ab/aa' THEN 'b' WHEN 'ab/cc' THEN 'ab' WHEN 'cc/ab' THEN 'c' WHEN 'aa/bb' THEN 'a' ELSE '' END AS lm,
    list_sort(list_filter(m, lambda h: NOT list_contains(s, h))) AS m, CASE marker WHEN 'ab/cd' THEN 'cd' WHEN 'ab/ac' THEN 'c' WHEN 'aa/ab' THEN 'b' WHEN 'ab/cc' THEN 'c' WHEN 'cc/ab' THEN 'ab' WHEN 'aa/bb' THEN 'b' ELSE '' END AS lf, list_sort(list_filter(f, lambda h: NOT list_contains(s, h))) AS f FROM m_v WHERE marker IS NOT NULL),
  m_n AS (SELECT locus, unnest(s) AS h, unnest(string_split(ls, '')) AS l FROM m_l WHERE ls <> '' UNION ALL SELECT locus, unnest(m), unnest(string_split(lm, '')) FROM m_l WHERE lm <> '' UNION ALL SELECT locus, unnest(f), unnest(string_split(lf, '')) FROM m_l WHERE lf <> ''),
  m_g AS (SELECT p.locus, marker, p.sample, p.h1, p.h2, a.l AS l1, b.l AS l2 FROM @haps p JOIN m_l USING (locus) LEFT JOIN m_n a ON a.locus = p.locus AND a.h = p.h1 LEFT JOIN m_n b ON b.locus = p.locus AND b.h = p.h2 WHERE p.sample > 1 AND NOT contains(p.h1 || p.h2, 'N'))"""
_ALLOWED = "map {" + ", ".join(f"'{k}': {sorted(cross.SEGREGATION['cp'][v])}" for k, v in cross.MAP_TYPES["cp"].items() if v in cross.SEGREGATION["cp"]) + "}"
_RULE = lambda kind, want: f"marker = '{kind}' AND n > 0 AND " + " + ".join(f"(count(*) FILTER (g = '{g}') OVER w - n * {e}) ** 2 / (nullif(n, 0) * {e})" for g, e in want.items()) + f" < {dict(cross.CRITICAL[len(want) - 1])[0.05]}"
_CHECK = {
    "corrected_genotypes": _MARKERS + f""", c_o AS (SELECT locus, sample, h1 AS h, (1 + (locus * 5 + sample * 3) % 12) * 3 AS n FROM m_g UNION ALL SELECT locus, sample, h2, (locus + sample * 7) % 5 FROM m_g),
      c_s AS (SELECT locus, i, min(b) || max(b) AS bases FROM (SELECT locus, i, h[i] AS b FROM (SELECT locus, unnest([h1, h2]) AS h FROM @haps) z, range(1, 5) AS r(i) WHERE i <= len(h) AND h[i] <> 'N') y GROUP BY locus, i),
      c_n AS (SELECT locus, sample, i, h[i] AS b, sum(n) AS n FROM c_o, range(1, 5) AS r(i) WHERE i <= len(h) GROUP BY ALL HAVING sum(n) > 0), c_r AS (SELECT *, row_number() OVER (PARTITION BY locus, sample, i ORDER BY n DESC, b) AS k, sum(n) OVER (PARTITION BY locus, sample, i) AS t FROM c_n),
      c_h AS (SELECT r.locus, r.sample, r.i, max(t) AS t, coalesce(max(n) FILTER (k = 2), 0) AS n2, coalesce(max(n) FILTER (k = 3), 0) AS n3, bool_and(contains(bases, b)) FILTER (k < 3) AND count(*) > 1 AS own FROM c_r r JOIN c_s s ON s.locus = r.locus AND s.i = r.i GROUP BY ALL),
      c_x AS (SELECT *, CASE WHEN t < 5 OR (n3 > 0 AND n2 <= n3) THEN 'u' WHEN NOT own OR n2 / t < 0.05 THEN 'o' WHEN n2 / t < 0.1 THEN 'u' ELSE 'e' END AS state FROM c_h),
      c_p AS (SELECT locus, sample, count(*) FILTER (state = 'u') AS unknown, count(*) FILTER (state = 'e') AS het, count(*) AS sites FROM c_x GROUP BY ALL),
      c_m AS (SELECT o.locus, o.sample, string_agg(coalesce(l, '-'), '' ORDER BY coalesce(l, '-')) AS made FROM (SELECT DISTINCT locus, sample, h FROM c_o WHERE n > 0) o LEFT JOIN m_n USING (locus, h) WHERE NOT EXISTS (SELECT 1 FROM c_s s WHERE s.locus = o.locus AND NOT contains(s.bases, o.h[s.i])) GROUP BY ALL),
      c_g AS (SELECT g.locus, g.sample, coalesce(l1 || l1, '--') AS g, unknown, het, sites, coalesce(made, '') AS made, marker FROM m_g g JOIN c_p USING (locus, sample) LEFT JOIN c_m USING (locus, sample)),
      c_z AS (SELECT locus, sample, g, CASE WHEN g = '--' THEN g WHEN unknown > 0 THEN '-' WHEN het < sites THEN g WHEN list_contains({_ALLOWED}[marker], made) THEN made ELSE '--' END AS genotype FROM c_g) SELECT locus, sample, genotype, genotype <> g AS corrected FROM c_z""",
    "null_allele_markers": _MARKERS + ", n_g AS (SELECT locus, marker, sample, coalesce(least(l1, l2) || greatest(l1, l2), '--') AS g FROM (SELECT * FROM m_g) z), n_h AS (SELECT locus, marker, sample, CASE WHEN g IS NULL THEN '--' ELSE g END AS g, count(*) FILTER (g <> '--') OVER (PARTITION BY locus) AS n FROM (SELECT n_g.locus, n_g.marker, n_g.sample, CASE WHEN m_g.l1 IS NULL OR m_g.l2 IS NULL THEN '--' ELSE n_g.g END AS g FROM n_g JOIN m_g USING (locus, sample)) y), n_r AS (SELECT locus, marker, sample, g, CASE "
    + " ".join(f"WHEN {_RULE(k, w)} THEN {i}" for i, (k, w, _, _) in enumerate(NULLS)) + " ELSE -1 END AS rule FROM n_h WINDOW w AS (PARTITION BY locus)) SELECT locus, marker, sample, g AS genotype, CASE rule "
    + " ".join(f"WHEN {i} THEN '{new}'" for i, (_, _, new, _) in enumerate(NULLS)) + " ELSE marker END AS new_marker, CASE " + " ".join(f"WHEN rule = {i} AND g = '{old}' THEN '{name}'" for i, (_, _, _, names) in enumerate(NULLS) for old, name in names.items()) + " ELSE g END AS new_genotype FROM n_r",
}
HAPS = ("haps",)
OPS = {"corrected_genotypes": Fn(HAPS, corrected_genotypes, _CHECK["corrected_genotypes"]), "null_allele_markers": Fn(HAPS, null_allele_markers, _CHECK["null_allele_markers"])}
