"""The catalog of loci with SNPs and alleles: built sample by sample, then matched by each sample, haplotype by haplotype.

A sample's loci are (sample, locus, consensus, snps, alleles, depth): snps an array of (col, bases) by column, alleles an array of (haplotype, depth), a letter
for each SNP column; both empty where nothing varies. A catalog locus is (catalog, consensus, snps, alleles), its alleles an array of haplotypes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar
from ..functions.columns import with_bases
from ..plans.dialect import Fn
from . import alignment, assembly, graphs

SNPS = "array<struct<col:int,bases:string>>"
CATALOG = f"catalog long, consensus string, snps {SNPS}, alleles array<string>"
LOCUS = f"consensus string, snps {SNPS}, alleles array<struct<haplotype:string,depth:long>>, depth long"

# ---------------------------------------------------------------- loci and their allele strings


def loci_of(members: DataFrame, critical: float = 3.84, alleles_from: DataFrame | None = None) -> DataFrame:
    """members (sample, locus, seq, depth) -> loci with consensus, heterozygous SNPs, and the alleles that reads show; locus numbers don't repeat
    across samples. alleles_from: the members whose reads show alleles, where these are fewer."""
    m = members.select("locus", "seq", "depth")
    het = assembly.locus_snps(m, critical).where("type = 'E'")
    snps = het.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("col", F.concat("rank_1", "rank_2").alias("bases")))).alias("snps"))
    shown = assembly.locus_alleles((alleles_from if alleles_from is not None else members).select("locus", "seq", "depth"), het)
    alleles = shown.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("haplotype", F.col("count").cast("long").alias("depth")))).alias("alleles"))
    own = members.groupBy("locus").agg(F.first("sample").alias("sample"), F.sum("depth").cast("long").alias("depth"))
    out = own.join(assembly.consensus(m, "locus", "depth"), "locus").join(snps, "locus", "left").join(alleles, "locus", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select("sample", "locus", "consensus", none("snps", SNPS), none("alleles", "array<struct<haplotype:string,depth:long>>"), "depth")


def strings(loci: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, haplotype, depth, seq): the consensus with each allele's bases put in; the consensus itself, named so, for loci without alleles."""
    kind = dict(loci.dtypes)["alleles"]
    plain = F.transform("alleles", lambda a: F.struct(a.alias("haplotype"), F.lit(0).cast("long").alias("depth"))) if kind == "array<string>" else F.col("alleles")
    whole = F.array(F.struct(F.lit("consensus").alias("haplotype"), (F.col("depth") if "depth" in loci.columns else F.lit(0)).cast("long").alias("depth")))
    e = loci.select(*keep, "consensus", "snps", F.explode(F.when(F.size("alleles") > 0, plain).otherwise(whole)).alias("a"))
    seq = F.when(F.col("a.haplotype") == "consensus", F.col("consensus")).otherwise(with_bases(F.col("consensus"), F.transform("snps", lambda s: s["col"]), F.col("a.haplotype")))
    return e.select(*keep, "a.haplotype", "a.depth", seq.alias("seq"))


# ---------------------------------------------------------------- merging loci


@dataclass
class Locus:
    consensus: str
    snps: list[tuple[int, str]] = field(default_factory=list)
    alleles: list[str] = field(default_factory=list)

    def laid_out(self, c: cigar.Cigar) -> Locus:
        """Along an alignment in which it is the read: gaps as N, SNPs where their columns come to lie."""
        where = cigar.shift_columns([col for col, _ in self.snps], c)
        return Locus(cigar.padded(self.consensus, c), [(to, bases) for to, (_, bases) in zip(where, self.snps, strict=True)], self.alleles)


def merged(a: Locus, b: Locus) -> Locus:
    """a with what b adds. SNPs are united by column, columns where the two consensus differ (N aside) become SNPs; each side's haplotypes are
    spelled over all columns with that side's consensus. Loci of different length are aligned first, and a's consensus takes b's bases where it has a gap."""
    if len(a.consensus) != len(b.consensus):
        c = alignment.align(a.consensus, b.consensus)[1]
        a, b = a.laid_out(cigar.invert(c)), b.laid_out(c)
    snps = assembly.merged_snps([(c, *x) for c, x in a.snps], [(c, *x) for c, x in b.snps], a.consensus, b.consensus)
    cols = [c for c, _ in snps]
    spelled = {h for side in (a, b) for h in assembly.expanded_alleles(side.alleles, [c for c, _ in side.snps], cols, side.consensus)}
    consensus = "".join(y if x == "N" else x for x, y in zip(a.consensus, b.consensus, strict=True))
    return Locus(consensus, [(c, "".join(x)) for c, x in snps], sorted(spelled) if cols else [])


def reduced_alleles(alleles: list[str]) -> list[str]:
    """Without haplotypes that another one says all of: it agrees wherever they are not N."""
    return [h for h in alleles if "N" not in h or not any(o != h and all(x in ("N", y) for x, y in zip(h, o, strict=True)) for o in alleles)]


def _merge(reduce: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for members in b.column("members").to_pylist():
                at, *rest = (Locus(m["consensus"], [(s["col"], s["bases"]) for s in m["snps"]], m["alleles"]) for m in members)
                for m in rest:
                    at = merged(at, m)
                out.append((at.consensus, [{"col": c, "bases": x} for c, x in at.snps], reduced_alleles(at.alleles) if reduce else at.alleles))
            kinds = (pa.string(), pa.list_(pa.struct([("col", pa.int32()), ("bases", pa.string())])), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("catalog"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=["catalog", "consensus", "snps", "alleles"])

    return run


# ---------------------------------------------------------------- building


def pairs_across(one: DataFrame, other: DataFrame, distance: int) -> DataFrame:
    """one (sa), other (sb) -> (sa, sb, dist): pairs of equal length, any length, at 1 to `distance` differing places. Two such share one of distance + 1 parts of their bases; a pair comes
    from its first shared part only."""
    parts = distance + 1

    def cut(t, s, h):
        at = lambda p: F.floor(F.length(s) * p / parts).cast("int")
        t = t.distinct().select(s, F.length(s).alias("n"), F.array(*[F.xxhash64(F.substr(F.col(s), at(p) + 1, at(p + 1) - at(p))) for p in range(parts)]).alias(h))
        return t.select(s, "n", h, F.posexplode(h).alias("part", "code"))

    # sizes are guessed from the files: sorted joins, so that none goes through the driver
    j = cut(one, "sa", "ha").join(cut(other, "sb", "hb").hint("merge"), ["n", "part", "code"])
    first = F.array_position(F.zip_with("ha", "hb", lambda a, b: (a == b).cast("int")), F.lit(1)) == F.col("part") + 1
    return j.where(first).select("sa", "sb", assembly.distance_of("sa", "sb").alias("dist")).where((F.col("dist") >= 1) & (F.col("dist") <= distance))


def nearest(own: DataFrame, known: DataFrame, distance: int, length: int) -> DataFrame:
    """own, known (locus or catalog, haplotype, seq): (locus, haplotype, catalog, dist), for each haplotype its nearest catalog locus within the distance, ties to the least number."""
    same = own.join(known.select("catalog", "seq"), "seq").groupBy("locus", "haplotype").agg(F.min("catalog").alias("catalog")).withColumn("dist", F.lit(0))
    if not distance:
        return same
    rest = own.join(same, ["locus", "haplotype"], "left_anti")
    pairs = pairs_across(rest.select(F.col("seq").alias("sa")), known.select(F.col("seq").alias("sb")), distance)
    found = rest.join(pairs, rest["seq"] == pairs["sa"]).drop("seq").join(known.select("catalog", F.col("seq").alias("sb")).hint("merge"), "sb")
    near = found.groupBy("locus", "haplotype").agg(F.min(F.struct("dist", "catalog")).alias("m")).select("locus", "haplotype", "m.catalog", "m.dist")
    return same.unionByName(near)


def gapped_nearest(own: DataFrame, known: DataFrame, distance: int, k: int, max_gaps: int, min_identity: float) -> DataFrame:
    """As nearest, by alignments with gaps: of the catalog strings that share most k-mers with a haplotype, those that align with few gaps, enough agreement and few mismatches."""
    q = own.select(F.xxhash64("locus", "haplotype").alias("id"), "locus", "haplotype", "seq")
    c = known.select(F.xxhash64("catalog", "haplotype").alias("other"), "catalog", "seq")
    pairs = assembly.gapped_candidates(q, c, k).join(q.select("id", F.col("seq").alias("sb")), "id").join(c.select("other", F.col("seq").alias("sa")), "other")
    ok = assembly.aligned_pairs(pairs, max_gaps, min_identity).where(F.col("dist") <= distance)
    found = ok.join(q.select("id", "locus", "haplotype"), "id").join(c.select("other", "catalog"), "other")
    return found.groupBy("locus", "haplotype").agg(F.min(F.struct("dist", "gaps", "catalog")).alias("m")).select("locus", "haplotype", "m.catalog", "m.dist")


def build(loci: DataFrame, distance: int = 1, length: int = 64, gapped_k: int | None = None, max_gaps: int = 2, min_identity: float = 0.8, reduce: bool = False, seed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """loci -> the catalog, and its sources (catalog, sample, locus).

    Samples come one after another in order, as what a sample meets depends on those before it; seed is a catalog to begin with. Each of a locus' haplotypes takes
    its nearest catalog locus within the distance (ties: the least number), or with gapped_k, if none of them has one, by gapped alignment. A locus that takes none becomes a catalog locus under
    its own number. One that takes several links them: they become one, under the least number. Catalog locus, sample loci and linked ones are
    merged, all groups of a sample at once; consensus, SNPs and alleles as in `merged`. Where reduce is set, alleles that others say all of are dropped.

    A sample is a few joins with the catalog, which is written anew (a row a locus); sources are only ever appended, and linked numbers put in
    at the end. A group is the loci that one sample joins to one catalog locus; repeats make it large, and assembly bounds their piles.
    """
    spark = loci.sparkSession
    base, base_path = graphs.written(loci.withColumn("_sample", F.col("sample")), "loci", by="_sample")
    samples = [r[0] for r in base.select("sample").distinct().orderBy("sample").collect()]  # a row a sample
    known = seed.select("catalog", "consensus", "snps", "alleles") if seed is not None else spark.createDataFrame([], CATALOG)
    path, renamed, sources = None, [], []
    for s in samples:
        own = base.where(F.col("_sample").eqNullSafe(F.lit(s))).drop("_sample")
        q, c = strings(own, "locus"), strings(known, "catalog")
        hits = nearest(q, c, distance, length)
        if gapped_k:
            hits = hits.unionByName(gapped_nearest(q.join(hits, "locus", "left_anti"), c, distance, gapped_k, max_gaps, min_identity))
        hits, hits_path = graphs.written(hits.select("locus", "catalog").distinct(), "hits")
        linked = hits.withColumn("low", F.min("catalog").over(Window.partitionBy("locus"))).where("low < catalog").select(F.col("low").alias("a"), F.col("catalog").alias("b"))
        root = None
        if linked.limit(1).count():
            root = graphs.components(linked).withColumnRenamed("v", "catalog")
            renamed.append(graphs.written(root.where("catalog <> root").select("catalog", "root"), "linked")[0])
            hits = hits.join(root, "catalog", "left").select("locus", F.coalesce("root", "catalog").alias("catalog")).distinct()
            known = known.join(root, "catalog", "left")
        else:
            known = known.withColumn("root", F.lit(None).cast("long"))
        touched = hits.select("catalog").distinct().withColumn("touched", F.lit(True))
        known = known.select(F.coalesce("root", "catalog").alias("to"), "*").join(touched.withColumnRenamed("catalog", "to"), "to", "left")
        member = lambda kind, no, alleles: F.struct(F.lit(kind).alias("kind"), F.col(no).alias("no"), "consensus", "snps", alleles.alias("alleles")).alias("m")
        parts = known.where("touched").select(F.col("to").alias("catalog"), member(0, "catalog", F.col("alleles")))
        bare = F.transform("alleles", lambda a: a["haplotype"])
        parts = parts.unionByName(own.join(hits, "locus").select("catalog", member(1, "locus", bare)))
        groups = parts.groupBy("catalog").agg(F.array_sort(F.collect_list("m")).alias("members"))
        new = own.join(hits, "locus", "left_anti").select(F.col("locus").alias("catalog"), "consensus", "snps", bare.alias("alleles"))
        every = known.where("touched is null").select("catalog", "consensus", "snps", "alleles").unionByName(groups.mapInArrow(_merge(reduce), CATALOG)).unionByName(new)
        known, new_path = graphs.written(every, "catalog")
        found = own.select("locus").join(hits, "locus", "left").select(F.coalesce("catalog", "locus").alias("catalog"), F.lit(s).cast(loci.schema["sample"].dataType).alias("sample"), "locus")
        sources.append(graphs.written(found, "sources")[0])
        for p in (path, hits_path):
            if p:
                graphs.removed(spark, p)
        path = new_path
    if not sources:
        return known, loci.select(F.col("locus").alias("catalog"), "sample", "locus")
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    if renamed:
        edges = renamed[0]
        for r in renamed[1:]:
            edges = edges.unionByName(r)
        last = graphs.components(edges.select(F.col("catalog").alias("a"), F.col("root").alias("b"))).withColumnRenamed("v", "catalog")
        out = out.join(last, "catalog", "left").select(F.coalesce("root", "catalog").alias("catalog"), "sample", "locus").distinct()
    graphs.removed(spark, base_path)
    return known, out


# ---------------------------------------------------------------- matching


def over_columns(consensus: str | Column, cols: Column, haplotype: Column, catalog_cols: Column) -> Column:
    """A sample's haplotype over its own and the catalog's SNP columns: its consensus where only the catalog varies, N past its end."""
    con = F.col(consensus) if isinstance(consensus, str) else consensus
    every = F.array_sort(F.array_union(cols, catalog_cols))
    place = lambda c: F.array_position(cols, c)
    base = lambda c: F.when(place(c) > 0, F.substr(haplotype, place(c).cast("int"), F.lit(1))).when(c < F.length(con), F.substr(con, (c + 1).cast("int"), F.lit(1))).otherwise(F.lit("N"))
    return F.array_join(F.transform(every, base), "")


def only_compatible(haplotype: Column, candidates: Column) -> Column:
    """The one of the candidates (an array) that agrees with the haplotype wherever it is not N; null if none or several do."""
    fits = F.filter(candidates, lambda c: (F.length(c) == F.length(haplotype)) & F.regexp_like(c, F.concat(F.lit("^"), F.replace(haplotype, F.lit("N"), F.lit(".")), F.lit("$"))))
    return F.when(F.size(fits) == 1, fits[0])


def _cols(name: str) -> Column:
    return F.transform(name, lambda s: s["col"])


def sequence_matches(loci: DataFrame, catalog: DataFrame) -> DataFrame:
    """(sample, locus, catalog, haplotype, depth, cigar, verdict): sample haplotypes that are an allele of the catalog, letter by letter.

    verdict is `verified`, or why a locus is left out: it hits several catalog loci (`multi`), varies in a column where the catalog does not (`extra_snp`), or
    has no haplotype that is one catalog allele's and no other's (`none_verified`); haplotype and cigar are null then.
    """
    q = strings(loci.withColumn("cols", _cols("snps")), "sample", "locus", "cols")
    c = strings(catalog.withColumn("cat_cols", _cols("snps")), "catalog", "cat_cols").select("catalog", "cat_cols", F.col("haplotype").alias("allele"), "seq")
    h = q.join(c, "seq")
    locus = Window.partitionBy("sample", "locus")
    h = h.withColumn("loci", F.size(F.collect_set("catalog").over(locus))).withColumn("extra", F.size(F.array_except("cols", "cat_cols")) > 0)
    h = h.withColumn("a", F.count("*").over(Window.partitionBy("sample", "locus", "haplotype"))).withColumn("b", F.count("*").over(Window.partitionBy("sample", "locus", "allele")))
    h = h.withColumn("ok", (F.col("a") == 1) & (F.col("b") == 1)).withColumn("some", F.max("ok").over(locus))
    verdict = F.when(F.col("loci") > 1, "multi").when(F.col("extra"), "extra_snp").when(~F.col("some"), "none_verified").when(F.col("ok"), "verified")
    h = h.withColumn("verdict", verdict).where("verdict is not null")
    ok = F.col("verdict") == "verified"
    return h.select("sample", "locus", "catalog", F.when(ok, F.col("allele")).alias("haplotype"), F.when(ok, F.col("depth")).alias("depth"), F.when(ok, F.concat(F.length("seq").cast("string"), F.lit("M"))).alias("cigar"), "verdict").distinct()


def place_matches(loci: DataFrame, catalog: DataFrame, places: list[str], impute: bool = True) -> DataFrame:
    """As sequence_matches, for loci at the same places (columns of both frames, such as chr, bp and strand).

    Two loci without SNPs match if they agree as far as both go. Else all SNPs of the sample's locus within the shorter one must be the catalog's too, and each
    of its haplotypes, spelled over the catalog's columns as well, matches the only catalog allele it is compatible with (or without impute, equal to).
    """
    c = catalog.select(*places, "catalog", F.col("consensus").alias("con"), _cols("snps").alias("cat_cols"), F.col("alleles").alias("cat_alleles"))
    j = loci.withColumn("cols", _cols("snps")).join(c, places)
    short = F.least(F.length("con"), F.length("consensus"))
    same = F.substr("consensus", F.lit(1), short) == F.substr("con", F.lit(1), short)
    plain = (F.size("cols") == 0) & (F.size("cat_cols") == 0)
    extra = F.size(F.array_except(F.filter("cols", lambda x: x < short), "cat_cols")) > 0
    j = j.withColumn("verdict", F.when(plain, F.when(same, "verified").otherwise("none_verified")).when(extra, "extra_snp"))
    simple = j.where("verdict is not null").select("sample", "locus", "catalog", F.when(F.col("verdict") == "verified", "consensus").alias("haplotype"), F.when(F.col("verdict") == "verified", F.col("depth")).alias("depth"), "verdict")
    own = F.when(F.size("alleles") > 0, F.col("alleles")).otherwise(F.array(F.struct(F.lit("").alias("haplotype"), F.col("depth").alias("depth"))))
    e = j.where("verdict is null").select("sample", "locus", "catalog", "consensus", "cols", "cat_cols", "con", "cat_alleles", F.explode(own).alias("a"))
    spelled = over_columns("consensus", F.col("cols"), F.col("a.haplotype"), F.col("cat_cols"))
    # a catalog locus that varies nowhere stands for itself
    theirs = F.when(F.size("cat_alleles") > 0, F.col("cat_alleles")).otherwise(F.array(over_columns("con", F.col("cat_cols"), F.lit(""), F.col("cols"))))
    e = e.withColumn("spelled", spelled).withColumn("theirs", theirs)
    hit = only_compatible(F.col("spelled"), F.col("theirs")) if impute else F.when(F.array_contains("theirs", F.col("spelled")), F.col("spelled"))
    e = e.withColumn("haplotype", hit).groupBy("sample", "locus", "catalog", "haplotype").agg(F.max("a.depth").alias("depth"))
    some = F.max(F.col("haplotype").isNotNull()).over(Window.partitionBy("sample", "locus", "catalog"))
    e = e.withColumn("some", some).where("haplotype is not null or not some")
    e = e.select("sample", "locus", "catalog", "haplotype", F.when(F.col("haplotype").isNotNull(), F.col("depth")).alias("depth"), F.when(F.col("haplotype").isNotNull(), "verified").otherwise("none_verified").alias("verdict"))
    return simple.unionByName(e)


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sample, locus, catalog, cols, cat_cols, hits), hits sorted by haplotype and rank -> rows of matches."""
    for b in batches:
        out: list[tuple] = []
        for i, (cols, theirs, hits) in enumerate(zip(*(b.column(n).to_pylist() for n in ("cols", "cat_cols", "hits")), strict=True)):
            best: dict[str, dict] = {}
            taken = set()
            for h in hits:
                if h["haplotype"] not in best and h["allele"] not in taken:
                    best[h["haplotype"]] = h
                    taken.add(h["allele"])
            deepest = min(best.values(), key=lambda h: (-h["depth"], h["haplotype"]))
            shifted = cigar.shift_columns(cols, cigar.parse(deepest["cigar"]))
            if set(shifted) - set(theirs):
                out.append((i, None, None, None, "extra_snp"))
            else:
                out += [(i, h["allele"], h["depth"], h["cigar"], "verified") for h in best.values()]
        at = pa.array([r[0] for r in out], pa.int64())
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in ("sample", "locus", "catalog")), *(pa.array([r[j + 1] for r in out], t) for j, t in enumerate(kinds))], names=["sample", "locus", "catalog", "haplotype", "depth", "cigar", "verdict"])


def gapped_matches(loci: DataFrame, catalog: DataFrame, k: int = 15, max_gaps: int = 2, min_identity: float = 0.8) -> DataFrame:
    """As sequence_matches, by alignment with gaps: a haplotype with those catalog alleles that share most k-mers with it. The alignment must leave the
    catalog's sequence as it is, have few gaps, enough agreement and no mismatch.

    Haplotypes in order take their best alignment (fewest gaps, then most agreement) with an allele not yet taken. The deepest one's alignment says where
    the locus' SNPs lie in the catalog's columns; all must be SNPs there.
    """
    q = strings(loci.withColumn("cols", _cols("snps")), "sample", "locus", "cols").withColumn("id", F.xxhash64("sample", "locus", "haplotype"))
    c = strings(catalog.withColumn("cat_cols", _cols("snps")), "catalog", "cat_cols").withColumn("other", F.xxhash64("catalog", "haplotype"))
    pairs = assembly.gapped_candidates(q, c, k).join(q.select("id", F.col("seq").alias("sb")), "id").join(c.select("other", F.col("seq").alias("sa")), "other")
    ok = assembly.aligned_pairs(pairs, max_gaps, min_identity).where("dist = 0 and instr(cigar, 'I') = 0")
    h = ok.join(q.drop("seq"), "id").join(c.select("other", "catalog", "cat_cols", F.col("haplotype").alias("allele")), "other")
    hit = F.struct("haplotype", "gaps", (-F.col("identity")).alias("rank"), "allele", "cigar", "depth")
    g = h.groupBy("sample", "locus").agg(F.countDistinct("catalog").alias("loci"), F.min("catalog").alias("catalog"), F.first("cols").alias("cols"), F.first("cat_cols").alias("cat_cols"), F.array_sort(F.collect_list(hit)).alias("hits"))
    kind = loci.schema["sample"].dataType.simpleString()
    one = g.where("loci = 1").drop("loci").mapInArrow(_assigned, f"sample {kind}, locus long, catalog long, haplotype string, depth long, cigar string, verdict string")
    many = h.join(g.where("loci > 1").select("sample", "locus"), ["sample", "locus"], "left_semi").select("sample", "locus", "catalog").distinct()
    return one.unionByName(many.select("*", F.lit(None).cast("string").alias("haplotype"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("cigar"), F.lit("multi").alias("verdict")))


def matches(loci: DataFrame, catalog: DataFrame, gapped_k: int | None = None, every: bool = False, **gaps) -> DataFrame:
    """(catalog, sample, locus, haplotype, depth, cigar) of verified matches, by sequence, and with gapped_k by alignment for loci that no sequence hits; `every` adds the others with
    their verdict in place of the haplotype."""
    m = sequence_matches(loci, catalog)
    if gapped_k:
        m = m.unionByName(gapped_matches(loci.join(m.select("sample", "locus").distinct(), ["sample", "locus"], "left_anti"), catalog, gapped_k, **gaps))
    if not every:
        return m.where("verdict = 'verified'").select("catalog", "sample", "locus", "haplotype", "depth", "cigar")
    return m.select("catalog", "sample", "locus", F.coalesce("haplotype", "verdict").alias("haplotype"), "depth", "cigar")


# ---------------------------------------------------------------- queries


def _members(piles: DataFrame) -> DataFrame:
    """Three samples of the piles: the first holds two variants of a group, or in each fifth group as loci of their own; the second a pair
    that shares one with it, and in each fifth group both of its variants in one locus, which links them; the third another pair."""
    fifth = F.col("g") % 5 == 0
    pick = lambda sample, locus, rows: piles.where(rows).select(F.lit(sample).alias("sample"), locus.cast("long").alias("locus"), "seq", F.col("depth").cast("long").alias("depth"))
    own = F.col("g") * 16
    a = pick(0, own + F.when(fifth, F.col("v")).otherwise(0), (fifth & F.col("v").isin(1, 2)) | (~fifth & F.col("v").isin(0, 1)))
    b = pick(1, own + 5, (fifth & F.col("v").isin(1, 2)) | (~fifth & F.col("v").isin(0, 2)))
    return a.unionByName(b).unionByName(pick(2, own + 6, F.col("v").isin(0, 3)))


def _letters(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "")), "")


def catalog_build(spark, piles):
    loci, _ = graphs.written(loci_of(_members(piles)), "sampleloci")
    known, sources = build(loci)
    s = sources.groupBy("catalog").agg(F.array_join(F.array_sort(F.collect_list(F.struct("sample", "locus"))).cast("array<string>"), ",").alias("members"))
    snps = F.array_join(F.transform("snps", lambda x: F.concat(x["col"].cast("string"), F.lit(":"), _letters(x["bases"]))), ",")
    return known.join(s, "catalog").select("catalog", "consensus", snps.alias("snps"), F.array_join("alleles", ",").alias("alleles"), F.regexp_replace("members", "[{}]", "").alias("members"))


def haplotype_matches(spark, piles):
    loci, _ = graphs.written(loci_of(_members(piles)), "sampleloci")
    return matches(loci, build(loci)[0], every=True)


def _fold(samples: int) -> str:
    """The samples' loci, then for each sample what the catalog is after it (k: consensus, ks: bases by column, ka: haplotypes)."""
    spelled = "array_to_string([CASE WHEN list_contains({cols}, i - 1) THEN {hap}[list_position({cols}, i - 1)] ELSE {con}[i] END FOR i IN range(1, len({con}) + 1)], '')"
    over = "array_to_string([CASE WHEN list_contains({own}, c) THEN {hap}[list_position({own}, c)] ELSE {con}[c + 1] END FOR c IN {cols}], '')"
    sql = f"""WITH c_m AS (SELECT 0 AS sample, g * 16 + CASE WHEN g % 5 = 0 THEN v ELSE 0 END AS locus, seq, depth FROM @piles WHERE CASE WHEN g % 5 = 0 THEN v IN (1, 2) ELSE v IN (0, 1) END
        UNION ALL SELECT 1, g * 16 + 5, seq, depth FROM @piles WHERE CASE WHEN g % 5 = 0 THEN v IN (1, 2) ELSE v IN (0, 2) END UNION ALL SELECT 2, g * 16 + 6, seq, depth FROM @piles WHERE v IN (0, 3)),
      c_b AS (SELECT locus, i - 1 AS col, seq[i] AS b, sum(depth) AS c FROM c_m, unnest(range(1, 65)) AS u(i) GROUP BY ALL),
      c_r AS (SELECT *, row_number() OVER (PARTITION BY locus, col ORDER BY c DESC, b) AS k FROM c_b),
      c_t AS (SELECT locus, col, sum(c) AS n, max(c) FILTER (k = 1) AS c1, coalesce(max(c) FILTER (k = 2), 0) AS c2, max(b) FILTER (k = 1) AS b1, max(b) FILTER (k = 2) AS b2 FROM c_r GROUP BY ALL),
      c_h AS (SELECT locus, col, b1 || b2 AS two FROM c_t WHERE 2 * (c1 * ln(c1 / n) + coalesce((n - c1) * ln(nullif(n - c1, 0) / (3 * n)), 0) - (c1 + c2) * ln((c1 + c2) / (2 * n)) - coalesce((n - c1 - c2) * ln(nullif(n - c1 - c2, 0) / (2 * n)), 0)) <= -3.84),
      c_l AS MATERIALIZED (SELECT locus, any_value(sample) AS sample, sum(depth)::BIGINT AS depth, any_value(con) AS con, coalesce(any_value(cols), []) AS cols, coalesce(any_value(twos), []) AS twos FROM c_m
        JOIN (SELECT locus, string_agg(b1, '' ORDER BY col) AS con FROM c_t GROUP BY locus) USING (locus) LEFT JOIN (SELECT locus, list(col ORDER BY col) AS cols, list(two ORDER BY col) AS twos FROM c_h GROUP BY locus) USING (locus) GROUP BY locus),
      c_a AS (SELECT locus, array_to_string([seq[c + 1] FOR c IN cols], '') AS hap, sum(m.depth)::BIGINT AS depth FROM c_m m JOIN c_l USING (locus) WHERE len(cols) > 0 AND list_bool_and([contains(twos[j], seq[cols[j] + 1]) FOR j IN range(1, len(cols) + 1)]) GROUP BY ALL),
      c_s AS MATERIALIZED (SELECT sample, locus, con, cols, coalesce(hap, 'consensus') AS hap, coalesce(a.depth, l.depth) AS depth, CASE WHEN hap IS NULL THEN con ELSE {spelled.format(cols="cols", hap="hap", con="con")} END AS seq FROM c_l l LEFT JOIN c_a a USING (locus)),
      k0 AS (SELECT locus AS catalog, con, cols FROM c_l WHERE sample = 0), ks0 AS (SELECT locus AS catalog, col, unnest([two[1], two[2]]) AS b FROM c_h JOIN c_l USING (locus) WHERE sample = 0), ka0 AS (SELECT locus AS catalog, hap FROM c_a JOIN c_l USING (locus) WHERE sample = 0), src0 AS (SELECT locus AS catalog, 0 AS sample, locus FROM c_l WHERE sample = 0)"""
    for i in range(1, samples):
        j = i - 1
        sql += f""",
      kst{j} AS MATERIALIZED (SELECT catalog, CASE WHEN hap IS NULL THEN con ELSE {spelled.format(cols="cols", hap="hap", con="con")} END AS seq FROM k{j} LEFT JOIN ka{j} USING (catalog)),
      n{i} AS (SELECT locus, hap, arg_min(catalog, hamming(s.seq, t.seq) * 1000000 + catalog) AS catalog FROM c_s s JOIN kst{j} t ON hamming(s.seq, t.seq) <= 1 WHERE sample = {i} GROUP BY locus, hap),
      e{i} AS (SELECT DISTINCT x.catalog AS a, y.catalog AS b FROM n{i} x JOIN n{i} y USING (locus)),
      w{i} AS (SELECT catalog AS c, catalog AS r FROM k{j} UNION SELECT e.b, w.r FROM w{i} w JOIN e{i} e ON e.a = w.c), root{i} AS MATERIALIZED (SELECT c AS old, min(r) AS catalog FROM w{i} GROUP BY c),
      h{i} AS MATERIALIZED (SELECT DISTINCT locus, r.catalog FROM n{i} n JOIN root{i} r ON r.old = n.catalog),
      mem{i} AS MATERIALIZED (SELECT r.catalog, 0 AS kind, old AS no, con, cols FROM k{j} k JOIN root{i} r ON r.old = k.catalog UNION ALL SELECT coalesce(h.catalog, locus), 1, locus, con, cols FROM c_l LEFT JOIN h{i} h USING (locus) WHERE sample = {i}),
      con{i} AS (SELECT catalog, arg_min(con, (kind, no)) AS con FROM mem{i} GROUP BY catalog),
      hap{i} AS (SELECT 0 AS kind, catalog AS no, hap FROM ka{j} UNION ALL SELECT 1, locus, hap FROM c_a JOIN c_l USING (locus) WHERE sample = {i}),
      ks{i} AS MATERIALIZED (SELECT r.catalog, col, b FROM ks{j} s JOIN root{i} r ON r.old = s.catalog UNION SELECT coalesce(h.catalog, locus), col, unnest([two[1], two[2]]) FROM c_h JOIN c_l USING (locus) LEFT JOIN h{i} h USING (locus) WHERE sample = {i}
        UNION SELECT m.catalog, i - 1, unnest([m.con[i], c.con[i]]) FROM mem{i} m JOIN con{i} c USING (catalog), unnest(range(1, 65)) AS u(i) WHERE m.con[i] <> c.con[i]),
      k{i} AS MATERIALIZED (SELECT catalog, any_value(con) AS con, coalesce(list(DISTINCT col ORDER BY col) FILTER (col IS NOT NULL), []) AS cols FROM con{i} LEFT JOIN ks{i} USING (catalog) GROUP BY catalog),
      ka{i} AS MATERIALIZED (SELECT DISTINCT m.catalog, {over.format(own="m.cols", hap="coalesce(p.hap, '')", con="m.con", cols="k.cols")} AS hap FROM mem{i} m JOIN k{i} k USING (catalog) LEFT JOIN hap{i} p USING (kind, no) WHERE len(k.cols) > 0),
      src{i} AS (SELECT r.catalog, sample, locus FROM src{j} s JOIN root{i} r ON r.old = s.catalog UNION ALL SELECT coalesce(h.catalog, locus), {i}, locus FROM c_l LEFT JOIN h{i} h USING (locus) WHERE sample = {i})"""
    return sql


_CHECK = {
    "catalog_build": _fold(3) + """ SELECT catalog, con AS consensus, coalesce(snps, '') AS snps, coalesce(alleles, '') AS alleles, members FROM k2
      LEFT JOIN (SELECT catalog, string_agg(col || ':' || bs, ',' ORDER BY col) AS snps FROM (SELECT catalog, col, string_agg(DISTINCT b, '' ORDER BY b) AS bs FROM ks2 GROUP BY ALL) GROUP BY catalog) USING (catalog)
      LEFT JOIN (SELECT catalog, string_agg(hap, ',' ORDER BY hap) AS alleles FROM ka2 GROUP BY catalog) USING (catalog)
      JOIN (SELECT catalog, string_agg(sample || ', ' || locus, ',' ORDER BY sample, locus) AS members FROM src2 GROUP BY catalog) USING (catalog)""",
    "haplotype_matches": _fold(3) + """, q_c AS (SELECT catalog, cols AS theirs, coalesce(hap, 'consensus') AS allele, CASE WHEN hap IS NULL THEN con ELSE array_to_string([CASE WHEN list_contains(cols, i - 1) THEN hap[list_position(cols, i - 1)] ELSE con[i] END FOR i IN range(1, 65)], '') END AS seq FROM k2 LEFT JOIN ka2 USING (catalog)),
      q_h AS (SELECT sample, locus, catalog, hap, allele, depth, len(list_filter(cols, lambda c: NOT list_contains(theirs, c))) > 0 AS extra FROM c_s JOIN q_c USING (seq)),
      q_l AS (SELECT *, len(list_distinct(list(catalog) OVER (PARTITION BY locus))) AS loci, count(*) OVER (PARTITION BY locus, hap) = 1 AND count(*) OVER (PARTITION BY locus, allele) = 1 AS ok FROM q_h),
      q_v AS (SELECT *, CASE WHEN loci > 1 THEN 'multi' WHEN extra THEN 'extra_snp' WHEN NOT bool_or(ok) OVER (PARTITION BY locus) THEN 'none_verified' END AS why FROM q_l)
      SELECT DISTINCT catalog, CAST(sample AS INT) AS sample, CAST(locus AS BIGINT) AS locus, coalesce(why, allele) AS haplotype, CASE WHEN why IS NULL THEN depth END AS depth, CASE WHEN why IS NULL THEN '64M' END AS cigar FROM q_v WHERE ok OR why IS NOT NULL""",
}
PILES = ("piles",)
OPS = {"catalog_build": Fn(PILES, catalog_build, _CHECK["catalog_build"]), "haplotype_matches": Fn(PILES, haplotype_matches, _CHECK["haplotype_matches"])}
