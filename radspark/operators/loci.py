"""Cleaning, k-mers, assembly and genotype models as operators over frames, with checks written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cross
from ..plans.dialect import Fn
from ..sources import formats
from . import assembly, cleaning, crosses, kmers, models, sinks

CODES = ("ACGTAC", "TTGACA", "GGCATT", "CATGCA", "GTACCA")

# ---------------------------------------------------------------- k-mers

# the k-mers of a read are cut from its start here, and joined with their counts
_KMER = "WITH c_k AS (SELECT read_id, sample, i, substr(seq, i, 15) AS k FROM (SELECT read_id, sample, seq, unnest(range(1, len(seq) - 13)) AS i FROM @reads WHERE len(seq) >= 15) z), c_f AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM c_k)"
_MED = "CASE WHEN len({0}) % 2 = 0 THEN ({0}[len({0}) // 2] + {0}[len({0}) // 2 + 1]) / 2.0 ELSE {0}[greatest(1, len({0}) // 2)] + 0.0 END"
_CHECK = {
    "kmer_count": _KMER + " SELECT k AS kmer, count(*) AS n FROM c_k GROUP BY k",
    "kmer_hist": _KMER + " SELECT n, count(DISTINCT k) AS kmers FROM c_f GROUP BY n",
    "kmer_spread": _KMER + f", c_d AS (SELECT list(n ORDER BY n) AS l FROM (SELECT DISTINCT k, n FROM c_f) z), c_m AS (SELECT l, {_MED.format('l')} AS median FROM c_d), c_r AS (SELECT median, list_sort([abs(x - CAST(floor(median) AS BIGINT)) FOR x IN l]) AS r FROM c_m) SELECT median, {_MED.format('r')} AS mad FROM c_r",
    "kmer_abundant_filter": _KMER + " SELECT r.read_id, CAST(count(n) AS INT) AS kmers, CAST(count(*) FILTER (n >= 5) AS INT) AS abundant FROM @reads r LEFT JOIN c_f f ON f.read_id = r.read_id GROUP BY r.read_id HAVING count(*) FILTER (n >= 5) <= floor(count(n) * 0.8 + 0.5)",
    "kmer_rare_filter": _KMER + f""", c_l AS (SELECT read_id, list(n ORDER BY i) AS l, list(n ORDER BY n) AS s FROM c_f GROUP BY read_id), c_b AS (SELECT read_id, l, floor({_MED.format('s')} * 0.15 + 0.5) AS bound FROM c_l),
      c_x AS (SELECT read_id, i, CAST(l[i] <= bound AS INT) AS low, CAST(l[1] <= bound AS INT) AS low1 FROM c_b, unnest(range(1, len(l) + 1)) AS u(i)),
      c_w AS (SELECT read_id, i, sum(low) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) + CASE WHEN i > 14 THEN low1 ELSE 0 END AS run FROM c_x)
      SELECT read_id, sample FROM @reads WHERE read_id NOT IN (SELECT read_id FROM c_w WHERE run >= 12)""",
    "kmer_median": _KMER + f", c_l AS (SELECT read_id, list(n ORDER BY n) AS l FROM c_f GROUP BY read_id) SELECT read_id, CAST(len(l) AS INT) AS kmers, {_MED.format('l')} AS median FROM c_l",
}

# ---------------------------------------------------------------- cleaning


def qc_chain(spark, reads):
    """Why reads go: too short, no cut site even after mending, low quality in a window, adapter; else retained."""
    c = cleaning.Checks(min_length=40, enzyme="ecoRI", window=0.15, min_quality=16, quality_base=48, adapter="GATCAGTC", adapter_kmer=5, adapter_mismatches=0)
    return cleaning.clean(reads, c).groupBy("sample", "verdict").agg(F.count("*").alias("n"))


def short_reads_chain(spark, reads):
    """As qc_chain without the cut site, and cutting reads where quality falls."""
    c = cleaning.Checks(min_length=40, window=0.15, min_quality=16, quality_base=48, trim=True)
    return cleaning.clean(reads, c).groupBy("verdict").agg(F.count("*").alias("n"), F.sum(F.when(F.col("verdict") == "retained", F.length("seq")).otherwise(0)).alias("bases"))


def window_quality_trim(spark, reads):
    return cleaning.quality_trim(reads, window=0.15, least=18, base=48, min_length=20)


def _codes(spark):
    return spark.createDataFrame([(c,) for c in CODES], "barcode string")


def barcode_rescue(spark, barcodes):
    return cleaning.demultiplex(barcodes, _codes(spark), 2).where("barcode is not null").select("read_id", "observed", F.col("barcode").alias("code"), F.col("distance").alias("dist"))


def unknown_barcodes(spark, barcodes):
    return cleaning.unknown_barcodes(cleaning.demultiplex(barcodes, _codes(spark), 1))


def _pairs(mates: DataFrame) -> DataFrame:
    a = mates.where("turn % 2 = 0").select("conv_id", "turn", F.col("seq").alias("seq1"))
    return a.join(mates.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("seq").alias("seq2")), ["conv_id", "turn"])


def transposed_pairs(spark, mates):
    return cleaning.transposed(_pairs(mates), "rsaI").groupBy("swapped").agg(F.count("*").alias("n"), F.sum(F.length("seq1")).alias("bases1"), F.sum(F.length("seq2")).alias("bases2"))


def paired_routes(spark, mates):
    """Both mates long enough and with a cut site, one, or none."""
    p = _pairs(mates)
    verdict = lambda c: F.when(F.length(c) < 60, "short").when(~F.substring(c, 1, 2).isin("AC", "CC", "GC"), "no_cutsite").otherwise("retained")
    return cleaning.routed(p.withColumn("verdict1", verdict("seq1")).withColumn("verdict2", verdict("seq2"))).groupBy("route").agg(F.count("*").alias("n"))


def pcr_dups(spark, alignments):
    """One pair of each start, strand and insert length."""
    return cleaning.pcr_duplicates(formats.mates_within(formats.aligned(alignments.where("flag & 2304 = 0"))), ["chr", "pos5", "strand"])


_LOW = "list_min([list_sum(q[i:i + w - 1]) FOR i IN range(1, len(seq) - w + 2)]) < {0} * w"
_Q = "WITH c_q AS (SELECT *, greatest(1, CAST(floor(0.15 * len(seq) + 0.5) AS INT)) AS w FROM @reads), c_w AS (SELECT read_id, i, sum(ord(substr(qual, i, 1)) - 48) OVER (PARTITION BY read_id ORDER BY i) AS s, w, len(seq) AS m FROM c_q, unnest(range(1, len(seq) + 1)) AS u(i)), c_s AS (SELECT *, s - coalesce(lag(s, w) OVER (PARTITION BY read_id ORDER BY i), 0) AS win FROM c_w) "
_Q = """WITH c_q AS (SELECT read_id, sample, seq, qual, greatest(1, CAST(floor(0.15 * len(seq) + 0.5) AS INT)) AS w FROM @reads),
  c_w AS (SELECT read_id, i, w, sum(ord(qual[i]) - 48) OVER (PARTITION BY read_id ORDER BY i) AS s FROM c_q, unnest(range(1, len(seq) + 1)) AS u(i)),
  c_s AS (SELECT b.read_id, b.i - b.w AS start, b.s - coalesce(a.s, 0) AS total, b.w FROM c_w b LEFT JOIN c_w a ON a.read_id = b.read_id AND a.i = b.i - b.w WHERE b.i >= b.w)"""
_CHECK |= {
    "qc_chain": _Q + """, c_low AS (SELECT DISTINCT read_id FROM c_s WHERE total < 16 * w), c_v AS (SELECT sample, CASE WHEN len(seq) < 40 THEN 'short' WHEN hamming(left(seq, 5), 'AATTC') > 1 THEN 'no_cutsite' WHEN read_id IN (SELECT read_id FROM c_low) THEN 'low_quality'
      WHEN contains(m, 'GATCAGTC') OR [1 FOR j IN range(5, 8) IF right(m, j) = left('GATCAGTC', j)] <> [] OR [1 FOR j IN range(5, 8) IF left(m, j) = right('GATCAGTC', j)] <> [] THEN 'adapter' ELSE 'retained' END AS verdict
      FROM (SELECT *, CASE WHEN len(seq) >= 5 AND hamming(left(seq, 5), 'AATTC') <= 1 THEN 'AATTC' || substr(seq, 6) ELSE seq END AS m FROM (SELECT read_id, sample, rpad(seq, greatest(5, CAST(len(seq) AS INT)), 'N') AS pad, seq FROM @reads) y WHERE len(seq) >= 5 OR true) z) SELECT sample, verdict, count(*) AS n FROM c_v GROUP BY ALL""".replace("hamming(left(seq, 5), 'AATTC') > 1", "hamming(left(pad, 5), 'AATTC') > 1").replace("AND hamming(left(seq, 5), 'AATTC') <= 1", "AND hamming(left(pad, 5), 'AATTC') <= 1"),
    "short_reads_chain": _Q + ", c_low AS (SELECT read_id, min(start) AS cut FROM c_s WHERE total < 16 * w GROUP BY read_id), c_v AS (SELECT len(seq) AS m, cut, CASE WHEN len(seq) < 40 THEN 'short' WHEN cut < 40 THEN 'low_quality' ELSE 'retained' END AS verdict FROM @reads r LEFT JOIN c_low USING (read_id)) SELECT verdict, count(*) AS n, CAST(sum(CASE WHEN verdict = 'retained' THEN coalesce(cut, m) ELSE 0 END) AS BIGINT) AS bases FROM c_v GROUP BY verdict",
    "window_quality_trim": _Q + ", c_low AS (SELECT read_id, min(start) AS cut FROM c_s WHERE total < 18 * w GROUP BY read_id) SELECT read_id, CASE WHEN len(seq) < 20 THEN 'short' WHEN cut < 20 THEN 'low_quality' ELSE 'retained' END AS verdict, CASE WHEN len(seq) >= 20 AND (cut IS NULL OR cut >= 20) THEN CAST(coalesce(cut, len(seq)) AS INT) END AS cut FROM @reads LEFT JOIN c_low USING (read_id)",
    "barcode_rescue": f"WITH c_m AS (SELECT read_id, observed, code, hamming(observed, code) AS dist FROM @barcodes, unnest({list(CODES)}) AS u(code)) SELECT DISTINCT ON (read_id) read_id, observed, code, CAST(dist AS INT) AS dist FROM c_m WHERE dist <= 2 ORDER BY read_id, dist > 0, code",
    "unknown_barcodes": f"SELECT observed, count(*) AS n FROM @barcodes WHERE list_min([hamming(observed, c) FOR c IN {list(CODES)}]) > 1 GROUP BY observed",
    "transposed_pairs": "WITH c_p AS (SELECT a.seq AS x, b.seq AS y, (coalesce(a.seq[1] = 'A', false)::INT + coalesce(a.seq[2] = 'C', false)::INT) < (coalesce(b.seq[1] = 'A', false)::INT + coalesce(b.seq[2] = 'C', false)::INT) AS swapped FROM @mates a JOIN @mates b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0) SELECT swapped, count(*) AS n, CAST(sum(len(if(swapped, y, x))) AS BIGINT) AS bases1, CAST(sum(len(if(swapped, x, y))) AS BIGINT) AS bases2 FROM c_p GROUP BY swapped",
    "paired_routes": "WITH c_m AS (SELECT conv_id, turn, len(seq) >= 60 AND left(seq, 2) IN ('AC', 'CC', 'GC') AS ok FROM @mates), c_p AS (SELECT a.ok AS x, b.ok AS y FROM c_m a JOIN c_m b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0) SELECT CASE WHEN x AND y THEN 'paired' WHEN x THEN 'rem1' WHEN y THEN 'rem2' ELSE 'discards' END AS route, count(*) AS n FROM c_p GROUP BY ALL",
    "pcr_dups": """WITH c_a AS (SELECT *, (flag & 16) > 0 AS back, CASE WHEN (flag & 16) > 0 THEN pos + CASE line % 7 WHEN 0 THEN 26 WHEN 1 THEN 33 WHEN 2 THEN 25 WHEN 3 THEN 23 ELSE 31 END ELSE pos END AS p FROM @alignments WHERE (flag & 2308) = 0),
      c_p AS (SELECT x.name, x.chr, x.p AS pos5, CASE WHEN x.back THEN '-' ELSE '+' END AS strand, abs(x.p - y.p) + 1 AS insert_ FROM c_a x JOIN c_a y ON x.name = y.name AND x.back <> y.back WHERE (x.flag & 64) > 0 AND (y.flag & 128) > 0 AND ((x.p <= y.p) <> x.back OR x.p = y.p))
      SELECT chr, pos5, strand, insert_, min(name) AS name, count(*) AS pairs FROM c_p WHERE insert_ <= 1000 GROUP BY ALL""",
}

# ---------------------------------------------------------------- assembly


def _loci_frame(piles: DataFrame) -> DataFrame:
    return piles.select(F.col("v").alias("sample"), F.col("stack").alias("locus"), "seq", "depth")


def kmer_similarity_join(spark, piles):
    return assembly.similar_pairs(piles.withColumnRenamed("stack", "id"), 2, 64, ["sample"])


def stack_loci(spark, piles):
    return assembly.loci(piles, distance=1)


def stack_trees(spark, piles):
    pairs = assembly.similar_pairs(piles.withColumnRenamed("stack", "id"), 2, 64, ["sample"]).withColumn("locus", F.floor(F.col("a") / 4).cast("long"))
    return assembly.spanning_trees(pairs).groupBy("locus").agg(F.count("*").alias("edges"), F.sum("dist").alias("weight"), F.sum(F.col("cut").cast("int")).alias("cut"))


def lumberjack(spark, piles):
    return assembly.lumberjack(piles).where("lumberjack").select("stack", "sample", "depth")


def secondary_merge(spark, piles):
    return assembly.secondary_matches(piles.where("depth >= 3"), piles.where("depth < 3").withColumnRenamed("stack", "read"), 4)


def _members(piles: DataFrame) -> DataFrame:
    return piles.select(F.col("g").alias("locus"), "seq", "depth")


def locus_consensus(spark, piles):
    return assembly.consensus(piles.withColumn("g", F.col("g").cast("long")), "g", "depth").withColumnRenamed("g", "locus")


def locus_snps(spark, piles):
    t = assembly.locus_snps(_members(piles))
    return t.where("type <> 'O' or rank_2 is not null").select("locus", "col", "type", (F.floor(F.col("lratio") * 1e5 + 0.5) / 1e5).alias("lratio"), "rank_1", "rank_2")


def locus_alleles(spark, piles):
    m = _members(piles)
    return assembly.locus_alleles(m, assembly.locus_snps(m))


def catalog_matches(spark, piles):
    """Sample loci matched to the catalog that the samples build, by sequence."""
    own = _loci_frame(piles).withColumn("allele", F.lit("consensus"))
    catalog = own.groupBy("seq").agg(F.min("locus").alias("locus"))
    return assembly.one_to_one(assembly.exact_matches(own, catalog)).select("catalog", "sample", "locus", "depth")


def gapped_join(spark, piles):
    """Each second variant, less a base, aligned with the loci it shares most k-mers with."""
    whole = piles.where("v = 0").select(F.col("stack").alias("other"), "seq")
    cut = piles.where("v = 1").select(F.col("stack").alias("id"), F.concat(F.substring("seq", 1, 40), F.substring("seq", 42, 64)).alias("seq"))
    c = assembly.gapped_candidates(cut, whole, 11)
    pairs = assembly.with_sequences(c, cut, whole)
    return assembly.best_alignments(assembly.aligned_pairs(pairs)).select("id", "other", "gaps", "dist")


def locus_contigs(spark, piles):
    """Reads of 40 letters along each locus, put together again."""
    reads = piles.where("v = 0").select(F.col("g").alias("locus"), F.explode(F.array(*[F.substring("seq", 1 + 8 * i, 40) for i in range(4)] * 2)).alias("seq"))
    return assembly.contigs(reads, 15, 2).select("locus", "contig")


def phased_haplotypes(spark, bases):
    return assembly.phased(bases).groupBy("locus", "status").agg(F.count("*").alias("samples"))


_NEAR = "c_p AS (SELECT x.sample, x.stack AS a, y.stack AS b, hamming(x.seq, y.seq) AS dist FROM @piles x JOIN @piles y ON x.sample = y.sample AND x.g = y.g AND x.stack < y.stack)"
_LONG = "c_b AS (SELECT g AS locus, i - 1 AS col, seq[i] AS b, CAST(sum(depth) AS BIGINT) AS c FROM @piles, unnest(range(1, 65)) AS u(i) GROUP BY ALL), c_r AS (SELECT *, row_number() OVER (PARTITION BY locus, col ORDER BY c DESC, b) AS k FROM c_b), c_t AS (SELECT locus, col, sum(c) AS n, max(c) FILTER (k = 1) AS c1, coalesce(max(c) FILTER (k = 2), 0) AS c2, max(b) FILTER (k = 1) AS b1, max(b) FILTER (k = 2) AS b2 FROM c_r GROUP BY ALL), c_l AS (SELECT *, 2 * (c1 * ln(c1 / n) + coalesce((n - c1) * ln(nullif(n - c1, 0) / (3 * n)), 0) - (c1 + c2) * ln((c1 + c2) / (2 * n)) - coalesce((n - c1 - c2) * ln(nullif(n - c1 - c2, 0) / (2 * n)), 0)) AS lr FROM c_t)"
_CHECK |= {
    "kmer_similarity_join": f"WITH {_NEAR} SELECT sample, a, b, CAST(dist AS INT) AS dist FROM c_p WHERE dist BETWEEN 1 AND 2",
    "similarity_join_hamming": "WITH c_u AS (SELECT seq, min(read_id) AS id FROM @reads WHERE len(seq) > 0 GROUP BY seq) SELECT a.id AS id1, b.id AS id2, CAST(hamming(a.seq, b.seq) AS INT) AS dist FROM c_u a JOIN c_u b ON len(a.seq) = len(b.seq) AND a.id < b.id WHERE hamming(a.seq, b.seq) <= 6",
    "stack_loci": f"WITH {_NEAR}, c_e AS (SELECT a, b FROM c_p WHERE dist = 1 UNION ALL SELECT b, a FROM c_p WHERE dist = 1), c_w AS (SELECT stack AS v, stack AS r FROM @piles UNION SELECT e.b, w.r FROM c_w w JOIN c_e e ON w.v = e.a), c_m AS (SELECT v, min(r) AS locus FROM c_w GROUP BY v) SELECT stack, sample, c_m.locus, count(*) OVER (PARTITION BY c_m.locus) > 3 AS blacklisted FROM @piles JOIN c_m ON c_m.v = stack",
    "stack_trees": "WITH c_n AS (SELECT g AS locus, count(*) AS n, count(*) FILTER (v = 0) AS hub FROM @piles GROUP BY g HAVING count(*) > 1) SELECT locus, n - 1 AS edges, CAST(CASE WHEN hub > 0 THEN n - 1 ELSE 2 * (n - 1) END AS BIGINT) AS weight, CAST(CASE WHEN hub > 0 THEN 0 ELSE n - 1 END AS BIGINT) AS cut FROM c_n",
    "lumberjack": "WITH c_s AS (SELECT sample, floor(avg(depth) + 3 * stddev_pop(depth) + 1) AS lim FROM @piles GROUP BY sample), c_d AS (SELECT s.* FROM @piles s JOIN c_s USING (sample) WHERE depth > lim) SELECT s.stack, s.sample, s.depth FROM @piles s WHERE EXISTS (SELECT 1 FROM c_d d WHERE d.sample = s.sample AND hamming(d.seq, s.seq) <= 1)",
    "secondary_merge": "WITH c_p AS (SELECT r.sample, r.stack AS read, p.stack, hamming(r.seq, p.seq) AS dist FROM @piles r JOIN @piles p ON r.sample = p.sample WHERE r.depth < 3 AND p.depth >= 3 AND hamming(r.seq, p.seq) <= 4), c_m AS (SELECT *, rank() OVER (PARTITION BY sample, read ORDER BY dist) AS k FROM c_p) SELECT sample, read, any_value(stack) AS stack, CAST(any_value(dist) AS INT) AS dist FROM c_m WHERE k = 1 GROUP BY sample, read HAVING count(*) = 1",
    "locus_consensus": f"WITH {_LONG} SELECT locus, string_agg(b1, '' ORDER BY col) AS consensus FROM c_t GROUP BY locus",
    "locus_snps": f"WITH {_LONG} SELECT locus, CAST(col AS INT) AS col, CASE WHEN lr <= -3.84 THEN 'E' WHEN lr >= 3.84 THEN 'O' ELSE 'U' END AS type, floor(lr * 1e5 + 0.5) / 1e5 AS lratio, b1 AS rank_1, b2 AS rank_2 FROM c_l WHERE lr < 3.84 OR b2 IS NOT NULL",
    "locus_alleles": f"WITH {_LONG}, c_h AS (SELECT locus, list(col ORDER BY col) AS cols, list(b1 || b2 ORDER BY col) AS two FROM c_l WHERE lr <= -3.84 GROUP BY locus), c_a AS (SELECT locus, depth, [seq[c + 1] FOR c IN cols] AS h, two FROM @piles JOIN c_h ON locus = g) SELECT locus, array_to_string(h, '') AS haplotype, CAST(sum(depth) AS BIGINT) AS count FROM c_a WHERE list_bool_and([contains(two[i], h[i]) FOR i IN range(1, len(h) + 1)]) GROUP BY ALL",
    "catalog_matches": "WITH c_c AS (SELECT *, min(stack) OVER (PARTITION BY seq) AS catalog FROM @piles), c_n AS (SELECT *, count(DISTINCT stack) OVER (PARTITION BY v, catalog) AS k FROM c_c) SELECT catalog, v AS sample, stack AS locus, depth FROM c_n WHERE k = 1",
    "gapped_join": "SELECT x.stack AS id, y.stack AS other, CAST(1 AS INT) AS gaps, CAST(1 AS INT) AS dist FROM @piles x JOIN @piles y ON x.g = y.g AND y.v = 0 WHERE x.v = 1", "phased_haplotypes": None,
    "locus_contigs": "SELECT g AS locus, seq AS contig FROM @piles WHERE v = 0",
    "consensus": "WITH c_b AS (SELECT sample, i, substr(seq, i, 1) AS b, count(*) AS c FROM @reads, unnest(range(1, len(seq) + 1)) AS u(i) GROUP BY ALL), c_1 AS (SELECT sample, i, arg_max(b, (c, -ord(b))) AS b FROM c_b GROUP BY ALL) SELECT sample, string_agg(b, '' ORDER BY i) AS consensus FROM c_1 GROUP BY sample",
}

# ---------------------------------------------------------------- models and crosses


def genotypes_low(spark, depths):
    return models.call(depths, "low").select("locus", "col", "sample", "variable", "allele", "other", "a1", "a2", "gq", "depth")


def genotypes_high(spark, depths):
    return models.call(depths, "high").select("locus", "col", "sample", "variable", "allele", "other", "a1", "a2", "gq", "depth")


def export_vcf_calls(spark, depths):
    """Calls of the high-coverage model as a file's lines."""
    return sinks.called_lines(models.call(depths, "high"), depths.select("sample"))


def guo_thompson(spark, haps):
    return models.guo_thompson(haps)


def _cross(haps: DataFrame) -> DataFrame:
    """Marker types of loci from two parents (samples 0 and 1), and the letters of their haplotypes."""
    ok = haps.where("instr(h1, 'N') = 0 and instr(h2, 'N') = 0")
    parent = lambda s, name: ok.where(F.col("sample") == s).select("locus", F.array_sort(F.array_distinct(F.array("h1", "h2"))).alias(name))
    return parent(0, "mother").join(parent(1, "father"), "locus", "full")


def cross_markers(spark, haps):
    kind = F.udf(lambda m, f: cross.marker_type(frozenset(m or ()) or None, frozenset(f or ()) or None), "string", useArrow=True)
    return _cross(haps).select("locus", kind("mother", "father").alias("marker")).where("marker is not null")


def segregation(spark, haps):
    """Progeny genotypes of a cross against their expected shares: chi-square, degrees of freedom, level."""
    return crosses.segregation(crosses.progeny_genotypes(haps))


_SHARES = {k: cross.SEGREGATION["cp"][v] for k, v in cross.MAP_TYPES["cp"].items() if v in cross.SEGREGATION["cp"]}
_OF = lambda want: " + ".join(f"(count(*) FILTER (g = '{x}') - n * {e}) ** 2 / (n * {e})" for x, e in want.items())
_SEGREGATION = crosses._MARKERS + ", s_g AS (SELECT locus, marker, CASE WHEN l1 IS NULL OR l2 IS NULL THEN '--' ELSE least(l1, l2) || greatest(l1, l2) END AS g FROM m_g), s_n AS (SELECT *, count(*) FILTER (list_contains(" + crosses._ALLOWED + "[marker], g)) OVER (PARTITION BY locus) AS n FROM s_g), s_x AS (SELECT locus, marker, any_value(n) AS progeny, CASE WHEN any_value(n) = 0 THEN 0.0 " \
    + " ".join(f"WHEN marker = '{k}' THEN {_OF(w).replace('n * ', 'any_value(n) * ')}" for k, w in _SHARES.items()) + " END AS x, CAST(CASE marker " + " ".join(f"WHEN '{k}' THEN {len(w) - 1}" for k, w in _SHARES.items()) + " END AS INT) AS df FROM s_n WHERE " + crosses._ALLOWED + "[marker] IS NOT NULL GROUP BY locus, marker) SELECT locus, marker, progeny, round(x, 6) AS chisq, df, CAST(CASE " \
    + " ".join(f"WHEN df = {d} AND x >= {c} THEN {level}" for d, rows in cross.CRITICAL.items() for level, c in reversed(rows)) + " ELSE 1.0 END AS DOUBLE) AS level FROM s_x"
# every pair of bases of every sample's reads, one by one
_HIGH = f"""WITH h_q AS (SELECT locus, col, sample, [na, nc, ng, nt] AS c, CAST(na + nc + ng + nt AS BIGINT) AS n FROM @depths),
  h_o AS (SELECT locus, col, i, row_number() OVER (PARTITION BY locus, col ORDER BY sum(c[i]) DESC, i) AS k, sum(c[i]) AS t FROM h_q, range(1, 5) AS r(i) GROUP BY locus, col, i),
  h_l AS MATERIALIZED (SELECT *, CASE WHEN hit > 0 THEN hit * ln(hit / ((1 + d) * n)) ELSE 0 END + CASE WHEN n > hit THEN (n - hit) * ln((n - hit) / ((3 - d) * n)) ELSE 0 END AS ln
    FROM (SELECT locus, col, sample, n, x, y, (x <> y)::INT AS d, c[x] + CASE WHEN x <> y THEN c[y] ELSE 0 END AS hit FROM h_q, range(1, 5) AS r(x), range(1, 5) AS s(y) WHERE x <= y AND n > 0) z),
  h_r AS (SELECT locus, col, sample, i, row_number() OVER (PARTITION BY locus, col, sample ORDER BY c[i] DESC, i) AS k FROM h_q, range(1, 5) AS r(i) WHERE n > 0),
  h_ab AS (SELECT locus, col, sample, max(i) FILTER (k = 1) AS a, max(i) FILTER (k = 2) AS b FROM h_r GROUP BY ALL),
  h_w AS (SELECT h.locus, h.col, h.a, h.b, m.ln AS hom, e.ln AS het, f.ln AS ref FROM h_ab h JOIN h_o o ON o.locus = h.locus AND o.col = h.col AND o.k = 1
    JOIN h_l m ON m.locus = h.locus AND m.col = h.col AND m.sample = h.sample AND m.x = h.a AND m.y = h.a JOIN h_l e ON e.locus = h.locus AND e.col = h.col AND e.sample = h.sample AND e.x = least(h.a, h.b) AND e.y = greatest(h.a, h.b)
    JOIN h_l f ON f.locus = h.locus AND f.col = h.col AND f.sample = h.sample AND f.x = o.i AND f.y = o.i),
  h_k AS MATERIALIZED (SELECT locus, col, i FROM h_o WHERE k = 1 AND t > 0 UNION SELECT locus, col, unnest(CASE WHEN hom > het THEN [a] ELSE [a, b] END) FROM h_w WHERE 2 * abs(hom - het) > 3.84 AND 2 * (greatest(hom, het) - ref) > 3.84),
  h_n AS (SELECT locus, col, count(*) > 1 AS several, list(i ORDER BY k) AS o FROM h_k JOIN h_o USING (locus, col, i) GROUP BY locus, col),
  h_b AS (SELECT l.locus, l.col, l.sample, x, y, ln, row_number() OVER (PARTITION BY l.locus, l.col, l.sample ORDER BY ln DESC, x, y) AS k FROM h_l l JOIN h_k p ON p.locus = l.locus AND p.col = l.col AND p.i = l.x JOIN h_k q ON q.locus = l.locus AND q.col = l.col AND q.i = l.y),
  h_2 AS (SELECT locus, col, sample, max(x) FILTER (k = 1) AS x, max(y) FILTER (k = 1) AS y, 2 * (max(ln) FILTER (k = 1) - max(ln) FILTER (k = 2)) AS ratio FROM h_b GROUP BY ALL),
  h_gl AS (SELECT l.locus, l.col, l.sample, list(ln ORDER BY x = y AND x = o[2], x <> y) AS gl FROM h_l l JOIN h_n n ON n.locus = l.locus AND n.col = l.col WHERE several AND list_contains(o[1:2], x) AND list_contains(o[1:2], y) GROUP BY ALL),
  h_g AS MATERIALIZED (SELECT q.locus, q.col, q.sample, several, 'ACGT'[o[1]] AS allele, CASE WHEN several THEN 'ACGT'[o[2]] END AS other, CASE WHEN ratio > 3.84 THEN 'ACGT'[x] END AS a1, CASE WHEN ratio > 3.84 THEN 'ACGT'[y] END AS a2,
    CAST(CASE WHEN ratio > 3.84 THEN len(list_filter({[float(x) for x in models.QUALITIES]}, lambda t: t <= ratio)) ELSE 0 END AS INT) AS gq, n AS depth, c, gl FROM h_q q JOIN h_n USING (locus, col) LEFT JOIN h_2 USING (locus, col, sample) LEFT JOIN h_gl USING (locus, col, sample))"""
_CHECK |= {
    "cross_markers": """WITH c_p AS (SELECT locus, sample, list_sort(list_distinct([h1, h2])) AS h FROM @haps WHERE sample < 2 AND NOT contains(h1 || h2, 'N')), c_t AS (SELECT locus, max(h) FILTER (sample = 0) AS m, max(h) FILTER (sample = 1) AS f FROM c_p GROUP BY locus),
      c_k AS (SELECT locus, len(m) AS x, len(f) AS y, len(list_intersect(m, f)) AS s FROM c_t), c_v AS (SELECT locus, CASE WHEN x IS NULL THEN CASE WHEN y = 2 THEN '--/ab' END WHEN y IS NULL THEN CASE WHEN x = 2 THEN 'ab/--' END WHEN x + y = 2 THEN CASE WHEN s = 0 THEN 'aa/bb' END
      WHEN x + y = 4 THEN ['ab/cd', 'ab/ac', 'ab/ab'][s + 1] WHEN x = 2 THEN if(s = 1, 'ab/aa', 'ab/cc') ELSE if(s = 1, 'aa/ab', 'cc/ab') END AS marker FROM c_k) SELECT locus, marker FROM c_v WHERE marker IS NOT NULL""",
    "genotypes_low": None, "guo_thompson": None,
    "genotypes_high": _HIGH + " SELECT locus, col, sample, several AS variable, allele, other, a1, a2, gq, depth FROM h_g",
    "export_vcf_calls": _HIGH + """, h_t AS (SELECT *, c[strpos('ACGT', allele)] AS x, CASE WHEN other IS NULL THEN 0 ELSE c[strpos('ACGT', other)] END AS y,
        CASE WHEN a1 IS NULL THEN NULL ELSE (a1 = other)::INT + (a2 = other)::INT END AS copies FROM h_g),
      h_f AS (SELECT *, [CAST(floor(v / ln(10) * 100 + 0.5) AS BIGINT) FOR v IN gl] AS gi FROM h_t),
      h_c AS (SELECT *, CASE WHEN depth = 0 THEN CASE WHEN several THEN './.' ELSE '.' END WHEN NOT several THEN depth::VARCHAR
        ELSE concat(CASE WHEN a1 IS NULL THEN './.:.:.:.' ELSE concat(CASE WHEN a1 <> a2 THEN '0/1' WHEN a1 = allele THEN '0/0' ELSE '1/1' END, ':.:.:', gq) END, ':', depth, ':', x, ',', y, ':',
          array_to_string([concat(if(g < 0, '-', ''), abs(g) // 100, '.', lpad((abs(g) % 100)::VARCHAR, 2, '0')) FOR g IN gi], ',')) END AS call FROM h_f),
      h_s AS (SELECT locus, col, several, allele, other, sum(depth) AS dp, sum(x) AS x, sum(y) AS y, sum(copies) AS minor, 2 * count(copies) AS copies FROM h_c GROUP BY ALL),
      h_p AS (SELECT s.*, p.sample FROM h_s s CROSS JOIN (SELECT DISTINCT sample FROM @depths) p)
      SELECT p.locus AS part, CAST(p.col AS BIGINT) AS line, concat_ws(chr(9), p.locus, p.col + 1, p.locus || ':' || p.col, p.allele, coalesce(p.other, '.'), '.', 'PASS',
        concat('DP=', p.dp, ';AD=', p.x, CASE WHEN p.several THEN concat(',', p.y, ';AF=', CASE WHEN p.copies > 0 THEN floor(p.minor / p.copies * 1000 + 0.5) / 1000 ELSE 0.0 END) ELSE '' END), CASE WHEN p.several THEN 'GT:PS:FT:GQ:DP:AD:GL' ELSE 'DP' END,
        string_agg(coalesce(c.call, CASE WHEN p.several THEN './.' ELSE '.' END), chr(9) ORDER BY p.sample)) AS value
      FROM h_p p LEFT JOIN h_c c ON c.locus = p.locus AND c.col = p.col AND c.sample = p.sample GROUP BY p.locus, p.col, p.several, p.allele, p.other, p.dp, p.x, p.y, p.minor, p.copies""", "segregation_chisq": _SEGREGATION, "kmer_normalise": None,
}

READS, PILES, DEPTHS, HAPS = ("reads",), ("piles",), ("depths",), ("haps",)
_RUN = {
    "kmer_count": (READS, lambda spark, reads: kmers.count(reads)), "kmer_hist": (READS, lambda spark, reads: kmers.histogram(reads)), "kmer_spread": (READS, lambda spark, reads: kmers.spread(reads)), "kmer_abundant_filter": (READS, lambda spark, reads: kmers.abundant_filter(reads, max_k_freq=5)),
    "kmer_rare_filter": (READS, lambda spark, reads: kmers.rare_filter(reads)), "kmer_median": (READS, lambda spark, reads: kmers.medians(reads)), "kmer_normalise": (READS, lambda spark, reads: kmers.normalise(reads)),
    "qc_chain": (READS, qc_chain), "short_reads_chain": (READS, short_reads_chain), "window_quality_trim": (READS, window_quality_trim), "barcode_rescue": (("barcodes",), barcode_rescue), "unknown_barcodes": (("barcodes",), unknown_barcodes),
    "transposed_pairs": (("mates",), transposed_pairs), "paired_routes": (("mates",), paired_routes), "pcr_dups": (("alignments",), pcr_dups),
    "similarity_join_hamming": (READS, lambda spark, reads: assembly.similar_by_parts(reads)), "consensus": (READS, lambda spark, reads: assembly.consensus(reads)), "kmer_similarity_join": (PILES, kmer_similarity_join), "stack_loci": (PILES, stack_loci), "stack_trees": (PILES, stack_trees),
    "lumberjack": (PILES, lumberjack), "secondary_merge": (PILES, secondary_merge), "locus_consensus": (PILES, locus_consensus), "locus_snps": (PILES, locus_snps), "locus_alleles": (PILES, locus_alleles), "catalog_matches": (PILES, catalog_matches),
    "gapped_join": (PILES, gapped_join), "locus_contigs": (PILES, locus_contigs), "phased_haplotypes": (("bases",), phased_haplotypes),
    "genotypes_low": (DEPTHS, genotypes_low), "genotypes_high": (DEPTHS, genotypes_high), "export_vcf_calls": (DEPTHS, export_vcf_calls), "guo_thompson": (HAPS, guo_thompson), "cross_markers": (HAPS, cross_markers), "segregation_chisq": (HAPS, segregation),
}
OPS = {name: Fn(inputs, run, _CHECK[name]) for name, (inputs, run) in _RUN.items()}
