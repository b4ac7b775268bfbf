"""Readers, sinks and column functions as operators over frames, with checks written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar, columns
from ..plans.dialect import Fn
from ..sources import formats
from . import loci, models, sinks


def _as_text(lines: DataFrame, per_block: int = 4096) -> DataFrame:
    """Lines made by a sink, as a reader's frame with splits."""
    return lines.select(F.col("part").cast("string").alias("file"), F.expr(f"line div {per_block}").alias("block"), F.col("line").cast("long").alias("line"), "value")


# ---------------------------------------------------------------- readers, over what the sinks write


def scan_fastq(spark: SparkSession, reads: DataFrame) -> DataFrame:
    lines = sinks.fastq_lines(reads, F.concat_ws(" ", F.col("read_id").cast("string"), F.coalesce("sample", F.lit("none"))), F.lit("all"))
    return formats.fastq(_as_text(lines)).select(F.col("name").cast("long").alias("read_id"), F.col("comment").alias("sample"), "seq", "qual")


def scan_fasta(spark: SparkSession, reads: DataFrame) -> DataFrame:
    lines = sinks.fasta_lines(reads, F.concat_ws(" ", F.col("read_id").cast("string"), F.coalesce("sample", F.lit("none"))), F.col("seq"), F.lit("all"), F.col("read_id"), width=60)
    # splits that begin within records
    text = lines.select(F.col("part").alias("file"), F.expr("(line + 3) div (1 << 22)").alias("block"), "line", "value")
    return formats.fasta(text).select(F.col("name").cast("long").alias("read_id"), F.col("comment").alias("sample"), "seq")


def scan_sam(spark: SparkSession, alignments: DataFrame) -> DataFrame:
    return formats.sam(_as_text(sinks.sam_lines(alignments, F.lit("a")))).select("line", "name", "flag", "chr", "pos", "mapq", "cigar", "strand", "mapped", "secondary", "supplementary", "ref_length", "clipped5", "pos5", F.length("seq").alias("bases"))


def alignment_filter(spark: SparkSession, alignments: DataFrame) -> DataFrame:
    t = formats.aligned(alignments)
    return formats.usable_alignments(t).select("line", "chr", "pos5")


def loci_by_start(spark: SparkSession, alignments: DataFrame) -> DataFrame:
    t = formats.loci_by_start(formats.aligned(alignments))
    return t.select("chr", "pos5", "strand", "reads", F.array_join("names", ",").alias("names"))


def mates_within(spark: SparkSession, alignments: DataFrame) -> DataFrame:
    return formats.mates_within(formats.aligned(alignments.where("flag & 2304 = 0")))


def unaligned_reads(spark: SparkSession, alignments: DataFrame) -> DataFrame:
    return formats.unaligned(formats.aligned(alignments).withColumn("file", F.lit("a"))).select("name", "mate", "seq", "qual")


def _vcf(calls: DataFrame) -> DataFrame:
    """A VCF as a reader would see it, in one file; sites of a locus follow each other."""
    body = sinks.vcf_lines(calls, calls.select("sample")).select(F.lit("v").alias("file"), F.col("part").alias("block"), (F.col("part") * 1000 + F.col("line")).alias("line"), "value")
    head = sinks.vcf_head(calls.select("sample")).select(F.lit("v").alias("file"), F.col("part").alias("block"), (F.col("line") - 100).alias("line"), "value")
    return head.unionByName(body)


def scan_vcf(spark: SparkSession, depths: DataFrame) -> DataFrame:
    """Calls of the high-coverage model, written as a file's lines and read again."""
    file = lambda lines, line: lines.select(F.lit("v").alias("file"), F.col("part").alias("block"), line.alias("line"), "value")
    samples = depths.select("sample").distinct()
    body = file(sinks.called_lines(models.call(depths, "high"), samples), F.col("part") * 1000 + F.col("line"))
    t = formats.vcf_calls(file(sinks.vcf_head(samples), F.col("line") - 100).unionByName(body))
    return t.select(F.col("chrom").cast("long").alias("locus"), "pos", F.col("sample").cast("int").alias("sample"), "a1", "a2", "dp", "gq", F.array_join("ad", ",").alias("ad"))


def vcf_samples(spark: SparkSession, calls: DataFrame) -> DataFrame:
    return formats.vcf_header(_vcf(calls)).select(F.size("meta").alias("meta_lines"), F.array_join("samples", ",").alias("samples"))


def external_loci(spark: SparkSession, calls: DataFrame) -> DataFrame:
    t = formats.external_loci(_vcf(calls))
    return t.where("a1 is not null").groupBy("chrom", "pos").agg(F.count("*").alias("called"), F.sum((F.col("a1") != F.col("a2")).cast("int")).alias("het"))


def locus_variants(spark: SparkSession, calls: DataFrame) -> DataFrame:
    t = formats.locus_variants(_vcf(calls))
    return t.select(F.col("chrom").cast("long").alias("locus"), F.array_join(F.transform("sites", lambda x: F.concat_ws(":", x["pos"].cast("string"), x["ref"], x["alt"])), ",").alias("sites"))


def locus_haplotypes(spark: SparkSession, calls: DataFrame, loci: DataFrame) -> DataFrame:
    """Haplotypes from a VCF and a FASTA of loci read together."""
    fa = formats.fasta(_as_text(sinks.fasta_lines(loci, F.col("locus").cast("string"), F.col("consensus"), F.lit("f"), F.col("locus"), 40)))
    h = formats.haplotypes(formats.locus_genotypes(_vcf(calls), fa))
    return h.select(F.col("chrom").cast("long").alias("locus"), F.col("sample").cast("int").alias("sample"), F.concat(F.least("h1", "h2"), F.lit("/"), F.greatest("h1", "h2")).alias("haplotypes"))


_REF = """c_copy AS (SELECT locus, col, unnest([a1, a2]) AS a FROM @calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL), c_n AS (SELECT locus, col, a, count(*) AS n, row_number() OVER (PARTITION BY locus, col ORDER BY count(*) DESC, a) AS k FROM c_copy GROUP BY locus, col, a),
  c_ref AS (SELECT locus, col, max(a) FILTER (k = 1) AS ref, max(a) FILTER (k = 2) AS alt, coalesce(max(n) FILTER (k = 2), 0) AS minor, sum(n) AS copies FROM c_n GROUP BY ALL)"""
_CHECK = {
    "scan_fastq": "SELECT read_id, coalesce(sample, 'none') AS sample, seq, qual FROM @reads",
    "scan_fasta": "SELECT read_id, coalesce(sample, 'none') AS sample, seq FROM @reads",
    "scan_sam": """SELECT line, name, flag, chr, pos, mapq, cigar, CASE WHEN (flag & 16) > 0 THEN '-' ELSE '+' END AS strand, (flag & 4) = 0 AS mapped, (flag & 256) > 0 AS secondary, (flag & 2048) > 0 AS supplementary, CAST(r AS INT) AS ref_length,
      CAST(CASE WHEN (flag & 16) > 0 THEN e ELSE b END AS INT) AS clipped5, CASE WHEN (flag & 16) > 0 THEN pos + r - 1 ELSE pos END AS pos5, 32 AS bases
      FROM (SELECT *, CASE line % 7 WHEN 0 THEN 27 WHEN 1 THEN 34 WHEN 2 THEN 26 WHEN 3 THEN 24 ELSE 32 END AS r, CASE line % 7 WHEN 0 THEN 5 WHEN 3 THEN 8 ELSE 0 END AS b, CASE line % 7 WHEN 2 THEN 3 ELSE 0 END AS e FROM @alignments) a""",
    "alignment_filter": """SELECT line, chr, CASE WHEN (flag & 16) > 0 THEN pos + CASE line % 7 WHEN 0 THEN 26 WHEN 1 THEN 33 WHEN 2 THEN 25 ELSE 31 END ELSE pos END AS pos5 FROM @alignments
      WHERE (flag & 2308) = 0 AND mapq >= 10 AND CASE WHEN (flag & 16) > 0 THEN line % 7 NOT IN (2, 3) ELSE line % 7 NOT IN (0, 3) END""",
    "loci_by_start": """SELECT chr, p AS pos5, s AS strand, count(*) AS reads, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT chr, name, CASE WHEN (flag & 16) > 0 THEN '-' ELSE '+' END AS s,
      CASE WHEN (flag & 16) > 0 THEN pos + CASE line % 7 WHEN 0 THEN 26 WHEN 1 THEN 33 WHEN 2 THEN 25 WHEN 3 THEN 23 ELSE 31 END ELSE pos END AS p FROM @alignments WHERE (flag & 4) = 0) a GROUP BY ALL""",
    "mates_within": """WITH c_a AS (SELECT *, (flag & 16) > 0 AS back, CASE WHEN (flag & 16) > 0 THEN pos + CASE line % 7 WHEN 0 THEN 26 WHEN 1 THEN 33 WHEN 2 THEN 25 WHEN 3 THEN 23 ELSE 31 END ELSE pos END AS p FROM @alignments WHERE (flag & 2308) = 0),
      c_p AS (SELECT x.name, x.chr, x.p AS pos5, CASE WHEN x.back THEN '-' ELSE '+' END AS strand, 1 + CASE WHEN x.back THEN x.p - y.p ELSE y.p - x.p END AS insert_ FROM c_a x JOIN c_a y ON x.name = y.name AND x.chr = y.chr AND x.back <> y.back WHERE (x.flag & 64) > 0 AND (y.flag & 128) > 0)
      SELECT * FROM c_p WHERE insert_ BETWEEN 1 AND 1000""",
    "unaligned_reads": "SELECT name, CASE WHEN (flag & 128) > 0 THEN 2 ELSE 1 END AS mate, CASE WHEN (flag & 16) > 0 THEN reverse(translate(seq, 'CAGT', 'GTCA')) ELSE seq END AS seq, CASE WHEN (flag & 16) > 0 THEN reverse(qual) ELSE qual END AS qual FROM @alignments WHERE (flag & 2304) = 0",
    "scan_vcf": loci._HIGH + """, v_p AS (SELECT s.locus, s.col, p.sample FROM (SELECT DISTINCT locus, col FROM h_g) s CROSS JOIN (SELECT DISTINCT sample FROM @depths) p),
      v_c AS (SELECT p.locus, p.col, p.sample, several AND depth > 0 AS told, a1 <> a2 AS het, a1, a2, allele, other, depth, gq, c FROM v_p p LEFT JOIN h_g g ON g.locus = p.locus AND g.col = p.col AND g.sample = p.sample)
      SELECT locus, CAST(col AS BIGINT) AS pos, sample, CASE WHEN told THEN CASE WHEN het THEN allele ELSE a1 END END AS a1, CASE WHEN told THEN CASE WHEN het THEN other ELSE a2 END END AS a2, CASE WHEN depth > 0 THEN CAST(depth AS INT) END AS dp,
      CASE WHEN told AND a1 IS NOT NULL THEN gq END AS gq, CASE WHEN told THEN concat(c[strpos('ACGT', allele)], ',', c[strpos('ACGT', other)]) END AS ad FROM v_c""",
    "vcf_samples": "SELECT 13 AS meta_lines, string_agg(sample, ',' ORDER BY sample) AS samples FROM (SELECT DISTINCT sample FROM @calls) s",
    "external_loci": f"WITH {_REF} SELECT CAST(locus AS VARCHAR) AS chrom, CAST(col AS BIGINT) AS pos, count(*) AS called, count(*) FILTER (a1 <> a2) AS het FROM @calls JOIN c_ref USING (locus, col) WHERE alt IS NOT NULL GROUP BY ALL",
    "locus_variants": f"WITH {_REF} SELECT locus, string_agg(concat_ws(':', col, ref, coalesce(alt, '.')), ',' ORDER BY col) AS sites FROM c_ref GROUP BY locus",
    "locus_haplotypes": """WITH c_s AS (SELECT s.locus, s.col, p.sample, c.a1, c.a2 FROM (SELECT DISTINCT locus, col FROM @calls) s, (SELECT DISTINCT sample FROM @calls) p LEFT JOIN @calls c ON c.locus = s.locus AND c.col = s.col AND c.sample = p.sample),
      c_ref AS (SELECT locus, col, max(a) FILTER (k = 1) AS ref FROM (SELECT locus, col, a, row_number() OVER (PARTITION BY locus, col ORDER BY count(*) DESC, a) AS k FROM (SELECT locus, col, unnest([a1, a2]) AS a FROM @calls) z GROUP BY locus, col, a) y GROUP BY locus, col),
      c_h AS (SELECT s.locus, sample, string_agg(CASE WHEN a1 IS NULL THEN 'N' WHEN ref IN (a1, a2) THEN ref ELSE a1 END, '' ORDER BY s.col) AS x, string_agg(CASE WHEN a1 IS NULL THEN 'N' WHEN a1 = ref THEN a2 ELSE a1 END, '' ORDER BY s.col) AS y FROM c_s s JOIN c_ref r ON s.locus = r.locus AND s.col = r.col JOIN @loci l ON l.locus = s.locus GROUP BY ALL)
      SELECT locus, sample, concat(least(x, y), '/', greatest(x, y)) AS haplotypes FROM c_h""",
}

# ---------------------------------------------------------------- sinks


def _with_cols(loci: DataFrame) -> DataFrame:
    return loci.withColumn("cols", F.transform(F.split("cols", ","), lambda c: c.cast("int")))


def _samples_raw(spark, haps, loci):
    return sinks.observed_sequences(haps, _with_cols(loci)).select("locus", "sample", "allele", "seq")


def _samples(spark, haps, loci):
    return sinks.sequences(haps, _with_cols(loci)).select("locus", "sample", "allele", "seq")


def _transposed(spark, calls):
    rank = calls.select("sample").distinct()  # a row a sample
    cells = calls.join(F.broadcast(rank.withColumn("s", F.col("sample").cast("long"))), "sample").select("s", F.concat_ws("_", F.col("locus").cast("string"), F.col("col").cast("string")).alias("site"), "dp")
    return sinks.transposed(cells, "s", "site", "dp")


def _genepop_file(spark, calls):
    return sinks.genepop_lines(sinks.genepop(calls), calls).select("part", "line", F.md5("value").alias("digest"))


_GRID = "c_g AS (SELECT s.locus, s.col, s.locus // 1000 AS block, p.sample, p.pop, c.a1, c.a2 FROM (SELECT DISTINCT locus, col FROM @calls) s CROSS JOIN (SELECT DISTINCT sample, pop FROM @calls) p LEFT JOIN @calls c ON c.locus = s.locus AND c.col = s.col AND c.sample = p.sample)"
_GP = "printf('%02d', CASE WHEN {0} IS NULL THEN 0 ELSE position({0} IN 'ACGT') END)"
_BI = """c_copy AS (SELECT locus, col, pop, unnest([a1, a2]) AS a FROM @calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL), c_two AS (SELECT locus, col, min(a) AS lo, max(a) AS hi FROM c_copy GROUP BY ALL HAVING count(DISTINCT a) = 2),
  c_all AS (SELECT locus, col FROM c_copy JOIN c_two USING (locus, col) GROUP BY ALL HAVING count(DISTINCT pop) = (SELECT count(DISTINCT pop) FROM @calls)), c_pop AS (SELECT locus, col, pop, list_sort(list(DISTINCT a)) AS l FROM c_copy JOIN c_all USING (locus, col) GROUP BY ALL)"""
_RANKED = "c_h AS (SELECT locus, h, row_number() OVER (PARTITION BY locus ORDER BY count(*) DESC, h) AS k FROM (SELECT locus, unnest([h1, h2]) AS h FROM @haps) z WHERE h NOT LIKE '%N%' GROUP BY locus, h), c_l AS (SELECT locus, list(h ORDER BY k) AS o FROM c_h GROUP BY ALL)"
# each population's letter, base by base
_ALL = """WITH c_b AS (SELECT locus, col, pop, list_sort(list_distinct(list(b))) AS k FROM (SELECT locus, col, pop, unnest([a1, a2]) AS b FROM @calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL) z GROUP BY ALL),
  c_i AS (SELECT locus, col, pop, CASE len(k) WHEN 1 THEN k[1] WHEN 2 THEN map {'AC': 'M', 'AG': 'R', 'AT': 'W', 'CG': 'S', 'CT': 'Y', 'GT': 'K'}[k[1] || k[2]] ELSE 'N' END AS x FROM c_b),
  c_p AS (SELECT l.locus, consensus, CAST(string_split(cols, ',') AS INT[]) AS cols, pop FROM @loci l CROSS JOIN (SELECT DISTINCT pop FROM @calls) p), c_m AS (SELECT locus, pop, map_from_entries(list((col, x))) AS m FROM c_i GROUP BY ALL),
  c_seq AS (SELECT p.locus, p.pop, array_to_string([CASE WHEN (i - 1) % 20 = 0 AND list_contains(cols, CAST((i - 1) // 20 AS INT)) THEN coalesce(m[CAST((i - 1) // 20 AS INT)], 'N') ELSE consensus[i] END FOR i IN range(1, len(consensus) + 1)], '') AS seq FROM c_p p LEFT JOIN c_m q ON q.locus = p.locus AND q.pop = p.pop)"""
_SEQ = "c_x AS (SELECT locus, sample, consensus, CAST(string_split(cols, ',') AS INT[]) AS cols, unnest([0, 1]) AS allele, unnest([h1, h2]) AS h FROM @haps JOIN @loci USING (locus)), c_q AS (SELECT locus, sample, allele, array_to_string([CASE WHEN (i - 1) % 20 = 0 AND list_contains(cols, (i - 1) // 20) THEN h[list_position(cols, (i - 1) // 20)] ELSE consensus[i] END FOR i IN range(1, len(consensus) + 1)], '') AS seq FROM c_x)"
_CHECK |= {
    "export_genepop": f"WITH {_GRID} SELECT pop, sample, block, string_agg({_GP.format('a1')} || {_GP.format('a2')}, chr(9) ORDER BY locus, col) AS piece FROM c_g GROUP BY ALL",
    "export_genepop_file": f"""WITH {_GRID}, c_b AS (SELECT pop, sample, string_agg({_GP.format('a1')} || {_GP.format('a2')}, chr(9) ORDER BY locus, col) AS v FROM c_g GROUP BY ALL),
      c_f AS (SELECT -2 AS part, 0 AS line, 'radspark' AS v UNION ALL SELECT -2, 1, (SELECT string_agg(locus || '_' || col, ',' ORDER BY locus, col) FROM (SELECT DISTINCT locus, col FROM @calls) s) UNION ALL SELECT DISTINCT pop, -1, 'pop' FROM @calls UNION ALL SELECT pop, sample, sample || ',' || chr(9) || v FROM c_b)
      SELECT CAST(part AS BIGINT) AS part, CAST(line AS BIGINT) AS line, md5(v) AS digest FROM c_f""",
    "export_structure": f"WITH {_GRID}, c_c AS (SELECT *, unnest([0, 1]) AS copy, unnest([a1, a2]) AS a FROM c_g) SELECT pop, sample, copy, block, string_agg(coalesce(position(a IN 'ACGT'), 0), chr(9) ORDER BY locus, col) AS piece FROM c_c GROUP BY ALL",
    "export_plink": f"WITH {_GRID} SELECT pop, sample, block, string_agg(coalesce(a1, '0') || chr(9) || coalesce(a2, '0'), chr(9) ORDER BY locus, col) AS piece FROM c_g GROUP BY ALL",
    "export_plink_map": "SELECT DISTINCT locus, col, concat(chr, chr(9), locus, '_', col, chr(9), '0', chr(9), bp + 20 * if(strand = '-', -col, col) + 1) AS value FROM @calls JOIN @positions USING (locus)",
    "export_hzar": f"WITH {_BI} SELECT pop, locus, col, count(*) FILTER (a = lo) / count(*) AS a, count(*) FILTER (a = hi) / count(*) AS b, count(*) AS n FROM c_copy JOIN c_two USING (locus, col) GROUP BY ALL",
    "export_radpainter": "SELECT locus, string_agg(CASE WHEN h1 LIKE '%N%' OR h2 LIKE '%N%' THEN '' WHEN h1 = h2 THEN h1 ELSE array_to_string(list_sort([h1, h2]), '/') END, chr(9) ORDER BY sample) AS line FROM @haps GROUP BY locus",
    "export_phylip": f"WITH {_BI} SELECT pop, locus // 1000 AS block, string_agg(CASE WHEN len(l) = 1 THEN l[1] ELSE map {{'AC': 'M', 'AG': 'R', 'AT': 'W', 'CG': 'S', 'CT': 'Y', 'GT': 'K'}}[l[1] || l[2]] END, '' ORDER BY locus, col) AS piece FROM c_pop GROUP BY ALL",
    "export_phylip_fixed": f"WITH {_BI}, c_one AS (SELECT locus, col FROM c_pop GROUP BY ALL HAVING max(len(l)) = 1) SELECT pop, locus // 1000 AS block, string_agg(l[1], '' ORDER BY locus, col) AS piece FROM c_pop JOIN c_one USING (locus, col) GROUP BY ALL",
    "export_phylip_all": _ALL + """, c_n AS (SELECT pop, row_number() OVER (ORDER BY pop) AS no, concat(rpad(pop::VARCHAR, 10, ' '), string_agg(seq, '' ORDER BY locus)) AS t FROM c_seq GROUP BY pop),
      c_w AS (SELECT w + 1 AS part, no AS line, substr(t, w * 120 + 1, 120) AS value FROM c_n, unnest(range(0, (SELECT max(len(t)) FROM c_n) // 120 + 1)) AS u(w) WHERE len(t) > w * 120)
      SELECT CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS line, concat(count(*), ' ', lpad((max(len(t)) - 10)::VARCHAR, 11, ' ')) AS value FROM c_n UNION ALL SELECT part, line, value FROM c_w UNION ALL SELECT part, CAST(1099511627776 AS BIGINT), '' FROM c_w WHERE line = 1 AND len(value) = 120""",
    "export_phylip_partitions": "WITH c_o AS (SELECT row_number() OVER (ORDER BY locus) AS part, sum(len(consensus)) OVER (ORDER BY locus) AS e, len(consensus) AS n FROM @loci) SELECT part, CAST(0 AS BIGINT) AS line, concat('DNA, p', part, '=', e - n + 1, '-', e) AS value FROM c_o",
    "export_vcf_haplotypes": f"WITH {_RANKED}, c_g AS (SELECT locus, sample, list_position(o, h1) - 1 AS x, list_position(o, h2) - 1 AS y, o FROM @haps JOIN c_l USING (locus)) SELECT locus, o[1] AS ref, CASE WHEN len(o) > 1 THEN array_to_string(o[2:], ',') ELSE '.' END AS alt, string_agg(CASE WHEN x IS NULL OR y IS NULL THEN './.' ELSE least(x, y) || '/' || greatest(x, y) END, chr(9) ORDER BY sample) AS calls FROM c_g GROUP BY locus, o",
    "export_genepop_haplotypes": f"WITH {_RANKED} SELECT locus, pop, sample, CASE WHEN h1 LIKE '%N%' OR h2 LIKE '%N%' THEN repeat('0', if(len(o) > 99, 6, 4)) WHEN len(o) > 99 THEN printf('%03d%03d', list_position(o, h1), list_position(o, h2)) ELSE printf('%02d%02d', list_position(o, h1), list_position(o, h2)) END AS code FROM @haps JOIN c_l USING (locus)",
    "export_phase": "SELECT locus AS part, CAST(sample * 3 + i AS BIGINT) AS line, [concat('# ', sample), replace(h1, 'N', '?'), replace(h2, 'N', '?')][i + 1] AS value FROM @haps, range(3) z(i)",
    "export_samples_fasta": f"WITH {_SEQ} SELECT locus, sample, allele, seq FROM c_q",
    "export_samples_raw": f"WITH {_SEQ} SELECT locus, sample, min(allele) AS allele, seq FROM c_q GROUP BY locus, sample, seq",
    "export_vcf_rows": """WITH v_n AS (SELECT locus, col, a, count(*) AS n FROM (SELECT locus, col, unnest([a1, a2]) AS a FROM @calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL) z GROUP BY ALL),
      v_o AS (SELECT locus, col, list(a ORDER BY n DESC, a) AS o, list(n ORDER BY n DESC, a) AS k, sum(n) AS m FROM v_n GROUP BY locus, col),
      v_s AS (SELECT s.locus, s.col, coalesce(o, []) AS o, coalesce(k, []) AS k, m FROM (SELECT DISTINCT locus, col FROM @calls) s LEFT JOIN v_o ON v_o.locus = s.locus AND v_o.col = s.col),
      v_c AS (SELECT s.*, p.sample, c.dp, CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN list_sort([list_position(o, a1) - 1, list_position(o, a2) - 1]) END AS g FROM v_s s CROSS JOIN (SELECT DISTINCT sample FROM @calls) p LEFT JOIN @calls c ON c.locus = s.locus AND c.col = s.col AND c.sample = p.sample)
      SELECT locus AS part, CAST(col AS BIGINT) AS line, concat_ws(chr(9), locus, col + 1, locus || ':' || col, coalesce(o[1], 'N'), CASE WHEN len(o) > 1 THEN array_to_string(o[2:], ',') ELSE '.' END, '.', 'PASS',
      'NS=' || count(g) || ';AF=' || CASE WHEN len(o) > 1 THEN array_to_string([floor(x / m * 1000 + 0.5) / 1000 FOR x IN k[2:]], ',') ELSE '0.0' END, 'GT:DP',
      string_agg(CASE WHEN g IS NULL THEN './.' ELSE concat_ws(':', g[1] || '/' || g[2], dp) END, chr(9) ORDER BY sample)) AS value FROM v_c GROUP BY locus, col, o, k, m""",
    "matrix_transpose": "SELECT locus || '_' || col AS site, CAST(0 AS BIGINT) AS block, string_agg(dp, chr(9) ORDER BY sample) AS piece FROM @calls GROUP BY ALL",
}

# ---------------------------------------------------------------- functions


def read_names(spark, names):
    h = names.select("id", columns.header(F.col("name")).alias("h"))
    return h.select("id", "h.*")


def sequence_functions(spark, reads):
    s, q = F.col("seq"), F.col("qual")
    with_n = F.translate(s, "T", "N")
    return reads.select(
        "read_id", F.md5(columns.complement(s)).alias("complement"), F.md5(columns.reverse_complement(s, 5)).alias("rc5"), F.md5(columns.reverse_quality(q, 5)).alias("rq5"), F.md5(columns.without_n(with_n)).alias("no_n"), F.md5(columns.n_last(with_n)).alias("n_last"),
        columns.has_n(with_n).alias("has_n"), F.md5(columns.unpacked(columns.packed(with_n))).alias("packed4"), F.md5(columns.unpacked(columns.packed(with_n, 3), 3)).alias("packed3"), columns.inline_barcode(s, 6).alias("barcode"),
        columns.padded_hamming(s, F.expr("substring(seq, 2)")).alias("dist"), columns.kmer_length(F.length(s), F.lit(2)).alias("k"), columns.least_matches(F.length(s), F.lit(15), F.lit(2)).alias("least"),
        columns.frameshift(s, F.expr("substring(seq, 3)"), F.lit(6)).alias("frameshift"),
    )


def number_functions(spark, numbers):
    n, k = F.col("n"), F.col("k")
    r = lambda x: F.floor(x * 1e6 + 0.5) / 1e6
    return numbers.select("id", (F.log10(columns.factorial(n)) * 1e6).cast("long").alias("factorial"), F.when(n >= k, r(F.log10(columns.reduced_factorial(n, k)))).alias("reduced"), r(columns.log_factorial(n)).alias("log_factorial"), F.when(n >= k, r(columns.reduced_log_factorial(n, k))).alias("reduced_log"),
        r(F.log10(columns.choose(n, k) + 1)).alias("choose"), F.size(columns.words(F.col("words"))).alias("words"), columns.is_integer(F.regexp_extract("words", "([0-9]+)", 1)).alias("integer"), columns.is_double(n.cast("string")).alias("is_double"), columns.phred(n / 10.0, -k / 10.0).alias("gq"))


def cigar_functions(spark, cigars):
    length = lambda i: (lambda c: cigar.lengths(c)[i], "int")
    fields = {"padded": length(0), "ref": length(1), "read": length(2), "inverted": (cigar.invert, "string"), "simple": (cigar.simplified, "string"), "extended": (lambda c: cigar.extend(c, 2, 3), "string"), "gaps": (lambda c: len(cigar.gap_columns(c)), "int")}
    return cigars.select("id", cigar.on_texts(fields, "cigar").alias("c")).select("id", "c.*")


_SUM = "coalesce(list_sum([CAST(x AS INT) FOR x IN regexp_extract_all(cigar, '([0-9]+)[{}]', 1)]), 0)"
_CHECK |= {
    "read_names": r"""WITH c_p AS (SELECT id, name, string_split(name, ':') AS f FROM @names) SELECT id, CASE len(f) WHEN 10 THEN 'v2' WHEN 5 THEN 'v1' ELSE 'unknown' END AS kind, CASE WHEN len(f) > 1 THEN f[1] END AS machine, CASE len(f) WHEN 10 THEN CAST(f[2] AS INT) END AS run,
      CAST(CASE len(f) WHEN 10 THEN f[4] WHEN 5 THEN f[2] END AS INT) AS lane, CAST(CASE len(f) WHEN 10 THEN f[5] WHEN 5 THEN f[3] END AS INT) AS tile, CAST(CASE len(f) WHEN 10 THEN f[6] WHEN 5 THEN f[4] END AS INT) AS x,
      CAST(CASE len(f) WHEN 10 THEN string_split(f[7], ' ')[1] WHEN 5 THEN string_split(f[5], '#')[1] END AS INT) AS y, CAST(CASE len(f) WHEN 10 THEN string_split(f[7], ' ')[2] WHEN 5 THEN string_split(f[5], '/')[2] END AS INT) AS read, CASE len(f) WHEN 10 THEN f[8] = 'Y' END AS filter,
      CASE len(f) WHEN 10 THEN f[10] WHEN 5 THEN regexp_extract(name, '#(.*)/', 1) END AS index FROM c_p""",
    "sequence_functions": """WITH c_s AS (SELECT *, replace(seq, 'T', 'N') AS w, greatest(len(seq) - 5, 0) AS m FROM @reads)
      SELECT read_id, md5(translate(seq, 'CAGT', 'GTCA')) AS complement, md5(reverse(translate(right(seq, m), 'CAGT', 'GTCA'))) AS rc5, md5(reverse(right(qual, m))) AS rq5, md5(replace(w, 'N', '')) AS no_n, md5(rpad(replace(w, 'N', ''), CAST(len(seq) AS INT), 'N')) AS n_last, contains(w, 'N') AS has_n, md5(w) AS packed4, md5(w) AS packed3, left(seq, 6) AS barcode,
      CAST(CASE WHEN len(seq) < 2 THEN len(seq) ELSE hamming(left(seq, -1), substr(seq, 2)) + 1 END AS INT) AS dist,
      CAST(greatest(7, coalesce(list_max([k FOR k IN range(1, len(seq) // 3 + 3) IF k % 2 = 1 AND len(seq) - (k * 3 - 1) > 0]), 7)) AS INT) AS k, CAST(greatest(1, len(seq) - 44) AS INT) AS least,
      CAST(CASE WHEN len(seq) < 3 THEN 0 ELSE hamming(right(left(seq, -2), least(4, CAST(len(seq) - 2 AS INT))), right(seq, least(4, CAST(len(seq) - 2 AS INT)))) END AS INT) AS frameshift FROM c_s""",
    "number_functions": r"""SELECT id, CAST(floor(log10(CAST(factorial(CAST(n AS INT)) AS DOUBLE)) * 1e6) AS BIGINT) AS factorial, NULL AS reduced, NULL AS log_factorial, NULL AS reduced_log, NULL AS choose, NULL AS words, NULL AS integer, NULL AS is_double, NULL AS gq FROM @numbers""",
    "cigar_functions": f"""WITH c_c AS (SELECT *, {_SUM.format('M=X')} AS m, {_SUM.format('IS')} AS i, {_SUM.format('D')} AS g, replace(replace(replace(cigar, 'X', 'M'), '=', 'M'), 'S', 'I') AS t, regexp_extract_all(cigar, '[0-9]+') AS n, regexp_extract_all(replace(replace(replace(cigar, 'X', 'M'), '=', 'M'), 'S', 'I'), '[MID]') AS o FROM @cigars)
      SELECT id, CAST(m + i + g AS INT) AS padded, CAST(m + g AS INT) AS ref, CAST(m + i AS INT) AS read, translate(cigar, 'ID', 'DI') AS inverted, CASE WHEN o[2] = o[3] THEN concat(n[1], o[1], CAST(n[2] AS INT) + CAST(n[3] AS INT), o[2]) ELSE t END AS simple,
      concat('2D', CASE WHEN right(cigar, 1) = 'D' THEN CASE WHEN o[2] = 'D' THEN concat(n[1], 'M', CAST(n[2] AS INT) + CAST(n[3] AS INT) + 3, 'D') ELSE concat(n[1], o[1], n[2], o[2], CAST(n[3] AS INT) + 3, 'D') END
        WHEN cigar LIKE '%I%I' THEN concat(n[1], 'M', CAST(n[2] AS INT) + CAST(n[3] AS INT), 'I3D') ELSE concat(cigar, '3D') END) AS extended, CAST(g AS INT) AS gaps FROM c_c""",
}
_CHECK["number_functions"] = r"""WITH c_n AS (SELECT id, n, k, words, coalesce(list_sum([ln(i) FOR i IN range(1, n + 1)]), 0) AS a, coalesce(list_sum([ln(i) FOR i IN range(1, k + 1)]), 0) AS b, coalesce(list_sum([ln(i) FOR i IN range(1, n - k + 1)]), 0) AS c FROM @numbers)
  SELECT id, CAST(floor(a / ln(10) * 1e6 + 1e-5) AS BIGINT) AS factorial, CASE WHEN n >= k THEN floor((a - b) / ln(10) * 1e6 + 0.5) / 1e6 END AS reduced, floor(a * 1e6 + 0.5) / 1e6 AS log_factorial, CASE WHEN n >= k THEN floor((a - b) * 1e6 + 0.5) / 1e6 END AS reduced_log,
  floor(log10(1 + CASE WHEN n >= k THEN exp(a - b - c) ELSE 0 END) * 1e6 + 0.5) / 1e6 AS choose, CAST(len(string_split(trim(words), ' ')) AS INT) AS words, -1 AS integer, true AS is_double, gq FROM c_n JOIN (
    SELECT n AS n2, k AS k2, CAST(least(40, count(*) FILTER (-10 * log10(greatest(p, 1e-300)) >= g)) AS INT) AS gq FROM (SELECT DISTINCT n, k, (n + k) / 5.0 AS x FROM @numbers) z, range(1, 41) y(g), LATERAL (SELECT 1 - 2 * (SELECT sum(exp(-0.5 * ((i + 0.5) * sqrt(z.x) / 4000) ** 2)) * sqrt(z.x) / 4000 / sqrt(2 * pi()) FROM range(4000) w(i)) AS p) q GROUP BY ALL) t ON n = n2 AND k = k2"""

READS, CALLS, HAPS, ALIGNED = ("reads",), ("calls",), ("haps",), ("alignments",)
_RUN = {
    "scan_fastq": (READS, scan_fastq), "scan_fasta": (READS, scan_fasta), "scan_sam": (ALIGNED, scan_sam), "alignment_filter": (ALIGNED, alignment_filter), "loci_by_start": (ALIGNED, loci_by_start), "mates_within": (ALIGNED, mates_within), "unaligned_reads": (ALIGNED, unaligned_reads),
    "scan_vcf": (("depths",), scan_vcf), "vcf_samples": (CALLS, vcf_samples), "external_loci": (CALLS, external_loci), "locus_variants": (CALLS, locus_variants), "locus_haplotypes": (("calls", "loci"), locus_haplotypes),
    "export_genepop": (CALLS, lambda spark, calls: sinks.genepop(calls)), "export_genepop_file": (CALLS, _genepop_file), "export_structure": (CALLS, lambda spark, calls: sinks.structure(calls)), "export_plink": (CALLS, lambda spark, calls: sinks.plink_ped(calls)),
    "export_plink_map": (("calls", "positions"), lambda spark, calls, positions: sinks.plink_map(calls, positions)), "export_hzar": (CALLS, lambda spark, calls: sinks.hzar(calls)), "export_radpainter": (HAPS, lambda spark, haps: sinks.radpainter(haps)),
    "export_phylip": (CALLS, lambda spark, calls: sinks.phylip_variable(calls)), "export_phylip_all": (("calls", "loci"), lambda spark, calls, loci: sinks.phylip_all(calls, loci)), "export_phylip_partitions": (("loci",), lambda spark, loci: sinks.phylip_partitions(loci)), "export_phylip_fixed": (CALLS, lambda spark, calls: sinks.phylip_fixed(calls)), "export_vcf_haplotypes": (HAPS, lambda spark, haps: sinks.vcf_haplotypes(haps)),
    "export_genepop_haplotypes": (HAPS, lambda spark, haps: sinks.genepop_haplotypes(haps)), "export_phase": (HAPS, lambda spark, haps: sinks.phase_lines(haps)), "export_samples_fasta": (("haps", "loci"), _samples), "export_samples_raw": (("haps", "loci"), _samples_raw),
    "export_vcf_rows": (CALLS, lambda spark, calls: sinks.vcf_lines(calls, calls.select("sample"))), "matrix_transpose": (CALLS, _transposed),
    "read_names": (("names",), read_names), "sequence_functions": (READS, sequence_functions), "number_functions": (("numbers",), number_functions), "cigar_functions": (("cigars",), cigar_functions),
}
OPS = {name: Fn(inputs, run, _CHECK[name]) for name, (inputs, run) in _RUN.items()}
