"""Genomic inputs made from the star-schema tables, the same in both engines.

popmap(sample, pop, grp); calls(locus, col, sample, pop, a1, a2, dp): genotypes of up to four sites a locus;
depths(locus, col, sample, pop, na, nc, ng, nt): read counts of the bases there, with some errors;
haps(locus, sample, pop, grp, h1, h2): a letter for each site of the locus, N where the sample has no call;
positions(locus, chr, bp, strand): loci that overlap their neighbours; sites(chr, bp, stat, alleles, fixed, pop), stat -7 where
there is none; reads(read_id, sample, seq, qual): all letters of a text, with a quality character each; mates(conv_id, turn, role,
seq): the letters of a turn; loci(locus, consensus, cols), alignments, names, numbers, cigars: inputs of the readers and functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.dialect import SPARK, Dialect

TABLES = {"popmap": ("supplier",), "calls": ("lineitem",), "depths": ("lineitem",), "haps": ("lineitem",), "positions": ("lineitem",), "loci": ("lineitem",), "alignments": ("customer",), "names": ("customer",), "piles": ("customer",), "bases": ("lineitem",), "numbers": ("part",), "cigars": ("lineitem",), "sites": ("events",), "reads": ("documents",), "mates": ("conversations",), "barcodes": ("customer",), "catalog": ("part",), "annotations": ("supplier",)}


def _alt(d: Dialect, j: int) -> str:
    return f"(lo * 31 + s * 17 + {j} * 7919 + {d.div('mo', '7')} * {j + 3} + lo * s * {j + 1}) % 10 < 2 + 2 * (s % 3)"


def encodings(d: Dialect) -> dict[str, str]:
    letter = lambda n: f"substring('ACGT', cast({n} as int), 1)"
    base = "SELECT l_partkey AS lo, l_suppkey % 12 AS s, min(l_orderkey) AS mo, count(*) AS dp FROM @lineitem GROUP BY l_partkey, l_suppkey % 12"
    calls = f"""SELECT {d.div('lo', '4')} AS locus, cast(lo % 4 as int) AS col, cast(s as int) AS sample, cast(s % 3 as int) AS pop,
      CASE WHEN {_alt(d, 1)} THEN {letter('(lo + 1) % 4 + 1')} ELSE {letter('lo % 4 + 1')} END AS a1,
      CASE WHEN {_alt(d, 2)} THEN {letter('(lo + 1) % 4 + 1')} ELSE {letter('lo % 4 + 1')} END AS a2, cast(dp as int) AS dp
      FROM ({base}) b"""
    depth = lambda x: f"CASE WHEN a1 = '{x}' THEN dp - {d.div('dp', '2')} ELSE 0 END + CASE WHEN a2 = '{x}' THEN {d.div('dp', '2')} ELSE 0 END + CASE WHEN (locus + 3 * col + sample) % 28 = {'ACGT'.index(x)} THEN 1 ELSE 0 END AS n{x.lower()}"
    seq = d.replace_all("lower(text)", "[^a-z]", "")
    seq = f"translate({seq}, 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
    reads = f"SELECT doc_id AS read_id, source AS sample, {seq} AS seq, concat(md5(text), md5(concat(text, 'q'))) AS q FROM @documents"
    return {
        "popmap": "SELECT cast(s_suppkey % 12 as int) AS sample, cast(min(s_suppkey % 3) as int) AS pop, cast(min(s_suppkey % 3 % 2) as int) AS grp FROM @supplier GROUP BY s_suppkey % 12",
        "calls": calls,
        "depths": f"SELECT locus, col, sample, pop, {', '.join(depth(x) for x in 'ACGT')} FROM ({calls}) c",
        "haps": f"""SELECT g.locus, g.sample, g.pop, g.pop % 2 AS grp, {d.cat("coalesce(c.a1, 'N')", '', 's.col')} AS h1, {d.cat("coalesce(c.a2, 'N')", '', 's.col')} AS h2
          FROM (SELECT DISTINCT locus, sample, pop FROM ({calls}) c) g JOIN (SELECT DISTINCT locus, col FROM ({calls}) c) s ON g.locus = s.locus
          LEFT JOIN ({calls}) c ON c.locus = s.locus AND c.col = s.col AND c.sample = g.sample GROUP BY g.locus, g.sample, g.pop""",
        "positions": f"SELECT DISTINCT {d.div('l_partkey', '4')} AS locus, cast({d.div('l_partkey', '4')} % 5 as int) AS chr, {d.div(d.div('l_partkey', '4'), '5')} * 40 + 100 AS bp, CASE WHEN {d.div('l_partkey', '4')} % 3 = 0 THEN '-' ELSE '+' END AS strand FROM @lineitem",
        "sites": f"""SELECT cast(user_id % 5 as int) AS chr, cast(user_id % 3 as int) AS pop, {"unix_timestamp(ts)" if d.spark else "CAST(floor(epoch(ts)) AS BIGINT)"} AS bp, CASE WHEN event_id % 13 = 0 THEN -7E0 ELSE value END AS stat,
          event_id % 11 = 0 AS fixed, cast(2 + event_id % 9 as int) AS alleles, event_id FROM @events""",
        "loci": f"SELECT locus, translate(concat(md5(cast(locus as varchar(20))), md5(concat('l', cast(locus as varchar(20)))), md5(concat('m', cast(locus as varchar(20))))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS consensus, {d.cat('cast(col as varchar(9))', ',', 'col')} AS cols FROM (SELECT DISTINCT locus, col FROM ({calls}) c) s GROUP BY locus",
        "alignments": f"""SELECT name, line, flag, chr, pos, mapq, seq, qual, CASE WHEN line % 7 = 0 THEN '5S27M' WHEN line % 7 = 1 THEN '20M2D12M' WHEN line % 7 = 2 THEN '10M3I16M3S' WHEN line % 7 = 3 THEN '8S24M' ELSE '32M' END AS cigar
          FROM (SELECT concat('r', cast({d.div('c_custkey', '2')} as varchar(20))) AS name, c_custkey AS line, cast(CASE WHEN c_custkey % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN {d.div('c_custkey', '2')} % 3 = c_custkey % 2 THEN 16 ELSE 0 END
            + CASE WHEN c_custkey % 11 = 0 THEN 4 ELSE 0 END + CASE WHEN c_custkey % 13 = 0 THEN 256 ELSE 0 END + CASE WHEN c_custkey % 17 = 0 THEN 2048 ELSE 0 END AS int) AS flag, concat('chr', cast({d.div('c_custkey', '2')} % 5 as varchar(9))) AS chr,
            {d.div('c_custkey', '4')} * 40 + c_custkey % 2 * 300 AS pos, cast(c_nationkey * 2 as int) AS mapq, translate(md5(c_name), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, md5(c_name) AS qual FROM @customer) c""",
        "names": f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN concat('M', cast(c_nationkey as varchar(9)), ':', cast(c_custkey as varchar(20)), ':FC:', cast(c_custkey % 8 as varchar(9)), ':11:', cast(c_custkey * 3 as varchar(20)), ':', cast(c_custkey * 5 as varchar(20)), ' ', cast(1 + c_custkey % 2 as varchar(9)), ':', CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END, ':0:ACGT')
          WHEN c_custkey % 3 = 1 THEN concat('H', cast(c_nationkey as varchar(9)), ':', cast(c_custkey % 8 as varchar(9)), ':12:', cast(c_custkey as varchar(20)), ':7#GG/', cast(1 + c_custkey % 2 as varchar(9))) ELSE c_name END AS name FROM @customer""",
        "piles": f"""SELECT stack, cast(g % 3 as int) AS sample, g, v, depth, CASE WHEN v = 0 THEN b ELSE concat(substring(b, 1, cast(spot - 1 as int)), translate(substring(b, cast(spot as int), 1), 'ACGT', 'CGTA'), substring(b, cast(spot + 1 as int), 64)) END AS seq
          FROM (SELECT c_custkey AS stack, {d.div('c_custkey', '4')} AS g, cast(c_custkey % 4 as int) AS v, 10 * (c_custkey % 4) + {d.div('c_custkey', '4')} % 7 AS spot, c_nationkey % 9 + 1 + CASE WHEN c_custkey % 97 = 0 THEN 500 ELSE 0 END AS depth,
            translate(concat(md5(cast({d.div('c_custkey', '4')} as varchar(20))), md5(concat('s', cast({d.div('c_custkey', '4')} as varchar(20))))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS b FROM @customer) c""",
        "bases": f"""SELECT c.locus, c.sample, c.col, c.a1, c.a2, r.read, CASE WHEN r.read % 2 = 0 THEN c.a1 ELSE c.a2 END AS base FROM ({calls}) c JOIN (SELECT 0 AS read UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) r ON r.read >= c.col - 1 AND r.read <= c.col + 2""",
        "numbers": "SELECT p_partkey AS id, cast(p_size as int) AS n, cast(p_partkey % 30 as int) AS k, p_type AS words FROM @part",
        "cigars": f"""SELECT l_orderkey * 8 + l_linenumber AS id, concat(cast(cast(l_quantity as int) as varchar(9)), 'M', cast(l_linenumber as varchar(9)), CASE WHEN l_orderkey % 2 = 0 THEN 'I' ELSE 'D' END, cast(l_suppkey % 9 + 1 as varchar(9)), CASE l_orderkey % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'S' WHEN 2 THEN '=' WHEN 3 THEN 'X' ELSE 'I' END) AS cigar FROM @lineitem""",
        "reads": f"SELECT read_id, sample, seq, substring(repeat(q, cast({d.div('length(seq)', '64')} + 1 as int)), 1, length(seq)) AS qual FROM ({reads}) t",
        "mates": f"SELECT conv_id, turn, role, {seq} AS seq FROM @conversations",
        "barcodes": "SELECT c_custkey AS read_id, substring(translate(md5(cast(c_custkey as varchar(20))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 6) AS observed, c_mktsegment AS sample FROM @customer",
        "catalog": "SELECT p_partkey AS locus, cast(p_partkey % 5 as int) AS chr, p_partkey * 37 AS bp, p_brand AS marker, p_size AS n_snps, p_retailprice AS lnl FROM @part",
        "annotations": "SELECT s_suppkey * 3 AS locus, s_name AS note FROM @supplier",
    }


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    sql = encodings(SPARK)[name]
    for t in tables:
        sql = sql.replace(f"@{t}", f"{{{t}}}")
    return spark.sql(sql, **tables)
