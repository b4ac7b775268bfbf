"""Rows of export formats that plain SQL says, one text row each; sinks.py has the others."""

from __future__ import annotations

from ..plans.dialect import Op

CALLS = ("calls",)


def treemix(d):
    """Counts of both alleles of each population at biallelic sites, 0,0 where it has none."""
    called = "a1 IS NOT NULL AND a2 IS NOT NULL"
    long = f"SELECT locus, col, pop, a1 AS a FROM @calls WHERE {called} UNION ALL SELECT locus, col, pop, a2 FROM @calls WHERE {called}"
    return {
        "pops": "SELECT DISTINCT pop FROM @calls",
        "m": f"SELECT locus, col, min(a) AS x FROM ({long}) l GROUP BY locus, col HAVING count(DISTINCT a) = 2",
        "n": f"SELECT l.locus, l.col, l.pop, sum(CASE WHEN l.a = m.x THEN 1 ELSE 0 END) AS nx, sum(CASE WHEN l.a <> m.x THEN 1 ELSE 0 END) AS ny FROM ({long}) l JOIN m ON l.locus = m.locus AND l.col = m.col GROUP BY l.locus, l.col, l.pop",
        "every": "SELECT m.locus, m.col, p.pop, coalesce(n.nx, 0) AS nx, coalesce(n.ny, 0) AS ny FROM m CROSS JOIN pops p LEFT JOIN n ON n.locus = m.locus AND n.col = m.col AND n.pop = p.pop",
    }, f"SELECT locus, col, {d.cat('concat(cast(nx as varchar(10)), chr(44), cast(ny as varchar(10)))', ' ', 'pop')} AS line FROM every GROUP BY locus, col"


def haplotype_matrix(d):
    """A line a locus, a cell a sample: its haplotypes, - where a site is uncalled."""
    cell = "CASE WHEN position('N' IN concat(h1, h2)) > 0 THEN '-' WHEN h1 = h2 THEN h1 ELSE concat(least(h1, h2), chr(47), greatest(h1, h2)) END"
    return {}, f"SELECT locus, count(*) AS samples, {d.cat(cell, chr(9), 'sample')} AS line FROM @haps GROUP BY locus"


_CHECK_TREEMIX = """WITH c_copy AS (SELECT locus, col, pop, unnest([a1, a2]) AS a FROM @calls WHERE a1 IS NOT NULL AND a2 IS NOT NULL), c_two AS (SELECT locus, col, min(a) AS lo FROM c_copy GROUP BY ALL HAVING count(DISTINCT a) = 2),
  c_n AS (SELECT locus, col, p.pop, (SELECT count(*) FILTER (a = lo) || ',' || count(*) FILTER (a <> lo) FROM c_copy c WHERE c.locus = t.locus AND c.col = t.col AND c.pop = p.pop) AS v FROM c_two t CROSS JOIN (SELECT DISTINCT pop FROM @calls) p)
  SELECT locus, col, string_agg(v, ' ' ORDER BY pop) AS line FROM c_n GROUP BY ALL"""
_CHECK_MATRIX = "SELECT locus, count(*) AS samples, string_agg(CASE WHEN contains(h1 || h2, 'N') THEN '-' WHEN h1 = h2 THEN h1 ELSE array_to_string(list_sort([h1, h2]), '/') END, chr(9) ORDER BY sample) AS line FROM @haps GROUP BY locus"

OPS = {"export_treemix": Op(CALLS, treemix, _CHECK_TREEMIX), "haplotype_matrix": Op(("haps",), haplotype_matrix, _CHECK_MATRIX)}
