"""Reads, loci and catalog tables: cleaning, duplicates, k-mers, grouping, similarity joins, lookups."""

from __future__ import annotations

from ..plans.dialect import Op

READS = ("reads",)
CODES = ("ACGTAC", "TTGACA", "GGCATT", "CATGCA", "GTACCA")


def clone_filter(d):
    """One read a sequence and sample: the first by id."""
    return {"k": "SELECT r.*, row_number() OVER (PARTITION BY sample, seq ORDER BY read_id) AS k FROM @reads r"}, "SELECT read_id, sample, seq FROM k WHERE k = 1"


def clone_dist(d):
    return {"c": "SELECT sample, seq, count(*) AS clones FROM @reads GROUP BY sample, seq"}, "SELECT clones, count(*) AS n FROM c GROUP BY clones"


def oligo_dedup(d):
    """Duplicates are reads of equal sequence and equal random oligo, here the first 8 quality characters."""
    return {}, "SELECT substring(qual, 1, 8) AS oligo, seq, min(read_id) AS read_id, count(*) AS copies FROM @reads GROUP BY substring(qual, 1, 8), seq"


def revcomp(d):
    return {}, "SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM @reads"


def group_reads(d):
    """Identical reads of a sample; 3 or more make a primary stack, the others are secondary."""
    return {"c": "SELECT sample, seq, count(*) AS n, min(read_id) AS first_read FROM @reads GROUP BY sample, seq"}, "SELECT sample, seq, n, first_read, CASE WHEN n >= 3 THEN 'primary' ELSE 'secondary' END AS stack FROM c"


def coverage_stats(d):
    """Depth of a sample's piles; the deviation is that of all of them."""
    return {"c": "SELECT sample, seq, count(*) AS n FROM @reads GROUP BY sample, seq"}, f"SELECT sample, count(*) AS piles, max(n) AS max_depth, sum(n) AS depth, {d.r('avg(1E0 * n)')} AS mean_depth, {d.r('sqrt(greatest(0E0, sum(n * n) / (1E0 * count(*)) - avg(1E0 * n) * avg(1E0 * n)))', 5)} AS sd FROM c GROUP BY sample"


_CHECK_COVERAGE = f"WITH c_c AS (SELECT sample, seq, count(*) AS n FROM @reads GROUP BY ALL) SELECT sample, count(*) AS piles, max(n) AS max_depth, CAST(sum(n) AS BIGINT) AS depth, floor(avg(n) * 1e9 + 0.5) / 1e9 AS mean_depth, floor(stddev_pop(n) * 1e5 + 0.5) / 1e5 AS sd FROM c_c GROUP BY sample"


def exact_match_join(d):
    """Reads matched to the catalog of sequences that two samples or more hold; several reads of a locus, one row."""
    return {"cat": "SELECT seq, min(read_id) AS cat_id FROM @reads GROUP BY seq HAVING count(DISTINCT sample) > 1"}, "SELECT c.cat_id, r.sample, count(*) AS depth, min(r.read_id) AS first_read FROM @reads r JOIN cat c ON r.seq = c.seq GROUP BY c.cat_id, r.sample"


def unmatched_reads(d):
    return {"cat": "SELECT seq FROM @reads GROUP BY seq HAVING count(DISTINCT sample) > 1"}, "SELECT r.read_id, r.sample FROM @reads r LEFT JOIN cat c ON r.seq = c.seq WHERE c.seq IS NULL"


def mates_of(d) -> str:
    return "SELECT a.conv_id, a.turn, a.role, a.seq AS seq1, b.seq AS seq2 FROM @mates a JOIN @mates b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0"


def mate_join(d):
    return {}, "SELECT a.conv_id, a.turn, a.seq AS forward, b.seq AS reverse_ FROM @mates a JOIN @mates b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0"


def clone_pairs(d, oligo=8):
    """Pairs by both sequences and a random oligo of each (its first letters): the first pair of each, and how many there are."""
    return {"p": mates_of(d)}, f"SELECT md5(concat(seq1, '|', seq2)) AS pair, substring(seq1, 1, {oligo}) AS oligo1, substring(seq2, 1, {oligo}) AS oligo2, min(conv_id * 1000 + turn) AS first_pair, count(*) AS copies FROM p GROUP BY seq1, seq2"


_CHECK_CLONE_PAIRS = "WITH c_m AS (SELECT *, lead(seq) OVER w AS s2, lead(turn) OVER w AS t2 FROM @mates WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT md5(seq || '|' || s2) AS pair, left(seq, 8) AS oligo1, left(s2, 8) AS oligo2, min(conv_id * 1000 + turn) AS first_pair, count(*) AS copies FROM c_m WHERE turn % 2 = 0 AND t2 = turn + 1 GROUP BY seq, s2"


def catalog_index(d):
    return {}, f"SELECT c.chr, c.marker, count(*) AS loci, sum(c.n_snps) AS snps, count(a.note) AS annotated, {d.r('avg(c.lnl)', 4)} AS mean_lnl FROM @catalog c LEFT JOIN @annotations a ON c.locus = a.locus GROUP BY c.chr, c.marker"


def catalog_page(d):
    """A page of the filtered catalog: 20 loci from the 41st on."""
    return {}, "SELECT locus, chr, bp, marker, n_snps FROM @catalog WHERE n_snps BETWEEN 5 AND 40 AND chr IN (1, 2, 3) ORDER BY chr, bp, locus LIMIT 20 OFFSET 40"


def whitelist(d):
    return {}, "SELECT c.locus, c.chr, c.bp FROM @catalog c WHERE c.locus IN (SELECT locus FROM @annotations)"


def blacklist(d):
    return {}, "SELECT c.locus, c.chr, c.bp FROM @catalog c WHERE NOT EXISTS (SELECT 1 FROM @annotations a WHERE a.locus = c.locus)"


def catalog_count(d):
    return {}, "SELECT count(*) AS loci FROM @catalog WHERE n_snps BETWEEN 5 AND 40 AND chr IN (1, 2, 3)"


# Checks written apart from the texts above.
_CHECK_CLONES = "SELECT min(read_id) AS read_id, sample, seq FROM @reads GROUP BY sample, seq"
_CHECK_DIST = "SELECT clones, count(*) AS n FROM (SELECT count(*) AS clones FROM @reads GROUP BY sample, seq) z GROUP BY clones"
_CHECK_OLIGO = "SELECT left(qual, 8) AS oligo, seq, min(read_id) AS read_id, count(*) AS copies FROM @reads GROUP BY ALL"
_CHECK_RC = "SELECT read_id, translate(reverse(seq), 'CAGT', 'GTCA') AS rc FROM @reads"
_CHECK_GROUPS = "SELECT sample, seq, count(*) AS n, min(read_id) AS first_read, if(count(*) < 3, 'secondary', 'primary') AS stack FROM @reads GROUP BY ALL"
_CHECK_EXACT = "WITH c_r AS (SELECT *, min(read_id) OVER (PARTITION BY seq) AS cat_id, min(sample) OVER (PARTITION BY seq) <> max(sample) OVER (PARTITION BY seq) AS shared FROM @reads) SELECT cat_id, sample, count(*) AS depth, min(read_id) AS first_read FROM c_r WHERE shared GROUP BY ALL"
_CHECK_UNMATCHED = "WITH c_r AS (SELECT read_id, sample, min(sample) OVER (PARTITION BY seq) <> max(sample) OVER (PARTITION BY seq) AS shared FROM @reads) SELECT read_id, sample FROM c_r WHERE shared IS NOT TRUE"
_CHECK_MATES = "WITH c_m AS (SELECT *, lead(seq) OVER w AS s2, lead(turn) OVER w AS t2 FROM @mates WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, seq AS forward, s2 AS reverse_ FROM c_m WHERE turn % 2 = 0 AND t2 = turn + 1"
_CHECK_INDEX = "SELECT chr, marker, count(*) AS loci, sum(n_snps) AS snps, count(*) FILTER (locus IN (SELECT locus FROM @annotations)) AS annotated, floor(avg(lnl) * 1e4 + 0.5) / 1e4 AS mean_lnl FROM @catalog GROUP BY ALL"

_READS = {"clone_filter": (clone_filter, _CHECK_CLONES), "clone_dist": (clone_dist, _CHECK_DIST), "oligo_dedup": (oligo_dedup, _CHECK_OLIGO), "revcomp": (revcomp, _CHECK_RC), "group_reads": (group_reads, _CHECK_GROUPS), "coverage_stats": (coverage_stats, _CHECK_COVERAGE),
    "exact_match_join": (exact_match_join, _CHECK_EXACT), "unmatched_reads": (unmatched_reads, _CHECK_UNMATCHED)}
OPS = {k: Op(READS, f, check) for k, (f, check) in _READS.items()} | {
    "mate_join": Op(("mates",), mate_join, _CHECK_MATES), "clone_filter_pairs": Op(("mates",), clone_pairs, _CHECK_CLONE_PAIRS),
    "catalog_index": Op(("catalog", "annotations"), catalog_index, _CHECK_INDEX), "catalog_filter_page": Op(("catalog",), catalog_page), "catalog_filter_count": Op(("catalog",), catalog_count), "whitelist_semi": Op(("catalog", "annotations"), whitelist), "blacklist_anti": Op(("catalog", "annotations"), blacklist),
}
