"""Restriction enzymes: what a cut leaves at the start of a read, on either strand."""

from __future__ import annotations

from itertools import product

# Remnants by enzyme, in nucleotide codes.
REMNANTS = {
    "sbfI": "TGCAGG", "pstI": "TGCAG", "notI": "GGCCGC", "ecoRI": "AATTC", "nspI": "CATGR", "sgrAI": "CCGGYG", "apeKI": "CWGC", "hindIII": "AGCTT", "haeIII": "CC", "dpnII": "GATC",
    "sphI": "CATGC", "nlaIII": "CATG", "mluCI": "AATT", "ecoT22I": "TGCAT", "ndeI": "TATG", "nsiI": "TGCAT", "mseI": "TAA", "mslI": "NNRTG", "mspI": "CGG", "sexAI": "CCWGGT",
    "sau3AI": "GATC", "bamHI": "GATCC", "xbaI": "CTAGA", "eaeI": "GGCCR", "taqI": "CGA", "claI": "CGAT", "cac8I": "NGC", "nheI": "CTAGC", "speI": "CTAGT", "apoI": "AATTY",
    "bstYI": "GATCY", "xhoI": "TCGAG", "sacI": "AGCTC", "bgIII": "GATCT", "ecoRV": "ATC", "kpnI": "GTACC", "ddeI": "TNAG", "aluI": "CT", "ageI": "CCGGT", "rsaI": "AC",
    "aciI": "CGS", "bfaI": "TAG", "bfuCI": "GATC", "aseI": "TAAT", "bspDI": "CGAT", "csp6I": "TAC", "bsaHI": "CGYC", "hpaII": "CGG", "ncoI": "CATGG", "apaLI": "TGCAC",
    "hinP1I": "CGC", "bbvCI": "TCAGC",
}
# Where the other strand's remnants are not the reverse complements, or a second remnant is known.
REVERSE = {"nspI": ("GCATG", "ACATG"), "apeKI": ("GTCG", "GACG"), "hindIII": ("TCGAA",), "aciI": ("GCG", "CCG"), "bbvCI": ("GCTGA", "ACTCC")}
FORWARD = {"bbvCI": ("TCAGC", "GGAGT")}
# Bases by which the ends of a cut overlap.
OVERLAP = {"sbfI": 4}
_CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "W": "AT", "S": "CG", "N": "ACGT"}


def reverse_complement(seq: str) -> str:
    return seq[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def spelled(code: str) -> tuple[str, ...]:
    return tuple("".join(x) for x in product(*(_CODES[c] for c in code)))


def sites(enzyme: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Remnants at the start of forward reads, and of the other strand."""
    if enzyme not in REMNANTS:
        raise ValueError(f"unknown enzyme {enzyme!r}; known: {', '.join(sorted(REMNANTS))}")
    forward = FORWARD.get(enzyme, spelled(REMNANTS[enzyme]))
    return forward, REVERSE.get(enzyme, tuple(reverse_complement(x) for x in forward))


def site_length(enzyme: str) -> int:
    return len(REMNANTS[enzyme])
