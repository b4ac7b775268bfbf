"""Genetic crosses: marker types from two parents, genotype letters, their translations, and expected segregation."""

from __future__ import annotations

# Marker type, as the map formats spell it.
MAP_TYPES = {
    "cp": {"ab/--": "ab/--", "--/ab": "--/ab", "ab/aa": "ab/aa", "aa/ab": "aa/ab", "ab/a-": "ab/--", "-a/ab": "--/ab", "ab/c-": "ab/cd", "-c/ab": "ab/cd", "ab/cc": "ab/--", "cc/ab": "--/ab", "ab/ab": "ab/ab", "ab/ac": "ab/ac", "ab/cd": "ab/cd", "-a/bb": "ab/--", "aa/b-": "--/ab"},
    "joinmap_cp": {"ab/--": "lmx--", "--/ab": "--xnp", "ab/aa": "lmxll", "aa/ab": "nnxnp", "ab/ab": "hkxhk", "ab/ac": "efxeg", "ab/cd": "abxcd"},
    "onemap_cp": {"ab/--": "abxoo", "--/ab": "ooxab", "ab/aa": "abxaa", "aa/ab": "aaxab", "ab/ab": "abxab", "ab/ac": "abxac", "ab/cd": "abxcd"},
    "bc1": {"aa/bb": "aaxbb", "bb/aa": "bbxaa", "ab/cc": "abxcc", "cc/ab": "ccxab"},
    "f2": {"aa/bb": "aaxbb", "ab/cd": "abxcd", "ab/aa": "abxaa", "aa/ab": "aaxab", "ab/cc": "abxcc", "cc/ab": "ccxab"},
    "dh": {"ab/--": "ab/--", "--/ab": "--/ab"},
}
# Expected shares of genotypes by map and marker type.
SEGREGATION = {
    "cp": {"ab/--": {"aa": 0.5, "ab": 0.5}, "--/ab": {"aa": 0.5, "ab": 0.5}, "ab/aa": {"aa": 0.5, "ab": 0.5}, "aa/ab": {"aa": 0.5, "ab": 0.5}, "ab/ab": {"ab": 0.5, "aa": 0.25, "bb": 0.25}, "ab/ac": {"ab": 0.25, "ac": 0.25, "bc": 0.25, "aa": 0.25}, "ab/cd": {"ac": 0.25, "ad": 0.25, "bc": 0.25, "bd": 0.25}},
    "f2": {"aaxbb": {"a": 0.25, "b": 0.25, "h": 0.5}, "abxcd": {"a": 0.25, "b": 0.25, "h": 0.5}, "abxaa": {"a": 1.0}, "aaxab": {"b": 1.0}, "abxcc": {"a": 0.5, "b": 0.5}, "ccxab": {"b": 0.5, "a": 0.5}},
    "bc1": {"aaxbb": {"h": 0.5, "b": 0.5}, "bbxaa": {"h": 0.5, "a": 0.5}, "abxcc": {"h": 0.5, "b": 0.5}, "ccxab": {"h": 0.5, "a": 0.5}},
    "dh": {"ab/--": {"a": 0.5, "b": 0.5}, "--/ab": {"a": 0.5, "b": 0.5}},
}


def marker_type(mother: frozenset[str] | None, father: frozenset[str] | None) -> str | None:
    """The cross of two parents by their haplotypes (one or two each; None where unknown); None for what is no marker."""
    if not mother or not father:
        known = mother or father
        if not known or len(known) != 2:
            return None
        return "ab/--" if mother else "--/ab"
    shared, n = len(mother & father), (len(mother), len(father))
    if n == (1, 1):
        return "aa/bb" if not shared else None
    if n == (2, 2):
        return {0: "ab/cd", 1: "ab/ac", 2: "ab/ab"}[shared]
    if n == (2, 1):
        return "ab/aa" if shared else "ab/cc"
    return "aa/ab" if shared else "cc/ab"


def letters(mother: frozenset[str], father: frozenset[str]) -> dict[str, str]:
    """Letters of the parents' haplotypes: shared ones take the first letters both parents' type has, then each parent's rest its own rest, in order."""
    kind = marker_type(mother, father)
    if kind is None:
        return {}
    one, two = (list(dict.fromkeys(c for c in side if c != "-")) for side in kind.split("/"))
    both = [c for c in one if c in two]
    out = dict(zip(sorted(mother & father), both, strict=False))
    for own, side in ((mother, one), (father, two)):
        free = [c for c in side if c not in out.values()]
        out |= dict(zip(sorted(h for h in own if h not in out), free, strict=False))
    return out


def genotype(h1: str, h2: str, names: dict[str, str]) -> str:
    """Sorted letters of two haplotypes, - for what has no letter."""
    if h1 not in names or h2 not in names:
        return "--"
    return "".join(sorted(names[h1] + names[h2]))


def translated(kind: str, map_type: str, call: str) -> str:
    """A genotype of a cross as a map type codes it: CP keeps letters, the three-way types a, b, h (heterozygous) or - ."""
    if call == "--":
        return "-" if map_type != "cp" else "--"
    if map_type == "cp":
        want = SEGREGATION["cp"].get(MAP_TYPES["cp"].get(kind, ""), {})
        return call if call in want else "--"
    marker = MAP_TYPES[map_type].get(kind)
    code = "h" if call[0] != call[1] else call[0]
    return code if marker and code in SEGREGATION[map_type].get(marker, {}) else "-"


def segregation_chisq(counts: dict[str, int], expected: dict[str, float]) -> tuple[float, int]:
    """Sum of (o - e)^2 / e over the expected classes, and the degrees of freedom."""
    n = sum(counts.get(g, 0) for g in expected)
    if not n:
        return 0.0, max(0, len(expected) - 1)
    return sum((counts.get(g, 0) - n * e) ** 2 / (n * e) for g, e in expected.items()), len(expected) - 1


# Critical values of chi-square by degrees of freedom.
CRITICAL = {1: ((0.1, 2.71), (0.05, 3.84), (0.01, 6.63), (0.001, 10.83)), 2: ((0.1, 4.61), (0.05, 5.99), (0.01, 9.21), (0.001, 13.82)), 3: ((0.1, 6.25), (0.05, 7.81), (0.01, 11.34), (0.001, 16.27))}


def chisq_p(x: float, df: int) -> float:
    """The least listed level whose critical value x reaches; 1 where it reaches none."""
    return min([1.0] + [p for p, c in CRITICAL.get(df, ()) if x >= c])
