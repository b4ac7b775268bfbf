"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import codes, decontam, jaccard, langid, mixing, neighbours, packing, pii, sharding, substrings, suffixes, toxicity, whitening

_MODULES = (langid, substrings, decontam, mixing, suffixes, neighbours, toxicity, sharding, pii, jaccard, codes, whitening, packing)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
