"""All queries of the engine and the SQL that says what they must return."""

from __future__ import annotations

from collections.abc import Callable

from .operators import catalogs, crosses, details, export, files, genotyping, linkage, loci, popgen, populations, pruning, reads, storage
from .plans.dialect import CHECK, Fn, Op
from .sources import encodings

OPS: dict[str, Op | Fn] = popgen.OPS | reads.OPS | export.OPS | files.OPS | loci.OPS | populations.OPS | storage.OPS | details.OPS | catalogs.OPS | linkage.OPS | genotyping.OPS | crosses.OPS | pruning.OPS


def _query(op: Op | Fn) -> Callable:
    return lambda spark, sf_dir: op(spark, **{name: encodings.load(spark, sf_dir, name) for name in op.inputs})


def queries() -> dict[str, Callable]:
    return {name: _query(op) for name, op in OPS.items()}


def oracle_sql() -> dict[str, str]:
    every = encodings.encodings(CHECK)
    sql = {name: op.check_sql({i: every[i] for i in op.inputs}) for name, op in OPS.items()}
    return {name: text for name, text in sql.items() if text}
