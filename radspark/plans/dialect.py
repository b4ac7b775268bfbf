"""Operators as relational SQL over named inputs, for Spark and, word for word or nearly, for the checking engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Dialect:
    """What differs between the two engines; `spark` says which one a text is for."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def r(self, x: str, digits: int = 9) -> str:
        """Rounded with the same arithmetic in both engines; at 9 digits quotients of small counts are not half way between two."""
        return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"

    def cat(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})" if self.spark else f"string_agg({x}, '{sep}' ORDER BY {order})"

    def lnfact(self, n: str) -> str:
        if self.spark:
            return f"aggregate(sequence(0, cast({n} as int)), 0D, (s, i) -> s + ln(cast(greatest(i, 1) as double)))"
        return f"coalesce(list_sum(list_transform(range(0, CAST({n} AS INT) + 1), lambda i: ln(CAST(greatest(i, 1) AS DOUBLE)))), 0)"

    def unnest(self, lo: str, hi: str, name: str) -> str:
        """A select item with the integers lo..hi, for lo <= hi."""
        return f"explode(sequence(cast({lo} as int), cast({hi} as int))) AS {name}" if self.spark else f"unnest(range(CAST({lo} AS INT), CAST({hi} AS INT) + 1)) AS {name}"

    def pieces(self, x: str, step: int, more: int) -> str:
        """A select item with structs `z` (p, piece): piece p starts after step * p characters and has `more` characters of the next, for x longer than `more`."""
        piece, last = f"substring({x}, cast(p * {step} + 1 as int), {step + more})", self.div(f"length({x}) - {more + 1}", str(step))
        if self.spark:
            return f"explode(transform(sequence(0, cast({last} as int)), p -> named_struct('p', p, 'piece', {piece}))) AS z"
        return f"unnest(list_transform(range(0, CAST({last} AS INT) + 1), lambda p: {{'p': p, 'piece': {piece}}})) AS z"

    def hamming(self, a: str, b: str) -> str:
        if self.spark:
            return f"aggregate(sequence(1, greatest(length({a}), 1)), 0, (s, i) -> s + if(substring({a}, i, 1) <> substring({b}, i, 1), 1, 0))"
        return f"hamming({a}, {b})"

    def differ(self, a: str, b: str) -> str:
        """Hamming distance of strings of equal length, in one pass over them."""
        return f"aggregate(zip_with(split({a}, ''), split({b}, ''), (x, y) -> if(x <=> y, 0, 1)), 0, (s, i) -> s + i)" if self.spark else f"hamming({a}, {b})"

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}')" if self.spark else f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def ascii(self, x: str) -> str:
        return f"ascii({x})"


SPARK, CHECK = Dialect(True), Dialect(False)


@dataclass(frozen=True)
class Op:
    """An operator: the inputs it takes, common table expressions by name, and the final select.

    `check` is SQL written apart from build() that says what must come out, its inputs marked with @ as well; without it the
    checking engine gets build()'s own text.
    """

    inputs: tuple[str, ...]
    build: Callable[[Dialect], tuple[dict[str, str], str]]
    check: str | None = None

    def __call__(self, spark: SparkSession, **inputs: DataFrame) -> DataFrame:
        """The operator over frames of one's own."""
        ctes, last = self.build(SPARK)
        names = "|".join(self.inputs)
        ref = lambda s: re.sub(rf"@({names})\b", r"{\1}", s)
        head = ", ".join(f"{k} AS ({ref(v)})" for k, v in ctes.items())
        return spark.sql(f"WITH {head} {ref(last)}" if head else ref(last), **{k: inputs[k] for k in self.inputs})

    def check_sql(self, encodings: dict[str, str]) -> str:
        if self.check:
            return _checked(self.check, encodings)
        ctes, last = self.build(CHECK)
        every = {k: encodings[k] for k in encodings} | ctes
        sql = "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in every.items()) + " " + last
        return re.sub(r"@(\w+)", r"\1", sql)


def _checked(sql: str, encodings: dict[str, str]) -> str:
    head, sql = ", ".join(f"{k} AS ({v})" for k, v in encodings.items()), sql.strip()
    sql = f"WITH RECURSIVE {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH RECURSIVE {head} {sql}"
    return re.sub(r"@(\w+)", r"\1", sql)


@dataclass(frozen=True)
class Fn:
    """An operator as a function of frames, where SQL alone doesn't say it; check as in Op."""

    inputs: tuple[str, ...]
    run: Callable[..., DataFrame]
    check: str | None = None

    def __call__(self, spark: SparkSession, **inputs: DataFrame) -> DataFrame:
        return self.run(spark, **{k: inputs[k] for k in self.inputs})

    def check_sql(self, encodings: dict[str, str]) -> str | None:
        return _checked(self.check, encodings) if self.check else None
