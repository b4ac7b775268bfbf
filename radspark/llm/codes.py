"""Vectors compressed to a code a part, the codebooks fitted by Hamerly's form of Lloyd's rounds on integers.

A component x counts as floor(1024 * x). Each vector is cut into PARTS consecutive parts (as equal as possible), each position with
a codebook of at most ENTRIES entries, which starts as that part of the vectors of least id. A round assigns every part to
its nearest entry, ties to the lower index, and moves each used entry to the componentwise floor of its parts' mean. With every row, and for
each of its parts, the table of a round keeps the entry, an upper bound of its distance and a lower bound of the second
nearest entry's. Moved entries widen the bounds by the way they went. A part whose upper bound is strictly below its
lower bound, or below half the way from its entry to the nearest other, keeps its entry unseen; else its own distance
is measured, and only if that doesn't decide strictly either, all entries are. Bounds are rounded outwards and all distances are exact
integers, so the entries are those of a full search, ties included.

A round is one pass: tasks write rows with their new bounds, and the sums and counts of each entry in rows of their own. Only the
sums over all tasks come to the driver, a row an entry and place; a codebook is ENTRIES vectors, whatever the table's size. What a
lost executor did is done again from the table of the round before.

Rows whose vector is null, empty, of another length than most, or holds null or non-finite components take no part; nor does any other
column, whatever its name. Null ids come last, equal ids in the order of their vectors; repeated rows are rows of their own and fewer rows than
ENTRIES make shorter codebooks, with repeated entries where vectors repeat. No rows give no rows. Scaled components beyond 2**40 count as
2**40, sums of errors beyond 2**63 - 1 as that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, read, written
from .vectors import clamped, finite, packed, parts_of, scaled, unpacked

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BROADCAST_GROUPS = 10_000  # of the groups with most rows
_FLUSH = 1 << 20  # rows whose sums a task adds up before it sends them
_EXACT = 1 << 53


def cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.array_split(x, parts, axis=1)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; Python integers where 64 bits may not hold them."""
    d = x - y
    most = int(np.abs(d).max(initial=0))
    if d.shape[1] * most * most < 1 << 63:
        return (d * d).sum(1)
    d = d.astype(object)
    return (d * d).sum(1)


def all_squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries: by a matrix product while doubles hold every integer on the way."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * most * most < _EXACT:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]
    return np.stack([squares(x, e[None]).astype(object) for e in book], 1)


def _root(squared: np.ndarray, towards: float) -> np.ndarray:
    """Square roots that are bounds: off by at most a few last places, in the direction given."""
    r = np.sqrt(squared.astype(np.float64))
    return np.nextafter(np.nextafter(r, towards), towards)


def _add(a: np.ndarray, b: np.ndarray, towards: float) -> np.ndarray:
    return np.nextafter(a + b, towards)


class Move:
    """What a change of one part's codebook means for bounds: how far each entry went, how far any other went at most, and half of the
    way to the nearest other entry."""

    def __init__(self, old: np.ndarray, new: np.ndarray) -> None:
        self.book, n = new, len(new)
        self.went = _root(squares(new, old), np.inf)
        self.went[(old == new).all(1)] = 0
        order = np.argsort(self.went, kind="stable")
        self.others = np.full(n, self.went[order[-1]])
        self.others[order[-1]] = self.went[order[-2]] if n > 1 else 0
        apart = all_squares(new, new)
        apart[np.arange(n), np.arange(n)] = apart.max(initial=0) if n > 1 else 0
        self.half = _root(apart.min(1), -np.inf) / 2 if n > 1 else np.full(n, np.inf)


def assign(x: np.ndarray, move: Move, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New entries and bounds of one part's rows, and how many rows looked at all entries."""
    upper, lower = _add(upper, move.went[at], np.inf), _add(lower, -move.others[at], -np.inf)
    at = at.copy()
    keeps = np.maximum(lower, move.half[at])
    open_ = np.flatnonzero(~(upper < keeps))
    if len(open_):
        upper[open_] = _root(squares(x[open_], move.book[at[open_]]), np.inf)
        open_ = open_[~(upper[open_] < keeps[open_])]
    if len(open_):
        d = all_squares(x[open_], move.book)
        best = np.array(d.argmin(1), np.int64)
        row = np.arange(len(open_))
        upper[open_] = _root(d[row, best], np.inf)
        at[open_] = best
        if d.shape[1] > 1:
            d[row, best] = d.max()
            lower[open_] = _root(d.min(1), -np.inf)
        else:
            lower[open_] = np.inf
    return at, upper, lower, len(open_)


class Sums:
    """Counts and sums of each entry's parts, of the rows added so far."""

    def __init__(self, books: list[np.ndarray]) -> None:
        self.n = [np.zeros(len(b), np.int64) for b in books]
        self.sums = [np.zeros(b.shape, np.int64) for b in books]
        self.rows = 0

    def add(self, xs: list[np.ndarray], at: np.ndarray) -> None:
        for p, x in enumerate(xs):
            order = np.argsort(at[:, p], kind="stable")
            used, first = np.unique(at[order, p], return_index=True)
            self.n[p][used] += np.diff(np.append(first, len(order)))
            self.sums[p][used] += np.add.reduceat(x[order], first, axis=0)
        self.rows += len(at)


_STATE = "x binary, entries binary, upper binary, lower binary, part int, entry int, n long, sums array<long>"


def _round(schema: pa.Schema, moves: list[Move], first: bool):
    """Rows of the last table -> rows with new entries and bounds, and rows of sums."""

    def sent(s: Sums) -> pa.RecordBatch:
        rows = [(p, int(e), int(s.n[p][e]), s.sums[p][e].tolist()) for p in range(len(moves)) for e in np.flatnonzero(s.n[p])]
        cols = dict(zip(("part", "entry", "n", "sums"), zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(len(rows), f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sums([m.book for m in moves])
        for batch in batches:
            for b in parts_of(batch):
                x = unpacked(b.column("x"))
                xs, n = cut(x, len(moves)), len(x)
                if first:
                    at, upper, lower = np.zeros((n, len(moves)), np.int64), np.full((n, len(moves)), np.inf), np.full((n, len(moves)), -np.inf)
                else:
                    at, upper, lower = unpacked(b.column("entries"), np.uint8).astype(np.int64), unpacked(b.column("upper"), np.float64), unpacked(b.column("lower"), np.float64)
                new = [assign(xs[p], m, at[:, p], upper[:, p], lower[:, p])[:3] for p, m in enumerate(moves)]
                at, upper, lower = (np.stack(c, 1) for c in zip(*new, strict=True))
                held.add(xs, at)
                cols = {"x": b.column("x"), "entries": packed(at.astype(np.uint8)), "upper": packed(upper), "lower": packed(lower)}
                cols |= {f.name: b.column(f.name) for f in schema if f.name in ("vec_id", "label")}
                yield pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)
                if held.rows >= _FLUSH:
                    yield sent(held)
                    held = Sums([m.book for m in moves])
        if held.rows:
            yield sent(held)

    return run


def _arrow(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def moved(books: list[np.ndarray], state: DataFrame) -> list[np.ndarray]:
    """Every entry at the componentwise floor of its parts' mean; unused ones where they were."""
    s = state.where("part is not null")
    n = {(r["part"], r["entry"]): int(r["n"]) for r in s.groupBy("part", "entry").agg(F.sum("n").alias("n")).collect()}
    each = s.select("part", "entry", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = [b.copy() for b in books]
    for r in each.collect():
        out[r["part"]][r["entry"], r["at"]] = int(r["v"]) // n[r["part"], r["entry"]]
    return out


def _scaled(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {"x": packed(scaled(b.column("embedding"), SCALE)), "vec_id": b.column("vec_id"), "label": b.column("label")}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], schema=schema)

    return run


def first_books(v: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors of least id, of (vec_id, embedding, ...)."""
    rows = v.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    return cut(scaled(pa.array([r[0] for r in rows], pa.list_(pa.float64())), SCALE), parts) if rows else []


def fit(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, x, entries), and the codebooks (entry x place, a part each) that the entries point into."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is one byte: 1 to 256 entries")
    v = finite(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label")), "embedding")
    books = first_books(v, parts, entries)
    ids = v.select("vec_id", "label")
    empty = ids.limit(0).select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("x", "binary"), ("entries", "binary"))])
    if not books:
        return empty, books
    state = v.mapInArrow(_scaled(_arrow(empty.select("vec_id", "label", "x").schema)), empty.select("vec_id", "label", "x").schema)
    whole = ids.limit(0).select("*", *[F.lit(None).cast(f.split(" ", 1)[1]).alias(f.split(" ", 1)[0]) for f in _STATE.split(", ")]).schema
    old, held = books, None
    for i in range(rounds + 1):
        moves = [Move(a, b) for a, b in zip(old, books, strict=True)]
        new = written(state.mapInArrow(_round(_arrow(whole), moves, i == 0), whole), f"codes{i}")
        if held is not None:
            free(vectors.sparkSession, held)
        held, state = new, new.where("part is null").drop("part", "entry", "n", "sums")
        if i < rounds:
            old, books = books, moved(books, new)
    return state.select("vec_id", "label", "x", "entries"), books


def _errors(schema: pa.Schema, books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts_of(batch):
                at = unpacked(b.column("entries"), np.uint8)
                xs = cut(unpacked(b.column("x")), len(books))
                e = sum(squares(x, book[at[:, p]]).astype(object) for p, (x, book) in enumerate(zip(xs, books, strict=True)))
                cols = {"code": pa.array([a.tobytes().hex() for a in at], pa.string()), "error": pa.array([min(int(s), (1 << 63) - 1) for s in e], pa.int64())}
                yield pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else b.column(f.name) for f in schema], schema=schema)

    return run


def codes(state: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of fit()'s rows."""
    schema = state.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    return state.mapInArrow(_errors(_arrow(schema), books), schema) if books else state.sparkSession.createDataFrame([], schema)


def decoded(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([b[i] for b, i in zip(books, bytes.fromhex(code), strict=True)]) / SCALE


def with_group_error(rows: DataFrame, most: int = BROADCAST_GROUPS) -> DataFrame:
    """rows (label, error, ...) with label_error, the errors of equal labels together. The labels of most rows, at most `most`, are
    broadcast; a label beyond these has less than 1 in `most` of the rows, and is joined by a shuffle."""
    sums = written(rows.groupBy("label").agg(clamped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"), F.count("*").alias("_n")), "labelerrors")
    top = sums.orderBy(F.desc("_n"), "label").limit(most).select(F.col("label").alias("_label"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_label"))
    with_top = rows.join(F.broadcast(top), same).drop("_label")
    if sums.count() <= most:
        return with_top
    rest = rows.join(F.broadcast(top), same, "left_anti")
    other = sums.select(F.col("label").alias("_label"), "label_error").join(F.broadcast(top.select(F.col("_label").alias("_top"))), F.col("_label").eqNullSafe(F.col("_top")), "left_anti")
    return with_top.unionByName(rest.join(other, same).drop("_label"))


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(i)) for b in books for i in b.ravel()).encode()).hexdigest()


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, books = fit(read(spark, sf_dir, "embeddings"))
    out = with_group_error(written(codes(state, books), "codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Every distance of every round, without bounds. Integers below 2**53 are exact in doubles."""
    book0 = f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [floor({SCALE} * c::DOUBLE) FOR c IN embedding] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT r, vec_id, label, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] AS x FROM kept, range({PARTS}) AS q(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST) - 1 AS e, x AS c FROM parts QUALIFY e < {ENTRIES})"""
    out = [book0]
    for i in range(ROUNDS + 1):
        dist = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
        out.append(f"d{i} AS (SELECT r, p, e, {dist} AS d FROM parts JOIN b{i} USING (p))")
        out.append(f"a{i} AS MATERIALIZED (SELECT r, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM d{i} GROUP BY r, p)")
        if i < ROUNDS:
            mean = f"m{i} AS (SELECT p, e, list(v ORDER BY j) AS c FROM (SELECT p, e, j, floor(sum(x[j]) / count(*)) AS v FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS j FROM parts JOIN a{i} USING (r, p)) GROUP BY p, e, j) GROUP BY p, e)"
            out += [mean, f"b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (p, e))"]
    out.append(f"rows AS (SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', a.e), '' ORDER BY p) AS code, sum(a.d)::BIGINT AS error FROM parts JOIN a{ROUNDS} a USING (r, p) GROUP BY r)")
    last = f"(SELECT sha256(string_agg(array_to_string([v::BIGINT FOR v IN c], ','), ',' ORDER BY p, e)) FROM b{ROUNDS})"
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {last} AS codebooks_sha256 FROM rows"


QUERIES = {"op11_codes": op11_codes}
ORACLE_SQL = {"op11_codes": _sql()}
