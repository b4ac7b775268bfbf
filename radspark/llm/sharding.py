"""Sharding by a hypergeometric communication matrix; DataFrame functions only.

The result is a uniform shuffle with exact shard sizes. Rows are dealt by key hash to B blocks. Of each block the matrix
says how many rows go to each shard: a draw of the contingency table with the blocks' row counts and the
shards' sizes as margins, split over blocks 16 at a time down a tree so that no step sees more than 16 x shards
numbers. Rows are permuted within their block and the first go to shard 0, the next to shard 1, as the matrix says.
Within a shard, rows are dealt to blocks at random again and permuted there; a block's first slot is the number of rows in
the shard's earlier blocks.

Blocks hold a bounded number of rows on average (B grows with the table), so no task sorts a whole shard.
Draws and permutations come from hashes of row values and a seed: reruns agree. Equal rows are interchangeable.
A null text has size 1 and the checksum of no bytes, 0. Under the law `rows`, the one in force, equal texts are rows like any others: they may come
into different shards, and only counts are balanced, so a very long text weighs no more than a short one. Rows are told apart by key, checksum and size
alone, and many rows equal in these meet in one block. A table without rows gives none. Kept columns come in a struct, so that their names don't
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written

SHARDS = 16
SEED = 771
ROWS_PER_BLOCK = 1 << 16
LEAF = 4  # log2 of the children of a node of the tree


def _lf(x: str) -> str:
    """SQL for ln(x!): Stirling's series at x + 8, brought down by the product."""
    z = f"(({x}) + 9D)"
    down = "*".join(f"(({x}) + {i}D)" for i in range(1, 9))
    return f"(({z} - 0.5D)*ln({z}) - {z} + 0.9189385332046727D + 1D/(12D*{z}) - 1D/(360D*{z}*{z}*{z}) + 1D/(1260D*pow({z},5)) - 1D/(1680D*pow({z},7)) - ln({down}))"


def _hypergeometric(total: str, good: str, draws: str, u: str) -> str:
    """SQL: how many of `draws` from `total`, of which `good` are good, by inversion from the mode outwards.

    The walk alternates between the next value above and below, spending u on each; it ends within a few
    standard deviations, and 60 of them bound the sequence it runs over.
    """
    p = f"""(p0 -> aggregate(sequence(0, cast(least(p0.hi - p0.lo, ceil(60 * p0.sd) + 60) as int)),
      named_struct('u', p0.u, 'up', p0.mode, 'pu', p0.pm, 'dn', p0.mode, 'pd', p0.pm, 'x', -1L),
      (a, i) -> CASE
        WHEN a.x >= 0 THEN a
        WHEN i = 0 THEN named_struct('u', a.u - p0.pm, 'up', a.up, 'pu', a.pu, 'dn', a.dn, 'pd', a.pd, 'x', if(a.u < p0.pm, p0.mode, -1L))
        ELSE transform(array(struct(
            if(a.up < p0.hi, a.pu * (p0.g - a.up) * (p0.d - a.up) / ((a.up + 1D) * (p0.n - p0.g - p0.d + a.up + 1D)), 0D) AS pu,
            if(a.dn > p0.lo, a.pd * a.dn * (p0.n - p0.g - p0.d + a.dn) / ((p0.g - a.dn + 1D) * (p0.d - a.dn + 1D)), 0D) AS pd)),
          m -> named_struct('u', a.u - m.pu - m.pd, 'up', a.up + if(a.up < p0.hi, 1, 0), 'pu', m.pu, 'dn', a.dn - if(a.dn > p0.lo, 1, 0), 'pd', m.pd,
            'x', CASE WHEN a.u < m.pu THEN a.up + 1 WHEN a.u < m.pu + m.pd THEN a.dn - 1 ELSE -1L END))[0]
      END, a -> if(a.x >= 0, a.x, p0.mode)))"""
    lam = p.strip()[1:-1]
    m = f"least({good}, {draws}, cast(floor((({draws}) + 1D) * (({good}) + 1D) / (({total}) + 2D)) as bigint))"
    lo = f"greatest(0L, ({draws}) + ({good}) - ({total}))"
    lnp = (
        f"{_lf(good)} - {_lf('q.mode')} - {_lf(f'({good}) - q.mode')} + {_lf(f'({total}) - ({good})')} - {_lf(f'({draws}) - q.mode')} - {_lf(f'({total}) - ({good}) - ({draws}) + q.mode')}"
        f" - {_lf(total)} + {_lf(draws)} + {_lf(f'({total}) - ({draws})')}"
    )
    sd = f"sqrt(greatest(0D, cast({draws} as double) * {good} / greatest(1, {total}) * (1 - {good} / greatest(1D, {total}))))"
    return f"""transform(transform(array(struct(greatest({lo}, {m}) AS mode)), q -> struct({u} AS u, q.mode AS mode, exp({lnp}) AS pm,
      {lo} AS lo, least({good}, {draws}) AS hi, {sd} AS sd, cast({good} as double) AS g, cast({draws} as double) AS d, cast({total} as double) AS n)), {lam})[0]"""


def _u(*parts: str) -> str:
    return f"(cast(shiftrightunsigned(xxhash64({', '.join(parts)}), 11) as double) * {2.0**-53!r}D)"


def matrix(counts: DataFrame, n_blocks_log16: int, shards: int, total: int, seed: int = SEED) -> DataFrame:
    """counts (b, n) of blocks 0 .. 16**n_blocks_log16 - 1 -> b, m: array of rows to each shard, all exact."""
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    spark = counts.sparkSession
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("node"), F.array(*[F.lit(x).cast("long") for x in sizes]).alias("m"))
    full = counts
    for level in range(n_blocks_log16):
        shift = LEAF * (n_blocks_log16 - 1 - level)
        kids = full.groupBy(F.shiftright("b", shift).alias("kid")).agg(F.sum("n").alias("n"))
        kids = kids.groupBy(F.shiftright("kid", LEAF).alias("node")).agg(F.sort_array(F.collect_list(F.struct("kid", "n"))).alias("kids"))
        # of a node's margins m, child after child takes its draw: shard after shard, given what is left of both
        inner = _hypergeometric("r.t", "element_at(a.m, cast(s + 1 as int))", "r.d", _u(str(seed), "c.kid", "s"))
        fold = f"""aggregate(kids, named_struct('m', m, 'out', cast(array() as array<struct<node:bigint,m:array<bigint>>>)),
          (a, c) -> transform(array(aggregate(sequence(0, {shards - 1}),
              named_struct('t', aggregate(a.m, 0L, (x, y) -> x + y), 'd', c.n, 'v', cast(array() as array<bigint>)),
              (r, s) -> transform(array({inner}), h -> named_struct('t', r.t - element_at(a.m, cast(s + 1 as int)), 'd', r.d - h, 'v', concat(r.v, array(h))))[0])),
            z -> named_struct('m', zip_with(a.m, z.v, (x, y) -> x - y), 'out', concat(a.out, array(struct(c.kid AS node, z.v AS m)))))[0], a -> a.out)"""
        nodes = nodes.join(kids, "node").select(F.expr(f"inline({fold})"))
        if level < n_blocks_log16 - 1:
            nodes = written(nodes, f"matrix{level}")
    return nodes.select(F.col("node").alias("b"), "m")


def _deal(seed: int, blocks: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(blocks))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, keep: tuple = ()) -> DataFrame:
    """Every row with size, text_crc32, shard and slot (both from 0), and the kept columns in a struct `row`."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *([F.struct(*keep).alias("row")] if keep else []))
    if not keep:
        rows = written(rows, "shardrows")
    total = rows.count()
    if total == 0:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))  # no rows, same columns
    deep = 2
    while 16**deep * ROWS_PER_BLOCK < total:
        deep += 1
    blocks = 16**deep
    ident = ("doc_id", "text_crc32", "size")
    rows = rows.withColumn("b", _deal(seed + 1, blocks, *ident))
    m = written(matrix(rows.groupBy("b").agg(F.count(F.lit(1)).alias("n")), deep, shards, total, seed), "matrix")
    local = Window.partitionBy("b").orderBy(F.xxhash64(F.lit(seed + 2), *ident), *ident)
    rows = rows.withColumn("i", F.row_number().over(local)).join(m, "b")
    into = F.expr("aggregate(m, named_struct('s', 0, 'c', 0L), (a, x) -> named_struct('s', a.s + if(i > a.c + x, 1, 0), 'c', a.c + x), a -> a.s)")
    sent = rows.withColumn("shard", into).drop("m", "i", "b").withColumn("b", _deal(seed + 3, blocks, *ident))
    count = sent.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    first = count.select("shard", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    again = Window.partitionBy("shard", "b").orderBy(F.xxhash64(F.lit(seed + 4), *ident), *ident)
    out = sent.withColumn("i", F.row_number().over(again)).join(first, ["shard", "b"])
    return out.withColumn("slot", F.col("first") + F.col("i") - 1).drop("first", "i", "b")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sharding": op8_sharding}
ORACLE_SQL: dict[str, str] = {}
