"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

Targets: sources in code-point order (null last) weigh WEIGHTS, repeating, and share all words; a target stops at CAP
times its source's words and the excess is shared among the rest by weight. A document's expected copies are
target / source words; whole copies are certain and the fraction is a probability. Two fractions of one source are
rounded against each other: words move from one document to the other, at random but fair, until one fraction is
0 or 1, so the words of the source do not change. Documents are dealt at random to groups of about FAN; each group is
folded to one undecided residual, residuals are dealt to groups again, and so on up the tree, whose depth is the
logarithm of the number of documents. One residual of each source is left; a coin decides it, so a source misses its
target by less than one document.

Equal (doc_id, source, size) rows are one class, rounded together; its copies are dealt evenly to its rows.
Null and empty texts have size 0 and are taken 0 times; a source of such texts alone has target 0, and a table without rows gives none. Of sources
that reach their stop together all stop at once. However long a text, it is one document of its words. Kept columns come in a struct, so that their
names don't clash. Groups are bounded at every level, whatever a source's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, read, written

WEIGHTS = (5, 2, 1)
CAP = 3
FAN = 64
SEED = 20240229


def uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *cols), 11)).cast("double") * F.lit(2.0**-53)


def class_key() -> Column:
    """128 bits of a class's own values, so that no two classes share one."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.md5(F.concat(part("doc_id"), part("source"), F.col("size").cast("string")))


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes (source, size) -> source, source_size, n_docs, target, one row a source.

    The share of a weight unit at which a source stops is cap * words / weight; in that order, a source stops if what
    the earlier ones left would give it more. The windows run over one row a source, not over documents.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int")))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left_words", F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("stops", cap * F.col("source_size") * F.col("left_weight") <= F.col("left_words") * F.col("w"))
    # the first that doesn't stop sets the share of a unit for itself and all after it
    s = s.withColumn("unit", F.min_by(F.when(~F.col("stops"), F.col("left_words") / F.col("left_weight")), F.when(~F.col("stops"), F.col("source_size") / F.col("w"))).over(every))
    s = s.withColumn("target", F.when(F.col("stops") | F.col("unit").isNull(), (cap * F.col("source_size")).cast("double")).otherwise(F.col("w") * F.col("unit")))
    return s.select("source", "source_size", "n_docs", "target")


_FOLD = """aggregate(items,
  named_struct('at', 0, 'k', cast(null as KIND), 's', 0D, 'x', 0D, 'out', cast(array() as array<struct<k:KIND,up:int>>)),
  (a, t) -> CASE WHEN a.k IS NULL THEN named_struct('at', a.at + 1, 'k', t.k, 's', t.s, 'x', t.x, 'out', a.out)
    ELSE transform(array(struct(
        least((1 - a.x) * a.s, t.x * t.s) AS up, least(a.x * a.s, (1 - t.x) * t.s) AS down)),
      m -> CASE
        WHEN t.u * (m.up + m.down) < m.down THEN
          CASE WHEN (1 - a.x) * a.s <= t.x * t.s
            THEN named_struct('at', a.at + 1, 'k', t.k, 's', t.s, 'x', greatest(0D, t.x - m.up / t.s), 'out', concat(a.out, array(struct(a.k AS k, 1 AS up))))
            ELSE named_struct('at', a.at + 1, 'k', a.k, 's', a.s, 'x', least(1D, a.x + m.up / a.s), 'out', concat(a.out, array(struct(t.k AS k, 0 AS up)))) END
        ELSE
          CASE WHEN a.x * a.s <= (1 - t.x) * t.s
            THEN named_struct('at', a.at + 1, 'k', t.k, 's', t.s, 'x', least(1D, t.x + m.down / t.s), 'out', concat(a.out, array(struct(a.k AS k, 0 AS up))))
            ELSE named_struct('at', a.at + 1, 'k', a.k, 's', a.s, 'x', greatest(0D, a.x - m.down / a.s), 'out', concat(a.out, array(struct(t.k AS k, 1 AS up)))) END
      END)[0] END)"""


def rounded(parts: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """parts (source, k, s, x): fractions x of s words -> k, up (1 if rounded up); the words of a source are kept but for one part.

    most: at least the number of parts of any source. The up and down moves have chances in inverse proportion to
    their sizes, so each part's expectation is its fraction.
    """
    done = []
    level, left = 0, most
    fold = _FOLD.replace("KIND", parts.schema["k"].dataType.simpleString())
    while True:
        last = left <= fan
        n = 1 if last else -(-left // (fan // 2))
        g = F.pmod(F.xxhash64(F.lit(level), F.lit(SEED), F.col("k")), F.lit(n))
        item = F.struct(uniform(F.lit(level + 100), "k").alias("o"), F.col("k"), F.col("s"), F.col("x"), uniform(F.lit(level), "k").alias("u"))
        folded = (
            parts.withColumn("g", g)
            .groupBy("source", "g")
            .agg(F.sort_array(F.collect_list(item)).alias("items"))
            .select("source", F.expr(fold).alias("a"))
        )
        folded = written(folded, f"mix{level}")  # two readers: decisions and residuals
        done.append(folded.select(F.inline("a.out").alias("k", "up")))
        parts = folded.select("source", F.col("a.k").alias("k"), F.col("a.s").alias("s"), F.col("a.x").alias("x"))
        if last:
            break
        # a random deal makes some groups of a level empty; that only lowers the count
        level, left = level + 1, n
    done.append(parts.select("k", (uniform(F.lit(999), "k") < F.col("x")).cast("int").alias("up")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple = WEIGHTS, cap: int = CAP, keep: tuple = ()) -> DataFrame:
    """For every row: key, size, source_size, target, copies, taken = copies * size, and the kept columns in a struct `row`."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"))
    cls = written(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "mixdocs")
    t = written(targets(cls.select("source", (F.col("size") * F.col("m")).alias("size")), weights, cap), "mixtargets")
    most = int(t.agg(F.max("n_docs")).first()[0] or 0)
    same = F.col("c.source").eqNullSafe(F.col("t.source"))
    c = cls.alias("c").join(t.alias("t"), same).select("c.*", "source_size", "target")
    want = F.when(F.col("size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(0.0)
    c = c.withColumn("want", want).withColumn("whole", F.floor("want")).withColumn("k", class_key())
    frac = c.select("source", "k", F.col("size").cast("double").alias("s"), (F.col("want") - F.col("whole")).alias("x")).where("x > 0 and s > 0")
    up = rounded(frac, most)
    c = c.join(up, "k", "left").withColumn("copies", F.col("whole") + F.coalesce("up", F.lit(0)))
    if not keep:
        # a class's rows, one by one
        one = c.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    else:
        kept = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("_s"), size_of(text).alias("_n"), F.struct(*keep).alias("row"))
        on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n"))
        one = kept.withColumnRenamed("doc_id", "_d").join(c, on)
        many = Window.partitionBy("k").orderBy(F.xxhash64("row"))
        one = one.withColumn("i", F.when(F.col("m") > 1, F.row_number().over(many)).otherwise(1))
    part = F.floor(F.col("copies") / F.col("m")) + (F.col("i") <= F.col("copies") % F.col("m")).cast("int")
    out = one.select("doc_id", "size", "source_size", "target", part.cast("long").alias("copies"), *(["row"] if keep else []))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", "copies", "taken", *(["row"] if keep else []))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_mixing": op4_mixing}
ORACLE_SQL: dict[str, str] = {}
