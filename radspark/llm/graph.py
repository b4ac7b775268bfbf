"""Connected components of an edge table, by hooking trees and halving their depth; everything stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, written

#: Rows of a written file, so that a round on few vertices doesn't write a file for each shuffle partition.
FILE_ROWS = 250_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges (a, b) -> v, root for every vertex that has an edge; root is the least vertex of its component.

    Labels form trees of vertices, each pointing to a lesser one. A round takes for every vertex the least
    grandparent among its neighbours, hangs the vertex and its parent below that if it is less, and halves the depth. Whole trees
    move at once, so rounds grow with the logarithm of the vertices. When nothing moves all trees are stars, and neighbours
    have the same root. Null ends, loops and repeated edges don't matter; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    e = written(e.union(e.select("y", "x")).distinct(), "edges")
    label = e.groupBy(F.col("x").alias("v")).agg(F.least(F.min("y"), F.first("x")).alias("root"))
    label = written(label, "labels")
    held, files = label, 1 + label.count() // FILE_ROWS
    while True:
        up = label.select(F.col("v").alias("root"), F.col("root").alias("over"))
        far = label.join(up, "root").select("v", "root", "over")
        near = e.join(far, e.y == far.v).groupBy(F.col("x").alias("v")).agg(F.min("over").alias("near"))
        own = far.join(near, "v").select("v", "root", F.least("root", "over", "near").alias("low"), "near")
        # for each vertex its own label, told by was, and what its children bring
        told = F.explode(F.array(F.struct(F.col("v"), F.col("root").alias("was"), F.col("low")), F.struct(F.col("root").alias("v"), F.lit(None).cast("long").alias("was"), F.col("near").alias("low"))))
        new = own.select(told.alias("t")).select("t.*").groupBy("v").agg(F.min("low").alias("root"), F.max("was").alias("was"))
        new = written(new.select("v", "root", (F.col("root") < F.col("was")).alias("moved")).coalesce(files), "labels")
        moved = new.where("moved").limit(1).count()
        free(e.sparkSession, held, *([] if moved else [e]))
        held, label = new, new.select("v", "root")
        if not moved:
            return label
