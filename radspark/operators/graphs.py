"""Graphs: connected components of an edge table, and small graphs within a group."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only with a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="radspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, where its lineage ends, and the table's path; `by` gives a folder to each value of a column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/radspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (v, root): the least vertex of its component, for every vertex with an edge.

    Each round a vertex takes the least label among its neighbours' and its own, and then its label's label; tables of
    the round before last are removed. Ends when no label moves.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).where("x <> y")
    e, e_path = written(both.union(both.select("y", "x")).distinct(), "edges")
    label, path = written(e.groupBy(F.col("x").alias("v")).agg(F.least(F.min("y"), F.first("x")).alias("root")), "labels")
    while True:
        near = e.join(label, e["y"] == label["v"]).groupBy("x").agg(F.min("root").alias("near"))
        hop = label.join(near, label["v"] == near["x"]).select("v", "root", F.least("root", "near").alias("low"))
        over = label.select(F.col("v").alias("low"), F.col("root").alias("over"))
        new = hop.join(over, "low").select("v", F.least("low", "over").alias("root"), (F.least("low", "over") < F.col("root")).alias("moved"))
        new, new_path = written(new, "labels")
        moved = new.where("moved").limit(1).count()
        if not moved:
            removed(spark, path)
            removed(spark, e_path)
            return new.select("v", "root")
        removed(spark, path)
        label, path = new.select("v", "root"), new_path


# ---------------------------------------------------------------- small graphs


def spanning_tree(edges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The edges (a, b, weight) of a minimum spanning tree, or forest: lightest first, ties by ends."""
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b, w in sorted(edges, key=lambda e: (e[2], min(e[0], e[1]), max(e[0], e[1]))):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b, w))
    return out


def connected(vertices: set[int], edges: list[tuple[int, int, int]]) -> bool:
    return len(parts(vertices, edges)) <= 1


def parts(vertices: set[int], edges: list[tuple[int, int, int]]) -> list[set[int]]:
    near = defaultdict(set)
    for a, b, *_ in edges:
        near[a].add(b)
        near[b].add(a)
    out, left = [], set(vertices)
    while left:
        stack = [min(left)]
        seen = set()
        while stack:
            v = stack.pop()
            if v not in seen:
                seen.add(v)
                stack += near[v] - seen
        out.append(seen)
        left -= seen
    return out


def cut_partitions(vertices: set[int], tree: list[tuple[int, int, int]]) -> list[list[set[int]]]:
    """All partitions of a tree's vertices that leaving out some of its edges gives, from whole to single vertices. Trees are those of a locus, of few piles."""
    out = []
    for mask in range(1 << len(tree)):
        out.append(parts(vertices, [e for i, e in enumerate(tree) if not mask >> i & 1]))
    return sorted(out, key=len)


def topological(near: dict[str, list[str]]) -> list[str] | None:
    """An order in which edges lead onwards, or None for a graph with a cycle."""
    into = defaultdict(int)
    for v, out in near.items():
        into[v] += 0
        for w in out:
            into[w] += 1
    ready = sorted((v for v, n in into.items() if not n), reverse=True)
    order = []
    while ready:
        v = ready.pop()
        order.append(v)
        for w in near.get(v, ()):
            into[w] -= 1
            if not into[w]:
                ready.append(w)
    return order if len(order) == len(into) else None


class DeBruijn:
    """K-mers that occur `least` times or more, each leading to those it overlaps but for a letter; runs of one letter are left out."""

    def __init__(self, reads: list[str], k: int, least: int = 2) -> None:
        self.k, count = k, defaultdict(int)
        for r in reads:
            for i in range(len(r) - k + 1):
                count[r[i : i + k]] += 1
        self.count = {x: n for x, n in count.items() if n >= least and len(set(x)) > 1 and "N" not in x}
        self.near = {x: [x[1:] + b for b in "ACGT" if x[1:] + b in self.count] for x in sorted(self.count)}

    def without_dimer_loops(self) -> DeBruijn:
        """Cuts the edges within repeats of two letters, which are cycles."""
        for x, out in self.near.items():
            if x[2:] == x[:-2]:
                self.near[x] = [y for y in out if y[2:] != y[:-2]]
        return self

    def best_path(self) -> str | None:
        """The path of the largest sum of counts, spelled out; of equal ones that through the first k-mer by letters. None with cycles."""
        order = topological(self.near)
        if order is None:
            return None
        best: dict[str, int] = {}
        follow: dict[str, str | None] = {}
        for x in reversed(order):
            nxt = max(self.near[x], key=lambda y: best[y], default=None)
            follow[x] = nxt
            best[x] = self.count[x] + (best[nxt] if nxt else 0)
        if not best:
            return None
        x = max(sorted(best), key=lambda y: best[y])
        out = x
        while follow[x]:
            x = follow[x]
            out += x[-1]
        return out

    def parts(self) -> list[set[str]]:
        index = {x: i for i, x in enumerate(self.near)}
        names = list(self.near)
        return [{names[i] for i in p} for p in parts(set(index.values()), [(index[x], index[y], 1) for x, out in self.near.items() for y in out])]

    def gfa(self) -> list[str]:
        """The graph in GFA: a line a k-mer, and one an overlap."""
        lines = ["H\tVN:Z:1.0"] + [f"S\t{x}\t{x}\tKC:i:{n}" for x, n in sorted(self.count.items())]
        return lines + [f"L\t{x}\t+\t{y}\t+\t{self.k - 1}M" for x, out in self.near.items() for y in out]


def contig(reads: list[str], k: int, least: int = 2) -> str | None:
    """The contig of a locus' reads: the best path, after dimer loops are cut if the graph has cycles."""
    g = DeBruijn(reads, k, least)
    out = g.best_path()
    return out if out is not None else g.without_dimer_loops().best_path()
