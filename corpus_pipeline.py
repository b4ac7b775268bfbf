"""A training corpus from `documents`: toxicity, near copies, benchmark leaks, source weights, shards.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes every stage's result to the shared folder
and reads it again for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radspark.llm import decontam, jaccard, mixing, sharding, toxicity
from radspark.llm.common import read, written


def whole(docs: DataFrame):
    return F.struct(*docs.columns).alias("row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; learned from the labelled rows that are not held out."""
    scored = toxicity.score(docs, toxicity.fitted(spark, docs, sf_dir), keep=(whole(docs),))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at similarity 0.8: that of least doc_id."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontam.find(docs, read(spark, sf_dir, "benchmark"), keep=(whole(docs),))
    return found.where(F.size("hits") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = mixing.mix(docs, keep=tuple(docs.columns)).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and place in it."""
    return sharding.shard(docs, keep=tuple(docs.columns)).select("row.*", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard_rows),
]

#: Fitting, fingerprints and random draws have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
