"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for the operators that count words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null, as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def use_shared_checkpoints(spark: SparkSession) -> None:
    """checkpoint() goes to spark.checkpoint.dir; only where that is unset, on one machine (tests), to a folder of our own."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


def shared_checkpoints(spark: SparkSession) -> str:
    """The folder of the checkpoints, for tables that a query writes and reads again."""
    use_shared_checkpoints(spark)
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def spread(df: DataFrame) -> DataFrame:
    """The rows, dealt to all cores where the files give fewer partitions than there are (so of small inputs alone)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place where it can be."""
    x = x * _K1
    x ^= x >> _S29
    x *= _K2
    x ^= x >> _S32
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0], then the next range, and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v) of longs, as (node, root): root is the least node of its component.

    Alternates large-star and small-star steps (each a grouped minimum and an equi-join) until nothing changes;
    each step is checkpointed, so lineage stays short and a lost executor costs one round at most. Minima are partial before they
    are shuffled, and as they are checkpointed before the join, Spark can split a hub's edges there (a skewed join of two plain exchanges).
    Edges with a null or from a node to itself are ignored; nodes without edges don't appear.
    """
    use_shared_checkpoints(edges.sparkSession)
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        e = e.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct().checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.countDistinct("u")).first())
        if now == state or now[0] == now[2] == 0:
            break
        state = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
