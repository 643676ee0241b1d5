"""What operators need of the session: shared folders, and row numbers without a single task."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset, on one machine (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession) -> str:
    """The name of a new folder among the shared ones."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join by name in which null keys are equal, as they are in a grouping."""
    right = right.withColumnsRenamed({k: f"_{k}_right" for k in keys})
    same = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"_{k}_right")), keys, F.lit(True))
    return left.join(right, same, how).drop(*[f"_{k}_right" for k in keys])


def _new_group(batch: pa.RecordBatch, by: list[str], last: list[pa.Array] | None) -> np.ndarray:
    """Whether each row's key differs from the row's before it; nulls are equal, and so are NaNs. last: the keys of the row before the batch."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[0] = last is None
    for k, c in enumerate(by):
        v = batch.column(c)
        both = pa.concat_arrays([v.slice(0, 1) if last is None else last[k], v])
        here, before = both.slice(1), both.slice(0, n)
        same = pc.or_(pc.fill_null(pc.equal(here, before), False), pc.and_(pc.is_null(here), pc.is_null(before)))
        if pa.types.is_floating(v.type):
            same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(here), pc.is_nan(before)), False))
        new |= ~same.to_numpy(zero_copy_only=False)
    return new


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, total: str | None = None) -> DataFrame:
    """Adds each row's place, from 0, in its group in the given order (which must be one of all rows), and the group's size
    where a name for it is given. Rows without a key are a group.

    Rows are dealt and sorted by range, so a large group is many tasks, and a task counts as it goes. Of the groups of a range only the first can have begun
    in an earlier one: the rows before it are a table of one row for each range, which is broadcast. That is one exchange of the rows. Sizes are
    counts by group, joined.
    """
    shared_folder(df.sparkSession)
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_range", F.spark_partition_id())

    def number(batches):
        last, at, first = None, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _new_group(batch, by, last)
            begun = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            place = np.where(begun < 0, at + np.arange(n), np.arange(n) - begun)
            groups = np.cumsum(new) + (last is not None)
            head = (groups == 1) & first
            first = bool(head[-1])
            last, at = [batch.column(c).slice(n - 1) for c in by], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64()), pa.array(head)], [*batch.schema.names, name, "_head"])

    shape = StructType([*ranged.schema.fields, StructField(name, LongType()), StructField("_head", BooleanType())])
    placed = ranged.mapInArrow(number, shape).checkpoint()
    heads = placed.where("_head").select(*by).distinct()  # a row for each range at most
    runs = meet(placed.select(*by, "_range"), F.broadcast(heads), by, "left_semi").groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = runs.select("_range", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")).alias("_before")).where("_before > 0")
    out = placed.join(F.broadcast(before), "_range", "left").withColumn(name, F.col(name) + F.when(F.col("_head"), F.coalesce("_before", F.lit(0))).otherwise(0)).drop("_before", "_range", "_head")
    return meet(out, placed.groupBy(*by).agg(F.count("*").alias(total)), by) if total else out


def quantiles(ranked: DataFrame, by: list[str], rank: str, total: str, col: str, shares: dict[str, Column]) -> DataFrame:
    """A row for each group of numbered rows: exact quantiles, linear between the two rows around a share of the order.
    Two rows of a group, at most, leave the scan for each share, however large the group."""
    at = {n: q * (F.col(total) - 1) for n, q in shares.items()}
    near = reduce(lambda x, y: x | y, [F.col(rank).isin(F.floor(k), F.ceil(k)) for k in at.values()])
    value = lambda k: F.max(F.when(F.col(rank) == k, F.col(col)))
    ends = [c for n, k in at.items() for c in (value(F.floor(k)).alias(f"_{n}_low"), value(F.ceil(k)).alias(f"_{n}_high"), F.first(k - F.floor(k)).alias(f"_{n}_part"))]
    found = ranked.where(near).groupBy(*by).agg(*ends)
    between = [(F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part")).alias(n) for n in shares]
    return found.select(*by, *between)
