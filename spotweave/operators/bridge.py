"""Correspondence by grid position, for all slice pairs at once. spots: pair_id, spot_idx, array_row, array_col, x, y, layer;
indices and positions are a slice's own, so every join has pair_id in its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import seeded

GRID = ["pair_id", "array_row", "array_col"]


def one_per_position(spots: DataFrame) -> DataFrame:
    """Of spots at one grid position the last (greatest index)."""
    return spots.groupBy(*GRID).agg(F.max_by(F.struct("spot_idx", "x", "y", "layer"), "spot_idx").alias("a")).select(*GRID, F.col("a.spot_idx").alias("a_idx"), F.col("a.x").alias("gt_x"), F.col("a.y").alias("gt_y"), F.col("a.layer").alias("a_layer"))


def array_bridge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per B spot: pair_id, b_idx, a_idx, gt_x, gt_y (null without counterpart), have. Never more rows than B."""
    found = b.join(one_per_position(a), GRID, "left")
    return found.select("pair_id", F.col("spot_idx").alias("b_idx"), "a_idx", "gt_x", "gt_y", F.col("a_idx").isNotNull().alias("have"))


def partner_index(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per B spot its partner's index, or -1."""
    return array_bridge(a, b).select("pair_id", "b_idx", F.coalesce("a_idx", F.lit(-1)).cast("long").alias("a_idx"))


def bridge_unmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    return b.join(a, GRID, "left_anti")


def bridge_coverage(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("pair_id").agg(F.avg(F.col("have").cast("int")).alias("coverage"), F.count("*").alias("n"))


def common_positions(a: DataFrame, b: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """Positions of both slices of a pair with both indices, sorted; n: that many of each pair by seeded hash."""
    last = lambda s, name: s.groupBy(*GRID).agg(F.max("spot_idx").alias(name))
    found = last(a, "a_idx").join(last(b, "b_idx"), GRID)
    if n is not None:
        by_hash = Window.partitionBy("pair_id").orderBy(seeded(F.concat_ws(",", *GRID[1:]), seed), *GRID[1:])
        found = found.withColumn("_k", F.row_number().over(by_hash)).where(F.col("_k") <= n).drop("_k")
    return found.orderBy(*GRID)


def intersect_positions(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*GRID).intersect(b.select(*GRID))


def self_target(spots: DataFrame) -> DataFrame:
    return spots.select("pair_id", F.col("spot_idx").alias("b_idx"), F.col("x").alias("gt_x"), F.col("y").alias("gt_y"), F.lit(True).alias("have"))
