"""Coordinate transforms whose parameters arrive as (small, broadcast) tables.

bumps: seed, bump_id, cx, cy, ux, uy, amp. cuts: seed, theta, quantile, side, offset_pitch. grid: seed, severity, tear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import numbered, quantiles
from ..functions.vectors import seeded


def extent(spots: DataFrame, width_share: float = 0.18) -> DataFrame:
    """Diagonal of the bounding box of each sample, and the width of its bumps."""
    e = spots.groupBy("sample_id").agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent"))
    return e.withColumn("bump_width", F.col("extent") * width_share)


def peak_normalize(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """A field divided by its greatest length in each group, which becomes 1 (or stays 0 where it is zero throughout)."""
    peak = df.groupBy(*by).agg(F.max(F.hypot(x, y)).alias("_peak"))
    scale = F.when(F.col("_peak") > 0, F.col("_peak")).otherwise(1.0)
    return df.join(peak, by).withColumns({x: F.col(x) / scale, y: F.col(y) / scale}).drop("_peak")


def _by_seed(parameters: DataFrame, name: str) -> DataFrame:
    """(seed, name): a seed's rows of a parameter table as one array."""
    rest = [c for c in parameters.columns if c != "seed"]
    return parameters.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))


def unit_field(spots: DataFrame, bumps: DataFrame) -> DataFrame:
    """(sample_id, seed, spot_idx, x, y, ux, uy): the sum of Gaussian bumps, one at its peak in each sample and seed. A seed's bumps are an array, summed in a spot's row; the
    sole exchanges are those of aggregates by sample."""
    b = bumps.select("seed", "bump_id", *[F.col(c).cast("double").alias(c) for c in ("cx", "cy", "ux", "uy", "amp")])
    f = spots.join(extent(spots).select("sample_id", "bump_width"), "sample_id").crossJoin(_by_seed(b, "bumps"))  # a row for each seed
    g = lambda u: u["amp"] * F.exp(-((F.col("x") - u["cx"]) * (F.col("x") - u["cx"]) + (F.col("y") - u["cy"]) * (F.col("y") - u["cy"])) / (2 * F.col("bump_width") * F.col("bump_width")))
    add = lambda c: F.aggregate("bumps", F.lit(0.0), lambda s, u: s + g(u) * u[c])
    f = f.select("sample_id", "seed", "spot_idx", "x", "y", add("ux").alias("ux"), add("uy").alias("uy"))
    return peak_normalize(f, "ux", "uy", ["sample_id", "seed"]).select("sample_id", "seed", "spot_idx", "x", "y", "ux", "uy")


def bump_displacement(spots: DataFrame, bumps: DataFrame, grid: DataFrame, pitch: float) -> DataFrame:
    """dx, dy of each (seed, severity, tear) of the grid."""
    f = unit_field(spots, bumps).join(grid, "seed")
    return f.select("sample_id", "seed", "severity", "tear", "spot_idx", "x", "y", (F.col("ux") * F.col("severity") * pitch).alias("dx"), (F.col("uy") * F.col("severity") * pitch).alias("dy"))


def scale_to_max_displacement(spots: DataFrame, bumps: DataFrame, max_px: float) -> DataFrame:
    return unit_field(spots, bumps).select("sample_id", "seed", "spot_idx", (F.col("ux") * max_px).alias("dx"), (F.col("uy") * max_px).alias("dy"))


def _thresholds(spots: DataFrame, cuts: DataFrame) -> DataFrame:
    """(sample_id, seed, mx, my, thr) of each cut: the sample's centre, and an exact quantile of the projections, which differs by cut: numpy's linear rule on their order. The centre is
    the numbered rows' own, as a sum made anew may differ in its last bit, and a spot lie beyond its own threshold."""
    centre = spots.groupBy("sample_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    p = spots.select("sample_id", "spot_idx", "x", "y").join(centre, "sample_id").crossJoin(cuts.select("seed", "theta", "quantile"))  # a row for each seed
    p = p.select("sample_id", "seed", "spot_idx", "quantile", "mx", "my", _projection().alias("proj"))
    group = ["sample_id", "seed"]
    p = numbered(p, group, ["proj", "spot_idx"], "r", total="n")
    own = p.groupBy(*group).agg(F.first("mx").alias("mx"), F.first("my").alias("my"))
    return own.join(quantiles(p, group, "r", "n", "proj", {"thr": F.col("quantile")}), group)


def _projection() -> Column:
    return (F.col("x") - F.col("mx")) * F.cos("theta") + (F.col("y") - F.col("my")) * F.sin("theta")


def _moved(pitch: float) -> list[Column]:
    """tx, ty and torn of a row that has tear, severity, a projection, its threshold and a cut."""
    torn = F.coalesce(F.col("tear") & (F.col("proj") > F.col("thr")), F.lit(False))
    move = F.when(torn, F.col("side") * pitch * F.col("offset_pitch") * F.greatest("severity", F.lit(1.0))).otherwise(0.0)
    return [(-F.sin("theta") * move).alias("tx"), (F.cos("theta") * move).alias("ty"), torn.alias("torn")]


def _cut_rows(rows: DataFrame, spots: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (the spots, or a field's row for each spot and seed) for each cut, with proj, thr and the cut's parameters: joins with tables of a row for each sample and seed."""
    every = _thresholds(spots, cuts).join(cuts, "seed")
    return rows.join(every, [c for c in ("sample_id", "seed") if c in rows.columns], "left" if "seed" in rows.columns else "inner").withColumn("proj", _projection())


def cut_displacement(spots: DataFrame, cuts: DataFrame, grid: DataFrame, pitch: float) -> DataFrame:
    """Spots strictly beyond the cut move along it; torn tells which. The offset is at least that of severity 1."""
    p = _cut_rows(spots.select("sample_id", "spot_idx", "x", "y"), spots, cuts).join(grid, "seed")
    return p.select("sample_id", "seed", "severity", "tear", "spot_idx", *_moved(pitch))


def apply_displacement(spots: DataFrame, bumps: DataFrame, cuts: DataFrame, grid: DataFrame, pitch: float) -> DataFrame:
    """All warps of the grid in one job: x, y (warped), x_orig, y_orig, dx, dy, torn. Field and cut meet in a spot's row for each seed; the
    grid is exploded last, from an array for each seed."""
    f = _cut_rows(unit_field(spots, bumps), spots, cuts)
    f = f.join(_by_seed(grid, "grid"), "seed").withColumn("g", F.explode("grid")).withColumns({"severity": F.col("g.severity"), "tear": F.col("g.tear")}).drop("grid", "g")
    moved = f.select("*", *_moved(pitch))
    by = lambda u, t: F.col(u) * F.col("severity") * pitch + F.coalesce(t, F.lit(0.0))
    b = moved.select("sample_id", "seed", "severity", "tear", "spot_idx", "x", "y", by("ux", "tx").alias("dx"), by("uy", "ty").alias("dy"), "torn")
    return b.select("sample_id", "seed", "severity", "tear", "spot_idx", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), F.col("x").alias("x_orig"), F.col("y").alias("y_orig"), "dx", "dy", "torn")


def displacement_stats(warped: DataFrame, by: list[str], pitch: float) -> DataFrame:
    d = F.hypot("dx", "dy")
    return warped.groupBy(*by).agg(F.max(d).alias("max_disp_px"), F.avg(d).alias("mean_disp_px"), (F.max(d) / pitch).alias("max_disp_pitch"), F.count_if("torn").alias("n_torn"))


def flip_y(spots: DataFrame) -> DataFrame:
    return spots.withColumn("y", -F.col("y"))


def normalize_frame(spots: DataFrame) -> DataFrame:
    """Coordinates less their mean over all samples, over the greatest deviation on either axis, to four places."""
    mean = spots.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c = spots.crossJoin(F.broadcast(mean)).withColumn("x", F.col("x") - F.col("mx")).withColumn("y", F.col("y") - F.col("my")).drop("mx", "my")
    scale = c.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("scale"))
    return c.crossJoin(F.broadcast(scale)).withColumn("x", F.round(F.col("x") / F.col("scale"), 4)).withColumn("y", F.round(F.col("y") / F.col("scale"), 4)).drop("scale")


def downsample_per_slice(spots: DataFrame, n: int, seed: int = 0) -> DataFrame:
    w = Window.partitionBy("sample_id").orderBy(seeded(F.col("spot_idx"), seed), "spot_idx")
    return spots.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def subsample_n(spots: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows by seeded hash, in order of index; all rows if there are no more."""
    return spots.orderBy(seeded(F.col("spot_idx"), seed), "spot_idx").limit(n).orderBy("spot_idx")


def shuffle_geometry(spots: DataFrame, seed: int = 0) -> DataFrame:
    """Coordinates permuted among the spots of each sample; features stay."""
    by_hash = numbered(spots.select("sample_id", "x", "y", "spot_idx", seeded(F.col("spot_idx"), seed).alias("_h")), ["sample_id"], ["_h", "spot_idx"], "_k")
    by_index = numbered(spots.drop("x", "y"), ["sample_id"], ["spot_idx"], "_k")
    return by_index.join(by_hash.select("sample_id", "x", "y", "_k"), ["sample_id", "_k"]).drop("_k")


def pitch_units(df: DataFrame, pitch: float, back: bool = False) -> DataFrame:
    by = pitch if back else 1.0 / pitch
    return df.withColumn("x", F.col("x") * by if back else F.col("x") / pitch).withColumn("y", F.col("y") * by if back else F.col("y") / pitch)


def stacking_height(slices: DataFrame, spacing: float) -> DataFrame:
    """Height of each sample in stacking order, centred on 0."""
    k = F.dense_rank().over(Window.orderBy("sample_id")) - 1
    return slices.select("sample_id").distinct().withColumn("k", k).withColumn("z", F.col("k") * spacing - F.max("k").over(Window.partitionBy(F.lit(0))) * spacing / 2).drop("k")
