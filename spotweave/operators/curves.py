"""Experiment analytics over curves: method, fold, seed, severity, role, reg_err and the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import written
from .scoring import registration_error_stats


def severity_curve(df: DataFrame, by: list[str], col: str = "reg_err") -> DataFrame:
    """All error statistics for each severity, one grouped job for all runs."""
    return registration_error_stats(df, [*by, "severity"], col)


def multi_seed_ci(curves: DataFrame, by: list[str], col: str = "reg_err") -> DataFrame:
    """Mean of seeds, sample deviation and 95 % interval; one seed has interval 0."""
    s = curves.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.count(col).alias("n"))
    return s.withColumn("std", F.coalesce("std", F.lit(0.0))).withColumn("ci", F.coalesce(1.96 * F.col("std") / F.sqrt("n"), F.lit(0.0)))


def degradation(curve: DataFrame, by: list[str], col: str) -> DataFrame:
    g = curve.groupBy(*by).agg(F.min_by(col, "severity").alias("first"), F.max_by(col, "severity").alias("last"))
    return g.withColumn("delta", F.col("last") - F.col("first")).withColumn("percent", 100 * F.col("delta") / F.col("first"))


def method_join(curve: DataFrame, a: str, b: str, keys: list[str], col: str) -> DataFrame:
    of = lambda m, n: curve.where(F.col("method") == m).select(*keys, F.col(col).alias(n))
    return of(a, "err_a").join(of(b, "err_b"), keys)


def method_ratio(curve: DataFrame, a: str, b: str, keys: list[str], col: str, pitch: float) -> DataFrame:
    j = method_join(curve, a, b, keys, col)
    return j.withColumn("ratio", F.col("err_b") / F.col("err_a")).withColumn("sub_pitch", F.col("err_a") < pitch)


def generalization_gap(curve: DataFrame, by: list[str], col: str) -> DataFrame:
    of = lambda r: F.avg(F.when(F.col("role") == r, F.col(col)))
    return curve.groupBy(*by).agg((of("test") - of("train")).alias("gap"))


def fold_summary(curve: DataFrame, series: list[str], col: str) -> DataFrame:
    """Fold by method, each cell "first->last" over severities."""
    ends = curve.groupBy("fold", "method").agg(F.min_by(col, "severity").alias("first"), F.max_by(col, "severity").alias("last"))
    cells = ends.select("fold", "method", written("%.0f->%.0f", F.col("first"), F.col("last")).alias("text"))
    return cells.groupBy("fold").pivot("method", series).agg(F.first("text"))


def method_table(ci: DataFrame, series: list[str], by: tuple[str, ...] = ("severity",)) -> DataFrame:
    """Rows by severity, or by fold and severity, columns by method; each cell "mean+-ci", n/a where there is none."""
    cells = ci.select(*by, "method", written("%.1f+-%.1f", F.col("mean"), F.col("ci")).alias("text"))
    p = cells.groupBy(*by).pivot("method", series).agg(F.first("text"))
    return p.select(*by, *[F.coalesce(F.col(f"`{s}`"), F.lit("n/a")).alias(s) for s in series])


def magnitude_matched(left: DataFrame, right: DataFrame, key: str, magnitude: str = "mean_disp_px") -> DataFrame:
    """For each left row the right row of nearest magnitude (ties: the smaller, then the lower severity). Both (severity, magnitude, err). No join: both sides are put in one order,
    and a left row looks at the right rows before and after it. Rows without a magnitude match nothing."""
    of = lambda df, side: df.where(F.col(magnitude).isNotNull()).select(key, F.lit(side).alias("side"), F.col("severity").alias("sev"), F.col(magnitude).alias("mag"), "err")
    order = Window.partitionBy(key).orderBy("mag", "side", "sev")
    right_row = F.when(F.col("side") == 1, F.struct("mag", "sev", "err"))
    # of equal magnitudes the first severity: right rows come before left ones in one order, after them in the other
    first = Window.partitionBy(key, "side", "mag").orderBy("sev").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = of(left, 2).union(of(right, 1)).withColumn("r", F.when(F.col("side") == 1, F.first(right_row).over(first)))
    both = both.withColumn("low", F.last("r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("high", F.first("r", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    near = F.when(F.col("low").isNull(), F.col("high")).when(F.col("high").isNull() | (F.col("mag") - F.col("low.mag") <= F.col("high.mag") - F.col("mag")), F.col("low")).otherwise(F.col("high"))
    found = both.where("side = 2").withColumn("m", near).where("m is not null")
    return found.select(key, F.col("sev").alias("sev_a"), F.col("mag").alias("mag_a"), F.col("err").alias("err_a"), F.col("m.sev").alias("sev_b"), F.col("m.mag").alias("mag_b"), F.col("m.err").alias("err_b"))


def metric_summary_by_method(curves: DataFrame, col: str = "reg_err") -> DataFrame:
    return registration_error_stats(curves, ["method"], col).select("method", "median", "p90", "n")


def first_last_severity(curve: DataFrame, by: list[str], col: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("severity").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return curve.select(*by, "severity", F.first_value(col).over(w).alias("first"), F.last_value(col).over(w).alias("last"))


def severity_step(curve: DataFrame, by: list[str], col: str) -> DataFrame:
    """Segments [s0, s1) of a curve; the last has none after it."""
    w = Window.partitionBy(*by).orderBy("severity")
    return curve.select(*by, F.col("severity").alias("s0"), F.lead("severity").over(w).alias("s1"), F.col(col).alias("e0"), F.lead(col).over(w).alias("e1"))


def interpolate_curve(curve: DataFrame, at: list[float], by: list[str], col: str) -> DataFrame:
    """Piecewise linear value of each curve at each place of a list, clamped at its ends. No join: a curve's points and the
    places asked for are put in one order, and a place looks at the points before and after it."""
    points = curve.select(*by, F.col("severity").alias("s"), F.col(col).alias("e"), F.lit(False).alias("asked"))
    places = curve.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(float(x)) for x in at])).alias("s"), F.lit(None).cast("double").alias("e"), F.lit(True).alias("asked"))
    order = Window.partitionBy(*by).orderBy("s", "asked")
    point = F.when(~F.col("asked"), F.struct("s", "e"))
    both = points.union(places).withColumn("low", F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("high", F.first(point, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    part = (F.col("s") - F.col("low.s")) / (F.col("high.s") - F.col("low.s"))
    value = F.when(F.col("low").isNull(), F.col("high.e")).when(F.col("high").isNull(), F.col("low.e")).otherwise(F.col("low.e") + part * (F.col("high.e") - F.col("low.e")))
    return both.where("asked").select(*by, "s", value.alias(col))


def severity_subset(curve: DataFrame, keep: list[float]) -> DataFrame:
    return curve.where(F.col("severity").isin(keep))


def best_config(curve: DataFrame, by: str, config: str, col: str) -> DataFrame:
    """The configuration of least error of each group, ties to the first by name."""
    m = F.min(F.struct(F.col(col).alias("e"), F.col(config).alias("c"))).alias("m")
    return curve.groupBy(by).agg(m).select(by, F.col("m.c").alias(config), F.col("m.e").alias(col))


def exclusive_running_sum(df: DataFrame, order: str, col: str, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(col).over(w), F.lit(0)))


def unpivot_history(wide: DataFrame, key: str = "epoch") -> DataFrame:
    return wide.unpivot(key, [c for c in wide.columns if c != key], "metric", "value")


def param_grid(spark, **values) -> DataFrame:
    """All combinations of the given lists, which are short."""
    out = None
    for name, items in values.items():
        kind = "double" if isinstance(items[0], float) else "long" if isinstance(items[0], int) and not isinstance(items[0], bool) else "boolean" if isinstance(items[0], bool) else "string"
        part = spark.createDataFrame([(x,) for x in items], f"{name} {kind}")
        out = part if out is None else out.crossJoin(F.broadcast(part))
    return out


def leave_one_group_out(slices: DataFrame, group: str = "donor") -> DataFrame:
    """(fold, group, sample, role): each group is the test set once."""
    g = slices.select(group).distinct()
    folds = g.select(F.col(group).alias("fold")).crossJoin(g)  # the shape of the result: every fold has every group
    return folds.join(slices, group).select("fold", group, "sample_id", F.when(F.col("fold") == F.col(group), "test").otherwise("train").alias("role"))


def pending_runs(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(done, keys, "left_anti")


def run_ledger_summary(ledger: DataFrame, failed: str = "F") -> DataFrame:
    return ledger.groupBy("batch").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == failed).alias("failures"), F.count_if(F.col("status") != failed).alias("completed"))


def parse_pairs(specs: DataFrame, col: str = "spec") -> DataFrame:
    """'a/b, c/d' to rows (pos, a, b)."""
    one = specs.select(col, F.posexplode(F.split(col, ",")).alias("pos", "chunk")).where(F.trim("chunk") != "")
    part = F.split("chunk", "/")
    return one.select(col, "pos", F.trim(F.get(part, F.lit(0))).alias("a"), F.trim(F.get(part, F.lit(1))).alias("b"))


def parse_severities(c: Column) -> Column:
    return F.transform(F.split(c, ","), lambda x: F.trim(x).cast("double"))


def dataset_stats(spots: DataFrame, genes: DataFrame, by: str = "donor") -> DataFrame:
    """Per donor: sections, spots, spots a section, labelled spots, and distinct genes. spots: donor, sample_id, layer; genes: donor, gene_idx."""
    per = spots.groupBy(by).agg(F.countDistinct("sample_id").alias("sections"), F.count("*").alias("spots"), F.count_if(F.col("layer") != "NA").alias("labelled"))
    panel = genes.groupBy(by).agg(F.countDistinct("gene_idx").alias("genes"))
    return per.join(panel, by, "left").select(by, "sections", "spots", (F.col("spots") / F.col("sections")).alias("mean_spots"), "labelled", F.coalesce("genes", F.lit(0)).alias("genes"))


def label_counts(spots: DataFrame) -> DataFrame:
    return spots.groupBy("sample_id", "layer").count().orderBy("sample_id", "layer")
