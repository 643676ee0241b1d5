"""Scores of transport plans (run_id, pair_id, a_idx, b_idx, mass; absent rows are zero) and of predicted coordinates.
Indices are a slice's own, so a run's rows meet the spots of their pair alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import meet, numbered, quantiles
from ..functions.vectors import finite, seeded_number

NA = "NA"
RUN = ["run_id", "pair_id"]


def filter_labeled_both(pairs: DataFrame, a: str = "layer_a", b: str = "layer_b") -> DataFrame:
    return pairs.where((F.col(a) != NA) & (F.col(b) != NA))


def filter_finite(df: DataFrame, col: str = "err", mask: Column | None = None) -> DataFrame:
    return df.where(finite(F.col(col)) if mask is None else finite(F.col(col)) & mask)


def mask_scorable(df: DataFrame) -> DataFrame:
    return df.where(F.col("have") & (F.col("col_mass") > 0))


def error(px: str = "x", py: str = "y", gx: str = "gt_x", gy: str = "gt_y") -> Column:
    return F.hypot(F.col(px) - F.col(gx), F.col(py) - F.col(gy))


def registration_error_stats(df: DataFrame, by: list[str], col: str = "err", approx: bool = False, ranges: bool = False) -> DataFrame:
    """mean, median, p90, max and n of the finite errors of each group; a group without any keeps its row, with nulls and n 0.

    Percentiles are exact, from a map of a group's distinct values in one task. For groups of very many rows: approx takes
    a sketch; ranges stays exact, as rows are dealt by range of the error and only the ranks around a percentile are kept.
    """
    e = F.when(finite(F.col(col)), F.col(col))
    shares = {"median": 0.5, "p90": 0.9}
    sums = {"mean": F.avg(e), "max": F.max(e), "n": F.count(e)}
    if ranges:
        rows = df.where(finite(F.col(col))).select(*by, F.col(col).alias("_e"), F.monotonically_increasing_id().alias("_tie"))
        ranked = numbered(rows, by, ["_e", "_tie"], "_r", total="_size")
        found = meet(df.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()]), quantiles(ranked, by, "_r", "_size", "_e", {n: F.lit(q) for n, q in shares.items()}), by, "left")
    else:
        of = F.percentile_approx if approx else F.percentile
        found = df.groupBy(*by).agg(*[c.alias(n) for n, c in (sums | {n: of(e, q) for n, q in shares.items()}).items()])
    return found.select(*by, "mean", "median", "p90", "max", "n")


#: Size parameter of the sketches; the normalised rank error that it gives is put beside every percentile.
SKETCH = 400


def error_sketches(df: DataFrame, by: list[str], col: str = "err", k: int = SKETCH) -> DataFrame:
    """Mergeable statistics of the finite errors of each group: n, total, max, and a KLL sketch of their distribution, some KB however many rows. Groups without
    any stay, with n 0. Stored, they give the percentiles of any coarser grouping without the rows."""
    e = F.when(finite(F.col(col)), F.col(col).cast("double"))
    return df.groupBy(*by).agg(F.count(e).alias("n"), F.sum(e).alias("total"), F.max(e).alias("max"), F.kll_sketch_agg_double(e, k).alias("sketch"))


def rolled_up(sketches: DataFrame, by: list[str], k: int = SKETCH) -> DataFrame:
    """mean, median, p90, max and n of coarser groups from `error_sketches`, and rank_error: a percentile's rank is off by no more than this share of n, with 99 %
    confidence. A sketch that hasn't dropped anything yet (n below k) is exact but for taking the nearest value, not the mean of two."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    at = lambda q: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    off = F.when(F.col("n") <= k, 0.0).otherwise(2.296 / k**0.9723)  # Fixed values: the published fit of the sketch's two-sided 99 % error
    return merged.select(*by, F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"), at(0.5).alias("median"), at(0.9).alias("p90"), "max", "n", off.alias("rank_error"))


def coordinate_loss(df: DataFrame, pitch: float) -> DataFrame:
    return df.where("have").groupBy("pair_id").agg((F.avg(error()) / pitch).alias("loss"))


def _renamed(spots: DataFrame, idx: str, *columns) -> DataFrame:
    return spots.select("pair_id", F.col("spot_idx").alias(idx), *columns)


def _each(plan: DataFrame, spots: DataFrame, idx: str) -> DataFrame:
    """Every spot of a run's pair in that run: the shape of the result."""
    return plan.select(*RUN).distinct().join(_renamed(spots, idx), "pair_id")


def argmax_partners(plan: DataFrame, spots_a: DataFrame, spots_b: DataFrame) -> DataFrame:
    """Heaviest B of each A spot in each run, ties to the least index; an A spot without mass gets the pair's least B index."""
    best = plan.groupBy(*RUN, "a_idx").agg(F.max(F.struct("mass", (-F.col("b_idx")).alias("i"))).alias("m")).select(*RUN, "a_idx", (-F.col("m.i")).alias("best"))
    first = spots_b.groupBy("pair_id").agg(F.min("spot_idx").alias("first"))
    every = _each(plan, spots_a, "a_idx").join(first, "pair_id")
    return every.join(best, [*RUN, "a_idx"], "left").select(*RUN, "a_idx", F.coalesce("best", "first").alias("b_idx"))


def argmax_projection(plan: DataFrame, spots_a: DataFrame, spots_b: DataFrame) -> DataFrame:
    """Coordinates of the heaviest A of each B, null where a B spot has no mass."""
    best = plan.where("mass > 0").groupBy(*RUN, "b_idx").agg(F.max(F.struct("mass", (-F.col("a_idx")).alias("i"))).alias("m")).select(*RUN, "b_idx", (-F.col("m.i")).alias("a_idx"))
    found = best.join(_renamed(spots_a, "a_idx", "x", "y"), ["pair_id", "a_idx"])
    return _each(plan, spots_b, "b_idx").join(found, [*RUN, "b_idx"], "left").select(*RUN, "b_idx", "a_idx", "x", "y")


def barycentric_projection(plan: DataFrame, spots_a: DataFrame, spots_b: DataFrame) -> DataFrame:
    """Mass-weighted mean of A coordinates for each B, null where a B spot has no mass."""
    mean = plan_project_join(plan, spots_a).groupBy(*RUN, "b_idx").agg(F.sum("mass").alias("col_mass"), F.sum(F.col("mass") * F.col("x")).alias("sx"), F.sum(F.col("mass") * F.col("y")).alias("sy"))
    ok = F.col("col_mass") > 0
    found = _each(plan, spots_b, "b_idx").join(mean, [*RUN, "b_idx"], "left")
    return found.select(*RUN, "b_idx", F.coalesce("col_mass", F.lit(0.0)).alias("col_mass"), F.when(ok, F.col("sx") / F.col("col_mass")).alias("x"), F.when(ok, F.col("sy") / F.col("col_mass")).alias("y"))


def plan_project_join(plan: DataFrame, spots_a: DataFrame) -> DataFrame:
    return plan.join(_renamed(spots_a, "a_idx", "x", "y"), ["pair_id", "a_idx"])


def plan_label_join(best: DataFrame, spots_a: DataFrame, spots_b: DataFrame) -> DataFrame:
    found = best.join(_renamed(spots_a, "a_idx", F.col("layer").alias("layer_a")), ["pair_id", "a_idx"]).join(_renamed(spots_b, "b_idx", F.col("layer").alias("layer_b")), ["pair_id", "b_idx"])
    return found.select(*RUN, "a_idx", "b_idx", "layer_a", "layer_b")


def plan_mass(plan: DataFrame) -> DataFrame:
    """Per run and pair: total mass, A and B spots with mass."""
    some = F.col("mass") > 0
    return plan.groupBy(*RUN).agg(F.sum("mass").alias("total_mass"), F.countDistinct(F.when(some, F.col("a_idx"))).alias("a_with_mass"), F.countDistinct(F.when(some, F.col("b_idx"))).alias("b_with_mass"))


def label_transfer_accuracy(labelled: DataFrame, by: list[str]) -> DataFrame:
    """accuracy, n_correct, n_scored, n_dropped_a_na, n_dropped_partner_na over (layer_a, layer_b)."""
    both = (F.col("layer_a") != NA) & (F.col("layer_b") != NA)
    counts = {
        "n_correct": both & (F.col("layer_a") == F.col("layer_b")),
        "n_scored": both,
        "n_dropped_a_na": F.col("layer_a") == NA,
        "n_dropped_partner_na": (F.col("layer_a") != NA) & (F.col("layer_b") == NA),
    }
    counted = labelled.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return counted.withColumn("accuracy", F.col("n_correct") / F.greatest("n_scored", F.lit(1)))


def random_floor_trials(spots_a: DataFrame, spots_b: DataFrame, trials: int = 50, seed: int = 0) -> DataFrame:
    """Per pair: mean and population deviation of the accuracy of uniformly random partners, over seeded trials.

    Only a partner's label counts, so a number below the count of B spots is drawn, and falls into a label's share of them:
    B is a row of label counts for each pair, and no spot is numbered.
    """
    labels = spots_b.groupBy("pair_id", "layer").agg(F.count("*").alias("n"))
    shares = labels.groupBy("pair_id").agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(F.struct("layer", "n"))).alias("by"))  # a row for each label
    t = spots_a.select("pair_id", "spot_idx", F.col("layer").alias("layer_a"), F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")).join(shares, "pair_id")
    t = t.withColumn("u", F.pmod(seeded_number(F.concat_ws("/", "trial", "spot_idx"), seed), F.col("count")))
    passed = F.aggregate("by", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("string").alias("found")), lambda s, x: F.struct((s["sum"] + x["n"]).alias("sum"), F.coalesce(s["found"], F.when(F.col("u") < s["sum"] + x["n"], x["layer"])).alias("found")))
    acc = label_transfer_accuracy(t.withColumn("layer_b", passed["found"]), ["pair_id", "trial"])
    return acc.groupBy("pair_id").agg(F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"), F.count("*").alias("n_trials"))


def random_floor_exact(spots_a: DataFrame, spots_b: DataFrame) -> DataFrame:
    """Per pair the expected accuracy of a random partner: the sum over labels of both slices' shares among labelled spots."""
    share = lambda s, n: s.where(F.col("layer") != NA).groupBy("pair_id", "layer").agg(F.count("*").alias(n))
    both = share(spots_a, "na").join(share(spots_b, "nb"), ["pair_id", "layer"], "full").select("pair_id", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    return both.groupBy("pair_id").agg((F.sum(F.col("na") * F.col("nb")) / (F.greatest(F.sum("na"), F.lit(1)) * F.greatest(F.sum("nb"), F.lit(1)))).alias("floor"))


def score_report(accuracy: DataFrame, floor: DataFrame) -> DataFrame:
    return accuracy.join(floor, "pair_id").withColumn("lift_points", (F.col("accuracy") - F.col("floor")) * 100)


def prediction_shift(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Distance between two predictions (x, y) of the same spot."""
    return first.join(second.withColumnsRenamed({"x": "x2", "y": "y2"}), keys).withColumn("shift", error("x", "y", "x2", "y2"))


def prediction_spread(df: DataFrame, by: list[str]) -> DataFrame:
    """Deviation of predicted against true coordinates; a ratio near 0 means collapse to the centre."""
    s = df.where("have").groupBy(*by).agg(*[F.stddev_pop(c).alias(f"sd_{c}") for c in ("x", "y", "gt_x", "gt_y")])
    return s.withColumn("ratio", F.sqrt((F.col("sd_x") ** 2 + F.col("sd_y") ** 2) / (F.col("sd_gt_x") ** 2 + F.col("sd_gt_y") ** 2)))
