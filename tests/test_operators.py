import json
import math
import random

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F
from spotweave.functions import vectors as V
from spotweave.functions.runtime import numbered
from spotweave.operators import bridge as B
from spotweave.operators import curves as C
from spotweave.operators import features as E
from spotweave.operators import neighbors as N
from spotweave.operators import scoring as S
from spotweave.operators import transforms as T
from spotweave.plans import fixtures as X
from spotweave.plans.bindings import QUERIES
from spotweave.sources import intake as I
from spotweave.sources import slices as L
from spotweave.streaming.leads import stream_leads

SPOTS = "pair_id string, sample_id string, spot_idx long, array_row int, array_col int, x double, y double, layer string"


def spots(spark, rows):
    """Rows without a pair are of pair p."""
    return spark.createDataFrame([r if len(r) == 8 else ("p", *r) for r in rows], SPOTS)


def test_bridge_takes_the_last_of_a_position_and_never_fans_out(spark):
    a = spots(spark, [("A", 0, 1, 1, 0.0, 0.0, "L"), ("A", 5, 1, 1, 9.0, 9.0, "L"), ("A", 7, 2, 2, 1.0, 1.0, "L")])
    b = spots(spark, [("B", 1, 1, 1, 0.0, 0.0, "L"), ("B", 2, 3, 3, 0.0, 0.0, "L")])
    got = {r.b_idx: (r.a_idx, r.gt_x, r.have) for r in B.array_bridge(a, b).collect()}
    assert got == {1: (5, 9.0, True), 2: (None, None, False)}
    assert {r.b_idx: r.a_idx for r in B.partner_index(a, b).collect()} == {1: 5, 2: -1}


def test_error_percentiles_by_ranges_are_exact(spark):
    """Rows dealt by range give what one map of all values gives: a hot group, equal values, a group without a name, one without a finite error."""
    rng = random.Random(5)
    rows = [("hot", float(rng.randrange(40))) for _ in range(3000)] + [("few", rng.random()) for _ in range(7)] + [("one", 2.5), (None, 1.0), (None, 4.0), ("none", None), ("none", math.nan), ("few", math.inf)]
    df = spark.createDataFrame(rows, "run string, err double").repartition(5)
    show = lambda d: {r.run: tuple(None if v is None else round(v, 9) for v in (r["mean"], r.median, r.p90, r["max"], r.n)) for r in d.collect()}
    got = show(S.registration_error_stats(df, ["run"], ranges=True))
    assert got == show(S.registration_error_stats(df, ["run"])) and len(got) == 5 and got["none"] == (None, None, None, None, 0)
    hot = [v for k, v in rows if k == "hot"]
    assert got["hot"][1:3] == (round(float(np.quantile(hot, 0.5)), 9), round(float(np.quantile(hot, 0.9)), 9))
    assert show(S.registration_error_stats(df.where("run = 'nobody'"), ["run"], ranges=True)) == {}


def test_pairs_are_kept_apart(spark):
    """Two pairs whose slices have the same indices and positions, in one frame."""
    a = spots(spark, [(p, "A", i, 0, i, float(i + off), 0.0, lab) for p, off, lab in (("p", 0, "L1"), ("q", 100, "L2")) for i in range(4)])
    b = spots(spark, [(p, "B", i, 0, i, 0.0, 0.0, lab) for p, lab in (("p", "L1"), ("q", "L2")) for i in range(4)])
    assert {(r.pair_id, r.b_idx): r.gt_x for r in B.array_bridge(a, b).collect()} == {(p, i): float(i + off) for p, off in (("p", 0), ("q", 100)) for i in range(4)}
    plan = spark.createDataFrame([("r", "p", 0, 1, 2.0), ("r", "q", 3, 1, 2.0), ("s", "q", 1, 2, 1.0)], "run_id string, pair_id string, a_idx long, b_idx long, mass double")
    got = {(r.run_id, r.pair_id, r.b_idx): r.x for r in S.barycentric_projection(plan, a, b).collect()}
    assert len(got) == 12 and {k: v for k, v in got.items() if v is not None} == {("r", "p", 1): 0.0, ("r", "q", 1): 103.0, ("s", "q", 2): 101.0}
    best = S.argmax_partners(plan, a, b)
    assert best.count() == 12 and {r.pair_id: r.n_correct for r in S.label_transfer_accuracy(S.plan_label_join(best, a, b), ["pair_id"]).collect()} == {"p": 4, "q": 8}
    assert {(r.pair_id, r.dst) for r in N.radius_join(b.withColumnRenamed("spot_idx", "c_idx"), a, 1.5).collect()} == {("p", 0), ("p", 1)}
    snapped = N.snap_to_nearest(b.select("pair_id", F.col("spot_idx").alias("b_idx"), "x", "y"), a).collect()
    assert {(r.pair_id, r.a_idx, r.moved) for r in snapped} == {("p", 0, 0.0), ("q", 0, 100.0)}
    rng = np.random.default_rng(1)
    v = {(p, s): rng.normal(size=(4, 3)) for p in "pq" for s in "AB"}
    qk = spark.createDataFrame([(p, s, i, m[i].tolist()) for (p, s), m in v.items() for i in range(4)], "pair_id string, side string, spot_idx long, v array<double>")
    top = {p: float(np.mean((v[p, "B"] @ v[p, "A"].T).argmax(1) == np.arange(4))) for p in "pq"}
    assert {r.pair_id: r.top1 for r in E.match_top1(qk, B.partner_index(a, b), block=2).collect()} == top
    support = {r.pair_id: r.support for r in E.effective_support(qk, block=3).collect()}
    target = N.soft_target(B.partner_index(a, b), a, 1.0, 0.5)
    loss = {r.pair_id: r.loss for r in E.soft_cross_entropy(qk, target, block=3).collect()}
    for p in "pq":
        logit = v[p, "B"] @ v[p, "A"].T / np.sqrt(3)
        soft = np.exp(logit) / np.exp(logit).sum(1, keepdims=True)
        assert abs(support[p] - np.median(1 / (soft**2).sum(1))) < 1e-9
        g = np.exp(-((np.arange(4)[:, None] - np.arange(4)[None]) ** 2) / 0.5) * (np.abs(np.arange(4)[:, None] - np.arange(4)[None]) <= 2)
        w = g / g.sum(1, keepdims=True)
        assert abs(loss[p] - np.mean(np.log(np.exp(logit).sum(1)) - (w * logit).sum(1))) < 1e-9


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_of_large_groups(spark):
    """No nested loops, no product, and no window over all rows."""
    df = spots(spark, [("A", i, 0, i, float(i % 7), float(i // 7), "x") for i in range(49)])
    curve = spark.createDataFrame([("m", 0.0, 1.0), ("m", 4.0, 3.0)], "method string, severity double, err double")
    genes = spark.createDataFrame([("s", 1, "g1"), ("t", 1, "g2"), ("s", 2, "x")], "sample_id string, gene_idx int, gene_name string")
    edges = spark.createDataFrame([("A", 0, 1, 1.0, 0.0)], "sample_id string, src long, dst long, rel_x double, rel_y double")
    z = spark.createDataFrame([("A", i, [1.0, float(i)]) for i in range(3)], "sample_id string, spot_idx long, z array<double>")
    plans = [C.interpolate_curve(curve, [1.0, 9.0], ["method"], "err"), N.message_hop(edges, z), S.random_floor_trials(df, df), T.shuffle_geometry(df), N.snap_to_nearest(df.withColumnRenamed("spot_idx", "b_idx"), df)]
    for out in plans:
        text = plan_of(out)
        assert "NestedLoop" not in text and "Cartesian" not in text
    for out in (plans[0], plans[1], plans[2], plans[3]):
        assert "SinglePartition" not in plan_of(out)
    assert sorted((r.s, r.err) for r in plans[0].collect()) == [(1.0, 1.5), (9.0, 3.0)]
    assert {tuple(r) for r in E.assert_same_genes(genes, "s").collect()} == {("t", 1), ("t", 2)}


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), ((F.col("id") * 7919) % 5003).alias("v"))
    got = numbered(df, ["g"], ["v"], "k").collect()
    for g in "ab":
        mine = sorted((r.v, r.k) for r in got if r.g == g)
        assert [k for _, k in mine] == list(range(len(mine)))


def test_a_crowded_spot_in_a_wide_sample(spark):
    """A third of all points in a thousandth of the width: cells shrink, and neighbours stay exact."""
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.uniform(0, 1000, (200, 2)), rng.uniform(500, 500.5, (100, 2))])
    df = spots(spark, [("A", i, 0, i, float(x), float(y), "x") for i, (x, y) in enumerate(xy)])
    got = {(r.src, r["rank"]): r.dst for r in N.knn_spatial(df, 3).collect()}
    d = ((xy[:, None] - xy[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, k + 1): int(j) for i in range(300) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3])}


@pytest.mark.parametrize("value,text", [(0.1 + 0.2, "0p3"), (1e-5, "1e-05"), (1e6, "1e+06"), (2 / 3, "0p666667"), (0.5, "0p5"), (8.0, "8"), (0.0, "0"), (-2.5, "-2p5"), (123456.7, "123457"), (1e-4, "0p0001"), (10.0, "10"), (-1e-9, "-1e-09"), (1234567.0, "1p23457e+06")])
def test_severity_tag(spark, value, text):
    assert spark.range(1).select(V.severity_tag(F.lit(value))).first()[0] == text == f"{value:g}".replace(".", "p")


@pytest.mark.parametrize("value", [1.5e6 * 66669, 1.5e6 * 66671, -179612.5, 0.1234565, 999999.5, 5e-324, 1.7976931348623157e308])
def test_severity_tag_of_halves(spark, value):
    assert spark.range(1).select(V.severity_tag(F.lit(value))).first()[0] == f"{value:g}".replace(".", "p")


def test_table_cells_round_exact_halves_to_even(spark):
    ci = spark.createDataFrame([("a", 0, 1.0, 12.25, 0.75), ("b", 0, 1.0, 35.05, 0.25)], "method string, fold int, severity double, mean double, ci double")
    assert C.method_table(ci, ["a", "b", "c"], ("fold", "severity")).collect() == [(0, 1.0, "12.2+-0.8", f"{35.05:.1f}+-0.2", "n/a")]
    curve = spark.createDataFrame([(0, "a", 1.0, 2.5), (0, "a", 2.0, 3.5)], "fold int, method string, severity double, err double")
    assert C.fold_summary(curve, ["a", "b"], "err").collect() == [(0, "2->4", None)]


def test_curve_files_of_all_generations(spark, tmp_path):
    for name, text in {
        "run_one_cut_S2_seed9999": "severity,max_disp_px,mean_disp_px,reg_err_mean,reg_err_median,reg_err_p90,n_reg_scored,paste2_acc,random_floor,n_label_scored,runtime_s\n0.0,1,2,3,4,5,6,0.7,0.4,9,10\n0.0,1,2,3,44,5,6,0.7,0.4,9,10\n",
        "learned_v2_testS1_test_curve": "severity,reg_err_median,reg_err_mean,reg_err_p90,match_top1,n\n8.0,1.5,2.5,3.5,0.25,77\n", "left_out_heldBr5292_train_curve": "severity,reg_err_median,reg_err_mean,reg_err_p90,n\n2,1,2,3,4\n\n",
    }.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = {r.run: r for r in L.scan_curves(spark, str(tmp_path)).collect()}
    assert {(r.method, r.fold, r.seed, r.role, r.severity, r.reg_err_median, r.match_top1, r.n, r.runtime_s) for r in got.values()} == {
        ("run_one_cut", "S2", 9999, None, 0.0, 44.0, None, None, 10.0), ("learned_v2", "S1", None, "test", 8.0, 1.5, 0.25, 77.0, None), ("left_out", "Br5292", None, "train", 2.0, 1.0, None, 4.0, None),
    }


def test_errors_that_are_not_finite_dont_count_and_groups_stay(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("r", 1.0), ("r", 2.0), ("r", nan), ("r", inf), ("r", None), ("s", nan)], "run string, err double")
    got = {r.run: r for r in S.registration_error_stats(df, ["run"]).collect()}
    assert (got["r"]["mean"], got["r"]["median"], got["r"]["n"]) == (1.5, 1.5, 2)
    assert abs(got["r"]["p90"] - np.percentile([1, 2], 90)) < 1e-12
    assert (got["s"]["mean"], got["s"]["n"]) == (None, 0)
    assert S.filter_finite(df).count() == 2


def test_ties_and_rows_without_mass(spark):
    a = spots(spark, [("A", i, 0, i, float(i), 0.0, "x") for i in (0, 2, 4)])
    b = spots(spark, [("B", i, 0, i, 0.0, 0.0, "x") for i in (1, 3)])
    plan = spark.createDataFrame([("r", "p", 0, 1, 2.0), ("r", "p", 0, 3, 2.0), ("r", "p", 2, 3, 5.0), ("r", "p", 0, 1, 0.0)], "run_id string, pair_id string, a_idx long, b_idx long, mass double").groupBy("run_id", "pair_id", "a_idx", "b_idx").agg(F.sum("mass").alias("mass"))
    assert {r.a_idx: r.b_idx for r in S.argmax_partners(plan, a, b).collect()} == {0: 1, 2: 3, 4: 1}
    zero = plan.where("b_idx = 3")
    assert {r.b_idx: r.x for r in S.barycentric_projection(zero, a, b).collect()} == {1: None, 3: 10 / 7}
    assert {r.b_idx: r.a_idx for r in S.argmax_projection(zero, a, b).collect()} == {1: None, 3: 2}


def test_permutation_plan_gives_the_same_soft_and_hard(spark):
    a = spots(spark, [("A", i, 0, i, float(i), float(-i), "x") for i in range(6)])
    b = spots(spark, [("B", i, 0, i, 0.0, 0.0, "x") for i in range(6)])
    plan = spark.createDataFrame([("r", "p", (i * 5) % 6, i, 0.3) for i in range(6)], "run_id string, pair_id string, a_idx long, b_idx long, mass double")
    soft = {r.b_idx: (round(r.x, 9), round(r.y, 9)) for r in S.barycentric_projection(plan, a, b).collect()}
    assert soft == {r.b_idx: (r.x, r.y) for r in S.argmax_projection(plan, a, b).collect()}


def test_na_is_a_label_and_denominators_are_clamped(spark):
    df = spark.createDataFrame([("r", "L1", "L1"), ("r", "NA", "L1"), ("r", "L1", "NA"), ("r", "L1", "L2"), ("s", "NA", "NA")], "run_id string, layer_a string, layer_b string")
    got = {r.run_id: (r.n_correct, r.n_scored, r.n_dropped_a_na, r.n_dropped_partner_na, r.accuracy) for r in S.label_transfer_accuracy(df, ["run_id"]).collect()}
    assert got == {"r": (1, 2, 1, 1, 0.5), "s": (0, 0, 1, 0, 0.0)}


def test_random_floor_trials_near_exact(spark):
    r = random.Random(1)
    a = spots(spark, [("A", i, 0, i, 0.0, 0.0, r.choice(["p", "q", "NA"])) for i in range(300)])
    b = spots(spark, [("B", i, 0, i, 0.0, 0.0, r.choice(["p", "q", "q", "NA"])) for i in range(200)])
    t, e = S.random_floor_trials(a, b, 40).first(), S.random_floor_exact(a, b).first()
    assert abs(t.accuracy_mean - e.floor) < 4 * max(t.accuracy_std, 0.01) / math.sqrt(40) + 0.01


@pytest.mark.parametrize("kind", ["random", "clustered", "duplicates"])
def test_grid_neighbours_equal_brute_force(spark, kind):
    r = np.random.default_rng(4)
    xy = r.normal(size=(150, 2)) * 50
    if kind == "clustered":
        xy = np.concatenate([r.normal(size=(140, 2)) * 0.01, [[500, 500], [501, 500], [-300, 9]]])
    if kind == "duplicates":
        xy = np.repeat(xy[:20], 6, axis=0)
    df = spots(spark, [("A", i, 0, i, float(x), float(y), "x") for i, (x, y) in enumerate(xy)])
    got = {}
    for row in N.knn_spatial(df, 4).collect():
        got.setdefault(row.src, []).append((row["rank"], row.dst))
    for i in range(len(xy)):
        d = sorted((float(((xy[i] - xy[j]) ** 2).sum()), j) for j in range(len(xy)) if j != i)
        assert [j for _, j in sorted(got[i])] == [j for _, j in d[:4]] or np.allclose(sorted(((xy[i] - xy[j]) ** 2).sum() for _, j in got[i]), [v for v, _ in d[:4]])


def test_neighbour_plans_have_no_cartesian_product(spark):
    df = spots(spark, [("A", i, 0, i, float(i % 7), float(i // 7), "x") for i in range(49)])
    for out in (N.knn_spatial(df, 3), N.radius_join(df.withColumnRenamed("spot_idx", "c_idx"), df, 2.0)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_mutual_edges_count_twice_and_lonely_nodes_stay(spark):
    e = spark.createDataFrame([("A", 0, 1), ("A", 1, 0)], "sample_id string, src long, dst long")
    assert N.symmetrize_edges(e).count() == 4
    edges = N.symmetrize_edges(e).withColumns({"rel_x": F.lit(1.0), "rel_y": F.lit(0.0)})
    f = spark.createDataFrame([("A", 0, [1.0]), ("A", 1, [5.0]), ("A", 2, [7.0])], "sample_id string, spot_idx long, z array<double>")
    assert {r.spot_idx: (r.z, r.off_x) for r in N.message_hop(edges, f).collect()} == {0: (6.0, 1.0), 1: (6.0, 1.0), 2: (7.0, 0.0)}


def test_a_cut_moves_at_severity_zero_and_strictly_beyond(spark):
    df = spots(spark, [("A", i, 0, i, float(i), 0.0, "x") for i in range(11)])
    bumps = spark.createDataFrame([(0, 0, 5.0, 0.0, 1.0, 0.0, 1.0)], "seed int, bump_id int, cx double, cy double, ux double, uy double, amp double")
    cuts = spark.createDataFrame([(0, 0.0, 0.6, 1, 3.0)], "seed int, theta double, quantile double, side int, offset_pitch double")
    grid = spark.createDataFrame([(0, 0.0, True), (0, 0.0, False), (0, 2.0, False)], "seed int, severity double, tear boolean")
    got = T.apply_displacement(df, bumps, cuts, grid, 10.0).collect()
    torn = {r.spot_idx: (r.dx, r.dy, r.torn) for r in got if r.tear}
    assert all(torn[i] == (0.0, 30.0, True) if i > 6 else torn[i] == (0.0, 0.0, False) for i in range(11))
    assert all((r.x, r.y) == (r.x_orig, r.y_orig) for r in got if r.severity == 0 and not r.tear)
    assert abs(max(math.hypot(r.dx, r.dy) for r in got if r.severity == 2) - 20.0) < 1e-9


def test_one_seed_has_no_interval(spark):
    df = spark.createDataFrame([("m", 0, 5.0), ("k", 0, 1.0), ("k", 1, 3.0)], "method string, seed int, reg_err double")
    got = {r.method: (r["mean"], r.ci) for r in C.multi_seed_ci(df, ["method"]).collect()}
    assert got["m"] == (5.0, 0.0)
    assert abs(got["k"][1] - 1.96 * np.std([1, 3], ddof=1) / math.sqrt(2)) < 1e-12


def test_svd_basis_equals_numpy(spark):
    r = np.random.default_rng(2)
    m = np.maximum(r.normal(size=(60, 4)) @ r.normal(size=(4, 30)), 0)
    rows = [("A", i, g, float(m[i, g])) for i in range(60) for g in range(30) if m[i, g]]
    v = E.shared_svd_basis(spark.createDataFrame(rows, "sample_id string, spot_idx long, gene_idx int, v double"), 3, 30, rounds=8)
    w = np.zeros((30, 3))
    for x in v.collect():
        w[x.gene_idx, x.dim] = x.w
    want = np.linalg.svd(m, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs(w), np.abs(want), atol=1e-4)


def test_softmax_rows_and_soft_targets_sum_to_one(spark):
    r = np.random.default_rng(3)
    qk = spark.createDataFrame([("p", s, i, r.normal(size=4).tolist()) for s in "AB" for i in range(9)], "pair_id string, side string, spot_idx long, v array<double>")
    p = E.softmax_over_row(E.attention_logits(qk)).groupBy("b_idx").agg(F.sum("p").alias("s")).collect()
    assert len(p) == 9 and all(abs(x.s - 1) < 1e-9 for x in p)
    a = spots(spark, [("A", i, 0, i, float(i), 0.0, "x") for i in range(9)])
    t = N.soft_target(spark.createDataFrame([("p", 1, 3), ("p", 2, -1)], "pair_id string, b_idx long, a_idx long"), a, 1.0, 0.5).collect()
    assert sorted(x.a_idx for x in t) == [1, 2, 3, 4, 5] and abs(sum(x.w for x in t) - 1) < 1e-9


def test_leads(spark, tmp_path):
    good = (" Ann Bee ", "a.b@c.org", "Co ", " ", "1-10", " help", None, None)
    rows = [good, ("", *good[1:]), (good[0], "no at", *good[2:]), (good[0], "space in@c.org", *good[2:]), (*good[:-1], "bot"), (*good[:5], "x" * 5001, None, "")]
    df = spark.createDataFrame(rows, I.LEAD)
    why = [r.reasons for r in I.validate_lead(df).collect()]
    assert why == [[], ["full_name required"], ["email shape"], ["email shape"], [], ["looking_for length"]]
    assert [(r.full_name, r.company, r.role, r.looking_for) for r in I.valid(df).collect()] == [("Ann Bee", "Co", None, "help")]
    root = str(tmp_path / "t")
    assert I.append_leads(df, root, 0) and I.append_leads(df, root, 1) and not I.append_leads(df, root, 1)
    landed = I.read_leads(spark, root).collect()
    assert len(landed) == 2 and len({r.id for r in landed}) == 2 and all(r.created_at for r in landed)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(r.asDict()) for r in df.collect()))
    stream_leads(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    assert I.read_leads(spark, str(tmp_path / "s")).count() == 1 and I.read_leads(spark, str(tmp_path / "s"), "rejected").count() == 4


def test_upload_signature(spark, tmp_path):
    magic = bytes.fromhex(I.HDF5_MAGIC)
    (tmp_path / "deep").mkdir()
    for name, body in {"a.h5ad": magic + b"x" * 100_000, "b.H5AD": b"", "c.h5ad": b"12345678", "d.txt": magic, "deep/e.h5ad": magic[:4], "_f.h5ad": magic}.items():
        (tmp_path / name).write_bytes(body)
    files = I.scan_uploads(spark, str(tmp_path))
    assert {(r.path[-6:], r["size"], bytes(r["head"])) for r in files.collect()} == {("a.h5ad", 100_008, magic), ("b.H5AD", 0, b""), ("c.h5ad", 8, b"12345678"), ("/d.txt", 8, magic), ("e.h5ad", 4, magic[:4])}
    got = {r.path[-6:]: (r.status, r.reason) for r in I.upload_signature_check(files).collect()}
    assert got == {"a.h5ad": (200, "ok"), "b.H5AD": (400, "empty"), "c.h5ad": (415, "signature"), "/d.txt": (400, "name"), "e.h5ad": (415, "signature")}


def test_round_trips(spark, tmp_path):
    c = spark.createDataFrame([(0.0, 1.5), (8.0, 2.5)], "severity double, err double")
    L.write_curves(c, str(tmp_path / "c"))
    got = L.scan_curves(spark, str(tmp_path / "c"), ["err"])
    assert sorted((r.severity, r.err) for r in got.collect()) == [(0.0, 1.5), (8.0, 2.5)]
    plan = spark.createDataFrame([("r", "p", 0, 1, 2.0), ("s", "p", 0, 1, 3.0)], "run_id string, pair_id string, a_idx long, b_idx long, mass double")
    L.write_plan(plan, str(tmp_path / "p"))
    assert [r.mass for r in L.scan_plan(spark, str(tmp_path / "p"), "s").collect()] == [3.0]
    kv = spark.createDataFrame([("a", "1=2"), ("b", "x")], "key string, value string")
    L.write_summary(kv, str(tmp_path / "s"))
    assert sorted((r.key, r.val) for r in L.scan_summary(spark, str(tmp_path / "s")).collect()) == [("a", "1=2"), ("b", "x")]
    spots(spark, [("A", 0, 0, 0, 0.0, 0.0, "x")]).drop("pair_id").write.partitionBy("sample_id").parquet(str(tmp_path / "t"))
    assert L.scan_slice(spark, str(tmp_path / "t"), "A").count() == 1
    with pytest.raises(FileNotFoundError):
        L.scan_slice(spark, str(tmp_path / "t"), "Z")
    assert [r[0] for r in spark.createDataFrame([(0.5,), (8.0,)], "s double").select(V.severity_tag(F.col("s"))).collect()] == ["0p5", "8"]


def test_matching_in_many_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = {s: rng.integers(-2, 3, (n, 3)).astype(float) for s, n in (("A", 37), ("B", 23))}
    qk = spark.createDataFrame([(p, s, i, v[s][i].tolist()) for p in ("p", "q") for s in "AB" for i in range(len(v[s]))] + [("p", "A", 99, None), ("r", "B", 1, [0.0] * 3)], "pair_id string, side string, spot_idx long, v array<double>")
    a = spots(spark, [(p, "A", i, 0, i, float(i * i % 7), float(-i), "L") for p in "pq" for i in range(37)])
    d = np.sqrt(((v["B"][:, None] - v["A"][None]) ** 2).sum(2))
    want = {(p, b, r + 1): int(i) for p in "pq" for b in range(23) for r, i in enumerate(np.lexsort((np.arange(37), d[b]))[:4])}
    assert {(r.pair_id, r.b_idx, r["rank"]): r.a_idx for r in E.topk_neighbors(qk, 4, block=5).collect()} == want
    logit = v["B"] @ v["A"].T / np.sqrt(3)
    p = np.exp(logit) / np.exp(logit).sum(1, keepdims=True)
    x = p @ np.array([float(i * i % 7) for i in range(37)])
    got = E.attention_match(qk, a, block=5).collect()
    assert len(got) == 46 and all(abs(r.x - x[r.b_idx]) < 1e-9 for r in got)
    assert E.attention_logits(qk, block=5).count() == 2 * 37 * 23


def test_vectors_that_are_not_finite_match_nothing(spark):
    nan, shape = math.nan, "pair_id string, side string, spot_idx long, v array<double>"
    rows = [("p", s, i, v) for s in "AB" for i, v in enumerate(([1.0, 2.0], [5.0, 2.0]))]
    good = spark.createDataFrame(rows, shape)
    odd = good.union(spark.createDataFrame([("p", "A", 7, [1.0, None]), ("p", "A", 8, [nan, 1.0]), ("p", "A", 9, [math.inf, 1.0]), ("p", "B", 7, [nan, nan]), ("p", "B", 8, None)], shape))
    a = spots(spark, [("A", i, 0, i, float(i), 1.0, "L") for i in (0, 1, 7, 8, 9)])
    partner = spark.createDataFrame([("p", 0, 0), ("p", 1, 0)], "pair_id string, b_idx long, a_idx long")
    target = spark.createDataFrame([("p", 0, 0, 1.0), ("p", 1, 8, 1.0), ("p", 1, 1, 0.5)], "pair_id string, b_idx long, a_idx long, w double")
    of = lambda q: [sorted(map(tuple, d.collect())) for d in (E.topk_neighbors(q, 1), E.feature_knn_weighted(q, a), E.attention_match(q, a), E.match_top1(q, partner), E.effective_support(q), E.cosine_match(q), E.attention_weights(q), E.soft_cross_entropy(q, target))]
    found = of(odd)
    assert found == of(good) and all(found) and found[0] == [("p", 0, 0, 0.0, 1), ("p", 1, 1, 0.0, 1)]


def test_soft_features(spark):
    rng = np.random.default_rng(8)
    v = {s: rng.normal(size=(n, 4)) for s, n in (("A", 11), ("B", 6))}
    qk = spark.createDataFrame([("p", s, i, v[s][i].tolist()) for s in "AB" for i in range(len(v[s]))], "pair_id string, side string, spot_idx long, v array<double>")
    a = spots(spark, [("A", i, 0, i, float(i), float(-i), "L") for i in range(11)])
    z = rng.normal(size=(11, 5))
    features = spark.createDataFrame([("p", i, z[i].tolist()) for i in range(11)] + [("p", 99, None)], "pair_id string, spot_idx long, z array<double>")
    p = np.exp(v["B"] @ v["A"].T / 2)
    p /= p.sum(1, keepdims=True)
    got = sorted(E.attention_match(qk, a, block=3, features=features).collect(), key=lambda r: r.b_idx)
    assert np.allclose([r.z for r in got], p @ z) and np.allclose([r.x for r in got], p @ np.arange(11))
    assert np.allclose([r.p for r in sorted(E.attention_weights(qk, block=4).collect(), key=lambda r: (r.b_idx, r.a_idx))], p.ravel())


def sparse(spark, m, extra=()):
    rows = [("A", i, g, float(m[i, g])) for i in range(len(m)) for g in range(m.shape[1]) if m[i, g]] + list(extra)
    return spark.createDataFrame(rows, "sample_id string, spot_idx long, gene_idx int, v double")


def test_packed_projection(spark):
    """One gene in every spot, genes that the basis lacks, weights that a dimension lacks, a basis in several blocks; no exchange by gene and no join."""
    r = np.random.default_rng(9)
    m = np.where(r.random((40, 25)) < 0.2, r.normal(size=(40, 25)), 0.0)
    m[:, 7] = 1.5
    w = np.where(r.random((25, 6)) < 0.6, r.normal(size=(25, 6)), 0.0)
    w[7] = [1.0, 2.0, 0.0, 0.0, 3.0, 4.0]
    values = sparse(spark, m, [("B", 1, 900, 2.0), ("B", 2, None, 2.0), ("B", 3, 7, 1.0)])
    basis = spark.createDataFrame([(g, k * 10, float(w[g, k])) for g in range(25) for k in range(6) if w[g, k]] + [(None, 1, 1.0), (7, None, 1.0)], "gene_idx int, dim int, w double")
    want = {}
    for i in range(40):
        for k in range(6):
            if any(m[i, g] and w[g, k] for g in range(25)):
                want["A", i, k * 10] = float(m[i] @ w[:, k])
    want |= {("B", 3, k * 10): float(w[7, k]) for k in range(6) if w[7, k]}
    for numbers in (E.BLOCK_NUMBERS, 60):
        out = E.project_basis(values, basis, numbers)
        got = {(x.sample_id, x.spot_idx, x.dim): x.z for x in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        plan = plan_of(out)
        assert "gene_idx" not in "".join(x for x in plan.splitlines() if "Exchange" in x) and "Join" not in plan
    assert E.project_basis(values, basis.where("dim = 77")).collect() == []


def test_svd_in_blocks_of_genes(spark):
    """More blocks than one, more partial sums than a group takes, fewer spots than columns."""
    r = np.random.default_rng(2)
    m = np.maximum(r.normal(size=(60, 4)) @ r.normal(size=(4, 30)), 0)
    v = E.shared_svd_basis(sparse(spark, m).repartition(9), 3, 30, rounds=8, gene_block=7, fan=2)
    w = np.zeros((30, 3))
    for x in v.collect():
        w[x.gene_idx, x.dim] = x.w
    assert np.allclose(np.abs(w), np.abs(np.linalg.svd(m, full_matrices=False)[2][:3].T), atol=1e-4)
    few = E.shared_svd_basis(sparse(spark, m[:2]), 2, 30, rounds=3).collect()
    assert {x.dim for x in few} == {0, 1}


def test_svd_of_packed_rows(spark):
    """Pieces of one spot and of several, entries of one place (added up), genes beyond the panel, a spot of such alone, a gene that no spot has; and its spots' image."""
    r = np.random.default_rng(6)
    m = np.where(r.random((50, 24)) < 0.4, r.normal(size=(50, 5)) @ r.normal(size=(5, 24)), 0.0)
    m[:, 11] = 0
    twice = [("A", 3, g, 0.5) for g in range(0, 24, 5)]
    rows = E.pack(sparse(spark, m, [*twice, ("A", 3, 24, 9.0), ("A", 4, -1, 9.0), ("A", 77, 30, 9.0)]).repartition(5)).persist()
    m[3, ::5] += 0.5
    want = np.linalg.svd(m, full_matrices=False)[2][:4].T
    for piece in (1, 24 * 7, E.PIECE):
        w = np.zeros((24, 4))
        for x in E.svd_basis_packed(rows, 4, 24, rounds=12, gene_block=10, fan=2, piece=piece).collect():
            w[x.gene_idx, x.dim] = x.w
        assert np.allclose(np.abs(w), np.abs(want), atol=1e-6)
    z = spark.createDataFrame([("A", i, k, float(m[i] @ w[:, k])) for i in range(50) for k in range(4)], "sample_id string, spot_idx long, dim int, z double")
    got = {(x.gene_idx, x.dim): x.g for x in E.packed_image(rows, z, 4).collect()}
    rows.unpersist()
    want = m.T @ (m @ w)
    assert {k for k in got if 0 <= k[0] < 24} == {(g, k) for g in range(24) for k in range(4) if g != 11} and all(abs(got[g, k] - want[g, k]) < 1e-9 for g, k in got if 0 <= g < 24)


def test_the_svd_query_makes_its_spots_once(spark, monkeypatch):
    """The rounds and the test of the basis read the packed spots that were kept; nothing goes back to the tables."""
    made, expr = spark.sparkContext.accumulator(0), X.expr

    def counted(s, d):
        def count(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        e = expr(s, d)
        return e.mapInArrow(count, e.schema)

    monkeypatch.setattr(X, "expr", counted)
    kept = len(spark.sparkContext._jsc.getPersistentRDDs())
    rows = QUERIES["shared_svd_basis"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 25 and all(r.invariant and r["product"] == (r.dim == r.other) for r in rows)
    assert made.value == expr(spark, "/root/testdata/sf0.001").count()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= kept + 2  # the basis and its image, not the spots


def test_the_index_finds_most_with_few_distances(spark):
    r = np.random.default_rng(0)
    turn = r.normal(size=(6, 40))
    x = {s: (r.normal(size=(n, 6)) * [3, 2, 1.5, 1, 0.7, 0.5]) @ turn + r.normal(size=(n, 40)) * 0.1 for s, n in (("A", 5000), ("B", 1500))}
    qk = spark.createDataFrame([("a/b", s, i, v.tolist()) for s in "AB" for i, v in enumerate(x[s])] + [("a/b", "A", 9999, [math.nan] * 40)], "pair_id string, side string, spot_idx long, v array<double>")
    exact = {(r.b_idx, r.a_idx) for r in E.topk_neighbors(qk, 10).collect()}
    near = {(r.b_idx, r.a_idx): r.pair_id for r in E.index_neighbors(qk, 10).collect()}
    work = E.index_work(qk).first()
    assert len(exact & near.keys()) >= 0.9 * len(exact) and set(near.values()) == {"a/b"}
    assert work.all_pairs == 5000 * 1500 and work.distances < 0.3 * work.all_pairs


@pytest.mark.parametrize("tile", [4096, 37])
def test_neighbours_of_crowds(spark, tile):
    """A crowd at one place, a dense cluster in a sparse field, a line of growing gaps, queries far away: all exact, by one pass."""
    r = np.random.default_rng(5)
    field = np.concatenate([r.uniform(0, 1000, (150, 2)), np.repeat([[500.0, 500.0]], 500, 0), r.uniform(500, 500.001, (200, 2))])
    samples = {"A": field, "B": np.c_[np.arange(200.0) ** 3, np.zeros(200)], "C": np.ones((30, 2)), "D": np.array([[1.0, 2.0]])}
    df = spark.createDataFrame([(s, i, float(x), float(y)) for s, xy in samples.items() for i, (x, y) in enumerate(xy)] + [("D", 5, None, 1.0), ("D", 6, math.nan, 1.0)], "sample_id string, spot_idx long, x double, y double").repartition(4)

    def plain(q, p, k, other):
        out = {}
        for i, (x, y) in enumerate(q):
            d = (x - p[:, 0]) ** 2 + (y - p[:, 1]) ** 2
            out[i] = [(int(j), float(d[j])) for j in np.lexsort((np.arange(len(p)), d)) if not other or j != i][:k]
        return {i: v for i, v in out.items() if v}

    def found(out):
        by = {}
        for w in sorted(out.collect(), key=lambda w: (w.src, w["rank"])):
            by.setdefault(w.sample_id, {}).setdefault(w.src, []).append((w.dst, w.d2))
        return by

    assert found(N.nearest(df, df, 5, True, tile)) == {s: v for s, xy in samples.items() if (v := plain(xy, xy, 5, True))}
    q = np.concatenate([r.uniform(-50, 150, (40, 2)), r.uniform(5000, 5001, (20, 2)), [[500.0, 500.0]]])
    asked = spark.createDataFrame([("A", i, float(x), float(y)) for i, (x, y) in enumerate(q)] + [("Z", 0, 1.0, 1.0)], df.schema)
    assert found(N.nearest(asked, df, 3, False, tile)) == {"A": plain(q, field, 3, False)}


def test_radius_join_of_a_crowded_cell(spark):
    """All points and centers in one cell: tiles of both, the rim included, and as many keys as pairs of tiles."""
    n = 120
    xy = np.random.default_rng(4).integers(0, 9, (n, 2)).astype(float)
    p = spark.createDataFrame([("p", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pair_id string, spot_idx long, x double, y double")
    got = N.radius_join(p.withColumnRenamed("spot_idx", "c_idx"), p, 10.0, tile=10)
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    assert sorted((r.c_idx, r.dst, r.d2) for r in got.collect()) == [(i, j, float(d2[i, j])) for i in range(n) for j in range(n) if d2[i, j] <= 100]


def test_numbers_over_ranges_of_keys(spark):
    """Null and NaN keys, groups over several ranges, groups of one, and sizes; one exchange of the rows."""
    rng = random.Random(3)
    keys = [None, math.nan, -0.0, 0.0, 1.5]
    rows = [(rng.choice(["a", None, "b"]), rng.choice(keys) if i % 2 else 7.0, i) for i in range(4000)] + [("only", 1.0, 5000)]
    df = spark.createDataFrame(rows, "g string, h double, v long").repartition(7)
    got = numbered(df, ["g", "h"], ["v"], "k", total="n").collect()
    by = {}
    for r in got:
        by.setdefault((r.g, "nan" if r.h is not None and math.isnan(r.h) else r.h), []).append((r.v, r.k, r.n))
    assert len(got) == len(rows)
    assert all([k for _, k, _ in sorted(v)] == list(range(len(v))) and {n for *_, n in v} == {len(v)} for v in by.values())


def test_a_batch_that_broke_off_is_landed_once(spark, tmp_path):
    good = ("Ann", "a.b@c.org", "Co", None, "1-10", "help", None, None)
    df = spark.createDataFrame([good, good, ("Bob", *good[1:]), ("", *good[1:])], I.LEAD)
    root = str(tmp_path / "t")
    I.landed(df, 4).write.parquet(f"{root}/valid/batch=4")  # it broke off before the rejected rows
    first = {r.id for r in spark.read.parquet(f"{root}/valid/batch=4").collect()}
    assert I.committed(spark, root).count() == 0 and len(first) == 3
    assert I.append_leads(df, root, 4) and not I.append_leads(df, root, 4)
    I.landed(df, 5).write.parquet(f"{root}/valid/batch=5")  # staged, never entered
    assert {r.id for r in I.read_leads(spark, root).collect()} == first and I.read_leads(spark, root, "rejected").count() == 1


def test_white_space_of_any_kind_is_no_name(spark):
    rows = [("\t\n", "a@b.c", "\u00a0", None, "\u3000", "\n\n", None, None), ("\u2003Ann\ufeff", "\ta@b.c\n", "Co", "\u2028", "1", "x\u00a0y\n", "\t", None)]
    df = spark.createDataFrame(rows, I.LEAD)
    assert [r.reasons for r in I.validate_lead(df).collect()] == [["full_name required", "company required", "company_size required", "looking_for required"], []]
    assert [(r.full_name, r.email, r.role, r.looking_for, r.source) for r in I.valid(df).collect()] == [("Ann", "a@b.c", None, "x\u00a0y", None)]


def test_a_stored_plan_is_scored_without_an_exchange(spark, tmp_path):
    r = random.Random(2)
    a = spots(spark, [(p, "A", i, 0, i, 0.0, 0.0, r.choice(["L", "M", "NA"])) for p in "pq" for i in range(40)])
    b = spots(spark, [(p, "B", i, 0, i, 0.0, 0.0, r.choice(["L", "M", "NA"])) for p in "pq" for i in range(30)])
    plan = spark.createDataFrame([(run, p, r.randrange(35), r.randrange(30), float(r.randrange(5))) for run in "rs" for p in "pq" for _ in range(300)], "run_id string, pair_id string, a_idx long, b_idx long, mass double").groupBy("run_id", "pair_id", "a_idx", "b_idx").agg(F.sum("mass").alias("mass"))
    runs = plan.select("run_id").distinct()
    labels = lambda s, idx: s.select("pair_id", F.col("spot_idx").alias(idx), "layer").crossJoin(runs)
    path = str(tmp_path / "plan")
    L.write_plan(plan, path, labels(a, "a_idx"), labels(b, "b_idx"), spark.createDataFrame([("r", "alpha", "0.1")], "run_id string, key string, value string"), buckets=4)
    want = {x.pair_id: (x.n_correct, x.n_scored, x.accuracy) for x in S.label_transfer_accuracy(S.plan_label_join(S.argmax_partners(plan, a, b), a, b), S.RUN).where("run_id = 'r'").collect()}
    assert {x.pair_id: (x.n_correct, x.n_scored, x.accuracy) for x in L.rescore(spark, path, "r").collect()} == want
    assert [(x.key, x.value) for x in L.scan_plan(spark, path, "r", "parameters").collect()] == [("alpha", "0.1")]
    for part in ("plan", "labels_a", "labels_b"):  # as another session would find it
        spark.sql(f"DROP TABLE {L._plan_table(path, part)}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = L.scan_plan(spark, path, "r").groupBy("pair_id", "a_idx").agg(F.max("mass").alias("m")).join(L.scan_plan(spark, path, "r", "labels_a"), ["pair_id", "a_idx"])
        assert "Exchange" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined) and joined.count() > 0
        assert {x.pair_id: (x.n_correct, x.n_scored, x.accuracy) for x in L.rescore(spark, path, "r").collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sketches_roll_up_within_their_stated_error(spark):
    r = np.random.default_rng(6)
    rows = [(g, s, float(x)) for g in ("m", "n") for s in range(4) for x in r.gamma(2.0, 10.0, 4000 if g == "m" else 20)] + [("m", 0, None), ("m", 1, math.nan), ("none", 0, math.inf)]
    df = spark.createDataFrame(rows, "g string, s int, err double").repartition(6)
    got = {x.g: x for x in S.rolled_up(S.error_sketches(df, ["g", "s"]), ["g"]).collect()}
    for g in ("m", "n"):
        v = np.sort([x for k, _, x in rows if k == g and x is not None and math.isfinite(x)])
        assert got[g].n == len(v) and abs(got[g]["mean"] - v.mean()) < 1e-9 and got[g]["max"] == v[-1] and got[g].rank_error < 0.01
        for q, c in ((0.5, "median"), (0.9, "p90")):
            assert abs((v <= got[g][c]).mean() - q) <= got[g].rank_error + 1 / len(v)
    assert got["n"].rank_error == 0 and (got["none"].n, got["none"].median, got["none"]["mean"]) == (0, None, None)


def test_nearest_magnitude_has_no_join(spark):
    shape = "fold int, severity double, mean_disp_px double, err double"
    left = spark.createDataFrame([(1, 0.0, 5.0, 1.0), (1, 1.0, 0.0, 2.0), (1, 2.0, 99.0, 3.0), (2, 0.0, 1.0, 4.0), (1, 3.0, None, 5.0), (1, 4.0, 4.0, 6.0)], shape)
    right = spark.createDataFrame([(1, 0.0, 4.0, 10.0), (1, 1.0, 6.0, 11.0), (1, 2.0, 4.0, 12.0), (1, 3.0, None, 13.0), (3, 0.0, 1.0, 14.0)], shape)
    out = C.magnitude_matched(left, right, "fold")
    assert "Join" not in plan_of(out) and {(r.sev_a, r.sev_b, r.err_b) for r in out.collect()} == {(0.0, 0.0, 10.0), (1.0, 0.0, 10.0), (2.0, 1.0, 11.0), (4.0, 0.0, 10.0)}


def test_stacks_are_read_and_written_in_parts(spark, tmp_path, monkeypatch):
    """A slice over many ranges and many lines, odd ids, white space, other keys, points without a number; a document written by another hand."""
    monkeypatch.setattr(L, "LINE", 7)
    r = random.Random(1)
    points = {name: [(round(r.uniform(-1, 1), 4), r.choice([0.0, -0.5, 1e-4, 12.25]), r.randrange(7)) for _ in range(n)] for name, n in (("a \"q\" [1,2]", 300), ("b", 1), ("c", 40), ("éß", 2))}
    rows = [(name, i * 3, x, y, k) for name, p in points.items() for i, (x, y, k) in enumerate(p)] + [("c", 999, math.nan, 1.0, None)]
    df = spark.createDataFrame(rows, "sample_id string, spot_idx long, x double, y double, k int").repartition(5)
    L.write_stack_json(df, str(tmp_path / "w"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "w").glob("part-*")))
    said = json.loads(text)["slices"]
    assert [(s["id"], s["n"]) for s in said] == [(name, len(points[name]) + (name == "c")) for name in sorted(points)]
    assert all([(x, y, k) for (x, y), k in zip(s["xy"], s["layer"])][: len(points[s["id"]])] == points[s["id"]] for s in said)
    want = {(name, i): (x, y, k) for name, p in points.items() for i, (x, y, k) in enumerate(p)} | {("c", 40): (None, 1.0, None)}
    (tmp_path / "one").mkdir()
    other = {"dataset": "x", "layers": ["L1", "L2"], "layerColors": ["#fff"], "spacing": 30.5, "slices": [{"id": name, "n": len(p), "xy": [[x, y] for x, y, _ in p], "layer": [k for *_, k in p]} for name, p in points.items()]}
    (tmp_path / "one/stack.json").write_text(json.dumps(other, indent=1))
    for folder, expected in (("w", want), ("one", {k: v for k, v in want.items() if v[0] is not None})):
        for size in (57, 1000, 1 << 20):
            got = L.read_stack_json(spark, str(tmp_path / folder), 10.0, size).collect()
            assert len(got) == len(expected) and {(x.sample_id, x.i): (x.x, x.y, x.layer) for x in got} == expected
    assert {x.sample_id: x.z for x in got} == {name: 10.0 * k - 15 for k, name in enumerate(sorted(points))}


def test_text_of_numbers_and_moments(spark):
    row = spark.range(1).select(V.thousands(F.lit(17127)).alias("a"), V.thousands(F.lit(-1234567)).alias("b"), V.utc_stamp(F.timestamp_seconds(F.lit(1709251140))).alias("c"), V.fixed_width(F.lit(42), 5).alias("d"), V.fixed_width(F.lit(123456), 5).alias("e")).first()
    assert tuple(row) == ("17,127", "-1,234,567", "2024-02-29T23:59:00Z", "   42", "123456")


def test_the_heaviest_of_equal_vectors_is_the_least_index(spark):
    """Copies of a vector lie anywhere in a block, where a matrix product rounds them differently."""
    rng = np.random.default_rng(8)
    few, b = rng.normal(size=(5, 61)), rng.normal(size=(67, 61))
    a_id = rng.permutation(1003)
    rows = [("p", "A", int(k), few[k % 5].tolist()) for k in a_id] + [("p", "B", i, x.tolist()) for i, x in enumerate(b)]
    qk = spark.createDataFrame(rows, "pair_id string, side string, spot_idx long, v array<double>")
    partner = spark.createDataFrame([("p", i, int(k)) for i, k in enumerate((b @ few.T).argmax(1))], "pair_id string, b_idx long, a_idx long")
    for block in (5000, 300):
        assert [tuple(r) for r in E.match_top1(qk, partner, block=block).collect()] == [("p", 1.0, len(b))]


def test_cross_entropy_near_partners_is_that_of_their_soft_target(spark):
    rng = np.random.default_rng(9)
    xy = rng.uniform(0, 6, (40, 2))
    a = spots(spark, [("A", i, 0, i, float(x), float(y), "L") for i, (x, y) in enumerate(xy) if i != 7])
    odd = {3: None, 5: [float("nan"), 1.0, 1.0], 11: [1.0, None, 1.0]}
    v = lambda s, i: odd[i] if i in odd else rng.normal(size=3).tolist()
    qk = spark.createDataFrame([("p", s, i, v(s, i)) for s in "AB" for i in range(40) if (s, i) != ("A", 20)], "pair_id string, side string, spot_idx long, v array<double>").persist()
    partner = spark.createDataFrame([("p", i, -1 if i % 4 == 0 else (i * 7) % 40) for i in range(40)], "pair_id string, b_idx long, a_idx long")
    want = E.soft_cross_entropy(qk, N.soft_target(partner, a, 1.0, 0.3)).first()
    for block in (1000, 6):
        got = E.soft_cross_entropy_near(qk, partner, a, 1.0, 0.3, block=block)
        assert (got.first().n, got.first().loss) == (want.n, pytest.approx(want.loss, abs=1e-12)) and want.n > 10
        assert "d2" not in plan_of(got)  # no row for each near spot


def test_a_row_is_sent_a_bounded_number_of_times(spark):
    """A side of 40,000 spots is four blocks, not twenty."""
    v = F.array(F.lit(1.0))
    qk = spark.range(80_000).select(F.lit("p").alias("pair_id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("side"), F.expr("id div 2").alias("spot_idx"), v.alias("v"))
    count = lambda pair, b, a: ([pair] * b.num_rows, b["spot_idx"], [a.num_rows] * b.num_rows)
    got = E._by_block(qk, count, "pair_id string, b_idx long, n long").groupBy("b_idx").agg(F.count("*").alias("k"), F.sum("n").alias("n")).groupBy("k", "n").count().collect()
    assert [tuple(r) for r in got] == [(4, 40_000, 40_000)]


def test_groups_of_a_pair_are_many_tasks(spark):
    """One pair's blocks are dealt out by group: before, all met where the pair's row of sizes was. A row is sent twice, for four groups."""
    rng = np.random.default_rng(12)
    qk = spark.createDataFrame([("p", s, i, [float(i), 1.0]) for s in "AB" for i in range(40)], "pair_id string, side string, spot_idx long, v array<double>").persist()
    where = lambda pair, b, a: ([pair] * b.num_rows, b["spot_idx"], [TaskContext.get().partitionId()] * b.num_rows)
    got = E._by_block(qk, where, "pair_id string, b_idx long, n long", block=5)
    found = got.groupBy("b_idx").agg(F.count("*").alias("k")).collect()
    assert [r.k for r in found] == [8] * 40 and got.select("n").distinct().count() > 3
    odd = {3: [0.1, float("nan"), 1.0], 5: None, 6: [], 8: [1e300, 1.0, 2.0], 9: [-0.0, 0.5, 1.0], 11: [None, 1.0, 2.0]}
    v = [odd.get(i, rng.normal(size=3).tolist() if i % 2 else rng.integers(-9, 9, 3).astype(float).tolist()) for i in range(16)]
    rows = spark.createDataFrame([("p", s, i, x) for s in "AB" for i, x in enumerate(v)], qk.schema)
    shape = lambda pair, b, a: ([pair] * b.num_rows, b["spot_idx"], b["v"])
    back = {r.b_idx: r.v for r in E._by_block(rows, shape, "pair_id string, b_idx long, v array<double>", whole=True).collect()}
    assert str([back[i] for i in range(16)]) == str(v)  # as they were, whether floats hold them or not


def test_score_files_are_small(spark, tmp_path):
    """The rows of a block lie so that their indices take some bits, not two bytes each."""
    rng = np.random.default_rng(13)
    a, b = rng.normal(size=(6000, 2)).round(2), rng.normal(size=(400, 2)).round(2)
    qk = spark.createDataFrame([("p", s, int(i), x.tolist()) for s, m in (("A", a), ("B", b)) for i, x in zip(rng.permutation(len(m)), m, strict=True)], "pair_id string, side string, spot_idx long, v array<double>")
    E.attention_weights(qk, digits=2).write.parquet(str(tmp_path / "p"))  # the weights themselves take nothing
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2_400_000
    assert sum(f.stat().st_size for f in (tmp_path / "p").glob("*.parquet")) < 2_400_000 * 0.5


def test_scores_rounded_where_they_are_made(spark):
    rng = np.random.default_rng(10)
    qk = spark.createDataFrame([("p", s, i, rng.normal(size=4).tolist()) for s in "AB" for i in range(30)], "pair_id string, side string, spot_idx long, v array<double>").persist()
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(E.cosine_match(qk, digits=6)) == rows(E.cosine_match(qk).withColumn("logit", F.round("logit", 6)))
    assert rows(E.attention_weights(qk, digits=9)) == rows(E.attention_weights(qk).withColumn("p", F.round("p", 9)))


def test_leads_of_repeated_content_have_ids_of_their_own(spark, monkeypatch):
    """However few or many contents come again, the same rows and ids; without any, no row is exchanged with its text."""
    row = lambda k: (k, "A　", "a@b.cd", "c", "", "1", " x  ", None, None)
    schema = f"custkey long, {I.LEAD}"
    some = spark.createDataFrame([row(k % 7) for k in range(10)] + [row(100)], schema)
    of = lambda d: sorted((r.custkey, r.full_name, r.looking_for, r.id) for r in I.landed(d, 3).collect())
    got = of(some)
    assert [r[:3] for r in got] == sorted((k % 7, "A", "x") for k in range(10)) + [(100, "A", "x")] and len({r[3] for r in got}) == 11
    monkeypatch.setattr(I, "AGAIN", 1)
    assert of(some) == got
    plan = plan_of(I.landed(spark.createDataFrame([row(k) for k in range(9)], schema), 3))
    assert "rangepartitioning" not in plan and "MapInArrow" not in plan
