"""Every operator bound to the driver's tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.runtime import numbered
from ..operators import bridge as B
from ..operators import curves as C
from ..operators import features as E
from ..operators import neighbors as N
from ..operators import scoring as S
from ..operators import transforms as T
from ..sources import intake as I
from ..sources import slices as L
from ..streaming.leads import stream_leads as run_stream
from . import fixtures as X
from .fixtures import PITCH, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Doubles to six places, for the comparison."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


def no_null(df: DataFrame, col: str) -> DataFrame:
    """Absent whole numbers as -1, so that the comparison sees whole numbers."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(-1)).cast("long"))


def no(col: str, value):
    """A value that stands for null, for the comparison."""
    return F.coalesce(F.col(col), F.lit(value))


def R(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in cols)


# --- bridge -----------------------------------------------------------------------------------------------------------
def _ab(s, d):
    return X.spots_a(s, d), X.spots_b(s, d)


def _bridge(s, d):
    return B.array_bridge(*_ab(s, d))


@query(with_("spots") + "SELECT pair_id, b_idx, coalesce(a_idx, -1) AS a_idx, round(gt_x, 6) AS gt_x, round(gt_y, 6) AS gt_y, have FROM bridge")
def array_bridge(s, d):
    return r6(no_null(_bridge(s, d), "a_idx"), "gt_x", "gt_y")


@query(with_("spots") + "SELECT pair_id, b_idx, coalesce(a_idx, -1) AS a_idx FROM bridge")
def partner_index(s, d):
    return B.partner_index(*_ab(s, d))


@query(with_("spots") + "SELECT pair_id, b_idx FROM bridge WHERE NOT have")
def bridge_unmatched(s, d):
    return B.bridge_unmatched(*_ab(s, d)).select("pair_id", F.col("spot_idx").alias("b_idx"))


@query(with_("spots") + "SELECT pair_id, round(avg(have::INT), 6) AS coverage, count(*) AS n FROM bridge GROUP BY pair_id")
def bridge_coverage(s, d):
    return r6(B.bridge_coverage(_bridge(s, d)), "coverage")


COMMON = "SELECT pair_id, array_row, array_col, a.spot_idx AS a_idx, b.spot_idx AS b_idx FROM last_a a JOIN last_b b USING (pair_id, array_row, array_col)"


@query(with_("spots") + COMMON)
def common_positions(s, d):
    return B.common_positions(*_ab(s, d))


@query(with_("spots") + COMMON + " QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY md5(array_row || ',' || array_col || '/3')) <= 50")
def common_positions_sample(s, d):
    return B.common_positions(*_ab(s, d), n=50, seed=3)


@query(with_("spots") + "SELECT pair_id, array_row, array_col, row_number() OVER (PARTITION BY pair_id ORDER BY array_row, array_col) - 1 AS place FROM last_a JOIN last_b USING (pair_id, array_row, array_col)")
def sort_common_keys(s, d):
    """The common positions in order, with their places."""
    keys = B.common_positions(*_ab(s, d)).select(*B.GRID)
    return numbered(keys, ["pair_id"], ["array_row", "array_col"], "place")


@query(with_("spots") + "SELECT pair_id, array_row, array_col FROM a INTERSECT SELECT pair_id, array_row, array_col FROM b")
def intersect_positions(s, d):
    return B.intersect_positions(*_ab(s, d))


@query(with_("spots") + "SELECT pair_id, spot_idx AS b_idx, round(x, 6) AS gt_x, round(y, 6) AS gt_y, true AS have FROM b")
def self_target(s, d):
    return r6(B.self_target(X.spots_b(s, d)), "gt_x", "gt_y")


def _residual(s, d):
    return X.spots_b(s, d).select("pair_id", F.col("spot_idx").alias("b_idx"), "x", "y", "layer").join(_bridge(s, d), ["pair_id", "b_idx"]).withColumn("err", F.when(F.col("have"), S.error()))


STATS = "round(avg(err), 6) AS mean, round(median(err), 6) AS median, round(quantile_cont(err, 0.9), 6) AS p90, round(max(err), 6) AS max, count(err) AS n"
ERR = ", e AS (SELECT b.layer, bridge.*, b.x, b.y, sqrt((b.x - gt_x) ^ 2 + (b.y - gt_y) ^ 2) AS err FROM b JOIN bridge ON (b.pair_id, b.spot_idx) = (bridge.pair_id, b_idx)) "


@query(with_("spots") + ERR + f"SELECT pair_id, layer, {STATS} FROM e GROUP BY ALL")
def registration_error_stats(s, d):
    return r6(S.registration_error_stats(_residual(s, d), ["pair_id", "layer"]), "mean", "median", "p90", "max")


@query(with_("spots") + ERR + f"SELECT pair_id, {STATS} FROM e GROUP BY pair_id")
def bridge_residual(s, d):
    return r6(S.registration_error_stats(_residual(s, d), ["pair_id"]), "mean", "median", "p90", "max")


@query(with_("spots") + ERR + "SELECT pair_id, b_idx, round(err, 6) AS err FROM e WHERE err IS NOT NULL AND layer <> 'NA'")
def filter_finite(s, d):
    return r6(S.filter_finite(_residual(s, d), "err", F.col("layer") != "NA").select("pair_id", "b_idx", "err"), "err")


@query(with_("spots") + ERR + "SELECT pair_id, round(avg(err) / 137, 6) AS loss FROM e WHERE have GROUP BY pair_id")
def coordinate_loss(s, d):
    return r6(S.coordinate_loss(_residual(s, d), PITCH), "loss")


@query(with_("spots") + ERR + "SELECT pair_id, layer, round(sqrt((stddev_pop(x) ^ 2 + stddev_pop(y) ^ 2) / (stddev_pop(gt_x) ^ 2 + stddev_pop(gt_y) ^ 2)), 6) AS ratio FROM e WHERE have GROUP BY ALL")
def prediction_spread(s, d):
    return r6(S.prediction_spread(_residual(s, d), ["pair_id", "layer"]).select("pair_id", "layer", "ratio"), "ratio")


# --- plans ------------------------------------------------------------------------------------------------------------
def _best(s, d):
    return S.argmax_partners(X.plan(s, d), *_ab(s, d))


def _labelled(s, d):
    return S.plan_label_join(_best(s, d), *_ab(s, d))


def _accuracy(s, d):
    return S.label_transfer_accuracy(_labelled(s, d), S.RUN)


PLAN = with_("spots", "plan")
ACC = "n_correct, n_scored, n_dropped_a_na, n_dropped_partner_na, round(n_correct / greatest(n_scored, 1), 6) AS accuracy"


@query(PLAN + "SELECT run_id, pair_id, a_idx, b_idx FROM best")
def argmax_partners(s, d):
    return _best(s, d)


@query(PLAN + "SELECT run_id, pair_id, a_idx, b_idx, layer_a, layer_b FROM labelled")
def plan_label_join(s, d):
    return _labelled(s, d)


@query(PLAN + "SELECT run_id, pair_id, a_idx, b_idx, layer_a, layer_b FROM labelled WHERE layer_a <> 'NA' AND layer_b <> 'NA'")
def filter_labeled_both(s, d):
    return S.filter_labeled_both(_labelled(s, d))


@query(PLAN + f"SELECT run_id, pair_id, {ACC} FROM accuracy")
def label_transfer_accuracy(s, d):
    return r6(_accuracy(s, d), "accuracy")


@query(
    PLAN +
    "SELECT run_id, pair_id, layer_a, count(*) FILTER (layer_a <> 'NA' AND layer_b <> 'NA' AND layer_a = layer_b) AS n_correct, "
    "count(*) FILTER (layer_a <> 'NA' AND layer_b <> 'NA') AS n_scored, round(count(*) FILTER (layer_a <> 'NA' AND layer_b = layer_a) / greatest(count(*) FILTER (layer_a <> 'NA' AND layer_b <> 'NA'), 1), 6) AS accuracy "
    "FROM labelled GROUP BY ALL"
)
def label_accuracy_by_layer(s, d):
    return r6(S.label_transfer_accuracy(_labelled(s, d), [*S.RUN, "layer_a"]).select(*S.RUN, "layer_a", "n_correct", "n_scored", "accuracy"), "accuracy")


FLOOR = """, shares AS (SELECT pair_id, layer, count(*) FILTER (side = 'A') AS na, count(*) FILTER (side = 'B') AS nb FROM spots WHERE layer <> 'NA' GROUP BY ALL),
floor_ AS (SELECT pair_id, sum(na * nb) / (sum(na) * sum(nb)) AS floor FROM shares GROUP BY pair_id) """


@query(with_("spots") + FLOOR + "SELECT pair_id, round(floor, 6) AS floor FROM floor_")
def random_floor_exact(s, d):
    return r6(S.random_floor_exact(*_ab(s, d)), "floor")


TRIALS = """, upto AS (SELECT pair_id, layer, sum(count(*)) OVER (PARTITION BY pair_id ORDER BY layer) AS hi, count(*) AS n, sum(count(*)) OVER (PARTITION BY pair_id) AS total FROM b GROUP BY pair_id, layer),
draw AS (
  SELECT a.pair_id, trial, a.layer AS layer_a, ('0x' || substr(md5(trial || '/' || spot_idx || '/0'), 1, 15))::BIGINT % total AS u
  FROM a JOIN (SELECT DISTINCT pair_id, total FROM upto) USING (pair_id), range(50) t(trial)),
got AS (SELECT draw.*, layer AS layer_b FROM draw JOIN upto ON draw.pair_id = upto.pair_id AND u < hi AND u >= hi - n),
acc AS (SELECT pair_id, trial, count(*) FILTER (layer_a <> 'NA' AND layer_a = layer_b) / greatest(count(*) FILTER (layer_a <> 'NA' AND layer_b <> 'NA'), 1) AS accuracy FROM got GROUP BY ALL)
SELECT pair_id, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std, count(*) AS n_trials FROM acc GROUP BY pair_id"""


@query(with_("spots") + TRIALS)
def random_floor_trials(s, d):
    return r6(S.random_floor_trials(*_ab(s, d)), "accuracy_mean", "accuracy_std")


@query(PLAN + FLOOR + f"SELECT run_id, pair_id, {ACC}, round(floor, 6) AS floor, round((n_correct / greatest(n_scored, 1) - floor) * 100, 6) AS lift_points FROM accuracy JOIN floor_ USING (pair_id)")
def score_report(s, d):
    return r6(S.score_report(_accuracy(s, d), S.random_floor_exact(*_ab(s, d))), "accuracy", "floor", "lift_points")


@query(PLAN + "SELECT run_id, pair_id, sum(mass) AS total_mass, count(DISTINCT a_idx) AS a_with_mass, count(DISTINCT b_idx) AS b_with_mass FROM plan WHERE mass > 0 GROUP BY run_id, pair_id")
def plan_mass(s, d):
    return S.plan_mass(X.plan(s, d))


@query(PLAN + "SELECT run_id, plan.pair_id, plan.a_idx, b_idx, mass, round(x, 6) AS x, round(y, 6) AS y FROM plan JOIN a ON (a.pair_id, a.spot_idx) = (plan.pair_id, plan.a_idx)")
def plan_project_join(s, d):
    return r6(S.plan_project_join(X.plan(s, d), X.spots_a(s, d)), "x", "y").select("run_id", "pair_id", "a_idx", "b_idx", "mass", "x", "y")


def _bary(s, d):
    return S.barycentric_projection(X.plan(s, d), *_ab(s, d))


@query(PLAN + f"SELECT run_id, pair_id, b_idx, col_mass, {R('x', 'y')} FROM bary")
def barycentric_projection(s, d):
    return r6(_bary(s, d), "x", "y")


ARGMAX = """, top AS (SELECT run_id, pair_id, b_idx, arg_max(a_idx, (mass, -a_idx)) AS a_idx FROM plan GROUP BY ALL),
hard AS (SELECT e.run_id, e.pair_id, e.b_idx, top.a_idx, a.x, a.y FROM each_b e LEFT JOIN top USING (run_id, pair_id, b_idx) LEFT JOIN a ON (a.pair_id, a.spot_idx) = (e.pair_id, top.a_idx)) """


@query(PLAN + ARGMAX + f"SELECT run_id, pair_id, b_idx, coalesce(a_idx, -1) AS a_idx, {R('x', 'y')} FROM hard")
def argmax_projection(s, d):
    return r6(no_null(S.argmax_projection(X.plan(s, d), *_ab(s, d)), "a_idx"), "x", "y")


@query(PLAN + ARGMAX + "SELECT run_id, pair_id, b_idx, round(sqrt((h.x - bary.x) ^ 2 + (h.y - bary.y) ^ 2), 6) AS shift FROM bary JOIN hard h USING (run_id, pair_id, b_idx)")
def prediction_shift(s, d):
    hard = S.argmax_projection(X.plan(s, d), *_ab(s, d)).drop("a_idx")
    return r6(S.prediction_shift(_bary(s, d), hard, [*S.RUN, "b_idx"]).select(*S.RUN, "b_idx", "shift"), "shift")


@query(PLAN + "SELECT run_id, pair_id, b_idx FROM bary JOIN bridge USING (pair_id, b_idx) WHERE have AND col_mass > 0")
def mask_scorable(s, d):
    return S.mask_scorable(_bary(s, d).join(_bridge(s, d), ["pair_id", "b_idx"])).select(*S.RUN, "b_idx")


# --- neighbours -------------------------------------------------------------------------------------------------------
KNN = """, knn AS (
  SELECT p.sample_id, p.spot_idx AS src, q.spot_idx AS dst, (p.x - q.x) ^ 2 + (p.y - q.y) ^ 2 AS d2,
         row_number() OVER (PARTITION BY p.sample_id, p.spot_idx ORDER BY (p.x - q.x) ^ 2 + (p.y - q.y) ^ 2, q.spot_idx) AS rank
  FROM spots p JOIN spots q ON p.sample_id = q.sample_id AND p.spot_idx <> q.spot_idx) """
EDGES = (
    KNN
    + """, half AS (SELECT sample_id, src, dst FROM knn WHERE rank <= 6),
edges AS (SELECT * FROM half UNION ALL SELECT sample_id, dst, src FROM half),
rel AS (
  SELECT e.*, (q.x - p.x) / 137.0::DOUBLE AS rel_x, (q.y - p.y) / 137.0::DOUBLE AS rel_y
  FROM edges e JOIN spots p ON (p.sample_id, p.spot_idx) = (e.sample_id, src) JOIN spots q ON (q.sample_id, q.spot_idx) = (e.sample_id, dst)) """
)


@query(with_("spots") + KNN + "SELECT sample_id, src, dst, round(d2, 6) AS d2, rank::INT AS rank FROM knn WHERE rank <= 6")
def knn_spatial(s, d):
    return r6(N.knn_spatial(X.spots(s, d), 6), "d2")


@query(with_("spots") + KNN + "SELECT sample_id, src, dst, rank::INT AS rank FROM knn WHERE rank <= 10")
def rank_neighbors(s, d):
    return N.knn_spatial(X.spots(s, d), 10).select("sample_id", "src", "dst", "rank")


@query(with_("spots") + KNN + "SELECT sample_id, src AS spot_idx, round(sqrt(d2), 6) AS distance FROM knn WHERE rank = 1")
def nearest_neighbor_distance(s, d):
    return r6(N.nearest_neighbor_distance(X.spots(s, d)), "distance")


@query(with_("spots") + KNN + "SELECT sample_id, round(median(sqrt(d2)), 6) AS pitch FROM knn WHERE rank = 1 GROUP BY sample_id")
def median_pitch(s, d):
    return r6(N.median_pitch(X.spots(s, d)), "pitch")


@query(with_("spots") + EDGES + "SELECT sample_id, src, dst FROM edges")
def symmetrize_edges(s, d):
    return N.symmetrize_edges(N.knn_spatial(X.spots(s, d), 6))


@query(with_("spots") + EDGES + f"SELECT sample_id, src, dst, {R('rel_x', 'rel_y')} FROM rel")
def knn_graph_symmetric(s, d):
    return r6(N.knn_graph_symmetric(X.spots(s, d), 6, PITCH), "rel_x", "rel_y")


@query(with_("spots") + "SELECT pair_id, b.spot_idx AS c_idx, a.spot_idx AS dst, round((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2, 6) AS d2 FROM b JOIN a USING (pair_id) WHERE (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 <= 40.0::DOUBLE ^ 2")
def radius_join(s, d):
    a, b = _ab(s, d)
    return r6(N.radius_join(b.select("pair_id", F.col("spot_idx").alias("c_idx"), "x", "y"), a, 40.0), "d2")


SNAP = """SELECT pair_id, b.spot_idx AS b_idx, arg_min(a.spot_idx, ((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2, a.spot_idx)) AS a_idx, round(sqrt(min((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)), 6) AS moved
FROM b JOIN a USING (pair_id) GROUP BY pair_id, b.spot_idx"""


@query(with_("spots") + SNAP)
def snap_to_nearest(s, d):
    a, b = _ab(s, d)
    return r6(N.snap_to_nearest(b.select("pair_id", F.col("spot_idx").alias("b_idx"), "x", "y"), a).select("pair_id", "b_idx", "a_idx", "moved"), "moved")


SOFT = """, near AS (
  SELECT pair_id, b_idx, q.spot_idx AS a_idx, exp(-((q.x - gt_x) ^ 2 + (q.y - gt_y) ^ 2) / (2 * 20.0::DOUBLE ^ 2)) AS g
  FROM bridge JOIN a q USING (pair_id) WHERE have AND (q.x - gt_x) ^ 2 + (q.y - gt_y) ^ 2 <= 80.0::DOUBLE ^ 2),
target AS (SELECT pair_id, b_idx, a_idx, g / sum(g) OVER (PARTITION BY pair_id, b_idx) AS w FROM near) """


def _target(s, d):
    return N.soft_target(B.partner_index(*_ab(s, d)), X.spots_a(s, d), 20.0, 1.0)


@query(with_("spots") + SOFT + "SELECT pair_id, b_idx, a_idx, round(w, 6) AS w FROM target")
def soft_target(s, d):
    return r6(_target(s, d), "w")


def _features(s, d):
    return X.qk(s, d).select(F.concat("pair_id", "side").alias("sample_id"), "spot_idx", F.col("v").alias("z"))


HOP = """, f AS (SELECT pair_id || side AS sample_id, spot_idx, unnest(v) AS z, generate_subscripts(v, 1) - 1 AS dim FROM qk),
m AS (SELECT e.sample_id, e.dst, dim, avg(z) AS v FROM edges e JOIN f ON (f.sample_id, f.spot_idx) = (e.sample_id, e.src) GROUP BY ALL),
o AS (SELECT sample_id, dst, avg(rel_x) AS off_x, avg(rel_y) AS off_y FROM rel GROUP BY ALL)
SELECT f.sample_id, f.spot_idx, f.dim::INT AS dim, round(z + coalesce(v, 0), 6) AS z, round(coalesce(off_x, 0), 6) AS off_x, round(coalesce(off_y, 0), 6) AS off_y
FROM f LEFT JOIN m ON (m.sample_id, m.dst, m.dim) = (f.sample_id, f.spot_idx, f.dim) LEFT JOIN o ON (o.sample_id, o.dst) = (f.sample_id, f.spot_idx)"""


@query(with_("spots", "qk") + EDGES + HOP)
def message_hop(s, d):
    return r6(N.message_hop(N.knn_graph_symmetric(X.spots(s, d), 6, PITCH), _features(s, d)), "z", "off_x", "off_y")


# --- features and matching --------------------------------------------------------------------------------------------
EXPR = with_("expr")


@query(EXPR + "SELECT sample_id, spot_idx, CASE WHEN sum(count) = 0 THEN 1 ELSE sum(count) END AS size FROM expr GROUP BY ALL")
def library_size(s, d):
    return E.library_size(X.expr(s, d))


@query(EXPR + "SELECT sample_id, spot_idx, gene_idx, round(v, 6) AS v FROM lognorm")
def lognorm(s, d):
    return r6(E.lognorm(X.expr(s, d)), "v")


def _z(s, d):
    return E.project_basis(E.lognorm(X.expr(s, d)), X.basis(s))


@query(EXPR + "SELECT sample_id, spot_idx, dim, round(z, 6) AS z FROM z")
def project_basis(s, d):
    return r6(_z(s, d), "z")


@query(EXPR + "SELECT sample_id, spot_idx, dim, round((z - avg(z) OVER w) / (stddev_pop(z) OVER w + 1e-6), 6) AS z FROM z WINDOW w AS (PARTITION BY dim)")
def standardize_global(s, d):
    return r6(E.standardize_global(_z(s, d)), "z")


SLICE_Z = EXPR + "SELECT sample_id, spot_idx, dim, round((z - avg(z) OVER w) / (stddev_pop(z) OVER w + 1e-6), 6) AS z FROM z WINDOW w AS (PARTITION BY sample_id, dim)"


@query(SLICE_Z)
def standardize_per_slice(s, d):
    return r6(E.standardize_per_slice(_z(s, d)), "z")


@query(SLICE_Z)
def slice_zscore(s, d):
    return r6(E.standardize_per_slice(_z(s, d)), "z")


BASIS = 5


def svd_basis(s, d):
    """The basis of the tables' expression, for the bench."""
    return E.shared_svd_basis(E.lognorm(X.expr(s, d)), BASIS, 500)


@query(EXPR + f", every AS (SELECT i::INT AS dim, j::INT AS other FROM range({BASIS}) a(i), range({BASIS}) b(j)) SELECT dim, other, CASE WHEN dim = other THEN 1.0 ELSE 0.0 END::DOUBLE AS product, true AS invariant FROM every")
def shared_svd_basis(s, d):
    """The basis' own test, as rows: products of its vectors (1 or 0), and whether the spots' Gram matrix keeps each within their span
    (its image less its part in the span is a tenth of it at most)."""
    rows = E.pack(E.lognorm(X.expr(s, d))).persist()
    basis = E.svd_basis_packed(rows, BASIS, 500, rounds=8).persist()
    pairs = basis.join(basis.select("gene_idx", F.col("dim").alias("other"), F.col("w").alias("w2")), "gene_idx").groupBy("dim", "other").agg(F.abs(F.round(F.sum(F.col("w") * F.col("w2")), 6)).alias("product"))
    image = E.packed_image(rows, E.project_packed(rows, basis), BASIS).persist()
    image.count()  # a row for each gene and dimension is kept, and the spots are let go
    rows.unpersist()
    inner = image.join(basis.select("gene_idx", F.col("dim").alias("other"), "w"), "gene_idx").groupBy("dim", "other").agg(F.sum(F.col("g") * F.col("w")).alias("c"))
    inside = inner.groupBy("dim").agg(F.sum(F.col("c") * F.col("c")).alias("in"))
    kept = image.groupBy("dim").agg(F.sum(F.col("g") * F.col("g")).alias("all")).join(inside, "dim").select("dim", (F.col("in") > 0.99 * F.col("all")).alias("invariant"))
    return pairs.join(kept, "dim").select("dim", "other", "product", "invariant")


QK = with_("spots", "qk")
DIST = ", dist AS (SELECT pair_id, b_idx, a_idx, list_distance(bv, av) AS distance, row_number() OVER (PARTITION BY pair_id, b_idx ORDER BY list_distance(bv, av), a_idx) AS rank FROM pairs) "


@query(QK + DIST + "SELECT dist.pair_id, b_idx, a_idx, round(distance, 6) AS distance, round(x, 6) AS x, round(y, 6) AS y FROM dist JOIN a ON a.pair_id = dist.pair_id AND a.spot_idx = a_idx WHERE rank = 1")
def feature_nn(s, d):
    return r6(E.feature_nn(X.qk_odd(s, d), X.spots_a(s, d)), "distance", "x", "y")


@query(QK + DIST + "SELECT pair_id, b_idx, a_idx, rank::INT AS rank FROM dist WHERE rank <= 10")
def topk_neighbors(s, d):
    return E.topk_neighbors(X.qk_odd(s, d), 10).select("pair_id", "b_idx", "a_idx", "rank")


@query(QK + DIST + "SELECT dist.pair_id, b_idx, round(sum(x / (distance + 1e-6)) / sum(1 / (distance + 1e-6)), 6) AS x, round(sum(y / (distance + 1e-6)) / sum(1 / (distance + 1e-6)), 6) AS y FROM dist JOIN a ON a.pair_id = dist.pair_id AND a.spot_idx = a_idx WHERE rank <= 10 GROUP BY ALL")
def feature_knn_weighted(s, d):
    return r6(E.feature_knn_weighted(X.qk_odd(s, d), X.spots_a(s, d)), "x", "y")


SOFT_MATCH = """SELECT softmax.pair_id, b_idx, round(sum(p * x), 6) AS x, round(sum(p * y), 6) AS y, round(sum(p * k.v[1]), 6) AS z0, round(sum(p * k.v[64]), 6) AS z63
FROM softmax JOIN a ON a.pair_id = softmax.pair_id AND a.spot_idx = a_idx JOIN qk k ON k.pair_id = softmax.pair_id AND k.side = 'A' AND k.spot_idx = a_idx GROUP BY ALL"""


@query(QK + SOFT_MATCH)
def attention_match(s, d):
    """Soft coordinates, and the first and the last number of the soft feature."""
    features = X.qk(s, d).where("side = 'A'").select("pair_id", "spot_idx", F.col("v").alias("z"))
    found = E.attention_match(X.qk_odd(s, d), X.spots_a(s, d), features=features)
    return r6(found.select("pair_id", "b_idx", "x", "y", F.get("z", F.lit(0)).alias("z0"), F.get("z", F.lit(63)).alias("z63")), "x", "y", "z0", "z63")


def _low(s, d):
    """Vectors of low dimension: the first three numbers of each."""
    return X.qk_odd(s, d).withColumn("v", F.slice("v", 1, 3))


@query(QK + "SELECT pair_id, count(*) AS all_pairs, true AS fewer, true AS found FROM pairs GROUP BY pair_id")
def feature_index(s, d):
    """The index against the exact way: whether it finds 0.9 of the ten nearest, and takes less than 0.8 of all distances (slices of these tables are small: their share falls as slices grow)."""
    exact, near = E.topk_neighbors(_low(s, d), 10), E.index_neighbors(_low(s, d), 10, tables=2, bucket=4, flips=3)
    recall = exact.join(near.select("pair_id", "b_idx", "a_idx", F.lit(1).alias("hit")), ["pair_id", "b_idx", "a_idx"], "left").groupBy("pair_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    work = E.index_work(_low(s, d), tables=2, bucket=4, flips=3).join(recall, "pair_id")
    return work.select("pair_id", "all_pairs", (F.col("distances") < F.col("all_pairs") * 0.8).alias("fewer"), (F.col("recall") >= 0.9).alias("found"))


@query(QK + "SELECT pair_id, b_idx, a_idx, round(list_inner_product(bv, av) / (sqrt(list_inner_product(bv, bv)) * sqrt(list_inner_product(av, av))) / 0.1::DOUBLE, 6) AS logit FROM pairs")
def cosine_match(s, d):
    return E.cosine_match(X.qk_odd(s, d), digits=6)


@query(QK + "SELECT pair_id, b_idx, a_idx, round(p, 9) AS p FROM softmax")
def softmax_over_row(s, d):
    return E.attention_weights(X.qk_odd(s, d), digits=9)


@query(QK + DIST + "SELECT pair_id, b_idx, a_idx, round((1 / (distance + 1e-6)) / sum(1 / (distance + 1e-6)) OVER (PARTITION BY pair_id, b_idx), 6) AS w FROM dist WHERE rank <= 10")
def weight_normalize(s, d):
    t = E.topk_neighbors(X.qk_odd(s, d), 10).withColumn("g", 1.0 / (F.col("distance") + 1e-6))
    return r6(t.select("pair_id", "b_idx", "a_idx", N.weight_normalize("g", "pair_id", "b_idx").alias("w")), "w")


@query(QK + ", t AS (SELECT pair_id, b_idx, arg_max(a_idx, (logit, -a_idx)) AS best FROM logits GROUP BY ALL) SELECT pair_id, round(avg((best = a_idx)::INT), 6) AS top1, count(*) AS n FROM t JOIN bridge USING (pair_id, b_idx) WHERE have GROUP BY pair_id")
def match_top1(s, d):
    return r6(E.match_top1(X.qk_odd(s, d), B.partner_index(*_ab(s, d))), "top1")


ENTROPY = """, l AS (SELECT pair_id, b_idx, ln(sum(exp(logit))) AS lse FROM logits GROUP BY ALL),
g AS (SELECT pair_id, b_idx, sum(w * logit) AS g FROM logits JOIN target USING (pair_id, b_idx, a_idx) GROUP BY ALL)
SELECT pair_id, round(avg(lse - g), 6) AS loss, count(*) AS n FROM l JOIN g USING (pair_id, b_idx) GROUP BY pair_id"""


@query(QK + SOFT + ENTROPY)
def soft_cross_entropy(s, d):
    return r6(E.soft_cross_entropy_near(X.qk_odd(s, d), B.partner_index(*_ab(s, d)), X.spots_a(s, d), 20.0, 1.0), "loss")


@query(QK + ", e AS (SELECT pair_id, b_idx, 1 / sum(p * p) AS support FROM softmax GROUP BY ALL) SELECT pair_id, round(median(support), 6) AS support FROM e GROUP BY pair_id")
def effective_support(s, d):
    return r6(E.effective_support(X.qk_odd(s, d)), "support")


VECTORS = """SELECT q.pair_id, b_idx, round(list_inner_product(q.v, k.v), 6) AS dot, round(sqrt(list_inner_product(q.v, q.v)), 6) AS norm, round(list_cosine_similarity(q.v, k.v), 6) AS cosine, round(list_distance(q.v, k.v) ^ 2, 6) AS distance2
FROM bridge JOIN qk q ON q.pair_id = bridge.pair_id AND q.side = 'B' AND q.spot_idx = b_idx JOIN qk k ON k.pair_id = bridge.pair_id AND k.side = 'A' AND k.spot_idx = a_idx"""


@query(with_("spots", "qk") + VECTORS)
def vector_functions(s, d):
    """Products, norms, cosines and distances of the vectors of bridged spots."""
    of = lambda side, idx, v: X.qk(s, d).where(F.col("side") == side).select("pair_id", F.col("spot_idx").alias(idx), F.col("v").alias(v))
    both = B.partner_index(*_ab(s, d)).join(of("B", "b_idx", "q"), ["pair_id", "b_idx"]).join(of("A", "a_idx", "k"), ["pair_id", "a_idx"])
    q, k = F.col("q"), F.col("k")
    return r6(both.select("pair_id", "b_idx", V.dot(q, k).alias("dot"), V.norm(q).alias("norm"), V.cosine(q, k).alias("cosine"), V.distance2(q, k).alias("distance2")), "dot", "norm", "cosine", "distance2")


@query("SELECT p_partkey, format('{:,}', (p_partkey * 7919 * 7919)::BIGINT) AS spots, strftime(TIMESTAMP '2024-02-28 23:59:58' + to_minutes(p_partkey), '%Y-%m-%dT%H:%M:%SZ') AS stamp, lpad(p_partkey::VARCHAR, 9, ' ') AS fixed FROM part")
def text_functions(s, d):
    """Numbers with thousands, time stamps of log lines, and fixed widths."""
    p = X.table(s, d, "part")
    at = F.timestamp_seconds(F.lit(1709164798) + F.col("p_partkey") * 60)
    return p.select("p_partkey", V.thousands(F.col("p_partkey").cast("long") * 7919 * 7919).alias("spots"), V.utc_stamp(at).alias("stamp"), V.fixed_width(F.col("p_partkey"), 9).alias("fixed"))


@query("SELECT p_partkey AS gene_idx, CASE WHEN row_number() OVER w = 1 THEN p_brand ELSE p_brand || '-' || (row_number() OVER w - 1) END AS gene_name FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
def make_unique_names(s, d):
    return E.make_unique_names(X.table(s, d, "part").select(F.col("p_partkey").alias("gene_idx"), F.col("p_brand").alias("gene_name")))


def _sparse(s, d):
    """Expression with some genes missing from some slices."""
    return X.expr(s, d).where("(gene_idx + cast(sample_id as int)) % 7 <> 0")


SPARSE = EXPR + ", sp AS (SELECT * FROM expr WHERE (gene_idx + sample_id::INT) % 7 <> 0), g0 AS (SELECT DISTINCT gene_idx FROM sp WHERE sample_id = '0'), g1 AS (SELECT DISTINCT gene_idx FROM sp WHERE sample_id = '1') "


@query(SPARSE + "SELECT sample_id, spot_idx, gene_idx, count FROM sp WHERE sample_id IN ('0', '1') AND gene_idx IN (SELECT * FROM g0 INTERSECT SELECT * FROM g1)")
def common_genes(s, d):
    return E.common_genes(_sparse(s, d), "0", "1").select("sample_id", "spot_idx", "gene_idx", "count")


@query(SPARSE + "SELECT * FROM g0 INTERSECT SELECT * FROM g1")
def intersect_genes(s, d):
    return E.intersect_genes(_sparse(s, d), "0", "1")


@query(SPARSE + "SELECT gene_idx, '1' AS missing_in FROM (FROM g0 EXCEPT FROM g1) UNION ALL SELECT gene_idx, '0' FROM (FROM g1 EXCEPT FROM g0)")
def gene_difference(s, d):
    return E.gene_difference(_sparse(s, d), "0", "1")


@query(
    SPARSE +
    ", n AS (SELECT DISTINCT sample_id, gene_idx FROM sp) SELECT DISTINCT sample_id, gene_idx FROM ((SELECT s.sample_id, gene_idx "
    "FROM (SELECT DISTINCT sample_id FROM n) s CROSS JOIN g0 WHERE (s.sample_id, gene_idx) NOT IN (FROM n)) UNION ALL (SELECT * FROM n "
    "WHERE gene_idx NOT IN (FROM g0)))"
)
def assert_same_genes(s, d):
    return E.assert_same_genes(_sparse(s, d).select("sample_id", "gene_idx", F.concat(F.lit("g"), "gene_idx").alias("gene_name")), "0")


@query(with_("spots") + "SELECT sample_id, spot_idx, layer FROM a UNION ALL SELECT sample_id, spot_idx, layer FROM b")
def stack_slices(s, d):
    a, b = _ab(s, d)
    return E.stack_slices(a.select("sample_id", "spot_idx", "layer"), b.select("layer", "spot_idx", "sample_id"))


# --- transforms -------------------------------------------------------------------------------------------------------
WARP = with_("spots", "warp")


@query(WARP + f"SELECT sample_id, {R('extent')} FROM extent")
def extent(s, d):
    return r6(T.extent(X.spots(s, d)).select("sample_id", "extent"), "extent")


@query(WARP + f"SELECT sample_id, {R('extent', 'bump_width')} FROM extent")
def bump_width(s, d):
    return r6(T.extent(X.spots(s, d)), "extent", "bump_width")


@query(WARP + f"SELECT sample_id, seed, spot_idx, {R('ux', 'uy')} FROM unit")
def peak_normalize(s, d):
    return r6(T.unit_field(X.spots(s, d), X.bumps(s)).select("sample_id", "seed", "spot_idx", "ux", "uy"), "ux", "uy")


@query(WARP + "SELECT sample_id, seed, severity, tear, spot_idx, round(ux * severity * 137.0::DOUBLE, 6) AS dx, round(uy * severity * 137.0::DOUBLE, 6) AS dy FROM unit JOIN grid USING (seed)")
def bump_displacement(s, d):
    return r6(T.bump_displacement(X.spots(s, d), X.bumps(s), X.grid(s), PITCH).drop("x", "y"), "dx", "dy")


@query(WARP + "SELECT sample_id, seed, severity, tear, spot_idx, round(-sin(theta) * move, 6) AS tx, round(cos(theta) * move, 6) AS ty, torn FROM cut")
def cut_displacement(s, d):
    return r6(T.cut_displacement(X.spots(s, d), X.cuts(s), X.grid(s), PITCH), "tx", "ty")


def _warped(s, d):
    return T.apply_displacement(X.spots(s, d), X.bumps(s), X.cuts(s), X.grid(s), PITCH)


@query(WARP + "SELECT sample_id, seed, severity, tear, spot_idx, round(x_orig + dx, 6) AS x, round(y_orig + dy, 6) AS y, round(x_orig, 6) AS x_orig, round(y_orig, 6) AS y_orig, round(dx, 6) AS dx, round(dy, 6) AS dy, torn FROM warped")
def apply_displacement(s, d):
    return r6(_warped(s, d), "x", "y", "x_orig", "y_orig", "dx", "dy")


@query(WARP + "SELECT sample_id, seed, spot_idx, round(ux * 500, 6) AS dx, round(uy * 500, 6) AS dy FROM unit")
def scale_to_max_displacement(s, d):
    return r6(T.scale_to_max_displacement(X.spots(s, d), X.bumps(s), 500.0), "dx", "dy")


@query(WARP + "SELECT sample_id, seed, severity, tear, round(max(sqrt(dx ^ 2 + dy ^ 2)), 6) AS max_disp_px, round(avg(sqrt(dx ^ 2 + dy ^ 2)), 6) AS mean_disp_px, round(max(sqrt(dx ^ 2 + dy ^ 2)) / 137, 6) AS max_disp_pitch, count(*) FILTER (torn) AS n_torn FROM warped GROUP BY ALL")
def displacement_stats(s, d):
    return r6(T.displacement_stats(_warped(s, d), ["sample_id", "seed", "severity", "tear"], PITCH), "max_disp_px", "mean_disp_px", "max_disp_pitch")


@query(with_("spots") + "SELECT sample_id, spot_idx, round(-y, 6) AS y FROM spots")
def flip_y(s, d):
    return r6(T.flip_y(X.spots(s, d)).select("sample_id", "spot_idx", "y"), "y")


NORMAL = ", c AS (SELECT *, x - avg(x) OVER () AS cx, y - avg(y) OVER () AS cy FROM spots), frame AS (SELECT sample_id, spot_idx, layer, round(cx / max(greatest(abs(cx), abs(cy))) OVER (), 4) AS x, round(cy / max(greatest(abs(cx), abs(cy))) OVER (), 4) AS y FROM c) "


@query(with_("spots") + NORMAL + "SELECT sample_id, spot_idx, x, y FROM frame")
def normalize_frame(s, d):
    return T.normalize_frame(X.spots(s, d)).select("sample_id", "spot_idx", "x", "y")


@query(with_("spots") + "SELECT sample_id, spot_idx FROM spots QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY md5(spot_idx || '/5')) <= 30")
def downsample_per_slice(s, d):
    return T.downsample_per_slice(X.spots(s, d), 30, 5).select("sample_id", "spot_idx")


@query("SELECT vec_id AS spot_idx FROM embeddings ORDER BY md5(vec_id || '/1') LIMIT 80")
def subsample_n(s, d):
    return T.subsample_n(X.table(s, d, "embeddings").select(F.col("vec_id").alias("spot_idx")), 80, 1)


@query("WITH s AS (SELECT o_orderkey AS spot_idx FROM orders ORDER BY md5(o_orderkey || '/2') LIMIT 300) SELECT spot_idx, row_number() OVER (ORDER BY spot_idx) AS place FROM s")
def limit_sample(s, d):
    """300 orders at random, in order of their keys again: the place tells that they are."""
    few = T.subsample_n(X.table(s, d, "orders").select(F.col("o_orderkey").alias("spot_idx")), 300, 2)
    return few.withColumn("place", F.expr("row_number() over (order by spot_idx)"))  # of 300 rows


@query(
    with_("spots") +
    ", i AS (SELECT sample_id, spot_idx, row_number() OVER (PARTITION BY sample_id ORDER BY spot_idx) AS k FROM spots), "
    "h AS (SELECT sample_id, x, y, row_number() OVER (PARTITION BY sample_id ORDER BY md5(spot_idx || '/9')) AS k FROM spots) "
    "SELECT sample_id, spot_idx, round(x, 6) AS x, round(y, 6) AS y FROM i JOIN h USING (sample_id, k)"
)
def shuffle_geometry(s, d):
    return r6(T.shuffle_geometry(X.spots(s, d), 9).select("sample_id", "spot_idx", "x", "y"), "x", "y")


@query(with_("spots") + "SELECT sample_id, spot_idx, round(x / 137, 6) AS x, round(y / 137, 6) AS y FROM spots")
def pitch_units(s, d):
    return r6(T.pitch_units(X.spots(s, d), PITCH).select("sample_id", "spot_idx", "x", "y"), "x", "y")


@query(with_("expr") + "SELECT DISTINCT sample_id, (dense_rank() OVER (ORDER BY sample_id) - 1) * 30.0::DOUBLE - (SELECT count(DISTINCT sample_id) - 1 FROM expr) * 30.0::DOUBLE / 2 AS z FROM expr")
def slice_order_offset(s, d):
    return T.stacking_height(X.expr(s, d), 30.0)


# --- curves -----------------------------------------------------------------------------------------------------------
CURVES = with_("curves")
EV = "round(avg(reg_err), 6) AS mean, round(median(reg_err), 6) AS median, round(quantile_cont(reg_err, 0.9), 6) AS p90, round(max(reg_err), 6) AS max, count(reg_err) AS n"


@query(CURVES + f"SELECT method, fold, severity, {EV} FROM curves GROUP BY ALL")
def severity_curve(s, d):
    return r6(C.severity_curve(X.curves(s, d), ["method", "fold"]), "mean", "median", "p90", "max")


SKETCHED = """, r AS (SELECT method, reg_err, row_number() OVER (PARTITION BY method ORDER BY reg_err) AS k, count(*) OVER (PARTITION BY method) AS n FROM curves)
SELECT method, round(avg(reg_err), 6) AS mean, round(max(reg_err), 6) AS max, count(*) AS n, true AS stated, true AS within FROM r GROUP BY method"""


@query(CURVES + SKETCHED)
def error_sketches(s, d):
    """Sketches by (method, fold, severity), stored, and rolled up to methods: whether the ranks of their percentiles lie within the stated error (and one row)."""
    path, rows = X.scratch(s), X.curves(s, d)
    S.error_sketches(rows, ["method", "fold", "severity"], "reg_err").write.parquet(path)
    up = S.rolled_up(s.read.parquet(path), ["method"])
    below = lambda q, c: F.abs(F.avg((F.col("reg_err") <= F.col(c)).cast("double")) - q) <= F.max("rank_error") + 1 / F.count("*")
    held = rows.join(up.select("method", "median", "p90", "rank_error"), "method").groupBy("method").agg((below(0.5, "median") & below(0.9, "p90")).alias("within"))
    return r6(up.join(held, "method").select("method", "mean", "max", "n", (F.col("rank_error") < 0.02).alias("stated"), "within"), "mean", "max")


CI = (
    "SELECT method, fold, severity, round(avg(e), 6) AS mean, round(coalesce(stddev_samp(e), 0), 6) AS std, count(*) AS n, "
    "round(coalesce(1.96::DOUBLE * stddev_samp(e) / sqrt(count(*)), 0), 6) AS ci FROM (SELECT method, fold, severity, seed, median(reg_err) AS e "
    "FROM curves GROUP BY ALL) GROUP BY ALL"
)


def _ci(s, d):
    per = X.curves(s, d).groupBy("method", "fold", "severity", "seed").agg(F.percentile("reg_err", 0.5).alias("e"))
    return C.multi_seed_ci(per, ["method", "fold", "severity"], "e")


@query(CURVES + CI)
def multi_seed_ci(s, d):
    return r6(_ci(s, d), "mean", "std", "ci")


@query(CURVES + "SELECT method, fold, round(f, 6) AS first, round(l, 6) AS last, round(l - f, 6) AS delta, round(100 * (l - f) / f, 6) AS percent FROM (SELECT method, fold, arg_min(err, severity) AS f, arg_max(err, severity) AS l FROM means GROUP BY ALL)")
def degradation(s, d):
    return r6(C.degradation(X.method_curves(s, d), ["method", "fold"], "err"), "first", "last", "delta", "percent")


def _two(s, d):
    """The first two methods by name, for the comparisons."""
    m = X.table(s, d, "events").agg(F.array_sort(F.collect_set("event_type"))).first()[0]
    return m[0], m[1]


PAIR = CURVES + ", m AS (SELECT list_sort(list(DISTINCT method)) AS m FROM curves), j AS (SELECT p.fold, p.severity, p.err AS err_a, q.err AS err_b FROM means p JOIN means q USING (fold, severity), m WHERE p.method = m[1] AND q.method = m[2]) "


@query(PAIR + f"SELECT fold, severity, {R('err_a', 'err_b')} FROM j")
def method_join(s, d):
    return r6(C.method_join(X.method_curves(s, d), *_two(s, d), ["fold", "severity"], "err"), "err_a", "err_b")


@query(PAIR + "SELECT fold, severity, round(err_a, 6) AS err_a, round(err_b, 6) AS err_b, round(err_b / err_a, 6) AS ratio, err_a < 137 AS sub_pitch FROM j")
def method_ratio(s, d):
    return r6(C.method_ratio(X.method_curves(s, d), *_two(s, d), ["fold", "severity"], "err", PITCH), "err_a", "err_b", "ratio")


@query(CURVES + "SELECT method, round(avg(reg_err) FILTER (role = 'test') - avg(reg_err) FILTER (role = 'train'), 6) AS gap FROM curves GROUP BY method")
def generalization_gap(s, d):
    return r6(C.generalization_gap(X.curves(s, d), ["method"], "reg_err"), "gap")


@query(CURVES + ", c AS (SELECT fold, method, printf('%.0f->%.0f', arg_min(err, severity), arg_max(err, severity)) AS t, dense_rank() OVER (ORDER BY method) AS k FROM means GROUP BY fold, method) SELECT fold, max(t) FILTER (k = 1) AS m1, max(t) FILTER (k = 2) AS m2 FROM c GROUP BY fold")
def fold_summary(s, d):
    a, b = _two(s, d)
    return C.fold_summary(X.method_curves(s, d), [a, b], "err").withColumnsRenamed({a: "m1", b: "m2"})


TABLE = f""", ci AS ({CI}),
c AS (
  SELECT fold, severity, printf('%.1f+-%.1f', mean, ci) AS t, dense_rank() OVER (ORDER BY method) AS k FROM ci
  WHERE NOT (severity = 8 AND fold = 0 AND method = (SELECT min(method) FROM ci)))
SELECT fold, severity, coalesce(max(t) FILTER (k = 1), 'n/a') AS m1, coalesce(max(t) FILTER (k = 2), 'n/a') AS m2 FROM c GROUP BY fold, severity"""


@query(CURVES + TABLE)
def method_table(s, d):
    """Of all folds; one cell is taken out, to be n/a."""
    a, b = _two(s, d)
    ci = r6(_ci(s, d), "mean", "ci").where(~((F.col("severity") == 8) & (F.col("fold") == 0) & (F.col("method") == a)))
    return C.method_table(ci, [a, b], ("fold", "severity")).withColumnsRenamed({a: "m1", b: "m2"})


@query(
    PAIR +
    ", x AS (SELECT fold, p.severity AS sev_a, p.err AS mag_a, p.err AS err_a, q.severity AS sev_b, q.err AS mag_b, q.err AS err_b "
    "FROM means p JOIN means q USING (fold), m WHERE p.method = m[1] AND q.method = m[2] QUALIFY row_number() OVER (PARTITION BY fold, p.severity ORDER BY abs(p.err - q.err), q.err, q.severity) = 1) "
    "SELECT fold, sev_a, sev_b, " + R("mag_a", "err_a", "mag_b", "err_b") + " FROM x"
)
def magnitude_matched(s, d):
    a, b = _two(s, d)
    of = lambda m: X.method_curves(s, d).where(F.col("method") == m).withColumn("mean_disp_px", F.col("err"))
    return r6(C.magnitude_matched(of(a), of(b), "fold"), "mag_a", "err_a", "mag_b", "err_b")


@query(CURVES + "SELECT method, round(median(reg_err), 6) AS median, round(quantile_cont(reg_err, 0.9), 6) AS p90, count(*) AS n FROM curves GROUP BY method")
def metric_summary_by_method(s, d):
    return r6(C.metric_summary_by_method(X.curves(s, d)), "median", "p90")


@query(CURVES + "SELECT method, fold, severity, round(first_value(err) OVER w, 6) AS first, round(last_value(err) OVER w, 6) AS last FROM means WINDOW w AS (PARTITION BY method, fold ORDER BY severity ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def first_last_severity(s, d):
    return r6(C.first_last_severity(X.method_curves(s, d), ["method", "fold"], "err"), "first", "last")


@query(CURVES + f"SELECT method, fold, s0, s1, {R('e0', 'e1')} FROM steps")
def severity_step(s, d):
    return r6(C.severity_step(X.method_curves(s, d), ["method", "fold"], "err"), "e0", "e1")


@query(
    CURVES +
    ", places(s) AS (VALUES (-1.0::DOUBLE), (0.0), (2.5), (5.0), (8.0), (11.0)) SELECT method, fold, s, "
    "round(CASE WHEN s >= s0 AND s1 IS NOT NULL THEN e0 + (s - s0) / (s1 - s0) * (e1 - e0) ELSE e0 END, 6) AS err FROM steps JOIN "
    "places ON (s >= s0 AND (s1 IS NULL OR s < s1)) OR (k = 1 AND s < s0)"
)
def interpolate_curve(s, d):
    return r6(C.interpolate_curve(X.method_curves(s, d), [-1.0, 0.0, 2.5, 5.0, 8.0, 11.0], ["method", "fold"], "err"), "err")


@query(CURVES + "SELECT method, fold, severity, round(err, 6) AS err FROM means WHERE severity IN (0, 4, 8)")
def severity_subset(s, d):
    return r6(C.severity_subset(X.method_curves(s, d), [0.0, 4.0, 8.0]), "err")


@query(CURVES + "SELECT fold, arg_min(method, (e, method)) AS method, round(min(e), 6) AS e FROM (SELECT fold, method, avg(reg_err) AS e FROM curves GROUP BY ALL) GROUP BY fold")
def best_config(s, d):
    return r6(C.best_config(X.curves(s, d).groupBy("fold", "method").agg(F.avg("reg_err").alias("e")), "fold", "method", "e"), "e")


@query("SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity::DOUBLE) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity::DOUBLE) AS l_quantity FROM lineitem GROUP BY ALL)")
def exclusive_running_sum(s, d):
    li = X.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("double")).alias("q"))
    return C.exclusive_running_sum(li, "l_linenumber", "q", ["l_orderkey"]).select("l_orderkey", "l_linenumber", F.col("start").cast("double").alias("start"))


@query(
    CURVES +
    ", w AS (SELECT severity AS epoch, avg(reg_err) FILTER (role = 'train') AS train_loss, avg(reg_err) FILTER (role = 'test') AS val "
    "FROM curves GROUP BY severity) SELECT epoch, 'train_loss' AS metric, round(train_loss, 6) AS value FROM w UNION ALL "
    "SELECT epoch, 'val', round(val, 6) FROM w"
)
def unpivot_history(s, d):
    wide = X.curves(s, d).groupBy(F.col("severity").alias("epoch")).agg(F.avg(F.when(F.col("role") == "train", F.col("reg_err"))).alias("train_loss"), F.avg(F.when(F.col("role") == "test", F.col("reg_err"))).alias("val"))
    return r6(C.unpivot_history(wide), "value")


@query(CURVES + "SELECT DISTINCT c.method, g.severity, g.seed FROM (SELECT DISTINCT method FROM curves) c CROSS JOIN (SELECT v::DOUBLE AS severity, s AS seed FROM (VALUES (0), (4), (8)) a(v), (VALUES (0), (9999)) b(s)) g")
def param_grid(s, d):
    return X.curves(s, d).select("method").distinct().crossJoin(F.broadcast(C.param_grid(s, severity=[0.0, 4.0, 8.0], seed=[0, 9999])))


@query(
    "WITH s AS (SELECT DISTINCT (s_nationkey % 4)::VARCHAR || '/' || n_regionkey AS sample_id, n_regionkey AS donor FROM supplier "
    "JOIN nation ON s_nationkey = n_nationkey), f AS (SELECT DISTINCT donor AS fold FROM s) SELECT fold, donor, sample_id, "
    "CASE WHEN fold = donor THEN 'test' ELSE 'train' END AS role FROM f CROSS JOIN s"
)
def leave_one_group_out(s, d):
    su, n = X.table(s, d, "supplier"), X.table(s, d, "nation")
    slices = su.join(n, su.s_nationkey == n.n_nationkey).select(F.concat_ws("/", F.expr("s_nationkey % 4"), "n_regionkey").alias("sample_id"), F.col("n_regionkey").alias("donor")).distinct()
    return C.leave_one_group_out(slices)


def _ledger(s, d):
    return X.table(s, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("batch"))


@query(with_("ledger") + "SELECT run FROM ledger WHERE run NOT IN (SELECT run FROM ledger WHERE status = 'F')")
def pending_runs(s, d):
    ledger = _ledger(s, d)
    return C.pending_runs(ledger.select("run"), ledger.where("status = 'F'").select("run"), ["run"])


@query(with_("ledger") + "SELECT batch, count(*) AS runs, count(*) FILTER (status = 'F') AS failures, count(*) FILTER (status <> 'F') AS completed FROM ledger GROUP BY batch")
def run_ledger_summary(s, d):
    return C.run_ledger_summary(_ledger(s, d))


@query(
    "SELECT p_partkey, (i - 1)::INT AS pos, trim(split_part(c, '/', 1)) AS a, trim(split_part(c, '/', 2)) AS b FROM (SELECT p_partkey, "
    "unnest(string_split(p_brand || '/' || p_partkey || ', x/' || p_partkey, ',')) AS c, generate_subscripts(string_split(p_brand || '/' || p_partkey || ', x/' || p_partkey, ','), 1) AS i "
    "FROM part)"
)
def parse_pairs(s, d):
    specs = X.table(s, d, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_partkey", F.lit(", x/"), "p_partkey").alias("spec"))
    return C.parse_pairs(specs).join(specs, "spec").select("p_partkey", "pos", "a", "b")


@query("SELECT user_id, list_sum(list_transform(string_split(t, ','), lambda z: trim(z)::DOUBLE)) AS total FROM (SELECT DISTINCT user_id, (user_id % 5) || ', ' || (user_id % 7) || '.5' AS t FROM events)")
def parse_severities(s, d):
    t = X.table(s, d, "events").select("user_id", F.concat(F.col("user_id") % 5, F.lit(", "), F.col("user_id") % 7, F.lit(".5")).alias("t")).distinct()
    return t.select("user_id", F.aggregate(C.parse_severities(F.col("t")), F.lit(0.0), lambda a, x: a + x).alias("total"))


TAGS = (0.0, 0.5, 8.0, 0.1 + 0.2, 2 / 3, 1e-4, 1e-5, 1.23456789e-7, 123456.0, 999999.5, 1e6, 1.5e6, 1234567.0, 100000.0, 0.1, -2.5, -1e-9, 12.3456789, 1e21)


@query(
    f"SELECT user_id, k, replace(regexp_replace(printf('%g', v), 'e([+-])0*(\\d\\d)', 'e\\1\\2'), '.', 'p') AS tag "
    f"FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([{', '.join(map(repr, TAGS))}]::DOUBLE[]) AS x, "
    f"unnest(range({len(TAGS)})) AS k), LATERAL (SELECT CASE WHEN k % 2 = 0 THEN x ELSE x * (1 + user_id) END AS v)"
)
def severity_tag(s, d):
    """Tags of numbers of all sizes, as they are and times each user's."""
    values = X.table(s, d, "events").select("user_id").distinct().select("user_id", F.posexplode(F.array(*[F.lit(float(x)) for x in TAGS])).alias("k", "x"))
    value = F.when(F.col("k") % 2 == 0, F.col("x")).otherwise(F.col("x") * (1 + F.col("user_id")))
    return values.select("user_id", F.col("k").cast("long").alias("k"), V.severity_tag(value).alias("tag"))


# --- slices, sources --------------------------------------------------------------------------------------------------
@query(with_("spots") + "SELECT sample_id, spot_idx, layer FROM spots WHERE sample_id = 'p1B'")
def scan_slice(s, d):
    """The slices written by sample, and one of them scanned."""
    path = X.scratch(s)
    X.spots(s, d).write.partitionBy("sample_id").parquet(path)
    return L.scan_slice(s, path, "p1B").select("sample_id", "spot_idx", "layer")


@query("SELECT doc_id, coalesce(lang, 'NA') AS layer FROM documents")
def resolve_label_column(s, d):
    t = X.table(s, d, "documents").withColumnsRenamed({"lang": "layer", "source": "Region"})
    return t.select("doc_id", F.coalesce(F.col(L.resolve_label_column(t)), F.lit("NA")).alias("layer"))


@query("SELECT vec_id, (vec_id % 2)::VARCHAR AS sample_id, coalesce(CASE WHEN label < 7 THEN label::VARCHAR END, 'NA') AS layer FROM embeddings")
def standardize_slice(s, d):
    t = X.table(s, d, "embeddings").select("vec_id", F.when(F.col("label") < 7, F.col("label")).alias("ground_truth"))
    return L.standardize_slice(t, (F.col("vec_id") % 2).cast("string")).select("vec_id", "sample_id", "layer")


@query("SELECT vec_id, label AS guess FROM embeddings")
def layer_fallback_two(s, d):
    t = X.table(s, d, "embeddings").withColumnRenamed("label", "sce.layer_guess").withColumn("layer", F.lit(-1))
    return t.select("vec_id", L.layer_fallback_two(t).alias("guess"))


@query(with_("spots") + "SELECT sample_id, spot_idx, list_position(['Layer1', 'Layer2', 'Layer3', 'Layer4', 'Layer5', 'Layer6', 'WM'], layer)::BIGINT - 1 AS k FROM spots WHERE layer <> 'NA'")
def layer_index(s, d):
    return X.spots(s, d).select("sample_id", "spot_idx", L.layer_index(F.col("layer")).cast("long").alias("k")).where("k >= 0")


@query(with_("spots") + "SELECT sample_id, layer, count(*) AS count FROM spots GROUP BY ALL")
def label_counts(s, d):
    return C.label_counts(X.spots(s, d))


STATS_SQL = """, genes AS (SELECT sample_id AS donor, count(DISTINCT gene_idx) AS genes FROM expr GROUP BY sample_id)
SELECT right(pair_id, 1) AS donor, count(DISTINCT sample_id) AS sections, count(*) AS spots, round(count(*) / count(DISTINCT sample_id), 6) AS mean_spots, count(*) FILTER (layer <> 'NA') AS labelled, any_value(genes) AS genes
FROM spots LEFT JOIN genes ON donor = right(pair_id, 1) GROUP BY right(pair_id, 1)"""


@query(with_("spots", "expr") + STATS_SQL)
def dataset_stats(s, d):
    spots = X.spots(s, d).withColumn("donor", F.substring("pair_id", -1, 1))
    return r6(C.dataset_stats(spots, X.expr(s, d).select(F.col("sample_id").alias("donor"), "gene_idx")), "mean_spots")


@query(CURVES + "SELECT f AS fold, v AS severity, round(err, 6) AS err FROM range(4) a(f) CROSS JOIN (SELECT DISTINCT severity AS v FROM curves) LEFT JOIN (SELECT fold, severity, avg(reg_err) AS err FROM curves GROUP BY ALL) ON fold = f AND severity = v")
def scan_optional(s, d):
    c = X.curves(s, d)
    grid = c.select("severity").distinct().crossJoin(F.broadcast(s.range(4).withColumnRenamed("id", "fold")))
    return r6(L.scan_optional(grid, c.groupBy("fold", "severity").agg(F.avg("reg_err").alias("err")), ["fold", "severity"]).select("fold", "severity", "err"), "err")


SCANNED = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS back, CASE WHEN event_type < 'd' THEN 'old' ELSE 'new' END AS kind FROM events)
SELECT event_type || '_testS' || length(event_type) || CASE kind WHEN 'old' THEN '_seed9999' ELSE '_test_curve' END AS run, event_type AS method, 'S' || length(event_type) AS fold, CASE kind WHEN 'old' THEN 9999 ELSE -1 END::BIGINT AS seed,
       CASE kind WHEN 'old' THEN 'none' ELSE 'test' END AS role, user_id::DOUBLE AS severity, round(value, 6) AS reg_err_median, CASE kind WHEN 'old' THEN -1 ELSE round(value * 2, 6) END AS match_top1
FROM e WHERE back = 1"""


@query(SCANNED)
def scan_curves(s, d):
    """Two generations of headed CSV files, of other columns in another order, written in order of event and read in one scan."""
    e = X.table(s, d, "events").select(F.col("event_type").alias("method"), F.col("user_id").cast("double").alias("severity"), "value", "event_id")
    path, old = X.scratch(s), F.col("method") < "d"
    name = F.concat("method", F.lit("_testS"), F.length("method"), F.when(old, "_seed9999").otherwise("_test_curve")).alias("run")
    for k, (test, columns) in enumerate(((old, ["severity", "reg_err_median"]), (~old, ["match_top1", "severity", "reg_err_median"]))):
        rows = e.where(test).select(name, "event_id", "severity", F.col("value").alias("reg_err_median"), (F.col("value") * 2).alias("match_top1"))
        rows.repartition("run").sortWithinPartitions("run", "event_id").select("run", *columns).write.partitionBy("run").option("header", True).csv(f"{path}/{k}")
    found = L.scan_curves(s, path, ["reg_err_median", "match_top1"], r"run=([^/]+)/").select("run", "method", "fold", no("seed", -1).cast("long").alias("seed"), no("role", "none").alias("role"), "severity", "reg_err_median", no("match_top1", -1.0).alias("match_top1"))
    return r6(found, "reg_err_median", "match_top1")


CURVE = with_("curves") + "SELECT method, fold, severity, round(err, 6) AS err FROM means"


@query(CURVE)
def write_curves(s, d):
    path = X.scratch(s)
    L.write_curves(X.method_curves(s, d), path)
    return r6(s.read.schema("method string, fold long, severity double, err double").option("header", True).csv(path), "err")


@query("SELECT p_partkey || '=' || p_brand AS value FROM part")
def write_summary(s, d):
    path = X.scratch(s)
    L.write_summary(X.table(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("value")), path)
    return s.read.text(path)


@query("SELECT p_partkey::VARCHAR AS key, p_brand AS val FROM part")
def scan_summary(s, d):
    path = X.scratch(s)
    L.write_summary(X.table(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("value")), path)
    return L.scan_summary(s, path)


def _written_plan(s, d):
    """The plans with the labels of both slices and the parameters of each run."""
    path, plan = X.scratch(s), X.plan(s, d)
    runs = plan.select("run_id").distinct()
    of = lambda spots, idx: spots.select("pair_id", F.col("spot_idx").alias(idx), "layer").crossJoin(F.broadcast(runs)).select("run_id", "pair_id", idx, "layer")
    total = plan.groupBy("run_id").agg(F.sum("mass").cast("long").alias("value")).select("run_id", F.lit("total_mass").alias("key"), "value")
    L.write_plan(plan, path, of(X.spots_a(s, d), "a_idx"), of(X.spots_b(s, d), "b_idx"), total)
    return path


WRITTEN = "SELECT run_id, pair_id, a_idx, b_idx, mass FROM plan UNION ALL SELECT run_id, 'total_mass', -1, -1, sum(mass) FROM plan GROUP BY run_id"


@query(PLAN + WRITTEN)
def write_plan(s, d):
    """All that was written: the masses, and each run's parameter."""
    path = _written_plan(s, d)
    masses = s.read.parquet(f"{path}/plan").select("run_id", "pair_id", "a_idx", "b_idx", "mass")
    said = s.read.parquet(f"{path}/parameters").select("run_id", F.col("key").alias("pair_id"), F.lit(-1).cast("long").alias("a_idx"), F.lit(-1).cast("long").alias("b_idx"), F.col("value").cast("double").alias("mass"))
    return masses.unionByName(said)


@query(PLAN + "SELECT run_id, pair_id, a_idx, b_idx, mass FROM plan WHERE run_id = 'R'")
def scan_plan(s, d):
    return L.scan_plan(s, _written_plan(s, d), "R").select("run_id", "pair_id", "a_idx", "b_idx", "mass")


@query(PLAN + f"SELECT run_id, pair_id, {ACC} FROM accuracy WHERE run_id = 'N'")
def rescore_plan(s, d):
    """A stored run scored again from what was stored."""
    return r6(L.rescore(s, _written_plan(s, d), "N"), "accuracy")


def _stack(s, d):
    """All labelled spots, written as one stack."""
    path = X.scratch(s)
    L.write_stack_json(T.normalize_frame(X.spots(s, d)).withColumn("k", L.layer_index(F.col("layer"))).where("k >= 0"), path)
    return path


POINTS = """SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY spot_idx) - 1)::INT AS i, x, y, (list_position(['Layer1', 'Layer2', 'Layer3', 'Layer4', 'Layer5', 'Layer6', 'WM'], layer) - 1)::INT AS layer{}
FROM frame WHERE layer <> 'NA'"""


@query(with_("spots") + NORMAL + POINTS.format(", count(*) OVER (PARTITION BY sample_id)::INT AS n"))
def write_stack_json(s, d):
    """The stack written, its parts joined by name and read by Spark's own JSON functions: every point."""
    lines = s.read.text(_stack(s, d)).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("k"))
    whole = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "k", "value"))), lambda x: x["value"]), "\n").alias("value"))
    slices = whole.select(F.explode(F.from_json("value", "slices array<struct<id:string,n:int,xy:array<array<double>>,layer:array<int>>>")["slices"]).alias("j"))
    p = slices.select(F.col("j.id").alias("sample_id"), F.col("j.n").alias("n"), F.posexplode(F.arrays_zip(F.col("j.xy").alias("xy"), F.col("j.layer").alias("k"))).alias("i", "p"))
    return p.select("sample_id", "i", F.get("p.xy", F.lit(0)).alias("x"), F.get("p.xy", F.lit(1)).alias("y"), F.col("p.k").alias("layer"), "n")


@query(with_("spots") + NORMAL + POINTS.format(", ((dense_rank() OVER (ORDER BY sample_id) - 1) * 30.0::DOUBLE - 75.0::DOUBLE) AS z"))
def read_stack_json(s, d):
    """The stack read again in ranges of 2,000 bytes, which cut points and arrays anywhere."""
    return L.read_stack_json(s, _stack(s, d), size=2000)


# --- intake -----------------------------------------------------------------------------------------------------------
@query(with_("leads") + "SELECT custkey, array_to_string(reasons, '; ') AS reasons FROM judged")
def validate_lead(s, d):
    return I.validate_lead(X.leads(s, d)).select("custkey", F.concat_ws("; ", "reasons").alias("reasons"))


@query(with_("leads") + "SELECT custkey FROM leads WHERE hp IS NULL OR hp = ''")
def drop_bots(s, d):
    return I.drop_bots(X.leads(s, d)).select("custkey")


@query(with_("leads") + "SELECT custkey, nullif(trim(role, white), '') AS role FROM leads")
def empty_to_null(s, d):
    return X.leads(s, d).select("custkey", I.empty_to_null(F.col("role")).alias("role"))


@query(with_("leads") + "SELECT custkey, trim(full_name, white) AS full_name, trim(email) AS email, trim(company) AS company, coalesce(nullif(trim(role, white), ''), '-') AS role, length(trim(looking_for, white)) AS asked, true AS stamped, n FROM judged, range(1, 3) t(n) WHERE len(reasons) = 0 AND hp IS NULL")
def append_leads(s, d):
    """The leads appended as two batches, the second one twice, as after a crash before its entry and again after it: what landed is there once a batch, with an id of its own."""
    path, leads = X.scratch(s), X.leads(s, d, dealt=True)
    I.append_leads(leads, path, 0)
    I.landed(leads, 1).write.parquet(f"{path}/valid/batch=1")  # a landing that broke off between the tables
    for _ in range(2):
        I.append_leads(leads, path, 1)
    landed = I.read_leads(s, path)
    n = F.row_number().over(Window.partitionBy("custkey").orderBy("id")).cast("long")
    stamped = F.col("created_at").isNotNull() & (F.col("id") > F.coalesce(F.lag("id").over(Window.partitionBy("custkey").orderBy("id")), F.lit("")))
    return landed.select("custkey", "full_name", "email", "company", no("role", "-").alias("role"), F.length("looking_for").cast("long").alias("asked"), stamped.alias("stamped"), n.alias("n"))


@query(with_("leads") + "SELECT custkey, email, nullif(trim(role, white), '') AS role, '' AS reasons FROM judged WHERE len(reasons) = 0 AND hp IS NULL UNION ALL SELECT custkey, email, role, array_to_string(reasons, '; ') AS reasons FROM judged WHERE len(reasons) > 0 AND hp IS NULL")
def stream_leads(s, d):
    """The leads written as JSON files, taken in by the stream, and both of its sinks read again."""
    path = X.scratch(s)
    X.leads(s, d).write.json(f"{path}/in")
    run_stream(s, f"{path}/in", f"{path}/landed", f"{path}/progress", schema=f"custkey long, {I.LEAD}").awaitTermination()
    valid = I.read_leads(s, f"{path}/landed").select("custkey", "email", "role", F.lit("").alias("reasons"))
    return valid.union(I.read_leads(s, f"{path}/landed", "rejected").select("custkey", "email", "role", F.concat_ws("; ", "reasons")))


@query(with_("uploads") + "SELECT page_id, filename, received, CASE WHEN declared_size > 0 THEN declared_size ELSE received END AS file_size, declared_size > received AS truncated, CASE WHEN spots > 0 THEN spots ELSE -1 END AS spots FROM uploads")
def upload_receipt(s, d):
    return no_null(I.upload_receipt(X.uploads(s, d)), "spots").select("page_id", "filename", "received", "file_size", "truncated", "spots")


@query(with_("uploads") + "SELECT page_id, regexp_replace(filename, '[^\\w.-]', '_', 'g') AS name FROM uploads")
def safe_filename(s, d):
    return X.uploads(s, d).select("page_id", V.safe_filename(F.col("filename")).alias("name"))


@query("SELECT page_id AS file, CASE WHEN page_id % 3 > 0 THEN page_id % 3 WHEN page_id % 5 > 0 THEN page_id % 5 WHEN page_id % 7 > 1 THEN page_id % 7 - 1 ELSE -1 END AS n_obs FROM pages")
def spot_count_resolve(s, d):
    p = X.table(s, d, "pages").select(F.col("page_id").alias("file"), (F.col("page_id") % 3).alias("idx_len"), (F.col("page_id") % 5).alias("dense_rows"), (F.col("page_id") % 7).alias("indptr_len"))
    return no_null(I.spot_count_resolve(p), "n_obs")


SIGNED = """SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 400 WHEN page_id % 10 = 4 THEN 400 WHEN page_id % 6 = 0 THEN 200 ELSE 415 END AS status,
       CASE WHEN page_id % 2 = 1 THEN 'name' WHEN page_id % 10 = 4 THEN 'empty' WHEN page_id % 6 = 0 THEN 'ok' ELSE 'signature' END AS reason
FROM pages"""


@query(SIGNED)
def upload_signature_check(s, d):
    """The pages written as files, one each: odd ones have another ending, some are empty, some begin with the signature. What is found is read from the files."""
    p, root = X.table(s, d, "pages"), X.scratch(s)
    name = F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".h5ad").otherwise(".txt"))
    html = F.encode("html", "UTF-8")
    content = F.when(F.col("page_id") % 10 == 4, F.encode(F.lit(""), "UTF-8")).when(F.col("page_id") % 6 == 0, F.concat(F.unhex(F.lit(I.HDF5_MAGIC)), html)).otherwise(html)
    X.write_files(p.select(name.alias("name"), content.alias("content")), root)
    found = I.upload_signature_check(I.scan_uploads(s, root))
    return found.select(F.regexp_extract("path", r"(\d+)\.[^/]*$", 1).cast("long").alias("page_id"), "status", "reason")
