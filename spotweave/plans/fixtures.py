"""The driver's tables as spots, plans, expression, curves and so on: as DataFrames, and as DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import scratch, shared_folder  # noqa: F401

PITCH = 137.0


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spots(spark: SparkSession, d: str) -> DataFrame:
    """Three pairs of slices, of all embeddings: odd ids are B, even ones A, and indices and positions begin anew in every slice.
    Every 11th position of A lies 1,000 rows down: off the grid of B, or, in slices of more rows than that, on another spot's position."""
    p, q = F.expr("vec_id div 2"), F.expr("(vec_id div 2) div 3")
    side = F.when(F.col("vec_id") % 2 == 1, "B").otherwise("A")
    pair = F.concat(F.lit("p"), p % 3)
    layer = F.when(F.col("label") <= 5, F.concat(F.lit("Layer"), F.col("label") + 1)).when(F.col("label") == 6, "WM").otherwise("NA")
    at = lambda k: F.get("embedding", F.lit(k)).cast("double") * 1000
    row = F.floor(q / 20) + F.when(F.col("vec_id") % 22 == 0, 1000).otherwise(0)
    return table(spark, d, "embeddings").select(
        pair.alias("pair_id"), side.alias("side"), F.concat(pair, side).alias("sample_id"), q.alias("spot_idx"), row.cast("int").alias("array_row"), (q % 20).cast("int").alias("array_col"), at(0).alias("x"), at(1).alias("y"), layer.alias("layer")
    )


def spots_a(spark: SparkSession, d: str) -> DataFrame:
    return spots(spark, d).where("side = 'A'")


def spots_b(spark: SparkSession, d: str) -> DataFrame:
    return spots(spark, d).where("side = 'B'")


def qk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    pair = F.concat(F.lit("p"), F.expr("(vec_id div 2) % 3"))
    return e.select(pair.alias("pair_id"), F.when(F.col("vec_id") % 2 == 1, "B").otherwise("A").alias("side"), F.expr("(vec_id div 2) div 3").alias("spot_idx"), F.col("embedding").cast("array<double>").alias("v"))


def qk_odd(spark: SparkSession, d: str) -> DataFrame:
    """qk, with a NaN in some vectors, a null in others: they match nothing."""
    first = F.when(F.col("_k") == 0, F.lit(float("nan"))).when(F.col("_k") == 1, F.lit(None).cast("double"))
    marked = qk(spark, d).withColumn("_k", F.when(F.col("spot_idx") % 31 == 7, F.col("spot_idx") % 2))
    return marked.withColumn("v", F.when(F.col("_k").isNotNull(), F.concat(F.array(first), F.slice("v", 2, 9999))).otherwise(F.col("v"))).drop("_k")


def plan(spark: SparkSession, d: str) -> DataFrame:
    """Mass of all of lineitem, in three runs over each of the three pairs. Keys are folded by the number of spots, so plans grow with
    the tables; the last tenth of A and the last 25th of B get none."""
    n = table(spark, d, "embeddings").agg(F.expr("count(*) div 6").alias("n"))
    li = table(spark, d, "lineitem").crossJoin(F.broadcast(n))  # one row
    keys = F.col("l_returnflag").alias("run_id"), F.concat(F.lit("p"), F.col("l_linenumber") % 3).alias("pair_id"), F.expr("l_orderkey % (n * 9 div 10)").alias("a_idx"), F.expr("l_partkey % (n * 24 div 25)").alias("b_idx")
    return li.select(*keys, F.col("l_quantity").cast("double").alias("q")).groupBy("run_id", "pair_id", "a_idx", "b_idx").agg(F.sum("q").alias("mass"))


def expr(spark: SparkSession, d: str) -> DataFrame:
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    j = li.join(s, li.l_suppkey == s.s_suppkey)
    return j.select(F.expr("cast(s_nationkey % 4 as string)").alias("sample_id"), F.col("l_suppkey").alias("spot_idx"), F.expr("cast(l_partkey % 500 as int)").alias("gene_idx"), F.col("l_quantity").cast("double").alias("q")).groupBy("sample_id", "spot_idx", "gene_idx").agg(F.sum("q").alias("count"))


def basis(spark: SparkSession) -> DataFrame:
    """A fixed basis of 4 dimensions, by rule."""
    return spark.range(500).select(F.col("id").cast("int").alias("gene_idx"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("dim")).withColumn("w", ((F.col("gene_idx") * 7 + F.col("dim") * 13) % 11 - 5) / 10.0)


def curves(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    severity = F.element_at(F.array(*[F.lit(float(x)) for x in (0, 1, 2, 3, 4, 6, 8)]), (F.col("user_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("event_type").alias("method"), severity.alias("severity"), (k % 5).cast("int").alias("seed"), (F.col("user_id") % 3).cast("long").alias("fold"), F.col("value").cast("double").alias("reg_err"), F.when(F.col("event_id") % 2 == 0, "train").otherwise("test").alias("role"))


def method_curves(spark: SparkSession, d: str) -> DataFrame:
    """Mean error of each (method, fold, severity)."""
    return curves(spark, d).groupBy("method", "fold", "severity").agg(F.avg("reg_err").alias("err"))


def bumps(spark: SparkSession) -> DataFrame:
    """8 bumps for 2 seeds, by rule."""
    b = spark.range(8).select(F.col("id").alias("bump_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seed"))
    return b.select("seed", "bump_id", ((F.col("bump_id") * 97 + F.col("seed") * 31) % 400 - 200).cast("double").alias("cx"), ((F.col("bump_id") * 61 + F.col("seed") * 17) % 400 - 200).cast("double").alias("cy"), F.cos(F.col("bump_id") + F.col("seed")).alias("ux"), F.sin(F.col("bump_id") + F.col("seed")).alias("uy"), (0.5 + F.col("bump_id") / 16.0).alias("amp"))


def cuts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0.7, 0.6, 1, 3.0), (1, 2.1, 0.65, -1, 3.0)], "seed int, theta double, quantile double, side int, offset_pitch double")


def grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, v, t) for s in (0, 1) for v in (0.0, 3.0, 8.0) for t in (False, True)], "seed int, severity double, tear boolean")


def leads(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """Leads of all customers. dealt: texts are some KB where customers are some bytes, so a small file is many tasks' work: short rows are dealt out first,
    and kept, as filters on the long ones would else be taken back to the file's few parts."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    if dealt:
        shared_folder(spark)
        c = c.repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey").checkpoint()
    k = F.col("c_custkey")
    name = F.when(k % 13 == 0, "\t\n\u00a0").otherwise(F.concat(F.lit("\t"), "c_name", F.lit("\u3000\n")))
    email = F.concat(F.lower("c_name"), F.when(k % 5 == 0, " at ").otherwise("@"), F.lower("c_mktsegment"), F.lit(".com"))
    return c.select(k.alias("custkey"), name.alias("full_name"), email.alias("email"), F.col("c_mktsegment").alias("company"), F.when(k % 3 == 0, "").otherwise(" lead\n").alias("role"), F.when(k % 17 == 0, "").otherwise("1-10").alias("company_size"), F.when(k % 19 == 0, "\n\n").otherwise(F.expr("repeat('x', cast(c_custkey % 5100 as int))")).alias("looking_for"), F.lit(None).cast("string").alias("source"), F.when(k % 11 == 0, "bot").alias("hp"))


def uploads(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", F.concat("url", F.when(F.col("page_id") % 2 == 0, ".h5ad").otherwise("")).alias("filename"), F.length("html").cast("long").alias("declared_size"), (F.length("html") - F.col("page_id") % 3).cast("long").alias("received"), (F.col("page_id") - 5).alias("spots"))


def write_files(rows: DataFrame, root: str) -> None:
    """Each row (name, content) as a file of its own in a shared folder."""
    from pyarrow import fs

    def write(batches):
        system, folder = fs.FileSystem.from_uri(root)
        system.create_dir(folder)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with system.open_output_stream(f"{folder}/{name}") as f:
                    f.write(content)
        yield from ()

    rows.mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()


SQL = {
    "spots": """spots AS (
  SELECT 'p' || (vec_id // 2) % 3 AS pair_id, CASE WHEN vec_id % 2 = 1 THEN 'B' ELSE 'A' END AS side, 'p' || (vec_id // 2) % 3 || CASE WHEN vec_id % 2 = 1 THEN 'B' ELSE 'A' END AS sample_id, (vec_id // 2) // 3 AS spot_idx,
         (((vec_id // 2) // 3) // 20 + CASE WHEN vec_id % 22 = 0 THEN 1000 ELSE 0 END)::INT AS array_row, (((vec_id // 2) // 3) % 20)::INT AS array_col,
         embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, CASE WHEN label <= 5 THEN 'Layer' || (label + 1) WHEN label = 6 THEN 'WM' ELSE 'NA' END AS layer
  FROM embeddings),
a AS (SELECT * FROM spots WHERE side = 'A'),
b AS (SELECT * FROM spots WHERE side = 'B'),
last_a AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY pair_id, array_row, array_col ORDER BY spot_idx DESC) = 1),
last_b AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY pair_id, array_row, array_col ORDER BY spot_idx DESC) = 1),
bridge AS (SELECT pair_id, b.spot_idx AS b_idx, a.spot_idx AS a_idx, a.x AS gt_x, a.y AS gt_y, a.spot_idx IS NOT NULL AS have FROM b LEFT JOIN last_a a USING (pair_id, array_row, array_col))""",
    "qk": """qk AS (
  SELECT 'p' || (vec_id // 2) % 3 AS pair_id, (vec_id // 2) // 3 AS spot_idx, CASE WHEN vec_id % 2 = 1 THEN 'B' ELSE 'A' END AS side, list_transform(embedding, lambda z: z::DOUBLE) AS v
  FROM embeddings),
pairs AS (SELECT q.pair_id, q.spot_idx AS b_idx, k.spot_idx AS a_idx, q.v AS bv, k.v AS av FROM qk q JOIN qk k ON q.pair_id = k.pair_id AND q.side = 'B' AND k.side = 'A' WHERE q.spot_idx % 31 <> 7 AND k.spot_idx % 31 <> 7),
logits AS (SELECT pair_id, b_idx, a_idx, list_inner_product(bv, av) / sqrt(len(av)) AS logit FROM pairs),
softmax AS (
  SELECT pair_id, b_idx, a_idx, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY pair_id, b_idx) AS p
  FROM (SELECT *, max(logit) OVER (PARTITION BY pair_id, b_idx) AS m FROM logits))""",
    "plan": """size AS (SELECT count(*) // 6 AS n FROM embeddings),
plan AS (
  SELECT l_returnflag AS run_id, 'p' || l_linenumber % 3 AS pair_id, l_orderkey % (n * 9 // 10) AS a_idx, l_partkey % (n * 24 // 25) AS b_idx, sum(l_quantity::DOUBLE) AS mass
  FROM lineitem, size GROUP BY ALL),
runs AS (SELECT DISTINCT run_id, pair_id FROM plan),
heaviest AS (SELECT run_id, pair_id, a_idx, arg_max(b_idx, (mass, -b_idx)) AS b_idx FROM plan GROUP BY ALL),
first_b AS (SELECT pair_id, min(spot_idx) AS b_idx FROM b GROUP BY pair_id),
best AS (
  SELECT run_id, pair_id, spot_idx AS a_idx, coalesce(h.b_idx, f.b_idx) AS b_idx
  FROM runs JOIN a USING (pair_id) JOIN first_b f USING (pair_id) LEFT JOIN heaviest h USING (run_id, pair_id) WHERE h.a_idx = spot_idx
  UNION ALL
  SELECT run_id, pair_id, spot_idx, f.b_idx FROM runs JOIN a USING (pair_id) JOIN first_b f USING (pair_id) WHERE NOT EXISTS (SELECT 1 FROM heaviest h WHERE (h.run_id, h.pair_id, h.a_idx) = (runs.run_id, runs.pair_id, a.spot_idx))),
labelled AS (SELECT best.*, a.layer AS layer_a, b.layer AS layer_b FROM best JOIN a ON (a.pair_id, a.spot_idx) = (best.pair_id, a_idx) JOIN b ON (b.pair_id, b.spot_idx) = (best.pair_id, b_idx)),
accuracy AS (
  SELECT run_id, pair_id, count(*) FILTER (layer_a <> 'NA' AND layer_b <> 'NA' AND layer_a = layer_b) AS n_correct, count(*) FILTER (layer_a <> 'NA' AND layer_b <> 'NA') AS n_scored,
         count(*) FILTER (layer_a = 'NA') AS n_dropped_a_na, count(*) FILTER (layer_a <> 'NA' AND layer_b = 'NA') AS n_dropped_partner_na
  FROM labelled GROUP BY run_id, pair_id),
means_b AS (SELECT run_id, plan.pair_id, b_idx, sum(mass) AS m, sum(mass * x) / sum(mass) AS x, sum(mass * y) / sum(mass) AS y FROM plan JOIN a ON (a.pair_id, a.spot_idx) = (plan.pair_id, plan.a_idx) GROUP BY run_id, plan.pair_id, b_idx),
each_b AS (SELECT run_id, pair_id, spot_idx AS b_idx FROM runs JOIN b USING (pair_id)),
bary AS (SELECT run_id, pair_id, b_idx, coalesce(m, 0) AS col_mass, x, y FROM each_b LEFT JOIN means_b USING (run_id, pair_id, b_idx))""",
    "expr": """expr AS (SELECT (s_nationkey % 4)::VARCHAR AS sample_id, l_suppkey AS spot_idx, (l_partkey % 500)::INT AS gene_idx, sum(l_quantity::DOUBLE) AS count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
lognorm AS (SELECT sample_id, spot_idx, gene_idx, ln(1 + count * 1e4 / sum(count) OVER (PARTITION BY sample_id, spot_idx)) AS v FROM expr),
basis AS (SELECT g::INT AS gene_idx, d::INT AS dim, ((g * 7 + d * 13) % 11 - 5) / 10.0::DOUBLE AS w FROM range(500) t(g), range(4) u(d)),
z AS (SELECT sample_id, spot_idx, dim, sum(v * w) AS z FROM lognorm JOIN basis USING (gene_idx) GROUP BY ALL)""",
    "curves": """curves AS (SELECT event_type AS method, [0, 1, 2, 3, 4, 6, 8][(user_id % 7 + 1)::INT]::DOUBLE AS severity, (json_extract_string(props, '$.k')::INT % 5)::INT AS seed, user_id % 3 AS fold, value::DOUBLE AS reg_err,
      CASE WHEN event_id % 2 = 0 THEN 'train' ELSE 'test' END AS role FROM events),
means AS (SELECT method, fold, severity, avg(reg_err) AS err FROM curves GROUP BY ALL),
steps AS (SELECT method, fold, severity AS s0, lead(severity) OVER w AS s1, err AS e0, lead(err) OVER w AS e1, row_number() OVER w AS k FROM means WINDOW w AS (PARTITION BY method, fold ORDER BY severity))""",
    "warp": """bumps AS (SELECT s::INT AS seed, i AS bump_id, ((i * 97 + s * 31) % 400 - 200)::DOUBLE AS cx, ((i * 61 + s * 17) % 400 - 200)::DOUBLE AS cy, cos(i + s) AS ux, sin(i + s) AS uy, 0.5::DOUBLE + i / 16.0::DOUBLE AS amp
      FROM range(8) t(i), range(2) u(s)),
cuts(seed, theta, quantile, side, offset_pitch) AS (VALUES (0, 0.7::DOUBLE, 0.6::DOUBLE, 1, 3.0::DOUBLE), (1, 2.1::DOUBLE, 0.65::DOUBLE, -1, 3.0::DOUBLE)),
grid AS (SELECT s::INT AS seed, v::DOUBLE AS severity, t AS tear FROM range(2) x(s), (VALUES (0), (3), (8)) y(v), (VALUES (false), (true)) z(t)),
extent AS (SELECT sample_id, sqrt((max(x) - min(x)) ^ 2 + (max(y) - min(y)) ^ 2) AS extent, sqrt((max(x) - min(x)) ^ 2 + (max(y) - min(y)) ^ 2) * 0.18::DOUBLE AS bump_width, avg(x) AS mx, avg(y) AS my FROM spots GROUP BY sample_id),
field AS (SELECT sample_id, seed, spot_idx, x, y, sum(amp * exp(-((x - cx) ^ 2 + (y - cy) ^ 2) / (2 * bump_width ^ 2)) * ux) AS fx, sum(amp * exp(-((x - cx) ^ 2 + (y - cy) ^ 2) / (2 * bump_width ^ 2)) * uy) AS fy
    FROM spots JOIN extent USING (sample_id) CROSS JOIN bumps GROUP BY ALL),
unit AS (SELECT sample_id, seed, spot_idx, x, y, fx / max(sqrt(fx ^ 2 + fy ^ 2)) OVER w AS ux, fy / max(sqrt(fx ^ 2 + fy ^ 2)) OVER w AS uy FROM field WINDOW w AS (PARTITION BY sample_id, seed)),
proj AS (SELECT sample_id, seed, spot_idx, theta, cuts.side, offset_pitch, quantile, (x - mx) * cos(theta) + (y - my) * sin(theta) AS proj FROM spots JOIN extent USING (sample_id) CROSS JOIN cuts),
thr AS (SELECT sample_id, seed, quantile_cont(proj, 0.6) FILTER (seed = 0) AS q0, quantile_cont(proj, 0.65) FILTER (seed = 1) AS q1 FROM proj GROUP BY ALL),
cut AS (SELECT p.sample_id, p.seed, severity, tear, spot_idx, tear AND proj > coalesce(q0, q1) AS torn, CASE WHEN tear AND proj > coalesce(q0, q1) THEN side * 137.0::DOUBLE * offset_pitch * greatest(severity, 1.0::DOUBLE) ELSE 0 END AS move, theta
    FROM proj p JOIN thr USING (sample_id, seed) JOIN grid USING (seed)),
warped AS (SELECT u.sample_id, u.seed, g.severity, g.tear, u.spot_idx, u.x AS x_orig, u.y AS y_orig, u.ux * g.severity * 137.0::DOUBLE - sin(theta) * move AS dx, u.uy * g.severity * 137.0::DOUBLE + cos(theta) * move AS dy, torn
    FROM unit u JOIN grid g USING (seed) JOIN cut c ON (c.sample_id, c.seed, c.severity, c.tear, c.spot_idx) = (u.sample_id, u.seed, g.severity, g.tear, u.spot_idx))""",
    "leads": """leads AS (SELECT c_custkey AS custkey, CASE WHEN c_custkey % 13 = 0 THEN chr(9) || chr(10) || chr(160) ELSE chr(9) || c_name || chr(12288) || chr(10) END AS full_name, lower(c_name) || CASE WHEN c_custkey % 5 = 0 THEN ' at ' ELSE '@' END || lower(c_mktsegment) || '.com' AS email, c_mktsegment AS company,
      CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' lead' || chr(10) END AS role, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE '1-10' END AS company_size, CASE WHEN c_custkey % 19 = 0 THEN chr(10) || chr(10) ELSE repeat('x', (c_custkey % 5100)::INT) END AS looking_for, ' ' || chr(9) || chr(10) || chr(160) || chr(12288) AS white, NULL::VARCHAR AS source,
      CASE WHEN c_custkey % 11 = 0 THEN 'bot' END AS hp FROM customer),
judged AS (SELECT *, list_filter([CASE WHEN trim(full_name, white) = '' THEN 'full_name required' END, CASE WHEN NOT regexp_matches(email, '(?i)^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'email shape' END,
    CASE WHEN company_size = '' THEN 'company_size required' END, CASE WHEN trim(looking_for, white) = '' THEN 'looking_for required' END,
    CASE WHEN length(looking_for) > 5000 THEN 'looking_for length' END], lambda x: x IS NOT NULL) AS reasons FROM leads)""",
    "uploads": """uploads AS (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '.h5ad' ELSE '' END AS filename, length(html)::BIGINT AS declared_size, (length(html) - page_id % 3)::BIGINT AS received, page_id - 5 AS spots
      FROM pages)""",
    "ledger": """ledger AS (SELECT o_orderkey AS run, o_orderstatus AS status, o_orderpriority AS batch FROM orders)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
