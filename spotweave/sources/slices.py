"""Reading and writing slices, curves, plans, run summaries and stacks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.runtime import meet, numbered, shared_folder
from ..functions.vectors import finite
from ..operators.scoring import label_transfer_accuracy
from ..operators.transforms import stacking_height
from .intake import scan_uploads

# Label columns in order of preference.
LABEL_COLUMNS = ("sce.layer_guess", "layer_guess", "layer_guess_reordered", "Layer", "layer", "ground_truth", "spatialLIBD", "Region", "annotation")
# Layers in order.
LAYERS = ("Layer1", "Layer2", "Layer3", "Layer4", "Layer5", "Layer6", "WM")
# The columns of all generations of curve files, after severity.
CURVE = (
    "max_disp_px", "mean_disp_px", "reg_err_mean", "reg_err_median", "reg_err_p90", "reg_err_mean_argmax", "reg_err_median_argmax", "reg_err_p90_argmax", "n_reg_scored", "paste2_acc", "random_floor",
    "n_label_scored", "match_top1", "n", "runtime_s",
)
#: What the name of a curve file says, by pattern.
NAME = {"seed": r"_seed(\d+)", "fold": r"_(?:test|held)?(S\d+|Br\d+)(?=_|$)", "role": r"_(train|test)_curve$"}


def scan_slice(spark: SparkSession, path: str, sample_id: str) -> DataFrame:
    """One sample of a table partitioned by sample_id; an unknown sample is an error."""
    df = spark.read.parquet(path).where(F.col("sample_id") == sample_id)
    if not df.take(1):
        raise FileNotFoundError(f"no sample {sample_id} in {path}")
    return df


def resolve_label_column(df: DataFrame, candidates: Sequence[str] = LABEL_COLUMNS) -> str | None:
    """The first candidate that is a column; a matter of the schema, not of rows."""
    return next((c for c in candidates if c in df.columns), None)


def layer_fallback_two(df: DataFrame) -> Column:
    return F.col(f"`{resolve_label_column(df, ('sce.layer_guess', 'layer'))}`")


def standardize_slice(df: DataFrame, sample_id: Column, candidates: Sequence[str] = LABEL_COLUMNS) -> DataFrame:
    """Adds sample_id and, if there is a label column, `layer` as a string with NA for missing labels."""
    found = resolve_label_column(df, candidates)
    out = df.withColumn("sample_id", sample_id)
    return out if found is None else out.withColumn("layer", F.coalesce(F.col(f"`{found}`").cast("string"), F.lit("NA")))


def layer_index(layer: Column, layers: Sequence[str] = LAYERS) -> Column:
    """0-based place among the layers, -1 for others."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in layers]), layer) - 1, F.lit(-1).cast("long"))


def write_curves(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def scan_curves(spark: SparkSession, path: str, columns: Sequence[str] = CURVE, stem: str = r"([^/]+)\.csv$") -> DataFrame:
    """Curve files of any generation in one scan: run (the file's name), method, fold, seed, role, severity, and the given
    columns as doubles, null where a file has none of that name.

    Files differ in their columns, so lines are read by their own file's header (its first line), never by place. Of equal
    (run, severity) the last row counts. Values are numbers, so a comma always parts two of them.
    """
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.csv").select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("k"))
    run = F.url_decode(F.regexp_extract("file", stem, 1))
    lines = lines.where(F.trim("value") != "").withColumn("cells", F.transform(F.split("value", ","), lambda x: F.trim(x)))
    head = F.array_contains("cells", F.lit("severity"))
    names = lines.where(head).groupBy("file").agg(F.min_by("cells", "k").alias("names"))
    rows = lines.where(~head).join(names, "file").withColumn("row", F.map_from_arrays(F.slice("names", 1, F.least(F.size("names"), F.size("cells"))), F.slice("cells", 1, F.least(F.size("names"), F.size("cells")))))
    value = lambda c: F.try_element_at("row", F.lit(c)).try_cast("double").alias(c)
    rows = rows.select(run.alias("run"), value("severity"), *[value(c) for c in columns], "k")
    rows = last_of_each(rows, ["run", "severity"], "k")
    said = {n: F.nullif(F.regexp_extract("run", p, 1), F.lit("")) for n, p in NAME.items()}
    method = F.col("run")
    for p in (NAME["role"], NAME["seed"], NAME["fold"]):
        method = F.regexp_replace(method, p, "")
    return rows.select("run", method.alias("method"), said["fold"].alias("fold"), said["seed"].cast("int").alias("seed"), said["role"].alias("role"), "severity", *columns)


def last_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def scan_optional(grid: DataFrame, curves: DataFrame, keys: list[str]) -> DataFrame:
    """The grid with nulls where a curve is missing."""
    return grid.join(curves, keys, "left")


#: Files of a plan's run, one for each bucket of (pair, A spot).
BUCKETS = 16


def _plan_table(path: str, part: str) -> str:
    return f"plan_{hashlib.md5(path.encode()).hexdigest()}_{part}"


def write_plan(plan: DataFrame, path: str, labels_a: DataFrame | None = None, labels_b: DataFrame | None = None, parameters: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """A plan (run_id, pair_id, a_idx, b_idx, mass) with what is needed to score it again: the labels of both slices (run_id, pair_id, a_idx or b_idx, layer) and its
    parameters (run_id, key, value). Plan and labels lie by run and, within it, in sorted buckets by spot, A's with the plan's."""
    spark = plan.sparkSession
    for part, df, key in (("plan", plan, "a_idx"), ("labels_a", labels_a, "a_idx"), ("labels_b", labels_b, "b_idx")):
        if df is not None:
            spark.sql(f"DROP TABLE IF EXISTS {_plan_table(path, part)}")
            dealt = df.repartition(buckets, "pair_id", key)  # as the buckets are: a file for each run and bucket
            dealt.write.mode("overwrite").partitionBy("run_id").bucketBy(buckets, "pair_id", key).sortBy("pair_id", key).option("path", f"{path}/{part}").saveAsTable(_plan_table(path, part))
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    if parameters is not None:
        parameters.select("run_id", "key", F.col("value").cast("string").alias("value")).write.mode("overwrite").partitionBy("run_id").parquet(f"{path}/parameters")


def scan_plan(spark: SparkSession, path: str, run_id: str, part: str = "plan") -> DataFrame:
    """A run of a written plan: part plan, labels_a, labels_b or parameters. The tables are registered, with their buckets, where this session's catalog hasn't got them."""
    if part == "parameters":
        return spark.read.parquet(f"{path}/parameters").where(F.col("run_id") == run_id)
    name = _plan_table(path, part)
    if not spark.catalog.tableExists(name):
        shape = spark.read.parquet(f"{path}/{part}").schema
        buckets, key = spark.read.parquet(f"{path}/layout").first()[0], "b_idx" if part == "labels_b" else "a_idx"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (run_id) CLUSTERED BY (pair_id, {key}) SORTED BY (pair_id, {key}) INTO {buckets} BUCKETS LOCATION '{path}/{part}'")
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name).where(F.col("run_id") == run_id)


def rescore(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Label transfer of a stored run, without aligning anew: (run_id, pair_id, counts, accuracy). The heaviest B of each A spot, and its label, are found bucket by bucket: the plan isn't shuffled."""
    plan = scan_plan(spark, path, run_id)
    a, b = (scan_plan(spark, path, run_id, f"labels_{x}") for x in "ab")
    best = plan.groupBy("pair_id", "a_idx").agg(F.max(F.struct("mass", (-F.col("b_idx")).alias("i"))).alias("m")).select("pair_id", "a_idx", (-F.col("m.i")).alias("best"))
    first = b.groupBy("pair_id").agg(F.min("b_idx").alias("first"))  # a row for each pair
    each = a.select("pair_id", "a_idx", F.col("layer").alias("layer_a")).join(best, ["pair_id", "a_idx"], "left").join(F.broadcast(first), "pair_id")
    each = each.select("pair_id", "layer_a", F.coalesce("best", "first").alias("b_idx")).join(b.select("pair_id", "b_idx", F.col("layer").alias("layer_b")), ["pair_id", "b_idx"])
    return label_transfer_accuracy(each, ["pair_id"]).select(F.lit(run_id).alias("run_id"), "*")


def summary_lines(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    return df.select(F.format_string("%s=%s", F.col(key), F.col(value).cast("string")).alias("value"))


def parse_summary(lines: DataFrame) -> DataFrame:
    """key=value lines to (key, value); other lines are left out."""
    at = F.instr("value", "=")
    return lines.where(at > 1).select(F.trim(F.expr("substring(value, 1, instr(value, '=') - 1)")).alias("key"), F.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("val"))


def write_summary(df: DataFrame, path: str) -> None:
    summary_lines(df).write.mode("overwrite").text(path)


def scan_summary(spark: SparkSession, path: str) -> DataFrame:
    return parse_summary(spark.read.text(path))


#: Points of one line of a written stack, and bytes of a stack that one task reads at a time.
LINE, RANGE = 1024, 8 << 20
#: Bytes before a range that are read too, so that the first value of the range is met at its start.
OVERLAP = 4096
_NUMBER = rb"(?:-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|null)"
_SPACE, _STRING = rb"[ \t\r\n]*", rb'"(?:[^"\\]|\\.)*"'
# a stack's parts: a slice's id, the start of one of its arrays, any other key with a plain value, a point, and a value that stands alone (of a layer array)
_TOKEN = re.compile(
    rb'"id"' + _SPACE + b":" + _SPACE + rb"(?P<id>" + _STRING + rb")|"
    rb'"(?P<array>xy|layer)"' + _SPACE + b":" + _SPACE + rb"\[|"
    + _STRING + _SPACE + b":" + _SPACE + rb"(?:" + _STRING + b"|" + _NUMBER + rb"|\[" + _SPACE + rb"(?:" + _STRING + _SPACE + rb",?" + _SPACE + rb")*\])|"
    rb"\[" + _SPACE + rb"(?P<x>" + _NUMBER + rb")" + _SPACE + b"," + _SPACE + rb"(?P<y>" + _NUMBER + rb")" + _SPACE + rb"\]|"
    rb"(?P<value>" + _NUMBER + rb")"
)


def stack_lines(spots: DataFrame, dataset: str = "stack") -> DataFrame:
    """(k, section, chunk, value): lines of text that, in this order, are one JSON document: slices with id, n, xy and layer, points in order of index.
    spots: sample_id, spot_idx, x, y, k (layer index). A line holds LINE points, so a slice is as many rows as it needs."""
    put = spots.select("sample_id", "spot_idx", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.col("k").cast("int").alias("layer"))
    placed = numbered(put, ["sample_id"], ["spot_idx", "x", "y", "layer"], "i")
    number = lambda c: F.when(finite(c), c.cast("string")).otherwise("null")
    point = F.struct("i", F.concat(F.lit("["), number(F.col("x")), F.lit(","), number(F.col("y")), F.lit("]")).alias("xy"), F.coalesce(F.col("layer").cast("string"), F.lit("null")).alias("layer"))
    lines = placed.groupBy("sample_id", F.expr(f"i div {LINE}").alias("chunk")).agg(F.array_sort(F.collect_list(point)).alias("points")).checkpoint()  # LINE at most
    sizes = lines.groupBy("sample_id").agg(F.sum(F.size("points")).alias("n"), F.max("chunk").alias("last"))  # a row for each slice, as are those below
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy("sample_id"))).withColumn("of", F.count("*").over(Window.partitionBy(F.lit(0))))
    comma = lambda more: F.when(more, ",").otherwise("")
    body = meet(lines, ranked, ["sample_id"])
    values = lambda c, section: body.select("k", F.lit(section).alias("section"), "chunk", F.concat(F.array_join(F.transform("points", lambda p: p[c]), ","), comma(F.col("chunk") < F.col("last"))).alias("value"))
    said = F.to_json(F.struct(F.coalesce(F.col("sample_id").cast("string"), F.lit("")).alias("id")))
    head = F.concat(F.substring(said, F.lit(1), F.length(said) - 1), F.lit(',"n":'), F.col("n").cast("string"), F.lit(',"xy":['))
    one = lambda section, value: ranked.select("k", F.lit(section).alias("section"), F.lit(0).cast("long").alias("chunk"), value.alias("value"))
    spark = spots.sparkSession
    ends = spark.createDataFrame([(0, 0, 0, json.dumps({"dataset": dataset})[:-1] + ', "slices": ['), (2**31 - 1, 0, 0, "]}")], "k int, section int, chunk long, value string")
    out = ends.union(one(0, head)).union(values("xy", 1)).union(one(2, F.lit('],"layer":['))).union(values("layer", 3)).union(one(4, F.concat(F.lit("]}"), comma(F.col("k") < F.col("of")))))
    return out.select("k", "section", "chunk", "value")


def write_stack_json(spots: DataFrame, path: str, dataset: str = "stack") -> None:
    """A stack as one JSON document in ordered parts: text files that, joined by name, are the document. Any number of tasks write a slice."""
    order = ["k", "section", "chunk"]
    stack_lines(spots, dataset).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def read_stack_json(spark: SparkSession, path: str, spacing: float = 30.0, size: int = RANGE) -> DataFrame:
    """One row per point of the stack documents under a path: sample, i (its place in its slice), x, y, layer, and height by the slice's place, centred.

    Files are read in ranges of bytes, so a slice is as many tasks as it needs. A range parts its bytes into values, beginning a little before itself, as any
    point or comma shows where values start; it doesn't know of which slice they are, nor how many came before. That follows from a table of
    the ranges' sections (one for each range and each array in it), and points and layers are joined by slice and place. Files in one folder are
    parts of one document, in order of name.
    """

    def read(batches):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, part, of in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "size")), strict=True):
                lo, hi = part * size, min((part + 1) * size, of)
                begin = max(0, lo - OVERLAP)
                with system.open_input_file(file) as f:
                    f.seek(begin)
                    data = f.read(min(hi + OVERLAP, of) - begin)
                rows, section, kind, i = [], 0, None, {"xy": 0, "layer": 0}
                for m in _TOKEN.finditer(data):
                    at = begin + m.start()
                    if at >= hi:
                        break
                    if at < lo:
                        continue
                    if m["id"] is not None or m["array"] is not None:
                        section, kind, i = section + 1, m["array"].decode() if m["array"] else "id", {"xy": 0, "layer": 0}
                        rows.append((file, part, section, kind, -1, None, None, None, json.loads(m["id"]) if m["id"] else None))
                    elif m["x"] is not None or m["value"] is not None:
                        what = "xy" if m["x"] is not None else "layer"
                        x, y, v = (None if t is None or t == b"null" else float(t) for t in (m["x"], m["y"], m["value"]))
                        rows.append((file, part, section, what, i[what], x, y, None if v is None else int(v), None))
                        i[what] += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    names = ["path", "part", "section", "kind", "at", "x", "y", "layer", "id"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.string()]
    shape = "path string, part long, section int, kind string, at long, x double, y double, layer int, id string"
    files = scan_uploads(spark, path).where("size > 0").select("path", "size")
    parts = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {size}"))).alias("part"))
    shared_folder(spark)
    values = parts.repartition("path", "part").mapInArrow(read, shape).checkpoint()
    # a row for each range and section: few
    sections = values.groupBy("path", "part", "section").agg(F.max(F.when(F.col("at") < 0, F.col("kind"))).alias("starts"), F.max("id").alias("id"), *[F.count_if((F.col("at") >= 0) & (F.col("kind") == c)).alias(f"n_{c}") for c in ("xy", "layer")])
    order = Window.partitionBy(F.lit(0)).orderBy("path", "part", "section")
    sections = sections.withColumn("slice", F.count_if(F.col("starts") == "id").over(order)).withColumn("run_xy", F.count_if(F.col("starts") == "xy").over(order)).withColumn("run_layer", F.count_if(F.col("starts") == "layer").over(order))
    before = lambda c: F.sum(f"n_{c}").over(Window.partitionBy(f"run_{c}").orderBy("path", "part", "section")) - F.col(f"n_{c}")
    sections = sections.withColumns({"before_xy": before("xy"), "before_layer": before("layer")})
    names_of = sections.where("starts = 'id'").select("slice", "id").checkpoint()
    placed = values.where("at >= 0").join(sections.select("path", "part", "section", "slice", "before_xy", "before_layer"), ["path", "part", "section"])
    xy = placed.where("kind = 'xy'").select("slice", (F.col("at") + F.col("before_xy")).alias("i"), "x", "y")
    layer = placed.where("kind = 'layer'").select("slice", (F.col("at") + F.col("before_layer")).alias("i"), "layer")
    height = stacking_height(names_of.select(F.col("id").alias("sample_id")), spacing)
    named = names_of.join(height, F.col("id") == F.col("sample_id")).select("slice", "sample_id", "z")
    return xy.join(layer, ["slice", "i"], "left").join(named, "slice").select("sample_id", F.col("i").cast("int").alias("i"), "x", "y", "layer", "z")
