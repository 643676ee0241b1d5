"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key; within its source, documents are taken in order of the key until the source's
budget is spent, beginning again from the first where the budget is larger than the source. The running sums are
distributed: keys are cut into `bins` ranges, the sizes of (source, range) are summed and accumulated (a table of
sources times bins rows at most), and only within such a range rows are sorted together. So a source that holds a
third of all rows is dealt over all its ranges. The last document taken gives as many words as the budget still has.

Targets: sources in order of code points, null last, get the given weights in turn and share `total` times all sizes;
a target stops at `most` times its source's size, and what is over is shared again by weight until none is above.
That is the level L with sum(min(most * size, L * weight)) = total * sizes, found with one sort of the sources by
most * size / weight and running sums; the table of sources is one row each.

Defined cases: texts of any length count with all their words, and one that is larger than its source's budget is taken in part; null text has size 0; a null source is a source, the last; documents of one key (repeated rows) are
taken in order of doc_id and size; an empty table gives an empty result; sources without words have target 0; other
columns are ignored by `mix_sources`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import use_shared_checkpoints, word_count

WEIGHTS, TOTAL, MOST, BINS = (5, 2, 1), 1.5, 2, 4096


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Adds `target` to rows (source, source_size)."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "place")
    everything = Window.partitionBy(F.lit(0))
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    s = sources.withColumn("place", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("before", F.sum("cap").over(upto) - F.col("cap")).withColumn("rest", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
    s = s.withColumn("level", (F.sum("source_size").over(everything) * float(total) - F.col("before")) / F.col("rest"))
    # sources are full in order of ratio; the level is that of the first which isn't
    s = s.withColumn("share", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)["level"])
    return s.withColumn("target", F.least("cap", F.coalesce(F.col("share") * F.col("weight"), F.col("cap")))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST, bins: int = BINS) -> DataFrame:
    """Per row of docs (doc_id, source, text): doc_id, size, source_size, target, taken."""
    use_shared_checkpoints(docs.sparkSession)
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    # one scan of the texts; what follows works on five small columns
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    d = d.withColumn("bin", F.floor(F.col("key") / F.lit(2.0**60 / bins)).cast("int")).withColumn("named", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).checkpoint()
    per = d.groupBy("named", "bin").agg(F.sum("size").alias("bin_size"), F.first("source").alias("source"))
    sizes = targets(per.groupBy("named").agg(F.sum("bin_size").alias("source_size"), F.first("source").alias("source")).select("source", "source_size"), weights, total, most)
    sizes = sizes.withColumn("named", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).drop("source")
    running = Window.partitionBy("named").orderBy("bin")
    per = per.select("named", "bin", (F.sum("bin_size").over(running) - F.col("bin_size")).alias("bins_before")).join(sizes, "named")
    within = Window.partitionBy("named", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(per, ["named", "bin"]).withColumn("before", F.col("bins_before") + F.sum("size").over(within) - F.col("size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.floor("target").cast("long") - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", left - F.col("before")))
    return d.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken.alias("taken"))


#: The same rows in DuckDB, for the given parameters.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][(place % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (
  SELECT *, cap / weight AS ratio, sum(cap) OVER o - cap AS before, sum(weight) OVER () - sum(weight) OVER o + weight AS rest,
         sum(source_size) OVER () AS everything
  FROM w WINDOW o AS (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (everything::DOUBLE * 1.5::DOUBLE - before) / rest AS level FROM r),
t AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1)) AS target FROM l),
p AS (
  SELECT doc_id, size, source_size, target,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT * size
             + greatest(0, least(size, floor(target)::BIGINT - floor(target / source_size)::BIGINT * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM p
"""
