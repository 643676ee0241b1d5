"""Quality rules with risk-controlled cutoffs, with DataFrame functions only.

Five measures, all shares or rates: symbols (a code point of words), repeated lines (a line with a word), repeated words
(a word), capitals (a code point of words), and punctuation marks (a word). `STEPS` fixes a path of ever stricter rules: at
each step a document is rejected that has any measure above that step's cutoff of it, so each document has a depth, the
first step that rejects it.

For each stratum (here: language) the labelled documents are a holdout: of n good ones a step rejects k. It is allowed if an
exact binomial test rejects "more than alpha of the good ones are rejected" - P(Bin(n, alpha) <= k) <= delta / strata, which is
the exact (Clopper-Pearson) bound. The steps are tested from the mildest on and k can only grow, so the sequence needs no
further correction (fixed-sequence testing), and delta is corrected for the strata (Bonferroni). So with confidence
1 - delta, in no stratum are more than alpha of the good documents rejected by all measures together. Of the allowed
steps the one that catches the most bad documents is used, of equal ones the mildest. A stratum whose mildest step isn't
allowed (with four strata, one of fewer than 72 good labels) is not certified: it keeps all that the base rules keep, and says so.

Texts never move: one scan gives each document its counts (checkpointed); the holdout is joined by id and summed to
(stratum, step) rows.

Windows of three words are equal when their 64-bit hashes are: two different windows of one text meet with a chance of some 1e-7 in a text of a million words.

Defined cases: null text has no words; texts of any length are counted whole; a null stratum is one of its own; labels are one per doc_id, the largest if
several are given, nulls ignored; a labelled id is one trial of the bound however many rows have it, with the least depth among them (then the first stratum by name); without labels no rule is on; equal rows each get their result; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, use_shared_checkpoints

ALPHA, DELTA = 0.05, 0.1
#: Cutoffs of each measure, step by step from the mildest.
STEPS = {
    "symbols": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04),
    "repeated_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "repeated_words": (0.48, 0.45, 0.4, 0.35, 0.3, 0.27, 0.24, 0.21, 0.18, 0.16, 0.14, 0.12),
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.17, 0.15),
    "marks": (3.0, 2.5, 2.0, 1.7, 1.4, 1.2, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5),
}
MEASURES = tuple(STEPS)
_WHITE = r"[\x20\x09-\x0D]+"


def counts(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the base counts of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), text.alias("t"))
    d = d.withColumn("solid", F.regexp_replace("t", _WHITE, ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    d = d.select(
        "doc_id", "stratum",
        F.filter(F.split("t", _WHITE), lambda x: x != "").alias("w"), lines.alias("lines"),
        F.length("solid").alias("word_chars"),
        F.length(F.regexp_replace("solid", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("solid", r"[^\p{Lu}]+", "")).alias("n_capitals"),
        F.length(F.regexp_replace("solid", r"[^!?.,;:]+", "")).alias("n_marks"),
    )
    # windows of three words by hash, sorted so that equal ones are neighbours
    triple = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda a, i: F.struct(F.xxhash64(a, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))
    d = d.withColumn("s", F.sort_array(triple))
    d = d.withColumn("e", F.zip_with("s", F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    met = F.transform("s", lambda a, i: F.when(F.get("e", i) | ((i > 0) & F.get("e", i - 1)), a["i"]))
    d = d.withColumn("p", F.sort_array(F.filter(met, lambda x: x.isNotNull())))
    steps = F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    long = lambda c: c.cast("long")
    return d.select(
        "doc_id", "stratum", long(F.size("w")).alias("n_words"), long(F.col("word_chars")).alias("word_chars"), long(F.col("n_symbols")).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), long(F.aggregate(steps, F.lit(0), lambda a, x: a + x)).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"), long(F.col("n_capitals")).alias("n_capitals"), long(F.col("n_marks")).alias("n_marks"),
    )


def _rate(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def measures() -> Column:
    """The measures in order, as an array."""
    return F.array(_rate("n_symbols", "word_chars"), _rate("n_dup_lines", "n_lines"), _rate("n_repeat_words", "n_words"), _rate("n_capitals", "word_chars"), _rate("n_marks", "n_words"))


def _log_factorial(n: Column) -> Column:
    n = n.cast("double")
    series = n * F.log(n) - n + 0.5 * F.log(2 * math.pi * n) + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * F.pow(n, F.lit(5.0)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20.0)).cast("int")).cast("double"))).otherwise(series)


def binomial_at_most(k: Column, n: Column, share: float) -> Column:
    """P(Bin(n, share) <= k) where k is no more than the mean; 1 beyond, where no test of interest can reject."""
    term = lambda i: F.exp(_log_factorial(n) - _log_factorial(i) - _log_factorial(n - i) + i * math.log(share) + (n - i) * math.log1p(-share))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(k, F.floor(n * share))), F.lit(0.0), lambda s, i: s + term(i))
    return F.when(k > n * share, 1.0).otherwise(total)


def depth(m: Column) -> Column:
    """The first step, from 1, whose rules reject a document of these measures; one more than there are steps if none does."""

    def first(value: Column, cuts: tuple[float, ...]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: value <= c)) + 1

    return F.least(*[first(F.get(m, F.lit(k)), cuts) for k, cuts in enumerate(STEPS.values())])


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, step, good, good_rejected, bad_rejected, chance) of the certified strata; step is null where no allowed one catches anything."""
    n_steps = len(next(iter(STEPS.values())))
    labels = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    one = F.min(F.struct("depth", F.coalesce("stratum", F.lit("")).alias("s"), "stratum")).alias("d")  # rows of one id are one trial
    held = measured.join(labels, "doc_id").groupBy("doc_id").agg(one, F.max("quality").alias("quality")).select("d.*", "quality")
    held = held.groupBy("stratum", "depth").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    # a table of strata * steps rows from here on
    upto = lambda c: F.transform(F.sequence(F.lit(1), F.lit(n_steps)), lambda s: F.aggregate(F.filter("by", lambda x: x["depth"] <= s), F.lit(0).cast("long"), lambda a, x: a + x[c]))
    held = held.groupBy("stratum").agg(F.sum("good").alias("good"), F.collect_list(F.struct("depth", "good", "bad")).alias("by")).withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(0))))
    held = held.select("stratum", "good", F.posexplode(F.arrays_zip(upto("good").alias("g"), upto("bad").alias("b"))).alias("step", "x"), "strata")
    held = held.select("stratum", (F.col("step") + 1).alias("step"), "good", F.col("x.g").alias("good_rejected"), F.col("x.b").alias("bad_rejected"), "strata")
    held = held.withColumn("chance", binomial_at_most(F.col("good_rejected"), F.col("good"), alpha)).where(F.col("chance") <= F.lit(delta) / F.col("strata"))
    best = Window.partitionBy("stratum").orderBy(F.desc("bad_rejected"), "step")
    return held.withColumn("k", F.row_number().over(best)).where("k = 1").select("stratum", F.when(F.col("bad_rejected") > 0, F.col("step")).alias("step"), "good", "good_rejected", "bad_rejected", "chance")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per document: the base counts, base_failed, kept, certified (its stratum has a cutoff), and `broken`, the measures above their cutoff."""
    use_shared_checkpoints(docs.sparkSession)
    measured = counts(docs, stratum).withColumn("m", measures()).withColumn("depth", depth(F.col("m"))).checkpoint()
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    rules = cutoffs(measured, labels, alpha, delta).select(named(F.col("stratum")).alias("named"), "step", F.lit(True).alias("certified"))
    d = measured.withColumn("named", named(F.col("stratum"))).join(rules, "named", "left")
    above = lambda k, cuts: F.get("m", F.lit(k)) > F.get(F.array(*[F.lit(c) for c in cuts]), F.col("step") - 1)
    broken = F.filter(F.array(*[F.when(above(k, cuts), F.lit(name)) for k, (name, cuts) in enumerate(STEPS.items())]), lambda x: x.isNotNull())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    d = d.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.coalesce("certified", F.lit(False)).alias("certified"), broken.alias("broken"))
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def oracle(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """The query's rows in DuckDB."""
    rate = {"symbols": ("n_symbols", "word_chars"), "repeated_lines": ("n_dup_lines", "n_lines"), "repeated_words": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars"), "marks": ("n_marks", "n_words")}
    first = ", ".join(f"len(list_filter({list(cuts)}::DOUBLE[], lambda c: {rate[m][0]} / greatest({rate[m][1]}, 1)::DOUBLE <= c)) + 1" for m, cuts in STEPS.items())
    steps = len(next(iter(STEPS.values())))
    word, white = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+"
    kept = lambda keep: f"len(regexp_replace(regexp_replace(t, '{white}', '', 'g'), '[^{keep}]+', '', 'g'))"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '{word}+')) AS word, generate_subscripts(regexp_extract_all(t, '{word}+'), 1) AS k FROM d),
g AS (SELECT doc_id, k, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT doc_id, k FROM g WHERE s IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
n AS (SELECT doc_id, count(DISTINCT k + j) AS n_repeat_words FROM r, range(3) x(j) GROUP BY doc_id),
c AS (
  SELECT doc_id, lang, len(regexp_extract_all(t, '{word}+')) AS n_words, len(regexp_replace(t, '{white}', '', 'g')) AS word_chars, {kept("#*$%&|<>")} AS n_symbols, {kept(chr(92) + "p{Lu}")} AS n_capitals, {kept("!?.,;:")} AS n_marks,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}'))) AS n_lines, len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')))) AS n_different,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN n USING (doc_id)),
m AS (SELECT *, n_lines - n_different AS n_dup_lines FROM c),
p AS (SELECT *, least({first}) AS depth FROM m),
l AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
o AS (SELECT doc_id, arg_min(lang, (depth, coalesce(lang, ''))) AS lang, min(depth) AS depth, any_value(quality) AS quality FROM p JOIN l USING (doc_id) GROUP BY doc_id),
h AS (
  SELECT lang, step, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND depth <= step) AS k, count(*) FILTER (quality = 0 AND depth <= step) AS bad
  FROM o, range(1, {steps + 1}) x(step) GROUP BY ALL),
q AS (
  SELECT *, CASE WHEN k > n * {alpha} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({alpha}) + (n - i) * ln(1 - {alpha})))) END AS chance
  FROM h WHERE n > 0),
best AS (SELECT lang, CASE WHEN bad > 0 THEN step END AS step FROM q WHERE chance <= {delta} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM h)) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY bad DESC, step) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, b.lang IS NOT NULL OR (p.lang IS NULL AND EXISTS (SELECT 1 FROM best WHERE lang IS NULL)) AS certified,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(depth <= b.step, false) AS kept
FROM p LEFT JOIN best b ON p.lang IS NOT DISTINCT FROM b.lang"""
