"""The corpus pipeline: documents through language ID, near-duplicate removal, suffix-array deduplication,
benchmark decontamination and mixing. Each stage is (name, function); a function takes (spark, docs, sf_dir), and its
result is written and read again as the next one's docs. All but the last return the columns of documents, with whatever other
columns they have; an empty table gives an empty result. Texts of any length are read whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm import decontamination, language_id, mixing, ngram_join, suffix_dedup
from spotweave.llm.common import table, use_shared_checkpoints


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected. Null texts and texts without letters go (they have no language); a null lang is not learned from; repeated
    rows share their fate; with no labelled documents at all every one goes, as none can be told."""
    learnable = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1)
    return language_id.identified(docs, language_id.learn(learnable))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least doc_id. Null and wordless texts stay; so do rows without a doc_id, and all rows of the
    least doc_id (rows of one id are one document)."""
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that an earlier document has in a string of 50. All rows stay, null and empty texts as they are; rows of one doc_id,
    or without one, take nothing from each other; n_chars follows the text."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and wordless texts stay; an empty benchmark takes none."""
    return decontamination.without_hits(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: a row for each row, of size 0 for null texts; a null source is a source."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language ID", identify_languages),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def written(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to a new folder among the checkpoints and read again."""
    use_shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    docs.write.parquet(folder)
    return spark.read.schema(docs.schema).parquet(folder)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
