"""Corpus pipeline: classify, apply rules, remove near copies, redact secrets, pack.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last return
the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom.llm import ngram_join, packing, quality_classifier, quality_rules, secret_scans
from netloom.llm.common import table
from netloom.session import cut, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MAX_BROADCAST = 2_000_000


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more."""
    weights = quality_classifier.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs.select(*COLUMNS), weights).where("score >= 0.7").select(*COLUMNS)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their stratum's certified cutoffs."""
    return quality_rules.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), keep_text=True).where("kept").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word n-grams, similarity 0.8.

    Rows are told apart by a key of their own, so repeated rows, several texts under one id and null
    ids are judged row by row. The row that stays is the least by id (nulls last), text hash and row
    key. Texts without words have no copies; of such rows with the same id and text one stays.
    """
    docs = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "rows")
    groups = ngram_join.joined(docs.select("_row", "text"), n=5, percent=80, id_col="_row")
    alike = F.when((F.col("n_shingles") == 0) & F.col("doc_id").isNotNull(), F.struct("doc_id", F.col("_hash").alias("h")))
    groups = cut(groups.join(docs.select("_row", "doc_id", F.xxhash64("text").alias("_hash")), "_row")
                 .select("_row", "doc_id", "_hash", alike.alias("_same"), F.when(alike.isNull(), F.col("component_id")).alias("_group")), "groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_hash", "_row"))
    kept = groups.groupBy("_same", "_group").agg(least.alias("_least")).select("_least._row")
    gone = cut(groups.select("_row").join(kept, "_row", "left_anti"), "gone")
    small = gone.count() <= MAX_BROADCAST
    return docs.join(F.broadcast(gone) if small else gone, "_row", "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and ``n_chars`` counted again where the text changed."""
    done = secret_scans.redact(docs.select(*COLUMNS, F.col("text").alias("_old")))
    same = F.col("text").eqNullSafe(F.col("_old"))
    return done.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens."""
    return packing.packed(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality_classifier", classify), ("quality_rules", apply_rules), ("ngram_join", drop_copies), ("secret_scans", redact), ("packing", pack)]

#: training, exact binomial tails and tokenizers are not SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STAGES`` applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
