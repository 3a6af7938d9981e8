"""A corpus pipeline in five stages, each written as Parquet and read again as the next one's documents.

toxicity -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> mixing to target weights.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rasterspark.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from rasterspark.llm.common import read_table, scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go; the chain learns from the labelled ones among docs."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in one of them; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.selectExpr(*[f"CAST(length(text) AS BIGINT) AS {c}" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return ngram_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark's windows cover to a twentieth or more go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy that the mix takes of a document, cut to the words that it takes, with target,
    taken, shard and shard_order; rows are dealt by shard and shuffled within it."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]
#: The first stage is a fitted model, which SQL can't express; the tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read_table(spark, sf_dir, "documents"), f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
