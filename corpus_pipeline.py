"""From raw documents to packed training batches, in five stages.

Each stage gets the documents that the one before kept, written as Parquet and
read again, and returns the columns of ``documents``; the last returns the
packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, neardup, packing, repeats, toxicity
from graphloom.llm.common import cut, drop, prepare, table
from graphloom.plans.session import ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    ship(spark)
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return neardup.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages of fifty words or more.

    Such a passage often has fewer than the 400 bytes of the operator's query, so
    the stage has a span and a least number of words of its own.
    """
    ship(spark)
    return repeats.without_repeats(docs, span=repeats.PASSAGE_SPAN, least_words=repeats.PASSAGE_WORDS)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; contaminated ones (two items or more) go."""
    ship(spark)
    out = decontaminate.without_spans(docs, table(spark, sf_dir, "benchmark"), drop_from=2)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in length buckets and token-budget batches."""
    ship(spark)
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]

#: SQL can't express a fitted model; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for _, stage in STAGES[:-1]:
        now: list[str] = []
        docs = cut(stage(spark, docs, sf_dir), now)
        drop(spark, before)  # the next stage is written
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
