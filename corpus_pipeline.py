"""A corpus pipeline of five stages over ``documents``; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (decontamination, line_duplicates, near_duplicates, packing, toxicity)
from newsloom.llm.queries import table, vocabulary
from newsloom.session import configure, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7; the model learns from the stage's own input."""
    configure(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are similar to an earlier line; ``n_chars`` counts what is left."""
    configure(spark)
    kept = line_duplicates.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    configure(spark)
    return near_duplicates.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    configure(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), "documents")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids packed into windows; one row for each piece."""
    configure(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines),
          ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("packing", pack)]
ORACLE_SQL = None  # scores, similarity joins and packing are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
