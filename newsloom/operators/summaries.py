"""Cluster summaries, labels and summary scores."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import lexicons as lx
from newsloom.functions.normalize import clean_ascii
from newsloom.operators.entities import top_entities_by
from newsloom.operators.ranking import top_per_group


def shorten(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit,
                  F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def cluster_summaries(df: DataFrame, cluster: str, text: str, order: Sequence[str], texts: int = 5,
                      sentences: int = 3, min_length: int = 30, limit: int = 300,
                      skip: Sequence[str] = lx.SUMMARY_SKIP_PREFIXES) -> DataFrame:
    """(cluster, summary): first distinct long sentences of each cluster's first texts.

    Without such a sentence the summary is the start of the cluster's first text.
    """
    first = top_per_group(df.select(cluster, text, *order), [cluster], order, texts, rank="t")
    parts = first.select(cluster, "t", F.posexplode(F.split(clean_ascii(F.col(text)), "[.?\n]+"))
                         .alias("p", "part")).withColumn("part", F.trim("part"))
    skipped = F.lit(False)
    for prefix in skip:
        skipped = skipped | F.col("part").startswith(prefix)
    good = parts.filter((F.length("part") > min_length) & ~skipped)
    once = good.groupBy(cluster, "part").agg(F.min(F.struct("t", "p")).alias("at"))
    kept = top_per_group(once, [cluster], ["at"], sentences, rank="n")
    joined = kept.groupBy(cluster).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("n", "part"))), lambda s: s["part"]), ". ").alias("s"))
    summary = joined.select(cluster, shorten(F.concat("s", F.lit(".")), limit).alias("summary"))
    fallback = first.filter("t = 1").select(
        cluster, F.concat(F.substring(text, 1, 200), F.lit("...")).alias("opening"))
    return fallback.join(summary, cluster, "left").select(
        cluster, F.coalesce("summary", "opening").alias("summary"))


def cluster_terms(df: DataFrame, cluster: str, text: str, order: Sequence[str],
                  stop_words: Sequence[str], texts: int = 10, chars: int = 200, terms: int = 5
                  ) -> DataFrame:
    """Most frequent words and two-word phrases of a cluster's first texts (ties by name)."""
    first = top_per_group(df.select(cluster, text, *order), [cluster], order, texts)
    # The texts count as one: a phrase may span two of them.
    combined = first.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct(*order, F.substring(text, 1, chars).alias("__s")))), lambda r: r["__s"]), " ")
        .alias("s"))
    tokens = F.filter(F.regexp_extract_all(F.lower("s"), F.lit(r"([\p{L}\p{N}_]{2,})"), 1),
                      lambda w: ~w.isin(*stop_words))
    listed = combined.select(cluster, tokens.alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.size("w") + 1), lambda a, b: F.concat_ws(
        " ", a, F.when(b.isNotNull(), b)))
    bigrams = F.slice(pairs, 1, F.greatest(F.size("w") - 1, F.lit(0)))
    grams = listed.select(cluster, F.explode(F.concat("w", bigrams)).alias("term"))
    counts = grams.groupBy(cluster, "term").agg(F.count("*").alias("n"))
    return top_per_group(counts, [cluster], [F.desc("n"), "term"], terms, rank="rank")


def cluster_labels(df: DataFrame, cluster: str, text: str, entities: str, order: Sequence[str],
                   stop_words: Sequence[str], limit: int = 30, fallback: str = "General News"
                   ) -> DataFrame:
    """(cluster, label): the two most frequent entities, else three leading terms."""
    top2 = top_entities_by(df, entities, cluster, 2)
    named = top2.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", "entity"))), lambda r: r["entity"]), " & ").alias("by_entity"))
    terms = cluster_terms(df, cluster, text, order, stop_words)
    worded = terms.groupBy(cluster).agg(F.initcap(F.array_join(F.slice(F.array_sort(
        F.collect_list("term")), 1, 3), " ")).alias("by_term"))
    every = df.select(cluster).distinct()
    out = every.join(named, cluster, "left").join(worded, cluster, "left")
    label = F.trim(F.replace(F.coalesce("by_entity", "by_term", F.lit("")), F.lit("_"), F.lit(" ")))
    label = F.when(label == "", F.lit(fallback)).otherwise(shorten(label, limit))
    return out.select(cluster, label.alias("label"))


def _common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit operation per word of ``b``."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | (1 << i)
    row = 0
    for word in b:
        match = row | places.get(word, 0)
        row = match & ~(match - ((row << 1) | 1))
    return bin(row).count("1")


@F.pandas_udf(T.DoubleType())
def rouge_l(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    """ROUGE-L F1 of two texts (lower-case ASCII letters and digits, no stemming)."""
    import re

    split = re.compile(r"[a-z0-9]+").findall
    scores = []
    for ref, cand in zip(reference, candidate):
        a, b = split((ref or "").lower()), split((cand or "").lower())
        common = _common_length(a, b) if a and b else 0
        scores.append(2.0 * common / (len(a) + len(b)) if common else 0.0)
    return pd.Series(scores, dtype=float)
