"""Sentiment operators that need more than one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import lexicons as lx
from newsloom.functions.text import vote
from newsloom.operators.bounds import broadcast_if_small


def neutral_share(df: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    """Share of neutral rows; a missing label counts as not neutral."""
    return df.agg(F.avg(F.coalesce(F.col(sentiment) == "neutral", F.lit(False)).cast("double"))
                  .alias("neutral_share"))


def rebalance(df: DataFrame, text: str, limit: float = 0.8,
              positive: Sequence[str] = lx.REBALANCE_POSITIVE,
              negative: Sequence[str] = lx.REBALANCE_NEGATIVE, weight: float = 0.4) -> DataFrame:
    """Rescore every row from a word list if more than ``limit`` of all rows are neutral."""
    tilted = neutral_share(df).select(F.col("neutral_share") > limit).scalar()
    again = df.withColumn("__flat", tilted).withColumn(
        "__vote", F.when(F.col("__flat"), vote(F.col(text), positive, negative, weight)))
    return again.withColumns({
        "sentiment": F.when(F.col("__flat"), F.col("__vote.label")).otherwise(F.col("sentiment")),
        "sentiment_score": F.when(F.col("__flat"), F.col("__vote.score")).otherwise(
            F.col("sentiment_score")),
    }).drop("__flat", "__vote")


def compound_score(df: DataFrame, key: str, text: str, valence: DataFrame,
                   alpha: float = 15.0) -> DataFrame:
    """(key, compound): summed word valences s as s / sqrt(s² + alpha); 0 without any.

    Sums are formed per text before the shuffle; the outer explode and join keep texts
    without a known word.
    """
    tokens = df.select(key, F.explode_outer(F.split(F.lower(text), lx.SPACES)).alias("word"))
    tokens = tokens.withColumn("word", F.trim(F.col("word"), F.lit(lx.KEYWORD_STRIP_CHARS)))
    scored = tokens.join(broadcast_if_small(valence.select("word", "valence")), "word", "left")
    total = scored.groupBy(key).agg(F.coalesce(F.sum("valence"), F.lit(0.0)).alias("s"))
    return total.select(key, (F.col("s") / F.sqrt(F.col("s") * F.col("s") + alpha))
                        .alias("compound"))
