"""Substring matching of many patterns against many texts as equi-joins.

A pattern without white space can only occur inside one word of the text, so the
substring test runs once per *distinct* word, not once per text: the vocabulary is cut
into four-character pieces, joined with the leading piece of each pattern and verified
with ``contains``. Texts then join on their words. Nothing is compared with everything,
and rows that travel hold a word, never the text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import lexicons as lx
from newsloom.operators.bounds import one_per_item, small_or_merge
from newsloom.session import materialize

GRAM = 4


def pieces(token: Column, sizes: Sequence[int] = (GRAM,)) -> Column:
    """Distinct substrings of the given lengths."""
    def of(size: int) -> Column:
        starts = F.when(F.length(token) >= size,
                        F.sequence(F.lit(1), F.length(token) - (size - 1)))
        return F.coalesce(F.transform(starts, lambda i: F.substr(token, i, F.lit(size))),
                          F.array().cast("array<string>"))

    out = of(sizes[0])
    for size in sizes[1:]:
        out = F.concat(out, of(size))
    return F.array_distinct(out)


def longest_part(pattern: Column) -> Column:
    """The longest white-space free part of a pattern (first one on ties)."""
    parts = F.split(pattern, lx.SPACES)
    longest = F.array_max(F.transform(parts, lambda p: F.length(p)))
    return F.get(F.filter(parts, lambda p: F.length(p) == longest), F.lit(0))


def match_substrings(docs: DataFrame, keys: Sequence[str], text: str, patterns: DataFrame,
                     pattern: str = "pattern", fold_case: bool = True) -> DataFrame:
    """Distinct (keys…, pattern) for which the text contains the pattern."""
    def fold(c: Column) -> Column:
        return F.lower(c) if fold_case else c

    tokens = one_per_item(docs, F.array_distinct(F.split(fold(F.col(text)), lx.SPACES)), "token",
                          keys).filter(F.col("token") != "")
    wanted = patterns.select(F.col(pattern).alias("pattern")).distinct().filter(
        F.trim("pattern") != "")
    wanted = wanted.withColumn("probe", longest_part(fold(F.trim("pattern"))))
    wanted = materialize(wanted.withColumn("piece", F.substring("probe", 1, GRAM)), "patterns")
    has_space = F.col("pattern").rlike(lx.SPACES)
    shortest, phrases_exist = wanted.agg(F.min(F.length("piece")),
                                         F.coalesce(F.bool_or(has_space), F.lit(False))).first()
    sizes = list(range(min(shortest or GRAM, GRAM), GRAM + 1))

    vocabulary = tokens.select("token").distinct()
    vocabulary = one_per_item(vocabulary, pieces(F.col("token"), sizes), "piece", ["token"])
    hits = vocabulary.join(small_or_merge(wanted), "piece").filter(
        F.contains("token", "probe")).select("token", "pattern").distinct()
    # Written once: its size decides whether the words of the texts have to move at all.
    hits = materialize(hits, "hits")
    pairs = tokens.join(small_or_merge(hits), "token").select(*keys, "pattern").distinct()
    if not phrases_exist:
        return pairs.withColumnRenamed("pattern", pattern)

    # A pattern of several words was only found by one of them: check the text itself.
    pairs = materialize(pairs, "pairs")
    whole = docs.select(*keys, fold(F.col(text)).alias("__text"))
    verified = whole.join(pairs.filter(has_space), list(keys)).filter(
        F.contains("__text", fold(F.col("pattern")))).drop("__text")
    return pairs.filter(~has_space).unionByName(verified).withColumnRenamed("pattern", pattern)
