"""Ranked lists shown on boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.normalize import (clean_for_display, display_location, first_filled,
                                          preview, title_key)
from newsloom.functions.text import hype_score, overlap_size, quadrant
from newsloom.operators.entities import top_entities_by
from newsloom.operators.events import event_badge
from newsloom.operators.ranking import newest_first, top_per_group



def newest(df: DataFrame, ts: str, key: str, k: int) -> DataFrame:
    """The k newest rows, newest first; ``key`` identifies a row and breaks ties.

    The first pass reads two columns. Everything else is then computed only for the rows
    picked. Rows without a time come last; a null key is a key like any other.
    """
    order = [F.col(ts).desc(), F.col(key)]
    top = df.select(F.col(ts).alias("__ts"), F.col(key).alias("__key")).orderBy(
        F.col("__ts").desc(), "__key").limit(k)
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col(ts).eqNullSafe(F.col("__ts"))
    picked = df.join(F.broadcast(top), same, "left_semi")  # k rows
    return picked.orderBy(*order).limit(k)


def live_feed(df: DataFrame, ts: str, tie: str, k: int = 20) -> DataFrame:
    """Newest rows as cards. The rows are picked first; only k texts are cleaned."""
    top = newest(df, ts, tie, k)
    mood = (F.when(F.col("sentiment") == "positive", "positive")
            .when(F.col("sentiment") == "negative", "negative").otherwise("neutral"))
    return top.select(
        tie, ts, mood.alias("mood"), event_badge(F.col("entities")).alias("badge"),
        preview(clean_for_display(first_filled(F.col("content"), F.col("title"))), 80)
        .alias("preview"),
        F.array_join(F.slice(F.col("entities"), 1, 5), ", ").alias("first_entities"))


def _headlines(df: DataFrame, mood: str, ts: str, tie: str, k: int, minimum: int,
               default_place: str) -> DataFrame:
    rows = df.filter(F.col("sentiment") == mood).select(
        title_key(F.col("title")).alias("k"), F.struct(tie, "title", "locations").alias("row"),
        newest_first(F.col(ts), F.col(tie)).alias("at"))
    # One row per headline, combined before the shuffle; the total is the sum of its counts.
    once = rows.groupBy("k").agg(F.min_by("row", "at").alias("row"), F.min("at").alias("at"),
                                 F.count("*").alias("n"))
    total = once.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    top = once.orderBy("at").limit(k).select("row.*")
    return top.withColumn("articles", total).filter(F.col("articles") >= minimum).select(
        tie, display_location(F.col("locations"), default_place).alias("place"),
        clean_for_display(F.col("title")).alias("title"), "articles")


def breaking(df: DataFrame, ts: str, tie: str, k: int = 5, minimum: int = 2,
             default_place: str = "India") -> DataFrame:
    """Newest distinct negative headlines, if there are at least ``minimum`` articles."""
    return _headlines(df, "negative", ts, tie, k, minimum, default_place)


def trending(df: DataFrame, ts: str, tie: str, k: int = 5, minimum: int = 2,
             default_place: str = "India") -> DataFrame:
    return _headlines(df, "positive", ts, tie, k, minimum, default_place)


def with_relevance(df: DataFrame, cluster: str, entities: str, top: int = 10) -> DataFrame:
    """Adds ``relevance`` = 10 per entity among the cluster's most frequent + confidence."""
    lists = top_entities_by(df, entities, cluster, top).groupBy(cluster).agg(
        F.collect_list("entity").alias("__top"))  # `top` names per cluster
    ranked = df.join(lists, cluster, "left")
    overlap = F.coalesce(overlap_size(F.col(entities), F.col("__top")), F.lit(0))
    overlap = F.when(overlap < 0, 0).otherwise(overlap)
    return ranked.withColumn("relevance", overlap * 10 + F.coalesce("confidence", F.lit(0.0))
                             ).drop("__top")


def cluster_leads(df: DataFrame, cluster: str, entities: str, tie: str, per_cluster: int = 3,
                  clusters: int = 20) -> DataFrame:
    """Most relevant distinct titles of the largest clusters."""
    largest = df.groupBy(cluster).agg(F.count("*").alias("size")).filter(
        F.col(cluster).cast("string") != "-1").orderBy(F.desc("size"), cluster).limit(clusters)
    kept = df.select(cluster, entities, "confidence", "title", tie).join(
        F.broadcast(largest), cluster)  # `clusters` rows
    scored = with_relevance(kept, cluster, entities)
    best = top_per_group(scored, [cluster, "title"], [F.col("relevance").desc(), F.col(tie)], 1)
    return top_per_group(best, [cluster], [F.col("relevance").desc(), F.col(tie)], per_cluster,
                         rank="rank").select(cluster, "size", "rank", tie, "title", "relevance")


def hype_table(df: DataFrame, key: str, entities: str, x_cut: float = 2.0, y_cut: float = 5.0,
               content_chars: int | None = None, **lexicons) -> DataFrame:
    """Hype figures per article from its title and content.

    ``content_chars`` scores only what a card shows of the content.
    """
    content = F.col("content") if content_chars is None else preview(F.col("content"),
                                                                     content_chars)
    shown = F.concat_ws(" ", "title", content)
    scored = df.select(key, "title", hype_score(shown, F.col(entities), **lexicons).alias("h"))
    return scored.select(key, preview(F.col("title"), 60).alias("title"), "h.hype",
                         "h.sensationalism", "h.density").withColumn(
        "zone", quadrant(F.col("density"), F.col("sensationalism"), x_cut, y_cut))


def top_by(df: DataFrame, score: str, tie: str | Column, k: int) -> DataFrame:
    return df.orderBy(F.col(score).desc(), tie).limit(k)
