"""Key figures and frequency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.normalize import headline_topic
from newsloom.operators.bounds import one_per_item
from newsloom.operators.entities import top_entities_by
from newsloom.operators.ranking import exact_median, top_per_group


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), F.lit(0.0))


def board_figures(df: DataFrame, ts: str, as_of: Column, recent_seconds: int = 300,
                  empty_lists_count: bool = False) -> DataFrame:
    """One row: total, recent, positive and negative with shares, rows with a place.

    ``empty_lists_count`` counts an empty list of places as a place.
    """
    located = F.col("locations").isNotNull()
    if not empty_lists_count:
        located = located & (F.size("locations") > 0)
    figures = df.agg(
        F.count("*").alias("total"),
        F.count_if((F.col(ts) >= as_of - F.make_dt_interval(secs=F.lit(recent_seconds)))
                   & (F.col(ts) <= as_of)).alias("recent"),
        F.count_if(F.col("sentiment") == "positive").alias("positive"),
        F.count_if(F.col("sentiment") == "negative").alias("negative"),
        F.count("sentiment").alias("rated"), F.count_if(located).alias("located"))
    return figures.withColumns({
        "positive_pct": percent(F.col("positive"), F.col("rated")),
        "negative_pct": percent(F.col("negative"), F.col("rated")),
        "located_pct": percent(F.col("located"), F.col("total"))})


def batch_figures(df: DataFrame, factual: float = 0.5, clickbait: float = 0.6) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.avg("sentiment_score").alias("avg_sentiment"),
                  F.count_if(F.col("factual_density") > factual).alias("factual"),
                  F.count_if(F.col("sensationalism_score") > clickbait).alias("clickbait"))


def active_streams(df: DataFrame, source: str, ts: str, as_of: Column, seconds: int = 300
                   ) -> DataFrame:
    since = as_of - F.make_dt_interval(secs=F.lit(seconds))
    return df.filter((F.col(ts) >= since) & (F.col(ts) <= as_of)).agg(
        F.countDistinct(source).alias("active_sources"))


def entity_coverage(df: DataFrame, items: str) -> DataFrame:
    return one_per_item(df, items, "e").agg(F.countDistinct("e").alias("entities"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def group_sizes_in_range(df: DataFrame, group: str, ts: str, start: Column, end: Column,
                         k: int = 20, **terms) -> DataFrame:
    """Rows and first time per group within [start, end], largest k groups.

    ``terms`` are column=value filters.
    """
    rows = df.filter(F.col(ts).between(start, end))
    for column, value in terms.items():
        rows = rows.filter(F.col(column) == value)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts")).orderBy(
        F.desc("n"), group).limit(k)


def latency_stats(df: DataFrame, level: str, value: str) -> DataFrame:
    """Count, mean, extremes, exact median and sample deviation (0 for one row) per level."""
    return exact_median(
        df.filter(F.col(level).isNotNull()), level, value, "median_ms",
        count=F.count("*"), avg_ms=F.avg(value), min_ms=F.min(value), max_ms=F.max(value),
        stdev_ms=F.coalesce(F.stddev_samp(value), F.lit(0.0)))


def latency_samples(df: DataFrame, level: str, value: str, order: Sequence[str], k: int = 100
                    ) -> DataFrame:
    return top_per_group(df.select(level, value, *order), [level], order, k, rank="rank")


def load_run_stats(df: DataFrame, run: str, ts: str, latency: str, failed: str) -> DataFrame:
    """Sent, failed, rate per minute, send latency and time span of each load run."""
    seconds = (F.unix_micros(F.max(ts).cast("timestamp"))
               - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6
    ok = ~F.col(failed)
    return df.groupBy(run).agg(
        F.count_if(ok).alias("total_sent"), F.count_if(F.col(failed)).alias("total_errors"),
        seconds.alias("duration_seconds"),
        (F.try_divide(F.count_if(ok).cast("double"), seconds) * 60.0).alias("actual_throughput"),
        F.coalesce(F.avg(F.when(ok, F.col(latency))), F.lit(0.0)).alias("avg_send_ms"),
        F.coalesce(F.max(F.when(ok, F.col(latency))), F.lit(0.0)).alias("max_send_ms"),
        F.min(ts).alias("start_time"), F.max(ts).alias("end_time"))


def daily_digest(df: DataFrame, ts: str, tie: str, as_of: Column, topics: int = 3,
                 newest: int = 12, headlines: int = 3) -> DataFrame:
    """Last 24 hours: article count, first distinct topics of the newest titles, headlines.

    With fewer than two articles the status is 'limited data' and the lists are empty.
    """
    recent = df.filter((F.col(ts) > as_of - F.make_dt_interval(hours=F.lit(24)))
                       & (F.col(ts) <= as_of)).select(tie, "title", ts)
    order = [F.col(ts).desc(), F.col(tie)]
    top = recent.filter(F.col("title").isNotNull()).orderBy(*order).limit(newest)
    listed = top.agg(F.array_sort(F.collect_list(F.struct(
        (-F.unix_micros(F.col(ts).cast("timestamp"))).alias("k"), F.col(tie).alias("t"), "title")))
        .alias("rows"))  # `newest` rows
    titles = F.transform("rows", lambda r: r["title"])
    total = recent.agg(F.count("*")).scalar()
    out = listed.withColumn("articles", total).withColumn("titles", titles)
    enough = F.col("articles") >= 2
    none = F.array().cast("array<string>")
    return out.select(
        "articles", F.when(enough, "ok").otherwise("limited data").alias("status"),
        F.when(enough, F.slice(F.array_distinct(F.transform("titles", headline_topic)), 1, topics))
        .otherwise(none).alias("topics"),
        F.when(enough, F.transform(F.slice("titles", 1, headlines),
                                   lambda t: F.substring(t, 1, 100)))
        .otherwise(none).alias("headlines"))


def cluster_breakdown(df: DataFrame, cluster: str, entities: str, ts: str, tie: str,
                      k_entities: int = 5, samples: int = 5) -> DataFrame:
    """Per cluster: size, mean sentiment, time span, common entities, newest titles."""
    base = df.groupBy(cluster).agg(
        F.count("*").alias("n"), F.avg("sentiment_score").alias("avg_sentiment"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    common = top_entities_by(df, entities, cluster, k_entities).groupBy(cluster).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))),
                    lambda r: r["entity"]).alias("common_entities"))
    newest = top_per_group(df.select(cluster, "title", ts, tie), [cluster],
                           [F.col(ts).desc(), F.col(tie)], samples, rank="r").groupBy(cluster).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))),
                    lambda r: r["title"]).alias("samples"))
    return base.join(common, cluster, "left").join(newest, cluster, "left")
