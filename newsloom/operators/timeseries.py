"""Counts over time, velocity, peaks, lifecycle stages.

Windows here run over one row per bucket, after an aggregation that was combined before
its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.operators.ranking import running_rank, running_sum
from newsloom.session import materialize

STEP = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY"}


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def filled_counts(df: DataFrame, ts: str, unit: str = "day", by: Sequence[str] = (),
                  **aggregates: Column) -> DataFrame:
    """Rows per bucket from the group's first to its last bucket, 0 where none fell."""
    counts = df.withColumn("bucket", F.date_trunc(unit, F.col(ts))).groupBy(*by, "bucket").agg(
        F.count("*").alias("n"), *[c.alias(name) for name, c in aggregates.items()])
    span = counts.groupBy(*by).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    steps = span.select(*by, F.explode(F.sequence("lo", "hi", F.expr(STEP[unit]))).alias("bucket"))
    return steps.join(counts, [*by, "bucket"], "left").fillna(0, ["n"])


def velocity(series: DataFrame, by: Sequence[str] = (), bucket: str = "bucket", n: str = "n"
             ) -> DataFrame:
    """Adds first and second differences of the counts, 0 in the first row."""
    w = W.partitionBy(*by).orderBy(bucket)
    out = series.withColumn("velocity", F.coalesce(F.col(n) - F.lag(n).over(w), F.lit(0)))
    return out.withColumn("acceleration", F.coalesce(
        F.col("velocity") - F.lag("velocity").over(w), F.lit(0)))


def stage(v: Column) -> Column:
    return (F.when(v > 0, "Birth/Growth").when(v == 0, "Stable/Maturity").otherwise("Decline"))


def lifecycle(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = velocity(series, by)
    return out.withColumn("stage", stage(F.col("velocity")))


def recent_lifecycle(df: DataFrame, ts: str, days: int = 7, switch_hours: float = 48.0
                     ) -> DataFrame:
    """Counts, mean sentiment and entity totals of the last days before the newest row.

    Buckets are days if the rows span more than ``switch_hours``, else hours. The rows are
    read once for their newest time and once to be summed by hour; the few hourly sums are
    written, and days are made from them if that is the unit.
    """
    latest = df.agg(F.max(ts)).scalar()
    recent = df.withColumn("__latest", latest).filter(
        F.col(ts) >= F.col("__latest") - F.make_dt_interval(days=F.lit(days)))
    hours = materialize(recent.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour")).agg(
        F.count("*").alias("n"), F.sum("sentiment_score").alias("s"),
        F.count("sentiment_score").alias("rated"), F.sum("entity_count").alias("e"),
        F.min(ts).alias("lo"), F.max(ts).alias("hi")), "hours")
    daily = hours.agg(_seconds(F.max("hi"), F.min("lo")) / 3600.0 > switch_hours).scalar()
    unit = hours.withColumn("__daily", daily).withColumn("bucket", F.when(
        F.col("__daily"), F.date_trunc("day", F.col("hour"))).otherwise(F.col("hour")))
    counts = unit.groupBy("__daily", "bucket").agg(
        F.sum("n").alias("post_count"),
        F.try_divide(F.sum("s"), F.sum("rated")).alias("avg_sentiment"),
        F.sum("e").alias("total_entities"))
    span = counts.groupBy("__daily").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    steps = span.select(F.explode(F.when(
        F.col("__daily"), F.sequence("lo", "hi", F.expr(STEP["day"]))).otherwise(
        F.sequence("lo", "hi", F.expr(STEP["hour"])))).alias("bucket"))
    filled = steps.join(counts.drop("__daily"), "bucket", "left").fillna(
        0, ["post_count", "total_entities"])
    out = velocity(filled, (), "bucket", "post_count")
    return out.withColumn("stage", stage(F.col("velocity")))


def spread_evenly(df: DataFrame, ts: str, tie: str, days: int = 7, within_seconds: float = 60.0
                  ) -> DataFrame:
    """If all rows fall within ``within_seconds``, space them evenly over ``days``.

    The figures that decide are read first; rows that lie far enough apart are returned as they are,
    without a rank. Rows without a time count as the earliest if the others are close.
    """
    found = df.agg(F.count("*").alias("n"), F.min(ts).alias("first"),
                   (_seconds(F.max(ts), F.min(ts)) < within_seconds).alias("dense"))
    if not found.first()["dense"]:
        return df
    ranked = running_rank(df, [], ts, [tie], "__rank")
    steps = F.greatest(found.select("n").scalar() - 1, F.lit(1)).cast("double")
    share = (F.col("__rank") - 1).cast("double") / steps
    moved = found.select("first").scalar() + F.make_dt_interval(secs=F.round(
        share * (days * 86_400.0), 6).cast("decimal(18,6)"))
    return ranked.withColumn(ts, moved).drop("__rank")


def sliding_velocity(df: DataFrame, ts: str, group: str, window: int = 60, poll: int = 5
                     ) -> DataFrame:
    """(window_start, group, n, velocity per minute) for windows of ``window`` seconds each
    ``poll`` seconds.

    Rows are first counted in buckets of ``poll`` seconds; only the counts are copied to the
    window/poll windows that contain them.
    """
    if window % poll:
        raise ValueError("the window must be a multiple of the poll interval")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    buckets = df.select(F.col(group), F.floor(micros / F.lit(poll * 1_000_000)).cast("long")
                        .alias("b")).groupBy(group, "b").agg(F.count("*").alias("c"))
    starts = F.sequence(F.col("b") - (window // poll - 1), F.col("b"))
    spread = buckets.select(group, "c", F.explode(starts).alias("s"))
    sums = spread.groupBy(group, "s").agg(F.sum("c").alias("n"))
    return sums.select(
        F.timestamp_seconds(F.col("s") * poll).alias("window_start"), group, "n",
        (F.col("n") * 60.0 / window).alias("velocity"))


def alert_status(v: Column, threshold: float = 50.0) -> Column:
    return (F.when(v >= threshold, "ALERT").when(v >= threshold * 0.5, "ELEVATED")
            .otherwise("NORMAL"))


def peaks(history: DataFrame, group: str, ts: str, value: str) -> DataFrame:
    """Largest value per group and the first time it was reached."""
    best = history.groupBy(group).agg(F.max_by(
        F.struct(F.col(value).alias("v"), F.col(ts).alias("t")),
        F.struct(F.col(value), -F.unix_micros(F.col(ts).cast("timestamp")))).alias("p"))
    return best.select(group, F.col("p.v").alias("peak_velocity"), F.col("p.t").alias("peak_time"))


def detection_lag(peak: DataFrame, items: DataFrame, group: str, ts: str) -> DataFrame:
    """Peaks with the first item's time and the seconds between them."""
    first = items.groupBy(group).agg(F.min(ts).cast("timestamp").alias("first_time"))
    return peak.join(first, group, "left").withColumn(
        "lag_seconds", _seconds(F.col("peak_time"), F.col("first_time")))


def cumulative_docs(history: DataFrame, group: str, ts: str, value: str, window: int = 60
                    ) -> DataFrame:
    """Adds the running sum of velocity times window length in minutes."""
    per_step = history.withColumn("__docs", F.col(value) * (window / 60.0))
    return running_sum(per_step, [group], ts, "__docs", "cumulative").drop("__docs")


def minutes_since_start(history: DataFrame, group: str, ts: str) -> DataFrame:
    start = history.groupBy(group).agg(F.min(ts).alias("__start"))
    return history.join(start, group).withColumn(
        "minutes", _seconds(F.col(ts), F.col("__start")) / 60.0).drop("__start")


def peak_position(curve: DataFrame, peak: DataFrame, group: str, ts: str) -> DataFrame:
    """Point of each curve nearest in time to the group's peak (the earlier on ties)."""
    gap = F.abs(_seconds(F.col(ts), F.col("peak_time")))
    near = curve.join(peak, group).groupBy(group).agg(F.min_by(
        F.struct(F.col(ts).alias("t"), F.col("cumulative").alias("c")),
        F.struct(gap, F.col(ts))).alias("p"))
    return near.select(group, F.col("p.t").alias("peak_bucket"), F.col("p.c").alias("peak_docs"))


def rolling_mean(series: DataFrame, by: Sequence[str] = (), bucket: str = "bucket", n: str = "n",
                 size: int = 3) -> DataFrame:
    """Mean of this and the previous buckets; null until there are ``size`` of them."""
    w = W.partitionBy(*by).orderBy(bucket).rowsBetween(1 - size, 0)
    return series.withColumn("rolling", F.when(F.count(n).over(w) == size, F.avg(n).over(w)))


def hour_profile(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
