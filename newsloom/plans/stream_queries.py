"""Queries that run as streams over the tables and must equal their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import lexicons as lx
from newsloom.functions.text import title_keywords
from newsloom.operators.events import keyword_clusters
from newsloom.operators.timeseries import peaks
from newsloom.plans.catalog import query
from newsloom.plans.event_queries import CLUSTERS, EVENTS
from newsloom.plans.series_queries import SLIDING
from newsloom.plans.tables import KEPT, NEGATIVE, POSTS, STAMP, hits, rounded, stamp
from newsloom.plans.text_queries import RAW, TOKEN_BAD, TOKEN_GOOD, negation_sql, raw_news
from newsloom.session import scratch_path
from newsloom.sources import readers, sinks
from newsloom.streaming import jobs


def streamed(t, df, name):
    """A table's rows as a stream: written to a folder that a file stream reads."""
    path = scratch_path(t.spark, name)
    df.write.parquet(path)
    return readers.table_stream(t.spark, path, df.schema)


def events(t):
    return t("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("c1_dedup_stream", f"""WITH RECURSIVE {KEPT} SELECT user_id, {STAMP.format('ts')} AS ts
  FROM kept""")
def _(t):
    rows = events(t).select("user_id", "ts")
    out = jobs.drop_duplicates(streamed(t, rows, "c1-in"), "user_id", "ts", 3600)
    return jobs.run_available(out, "c1").select("user_id", stamp("ts").alias("ts"))


FINAL = "WHERE window_start + INTERVAL 60 SECOND <= (SELECT max(ts) FROM events)"


@query("i8_velocity_stream", f"""WITH {SLIDING} SELECT {STAMP.format('window_start')} AS window_start,
  event_type, n, velocity FROM h {FINAL}""")
def _(t):
    out = jobs.sliding_counts(streamed(t, events(t).select("event_type", "ts"), "i8-in"), "ts",
                              "event_type").drop("w")
    return jobs.run_available(out, "i8").withColumn("window_start", stamp("window_start"))


@query("i9_peaks_stream", f"""WITH {SLIDING}, k AS (SELECT *, row_number() OVER (PARTITION BY
    event_type ORDER BY velocity DESC, window_start) AS r FROM h {FINAL})
  SELECT event_type, velocity AS peak_velocity, {STAMP.format('window_start')} AS peak_time FROM k
  WHERE r = 1""")
def _(t):
    counts = jobs.sliding_counts(streamed(t, events(t).select("event_type", "ts"), "i9-in"), "ts",
                                 "event_type")
    emitted = jobs.run_available(jobs.running_peaks(counts, "event_type"), "i9")
    best = peaks(emitted.withColumnRenamed("grp", "event_type"), "event_type", "peak_time",
                 "peak_velocity")
    return best.withColumn("peak_time", stamp("peak_time"))


@query("f2_f3_keyword_stream", f"""WITH {CLUSTERS} SELECT 'event_' || cluster_key AS event_id, id,
  n AS article_count, CASE WHEN n = 3 THEN {STAMP.format('published_at')} ELSE
  {STAMP.format('first_ts')} END AS first_seen, n > 3 AS event_update FROM nth WHERE n >= 3""")
def _(t):
    clusters = keyword_clusters(t.articles, text=("title", "content")).select(
        "cluster_key", "id", F.col("ts").cast("timestamp").alias("ts"))
    out = jobs.run_available(jobs.keyword_events(streamed(t, clusters, "f2-in"), idle_seconds=None), "f2")
    return out.withColumn("first_seen", stamp("first_seen"))


@query("f1_semantic_stream")
def _(t):
    rows = t.vectors.select("id", F.col("ts").cast("timestamp").alias("ts"), "vector")
    path = scratch_path(t.spark, "f1")
    jobs.merged_events(streamed(t, rows, "f1-in"), path, 0.2, 3, 86_400.0, 64).awaitTermination()
    return jobs.event_names(t.spark, path)


@query("g1_match_posts_stream", f"""WITH {EVENTS}, {POSTS} SELECT post_id, event_id FROM posts JOIN ev
  ON post_ts >= event_ts AND post_ts < event_ts + INTERVAL 24 HOUR
  WHERE len(list_filter(kw, lambda k: contains(lower(text), k))) > 0""")
def _(t):
    posts = t.posts.select("post_id", "text", F.col("post_ts").cast("timestamp").alias("post_ts"))
    titles = t.articles.select(F.col("id").alias("event_id"), F.col("published_at").cast("timestamp")
                               .alias("event_ts"), title_keywords(F.col("title")).alias("keywords"))
    pairs = jobs.match_posts(streamed(t, posts, "g1-posts"), streamed(t, titles, "g1-events"))
    return jobs.run_available(pairs, "g1").select("post_id", "event_id")


@query("live_articles", f"""WITH {negation_sql(TOKEN_GOOD, TOKEN_BAD, lx.NEGATIONS)}, {RAW}
  SELECT raw.url, raw.title, raw.source, published_at, coalesce(label, 'neutral') AS sentiment,
    round(coalesce(score, 0)::DOUBLE, 6) AS sentiment_score
  FROM raw LEFT JOIN scored USING (doc_id) WHERE title <> '' AND {hits('text', NEGATIVE)} = 0""")
def _(t):
    """Every article comes twice, most of them half an hour later the second time."""
    path = scratch_path(t.spark, "live")
    raw = raw_news(t)
    again = raw.withColumns({
        "publishedAt": F.replace("publishedAt", F.lit("10:20:30"), F.lit("10:50:30")),
        "published_at": F.replace("published_at", F.lit("04:05:06"), F.lit("04:35:06"))})
    raw.write.parquet(f"{path}/in")
    again.write.mode("append").parquet(f"{path}/in")
    stream = readers.table_stream(t.spark, f"{path}/in", raw.schema)
    jobs.live_articles(stream, f"{path}/articles", f"{path}/checkpoint",
                       F.lit("2024-03-01 00:00:00").cast("timestamp"), lateness="90 days",
                       blocked_words=NEGATIVE, positive=TOKEN_GOOD, negative=TOKEN_BAD).awaitTermination()
    rows = t.spark.read.parquet(f"{path}/articles")
    return rows.select("url", "title", "source", stamp("published_at").alias("published_at"),
                       "sentiment", rounded(F.col("sentiment_score")).alias("sentiment_score"))


@query("l1_late_rows", """SELECT count(*) AS rows FROM events""")
def _(t):
    """Rows within the allowed lateness are all counted."""
    stream = streamed(t, events(t).select("event_type", "ts"), "l1-in")
    counts = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(
        F.count("*").alias("n"))
    out = jobs.run_updates(counts, "l1", ["window", "event_type"])
    return out.agg(F.sum("n").alias("rows"))


@query("l4_latency_rows", """SELECT event_id, CASE WHEN event_type <> 'error' THEN
  round(value * 1000, 3) END AS latency_ms FROM events""")
def _(t):
    sent = F.when(F.col("event_type") != "error", F.col("ts"))
    received = F.timestamp_micros((F.unix_micros("ts") + F.round(F.col("value") * 1_000_000))
                                  .cast("long"))
    rows = events(t).select("event_id", sent.alias("sent"), received.alias("at"))
    out = jobs.latency_rows(streamed(t, rows, "l4-in"), "sent", F.col("at"))
    return jobs.run_available(out, "l4").select(
        "event_id", rounded(F.col("latency_ms"), 3).alias("latency_ms"))


@query("l7_running_latency", """SELECT event_type, count(value) AS count, round(avg(value), 6) AS
  avg_ms, min(value) AS min_ms, max(value) AS max_ms FROM events GROUP BY 1""")
def _(t):
    stream = streamed(t, t("events").select("event_type", "value"), "l7-in")
    out = jobs.run_updates(jobs.running_latency(stream, "event_type", "value"), "l7",
                           ["event_type"])
    return out.withColumn("avg_ms", rounded(F.col("avg_ms")))


@query("l1_rows_too_late", """SELECT event_type, count(*) AS rows FROM events
  WHERE ts >= (SELECT min(ts)::DATE + 1 FROM events) GROUP BY event_type""")
def _(t):
    """The first day's rows arrive last, when the watermark is past their window, and are dropped."""
    rows = events(t).select("event_type", "ts")
    first = rows.withColumn("next", F.date_trunc("day", rows.agg(F.min("ts")).scalar())
                            + F.expr("INTERVAL 1 DAY"))
    path = scratch_path(t.spark, "l1-late")
    # One file for each micro-batch. A watermark drops rows from the second batch after its own on.
    turn = F.when(F.col("ts") < F.col("next"), 2).otherwise(F.pmod(F.xxhash64("ts"), F.lit(2)))
    for batch in range(3):
        first.filter(turn == batch).drop("next").coalesce(1).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    counts = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(
        F.count("*").alias("n"))
    out = jobs.run_updates(counts, "l1-late", ["window", "event_type"])
    return out.groupBy("event_type").agg(F.sum("n").alias("rows"))


@query("f4_l3_progress", """SELECT count(*) AS rows, count(*) AS reported,
  count(*) FILTER (lang = 'en') AS english FROM documents""")
def _(t):
    """Rows written by a checkpointed stream, and the counters that it reported."""
    stream = jobs.with_progress(streamed(t, t("documents").select("doc_id", "lang"), "f4-in"), "articles",
                                english=F.count_if(F.col("lang") == "en"))
    base = scratch_path(t.spark, "f4")
    query = sinks.file_sink(stream, f"{base}/out", f"{base}/checkpoint", "parquet")
    query.awaitTermination()
    told = jobs.progress_totals(query, "articles")
    return t.spark.read.schema("doc_id long").parquet(f"{base}/out").agg(
        F.count("*").alias("rows"), F.lit(told["rows"]).cast("long").alias("reported"),
        F.lit(told["english"]).cast("long").alias("english"))
