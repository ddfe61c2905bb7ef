"""Queries for sources and sinks: what is written must read back as the tables say."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators import metrics, timeseries
from newsloom.plans.catalog import query
from newsloom.plans.series_queries import SLIDING, history
from newsloom.plans.tables import ART, STAMP, rounded, stamp
from newsloom.session import scratch_path
from newsloom.sources import readers, sinks
from newsloom.streaming import jobs

EVENT_JSON = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType())])
PROPS = T.StructType([T.StructField("k", T.LongType())])


def joined(col, sep=","):
    return F.array_join(col, sep)


def event_lines(t):
    """Events as JSON text; refunds of the 'error' type are cut short and do not parse."""
    lines = sinks.encode_json(t("events").select("event_id", "event_type", "value"))
    return lines.withColumn("value", F.when(
        F.col("value").contains('"error"'), F.substr("value", F.lit(1), F.length("value") - 1))
        .otherwise(F.col("value")))


def landed_lines(t, name):
    path = scratch_path(t.spark, name)
    event_lines(t).write.text(path)
    return path


PARSED = "SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'"


@query("a1_topic_scan", PARSED)
def _(t):
    stream = readers.text_stream(t.spark, landed_lines(t, "topic"))
    return jobs.run_available(readers.decoded_rows(stream, EVENT_JSON), "a1")


@query("a2_topic_sink", "SELECT event_id, event_type, value FROM events")
def _(t):
    spark, base = t.spark, scratch_path(t.spark, "topic-sink")
    source = spark.readStream.schema(t("events").schema).parquet(f"{t.folder}/events*.parquet")
    sinks.file_sink(source.select("event_id", "event_type", "value"), f"{base}/out",
                    f"{base}/checkpoint").awaitTermination()
    return readers.decoded_rows(spark.read.text(f"{base}/out"), EVENT_JSON)


@query("a3_json_decode", """SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events""")
def _(t):
    rows = t("events").select("event_id", F.col("props").alias("value"))
    return readers.decode_json(rows, PROPS).select("event_id", "record.k")


@query("a3_json_corrupt", """SELECT count(*) FILTER (event_type = 'error') AS corrupt,
  count(*) FILTER (event_type <> 'error') AS parsed FROM events""")
def _(t):
    return readers.decode_json(event_lines(t), EVENT_JSON).agg(
        F.count("_corrupt").alias("corrupt"),
        F.count_if(F.col("record").isNotNull()).alias("parsed"))


@query("a3_json_encode", """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' ||
  event_type || '"}' AS value FROM events""")
def _(t):
    rows = t("events").select("event_id", "event_type")
    return rows.select("event_id", F.to_json(F.struct(*rows.columns)).alias("value"))


@query("a4_json_lines", PARSED)
def _(t):
    return readers.read_json_lines(t.spark, landed_lines(t, "lines"), EVENT_JSON)


@query("a5_json_array", "SELECT doc_id AS id, source, n_chars::DOUBLE AS n_chars FROM documents")
def _(t):
    rows = t("documents").select(F.col("doc_id").alias("id"), "source",
                                 F.col("n_chars").cast("string").alias("n_chars"))
    # One array of a few hundred records per file; each array repeats its first record.
    packed = rows.groupBy(F.floor(F.col("id") / 250).alias("part")).agg(
        F.collect_list(F.struct("id", "source", "n_chars")).alias("r"))
    text = packed.select(F.to_json(F.concat("r", F.slice("r", 1, 1))).alias("value"), "part")
    path = scratch_path(t.spark, "arrays")
    text.write.partitionBy("part").text(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.StringType())])
    out = readers.read_json_array(t.spark, f"{path}/*", schema)
    return out.withColumn("n_chars", F.col("n_chars").cast("double"))


@query("a6_csv_scan", f"""WITH {ART} SELECT id, array_to_string(entities, '|') AS entities,
  array_to_string(locations, '|') AS locations, {STAMP.format('published_at')} AS timestamp,
  (len(entities) >= 3)::INT AS matched_event FROM art""")
def _(t):
    path = scratch_path(t.spark, "csv")
    t.articles.select("id", joined("entities", ", ").alias("entities"),
                      joined("locations", ", ").alias("locations"),
                      stamp("published_at").alias("timestamp")).write.csv(path, header=True)
    schema = T.StructType([T.StructField("id", T.LongType()),
                           *[T.StructField(c, T.StringType())
                             for c in ("entities", "locations", "timestamp")]])
    out = readers.read_csv_articles(t.spark, path, schema)
    return out.withColumns({"entities": joined("entities", "|"),
                            "locations": joined("locations", "|"),
                            "timestamp": stamp("timestamp")})


@query("a7_newest_rows", f"""SELECT event_id, {STAMP.format('ts')} AS ts, event_type FROM events
  ORDER BY events.ts DESC, event_id LIMIT 2000""")
def _(t):
    out = readers.newest_rows(t("events").select("event_id", "ts", "event_type"), "ts", "event_id",
                              2000)
    return out.withColumn("ts", stamp("ts"))


@query("a8_full_scan", "SELECT vec_id, label FROM embeddings")
def _(t):
    return readers.full_scan(t("embeddings"), ["embedding"])


@query("a9_row_count", "SELECT count(*) AS count FROM lineitem")
def _(t):
    return readers.row_count(t("lineitem"))


@query("a10_upsert", """SELECT o_custkey AS id, o_orderkey AS orderkey FROM (SELECT *, row_number()
  OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
  WHERE rn = 1""")
def _(t):
    """Orders arrive in three batches, out of order; the table keeps each customer's latest."""
    spark, base = t.spark, scratch_path(t.spark, "upsert-table")
    orders = t("orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("orderkey"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
        F.year("o_orderdate").alias("year"))
    orders.withColumn("arrival", F.col("year") % 3).write.partitionBy("arrival").parquet(
        f"{base}/in")
    for arrival in (0, 1, 2):
        stream = spark.readStream.schema(orders.schema).parquet(f"{base}/in/arrival={arrival}")
        sinks.upsert_stream(stream, f"{base}/table", f"{base}/checkpoint-{arrival}", "id",
                            ["at", "orderkey"], "year").awaitTermination()
    return spark.read.parquet(f"{base}/table").select("id", "orderkey")


@query("a12_export_json", "SELECT doc_id, source, n_chars FROM documents")
def _(t):
    path = scratch_path(t.spark, "export-json")
    rows = t("documents").select("doc_id", "source", "n_chars")
    sinks.export_json(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@query("a12_export_csv", """SELECT vec_id, label, len(embedding) AS dims FROM embeddings""")
def _(t):
    path = scratch_path(t.spark, "export-csv")
    sinks.export_csv(t("embeddings"), path)
    out = t.spark.read.csv(path, header=True, escape='"',
                           schema="vec_id long, embedding string, label int")
    vector = F.from_json("embedding", "array<float>")
    return out.select("vec_id", "label", F.size(vector).cast("long").alias("dims"))


@query("a13_append_lines", """SELECT event_type, count(*) AS n FROM events GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "append")
    rows = t("events").select("event_id", "event_type", "value")
    sinks.append_json_lines(rows.filter("value < 10"), path)
    sinks.append_json_lines(rows.filter("value >= 10 OR value IS NULL"), path)
    return readers.read_json_lines(t.spark, path, EVENT_JSON).groupBy("event_type").agg(
        F.count("*").alias("n"))


@query("a14_metrics_sink", f"""SELECT event_id::VARCHAR AS article_id, (user_id % 3)::INT AS
  throughput_level, round(value * 1000, 3) AS latency_ms FROM events""")
def _(t):
    path = scratch_path(t.spark, "metrics")
    sent = F.col("ts").cast("timestamp")
    received = F.timestamp_micros((F.unix_micros(sent) + F.round(F.col("value") * 1_000_000)
                                   ).cast("long"))
    rows = t("events").select(
        received.alias("timestamp"), sent.alias("kafka_timestamp"),
        received.alias("elasticsearch_timestamp"),
        ((F.unix_micros(received) - F.unix_micros(sent)) / 1000.0).alias("latency_ms"),
        (F.col("user_id") % 3).cast("int").alias("throughput_level"),
        F.col("event_id").cast("string").alias("article_id"))
    sinks.append_metrics(rows, path)
    return t.spark.read.schema(rows.schema).parquet(path).select(
        "article_id", "throughput_level", rounded(F.col("latency_ms"), 3).alias("latency_ms"))


@query("a15_latency_report", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type
    ORDER BY event_id) AS k FROM events),
  s AS (SELECT event_type, string_agg(round(value, 2)::VARCHAR, ',' ORDER BY k) AS samples FROM r
    WHERE k <= 100 GROUP BY 1)
  SELECT event_type, count(*) AS count, round(median(value), 6) AS median_ms,
    any_value(samples) AS samples FROM events JOIN s USING (event_type) GROUP BY 1""")
def _(t):
    stats = metrics.latency_stats(t("events"), "event_type", "value")
    samples = metrics.latency_samples(t("events"), "event_type", "value", ["event_id"])
    out = sinks.latency_report(stats, samples, "event_type", "value")
    text = F.transform("samples", lambda v: F.round(v, 2).cast("string"))
    return out.select("event_type", "count", rounded(F.col("median_ms")).alias("median_ms"),
                      joined(text).alias("samples"))


@query("a15_velocity_report", f"""WITH {SLIDING},
  s AS (SELECT event_type, count(*) AS points, sum(velocity) AS total FROM h GROUP BY 1) SELECT event_type, peak_velocity, points, total FROM p JOIN s USING (event_type)""")
def _(t):
    h = history(t)
    peak = timeseries.peaks(h, "event_type", "window_start", "velocity")
    out = sinks.velocity_report(peak, h, "event_type", "window_start", "velocity")
    return out.select("event_type", "peak_velocity",
                      F.size("velocity_history").cast("long").alias("points"),
                      F.aggregate("velocity_history", F.lit(0.0),
                                  lambda a, x: a + x["velocity"]).alias("total"))


@query("a16_union_feeds", """SELECT 'doc' AS feed, doc_id AS id, length(text) AS chars, lang, NULL
    AS url FROM documents UNION ALL SELECT 'page', page_id, length(html), NULL, url FROM pages
  UNION ALL SELECT 'item', item_id, length(text), NULL, NULL FROM benchmark""")
def _(t):
    docs = t("documents").select(F.lit("doc").alias("feed"), F.col("doc_id").alias("id"),
                                 F.length("text").cast("long").alias("chars"), "lang")
    pages = t("pages").select(F.lit("page").alias("feed"), F.col("page_id").alias("id"),
                              F.length("html").cast("long").alias("chars"), "url")
    items = t("benchmark").select(F.lit("item").alias("feed"), F.col("item_id").alias("id"),
                                  F.length("text").cast("long").alias("chars"))
    return readers.union_feeds(docs, pages, items)
