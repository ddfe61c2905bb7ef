"""Queries for key figures, places and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import geo, metrics, timeseries
from newsloom.operators import entities as en
from newsloom.operators.bounds import broadcast_if_small
from newsloom.plans.catalog import query
from newsloom.plans.tables import ART, PLACES_SQL, STAMP, rounded, stamp

AS_OF = "2024-01-04 12:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


def joined(col, sep=","):
    return F.array_join(col, sep)


# --- key figures -----------------------------------------------------------------------

@query("h1_board_figures", f"""WITH {ART} SELECT count(*) AS total, count(*) FILTER (published_at >=
    {AS_OF_SQL} - INTERVAL 5 MINUTE AND published_at <= {AS_OF_SQL}) AS recent,
    count(*) FILTER (sentiment = 'positive') AS positive,
  count(*) FILTER (sentiment = 'negative') AS negative, count(sentiment) AS rated,
  count(*) FILTER (len(locations) > 0) AS located,
  round(count(*) FILTER (sentiment = 'positive') * 100.0::DOUBLE / count(sentiment), 6)
    AS positive_pct,
  round(count(*) FILTER (sentiment = 'negative') * 100.0::DOUBLE / count(sentiment), 6)
    AS negative_pct,
  round(count(*) FILTER (len(locations) > 0) * 100.0::DOUBLE / count(*), 6) AS located_pct
  FROM art""")
def _(t):
    out = metrics.board_figures(t.articles, "published_at", moment(AS_OF))
    return out.withColumns({c: rounded(F.col(c)) for c in out.columns if c.endswith("_pct")})


@query("h2_batch_figures", """SELECT count(*) AS total, round(avg(l_quantity - 25)::DOUBLE, 6)
    AS avg_sentiment, count(*) FILTER (l_discount > 0.05) AS factual,
  count(*) FILTER (l_tax > 0.04) AS clickbait FROM lineitem""")
def _(t):
    rows = t("lineitem").select((F.col("l_quantity") - 25).alias("sentiment_score"),
                                F.col("l_discount").alias("factual_density"),
                                F.col("l_tax").alias("sensationalism_score"))
    return metrics.batch_figures(rows, 0.05, 0.04).withColumn(
        "avg_sentiment", rounded(F.col("avg_sentiment")))


@query("h3_active_streams", f"""SELECT count(DISTINCT user_id) AS active_sources FROM events
  WHERE ts >= {AS_OF_SQL} - INTERVAL 6 HOUR AND ts <= {AS_OF_SQL}""")
def _(t):
    return metrics.active_streams(t("events"), "user_id", "ts", moment(AS_OF), 6 * 3600)


@query("h3_entity_coverage", f"""WITH {ART} SELECT count(DISTINCT e) AS entities FROM (
  SELECT unnest(entities) AS e FROM art)""")
def _(t):
    return metrics.entity_coverage(t.articles, "entities")


@query("h3_sentiment_distribution", f"""WITH {ART} SELECT sentiment, count(*) AS n FROM art
  GROUP BY 1""")
def _(t):
    return metrics.distribution(t.articles, "sentiment")


@query("h4_top_entities", f"""WITH {ART} SELECT entity, count(*) AS mentions FROM (
  SELECT unnest(entities) AS entity FROM art) GROUP BY 1 ORDER BY mentions DESC, entity LIMIT 20""")
def _(t):
    return en.top_entities(t.articles, "entities", 20)


@query("h4_top_entities_by_source", f"""WITH {ART}, c AS (SELECT source, entity, count(*) AS mentions
    FROM (SELECT source, unnest(entities) AS entity FROM art) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mentions DESC, entity) AS rank
    FROM c) SELECT source, entity, mentions, rank::INT AS rank FROM r WHERE rank <= 5""")
def _(t):
    return en.top_entities_by(t.articles, "entities", "source", 5)


@query("h5_top_locations", f"""WITH {PLACES_SQL} SELECT location, mentions FROM places
  ORDER BY mentions DESC, location LIMIT 20""")
def _(t):
    return t.places.orderBy(F.desc("mentions"), "location").limit(20)


# The nations as place names, each with its region for a country; every third has no coordinates.
COUNTRIES = """countries AS (SELECT DISTINCT array_to_string(list_transform(string_split(
    lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS location, r_name AS country
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
COORDS = """coords AS (SELECT array_to_string(list_transform(string_split(lower(n_name), ' '),
    lambda w: upper(w[1]) || w[2:]), ' ') AS location, n_nationkey * 2.5::DOUBLE - 30 AS lat,
    n_nationkey * 5::DOUBLE - 60 AS lon FROM nation WHERE n_nationkey % 3 <> 0)"""


def spelled(t):
    return t("nation").withColumn("location", F.initcap(F.lower("n_name")))


def countries(t):
    return spelled(t).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")
                           ).select("location", F.col("r_name").alias("country"))  # some regions


def coords(t):
    key = F.col("n_nationkey").cast("double")
    return spelled(t).filter("n_nationkey % 3 <> 0").select(
        "location", (key * 2.5 - 30).alias("lat"), (key * 5 - 60).alias("lon"))


@query("g3_country_lookup", f"""WITH {PLACES_SQL}, {COUNTRIES} SELECT location, country FROM places
  JOIN countries USING (location)""")
def _(t):
    return t.places.join(broadcast_if_small(countries(t)), "location").select("location", "country")


@query("g4_map_markers", f"""WITH {PLACES_SQL}, {COORDS} SELECT location, mentions, lat, lon,
  round(least(mentions / 2.0::DOUBLE, 20), 6) AS radius FROM places JOIN coords USING (location)""")
def _(t):
    out = geo.map_markers(t.places, coords(t))
    return out.withColumn("radius", rounded(F.col("radius")))


@query("g4_map_markers_default", f"""WITH {PLACES_SQL}, {COORDS} SELECT location, mentions,
  coalesce(lat, 28.6139::DOUBLE) AS lat, coalesce(lon, 77.209::DOUBLE) AS lon,
  least(mentions::DOUBLE, 30) AS radius FROM places LEFT JOIN coords USING (location)""")
def _(t):
    return geo.map_markers(t.places, coords(t), 1.0, 30.0, (28.6139, 77.2090))


@query("h6_country_totals", f"""WITH {PLACES_SQL}, {COUNTRIES} SELECT country,
  sum(mentions)::BIGINT AS mentions FROM places JOIN countries USING (location) GROUP BY 1""")
def _(t):
    return geo.country_totals(t.places, countries(t))


@query("h6_region_totals", """SELECT r_name AS country, count(*) AS mentions FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def _(t):
    counts = t("customer").groupBy(F.col("c_nationkey").alias("location")).agg(
        F.count("*").alias("mentions"))
    alias = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("location"), F.col("r_name").alias("country"))
    return geo.country_totals(counts, alias)


@query("h7_source_distribution", """SELECT source, count(*) AS n FROM documents GROUP BY 1""")
def _(t):
    return metrics.distribution(t("documents"), "source")


RANGE = ("2024-01-03 00:00:00", "2024-01-10 00:00:00")


@query("h8_groups_in_range", f"""SELECT event_type, count(*) AS n,
    {STAMP.format('min(ts)')} AS first_ts FROM events WHERE ts BETWEEN TIMESTAMP '{RANGE[0]}' AND
    TIMESTAMP '{RANGE[1]}' GROUP BY 1 ORDER BY n DESC, event_type LIMIT 20""")
def _(t):
    lo, hi = [moment(x) for x in RANGE]
    return metrics.group_sizes_in_range(t("events"), "event_type", "ts", lo, hi).withColumn(
        "first_ts", stamp("first_ts"))


@query("h8_one_group", f"""SELECT user_id, count(*) AS n, {STAMP.format('min(ts)')} AS first_ts
  FROM events WHERE ts BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'
  AND event_type = 'click' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20""")
def _(t):
    lo, hi = [moment(x) for x in RANGE]
    return metrics.group_sizes_in_range(t("events"), "user_id", "ts", lo, hi, event_type="click"
                                        ).withColumn("first_ts", stamp("first_ts"))


@query("h9_latency_stats", """SELECT event_type, count(*) AS count, round(avg(value), 6) AS avg_ms,
  min(value) AS min_ms, max(value) AS max_ms, round(median(value), 6) AS median_ms,
  round(coalesce(stddev_samp(value), 0), 6) AS stdev_ms FROM events GROUP BY 1""")
def _(t):
    out = metrics.latency_stats(t("events"), "event_type", "value")
    return out.withColumns({c: rounded(F.col(c)) for c in ("avg_ms", "median_ms", "stdev_ms")})


@query("h9_latency_samples", """SELECT event_type, value, rank::INT AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM events)
  WHERE rank <= 100""")
def _(t):
    return metrics.latency_samples(t("events"), "event_type", "value", ["event_id"]).drop(
        "event_id")


@query("h10_load_run_stats", f"""SELECT user_id, count(*) FILTER (event_type <> 'error') AS total_sent,
  count(*) FILTER (event_type = 'error') AS total_errors,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS duration_seconds,
  round(count(*) FILTER (event_type <> 'error') / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)
    * 60, 6) AS actual_throughput,
  round(avg(value) FILTER (event_type <> 'error'), 6) AS avg_send_ms,
  max(value) FILTER (event_type <> 'error') AS max_send_ms,
  {STAMP.format('min(ts)')} AS start_time, {STAMP.format('max(ts)')} AS end_time
  FROM events GROUP BY 1""")
def _(t):
    rows = t("events").withColumn("failed", F.col("event_type") == "error")
    out = metrics.load_run_stats(rows, "user_id", "ts", "value", "failed")
    return out.withColumns({
        "duration_seconds": rounded(F.col("duration_seconds"), 3),
        "actual_throughput": rounded(F.col("actual_throughput")),
        "avg_send_ms": rounded(F.col("avg_send_ms")),
        "start_time": stamp("start_time"), "end_time": stamp("end_time")})


@query("h11_neutral_share", f"""WITH {ART} SELECT round(avg((sentiment = 'neutral')::INT), 6)
  AS neutral_share FROM art""")
def _(t):
    from newsloom.operators.sentiment import neutral_share

    return neutral_share(t.articles).withColumn("neutral_share", rounded(F.col("neutral_share")))


DIGEST_AT = "2024-01-02 12:00:00"
TOPIC = ("CASE WHEN contains(title, ':') THEN split_part(title, ':', 1) ELSE left(title, 50) END")


@query("h12_daily_digest", f"""WITH {ART}, r AS (SELECT * FROM art WHERE published_at >
    TIMESTAMP '2024-01-01 12:00:00' AND published_at <= TIMESTAMP '2024-01-02 12:00:00'),
  n AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, id) AS i FROM r
        QUALIFY i <= 12),
  p AS (SELECT {TOPIC} AS topic, min(i) AS i FROM n GROUP BY 1),
  f AS (SELECT topic, row_number() OVER (ORDER BY i) AS k, i FROM p)
  SELECT (SELECT count(*) FROM r) AS articles, 'ok' AS status,
    (SELECT string_agg(topic, '|' ORDER BY i) FROM f WHERE k <= 3) AS topics,
    (SELECT string_agg(left(title, 100), '|' ORDER BY i) FROM n WHERE i <= 3) AS headlines""")
def _(t):
    out = metrics.daily_digest(t.articles, "published_at", "id", moment(DIGEST_AT))
    return out.select("articles", "status", joined("topics", "|").alias("topics"),
                      joined("headlines", "|").alias("headlines"))


@query("h13_hour_profile", "SELECT hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return timeseries.hour_profile(t("events"), "ts")


@query("h14_cluster_breakdown", f"""WITH {ART}, b AS (SELECT source, count(*) AS n,
    round(avg(sentiment_score), 6) AS avg_sentiment, {STAMP.format('min(published_at)')} AS first_ts,
    {STAMP.format('max(published_at)')} AS last_ts FROM art GROUP BY 1),
  e AS (SELECT source, entity, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, entity)
    AS r FROM (SELECT source, unnest(entities) AS entity FROM art) GROUP BY 1, 2),
  c AS (SELECT source, string_agg(entity, ',' ORDER BY r) AS common_entities FROM e WHERE r <= 5
    GROUP BY 1),
  s AS (SELECT source, title, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, id)
    AS r FROM art),
  a AS (SELECT source, string_agg(title, '|' ORDER BY r) AS samples FROM s WHERE r <= 5 GROUP BY 1)
  SELECT * FROM b JOIN c USING (source) JOIN a USING (source)""")
def _(t):
    out = metrics.cluster_breakdown(t.articles, "source", "entities", "published_at", "id")
    return out.withColumns({
        "avg_sentiment": rounded(F.col("avg_sentiment")), "first_ts": stamp("first_ts"),
        "last_ts": stamp("last_ts"), "common_entities": joined("common_entities"),
        "samples": joined("samples", "|")})


@query("h15_mean_scores", """SELECT round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic
  FROM labels""")
def _(t):
    return t("labels").agg(*[rounded(F.avg(c)).alias(c) for c in ("quality", "toxic")])


# --- time series --------------------------------------------------------------------------

FILLED = """c AS (SELECT event_type, date_trunc('{unit}', ts) AS bucket, count(*) AS n FROM events
    {where} GROUP BY 1, 2),
  s AS (SELECT event_type, unnest(generate_series(min(bucket)::TIMESTAMP, max(bucket)::TIMESTAMP,
    INTERVAL 1 {unit})) AS bucket FROM c GROUP BY 1),
  f AS (SELECT event_type, s.bucket, coalesce(n, 0) AS n FROM s LEFT JOIN c
    ON s.event_type = c.event_type AND s.bucket = c.bucket::TIMESTAMP AND true)"""
FILLED = FILLED.replace("SELECT event_type, s.bucket", "SELECT s.event_type, s.bucket")
DAILY = FILLED.format(unit="day", where="")
HOURLY = FILLED.format(unit="hour", where="")
VELOCITY = """v AS (SELECT *, coalesce(n - lag(n) OVER (PARTITION BY event_type ORDER BY bucket), 0)
    AS velocity FROM f),
  a AS (SELECT *, coalesce(velocity - lag(velocity) OVER (PARTITION BY event_type ORDER BY bucket),
    0) AS acceleration FROM v)"""


@query("i1_daily_counts", f"""WITH {DAILY} SELECT event_type, {STAMP.format('bucket')} AS bucket, n
  FROM f""")
def _(t):
    return timeseries.filled_counts(t("events"), "ts", "day", ["event_type"]).withColumn(
        "bucket", stamp("bucket"))


@query("i1_hourly_counts", f"""WITH {HOURLY} SELECT event_type, {STAMP.format('bucket')} AS bucket, n
  FROM f""")
def _(t):
    return timeseries.filled_counts(t("events"), "ts", "hour", ["event_type"]).withColumn(
        "bucket", stamp("bucket"))


RECENT = """ev AS (SELECT {ts} AS ts, value, length(props) AS e FROM events),
  r AS (SELECT * FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 7 DAY),
  c AS (SELECT date_trunc('{unit}', ts)::TIMESTAMP AS bucket, count(*) AS post_count,
    avg(value) AS avg_sentiment, sum(e)::BIGINT AS total_entities FROM r GROUP BY 1),
  s AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 {unit})) AS bucket
    FROM c),
  f AS (SELECT s.bucket, coalesce(post_count, 0) AS post_count, avg_sentiment,
    coalesce(total_entities, 0) AS total_entities FROM s LEFT JOIN c USING (bucket)),
  v AS (SELECT *, coalesce(post_count - lag(post_count) OVER (ORDER BY bucket), 0) AS velocity
    FROM f)
  SELECT strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, post_count,
    round(avg_sentiment, 6) AS avg_sentiment, total_entities, velocity,
    coalesce(velocity - lag(velocity) OVER (ORDER BY bucket), 0) AS acceleration,
    CASE WHEN velocity > 0 THEN 'Birth/Growth' WHEN velocity = 0 THEN 'Stable/Maturity'
         ELSE 'Decline' END AS stage FROM v"""


def recent(t, rows):
    rows = rows.select("ts", F.col("value").alias("sentiment_score"),
                       F.length("props").cast("long").alias("entity_count"))
    return timeseries.recent_lifecycle(rows, "ts").withColumns({
        "bucket": stamp("bucket"), "avg_sentiment": rounded(F.col("avg_sentiment"))})


@query("i2_lifecycle_days", "WITH " + RECENT.format(unit="day", ts="ts"))
def _(t):
    return recent(t, t("events"))


@query("i2_lifecycle_hours", "WITH " + RECENT.format(
    unit="hour", ts="make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 20)"))
def _(t):
    """The month of events squeezed into a day and a half, so that buckets are hours."""
    start = 1_704_067_200_000_000  # 2024-01-01 in microseconds
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    squeezed = F.timestamp_micros(F.floor((micros - start) / 20).cast("long") + start)
    return recent(t, t("events").withColumn("ts", squeezed))


@query("i3_velocity", f"""WITH {DAILY}, {VELOCITY} SELECT event_type,
  {STAMP.format('bucket')} AS bucket, n, velocity, acceleration FROM a""")
def _(t):
    series = timeseries.filled_counts(t("events"), "ts", "day", ["event_type"])
    return timeseries.velocity(series, ["event_type"]).withColumn("bucket", stamp("bucket"))


@query("i4_lifecycle", f"""WITH {DAILY}, {VELOCITY} SELECT event_type,
  {STAMP.format('bucket')} AS bucket, n, velocity, acceleration, CASE WHEN velocity > 0
  THEN 'Birth/Growth' WHEN velocity = 0 THEN 'Stable/Maturity' ELSE 'Decline' END AS stage FROM a""")
def _(t):
    series = timeseries.filled_counts(t("events"), "ts", "day", ["event_type"])
    return timeseries.lifecycle(series, ["event_type"]).withColumn("bucket", stamp("bucket"))


@query("i5_spread_evenly", """WITH d AS (SELECT doc_id, TIMESTAMP '2024-01-01 00:00:00' +
    to_microseconds((doc_id * 37 % 1000) * 1000) AS ts FROM documents),
  r AS (SELECT *, row_number() OVER (ORDER BY ts, doc_id) AS k, count(*) OVER () AS n,
    min(ts) OVER () AS lo FROM d)
  SELECT doc_id, round((k - 1)::DOUBLE / (n - 1) * 604800, 0)::BIGINT AS seconds FROM r""")
def _(t):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    offset = ((F.col("doc_id") * 37 % 1000) / 1000).cast("decimal(18,6)")
    rows = t("documents").select("doc_id", (start + F.make_dt_interval(secs=offset)).alias("ts"))
    out = timeseries.spread_evenly(rows, "ts", "doc_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return out.select("doc_id", F.round(gap / 1e6, 0).cast("long").alias("seconds"))


@query("i5_spread_sparse", """SELECT doc_id, doc_id * 37 % 1000 AS seconds FROM documents""")
def _(t):
    """Rows that lie more than a minute apart stay where they are."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    offset = (F.col("doc_id") * 37 % 1000).cast("decimal(18,6)")
    rows = t("documents").select("doc_id", (start + F.make_dt_interval(secs=offset)).alias("ts"))
    out = timeseries.spread_evenly(rows, "ts", "doc_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return out.select("doc_id", F.round(gap / 1e6, 0).cast("long").alias("seconds"))


SLIDING = """q AS (SELECT event_type, epoch_us(ts) // 5000000 AS b FROM events),
  w AS (SELECT event_type, unnest(generate_series(b - 11, b)) * 5 AS s FROM q),
  h AS (SELECT make_timestamp(s * 1000000) AS window_start, event_type, count(*) AS n,
    count(*)::DOUBLE AS velocity FROM w GROUP BY s, event_type),
  p AS (SELECT event_type, max(velocity) AS peak_velocity,
    min(window_start) FILTER (velocity = mv) AS peak_time FROM (SELECT *, max(velocity) OVER (
      PARTITION BY event_type) AS mv FROM h) GROUP BY 1)"""


def history(t):
    return timeseries.sliding_velocity(t("events"), "ts", "event_type")


@query("i8_sliding_velocity", f"""WITH {SLIDING} SELECT {STAMP.format('window_start')} AS
  window_start, event_type, n, velocity FROM h""")
def _(t):
    return history(t).withColumn("window_start", stamp("window_start"))


@query("i9_peaks", f"""WITH {SLIDING} SELECT event_type, peak_velocity,
  {STAMP.format('peak_time')} AS peak_time FROM p""")
def _(t):
    return timeseries.peaks(history(t), "event_type", "window_start", "velocity").withColumn(
        "peak_time", stamp("peak_time"))


@query("g9_detection_lag", f"""WITH {SLIDING}, f AS (SELECT event_type, min(ts) AS first_time
    FROM events GROUP BY 1) SELECT event_type, peak_velocity, {STAMP.format('peak_time')} AS
    peak_time, {STAMP.format('first_time')} AS first_time,
    round((epoch_us(peak_time) - epoch_us(first_time)) / 1e6, 3) AS lag_seconds
  FROM p JOIN f USING (event_type)""")
def _(t):
    peak = timeseries.peaks(history(t), "event_type", "window_start", "velocity")
    out = timeseries.detection_lag(peak, t("events"), "event_type", "ts")
    return out.withColumns({"peak_time": stamp("peak_time"), "first_time": stamp("first_time"),
                            "lag_seconds": rounded(F.col("lag_seconds"), 3)})


CUMULATIVE = """u AS (SELECT window_start, event_type, velocity, sum(velocity) OVER (
    PARTITION BY event_type ORDER BY window_start) AS cumulative FROM h)"""


@query("i6_cumulative_docs", f"""WITH {SLIDING}, {CUMULATIVE} SELECT event_type,
  {STAMP.format('window_start')} AS window_start, round(cumulative, 6) AS cumulative FROM u""")
def _(t):
    out = timeseries.cumulative_docs(history(t), "event_type", "window_start", "velocity")
    return out.select("event_type", stamp("window_start").alias("window_start"),
                      rounded(F.col("cumulative")).alias("cumulative"))


@query("i7_rolling_mean", f"""WITH {HOURLY} SELECT event_type, {STAMP.format('bucket')} AS bucket, n,
  CASE WHEN count(*) OVER w = 3 THEN round(avg(n) OVER w, 6) END AS rolling FROM f
  WINDOW w AS (PARTITION BY event_type ORDER BY bucket ROWS 2 PRECEDING)""")
def _(t):
    series = timeseries.filled_counts(t("events"), "ts", "hour", ["event_type"])
    return timeseries.rolling_mean(series, ["event_type"]).withColumns({
        "bucket": stamp("bucket"), "rolling": rounded(F.col("rolling"))})


@query("i10_alert_status", f"""WITH {SLIDING} SELECT event_type, CASE WHEN velocity >= 4 THEN 'ALERT'
  WHEN velocity >= 2 THEN 'ELEVATED' ELSE 'NORMAL' END AS status, count(*) AS n FROM h
  GROUP BY 1, 2""")
def _(t):
    status = timeseries.alert_status(F.col("velocity"), 4.0)
    return history(t).groupBy("event_type", status.alias("status")).agg(F.count("*").alias("n"))


@query("i11_minutes_since_start", f"""WITH {SLIDING} SELECT event_type,
  {STAMP.format('window_start')} AS window_start, round((epoch_us(window_start) -
    epoch_us(min(window_start) OVER (PARTITION BY event_type))) / 6e7, 6) AS minutes FROM h""")
def _(t):
    out = timeseries.minutes_since_start(history(t), "event_type", "window_start")
    return out.select("event_type", stamp("window_start").alias("window_start"),
                      rounded(F.col("minutes")).alias("minutes"))


@query("i12_sentiment_series", f"""WITH {ART} SELECT id, {STAMP.format('published_at')} AS
  published_at, sentiment, sentiment_score FROM art ORDER BY published_at DESC, id LIMIT 200""")
def _(t):
    from newsloom.operators.boards import newest

    rows = t.articles.select("id", "published_at", "sentiment", "sentiment_score")
    return newest(rows, "published_at", "id", 200).withColumn("published_at",
                                                              stamp("published_at"))


@query("i13_peak_position", f"""WITH {SLIDING}, {CUMULATIVE}, k AS (SELECT u.*, row_number() OVER (
    PARTITION BY u.event_type ORDER BY abs(epoch_us(window_start) - epoch_us(peak_time)),
    window_start) AS rn FROM u JOIN p ON u.event_type = p.event_type)
  SELECT event_type, {STAMP.format('window_start')} AS peak_bucket, round(cumulative, 6)
    AS peak_docs FROM k WHERE rn = 1""")
def _(t):
    h = history(t)
    curve = timeseries.cumulative_docs(h, "event_type", "window_start", "velocity")
    peak = timeseries.peaks(h, "event_type", "window_start", "velocity")
    out = timeseries.peak_position(curve.drop("velocity", "n"), peak, "event_type", "window_start")
    return out.withColumns({"peak_bucket": stamp("peak_bucket"),
                            "peak_docs": rounded(F.col("peak_docs"))})
