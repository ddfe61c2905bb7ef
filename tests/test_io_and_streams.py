"""Sources, sinks and streaming jobs over several micro-batches."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators import events, timeseries
from newsloom.session import materialize, shared_folder
from newsloom.sources import readers, sinks
from newsloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def land(df, path, parts, column="id"):
    """Write the rows as one file per micro-batch, oldest first."""
    n = df.count()
    for p in range(parts):
        rows = df.filter((F.col(column) >= p * n // parts) & (F.col(column) < (p + 1) * n // parts))
        rows.coalesce(1).write.mode("append").parquet(str(path))


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


# --- sources ------------------------------------------------------------------------

def test_bad_lines_are_separated(spark):
    schema = T.StructType([T.StructField("a", T.LongType())])
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": ',), ("",), (None,), ('{"a": "x"}',)],
                               "value string")
    rows = readers.decode_json(df, schema).collect()
    assert [r["record"]["a"] if r["record"] else None for r in rows][:2] == [1, None]
    assert rows[1]["_corrupt"] == '{"a": ' and rows[4]["record"] is None
    assert readers.decoded_rows(df, schema).count() == 1


def test_json_array_counts_repeated_records_once(spark, tmp_path):
    rows = [{"id": "a", "n": "1"}, {"id": "b", "n": "2"}, {"id": "a", "n": "1"}]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    out = readers.read_json_array(spark, str(tmp_path), T.StructType(
        [T.StructField("id", T.StringType()), T.StructField("n", T.StringType())]))
    assert sorted(r["id"] for r in out.collect()) == ["a", "b"]


def test_json_lines_newest_first(spark, tmp_path):
    lines = ['{"id": "1", "ingested_at": "2024-01-01T00:00:00"}', "{broken",
             '{"id": "2", "published_at": "2024-01-03T00:00:00"}']
    (tmp_path / "feed.jsonl").write_text("\n".join(lines))
    from newsloom.schema import LIVE_FEED

    df = readers.read_json_lines(spark, str(tmp_path), LIVE_FEED)
    got = readers.newest_first(df, "ingested_at", "published_at")
    assert [r["id"] for r in got.collect()] == ["2", "1"]


def test_csv_lists_and_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'id,entities,locations,timestamp\n1,"A, B, C",,2024-01-01T00:00:00\n2,,"X",bad\n')
    schema = T.StructType([T.StructField(c, T.StringType())
                           for c in ("id", "entities", "locations", "timestamp")])
    rows = readers.read_csv_articles(spark, str(tmp_path), schema).orderBy("id").collect()
    assert (rows[0]["entities"], rows[0]["locations"], rows[0]["matched_event"]) == \
        (["A", "B", "C"], [], 1)
    assert (rows[1]["entities"], rows[1]["timestamp"], rows[1]["matched_event"]) == ([], None, 0)


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, "y")], "id int, b string")
    assert sorted(tuple(r) for r in readers.union_feeds(a, b).collect()) == [(1, "x", None),
                                                                             (2, None, "y")]


# --- sinks ------------------------------------------------------------------------

def test_upsert_moves_rows_and_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "id string, at int, day string"

    def put(rows, **options):
        sinks.upsert(spark.createDataFrame(rows, schema), path, "id", ["at"], "day", **options)

    def table():
        return sorted(tuple(r) for r in spark.read.parquet(path).select("id", "at", "day").collect())

    put([("a", 1, "d1"), ("b", 1, "d1"), ("c", 1, "d2"), ("a", 0, "d1")])
    assert table() == [("a", 1, "d1"), ("b", 1, "d1"), ("c", 1, "d2")]
    batch = [("c", 2, "d3"), ("a", 0, "d1"), ("b", 5, "d1")]  # c moves, a is older, b newer
    put(batch)
    want = [("a", 1, "d1"), ("b", 5, "d1"), ("c", 2, "d3")]
    assert table() == want
    put(batch)
    assert table() == want
    put([("b", 6, "d1")], rows_move=False)
    assert ("b", 6, "d1") in table()


def test_upsert_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, i) for i in range(9)], "id int, k int, at int")
    land(df, tmp_path / "in", 3)
    stream = stream_of(spark, tmp_path / "in", df.schema).withColumn("p", F.lit("x"))
    sinks.upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), "k", ["at"], "p"
                        ).awaitTermination()
    assert sorted(r["at"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [6, 7, 8]


def test_csv_export_keeps_nested_values(spark, tmp_path):
    df = spark.createDataFrame([(1, ['say "hi"', "b"])], "id int, names array<string>")
    sinks.export_csv(df, str(tmp_path / "o"))
    row = spark.read.csv(str(tmp_path / "o"), header=True, escape='"').first()
    assert json.loads(row["names"]) == ['say "hi"', "b"]


def test_topic_needs_the_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        readers.topic_stream(spark, "localhost:1", "t")


def test_materialize_starts_from_a_scan(spark, capsys):
    df = materialize(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 20
    df.explain()
    assert "FileScan parquet" in capsys.readouterr().out
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir", shared_folder(spark))


# --- streams -----------------------------------------------------------------------

def test_dedup_forgets_keys(spark, tmp_path):
    rows = [(0, "u", at(0)), (1, "u", at(600)), (2, "v", at(3 * 3600)), (3, "w", at(3 * 3600)),
            (4, "u", at(4 * 3600)), (5, "x", at(9 * 3600))]
    df = spark.createDataFrame(rows, "id long, url string, ts timestamp")
    land(df, tmp_path / "in", 6)
    out = jobs.run_available(jobs.drop_duplicates(stream_of(spark, tmp_path / "in", df.schema),
                                                  "url", "ts", 3600), "t")
    assert sorted(r["id"] for r in out.collect()) == [0, 2, 3, 4, 5]


def test_dedup_across_a_full_hour_equals_batch(spark, tmp_path):
    from newsloom.operators.dedup import first_per_window

    # 10:59 and 11:01 lie within an hour; so does 11:58 of 10:59, but 12:00 does not.
    minutes = [659, 661, 718, 720, 779, 780]
    rows = [(str(i), "u", at(60 * m)) for i, m in enumerate(minutes)] + [("z", None, at(60 * 660))]
    df = spark.createDataFrame(rows, "id string, url string, ts timestamp")
    batch = first_per_window(df, "url", "ts", 3600, "id")
    assert sorted(r["id"] for r in batch.collect()) == ["0", "3", "5", "z"]
    df.coalesce(1).orderBy(F.desc("ts")).write.parquet(str(tmp_path / "in"))
    out = jobs.run_available(jobs.drop_duplicates(stream_of(spark, tmp_path / "in", df.schema),
                                                  "url", "ts", 3600), "t")
    assert sorted(r["id"] for r in out.collect()) == ["0", "3", "5", "z"]


def test_late_rows_are_dropped(spark, tmp_path):
    # Spark drops by the watermark of the batch before: row 3 comes two batches after row 1.
    rows = [(0, "a", at(0)), (1, "a", at(1000)), (2, "a", at(1001)), (3, "a", at(2)),
            (4, "a", at(2000))]
    df = spark.createDataFrame(rows, "id long, g string, ts timestamp")
    land(df, tmp_path / "in", 5)
    counts = jobs.sliding_counts(stream_of(spark, tmp_path / "in", df.schema), "ts", "g", 60, 60)
    out = {r["window_start"]: r["n"] for r in jobs.run_available(counts.drop("w"), "t").collect()}
    assert out[at(0)] == 1  # the row of second 2 came after the watermark had passed


def test_velocity_and_peaks_over_batches(spark, tmp_path):
    rng = np.random.default_rng(4)
    times = np.sort(rng.integers(0, 900, 200))
    rows = [(i, "ab"[i % 3 == 0], at(int(s))) for i, s in enumerate(times)] + \
        [(200, "z", at(5000))]  # moves the watermark past all windows
    df = spark.createDataFrame(rows, "id long, g string, ts timestamp")
    land(df, tmp_path / "in", 4)
    counts = jobs.sliding_counts(stream_of(spark, tmp_path / "in", df.schema), "ts", "g")
    out = jobs.run_available(counts.drop("w"), "t")
    batch = timeseries.sliding_velocity(df.filter("g <> 'z'"), "ts", "g")
    key = ("window_start", "g", "n")
    assert {tuple(r[c] for c in key) for r in out.filter("g <> 'z'").collect()} == \
        {tuple(r[c] for c in key) for r in batch.collect()}

    emitted = jobs.run_available(jobs.running_peaks(counts, "g"), "t2").filter("grp <> 'z'")
    last = emitted.groupBy("grp").agg(F.max("peak_velocity").alias("v"))
    want = batch.groupBy("g").agg(F.max("velocity").alias("v"))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in want.collect()}


def test_keyword_events_over_batches(spark, tmp_path):
    rows = [(i, at(i), "hot" if i % 2 else f"k{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, cluster_key string")
    land(df, tmp_path / "in", 4)
    out = jobs.run_available(jobs.keyword_events(stream_of(spark, tmp_path / "in", df.schema)), "t")
    want = set()
    for k in {r[2] for r in rows}:
        members = [r for r in rows if r[2] == k]
        want |= {("event_" + k, r[0], n, r[1] if n == 3 else members[0][1], n > 3)
                 for n, r in enumerate(members, 1) if n >= 3}
    assert {tuple(r) for r in out.collect()} == want


def test_semantic_events_over_batches_equal_one_pass(spark, tmp_path):
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((4, 6)) * 3
    rows = [(i, at(i), [float(x) for x in centers[i % 4] + rng.standard_normal(6) * 0.7])
            for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, vector array<double>")
    land(df, tmp_path / "in", 3)
    out = jobs.run_available(jobs.semantic_events(stream_of(spark, tmp_path / "in", df.schema),
                                                  0.75, 0, 6), "t")
    want = events.semantic_events(df, 0.75, 0, None)
    assert {(r["id"], r["event"]) for r in out.collect()} == \
        {(r["id"], r["event"]) for r in want.collect()}


def test_merged_events_over_batches_equal_the_batch_form(spark, tmp_path):
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((12, 16))
    vectors = [centers[i % 12] + rng.standard_normal(16) * 0.3 if i % 2 else rng.standard_normal(16)
               for i in range(300)]
    rows = [(i, at(60 * i), v.tolist()) for i, v in enumerate(vectors)] + [(300, at(0), None)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, vector array<double>")
    land(df, tmp_path / "in", 3)
    jobs.merged_events(stream_of(spark, tmp_path / "in", df.schema), str(tmp_path / "out"), 0.75, 4,
                       3600.0, 16, most=64).awaitTermination()
    got = {r["id"]: r["event"] for r in jobs.event_names(spark, str(tmp_path / "out")).collect()}
    want = {r["id"]: r["event"] for r in events.semantic_events(df, 0.75, 0, None).collect()}
    assert got.keys() == want.keys() and len(got) == 300
    assert abs(len(set(got.values())) - len(set(want.values()))) <= 0.05 * len(set(want.values()))
    assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)


def test_semantic_events_are_forgotten_after_a_day(spark, tmp_path):
    rows = [("0", at(0), [1.0, 0.0]), ("1", at(86_400), [1.0, 0.0]),
            ("2", at(2 * 86_400 + 1), [1.0, 0.0]), ("3", at(2 * 86_400 + 2), None)]
    df = spark.createDataFrame(rows, "id string, ts timestamp, vector array<double>")
    land(df, tmp_path / "in", 4)
    out = jobs.run_available(jobs.semantic_events(stream_of(spark, tmp_path / "in", df.schema)), "t")
    assert {r["id"]: r["event"] for r in out.collect()} == {"0": "0", "1": "0", "2": "2"}


def test_match_posts_over_batches(spark, tmp_path):
    ev = [(i, at(i * 3600), [f"storm{i % 3}", "flood"]) for i in range(6)]
    posts = [(i, at(i * 7000 + 10), "After STORM%d: %s" % (i % 3, "floods" if i % 4 == 0 else ""))
             for i in range(24)]
    edf = spark.createDataFrame(ev, "event_id long, event_ts timestamp, keywords array<string>")
    pdf = spark.createDataFrame(posts, "post_id long, post_ts timestamp, text string")
    land(edf, tmp_path / "e", 1, "event_id")
    land(pdf, tmp_path / "p", 3, "post_id")
    pairs = jobs.match_posts(stream_of(spark, tmp_path / "p", pdf.schema),
                             stream_of(spark, tmp_path / "e", edf.schema))
    got = [(r["post_id"], r["event_id"]) for r in jobs.run_available(pairs, "t").collect()]
    batch = events.match_posts(pdf, edf.withColumn("title", F.lit("")))
    want = [(r["post_id"], r["event_id"]) for r in batch.collect()]
    assert sorted(got) == sorted(want) and want


def test_latency_of_rows_without_a_time(spark):
    df = spark.createDataFrame([(at(0), at(1)), (None, at(1))], "sent timestamp, got timestamp")
    got = [r["latency_ms"] for r in jobs.latency_rows(df, "sent", F.col("got")).collect()]
    assert got == [1000.0, None]


def test_idle_keyword_groups_start_again(spark, tmp_path):
    day = 86_400
    times = [0, 1, 2, 3, day + 3, 2 * day + 4, 2 * day + 5, 2 * day + 6, 5 * day]
    rows = [(i, at(s), "k") for i, s in enumerate(times)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, cluster_key string")
    want = {(2, 3, at(2), False), (3, 4, at(0), True), (4, 5, at(0), True), (7, 3, at(2 * day + 6), False)}
    for parts in (1, 9):
        land(df, tmp_path / f"in{parts}", parts)
        stream = stream_of(spark, tmp_path / f"in{parts}", df.schema)
        out = jobs.run_available(jobs.keyword_events(stream), "t").drop("event_id")
        assert {tuple(r) for r in out.collect()} == want


def test_match_posts_compares_within_slots_of_time(spark, tmp_path):
    # Posts at, and a microsecond beside, the ends of an event's 90 minutes, over several slots.
    ev = [(i, at(i * 5400 + 60 * i), ["storm"]) for i in range(5)]
    tick = dt.timedelta(microseconds=1)
    ends = sorted({e[1] + dt.timedelta(seconds=s) + d for e in ev for s in (0, 5400)
                   for d in (-tick, dt.timedelta(0), tick)})
    edf = spark.createDataFrame(ev, "event_id long, event_ts timestamp, keywords array<string>")
    pdf = spark.createDataFrame([(i, t, "Thunderstorms") for i, t in enumerate(ends)],
                                "post_id long, post_ts timestamp, text string")
    land(edf, tmp_path / "e", 1, "event_id")
    land(pdf, tmp_path / "p", 1, "post_id")
    pairs = jobs.match_posts(stream_of(spark, tmp_path / "p", pdf.schema),
                             stream_of(spark, tmp_path / "e", edf.schema), "90 minutes")
    plan = pairs._jdf.queryExecution().analyzed().toString()
    assert "(post_slot#" in plan and "= event_slot#" in plan
    got = [(r["post_id"], r["event_id"]) for r in jobs.run_available(pairs, "t").collect()]
    want = [(i, e[0]) for i, t in enumerate(ends) for e in ev
            if e[1] <= t < e[1] + dt.timedelta(minutes=90)]
    assert sorted(got) == sorted(want)


def test_match_posts_packs_the_words_of_posts(spark, tmp_path):
    words = [f"{a}{b}storming" for a in "abcd" for b in "abcde"]
    posts = [(f"p{i}", at(60 * i), " ".join(words)) for i in range(50)]
    ev = [(i, at(600 * i + 1), ["storm", f"{'abcd'[i]}astorm"]) for i in range(4)]
    edf = spark.createDataFrame(ev, "event_id long, event_ts timestamp, keywords array<string>")
    pdf = spark.createDataFrame(posts, "post_id string, post_ts timestamp, text string")
    land(edf, tmp_path / "e", 1, "event_id")
    pdf.coalesce(1).write.parquet(f"{tmp_path}/p")
    pairs = jobs.match_posts(stream_of(spark, tmp_path / "p", pdf.schema),
                             stream_of(spark, tmp_path / "e", edf.schema))
    assert "spark.watermarkDelayMs" in pairs.schema["post_ts"].metadata
    query = (pairs.writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    got = spark.read.schema(pairs.schema).parquet(f"{tmp_path}/out").collect()
    want = [(p, e, ts) for p, ts, _ in posts for e, since, _ in ev if ts >= since]
    assert sorted((r["post_id"], r["event_id"], r["post_ts"]) for r in got) == sorted(want)
    written = sum(s.numRowsUpdated for report in query.recentProgress for s in report.stateOperators
                  if s.operatorName == "symmetricHashJoin")
    assert 0 < written < len(posts) * len(words)  # rows of the state are not one for each word of a post


@pytest.mark.parametrize("salts", [1, 3])
def test_match_posts_in_short_rows(spark, tmp_path, monkeypatch, salts):
    monkeypatch.setattr(jobs, "PIECE_BUCKETS", 2)
    monkeypatch.setattr(jobs, "LINKS", 3)
    monkeypatch.setattr(jobs, "HELD", 1)
    names = ["flood", "Storm", "quakes", "fire", "İzmir", "naïveté"]
    ev = [(i, at(i * 7200), [names[i % 6], names[i * i % 5], "it"]) for i in range(20)] + [
        (20, None, ["flood"]), (21, at(0), None)]
    posts = [(i, at(i * 3600 + 5), " ".join(f"x{n}S" for n in names[i % 4:i % 4 + 2])) for i in range(60)]
    posts += [(60, None, "flood"), (61, at(5), None), (62, at(5), "it")]
    edf = spark.createDataFrame(ev, "event_id long, event_ts timestamp, keywords array<string>")
    pdf = spark.createDataFrame(posts, "post_id long, post_ts timestamp, text string")
    land(edf, tmp_path / "e", 2, "event_id")
    land(pdf, tmp_path / "p", 2, "post_id")
    pairs = jobs.match_posts(stream_of(spark, tmp_path / "p", pdf.schema),
                             stream_of(spark, tmp_path / "e", edf.schema), "6 hours", "40 days", salts)
    got = [(r["post_id"], r["event_id"]) for r in jobs.run_available(pairs, "t").collect()]
    want = [(p, e) for p, ts, text in posts for e, since, keywords in ev
            if None not in (ts, text, since, keywords) and since <= ts < since + dt.timedelta(hours=6)
            and any(len(k) > 3 and k.lower() in text.lower() for k in keywords)]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_dedup_of_keys_that_share_a_state(spark, tmp_path, monkeypatch):
    from newsloom.operators.dedup import first_per_window

    monkeypatch.setattr(jobs, "BUCKETS", 2)
    rng = np.random.default_rng(5)
    times = np.sort(rng.choice(40_000, 300, replace=False))
    keys = [None, *range(2 ** 60, 2 ** 60 + 19)]
    rows = [(i, keys[rng.integers(20)], at(int(s))) for i, s in enumerate(times)]
    df = spark.createDataFrame(rows, "id long, user long, ts timestamp")
    land(df, tmp_path / "in", 3)
    out = jobs.drop_duplicates(stream_of(spark, tmp_path / "in", df.schema), "user", "ts", 3600)
    got = jobs.run_available(out, "t")
    want = first_per_window(df, "user", "ts", 3600, "id")
    assert got.columns == df.columns
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())


@pytest.mark.parametrize("idle", [None, 3600.0])
def test_keyword_groups_that_share_a_state(spark, tmp_path, monkeypatch, idle):
    monkeypatch.setattr(jobs, "BUCKETS", 1)
    rows = [(i, at(60 * i), f"k{i * i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, cluster_key string")
    land(df, tmp_path / "in", 3)
    stream = stream_of(spark, tmp_path / "in", df.schema)
    out = jobs.run_available(jobs.keyword_events(stream, 2, idle_seconds=idle), "t")
    want = set()
    for k in {r[2] for r in rows}:
        members = [r for r in rows if r[2] == k]  # no group is idle for an hour
        want |= {("event_" + k, r[0], n, (r if n == 2 else members[0])[1], n > 2)
                 for n, r in enumerate(members, 1) if n >= 2}
    assert {tuple(r) for r in out.collect()} == want
