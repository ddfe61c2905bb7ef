"""Structured Streaming forms of the operators.

All use event time with a watermark. State is keyed, typed and bounded by the watermark
or a time to live. ``run_available`` drains a source once; production jobs start the same
DataFrame with a processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom import lexicons as lx
from newsloom.functions.normalize import enrich_articles, normalize_articles
from newsloom.operators import events
from newsloom.operators.bounds import one_per_item
from newsloom.operators.components import roots
from newsloom.operators.events import LeaderClusters, lsh_bucket
from newsloom.operators.matching import GRAM, pieces
from newsloom.session import materialize, scratch_path
from newsloom.sources.sinks import exists, foreach_batch, upsert_stream

EVENT_COLUMNS = ["id", "ts", "n", "vsum", "seen"]


def run_available(stream: DataFrame, name: str, mode: str = "append",
                  path: str | None = None) -> DataFrame:
    """Process everything available into a Parquet table in the shared folder; return it."""
    spark = stream.sparkSession
    base = path or scratch_path(spark, name)
    query = (stream.writeStream.format("parquet").outputMode(mode)
             .option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def run_updates(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Drain an updating aggregate: the last version of each key's row."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{base}/data/run={batch_id}")

    query = (stream.writeStream.foreachBatch(keep).outputMode("update")
             .option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/data").drop("run")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("r"))
    return last.select(*keys, "r.*")


MILLIS, KEY, BUCKET = "millis_of_row", "key_of_row", "bucket_of_row"
BUCKETS = 4096  # groups of keys that share a state: a call in Python costs more than a row


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _first_per_window(seconds: int):
    """Keeps the times of the last kept rows of a bucket's keys until the watermark is past them."""
    millis = seconds * 1000

    def put(state: GroupState, known: dict) -> None:
        now = state.getCurrentWatermarkMs()
        known = {name: last for name, last in known.items() if last + millis > now}
        if known:
            state.update((list(known), list(known.values())))
            state.setTimeoutTimestamp(int(max(known.values())) + millis + 1)
        elif state.exists:
            state.remove()

    def run(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get)) if state.exists else {}
        if state.hasTimedOut:
            put(state, known)
            return
        # Of a key's equal times only the first to arrive can stay.
        parts = [part.drop_duplicates([KEY, MILLIS]) for part in rows]
        batch = pd.concat(parts).drop_duplicates([KEY, MILLIS]) if len(parts) > 1 else parts[0]
        batch = batch.sort_values(MILLIS, kind="stable")
        keep = []
        for name, at in zip(batch[KEY].tolist(), batch[MILLIS].tolist()):
            last = known.get(name)
            stays = last is None or at >= last + millis or at <= last - millis
            if stays:
                known[name] = at if last is None else max(last, at)
            keep.append(stays)
        put(state, known)
        yield batch[np.array(keep, dtype=bool)]

    return run


def drop_duplicates(stream: DataFrame, key: str, ts: str, seconds: int = 3600,
                    lateness: str = "0 seconds") -> DataFrame:
    """The rule of ``dedup.first_per_window`` on a stream: a row goes if a kept row of its key
    lies less than ``seconds`` before it, then the key is forgotten.

    Rows of one micro-batch are taken in the order of time; of equal times the first to
    arrive stays. Rows without a time cannot be placed and go. Keys are compared as strings; those
    of a bucket share one state, which holds a key and a time each.
    """
    millis = F.unix_micros(F.col(ts).cast("timestamp")) / 1000.0
    timed = stream.filter(F.col(ts).isNotNull()).withColumns(
        {MILLIS: millis, KEY: F.col(key).cast("string")}).withWatermark(ts, lateness)
    timed = timed.withColumn(BUCKET, _bucket(F.col(KEY)))
    return timed.groupBy(BUCKET).applyInPandasWithState(
        _first_per_window(seconds), timed.schema, "names array<string>, last array<double>",
        "append", GroupStateTimeout.EventTimeTimeout).select(stream.columns)


def live_articles(raw: DataFrame, path: str, checkpoint: str, now: Column | None = None,
                  seconds: int = 3600, lateness: str = "1 hour", every: str | None = None,
                  **enrich) -> StreamingQuery:
    """The live path as one stream: raw news is normalised, loses repeated links within an hour, is
    enriched and goes into a table by its id, in folders by day.

    An id comes from link, title and time, so an article that comes again replaces itself, and it
    never changes its day.
    """
    first = drop_duplicates(normalize_articles(raw, now), "url", "published_at", seconds, lateness)
    rows = enrich_articles(first, **enrich).withColumn("day", F.to_date("event_time"))
    return upsert_stream(rows, path, checkpoint, "id", ["ingested_at", "event_time"], "day",
                         rows_move=False, every=every)


def sliding_counts(stream: DataFrame, ts: str, group: str, window: int = 60, poll: int = 5,
                   lateness: str = "0 seconds") -> DataFrame:
    """(window_start, group, n, velocity): final once the watermark has passed a window."""
    w = F.window(ts, f"{window} seconds", f"{poll} seconds")
    counts = stream.withWatermark(ts, lateness).groupBy(w.alias("w"), group).agg(
        F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), group, "n",
                         (F.col("n") * 60.0 / window).alias("velocity"), F.col("w"))


class PeakProcessor(StatefulProcessor):
    """Largest velocity so far per group and the first time it was reached."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.peak = handle.getValueState("peak", "velocity double, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        best = self.peak.get() if self.peak.exists() else None
        changed = False
        for batch in rows:
            top = batch.sort_values(["velocity", "window_start"], ascending=[False, True]).iloc[0]
            value, at = float(top["velocity"]), top["window_start"].to_pydatetime()
            if best is None or value > best[0] or (value == best[0] and at < best[1]):
                best, changed = (value, at), True
        if changed:
            self.peak.update(best)
            yield pd.DataFrame({"grp": [key[0]], "peak_velocity": [best[0]],
                                "peak_time": [best[1]]})

    def close(self) -> None:
        pass


def running_peaks(counts: DataFrame, group: str) -> DataFrame:
    """Emits (grp, peak_velocity, peak_time) whenever a group's peak changes."""
    narrow = counts.select(F.col(group).cast("string").alias("grp"), "window_start", "velocity")
    return narrow.groupBy("grp").transformWithStateInPandas(
        statefulProcessor=PeakProcessor(),
        outputStructType="grp string, peak_velocity double, peak_time timestamp",
        outputMode="Append", timeMode="None")


def _keyword_counts(size: int, idle_seconds: float | None):
    """Counts the articles of a bucket's keyword groups; keeps of each its number, its first and its
    last time, in microseconds.

    A group that had no article for longer than ``idle_seconds`` starts again, and it is forgotten
    once the watermark is past that time.
    """
    idle = None if idle_seconds is None else idle_seconds * 1_000_000

    def put(state: GroupState, known: dict) -> None:
        if idle is not None:
            now = state.getCurrentWatermarkMs() * 1000
            known = {name: group for name, group in known.items()
                     if group[2] is None or group[2] + idle >= now}
        if known:
            state.update((list(known), *map(list, zip(*known.values()))))
        elif state.exists:
            state.remove()
        timed = [last for _, _, last in known.values() if last is not None]
        if idle is not None and timed:
            state.setTimeoutTimestamp(int((max(timed) + idle) / 1000) + 1)

    def run(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {}
        if state.exists:
            names, *figures = state.get
            known = dict(zip(names, zip(*figures)))
        if state.hasTimedOut:
            put(state, known)
            return
        batch = pd.concat(list(rows)).sort_values(["micros", "id"])  # a bucket of one micro-batch
        numbers, firsts = [], []
        for name, at in zip(batch["cluster_key"].tolist(), batch["micros"].tolist()):
            at = int(at) if at == at else None  # rows without a time come last and change no time
            n, first, last = known.get(name, (0, None, None))
            gone = idle is not None and None not in (at, last) and at - last > idle
            n, first = (1, at) if gone else (n + 1, at if first is None else first)
            last = last if at is None else at if last is None or gone else max(last, at)
            known[name] = n, first, last
            numbers.append(n)
            firsts.append(at if n == size else first)
        put(state, known)
        out = batch[["cluster_key", "id"]].assign(
            article_count=numbers, micros=pd.array(firsts, dtype="Int64"))
        yield out[out["article_count"] >= size]

    return run


def keyword_events(clusters: DataFrame, size: int = 3, idle_seconds: float | None = 86_400,
                   lateness: str = "1 hour") -> DataFrame:
    """Births and updates of keyword groups from (id, ts, cluster_key) as they arrive.

    A group without an article for ``idle_seconds`` is forgotten, so the state holds the groups of a
    day; None keeps all groups for good, as the batch form does. Groups of a bucket share a state.
    """
    narrow = clusters.select(F.col("cluster_key").cast("string").alias("cluster_key"), "id",
                             F.col("ts").cast("timestamp").alias("ts"))
    kind = dict(narrow.dtypes)["id"]
    if idle_seconds is not None:
        narrow = narrow.withWatermark("ts", lateness)
    keyed = narrow.withColumns({"micros": F.unix_micros("ts"), BUCKET: _bucket(F.col("cluster_key"))})
    counted = keyed.groupBy(BUCKET).applyInPandasWithState(
        _keyword_counts(size, idle_seconds),
        f"cluster_key string, id {kind}, article_count long, micros long",
        "names array<string>, n array<long>, first array<long>, last array<long>", "append",
        GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.EventTimeTimeout)
    return counted.select(
        F.concat(F.lit("event_"), "cluster_key").alias("event_id"), "id", "article_count",
        F.timestamp_micros("micros").alias("first_seen"),
        (F.col("article_count") > size).alias("event_update"))


class SemanticEventProcessor(StatefulProcessor):
    """Centroids of one bucket: name -> (sum, count, time of the last article)."""

    def __init__(self, threshold: float, ttl_seconds: float | None, kind: str):
        self.threshold, self.ttl_seconds, self.kind = threshold, ttl_seconds, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", f"name {self.kind}",
                                         "vsum array<double>, n double, seen double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "id"])  # one bucket of one micro-batch
        seconds = (batch["ts"] - pd.Timestamp(0)).dt.total_seconds().tolist()
        clusters = LeaderClusters(self.threshold)
        forgotten = []
        for (name,), (vsum, n, seen) in sorted(self.events.iterator(), key=lambda e: e[0][0]):
            if self.ttl_seconds is not None and seen < seconds[0] - self.ttl_seconds:
                forgotten.append(name)
            else:
                clusters.load(name, np.asarray(vsum), n)
        for name in forgotten:
            self.events.removeKey((name,))
        found = [clusters.add(i, v) for i, v in zip(batch["id"].tolist(), batch["vector"])]
        last = {f[0]: at for f, at in zip(found, seconds)}
        place = {name: at for at, name in enumerate(clusters.names)}
        for name, seen in last.items():
            at = place[name]
            self.events.updateValue((name,), (clusters.sums[at].tolist(), clusters.counts[at], seen))
        yield pd.DataFrame({"id": batch["id"].to_numpy(), "event": [f[0] for f in found],
                            "similarity": [f[1] for f in found], "is_new": [f[2] for f in found]})

    def close(self) -> None:
        pass


def semantic_events(stream: DataFrame, threshold: float = 0.75, lsh_bits: int = 0,
                    dim: int = 384, ttl_seconds: float | None = 86_400) -> DataFrame:
    """Assign (id, ts, vector) rows to events as they arrive, bucket by bucket.

    When a micro-batch comes, events whose last article is more than ``ttl_seconds`` older than
    its first row are forgotten, so the state holds the events of a day. Buckets (``lsh_bits``)
    spread the work but part an event whose articles fall into several; without them the rule
    is exact, and one task's work. Rows without a vector are left out.
    """
    kind = dict(stream.dtypes)["id"]
    keyed = stream.filter(F.col("vector").isNotNull()).select(
        "id", F.col("ts").cast("timestamp").alias("ts"),
        F.col("vector").cast("array<double>").alias("vector"),
        lsh_bucket(F.col("vector"), lsh_bits, dim).alias("bucket"))
    return keyed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=SemanticEventProcessor(threshold, ttl_seconds, kind),
        outputStructType=f"id {kind}, event {kind}, similarity double, is_new boolean",
        outputMode="Append", timeMode="None")


def merged_events(stream: DataFrame, path: str, threshold: float = 0.75, lsh_bits: int = 12,
                  slot_seconds: float | None = 3600.0, dim: int = 384,
                  ttl_seconds: float | None = 86_400, most: int = events.MOST_ROWS,
                  every: str | None = None) -> StreamingQuery:
    """Assign (id, ts, vector) rows to events as they arrive, merged over all buckets.

    Each micro-batch is cut into local events, and these and the events known so far are put
    together as in the batch form (``events.merge_parts``), so the work is spread and events meet
    whatever bucket their articles fell into. Events whose last article is more than
    ``ttl_seconds`` older than a micro-batch's first row are forgotten.

    Under ``path``, a micro-batch writes its articles' names, the known events that it merged and the
    events known after it, each to a folder of its own; a batch that is repeated replaces them.
    ``event_names`` reads them.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = materialize(events.event_members(batch), "articles")
        local, parts = events.local_events(rows, threshold, lsh_bits, slot_seconds, dim, most=most)
        last = local.join(rows.select("id", "ts"), "id").groupBy(F.col("event").alias("id")).agg(
            F.max("ts").alias("seen"))
        parts = parts.join(last, "id").select(EVENT_COLUMNS)
        if exists(spark, f"{path}/events/batch={number - 1}"):
            known = spark.read.schema(parts.schema).parquet(f"{path}/events/batch={number - 1}")
            if ttl_seconds is not None:
                start = rows.agg(F.min("ts")).scalar()
                age = F.unix_micros(start.cast("timestamp")) - F.unix_micros(F.col("seen").cast("timestamp"))
                known = known.filter(F.coalesce(age <= ttl_seconds * 1_000_000, F.lit(True)))
            parts = known.unionByName(parts)
        parts = materialize(parts, "parts")
        names, merged = events.merge_parts(parts.drop("seen"), threshold, most)
        seen = names.join(parts.select("id", "seen"), "id").groupBy(F.col("event").alias("id")).agg(
            F.max("seen").alias("seen"))
        for folder, table in (("articles", local), ("merges", names.filter("id <> event")),
                              ("events", merged.join(seen, "id").select(EVENT_COLUMNS))):
            table.write.mode("overwrite").parquet(f"{path}/{folder}/batch={number}")

    return foreach_batch(stream, step, f"{path}/checkpoint", every)


def event_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, event) of all articles that ``merged_events`` has seen, by the events of now."""
    told = spark.read.parquet(f"{path}/articles").select("id", F.col("event").alias("local"))
    ends = roots(spark.read.parquet(f"{path}/merges").select("id", "event"), "id", "event").select(
        F.col("id").alias("local"), "root")
    return told.join(ends, "local", "left").select("id", F.coalesce("root", "local").alias("event"))


PIECE_BUCKETS = 1024  # groups of pieces whose posts share a row of the join's state
LINKS = 1024  # of a word to a post, in one row at most
HELD = 32 << 20  # bytes of links that a task holds at once


def _packed(names: Sequence[str]):
    """Rows (post_slot, bucket, word, post_id, post_ts) of a slot and bucket as lists in one row, with
    their last time."""
    def lists(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        slot, bucket = table["post_slot"].to_numpy(), table["bucket"].to_numpy()
        order = np.lexsort((bucket, slot))
        slot, bucket = slot[order], bucket[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (slot[1:] != slot[:-1]) | (bucket[1:] != bucket[:-1])
        starts = np.flatnonzero(first)
        place = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
        starts = np.flatnonzero(place % LINKS == 0)
        links = table.select(["word", "post_id", "post_ts"]).take(order).combine_chunks()
        ts = links["post_ts"].chunk(0)
        last = np.maximum.reduceat(ts.cast("int64").to_numpy(), starts)
        posts = pa.StructArray.from_arrays([c.chunk(0) for c in links.columns], links.column_names)
        ends = pa.array(np.append(starts, len(order)), "int32")
        return pa.RecordBatch.from_arrays(
            [pa.array(slot[starts]), pa.array(bucket[starts]), pa.array(last).cast(ts.type),
             pa.ListArray.from_arrays(ends, posts)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= HELD:
                yield lists(held)
                held, size = [], 0
        if held:
            yield lists(held)

    return run


def match_posts(posts: DataFrame, events: DataFrame, ttl: str = "24 hours",
                lateness: str = "10 minutes", salts: int = 1) -> DataFrame:
    """(post_id, post_ts, event_id) pairs of two streams; every pair once.

    The words of a post are cut into pieces of four characters, which meet the leading
    piece of each keyword in a time-bounded equi-join (a stream-stream join needs one);
    ``contains`` decides. Keywords need four characters or more and no white space.
    The time bound is also an equality on slots of its length, else a post would be compared with
    all keywords of its pieces that the state holds, whatever their time.

    A row of the state costs far more than a word, so the words of a micro-batch's posts are packed
    by slot and bucket of pieces before the join, up to ``LINKS`` in a row. A row is as old as its last
    post: a post that comes too late may still be matched together with later ones of its slot, and
    the state holds a keyword for two lengths of the time bound. So a common piece is few rows; posts
    can also be dealt over ``salts`` copies of the keywords.
    """
    width = F.unix_micros(F.expr(f"TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {ttl}"))

    def slot(ts: Column) -> Column:
        return F.floor(F.unix_micros(ts.cast("timestamp")) / width)

    def bucket(piece: Column) -> Column:
        return F.pmod(F.xxhash64(piece), F.lit(PIECE_BUCKETS))

    timed = posts.withWatermark("post_ts", lateness)
    fields = {f.name: f for f in timed.schema}

    def post_time(ts: str) -> Column:
        # The mark of a time with a watermark is in the column's metadata, which packing loses.
        return F.col(ts).alias("post_ts", metadata=fields["post_ts"].metadata)

    words = one_per_item(timed, F.array_distinct(F.split(F.lower("text"), lx.SPACES)), "word",
                         ["post_id", "post_ts"]).filter(F.col("post_ts").isNotNull())
    buckets = F.array_distinct(F.transform(pieces(F.col("word")), bucket))
    words = one_per_item(words, buckets, "bucket", [
        "post_id", "post_ts", "word", slot(F.col("post_ts")).alias("post_slot")])
    salt = F.pmod(F.xxhash64("post_id"), F.lit(salts))
    words = words.withColumn("bucket", F.col("bucket") + salt * PIECE_BUCKETS)
    link = T.StructType([T.StructField("word", T.StringType()), *[
        T.StructField(name, fields[name].dataType) for name in ("post_id", "post_ts")]])
    row = T.StructType([
        T.StructField("post_slot", T.LongType()), T.StructField("bucket", T.LongType()),
        T.StructField("post_ts", link["post_ts"].dataType), T.StructField("posts", T.ArrayType(link))])
    packed = words.repartition("post_slot", "bucket").mapInArrow(_packed(row.names), row)
    packed = packed.select("post_slot", "bucket", post_time("post_ts"), "posts")

    keywords = events.withWatermark("event_ts", lateness).select(
        "event_id", "event_ts", F.explode(F.array_distinct("keywords")).alias("k"))
    keywords = keywords.select("event_id", "event_ts", F.lower("k").alias("keyword")).filter(
        F.length("keyword") >= GRAM).withColumn("lead", bucket(F.substring("keyword", 1, GRAM)))
    copies = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    keywords = keywords.withColumn("lead", F.explode(
        F.transform(copies, lambda copy: F.col("lead") + copy * PIECE_BUCKETS)))
    keywords = keywords.withColumn("event_slot", F.explode(F.sequence(
        slot(F.col("event_ts")), slot(F.col("event_ts") + F.expr(f"INTERVAL {ttl}")))))
    # The last of a row's posts is less than a slot after any of them.
    met = packed.join(keywords, F.expr(
        f"bucket = lead AND post_slot = event_slot AND post_ts >= event_ts "
        f"AND post_ts < event_ts + INTERVAL {ttl} + INTERVAL {ttl}"))
    pairs = met.select("event_id", "event_ts", "keyword", F.explode("posts").alias("post")).filter(
        f"contains(post.word, keyword) AND post.post_ts >= event_ts "
        f"AND post.post_ts < event_ts + INTERVAL {ttl}")
    return pairs.select("post.post_id", "event_id", post_time("post.post_ts")
                        ).dropDuplicatesWithinWatermark(["post_id", "event_id"])


def latency_rows(stream: DataFrame, sent: str, received: Column | None = None) -> DataFrame:
    """Adds received time and milliseconds since ``sent``; null without a sent time."""
    now = F.current_timestamp() if received is None else received
    gap = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(sent).cast("timestamp"))
    return stream.withColumns({"received": now, "latency_ms": gap / 1000.0})


def running_latency(stream: DataFrame, level: str, value: str = "latency_ms") -> DataFrame:
    """Running figures per level from mergeable sums (an updating aggregate)."""
    return stream.groupBy(level).agg(
        F.count(value).alias("count"), F.avg(value).alias("avg_ms"), F.min(value).alias("min_ms"),
        F.max(value).alias("max_ms"))


def with_progress(stream: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """Counters that appear in each progress report of the query."""
    rows = F.count(F.lit(1)).alias("rows")
    return stream.observe(name, rows, *[c.alias(n) for n, c in metrics.items()])


def progress_totals(query: StreamingQuery, name: str) -> dict[str, int]:
    """The counters of ``with_progress``, added up over the reports that the query still holds
    (``spark.sql.streaming.numRecentProgressUpdates``, 100 unless set)."""
    totals: dict[str, int] = {}
    for report in query.recentProgress:
        counters = report.observedMetrics.get(name)
        for counter, value in (counters.asDict() if counters else {}).items():
            totals[counter] = totals.get(counter, 0) + value
    return totals
