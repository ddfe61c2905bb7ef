"""Event detection and matching of posts to active events (batch forms)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.normalize import entity_count
from newsloom.functions.text import (cluster_key, event_id, matching_keywords, negation_sentiment,
                                     plain_keywords, title_keywords)
from newsloom.functions.vector import cosine
from newsloom.operators.bounds import broadcast_if_small, compute_once, one_per_item
from newsloom.operators.components import roots
from newsloom.operators.entities import entity_groups
from newsloom.operators.matching import match_substrings
from newsloom.operators.ranking import running_rank, time_slot, top_per_group
from newsloom.schema import DETECTED_EVENT
from newsloom.session import materialize

MOST_ROWS, MOST_ROUNDS = 2048, 16  # rows that a group of merges has; rounds of merges

# --- events from embeddings --------------------------------------------------------


class LeaderClusters:
    """Running centroids of one key: a vector joins the most similar one or starts its own.

    Keeps sums and counts, so a centroid is the mean of its members and two sets of
    centroids can be merged.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.names: list = []
        self.sums: np.ndarray | None = None
        self.norms: np.ndarray | None = None  # of the sums: kept, not computed for each vector
        self.counts: list[float] = []

    def load(self, name, vector_sum: np.ndarray, count: float) -> None:
        vector_sum = np.asarray(vector_sum, dtype=float)
        if self.sums is None:
            self.sums, self.norms = np.empty((16, vector_sum.size)), np.empty(16)
        elif len(self.names) == len(self.sums):
            more = max(16, len(self.sums) // 4)
            self.sums = np.concatenate([self.sums, np.empty((more, vector_sum.size))])
            self.norms = np.concatenate([self.norms, np.empty(more)])
        self.sums[len(self.names)] = vector_sum
        self.norms[len(self.names)] = np.linalg.norm(vector_sum)
        self.names.append(name)
        self.counts.append(count)

    def best(self, vector: np.ndarray) -> tuple[int, float]:
        if not self.names:
            return -1, 0.0
        sums = self.sums[:len(self.names)]
        scale = self.norms[:len(sums)] * np.linalg.norm(vector)
        sims = np.divide(sums @ vector, scale, out=np.zeros(len(sums)), where=scale > 0)
        at = int(np.argmax(sims))
        return (at, float(sims[at])) if sims[at] > 0 else (-1, 0.0)

    def add(self, name, vector_sum: np.ndarray, count: float = 1.0) -> tuple[object, float, bool]:
        """(event name, similarity, is new)"""
        vector_sum = np.asarray(vector_sum, dtype=float)
        at, similarity = self.best(vector_sum)
        if at < 0 or similarity < self.threshold:
            self.load(name, vector_sum, count)
            return name, 0.0, True
        self.sums[at] += vector_sum
        self.norms[at] = np.linalg.norm(self.sums[at])
        self.counts[at] += count
        return self.names[at], similarity, False


def lsh_bucket(vector: Column, bits: int, dim: int, seed: int = 42) -> Column:
    """Signs of ``bits`` random projections as an integer; similar vectors often agree."""
    if bits == 0:
        return F.lit(0).cast("long")
    planes = np.random.default_rng(seed).standard_normal((dim, bits))
    weights = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf(T.LongType())
    def bucket(vectors: pd.Series) -> pd.Series:
        matrix = np.stack(vectors.to_numpy()).astype(float)
        return pd.Series(((matrix @ planes) > 0) @ weights)

    return bucket(vector)


def _leader_pass(rows: DataFrame, group: Sequence[str], order: Sequence[str],
                 threshold: float) -> DataFrame:
    """Assign each (id, vsum, n) row of a group, in order, to an event.

    Rows stream through the task in Arrow batches; a task holds centroids, not rows. Without a
    group one task sorts and assigns the rows, but does not compute them.
    """
    spread = rows.repartition(*group) if group else rows.repartition(1)
    ordered = spread.sortWithinPartitions(*group, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, clusters = None, LeaderClusters(threshold)
        for batch in batches:
            found = []
            keys = list(zip(*[batch[g] for g in group])) if group else [()] * len(batch)
            for key, name, vsum, n in zip(keys, batch["id"], batch["vsum"], batch["n"]):
                if key != current:
                    current, clusters = key, LeaderClusters(threshold)
                found.append(clusters.add(name, vsum, n))
            yield pd.DataFrame({
                "id": batch["id"], "event": [f[0] for f in found],
                "similarity": [f[1] for f in found], "is_new": [f[2] for f in found]})

    kind = dict(rows.dtypes)["id"]
    return ordered.mapInPandas(
        run, f"id {kind}, event {kind}, similarity double, is_new boolean")


def _in_chunks(rows: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Adds ``chunk``: the rows of a key with more than ``most`` are dealt over several by their id.

    Only the counts of such keys meet the rows, so no row moves for it if they are few.
    """
    if rows.select(F.lit(1)).limit(most + 1).count() <= most:  # then no key has more
        return rows.withColumn("chunk", F.lit(0).cast("long"))
    large = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > most)
    dealt = rows.join(broadcast_if_small(materialize(large, "large")), list(keys), "left")
    chunks = F.ceil(F.coalesce("__n", F.lit(1)) / most)
    return dealt.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks)).drop("__n")


def _event_sums(members: DataFrame) -> DataFrame:
    """One row per event of members(event, id, ts, n, vsum), as a member of the next pass: its id
    is the event's, its place that of the earliest member."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = Summarizer.mean(
        array_to_vector(F.transform("vsum", lambda x: x / F.col("n"))), F.col("n"))
    sums = members.groupBy("event").agg(
        mean.alias("m"), F.sum("n").alias("n"), F.min("ts").alias("ts"))
    return sums.select(F.col("event").alias("id"), "ts", "n",
                       F.transform(vector_to_array("m"), lambda x: x * F.col("n")).alias("vsum"))


def lsh_codes(vector: Column, tables: int, bits: int, seed: int) -> Column:
    """For each of several tables, the signs of that many random projections as an integer."""
    weights = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def codes(vectors: pd.Series) -> pd.Series:
        matrix = np.stack(vectors.to_numpy()).astype(float)
        planes = np.random.default_rng(seed).standard_normal((matrix.shape[1], tables * bits))
        signs = ((matrix @ planes) > 0).reshape(len(matrix), tables, bits)
        return pd.Series(list(signs @ weights))

    return codes(vector)


def merge_parts(parts: DataFrame, threshold: float, most: int = MOST_ROWS, seed: int = 42
                ) -> tuple[DataFrame, DataFrame]:
    """Events of parts (id, ts, n, vsum): the names (id, event), and the events as parts.

    A round deals the parts to several tables of buckets by random projections, so many that parts
    as similar as the threshold asks share a bucket of some table in 19 of 20 cases. In a bucket the
    rule is applied in the order of time; a bucket of more than ``most`` parts takes more
    projections, and parts that these leave together are dealt over chunks. Each part then follows
    the most similar earlier one that it met, chains are put together, and the events are the next
    round's parts, with other projections. Rounds end when one compares all parts with each other or
    joins less than one part in a hundred. No group has more than about ``most`` parts.
    """
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    names, before = parts.select("id", F.col("id").alias("event")), parts.count()
    for turn in range(MOST_ROUNDS):
        bits = max(0, math.ceil(math.log2(max(1, before) / most)))
        if bits:
            tables, extra = math.ceil(3 / agree ** bits), 12
            codes = lsh_codes(F.col("vsum"), tables, bits + extra, seed + turn)
            dealt = parts.select("id", "ts", "n", "vsum", F.posexplode(codes).alias("table", "code"))
            dealt = dealt.withColumn("bucket", F.pmod("code", F.lit(1 << bits)))
            sizes = parts.select(F.posexplode(codes).alias("table", "code")).groupBy(
                "table", F.pmod("code", F.lit(1 << bits)).alias("bucket")).agg(F.count("*").alias("size"))
            sizes = sizes.filter(F.col("size") > most).select(
                "table", "bucket", F.least(F.lit(extra), F.ceil(F.log2(F.col("size") / most)))
                .cast("int").alias("more"))
            dealt = dealt.join(broadcast_if_small(materialize(sizes, "sizes")), ["table", "bucket"], "left")
            wide = F.lit(bits) + F.coalesce("more", F.lit(0))
            dealt = dealt.withColumn("bucket", F.pmod(F.col("code"), F.pow(F.lit(2), wide).cast("long")))
            dealt = _in_chunks(dealt.drop("code", "more"), ["table", "bucket"], 2 * most)
            group = ["table", "bucket", "chunk"]
        else:
            dealt = parts.select("*", F.lit(0).alias("table"))
            group = ["table"]
        met = _leader_pass(dealt, group, ["ts", "id"], threshold).filter("NOT is_new")
        if bits:
            followed = materialize(met.groupBy("id").agg(F.max_by(
                "event", F.struct("similarity", "event")).alias("parent")), "followed")
            ends = roots(followed, "id", "parent")
        else:  # one pass over all: what a part joins has joined nothing
            ends = materialize(met.select("id", F.col("event").alias("root")), "followed")
        joined = parts.join(ends.select("id", F.col("root").alias("event")), "id", "left")
        parts = materialize(_event_sums(joined.withColumn(
            "event", F.coalesce("event", "id"))), "parts")
        into = ends.select(F.col("id").alias("event"), "root")
        names = names.join(into, "event", "left").select(
            "id", F.coalesce("root", "event").alias("event"))
        if not bits:
            break
        after = parts.count()
        if after > 0.99 * before:
            break
        before = after
    return names, parts


def semantic_events(vectors: DataFrame, threshold: float = 0.75, lsh_bits: int = 12,
                    slot_seconds: float | None = 3600.0, dim: int = 384,
                    seed: int = 42, most: int = MOST_ROWS) -> DataFrame:
    """Assign each (id, ts, vector) to an event: (id, event, similarity, is_new).

    ``event`` is the id of the article that started the event. Articles meet first within
    time slots of buckets of similar vectors (of ``most`` rows or so), which may split an event.
    ``merge_parts`` puts its parts together by their centroids; no pass is one task's.

    ``similarity`` is that to the event's centroid over all its articles, and 0 for the article
    that started it (``is_new``). ``lsh_bits=0, slot_seconds=None`` is the rule applied to one
    global sequence, by its nature one task; there ``similarity`` is that on arrival. Rows
    without a vector belong to no event and are left out.
    """
    rows = event_members(vectors)
    if not lsh_bits and slot_seconds is None:
        return _leader_pass(rows, [], ["ts", "id"], threshold)
    local, parts = local_events(rows, threshold, lsh_bits, slot_seconds, dim, seed, most)
    names, parts = merge_parts(parts, threshold, most, seed)
    names = names.select(F.col("id").alias("local"), "event")
    events = names.join(parts.select(F.col("id").alias("event"), F.col("vsum").alias("centroid")),
                        "event")
    found = local.withColumnRenamed("event", "local").join(events, "local").join(
        rows.select("id", "vsum"), "id")
    is_new = F.col("id") == F.col("event")
    likeness = cosine(F.col("vsum"), F.col("centroid"))
    return found.select("id", "event", F.when(is_new, 0.0).otherwise(likeness).alias("similarity"),
                        is_new.alias("is_new"))


def event_members(vectors: DataFrame) -> DataFrame:
    """(id, ts, vsum, n): each (id, ts, vector) with a vector, as an event of one article."""
    return vectors.filter(F.col("vector").isNotNull()).select(
        "id", "ts", F.col("vector").cast("array<double>").alias("vsum"), F.lit(1.0).alias("n"))


def local_events(rows: DataFrame, threshold: float, lsh_bits: int, slot_seconds: float | None,
                 dim: int, seed: int = 42, most: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Events within slots of buckets: the names (id, event), and the events as parts."""
    slot = F.lit(0) if slot_seconds is None else time_slot(F.col("ts"), slot_seconds)
    keyed = rows.withColumns({"bucket": lsh_bucket(F.col("vsum"), lsh_bits, dim, seed), "slot": slot})
    keyed = _in_chunks(keyed, ["bucket", "slot"], most)
    local = materialize(_leader_pass(keyed, ["bucket", "slot", "chunk"], ["ts", "id"], threshold)
                        .select("id", "event"), "local")
    return local, materialize(_event_sums(local.join(rows, "id")), "parts")


def event_records(assigned: DataFrame, articles: DataFrame) -> DataFrame:
    """The record of each detected event, as ``schema.DETECTED_EVENT``.

    ``assigned`` comes from ``semantic_events``; ``articles(id, ts, vector, title, source)``
    may lack the source.
    """
    source = F.col("source") if "source" in articles.columns else F.lit(None)
    told = articles.select("id", "title", "vector", F.col("ts").alias("timestamp"),
                           F.coalesce(source, F.lit("Unknown")).alias("source"))
    founders = assigned.filter("is_new").join(told, "id")
    named = founders.withColumns({"event_id": event_id(F.col("event")),
                                  "keywords": title_keywords(F.coalesce("title", F.lit("")))})
    return named.select([F.col(f.name).cast(f.dataType) for f in DETECTED_EVENT])


# --- events from keywords ------------------------------------------------------------

def keyword_clusters(articles: DataFrame, id: str = "id", ts: str = "published_at",
                     text: Sequence[str] = ("title", "description", "content"),
                     carry: Sequence[str] = ()) -> DataFrame:
    """(id, ts, keywords, cluster_key, carried…) of articles with two keywords or more."""
    present = [c for c in text if c in articles.columns]
    keyed = compute_once(articles,
                         keywords=plain_keywords(F.concat_ws(" ", *present)))
    keyed = keyed.select(F.col(id).alias("id"), F.col(ts).alias("ts"), *carry, "keywords")
    return keyed.filter(F.size("keywords") >= 2).withColumn(
        "cluster_key", cluster_key(F.col("keywords")))


def keyword_event_births(articles: DataFrame, size: int = 3,
                         carry: Sequence[str] = ("title", "source", "url"), **columns
                         ) -> DataFrame:
    """One event per keyword group that reaches ``size`` articles, as of that article.

    ``carry`` names what an initial article shows, as far as the articles have it.

    The window keeps at most ``size`` rows per group before the shuffle, and the lists
    hold ``size`` entries.
    """
    carry = [c for c in carry if c in articles.columns]
    clusters = keyword_clusters(articles, carry=carry, **columns)
    first = top_per_group(clusters, ["cluster_key"], ["ts", "id"], size, rank="n")
    initial = F.struct("n", *carry)
    births = first.groupBy("cluster_key").agg(
        F.max("n").alias("article_count"), F.max_by("keywords", "n").alias("keywords"),
        F.max("ts").alias("first_seen"), F.max_by("id", "n").alias("seed"),
        F.array_sort(F.collect_list(initial)).alias("initial_articles"))
    return births.filter(F.col("article_count") == size).withColumn(
        "event_id", F.concat(F.lit("event_"), "cluster_key"))


def keyword_event_updates(articles: DataFrame, size: int = 3, **columns) -> DataFrame:
    """One update per article after the ``size``-th of its keyword group."""
    # Ranges are cut by a sample: let that read the written keys, not the texts.
    clusters = materialize(keyword_clusters(articles, **columns), "clusters")
    ranked = running_rank(clusters, ["cluster_key"], "ts", ["id"], rank="article_count",
                          first="first_seen")
    return ranked.filter(F.col("article_count") > size).select(
        F.concat(F.lit("event_"), "cluster_key").alias("event_id"), "id", "ts", "keywords",
        "article_count", "first_seen", "cluster_key", F.lit(True).alias("event_update"))


# --- posts and events ------------------------------------------------------------------

def match_posts(posts: DataFrame, events: DataFrame, ttl_seconds: int = 86_400,
                post_key: Sequence[str] = ("post_id",)) -> DataFrame:
    """(post_key…, post_ts, event_id, matched_keywords) for posts(post_key…, post_ts, text)
    and events(event_id, event_ts, keywords).

    A post matches an event that started at most ``ttl_seconds`` before it if its text
    contains a keyword. Substrings are matched per distinct word (see ``matching``);
    the time bound is an equality on the slot of the TTL's length plus the exact test,
    so a common keyword only meets the events of two slots.
    """
    active = events.filter(F.col("event_id").isNotNull())
    keywords = one_per_item(active, F.array_distinct(F.transform("keywords", lambda k: F.lower(k))),
                            "keyword", ["event_id", "event_ts"])
    keywords = materialize(keywords, "keywords")  # read three times below
    keys = [*post_key, "post_ts"]
    found = match_substrings(posts.filter(F.col("text") != ""), keys, "text", keywords, "keyword")

    slot = time_slot(F.col("event_ts"), ttl_seconds)
    found = found.withColumn("slot", time_slot(F.col("post_ts"), ttl_seconds))
    spans = keywords.withColumn("slot", F.explode(F.array(slot, slot + 1)))
    age = (F.unix_micros(F.col("post_ts").cast("timestamp"))
           - F.unix_micros(F.col("event_ts").cast("timestamp")))
    joined = found.join(spans, ["keyword", "slot"]).filter(
        (age >= 0) & (age < ttl_seconds * 1_000_000))
    return joined.groupBy(*keys, "event_id").agg(
        F.array_sort(F.collect_set("keyword")).alias("matched_keywords"))


def enrich_matches(matches: DataFrame, posts: DataFrame, events: DataFrame,
                   post_key: Sequence[str] = ("post_id",), positive: Sequence[str] | None = None,
                   negative: Sequence[str] | None = None, mentions: DataFrame | None = None,
                   per_group: int = 5) -> DataFrame:
    """One document per matched (post, event) with keywords in the event's own order.

    ``mentions(post_key…, text, label)`` are the entities of the posts, from a model or
    a gazetteer; they become ``entities`` (persons, organizations, locations). Posts without
    any have empty lists. ``enriched_at`` is the time of the run.
    """
    kinds = ("persons", "organizations", "locations")
    none = F.array().cast("array<string>")
    lists = {k: v for k, v in (("positive", positive), ("negative", negative)) if v is not None}
    titles = events.select("event_id", F.col("title").alias("event_title"), "keywords")
    optional = {"platform": F.lit("Unknown"), "user": F.lit("Unknown"),
                "location": F.lit("Unknown"), "likes": F.lit(0).cast("long"),
                "retweets": F.lit(0).cast("long")}
    details = posts.select(*post_key, "text", *[
        (F.coalesce(F.col(c), d) if c in posts.columns else d).alias(c)
        for c, d in optional.items()],
        negation_sentiment(F.col("text"), **lists)["score"].alias("sentiment"))
    if mentions is not None:
        found = entity_groups(mentions, post_key, per_group)
        details = details.join(found, list(post_key), "left")
    lists = [F.coalesce(F.col(k), none) if mentions is not None else none for k in kinds]
    details = details.withColumn("entities", F.struct(*[v.alias(k) for v, k in zip(lists, kinds)]))
    # Titles first: a post's text then moves once, not once for each event that it matches.
    return matches.drop("matched_keywords").join(titles, "event_id").join(
        details, list(post_key)).select(
        "event_id", "event_title", *post_key, "post_ts",
        matching_keywords(F.col("text"), F.col("keywords")).alias("matched_keywords"),
        F.col("text").alias("social_text"), "platform", "user", "location", "sentiment",
        "entities", "likes", "retweets", F.current_timestamp().alias("enriched_at"))


def event_badge(entities: Column) -> Column:
    return F.when(entity_count(entities) >= 3, "event").otherwise("")
