"""Operators against brute force on small fixtures, with skewed groups and edge rows."""

import datetime as dt
import itertools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import (boards, dedup, entities, events, graph, matching, metrics, ranking,
                                sentiment, timeseries, vectors)
from newsloom.session import materialize

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


# --- ranking -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def skewed():
    """300 rows, two thirds under one key, many equal times."""
    rnd = random.Random(1)
    return [(i, "hot" if i % 3 else f"k{rnd.randrange(20)}", at(rnd.randrange(0, 9000, 50)),
             rnd.random()) for i in range(300)]


@pytest.fixture(scope="module")
def skewed_df(spark, skewed):
    return spark.createDataFrame(skewed, "id long, k string, ts timestamp, v double")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_running_rank(skewed, skewed_df):
    out = ranking.running_rank(skewed_df, ["k"], "ts", ["id"], first="first")
    want = {r[0]: (n, rows[0][2]) for rows in by_key(skewed).values()
            for n, r in enumerate(rows, 1)}
    assert {r["id"]: (r["rank"], r["first"]) for r in out.collect()} == want


def test_running_sum(spark, skewed):
    rows = [(k, at(i * 100), float(i)) for k in ("a", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    out = ranking.running_sum(df, ["k"], "ts", "v", "total", slot_seconds=700)
    want = {(k, t): sum(range(int(v) + 1)) for k, t, v in rows}
    assert {(r["k"], r["ts"]): r["total"] for r in out.collect()} == want


def test_top_per_group_limits_before_the_shuffle(skewed, skewed_df, capsys):
    out = ranking.top_per_group(skewed_df, ["k"], ["ts", "id"], 2, rank="n")
    want = {(k, n): r[0] for k, rows in by_key(skewed).items() for n, r in enumerate(rows[:2], 1)}
    assert {(r["k"], r["n"]): r["id"] for r in out.collect()} == want
    out.explain()
    assert "row_number(), 2, Partial" in capsys.readouterr().out


@pytest.mark.parametrize("accuracy", [20, 100_000])
def test_exact_median(spark, accuracy):
    rnd = random.Random(2)
    groups = {"one": [3.0], "two": [1.0, 4.0], "ties": [5.0] * 40 + [1.0],
              "even": [rnd.gauss(0, 1) for _ in range(400)],
              "odd": [float(rnd.randrange(50)) for _ in range(401)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("even", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["median"] for r in ranking.exact_median(df, "k", "v", accuracy=accuracy)
           .collect()}
    assert got == pytest.approx({k: statistics.median(vs) for k, vs in groups.items()})


# --- duplicates --------------------------------------------------------------------

def test_latest_per_title(spark):
    df = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(5)), (3, "a", at(5)), (4, "b", at(1))],
                               "id long, title string, ts timestamp")
    assert sorted(r["id"] for r in dedup.latest_per_title(df, "ts", "id").collect()) == [2, 4]


def test_first_per_window(spark):
    df = spark.createDataFrame([(1, "u", at(0)), (2, "u", at(3599)), (3, "u", at(3600))],
                               "id long, url string, ts timestamp")
    got = dedup.first_per_window(df, "url", "ts", 3600, "id")
    assert sorted(r["id"] for r in got.collect()) == [1, 3]


def test_only_new(spark):
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1)], "id string, n int")
    sink = spark.createDataFrame([("a",), ("z",)], "id string")
    got = dedup.only_new(batch, sink, "id", ["n"]).collect()
    assert [tuple(r) for r in got] == [("b", 1)]


# --- matching ----------------------------------------------------------------------

def test_match_substrings_equals_brute_force(spark):
    rnd = random.Random(3)
    letters = "abcde"
    def word():
        return "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rnd.randint(0, 12))) for _ in range(60)]
    texts += ["Reserve bank OF india", "reserve bank", "the reservebank", ""]
    patterns = {word() for _ in range(40)} | {"reserve bank", "BANK", "a", "ab c", "serve  bank"}
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pats = spark.createDataFrame([(p,) for p in patterns] + [(" ",)], "p string")
    got = {tuple(r) for r in matching.match_substrings(docs, ["id"], "text", pats, "p").collect()}
    want = {(i, p) for i, t in enumerate(texts) for p in patterns if p.lower() in t.lower()}
    assert got == want


def test_match_substrings_without_phrases_and_without_hints(spark, monkeypatch):
    from newsloom.operators import bounds

    monkeypatch.setattr(matching, "small_or_merge", lambda df: bounds.small_or_merge(df, 0))
    docs = spark.createDataFrame([(1, "forward march"), (2, "peace")], "id long, text string")
    pats = spark.createDataFrame([("ward",), ("arch",), ("none",)], "p string")
    got = {tuple(r) for r in matching.match_substrings(docs, ["id"], "text", pats, "p").collect()}
    assert got == {(1, "ward"), (1, "arch")}


def test_match_posts_time_bound(spark):
    posts = spark.createDataFrame(
        [(1, at(-1), "storm warning"), (2, at(0), "STORMS here"), (3, at(86_399), "a storm"),
         (4, at(86_400), "storm"), (5, at(10), "calm"), (6, at(10), "")],
        "post_id long, post_ts timestamp, text string")
    ev = spark.createDataFrame(
        [("e1", at(0), "T", ["storm", "Warning"]), ("e2", at(5), "T", []),
         (None, at(0), "T", ["calm"]), ("e3", at(0), "T", ["here"])],
        "event_id string, event_ts timestamp, title string, keywords array<string>")
    got = {(r["post_id"], r["event_id"]): r["matched_keywords"]
           for r in events.match_posts(posts, ev).collect()}
    assert got == {(2, "e1"): ["storm"], (2, "e3"): ["here"], (3, "e1"): ["storm"]}


def test_enrich_matches_defaults(spark):
    posts = spark.createDataFrame([(1, at(0), "win win storm", None, 7)],
                                  "post_id long, post_ts timestamp, text string, user string, "
                                  "likes long")
    ev = spark.createDataFrame([("e1", at(0), "T", ["Storm", "win"])],
                               "event_id string, event_ts timestamp, title string, "
                               "keywords array<string>")
    found = events.match_posts(posts, ev)
    row = events.enrich_matches(found, posts, ev).first()
    assert row["entities"].asDict() == {"persons": [], "organizations": [], "locations": []}
    named = spark.createDataFrame([(1, "Rao", "PERSON"), (1, "Pune", "GPE")],
                                  "post_id long, text string, label string")
    known = events.enrich_matches(found, posts, ev, mentions=named).first()["entities"]
    assert known.asDict() == {"persons": ["Rao"], "organizations": [], "locations": ["Pune"]}
    assert row["enriched_at"] is not None
    assert row["matched_keywords"] == ["Storm", "win"]
    assert (row["user"], row["platform"], row["likes"], row["retweets"]) == ("Unknown", "Unknown",
                                                                             7, 0)
    assert row["sentiment"] == pytest.approx(0.3)


# --- events ------------------------------------------------------------------------

def leader(vectors_, threshold):
    """The sequential rule, written out."""
    cents, out = [], {}
    for i, v in vectors_:
        sims = [float(np.dot(s / n, v) / (np.linalg.norm(s / n) * np.linalg.norm(v)))
                for _, s, n in cents]
        best = max(range(len(sims)), key=lambda j: sims[j], default=None)
        if best is None or sims[best] < threshold or sims[best] <= 0:
            cents.append([i, v.copy(), 1])
            out[i] = i
        else:
            cents[best][1] += v
            cents[best][2] += 1
            out[i] = cents[best][0]
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((6, 8)) * 3
    return [(i, centers[i % 6] + rng.standard_normal(8) * 0.6) for i in range(120)]


@pytest.fixture(scope="module")
def points_df(spark, points):
    return spark.createDataFrame([(i, at(i * 60), [float(x) for x in v]) for i, v in points],
                                 "id long, ts timestamp, vector array<double>")


def test_semantic_events_exact(points, points_df):
    got = events.semantic_events(points_df, 0.75, 0, None).collect()
    want = leader(points, 0.75)
    assert {r["id"]: r["event"] for r in got} == want
    assert {r["id"] for r in got if r["is_new"]} == set(want.values())


def test_semantic_events_split_covers_every_row(points, points_df):
    got = events.semantic_events(points_df, 0.75, lsh_bits=2, slot_seconds=1800, dim=8).collect()
    assert sorted(r["id"] for r in got) == [i for i, _ in points]
    assert {r["event"] for r in got if r["is_new"]} == {r["event"] for r in got}
    # Slots without buckets merge back to few events: the groups are well apart.
    merged = events.semantic_events(points_df, 0.75, 0, 1800).collect()
    assert len({r["event"] for r in merged}) == len(set(leader(points, 0.75).values()))


@pytest.mark.parametrize("noise", [0.3, 0.5])
def test_semantic_events_default_split_finds_the_rules_events(spark, noise):
    rng = np.random.default_rng(11)
    centers = rng.standard_normal((40, 384))
    rows = [(str(i), centers[i % 40] + rng.standard_normal(384) * noise) for i in range(800)]
    df = spark.createDataFrame([(i, at(60 * int(i)), [float(x) for x in v]) for i, v in rows]
                               + [("none", at(0), None)],
                               "id string, ts timestamp, vector array<double>")
    exact = len({r["event"] for r in events.semantic_events(df, 0.75, 0, None).collect()})
    got = events.semantic_events(df).collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, _ in rows)
    found = {r["event"] for r in got}
    assert abs(len(found) - exact) <= 0.05 * exact
    assert {r["id"] for r in got if r["is_new"]} == found
    assert all((r["similarity"] == 0) == r["is_new"] for r in got)


def test_event_records(spark):
    from newsloom.schema import DETECTED_EVENT

    df = spark.createDataFrame(
        [("a", at(0), [1.0, 0.0], "Storm hits coastal town", "x"),
         ("b", at(5), [1.0, 0.1], "Storm again", "y"), ("c", at(9), [0.0, 1.0], None, None)],
        "id string, ts timestamp, vector array<double>, title string, source string")
    out = events.event_records(events.semantic_events(df, dim=2), df)
    assert [f.name for f in out.schema] == [f.name for f in DETECTED_EVENT]
    got = {r["source"]: r for r in out.collect()}
    assert set(got) == {"x", "Unknown"}
    assert got["x"]["title"] == "Storm hits coastal town" and "storm" in got["x"]["keywords"]
    assert got["x"]["is_new"] and got["x"]["similarity"] == 0.0


def test_keyword_births_and_updates(spark):
    same = "markets rally after budget speech today"
    rows = [(i, at(i), same, "s") for i in range(5)] + [(9, at(9), "tiny", "s")] + \
        [(20 + i, at(i), "floods strike coastal villages again", "s") for i in range(2)]
    df = spark.createDataFrame(rows, "id long, published_at timestamp, title string, source string")
    births = events.keyword_event_births(df).collect()
    assert [(b["seed"], b["article_count"], b["first_seen"]) for b in births] == [(2, 3, at(2))]
    assert [a["n"] for a in births[0]["initial_articles"]] == [1, 2, 3]
    updates = events.keyword_event_updates(df).collect()
    assert sorted((u["id"], u["article_count"], u["first_seen"]) for u in updates) == \
        [(3, 4, at(0)), (4, 5, at(0))]
    assert {u["event_id"] for u in updates} == {births[0]["event_id"]}


# --- graph -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def lists():
    rnd = random.Random(7)
    names = [f"n{i:02d}" for i in range(40)]
    out = [[rnd.choice(names) for _ in range(rnd.randint(0, 9))] for _ in range(60)]
    out.append([rnd.choice(names) for _ in range(700)])          # one very long list
    out.append([f"x{i}" for i in range(400)])                     # long, names seen once
    return out


@pytest.fixture(scope="module")
def lists_df(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "id long, names array<string>")


def brute_weights(lists):
    weights = {}
    for names in lists:
        for a, b in itertools.combinations(names, 2):
            key = tuple(sorted((a, b)))
            weights[key] = weights.get(key, 0) + 1
    return weights


def brute_degrees(lists):
    degree = {}
    for (a, b), w in brute_weights(lists).items():
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
    return degree


def test_entity_pairs(spark, lists, lists_df):
    short = [x for x in lists if len(x) < 20]
    df = lists_df.filter(F.size("names") < 20)
    got = sorted(tuple(r) for r in graph.entity_pairs(df, "names").collect())
    assert got == sorted(p for x in short for p in itertools.combinations(x, 2))


def test_edge_weights_across_blocks(lists, lists_df):
    got = {(r["src"], r["dst"]): r["weight"]
           for r in graph.edge_weights(lists_df, "id", "names").collect()}
    assert got == brute_weights(lists)


def test_weighted_degree_without_edges(lists, lists_df):
    got = {r["entity"]: r["degree"] for r in graph.weighted_degree(lists_df, "names").collect()}
    assert got == brute_degrees(lists)


def test_top_subgraph(lists, lists_df):
    top, edges = graph.top_subgraph(lists_df, "id", "names", 7)
    degree = brute_degrees(lists)
    best = sorted(degree, key=lambda e: (-degree[e], e))[:7]
    assert sorted(r["entity"] for r in top.collect()) == sorted(best)
    want = {k: w for k, w in brute_weights(lists).items() if set(k) <= set(best)}
    assert {(r["src"], r["dst"]): r["weight"] for r in edges.collect()} == want


def test_article_edges(lists, lists_df):
    count = {}
    for names in lists:
        for n in names:
            count[n] = count.get(n, 0) + 1
    want = {}
    for names in lists:
        kept = sorted({n for n in names if count[n] >= 5})
        for pair in itertools.combinations(kept, 2):
            want[pair] = want.get(pair, 0) + 1
    want = {k: w for k, w in want.items() if w >= 3}
    got = {(r["src"], r["dst"]): r["weight"]
           for r in graph.article_edges(lists_df, "id", "names").collect()}
    assert got == want


def test_article_edges_self_loops(spark):
    df = spark.createDataFrame([(i, ["a", "a", "b"]) for i in range(3)], "id long, n array<string>")
    got = {(r["src"], r["dst"]): r["weight"]
           for r in graph.article_edges(df, "id", "n", 1, 3, self_loops=True).collect()}
    assert got == {("a", "b"): 3, ("a", "a"): 3}


def test_prune_and_centrality(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 3), ("c", "a", 3), ("a", "leaf", 3),
                                   ("a", "loud", 3), ("p", "q", 3)],
                                  "src string, dst string, weight long")
    mentions = spark.createDataFrame(
        [("a", 20), ("b", 5), ("c", 5), ("leaf", 9), ("loud", 10), ("p", 3), ("q", 50)],
        "entity string, mentions long")
    nodes, left = graph.prune_leaves(edges, mentions)
    got = {r["entity"]: r["degree"] for r in nodes.collect()}
    assert got == {"a": 3, "b": 2, "c": 2, "loud": 1, "q": 0}  # q stays, its neighbour went
    assert left.count() == 4
    central = {r["entity"]: r["centrality"] for r in graph.degree_centrality(nodes).collect()}
    assert central["a"] == pytest.approx(3 / 4) and central["q"] == 0.0


def test_entity_types_majority(spark):
    df = spark.createDataFrame([("X", "ORG"), ("X", "GPE"), ("X", "GPE"), ("Y", "PERSON"),
                                ("Y", "ORG")], "text string, label string")
    assert {r["entity"]: r["label"] for r in graph.entity_types(df).collect()} == \
        {"X": "GPE", "Y": "ORG"}


# --- entities ----------------------------------------------------------------------

def test_validate_entities(spark):
    rows = [("RBI", "ORG"), ("RBI Governor Das", "PERSON"), ("Lorem Corp", "ORG"), ("Acme", "ORG"),
            ("Acme Steel", "ORG"), ("John Smith", "PERSON"), ("Delhi", "LOC"), ("UN", "ORG"),
            ("G20 Summit", "ORG"), ("The", "GPE"), (" Mumbai ", "GPE")]
    df = spark.createDataFrame(rows, "text string, label string")
    got = {r["text"] for r in entities.validate_entities(df).collect()}
    assert got == {"RBI", "RBI Governor Das", "Acme Steel", "Mumbai"}
    flagged = df.withColumn("is_proper_noun", F.col("text") != "RBI")
    assert "RBI" not in {r["text"] for r in entities.validate_entities(flagged).collect()}


def test_entity_groups(spark):
    rows = [(1, f"p{i}", "PERSON") for i in range(7)] + [(1, "o", "ORG"), (1, "o", "ORG"),
                                                         (1, "pr", "PRODUCT"), (2, "x", "EVENT")]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    row = entities.entity_groups(df, "id").first()
    assert row["persons"] == ["p0", "p1", "p2", "p3", "p4"]
    assert (row["organizations"], row["locations"]) == (["o", "pr"], [])


def test_drop_generic(spark):
    df = spark.createDataFrame([("World", "ORG"), ("X", "GPE"), ("Bihar", "GPE"), ("Tata", "ORG"),
                                ("Cup", "PRODUCT")], "text string, label string")
    assert {(r["text"], r["role"]) for r in entities.drop_generic(df).collect()} == \
        {("Bihar", "location"), ("Tata", "entity")}


def test_top_entities_ties_by_name(spark):
    df = spark.createDataFrame([(["b", "a"],), (["b", "a", "c"],), ([],), (None,)],
                               "e array<string>")
    got = [tuple(r) for r in entities.top_entities(df, "e", 2).collect()]
    assert got == [("a", 2), ("b", 2)]


# --- sentiment ---------------------------------------------------------------------

def test_rebalance_only_if_mostly_neutral(spark):
    def run(labels):
        df = spark.createDataFrame([(i, "crisis", s, 0.0) for i, s in enumerate(labels)],
                                   "id long, text string, sentiment string, sentiment_score double")
        return [(r["sentiment"], r["sentiment_score"])
                for r in sentiment.rebalance(df, "text").orderBy("id").collect()]

    assert run(["neutral"] * 4 + ["positive"]) == [("neutral", 0.0)] * 4 + [("positive", 0.0)]
    assert run(["neutral"] * 9 + ["positive"]) == [("negative", -0.4)] * 10


def test_compound_score_keeps_texts_without_hits(spark):
    valence = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "word string, valence double")
    df = spark.createDataFrame([(1, "Good, good!"), (2, "none"), (3, ""), (4, None)],
                               "id long, text string")
    got = {r["id"]: r["compound"] for r in sentiment.compound_score(df, "id", "text", valence)
           .collect()}
    s = 3.8
    assert got == pytest.approx({1: s / (s * s + 15) ** 0.5, 2: 0.0, 3: 0.0, 4: 0.0})


# --- vectors -----------------------------------------------------------------------

def test_cosine_edges(spark):
    from newsloom.functions.vector import cosine

    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 2.0], [1.0, 2.0]),
                                ([1.0, 0.0], [-2.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0.0, 1.0, -1.0])


@pytest.mark.parametrize("limit", [0, 4096])
def test_nearest_centroid_both_ways(spark, points, points_df, monkeypatch, limit):
    monkeypatch.setattr(vectors, "MAX_LOCAL_CENTROIDS", limit)
    cents = points[:9]
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in cents] + [(99, [0.0] * 8)],
                                "id long, centroid array<double>")
    got = {r["id"]: (r["centroid_id"], r["similarity"])
           for r in vectors.nearest_centroid(points_df, "id", "vector", cdf).collect()}
    for i, v in points:
        sims = {j: float(v @ c / np.linalg.norm(v) / np.linalg.norm(c)) for j, c in cents}
        best = max(sims, key=lambda j: (sims[j], -j))
        want = (best, sims[best]) if sims[best] > 0 else (None, 0.0)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1])


@pytest.mark.parametrize("limit", [0, 1, 4096])
def test_nearest_centroid_odd_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(vectors, "MAX_LOCAL_CENTROIDS", limit)
    big = 2 ** 53 + 1
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (None, [1.0, 0.0]),
            (3, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    cents = spark.createDataFrame([(big, [2.0, 0.0]), (7, [0.0, 1.0]), (8, None)],
                                  "id long, centroid array<double>")
    got = sorted((tuple(r) for r in vectors.nearest_centroid(df, "k", "v", cents).collect()),
                 key=str)
    assert got == sorted([(1, big, 1.0), (1, big, 1.0), (1, 7, 1.0), (2, None, 0.0),
                          (None, big, 1.0), (3, None, 0.0)], key=str)


def test_centroid_index_is_exact_and_meets_few_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MAX_LOCAL_CENTROIDS", 100)
    rng = np.random.default_rng(3)
    topics = rng.standard_normal((60, 16))
    cents = (topics[rng.integers(0, 60, 3000)] + 0.1 * rng.standard_normal((3000, 16)))
    cents[1000:1010] = cents[0]  # ties: the least id counts
    rows = topics[rng.integers(0, 60, 500)] + 0.1 * rng.standard_normal((500, 16))
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cents)], "id long, centroid array<double>")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*rows, cents[0]])], "no long, v array<double>")
    got = {r["no"]: r["centroid_id"] for r in vectors.nearest_centroid(df, "no", "v", cdf).collect()}
    unit = cents / np.linalg.norm(cents, axis=1, keepdims=True)
    want = dict(enumerate((rows @ unit.T).argmax(axis=1).tolist()))
    assert got == want | {500: 0}
    index = vectors.CentroidIndex(cdf)
    near = index.nearest(df, index.first_cell("v"))
    more = df.join(near, "no").select(F.size(index.other_cells("v", -F.col("best.neg"))).alias("n"))
    assert 1 + more.agg(F.avg("n")).first()[0] < 0.05 * len(index.radii) + 1


def test_nearest_centroid_without_centroids(spark, points_df):
    none = spark.createDataFrame([], "id long, centroid array<double>")
    row = vectors.nearest_centroid(points_df, "id", "vector", none).first()
    assert row["centroid_id"] is None and row["similarity"] == 0.0


def test_centroid_merge_is_order_independent(points_df):
    whole = vectors.centroids(points_df, "vector").first()
    parts = vectors.centroids(points_df.withColumn("g", F.col("id") % 7), "vector", ["g"])
    merged = vectors.merge_means(parts).first()
    assert merged["n"] == whole["n"]
    assert merged["centroid"] == pytest.approx(whole["centroid"])


def test_drift(spark):
    a = spark.createDataFrame([([1.0, 0.0],)], "v array<double>")
    b = spark.createDataFrame([([0.0, 1.0],)], "v array<double>")
    assert tuple(vectors.set_drift(a, b, "v").first()) == (1.0, "high")
    assert vectors.set_drift(a, a, "v").first()["band"] == "stable"


def test_drift_series_skips_thin_buckets(spark):
    h = 3600
    rows = [(at(0), [1.0, 0.0]), (at(60), [1.0, 0.0]), (at(5 * h), [0.0, 1.0]),
            (at(9 * h), [0.0, 1.0]), (at(9 * h + 1), [0.0, 1.0])]
    df = spark.createDataFrame(rows, "ts timestamp, v array<double>")
    got = [(r["bucket"], r["n"], r["drift"]) for r in vectors.drift_series(df, "ts", "v").collect()]
    assert got == [(at(8 * h), 2, 1.0)]


def test_confidence(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (1.0,)], "distance double")
    assert [r["confidence"] for r in vectors.with_confidence(df).collect()] == [1.0, 0.0, 0.5]
    zero = spark.createDataFrame([(0.0,)], "distance double")
    assert vectors.with_confidence(zero).first()["confidence"] == 1.0


TEXTS = ["The Cat sat, the cat_9 sat!", "ΟΔΟΣ ÀÉ école x y", None, "", "don't Don't a b", "नमस्ते दुनिया दुनिया", "cat dog dog"]


def test_tfidf_is_that_of_the_ml_stages_in_one_pass(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer, StopWordsRemover
    from pyspark.ml.functions import vector_to_array

    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text or ""

    raw = spark.createDataFrame(list(enumerate(TEXTS)), "id int, raw string").coalesce(1)
    df = raw.select("id", F.udf(counted)("raw").alias("text"))
    out = vectors.tfidf(df, "text", 12)
    assert read.value == len(TEXTS)  # the vocabulary and its weights
    plain = df.cache()
    steps = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="w", pattern=r"(?U)\w\w+", gaps=False),
        StopWordsRemover(inputCol="w", outputCol="k"),
        CountVectorizer(inputCol="k", outputCol="tf", vocabSize=12), IDF(inputCol="tf", outputCol="i")]).fit(plain)
    weights = np.array(steps.stages[-1].idf) + 1
    want = {r.id: r.tf.toArray() * weights for r in steps.transform(plain).collect()}
    for r in out.select("id", vector_to_array("features").alias("v")).collect():
        # Terms of one count have no order there.
        assert np.allclose(sorted(r.v), sorted(want[r.id] / (np.linalg.norm(want[r.id]) or 1)))


def test_hash_embedder_adds_up_words():
    import zlib

    texts = ["a b a", "", "Ünïcode a"]
    sums = np.zeros((3, 8), np.float32)
    for row, text in zip(sums, texts):
        for code in (zlib.crc32(w.encode()) for w in text.lower().split()):
            row[code % 8] += 1 if code & 0x10000 else -1
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    got = vectors.hash_embedder(8)()(np.array(texts, object))
    assert got.dtype == np.float32 and (got == np.divide(sums, norms, out=sums, where=norms > 0)).all()


def test_kmeans_and_projection(points_df):
    model = vectors.fit_kmeans(points_df, "vector", k=6, n_init=3, max_iter=20)
    placed = vectors.assign_clusters(points_df, model, "vector")
    assert placed.count() == 120 and placed.select("cluster").distinct().count() == 6
    flat = vectors.project_2d(points_df, "vector")
    assert {"x", "y"} <= set(flat.columns)


def test_restarts_in_shared_passes_are_single_fits(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((60, 5)) + 4 * rng.standard_normal(5) for _ in range(7)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    model = vectors.fit_kmeans(df, "v", k=7, n_init=20, tol=1e-12)
    sample = np.array([r[0] for r in df.filter("v IS NOT NULL").orderBy(F.xxhash64("v"), "v").select("v").collect()])
    costs = []
    for centers in vectors._starts(sample, 7, 20, 42):
        for _ in range(500):
            apart = ((x[:, None] - centers) ** 2).sum(axis=2)
            at, last = apart.argmin(axis=1), centers
            centers = np.stack([x[at == k].mean(axis=0) if (at == k).any() else centers[k] for k in range(7)])
            if ((centers - last) ** 2).sum() <= 1e-12 * sample.var(axis=0).mean():
                break
        costs.append(apart.min(axis=1).sum())
    assert model.cost == pytest.approx(min(costs)) and model.passes > 1
    placed = vectors.assign_clusters(df, model, "v").collect()
    assert [r["cluster"] for r in placed if r["v"] is None] == [None]
    assert sum(r["distance"] ** 2 for r in placed if r["v"]) == pytest.approx(model.cost)
    with pytest.raises(ValueError):
        vectors.fit_kmeans(df.limit(3), "v", k=7)


def test_embed_is_deterministic(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("c",)], "t string")
    rows = [r[0] for r in df.select(vectors.embed(F.col("t"), vectors.hash_embedder(16))).collect()]
    assert rows[0] == rows[1] != rows[2]
    assert np.linalg.norm(rows[0]) == pytest.approx(1.0)


# --- time series ---------------------------------------------------------------------

def test_velocity_and_stage(spark):
    d = 86_400
    rows = [(at(0),), (at(10),), (at(2 * d),), (at(3 * d),)]
    series = timeseries.filled_counts(spark.createDataFrame(rows, "ts timestamp"), "ts", "day")
    got = [(r["n"], r["velocity"], r["acceleration"], r["stage"])
           for r in timeseries.lifecycle(series).orderBy("bucket").collect()]
    assert got == [(2, 0, 0, "Stable/Maturity"), (0, -2, -2, "Decline"), (1, 1, 3, "Birth/Growth"),
                   (1, 0, -1, "Stable/Maturity")]


def test_sliding_velocity_equals_window(spark, skewed_df):
    got = {(r["window_start"], r["k"]): r["n"]
           for r in timeseries.sliding_velocity(skewed_df, "ts", "k", 60, 5).collect()}
    direct = skewed_df.groupBy(F.window("ts", "60 seconds", "5 seconds"), "k").count()
    assert got == {(r["window"]["start"], r["k"]): r["count"] for r in direct.collect()}


def test_peaks_first_time_of_maximum(spark):
    df = spark.createDataFrame([("a", at(0), 1.0), ("a", at(5), 3.0), ("a", at(9), 3.0)],
                               "g string, ts timestamp, v double")
    row = timeseries.peaks(df, "g", "ts", "v").first()
    assert (row["peak_velocity"], row["peak_time"]) == (3.0, at(5))


def test_ranks_of_one_key_and_time_are_spread(spark, monkeypatch):
    rows = [("k", at(0), i) for i in range(4000)] + [(None, at(0), 1), (None, None, 0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long").repartition(4)
    written = []
    monkeypatch.setattr(ranking, "materialize", lambda *a: written.append(materialize(*a)) or written[-1])
    small = "spark.sql.adaptive.coalescePartitions.enabled"  # would join ranges of so few rows
    spark.conf.set(small, "false")
    try:
        out = ranking.running_rank(df, ["k"], "ts", ["id"]).collect()
    finally:
        spark.conf.set(small, "true")
    assert sorted(r["rank"] for r in out if r["k"]) == list(range(1, 4001))
    assert all(r["rank"] == r["id"] + 1 for r in out if r["k"])
    sizes = [r[0] for r in written[0].groupBy(F.shiftright("__seq", 33)).count().select("count").collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * len(rows)


def test_spread_evenly_only_dense_rows(spark):
    dense = spark.createDataFrame([(i, at(i % 3)) for i in range(5)], "id long, ts timestamp")
    got = [r["ts"] for r in timeseries.spread_evenly(dense, "ts", "id").orderBy("ts").collect()]
    step = 7 * 86_400 / 4
    assert got == [at(i * step) for i in range(5)]
    wide = spark.createDataFrame([(0, at(0)), (1, at(61))], "id long, ts timestamp")
    assert sorted(r["ts"] for r in timeseries.spread_evenly(wide, "ts", "id").collect()) == \
        [at(0), at(61)]


def test_rolling_mean_starts_after_three(spark):
    df = spark.createDataFrame([(i, i) for i in range(4)], "bucket int, n int")
    got = [r["rolling"] for r in timeseries.rolling_mean(df).orderBy("bucket").collect()]
    assert got == [None, None, 1.0, 2.0]


# --- key figures -----------------------------------------------------------------------

def test_latency_stats_of_one_row(spark):
    df = spark.createDataFrame([(100, 5.0), (200, 1.0), (200, 3.0), (None, 9.0), (100, None)],
                               "level int, ms double")
    got = {r["level"]: (r["count"], r["median_ms"], r["stdev_ms"])
           for r in metrics.latency_stats(df, "level", "ms").collect()}
    assert got[100] == (1, 5.0, 0.0)
    assert got[200] == (2, 2.0, pytest.approx(statistics.stdev([1.0, 3.0])))


def test_board_figures_and_empty_lists(spark):
    df = spark.createDataFrame(
        [("positive", ["x"], at(0)), ("negative", [], at(100)), (None, None, at(400))],
        "sentiment string, locations array<string>, ts timestamp")
    row = metrics.board_figures(df, "ts", F.lit(at(400))).first()
    assert (row["total"], row["recent"], row["located"], row["rated"]) == (3, 2, 1, 2)
    assert row["positive_pct"] == 50.0
    loose = metrics.board_figures(df, "ts", F.lit(at(400)), empty_lists_count=True).first()
    assert loose["located"] == 2


def test_digest_with_too_few_rows(spark):
    df = spark.createDataFrame([(1, "Only: one", at(0))], "id long, title string, ts timestamp")
    row = metrics.daily_digest(df, "ts", "id", F.lit(at(60))).first()
    assert (row["status"], row["topics"], row["headlines"]) == ("limited data", [], [])


def test_breaking_needs_two_articles(spark):
    rows = [(1, "A. b", "negative", ["the coast"], at(0)), (2, "a b!", "negative", None, at(5)),
            (3, "<b>C</b>", "negative", [], at(1)), (4, "D", "positive", [], at(2))]
    df = spark.createDataFrame(rows, "id long, title string, sentiment string, "
                                     "locations array<string>, ts timestamp")
    got = [(r["id"], r["place"], r["title"], r["articles"])
           for r in boards.breaking(df, "ts", "id").collect()]
    assert got == [(2, "India", "a b!", 3), (3, "India", "C", 3)]
    assert boards.trending(df, "ts", "id").count() == 0


def test_boards_take_string_ids_and_null_keys(spark):
    rows = [("b", "A x", "negative", ["p"], at(5), ["E", "F"]),
            ("a", "A x", "negative", None, at(5), ["E"]), ("c", "B", "negative", [], None, ["E"]),
            (None, "C", "positive", [], at(9), [])]
    df = spark.createDataFrame(rows, "id string, title string, sentiment string, "
                                     "locations array<string>, ts timestamp, names array<string>")
    assert [(r["id"], r["articles"]) for r in boards.breaking(df, "ts", "id").collect()] == \
        [("a", 3), ("c", 3)]
    top = entities.top_stories(df, "names", "ts", "id").collect()
    assert [(r["entity"], r["rank"], r["title"]) for r in top] == [("E", 1, "A x"), ("E", 2, "B")]
    assert [r["id"] for r in boards.newest(df, "ts", "id", 2).collect()] == [None, "a"]


def test_the_rule_on_one_sequence_leaves_the_input_spread(spark):
    rows = spark.range(40, numPartitions=4).select(
        "id", F.timestamp_seconds("id").alias("ts"),
        F.array(F.cos(F.col("id")), F.sin(F.col("id"))).alias("vector"))
    out = events.semantic_events(rows, 0.9, 0, None)
    assert "Coalesce" not in out._jdf.queryExecution().executedPlan().toString()
    clusters = events.LeaderClusters(0.9)
    want = {i: clusters.add(i, np.array([np.cos(i), np.sin(i)]))[0] for i in range(40)}
    assert {r["id"]: r["event"] for r in out.collect()} == want
    np.testing.assert_allclose(clusters.norms[:len(clusters.names)],
                               np.linalg.norm(clusters.sums[:len(clusters.names)], axis=1))


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(graph, "PAIRS", 20)
    rng = np.random.default_rng(3)
    lists = [[f"n{x}" for x in rng.integers(0, 9, rng.integers(0, 12))] for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(lists)), "id long, names array<string>")
    out = graph.edge_weights(df, "id", "names")
    assert out.select(F.spark_partition_id()).distinct().count() > 4
    want = Counter(tuple(sorted(p)) for x in lists for p in itertools.combinations(x, 2))
    assert {(r["src"], r["dst"]): r["weight"] for r in out.collect()} == want

    mentions = Counter(n for x in lists for n in x)
    shared = Counter(p for x in lists for p in itertools.combinations(sorted(set(x)), 2))
    shared += Counter((n, n) for x in lists for n, c in Counter(x).items() if c > 1)
    want = {p: n for p, n in shared.items() if n >= 3 and min(mentions[p[0]], mentions[p[1]]) >= 5}
    out = graph.article_edges(df, "id", "names", 5, 3, self_loops=True)
    assert {(r["src"], r["dst"]): r["weight"] for r in out.collect()} == want
    assert out.filter("src > dst").count() == 0
    assert dict(out.dtypes)["src"] == "string"


def test_enriched_posts_move_once(spark):
    posts = spark.createDataFrame([(i, at(10), f"A storm {i}") for i in range(4)],
                                  "post_id long, post_ts timestamp, text string")
    ev = spark.createDataFrame([(i, at(0), f"T{i}", ["storm"]) for i in range(3)],
                               "event_id long, event_ts timestamp, title string, keywords array<string>")
    out = events.enrich_matches(events.match_posts(posts, ev), posts, ev)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "post_id" in joins[0] and "event_id" not in joins[0]  # texts come in with the last join
    assert {(r["post_id"], r["event_id"], r["event_title"], r["social_text"]) for r in out.collect()} == {
        (p, e, f"T{e}", f"A storm {p}") for p in range(4) for e in range(3)}
