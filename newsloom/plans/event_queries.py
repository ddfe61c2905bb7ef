"""Queries for event detection and the matching of posts to events."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import lexicons as lx
from newsloom.functions.text import document_key, title_keywords
from newsloom.operators import events
from newsloom.plans.catalog import query
from newsloom.plans.tables import (ART, LABELS, NAME_PATTERN, POSTS, STAMP, fill, labelled,
                                   rounded, stamp)
from newsloom.plans.text_queries import (CLUSTER_KEY, D1, D2, TOKEN_BAD, TOKEN_GOOD,
                                         distinct_in_order, negation_sql, ordered_distinct_cte)

CLUSTERS = f"""{ART}, raw_kw AS (SELECT *, {fill(D2, "title || ' ' || content")} AS l FROM art),
  kw AS (SELECT *, {distinct_in_order('l')} AS keywords FROM raw_kw),
  cl AS (SELECT *, {fill(CLUSTER_KEY, 'keywords')} AS cluster_key FROM kw WHERE len(keywords) >= 2),
  nth AS (SELECT *, row_number() OVER w AS n, min(published_at) OVER (PARTITION BY cluster_key)
    AS first_ts FROM cl WINDOW w AS (PARTITION BY cluster_key ORDER BY published_at, id))"""


def joined(col, sep=","):
    return F.array_join(col, sep)


@query("f2_keyword_births", f"""WITH {CLUSTERS}, i AS (SELECT cluster_key, string_agg(title || '/' ||
    source, '|' ORDER BY n) AS initial FROM nth WHERE n <= 3 GROUP BY 1)
  SELECT 'event_' || cluster_key AS event_id, array_to_string(keywords, ',') AS keywords,
    {STAMP.format('published_at')} AS first_seen, n::INT AS article_count, id AS seed, initial
  FROM nth JOIN i USING (cluster_key) WHERE n = 3""")
def _(t):
    out = events.keyword_event_births(t.articles, text=("title", "content"))
    initial = F.transform("initial_articles", lambda a: F.concat_ws("/", a["title"], a["source"]))
    return out.select("event_id", joined("keywords").alias("keywords"),
                      stamp("first_seen").alias("first_seen"), "article_count", "seed",
                      joined(initial, "|").alias("initial"))


@query("f3_keyword_updates", f"""WITH {CLUSTERS} SELECT 'event_' || cluster_key AS event_id, id,
    n AS article_count, {STAMP.format('first_ts')} AS first_seen FROM nth WHERE n > 3""")
def _(t):
    out = events.keyword_event_updates(t.articles, text=("title", "content"))
    return out.select("event_id", "id", "article_count", stamp("first_seen").alias("first_seen"))


@query("f1_semantic_events")
def _(t):
    rows = t.vectors.select("id", "ts", "vector")
    return events.semantic_events(rows, threshold=0.2, lsh_bits=3, slot_seconds=86_400.0, dim=64)


# The rule, one article after the other: the most similar sum so far, or an event of its own.
@query("f1_semantic_rule", """WITH RECURSIVE v AS MATERIALIZED (SELECT event_id AS id,
    embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY ts, event_id) AS k
    FROM embeddings JOIN events ON vec_id = event_id),
  run AS (SELECT 0::BIGINT AS k, 0::BIGINT AS id, 0::BIGINT AS event, []::STRUCT(id BIGINT, s DOUBLE[])[] AS es
    UNION ALL SELECT k, id, CASE WHEN best >= 0.2 THEN es[place].id ELSE id END,
      CASE WHEN best >= 0.2 THEN list_transform(es, lambda e, i: CASE WHEN i = place THEN
          {'id': e.id, 's': list_transform(list_zip(e.s, x), lambda z: z[1] + z[2])} ELSE e END)
        ELSE list_append(es, {'id': id, 's': x}) END
    FROM (SELECT *, list_position(sims, best) AS place FROM (SELECT *, list_max(sims) AS best FROM (
      SELECT v.k, v.id, v.x, run.es, list_transform(run.es, lambda e: list_cosine_similarity(e.s, v.x)) AS sims
      FROM run JOIN v ON v.k = run.k + 1))))
  SELECT id, event FROM run WHERE k > 0""")
def _(t):
    return events.semantic_events(t.vectors.select("id", "ts", "vector"), 0.2, 0, None).select("id", "event")


# Events: one per document, with the keywords of its title. Posts: conversation turns.
EVENTS = f"""{ART}, kw0 AS (SELECT id AS doc_id, title AS text FROM art),
  {ordered_distinct_cte('kw', 'doc_id', fill(D1, 'text'), 'kw0', 5)},
  ev AS (SELECT id AS event_id, published_at AS event_ts, title, kw FROM art JOIN kw
    ON id = doc_id)"""
MATCHES = f"""{EVENTS}, {POSTS}, matches AS (SELECT post_id, post_ts, event_id, title,
    list_sort(list_filter(kw, lambda k: contains(lower(text), k))) AS hit,
    list_filter(kw, lambda k: contains(lower(text), k)) AS in_order
  FROM posts JOIN ev ON post_ts >= event_ts AND post_ts < event_ts + INTERVAL 24 HOUR
  WHERE len(list_filter(kw, lambda k: contains(lower(text), k))) > 0)"""


def title_events(t):
    return t.articles.select(F.col("id").alias("event_id"), F.col("published_at").alias("event_ts"),
                             "title", title_keywords(F.col("title")).alias("keywords"))


@query("g1_match_posts", f"""WITH {MATCHES} SELECT post_id, {STAMP.format('post_ts')} AS post_ts,
  event_id, array_to_string(hit, ',') AS matched FROM matches""")
def _(t):
    out = events.match_posts(t.posts, title_events(t))
    return out.select("post_id", stamp("post_ts").alias("post_ts"), "event_id",
                      joined("matched_keywords").alias("matched"))


def grouped(*labels):
    """The first five names of some kinds in a post, as one string."""
    at = ", ".join(str(LABELS.index(x)) for x in labels)
    return f"""array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text,
      '{NAME_PATTERN}'), lambda n: length(n) % {len(LABELS)} IN ({at}))))[1:5], ',')"""


@query("g2_enrich_matches", f"""WITH docs2 AS (SELECT conv_id * 100 + turn AS doc_id, text
    FROM conversations), {negation_sql(TOKEN_GOOD, TOKEN_BAD, lx.NEGATIONS)
                          .replace('FROM documents', 'FROM docs2')}, {MATCHES}
  SELECT post_id, event_id, title AS event_title, array_to_string(in_order, ',') AS matched,
    "user", 'Unknown' AS platform, 0::BIGINT AS likes, round(coalesce(score, 0)::DOUBLE, 6)
    AS sentiment, {grouped('PERSON')} AS persons, {grouped('ORG', 'PRODUCT')} AS organizations,
    {grouped('GPE', 'LOC')} AS locations
  FROM matches JOIN (SELECT post_id, "user", text FROM posts) USING (post_id)
  LEFT JOIN scored ON scored.doc_id = post_id""")
def _(t):
    ev = title_events(t)
    found = events.match_posts(t.posts, ev)
    out = events.enrich_matches(found, t.posts, ev, positive=TOKEN_GOOD, negative=TOKEN_BAD,
                                mentions=labelled(t.posts, "post_id"))
    return out.select("post_id", "event_id", "event_title",
                      joined("matched_keywords").alias("matched"), "user", "platform", "likes",
                      rounded(F.col("sentiment")).alias("sentiment"),
                      *[joined(f"entities.{k}").alias(k)
                        for k in ("persons", "organizations", "locations")])


@query("a11_document_key", f"""WITH {POSTS} SELECT post_id, post_id || '_' ||
  replace(strftime(post_ts, '%Y-%m-%dT%H:%M:%S'), ':', '') || '_' || "user" AS k FROM posts""")
def _(t):
    at = F.date_format("post_ts", "yyyy-MM-dd'T'HH:mm:ss")
    return t.posts.select("post_id", document_key(F.col("post_id").cast("string"), at,
                                                  F.col("user")).alias("k"))
