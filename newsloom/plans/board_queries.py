"""Queries for ranked lists and cluster views."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import boards, summaries, timeseries
from newsloom.operators import entities as en
from newsloom.plans.catalog import query
from newsloom.plans.series_queries import SLIDING, history
from newsloom.plans.tables import (ART, SQL_SPACES, STAMP, STOP_WORDS, fill, in_list, rounded, stamp)
from newsloom.plans.text_queries import CLEAN, FELT, LOUD, TITLE_KEY, hits

ARTICLE_CONFIDENCE = "(length(content) % 97) / 97.0::DOUBLE"


def clustered(t):
    """Articles with their source as cluster and a confidence derived from their length."""
    return t.articles.withColumn("confidence", F.length("content") % 97 / F.lit(97.0))


@query("j1_live_feed", f"""WITH {ART} SELECT id, {STAMP.format('published_at')} AS published_at,
  sentiment AS mood, CASE WHEN len(entities) >= 3 THEN 'event' ELSE '' END AS badge,
  left({fill(CLEAN, "coalesce(nullif(content, ''), title)")}, 80) AS preview,
  array_to_string(entities[1:5], ', ') AS first_entities
  FROM art ORDER BY art.published_at DESC, id LIMIT 20""")
def _(t):
    out = boards.live_feed(t.articles, "published_at", "id", 20)
    return out.withColumn("published_at", stamp("published_at"))


PLACE = """CASE WHEN len(locations) = 0 THEN 'India'
  ELSE upper(locations[1][1]) || locations[1][2:] END"""


def headlines_sql(mood):
    return f"""WITH {ART}, m AS (SELECT * FROM art WHERE sentiment = '{mood}'),
  f AS (SELECT *, row_number() OVER (PARTITION BY {TITLE_KEY} ORDER BY published_at DESC, id) AS rn
    FROM m)
  SELECT id, {PLACE} AS place, {fill(CLEAN, 'title')} AS title,
    (SELECT count(*) FROM m) AS articles FROM f WHERE rn = 1 AND (SELECT count(*) FROM m) >= 2
  ORDER BY published_at DESC, id LIMIT 5"""


@query("j2_breaking", headlines_sql("negative"))
def _(t):
    return boards.breaking(t.articles, "published_at", "id")


@query("j3_trending", headlines_sql("positive"))
def _(t):
    return boards.trending(t.articles, "published_at", "id")


RELEVANCE = f"""e AS (SELECT source, entity, count(*) AS n FROM (SELECT source, unnest(entities)
    AS entity FROM art) GROUP BY 1, 2),
  top AS (SELECT source, list(entity) AS names FROM (SELECT *, row_number() OVER (
    PARTITION BY source ORDER BY n DESC, entity) AS r FROM e) WHERE r <= 10 GROUP BY 1),
  rel AS (SELECT art.*, coalesce(len(list_filter(entities, lambda x: list_contains(names, x))), 0)
    * 10 + {ARTICLE_CONFIDENCE} AS relevance FROM art LEFT JOIN top USING (source))"""


@query("g8_relevance", f"""WITH {ART}, {RELEVANCE} SELECT id, round(relevance, 6) AS relevance
  FROM rel""")
def _(t):
    out = boards.with_relevance(clustered(t), "source", "entities")
    return out.select("id", rounded(F.col("relevance")).alias("relevance"))


@query("j4_cluster_leads", f"""WITH {ART}, {RELEVANCE},
  sizes AS (SELECT source, count(*) AS size FROM art GROUP BY 1 ORDER BY size DESC, source LIMIT 20),
  b AS (SELECT *, row_number() OVER (PARTITION BY source, title ORDER BY relevance DESC, id) AS one
    FROM rel), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, id)
    AS rank FROM b WHERE one = 1)
  SELECT source, size, rank::INT AS rank, id, title, round(relevance, 6) AS relevance
  FROM r JOIN sizes USING (source) WHERE rank <= 3""")
def _(t):
    out = boards.cluster_leads(clustered(t), "source", "entities", "id")
    return out.withColumn("relevance", rounded(F.col("relevance")))


TOP3 = """top AS (SELECT entity, count(*) AS mentions FROM (SELECT unnest(entities) AS entity
    FROM art) GROUP BY 1 ORDER BY mentions DESC, entity LIMIT 3),
  tagged AS (SELECT entity, mentions, id, title, published_at FROM top
    JOIN art ON list_contains(entities, entity))"""


@query("g5_articles_of_top", f"""WITH {ART}, {TOP3} SELECT entity, mentions, id FROM tagged""")
def _(t):
    return en.articles_of_top_entities(t.articles.select("id", "entities"), "id", "entities", 3
                                       ).select("entity", "mentions", "id")


@query("j5_top_stories", f"""WITH {ART}, {TOP3},
  sizes AS (SELECT entity, count(*) AS articles FROM tagged GROUP BY 1 HAVING count(*) >= 2),
  d AS (SELECT *, row_number() OVER (PARTITION BY entity, title ORDER BY published_at DESC, id)
    AS one FROM tagged WHERE title <> ''),
  r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY published_at DESC, id) AS rank
    FROM d WHERE one = 1)
  SELECT entity, mentions, articles, rank::INT AS rank, title FROM r JOIN sizes USING (entity)
  WHERE rank <= 3""")
def _(t):
    return en.top_stories(t.articles, "entities", "published_at", "id")


@query("j8_top_peaks", f"""WITH {SLIDING} SELECT event_type, peak_velocity FROM p
  ORDER BY peak_velocity DESC, event_type LIMIT 3""")
def _(t):
    peak = timeseries.peaks(history(t), "event_type", "window_start", "velocity")
    return boards.top_by(peak, "peak_velocity", "event_type", 3).drop("peak_time")


N_WORDS = ("len(list_filter(regexp_split_to_array(shown, '" +
           SQL_SPACES + "'), lambda w: w <> ''))")
SENS = (f"({hits('shown', LOUD)} * 2 + {hits('shown', FELT)} + length(shown) - "
        "length(replace(shown, '!', '')) + length(regexp_replace(shown, '\\P{Lu}+', '', 'g'))"
        "::DOUBLE / length(shown) * 5)")
DENS = f"coalesce(len(entities)::DOUBLE / nullif({N_WORDS}, 0) * 10, 0)"


@query("hype_table", f"""WITH {ART}, a AS (SELECT *, title || ' ' || content AS shown FROM art),
  s AS (SELECT id, left(title, 60) AS title,
    CASE WHEN length(shown) < 10 THEN 0::DOUBLE ELSE {SENS} END AS s,
    CASE WHEN length(shown) < 10 THEN 0::DOUBLE ELSE {DENS} END AS d FROM a)
  SELECT id, title, round(greatest(0, least(10, s - d)), 5)::DOUBLE AS hype,
    round(s, 5) AS sensationalism, round(d, 5) AS density,
    CASE WHEN s > 5 AND d > 2 THEN 'Sensationalist News' WHEN s > 5 THEN 'Clickbait / Noise'
      WHEN d > 2 THEN 'Quality Journalism' ELSE 'Inert Content' END AS zone FROM s""")
def _(t):
    out = boards.hype_table(t.articles, "id", "entities", sensational=LOUD, emotional=FELT)
    return out.withColumns({c: rounded(F.col(c), 5) for c in ("hype", "sensationalism", "density")})


TERMS = f"""r AS (SELECT source, doc_id, left(text, 200) AS s, row_number() OVER (PARTITION BY source
    ORDER BY doc_id) AS k FROM documents),
  c AS (SELECT source, string_agg(s, ' ' ORDER BY doc_id) AS s FROM r WHERE k <= 10 GROUP BY 1),
  w AS (SELECT source, list_filter(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
    lambda x: x NOT IN {in_list(STOP_WORDS)}) AS w FROM c),
  g AS (SELECT source, unnest(w) AS term FROM w UNION ALL
    SELECT source, w[i] || ' ' || w[i + 1] FROM (SELECT source, w, unnest(generate_series(1,
      len(w) - 1)) AS i FROM w)),
  n AS (SELECT source, term, count(*) AS n FROM g GROUP BY 1, 2),
  top AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rank FROM n
    QUALIFY rank <= 5)"""


@query("h16_cluster_terms", f"WITH {TERMS} SELECT source, term, n, rank::INT AS rank FROM top")
def _(t):
    return summaries.cluster_terms(t("documents"), "source", "text", ["doc_id"], STOP_WORDS)


def shortened(x):
    return f"CASE WHEN length({x}) > 30 THEN left({x}, 27) || '...' ELSE {x} END"


@query("h16_cluster_labels", f"""WITH {ART}, e AS (SELECT source, entity, row_number() OVER (
    PARTITION BY source ORDER BY count(*) DESC, entity) AS r FROM (SELECT source, unnest(entities)
    AS entity FROM art) GROUP BY 1, 2),
  l AS (SELECT source, string_agg(entity, ' & ' ORDER BY r) AS label FROM e WHERE r <= 2 GROUP BY 1)
  SELECT source, {shortened('label')} AS label FROM l""")
def _(t):
    return summaries.cluster_labels(t.articles, "source", "content", "entities", ["id"], STOP_WORDS)


@query("h16_cluster_labels_terms", f"""WITH {TERMS}, l AS (SELECT source, list_sort(list(term))[1:3]
    AS terms FROM top GROUP BY 1),
  j AS (SELECT source, array_to_string(list_transform(string_split(array_to_string(terms, ' '), ' '),
    lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM l)
  SELECT source, {shortened("replace(label, '_', ' ')")} AS label FROM j""")
def _(t):
    d = t("documents").withColumn("entities", F.array().cast("array<string>"))
    return summaries.cluster_labels(d, "source", "text", "entities", ["doc_id"], STOP_WORDS)
