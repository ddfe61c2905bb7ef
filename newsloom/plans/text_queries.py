"""Queries for projections, duplicate removal and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import lexicons as lx
from newsloom.functions import normalize as nz
from newsloom.functions import text as tx
from newsloom.operators import dedup, entities, sentiment, summaries
from newsloom.operators.bounds import one_per_item
from newsloom.plans.catalog import query
from newsloom.plans.tables import (ART, KEPT, MENTIONS, NEGATIONS, NEGATIVE, POSITIVE, SQL_SPACE, SQL_SPACES,
                                   STAMP, STOP_WORDS,
                                   VALENCE, WORDS, distinct_in_order, fill, hits, in_list, rounded, stamp,
                                   text_list, vote_label)

NO_WORDS = "array<string>"


def joined(col, sep=","):
    return F.array_join(col, sep)


CAPITAL_SQL = (f"(?:^|[{SQL_SPACE}])[^\\p{{Ll}}{SQL_SPACE}]*\\p{{Lu}}[^\\p{{Ll}}{SQL_SPACE}]*"
               f"(?:[{SQL_SPACE}]|$)")


# --- normalisation -------------------------------------------------------------------

def raw_news(t):
    """Documents as raw news: the source is text in some rows and an object in others."""
    d = t("documents")
    as_object = F.to_json(F.struct(F.lower("source").alias("id"), F.col("source").alias("name")))
    return d.select(
        F.when(F.col("lang") == "en", as_object).when(F.col("lang") == "fr", F.lit(None))
        .otherwise(F.col("source")).alias("source"),
        F.concat(F.lit("  "), F.regexp_extract("text", r"^[^.\n]*", 0)).alias("title"),
        F.when(F.col("lang") == "es", F.lit("")).otherwise(F.col("text")).alias("description"),
        F.col("text").alias("content"),
        F.concat(F.lit("https://example.org/"), "doc_id").alias("url"),
        F.when(F.col("lang") == "de", F.lit(None)).otherwise(F.lit("staff")).alias("author"),
        F.when(F.col("lang") == "en", F.lit("Mon, 01 Jan 2024 10:20:30 GMT")).alias("publishedAt"),
        F.when(F.col("lang") == "fr", F.lit("2024-02-03T04:05:06")).otherwise(F.lit("n/a"))
        .alias("published_at"))


RAW = """raw AS (SELECT doc_id, text, lang,
  CASE lang WHEN 'fr' THEN 'Unknown' ELSE source END AS source,
  trim(regexp_extract(text, '^[^.\\n]*')) AS title,
  CASE lang WHEN 'es' THEN '' ELSE trim(text) END AS description, trim(text) AS content,
  'https://example.org/' || doc_id AS url,
  CASE lang WHEN 'de' THEN 'Unknown' ELSE 'staff' END AS author,
  CASE lang WHEN 'en' THEN '2024-01-01 10:20:30' WHEN 'fr' THEN '2024-02-03 04:05:06'
       ELSE '2024-03-01 00:00:00' END AS published_at FROM documents)"""


@query("b1_normalize_articles", f"""WITH {RAW} SELECT url, source, title, length(description) AS
  description_chars, length(content) AS content_chars, author, published_at FROM raw
  WHERE title <> ''""")
def _(t):
    out = nz.normalize_articles(raw_news(t), F.lit("2024-03-01 00:00:00").cast("timestamp"))
    return out.select("url", "source", "title", F.length("description").cast("long").alias("description_chars"),
                      F.length("content").cast("long").alias("content_chars"), "author",
                      stamp("published_at").alias("published_at"))


@query("b2_feed_entries", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY source
    ORDER BY doc_id) AS rn FROM documents)
  SELECT doc_id, 'feed-' || source AS source_id, 'Feed ' || source AS source_name,
    left(text, 500) AS description, length(left(text, 1000)) AS content_chars
  FROM e WHERE rn <= 15""")
def _(t):
    d = t("documents").select(
        F.concat(F.lit("Feed "), "source").alias("feed_title"), F.lit(None).cast("string")
        .alias("author"), F.col("lang").alias("title"), F.col("text").alias("summary"),
        F.col("doc_id").cast("string").alias("url"), "doc_id")
    out = nz.feed_entries(d, "feed_title", ["doc_id"])
    return out.select(F.col("url").cast("long").alias("doc_id"), "source_id", "source_name",
                      "description",
                      F.length("content").cast("long").alias("content_chars"))


@query("b3_source_name", f"WITH {RAW} SELECT doc_id, source FROM raw")
def _(t):
    return raw_news(t).select(
        F.substring_index("url", "/", -1).cast("long").alias("doc_id"),
        nz.source_name(F.col("source")).alias("source"))


@query("b4_content_fallback", """SELECT doc_id, length(coalesce(nullif(CASE lang WHEN 'es' THEN ''
  ELSE text END, ''), source)) AS chars FROM documents""")
def _(t):
    text = F.when(F.col("lang") == "es", "").otherwise(F.col("text"))
    return t("documents").select("doc_id", F.length(nz.first_filled(text, F.col("source")))
                                 .cast("long").alias("chars"))


@query("b5_resolve_timestamp", """SELECT event_id, CASE event_type
  WHEN 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 'view' THEN strftime(ts,
  '%Y-%m-%d %H:%M:%S') WHEN 'error' THEN NULL ELSE '2024-01-02 03:04:05' END AS ts FROM events""")
def _(t):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rss = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    first = F.when(F.col("event_type") == "click", iso).when(F.col("event_type") == "error", "soon")
    second = F.when(F.col("event_type") == "view", rss)
    third = F.when(F.col("event_type") != "error", "2024-01-02T03:04:05")
    return t("events").select("event_id", stamp(nz.resolve_timestamp(first, second, third))
                              .alias("ts"))


@query("b6_required_fields", f"""WITH {RAW} SELECT count(*) AS n FROM raw WHERE title <> ''
  AND description <> ''""")
def _(t):
    rows = nz.normalize_articles(raw_news(t))
    return rows.filter(F.col("description") != "").agg(F.count("*").alias("n"))


@query("b7_blocked_content", f"""SELECT doc_id FROM documents
  WHERE {hits('text', NEGATIVE)} = 0""")
def _(t):
    return t("documents").filter(~nz.blocked(F.col("text"), words=NEGATIVE)).select("doc_id")


@query("b8_sentiment_filter", f"""WITH {ART} SELECT id, sentiment FROM art
  WHERE sentiment IN ('positive', 'negative')""")
def _(t):
    return t.articles.filter(F.col("sentiment").isin("positive", "negative")).select(
        "id", "sentiment")


@query("b9_thresholds", """SELECT count(*) FILTER (value > 20) AS high,
  count(*) FILTER (value > 5) AS mid FROM events""")
def _(t):
    return t("events").agg(F.count_if(F.col("value") > 20).alias("high"),
                           F.count_if(F.col("value") > 5).alias("mid"))


CLEAN = ("trim(regexp_replace(regexp_replace(regexp_replace(:x:, '<[^>]+>', '', 'g'), "
         f"'http[^{SQL_SPACE}]+', '', 'g'), '{SQL_SPACES}', ' ', 'g'))")
CLEAN_ASCII = ("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(:x:, '<[^>]+>', "
               f"' ', 'g'), 'http[^{SQL_SPACE}]+', '', 'g'), '[^\\x00-\\x7F]+', ' ', 'g'), "
               f"'{SQL_SPACES}', ' ', 'g'))")


@query("b10_clean_html", f"""SELECT page_id, md5({fill(CLEAN, 'html')}) AS cleaned,
  md5({fill(CLEAN_ASCII, 'html')}) AS ascii FROM pages""")
def _(t):
    return t("pages").select(
        "page_id", F.md5(nz.clean_for_display(F.col("html")).cast("binary")).alias("cleaned"),
        F.md5(nz.clean_ascii(F.col("html")).cast("binary")).alias("ascii"))


TITLE_KEY = f"regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_{SQL_SPACE}]', '', 'g')"


@query("b11_title_key", f"WITH {ART} SELECT id, {TITLE_KEY} AS k FROM art")
def _(t):
    return t.articles.select("id", nz.title_key(F.col("title")).alias("k"))


@query("b12_scalar_to_list", f"""SELECT doc_id, CASE WHEN lang = 'en' THEN
  array_to_string(regexp_extract_all(text, '[A-Z][a-z]{{3,}}'), '|')
  WHEN lang = 'fr' THEN source ELSE '' END AS items FROM documents""")
def _(t):
    words = F.when(F.col("lang") == "en",
                   F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0)))
    one = F.when(F.col("lang") == "fr", F.col("source"))
    return t("documents").select("doc_id", joined(nz.as_list(words, one), "|").alias("items"))


@query("b13_matched_event", f"""WITH {ART} SELECT id, (len(entities) >= 3)::INT AS matched_event
  FROM art""")
def _(t):
    return t.articles.select("id", nz.matched_event(F.col("entities")).alias("matched_event"))


@query("b14_display_location", f"""WITH {ART} SELECT id, CASE WHEN len(locations) = 0 THEN 'India'
  ELSE upper(locations[1][1]) || locations[1][2:] END AS place FROM art""")
def _(t):
    return t.articles.select("id", nz.display_location(F.col("locations")).alias("place"))


@query("b15_stable_id", f"""WITH {ART} SELECT id,
  sha256(source || '|' || title || '|' || id::VARCHAR) AS stable FROM art""")
def _(t):
    return t.articles.select("id", nz.stable_id(F.col("source"), F.col("title"), F.col("id"))
                             .alias("stable"))


@query("b16_headline_topic", """SELECT page_id, CASE WHEN contains(url, ':')
  THEN split_part(url, ':', 1) ELSE left(url, 50) END AS topic,
  CASE WHEN contains(html, ':') THEN split_part(html, ':', 1) ELSE left(html, 50) END AS topic2
  FROM pages""")
def _(t):
    return t("pages").select("page_id", nz.headline_topic(F.col("url")).alias("topic"),
                             nz.headline_topic(F.col("html")).alias("topic2"))


@query("b17_previews", """SELECT doc_id, left(text, 60) AS p60, left(text, 80) AS p80,
  left(text, 100) AS p100, left(text, 200) AS p200 FROM documents""")
def _(t):
    return t("documents").select("doc_id", *[nz.preview(F.col("text"), n).alias(f"p{n}")
                                             for n in (60, 80, 100, 200)])


@query("b18_entity_count", f"WITH {ART} SELECT id, len(entities)::INT AS n FROM art")
def _(t):
    return t.articles.select("id", nz.entity_count(F.col("entities")).alias("n"))


@query("b19_article_grid", f"""WITH {ART} SELECT {STAMP.format('published_at')} AS published_at,
  title, category, sentiment, sentiment_score FROM art""")
def _(t):
    return t.articles.select(stamp("published_at").alias("published_at"), "title", "category",
                             "sentiment", "sentiment_score")


# --- duplicates ------------------------------------------------------------------------

@query("c1_dedup_within_hour", f"""WITH RECURSIVE {KEPT} SELECT min(event_id) AS event_id
  FROM kept JOIN events USING (user_id, ts) GROUP BY user_id, ts""")
def _(t):
    return dedup.first_per_window(t("events").select("event_id", "user_id", "ts"), "user_id", "ts",
                                  3600, "event_id").select("event_id")


@query("c2_only_new", """SELECT o_custkey AS custkey, min(o_orderkey) AS orderkey FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)
  GROUP BY o_custkey""")
def _(t):
    batch = t("orders").select(F.col("o_custkey").alias("custkey"),
                               F.col("o_orderkey").alias("orderkey"))
    sink = t("customer").filter("c_acctbal < 5000").select(F.col("c_custkey").alias("custkey"))
    return dedup.only_new(batch, sink, "custkey", ["orderkey"])


@query("c3_latest_per_title", f"""WITH {ART} SELECT title, id FROM (SELECT title, id, row_number()
  OVER (PARTITION BY title ORDER BY published_at DESC, id) AS rn FROM art) WHERE rn = 1""")
def _(t):
    return dedup.latest_per_title(t.articles.select("title", "id", "published_at"), "published_at",
                                  "id").select("title", "id")


@query("c4_distinct_headlines", f"""WITH {ART}, f AS (SELECT id, title, published_at, row_number()
    OVER (PARTITION BY {TITLE_KEY} ORDER BY published_at DESC, id) AS rn FROM art)
  SELECT id, title FROM f WHERE rn = 1 ORDER BY published_at DESC, id LIMIT 5""")
def _(t):
    return dedup.distinct_headlines(t.articles.select("id", "title", "published_at"),
                                    [F.col("published_at").desc(), F.col("id")], 5).select(
        "id", "title")


LOWER_WORDS = fill(WORDS, "lower(text)")


@query("c5_ordered_distinct", f"""WITH w AS (SELECT doc_id, {LOWER_WORDS} AS l FROM documents),
  p AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM w),
  f AS (SELECT doc_id, x, min(i) AS i FROM p GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f)
  SELECT doc_id, string_agg(x, ' ' ORDER BY rn) AS firsts FROM n WHERE rn <= 8 GROUP BY 1""")
def _(t):
    return t("documents").select("doc_id", joined(tx.distinct_first(
        tx.words(F.lower("text")), 8), " ").alias("firsts"))


@query("c6_overlap", f"""WITH {ART} SELECT id, len(list_filter(entities, lambda e: e IN
  {in_list(('That', 'This', 'With', 'From'))})) AS n FROM art""")
def _(t):
    top = F.array(*[F.lit(x) for x in ("That", "This", "With", "From")])
    return t.articles.select("id", tx.overlap_size(F.col("entities"), top).cast("long").alias("n"))


# --- keywords ----------------------------------------------------------------------------

D1 = (f"list_filter(list_transform(regexp_split_to_array(lower(:x:), '{SQL_SPACES}'), "
      f"lambda w: trim(w, '{lx.KEYWORD_STRIP_CHARS.replace(chr(39), chr(39) * 2)}')), "
      "lambda w: length(w) > 3 AND regexp_matches(w, '^[\\p{L}\\p{N}]+$') AND w NOT IN "
      f"{in_list(lx.KEYWORD_STOP_WORDS)})")
D2 = (f"list_filter(regexp_split_to_array(lower(:x:), '{SQL_SPACES}'), "
      "lambda w: length(w) > 4 AND regexp_matches(w, '^\\p{L}+$'))[1:10]")


def ordered_distinct_cte(name: str, key: str, items: str, source: str, keep: int) -> str:
    """CTE (key, kw): the first distinct items of a list expression, in order."""
    return f"""{name} AS (SELECT {key}, list(x ORDER BY i)[1:{keep}] AS kw FROM (
      SELECT {key}, x, min(i) AS i FROM (SELECT {key}, unnest(l) AS x,
        generate_subscripts(l, 1) AS i FROM (SELECT {key}, {items} AS l FROM {source}))
      GROUP BY {key}, x) GROUP BY {key})"""


@query("d1_title_keywords", f"""WITH {ordered_distinct_cte('k', 'doc_id', fill(D1, 'text'),
  'documents', 5)} SELECT doc_id, coalesce(array_to_string(kw, ','), '') AS keywords
  FROM documents LEFT JOIN k USING (doc_id)""")
def _(t):
    return t("documents").select("doc_id", joined(tx.title_keywords(F.col("text")))
                                 .alias("keywords"))


@query("d2_plain_keywords", f"""SELECT doc_id, array_to_string({distinct_in_order('l')}, ',')
  AS keywords FROM (SELECT doc_id, {fill(D2, 'text')} AS l FROM documents)""")
def _(t):
    return t("documents").select("doc_id", joined(tx.plain_keywords(F.col("text")))
                                 .alias("keywords"))


CLUSTER_KEY = "left(md5(array_to_string(list_sort((:x:)[1:5]), '')), 8)"


@query("d3_cluster_key", f"""SELECT doc_id, {fill(CLUSTER_KEY, distinct_in_order('l'))} AS k
  FROM (SELECT doc_id, {fill(D2, 'text')} AS l FROM documents)""")
def _(t):
    return t("documents").select("doc_id", tx.cluster_key(tx.plain_keywords(F.col("text")))
                                 .alias("k"))


WANTED = ("That", "RETITION", "avec", "ung")


@query("d4_contains_keyword", f"SELECT doc_id, {hits('text', WANTED)} > 0 AS hit FROM documents")
def _(t):
    wanted = F.array(*[F.lit(w) for w in WANTED])
    return t("documents").select("doc_id", tx.contains_keyword(F.col("text"), wanted).alias("hit"))


@query("d5_matching_keywords", f"""SELECT doc_id, array_to_string(list_filter({text_list(WANTED)},
  lambda k: contains(lower(text), lower(k))), ',') AS hit FROM documents""")
def _(t):
    wanted = F.array(*[F.lit(w) for w in WANTED])
    return t("documents").select("doc_id", joined(tx.matching_keywords(F.col("text"), wanted))
                                 .alias("hit"))


# --- sentiment ---------------------------------------------------------------------------

def simple_sql(text, pos, neg):
    p, n = hits(text, pos), hits(text, neg)
    return f"CASE WHEN {p} + {n} = 0 THEN 0.0 ELSE ({p} - {n})::DOUBLE / ({p} + {n}) END"


MIXED_POSITIVE = POSITIVE + ("that", "retiti")


@query("d6_simple_sentiment", f"""SELECT doc_id, round({simple_sql('text', MIXED_POSITIVE,
  NEGATIVE + ('with',))}, 6) AS score, round({simple_sql('text', lx.SIMPLE_POSITIVE,
  lx.SIMPLE_NEGATIVE)}, 6) AS default_score FROM documents""")
def _(t):
    text = F.col("text")
    return t("documents").select(
        "doc_id",
        rounded(tx.simple_sentiment(text, MIXED_POSITIVE, NEGATIVE + ("with",))).alias("score"),
        rounded(tx.simple_sentiment(text)).alias("default_score"))


TOKEN_GOOD = ("that", "with", "avec", "nicht", "les")
TOKEN_BAD = NEGATIVE + ("this", "from", "pour")


def negation_sql(good, bad, negations):
    chars = lx.TOKEN_STRIP_CHARS
    return f"""w AS (SELECT doc_id, {LOWER_WORDS} AS l FROM documents),
    k AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM w),
    c AS (SELECT doc_id, i, trim(x, '{chars}') AS x FROM k),
    p AS (SELECT doc_id, x, coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY i) IN
            {in_list(negations)}, false) AS flip FROM c),
    s AS (SELECT doc_id, sum(CASE WHEN x IN {in_list(good)} AND NOT flip THEN 1.0
              WHEN x NOT IN {in_list(good)} AND x IN {in_list(bad)} AND flip THEN 0.5
              ELSE 0.0 END)::DOUBLE AS pos,
            sum(CASE WHEN x IN {in_list(good)} THEN flip::INT
              WHEN x IN {in_list(bad)} THEN (NOT flip)::INT ELSE 0 END)::DOUBLE AS neg
          FROM p GROUP BY doc_id),
    scored AS (SELECT doc_id, CASE WHEN pos > neg AND pos >= 2 THEN 'positive'
        WHEN neg > pos AND neg >= 2 THEN 'negative' ELSE 'neutral' END AS label,
        CASE WHEN pos > neg AND pos >= 2 THEN least(0.8, (pos - neg) * 0.15)
        WHEN neg > pos AND neg >= 2 THEN -least(0.8, (neg - pos) * 0.15) ELSE 0.0 END AS score
      FROM s)"""


@query("d7_negation_sentiment", f"""WITH {negation_sql(TOKEN_GOOD, TOKEN_BAD, NEGATIONS)}
  SELECT doc_id, coalesce(label, 'neutral') AS label, round(coalesce(score, 0)::DOUBLE, 6) AS score
  FROM documents LEFT JOIN scored USING (doc_id)""")
def _(t):
    mood = tx.negation_sentiment(F.col("text"), TOKEN_GOOD, TOKEN_BAD, NEGATIONS)
    return t("documents").select("doc_id", mood.alias("m")).select(
        "doc_id", "m.label", rounded(F.col("m.score")).alias("score"))


@query("d8_vote_sentiment", f"""SELECT doc_id, {vote_label('text', POSITIVE, NEGATIVE)} AS label,
  round(sign({hits('text', POSITIVE)} - {hits('text', NEGATIVE)}) * 0.6::DOUBLE, 6) AS score
  FROM documents""")
def _(t):
    return t("documents").select("doc_id", tx.vote_sentiment(F.col("text"), POSITIVE, NEGATIVE)
                                 .alias("m")).select("doc_id", "m.label",
                                                     rounded(F.col("m.score")).alias("score"))


REBALANCED = ("that", "les")


@query("d9_rebalance", f"""WITH {ART}, share AS (SELECT avg((sentiment = 'neutral')::INT) AS s
  FROM art) SELECT id, CASE WHEN s > 0.5 THEN {vote_label('content', REBALANCED, NEGATIVE)}
    ELSE sentiment END AS sentiment, round(CASE WHEN s > 0.5 THEN 0.4 * sign(
    {hits('content', REBALANCED)} - {hits('content', NEGATIVE)}) ELSE sentiment_score END, 6)
    ::DOUBLE AS score FROM art, share""")
def _(t):
    rows = t.articles.select("id", "content", "sentiment", "sentiment_score")
    out = sentiment.rebalance(rows, "content", 0.5, REBALANCED, NEGATIVE)
    return out.select("id", "sentiment", rounded(F.col("sentiment_score")).alias("score"))


@query("d10_polarity_label", """SELECT event_id, CASE WHEN (value - 10) / 40 > 0.1 THEN 'positive'
  WHEN (value - 10) / 40 < -0.1 THEN 'negative' ELSE 'neutral' END AS label,
  CASE WHEN (value - 10) / 40 > 0.05 THEN 'positive' WHEN (value - 10) / 40 < -0.05
  THEN 'negative' ELSE 'neutral' END AS narrow FROM events""")
def _(t):
    score = (F.col("value") - 10) / 40
    return t("events").select("event_id", tx.polarity_label(score).alias("label"),
                              tx.polarity_label(score, -0.05, 0.05).alias("narrow"))


VALENCE_SQL = "(VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in VALENCE) + ") v(word, val)"


@query("d11_compound_score", f"""WITH w AS (SELECT doc_id, trim(unnest({LOWER_WORDS}),
    '{lx.KEYWORD_STRIP_CHARS.replace(chr(39), chr(39) * 2)}') AS word FROM documents),
  s AS (SELECT doc_id, sum(val) AS s FROM w JOIN {VALENCE_SQL} USING (word) GROUP BY doc_id)
  SELECT doc_id, round(coalesce(s / sqrt(s * s + 15), 0), 6) AS compound
  FROM documents LEFT JOIN s USING (doc_id)""")
def _(t):
    valence = t.spark.createDataFrame(list(VALENCE), "word string, valence double")
    out = sentiment.compound_score(t("documents"), "doc_id", "text", valence)
    return out.select("doc_id", rounded(F.col("compound")).alias("compound"))


# --- hype ----------------------------------------------------------------------------------

LOUD = ("therha", "oushed", "you won't believe", "license")
FELT = ("stupid", "worthless", "andre")
N_WORDS = f"len({fill(WORDS, 'text')})"
ENTS = "len(regexp_extract_all(text, '[A-Z][a-z]{3,}'))"
SENS = (f"({hits('text', LOUD)} * 2 + {hits('text', FELT)} + length(text) - "
        "length(replace(text, '!', '')) + coalesce(length(regexp_replace(text, '\\P{Lu}+', '', "
        "'g'))::DOUBLE / nullif(length(text), 0), 0) * 5)")
DENS = f"(coalesce({ENTS}::DOUBLE / nullif({N_WORDS}, 0) * 10, 0))"


@query("d12_hype_score", f"""SELECT doc_id,
  round(CASE WHEN length(text) < 10 THEN 0 ELSE greatest(0, least(10, {SENS} - {DENS})) END, 5)
    ::DOUBLE AS hype,
  round(CASE WHEN length(text) < 10 THEN 0 ELSE {SENS} END, 5)::DOUBLE AS sensationalism,
  round(CASE WHEN length(text) < 10 THEN 0 ELSE {DENS} END, 5)::DOUBLE AS density
  FROM documents""")
def _(t):
    names = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))
    return t("documents").select("doc_id", tx.hype_score(F.col("text"), names, LOUD, FELT)
                                 .alias("h")).select(
        "doc_id", *[rounded(F.col(f"h.{c}"), 5).alias(c)
                    for c in ("hype", "sensationalism", "density")])


TITLE_WORDS = ((("retiti", "avec"), 2.0), (("nicht", "ung"), 2.0), (("that", "les"), 1.5),
               (("with", "der"), 0.8))


def title_points(text):
    points = [f"CASE WHEN {hits(text, ws)} > 0 THEN {p}::DOUBLE ELSE 0 END" for ws, p in TITLE_WORDS]
    points.append(f"CASE WHEN regexp_matches({text}, '[!?]') THEN 1.0::DOUBLE ELSE 0 END")
    points.append(f"CASE WHEN regexp_matches({text}, '{CAPITAL_SQL}') THEN 1.2::DOUBLE "
                  "ELSE 0 END")
    return "round(least(5.0::DOUBLE, " + " + ".join(points) + "), 2)"


@query("d13_title_sensationalism", f"""SELECT doc_id, {title_points('text')} AS points
  FROM documents""")
def _(t):
    return t("documents").select("doc_id", tx.title_sensationalism(F.col("text"), TITLE_WORDS)
                                 .alias("points"))


@query("d14_factual_density", f"""SELECT doc_id, coalesce(round({ENTS}::DOUBLE /
  nullif({N_WORDS}, 0) * 100, 2), 0)::DOUBLE AS density FROM documents""")
def _(t):
    names = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))
    return t("documents").select("doc_id", tx.factual_density(names, F.col("text"))
                                 .alias("density"))


WEIGHTED = (f"least(5.0::DOUBLE, {hits('text', LOUD)} * 2.0::DOUBLE + CASE WHEN "
            f"regexp_matches(text, '{CAPITAL_SQL}') THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN "
            "length(text) - length(replace(text, '!', '')) > 1 OR length(text) - "
            "length(replace(text, '?', '')) > 1 THEN 1.0::DOUBLE ELSE 0 END)")


@query("d15_net_hype", f"""SELECT doc_id, s AS sensationalism, round(greatest(0, least(10, s -
  coalesce(round({ENTS}::DOUBLE / nullif({N_WORDS}, 0) * 100, 2), 0) / 2)), 6)::DOUBLE AS net
  FROM (SELECT *, {WEIGHTED} AS s FROM documents)""")
def _(t):
    names = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))
    d = t("documents").select(
        "doc_id", tx.weighted_sensationalism(F.col("text"), LOUD).alias("sensationalism"),
        tx.factual_density(names, F.col("text")).alias("density"))
    return d.select("doc_id", "sensationalism", rounded(tx.net_hype(
        F.col("sensationalism"), F.col("density"))).alias("net"))


@query("d16_quadrant", """SELECT l_returnflag AS flag, CASE
    WHEN l_tax > 0.04 AND l_discount > 0.05 THEN 'Sensationalist News'
    WHEN l_tax > 0.04 THEN 'Clickbait / Noise' WHEN l_discount > 0.05 THEN 'Quality Journalism'
    ELSE 'Inert Content' END AS zone, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(t):
    zone = tx.quadrant(F.col("l_discount"), F.col("l_tax"), 0.05, 0.04)
    return t("lineitem").groupBy(F.col("l_returnflag").alias("flag"), zone.alias("zone")).agg(
        F.count("*").alias("n"))


@query("d17_risk_band", """SELECT event_id, CASE WHEN value >= 8 THEN 'extreme clickbait'
  WHEN value >= 6 THEN 'high clickbait risk' WHEN value >= 4 THEN 'moderate sensationalism'
  WHEN value >= 2 THEN 'acceptable range' ELSE 'high-quality journalism' END AS band
  FROM events""")
def _(t):
    return t("events").select("event_id", tx.risk_band(F.col("value")).alias("band"))


# --- entities --------------------------------------------------------------------------------

GAZETTEER = ("Anon", "Thon", "Tion", "Eren", "Licen", "aire", "ung ", "Reth")


@query("d18_gazetteer", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(
  [source], list_filter({text_list(GAZETTEER)}, lambda n: contains(text, n))))), ',') AS names
  FROM documents""")
def _(t):
    return t("documents").select("doc_id", joined(entities.extract_from_gazetteer(
        F.col("text"), GAZETTEER, F.array("source"))).alias("names"))


@query("d18_gazetteer_join", """WITH g AS (SELECT DISTINCT
    array_to_string(string_split(text, ' ')[2:3], ' ') AS name FROM benchmark
    UNION SELECT DISTINCT string_split(text, ' ')[2] FROM benchmark)
  SELECT doc_id, name FROM documents JOIN g ON contains(text, name)""")
def _(t):
    parts = F.split("text", " ", -1)
    g = t("benchmark").select(F.explode(F.array(
        F.array_join(F.slice(parts, 2, 2), " "), F.get(parts, F.lit(1)))).alias("name")).distinct()
    return entities.match_gazetteer(t("documents"), "doc_id", "text", g)


@query("d19_entity_groups", f"""WITH {MENTIONS}, g AS (SELECT DISTINCT id, text, CASE
    WHEN label = 'PERSON' THEN 'p' WHEN label IN ('ORG', 'PRODUCT') THEN 'o'
    WHEN label IN ('GPE', 'LOC') THEN 'l' END AS kind FROM mentions),
  r AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY text) AS rn FROM g
        WHERE kind IS NOT NULL)
  SELECT id, coalesce(string_agg(text, ',' ORDER BY text) FILTER (kind = 'p'), '') AS persons,
    coalesce(string_agg(text, ',' ORDER BY text) FILTER (kind = 'o'), '') AS organizations,
    coalesce(string_agg(text, ',' ORDER BY text) FILTER (kind = 'l'), '') AS locations
  FROM r WHERE rn <= 5 GROUP BY id""")
def _(t):
    out = entities.entity_groups(t.mentions, "id")
    return out.select("id", *[joined(F.col(c)).alias(c)
                              for c in ("persons", "organizations", "locations")])


GENERIC = ("that", "this", "with", "from")


@query("d20_drop_generic", f"""WITH {MENTIONS} SELECT CASE WHEN label IN ('PERSON', 'ORG', 'EVENT')
    THEN 'entity' ELSE 'location' END AS role, text, count(*) AS n FROM mentions
  WHERE label <> 'PRODUCT' AND lower(text) NOT IN {in_list(GENERIC)} GROUP BY 1, 2""")
def _(t):
    return entities.drop_generic(t.mentions, GENERIC).groupBy("role", "text").agg(
        F.count("*").alias("n"))


KNOWN = ("Thon", "Erin", "Tion")


@query("d21_validate_entities", f"""WITH w AS (SELECT doc_id AS id,
    unnest(regexp_extract_all(text, '[A-Za-z]{{3,}}[A-Z]*')) AS text FROM documents),
  m AS (SELECT id, text, {text_list(('PERSON', 'ORG', 'GPE', 'LOC', 'PRODUCT', 'EVENT'))}
    [length(text) % 6 + 1] AS label FROM w)
  SELECT text, label, count(*) AS n FROM m WHERE label IN ('ORG', 'GPE', 'PERSON')
    AND lower(text) NOT IN {in_list(lx.ENTITY_STOP_WORDS)}
    AND NOT regexp_matches(lower(text), '{"|".join(lx.GIBBERISH)}')
    AND ({" OR ".join(f"contains(text, '{k}')" for k in KNOWN)} OR (label IN ('ORG', 'GPE')
      AND length(regexp_replace(text, '[^A-Z]', '', 'g')) >= 2)) GROUP BY 1, 2""")
def _(t):
    labels = F.array(*[F.lit(x) for x in ("PERSON", "ORG", "GPE", "LOC", "PRODUCT", "EVENT")])
    found = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}[A-Z]*"), F.lit(0))
    words = one_per_item(t("documents"), found, "text", [F.col("doc_id").alias("id")])
    m = words.withColumn("label", F.get(labels, F.length("text") % 6))
    return entities.validate_entities(m, KNOWN).groupBy("text", "label").agg(
        F.count("*").alias("n"))


@query("d22_top_words", f"""SELECT word, count(*) AS n FROM (SELECT unnest({LOWER_WORDS}) AS word
  FROM documents) WHERE regexp_matches(word, '^\\p{{L}}+$') AND word NOT IN {in_list(STOP_WORDS)}
  GROUP BY word ORDER BY n DESC, word LIMIT 10""")
def _(t):
    stop = t.spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")
    return entities.top_words(t("documents"), "text", 10, stop)


# --- summaries ---------------------------------------------------------------------------------

@query("d23_cluster_summary", f"""WITH r AS (SELECT source, doc_id, text, row_number() OVER (
    PARTITION BY source ORDER BY doc_id) AS t FROM documents),
  c AS (SELECT source, t, regexp_split_to_array({fill(CLEAN_ASCII, 'text')}, '[.?\\n]+') AS l
    FROM r WHERE t <= 5),
  p AS (SELECT source, t, generate_subscripts(l, 1) AS p, trim(unnest(l)) AS part FROM c),
  o AS (SELECT source, part, min((t, p)) AS pos FROM p WHERE length(part) > 30
    AND NOT starts_with(part, 'Click') AND NOT starts_with(part, 'Read')
    AND NOT starts_with(part, 'Subscribe') GROUP BY source, part),
  n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS n FROM o),
  j AS (SELECT source, string_agg(part, '. ' ORDER BY n) || '.' AS s FROM n WHERE n <= 3
    GROUP BY source)
  SELECT r.source, coalesce(CASE WHEN length(s) > 300 THEN left(s, 297) || '...' ELSE s END,
    left(r.text, 200) || '...') AS summary FROM r LEFT JOIN j USING (source) WHERE t = 1""")
def _(t):
    return summaries.cluster_summaries(t("documents"), "source", "text", ["doc_id"])


@query("d24_lead_summary", """SELECT doc_id, array_to_string(string_split(text, '.')[1:3], '. ')
  || '.' AS summary FROM documents""")
def _(t):
    return t("documents").select("doc_id", tx.lead_summary(F.col("text")).alias("summary"))


# The words of a text's first sentences are a subsequence of the text's, so all of them are common.
@query("d25_rouge_l", r"""WITH p AS (SELECT lang,
    len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS whole,
    len(regexp_extract_all(lower(array_to_string(string_split(coalesce(text, ''), '.')[1:3], '. ')),
      '[a-z0-9]+')) AS lead FROM documents)
  SELECT lang, round(avg(CASE WHEN lead > 0 THEN 2.0 * lead / (whole + lead) ELSE 0 END), 6) AS rouge_l
  FROM p GROUP BY lang""")
def _(t):
    pairs = t("documents").select("lang", "text", tx.lead_summary(F.col("text"), 3).alias("lead"))
    return pairs.groupBy("lang").agg(
        F.round(F.avg(summaries.rouge_l(F.col("text"), F.col("lead"))), 6).alias("rouge_l"))


# The table of common lengths, a row for each word of the other title.
@query("d25_rouge_titles", f"""WITH {ART}, w AS (SELECT id,
    regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+') AS w FROM art),
  p AS (SELECT a.id, a.w AS a, b.w AS b FROM w a JOIN w b ON b.id = a.id + 1),
  l AS (SELECT id, len(a) AS m, len(b) AS n, list_reduce(list_prepend(
      list_transform(range(len(a) + 1), lambda z: 0::BIGINT), list_transform(range(len(b)), lambda y: [y + 1])),
    lambda p, y: list_reduce(list_prepend([0::BIGINT], list_transform(range(len(a)), lambda x: [x + 1])),
      lambda q, x: list_append(q, CASE WHEN a[x[1]] = b[y[1]] THEN p[x[1]] + 1
        ELSE greatest(p[x[1] + 1], q[len(q)]) END)))[len(a) + 1] AS common FROM p)
  SELECT id, CASE WHEN common > 0 THEN round(2.0 * common / (m + n), 6) ELSE 0 END::DOUBLE AS rouge_l FROM l""")
def _(t):
    titles = t.articles.select("id", "title")
    other = titles.select((F.col("id") - 1).alias("id"), F.col("title").alias("other"))
    return titles.join(other, "id").select("id", F.round(
        summaries.rouge_l(F.col("title"), F.col("other")), 6).alias("rouge_l"))


@query("d27_event_id", """SELECT doc_id, 'evt_' || left(sha256(doc_id::VARCHAR), 16) AS event_id
  FROM documents""")
def _(t):
    return t("documents").select("doc_id", tx.event_id(F.col("doc_id")).alias("event_id"))


@query("enrich_articles", f"""WITH {negation_sql(TOKEN_GOOD, TOKEN_BAD, lx.NEGATIONS)}
  SELECT 'https://example.org/' || doc_id AS url, coalesce(label, 'neutral') AS sentiment,
    round(coalesce(score, 0)::DOUBLE, 6) AS sentiment_score, 'live_news' AS theme
  FROM documents LEFT JOIN scored USING (doc_id)
  WHERE trim(regexp_extract(text, '^[^.\\n]*')) <> '' AND {hits('text', NEGATIVE)} = 0""")
def _(t):
    rows = nz.normalize_articles(raw_news(t), F.lit("2024-03-01 00:00:00").cast("timestamp"))
    out = nz.enrich_articles(rows, blocked_words=NEGATIVE, positive=TOKEN_GOOD, negative=TOKEN_BAD)
    return out.select("url", "sentiment", rounded(F.col("sentiment_score"))
                      .alias("sentiment_score"), "theme")
