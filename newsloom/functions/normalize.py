"""Projections, filters and clean-up of raw article fields (column functions)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import lexicons as lx
from newsloom.functions.text import any_hit

ISO_PATTERNS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd[ HH:mm:ss]")
RSS_PATTERN = "d MMM yyyy HH:mm:ss Z"


def blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


def first_filled(*cols: Column) -> Column:
    """First column that is neither null nor blank; '' when all are."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def source_name(source: Column, default: str = "Unknown") -> Column:
    """Name of a source that arrives as plain text or as a JSON object {id, name}."""
    is_object = F.trim(source).startswith("{")
    name = F.when(is_object, F.get_json_object(source, "$.name")).otherwise(source)
    return F.coalesce(blank_to_null(name), F.lit(default))


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 or RFC-822 text to a timestamp; null when it is neither."""
    rss = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    rss = F.regexp_replace(rss, r"\s(GMT|UTC|Z)$", " +0000")
    return F.coalesce(
        F.try_to_timestamp(text),
        *[F.try_to_timestamp(text, F.lit(p)) for p in ISO_PATTERNS],
        F.try_to_timestamp(rss, F.lit(RSS_PATTERN)),
    )


def resolve_timestamp(*candidates: Column, default: Column | None = None) -> Column:
    """First candidate text that parses, then the default."""
    parsed = [parse_timestamp(c) for c in candidates]
    return F.coalesce(*parsed, *([default] if default is not None else []))


def blocked(*texts: Column, words: Sequence[str] = lx.BLOCKED_WORDS) -> Column:
    """True if any text contains a blocked word, ignoring case."""
    return reduce(lambda a, b: a | b, [F.coalesce(any_hit(t, words), F.lit(False)) for t in texts])


def clean_for_display(text: Column) -> Column:
    """Drop tags and links, collapse white space."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", "")
    out = F.regexp_replace(out, rf"(?U)http[^{lx.SPACE_CLASS}]+", "")
    return F.trim(F.regexp_replace(out, lx.SPACES, " "))


def clean_ascii(text: Column) -> Column:
    """Tags and runs of non-ASCII characters become a blank, links disappear."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    out = F.regexp_replace(out, rf"(?U)http[^{lx.SPACE_CLASS}]+", "")
    out = F.regexp_replace(out, r"[^\x00-\x7F]+", " ")
    return F.trim(F.regexp_replace(out, lx.SPACES, " "))


def title_key(title: Column) -> Column:
    """Lower-cased title with only letters, digits, underscores and white space left."""
    return F.regexp_replace(F.lower(title), rf"(?U)[^\p{{L}}\p{{N}}_{lx.SPACE_CLASS}]", "")


def as_list(values: Column | None, scalar: Column) -> Column:
    """The list if there is one, else the scalar as a list of one, else an empty list."""
    one = F.when(blank_to_null(scalar).isNotNull(), F.array(scalar))
    options = [values] if values is not None else []
    return F.coalesce(*options, one, F.array().cast("array<string>"))


def split_list(text: Column) -> Column:
    """', '-joined text to a trimmed list; null or empty text to an empty list."""
    parts = F.transform(F.split(text, ", "), lambda p: F.trim(p))
    return F.when(F.coalesce(text, F.lit("")) != "", parts).otherwise(
        F.array().cast("array<string>"))


def entity_count(entities: Column) -> Column:
    return F.coalesce(F.array_size(entities), F.lit(0))


def matched_event(entities: Column, minimum: int = 3) -> Column:
    return (entity_count(entities) >= minimum).cast("int")


def display_location(locations: Column, default: str = "India") -> Column:
    """First place of an article with its first letter in upper case."""
    place = F.coalesce(blank_to_null(F.get(locations, F.lit(0))), F.lit(default))
    place = F.when(place == "Unknown", F.lit(default)).otherwise(place)
    return F.concat(F.upper(F.substring(place, 1, 1)), F.substr(place, F.lit(2)))


def stable_id(*parts: Column) -> Column:
    """Replayable identifier made from the fields that define a record."""
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *filled), 256)


def headline_topic(title: Column) -> Column:
    """Text before the first colon, else the first 50 characters."""
    return F.when(title.contains(":"), F.substring_index(title, ":", 1)).otherwise(
        F.substring(title, 1, 50))


def preview(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def slug(text: Column) -> Column:
    return F.translate(F.lower(text), " ", "-")


def normalize_articles(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """Raw news of either producer shape to trimmed, defaulted, typed articles.

    Rows without a title or a link are not articles and are left out.
    """
    now = F.current_timestamp() if now is None else now

    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit("")))

    out = raw.select(
        source_name(F.col("source")).alias("source"),
        text("title").alias("title"),
        text("description").alias("description"),
        text("content").alias("content"),
        text("url").alias("url"),
        F.coalesce(F.col("author"), F.lit("Unknown")).alias("author"),
        resolve_timestamp(F.col("publishedAt"), F.col("published_at"),
                          default=now).alias("published_at"),
        now.alias("ingested_at"),
    )
    return out.filter((F.col("title") != "") & (F.col("url") != ""))


def enrich_articles(articles: DataFrame, theme: str = "live_news",
                    blocked_words: Sequence[str] = lx.BLOCKED_WORDS,
                    positive: Sequence[str] = lx.TOKEN_POSITIVE,
                    negative: Sequence[str] = lx.TOKEN_NEGATIVE) -> DataFrame:
    """Blocked rows out, content fallback, sentiment and identifier in: one projection."""
    from newsloom.functions.text import negation_sentiment

    kept = articles.filter(~blocked(F.col("title"),
                                    first_filled(F.col("description"), F.col("content")),
                                    words=blocked_words))
    kept = kept.withColumn("content", first_filled(F.col("description"), F.col("content")))
    kept = kept.withColumn("mood", negation_sentiment(F.col("content"), positive, negative))
    return kept.select(
        stable_id(F.col("url"), F.col("title"), F.col("published_at")).alias("id"),
        "title", "description", "content", "source", "author", "url", "published_at",
        "ingested_at", F.coalesce("published_at", "ingested_at").alias("event_time"),
        F.col("mood.label").alias("sentiment"), F.col("mood.score").alias("sentiment_score"),
        F.lit(theme).alias("theme"),
    )


def feed_entries(entries: DataFrame, feed: str, order: Sequence[Column], per_feed: int = 15,
                 max_description: int = 500, max_content: int = 1000) -> DataFrame:
    """Landed feed entries to articles: the first entries of each feed, shortened fields."""
    from newsloom.operators.ranking import top_per_group

    first = top_per_group(entries, [feed], order, per_feed)
    name = F.coalesce(F.col("feed_title"), F.lit("RSS Feed"))
    return first.select(
        slug(name).alias("source_id"), name.alias("source_name"),
        F.coalesce(F.col("author"), F.lit("Unknown")).alias("author"),
        F.col("title"), preview(F.col("summary"), max_description).alias("description"),
        preview(F.col("summary"), max_content).alias("content"), F.col("url"),
    )
