"""Entity mentions: extraction, typing, validation, frequency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import lexicons as lx
from newsloom.operators.bounds import broadcast_if_small, one_per_item
from newsloom.operators.matching import match_substrings
from newsloom.operators.ranking import newest_first, top_per_group


def extract_from_gazetteer(text: Column, names: Sequence[str],
                           existing: Column | None = None) -> Column:
    """Sorted distinct gazetteer names that occur in the text, with those already known.

    Every name is tried on every text; gazetteer tables belong in ``match_gazetteer``.
    """
    found = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(text, n))
    found = F.coalesce(found, F.array().cast("array<string>"))
    if existing is not None:
        found = F.concat(F.coalesce(existing, F.array().cast("array<string>")), found)
    return F.array_sort(F.array_distinct(found))


def match_gazetteer(docs: DataFrame, key: str, text: str, gazetteer: DataFrame,
                    name: str = "name") -> DataFrame:
    """Distinct (key, name) pairs for a gazetteer of any size."""
    return match_substrings(docs, [key], text, gazetteer, name, fold_case=False)


def entity_groups(mentions: DataFrame, key: str | Sequence[str], per_group: int = 5
                  ) -> DataFrame:
    """(key…, persons, organizations, locations): first names of each kind in sorted order.

    Mentions are reduced to the names kept before any list is built.
    """
    kind = (F.when(F.col("label") == "PERSON", "persons")
            .when(F.col("label").isin("ORG", "PRODUCT"), "organizations")
            .when(F.col("label").isin("GPE", "LOC"), "locations"))
    keys = [key] if isinstance(key, str) else list(key)
    names = mentions.select(*keys, kind.alias("kind"), "text").filter("kind is not null").distinct()
    kept = top_per_group(names, [*keys, "kind"], ["text"], per_group)

    def group(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == name, F.col("text")))).alias(name)

    return kept.groupBy(*keys).agg(group("persons"), group("organizations"), group("locations"))


def drop_generic(mentions: DataFrame, generic: Sequence[str] = lx.GENERIC_ENTITIES) -> DataFrame:
    """Mentions worth keeping, with ``role`` entity or location."""
    role = (F.when(F.col("label").isin("PERSON", "ORG", "EVENT"), "entity")
            .when(F.col("label").isin("GPE", "LOC"), "location"))
    return mentions.withColumn("role", role).filter(
        F.col("role").isNotNull() & ~F.lower("text").isin(*generic) & (F.length("text") > 1))


def validate_entities(mentions: DataFrame, known: Sequence[str] = lx.ORGANIZATIONS + lx.PLACES,
                      stop_words: Sequence[str] = lx.ENTITY_STOP_WORDS,
                      gibberish: Sequence[str] = lx.GIBBERISH) -> DataFrame:
    """Keep mentions of known names, and other ORG/GPE names with two capitals or more.

    An optional boolean column ``is_proper_noun`` is honoured if present.
    """
    text = F.trim(F.col("text"))
    lowered = F.lower(text)
    is_known = F.exists(F.array(*[F.lit(n) for n in known]), lambda n: F.contains(text, n))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", "")) >= 2
    keep = (
        F.col("label").isin("ORG", "GPE", "PERSON") & (F.length(text) >= 3)
        & ~lowered.isin(*stop_words) & ~lowered.rlike("|".join(gibberish))
        & text.rlike(r"^[A-Za-z\s]+$")
        & (is_known | (F.col("label").isin("ORG", "GPE") & capitals))
    )
    if "is_proper_noun" in mentions.columns:
        keep = keep & F.col("is_proper_noun")
    return mentions.filter(keep).withColumn("text", text)


def frequency(df: DataFrame, items: str, name: str = "entity", by: Sequence[str] = ()
              ) -> DataFrame:
    """Mentions per item (and per ``by``), counted before the shuffle and after."""
    exploded = one_per_item(df, items, name, by)
    return exploded.groupBy(*by, name).agg(F.count("*").alias("mentions"))


def top_entities(df: DataFrame, items: str, k: int, name: str = "entity") -> DataFrame:
    return frequency(df, items, name).orderBy(F.desc("mentions"), name).limit(k)


def top_entities_by(df: DataFrame, items: str, by: str, k: int, name: str = "entity"
                    ) -> DataFrame:
    return top_per_group(frequency(df, items, name, [by]), [by], [F.desc("mentions"), name], k,
                         rank="rank")


def articles_of_top_entities(df: DataFrame, key: str, items: str, k: int) -> DataFrame:
    """(entity, mentions, article…) for the k most frequent entities, each article once."""
    top = F.broadcast(top_entities(df, items, k))  # k rows
    rest = [c for c in df.columns if c != items]
    exploded = one_per_item(df, F.array_distinct(items), "entity", rest)
    return exploded.join(top, "entity")


def top_stories(df: DataFrame, items: str, ts: str, tie: str, entities: int = 3,
                headlines: int = 3, min_articles: int = 2) -> DataFrame:
    """Newest distinct headlines of the most frequent entities with enough articles."""
    narrow = df.select(tie, "title", F.col(ts), items)
    tagged = articles_of_top_entities(narrow, tie, items, entities)
    # One row per entity and title before ranking, so a hot entity is already reduced.
    titles = tagged.groupBy("entity", "mentions", "title").agg(
        F.count("*").alias("n"),
        F.min(newest_first(F.col(ts), F.col(tie))).alias("at"))
    order = ["at", "title"]
    ranked = top_per_group(titles.filter(F.col("title") != ""), ["entity"], order, headlines,
                           rank="rank")
    sizes = titles.groupBy("entity").agg(F.sum("n").alias("articles")).filter(
        F.col("articles") >= min_articles)  # one row per entity
    return ranked.join(F.broadcast(sizes), "entity").select(
        "entity", "mentions", "articles", "rank", "title")


def top_words(df: DataFrame, text: str, k: int, stop_words: DataFrame) -> DataFrame:
    """Most frequent alphabetic words of a text column that are not stop words."""
    tokens = one_per_item(df, F.split(F.lower(text), lx.SPACES), "word").filter(
        F.col("word").rlike(r"^\p{L}+$"))
    counts = tokens.groupBy("word").agg(F.count("*").alias("n"))
    return counts.join(broadcast_if_small(stop_words.select("word")), "word", "left_anti").orderBy(
        F.desc("n"), "word").limit(k)
