"""Keyword, sentiment and scoring functions on text columns.

Everything here is a Column expression over built-in functions. Word tests over a
short list become one ``contains`` per word (inside generated code); tests per token
use ``isin``, which Spark turns into a hash-set lookup for long lists.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import lexicons as lx


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words, no empty ones."""
    return F.filter(F.split(text, lx.SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    parts = F.split(text, lx.SPACES)
    # Splitting leaves an empty part before leading and after trailing white space.
    edges = (F.get(parts, F.lit(0)) == "").cast("int") + (
        F.get(parts, F.size(parts) - 1) == "").cast("int")
    return F.greatest(F.size(parts) - edges, F.lit(0))


def hit_count(text: Column, lexicon: Sequence[str]) -> Column:
    """How many lexicon entries occur in the text, each counted once, ignoring case."""
    lowered = F.lower(text)
    return reduce(add, [lowered.contains(F.lit(w.lower())).cast("int") for w in lexicon])


def any_hit(text: Column, lexicon: Sequence[str]) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [lowered.contains(F.lit(w.lower())) for w in lexicon])


def title_keywords(text: Column, top_n: int = 5,
                   stop_words: Sequence[str] = lx.KEYWORD_STOP_WORDS) -> Column:
    """First distinct words longer than three, stripped of punctuation, no stop words."""
    long = F.filter(F.split(F.lower(text), lx.SPACES), lambda w: F.length(w) > 3)
    stripped = F.transform(long, lambda w: F.trim(w, F.lit(lx.KEYWORD_STRIP_CHARS)))
    kept = F.filter(stripped, lambda w: (F.length(w) > 3) & ~w.isin(*stop_words)
                    & w.rlike(r"^[\p{L}\p{N}]+$"))
    return F.slice(F.array_distinct(kept), 1, top_n)


def plain_keywords(text: Column, max_keywords: int = 10) -> Column:
    """Distinct words among the first purely alphabetic ones longer than four."""
    kept = F.filter(F.split(F.lower(text), lx.SPACES),
                    lambda w: (F.length(w) > 4) & w.rlike(r"^\p{L}+$"))
    return F.array_distinct(F.slice(kept, 1, max_keywords))


def cluster_key(keywords: Column) -> Column:
    """Eight hex digits that name the group of articles with the same leading keywords."""
    first = F.array_sort(F.slice(keywords, 1, 5))
    return F.left(F.md5(F.array_join(first, "").cast("binary")), F.lit(8))


def contains_keyword(text: Column, keywords: Column) -> Column:
    lowered = F.lower(text)
    return F.exists(keywords, lambda k: F.contains(lowered, F.lower(k)))


def matching_keywords(text: Column, keywords: Column) -> Column:
    lowered = F.lower(text)
    return F.filter(keywords, lambda k: F.contains(lowered, F.lower(k)))


def distinct_first(items: Column, n: int) -> Column:
    return F.slice(F.array_distinct(items), 1, n)


def overlap_size(items: Column, top: Column) -> Column:
    return F.size(F.filter(items, lambda e: F.array_contains(top, e)))


# --- sentiment ---------------------------------------------------------------

def simple_sentiment(text: Column, positive: Sequence[str] = lx.SIMPLE_POSITIVE,
                     negative: Sequence[str] = lx.SIMPLE_NEGATIVE) -> Column:
    """(hits for - hits against) / hits, 0 without hits."""
    pos, neg = hit_count(text, positive), hit_count(text, negative)
    return F.coalesce(F.try_divide((pos - neg).cast("double"), (pos + neg).cast("double")),
                      F.lit(0.0))


def vote(text: Column, positive: Sequence[str], negative: Sequence[str], weight: float) -> Column:
    """struct(label, score) by majority of substring hits."""
    balance = F.coalesce(hit_count(text, positive) - hit_count(text, negative), F.lit(0))
    label = F.when(balance > 0, "positive").when(balance < 0, "negative").otherwise("neutral")
    return F.struct(label.alias("label"), (F.signum(balance) * weight).alias("score"))


def vote_sentiment(text: Column, positive: Sequence[str] = lx.VOTE_POSITIVE,
                   negative: Sequence[str] = lx.VOTE_NEGATIVE) -> Column:
    return vote(text, positive, negative, 0.6)


def negation_sentiment(text: Column, positive: Sequence[str] = lx.TOKEN_POSITIVE,
                       negative: Sequence[str] = lx.TOKEN_NEGATIVE,
                       negations: Sequence[str] = lx.NEGATIONS) -> Column:
    """struct(label, score) from whole words; a negation right before a word flips it.

    A negated positive word counts 1 against, a negated negative word 0.5 in favour.
    A side wins with at least 2 and more than the other; the score is 0.15 per point of
    difference, at most 0.8 either way.

    Each word becomes one digit (1 positive, 2 negative, 3 negation, 0 other); the counts
    are those of the digits and of the pairs "31" and "32" in the resulting string.
    """
    def digit(w: Column) -> Column:
        return (F.when(w.isin(*positive), "1").when(w.isin(*negative), "2")
                .when(w.isin(*negations), "3").otherwise("0"))

    digits = F.array_join(F.transform(
        F.split(F.lower(text), lx.SPACES),
        lambda w: digit(F.trim(w, F.lit(lx.TOKEN_STRIP_CHARS)))), "")
    def count(d: Column) -> Column:
        flipped_pos, flipped_neg = pattern_count(d, "31"), pattern_count(d, "32")
        return F.struct(
            (char_count(d, "1") - flipped_pos + flipped_neg * 0.5).alias("pos"),
            (char_count(d, "2") - flipped_neg + flipped_pos).cast("double").alias("neg"))

    def decide(c: Column) -> Column:
        pos, neg = c["pos"], c["neg"]
        up = (pos > neg) & (pos >= 2)
        down = (neg > pos) & (neg >= 2)
        size = F.least(F.lit(0.8), F.abs(pos - neg) * 0.15)
        return F.struct(
            F.when(up, "positive").when(down, "negative").otherwise("neutral").alias("label"),
            F.when(up, size).when(down, -size).otherwise(0.0).alias("score"))

    return let(let(digits, count), decide)


def polarity_label(score: Column, low: float = -0.1, high: float = 0.1) -> Column:
    return F.when(score > high, "positive").when(score < low, "negative").otherwise("neutral")


# --- hype and factual density --------------------------------------------------

def upper_ratio(text: Column) -> Column:
    upper = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    return F.coalesce(F.try_divide(upper.cast("double"), F.length(text).cast("double")),
                      F.when(text.isNotNull(), 0.0))


def pattern_count(text: Column, pattern: str) -> Column:
    """Occurrences of a fixed string that cannot overlap itself."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit("")))
    return (removed / len(pattern)).cast("int") if len(pattern) > 1 else removed


def char_count(text: Column, char: str) -> Column:
    return pattern_count(text, char)


def hype_score(text: Column, entities: Column, sensational: Sequence[str] = lx.SENSATIONAL_WORDS,
               emotional: Sequence[str] = lx.EMOTIONAL_WORDS) -> Column:
    """struct(hype, sensationalism, density); zeros for texts under ten characters."""
    # A short text becomes null and null figures become 0: without branches, figures that
    # are used twice are computed once.
    shown = F.when(F.length(text) >= 10, text)
    sens = F.coalesce(hit_count(shown, sensational) * 2 + hit_count(shown, emotional)
                      + char_count(shown, "!") + upper_ratio(shown) * 5.0, F.lit(0.0))
    n_entities = F.coalesce(F.array_size(entities), F.lit(0))
    density = F.coalesce(F.try_divide(n_entities.cast("double"),
                                      word_count(shown).cast("double")) * 10.0, F.lit(0.0))
    hype = F.greatest(F.lit(0.0), F.least(F.lit(10.0), sens - density))
    return F.struct(hype.alias("hype"), sens.alias("sensationalism"), density.alias("density"))


CAPITAL_WORD = (rf"(?U)(?:^|[{lx.SPACE_CLASS}])[^\p{{Ll}}{lx.SPACE_CLASS}]*\p{{Lu}}"
                rf"[^\p{{Ll}}{lx.SPACE_CLASS}]*(?:[{lx.SPACE_CLASS}]|$)")


def has_capital_word(text: Column) -> Column:
    """True if some word has an upper-case and no lower-case letter."""
    return text.rlike(CAPITAL_WORD)


def title_sensationalism(title: Column, rules: Sequence[tuple] = lx.TITLE_RULES,
                         punctuation: float = 1.0, capitals: float = 1.2,
                         cap: float = 5.0) -> Column:
    """Points for trigger words, '!' or '?', and all-capital words, at most ``cap``."""
    points = [F.when(any_hit(title, rule), value).otherwise(0.0) for rule, value in rules]
    points.append(F.when(title.rlike("[!?]"), punctuation).otherwise(0.0))
    points.append(F.when(has_capital_word(title), capitals).otherwise(0.0))
    return F.round(F.least(reduce(add, points), F.lit(cap)), 2)


def factual_density(entities: Column, text: Column) -> Column:
    """Entities per 100 words, two decimals; 0 for a text without words."""
    n = F.coalesce(F.array_size(entities), F.lit(0)).cast("double")
    return F.coalesce(F.round(F.try_divide(n, word_count(text).cast("double")) * 100.0, 2),
                      F.lit(0.0))


def weighted_sensationalism(title: Column, hype_words: Sequence[str] = lx.HYPE_WORDS,
                            word_points: float = 2.0, capitals: float = 1.5,
                            repeated_marks: float = 1.0, cap: float = 5.0) -> Column:
    """The other published scale: points per trigger word, for capitals, for '!!' or '??'."""
    many = (char_count(title, "!") > 1) | (char_count(title, "?") > 1)
    total = (hit_count(title, hype_words) * word_points
             + F.when(has_capital_word(title), capitals).otherwise(0.0)
             + F.when(many, repeated_marks).otherwise(0.0))
    return F.least(total, F.lit(cap))


def net_hype(sensationalism: Column, density: Column) -> Column:
    """Sensationalism less half the factual density, kept within 0..10."""
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), sensationalism - density / 2.0))


def quadrant(density: Column, sensationalism: Column, x_cut: float = 0.5,
             y_cut: float = 0.5) -> Column:
    loud, dense = sensationalism > y_cut, density > x_cut
    return (F.when(loud & dense, "Sensationalist News").when(loud, "Clickbait / Noise")
            .when(dense, "Quality Journalism").otherwise("Inert Content"))


def risk_band(hype: Column) -> Column:
    return (F.when(hype >= 8, "extreme clickbait").when(hype >= 6, "high clickbait risk")
            .when(hype >= 4, "moderate sensationalism").when(hype >= 2, "acceptable range")
            .otherwise("high-quality journalism"))


# --- summaries and identifiers ---------------------------------------------------

def lead_summary(text: Column, sentences: int = 3) -> Column:
    """The first parts of the text between full stops."""
    return F.concat(F.array_join(F.slice(F.split(text, r"\."), 1, sentences), ". "), F.lit("."))


def event_id(seed: Column) -> Column:
    """Replayable event identifier from the article that starts the event."""
    return F.concat(F.lit("evt_"), F.left(F.sha2(seed.cast("string"), 256), F.lit(16)))


def document_key(event: Column, timestamp: Column, user: Column) -> Column:
    """Key of an enriched document: event, time without colons, user."""
    return F.concat_ws("_", F.coalesce(event, F.lit("unknown")),
                       F.replace(F.coalesce(timestamp, F.lit("")), F.lit(":"), F.lit("")),
                       F.coalesce(user, F.lit("unknown")))
