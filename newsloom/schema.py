"""Canonical schemas of the records that flow through the engine."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _I, _L, _B, _TS = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(),
    T.TimestampType(),
)
_STRINGS = T.ArrayType(T.StringType())

RAW_NEWS = _struct(
    id=_S, source=_S, author=_S, title=_S, description=_S, content=_S, url=_S, urlToImage=_S,
    publishedAt=_S, published_at=_S, ingested_at=_S, timestamp=_S, platform=_S, category=_S,
)

RAW_SOCIAL = _struct(
    post_id=_S, platform=_S, username=_S, user=_S, content=_S, text=_S, location=_S,
    timestamp=_S, likes=_L, retweets=_L, is_event_related=_B, hashtags=_STRINGS,
)

ARTICLE = _struct(
    id=_S, title=_S, description=_S, content=_S, source=_S, author=_S, url=_S, category=_S,
    theme=_S, published_at=_TS, ingested_at=_TS, event_time=_TS, timestamp=_TS,
    entities=_STRINGS, locations=_STRINGS, entity_count=_I, matched_event=_I, cluster_id=_I,
    sentiment=_S, sentiment_score=_D, sensationalism_score=_D, factual_density=_D,
    cluster_confidence=_D, cluster_topic=_S, cluster_keywords=_STRINGS, is_clickbait=_B,
    embedding_vector=T.ArrayType(T.FloatType()),
)

LIVE_FEED = _struct(
    id=_S, title=_S, description=_S, source=_S, url=_S, published_at=_S, ingested_at=_S,
    category=_S, sentiment=_S, sentiment_score=_D,
)

DETECTED_EVENT = _struct(
    event_id=_S, keywords=_STRINGS, vector=T.ArrayType(T.FloatType()), title=_S, source=_S,
    timestamp=_TS, similarity=_D, is_new=_B,
)

ENTITY_GROUPS = _struct(persons=_STRINGS, organizations=_STRINGS, locations=_STRINGS)

ENRICHED = _struct(
    event_id=_S, event_title=_S, social_text=_S, platform=_S, user=_S, location=_S,
    matched_keywords=_STRINGS, timestamp=_TS, enriched_at=_TS, sentiment=_D,
    entities=ENTITY_GROUPS, likes=_L, retweets=_L,
)

LATENCY_METRIC = _struct(
    timestamp=_TS, kafka_timestamp=_TS, elasticsearch_timestamp=_TS, latency_ms=_D,
    throughput_level=_I, article_id=_S, test_sequence=_I, load_test_id=_S,
)
