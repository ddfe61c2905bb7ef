"""Places: lookups and totals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import lexicons as lx
from newsloom.operators.bounds import broadcast_if_small


def coordinates(spark: SparkSession, table: Mapping[str, tuple] = lx.LOCATION_COORDS) -> DataFrame:
    rows = [(name, float(lat), float(lon)) for name, (lat, lon) in table.items()]
    return spark.createDataFrame(rows, "location string, lat double, lon double")


def country_aliases(spark: SparkSession,
                    table: Mapping[str, str] = lx.COUNTRY_ALIASES) -> DataFrame:
    return spark.createDataFrame(list(table.items()), "location string, country string")


def country_totals(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions per country; ``mentions(location, mentions)`` is already one row per place."""
    return mentions.join(broadcast_if_small(aliases), "location").groupBy("country").agg(
        F.sum("mentions").alias("mentions"))


def map_markers(mentions: DataFrame, coords: DataFrame, scale: float = 2.0, cap: float = 20.0,
                default: tuple[float, float] | None = None) -> DataFrame:
    """Places with coordinates and a marker radius of mentions/scale, at most ``cap``.

    Unknown places are dropped, or put at ``default`` if one is given.
    """
    known = mentions.join(broadcast_if_small(coords), "location", "left" if default else "inner")
    if default:
        known = known.withColumns({"lat": F.coalesce("lat", F.lit(default[0])),
                                   "lon": F.coalesce("lon", F.lit(default[1]))})
    return known.withColumn("radius", F.least(F.col("mentions") / F.lit(scale), F.lit(cap)))
