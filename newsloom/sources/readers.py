"""Scans: topics, JSON lines, JSON arrays, CSV, tables, landed feeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.normalize import matched_event, parse_timestamp, split_list
from newsloom.operators.boards import newest
from newsloom.operators.ranking import top_per_group


def topic_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest"
                 ) -> DataFrame:
    """A topic's values as a streaming ``value`` string column.

    Needs the Kafka connector on the class path; every consumer below takes any streaming
    DataFrame with a ``value`` column instead, such as ``text_stream``.
    """
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("startingOffsets", starting).load())
    return raw.select(F.col("value").cast("string").alias("value"),
                      F.col("timestamp").alias("kafka_timestamp"))


def text_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of files that land in a folder, as a streaming ``value`` column."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def table_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def decode_json(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Adds ``record`` (null if undecodable) and ``_corrupt`` (the text that failed)."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(F.col(value), full, {"mode": "PERMISSIVE",
                                              "columnNameOfCorruptRecord": "_corrupt"})
    out = df.withColumn("__parsed", parsed)
    bad = F.col("__parsed").isNull() | F.col("__parsed._corrupt").isNotNull()
    record = F.struct(*[F.col(f"__parsed.`{f.name}`").alias(f.name) for f in schema.fields])
    return out.withColumns({"record": F.when(~bad, record),
                            "_corrupt": F.when(bad, F.col(value))}).drop("__parsed")


def decoded_rows(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """The records that decode; ``decode_json`` also shows the others."""
    return decode_json(df, schema, value).filter(F.col("record").isNotNull()).select("record.*")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def newest_first(df: DataFrame, *candidates: str) -> DataFrame:
    """Adds ``timestamp`` from the first candidate that parses and sorts newest first."""
    stamp = F.coalesce(*[parse_timestamp(F.col(c)) for c in candidates])
    return df.withColumn("timestamp", stamp).orderBy(F.desc_nulls_last("timestamp"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, key: str = "id"
                    ) -> DataFrame:
    """Files that each hold one JSON array; repeated records count once per key.

    Such a file cannot be split, so one task reads one file.
    """
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.dropDuplicates([key])


def read_csv_articles(spark: SparkSession, path: str, schema: T.StructType,
                      lists: Sequence[str] = ("entities", "locations"),
                      limit: int | None = None) -> DataFrame:
    """CSV with ', '-joined lists and textual timestamps; empty text is an empty list."""
    rows = spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True)
    out = rows.withColumns({c: split_list(F.col(c)) for c in lists if c in rows.columns})
    if "timestamp" in out.columns:
        out = out.withColumn("timestamp", parse_timestamp(F.col("timestamp").cast("string")))
    if "matched_event" not in out.columns and "entities" in out.columns:
        out = out.withColumn("matched_event", matched_event(F.col("entities")))
    return out.limit(limit) if limit else out


def newest_rows(table: DataFrame, ts: str, key: str, size: int) -> DataFrame:
    """Snapshot: the newest rows of a table, newest first."""
    return newest(table, ts, key, size)


def full_scan(table: DataFrame, exclude: Sequence[str] = ("embedding_vector",)) -> DataFrame:
    """Every row without the excluded columns, which are then never read."""
    return table.drop(*exclude)


def row_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("count"))


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All feeds' rows; a column a feed lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
