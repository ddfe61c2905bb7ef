"""The driver's tables seen as articles, posts, vectors and feeds; the same views in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import lexicons as lx
from newsloom.functions.text import vote
from newsloom.operators.bounds import one_per_item
from newsloom.operators.entities import extract_from_gazetteer

# Lexicons that occur in the test tables, so that every branch is taken.
POSITIVE = ("nicht", "avec")
NEGATIVE = ("worthless", "stupid", "idiot")
NEGATIONS = ("of", "the")
PLACES = ("Anon", "Eren", "Ther", "Thon", "Tion")
STOP_WORDS = ("the", "and", "that", "with", "les", "des", "die", "der", "que", "los")
VALENCE = (("that", 1.5), ("with", 0.8), ("avec", 0.4), ("nicht", -1.2), ("stupid", -2.0),
           ("worthless", -2.5))
LABELS = ("PERSON", "ORG", "GPE", "LOC", "PRODUCT", "EVENT")
NAME_PATTERN = "[A-Z][a-z]{3,}"


def stamp(ts: Column | str) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM-dd HH:mm:ss")


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 turned into 0.0."""
    return F.round(value, digits) + F.lit(0.0)


def labelled(df: DataFrame, key: str) -> DataFrame:
    """(key, text, label): capitalised words of a text, labelled by their length."""
    names = F.regexp_extract_all("text", F.lit(NAME_PATTERN), F.lit(0))
    labels = F.array(*[F.lit(x) for x in LABELS])
    return one_per_item(df, names, "text", [key]).withColumn(
        "label", F.get(labels, F.length("text") % len(LABELS)))


class Tables:
    """Views over one folder of Parquet tables. All are lazy and prune their columns."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def articles(self) -> DataFrame:
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        return self("documents").select(
            F.col("doc_id").alias("id"),
            F.trim(F.regexp_extract("text", r"^[^.\n]*", 0)).alias("title"),
            F.col("text").alias("content"), "source", F.col("lang").alias("category"),
            (start + F.make_dt_interval(mins=(F.col("doc_id") * 7).cast("int")))
            .alias("published_at"),
            F.regexp_extract_all("text", F.lit(NAME_PATTERN), F.lit(0)).alias("entities"),
            extract_from_gazetteer(F.col("text"), PLACES).alias("locations"),
            vote(F.col("text"), POSITIVE, NEGATIVE, 0.6).alias("mood"),
        ).select("*", F.col("mood.label").alias("sentiment"),
                 F.col("mood.score").alias("sentiment_score")).drop("mood")

    @cached_property
    def mentions(self) -> DataFrame:
        """(id, text, label): capitalised words, labelled by their length."""
        return labelled(self("documents").withColumnRenamed("doc_id", "id"), "id")

    @cached_property
    def posts(self) -> DataFrame:
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        number = F.col("conv_id") * 100 + F.col("turn")
        return self("conversations").select(
            number.alias("post_id"), "text", F.col("role").alias("user"),
            (start + F.make_dt_interval(mins=(F.col("conv_id") * 60 + F.col("turn")).cast("int")))
            .alias("post_ts"))

    @cached_property
    def vectors(self) -> DataFrame:
        """(id, vector, label, ts): the vector's time is that of the event with its id."""
        times = self("events").select(F.col("event_id").alias("id"), "ts")
        return self("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label").join(
            times, "id")

    @cached_property
    def places(self) -> DataFrame:
        """(location, mentions): customers per nation, with the spelling of the gazetteers."""
        nation = self("nation").select("n_nationkey", F.initcap(F.lower("n_name")).alias("location"))
        counts = self("customer").groupBy("c_nationkey").agg(F.count("*").alias("mentions"))
        return counts.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")
                           ).select("location", "mentions")  # nation: one row per country


# --- the same views for the oracle -----------------------------------------------------

def text_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def in_list(words) -> str:
    return "(" + text_list(words)[1:-1] + ")"


def hits(text: str, words) -> str:
    return "(" + " + ".join(
        "contains(lower({}), '{}')::INT".format(text, w.lower().replace("'", "''"))
        for w in words) + ")"


def vote_label(text: str, positive, negative) -> str:
    diff = f"({hits(text, positive)} - {hits(text, negative)})"
    return f"CASE WHEN {diff} > 0 THEN 'positive' WHEN {diff} < 0 THEN 'negative' ELSE 'neutral' END"


def distinct_in_order(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def fill(template: str, value: str) -> str:
    """Put a value where ``:x:`` stands; braces of regular expressions stay as they are."""
    return template.replace(":x:", value)


# The same white space written out, since RE2 has no Unicode flag.
SQL_SPACE = (
    r"\t-\r\x{1c}- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SQL_SPACES = f"[{SQL_SPACE}]+"
WORDS = f"list_filter(regexp_split_to_array(:x:, '{SQL_SPACES}'), lambda w: w <> '')"
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"

ART = f"""art AS (
  SELECT doc_id AS id, trim(regexp_extract(text, '^[^.\\n]*')) AS title, text AS content, source,
    lang AS category, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 7) AS published_at,
    regexp_extract_all(text, '{NAME_PATTERN}') AS entities,
    list_filter({text_list(PLACES)}, lambda n: contains(text, n)) AS locations,
    {vote_label('text', POSITIVE, NEGATIVE)} AS sentiment,
    sign({hits('text', POSITIVE)} - {hits('text', NEGATIVE)}) * 0.6::DOUBLE AS sentiment_score
  FROM documents)"""

MENTIONS = f"""mentions AS (
  SELECT id, text, {text_list(LABELS)}[length(text) % {len(LABELS)} + 1] AS label FROM (
    SELECT doc_id AS id, unnest(regexp_extract_all(text, '{NAME_PATTERN}')) AS text FROM documents))"""

POSTS = """posts AS (
  SELECT conv_id * 100 + turn AS post_id, text, role AS "user",
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 60 + turn) AS post_ts
  FROM conversations)"""

VECTORS = """vectors AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label, ts
  FROM embeddings JOIN events ON event_id = vec_id)"""

PLACES_SQL = """places AS (
  SELECT array_to_string(list_transform(string_split(lower(n_name), ' '),
           lambda w: upper(w[1]) || w[2:]), ' ') AS location, count(*) AS mentions
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"""

# Times at which a user's events stay if others within an hour after a kept one go.
KEPT = """kept AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
  UNION ALL SELECT k.user_id, min(e.ts) FROM kept k JOIN events e
    ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 1 HOUR GROUP BY 1)"""
