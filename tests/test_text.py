"""Column functions with hand-computed results and the reference's default word lists."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import normalize as nz
from newsloom.functions import text as tx


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    df = spark.createDataFrame([tuple(v[0] for v in values.values())], schema)
    return df.select(column.alias("x")).first()["x"]


def on_text(spark, function, text):
    return one(spark, function(F.col("t")), t=(text, "string"))


@pytest.mark.parametrize("text, expected", [
    ("This storm, this STORM (damage) hits 2024! about their coast-line", ["storm", "damage", "hits",
                                                                          "2024"]),
    ("", []), ("a bc def", []),
    ("alpha bravo carol delta echos foxtr", ["alpha", "bravo", "carol", "delta", "echos"]),
])
def test_title_keywords(spark, text, expected):
    got = on_text(spark, tx.title_keywords, text)
    assert got == expected


def test_plain_keywords_drop_words_with_punctuation(spark):
    assert on_text(spark, tx.plain_keywords, "India. markets rally rally today x1234 in india") == \
        ["markets", "rally", "today", "india"]


def test_plain_keywords_take_ten_then_distinct(spark):
    text = " ".join(["aaaaa"] * 9 + ["bbbbb", "ccccc"])
    assert on_text(spark, tx.plain_keywords, text) == ["aaaaa", "bbbbb"]


def test_cluster_key(spark):
    import hashlib

    words = ["zebra", "apple", "mango", "grape", "lemon", "never"]
    want = hashlib.md5("".join(sorted(words[:5])).encode()).hexdigest()[:8]
    assert one(spark, tx.cluster_key(F.col("k")), k=(words, "array<string>")) == want


def test_keyword_inside_a_longer_word(spark):
    k = (["WAR", "peace"], "array<string>")
    assert one(spark, tx.matching_keywords(F.col("t"), F.col("k")), t=("Going forward", "string"),
               k=k) == ["WAR"]
    assert one(spark, tx.contains_keyword(F.col("t"), F.col("k")), t=("nothing", "string"),
               k=k) is False


@pytest.mark.parametrize("text, expected", [
    ("good and great but sad", (2 - 1) / 3), ("", 0.0), ("plain", 0.0), ("awful crisis", -1.0),
])
def test_simple_sentiment(spark, text, expected):
    assert on_text(spark, tx.simple_sentiment, text) == pytest.approx(expected)


@pytest.mark.parametrize("text, label, score", [
    ("great success and growth", "positive", 0.45),
    ("good news", "neutral", 0.0),                      # one word is not enough
    ("not good, not great!", "negative", -0.3),         # flipped to negative
    ("not bad not terrible", "neutral", 0.0),           # 0.5 each: only 1 in favour
    ("not bad not terrible win", "positive", 0.3),      # 0.5 + 0.5 + 1
    ("war death crisis attack fraud scam", "negative", -0.8),
    ("great war win crisis", "neutral", 0.0),
    ("", "neutral", 0.0),
    ("not not good success win", "positive", 0.15),
])
def test_negation_sentiment(spark, text, label, score):
    got = on_text(spark, tx.negation_sentiment, text)
    assert got["label"] == label
    assert got["score"] == pytest.approx(score)


def test_sentiment_of_null(spark):
    assert on_text(spark, tx.negation_sentiment, None)["label"] == "neutral"
    assert on_text(spark, tx.simple_sentiment, None) == 0.0


def test_vote(spark):
    assert on_text(spark, tx.vote_sentiment, "a crisis").asDict() == {"label": "negative",
                                                                      "score": -0.6}


def test_hype(spark):
    text = "SHOCKING secret exposed!! amazing"
    got = one(spark, tx.hype_score(F.col("t"), F.col("e")), t=(text, "string"),
              e=(["A"], "array<string>"))
    sens = 3 * 2 + 1 + 2 + 8 / len(text) * 5
    assert got["sensationalism"] == pytest.approx(sens)
    assert got["density"] == pytest.approx(1 / 4 * 10)
    assert got["hype"] == pytest.approx(sens - 2.5)


def test_hype_of_short_text_is_zero(spark):
    got = one(spark, tx.hype_score(F.col("t"), F.col("e")), t=("SHOCKING!", "string"),
              e=(None, "array<string>"))
    assert tuple(got) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("title, points", [
    ("Quiet day", 0.0), ("Shocking secret", 2.0), ("Shocking urgent alert", 5.0),
    ("What now?", 1.0), ("NASA launch", 1.2), ("Emergency", 0.8),
    ("SHOCKING ALERT: emergency!", 5.0),
])
def test_title_sensationalism(spark, title, points):
    assert on_text(spark, tx.title_sensationalism, title) == pytest.approx(points)


def test_weighted_sensationalism(spark):
    assert on_text(spark, tx.weighted_sensationalism, "Secret plan!!") == pytest.approx(3.0)
    assert on_text(spark, tx.weighted_sensationalism, "BREAKING shocking exposed") == 5.0


@pytest.mark.parametrize("text, n", [("", 0), ("  ", 0), (" a  b\tc d\n", 4), ("one", 1)])
def test_word_count(spark, text, n):
    assert on_text(spark, tx.word_count, text) == n


@pytest.mark.parametrize("d, s, zone", [
    (0.6, 0.6, "Sensationalist News"), (0.5, 0.6, "Clickbait / Noise"),
    (0.5, 0.5, "Inert Content"), (0.6, 0.5, "Quality Journalism")])
def test_quadrant(spark, d, s, zone):
    assert one(spark, tx.quadrant(F.col("d"), F.col("s")), d=(d, "double"), s=(s, "double")) == zone


def test_lead_summary(spark):
    assert on_text(spark, tx.lead_summary, "A. B. C. D") == "A.  B.  C."


def test_rouge_l(spark):
    from newsloom.operators.summaries import rouge_l

    df = spark.createDataFrame([("the cat sat", "the cat ran"), ("", "x"), ("a b", "a b")],
                               "a string, b string")
    got = [r[0] for r in df.select(rouge_l("a", "b")).collect()]
    assert got == pytest.approx([2 / 3, 0.0, 1.0])


# --- normalisation -----------------------------------------------------------------

@pytest.mark.parametrize("raw, name", [
    ('{"id": "x", "name": "Daily"}', "Daily"), ("Daily", "Daily"), (None, "Unknown"),
    ("", "Unknown"), ('{"id": "x"}', "Unknown")])
def test_source_name(spark, raw, name):
    assert on_text(spark, nz.source_name, raw) == name


@pytest.mark.parametrize("raw, want", [
    ("2024-01-02T03:04:05", "2024-01-02 03:04:05"),
    ("2024-01-02T03:04:05.250000+02:00", "2024-01-02 01:04:05"),
    ("Tue, 02 Jan 2024 03:04:05 GMT", "2024-01-02 03:04:05"),
    ("Tue, 2 Jan 2024 03:04:05 +0530", "2024-01-01 21:34:05"),
    ("soon", None), (None, None)])
def test_parse_timestamp(spark, raw, want):
    got = one(spark, F.date_format(nz.parse_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss"),
              t=(raw, "string"))
    assert got == want


def test_clean_for_display(spark):
    assert on_text(spark, nz.clean_for_display,
                   "<p class='x'>Hi</p>  see https://a.b/c now\n") == "Hi see now"
    assert on_text(spark, nz.clean_for_display, None) == ""


def test_title_key(spark):
    assert on_text(spark, nz.title_key, "‘Café’ — It's \"BIG\"!") == "café  its big"


def test_split_list(spark):
    assert on_text(spark, nz.split_list, "a, b,c ,  d") == ["a", "b,c", "d"]
    assert on_text(spark, nz.split_list, None) == []


def test_display_location(spark):
    def place(value):
        return one(spark, nz.display_location(F.col("l")), l=(value, "array<string>"))

    assert place(["the Middle East"]) == "The Middle East"
    assert place([]) == place(None) == place(["Unknown"]) == "India"


def test_normalize_keeps_rows_with_null_description(spark):
    raw = spark.createDataFrame(
        [("S", " T ", None, None, "u", None, None, None), ("S", "", "d", "c", "u", "a", None, None),
         ("S", "t", "d", "c", None, "a", None, None)],
        "source string, title string, description string, content string, url string, "
        "author string, publishedAt string, published_at string")
    rows = nz.normalize_articles(raw).collect()
    assert [(r["title"], r["description"], r["author"]) for r in rows] == [("T", "", "Unknown")]
