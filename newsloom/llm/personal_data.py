"""Op 7. Personal data by seed patterns and bootstrapped contexts, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import materialize

KINDS = ("email", "ip", "card", "phone")
# The leftmost matches of the base patterns. A match can begin at the first character of a run
# only, or where the match before ended; possessive parts never go back.
_MAIL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must contain for a kind's pattern to be worth running.
HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}",
         "phone": r"\+[0-9]"}
# An identifier-like run: number words with single blanks between them, or else one word that has
# a digit or an at sign. It begins after a blank or a label's mark, and touches no base span.
_BLANK, _MASK, _MARK = r"\x20\x09-\x0D", "\x01", r"\x01"
_NUMBER = rf"[(+]{{0,2}}[0-9][0-9().+/-]*+(?![^{_BLANK},;:!?\"'\])}}])"
TOKEN = (rf"(?<![^{_BLANK}=:])(?:{_NUMBER}(?:\x20{_NUMBER})*+"
         rf"|[^{_BLANK}{_MARK}=:0-9@]*+[0-9@][^{_BLANK}{_MARK}]*+(?!{_MARK}))")
AROUND = 256  # characters before and after a candidate in which its contexts are looked for
ROUNDS, LEAST_SUPPORT, LEAST_CONFIDENCE = 3, 3, 0.8

_SPAN = "struct<start:bigint,end:bigint,value:string,before:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    length = F.length(digits)

    def worth(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when((length - i) % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), length), F.lit(0), lambda a, i: a + worth(i))
    return F.when(length.between(14, 19), total % 10 == 0).otherwise(False)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, hint: str, valid) -> Column:
    """Valid matches: (start, end, value, before), in code points; ``before`` is the gap before.

    The pieces between the matches have the lengths that tell the matches' places.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found,
                       lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(state, pair):
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"),
                        pair["value"].alias("value"), pair["gap"].alias("before"))
        return F.struct(end.cast("long").alias("at"),
                        F.when(valid(pair["value"]), F.concat(state["out"], F.array(span)))
                        .otherwise(state["out"]).alias("out"))

    spans = F.aggregate(pairs, zero, step, lambda s: s["out"])
    return F.when(text.rlike(hint), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def base_spans(text: Column) -> Column:
    """(start, rank, end, kind) of the base kinds' matches; ``rank`` is the kind's place."""
    def spans(rank, kind):
        found = matches(text, PATTERNS[kind], HINTS[kind], lambda v: _valid(kind, v))
        return F.transform(found, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
            F.lit(kind).alias("kind")))

    return F.concat(*[spans(rank, kind) for rank, kind in enumerate(KINDS)])


def _masked(text: Column, base: Column) -> Column:
    """The text with every character of a base span replaced by a mark, so that places stay."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, span):
        start, end = (F.greatest(state["at"], span[x]) for x in ("start", "end"))
        return F.struct(end.alias("at"), F.concat(
            state["out"], F.substring(text, (state["at"] + 1).cast("int"),
                                      (start - state["at"]).cast("int")),
            F.repeat(F.lit(_MASK), (end - start).cast("int"))).alias("out"))

    return F.aggregate(base, zero, step, lambda s: F.concat(
        s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def _shapes(value: Column) -> tuple[Column, Column]:
    """The exact shape (9 for digits, a for letters, w for both) and the coarse one.

    The coarse shape is an at sign, w, a number of four or more dotted parts, or how many digits a
    number has: under 7, 14, 20 or more.
    """
    exact = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        value, "[0-9]+", "9"), r"\p{L}+", "a"), "(?:a9|9a)[a9]*", "w")
    many = F.length(_digits(value))
    coarse = (F.when(value.contains("@"), "~@").when(value.rlike(r"\p{L}"), "~w")
              .when(value.rlike(r"^[0-9]+(?:\.[0-9]+){3,}$"), "~.").when(many < 7, "~9")
              .when(many < 14, "~99").when(many < 20, "~999").otherwise("~9999"))
    return exact, coarse


def _candidates(text: Column, base: Column, masked: Column) -> Column:
    """(start, end, value, left, right, exact, coarse, kind) of base spans and identifier-like runs.

    ``kind`` is a base span's and else null. ``left`` is the word before, ``right`` the two words
    after (one alone says little), in lower case and without marks; empty: there is none.
    """
    def plain(word):
        return F.lower(F.regexp_replace(word, r"^[^\p{L}0-9=:]+|[^\p{L}0-9=:]+$", ""))

    def described(start, end, value, kind):
        lead = F.greatest(start - AROUND, F.lit(0))
        before = F.substring(text, (lead + 1).cast("int"), (start - lead).cast("int"))
        after = F.substring(text, (end + 1).cast("int"), F.lit(AROUND))
        pair = rf"^[^{_BLANK}\p{{L}}0-9]*+[{_BLANK}]++([^{_BLANK}]++)[{_BLANK}]++([^{_BLANK}]++)"
        first, second = (plain(F.regexp_extract(after, pair, k)) for k in (1, 2))
        exact, coarse = _shapes(value)
        return F.struct(
            start.alias("start"), end.alias("end"), value.alias("value"),
            plain(F.regexp_extract(before, rf"([^{_BLANK}]++)[{_BLANK}]*+$", 1)).alias("left"),
            F.when((first != "") & (second != ""), F.concat_ws(" ", first, second))
            .otherwise("").alias("right"),
            exact.alias("exact"), coarse.alias("coarse"), kind.alias("kind"))

    def trimmed(s):
        core = F.regexp_extract(
            s["value"], r"(?:\(\+?[0-9]+\)|\+?[\p{L}0-9])(?:.*[\p{L}0-9])?", 0)
        start = s["start"] + F.position(core, s["value"]) - 1
        return described(start, start + F.length(core), core, F.lit(None).cast("string"))

    seeds = F.transform(base, lambda b: described(b["start"], b["end"], F.substring(
        text, (b["start"] + 1).cast("int"), (b["end"] - b["start"]).cast("int")), b["kind"]))
    words = F.transform(matches(masked, TOKEN, "[0-9@]", lambda v: v.rlike(r"[\p{L}0-9]")), trimmed)
    return F.filter(F.concat(seeds, words), lambda w: (w["left"] != "") | (w["right"] != ""))


def score_patterns(found: DataFrame, rounds: int = ROUNDS, support: int = LEAST_SUPPORT,
                   confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Accepted patterns: (context, shape, kind, confidence).

    ``found`` has one row for each (context, shape, value, kind or null). Seeds are values with a
    kind. A pattern's confidence is the sum of its distinct values' scores divided by their number;
    it is accepted with ``support`` good values and ``confidence`` or more. A value without a kind
    scores 1 - product of (1 - confidence) over its accepted patterns in the next round. Each
    round's scores are written, so a lost executor costs that round alone.
    """
    edges = materialize(found.groupBy("context", "shape", "value").agg(F.max("kind").alias("kind")),
                        "pii-edges")
    scores = edges.groupBy("value").agg(F.max("kind").alias("seed")).select(
        "value", "seed", F.when(F.col("seed").isNull(), 0.0).otherwise(1.0).alias("score"))
    patterns = None
    for _ in range(rounds):
        linked = edges.drop("kind").join(scores, "value")
        patterns = linked.groupBy("context", "shape").agg(
            (F.sum("score") / F.count("*")).alias("confidence"),
            F.sum(F.when(F.col("score") >= confidence, 1).otherwise(0)).alias("support"),
            F.mode("seed", True).alias("kind"))
        patterns = materialize(patterns.filter(
            (F.col("support") >= support) & (F.col("confidence") >= confidence)
            & F.col("kind").isNotNull()), "pii-patterns")
        raised = edges.drop("kind").join(patterns, ["context", "shape"]).groupBy("value").agg(
            F.max("kind").alias("kind"),
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("raised"))
        scores = materialize(scores.join(raised, "value", "left").select(
            "value", F.coalesce("seed", "kind").alias("seed"),
            F.greatest("score", F.coalesce("raised", F.lit(0.0))).alias("score")), "pii-scores")
    return patterns.select("context", "shape", "kind", "confidence")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each whole text.

    Base spans are the matches of the four seed patterns that pass their kind's test; they are
    counted, and ``base_sha256`` digests their kind:start:end by start and kind. They are the
    seeds, each whole: a pattern is the word before an identifier-like run or the two words after
    it, with the run's exact or coarse shape, and patterns that seeds fill nearly always
    (``score_patterns``) give their kind to other runs in their place; of several kinds that of
    the highest confidence counts. Contexts are looked for in 256 characters on each side. ``spans`` lists base spans and those, likewise. Places count code points, ends are
    exclusive.

    The texts are read once and not shuffled; what later steps read is a written table of spans and
    identifier-like words. A null or empty text has no spans. Rows of one id are told apart by a
    hash of the text, so repeated rows get one result each. Null ids stay. Other columns are not
    read. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    base = rows.select("doc_id", F.xxhash64("text").alias("copy"), "text",
                       F.array_sort(base_spans(F.col("text"))).alias("base"))
    base = base.withColumn("masked", _masked(F.col("text"), F.col("base")))
    found = materialize(base.select("doc_id", "copy", "base", _candidates(
        F.col("text"), F.col("base"), F.col("masked")).alias("words")), "pii")
    sides = F.array(*[F.when(F.col(side) != "", F.struct(
        F.concat(F.lit(side + " "), side).alias("context"), F.col(shape).alias("shape")))
        for side in ("left", "right") for shape in ("exact", "coarse")])
    words = found.select("doc_id", "copy", F.explode("words").alias("w")).select(
        "doc_id", "copy", "w.*").withColumn("p", F.explode(F.array_compact(sides))).select(
        "doc_id", "copy", "start", "end", "value", "kind", "p.*")
    accepted = score_patterns(words.select("context", "shape", "value", "kind"))
    ranks = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    new = (words.filter("kind IS NULL").drop("kind").join(accepted, ["context", "shape"])
           .groupBy("doc_id", "copy", "start", "end")
           .agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
           .groupBy(F.col("doc_id").alias("d"), F.col("copy").alias("c"))
           .agg(F.collect_set(F.struct("start", ranks[F.col("kind")].alias("rank"), "end", "kind"))
                .alias("new")))
    both = found.drop("words").join(
        new, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")), "left")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return both.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.when(F.col("new").isNull(), F.col("base")).otherwise(
            F.array_sort(F.concat("base", "new")))).alias("spans"))
