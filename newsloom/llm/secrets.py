"""Op 11. Secrets by fixed patterns and by the entropy of sliding windows, by DataFrame functions
alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.personal_data import matches

KINDS = ("assign", "access", "hex")
_NAME = "(?i:password|passwd|secret|token|api_?key)"
_VALUE = "[A-Za-z0-9+/_.=-]"
PATTERNS = {
    "assign": rf"{_NAME}[\"']?\x20*[:=]\x20*[\"']?({_VALUE}+)",
    # Runs that are too short fail as a whole, so only the first place in a run needs a look.
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
HINTS = {"assign": _NAME, "access": "AKIA", "hex": "[0-9a-f]{24}"}

WINDOW = 20
# Each character class: its characters, and the least entropy in bits of a window of 20. A window
# of random characters of the class is above it in nearly all cases, words are not.
CLASSES = {
    "hex": ("0123456789abcdef", 2.9),
    "upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.4),
    "lower": ("abcdefghijklmnopqrstuvwxyz0123456789", 3.4),
    "mixed": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.7),
}
FOUND = tuple(f"entropy_{name}" for name in CLASSES)
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
# What looks random and is not: identifiers, paths, words with a number, runs along the alphabet.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?(?:[A-Za-z]+[0-9]{0,4}[/_-]+)*[A-Za-z]+[0-9]{0,4}/?$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|redacted",
    r"(?i)abcdefgh|12345678|qwertyui",
)
_BITS = 1 << 20
# n log2 n in fixed point: sums of these are exact, so steps of a window do not drift.
_WORTH = [round(_BITS * n * math.log2(n)) if n else 0 for n in range(WINDOW + 1)]

_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _span(start: Column, rank: int, end: Column, kind: str) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"),
                    end.cast("long").alias("end"), F.lit(kind).alias("kind"))


def base_spans(text: Column) -> Column:
    """(start, rank, end, kind) of the fixed patterns' matches; ``rank`` is the kind's place."""
    def valid(kind, value):
        if kind == "assign":
            return F.length(F.regexp_extract(value, PATTERNS[kind], 1)) >= 6
        return F.lit(True)

    def spans(rank, kind):
        found = matches(text, PATTERNS[kind], HINTS[kind], lambda v: valid(kind, v))
        return F.transform(found, lambda s: _span(s["start"], rank, s["end"], kind))

    return F.concat(*[spans(rank, kind) for rank, kind in enumerate(KINDS)])


def most_worth(bits: float) -> int:
    """The most that the counts' worth may be in a window of at least that entropy."""
    return math.floor(_BITS * WINDOW * (math.log2(WINDOW) - bits))


def random_windows(value: Column, alphabet: str, bits: float) -> Column:
    """(start, end) of the windows with an entropy of at least ``bits``, merged where they meet.

    ``value`` has at least 20 characters, all of the alphabet. A window's entropy is log2(20) less
    the sum of n log2 n over its characters' counts n, divided by 20. One pass keeps the counts and
    that sum; the character that enters and the one that leaves change them.
    """
    worth = F.array(*[F.lit(w).cast("long") for w in _WORTH])
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c))
    leaving = F.concat(F.array_repeat(F.lit(0), WINDOW), codes)
    moves = F.zip_with(codes, F.slice(leaving, F.lit(1), F.size(codes)),
                       lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    zero = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0).cast("long").alias("sum"),
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("runs"))

    def step(state, move):
        new, old, counts, runs = move["new"], move["old"], state["counts"], state["runs"]
        at = state["at"] + 1
        up, down = F.get(counts, new - 1), F.get(counts, old - 1)
        gain = F.get(worth, up + 1) - F.get(worth, up)
        loss = F.when(old > 0, F.get(worth, down - 1) - F.get(worth, down)).otherwise(0)
        total = F.when(new == old, state["sum"]).otherwise(state["sum"] + gain + loss)
        changed = F.when(new == old, counts).otherwise(F.transform(
            counts, lambda n, k: n + (k == new - 1).cast("int") - (k == old - 1).cast("int")))
        last = F.try_element_at(runs, F.lit(-1))
        meets = F.coalesce(last["end"] >= at - WINDOW, F.lit(False))
        start = F.when(meets, last["start"]).otherwise(at - WINDOW)
        kept = F.when(meets, F.slice(runs, F.lit(1), F.size(runs) - 1)).otherwise(runs)
        span = F.struct(start.alias("start"), at.alias("end"))
        random = (at >= WINDOW) & (total <= most_worth(bits))
        return F.struct(changed.alias("counts"), total.alias("sum"), at.alias("at"),
                        F.when(random, F.concat(kept, F.array(span))).otherwise(runs).alias("runs"))

    return F.aggregate(moves, zero, step, lambda s: s["runs"])


def _shifted(runs: Column, by: Column, place: int) -> Column:
    return F.transform(runs, lambda r: _span(by + r["start"], len(KINDS) + place, by + r["end"],
                                             FOUND[place]))


def entropy_spans(text: Column) -> Column:
    """(start, rank, end, kind) of the random parts of candidate strings.

    Candidates are runs of 20 or more of the characters ``A-Za-z0-9+/_-`` with at least two digits
    and a letter, unless the allow-list has them. A candidate belongs to the first class that holds
    all its characters.
    """
    def candidate(value):
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | value.rlike(pattern)
        return value.rlike("[0-9][^0-9]*[0-9]") & value.rlike("[A-Za-z]") & ~allowed

    found = matches(text, RUN, "[A-Za-z0-9+/_-]{20}", candidate)

    def spans(s):
        out = _none()
        for rank, (alphabet, bits) in reversed(list(enumerate(CLASSES.values()))):
            runs = _shifted(random_windows(s["value"], alphabet, bits), s["start"], rank)
            out = F.when(s["value"].rlike(f"^[{alphabet}]+$"), runs).otherwise(out)
        return out

    return F.flatten(F.transform(found, spans))


def secret_spans(docs: DataFrame, text: str, base: str, spans: str) -> DataFrame:
    """``docs`` with the fixed patterns' spans and all spans, by start and then by kind.

    A random part that lies within a span of a fixed pattern adds nothing.
    """
    both = docs.withColumn(base, F.array_sort(base_spans(F.coalesce(text, F.lit("")))))
    more = F.filter(entropy_spans(F.coalesce(text, F.lit(""))), lambda s: ~F.exists(
        base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return both.withColumn(spans, F.array_sort(F.concat(F.col(base), more)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all columns, with the name of its kind in brackets in place of each secret.

    Spans that overlap become one, named after the first. A null text stays.
    """
    base, spans = (f"__{name}_{'_'.join(docs.columns)}" for name in ("base", "spans"))
    found = secret_spans(docs, text, base, spans)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.substring(F.col(text), (state["at"] + 1).cast("int"),
                          F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        named = F.concat(state["out"], gap, F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= state["at"], named).otherwise(state["out"]).alias("out"))

    clean = F.aggregate(F.col(spans), zero, step, lambda s: F.concat(s["out"], F.substring(
        F.col(text), (s["at"] + 1).cast("int"), F.length(F.col(text)))))
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text))).select(
        docs.columns)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each whole text.

    Base spans are the matches of the three fixed patterns that are long enough: they are counted,
    and ``base_sha256`` digests their kind:start:end by start and kind. ``spans`` lists those and the
    random parts of candidate strings (``entropy_spans``), likewise. Places count code points, ends
    are exclusive.

    Each text is read once, in one stage without a shuffle. A null or empty text has no spans. Rows
    repeated whole get a result each; null ids stay. Other columns are not read. An empty table gives
    no rows. The work on a text is in proportion to its length.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = secret_spans(rows, "text", "base", "spans")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))
