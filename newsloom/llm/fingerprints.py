"""Op 2. Homomorphic multiset hashes of documents, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import shuffle_partitions

EQUAL_LANES, EQUAL_BITS = 16, 32    # of SHA-512: equal multisets of paragraphs
NEAR_LANES, NEAR_BITS = 128, 24     # random signs: how much two multisets share
BLOCK = 1 << 14                     # elements; four sums of so many signs fit in one long
PIECE = r"[^\x20\x09-\x0D]++(?:[\x20\x09]++[^\x20\x09-\x0D]++){0,2}+"


def _elements(text: Column, which: int) -> Column:
    """Two kinds of (which, exact, value): a paragraph's SHA-512, and its pieces of three words."""
    def element(exact, value):
        return F.struct(F.lit(which).alias("which"), F.lit(exact).alias("exact"),
                        value.alias("value"))

    paragraphs = F.transform(F.split(text, "\n"), lambda p: element(True, F.sha2(p, 512)))
    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)),
                         lambda p: element(False, p))
    return F.concat(paragraphs, pieces)


def _sums() -> list[Column]:
    """Lane sums of a block of elements.

    An equality lane adds up 32 bits of each paragraph's hash. A likeness lane adds up a sign for
    each piece: here the signs' bits, four lanes in the 16-bit fields of one long.
    """
    exact = F.col("e.exact")
    out = [F.sum(F.when(exact, F.conv(F.substring("e.value", 8 * k + 1, 8), 16, 10).cast("long"))
                 .otherwise(0)).alias(f"x{k}") for k in range(EQUAL_LANES)]
    fields = F.lit(0x0001000100010001)
    for seed, name in enumerate(("h0", "h1")):
        out += [F.sum(F.when(exact, 0).otherwise(F.shiftright(F.col(name), k).bitwiseAND(fields)))
                .alias(f"n{seed}_{k}") for k in range(16)]
    return out + [F.sum(F.when(exact, 0).otherwise(1)).alias("pieces")]


def _lanes() -> Column:
    """A block's lanes as one array: equality lanes, then likeness lanes (signs added up)."""
    exact = [F.col(f"x{k}") for k in range(EQUAL_LANES)]
    near = [2 * F.shiftright(F.col(f"n{seed}_{k}"), 16 * f).bitwiseAND(0xFFFF) - F.col("pieces")
            for seed in range(2) for k in range(16) for f in range(4)]
    return F.array(*exact, *near)


def _combined(blocks: Column, which: int) -> Column:
    """The sum of the blocks' lanes modulo 2^32 (equality) and 2^24 (likeness, signed)."""
    zero = F.array_repeat(F.lit(0).cast("long"), EQUAL_LANES + NEAR_LANES)
    total = F.aggregate(F.filter(blocks, lambda b: b["which"] == which), zero,
                        lambda a, b: F.zip_with(a, b["lanes"], lambda x, y: x + y))
    half = 1 << (NEAR_BITS - 1)
    return F.transform(total, lambda x, i: F.when(
        i < EQUAL_LANES, x.bitwiseAND((1 << EQUAL_BITS) - 1)).otherwise(
        (x + half).bitwiseAND((1 << NEAR_BITS) - 1) - half))


def _text(lanes: Column) -> Column:
    """Hexadecimal, eight digits for an equality lane and six for a likeness lane."""
    return F.array_join(F.transform(lanes, lambda x, i: F.when(
        i < EQUAL_LANES, F.lpad(F.hex(x), 8, "0")).otherwise(
        F.lpad(F.hex(x.bitwiseAND((1 << NEAR_BITS) - 1)), 6, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the product of two lane arrays by the sum of their squares; equal ones 1."""
    near = [F.slice(x, EQUAL_LANES + 1, NEAR_LANES) for x in (a, b)]

    def total(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0),
                           lambda s, v: s + v)

    share = 2 * total(*near) / F.nullif(total(near[0], near[0]) + total(near[1], near[1]), F.lit(0.0))
    return F.when(a == b, 1.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0)))))


def lanes_of(df: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """``keys`` and, for each text column, its array of lanes (``texts`` name them).

    Words travel through one generator into a partial aggregate, so no row is wider than its keys.
    ``keys`` must tell rows apart; a partitioning by some of them is kept.
    """
    elements = F.concat(*[_elements(F.coalesce(F.col(t), F.lit("")), k)
                          for k, t in enumerate(texts)])
    rows = df.select(*keys, F.posexplode(elements).alias("pos", "e"))
    rows = rows.select(*keys, F.shiftright("pos", BLOCK.bit_length() - 1).alias("block"), "e",
                       F.xxhash64("e.value").alias("h0"),
                       F.xxhash64(F.lit(1), "e.value").alias("h1"))
    blocks = rows.groupBy(*keys, "block", F.col("e.which").alias("which")).agg(*_sums())
    blocks = blocks.select(*keys, F.struct("which", _lanes().alias("lanes")).alias("b"))
    lists = blocks.groupBy(*keys).agg(F.collect_list("b").alias("blocks"))
    return lists.select(*keys, *[_combined(F.col("blocks"), k).alias(t)
                                 for k, t in enumerate(texts)])


def fingerprint(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, fingerprint, lanes) of each text; ``key`` must tell rows apart.

    A fingerprint is the sum, lane by lane modulo a power of two, of wide vectors hashed from the
    text's paragraphs (lines): 16 lanes of a paragraph's SHA-512, modulo 2^32, and 128 lanes of
    random signs of its pieces of three words, modulo 2^24. The order of paragraphs does not count,
    and adding or subtracting lanes inserts or deletes paragraphs (``add``).
    """
    out = lanes_of(df.select(key, F.col(text).alias("lanes")), [key], ["lanes"])
    return out.select(key, _text(F.col("lanes")).alias("fingerprint"), "lanes")


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the paragraphs of both texts, or (sign -1) of the first without the second's."""
    half = 1 << (NEAR_BITS - 1)
    return F.transform(F.zip_with(a, b, lambda x, y: x + sign * y), lambda x, i: F.when(
        i < EQUAL_LANES, x.bitwiseAND((1 << EQUAL_BITS) - 1)).otherwise(
        (x + half).bitwiseAND((1 << NEAR_BITS) - 1) - half))


def _buckets(docs: DataFrame, count: int) -> DataFrame:
    """``bucket``: ranges of the numeric id with about equally many rows, in the id's order.

    Null ids come first, in 64 ranges of the text's hash.
    """
    shares = F.array(*[F.lit(k / count) for k in range(1, count)]) if count > 1 else F.array(F.lit(0.5))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("double"), shares, 20 * count)).first()[0]
    splits = [float("-inf"), *(sorted(set(cuts or [])) or [0.0]), float("inf")]
    ranges = Bucketizer(splits=splits, inputCol="__id", outputCol="__range", handleInvalid="keep")
    out = ranges.transform(docs.withColumn("__id", F.col("doc_id").cast("double")))
    null_range = F.shiftright("copy", 58) - 32  # -64 to -1, in the hash's order
    return out.withColumn("bucket", F.when(F.col("doc_id").isNull(), null_range).otherwise(
        F.col("__range")).cast("long")).drop("__id", "__range")


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The
    edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document by ascending id; the last document is followed by the first.

    Texts are shuffled once, into ranges of the id; the first row of each range goes to the range
    before as well. Sorting, edits, hashing and sums then stay there.

    A null text is empty. Ids are numbers; null ids come first. Rows of one id are ordered by a
    hash of their text and then as they come: equal rows are each other's neighbours. Other columns
    are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = _buckets(rows.withColumn("copy", F.xxhash64("text")),
                    shuffle_partitions(spark, docs, 32 << 20))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "copy")
    # One row for each range, read by one window.
    firsts = rows.groupBy("bucket").agg(F.min(key).alias("first"))
    order = Window.orderBy("bucket")
    firsts = firsts.select(
        "bucket", "first", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(
            order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    firsts = firsts.select(F.col("bucket").alias("b"), F.col("first").alias("f"), "to")
    both = rows.join(F.broadcast(firsts), (F.col("bucket") == F.col("b"))
                     & (F.col("f.copy") == F.col("copy"))
                     & F.col("f.doc_id").eqNullSafe(F.col("doc_id")), "left")
    own = F.struct("bucket", F.lit(False).alias("guest"))
    guest = F.struct(F.col("to").alias("bucket"), F.lit(True).alias("guest"))
    dealt = both.select(
        F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, guest)))
        .alias("p"), "doc_id", "copy", "text").select("p.bucket", "p.guest", "doc_id", "copy", "text")
    line = Window.partitionBy("bucket").orderBy(
        "guest", F.col("doc_id").asc_nulls_first(), "copy")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    placed = dealt.select(
        "bucket", "doc_id", "text", "guest", F.row_number().over(line).alias("place"),
        F.lead("text").over(line).alias("following"))
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")),
                      F.substring(F.coalesce("following", F.lit("")), F.lit(1), half))
    ready = placed.select(
        "bucket", "place", "doc_id", "guest", n.cast("long").alias("n_chars"), "text",
        F.when(F.col("guest"), "").otherwise(edited).alias("edited"))
    ready = ready.select("*", F.unhex(F.sha2("edited", 256)).alias("digest"))
    lanes = lanes_of(ready, ["bucket", "place", "doc_id", "guest", "n_chars", "digest"],
                     ["text", "edited"])
    line = Window.partitionBy("bucket").orderBy("place")
    following = lanes.withColumn("following", F.lead("text").over(line)).filter(~F.col("guest"))
    return following.select(
        "doc_id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"),
        F.lower(_text(F.col("text"))).alias("fingerprint"),
        F.lower(_text(F.col("edited"))).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"),
        likeness(F.col("text"), F.col("following")).alias("near_next"))
