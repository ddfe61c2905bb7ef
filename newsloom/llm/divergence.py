"""Op 13. How far the sources of a lang differ in their words: exact counts and sparse pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import chunks, give_back, listed, shuffle_partitions, split_words
from newsloom.operators.bounds import broadcast_if_small
from newsloom.session import materialize, scratch_path

SCALE = 1_000_000_000
MIN_DOCUMENTS, TOP_TERMS = 3, 200
MAX_VOCABULARY = 2**31 - 1
PART_BYTES, MOST_PARTS = 256 << 20, 1024
BLOCK = 256       # sources of a lang whose pairs meet in one group
HELD = 1 << 18    # counts that a group has on average
# A task hands on what it has counted once there are so many counts by group, or bytes of terms.
TALLY_ENTRIES, TALLY_BYTES = 1 << 21, 32 << 20
BATCH_TERMS = 1 << 18
PART_TASKS, TASK_BUCKETS = 16, 4  # tasks that put a part's terms together, and buckets for each
DIGIT_BITS = 4    # a term's count is handed on by digits of so many bits

# A-Z in lower case, ASCII other than letters as a space; the rest is part of terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32
                 for b in range(256))


def _numbered(values: np.ndarray, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and the place of each value among them; ``top`` is above all."""
    if top is not None and top <= 4 * len(values):
        there = np.zeros(top, bool)
        there[values] = True
        return np.flatnonzero(there), (np.cumsum(there) - 1)[values]
    coded = pc.dictionary_encode(pa.array(values, pa.int64()))
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)


class Tally:
    """Terms of many documents: in how many of these each is, and how often by group.

    A term is ``lang``, a space and the word, so that one vocabulary keeps the langs apart.
    """

    def __init__(self):
        self.names, self.held = pa.array([], pa.large_string()), np.empty(0, np.int64)
        self.kinds: dict[int, int] = {}
        self.keys, self.counts, self.entries = [], [], 0  # keys: a group's place, and below 2^32 the term's

    def add(self, groups: list[int], langs: list[str], texts: list[str]) -> None:
        """Count a chunk of documents."""
        words, starts = split_words([t.encode().translate(_LETTERS) for t in texts])
        if not len(words):
            return
        coded, spoken = pc.dictionary_encode(words), pc.dictionary_encode(pa.array(langs, pa.string()))
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        width = len(coded.dictionary)
        found, which = _numbered(spoken.indices.to_numpy()[owner].astype(np.int64) * width
                                 + coded.indices.to_numpy(), len(spoken.dictionary) * width)
        count = len(found)
        names = pc.binary_join_element_wise(
            spoken.dictionary.take(pa.array(found // width)).cast(pa.large_string()),
            coded.dictionary.take(pa.array(found % width)).cast(pa.large_string()),
            pa.scalar(" ", pa.large_string()))
        held = np.bincount(_counted(owner * count + which)[0] % count, minlength=count)
        kinds, kind = _numbered(np.array(groups, np.int64))
        sums, n = _counted(kind[owner] * count + which)
        self.put(names, held, kinds[sums // count], sums % count, n)

    def put(self, names: pa.Array, held: np.ndarray, group: np.ndarray, term: np.ndarray, n: np.ndarray) -> None:
        """Add ``held`` documents to each of ``names``, and ``n`` occurrences in a group to its ``term``-th."""
        known = len(self.names)  # these keep their places
        coded = pc.dictionary_encode(pa.concat_arrays([self.names, names]))
        self.names, place = coded.dictionary, coded.indices.to_numpy()[known:].astype(np.int64)
        more = np.bincount(place, held, len(self.names)).astype(np.int64)
        more[:known] += self.held
        self.held = more
        kinds, kind = _numbered(group)
        number = np.array([self.kinds.setdefault(g, len(self.kinds)) for g in kinds.tolist()], np.int64)
        self.keys.append(number[kind] << 32 | place[term])
        self.counts.append(n)
        self.entries += len(n)

    def full(self) -> bool:
        return self.entries >= TALLY_ENTRIES or self.names.nbytes >= TALLY_BYTES

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, term and occurrences, one row for each term of a group."""
        keys, n = _counted(np.concatenate(self.keys), np.concatenate(self.counts))
        return np.array(list(self.kinds), np.int64)[keys >> 32], keys & 0xFFFFFFFF, n

    def hashed(self, buckets: int) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(n) % buckets for n in listed(
            self.names.cast(pa.large_binary()))), np.int64, len(self.names))

    def pieces(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """A row for each bucket of terms: what ``put`` takes, as lists."""
        if not self.entries:
            return
        bucket = self.hashed(buckets)
        order = np.argsort(bucket)
        names, held = self.names.cast(pa.string()).take(pa.array(order)), self.held[order]
        found, starts = np.unique(bucket[order], return_index=True)
        starts = np.append(starts, len(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.repeat(starts[:-1], np.diff(starts))
        group, term, n = self.sums()
        order = np.argsort(bucket[term])
        group, of, n = group[order], place[term[order]], n[order]
        ends = np.append(0, np.cumsum(np.bincount(bucket[term], minlength=buckets)[found]))
        for low, high in _runs(ends):
            def lists(values, ends):
                return pa.ListArray.from_arrays(pa.array(ends[low:high + 1] - ends[low], pa.int32()),
                                                values[ends[low]:ends[high]])

            yield pa.RecordBatch.from_arrays(
                [pa.array(found[low:high], pa.int32()), lists(names, starts), lists(pa.array(held), starts),
                 lists(pa.array(group), ends), lists(pa.array(of, pa.int32()), ends), lists(pa.array(n), ends)],
                ["bucket", "names", "held", "groups", "places", "counts"])

    def rows(self, parts: int, min_documents: int, bits: int) -> Iterator[pa.RecordBatch]:
        """The rows of ``tagged_terms``."""
        if not self.entries:
            return
        part, names = self.hashed(parts), self.names.cast(pa.string())
        most = min(min_documents, int(self.held.max()))
        some = [np.flatnonzero(self.held > k) for k in range(most)]
        for rows, seen in _lists(np.concatenate([part[x] * most + k for k, x in enumerate(some)]),
                                 np.concatenate(some), names):
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows // most, pa.int32()), seen, none, none, pa.nulls(len(rows), seen.type)],
                ["part", "seen", "grp", "times", "terms"])
        group, term, n = self.sums()
        kinds, of = _numbered(group)
        of += part[term] * len(kinds)
        span, levels = 1 << bits, -(-int(n.max()).bit_length() // bits)
        keys, chosen = [], []
        for level in range(levels):
            digit = n >> level * bits & span - 1
            some = np.flatnonzero(digit)
            keys.append((of[some] * levels + level) * span + digit[some])
            chosen.append(term[some])
        for rows, terms in _lists(np.concatenate(keys), np.concatenate(chosen), names):
            of, digit = rows // span // levels, rows % span << rows // span % levels * bits
            yield pa.RecordBatch.from_arrays(
                [pa.array(of // len(kinds), pa.int32()), pa.nulls(len(rows), terms.type),
                 pa.array(kinds[of % len(kinds)]), pa.array(digit), terms],
                ["part", "seen", "grp", "times", "terms"])


def _counted(values: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in ascending order, and how often each is there (or the sum of its ``n``)."""
    if n is None:
        values = np.sort(values)
    else:
        order = np.argsort(values)
        values, n = values[order], n[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[starts], np.diff(np.append(starts, len(values))) if n is None else np.add.reduceat(n, starts)


def _runs(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lists with some ``BATCH_TERMS`` items; ``ends`` is where each list begins (one more)."""
    low = 0
    while low < len(ends) - 1:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + BATCH_TERMS, "right")) - 1)
        yield low, high
        low = high


def _lists(key: np.ndarray, chosen: np.ndarray, names: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The distinct keys and each one's names."""
    order = np.argsort(key)
    found, n = _counted(key)
    ends = np.append(0, np.cumsum(n))
    for low, high in _runs(ends):
        yield found[low:high], pa.ListArray.from_arrays(
            pa.array(ends[low:high + 1] - ends[low], pa.int32()),
            names.take(pa.array(chosen[order[ends[low]:ends[high]]])))


def tallied(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (grp, lang, text) as pieces of tallies."""
    tally = Tally()
    for rows in chunks(batches, ["grp", "lang", "text"], "text", 8 << 20):
        tally.add(*rows)
        if tally.full():
            yield from tally.pieces(buckets)
            tally = Tally()
    yield from tally.pieces(buckets)
    del tally
    give_back()


def merged(batches: Iterator[pa.RecordBatch], parts: int, min_documents: int, bits: int
           ) -> Iterator[pa.RecordBatch]:
    """Pieces of tallies as the rows of ``tagged_terms``."""
    give_back()
    tally = Tally()
    for batch in batches:
        names, held, groups, places, counts = (batch[c] for c in ("names", "held", "groups", "places", "counts"))
        if not len(batch):
            continue
        # A row's places are those among its own names.
        first = np.append(0, np.cumsum(pc.list_value_length(names).to_numpy()))[:-1]
        of = places.flatten().to_numpy() + np.repeat(first, pc.list_value_length(places).to_numpy())
        tally.put(names.flatten().cast(pa.large_string()), held.flatten().to_numpy(),
                  groups.flatten().to_numpy(), of, counts.flatten().to_numpy())
        if tally.full():
            yield from tally.rows(parts, min_documents, bits)
            tally = Tally()
    yield from tally.rows(parts, min_documents, bits)
    del tally
    give_back()


def tagged_terms(docs: DataFrame, parts: int, min_documents: int = MIN_DOCUMENTS,
                 bits: int = 1) -> DataFrame:
    """(part, seen, grp, times, terms): the terms of the documents, put together.

    Each task counts its documents in a ``Tally``; these meet by hashed buckets of the terms, finer than
    the ``parts`` that a term goes to by its hash. A row either has ``seen``: of ``min_documents`` such
    rows, a term is in as many as there are documents with it, or in all if there are more. So the rows
    of the whole table with a term are ``min_documents`` or more just where its documents are. Or it has
    ``terms`` of a group, each of which counts ``times``: a term's number of occurrences is the sum of
    its digits of ``bits`` bits, each with its power. A tally that is full is handed on and a new one
    begun, so that a term may have several rows, but no task holds a bucket whole.
    """
    tasks = parts * PART_TASKS
    pieces = docs.select("grp", "lang", "text").mapInArrow(
        lambda batches: tallied(batches, tasks * TASK_BUCKETS),
        "bucket int, names array<string>, held array<long>, groups array<long>, places array<int>, counts array<long>")
    return pieces.repartition(tasks, "bucket").mapInArrow(
        lambda batches: merged(batches, parts, min_documents, bits),
        "part int, seen array<string>, grp long, times long, terms array<string>")


def parts_of(docs: DataFrame) -> int:
    """Parts of the terms of a table: one for each 256 MB, at most 1024.

    The table must be a scan: the estimate for a join is the product of its sides.
    """
    megabytes = shuffle_partitions(docs.sparkSession, docs, 1 << 20)
    return max(1, min(MOST_PARTS, -(-megabytes // (PART_BYTES >> 20))))


def term_counts(docs: DataFrame, parts: int, min_documents: int = MIN_DOCUMENTS
                ) -> tuple[DataFrame, DataFrame]:
    """Occurrences in each group of the terms that a lang keeps: (grp, part, at, n), and the terms'
    names (part, at, lang, term).

    ``docs`` has grp (a number), lang and text without nulls. A lang keeps the terms in at least
    ``min_documents`` of its documents: one CountVectorizer for each part of the terms makes its
    vocabulary and exact sparse vectors of groups of documents, and their entries add up by group. A part
    is a hashed share of all langs' terms. With ``parts_of`` the vocabulary that a fit holds on the
    driver is that of a bounded piece of the table (beyond 256 GB: a 1024th of all distinct terms).
    """
    spark = docs.sparkSession
    tokens, counts, vocabulary = (scratch_path(spark, n) for n in ("terms", "term-counts", "term-names"))
    tagged_terms(docs, parts, min_documents, DIGIT_BITS).write.partitionBy("part").parquet(tokens)
    # Fits need a term. No word is empty, so this one is nobody's.
    never = spark.range(min_documents).select(F.array(F.lit("")).alias("terms"))
    for part in range(parts):
        rows = spark.read.schema("seen array<string>, grp long, times long, terms array<string>, part int").parquet(
            tokens).filter(F.col("part") == part)
        seen = rows.filter("seen IS NOT NULL").select(F.col("seen").alias("terms"))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_documents),
                                vocabSize=MAX_VOCABULARY).fit(seen.unionByName(never))
        saved = scratch_path(spark, "vocabulary")
        model.save(saved)
        number = F.lit(part).alias("part")
        word = F.substring_index("name", " ", -1)
        spark.read.parquet(f"{saved}/data").select(number, F.posexplode("vocabulary").alias("at", "name")).filter(
            "name <> ''").select("part", "at", F.expr("left(name, length(name) - length(substring_index("
                                                      "name, ' ', -1)) - 1)").alias("lang"),
                                 word.alias("term")).write.mode("append").parquet(vocabulary)
        vectors = model.transform(rows.filter("terms IS NOT NULL").select("grp", "times", "terms")).select(
            "grp", "times", F.unwrap_udt("vector").alias("v"))
        # One expression: fields of the vector taken apart would each compute it again.
        entries = vectors.select("grp", "times", F.explode(F.arrays_zip(
            F.col("v.indices").alias("at"), F.col("v.values").alias("n"))).alias("e"))
        entries.groupBy("grp", F.col("e.at").alias("at")).agg(
            F.sum(F.col("e.n").cast("long") * F.col("times")).alias("n")).select(
            "grp", number, "at", "n").write.mode("append").parquet(counts)
    return (spark.read.schema("grp long, part int, at int, n long").parquet(counts),
            spark.read.schema("part int, at int, lang string, term string").parquet(vocabulary))


def _floor(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / (total + terms)), exactly: in decimals where longs are too short."""
    wide = _floor((n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"),
                  (total + terms).cast("decimal(20,0)"))
    return 1 + F.when(n < 9 * SCALE, _floor(F.when(n < 9 * SCALE, n + 1) * SCALE, total + terms)).otherwise(wide)


def distance(p: Column, q: Column) -> Column:
    return _floor((p - q) * (p - q), q)


def group_totals(groups: DataFrame, counts: DataFrame, names: DataFrame) -> DataFrame:
    """``groups`` (grp, lang, source) with spoken and place (the lang's number, the source's in the
    lang), sources, total, terms (kept terms that occur), zero (the share of the others), lang_terms
    and lang_total."""
    sums = counts.groupBy("grp").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    kept = names.groupBy("lang").agg(F.count("*").alias("lang_terms"))
    out = groups.join(sums, "grp", "left").join(kept, "lang", "left").fillna(0)
    line = Window.partitionBy("lang")
    zero = F.when(F.col("lang_terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("lang_terms")))
    return out.select(
        "*", F.min("grp").over(line).alias("spoken"), F.sum("total").over(line).alias("lang_total"),
        (F.row_number().over(line.orderBy("source")) - 1).cast("long").alias("place"),
        F.count("*").over(line).alias("sources"), zero.alias("zero"))


def _term_part(counts: DataFrame, names: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("part", "at"))
    both = counts.withColumn("all", total).join(
        groups.select("grp", "total", "lang_terms", "lang_total"), "grp")
    p = share(F.col("n"), F.col("total"), F.col("lang_terms"))
    q = share(F.col("all"), F.col("lang_total"), F.col("lang_terms"))
    both = both.select("grp", "part", "at", p.alias("p"), q.alias("q")).filter("p > q").select(
        "grp", "part", "at", distance(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("grp").orderBy(F.col("value").desc())
    some = both.withColumn("rank", F.rank().over(best)).filter(F.col("rank") <= top).drop("rank")
    out = some.join(names, ["part", "at"]).join(groups.select("grp", "source"), "grp").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return _ranked(out).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _common(table: pa.Table, size: int) -> pa.Table:
    """What pairs of sources that both have a term change, summed over the table's terms."""
    table = table.sort_by([("spoken", "ascending"), ("part", "ascending"), ("at", "ascending"),
                           ("place", "ascending")])
    spoken, part, at, place, p, zero = (table[c].to_numpy() for c in (
        "spoken", "part", "at", "place", "p", "zero"))
    apart = np.append(True, (part[1:] != part[:-1]) | (at[1:] != at[:-1]) | (spoken[1:] != spoken[:-1]))
    run = np.cumsum(apart)
    places, small = np.unique(place, return_inverse=True)  # two blocks' sources at most
    block, wide = places // size, len(places)
    langs, lang = np.unique(spoken, return_inverse=True)
    across = bool(block.min() != block.max())
    out = []
    for low in range(0, len(langs), 64):
        start, end = np.searchsorted(lang, (low, low + 64))
        sums = np.zeros((min(64, len(langs) - low), wide, wide), np.int64)
        left = np.arange(start, end)
        shift = 1
        while True:
            left = left[left + shift < end]
            left = left[run[left] == run[left + shift]]
            if not len(left):
                break
            x, y = left, left + shift
            if across:
                other = block[small[x]] != block[small[y]]
                x, y = x[other], y[other]
            for i, j in ((x, y), (y, x)):
                more = (_distance(p[i], p[j]) - _distance(p[i], zero[j])
                        - _distance(zero[i], p[j]) + _distance(zero[i], zero[j]))
                np.add.at(sums, (lang[i] - low, small[i], small[j]), more)
            shift += 1
        k, i, j = np.nonzero(sums)
        out.append((langs[k + low], places[i], places[j], sums[k, i, j]))
    return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)],
                    ["spoken", "place", "other", "common"])


def _pair_part(counts: DataFrame, groups: DataFrame, size: int, held_rows: int) -> DataFrame:
    """Sums over all kept terms of both sources' distances, from the terms that occur.

    A pair's sum is that of p against the other's share of absent terms, and of the own one against
    q, for the terms of each; the terms of neither count alike; and the terms of both are corrected.
    The first two come from the numbers of terms by share. For the last, hashed parts of the terms
    meet by pairs of blocks of a lang's sources, so no group has more than two blocks of a term.
    """
    facts = groups.select("grp", "spoken", "place", "sources", "total", "lang_terms", "zero")
    held = counts.join(facts, "grp").select(
        "part", "at", "spoken", "place", "sources", "zero",
        share(F.col("n"), F.col("total"), F.col("lang_terms")).alias("p"))
    buckets = counts.count() // held_rows + 1
    block = F.floor(F.col("place") / size)
    last = F.floor((F.col("sources") - 1) / size)
    dealt = held.select("part", "at", "spoken", "place", "zero", "p", block.alias("b"),
                        F.pmod(F.xxhash64("part", "at"), F.lit(buckets)).alias("bucket"),
                        F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("o"))
    dealt = dealt.withColumns({"lo": F.least("b", "o"), "hi": F.greatest("b", "o")}).drop("b", "o")

    def meet(table: pa.Table) -> pa.Table:
        return _common(table, size)

    pair = ["spoken", "place", "other"]
    common = dealt.groupBy("bucket", "lo", "hi").applyInArrow(
        meet, "spoken long, place long, other long, common long").groupBy(*pair).agg(
        F.sum("common").alias("common"))
    # How many of a group's terms have each share.
    levels = held.groupBy("spoken", "place", "p").agg(F.count("*").alias("k"))
    zeros = groups.select("spoken", F.col("place").alias("other"), F.col("zero").alias("there"))
    apart = levels.join(zeros, "spoken").filter(F.col("place") != F.col("other")).groupBy(*pair).agg(
        F.sum(F.col("k") * distance(F.col("p"), F.col("there"))).alias("out"),
        F.sum(F.col("k") * distance(F.col("there"), F.col("p"))).alias("back"))
    apart = materialize(apart, "apart")
    theirs = apart.select("spoken", F.col("other").alias("place"), F.col("place").alias("other"), "back")
    left = groups.select("spoken", "lang", "source", "place", "lang_terms", F.col("terms").alias("a"),
                         F.col("zero").alias("z"))
    right = groups.select("spoken", F.col("source").alias("item"), F.col("place").alias("other"),
                          F.col("terms").alias("b"), F.col("zero").alias("y"))
    out = left.join(right, "spoken").filter(F.col("place") != F.col("other"))
    for part in (apart.drop("back"), theirs, common):
        out = out.join(part, pair, "left")
    nobody = (F.col("lang_terms") - F.col("a") - F.col("b")) * distance(F.col("z"), F.col("y"))
    value = F.coalesce(nobody, F.lit(0)) + sum(
        (F.coalesce(c, F.lit(0)) for c in ("out", "back", "common")), F.lit(0))
    return _ranked(out.select("lang", "source", F.lit("pair").alias("part"), "item",
                              value.cast("long").alias("value")))


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS,
          size: int = BLOCK, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others of its lang.

    Terms are runs of letters and of characters beyond ASCII, A-Z in lower case; a lang keeps those
    in at least ``min_documents`` of its documents. Part ``pair`` has a row for each other source of
    the lang, part ``term`` the ``top`` kept terms that the source has more of than the lang. Values
    are exact integers: chi-square distances of shares in 10^9. ``rank`` counts from 1 in each group
    and part, by falling value and then by the item's bytes.

    A null text, lang or source is an empty one. Documents without terms still make their group, and
    a lang without kept terms has pairs of value 0. Rows repeated whole are documents of their own.
    Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                         for c in ("lang", "source", "text")])
    groups = materialize(rows.select("lang", "source").distinct().withColumn(
        "grp", F.monotonically_increasing_id()), "groups")
    rows = rows.join(broadcast_if_small(groups), ["lang", "source"])
    counts, names = term_counts(rows, parts_of(docs), min_documents)
    groups = broadcast_if_small(materialize(group_totals(groups, counts, names), "groups"))
    return _pair_part(counts, groups, size, held).unionByName(_term_part(counts, names, groups, top))
