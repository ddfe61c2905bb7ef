"""Op 9. Line deduplication by an exact set-similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import (WordHashes, chunks, fold, fold_lines, folded_words, listed, may_contain,
                                 mix, planes, ranks, shuffle_partitions, split_words, unplaned, whole_rows)
from newsloom.session import materialize

THRESHOLD = 0.8
FREQUENT = 100_000  # a word with this part of all words' occurrences, or more, is frequent
FEW = 64           # candidates of a set in a bucket that are all kept; of more, the ``BEST``
BEST = 16
MOST_HELD = 1_000_000  # pairs held at once; beyond it, those of sets with more than ``FEW`` go
LONG = 160         # words of a line that has tallies beside its parities
BUCKET = 2 << 20   # bytes of input for each bucket of postings
CHUNK = 4 << 20    # characters of text cut at once


def frequent_words(docs: DataFrame, text: str) -> dict[int, int]:
    """Places of frequent words' hashes by rising frequency; at most ``FREQUENT`` words.

    Counts cover all texts; a word rarer than that in some 8 MB of text is not counted there. The
    order decides how fast the join is, never what it finds.
    """
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in chunks(batches, ["text"], "text"):
            words, _ = split_words([fold(t) for t in texts])
            found = pc.value_counts(words)
            names, counts = found.field(0), found.field(1)
            keep = pc.greater_equal(counts, max(2, len(words) // FREQUENT))
            yield pa.RecordBatch.from_arrays(
                [names.filter(keep).view(pa.large_binary()).cast(pa.binary()), counts.filter(keep).cast(pa.int64())],
                schema.fieldNames())

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, schema)
    totals = parts.groupBy("word").agg(F.sum("n").alias("n"))
    rows = totals.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    hashes = WordHashes().array([bytes(r[0]) for r in rows[::-1]])
    return {int(h): k + 1 for k, h in enumerate(hashes)}


def prefix_length(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Sets with similarity ``threshold`` or more share a word among so many of their rarest."""
    return sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1


def _sets(lines: list[bytes], places):
    """Of folded lines (words' sort keys by line, rarest first, without repeats; starts; owners)."""
    words, starts = split_words(lines)
    coded = pc.dictionary_encode(words)
    distinct = listed(coded.dictionary.view(pa.large_binary()))
    values = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    names, place = places
    keys = values >> np.uint64(21)  # 43 bits of a rare word's hash, a frequent word's place
    if len(names):
        at = np.minimum(np.searchsorted(names, values), len(names) - 1)
        keys = np.where(names[at] == values, np.uint64(1 << 43) + place[at].astype(np.uint64), keys)
    keys = keys[coded.indices.to_numpy()]
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    if len(starts) <= 1 << 20:
        both = np.sort(owner << np.uint64(44) | keys)
        new = np.append(True, both[1:] != both[:-1])[:len(both)]
        both = both[new]
        keys, owner = both & np.uint64((1 << 44) - 1), (both >> np.uint64(44)).astype(np.int64)
    else:
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order].astype(np.int64)
        new = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))[:len(keys)]
        keys, owner = keys[new], owner[new]
    return keys, np.append(0, np.cumsum(np.bincount(owner, minlength=len(starts) - 1))), owner


def _parities(spread: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a line's words in each of 128 hashed parts are odd in number: two 64-bit values."""
    part = spread >> np.uint64(57)
    bit = np.uint64(1) << (part & np.uint64(63))
    high = part >= 64
    zero = np.uint64(0)
    return np.stack([np.bitwise_xor.reduceat(np.where(high, zero, bit), starts),
                     np.bitwise_xor.reduceat(np.where(high, bit, zero), starts)], axis=1)


def _tallies(spread: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of a line's words fall into each of 32 hashed parts, modulo 16: two in a byte."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    part = (spread >> np.uint64(40) & np.uint64(31)).astype(np.int64)
    each = np.bincount(owner * 32 + part, minlength=len(sizes) * 32)
    each = (each & 15).astype(np.uint8).reshape(len(sizes), 32)
    return each[:, :16] | each[:, 16:] << 4


def _packed(marks, parities, words, name, line, sizes, place, tallies) -> bytes:
    """Postings with the high halves of their words' hashes; ``tallies`` are those of long lines."""
    return b"".join([
        np.array([len(marks)], "<u4").tobytes(), marks.tobytes(), parities.tobytes(),
        words.astype("<u4").tobytes(), planes(name), planes(line), planes(sizes), planes(place),
        tallies.tobytes()])


def _postings(docs: DataFrame, threshold: float, buckets: int, frequent: dict[int, int]) -> DataFrame:
    """Prefix words of each distinct line of some ``CHUNK`` of text, dealt by the word, packed.

    A line whose set of words stands before in the same chunk is sent as removed instead.
    """
    sent = T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("removed", T.BooleanType()),
        T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)),
        T.StructField("copies", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])
    names = np.array(sorted(frequent), np.uint64)
    places = names, np.array([frequent[int(n)] for n in names], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None

        def typed():
            nonlocal arrow
            for batch in batches:
                arrow = batch.schema.field("doc_id").type
                yield batch

        def row(bucket, removed, ids, copies, used, payload):
            return pa.RecordBatch.from_arrays([
                pa.array([bucket], pa.int32()), pa.array([removed]),
                pa.array([[ids[i] for i in used]], pa.list_(arrow)),
                pa.array([copies[used]], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                sent.fieldNames())

        for ids, copies, texts in chunks(typed(), ["doc_id", "copy", "text"], "text", CHUNK):
            seen = {(i, c): k for k, (i, c) in enumerate(zip(ids, copies))}  # rows repeated whole
            order = sorted(seen.values(), key=lambda k: (ids[k] is not None, ids[k], copies[k]))
            ids, copies = [ids[k] for k in order], np.array([copies[k] for k in order])
            lines = [fold_lines(texts[k]) for k in order]
            line = np.concatenate([np.arange(len(x)) for x in lines])
            document = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
            keys, at, owner = _sets([x for part in lines for x in part], places)
            sizes = np.diff(at)
            some = np.flatnonzero(sizes)
            if not len(some):
                continue
            spread = mix(keys)
            with np.errstate(over="ignore"):
                marks = np.add.reduceat(spread, at[some])
            parities = _parities(spread, at[some])
            _, first = np.unique(marks, return_index=True)
            fresh = np.zeros(len(some), bool)
            fresh[first] = True
            late = some[~fresh]
            if len(late):
                used, name = np.unique(document[late], return_inverse=True)
                yield row(int(copies[used[0]] % buckets), True, ids, copies, used,
                          np.array([len(late)], "<u4").tobytes() + planes(name)
                          + planes(line[late]))
            kept = some[fresh]
            lead = prefix_length(sizes[kept], threshold)
            ends = np.cumsum(lead)
            which = np.repeat(np.arange(len(kept)), lead)
            place = np.arange(ends[-1]) - np.repeat(ends - lead, lead)
            words = mix(keys[at[kept][which] + place])
            target = words % np.uint64(buckets)
            order = np.argsort(target, kind="stable")
            marks, parities = marks[fresh], parities[fresh]
            long = sizes[kept] >= LONG
            row_of = np.cumsum(long) - 1
            listed = np.zeros(len(sizes), bool)
            listed[kept[long]] = True
            tallies = _tallies(spread[listed[owner]], sizes[kept[long]])
            for part in np.split(order, np.flatnonzero(np.diff(target[order])) + 1):
                w = which[part]
                used, name = np.unique(document[kept[w]], return_inverse=True)
                yield row(int(target[part[0]]), False, ids, copies, used, _packed(
                    marks[w], parities[w], words[part] >> np.uint64(32), name, line[kept[w]],
                    sizes[kept[w]], place[part], tallies[row_of[w[long[w]]]]))

    return docs.mapInArrow(deal, sent)


def _candidates(postings: DataFrame, threshold: float, only: np.ndarray | None = None) -> DataFrame:
    """Removed lines (``set`` null) and candidates: (doc_id, copy, line, set, other, apart, more,
    other_id, other_copy, other_line), and postings for a second pass (bucket, ids, copies, payload).

    Where the postings of a word meet, equal sets keep their first line. A pair that the filters by
    length, position, parities and tallies leave is a candidate for its later set. A set with more
    than ``FEW`` candidates in a bucket gets the ``BEST`` nearest (``apart``) from it, and ``more``
    counts the others there; the bucket's postings of such sets' words are returned, packed in one
    row. With ``only``, a bitmap of sets' marks, those sets get all their candidates.
    """
    kind = postings.schema["ids"].dataType.elementType
    long = T.LongType()
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("copy", long), T.StructField("line", long),
         T.StructField("set", long), T.StructField("other", long),
         T.StructField("apart", T.DoubleType()), T.StructField("more", long),
         T.StructField("other_id", kind), T.StructField("other_copy", long),
         T.StructField("other_line", long), T.StructField("bucket", T.IntegerType()),
         T.StructField("ids", T.ArrayType(kind)), T.StructField("copies", T.ArrayType(long)),
         T.StructField("payload", T.BinaryType())])

    def meet(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks()
        copies = table.column("copies").combine_chunks()
        lengths = np.diff(ids.offsets.to_numpy())
        ids, copies = ids.flatten(), copies.flatten()
        base = np.cumsum(lengths) - lengths
        gone, rows = [(np.zeros(0, np.int64),) * 2], []
        for r, (removed, raw) in enumerate(zip(table.column("removed").to_pylist(),
                                               table.column("payload"))):
            raw = raw.as_py()
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            if removed:
                gone.append((unplaned(raw, 4, n) + base[r], unplaned(raw, 4 + 4 * n, n)))
            else:
                at = 4 + 28 * n
                lists = [unplaned(raw, at + 4 * n * k, n).astype(np.int32) for k in range(4)]
                lists[0] += base[r].astype(np.int32)
                rows.append((
                    np.frombuffer(raw, "<u8", n, 4),
                    np.frombuffer(raw, "<u8", 2 * n, 4 + 8 * n).reshape(n, 2),
                    np.frombuffer(raw, "<u4", n, 4 + 24 * n).astype(np.int64), *lists,
                    np.frombuffer(raw, np.uint8, -1, at + 16 * n).reshape(-1, 16)))
        late = early = np.zeros(0, np.int64)
        apart, more = np.zeros(0), late
        marks, owner, line, again = np.zeros(0, np.uint64), late, late, []
        if rows:
            marks, parities, words, owner, line, sizes, place, tallies = (
                np.concatenate(x) for x in zip(*rows))
            rows.clear()
            row_of = (np.cumsum(sizes >= LONG) - 1).astype(np.int32)  # of ``tallies``
            rank = ranks(ids, copies)[owner] << 32 | line
            order = np.lexsort((rank, words << 31 | (marks >> np.uint64(33)).astype(np.int64)))
            marks, parities, words, owner, line, sizes, place, rank, row_of = (
                x[order] for x in (marks, parities, words, owner, line, sizes, place, rank, row_of))
            # Sets whose marks differ in their last bits only may stand between equal ones, which
            # are then candidates of each other.
            same = np.append(False, (words[1:] == words[:-1]) & (marks[1:] == marks[:-1])
                             & (sizes[1:] == sizes[:-1])
                             & (parities[1:] == parities[:-1]).all(axis=1))
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
            later = same & (place == 0) & (rank > rank[lead])  # a set has one rarest word
            gone.append((owner[later], line[later]))
            order = np.flatnonzero(~same)
            order = order[np.lexsort((sizes[order], words[order]))]
            chosen = None if only is None else only[
                (marks[order] & np.uint64(len(only) - 1)).astype(np.int64)]
            late, early, apart, more = _similar(
                words[order], sizes[order], place[order], parities[order], tallies, row_of[order],
                rank[order], threshold, chosen)
            late, early = order[late], order[early]
            if only is None and more.any():
                cut = words[order[np.isin(marks[order], marks[late[more > 0]])]]
                held = order[np.isin(words[order], cut)]
                used, name = np.unique(owner[held], return_inverse=True)
                again = [(pa.array(used), _packed(
                    marks[held], parities[held], words[held], name, line[held], sizes[held],
                    place[held], tallies[row_of[held[sizes[held] >= LONG]]]))]
        holders, lines = (np.concatenate(x) for x in zip(*gone))
        n, m = len(holders), len(late)
        empty = np.append(np.ones(n, bool), np.zeros(m, bool))

        def known(values, kind):
            return pa.array(np.append(np.zeros(n, values.dtype), values).astype(kind), mask=empty)

        other = pa.array(np.append(np.zeros(n, np.int64), owner[early]), mask=empty)
        mine = pa.array(np.append(holders, owner[late]))
        names = schema.fieldNames()
        out = pa.table([
            ids.take(mine), copies.take(mine), pa.array(np.append(lines, line[late])),
            known(marks[late].view(np.int64), np.int64), known(marks[early].view(np.int64), np.int64),
            known(apart, np.float64), known(more, np.int64), ids.take(other), copies.take(other),
            known(line[early], np.int64)], names=names[:10])
        lists = pa.list_(ids.type), pa.list_(pa.int64())
        kinds = [*out.schema.types, pa.int32(), *lists, pa.binary()]
        out = pa.table([*out.columns, *[pa.nulls(n + m, k) for k in kinds[10:]]], names=names)
        packed = [pa.table([*[pa.nulls(1, k) for k in kinds[:10]], table["bucket"].slice(0, 1),
                            pa.array([ids.take(used).to_pylist()], lists[0]),
                            pa.array([copies.take(used).to_pylist()], lists[1]),
                            pa.array([raw], pa.binary())], names=names) for used, raw in again]
        return pa.concat_tables([out, *packed])

    return postings.groupBy("bucket").applyInArrow(meet, schema)


def _similar(words, sizes, place, parities, tallies, row_of, rank, threshold, chosen):
    """Candidate pairs of postings of one word, ordered by size: (later, earlier, apart, more).

    Length: the smaller set has ``threshold`` of the larger one's size. Position: the words after
    the shared one must suffice for the needed overlap. Parities, and tallies of long lines: the
    words' numbers in hashed parts differ by no more than the sets do. Of a set with more than
    ``FEW`` pairs only the ``BEST`` are kept as the pairs go by, unless ``chosen`` marks the sets
    all of whose pairs are wanted.
    """
    left = np.arange(len(words))
    if chosen is not None:
        wanted = np.unique(words[chosen])
        left = left[np.isin(words, wanted)]
    # The smaller set has the word among fewer of its rarest words still.
    left = left[place[left] < prefix_length(sizes[left], 2 * threshold / (1 + threshold))]
    found, held, shift = [], 0, 1
    while True:
        left = left[left + shift < len(words)]
        right = left + shift
        ok = (words[left] == words[right]) & (sizes[left] >= threshold * sizes[right] - 1e-9)
        left, right = left[ok], right[ok]  # sizes rise: a pair that fails has no longer partner
        if not len(left):
            break
        shift += 1
        total = sizes[left] + sizes[right]
        needed = np.ceil(threshold / (1 + threshold) * total - 1e-9).astype(np.int64)
        good = np.minimum(place[left], place[right]) + np.minimum(
            sizes[left] - place[left], sizes[right] - place[right]) >= needed
        if not good.any():
            continue
        a, b, allowed = left[good], right[good], (total - 2 * needed)[good]
        differ = np.bitwise_count(parities[a] ^ parities[b]).sum(axis=1, dtype=np.int64)
        good = differ <= allowed
        a, b, allowed, differ = a[good], b[good], allowed[good], differ[good]
        long = np.flatnonzero(np.minimum(sizes[a], sizes[b]) >= LONG)
        if len(long):
            one, two = tallies[row_of[a[long]]], tallies[row_of[b[long]]]
            total = np.zeros(len(long), np.int64)
            for x, y in ((one & 15, two & 15), (one >> 4, two >> 4)):
                gap = np.abs(x.astype(np.int8) - y.astype(np.int8))
                total += np.minimum(gap, 16 - gap).sum(axis=1, dtype=np.int64)
            differ[long] = np.maximum(differ[long], total)
            good = differ <= allowed
            a, b, differ = a[good], b[good], differ[good]
        later = rank[a] > rank[b]
        late = np.where(later, a, b)
        part = (late, np.where(later, b, a), differ / (sizes[a] + sizes[b]),
                np.zeros(len(a), np.int64))
        if chosen is not None:
            part = tuple(x[chosen[late]] for x in part)
        found.append(part)
        held += len(part[0])
        if chosen is None and held > MOST_HELD:
            found = [_best(found)]
            held = len(found[0][0])
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, np.int64))
    return _best(found) if chosen is None else tuple(np.concatenate(x) for x in zip(*found))


def _best(found):
    """The pairs, of sets with more than ``FEW`` only the best; ``more`` adds up the others."""
    late, early, apart, more = (np.concatenate(x) for x in zip(*found))
    if not len(late):
        return late, early, apart, more
    order = np.lexsort((early, apart, late))
    late, early, apart, more = late[order], early[order], apart[order], more[order]
    first = np.append(True, late[1:] != late[:-1])
    lead = np.flatnonzero(first)
    size = np.diff(np.append(lead, len(late)))
    place = np.arange(len(late)) - np.repeat(lead, size)
    gone = np.add.reduceat(more, lead)
    many = (size > FEW) | (gone > 0)
    rest = np.where(many, np.maximum(size - BEST, 0) + gone, 0)
    keep = (place < BEST) | ~np.repeat(many, size)
    more = np.where(place == 0, np.repeat(rest, size), 0)
    return late[keep], early[keep], apart[keep], more[keep]


def _verified(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """The sets of ``pairs`` (set, other) that are similar by their lines' words: (set)."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x, y = set(folded_words(a)), set(folded_words(b))
                common = len(x & y)
                keep.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))],
                                             ["set"])

    mine = lines.select(F.col("mark").alias("m"), F.col("text").alias("a"))
    others = lines.select(F.col("mark").alias("o"), F.col("text").alias("b"))
    both = pairs.join(mine, F.col("set") == F.col("m")).join(others, F.col("other") == F.col("o"))
    return both.select("set", "a", "b").mapInArrow(verify, "set long").distinct()


def _texts(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(mark, text) of sets by the place of a line (mark, doc_id, copy, line)."""
    texts = may_contain(rows, "copy", sets).filter("__may").select(
        F.col("doc_id").alias("d"), F.col("copy").alias("c"), "text")
    found = sets.join(texts, sets["doc_id"].eqNullSafe(texts["d"]) & (sets["copy"] == texts["c"]))
    return materialize(found.select("mark", F.get(
        F.split("text", "\n"), F.col("line").cast("int")).alias("text")).dropDuplicates(["mark"]),
        "line-texts")


def _bitmap(sets: DataFrame, bits: int = 25) -> np.ndarray:
    """The low bits of the sets' marks, as a bitmap of fixed size."""
    low = F.col("set").bitwiseAND((1 << bits) - 1)
    parts = sets.select((low + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(1 << bits, bool)
    for part, raw in parts.collect():  # 4 MB at most
        size = 8 * len(raw)
        out[(part - 1) * size:part * size] = np.unpackbits(
            np.frombuffer(bytes(raw), np.uint8), bitorder="little")
    return out


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, copy, lines): numbers from 0 of the lines that are similar to an earlier line.

    Lines are parts between line breaks, as sets of ``folded_words``. A line goes if the Jaccard
    similarity to any line before it, by (id, hash of the text, number of the line), is at least
    ``threshold``; whether that line itself goes does not count. A line without words stays.

    Each set of lines is represented by its first line. Sets share one of their rarest words (the
    prefix filter); pairs that pass the filters of ``_similar`` are candidates. One similar earlier
    set is enough: each set is verified by its words against its best candidate, the rest against
    the others that were kept, and sets that are left and had more against all of them, in a second
    pass over the postings of such sets' words. So a group of n similar lines gives of the order of n pairs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("copy"),
                       F.col(text).alias("text"))
    buckets = shuffle_partitions(spark, docs, BUCKET)
    postings = _postings(rows, threshold, buckets, frequent_words(docs, text))
    found = materialize(_candidates(postings, threshold), "line-candidates")
    pairs = found.filter("set IS NOT NULL").drop("bucket", "ids", "copies", "payload")
    done = _settle(rows, pairs, threshold)
    left = pairs.filter("more > 0").select("set").join(done, "set", "left_anti").distinct()
    left = materialize(left, "lines-left")
    if left.take(1):
        again = found.filter("bucket IS NOT NULL").select(
            "bucket", F.lit(False).alias("removed"), "ids", "copies", "payload")
        rest = _candidates(again, threshold, _bitmap(left)).filter("set IS NOT NULL")
        rest = rest.drop("bucket", "ids", "copies", "payload")
        rest = materialize(rest.join(left, "set", "left_semi"), "line-candidates")
        done = done.unionByName(_settle(rows, rest, threshold))
        pairs = pairs.unionByName(rest)
    near = pairs.join(done.distinct(), "set", "left_semi").select("doc_id", "copy", "line")
    sure = found.filter("set IS NULL AND bucket IS NULL").select("doc_id", "copy", "line")
    return materialize(sure.unionByName(near).groupBy("doc_id", "copy").agg(
        F.collect_set("line").alias("lines")), "lines")


def _settle(rows: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The sets of ``pairs`` that have a similar candidate: the best one first, then the others."""
    place = ["doc_id", "copy", "line"]
    sets = pairs.select(F.col("set").alias("mark"), *place).unionByName(pairs.select(
        F.col("other").alias("mark"), F.col("other_id").alias("doc_id"),
        F.col("other_copy").alias("copy"), F.col("other_line").alias("line")))
    lines = _texts(rows, materialize(sets.dropDuplicates(["mark"]), "line-sets"))
    best = pairs.groupBy("set").agg(F.min_by("other", F.struct("apart", "other")).alias("other"))
    first = materialize(_verified(best, lines, threshold), "lines-done")
    others = pairs.select("set", "other").join(first, "set", "left_anti").distinct()
    return first.unionByName(materialize(_verified(others, lines, threshold), "lines-done"))


def _kept(docs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """(row, lines): each row as a struct, and the numbers of its lines to remove or null.

    Only rows that may lose lines are shuffled.
    """
    gone = repeated_lines(docs, doc_id, text, threshold).select(
        F.col("doc_id").alias("d"), F.col("copy").alias("c"), "lines")
    rows = docs.select(whole_rows(docs), F.col(doc_id).alias("id"), F.xxhash64(text).alias("copy"))
    marked = may_contain(rows, "copy", gone.select(F.col("c").alias("copy")))
    some = marked.filter("__may")
    some = some.join(gone, some["id"].eqNullSafe(gone["d"]) & (some["copy"] == gone["c"]), "left")
    rest = marked.filter("NOT __may").withColumn("lines", F.lit(None).cast("array<bigint>"))
    return some.select("row", "lines").unionByName(rest.select("row", "lines"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, without lines that ``repeated_lines`` finds.

    A document that loses all its lines goes; one that had no word stays. Null and empty texts
    stay as they are. Rows repeated whole are one document and get one result each; null ids come
    first. Other columns may have any names. An empty table gives no rows.
    """
    lines, old = F.col("lines"), F.col("row")[text]
    left = F.filter(F.split(old, "\n"), lambda x, i: ~F.array_contains(lines, i.cast("long")))
    out = _kept(docs, doc_id, text, threshold).select(
        F.when(lines.isNull(), F.col("row")).otherwise(
            F.col("row").withField(f"`{text}`", F.array_join(left, "\n"))).alias("row"), "lines")
    return out.filter(lines.isNull() | old.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
                      ).select("row.*")


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of each document; a null text has one empty line.

    ``kept_sha256`` digests the kept lines, joined by line breaks.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = _kept(rows, "doc_id", "text", threshold).select("row.*", "lines")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    gone = F.coalesce("lines", F.array().cast("array<bigint>"))
    kept = F.filter(lines, lambda x, i: ~F.array_contains(gone, i.cast("long")))
    return marked.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.sha2(F.array_join(kept, "\n"), 256).alias("kept_sha256"))
