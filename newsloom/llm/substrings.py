"""Op 10. Substring deduplication by compaction of a de Bruijn graph of token windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import (WordHashes, chunks, flat, may_contain, mix, plain_words,
                                 planes, ranks, shuffle_partitions, unplaned, valid_starts,
                                 window_hashes)
from newsloom.session import materialize

ANCHOR = 8


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` consecutive values, by doubling."""
    out, span = values, 1
    while span * 2 <= size:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = size - span
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(values: np.ndarray, starts: np.ndarray, window: int,
            anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (first window, number of windows, anchor's hash), and the
    windows' hashes by start.

    A window's anchor is its run of ``anchor`` words with the least hash, the first one of equals:
    equal windows have equal anchors at equal places, wherever they stand.
    """
    total = len(values) - window + 1
    ok = valid_starts(starts, window)
    if total <= 0 or not ok.any():
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, np.uint64), np.empty(0, np.uint64)
    small = window_hashes(values, anchor)
    # 34 bits of the hash, then the place: minima of equal hashes are the first ones.
    keys = (small & np.uint64(0xFFFFFFFFC0000000)) | np.arange(len(small), dtype=np.uint64)
    place = (_sliding_min(keys, window - anchor + 1) & np.uint64((1 << 30) - 1)).astype(np.int64)
    at = np.flatnonzero(ok)
    place = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return at[first], count, small[place[first]], window_hashes(values, window)


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _islands(owner: np.ndarray, start: np.ndarray, shift: np.ndarray):
    """Runs of consecutive rows with one owner, consecutive starts and one shift."""
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1) | (shift[1:] != shift[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(start)))


def _edge_blob(hashes, owner, start, count, windows) -> bytes:
    """Edges of the graph, by runs with one anchor; 40 bits of each window's hash."""
    return b"".join([
        np.array([len(hashes), len(windows)], "<u4").tobytes(), hashes.astype("<u8").tobytes(),
        count.astype(np.uint8).tobytes(), planes(owner), planes(start),
        (windows >> np.uint64(24)).astype("<u4").tobytes(),
        (windows >> np.uint64(56)).astype(np.uint8).tobytes()])


def _path_blob(owner, start, count, source, source_start) -> bytes:
    return b"".join([np.array([len(owner)], "<u4").tobytes(),
                     *[planes(x) for x in (owner, start, count, source, source_start)]])


def repeated_paths(docs: DataFrame, window: int, doc_id: str, text: str,
                   anchor: int = ANCHOR) -> DataFrame:
    """Paths of windows that start earlier too: (doc_id, copy, start, count, source_id,
    source_copy, source_start), by word positions.

    ``copy`` is a hash of the text: a document's coordinates are (doc_id, copy, start), nulls
    first. Windows of ``window`` words are the edges of a de Bruijn graph. They are dealt by their
    anchor, so a run of neighbouring edges travels as one row part; a task sends each distinct edge
    once for about 8 MB of text, however often it occurs there. Where edges of all texts meet,
    each takes its least coordinates as source, and neighbouring edges with neighbouring sources
    leave as one path.
    """
    kind = docs.schema[doc_id].dataType
    spark = docs.sparkSession
    buckets = 4 * shuffle_partitions(spark, docs, 32 << 20)
    sent = T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("is_path", T.BooleanType()),
        T.StructField("ids", T.ArrayType(kind)), T.StructField("copies", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType())])
    paths = T.StructType([
        T.StructField("doc_id", kind), T.StructField("copy", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("count", T.LongType()),
        T.StructField("source_id", kind), T.StructField("source_copy", T.LongType()),
        T.StructField("source_start", T.LongType())])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, arrow = WordHashes(), None

        def typed():
            nonlocal arrow
            for batch in batches:
                arrow = batch.schema.field("doc_id").type
                yield batch

        def row(bucket, is_path, ids, copies, used, payload):
            return pa.RecordBatch.from_arrays([
                pa.array([bucket], pa.int32()), pa.array([is_path]),
                pa.array([[ids[i] for i in used]], pa.list_(arrow)),
                pa.array([copies[used]], pa.list_(pa.int64())),
                pa.array([payload], pa.binary())], sent.fieldNames())

        for ids, copies, texts in chunks(typed(), ["doc_id", "copy", "text"], "text"):
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i], copies[i]))
            ids, copies = [ids[i] for i in order], np.array([copies[i] for i in order])
            values, starts = flat([texts[i] for i in order], False, hashes)
            first, count, marks, whole = anchors(values, starts, window, anchor)
            if not len(first):
                continue
            same = np.zeros(len(ids), bool)  # a repeated row is the same document
            same[1:] = [ids[i] == ids[i - 1] and copies[i] == copies[i - 1]
                        for i in range(1, len(ids))]
            at = _runs(first, count)
            owner = np.searchsorted(starts, at, "right") - 1
            keys = whole[at]
            _, least, back = np.unique(keys, return_index=True, return_inverse=True)
            source = at[least[back]]
            source_owner = owner[least[back]]
            known = (source != at) & ~same[owner]
            if known.any():
                k = np.flatnonzero(known)
                lead, size = _islands(owner[k], at[k], at[k] - source[k])
                k = k[lead]
                used, names = np.unique(np.concatenate((owner[k], source_owner[k])),
                                        return_inverse=True)
                yield row(int(copies[used[0]] % buckets), True, ids, copies, used, _path_blob(
                    names[:len(k)], at[k] - starts[owner[k]], size, names[len(k):],
                    source[k] - starts[source_owner[k]]))
            # Runs all of whose edges stand earlier in this chunk have nothing to tell others.
            ends = np.cumsum(count)
            news = np.add.reduceat(~known, ends - count) > 0
            lone = owner[ends - count]
            news &= ~same[lone]
            first, count, marks, lone = first[news], count[news], marks[news], lone[news]
            deal = (mix(marks) >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(deal, kind="stable")
            cuts = np.flatnonzero(np.diff(deal[order])) + 1
            for part in np.split(order, cuts):
                if not len(part):
                    continue
                used, names = np.unique(lone[part], return_inverse=True)
                yield row(int(deal[part[0]]), False, ids, copies, used, _edge_blob(
                    marks[part], names, first[part] - starts[lone[part]], count[part],
                    whole[_runs(first[part], count[part])]))

    def meet(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks()
        copies = table.column("copies").combine_chunks()
        tables = np.diff(ids.offsets.to_numpy())
        ids, copies = ids.flatten(), copies.flatten()
        base = np.cumsum(tables) - tables
        flags = table.column("is_path").to_pylist()
        done, runs = [], []
        for r, raw in enumerate(table.column("payload")):
            raw = raw.as_py()
            if flags[r]:
                n = int(np.frombuffer(raw, "<u4", 1)[0])
                part = [unplaned(raw, 4 + 4 * n * k, n) for k in range(5)]
                part[0] += base[r]
                part[3] += base[r]
                done.append(part)
            else:
                n, m = np.frombuffer(raw, "<u4", 2).tolist()
                at = 8 + 9 * n
                low = np.frombuffer(raw, "<u4", m, at + 8 * n).astype(np.uint64)
                high = np.frombuffer(raw, np.uint8, m, at + 8 * n + 4 * m).astype(np.uint64)
                runs.append((np.frombuffer(raw, "<u8", n, 8),
                             np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(np.int64),
                             unplaned(raw, at, n) + base[r], unplaned(raw, at + 4 * n, n),
                             low | high << np.uint64(32)))
        if runs:
            marks, count, owner, start, keys = (np.concatenate(x) for x in zip(*runs))
            rank = ranks(ids, copies)
            at = _runs(start, count)
            with np.errstate(over="ignore"):
                keys = mix(np.repeat(marks, count) * np.uint64(0x9E3779B97F4A7C15) + mix(keys))
            owner = np.repeat(owner, count)
            place = rank[owner] << 32 | at
            order = np.argsort(keys)
            keys = keys[order]
            new = np.append(True, keys[1:] != keys[:-1])
            lead = np.flatnonzero(new)
            size = np.diff(np.append(lead, len(keys)))
            many = np.repeat(size > 1, size)
            order, size = order[many], size[size > 1]
            if len(order):
                least = np.minimum.reduceat(place[order], np.cumsum(size) - size)
                least = np.repeat(least, size)
                late = place[order] > least
                k, least = order[late], least[late]
                again = np.argsort(k)
                k, least = k[again], least[again]
                holder = np.zeros(int(rank.max()) + 1, np.int64)
                holder[rank] = np.arange(len(rank))
                source, source_start = holder[least >> 32], least & 0xFFFFFFFF
                lead, size = _islands(owner[k], at[k], (least >> 32 << 33) + source_start - at[k])
                done.append((owner[k][lead], at[k][lead], size, source[lead], source_start[lead]))
        if not done:
            return pa.Table.from_batches([], pa.schema(
                [pa.field(n, ids.type if n.endswith("_id") else pa.int64())
                 for n in paths.fieldNames()]))
        owner, start, count, source, source_start = (np.concatenate(x) for x in zip(*done))
        return pa.table({"doc_id": ids.take(pa.array(owner)),
                         "copy": copies.take(pa.array(owner)), "start": start, "count": count,
                         "source_id": ids.take(pa.array(source)),
                         "source_copy": copies.take(pa.array(source)),
                         "source_start": source_start})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("copy"),
                       F.col(text).alias("text"))
    return rows.mapInArrow(edges, sent).groupBy("bucket").applyInArrow(meet, paths)


def repeated_spans(docs: DataFrame, window: int = 20, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Maximal repeated spans with their sources, in words: (doc_id, copy, start, end, source_id,
    source_copy, source_start).

    Paths that continue each other in the document and in the source alike are glued: those
    neighbours are verified by their coordinates on both sides.
    """
    paths = repeated_paths(docs, window, doc_id, text).withColumn(
        "shift", F.col("source_start") - F.col("start"))
    line = ["doc_id", "copy", "source_id", "source_copy", "shift"]
    by = Window.partitionBy(*line).orderBy("start")
    reach = F.max(F.col("start") + F.col("count")).over(
        by.rowsBetween(Window.unboundedPreceding, -1))
    marked = paths.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    island = marked.withColumn("island", F.sum("new").over(by))
    return (island.groupBy(*line, "island")
            .agg(F.min("start").alias("start"),
                 (F.max(F.col("start") + F.col("count")) + (window - 1)).alias("end"),
                 F.min("source_start").alias("source_start"))
            .drop("shift", "island"))


def _join_spans(docs: DataFrame, window: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, starts, ends): each row with its document's repeated spans.

    Only rows that may have some are shuffled.
    """
    spans = repeated_spans(docs, window, doc_id, text)
    listed = materialize(spans.groupBy(F.col("doc_id").alias("d"), F.col("copy").alias("c")).agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "spans")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       F.xxhash64(text).alias("copy"))
    rows = may_contain(rows, "copy", listed.select(F.col("c").alias("copy")))
    some = rows.filter("__may")
    some = some.join(listed, some["doc_id"].eqNullSafe(listed["d"])
                     & (some["copy"] == listed["c"]), "left")
    none = F.lit(None).cast("array<bigint>")
    rest = rows.filter("NOT __may").withColumn("starts", none).withColumn("ends", none)
    columns = ["doc_id", "text", "starts", "ends"]
    return some.select(columns).unionByName(rest.select(columns))


def remove_repeats(docs: DataFrame, window: int = 20, doc_id: str = "doc_id",
                   text: str = "text", with_text: bool = True) -> DataFrame:
    """Documents without the words of windows that start earlier too.

    One row for each document: (doc_id, n_words, n_removed, kept_sha256[, kept]). Words are runs of
    characters other than ASCII white space. A word goes if some window of ``window`` consecutive
    words that covers it also starts earlier: in a document with a smaller id, or before in the
    same document. Windows are judged on the input. ``kept`` are the kept words, joined by spaces.

    A null or empty text has no words. Rows of one id are ordered by a hash of their text; a row
    repeated whole is one and the same document and gets the same result each time. Null ids come
    first. Other columns are not read. A text of any length is one row of a task. An empty table
    gives no rows.
    """
    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType),
              T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("kept_sha256", T.StringType())]
    if with_text:
        fields.append(T.StructField("kept", T.StringType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            out = []
            for r in range(batch.num_rows):
                words = plain_words(texts[r].as_py())
                n, starts = len(words), batch.column(2)[r]
                if starts.is_valid:
                    keep = np.zeros(n + 1, np.int64)
                    np.add.at(keep, starts.values.to_numpy(), 1)
                    np.add.at(keep, batch.column(3)[r].values.to_numpy(), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(keep[:-1]) == 0)]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept))
            arrays = [batch.column(0), pa.array([o[0] for o in out], pa.int64()),
                      pa.array([o[1] for o in out], pa.int64()),
                      pa.array([o[2] for o in out], pa.string())]
            if with_text:
                arrays.append(pa.array([o[3] for o in out], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    return _join_spans(docs, window, doc_id, text).mapInArrow(cut, T.StructType(fields))
