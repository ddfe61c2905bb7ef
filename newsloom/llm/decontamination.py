"""Op 4. Benchmark decontamination: windows of benchmark words in training documents."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import (WordHashes, chunks, flat, folded_words, give_back, valid_starts,
                                 whole_rows, window_hashes)

BROADCAST_BYTES = 1 << 20  # of items: half a million windows at most, about 60 MB here in English
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class BenchmarkWindows:
    """Hash set of the windows of all items: ``size`` words, or all words of a shorter item."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        lengths = set()
        for item, text in items:
            words = folded_words(text)
            length = min(size, len(words))
            if length:
                lengths.add(length)
                for i in range(len(words) - length + 1):
                    self.items[b" ".join(words[i:i + length])].add(item)
        self.lengths = sorted(lengths)
        bits = max(16, min(27, (16 * len(self.items)).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = {n: np.zeros(1 << bits, bool) for n in self.lengths}
        hashes = WordHashes()
        for window in self.items:
            words = window.split(b" ")
            self.seen[len(words)][
                window_hashes(hashes.array(words), len(words)) & self.mask] = True

    def scan(self, texts: list[str | None], hashes: WordHashes):
        """For each text: (number of words, positions of hit words, ids of items)."""
        values, starts = flat(texts, True, hashes)
        covered = np.zeros(len(values) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        split: dict[int, list[bytes]] = {}
        for length in self.lengths:
            found = self.seen[length][window_hashes(values, length) & self.mask]
            places = np.flatnonzero(found & valid_starts(starts, length))
            owners = np.searchsorted(starts, places, "right") - 1
            for place, owner in zip(places.tolist(), owners.tolist()):
                words = split.get(owner)
                if words is None:
                    words = split[owner] = folded_words(texts[owner])
                at = place - int(starts[owner])
                verified = self.items.get(b" ".join(words[at:at + length]))
                if verified:
                    items[owner] |= verified
                    covered[place] += 1
                    covered[place + length] -= 1
        hit = np.cumsum(covered[:-1]) > 0
        for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            yield b - a, np.flatnonzero(hit[a:b]), items.get(i, set())


def _name(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def _windows(benchmark: DataFrame, size: int, item_id: str, text: str,
             limit: int) -> BenchmarkWindows | None:
    """The hash set, if the benchmark's texts have at most ``limit`` bytes in all."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(text) + 8), F.lit(0))).first()[0]
    if total > limit:
        return None
    rows = benchmark.select(_name(item_id), text).collect()
    return BenchmarkWindows([(r[0], r[1]) for r in rows], size)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """What benchmark windows each document has: (doc_id, n_words, hit_words, items).

    Words are runs of letters, digits and non-ASCII characters, ASCII letters in lower case. A
    window is ``size`` consecutive words of an item, or all words of an item that has fewer; a
    document's word inside an occurrence is hit. ``hit_words`` are its hit words' positions from
    0, ``items`` the ids (as strings, sorted) of the items whose windows occur.

    The windows' hash set is broadcast if the benchmark's texts have at most ``broadcast_bytes``;
    documents are then scanned where they are read, and each hit is verified by its words. A
    larger benchmark is joined to the documents' windows by two hashes of 64 bits.

    A null or empty text has no words, and an item without words no windows. A null id stays null
    (an item's is the text ``null``); repeated rows are judged each for itself, and an item that
    is repeated is one item. Other columns are not read. Empty tables give no rows, or no hits.
    """
    windows = _windows(benchmark, size, item_id, item_text, broadcast_bytes)
    if windows is None:
        return _joined(docs, benchmark, size, doc_id, text, item_id, item_text)
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kind = WordHashes(), None

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(doc_id).type
                yield batch

        for keys, texts in chunks(typed(), [doc_id, text], text):
            found = list(shared.value.scan(texts, hashes))
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, kind), pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1].tolist() for f in found], pa.list_(pa.int64())),
                pa.array([sorted(f[2]) for f in found], pa.list_(pa.string()))],
                schema.fieldNames())

    return docs.select(doc_id, text).mapInArrow(scan, schema)


def _hashed(df: DataFrame, keys: list[str], text: str, lengths: list[int],
            shorter: bool) -> DataFrame:
    """(keys, n_words, position, length, h1, h2) of each window; position null: no windows.

    ``shorter``: a text of fewer words than the largest length has one window of all of them.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField(n, T.LongType()) for n in ("n_words", "position", "length", "h1", "h2")])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for r in range(batch.num_rows):
                values = hashes.array(folded_words(batch.column(text)[r].as_py()))
                sizes = [min(lengths[-1], len(values))] if shorter else lengths
                columns = [[len(values)], [None], [None], [None], [None]]
                for n in sizes:
                    first = window_hashes(values, n) if n else values[:0]
                    second = window_hashes(values ^ np.uint64(0xA5A5A5A5A5A5A5A5), n) if n else first
                    columns[0] += [len(values)] * len(first)
                    columns[1] += range(len(first))
                    columns[2] += [n] * len(first)
                    columns[3] += first.view(np.int64).tolist()
                    columns[4] += second.view(np.int64).tolist()
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(k)[r].as_py()] * n, batch.column(k).type) for k in keys]
                    + [pa.array(c, pa.int64()) for c in columns], schema.fieldNames())

    return df.select(*keys, text).mapInArrow(windows, schema)


def _joined(docs, benchmark, size, doc_id, text, item_id, item_text) -> DataFrame:
    """``contamination`` for a benchmark too large to broadcast; equal rows are judged once."""
    items = _hashed(benchmark.select(_name(item_id).alias("item"), F.col(item_text).alias("text")),
                    ["item"], "text", [size], True).filter("position IS NOT NULL")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # 1 to size
    texts = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
             .groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
             .withColumn("row", F.sha2(F.to_json(F.struct("doc_id", "text")), 256)))
    spans = _hashed(texts, ["row", "doc_id", "copies"], "text", lengths or [size], False)
    hits = (spans.filter("position IS NOT NULL")
            .join(items.select("length", "h1", "h2", "item").distinct(), ["length", "h1", "h2"])
            .groupBy("row").agg(
                F.array_sort(F.array_distinct(F.flatten(F.collect_set(
                    F.sequence("position", F.col("position") + F.col("length") - 1)))))
                .alias("hit_words"),
                F.array_sort(F.collect_set("item")).alias("items")))
    whole = spans.filter("position IS NULL").select("row", "doc_id", "copies", "n_words")
    out = whole.join(hits, "row", "left")
    return out.select(
        F.explode(F.array_repeat(F.struct(
            "doc_id", "n_words",
            F.coalesce("hit_words", F.array().cast("array<bigint>")).alias("hit_words"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items")),
            F.col("copies").cast("int"))).alias("r")).select("r.*")


def digest(found: DataFrame) -> DataFrame:
    """Counts and a digest of ``contamination``'s rows."""
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"))


def without_words(text: str, hit: np.ndarray) -> str:
    """The text without its hit words; each run of them leaves one line break."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at, previous = [], 0, None
    for k in hit.tolist():
        start, end = spans[k]
        if previous != k - 1:
            out += [text[at:start], "\n"]
        at, previous = end, k
    return "".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents",
                  size: int = 10, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents, all columns, without contaminated ones or (``"spans"``) their hit words.

    Nulls, empty texts and repeated rows as in ``contamination``; a clean row stays unchanged.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    windows = _windows(benchmark, size, item_id, item_text, broadcast_bytes)
    if windows is None:
        texts = docs.select(F.sha2(text, 256).alias("doc_id"), F.col(text).alias("text")).distinct()
        found = _joined(texts, benchmark, size, "doc_id", "text", item_id, item_text)
        hits = found.filter(F.size("hit_words") > 0).select(
            F.col("doc_id").alias("__digest"), F.col("hit_words").alias("__hit"))
        rows = docs.select(whole_rows(docs), F.sha2(text, 256).alias("key"), F.col(text).alias("old"))
        if remove == "documents":
            return rows.join(hits, F.col("key") == F.col("__digest"), "left_anti").select("row.*")
        cut = F.udf(lambda t, h: t if not h else without_words(t, np.array(h)))
        both = rows.join(hits, F.col("key") == F.col("__digest"), "left")
        return both.select(F.col("row").withField(f"`{text}`", cut("old", "__hit")).alias("row")).select("row.*")
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        hashes = WordHashes()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = part.column(at).to_pylist()
                hit = [f[1] for f in shared.value.scan(texts, hashes)]
                if remove == "documents":
                    yield part.filter(pa.array([len(h) == 0 for h in hit]))
                else:
                    texts = [without_words(t, h) if len(h) else t for t, h in zip(texts, hit)]
                    yield part.set_column(at, part.schema.field(at),
                                          pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(scan, docs.schema)
