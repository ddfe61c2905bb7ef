"""Words, hashes and chunks shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A-Z in lower case, ASCII other than letters and digits as a space; the rest is part of words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256))
_FOLD_LINES = _FOLD[:10] + b"\n" + _FOLD[11:]

CACHE_WORDS = 400_000


def listed(values: pa.Array) -> list:
    """Strings or bytes as a list; ``to_pylist`` makes an object of each on the way."""
    return values.to_numpy(zero_copy_only=False).tolist()


def folded_words(text: str | None) -> list[bytes]:
    """Lower-case words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; a null text has none."""
    return text.encode().translate(_FOLD).split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none."""
    return text.encode().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words. Only hits are kept between chunks, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values, by doubling; one per start.

    The hash is a polynomial over spread values with an odd multiplier, spread again.
    """
    count = len(values) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        power, span, run = base, 1, mix(values)
        out, done = None, 0
        while True:
            if size & span:
                part = run[done:done + count] if out is not None else run[:count].copy()
                if out is None:
                    out, shift = part, power
                else:
                    out = out + shift * part
                    shift = shift * power
                done += span
            if span * 2 > size:
                break
            run = run[:len(run) - span] + power * run[span:]
            power, span = power * power, span * 2
        return mix(out)


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that returns freed memory, if it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda kept: 0


def give_back() -> None:
    """Workers live on after a task: memory that nothing uses any more goes back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def chunks(batches: Iterable[pa.RecordBatch], columns: list[str], text: str,
           limit: int = 8 << 20) -> Iterator[list[list]]:
    """Rows as lists of columns, in groups of about ``limit`` characters of the text column.

    A single longer text makes a group of its own, so a task holds one group at a time.
    """
    give_back()
    at = columns.index(text)
    rows: list[list] = [[] for _ in columns]
    size = 0
    for batch in batches:
        values = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        for start in range(0, batch.num_rows, 256):
            part = [v.slice(start, 256).to_pylist() for v in values]
            for row in zip(*part):
                for kept, value in zip(rows, row):
                    kept.append(value)
                size += len(row[at] or "") + 64
                if size >= limit:
                    yield rows
                    rows, size = [[] for _ in columns], 0
    if rows[0]:
        yield rows
    del rows
    give_back()


def fold(text: str | None) -> bytes:
    """The text with ``folded_words`` between spaces."""
    return (text or "").encode().translate(_FOLD)


def fold_lines(text: str | None) -> list[bytes]:
    """``fold`` of each part between line breaks."""
    return (text or "").encode().translate(_FOLD_LINES).split(b"\n")


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All texts' words (between ASCII white space), and where each text's begin (one more)."""
    column = pc.ascii_trim_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    lists = pc.ascii_split_whitespace(column)
    counts = np.diff(lists.offsets.to_numpy())
    words = lists.flatten()
    empty = pc.equal(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # to Arrow an empty text is one empty word
        words = words.filter(pc.not_equal(pc.binary_length(words), 0))
        counts[empty] = 0
    return words, np.append(0, np.cumsum(counts))


def flat(texts: list[str | None], folded: bool, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and where each text begins (one more).

    The words are those of ``folded_words`` or ``plain_words``; Arrow cuts the texts, and each
    distinct word is hashed once.
    """
    words, starts = split_words([fold(t) if folded else (t or "").encode() for t in texts])
    coded = pc.dictionary_encode(words)
    known = hashes.array(listed(coded.dictionary.view(pa.large_binary())))
    return known[coded.indices.to_numpy()], starts


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as their low halves, then their high halves (mostly zeros)."""
    return ((values & 0xFFFF).astype("<u2").tobytes()
            + (values >> 16).astype("<u2").tobytes())


def unplaned(raw: bytes, at: int, count: int) -> np.ndarray:
    low = np.frombuffer(raw, "<u2", count, at).astype(np.int64)
    return low | np.frombuffer(raw, "<u2", count, at + 2 * count).astype(np.int64) << 16


def ranks(ids: pa.Array, copies: pa.Array) -> np.ndarray:
    """Dense ranks of (id, copy), null ids first; equal pairs have equal ranks."""
    table = pa.table({"known": pc.is_valid(ids), "id": ids, "copy": copies})
    order = pc.sort_indices(table, sort_keys=[("known", "ascending"), ("id", "ascending"),
                                              ("copy", "ascending")])
    table = table.take(order)
    a, b = table.slice(1), table.slice(0, max(0, len(table) - 1))
    same_id = pc.if_else(pc.and_(a["known"], b["known"]), pc.fill_null(
        pc.equal(a["id"], b["id"]), False), pc.equal(a["known"], b["known"]))
    same = pc.and_(same_id, pc.equal(a["copy"], b["copy"])).to_numpy()
    out = np.empty(len(table), np.int64)
    out[order.to_numpy()] = np.append(0, np.cumsum(~same.astype(bool))) if len(table) else 0
    return out


def valid_starts(starts: np.ndarray, size: int) -> np.ndarray:
    """For each window start: does the window lie in one text?"""
    total = int(starts[-1]) - size + 1
    if total <= 0:
        return np.zeros(0, bool)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return owner[:total] == owner[size - 1:]


def shuffle_partitions(spark: SparkSession, df: DataFrame | None = None,
                       target: int = 64 << 20) -> int:
    """The session's number of shuffle partitions, or more if the input's size asks for it."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df is None:
        return least
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(size // target, 1 << 20)) if size < 1 << 60 else least


def whole_rows(docs: DataFrame) -> Column:
    """Each row as one struct, so that a job's own columns meet none of the table's names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def may_contain(df: DataFrame, key: str, members: DataFrame, bits: int = 25) -> DataFrame:
    """``df`` with ``__may``: false only where no row of ``members`` has the 64-bit hash ``key``.

    The members' hashes set bits of a bitmap of fixed size (4 MB), which is broadcast in parts of
    4 KB. It keeps rows that cannot match out of a shuffle; those that may still go through it.
    """
    place = F.pmod(F.col(key), F.lit(1 << bits)) + 1
    parts = members.select(place.alias("__p")).groupBy(
        F.bitmap_bucket_number("__p").alias("__part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("__p")).alias("__bits"))
    both = df.withColumn("__p", place).join(
        F.broadcast(parts), F.bitmap_bucket_number("__p") == F.col("__part"), "left")
    at = F.bitmap_bit_position("__p")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    hit = F.floor(byte.cast("long") / F.pow(F.lit(2), at % 8)) % 2 == 1
    return both.withColumn("__may", F.coalesce(hit, F.lit(False))).drop("__p", "__part", "__bits")
