"""Op 1. Hierarchical packing of documents into windows of several context sizes."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from newsloom.llm.common import chunks
from newsloom.llm.tokens import encoder

TIERS = (2048, 1024, 512, 256)


class _Piece:
    """``ids`` are those of its row from ``start`` on; ``row`` is (document, its number of ids)."""

    __slots__ = ("row", "start", "ids")

    def __init__(self, row, start, ids):
        self.row, self.start, self.ids = row, start, ids

    def cut(self, length: int) -> tuple[_Piece, _Piece]:
        return (_Piece(self.row, self.start, self.ids[:length]),
                _Piece(self.row, self.start + length, self.ids[length:]))


def fill_windows(pieces: list[_Piece], tiers: Sequence[int]) -> tuple[list, list[_Piece]]:
    """Full windows, each a list of pieces, and what is left: less than one longest window.

    A piece as long as the longest window or longer gives windows of its own. The rest of it,
    like a shorter document, belongs to the shortest tier that holds it and opens a window there,
    longest first. The window's gap takes the longest pieces of shorter tiers that fit and, where
    none fits, the beginning of the shortest that does not.
    """
    longest, full, pool, kept = tiers[0], [], [], []
    for piece in pieces:
        while len(piece.ids) >= longest:
            head, piece = piece.cut(longest)
            full.append([head])
        if len(piece.ids):
            pool.append((len(piece.ids), len(kept)))
            kept.append(piece)
    pool.sort()
    while pool:
        length, at = pool.pop()
        gap = min(t for t in tiers if t >= length) - length
        window = [kept[at]]
        while gap and pool:
            best = bisect_right(pool, (gap, len(kept))) - 1
            length, at = pool.pop(max(best, 0))
            piece = kept[at]
            if best < 0:
                piece, rest = piece.cut(gap)
                insort(pool, (len(rest.ids), len(kept)))
                kept.append(rest)
            window.append(piece)
            gap -= len(piece.ids)
        if gap:
            return full, window
        full.append(window)
    return full, []


def split_rest(pieces: list[_Piece]) -> list[list[_Piece]]:
    """Windows whose sizes are the powers of two that the pieces' length is made of."""
    total, out = sum(len(p.ids) for p in pieces), []
    pieces = pieces[::-1]
    while total:
        gap = 1 << (total.bit_length() - 1)
        total -= gap
        window = []
        while gap:
            piece = pieces.pop()
            if len(piece.ids) > gap:
                piece, rest = piece.cut(gap)
                pieces.append(rest)
            window.append(piece)
            gap -= len(piece.ids)
        out.append(window)
    return out


def step_groups(windows: list[list[_Piece]], step_tokens: int) -> list[int]:
    """A group for each window: one size in a group, about ``step_tokens`` ids in each.

    Windows of one size are dealt back and forth in the order of their attention cost (the sum of
    squared piece lengths), so that the groups of a size differ by one window at most and cost
    about the same.
    """
    by_size, out, first = defaultdict(list), [0] * len(windows), 0
    for at, window in enumerate(windows):
        by_size[sum(len(p.ids) for p in window)].append(at)
    for size in sorted(by_size, reverse=True):
        members = sorted(by_size[size], key=lambda i: (-sum(len(p.ids) ** 2 for p in windows[i]), i))
        groups = max(1, round(len(members) * size / step_tokens))
        for k, at in enumerate(members):
            turn, place = divmod(k, groups)
            out[at] = first + (place if turn % 2 == 0 else groups - 1 - place)
        first += groups
    return out


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                   end_id: int = 1, tiers: Sequence[int] = TIERS, step_tokens: int = 65_536,
                   with_ids: bool = True) -> DataFrame:
    """Pack documents into windows of the sizes ``tiers`` (powers of two, longest first).

    One row for each piece of a document: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, size, step_group[, ids]). ``sequence_id`` names a window of ``size`` ids,
    which its pieces fill without gaps from ``offset`` 0 on; ``step_group`` groups windows of one
    size for a training step; ``ids`` are little-endian unsigned 32-bit numbers.

    Each task packs the rows of its input partition as they stream by, about 8 MB of text at a
    time, and hands less than one window on to the next 8 MB: there is no shuffle, and a repeated
    task gives its rows again. All windows are full: a task's last ids go into windows of the
    powers of two that their number is made of, so there is no padding.

    A null or empty text is its end id alone. A null id stays null; repeated rows and ids are
    documents of their own. A long text is cut. Other columns are not read. An empty table gives
    no rows.
    """
    if list(tiers) != sorted(tiers, reverse=True) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two, longest first")
    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "size",
        "step_group")]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    names = [f.name for f in fields]
    tiers = tuple(tiers)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, True).encode
        base = TaskContext.get().partitionId() << 40
        count = groups = 0
        kind = None

        def rows(windows):
            nonlocal count, groups
            chosen = step_groups(windows, step_tokens)
            columns = [[] for _ in names]
            for window, group in zip(windows, chosen):
                size, offset = sum(len(p.ids) for p in window), 0
                for p in window:
                    raw = p.ids.tobytes()
                    row = (p.row[0], p.start, len(p.ids), zlib.crc32(raw), p.row[1], base + count,
                           offset, size, base + groups + group, raw)
                    for column, value in zip(columns, row):
                        column.append(value)
                    offset += len(p.ids)
                count += 1
            groups += max(chosen, default=-1) + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:9]]
                + [pa.array(c, pa.binary()) for c in columns[9:]], names)

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(doc_id).type
                yield batch

        rest: list[_Piece] = []
        for keys, texts in chunks(typed(), [doc_id, text], text):
            ids, starts = encode(texts)
            pieces = rest
            for k, key in enumerate(keys):
                own = np.append(ids[starts[k]:starts[k + 1]], np.uint32(end_id))
                pieces.append(_Piece((key, len(own)), 0, own))
            windows, rest = fill_windows(pieces, tiers)
            rest = [_Piece(p.row, p.start, p.ids.copy()) for p in rest]
            yield rows(windows)
        if rest:
            yield rows(split_rest(rest))

    return docs.select(doc_id, text).mapInArrow(pack, T.StructType(fields))
