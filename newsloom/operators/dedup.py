"""Duplicate removal."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.normalize import title_key
from newsloom.operators.ranking import top_per_group


def first_per_key(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first by ``order``. A hot key leaves one row per map task."""
    return top_per_group(df, [key], order, 1)


def first_per_window(df: DataFrame, key: str, ts: str, seconds: int,
                     tie: str) -> DataFrame:
    """A row goes if a kept row of its key lies less than ``seconds`` before it.

    So the first row of a key stays, and after each kept row the first one ``seconds`` or
    more later. The decision depends on the one before, hence one pass over each key's rows
    in the order of time; a task streams its rows in Arrow batches and holds one time. Of a
    key's rows without a time the first by ``tie`` stays.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    placed = df.withColumn("__micros", micros)
    # Of equal times only the first can stay: a burst is reduced before the shuffle.
    placed = top_per_group(placed, [key, "__micros"], [tie], 1)
    ordered = placed.repartition(key).sortWithinPartitions(key, "__micros")
    span = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = object(), None
        for batch in batches:
            keep = []
            keys, times = batch.column(key).to_pylist(), batch.column("__micros").to_pylist()
            for name, at in zip(keys, times):
                if name != current:
                    current, last = name, None
                stays = at is None or last is None or at >= last + span
                if stays and at is not None:
                    last = at
                keep.append(stays)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, placed.schema).drop("__micros")


def only_new(batch: DataFrame, sink: DataFrame, key: str, order: Sequence[str | Column]
             ) -> DataFrame:
    """Rows whose key the sink does not hold yet, each key once."""
    fresh = batch.join(sink.select(key), key, "left_anti")
    return first_per_key(fresh, key, order)


def latest_per_title(df: DataFrame, ts: str, tie: str) -> DataFrame:
    return first_per_key(df, "title", [F.col(ts).desc(), F.col(tie)])


def distinct_headlines(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows by ``order`` whose normalised titles differ."""
    keyed = df.withColumn("__key", title_key(F.col("title")))
    return first_per_key(keyed, "__key", order).orderBy(*order).limit(k).drop("__key")
