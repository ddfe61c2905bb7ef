"""Broadcasts and driver-side reads behind a check of the size; one row per list item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only if the side has at most ``max_rows`` rows.

    Beyond that the plain side is returned: the join then shuffles, and adaptive
    execution picks the strategy and splits skewed partitions.
    """
    if len(df.limit(max_rows + 1).select(F.lit(1)).take(max_rows + 1)) > max_rows:
        return df
    return F.broadcast(df)


def small_or_merge(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join side that is broadcast if it is small, else sort-merged.

    For joins whose other side is an explode: its size estimate is that of the rows before
    the explode, so the optimizer must not be left to broadcast it.
    """
    side = broadcast_if_small(df, max_rows)
    return side if side is not df else df.hint("merge")


def rows_if_small(df: DataFrame, max_rows: int) -> list[Row] | None:
    """The rows of a table known to be small, or None if it has more than ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def one_per_item(df: DataFrame, items: str | Column, name: str,
                 keep: Sequence[str | Column] = ()) -> DataFrame:
    """One row per non-null list item, with the kept columns.

    A plain ``explode`` makes the optimizer add a filter on the list's size below it, which
    computes the list again; for lists cut out of long texts that doubles the work.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose values are computed once, whatever filters and uses follow.

    A filter on a plain computed column moves below the projection and computes the value
    again there; it cannot move below a generator.
    """
    fields = F.struct(*[value.alias(name) for name, value in columns.items()])
    out = df.select("*", F.explode_outer(F.array(fields)).alias("__once"))
    return out.select(*df.columns, *[F.col(f"__once.{name}").alias(name) for name in columns])
