"""Top rows per group, and ranks and running sums that survive one hot group.

``top_per_group`` filters ``row_number`` against a constant, so Spark keeps only the
first k rows of each group before the shuffle (WindowGroupLimit).

Ranks over *all* rows of a group cannot be limited that way. They are computed in two
levels: within ranges of the sorted rows (ranks) or short time slots (sums), and as offsets
over the totals of those. A group that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.operators.bounds import small_or_merge
from newsloom.session import materialize


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int,
                  rank: str | None = None) -> DataFrame:
    name = rank or "__rank"
    window = W.partitionBy(*keys).orderBy(*_columns(order))
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def time_slot(ts: Column, seconds: float) -> Column:
    """Number of the fixed-width slot a timestamp falls into; keeps the order of time."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.floor(micros / F.lit(int(seconds * 1_000_000))).cast("long")


def newest_first(ts: Column, tie: Column) -> Column:
    """A value whose least is the newest row's; rows without a time come last.

    ``tie`` may have any type that can be ordered.
    """
    return F.struct(ts.isNull().alias("untimed"),
                    (-F.unix_micros(ts.cast("timestamp"))).alias("age"), tie.alias("tie"))


def running_rank(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str | Column],
                 rank: str = "rank", first: str | None = None) -> DataFrame:
    """Position 1, 2, … of each row within its group (all rows without keys) by (ts, tie).

    The rows are sorted by ranges over all groups, which spreads a large group and rows of one time
    alike if the tie differs, and written with their place. The numbers of rows of the ranges before
    in the group, one value for each group and range, are added. ``first`` additionally names a
    column for the earliest ``ts`` of the group.
    """
    order = [*_columns(keys), F.col(ts), *_columns(tie)]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("__seq", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("__range", F.shiftright("__seq", 33))
    totals = placed.groupBy(*keys, "__range").agg(
        F.count("*").alias("__n"), F.min("__seq").alias("__start"), F.min(ts).alias("__first"))
    group = W.partitionBy(*keys)
    before = group.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__range").alias("__at"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__start") + 1).alias("__shift"),
        F.min("__first").over(group).alias("__group_first"))
    same = F.col("__range") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    out = placed.join(offsets, same).withColumn(rank, F.col("__seq") + F.col("__shift"))
    if first:
        out = out.withColumn(first, F.col("__group_first"))
    return out.drop("__seq", "__range", "__at", "__shift", "__group_first",
                    *[f"__key{i}" for i in range(len(keys))])


def running_sum(df: DataFrame, keys: Sequence[str], ts: str, value: str, name: str,
                slot_seconds: float = 86_400.0) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to and including this one."""
    slotted = df.withColumn("__slot", time_slot(F.col(ts), slot_seconds))
    totals = slotted.groupBy(*keys, "__slot").agg(F.sum(value).alias("__total"))
    earlier = W.partitionBy(*keys).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__slot", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    within = W.partitionBy(*keys, "__slot").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    out = slotted.withColumn("__in_slot", F.sum(value).over(within)).join(
        offsets, [*keys, "__slot"])
    return out.withColumn(name, F.col("__before") + F.col("__in_slot")).drop(
        "__slot", "__before", "__in_slot")


def exact_median(df: DataFrame, key: str, value: str, name: str = "median",
                 accuracy: int = 100_000, **figures: Column) -> DataFrame:
    """Exact median per key without holding a group's values in one place.

    A quantile sketch brackets the middle of each group within a few parts in
    ``accuracy``; other ``figures`` are aggregated in the same pass. The bracket, one row
    per key, is written and then broadcast if there are few keys. The second pass counts
    the values below the bracket and ranks only those inside, collapsed to (value, count).
    """
    rows = df.filter(F.col(value).isNotNull())
    v = F.col(value).cast("double")
    margin = 4.0 / accuracy
    sketch = rows.groupBy(key).agg(
        F.percentile_approx(v, [0.5 - margin, 0.5 + margin], accuracy).alias("b"),
        F.count("*").alias("n"), F.min(v).alias("lo_all"), F.max(v).alias("hi_all"),
        *[figure.alias(label) for label, figure in figures.items()])
    # Small groups are ranked whole: the sketch may skip neighbours of their middle.
    whole = F.col("n") < accuracy
    bracket = materialize(sketch.select(
        key, "n", *figures, F.when(whole, F.col("lo_all")).otherwise(F.col("b")[0]).alias("lo"),
        F.when(whole, F.col("hi_all")).otherwise(F.col("b")[1]).alias("hi")), "bracket")
    placed = rows.select(key, v.alias("v")).join(
        small_or_merge(bracket.select(key, "n", "lo", "hi")), key).filter(F.col("v") <= F.col("hi"))
    inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))
    counted = placed.groupBy(key, "n", inside.alias("v")).agg(F.count("*").alias("c"))
    upto = W.partitionBy(key).orderBy(F.col("v").asc_nulls_first()).rowsBetween(
        W.unboundedPreceding, 0)
    ranked = counted.withColumn("last", F.sum("c").over(upto))
    ranked = ranked.withColumn("first", F.col("last") - F.col("c") + 1)
    low_rank = F.floor((F.col("n") + 1) / 2)
    high_rank = F.floor((F.col("n") + 2) / 2)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("v")))

    medians = ranked.groupBy(key).agg(((at(low_rank) + at(high_rank)) / 2).alias(name))
    return medians.join(bracket.select(key, *figures), key) if figures else medians
