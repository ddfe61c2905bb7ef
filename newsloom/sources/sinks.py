"""Sinks: topics, keyed upserts, exports, reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators.ranking import top_per_group
from newsloom.session import scratch_path


def encode_json(df: DataFrame) -> DataFrame:
    """One ``value`` column with each row as a JSON object."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def topic_sink(stream: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    return (encode_json(stream).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("kafka.acks", "all").option("checkpointLocation", checkpoint).start())


def file_sink(stream: DataFrame, path: str, checkpoint: str, format: str = "text",
              every: str | None = None) -> StreamingQuery:
    """JSON lines (``text``) or a table (``parquet``); with no interval, what is there now."""
    out = encode_json(stream) if format == "text" else stream
    writer = out.writeStream.format(format).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def upsert(batch: DataFrame, path: str, key: str, order: Sequence[str], partition: str,
           rows_move: bool = True) -> None:
    """Merge a batch into a Parquet table partitioned by ``partition``: the row that is last by
    the ``order`` columns wins, so late and repeated batches are harmless.

    Only the partitions that receive rows, or hold an older row of a key that comes again, are
    read in full and rewritten. Finding the latter reads the key column of the table;
    ``rows_move=False`` skips it where a key always stays in its partition. The new contents
    are written elsewhere first and then replace those partitions.
    """
    spark = batch.sparkSession
    latest = [F.col(c).desc() for c in order]
    last = top_per_group(batch, [key], latest, 1)
    if not exists(spark, path):
        last.hint("rebalance", F.col(partition)).write.partitionBy(partition).parquet(path)
        return
    staged = scratch_path(spark, "upsert")

    def step(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{staged}/{name}")
        return spark.read.schema(df.schema).parquet(f"{staged}/{name}")

    new = step(last, "new")
    old = spark.read.schema(last.schema).parquet(path)
    touched = new.select(partition)
    if rows_move:
        known = old.select(key, partition).join(new.select(key), key, "left_semi")
        touched = touched.unionByName(known.select(partition))
    touched = step(touched.distinct(), "touched")
    present = old.join(touched, partition, "left_semi")
    merged = step(top_per_group(present.unionByName(new), [key], latest, 1), "merged")
    (merged.hint("rebalance", F.col(partition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))
    _drop_emptied(touched.join(merged.select(partition), partition, "left_anti"), path, partition)


def _drop_emptied(partitions: DataFrame, path: str, partition: str) -> None:
    """Remove partition folders that no longer hold a row (one name per folder)."""
    spark = partitions.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for row in partitions.select(F.col(partition).cast("string")).toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={row[0]}")
        folder.getFileSystem(conf).delete(folder, True)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str,
                  order: Sequence[str], partition: str, rows_move: bool = True,
                  every: str | None = None) -> StreamingQuery:
    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, path, key, order, partition, rows_move)

    return foreach_batch(stream, merge, checkpoint, every)


def foreach_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str,
                  every: str | None = None, mode: str = "append") -> StreamingQuery:
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (stream.writeStream.foreachBatch(action).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Nested columns become JSON text; everything else is written as it is."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)


def latency_report(stats: DataFrame, samples: DataFrame, level: str, value: str) -> DataFrame:
    """One nested row per level: figures and its first samples (already limited)."""
    listed = samples.groupBy(level).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", value))), lambda s: s[value])
        .alias("samples"))
    return stats.join(listed, level, "left")


def velocity_report(peaks: DataFrame, history: DataFrame, group: str, ts: str, value: str,
                    points: int | None = None) -> DataFrame:
    """One nested row per group: its peak and its whole history, or its latest ``points`` points."""
    kept = history.select(group, ts, value)
    if points is not None:
        kept = top_per_group(kept, [group], [F.col(ts).desc()], points)
    listed = kept.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct(ts, value))).alias("velocity_history"))
    return peaks.join(listed, group, "left")
