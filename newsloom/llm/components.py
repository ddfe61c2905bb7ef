"""Connected components by contraction, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import materialize


def _normal(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v) that has an edge to another node.

    In each round every node joins its least neighbour, if that is less than itself, and the edges
    between what has joined make the next, smaller graph; the rounds' tables are then put together
    from the last to the first. Labels should be hashes: then the graph shrinks by a constant
    factor in each round, whatever its shape. Nulls and loops are left out.
    """
    now, steps = materialize(_normal(edges.filter("u IS NOT NULL AND v IS NOT NULL")), "edges"), []
    while now.take(1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("node"), F.least("u", "m").alias("root")), "edges")
        steps.append(step)
        ends = [step.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root"))
                for c in "uv"]
        joined = now.join(ends[0], F.col("u") == F.col("u_node")).join(
            ends[1], F.col("v") == F.col("v_node"))
        now = materialize(_normal(joined.select(F.col("u_root").alias("u"),
                                                F.col("v_root").alias("v"))), "edges")
    if not steps:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = steps.pop()
    while steps:
        later = out.select(F.col("node").alias("at"), F.col("root").alias("end"))
        out = steps.pop().join(later, F.col("root") == F.col("at"), "left").select(
            "node", F.coalesce("end", "root").alias("root"))
    return out
