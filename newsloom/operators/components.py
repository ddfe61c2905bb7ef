"""Ends of chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import materialize


def roots(parents: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root): where the chain of parents of each node ends.

    Chains have no loops. Each round joins the table with itself and so halves all chains; its
    result is written.
    """
    now = parents.select(F.col(node), F.col(parent).alias("root"))
    while True:
        above = now.select(F.col(node).alias("__at"), F.col("root").alias("__next"))
        now = materialize(now.join(above, F.col("root") == F.col("__at"), "left").select(
            node, F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__more")),
            "chains")
        if not now.filter("__more").take(1):
            return now.drop("__more")
        now = now.drop("__more")
