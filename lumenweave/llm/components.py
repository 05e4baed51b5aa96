"""Connected components by joins: every node takes its smallest neighbour's label, then its label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every end of ``edges`` (columns a, b, longs): the smallest id that links reach.

    Each round is written to the shared folder, which cuts lineage; rounds grow with the logarithm of a
    component's diameter because labels are followed as pointers. Nothing but a changed-row count comes
    to the driver. Self links, repeated links and an empty table are fine.
    """
    both = scratch.table(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .distinct(),
        f"{name}-edges",
    )
    first = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("label"))
    labels, n = scratch.table(first, f"{name}-0"), 0
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("v"), F.col("label").alias("l")), "v")
            .groupBy("u")
            .agg(F.min("l").alias("l"))
        )
        low = labels.join(near.withColumnRenamed("u", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "l").alias("low"))
        jump = low.join(
            labels.select(F.col("id").alias("low"), F.col("label").alias("over")), "low", "left"
        ).select("id", F.coalesce(F.least("low", "over"), "low").alias("label"), "old")
        n += 1
        found = scratch.table(jump, f"{name}-{n}")
        labels = found.select("id", "label")
        scratch.drop(f"{name}-{n - 1}")
        if found.filter("label <> old").isEmpty():
            scratch.drop(f"{name}-edges")
            return labels.withColumnRenamed("label", "component")
