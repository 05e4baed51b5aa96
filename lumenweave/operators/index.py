"""Row numbers over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_index(df: DataFrame, order: list[str], out: str, partitions: int = 0) -> DataFrame:
    """``df`` with ``out``: 0, 1, 2, ... by ``order``, which must be unique.

    Rows are dealt by ranges of the order, numbered inside each range, and go on from the sizes of those before. The dealt
    rows are kept, because range bounds are sampled and both readers must see the same ranges.
    """
    n = partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()).persist()
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))  # a row a range
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", own).join(F.broadcast(first), "__part").select(*df.columns, (F.col("__first") + F.col("__own") - 1).cast("long").alias(out))
