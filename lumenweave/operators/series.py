"""Ordered and neighbourhood operators: shrinking windows, de-banding, ranked and spatial selection, derivatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.scalars import finite
from lumenweave.session import settled

NAN = float("nan")


def symmetric_mean(df: DataFrame, keys: list[str], order: str, v: str, width: int) -> DataFrame:
    """Moving mean whose half width shrinks alike on both sides near the ends: min(width // 2, i, n - 1 - i). NaN is skipped.

    Prefix sums answer any window, so each row looks two of them up in its own group instead of scanning a frame.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    ok = finite(F.col(v))
    rows = df.withColumns(
        {
            "__i": F.row_number().over(w) - 1,
            "__n": F.count("*").over(Window.partitionBy(*keys)),
            "__s": F.sum(F.when(ok, F.col(v)).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "__c": F.sum(ok.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    half = F.least(F.lit(width // 2), F.col("__i"), F.col("__n") - 1 - F.col("__i"))
    rows = rows.withColumns({"__a": F.col("__i") - half - 1, "__b": F.col("__i") + half})
    at = lambda k: rows.select(*keys, F.col("__i").alias(f"__{k}"), F.col("__s").alias(f"__s{k}"), F.col("__c").alias(f"__c{k}"))
    out = rows.join(at("b"), [*keys, "__b"]).join(at("a"), [*keys, "__a"], "left")
    total, count = F.col("__sb") - F.coalesce("__sa", F.lit(0.0)), F.col("__cb") - F.coalesce("__ca", F.lit(0))
    return out.select(*df.columns, F.when(count > 0, total / count).otherwise(F.lit(NAN)).alias("trend"))


def deband(df: DataFrame, medians: DataFrame, width: int, strips: int = 4, window: int = 129) -> DataFrame:
    """Subtract from each pixel its strip's row median less its trend; the first and last row have no trend to leave."""
    amp = F.least(F.floor(F.col("x") / (width // strips)), F.lit(strips - 1)).cast("int")
    trend = symmetric_mean(medians, ["frame", "amp"], "y", "m", window | 1)
    off = F.when(finite(F.col("m")) & finite(F.col("trend")), F.col("m") - F.col("trend")).otherwise(0.0)
    rows = df.withColumn("amp", amp).join(trend.select("frame", "amp", "y", off.alias("correction")), ["frame", "amp", "y"], "left")
    return rows.select("frame", "x", "y", "amp", (F.col("v") - F.coalesce("correction", F.lit(0.0))).alias("v"))


def brightest(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The ``n`` of greatest peak, then least x, then least y, of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("peak").desc(), "x", "y"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def spread(df: DataFrame, n: int, keys: list[str], extent: float) -> DataFrame:
    """At most ``n`` of each group, taken in turns from the cells of a sqrt(n) grid, brightest first; all where there are no more."""
    side = max(1, int(n**0.5))
    cell = lambda c: F.least(F.floor(F.col(c) * side / extent), F.lit(side - 1))
    own = Window.partitionBy(*keys, "__cell").orderBy(F.col("peak").desc(), "x", "y")
    turn = Window.partitionBy(*keys).orderBy("__turn", "__cell")
    rows = df.withColumn("__cell", cell("y") * side + cell("x")).withColumn("__turn", F.row_number().over(own))
    rows = rows.withColumn("rank", F.row_number().over(turn)).withColumn("__all", F.count("*").over(Window.partitionBy(*keys)))
    return rows.filter((F.col("__all") <= n) | (F.col("rank") <= n)).drop("__cell", "__turn", "__all")


def supported(df: DataFrame, n: int, keys: list[str], support: str = "support", order: str = "star", least: int = 4, enough: int = 2) -> DataFrame:
    """The ``n`` of most support, then least index; where fewer than ``least`` have ``enough`` of it, the first ``n`` by index."""
    # a row a group says which order holds, so that ranks stop at n in every task before a group comes together
    rows = settled(df, "supported")
    good = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg((F.count_if(F.col(support) >= enough) < least).alias("fallback"))
    first = F.when(F.col("fallback"), 0).otherwise(-F.col(support))
    placed = rows.join(F.broadcast(good), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*good.columns[:-1])
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(first, order))).filter(F.col("rank") <= n)
    return ranked.filter(F.col("fallback") | (F.col(support) >= enough))


def neighbours(df: DataFrame, v: str = "v") -> DataFrame:
    """Left, right, up and down neighbour values, null where the pixel next to it is missing."""
    row, col = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")

    def near(w, axis, step):
        shift = F.lag if step < 0 else F.lead
        return F.when(shift(axis).over(w) == F.col(axis) + step, shift(v).over(w))

    return df.withColumns({"left": near(row, "x", -1), "right": near(row, "x", 1), "up": near(col, "y", -1), "down": near(col, "y", 1)})


def derivative(df: DataFrame, v: str = "v") -> DataFrame:
    """Largest difference to a neighbour, and the Laplacian where all four are there."""
    rows = neighbours(df, v)
    sides = [F.col(c) for c in ("left", "right", "up", "down")]
    return rows.select(
        "frame", "x", "y", F.greatest(*[F.abs(F.col(v) - s) for s in sides]).alias("steepest"), (4 * F.col(v) - sum(sides[1:], sides[0])).alias("laplacian")
    )


def local_maxima(df: DataFrame, v: str = "v") -> DataFrame:
    """Pixels above all their neighbours (a missing one doesn't count against them)."""
    rows = neighbours(df, v)
    above = finite(F.col(v))
    for c in ("left", "right", "up", "down"):
        above &= F.coalesce(F.col(v) > F.col(c), F.lit(True))
    return rows.filter(above).select("frame", "x", "y", v)


def tile_noise(df: DataFrame, size: int = 64, v: str = "v") -> DataFrame:
    """1.0484 * median |v(x) - v(x + 1)| by tile."""
    w = Window.partitionBy("frame", "y").orderBy("x")
    step = F.when(F.lead("x").over(w) == F.col("x") + 1, F.abs(F.col(v) - F.lead(v).over(w)))
    rows = df.filter(finite(F.col(v))).withColumn("step", step)
    return rows.groupBy("frame", F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty")).agg((1.0484 * F.median("step")).alias("noise"))


def equalise(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Share of samples up to and with each bin."""
    w = Window.partitionBy(*keys)
    return hist.select(*keys, "bin", (F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)).alias("cdf"))
