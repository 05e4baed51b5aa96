"""Scoring detections against labels, and containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and ratios of detections (selected, truth: star, not or ambiguous); a ratio over nothing is null.

    Conservative precision counts unresolved selections against the detector, certain precision leaves them out.
    """
    sel, t = F.col("selected"), F.col("truth")
    k = df.groupBy(*keys).agg(
        F.count_if(sel & (t == "star")).alias("tp"), F.count_if(sel & (t == "not")).alias("fp"),
        F.count_if(~sel & (t == "star")).alias("fn"), F.count_if(sel & (t == "ambiguous")).alias("unresolved"),
    )
    ratio = lambda *c: F.col("tp") / F.nullif(sum((F.col(x) for x in c[1:]), F.col(c[0])), F.lit(0))
    return k.withColumns({"conservative": ratio("tp", "fp", "unresolved"), "certain": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


def leakage(mask: DataFrame, rects: DataFrame, threshold: float = 0.05) -> DataFrame:
    """By frame: pixels under any protected rectangle, those above ``threshold``, and the mask's sum; overlaps count once."""
    r = F.broadcast(rects)
    inside = (mask["x"] >= r["x0"]) & (mask["x"] <= r["x1"]) & (mask["y"] >= r["y0"]) & (mask["y"] <= r["y1"])
    under = mask.join(r, inside, "left_semi").filter(~F.isnan("mask"))
    return under.groupBy("frame").agg(F.count("*").alias("pixels"), F.count_if(F.col("mask") > threshold).alias("leaking"), F.sum("mask").alias("mask_sum"))


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Inside a convex polygon given counter-clockwise, its border included."""
    out = F.lit(True)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]]):
        out &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
    return out
