"""Mixing channels into colour: weighted sums, wavelength weights, overlays, luminance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.scalars import finite


def weighted_mix(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Red, green and blue of each pixel: the sum of v / peak * weight over sources, hue kept by dividing by the greatest where it is above 1.

    A source whose finite peak isn't positive takes no part. ``weights``: a row a source (frame, wr, wg, wb).
    """
    ok = df.filter(finite(F.col("v")))
    peak = ok.groupBy("frame").agg(F.max("v").alias("peak")).filter("peak > 0").join(weights, "frame")
    unit = F.col("v") / F.col("peak")
    c = ok.join(F.broadcast(peak), "frame").groupBy("x", "y").agg(*[F.sum(unit * F.col(f"w{k}")).alias(k) for k in "rgb"])
    top = F.greatest(F.lit(1.0), "r", "g", "b")
    return c.select("x", "y", *[(F.col(k) / top).alias(k) for k in "rgb"])


def wavelength_weights(sources: DataFrame, accent: float = 100.0, shift: float = 0.25) -> DataFrame:
    """Weights of sources (id, nm, class base or narrow) by place in the spectrum.

    Anchors run from blue (0, s, 1 - s) over green (s, 1 - 2 s, s) to red (1 - s, s, 0). Base columns sum to one
    over the base sources; narrow ones share an accent, scaled by their largest column. With fewer than two
    base sources all are base (``promoted``).
    """
    every = Window.partitionBy(F.lit(0))  # a row a source
    base = F.col("kind") == "base"
    s = sources.withColumn("promoted", F.sum(base.cast("int")).over(every) < 2)
    s = s.withColumn("kind", F.when(F.col("promoted"), "base").otherwise(F.col("kind")))
    lo, hi = F.min("nm").over(every), F.max("nm").over(every)
    t = F.when(hi > lo, (F.col("nm") - lo) / (hi - lo)).otherwise(0.5)
    blue, green, red = (0.0, shift, 1 - shift), (shift, 1 - 2 * shift, shift), (1 - shift, shift, 0.0)
    s = s.withColumn("t", t)
    for k, name in enumerate("rgb"):
        low = blue[k] + (green[k] - blue[k]) * (F.col("t") * 2)
        high = green[k] + (red[k] - green[k]) * (F.col("t") * 2 - 1)
        s = s.withColumn(f"raw_{name}", F.when(F.col("t") <= 0.5, low).otherwise(high))
    part = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)).otherwise(0.0)).over(every)
    sums = {f"b_{c}": part("base", f"raw_{c}") for c in "rgb"} | {f"n_{c}": part("narrow", f"raw_{c}") for c in "rgb"}
    s = s.withColumns(sums)
    most = F.greatest("n_r", "n_g", "n_b")
    out = [
        F.when(F.col("kind") == "base", F.when(F.col(f"b_{c}") > 0, F.col(f"raw_{c}") / F.col(f"b_{c}")).otherwise(0.0))
        .otherwise(F.col(f"raw_{c}") * accent / 100 / F.when(most > 0, most).otherwise(1.0))
        .alias(f"w{c}")
        for c in "rgb"
    ]
    return s.select("id", "nm", "kind", "promoted", *out)
