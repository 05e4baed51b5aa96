"""Combining pixels: block reduction, drizzle, context planes, stacks, masters, overlap cells.

Every operator scatters or groups relationally: contributions are summed before and after one shuffle on
the output key, whatever the number of frames.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.scalars import Affine, finite
from lumenweave.operators.stats import clipped, linear, median, quantiles

NAN = float("nan")


def block_reduce(df: DataFrame, factor: int, width: int, height: int) -> DataFrame:
    """factor x factor blocks: v finite mean, wht finite sum, err root of squares over n, dq OR; incomplete edge blocks go."""
    ok = lambda c: F.when(finite(F.col(c)), F.col(c))
    bx, by = F.floor(F.col("x") / factor), F.floor(F.col("y") / factor)
    inside = df.filter((F.col("x") < width // factor * factor) & (F.col("y") < height // factor * factor))
    return inside.groupBy("frame", bx.alias("bx"), by.alias("by")).agg(
        F.coalesce(F.avg(ok("v")), F.lit(NAN)).alias("v"), F.coalesce(F.sum(ok("wht")), F.lit(0.0)).alias("wht"),
        (F.sqrt(F.sum(ok("err") * ok("err"))) / F.count(ok("err"))).alias("err"), F.bit_or("dq").alias("dq"),
    )


def downsample(df: DataFrame, factor: int) -> DataFrame:
    """Mean of a block's finite samples; NaN where it has none."""
    c = F.when(finite(F.col("v")), F.col("v"))
    return df.groupBy("frame", F.floor(F.col("x") / factor).alias("bx"), F.floor(F.col("y") / factor).alias("by")).agg(F.coalesce(F.avg(c), F.lit(NAN)).alias("v"))


# --- drizzle --------------------------------------------------------------------------------------

KERNELS = ("square", "point", "turbo", "gaussian", "tophat", "lanczos2", "lanczos3")


def _sinc(c: Column) -> Column:
    p = F.lit(math.pi) * c
    return F.when(F.abs(c) < 1e-12, 1.0).otherwise(F.sin(p) / p)


def scatter(df: DataFrame, kernel: str, drop: float) -> DataFrame:
    """Each sample at (cx, cy) on the output grid to the pixels its footprint reaches: ox, oy and kernel weight kw.

    Fan-out is bounded by the kernel's size: 1 for point, (drop + 2) squared for square, and so on.
    """
    cx, cy, half = F.col("cx"), F.col("cy"), drop / 2
    if kernel == "point":
        return df.select("*", F.floor(cx + 0.5).alias("ox"), F.floor(cy + 0.5).alias("oy"), F.lit(1.0).alias("kw"))
    if kernel in ("lanczos2", "lanczos3"):
        n = int(kernel[-1])
        low = lambda c: F.floor(c) - n + 1
        high = lambda c: F.floor(c) + n
    else:
        reach = {"square": half, "turbo": half, "tophat": half, "gaussian": 3 * drop / 2.3548}[kernel]
        low = lambda c: F.floor(c - reach + 0.5)
        high = lambda c: F.ceil(c + reach - 0.5)
    grid = df.withColumn("ox", F.explode(F.sequence(low(cx), F.greatest(low(cx), high(cx))))).withColumn("oy", F.explode(F.sequence(low(cy), F.greatest(low(cy), high(cy)))))
    dx, dy = F.col("ox") - cx, F.col("oy") - cy
    if kernel == "square":
        side = lambda o, c: F.greatest(F.lit(0.0), F.least(o + 0.5, c + half) - F.greatest(o - 0.5, c - half))
        kw = side(F.col("ox"), cx) * side(F.col("oy"), cy) / (drop * drop)
    elif kernel == "turbo":
        nearest = (F.col("ox") == F.floor(cx + 0.5)) & (F.col("oy") == F.floor(cy + 0.5))
        inside = (F.abs(dx) <= half) & (F.abs(dy) <= half)
        # a footprint that holds no pixel centre goes to the nearest pixel
        none = (F.abs(F.floor(cx + 0.5) - cx) > half) | (F.abs(F.floor(cy + 0.5) - cy) > half)
        kw = F.when(inside | (none & nearest), 1.0).otherwise(0.0)
    elif kernel == "gaussian":
        sigma = drop / 2.3548
        kw = F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))
        kw = F.when(kw < 1e-6, 0.0).otherwise(kw)
    elif kernel == "tophat":
        kw = F.when(dx * dx + dy * dy <= half * half, 1.0).otherwise(0.0)
    else:
        n = int(kernel[-1])
        kw = _sinc(dx) * _sinc(dx / n) * _sinc(dy) * _sinc(dy / n)
        kw = F.when((F.abs(dx) >= n) | (F.abs(dy) >= n), 0.0).otherwise(kw)
    return grid.withColumn("kw", kw).filter("kw <> 0")


def sample_weight(mode: str) -> tuple[Column, Column]:
    """(value, weight) of a sample with v, err, wht, exptime and unit class: uniform, exposure or error weighting.

    Counts become rates under exposure and error weighting; what is a rate already is not divided again.
    """
    counts = F.col("unit") == "counts"
    value = F.when(counts, F.col("v") / F.col("exptime")).otherwise(F.col("v"))
    if mode == "exposure":
        return value, F.col("exptime")
    if mode == "err":
        e = F.when(counts, F.col("err") / F.col("exptime")).otherwise(F.col("err"))
        return value, F.when(F.col("wht") > 0, F.col("wht")).when(e > 0, 1 / (e * e)).otherwise(1.0)
    return F.col("v"), F.lit(1.0)


def accumulate(contributions: DataFrame, value: Column, weight: Column) -> DataFrame:
    """Weighted mean and weight by output pixel; NaN where the weight all but vanishes. Lanczos weights are signed, so its size decides."""
    w = weight * F.col("kw")
    sums = contributions.filter(finite(value)).groupBy("ox", "oy").agg(F.sum(value * w).alias("vw"), F.sum(w).alias("w"))
    return sums.select("ox", "oy", F.when(F.abs("w") <= 1e-12, F.lit(NAN)).otherwise(F.col("vw") / F.col("w")).alias("v"), F.col("w").alias("weight"))


def map_table(spark, maps: dict[int, Affine]) -> DataFrame:
    """Frames' maps as a table: a row a frame, which the caller's dictionary already holds."""
    rows = [(int(k), *(float(getattr(m, c)) for c in "abcdef")) for k, m in maps.items()]
    return spark.createDataFrame(rows, "frame long, ma double, mb double, mc double, md double, me double, mf double")


def place(df: DataFrame, maps: dict[int, Affine]) -> DataFrame:
    """cx, cy of each pixel by its frame's map (identity where it has none)."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    if not maps:
        return df.withColumns({"cx": x, "cy": y})
    j = df.join(F.broadcast(map_table(df.sparkSession, maps)), "frame", "left")  # a row a frame
    at = lambda a, b, c, own: F.coalesce(F.col(a) * x + F.col(b) * y + F.col(c), own)
    return j.select(*[F.col(f"`{c}`") for c in df.columns], at("ma", "mb", "mc", x).alias("cx"), at("md", "me", "mf", y).alias("cy"))


def context(contributions: DataFrame) -> DataFrame:
    """By output pixel and plane of 32 inputs: which inputs contribute, as bits; n is how many."""
    bit = F.expr("shiftleft(1L, cast(frame % 32 as int))")
    return contributions.groupBy("ox", "oy", F.floor(F.col("frame") / 32).alias("plane")).agg(F.bit_or(bit).alias("bits")).withColumn("n", F.bit_count("bits"))


def project_mask(contributions: DataFrame) -> DataFrame:
    """OR of the bit masks that land on each output pixel."""
    return contributions.groupBy("ox", "oy").agg(F.bit_or("dq").alias("dq"))


def seam(contributions: DataFrame, mosaic: DataFrame, weight: Column) -> DataFrame:
    """Root mean square of samples about the mosaic where two inputs or more meet."""
    m = mosaic.select("ox", "oy", F.col("v").alias("m"))
    w = weight * F.col("kw")
    d = F.col("v") - F.col("m")
    s = contributions.filter(finite(F.col("v"))).join(m, ["ox", "oy"]).groupBy("ox", "oy")
    both = s.agg(F.sum(w * d * d).alias("q"), F.sum(w).alias("w"), F.countDistinct("frame").alias("inputs"))
    return both.filter("inputs >= 2 AND w > 0").select("ox", "oy", "inputs", F.sqrt(F.col("q") / F.col("w")).alias("rms"))


def plane_mean(cover: DataFrame, planes: DataFrame) -> DataFrame:
    """Mean of a x + b y + c over the planes of the frames that cover a pixel."""
    at = F.col("a") * F.col("ox") + F.col("b") * F.col("oy") + F.col("c")
    return cover.select("ox", "oy", "frame").distinct().join(F.broadcast(planes), "frame").groupBy("ox", "oy").agg(F.avg(at).alias("sky"))


# --- stacks ---------------------------------------------------------------------------------------


def stack(df: DataFrame, frames: int) -> DataFrame:
    """Per pixel over frames: median, and the lesser of mean and median when there are three frames or fewer (of all, not of those that cover it)."""
    ok = df.filter(finite(F.col("v")))
    s = ok.groupBy("x", "y").agg(F.count("*").alias("n"), F.median("v").alias("median"), F.avg("v").alias("mean"))
    return s.select("x", "y", "n", (F.least("mean", "median") if frames <= 3 else F.col("median")).alias("v"))


def master_bias(df: DataFrame) -> DataFrame:
    return df.filter(finite(F.col("v"))).groupBy("x", "y").agg(F.median("v").alias("bias"))


def master_flat(df: DataFrame, bias: DataFrame) -> DataFrame:
    """Per-pixel median less bias, over the median of all positive ones; what isn't positive is NaN."""
    raw = df.join(bias, ["x", "y"]).withColumn("d", F.col("v") - F.col("bias")).filter(finite(F.col("d"))).groupBy("x", "y").agg(F.median("d").alias("f"))
    level = median(raw.filter("f > 0"), [], F.col("f"), "level")
    return raw.crossJoin(F.broadcast(level)).select("x", "y", F.when(F.col("f") > 0, F.col("f") / F.col("level")).otherwise(F.lit(NAN)).alias("flat"))


def calibrate(df: DataFrame, bias: DataFrame, flat: DataFrame) -> DataFrame:
    """(v - bias) / flat, NaN where the flat is bad."""
    good = finite(F.col("flat")) & (F.col("flat") > 0)
    return df.join(bias, ["x", "y"], "left").join(flat, ["x", "y"], "left").select(
        "frame", "x", "y", F.when(good, (F.col("v") - F.coalesce("bias", F.lit(0.0))) / F.col("flat")).otherwise(F.lit(NAN)).alias("v")
    )


def cells(df: DataFrame, size: int = 32, most: int = 96, least: int = 8) -> DataFrame:
    """Median of each frame's overlap cell: its first ``most`` finite samples in row order, if there are ``least``."""
    at = df.filter(finite(F.col("v"))).withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    rank = F.row_number().over(Window.partitionBy("frame", "cx", "cy").orderBy("y", "x"))
    return at.withColumn("r", rank).filter(F.col("r") <= most).groupBy("frame", "cx", "cy").agg(F.count("*").alias("n"), F.median("v").alias("value")).filter(F.col("n") >= least)


def overlap_differences(c: DataFrame) -> DataFrame:
    """Pairs of frames i < j by shared cell, with value j - i."""
    a, b = c.select(F.col("frame").alias("i"), "cx", "cy", F.col("value").alias("vi")), c.select(F.col("frame").alias("j"), "cx", "cy", F.col("value").alias("vj"))
    return a.join(b, ["cx", "cy"]).filter("i < j").select("i", "j", "cx", "cy", (F.col("vj") - F.col("vi")).alias("delta"))


def local_minimum(values: DataFrame, group: str, v: str) -> DataFrame:
    """Each row's group minimum and the minimum of all."""
    least = values.agg(F.min(v).alias("global_min"))
    return values.withColumn("local_min", F.min(v).over(Window.partitionBy(group))).crossJoin(F.broadcast(least))


def amplifier_steps(df: DataFrame, width: int, band: int = 16, least: int = 200, strips: int = 4) -> DataFrame:
    """Cumulative offsets between vertical strips, centred on zero, by the median over bands of clipped-median steps."""
    w = width // strips
    amp = F.least(F.floor(F.col("x") / w), F.lit(strips - 1)).cast("int")
    keys = ["frame", "amp", "band"]
    rows = df.withColumns({"amp": amp, "band": F.floor(F.col("y") / band)})
    level = quantiles(clipped(rows, keys, "v", 3.0, 3.0, 3), keys, F.col("v"), {"m": linear(0.5)}).filter(F.col("n") >= least)
    nxt = level.select("frame", (F.col("amp") - 1).alias("amp"), "band", F.col("m").alias("m2"))
    step = level.join(nxt, keys).groupBy("frame", (F.col("amp") + 1).alias("amp")).agg(F.median(F.col("m2") - F.col("m")).alias("step"))
    every = level.select("frame").distinct().crossJoin(df.sparkSession.range(strips).select(F.col("id").cast("int").alias("amp"))).join(step, ["frame", "amp"], "left")
    run = F.sum(F.coalesce("step", F.lit(0.0))).over(Window.partitionBy("frame").orderBy("amp"))
    return every.withColumn("run", run).select("frame", "amp", (F.col("run") - F.avg("run").over(Window.partitionBy("frame"))).alias("offset"))


def row_medians(df: DataFrame, width: int, least: int = 64, strips: int = 4) -> DataFrame:
    """Median of each strip's row, NaN under ``least`` unmasked samples."""
    amp = F.least(F.floor(F.col("x") / (width // strips)), F.lit(strips - 1)).cast("int")
    ok = F.when(finite(F.col("v")) & ~F.coalesce(F.col("mask"), F.lit(False)), F.col("v"))
    return df.groupBy("frame", amp.alias("amp"), "y").agg(F.count(ok).alias("n"), F.when(F.count(ok) >= least, F.median(ok)).otherwise(F.lit(NAN)).alias("m"))
