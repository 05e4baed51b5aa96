"""Planes of different grids brought to one: a table of control points says where the pixels of a grid lie in another, and what lies between is interpolated.

The exact way between two grids (sky coordinates, distortions undone step by step) is taken for a coarse net of points only. How far the interpolated places are from the
exact ones is measured in the middle of every cell of the net and along its edges, and the net is made finer until none is further off than a stated bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.functions import scalars as s
from lumenweave.functions.scalars import finite
from lumenweave.functions.wcs import Mapper
from lumenweave.operators import compose, raster, series, stats

MOST_POINTS = 4_000_000  # of a net: 64 MB on the driver


def net(own: Mapper, target: Mapper, width: int, height: int, step: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Places in ``own`` (py, px of each point) of the target grid's pixels at multiples of ``step``, one past its far edges, and the largest error of what is interpolated between them."""

    def exact(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return own.pixel(*target.sky(x, y))

    gx, gy = np.meshgrid(np.arange(0, width + step, step, dtype=float), np.arange(0, height + step, step, dtype=float))
    px, py = exact(gx.ravel(), gy.ravel())
    px, py = px.reshape(gx.shape), py.reshape(gx.shape)
    worst = 0.0
    for fx, fy in ((0.5, 0.5), (0.5, 0.0), (0.0, 0.5), (0.25, 0.75), (0.75, 0.25)):
        mx, my = exact((gx[:-1, :-1] + fx * step).ravel(), (gy[:-1, :-1] + fy * step).ravel())
        w = ((1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy)
        at = lambda p: w[0] * p[:-1, :-1] + w[1] * p[:-1, 1:] + w[2] * p[1:, :-1] + w[3] * p[1:, 1:]
        worst = max(worst, float(np.hypot(at(px).ravel() - mx, at(py).ravel() - my).max()))
    return px, py, worst


def control_points(spark, mappers: dict[int, Mapper], target: Mapper, width: int, height: int, bound: float = 0.02, step: int = 64) -> DataFrame:
    """(frame, step, cx, cy, p00, p10, p01, p11 and q alike): each cell of every frame's net with its corners' places, error below ``bound`` pixels.

    Nets are made frame by frame from a row a frame; a net of more than MOST_POINTS, as a map that can't be interpolated needs, is an error.
    """
    out = None
    schema = "frame long, step int, cx long, cy long, " + ", ".join(f"{n}{k} double" for n in "pq" for k in ("00", "10", "01", "11"))
    for frame, own in sorted(mappers.items()):
        size = step
        while True:
            if (width // size + 2) * (height // size + 2) > MOST_POINTS:
                raise ValueError(f"the map of frame {frame} can't be interpolated to {bound} pixels")
            px, py, worst = net(own, target, width, height, size)
            if worst <= bound or size == 1:
                break
            size //= 2
        cy, cx = (c.ravel() for c in np.mgrid[0 : px.shape[0] - 1, 0 : px.shape[1] - 1])
        corner = [p[cy + j, cx + i] for p in (px, py) for j, i in ((0, 0), (0, 1), (1, 0), (1, 1))]
        names = [f"{n}{k}" for n in "pq" for k in ("00", "10", "01", "11")]
        rows = spark.createDataFrame(pd.DataFrame({"frame": frame, "step": size, "cx": cx, "cy": cy, **dict(zip(names, corner))}), schema)
        out = rows if out is None else out.unionByName(rows)
    return out


def places(cells: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, id, px, py) of every pixel of the target grid, id = y * width + x: a cell's pixels, interpolated between its corners, to 1e-5 pixels, so that a grid on itself is
    at its own pixels."""
    span = F.explode(F.sequence(F.lit(0), F.col("step") - 1))
    each = cells.withColumn("i", span).withColumn("j", span)
    x, y = F.col("cx") * F.col("step") + F.col("i"), F.col("cy") * F.col("step") + F.col("j")
    fx, fy = F.col("i") / F.col("step"), F.col("j") / F.col("step")
    at = lambda n: (1 - fy) * ((1 - fx) * F.col(f"{n}00") + fx * F.col(f"{n}10")) + fy * ((1 - fx) * F.col(f"{n}01") + fx * F.col(f"{n}11"))
    return each.filter((x < width) & (y < height)).select("frame", (y * width + x).alias("id"), F.round(at("p"), 5).alias("px"), F.round(at("q"), 5).alias("py"))


def reproject(df: DataFrame, mappers: dict[int, Mapper], target: Mapper, width: int, height: int, bound: float = 0.02) -> DataFrame:
    """Frames (frame, x, y, v) on the target's grid: each pixel takes the bilinear value at its place in the frame; beyond the frame there is none."""
    points = places(control_points(df.sparkSession, mappers, target, width, height, bound), width, height)
    got = raster.resample(df, points).filter(finite(F.col("v")))
    return got.select("frame", (F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"), "v")


def equalised(df: DataFrame) -> DataFrame:
    """Each frame's finite samples (frame, x, y, v) by their share of its histogram of 256 bins, 0 to 1; a row a frame and bin is joined back."""
    ok = df.filter(finite(F.col("v")))
    span = ok.groupBy("frame").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    cdf = series.equalise(stats.histogram(ok, ["frame"]), ["frame"])
    unit = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    binned = ok.join(span, "frame").withColumn("bin", F.floor(unit * 255).cast("int"))
    return binned.join(cdf, ["frame", "bin"]).select("frame", "x", "y", F.col("cdf").alias("v"))


def composed(
    df: DataFrame, mappers: dict[int, Mapper], target: Mapper, width: int, height: int, weights: DataFrame, *, stretch: s.Stretch | None = None,
    overlay: int | None = None, opacity: float = 0.5, tint: tuple[float, float, float] = (1.0, 1.0, 1.0), bound: float = 0.02,
) -> DataFrame:
    """Bytes (x, y, r, g, b) of frames of different grids: brought to the target's, stretched alike or, without a stretch, equalised, mixed by weights (frame, wr, wg, wb), and one
    frame, if named, screened over the mix by its opacity and tint."""
    on = reproject(df, mappers, target, width, height, bound)
    peak = on.groupBy("frame").agg(F.max("v").alias("peak")).filter("peak > 0")
    even = equalised(on) if stretch is None else on.join(peak, "frame").select("frame", "x", "y", s.clamp01(s.stretch(F.col("v") / F.col("peak"), stretch)).alias("v"))
    base = even if overlay is None else even.filter(F.col("frame") != overlay)
    mixed = compose.weighted_mix(base, weights)
    if overlay is not None:
        layer = even.filter(F.col("frame") == overlay).select("x", "y", F.col("v").alias("layer"))
        mixed = mixed.join(layer, ["x", "y"], "left")
        over = lambda c, t: s.screen(F.col(c), F.coalesce("layer", F.lit(0.0)), opacity, t)
        mixed = mixed.select("x", "y", *[over(c, t).alias(c) for c, t in zip("rgb", tint)])
    return mixed.select("x", "y", *[s.to_byte(s.clamp01(F.col(c)), True).alias(c) for c in "rgb"])
