"""Editing: sharpening, curves, healing, cropping and turning of pixel tables, and cleaning of colour specks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.scalars import clamp01
from lumenweave.operators.raster import blur, label_components, shifted, tile_map
from lumenweave.session import settled


def sharpen(df: DataFrame, amount: float = 0.5, sigma: float = 1.0, size: int = 64) -> DataFrame:
    """v + amount * (v - its blur), within 0..1."""
    return df.join(blur(df, sigma, size), ["frame", "x", "y"]).select("frame", "x", "y", clamp01(F.col("v") + amount * (F.col("v") - F.col("blurred"))).alias("v"))


def curve_table(points: list[tuple[float, float]], n: int = 256) -> list[float]:
    """``n`` samples over 0..1 of a monotone cubic through the points: slopes are harmonic means, and 0 where the run turns."""
    x, y = (np.array(c, dtype=float) for c in zip(*sorted(points)))
    if len(x) == 1:
        return [float(y[0])] * n
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    m[0], m[-1] = d[0], d[-1]
    for k in range(1, len(x) - 1):
        if d[k - 1] * d[k] > 0:
            a, b = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            m[k] = (a + b) / (a / d[k - 1] + b / d[k])
    at = np.linspace(0, 1, n)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    t = np.clip((at - x[k]) / h[k], 0, 1)
    out = (2 * t**3 - 3 * t**2 + 1) * y[k] + (t**3 - 2 * t**2 + t) * h[k] * m[k] + (-2 * t**3 + 3 * t**2) * y[k + 1] + (t**3 - t**2) * h[k] * m[k + 1]
    return np.clip(out, 0, 1).tolist()


def curve(v: Column, points: list[tuple[float, float]]) -> Column:
    """A value of 0..1 through the curve's table of 256 entries."""
    return F.element_at(F.array(*[F.lit(x) for x in curve_table(points)]), (F.floor(clamp01(v) * 255 + 0.5) + 1).cast("int"))


def heal(df: DataFrame, x: float, y: float, radius: float, from_x: float, from_y: float) -> DataFrame:
    """A disc replaced by the one around another place, shifted to the mean of its rim, with a soft edge of a fifth of the radius."""
    r = F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    dx, dy = round(from_x - x), round(from_y - y)
    source = df.select("frame", (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("v").alias("s"))
    j = df.join(source, ["frame", "x", "y"], "left").withColumn("r", r)
    rim = j.filter((F.col("r") > radius) & (F.col("r") <= radius + 2)).groupBy("frame").agg(F.avg(F.col("v") - F.col("s")).alias("shift"))
    w = F.when(F.col("r") <= 0.8 * radius, 1.0).when(F.col("r") <= radius, (radius - F.col("r")) / (0.2 * radius)).otherwise(0.0)
    healed = F.col("v") + w * (F.col("s") + F.coalesce("shift", F.lit(0.0)) - F.col("v"))
    return j.join(F.broadcast(rim), "frame", "left").select("frame", "x", "y", F.when(F.col("s").isNotNull() & (w > 0), healed).otherwise(F.col("v")).alias("v"))


def crop(df: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The pixels of [x0, x1) x [y0, y1), moved to the origin."""
    inside = df.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def turn(df: DataFrame, width: int, height: int, how: str) -> DataFrame:
    """flip-x, flip-y, clockwise, counter or half."""
    x, y = F.col("x"), F.col("y")
    nx, ny = {
        "flip-x": (width - 1 - x, y), "flip-y": (x, height - 1 - y), "clockwise": (height - 1 - y, x),
        "counter": (y, width - 1 - x), "half": (width - 1 - x, height - 1 - y),
    }[how]
    return df.select(*[c for c in df.columns if c not in ("x", "y")], nx.alias("x"), ny.alias("y"))


# --- specks of composed colour --------------------------------------------------------------------


@dataclass(frozen=True)
class Specks:
    """What counts as a speck, in levels of 0..255: fixed values of the cleaning's defaults."""

    most: int = 25  # pixels of a speck
    ratio: float = 2.5  # of the strongest channel to the next
    delta: int = 60
    strong: int = 96
    excess: int = 40  # over the channel's median of 5 x 5, of one of its pixels at least
    ring: int = 2
    dark: int = 64  # a dropout's brightest channel at most
    deficit: int = 50  # below the medians of all channels


def local_medians(df: DataFrame, reach: int = 2, size: int = 64) -> DataFrame:
    """Upper medians (mr, mg, mb) of each channel in the window around a pixel, as far as it lies in the raster."""

    def kernel(p):
        out = {}
        for c in "rgb":
            s = np.sort(shifted(p[c], reach), axis=0)  # what is missing comes last
            out[f"m{c}"] = np.take_along_axis(s, (np.isfinite(s).sum(axis=0) // 2)[None], axis=0)[0]
        return out

    return tile_map(df, kernel, {f"m{c}": "double" for c in "rgb"}, size, reach, tuple("rgb"))


def clean_specks(df: DataFrame, settings: Specks = Specks(), size: int = 64) -> DataFrame:
    """Levels (frame, x, y, r, g, b, and ``repaired``) with small specks of one colour and dark dropouts replaced by the medians around them.

    A pixel is a candidate of a channel that dominates the others, or of the dark kind where all are far below the local medians. Components of a kind of up to ``most`` pixels, one of
    which stands out of its surroundings, get the upper median of each channel over their box and ``ring`` pixels around it, candidates left out. Components
    are whole whatever tiles they cross, so their size decides and not the tile's.
    """
    s, c = settings, F.col
    rows = df.select("frame", "x", "y", "r", "g", "b").join(local_medians(df, 2, size), ["frame", "x", "y"])
    kind = F.lit(None).cast("int")
    out = F.lit(False)
    for k, (a, p, q) in enumerate((("r", "g", "b"), ("g", "r", "b"), ("b", "r", "g"))):
        second = F.greatest(p, q)
        strong = (c(a) > c(p) if k else c(a) >= c(p)) & (c(a) > c(q) if k == 2 else c(a) >= c(q))
        hit = strong & (c(a) >= s.strong) & (c(a) - second >= s.delta) & (c(a) >= s.ratio * second)
        kind, out = F.when(hit, k).otherwise(kind), F.when(hit, c(a) >= c(f"m{a}") + s.excess).otherwise(out)
    hole = (F.greatest("r", "g", "b") <= s.dark) & (c("mr") - c("r") >= s.deficit) & (c("mg") - c("g") >= s.deficit) & (c("mb") - c("b") >= s.deficit)
    rows = rows.withColumns({"kind": F.coalesce(kind, F.when(hole, 3)), "out": F.when(kind.isNotNull(), out).otherwise(hole)})
    rows = settled(rows, "speck-candidates")
    marked = rows.filter("kind IS NOT NULL")
    labels = label_components(marked.select((c("frame") * 4 + c("kind")).alias("frame"), "x", "y"), size)  # kinds don't grow together
    labels = labels.select(F.floor(c("frame") / 4).alias("frame"), (c("frame") % 4).cast("int").alias("kind"), "x", "y", "label")
    members = settled(marked.join(labels, ["frame", "kind", "x", "y"]).select("frame", "kind", "label", "x", "y", "out"), "specks")
    box = {f"{n}{a}": f(a) for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))}
    small = members.groupBy("frame", "kind", "label").agg(F.count("*").alias("area"), F.max("out").alias("out"), *[v.alias(k) for k, v in box.items()]).filter((c("area") <= s.most) & c("out"))
    span = lambda a: F.explode(F.sequence(c(f"lo{a}") - s.ring, c(f"hi{a}") + s.ring))
    around = small.select("frame", "kind", "label", span("x").alias("x"), "loy", "hiy").withColumn("y", span("y"))
    ring = around.join(rows.filter("kind IS NULL").select("frame", "x", "y", "r", "g", "b"), ["frame", "x", "y"])
    upper = lambda a: F.element_at(F.sort_array(F.collect_list(a)), (F.floor(F.count("*") / 2) + 1).cast("int"))  # noqa: E731  a ring's size is bounded by the speck's
    fill = ring.groupBy("frame", "kind", "label").agg(*[upper(a).alias(f"f{a}") for a in "rgb"])
    fixed = members.join(fill, ["frame", "kind", "label"]).select("frame", "x", "y", "fr", "fg", "fb")
    j = rows.select("frame", "x", "y", "r", "g", "b").join(fixed, ["frame", "x", "y"], "left")
    return j.select("frame", "x", "y", *[F.coalesce(f"f{a}", a).alias(a) for a in "rgb"], c("fr").isNotNull().alias("repaired"))
