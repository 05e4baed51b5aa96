"""Stars in polar bins: wings, rings, spikes and halos of M19, whitening of M21."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import polar
from lumenweave.plans.q_flow import _field
from lumenweave.plans.registry import query, r
from lumenweave.session import settled


def _drawn(spark, sf, profile, outer: float, fwhm: float):
    """The drawn field of all frames' catalogs, and its stars as sources with an id."""
    field, top = _field(spark, sf, profile)
    cell = lambda c: F.floor(F.col(c) / 32)
    src = top.select("frame", (F.col("frame") * 64 + cell("sx") * 8 + cell("sy")).alias("id"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.lit(outer).alias("outer"), F.lit(fwhm).alias("fwhm"), F.lit(fwhm).alias("core"))
    return field, settled(src, "drawn")


@query("m19_saturated_wings")
def m19_wings(spark, sf):
    """Moffat stars cut off at a level: the profile of the light beyond the plateau."""
    field, src = _drawn(spark, sf, lambda d: F.pow(1 + d / 3, -2.5), 8.0, 2.0)
    table = polar.polar_table(field.withColumn("v", F.least("v", F.lit(250.0))), src)
    got = polar.saturated_wings(table, src)
    return got.select("frame", "id", r("core", digits=1), "model", r("width", digits=1), r("amplitude", digits=1), "status", "reason")


@query("m19_diffraction_rings")
def m19_rings(spark, sf):
    """Stars with a ring of light five pixels out."""
    field, src = _drawn(spark, sf, lambda d: F.exp(-d / 3) + 0.2 * F.exp(-F.pow(F.sqrt(d) - 5.5, 2) / 0.8), 9.0, 3.0)
    return polar.diffraction_rings(polar.polar_table(field, src)).select("frame", "id", "ring", r("excess", digits=2), r("share", digits=3))


@query("m19_spikes")
def m19_spikes(spark, sf):
    """Stars with two lines of light through each, turned by eleven degrees a frame."""
    turn = F.radians(11.0 * F.col("frame") + 7)
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    line = lambda off: F.exp(-off * off / 0.9)
    arms = line(dx * F.sin(turn) - dy * F.cos(turn)) + line(dx * F.cos(turn) + dy * F.sin(turn))
    field, src = _drawn(spark, sf, lambda d: F.exp(-d / 2) + F.when(d < 100, 0.25 * arms).otherwise(0.0), 10.0, 2.0)
    return polar.spikes(polar.polar_table(field, src, 36), src, 36).select("frame", "id", "angle", "length", r("score", digits=1))


@query("m19_halos")
def m19_halos(spark, sf):
    """Stars with faint light around them."""
    field, src = _drawn(spark, sf, lambda d: F.exp(-d / 2) + 0.05 * F.exp(-F.sqrt(d) / 2), 9.0, 2.0)
    return polar.halos(polar.polar_table(field, src), src).select("frame", "id", "reach", r("light", digits=1))


@query("m21_annulus_whitening")
def m21_annulus(spark, sf):
    """Red stars over a bluish sky, drawn to neutral over what their annuli show."""
    field, src = _drawn(spark, sf, lambda d: F.exp(-d / 4), 6.0, 3.0)
    light = (F.col("v") - 100) / 1000
    rgb = field.select("frame", "x", "y", (0.1 + light).alias("r"), (0.1 + 0.6 * light).alias("g"), (0.2 + 0.3 * light).alias("b"))
    got = polar.whitened(rgb, src.withColumn("radius", F.col("outer")))
    return got.select("frame", "x", "y", *[r(c, digits=4) for c in "rgb"])
