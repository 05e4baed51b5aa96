"""Stars in polar bins: wings of saturated stars, diffraction rings, spikes at any angle, and colours drawn to neutral over measured backgrounds.

Pixels meet the stars whose reach they lie in by an equi join on the pixel. A star's samples, whose number its radius bounds, become a row a ring and sector, and
all later steps work on these rows, whatever the raster's size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.session import settled

FROM, TO = 1.35, 1.9  # of a star's outer radius: the annulus of its background


MOST_OUTER = 64.0  # pixels: a star's samples are one group, of less than 12 times its square


def _around(df: DataFrame, sources: DataFrame, columns: list[str]) -> DataFrame:
    """Pixels with each source (frame, id, x, y, outer) whose annulus reaches them: frame, id, outer, x, y, dx, dy, dist and the columns."""
    reach = F.least(F.col("outer"), F.lit(MOST_OUTER)) * TO
    span = lambda c: F.explode(F.sequence(F.ceil(F.col(c) - reach).cast("long"), F.floor(F.col(c) + reach).cast("long")))
    s = sources.select("frame", "id", F.col("x").alias("sx"), F.col("y").alias("sy"), "outer", span("x").alias("x"), "y").withColumn("y", span("y"))
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    near = s.select("frame", "id", "x", "y", F.least("outer", F.lit(MOST_OUTER)).alias("outer"), dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("dist"))
    return near.filter(F.col("dist") <= TO * F.col("outer")).join(df.select("frame", "x", "y", *columns), ["frame", "x", "y"])


def background_plane(dx: np.ndarray, dy: np.ndarray, v: np.ndarray, clips: int = 2) -> tuple[float, float, float, float]:
    """(base, gx, gy, noise) of an annulus' samples: their median, slopes about it, and robust deviation; NaN where there are none.

    Samples beyond three deviations of the median go ``clips`` times: neighbours and knots are few of an annulus.
    """
    ok = np.isfinite(v)
    dx, dy, v = dx[ok], dy[ok], v[ok]
    if not len(v):
        return (math.nan,) * 4
    for k in range(clips + 1):
        m = np.median(v)
        s = 1.4826 * np.median(np.abs(v - m))
        keep = np.abs(v - m) <= 3 * s
        if k < clips and s > 0:
            dx, dy, v = dx[keep], dy[keep], v[keep]
    slope = lambda d: float((d * (v - m)).sum() / max((d * d).sum(), 1e-300))
    return float(m), slope(dx), slope(dy), max(float(s), 1e-12)


def polar_table(df: DataFrame, sources: DataFrame, sectors: int = 16) -> DataFrame:
    """(frame, id, ring, sector, n, level, noise): medians of the samples less the star's background plane, in rings of a pixel and equal sectors from angle 0.

    A group is one star's samples within TO of its outer radius; stars whose annulus has no sample are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dx, dy, dist, v = (pdf[c].to_numpy(float) for c in ("dx", "dy", "dist", "v"))
        outer = float(pdf["outer"].iloc[0])
        ring = dist >= FROM * outer
        base, gx, gy, noise = background_plane(dx[ring], dy[ring], v[ring])
        own = (dist < outer) & np.isfinite(v) & math.isfinite(base)
        sector = np.minimum(np.floor(np.mod(np.arctan2(dy[own], dx[own]) / (2 * math.pi), 1.0) * sectors), sectors - 1)
        bins = pd.DataFrame({"ring": np.floor(dist[own]).astype(np.int32), "sector": sector.astype(np.int32), "level": v[own] - base - gx * dx[own] - gy * dy[own]})
        out = bins.groupby(["ring", "sector"], as_index=False)["level"].agg(n="count", level="median")
        return pd.DataFrame({"frame": pdf["frame"].iloc[0], "id": pdf["id"].iloc[0], "ring": out["ring"], "sector": out["sector"], "n": out["n"], "level": out["level"], "noise": noise})

    near = _around(df, sources, ["v"]).select("frame", "id", "outer", "dx", "dy", "dist", "v")
    return settled(near.groupBy("frame", "id").applyInPandas(run, "frame long, id long, ring int, sector int, n long, level double, noise double"), "polar")


def _grid(pdf: pd.DataFrame, sectors: int) -> np.ndarray:
    """A star's levels as rings x sectors, NaN where there is no sample."""
    g = np.full((int(pdf["ring"].max()) + 1, sectors), np.nan)
    g[pdf["ring"], pdf["sector"]] = pdf["level"]
    return g


def _median(g: np.ndarray) -> np.ndarray:
    """Medians of the rows' finite values; NaN for rows of under a quarter of them."""
    return np.array([np.median(r[np.isfinite(r)]) if np.isfinite(r).sum() * 4 >= len(r) else np.nan for r in g])


# --- wings ----------------------------------------------------------------------------------------

WING = "frame long, id long, core double, model string, width double, amplitude double, residual double, snr double, status string, reason string"
BETAS = (0.0, 1.5, 2.5, 4.0)  # 0 stands for a Gaussian


def _shape(r: np.ndarray, width: float, beta: float) -> np.ndarray:
    return np.exp(-(r * r) / (2 * width * width)) if beta == 0 else (1 + (r * r) / (width * width)) ** -beta


def _balance(off: np.ndarray) -> float:
    """The net direction of deviations by sector, as a share of their size: 0 where opposite sectors deviate alike, 1 where one side alone does."""
    angle = 2 * np.pi * (np.arange(off.shape[1]) + 0.5) / off.shape[1]
    size = np.abs(off).sum()
    return float(np.hypot((np.abs(off) * np.cos(angle)).sum(), (np.abs(off) * np.sin(angle)).sum()) / size) if size > 0 else 0.0


def wing_of(g: np.ndarray, fwhm: float, noise: float, limit: float = 0.35) -> tuple:
    """(core, model, width, amplitude, residual, snr, status, reason) of a saturated star's levels by ring and sector.

    The core is 0.9 FWHM, grown over rings that are as bright as the one inside them (a plateau of cut-off samples). Beyond it the median of a ring's sectors must
    fall clearly over five rings or more; the profile that fits best is taken. Of the sectors the quarter that deviates most doesn't count, if it is balanced around the
    star: spikes come in pairs, a neighbour doesn't.
    """
    r = np.arange(len(g)) + 0.5
    ring = _median(g)
    core = max(1.5, 0.9 * fwhm)
    first = int(np.ceil(core))
    while first + 1 < len(g) and ring[first] >= 0.93 * ring[first - 1]:
        first += 1
    core = max(core, float(first))
    bad = lambda why: (core, "", math.nan, math.nan, math.nan, 0.0, "rejected", why)
    use = np.flatnonzero((np.arange(len(g)) >= first) & np.isfinite(ring))
    if core >= 0.55 * len(g) or len(use) < 5:
        return bad("span")
    third = max(1, len(use) // 3)
    snr = float(ring[use[0]] / noise)
    if snr < 5 or ring[use[-third:]].mean() > 0.5 * ring[use[:third]].mean():
        return bad("decline")
    best = None
    weight = np.sqrt(r[use])  # an outer ring has more samples
    for beta in BETAS:
        for width in np.arange(0.6, 8.01, 0.1):
            t = _shape(r[use], width, beta)
            a = max(0.0, float((weight * t * ring[use]).sum() / (weight * t * t).sum()))
            error = float((weight * (ring[use] - a * t) ** 2).sum())
            if best is None or error < best[0]:
                best = (error, beta, width, a)
    _, beta, width, a = best
    fit = a * _shape(r[use], width, beta)
    quarter = g.shape[1] // 4
    for k in range(4):
        part = g[use][:, k * quarter : (k + 1) * quarter]
        share = np.nansum(part) / max(float((fit[:, None] * np.isfinite(part)).sum()), 1e-300)
        if not 0.4 <= share <= 2.5:
            return bad("one-sided")
    off = np.nan_to_num(g[use] - fit[:, None])
    size = np.abs(off).sum(axis=0)
    trimmed = np.isin(np.arange(g.shape[1]), np.argsort(size)[-quarter:])
    keep = ~trimmed if _balance(np.where(trimmed, off, 0.0)) <= limit else np.ones(g.shape[1], dtype=bool)
    residual = float(np.sqrt((off[:, keep] ** 2).mean()) / np.sqrt((fit**2).mean()))
    status = ("accepted", "") if residual <= 0.35 else ("rejected", "residual")
    return core, "gaussian" if beta == 0 else f"moffat-{beta}", float(width), float(a), residual, snr, *status


def saturated_wings(polar: DataFrame, sources: DataFrame, sectors: int = 16) -> DataFrame:
    """WING of each star (frame, id, fwhm) from its polar table; the missing core is not made up: the profile holds beyond ``core`` alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = wing_of(_grid(pdf, sectors), float(pdf["fwhm"].iloc[0]), float(pdf["noise"].iloc[0]))
        return pd.DataFrame([(int(pdf["frame"].iloc[0]), int(pdf["id"].iloc[0]), *got)], columns=[c.split()[0] for c in WING.split(", ")])

    rows = polar.join(sources.select("frame", "id", "fwhm"), ["frame", "id"])
    return rows.groupBy("frame", "id").applyInPandas(run, WING)


# --- diffraction rings ----------------------------------------------------------------------------


def diffraction_rings(polar: DataFrame, sectors: int = 16, prominent: float = 3.0, share: float = 0.75) -> DataFrame:
    """Bright rings of stars, (frame, id, ring, excess, share): where the ring's median over sectors stands ``prominent`` noises above the darkest ring between
    it and the brighter light inside, and as much above the next ring outside, in ``share`` of the sectors.

    Sectors give a ring's level by their median, so that spikes and neighbours don't make one. A ring next to two or more without samples is none.
    """
    keys = ["frame", "id"]
    star = Window.partitionBy(*keys).orderBy("ring")
    level = polar.groupBy(*keys, "ring").agg(F.median("level").alias("level"), F.first("noise").alias("noise"), F.count("*").alias("sectors")).filter(F.col("sectors") * 2 >= sectors)
    near = lambda k, c: F.when(F.abs((F.lag if k < 0 else F.lead)("ring", abs(k)).over(star) - F.col("ring")) <= abs(k) + 1, (F.lag if k < 0 else F.lead)(c, abs(k)).over(star))
    peaks = level.withColumns({"inside": near(-1, "level"), "outside": near(1, "level"), "gap": F.min("level").over(star.rowsBetween(-4, -1))})
    peaks = peaks.filter("inside IS NOT NULL AND outside IS NOT NULL AND level > inside AND level >= outside")
    # the gap is the darkest of the rings inside, and beyond it there is brighter light
    peaks = peaks.withColumn("excess", F.col("level") - F.col("gap")).filter(F.col("excess") > prominent * F.col("noise"))
    dark = polar.groupBy(*keys, "sector").agg(F.map_from_entries(F.collect_list(F.struct("ring", "level"))).alias("at"))
    beside = F.array(*[F.try_element_at("at", (F.col("ring") - k).cast("int")) for k in range(1, 5)])
    seen = peaks.join(dark, keys).withColumn("rise", F.try_element_at("at", F.col("ring")) - F.array_min(beside)).filter("rise IS NOT NULL")
    agree = seen.groupBy(*keys, "ring").agg(F.avg((F.col("rise") > 0.3 * F.col("excess")).cast("int")).alias("share"))
    return peaks.join(agree, [*keys, "ring"]).filter(F.col("share") >= share).select(*keys, "ring", "excess", "share")


# --- spikes ---------------------------------------------------------------------------------------


def spikes(polar: DataFrame, cores: DataFrame, sectors: int, beside: int = 2, k: float = 4.0, least: int = 5, paired: bool = True) -> DataFrame:
    """Diffraction spikes (frame, id, sector, angle in degrees, length, score) at whatever angle the pixels show them.

    A sector's contrast in a ring is its level less the greater of those ``beside`` sectors to both sides. A spike begins within three rings of the star's core (frame, id, core) and of the first ring with a pixel a sector, goes
    on over rings whose contrast is above ``k`` noises of a sector's sample (a ring may fail once), and is ``least`` rings long; its score, the mean contrast in
    noises, is the greatest among its neighbours. ``paired``: only those that have another on the star's other side, which a filament that ends at a star has not.
    """
    keys = ["frame", "id"]
    arms = polar.groupBy(*keys, "ring").agg(F.map_from_entries(F.collect_list(F.struct("sector", "level"))).alias("at"), F.first("noise").alias("noise"))
    side = lambda s, d: F.try_element_at("at", F.pmod(s + d, F.lit(sectors)).cast("int"))
    one = lambda s: F.struct(s.cast("int").alias("sector"), (side(s, 0) - F.greatest(side(s, beside), side(s, -beside))).alias("contrast"))
    rows = arms.select(*keys, "ring", "noise", F.explode(F.transform(F.sequence(F.lit(0), F.lit(sectors - 1)), one)).alias("c")).select(*keys, "ring", "noise", "c.*")
    rows = rows.join(cores.select(*keys, "core"), keys).filter("contrast IS NOT NULL AND ring >= core")
    rows = rows.withColumn("good", F.col("contrast") > k * F.col("noise"))
    out = Window.partitionBy(*keys, "sector").orderBy("ring")
    fails = F.sum((~F.col("good")).cast("int")).over(out)
    held = rows.withColumn("fails", fails).filter("fails <= 1 AND good")
    arm = held.groupBy(*keys, "sector").agg(F.min("ring").alias("begins"), (F.max("ring") - F.min("ring") + 1).alias("length"), F.avg(F.col("contrast") / F.col("noise")).alias("score"), F.first("core").alias("core"))
    arm = arm.filter((F.col("length") >= least) & (F.col("begins") <= F.greatest("core", F.lit(sectors / (2 * math.pi))) + 3))
    other = arm.select(*keys, F.col("sector").alias("o"), F.col("score").alias("os"))
    pairs = arm.join(other, keys)  # a star's arms, at most as many as sectors
    apart = F.pmod(F.col("o") - F.col("sector"), F.lit(sectors))
    close = (apart > 0) & ((apart <= beside) | (apart >= sectors - beside)) & ((F.col("os") > F.col("score")) | ((F.col("os") == F.col("score")) & (F.col("o") < F.col("sector"))))
    opposite = F.abs(apart - sectors / 2) <= max(1, sectors // 36)
    judged = pairs.groupBy(*keys, "sector", "length", "score").agg(F.max(close).alias("beaten"), F.max(opposite).alias("pair"))
    good = judged.filter(~F.col("beaten") & (F.col("pair") if paired else F.lit(True)))
    return good.select(*keys, "sector", ((F.col("sector") + 0.5) * 360.0 / sectors).alias("angle"), "length", "score")


# --- halos ----------------------------------------------------------------------------------------


def halos(polar: DataFrame, cores: DataFrame, k: float = 3.0) -> DataFrame:
    """Each star's extended halo (frame, id, reach, light): rings from its core (frame, id, core) on whose median over sectors is above ``k`` of a ring's error, up to the first that is not, and the
    sum of their light. A ring that is brighter than the one inside it by more than that ends the halo too: it belongs to something else."""
    keys = ["frame", "id"]
    star = Window.partitionBy(*keys).orderBy("ring")
    ring = polar.groupBy(*keys, "ring").agg(F.median("level").alias("level"), F.sum("n").alias("n"), F.first("noise").alias("noise"))
    error = 1.2533 * F.col("noise") / F.sqrt("n")
    rows = ring.join(cores.select(*keys, "core"), keys).filter("ring >= core").withColumn("error", error)
    rises = F.coalesce(F.col("level") > F.lag("level").over(star) + k * F.col("error"), F.lit(False))
    closed = F.sum(((F.col("level") <= k * F.col("error")) | rises).cast("int")).over(star)
    open_ = rows.withColumn("closed", closed).filter("closed = 0")
    got = open_.groupBy(*keys).agg((F.max("ring") + 1).alias("reach"), F.sum(F.col("level") * F.col("n")).alias("light"))
    return cores.select(*keys).join(got, keys, "left").select(*keys, F.coalesce("reach", F.lit(0)).alias("reach"), F.coalesce("light", F.lit(0.0)).alias("light"))


# --- neutral colours ------------------------------------------------------------------------------


def feather(t: Column) -> Column:
    """1 within 0.65 of the radius, a cosine to 0 beyond."""
    return F.when(t <= 0.65, 1.0).when(t <= 1, 0.5 + 0.5 * F.cos(F.lit(math.pi) * (t - 0.65) / 0.35)).otherwise(0.0)


def annulus_levels(df: DataFrame, sources: DataFrame, channels: str = "rgb") -> DataFrame:
    """Sources (frame, id, x, y, radius) with ``base_r`` and so on: the clipped median of each channel in the annulus around a star; a group is one star's annulus."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dx, dy = pdf["dx"].to_numpy(float), pdf["dy"].to_numpy(float)
        levels = [background_plane(dx, dy, pdf[c].to_numpy(float))[0] for c in channels]
        return pd.DataFrame([(pdf["frame"].iloc[0], pdf["id"].iloc[0], *levels)], columns=["frame", "id", *(f"base_{c}" for c in channels)])

    near = _around(df, sources.withColumn("outer", F.col("radius")), list(channels)).filter(F.col("dist") >= FROM * F.col("outer"))
    got = near.select("frame", "id", "dx", "dy", *channels).groupBy("frame", "id").applyInPandas(run, "frame long, id long, " + ", ".join(f"base_{c} double" for c in channels))
    return sources.join(got, ["frame", "id"])


def whitened(df: DataFrame, sources: DataFrame, amount: float = 1.0, passes: int = 2) -> DataFrame:
    """Colours (frame, x, y, r, g, b) near stars (frame, id, x, y, radius) drawn to neutral over the background that each star's annulus shows.

    A channel's excess over its base rises to the greatest of the three by the star's feather. Where stars overlap, each has a share by its feather. Every pass measures the
    backgrounds and what is left to do again, on what the one before it made; stars whose annulus has no sample stay.
    """
    for _ in range(passes):
        src = settled(annulus_levels(df, sources), "annuli")
        near = _around(df, src.withColumn("outer", F.col("radius") / TO), list("rgb")).withColumn("w", feather(F.col("dist") / (F.col("outer") * TO))).filter("w > 0")
        near = near.join(src.select("frame", "id", *[f"base_{c}" for c in "rgb"]), ["frame", "id"])
        ex = {c: F.greatest(F.lit(0.0), F.col(c) - F.col(f"base_{c}")) for c in "rgb"}
        top = F.greatest(*ex.values())
        moved = near.select("frame", "x", "y", "w", *[(F.col("w") * F.col("w") * amount * (top - ex[c])).alias(c) for c in "rgb"])
        add = moved.groupBy("frame", "x", "y").agg(*[(F.sum(c) / F.sum("w")).alias(f"d{c}") for c in "rgb"])
        j = df.join(add, ["frame", "x", "y"], "left")
        df = settled(j.select("frame", "x", "y", *[(F.col(c) + F.coalesce(F.col(f"d{c}"), F.lit(0.0))).alias(c) for c in "rgb"]), "whitened")
    return df
