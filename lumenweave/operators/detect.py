"""Star extraction, star maps and treatments: blobs by tile, profile fits, verification, gentler and neutral stars."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.scalars import finite
from lumenweave.operators import near
from lumenweave.operators.graph import connected
from lumenweave.operators.joins import radius_join
from lumenweave.operators.raster import blur_grid, haloed_tiles
from lumenweave.session import settled

STAR = "frame long, x double, y double, flux double, peak double, area long"


def blobs(mask: np.ndarray) -> list[np.ndarray]:
    """8-neighbour components of a mask, each as an array of (row, column)."""
    seen, out = np.zeros(mask.shape, dtype=bool), []
    for start in map(tuple, np.argwhere(mask)):
        if seen[start]:
            continue
        seen[start], todo, own = True, [start], []
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    k = (y + i, x + j)
                    if 0 <= k[0] < mask.shape[0] and 0 <= k[1] < mask.shape[1] and mask[k] and not seen[k]:
                        seen[k] = True
                        todo.append(k)
        out.append(np.array(own))
    return out


def stars_of_grid(g: np.ndarray, bg: float, sigma: float, k: float = 5.0, least: int = 5, most: int = 400) -> list[tuple]:
    """(x, y, flux, peak, area) of the stars of a grid.

    Blobs of the blurred grid above bg + k sigma go when they are small, large, long (aspect above 2), a
    single hot pixel (peak / flux above 0.35), sharper than the blur allows (below 0.25) or faint (below 6 sigma).
    """
    smooth = blur_grid(g, 1.5)
    out = []
    for b in blobs(np.nan_to_num(smooth, nan=-np.inf) > bg + k * sigma):
        if not max(least, 5) <= len(b) <= most:
            continue
        (h, w) = b.max(axis=0) - b.min(axis=0) + 1
        if max(h, w) // max(1, min(h, w)) > 2:
            continue
        v = np.nan_to_num(g[b[:, 0], b[:, 1]] - bg)
        flux, top = v.sum(), int(v.argmax())
        if flux <= 0 or v[top] / flux > 0.35 or v[top] < 6 * sigma:
            continue
        if (smooth[tuple(b[top])] - bg) / v[top] < 0.25:
            continue
        r = math.sqrt(len(b) / math.pi) + 1.5
        y0, x0 = (b * np.maximum(v, 0)[:, None]).sum(axis=0) / np.maximum(v, 0).sum()
        yy, xx = np.mgrid[max(0, int(y0 - r)) : int(y0 + r) + 2, max(0, int(x0 - r)) : int(x0 + r) + 2]
        ok = (yy < g.shape[0]) & (xx < g.shape[1])
        yy, xx = yy[ok], xx[ok]
        near = (yy - y0) ** 2 + (xx - x0) ** 2 <= r * r
        weight = np.maximum(np.nan_to_num(g[yy[near], xx[near]] - bg), 0)
        if weight.sum() > 0:
            y0, x0 = (yy[near] * weight).sum() / weight.sum(), (xx[near] * weight).sum() / weight.sum()
        out.append((x0, y0, float(flux), float(v[top]), len(b)))
    return out


def extract_stars(df: DataFrame, levels: DataFrame, size: int = 256, halo: int = 24, k: float = 5.0) -> DataFrame:
    """Stars of each frame (STAR), tile by tile; a star belongs to the tile its centre lies in, so none comes twice.

    ``levels``: bg and sigma of each frame. The halo must hold a star of the largest allowed area.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty, frame = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0]), int(pdf["frame"].iloc[0])
        left, top, side = tx * size - halo, ty * size - halo, size + 2 * halo
        g = np.full((side, side), np.nan)
        g[pdf["y"] - top, pdf["x"] - left] = pdf["v"]
        rows = [
            (frame, x + left, y + top, f, p, a)
            for x, y, f, p, a in stars_of_grid(g, pdf["bg"].iloc[0], pdf["sigma"].iloc[0], k)
            if halo <= x < halo + size and halo <= y < halo + size
        ]
        return pd.DataFrame(rows, columns=["frame", "x", "y", "flux", "peak", "area"])

    tiles = haloed_tiles(df.select("frame", "x", "y", "v"), size, halo).join(F.broadcast(levels.select("frame", "bg", "sigma")), "frame")
    return tiles.groupBy("frame", "tx", "ty").applyInPandas(run, STAR)


def fit_moffat(v: np.ndarray, beta: float = 2.5, least: int = 45) -> tuple[float, float, float, float] | None:
    """(amplitude, background, FWHM, relative residual) of a centred square stamp, or None where it has too few samples.

    FWHM is scanned; for each, amplitude and a sloping background are linear least squares, the amplitude not negative.
    """
    n = v.shape[0] // 2
    y, x = np.mgrid[-n : n + 1, -n : n + 1]
    ok = np.isfinite(v)
    quadrants = [((y >= 0) == a) & ((x >= 0) == b) & ok for a in (False, True) for b in (False, True)]
    if ok.sum() < least or min(q.sum() for q in quadrants) < 5:
        return None
    best = None
    for fwhm in np.arange(1.2, 8.01, 0.2):
        alpha = fwhm / (2 * math.sqrt(2 ** (1 / beta) - 1))
        t = (1 + (x * x + y * y) / (alpha * alpha)) ** -beta
        a = np.column_stack([t[ok], np.ones(ok.sum()), x[ok], y[ok]])
        c = np.linalg.lstsq(a, v[ok], rcond=None)[0]
        c[0] = max(0.0, c[0])
        error = float(((v[ok] - a @ c) ** 2).sum())
        if best is None or error < best[0]:
            best = (error, c, fwhm)
    error, c, fwhm = best
    amplitude = float(c[0])
    return amplitude, float(c[1]), float(fwhm), math.sqrt(error / ok.sum()) / amplitude if amplitude > 0 else math.inf


def star_map(df: DataFrame, stars: DataFrame, noise: DataFrame, reach: int = 6) -> DataFrame:
    """Each star with its profile fit and status: accepted from an SNR of 7, a FWHM of 1.5 to 5.2 and a residual up to 0.22.

    A group is one star's stamp.
    """
    at = stars.select("frame", F.monotonically_increasing_id().alias("id"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    at = at.withColumns({"cx": F.round("sx").cast("long"), "cy": F.round("sy").cast("long")})
    span = F.sequence(F.lit(-reach), F.lit(reach))
    stamp = at.withColumn("i", F.explode(span)).withColumn("j", F.explode(span)).withColumns({"x": F.col("cx") + F.col("i"), "y": F.col("cy") + F.col("j")})
    px = stamp.join(df.select("frame", "x", "y", "v"), ["frame", "x", "y"], "left").join(F.broadcast(noise.select("frame", "sigma")), "frame")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.full((2 * reach + 1, 2 * reach + 1), np.nan)
        g[pdf["j"] + reach, pdf["i"] + reach] = pdf["v"]
        sigma = float(pdf["sigma"].iloc[0])
        got = fit_moffat(g)
        amplitude, base, fwhm, residual = got or (0.0, math.nan, math.nan, math.inf)
        snr = amplitude / sigma if sigma > 0 else 0.0
        good = got is not None and snr >= 7 and 1.5 <= fwhm <= 5.2 and residual <= 0.22
        radius = min(16.0, max(3.0, 1.6 * fwhm)) if got else 3.0
        return pd.DataFrame(
            [(int(pdf["frame"].iloc[0]), int(pdf["id"].iloc[0]), pdf["sx"].iloc[0], pdf["sy"].iloc[0], amplitude, base, fwhm, residual, snr, radius, "accepted" if good else "uncertain")],
            columns=["frame", "id", "x", "y", "amplitude", "base", "fwhm", "residual", "snr", "radius", "status"],
        )

    return px.groupBy("frame", "id").applyInPandas(
        run, "frame long, id long, x double, y double, amplitude double, base double, fwhm double, residual double, snr double, radius double, status string"
    )


RINGS = range(2, 15)  # of half a pixel, from 1 to 7.5 pixels around a source
LEAST_SOURCES = 5  # that a field's profile is taken from


def ring_profiles(df: DataFrame, sources: DataFrame) -> DataFrame:
    """(frame, id, ring, n, level) of sources (frame, id, x, y, amplitude): the median of the samples at each distance, over the source's own background and amplitude.

    The background is the median of the samples 8 to 11 pixels away. A group is one source's ring.
    """
    near = _within_reach(df.select("frame", "x", "y", "v").filter(finite(F.col("v"))), sources.select("frame", "id", "x", "y", "amplitude", F.lit(11.0).alias("radius")))
    rows = near.select("frame", F.col("r_id").alias("id"), F.col("r_amplitude").alias("amplitude"), "v", "dist")
    base = rows.filter("dist >= 8").groupBy("frame", "id").agg(F.median("v").alias("base"))
    ring = F.floor(2 * F.col("dist")).cast("int")
    inner = rows.withColumn("ring", ring).filter(F.col("ring").between(RINGS[0], RINGS[-1])).join(base, ["frame", "id"])
    return inner.groupBy("frame", "id", "ring").agg(F.count("*").alias("n"), F.median((F.col("v") - F.col("base")) / F.col("amplitude")).alias("level"))


def field_profiles(rings: DataFrame) -> DataFrame:
    """``rings`` (frame, id, ring, level, ...) with ``field``: the median of the levels of the frame's other sources in that ring, not below 0; null with fewer than LEAST_SOURCES.

    A source's own level is left out by its rank: of the values around the middle only which ones count changes.
    """
    w = Window.partitionBy("frame", "ring")
    ranked = settled(rings.withColumns({"rank": F.row_number().over(w.orderBy("level", "id")) - 1, "of": F.count("*").over(w)}), "rings")
    low = F.floor((F.col("of") - 2) / 2).cast("int")  # places of the middle among the others
    middle = ranked.filter(F.col("rank").between(low, low + 2)).groupBy("frame", "ring").agg(F.map_from_entries(F.collect_list(F.struct("rank", "level"))).alias("at"))
    high = F.floor((F.col("of") - 1) / 2).cast("int")
    pick = lambda k: F.try_element_at("at", F.when(k < F.col("rank"), k).otherwise(k + 1).cast("int"))
    value = F.greatest(F.lit(0.0), (pick(low) + pick(high)) / 2)
    got = ranked.join(middle, ["frame", "ring"]).withColumn("field", F.when(F.col("of") > LEAST_SOURCES, value))
    return got.drop("rank", "of", "at")


def field_tested(df: DataFrame, mapped: DataFrame, narrow: float = 0.55, wide: float = 1.65, differs: float = 0.65) -> DataFrame:
    """A star map (``star_map``) with ``reason``, and accepted sources made uncertain that don't look like their frame's stars.

    ``width``: the FWHM lies beyond ``narrow`` or ``wide`` of the frame's median. ``wings``: the root of the squared differences of the rings' levels to those of the frame's other
    accepted sources, over the squared levels, is above ``differs``. Rings of one sample don't count, frames of too few sources are not tested.
    """
    ok = mapped.filter("status = 'accepted'")
    widths = ok.groupBy("frame").agg(F.median("fwhm").alias("usual"), F.count("*").alias("of"))
    rings = field_profiles(ring_profiles(df, ok.select("frame", "id", "x", "y", "amplitude")))
    off = F.sum((F.col("level") - F.col("field")) ** 2) / F.sum(F.col("level") ** 2)
    wings = rings.filter("n >= 2 AND field IS NOT NULL").groupBy("frame", "id").agg(F.sqrt(off).alias("difference"))
    j = mapped.join(widths, "frame", "left").join(wings, ["frame", "id"], "left")
    unlike = (F.col("of") > LEAST_SOURCES) & ~F.col("fwhm").between(narrow * F.col("usual"), wide * F.col("usual"))
    reason = F.when(F.col("status") != "accepted", "fit").when(unlike, "width").when(F.col("difference") > differs, "wings")
    tested = j.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "accepted").otherwise("uncertain"))
    return tested.select(*mapped.columns, "reason", "difference")


def verify(sources: DataFrame, evidence: DataFrame, radius: float = 2.0, least: int = 2) -> DataFrame:
    """Sources confirmed by detections in at least ``least`` different original exposures."""
    near = radius_join(sources.select("id", "x", "y"), evidence.select("x", "y", "exposure"), radius)
    n = near.groupBy("id").agg(F.countDistinct("r_exposure").alias("confirmations"))
    return sources.join(n, "id", "left").withColumn("confirmations", F.coalesce("confirmations", F.lit(0))).withColumn("confirmed", F.col("confirmations") >= least)


def _within_reach(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Pixels with each source whose radius reaches them: df's columns, the source's prefixed r_, and dist. Sources go to the pixels of their box."""
    span = lambda c: F.sequence(F.ceil(F.col(c) - F.col("radius")).cast("long"), F.floor(F.col(c) + F.col("radius")).cast("long"))
    s = sources.select("frame", F.explode(span("x")).alias("__x"), *[F.col(c).alias(f"r_{c}") for c in sources.columns if c != "frame"], "y", "radius")
    s = s.withColumn("__y", F.explode(span("y"))).drop("y", "radius")
    j = df.join(s, (df["frame"] == s["frame"]) & (df["x"] == s["__x"]) & (df["y"] == s["__y"])).drop(s["frame"]).drop("__x", "__y")
    dist = F.sqrt((F.col("x") - F.col("r_x")) ** 2 + (F.col("y") - F.col("r_y")) ** 2)
    return j.withColumn("dist", dist).filter(F.col("dist") <= F.col("r_radius"))


def gentler(df: DataFrame, sources: DataFrame, strength: float = 0.5) -> DataFrame:
    """Pixels (frame, x, y, v of 0..1) less the greatest of their stars' corrections: w * (E - E / (1 + 4 * strength * E)).

    E is the excess over a source's base, w its feather: 1 within 0.65 of the radius, a cosine to 0 beyond.
    """
    src = sources.select("frame", "x", "y", "radius", "base")
    near = _within_reach(df.select("frame", "x", "y", "v"), src)
    t = F.col("dist") / F.col("r_radius")
    w = F.when(t <= 0.65, 1.0).when(t <= 1, 0.5 + 0.5 * F.cos(F.lit(math.pi) * (t - 0.65) / 0.35)).otherwise(0.0)
    e = F.greatest(F.lit(0.0), F.col("v") - F.col("r_base"))
    c = near.withColumn("c", w * (e - e / (1 + 4 * strength * e))).groupBy("frame", "x", "y").agg(F.max("c").alias("c"))
    return df.join(c, ["frame", "x", "y"], "left").withColumn("v", F.col("v") - F.coalesce("c", F.lit(0.0))).drop("c")


def whiten(df: DataFrame, sources: DataFrame, amount: float = 1.0, luma: bool = False) -> DataFrame:
    """Colours (frame, x, y, r, g, b) near a star moved towards neutral by its feather: each channel's excess to the greatest, or to their luma."""
    near = _within_reach(df, sources.select("frame", "x", "y", "radius", "base_r", "base_g", "base_b"))
    t = F.col("dist") / F.col("r_radius")
    w = F.when(t <= 0.65, 1.0).when(t <= 1, 0.5 + 0.5 * F.cos(F.lit(math.pi) * (t - 0.65) / 0.35)).otherwise(0.0)
    ex = {c: F.greatest(F.lit(0.0), F.col(c) - F.col(f"r_base_{c}")) for c in "rgb"}
    neutral = 0.2126 * ex["r"] + 0.7152 * ex["g"] + 0.0722 * ex["b"] if luma else F.greatest(*ex.values())
    best = near.withColumn("w", w).filter("w > 0").groupBy("frame", "x", "y").agg(
        F.max_by(F.struct(*[(F.col("w") * amount * (neutral - ex[c])).alias(c) for c in "rgb"]), "w").alias("d")
    )
    j = df.join(best, ["frame", "x", "y"], "left")
    return j.select("frame", "x", "y", *[(F.col(c) + F.coalesce(F.col(f"d.{c}"), F.lit(0.0))).alias(c) for c in "rgb"])


def match_psf(df: DataFrame, own: float, target: float, saturated: float, size: int = 64) -> DataFrame:
    """Blur frames of one FWHM to a wider one by the difference of variances; saturated pixels stay as they are."""
    from lumenweave.operators.raster import blur

    extra = math.sqrt(max(0.0, target * target - own * own)) / 2.3548
    if extra <= 0.05:
        return df.select("frame", "x", "y", "v")
    wide = blur(df, extra, size)
    return df.join(wide, ["frame", "x", "y"]).select("frame", "x", "y", F.when(F.col("v") >= saturated, F.col("v")).otherwise(F.col("blurred")).alias("v"))


# --- saturated stars and their spikes --------------------------------------------------------------


def saturated_stars(df: DataFrame, level: float, least: int = 4, size: int = 64) -> DataFrame:
    """Stars whose cores are cut off at ``level``: a row a component of such pixels of ``least`` or more that isn't long (aspect up to 3).

    frame, x, y (its centre), area, radius (that of a disc of its area). Cores whose samples are missing are found by ``missing_cores``.
    """
    from lumenweave.operators.raster import component_shapes, label_components

    hot = df.filter(F.col("v") >= level).select("frame", "x", "y")
    labels = settled(label_components(hot, size), "saturated")
    shape = component_shapes(labels)
    centre = labels.groupBy("frame", "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    long = F.greatest("width", "height") / F.least("width", "height")
    good = shape.join(centre, ["frame", "label"]).filter((F.col("area") >= least) & (long <= 3))
    return good.select("frame", "x", "y", "area", F.sqrt(F.col("area") / math.pi).alias("radius"))


def missing_cores(df: DataFrame, levels: DataFrame, k: float = 20.0, share: float = 0.75, least: int = 4, most: int = 2000, size: int = 64) -> DataFrame:
    """Stars whose cores are missing: components of ``least`` to ``most`` samples that aren't finite, all around which there is a bright ring.

    The ring is what touches the component. ``share`` of it must be above bg + k sigma of ``levels`` (frame, bg, sigma), and none of it may be missing or beyond the
    raster. frame, x, y, area, radius.
    """
    from lumenweave.operators.raster import label_components

    rows = df.select("frame", "x", "y", "v").withColumn("gone", ~F.coalesce(finite(F.col("v")), F.lit(False)))
    labels = settled(label_components(rows.filter("gone").select("frame", "x", "y"), size), "missing")
    area = labels.groupBy("frame", "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("area")).filter(F.col("area").between(least, most))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    around = labels.join(area.select("frame", "label"), ["frame", "label"]).withColumn("o", steps)
    around = around.select("frame", "label", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y")).distinct()
    around = around.join(labels.select("frame", "label", "x", "y"), ["frame", "label", "x", "y"], "left_anti")
    seen = around.join(rows, ["frame", "x", "y"], "left").join(levels.select("frame", "bg", "sigma"), "frame")
    bright = F.avg((~F.col("gone") & (F.col("v") > F.col("bg") + k * F.col("sigma"))).cast("int"))
    ring = seen.groupBy("frame", "label").agg(F.coalesce(bright, F.lit(0.0)).alias("bright"), F.max(F.coalesce("gone", F.lit(True))).alias("open"))
    good = area.join(ring.filter((F.col("bright") >= share) & ~F.col("open")), ["frame", "label"])
    return good.select("frame", "x", "y", "area", F.sqrt(F.col("area") / math.pi).alias("radius"))


def reject_spikes(sources: DataFrame, saturated: DataFrame, reach: float = 12.0, width: float = 1.5, turn: float = 45.0) -> DataFrame:
    """``sources`` (frame, id, x, y, ...) with ``spike``: whether one lies on a ray of a saturated star (frame, x, y, radius), beyond its core.

    Rays leave a star every ``turn`` degrees and are ``reach`` of its radii long; ``width`` is a ray's half width in pixels.
    """
    # places meet by cells; one on a ray leaves the cell's search, so few are held against many stars. What lies at a ray's very edge is decided by columns below
    far = float(saturated.agg(F.coalesce(F.max(F.col("radius") * reach), F.lit(1.0)).alias("m")).first()["m"])  # one number

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):  # a side without rows has no columns
            return pd.DataFrame()
        ax, ay, left = a["x"].to_numpy(float), a["y"].to_numpy(float), np.arange(len(a))
        sure, edge = np.zeros(len(a), dtype=bool), []
        for x, y, radius in zip(*(b[c].to_numpy(float) for c in ("x", "y", "radius"))):
            dx, dy = ax[left] - x, ay[left] - y
            dist, angle = np.sqrt(dx * dx + dy * dy), np.degrees(np.arctan2(dy, dx))
            # how far inside the ray a place is: beyond the core, before the end, beside its middle
            inside = np.minimum(np.minimum(dist - radius - 1, reach * radius - dist), width - dist * np.sin(np.radians(np.abs(angle - np.floor(angle / turn + 0.5) * turn))))
            edge += [(k, x, y, radius) for k in left[np.abs(inside) <= 1e-6]]
            sure[left[inside > 1e-6]] = True
            left = left[inside <= 1e-6]
            if not len(left):
                break
        edge = [e for e in edge if not sure[e[0]]]
        k = np.r_[np.flatnonzero(sure), np.array([e[0] for e in edge], dtype=int)]
        at = np.array([(math.nan,) * 3] * int(sure.sum()) + [e[1:] for e in edge], dtype=float).reshape(-1, 3)
        return pd.DataFrame({"frame": a["frame"].iloc[0], "x": ax[k], "y": ay[k], "sx": at[:, 0], "sy": at[:, 1], "radius": at[:, 2], "sure": sure[k]})

    places = near.known(sources.select("frame", "x", "y")).distinct()
    side = near.cell_side(places, ["frame"], far)
    bright = near.known(saturated.select("frame", "x", "y", "radius")).distinct()
    got = near.meet(near.celled(places, side), near.celled(bright, side, far), ["frame"], run, "frame long, x double, y double, sx double, sy double, radius double, sure boolean")
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    dist, angle = F.sqrt(dx * dx + dy * dy), F.degrees(F.atan2(dy, dx))
    beside = dist * F.sin(F.radians(F.abs(angle - F.floor(angle / turn + 0.5) * turn)))
    hit = got.filter(F.col("sure") | ((dist > F.col("radius") + 1) & (dist <= reach * F.col("radius")) & (beside <= width))).select("frame", "x", "y").distinct()
    marked = sources.join(hit.withColumn("spike", F.lit(True)), ["frame", "x", "y"], "left")
    return marked.select("frame", "id", *[c for c in sources.columns if c not in ("frame", "id")], F.coalesce("spike", F.lit(False)).alias("spike"))


# --- fits that treatments use ----------------------------------------------------------------------


def nonnegative(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Least squares with no coefficient below 0: those that would be are held at 0, one at a time, and let go where that pays."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        k = int(slope.argmax())
        if free.all() or slope[k] <= 1e-10 * max(1.0, float(np.abs(a.T @ b).max())):
            return x
        free[k] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > 0).all():
                x = z
                break
            low = free & (z <= 0)
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


TREATMENT = "frame long, id long, x double, y double, fwhm double, blend long, amplitude double, base double, residual double, wing double, footprint double"


def fit_treatments(df: DataFrame, sources: DataFrame, noise: DataFrame, beta: float = 2.5, most: float = 16.0) -> DataFrame:
    """Per source (frame, id, x, y, fwhm, radius) what a treatment needs (TREATMENT), stars that touch solved together.

    Profiles of known width over a level are fitted with no amplitude below 0, on the pixels within the blend's radii. ``wing`` is the median
    excess over the fit from 1.1 to 1.5 radii, ``footprint`` the distance at which the profile sinks to half the noise, 16 pixels at most. A
    blend is a group of discs that overlap, with their pixels.
    """
    src = sources.select("frame", "id", "x", "y", "fwhm", "radius")
    pairs = radius_join(src, src, 2 * most, ["frame"]).filter((F.col("id") < F.col("r_id")) & (F.col("dist") <= F.col("radius") + F.col("r_radius")))
    comp = connected(pairs.select(F.col("id").alias("a"), F.col("r_id").alias("b")))
    grouped = src.join(comp, "id", "left").withColumn("blend", F.coalesce("component", F.col("id"))).drop("component")
    reach = F.col("radius") * 1.5
    span = lambda c: F.explode(F.sequence(F.ceil(F.col(c) - reach).cast("long"), F.floor(F.col(c) + reach).cast("long")))
    stamp = grouped.select("frame", "blend", span("x").alias("px"), "y", "radius").select("frame", "blend", "px", span("y").alias("py")).distinct()
    px = stamp.join(df.select("frame", F.col("x").alias("px"), F.col("y").alias("py"), "v"), ["frame", "px", "py"])
    px = px.join(F.broadcast(noise.select("frame", "sigma")), "frame")  # a row a frame

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        stars = right.sort_values("id")
        ok = np.isfinite(left["v"].to_numpy(float))
        x, y, v = (left[c].to_numpy(float)[ok] for c in ("px", "py", "v"))
        if not len(v):
            return pd.DataFrame(columns=[c.split()[0] for c in TREATMENT.split(", ")])
        sigma = float(left["sigma"].iloc[0])
        alpha = stars["fwhm"].to_numpy(float) / (2 * math.sqrt(2 ** (1 / beta) - 1))
        d2 = (x[:, None] - stars["x"].to_numpy(float)) ** 2 + (y[:, None] - stars["y"].to_numpy(float)) ** 2
        shape = (1 + d2 / alpha**2) ** -beta
        inside = (d2 <= stars["radius"].to_numpy(float) ** 2).any(axis=1)
        low = float(np.median(v[~inside])) if (~inside).sum() >= 8 else float(v.min())
        design = np.column_stack([shape, np.ones(len(v))])
        floor = min(low, float(v.min()))  # the level may be below 0: it is fitted from the least sample up
        got = nonnegative(design[inside] if inside.any() else design, (v[inside] if inside.any() else v) - floor)
        amplitude, base = got[:-1], got[-1] + floor
        rest = v - shape @ amplitude - base
        rows = []
        for k, star in enumerate(stars.itertuples()):
            d = np.sqrt(d2[:, k])
            own = d <= star.radius
            ring = (d >= 1.1 * star.radius) & (d <= 1.5 * star.radius)
            residual = float(np.sqrt((rest[own] ** 2).mean()) / amplitude[k]) if own.any() and amplitude[k] > 0 else math.inf
            wing = float(np.median(rest[ring])) if ring.sum() >= 8 else 0.0
            fades = alpha[k] * math.sqrt(max((2 * amplitude[k] / sigma) ** (1 / beta) - 1, 0.0)) if sigma > 0 and amplitude[k] > 0 else 0.0
            rows.append((int(star.frame), int(star.id), star.x, star.y, star.fwhm, int(star.blend), float(amplitude[k]), float(base), residual, wing, min(most, fades)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TREATMENT.split(", ")])

    right = grouped.select(*[F.col(c).alias(c) for c in ("frame", "blend", "id", "x", "y", "fwhm", "radius")])
    return px.groupBy("frame", "blend").cogroup(right.groupBy("frame", "blend")).applyInPandas(run, TREATMENT)


def treatment_preview(before: DataFrame, after: DataFrame, sources: DataFrame, rings: int = 8) -> DataFrame:
    """Per source (frame, id, x, y, radius) and ring (of a pixel's width, from its centre): samples, and their mean before and after a treatment."""
    near = _within_reach(before.select("frame", "x", "y", "v"), sources.select("frame", "id", "x", "y", "radius"))
    both = near.join(after.select("frame", "x", "y", F.col("v").alias("after")), ["frame", "x", "y"])
    ring = F.least(F.floor("dist"), F.lit(rings - 1)).cast("int")
    return both.groupBy("frame", F.col("r_id").alias("id"), ring.alias("ring")).agg(F.count("*").alias("n"), F.avg("v").alias("before"), F.avg("after").alias("after"))
