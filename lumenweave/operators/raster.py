"""Tile kernels: pixels go to tiles with a halo, numpy works on a tile's grid, and only a tile's own pixels come back.

A group is one tile, whose size is a parameter, so a task's memory doesn't grow with the raster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.scalars import finite
from lumenweave.operators.graph import connected

NAN = float("nan")


def haloed_tiles(df: DataFrame, size: int, halo: int) -> DataFrame:
    """Each pixel in its own tile (own = true) and in those whose halo it lies in."""
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size))
    rows = df.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))
    return rows.withColumn("own", (F.floor(F.col("x") / size) == F.col("tx")) & (F.floor(F.col("y") / size) == F.col("ty")))


def tile_map(df: DataFrame, kernel, outputs: dict[str, str], size: int = 64, halo: int = 4, inputs: tuple[str, ...] = ("v",), placed: bool = False) -> DataFrame:
    """``kernel(planes)`` on each tile: a dict of 2-D arrays (NaN where there is no pixel) to a dict of 2-D arrays of one shape.

    A ``placed`` kernel also gets the x and y of the arrays' first sample.

    Returns frame, x, y and the outputs, for the tiles' own pixels that exist.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["own"].any():  # only the halo of a tile beyond the raster
            return pd.DataFrame({c: [] for c in ("frame", "x", "y", *outputs)})
        tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        side = size + 2 * halo
        c, rw = (pdf["x"] - (tx * size - halo)).to_numpy(), (pdf["y"] - (ty * size - halo)).to_numpy()
        planes = {}
        for name in inputs:
            g = np.full((side, side), np.nan)
            g[rw, c] = pdf[name].to_numpy(dtype=float)
            planes[name] = g
        got = kernel(planes, tx * size - halo, ty * size - halo) if placed else kernel(planes)
        own = pdf["own"].to_numpy()
        out = {"frame": pdf["frame"][own], "x": pdf["x"][own], "y": pdf["y"][own]}
        for name, kind in outputs.items():
            values = np.asarray(got[name])[rw[own], c[own]]
            out[name] = values.astype({"long": np.int64, "int": np.int32, "boolean": bool}.get(kind, float))
        return pd.DataFrame(out)

    schema = "frame long, x long, y long, " + ", ".join(f"{k} {t}" for k, t in outputs.items())
    got = haloed_tiles(df.select("frame", "x", "y", *inputs), size, halo).groupBy("frame", "tx", "ty").applyInPandas(run, schema)
    # pandas' NaN comes back as null
    return got.withColumns({k: F.coalesce(k, F.lit(NAN)) for k, t in outputs.items() if t == "double"})


def shifted(g: np.ndarray, reach: int) -> np.ndarray:
    """All (2 reach + 1) ** 2 shifts of a grid, NaN beyond its edge."""
    p = np.pad(g, reach, constant_values=np.nan)
    n, m = g.shape
    return np.stack([p[i : i + n, j : j + m] for i in range(2 * reach + 1) for j in range(2 * reach + 1)])


def window_median(df: DataFrame, reach: int = 5, size: int = 64) -> DataFrame:
    """Median of the finite samples within ``reach`` of a pixel along both axes, and how many."""

    def kernel(p):
        with np.errstate(all="ignore"):
            s = shifted(np.where(np.isfinite(p["v"]), p["v"], np.nan), reach)
            n = np.isfinite(s).sum(axis=0)
            import warnings

            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return {"n": n, "median": np.nanmedian(s, axis=0)}

    return tile_map(df, kernel, {"n": "long", "median": "double"}, size, reach)


def gaussian_weights(sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    w = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    return w / w.sum()


def blur_grid(g: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian over finite samples only; NaN where there are none."""
    w = gaussian_weights(sigma)
    ok = np.isfinite(g)
    total, weight = np.where(ok, g, 0.0), ok.astype(float)
    for axis in (0, 1):
        total = np.apply_along_axis(np.convolve, axis, total, w, mode="same")
        weight = np.apply_along_axis(np.convolve, axis, weight, w, mode="same")
    return np.where(weight > 1e-12, total / np.maximum(weight, 1e-12), np.nan)


def blur(df: DataFrame, sigma: float = 1.5, size: int = 64) -> DataFrame:
    return tile_map(df, lambda p: {"blurred": blur_grid(p["v"], sigma)}, {"blurred": "double"}, size, int(np.ceil(3 * sigma)))


def _mirrored(g: np.ndarray, left: int, top: int, width: int, height: int) -> np.ndarray:
    """A grid whose samples outside the raster are those mirrored at its edge, where the grid holds these."""

    def back(at: np.ndarray, n: int) -> np.ndarray:
        return np.where(at < 0, -at - 1, np.where(at >= n, 2 * n - at - 1, at))

    rows, cols = np.arange(g.shape[0]) + top, np.arange(g.shape[1]) + left
    r, c = back(rows, height) - top, back(cols, width) - left
    ok = ((r >= 0) & (r < g.shape[0]))[:, None] & ((c >= 0) & (c < g.shape[1]))[None, :]
    return np.where(ok, g[np.clip(r, 0, g.shape[0] - 1)][:, np.clip(c, 0, g.shape[1] - 1)], np.nan)


def fill_grid(g: np.ndarray, hole: np.ndarray, samples: np.ndarray, near: int = 4, far: int = 8) -> np.ndarray:
    """``g`` with its holes filled from ``samples`` (NaN where there are none).

    A bicubic surface of 16 terms over the window ``near``, weighted by 1 / (1 + distance squared), with a small ridge, where that has 24
    samples; its value stays within theirs. Else the weighted median of the window ``far``; else what was there.
    """
    out = g.copy()

    def window(reach):
        at = np.arange(-reach, reach + 1)
        dx, dy = np.meshgrid(at, at)
        return dx.ravel(), dy.ravel(), 1.0 / (1 + (dx * dx + dy * dy).ravel())

    dx, dy, w = window(near)
    powers = np.stack([(dx / near) ** a * (dy / near) ** b for b in range(4) for a in range(4)], axis=1)
    padded = np.pad(samples, far, constant_values=np.nan)
    fx, fy, fw = window(far)
    for y, x in np.argwhere(hole):
        v = padded[y + far + dy, x + far + dx]
        ok = np.isfinite(v)
        if ok.sum() >= 24:
            a = powers[ok]
            m = a.T @ (a * w[ok, None]) + 1e-8 * np.eye(16)
            got = np.linalg.solve(m, a.T @ (w[ok] * v[ok]))[0]
            if np.isfinite(got):
                out[y, x] = min(max(got, v[ok].min()), v[ok].max())
                continue
        v = padded[y + far + fy, x + far + fx]
        ok = np.isfinite(v) & ((fx != 0) | (fy != 0))
        if ok.any():
            order = np.argsort(v[ok], kind="stable")
            run = np.cumsum(fw[ok][order])
            out[y, x] = v[ok][order][np.searchsorted(run, run[-1] / 2)]
    return out


def fill_holes(df: DataFrame, width: int, height: int, size: int = 64) -> DataFrame:
    """Missing samples filled from their neighbours, mirrored at the raster's edge (``fill_grid``): frame, x, y, filled."""

    def kernel(p, left, top):
        samples = _mirrored(p["v"], left, top, width, height)
        return {"filled": fill_grid(p["v"], ~np.isfinite(p["v"]), samples)}

    return tile_map(df, kernel, {"filled": "double"}, size, 8, placed=True)


def label_components(mask: DataFrame, size: int = 64) -> DataFrame:
    """8-neighbour components of a sparse mask (frame, x, y): ``label`` is the least y * 2 ** 31 + x of the component.

    Tiles label their own pixels; labels that touch across tile borders are edges of a small graph whose
    components, found by joins, give the final label.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        where = {(int(x), int(y)): i for i, (x, y) in enumerate(zip(pdf["x"], pdf["y"]))}
        label = np.full(len(pdf), -1, dtype=np.int64)
        for x, y in sorted(where, key=lambda k: (k[1], k[0])):
            if label[where[x, y]] >= 0:
                continue
            own, todo = y * (1 << 31) + x, [(x, y)]
            label[where[x, y]] = own
            while todo:
                a, b = todo.pop()
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        k = where.get((a + i, b + j))
                        if k is not None and label[k] < 0:
                            label[k] = own
                            todo.append((a + i, b + j))
        return pd.DataFrame({"frame": pdf["frame"], "x": pdf["x"], "y": pdf["y"], "local": label})

    tiled = mask.select("frame", "x", "y").withColumns({"tx": F.floor(F.col("x") / size), "ty": F.floor(F.col("y") / size)})
    local = tiled.groupBy("frame", "tx", "ty").applyInPandas(run, "frame long, x long, y long, local long").cache()
    border = (F.col("x") % size).isin(0, size - 1) | (F.col("y") % size).isin(0, size - 1)
    edge = local.filter(border)
    near = edge.withColumn("i", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("j", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    near = near.select("frame", (F.col("x") + F.col("i")).alias("x"), (F.col("y") + F.col("j")).alias("y"), F.col("local").alias("other"))
    links = edge.join(near, ["frame", "x", "y"]).filter("local <> other")
    # labels repeat between frames, so a node is (frame, label)
    node = lambda c: F.concat_ws(":", "frame", F.lpad(F.col(c).cast("string"), 20, "0"))
    comp = connected(links.select(node("local").alias("a"), node("other").alias("b")).distinct())
    joined = local.withColumn("id", node("local")).join(comp, "id", "left")
    return joined.select("frame", "x", "y", F.coalesce(F.split("component", ":")[1].cast("long"), F.col("local")).alias("label"))


def component_shapes(labels: DataFrame) -> DataFrame:
    """Area, box and fill of each component."""
    w, h = F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1
    return labels.groupBy("frame", "label").agg(F.count("*").alias("area"), w.alias("width"), h.alias("height"), (F.count("*") / (w * h)).alias("fill"))


def _grown(now: np.ndarray, seeds: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels (flat places of a grid with a border of NaN) that hang together with seeds, each above the floor of the seed it is reached from, and the number of their blob.

    All blobs grow together by a ring of pixels at a time; those that touch are one, and have the number of their first seed.
    """
    width = now.shape[1]
    values, label = now.ravel(), np.full(now.size, -1, dtype=np.int64)
    label[seeds] = np.arange(len(seeds))
    around = np.array([i * width + j for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    ring, touching = seeds, [np.empty((0, 2), dtype=np.int64)]
    while len(ring):
        at, own = (ring[:, None] + around).ravel(), np.repeat(label[ring], 8)
        met = (label[at] >= 0) & (label[at] != own)
        touching.append(np.unique(np.stack([own[met], label[at[met]]], axis=1), axis=0))
        new = (label[at] < 0) & (values[at] > floors[own])
        at, own = at[new], own[new]
        order = np.lexsort((own, at))
        ring, first = np.unique(at[order], return_index=True)
        label[ring] = own[order][first]
    blob, links = np.arange(len(seeds)), np.concatenate(touching)
    while len(links):
        before = blob.copy()
        np.minimum.at(blob, links[:, 0], blob[links[:, 1]])
        np.minimum.at(blob, links[:, 1], blob[links[:, 0]])
        blob = blob[blob]
        if np.array_equal(blob, before):
            break
    at = np.flatnonzero(label >= 0)
    return at, blob[label[at]]


def clean_grid(g: np.ndarray, sigma: float, inside: np.ndarray | None = None, spared: np.ndarray | None = None, passes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Single-frame cosmic-ray removal: (cleaned, hit).

    A seed is positive and above its four neighbours (a missing one counts as the seed itself) by ten deviations in all; it grows over
    touching samples above its own wide background, the upper median of 11 x 11, plus two deviations; blobs that touch are one, with the background of
    the first seed. A blob like a star (over 60 pixels, or over 12 that fill their box of more than 3 x 3 to 0.65) stays, any other becomes the background.
    ``inside``: where seeds may lie (the raster but for its outer two pixels); ``spared`` pixels never seed.
    """
    height, width = g.shape
    if inside is None:
        inside = np.zeros(g.shape, dtype=bool)
        inside[2 : height - 2, 2 : width - 2] = True
    if spared is not None:
        inside = inside & ~spared
    now, hit = np.pad(g, 5, constant_values=np.nan), np.zeros((height + 10, width + 10), dtype=bool)
    inside = np.pad(inside, 5)
    wide = np.array([i * now.shape[1] + j for i in range(-5, 6) for j in range(-5, 6)])
    for _ in range(passes):
        around = np.stack([np.roll(now, step, axis) for axis in (0, 1) for step in (-1, 1)])
        excess = (now - np.where(np.isnan(around), now, around)).sum(axis=0)
        seeds = np.flatnonzero(inside & (now > 0) & (excess > 10 * sigma))
        if not len(seeds):
            break
        window = np.sort(now.ravel()[seeds[:, None] + wide], axis=1)  # NaN come last
        levels = window[np.arange(len(seeds)), (~np.isnan(window)).sum(axis=1) // 2]
        at, blob = _grown(now, seeds, levels + 2 * sigma)
        area = np.bincount(blob, minlength=len(seeds))
        y, x = np.divmod(at, now.shape[1])
        span = []
        for c in (y, x):
            low, high = np.full(len(seeds), now.size), np.full(len(seeds), -1)
            np.minimum.at(low, blob, c)
            np.maximum.at(high, blob, c)
            span.append(np.maximum(high - low + 1, 1))
        star = (area > 60) | ((area > 12) & (area > 0.65 * span[0] * span[1]) & (span[0] > 3) & (span[1] > 3))
        gone = ~star[blob]
        now, flat = now.copy(), hit.ravel()
        now.ravel()[at[gone]] = levels[blob[gone]]
        flat[at[gone]] = True
    return now[5:-5, 5:-5], hit[5:-5, 5:-5]


#: What a blob that isn't a star may span, with the window of its background, in each of two passes.
CLEAN_HALO = 2 * (61 + 6)


def clean(df: DataFrame, levels: DataFrame, width: int, height: int, size: int = 256, spared: DataFrame | None = None) -> DataFrame:
    """Cosmic-ray cleaned pixels with a ``hit`` flag; ``levels`` has the sigma of each frame, ``spared`` the pixels (x, y) that never seed.

    The halo holds every blob that is removed, so tiles don't show.
    """
    rows = df.join(F.broadcast(levels.select("frame", "sigma")), "frame")  # a row a frame
    if spared is not None:
        rows = rows.join(spared.select("x", "y", F.lit(1.0).alias("spared")), ["x", "y"], "left")
    inputs = ("v", "sigma") if spared is None else ("v", "sigma", "spared")

    def kernel(p, left, top):
        y, x = np.arange(p["v"].shape[0]) + top, np.arange(p["v"].shape[1]) + left
        inside = ((y >= 2) & (y < height - 2))[:, None] & ((x >= 2) & (x < width - 2))[None, :]
        out, hit = clean_grid(p["v"], float(np.nanmax(p["sigma"])), inside, p["spared"] == 1 if "spared" in p else None)
        return {"clean": out, "hit": hit}

    return tile_map(rows, kernel, {"clean": "double", "hit": "boolean"}, size, CLEAN_HALO, inputs, placed=True)


def cosmic_mask(df: DataFrame, snr: float = 4.0, scale: float = 1.2) -> DataFrame:
    """Pixels above their model (columns v, model, noise): seeds, growth, and two rounds of a halo, by neighbour joins.

    A seed has positive data and an excess over snr * noise + scale * steepest model step; a missing neighbour
    makes a border pixel, which never seeds.
    """
    from lumenweave.operators.series import neighbours

    model = neighbours(df, "model")
    sides = [F.col(c) for c in ("left", "right", "up", "down")]
    whole = sides[0].isNotNull() & sides[1].isNotNull() & sides[2].isNotNull() & sides[3].isNotNull()
    steep = F.greatest(*[F.abs(F.col("model") - s) for s in sides])
    excess = F.col("v") - F.col("model")
    rows = model.withColumn("excess", excess).withColumn(
        "flag", F.coalesce(whole & (F.col("v") > 0) & (excess > 0) & (excess > snr * F.col("noise") + scale * steep), F.lit(False))
    ).select("frame", "x", "y", "excess", "noise", "flag")
    grow = [lambda n: (F.col("excess") > 0.5 * snr * F.col("noise")) & (n >= 1)]
    grow += 2 * [lambda n: (F.col("excess") > 0.5 * F.col("noise")) & ((n >= 2) | ((n >= 1) & (F.col("excess") > F.col("noise"))))]
    for rule in grow:
        rows = rows.cache()  # each round reads it twice
        around = [F.array(*[F.lit(i) for i in (-1, 0, 1)])] * 2
        hits = rows.filter("flag").withColumn("i", F.explode(around[0])).withColumn("j", F.explode(around[1])).filter("i <> 0 OR j <> 0")
        n = hits.groupBy("frame", (F.col("x") + F.col("i")).alias("x"), (F.col("y") + F.col("j")).alias("y")).agg(F.count("*").alias("near"))
        rows = rows.join(n, ["frame", "x", "y"], "left").withColumn("flag", F.col("flag") | rule(F.coalesce("near", F.lit(0)))).drop("near")
    return rows


def resample(df: DataFrame, points: DataFrame, renormalise: bool = True) -> DataFrame:
    """Bilinear value of ``points`` (frame, id, px, py) from their four pixels; missing ones drop out of the weights, or make it NaN."""
    fx, fy = F.floor("px"), F.floor("py")
    corner = points.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    wx = F.when(F.col("i") == 0, 1 - (F.col("px") - fx)).otherwise(F.col("px") - fx)
    wy = F.when(F.col("j") == 0, 1 - (F.col("py") - fy)).otherwise(F.col("py") - fy)
    corner = corner.withColumns({"x": fx + F.col("i"), "y": fy + F.col("j"), "w": wx * wy}).filter("w > 0")
    ok = finite(F.col("v"))
    got = corner.join(df.select("frame", "x", "y", "v"), ["frame", "x", "y"], "left").groupBy("frame", "id").agg(
        F.sum(F.when(ok, F.col("v") * F.col("w"))).alias("s"), F.coalesce(F.sum(F.when(ok, F.col("w"))), F.lit(0.0)).alias("w")
    )
    value = F.when(F.col("w") > 0, F.col("s") / F.col("w")) if renormalise else F.when(F.col("w") > 1 - 1e-9, F.col("s"))
    return got.select("frame", "id", F.coalesce(value, F.lit(NAN)).alias("v"))


# --- masks ----------------------------------------------------------------------------------------


def disc(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def _spread(mask: DataFrame, radius: int) -> DataFrame:
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in disc(radius)]))
    return mask.select("frame", "x", "y", at.alias("o")).select("frame", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"))


def dilate(mask: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """Pixels of the raster within a disc of a mask pixel."""
    return _spread(mask, radius).filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).distinct()


def erode(mask: DataFrame, radius: int) -> DataFrame:
    """Mask pixels whose whole disc is mask; outside the raster nothing is."""
    n = _spread(mask, radius).groupBy("frame", "x", "y").agg(F.count("*").alias("n"))
    return n.filter(F.col("n") == len(disc(radius))).select("frame", "x", "y")


def suppress(df: DataFrame, radius: int, v: str = "v") -> DataFrame:
    """Non-maximum suppression: a candidate stays if none stronger (then lower y, x) is within ``radius`` along both axes."""
    from lumenweave.operators.joins import radius_join

    cand = df.select("frame", "x", "y", v)
    near = radius_join(cand, cand, radius * 2**0.5, ["frame"]).filter((F.abs(F.col("x") - F.col("r_x")) <= radius) & (F.abs(F.col("y") - F.col("r_y")) <= radius))
    other = F.col(f"r_{v}") > F.col(v)
    tie = (F.col(f"r_{v}") == F.col(v)) & ((F.col("r_y") < F.col("y")) | ((F.col("r_y") == F.col("y")) & (F.col("r_x") < F.col("x"))))
    beaten = near.filter(other | tie).select("frame", "x", "y").distinct()
    return cand.join(beaten, ["frame", "x", "y"], "left_anti")


def fold_masks(steps: DataFrame) -> DataFrame:
    """Masks added and erased in order (columns x, y, step, op): what the last step to touch a pixel left."""
    w = Window.partitionBy("frame", "x", "y").orderBy(F.desc("step"))
    return steps.withColumn("r", F.row_number().over(w)).filter("r = 1 AND op = 'add'").select("frame", "x", "y")


def feathered(sources: DataFrame) -> DataFrame:
    """Star discs (x, y, radius, id, bits) to pixels: mask 1 within 0.65 of the radius, a cosine to 0 beyond; greatest mask wins, its id labels, bits OR.

    Equal discs are one. Mask and id make one number of 38 digits, whose greatest is kept without a sort: a mask is a multiple of 2 ** -54.
    """
    kind = dict(sources.dtypes)["id"]
    discs = sources.groupBy("frame", "x", "y", "radius").agg(F.min("id").alias("id"), F.bit_or("bits").alias("bits"))
    at = lambda c, sign: F.ceil(F.col(c) - F.col("radius")) if sign < 0 else F.floor(F.col(c) + F.col("radius"))
    grid = discs.withColumn("px", F.explode(F.sequence(at("x", -1), at("x", 1)))).withColumn("py", F.explode(F.sequence(at("y", -1), at("y", 1))))
    t = F.sqrt((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2) / F.col("radius")
    mask = F.when(t <= 0.65, 1.0).when(t <= 1, 0.5 + 0.5 * F.cos(F.lit(np.pi) * (t - 0.65) / 0.35)).otherwise(0.0)
    step, top = "CAST(20000000000000000000 AS DECIMAL(20, 0))", "CAST(9223372036854775807 AS DECIMAL(20, 0))"
    # an id counts from above, so that the least of equal masks wins
    hit = grid.withColumn("mask", mask).filter("mask > 0").withColumn("best", F.expr(f"CAST(CAST(mask * 18014398509481984D AS BIGINT) AS DECIMAL(17, 0)) * {step} + ({top} - CAST(id AS DECIMAL(20, 0)))"))
    won = hit.groupBy("frame", F.col("px").alias("x"), F.col("py").alias("y")).agg(F.max("mask").alias("mask"), F.max("best").alias("best"), F.bit_or("bits").alias("bits"))
    return won.select("frame", "x", "y", "mask", F.expr(f"CAST({top} - best % {step} AS {kind})").alias("label"), "bits")


def shared_star_mask(df: DataFrame, levels: DataFrame, width: int, height: int, least: int = 2, seed_sigmas: float = 2.0, grow_sigmas: float = 1.0) -> DataFrame:
    """Pixels (x, y) that are stars in several channels: seeds above bg + ``seed_sigmas`` sigma in at least ``least`` frames, grown in each
    channel above bg + ``grow_sigmas`` sigma along touching pixels, and dilated by one."""
    rows = df.join(F.broadcast(levels), "frame").filter(finite(F.col("v")))
    seed = rows.filter(F.col("v") > F.col("bg") + seed_sigmas * F.col("sigma")).groupBy("x", "y").agg(F.countDistinct("frame").alias("n")).filter(F.col("n") >= least)
    bright = rows.filter(F.col("v") > F.col("bg") + grow_sigmas * F.col("sigma")).select("frame", "x", "y")
    blobs = label_components(bright)
    hit = blobs.join(seed.select("x", "y"), ["x", "y"]).select("frame", "label").distinct()
    grown = blobs.join(hit, ["frame", "label"], "left_semi").select(F.lit(0).cast("long").alias("frame"), "x", "y").distinct()
    return dilate(grown, 1, width, height).select("x", "y")


def clean_channels(df: DataFrame, levels: DataFrame, width: int, height: int, size: int = 256, **stars) -> DataFrame:
    """Cosmic-ray cleaning of aligned channels: pixels that they share as stars never seed, whatever a single channel looks like there. ``stars``: settings of ``shared_star_mask``."""
    return clean(df, levels, width, height, size, shared_star_mask(df, levels, width, height, **stars))


def footprints(frames: DataFrame, maps: dict) -> DataFrame:
    """The four mapped corners of each frame (frame, width, height), in order around it; null where it has no map."""
    from lumenweave.operators.combine import map_table

    w, h, z = F.col("width") - 1.0, F.col("height") - 1.0, F.lit(0.0)
    at = lambda a, b, c, x, y: F.col(a) * x + F.col(b) * y + F.col(c)
    corner = lambda x, y: F.struct(at("ma", "mb", "mc", x, y).alias("x"), at("md", "me", "mf", x, y).alias("y"))
    poly = F.when(F.col("ma").isNotNull(), F.array(corner(z, z), corner(w, z), corner(w, h), corner(z, h)))
    j = frames.join(F.broadcast(map_table(frames.sparkSession, maps)), "frame", "left")  # a row a frame
    return j.select(*frames.columns, poly.alias("polygon"))


def project_mask_back(pixels: DataFrame, mask: DataFrame, maps: dict, radius: float = 0.5) -> DataFrame:
    """Detector pixels (frame, x, y) whose place in the output lies within ``radius`` of a mask pixel (x, y)."""
    from lumenweave.operators.combine import place
    from lumenweave.operators.joins import radius_join

    at = place(pixels.select("frame", "x", "y"), maps).select("frame", F.col("x").alias("px"), F.col("y").alias("py"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    near = radius_join(at, mask.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), max(radius, 1e-6), copied="right")
    return near.select("frame", F.col("px").alias("x"), F.col("py").alias("y")).distinct()
