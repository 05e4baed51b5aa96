"""Flows over several operators: F15, F16, M03, M04, M15-M17, M20, M21, M23, M26-M29, S14."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import scalars as s
from lumenweave.functions.wcs import Mapper
from lumenweave.operators import align, combine, detect, edit, mosaic, reproject, stats
from lumenweave.plans.registry import query, r
from lumenweave.session import settled
from lumenweave.plans.views import pix, pix_nan, stars, table, with_views

P, N, S = with_views("pix"), with_views("pix", "pix_nan"), with_views("stars")


@query(
    "f16_model_tree",
    f"{S} SELECT star, round((x - 128) * 0.5 + 3 * (y - 128) * (y - 128) * 0.001, 5) AS u, round((y + 2) * 2, 5) AS v FROM stars",
)
def f16(spark, sf):
    from lumenweave.functions.wcs import evaluate_model

    quad = {"model": "compose", "of": [
        {"model": "concatenate", "of": [{"model": "shift", "offset": -128}, {"model": "shift", "offset": -128}]},
        {"model": "polynomial", "terms": [((1, 0), 0.5), ((0, 2), 0.003)]},
    ]}
    line = {"model": "compose", "of": [{"model": "shift", "offset": 2}, {"model": "scale", "factor": 2}]}
    tree = {"model": "compose", "of": [{"model": "remap", "mapping": [0, 1, 1]}, {"model": "concatenate", "of": [quad | {"inputs": 2}, line]}]}
    return evaluate_model(stars(spark, sf).select("star", "x", "y"), tree, ["x", "y"], ["u", "v"]).select("star", r("u", digits=5), r("v", digits=5))


@query("f15_pixel_mapper", f"{S} SELECT star, frame, round(x + 2 * frame, 4) AS cx, round(y - frame, 4) AS cy FROM stars")
def f15(spark, sf):
    from lumenweave.functions.wcs import Mapper, map_pixels

    cd = (-1e-5, 0.0, 0.0, 1e-5)
    at = lambda k: Mapper((128.0 - 2 * k, 128.0 + k), (150.0, 2.2), cd)
    return map_pixels(stars(spark, sf).select("star", "frame", "x", "y"), {k: at(k) for k in range(8)}, at(0)).select("star", "frame", r("cx"), r("cy"))


def _fields(spark, sf):
    """All frames' catalogs side by side, one field each, 4,000 pixels apart."""
    return stars(spark, sf).select(F.col("frame").alias("field"), "star", (F.col("x") + 4000 * F.col("frame")).alias("x"), "y", "peak")


def _moved_fields(spark, sf, dx: int, dy: int):
    """Each field four times, moved by so much times 1 to 4; frames are numbered by field and time."""
    st, k = _fields(spark, sf), F.col("k")
    each = st.crossJoin(F.broadcast(spark.range(1, 5).withColumnRenamed("id", "k")))
    return st, each.select("field", "k", (F.col("field") * 8 + k).alias("frame"), "star", (F.col("x") + dx * k).alias("x"), (F.col("y") + dy * k).alias("y"), "peak")


def _displacement(fits):
    """Fits of ``_moved_fields`` with what each does at its field's centre."""
    field = F.floor(F.col("frame") / 8)
    x, y = field * 4000 + 128, F.lit(128)
    dx, dy = F.col("a") * x + F.col("b") * y + F.col("c") - x, F.col("d") * x + F.col("e") * y + F.col("f") - y
    return fits.select(field.alias("field"), (F.col("frame") % 8).alias("frame"), "method", "support", dx.alias("dx"), dy.alias("dy"))


@query("m03_alignment", None)
def m03(spark, sf):
    st, moved = _moved_fields(spark, sf, -3, 2)
    moved = moved.filter((F.col("star") + F.col("k")) % 5 != 0)
    return _displacement(align.align_to(moved, st, 256.0)).select("field", "frame", "method", "support", r("dx", digits=2), r("dy", digits=2))


def _field(spark, sf, profile):
    """A raster of 256 x 256 a frame with the brightest star of each 32 x 32 cell of the catalog drawn near the cell's centre."""
    st = stars(spark, sf).withColumns({"cx": F.floor(F.col("x") / 32), "cy": F.floor(F.col("y") / 32)})
    top = st.groupBy("frame", "cx", "cy").agg(F.max_by(F.struct("x", "y", "peak"), F.struct("peak", "star")).alias("s"))
    at = lambda c: F.col(f"c{c}") * 32 + 13 + F.col(f"s.{c}") % 6
    top = top.select("frame", at("x").alias("sx"), at("y").alias("sy"), (200 + F.col("s.peak") * 3).alias("peak"))
    span = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long")))
    grid = top.select("frame").distinct().withColumn("x", span).withColumn("y", span)
    px = grid.withColumns({"cx": F.floor(F.col("x") / 32), "cy": F.floor(F.col("y") / 32)})
    drawn = top.withColumns({"cx": F.floor(F.col("sx") / 32), "cy": F.floor(F.col("sy") / 32)})
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    lit = F.coalesce(F.col("peak") * profile(dx * dx + dy * dy), F.lit(0.0))
    field = px.join(drawn, ["frame", "cx", "cy"], "left").select("frame", "x", "y", (100 + lit).alias("v"))
    return field, top


@query("m15_star_extraction")
def m15(spark, sf):
    """Gaussian stars at catalog places in all frames, found again."""
    field, top = _field(spark, sf, lambda d: F.exp(-d / 8))
    levels = top.select("frame").distinct().select("frame", F.lit(100.0).alias("bg"), F.lit(2.0).alias("sigma"))
    return detect.extract_stars(field, levels, 64).select("frame", r("x", digits=2), r("y", digits=2), r("peak", digits=1), "area")


@query("m16_star_map")
def m16(spark, sf):
    """Moffat stars at catalog places in all frames, mapped with profile and status."""
    field, top = _field(spark, sf, lambda d: F.pow(1 + d / 6, -2.5))
    levels = top.select("frame").distinct().select("frame", F.lit(100.0).alias("bg"), F.lit(3.0).alias("sigma"))
    got = detect.star_map(field, detect.extract_stars(field, levels, 64), levels)
    return got.select("frame", r("x", digits=2), r("y", digits=2), r("fwhm", digits=1), r("snr", digits=1), "status")


def _disturbed_field(spark, sf):
    """Moffat stars of another width in each frame; around those with a peak just past a multiple of 7 lies a disc of half of their height."""
    field, top = _field(spark, sf, lambda d: F.pow(1 + d / (4 + F.col("frame") * 0.8), -2.5) + F.when((F.floor("peak") % 7 == 0) & (d <= 81), 0.5).otherwise(0.0))
    return field, top


@query("m16_field_tested")
def m16_field(spark, sf):
    """Sources that fit as stars do, held against the rings of the frame's other stars."""
    field, top = _disturbed_field(spark, sf)
    levels = top.select("frame").distinct().select("frame", F.lit(100.0).alias("bg"), F.lit(3.0).alias("sigma"))
    mapped = detect.star_map(field, detect.extract_stars(field, levels, 64), levels)
    got = detect.field_tested(field, settled(mapped, "star-map"))
    return got.select("frame", r("x", digits=1), r("y", digits=1), r("fwhm", digits=1), "status", "reason", r("difference", digits=3))


@query("m16_missing_cores")
def m16_missing(spark, sf):
    """The drawn stars with their cores missing: each is a hole inside a bright ring."""
    field, top = _field(spark, sf, lambda d: F.exp(-d / 8))
    levels = top.select("frame").distinct().select("frame", F.lit(100.0).alias("bg"), F.lit(2.0).alias("sigma"))
    got = detect.missing_cores(field.withColumn("v", F.when(F.col("v") > 250, float("nan")).otherwise(F.col("v"))), levels)
    return got.select("frame", r("x", digits=2), r("y", digits=2), "area")


@query(
    "m17_verified_sources",
    f"""{S}, a AS (SELECT star AS id, x, y FROM stars WHERE frame = 0), n AS (SELECT a.id, count(DISTINCT b.exposure) AS c FROM a JOIN stars b ON b.frame > 0 AND floor(b.x / 2) BETWEEN floor(a.x / 2) - 1 AND floor(a.x / 2) + 1
AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4 GROUP BY 1) SELECT a.id, coalesce(c, 0) AS confirmations, coalesce(c, 0) >= 2 AS confirmed FROM a LEFT JOIN n USING (id)""",
)
def m17(spark, sf):
    st = stars(spark, sf)
    return detect.verify(st.filter("frame = 0").select(F.col("star").alias("id"), "x", "y"), st.filter("frame > 0")).select("id", "confirmations", "confirmed")


SRC = "src AS (SELECT * FROM (VALUES (0, 20.0, 20.0, 6.0, 0.2), (0, 24.0, 22.0, 5.0, 0.1), (1, 40.0, 40.0, 8.0, 0.3)) t(frame, x, y, radius, base))"
FEATHER = "CASE WHEN t <= 0.65 THEN 1.0 WHEN t <= 1 THEN 0.5 + 0.5 * cos(pi() * (t - 0.65) / 0.35) ELSE 0 END"


def _sources(spark):
    return spark.createDataFrame([(0, 20.0, 20.0, 6.0, 0.2), (0, 24.0, 22.0, 5.0, 0.1), (1, 40.0, 40.0, 8.0, 0.3)], "frame long, x double, y double, radius double, base double")


GENTLER = f"""{P}, {SRC}, k AS (SELECT p.frame, p.x, p.y, v / 110 AS v, greatest(0.0, v / 110 - base) AS e, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) / radius AS t FROM pix p JOIN src s ON s.frame = p.frame AND abs(p.x - s.x) <= 16 AND abs(p.y - s.y) <= 16),
c AS (SELECT frame, x, y, max({FEATHER} * (e - e / (1 + 2 * e))) AS c FROM k GROUP BY 1, 2, 3) SELECT frame, x, y, round(v / 110 - coalesce(c, 0), 5) AS v FROM pix LEFT JOIN c USING (frame, x, y)"""


@query("m20_gentler_stars", GENTLER)
def m20(spark, sf):
    p = pix(spark, sf).select("frame", "x", "y", (F.col("v") / 110).alias("v"))
    return detect.gentler(p, _sources(spark)).select("frame", "x", "y", r("v", digits=5))


@query("m21_whitened_stars")
def m21(spark, sf):
    p = pix(spark, sf).select("frame", "x", "y", (F.col("v") / 110).alias("r"), (F.col("v") / 150).alias("g"), (F.col("v") / 200).alias("b"))
    src = _sources(spark).withColumns({f"base_{c}": F.col("base") for c in "rgb"})
    return detect.whiten(p, src).select("frame", "x", "y", *[r(c, digits=5) for c in "rgb"])


@query(
    "m23_prepared_frames",
    f"""{P}, m AS (SELECT DISTINCT frame, CASE WHEN frame % 2 = 0 THEN 'counts' ELSE 'rate' END AS unit, frame + 1.0 AS exptime FROM pix)
SELECT frame, count(*) AS n, round(sum(CASE WHEN unit = 'counts' THEN v / exptime ELSE v END), 3) AS total, round(sum(CASE WHEN unit = 'counts' THEN err / exptime ELSE err END), 3) AS err FROM pix JOIN m USING (frame) GROUP BY frame""",
)
def m23(spark, sf):
    meta = spark.range(8).select(F.col("id").alias("frame"), F.when(F.col("id") % 2 == 0, "counts").otherwise("rate").alias("unit"), (F.col("id") + 1.0).alias("exptime"))
    got = mosaic.prepare(pix(spark, sf), mosaic.Options(), meta)
    return got.groupBy("frame").agg(F.count("*").alias("n"), r(F.sum("v"), "total", 3), r(F.sum("err"), "err", 3))


@query("m26_mosaic")
def m26(spark, sf):
    maps = {k: s.Affine(c=1.5 * k, f=-0.75 * k) for k in range(8)}
    ready = mosaic.prepare(pix_nan(spark, sf).withColumn("err", F.col("err") * 20), mosaic.Options())  # errors of the size of the samples' own spread
    got = mosaic.build(ready, mosaic.Options(maps=maps, reject=True, cell=8, weighting="err"))
    return got.filter(~F.isnan("v")).select("ox", "oy", r("v", digits=2), r("weight", digits=3), "inputs", "dq")


@query(
    "m26_blotted_model",
    f"""{N}, p AS (SELECT frame, x, y, v, CAST(x + 2 * frame AS DOUBLE) + 0.25 AS cx, CAST(y - frame AS DOUBLE) + 0.5 AS cy FROM pix_nan),
e AS (SELECT frame, CAST(floor(cx + 0.5) AS BIGINT) AS ox, CAST(floor(cy + 0.5) AS BIGINT) AS oy, avg(v) AS v FROM p WHERE isfinite(v) GROUP BY 1, 2, 3),
m AS (SELECT ox, oy, median(v) AS v FROM e GROUP BY 1, 2),
k AS (SELECT p.frame, p.x, p.y, CAST(floor(cx) AS BIGINT) + i AS ox, CAST(floor(cy) AS BIGINT) + j AS oy,
  (CASE i WHEN 0 THEN 1 - (cx - floor(cx)) ELSE cx - floor(cx) END) * (CASE j WHEN 0 THEN 1 - (cy - floor(cy)) ELSE cy - floor(cy) END) AS w
  FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT frame, x, y, round(sum(m.v * w) / sum(w), 4) AS model FROM k JOIN m USING (ox, oy) GROUP BY 1, 2, 3""",
)
def m26_blot(spark, sf):
    """Frames drizzled alone, their median, and that seen from each frame's pixels."""
    maps = {k: s.Affine(c=2.0 * k + 0.25, f=0.5 - k) for k in range(8)}
    placed = combine.place(pix_nan(spark, sf), maps)
    model = mosaic.median_model(mosaic.separate(placed, "point", 1.0), 8)
    return mosaic.blot(model, placed).select("frame", "x", "y", r("model"))


@query("m27_colour")
def m27(spark, sf):
    weights = spark.range(8).select(F.col("id").alias("frame"), *[((F.col("id") + k) % 3 * 0.2).alias(c) for k, c in enumerate(("wr", "wg", "wb"))])
    return mosaic.colour(pix_nan(spark, sf), weights, s.Stretch("Asinh", 0.1, 1.0, 20.0), 0.3)


def _grids():
    """Eight grids of one field, turned, scaled and bent a little against the first, whose shift is its number."""
    import math as m

    out = {}
    for k in range(8):
        turn, scale = m.radians(1.5 * k), 1e-4 * (1 + 0.01 * k)
        cd = (scale * m.cos(turn), -scale * m.sin(turn), scale * m.sin(turn), scale * m.cos(turn))
        out[k] = Mapper((32.0 - k, 32.0 + 0.5 * k), (150.0, 2.2), cd, {(2, 0): 1e-5 * k}, {(1, 1): -1e-5 * k})
    return out


@query("m27_grids")
def m27_grids(spark, sf):
    """Frames of eight grids on the first's, equalised, mixed, and the last screened over the mix."""
    grids = _grids()
    weights = spark.range(8).select(F.col("id").alias("frame"), *[((F.col("id") + k) % 3 * 0.3).alias(c) for k, c in enumerate(("wr", "wg", "wb"))])
    return reproject.composed(pix(spark, sf).select("frame", "x", "y", "v"), grids, grids[0], 64, 64, weights, overlay=7, opacity=0.4, tint=(1.0, 0.5, 0.2), bound=1e-4)


@query("m28_sharpen")
def m28(spark, sf):
    p = pix(spark, sf).select("frame", "x", "y", (F.col("v") / 110).alias("v"))
    return edit.sharpen(p, 0.6).select("frame", "x", "y", r("v"))


@query(
    "m28_crop_turn",
    f"{P} SELECT frame, 19 - (y - 10) AS x, x - 5 AS y, v FROM pix WHERE x BETWEEN 5 AND 34 AND y BETWEEN 10 AND 29",
)
def m28_crop(spark, sf):
    return edit.turn(edit.crop(pix(spark, sf).select("frame", "x", "y", "v"), 5, 10, 35, 30), 30, 20, "clockwise").select("frame", "x", "y", "v")


@query(
    "m28_heal",
    f"""{P}, u AS (SELECT frame, x, y, v / 110 AS v, sqrt((x - 20) * (x - 20) + (y - 30) * (y - 30)) AS r FROM pix), j AS (SELECT u.*, s.v AS s FROM u LEFT JOIN u s ON s.frame = u.frame AND s.x = u.x + 22 AND s.y = u.y - 7),
h AS (SELECT frame, avg(v - s) AS shift FROM j WHERE r > 6 AND r <= 8 GROUP BY 1), k AS (SELECT j.*, coalesce(shift, 0) AS shift, CASE WHEN r <= 4.8 THEN 1.0 WHEN r <= 6 THEN (6 - r) / 1.2 ELSE 0 END AS w FROM j LEFT JOIN h USING (frame))
SELECT frame, x, y, round(CASE WHEN s IS NOT NULL AND w > 0 THEN v + w * (s + shift - v) ELSE v END, 4) AS v FROM k""",
)
def m28_heal(spark, sf):
    p = pix(spark, sf).select("frame", "x", "y", (F.col("v") / 110).alias("v"))
    return edit.heal(p, 20, 30, 6.0, 42, 23).select("frame", "x", "y", r("v"))


@query("m28_curve", f"{P} SELECT frame, x, y, round(least(1.0, floor(least(1.0, v / 110) * 255 + 0.5) / 255), 4) AS v FROM pix")
def m28_curve(spark, sf):
    """Three points of a line: the curve through them is that line, at 256 steps."""
    return pix(spark, sf).select("frame", "x", "y", r(edit.curve(F.col("v") / 110, [(0.0, 0.0), (0.5, 0.5), (1.0, 1.0)]), "v"))


def _levels(spark, sf):
    """Frames 0 to 2, and so on, as colours of 0..255; a channel that is missing where another is not is a dim 40."""
    p = pix(spark, sf).filter("frame < 6").withColumns({"c": F.col("frame") % 3, "frame": F.floor(F.col("frame") / 3)})
    wide = p.groupBy("frame", "x", "y").pivot("c", [0, 1, 2]).agg(F.first(F.floor(F.least(F.lit(1.0), F.col("v") / 70) * 255).cast("long")))
    return wide.select("frame", "x", "y", *[F.coalesce(F.col(str(k)), F.lit(40).cast("long")).alias(c) for k, c in enumerate("rgb")])


@query("m28_specks")
def m28_specks(spark, sf):
    """Two composed colours with their small specks and dropouts filled."""
    return edit.clean_specks(_levels(spark, sf), size=16).select("frame", "x", "y", "r", "g", "b", "repaired")


@query("m29_matched_psf")
def m29(spark, sf):
    return detect.match_psf(pix(spark, sf), 2.0, 3.5, 90.0).select("frame", "x", "y", r("v"))


@query("a10_tile_levels", f"{P} SELECT frame, x // 16 AS tx, y // 16 AS ty, round(median(v), 4) AS median FROM pix GROUP BY 1, 2, 3")
def a10_tiles(spark, sf):
    p = pix(spark, sf).withColumns({"tx": F.floor(F.col("x") / 16), "ty": F.floor(F.col("y") / 16)})
    return stats.robust_sigma(p, ["frame", "tx", "ty"]).select("frame", "tx", "ty", r("median"))


@query(
    "m06_single_models",
    f"{S}, f AS (SELECT DISTINCT frame AS field FROM stars) SELECT field, CAST(k AS BIGINT) AS frame, m AS model, CAST(6 * k AS DOUBLE) AS dx, CAST(-4 * k AS DOUBLE) AS dy FROM f CROSS JOIN (SELECT unnest(range(1, 5)) AS k) CROSS JOIN (SELECT unnest(['translation', 'similarity', 'affine']) AS m)",
)
def m06(spark, sf):
    st, each = _moved_fields(spark, sf, -6, 4)
    out = None
    for model in ("translation", "similarity", "affine"):
        got = _displacement(align.estimate(each, st, model))
        got = got.select("field", "frame", F.lit(model).alias("model"), *[(F.round(F.col(c) * 10, 0) / 10 + 0.0).alias(c) for c in ("dx", "dy")])
        out = got if out is None else out.union(got)
    return out


@query("m16_saturated_stars")
def m16_saturated(spark, sf):
    """The drawn stars' cores cut off at a level: each is one component about its centre."""
    field, _ = _field(spark, sf, lambda d: F.exp(-d / 8))
    got = detect.saturated_stars(field.withColumn("v", F.least("v", F.lit(220.0))), 220.0)
    return got.select("frame", r("x", digits=2), r("y", digits=2), "area")


@query(
    "m16_spikes",
    f"""{S}, b AS (SELECT frame, star, x, y, 3.0 AS radius FROM stars WHERE star % 50 = 0), d AS (SELECT a.star, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist, degrees(atan2(a.y - b.y, a.x - b.x)) AS angle FROM stars a JOIN b ON a.frame = b.frame),
h AS (SELECT DISTINCT star FROM d WHERE dist > 4 AND dist <= 36 AND dist * sin(radians(abs(angle - floor(angle / 45 + 0.5) * 45))) <= 1.5) SELECT frame, star AS id, star IN (SELECT star FROM h) AS spike FROM stars""",
)
def m16_spikes(spark, sf):
    """All stars of the catalog; every fiftieth has spikes."""
    st = stars(spark, sf).select("frame", F.col("star").alias("id"), "x", "y")
    bright = st.filter("id % 50 = 0").select("frame", "x", "y", F.lit(3.0).alias("radius"))
    return detect.reject_spikes(st, bright).select("frame", "id", "spike")


def _blends(spark, sf):
    """Pairs of Moffat stars about the drawn places, 5 pixels apart, the second half as bright, over a level of 100."""
    profile = lambda d: F.pow(1 + d / 4, -2.5)
    field, top = _field(spark, sf, profile)
    at = top.select("frame", "sx", "sy", "peak", F.floor(F.col("sx") / 32).alias("cx"), F.floor(F.col("sy") / 32).alias("cy"))
    dx, dy = F.col("x") - F.col("sx") - 5, F.col("y") - F.col("sy")
    second = field.join(at, (field["frame"] == at["frame"]) & (F.floor(field["x"] / 32) == at["cx"]) & (F.floor(field["y"] / 32) == at["cy"])).drop(at["frame"])
    lit = second.select("frame", "x", "y", (F.col("v") + 0.5 * F.col("peak") * profile(dx * dx + dy * dy)).alias("v"))
    number = (F.col("frame") * 64 + F.col("cx") * 8 + F.col("cy")) * 2
    fwhm = 2 * 2 * (2 ** (1 / 2.5) - 1) ** 0.5
    one = lambda k: at.select("frame", (number + k).alias("id"), (F.col("sx") + 5.0 * k).alias("x"), F.col("sy").alias("y"), F.lit(fwhm).alias("fwhm"), F.lit(4.0).alias("radius"), (F.col("peak") / (1 + k)).alias("planted"))
    return lit, one(0).union(one(1))


@query("m19_blended_fits")
def m19(spark, sf):
    """Amplitudes of stars that overlap, solved together."""
    field, src = _blends(spark, sf)
    noise = src.select("frame").distinct().withColumn("sigma", F.lit(2.0))
    got = detect.fit_treatments(field, src, noise)
    return got.join(src.select("id", "planted"), "id").select("frame", "id", "blend", r("amplitude", digits=1), r("base", digits=1), r("planted", digits=1), r("footprint", digits=2), r("wing", digits=2))


@query(
    "m24_cached_builds",
    f"{with_views('pix_nan')}, p AS (SELECT DISTINCT x, y, frame FROM pix_nan WHERE isfinite(v)) SELECT 'built' AS step, count(DISTINCT y * 64 + x) AS pixels FROM p UNION ALL SELECT 'read', count(DISTINCT y * 64 + x) FROM p UNION ALL SELECT 'other inputs', count(DISTINCT y * 64 + x) FROM p WHERE frame >= 4",
)
def m24(spark, sf):
    """An equal fingerprint reads what was built, whatever the frames now are; another builds again."""
    from lumenweave.session import shared_folder

    folder, files = shared_folder(spark, "builds"), table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("modified"))
    p, o = pix_nan(spark, sf).withColumns({"err": F.lit(1.0), "dq": F.lit(0).cast("long")}), mosaic.Options(sky="none")
    one, two = mosaic.inputs_fingerprint(files), mosaic.inputs_fingerprint(files, "new flat")
    steps = (("built", p, one), ("read", p.limit(0), one), ("other inputs", p.filter("frame >= 4"), two))
    out = None
    for name, df, key in steps:
        got = mosaic.cached_build(df, o, folder, key).filter(~F.isnan("v")).agg(F.count("*").alias("pixels")).select(F.lit(name).alias("step"), "pixels")
        out = got if out is None else out.union(got)
    return out


@query(
    "x10_treatment_preview",
    f"""{P}, {SRC}, s2 AS (SELECT *, CAST(row_number() OVER (ORDER BY frame, x) AS BIGINT) AS id FROM src), d AS (SELECT p.frame, s2.id, v / 110 AS v, least(floor(sqrt((p.x - s2.x) * (p.x - s2.x) + (p.y - s2.y) * (p.y - s2.y))), 7) AS ring FROM pix p JOIN s2 ON s2.frame = p.frame AND (p.x - s2.x) * (p.x - s2.x) + (p.y - s2.y) * (p.y - s2.y) <= s2.radius * s2.radius)
SELECT frame, id, CAST(ring AS INTEGER) AS ring, count(*) AS n, round(avg(v), 4) AS "before", round(avg(v) / 2, 4) AS "after" FROM d GROUP BY 1, 2, 3""",
)
def x10(spark, sf):
    """Rings about three sources, before and after a treatment that halves every sample."""
    from pyspark.sql import Window

    p = pix(spark, sf).select("frame", "x", "y", (F.col("v") / 110).alias("v"))
    src = _sources(spark).withColumn("id", F.row_number().over(Window.orderBy("frame", "x")).cast("long"))
    got = detect.treatment_preview(p, p.withColumn("v", F.col("v") / 2), src)
    return got.select("frame", "id", "ring", "n", r("before"), r("after"))


@query("r02_status_stream", "SELECT date_trunc('hour', ts) AS start, event_type AS status, count(*) AS jobs FROM events GROUP BY 1, 2")
def r02_stream(spark, sf):
    """Events that land as files, counted by hour in a stream that runs until it has read them all."""
    from lumenweave.session import shared_folder
    from lumenweave.streaming import jobs

    folder = shared_folder(spark, "stream")
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    e.repartition(4).write.parquet(f"{folder}/in")
    counted = jobs.windowed_counts(jobs.status_stream(spark, f"{folder}/in", e.schema))

    def keep(batch, number):
        # a window's count comes again when it changes; the last one holds
        batch.select("start", "status", "jobs", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    q = counted.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{folder}/out/*").groupBy("start", "status").agg(F.max_by("jobs", "batch").alias("jobs"))
    return last.withColumn("start", F.col("start").cast("timestamp_ntz"))
