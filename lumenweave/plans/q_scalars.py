"""Scalar functions on pixels: F01-F12, F25, F27, F28, F31, F32, P15, P16."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenweave.functions import scalars as s
from lumenweave.plans.registry import query, r
from lumenweave.plans.views import pix, stars, table, with_views

P, S = with_views("pix"), with_views("stars")
U = "(v / 110)"


@query("f01_raw_stretch", f"{P} SELECT frame, x, y, round(ln(1 + 9 * {U}) / ln(10), 5) AS log, round(asinh(10 * {U}) / asinh(10), 5) AS asinh, round(sqrt({U}), 5) AS sqrt FROM pix")
def f01(spark, sf):
    u = F.col("v") / 110
    return pix(spark, sf).select("frame", "x", "y", *[r(s.raw_stretch(u, m), m.lower(), 5) for m in ("Log", "Asinh", "Sqrt")])


X = "greatest(0.0, (v - 20) * (100 / 70.0))"


@query(
    "f02_stretch",
    f"""{P} SELECT frame, x, y, round({X} / 100, 5) AS linear, round(ln(1 + {X}) / ln(101), 5) AS log, round(sqrt({X}) / 10, 5) AS sqrt, round(asinh({X} / 2) / asinh(50), 5) AS asinh,
round(CASE WHEN {X} <= 0 THEN 0 WHEN {X} >= 100 THEN 1 ELSE (0.25 - 1) * ({X} / 100) / ((2 * 0.25 - 1) * ({X} / 100) - 0.25) END, 5) AS mtf FROM pix""",
)
def f02(spark, sf):
    at = lambda m: r(s.stretch(F.col("v"), s.Stretch(m, 20.0, 90.0, 100.0, 2.0)), m.lower(), 5)
    return pix(spark, sf).select("frame", "x", "y", *[at(m) for m in ("Linear", "Log", "Sqrt", "Asinh", "MTF")])


@query("f03_midtones", f"{P} SELECT frame, x, y, round(CASE WHEN {U} >= 1 THEN 1 ELSE (0.1 - 1) * {U} / ((2 * 0.1 - 1) * {U} - 0.1) END, 5) AS m FROM pix")
def f03(spark, sf):
    return pix(spark, sf).select("frame", "x", "y", r(s.midtones(F.col("v") / 110, 0.1), "m", 5))


def _ghs(d: float, sp: float) -> str:
    low = math.exp(-d * sp)
    end = 2 - math.exp(-d * (1 - sp))
    return f"CASE WHEN {U} < {sp} THEN (exp({-d * sp!r} + {d} * {U}) - {low!r}) / {end - low!r} ELSE (2 - exp({d * sp!r} - {d} * {U}) - {low!r}) / {end - low!r} END"


@query("f04_hyperbolic", f"{P} SELECT frame, x, y, round({_ghs(3.0, 0.2)}, 5) AS g FROM pix WHERE {U} < 1")
def f04(spark, sf):
    u = F.col("v") / 110
    return pix(spark, sf).filter(u < 1).select("frame", "x", "y", r(s.hyperbolic(u, s.Stretch(d=3.0, symmetry=0.2)), "g", 5))


GHS_B = {
    "positive": (1.5, "1 - power(1 + 3.0 * 1.5 * {u}, -1 / 1.5)"),
    "negative": (-1.4, "(power(1 + 3.0 * 1.4 * {u}, 0.4 / 1.4) - 1) / 0.4"),
}


def _ghs_b(kind: str) -> str:
    rise = GHS_B[kind][1]
    at0, at1 = rise.format(u="0.2"), rise.format(u="0.8")
    return f"(CASE WHEN {U} < 0.2 THEN -1 ELSE 1 END * ({rise.format(u=f'abs({U} - 0.2)')}) + {at0}) / ({at1} + {at0})"


@query("f04_hyperbolic_local", f"{P} SELECT frame, x, y, round({_ghs_b('positive')}, 5) AS positive, round({_ghs_b('negative')}, 5) AS negative FROM pix WHERE {U} < 1")
def f04_local(spark, sf):
    u = F.col("v") / 110
    return pix(spark, sf).filter(u < 1).select("frame", "x", "y", *[r(s.hyperbolic(u, s.Stretch(d=3.0, b=b, symmetry=0.2)), k, 5) for k, (b, _) in GHS_B.items()])


@query("f05_mode_names", "SELECT CASE lower(trim(m)) WHEN 'log' THEN 'Log' WHEN 'sqrt' THEN 'Sqrt' WHEN 'asinh' THEN 'Asinh' WHEN 'histeq' THEN 'HistEq' WHEN 'mtf' THEN 'MTF' WHEN 'ghs' THEN 'GHS' ELSE 'Linear' END AS mode, count(*) AS n FROM (SELECT [' log', 'SQRT', 'asinH', 'other', 'mtf ', 'Ghs', 'histeq', ''][l_orderkey % 8 + 1] AS m FROM lineitem) GROUP BY 1")
def f05(spark, sf):
    names = F.array(*[F.lit(k) for k in (" log", "SQRT", "asinH", "other", "mtf ", "Ghs", "histeq", "")])
    return table(spark, sf, "lineitem").groupBy(s.mode_name(F.element_at(names, (F.col("l_orderkey") % 8 + 1).cast("int"))).alias("mode")).agg(F.count("*").alias("n"))


@query("f06_quantise", f"{P} SELECT frame, x, y, CAST(floor(least(1.0, v / 90) * 255) AS INTEGER) AS cut, CAST(floor(least(1.0, v / 90) * 255 + 0.5) AS INTEGER) AS rounded, CAST(floor(least(1.0, v / 90) * 65535) AS INTEGER) AS wide FROM pix")
def f06(spark, sf):
    u = F.col("v") / 90
    return pix(spark, sf).select("frame", "x", "y", s.to_byte(u).alias("cut"), s.to_byte(u, True).alias("rounded"), s.to_uint16(u).alias("wide"))


@query("f07_rgb_levels", f"{P} SELECT frame, x, y, round(least(1.0, greatest(0.0, ({U} * 255 - 30) / 170)), 5) AS level FROM pix")
def f07(spark, sf):
    return pix(spark, sf).select("frame", "x", "y", r(s.rgb_level(F.col("v") / 110, 30, 200), "level", 5))


@query("f08_gamma_lut", f"{P} SELECT frame, x, y, CAST(floor(pow(floor(least(1.0, {U}) * 255) / 255, 1 / 2.2) * 255 + 0.5) AS INTEGER) AS value FROM pix")
def f08(spark, sf):
    lut = F.array(*[F.lit(int(math.floor((k / 255) ** (1 / 2.2) * 255 + 0.5))) for k in range(256)])
    return pix(spark, sf).select("frame", "x", "y", F.element_at(lut, s.to_byte(F.col("v") / 110) + 1).alias("value"))


@query("f09_screen_blend", f"{P} SELECT frame, x, y, round(least(1.0, {U} + 0.4 * 0.8 * (x / 63.0) - {U} * 0.4 * 0.8 * (x / 63.0)), 5) AS v FROM pix")
def f09(spark, sf):
    return pix(spark, sf).select("frame", "x", "y", r(s.screen(F.col("v") / 110, F.col("x") / 63, 0.4, 0.8), "v", 5))


L = "(1 + 0.7 * (((x + y) / 126.0) / greatest(0.2126 * r + 0.7152 * g + 0.0722 * b, 1e-6) - 1))"


@query("f10_luminance", f"{P}, c AS (SELECT frame, x, y, {U} AS r, {U} * 0.8 AS g, {U} * 0.5 AS b FROM pix) SELECT frame, x, y, " + ", ".join(f"round(least(1.0, greatest(0.0, {k} * {L})), 5) AS {k}" for k in "rgb") + " FROM c")
def f10(spark, sf):
    u = F.col("v") / 110
    out = s.inject_luminance(u, u * 0.8, u * 0.5, (F.col("x") + F.col("y")) / 126, 0.7)
    return pix(spark, sf).select("frame", "x", "y", *[r(c, k, 5) for c, k in zip(out, "rgb")])


C, SN = 1.1 * math.cos(math.radians(30)), 1.1 * math.sin(math.radians(30))


@query(
    "f11_affine",
    f"{S} SELECT star, round({C!r} * x - {SN!r} * y + {128 - C * 128 + SN * 128!r}, 4) AS u, round({SN!r} * x + {C!r} * y + {128 - SN * 128 - C * 128!r}, 4) AS v, x AS back_x, y AS back_y, CAST(30 AS DOUBLE) AS degrees, CAST(1.1 AS DOUBLE) AS scale FROM stars",
)
def f11(spark, sf):
    m = s.Affine.about(128, 128, 30, 1.1)
    u, v = m.apply(F.col("x"), F.col("y"))
    bx, by = m.then(m.inverse()).apply(F.col("x"), F.col("y"))
    degrees, scale = m.summary()
    return stars(spark, sf).select("star", r(u, "u"), r(v, "v"), F.round(bx, 3).alias("back_x"), F.round(by, 3).alias("back_y"), F.lit(round(degrees, 6)).alias("degrees"), F.lit(round(scale, 6)).alias("scale"))


CRPIX, CRVAL, CD = (128.0, 128.0), (150.0, 2.2), (-1e-4, 2e-5, 2e-5, 1e-4)
D0 = math.radians(CRVAL[1])
XI, ETA = "radians(-1e-4 * (x - 128) + 2e-5 * (y - 128))", "radians(2e-5 * (x - 128) + 1e-4 * (y - 128))"
DEN = f"({math.cos(D0)!r} - {ETA} * {math.sin(D0)!r})"


@query(
    "f12_pixel_to_sky",
    f"{S} SELECT star, round(150 + degrees(atan2({XI}, {DEN})), 7) AS ra, round(degrees(atan2({math.sin(D0)!r} + {ETA} * {math.cos(D0)!r}, sqrt({XI} * {XI} + {DEN} * {DEN}))), 7) AS dec, x AS back_x, y AS back_y FROM stars",
)
def f12(spark, sf):
    ra, dec = s.tan_to_sky(F.col("x"), F.col("y"), CRPIX, CRVAL, CD)
    bx, by = s.sky_to_tan(ra, dec, CRPIX, CRVAL, CD)
    return stars(spark, sf).select("star", r(ra, "ra", 7), r(dec, "dec", 7), F.round(bx, 3).alias("back_x"), F.round(by, 3).alias("back_y"))


@query("f13_sip", f"{S} SELECT star, round((x - 128) + 1e-5 * (x - 128) * (x - 128) + 2e-6 * (x - 128) * (y - 128), 5) + 0.0 AS u, round((y - 128) - 1e-5 * (y - 128) * (y - 128), 5) + 0.0 AS v, round(x - 128, 4) + 0.0 AS back_u, round(y - 128, 4) + 0.0 AS back_v FROM stars")
def f13(spark, sf):
    a, b = {(2, 0): 1e-5, (1, 1): 2e-6}, {(0, 2): -1e-5}
    u, v = F.col("x") - 128, F.col("y") - 128
    du, dv = u + s.polynomial(u, v, a), v + s.polynomial(u, v, b)
    bu, bv = s.sip_inverse(du, dv, a, b)
    return stars(spark, sf).select("star", r(du, "u", 5), r(dv, "v", 5), r(bu, "back_u"), r(bv, "back_v"))


@query("f25_plate_scale", f"{S} SELECT star, round(sqrt(abs(-1e-4 * (1 + area / 1000.0) * 1e-4 - 2e-5 * 2e-5)) * 3600, 6) AS scale FROM stars")
def f25(spark, sf):
    scale = s.plate_scale(F.lit(-1e-4) * (1 + F.col("area") / 1000), F.lit(2e-5), F.lit(2e-5), F.lit(1e-4))
    return stars(spark, sf).select("star", r(scale, "scale", 6))


@query("f27_rotate_crop", f"{P} SELECT frame, 63 - y - 10 AS x, x - 5 AS y, v FROM pix WHERE 63 - y BETWEEN 10 AND 49 AND x BETWEEN 5 AND 44")
def f27(spark, sf):
    turned = pix(spark, sf).select("frame", (63 - F.col("y")).alias("x"), F.col("x").alias("y"), "v")
    return turned.filter(F.col("x").between(10, 49) & F.col("y").between(5, 44)).select("frame", (F.col("x") - 10).alias("x"), (F.col("y") - 5).alias("y"), "v")


@query("f28_cell_key", f"{S} SELECT star, CAST(floor(x / 32) AS BIGINT) * 4294967296 + CAST(floor(y / 32) AS BIGINT) AS key, CAST(floor(x / 32) AS BIGINT) AS ix, CAST(floor(y / 32) AS BIGINT) AS iy FROM stars")
def f28(spark, sf):
    ix, iy = F.floor(F.col("x") / 32), F.floor(F.col("y") / 32)
    k = stars(spark, sf).select("star", F.shiftleft(ix, 32).bitwiseOR(iy).alias("key"))
    return k.select("star", "key", F.shiftright("key", 32).alias("ix"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("iy"))


@query(
    "f31_stretch_match",
    f"""{P}, q AS (SELECT frame, median(v) AS m, quantile_cont(v, 0.998) AS h FROM pix GROUP BY frame), a AS (SELECT m AS m0, h AS h0 FROM q WHERE frame = 0)
SELECT frame, round(m - (h - m) / nullif(h0 - m0, 0) * m0, 4) AS background, round(m - (h - m) / nullif(h0 - m0, 0) * m0 + (h - m) / nullif(h0 - m0, 0) * 100, 3) AS peak FROM q CROSS JOIN a""",
)
def f31(spark, sf):
    q = pix(spark, sf).groupBy("frame").agg(F.median("v").alias("m"), F.percentile("v", 0.998).alias("h"))
    a = q.filter("frame = 0").select(F.col("m").alias("m0"), F.col("h").alias("h0"))
    gain = (F.col("h") - F.col("m")) / F.nullif(F.col("h0") - F.col("m0"), F.lit(0.0))
    bg = F.col("m") - gain * F.col("m0")
    return q.crossJoin(F.broadcast(a)).select("frame", r(bg, "background"), r(bg + gain * 100, "peak", 3))


@query(
    "f32_speck_classes",
    f"{P}, c AS (SELECT x, y, coalesce(max(v) FILTER (frame = 0), 0) AS r, coalesce(max(v) FILTER (frame = 1), 0) AS g, coalesce(max(v) FILTER (frame = 2), 0) AS b FROM pix WHERE frame < 3 GROUP BY 1, 2) SELECT CASE WHEN r > 1.5 * greatest(g, b) AND r - greatest(g, b) > 8 THEN 'red' WHEN g > 1.5 * greatest(r, b) AND g - greatest(r, b) > 8 THEN 'green' WHEN b > 1.5 * greatest(r, g) AND b - greatest(r, g) > 8 THEN 'blue' WHEN greatest(r, g, b) < 12 THEN 'dark' ELSE '' END AS class, count(*) AS n FROM c GROUP BY 1",
)
def f32(spark, sf):
    from lumenweave.plans.q_combine import _rgb

    c = _rgb(spark, sf).select(*[(F.col(k) * 120).alias(k) for k in "rgb"])
    over = lambda a, b, d: (F.col(a) > 1.5 * F.greatest(b, d)) & (F.col(a) - F.greatest(b, d) > 8)
    kind = F.when(over("r", "g", "b"), "red").when(over("g", "r", "b"), "green").when(over("b", "r", "g"), "blue").when(F.greatest("r", "g", "b") < 12, "dark").otherwise("")
    return c.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("p15_accepted_sources", f"{S}, t AS (SELECT star, CASE star % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE '' END AS override, CASE WHEN area > 10 THEN 'accepted' ELSE 'uncertain' END AS status FROM stars) SELECT star FROM t WHERE override = 'accept' OR (override <> 'reject' AND status = 'accepted')")
def p15(spark, sf):
    k = F.col("star") % 5
    override, status = F.when(k == 0, "accept").when(k == 1, "reject").otherwise(""), F.when(F.col("area") > 10, "accepted").otherwise("uncertain")
    return stars(spark, sf).filter((override == "accept") | ((override != "reject") & (status == "accepted"))).select("star")


@query("p16_padding", f"{P} SELECT frame, count(*) AS valid FROM (SELECT frame, CASE WHEN (x + y) % 13 = 0 THEN 0 ELSE v END AS v FROM pix) WHERE v <> 0 AND isfinite(v) GROUP BY frame")
def p16(spark, sf):
    p = pix(spark, sf).withColumn("v", F.when((F.col("x") + F.col("y")) % 13 == 0, 0.0).otherwise(F.col("v")))
    return p.filter((F.col("v") != 0) & s.finite(F.col("v"))).groupBy("frame").agg(F.count("*").alias("valid"))
