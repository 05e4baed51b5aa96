"""Combining frames: A14-A24, A29-A32, A40, F17-F19, W09-W12, M12-M15, U01-U03, G01-G02."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import scalars as s
from lumenweave.operators import combine, joins, raster, stats
from lumenweave.plans.registry import query, r, snap
from lumenweave.plans.views import pix, pix_nan, table, with_views

P, N = with_views("pix"), with_views("pix_nan")


@query(
    "a14_block_reduce",
    f"""{N} SELECT frame, x // 5 AS bx, y // 5 AS by, CASE WHEN count(*) FILTER (isfinite(v)) = 0 THEN NULL ELSE round(avg(v) FILTER (isfinite(v)), 4) END AS v, round(coalesce(sum(err) FILTER (isfinite(err)), 0), 3) AS wht,
round(sqrt(sum(err * err)) / count(err), 4) AS err, bit_or(dq) AS dq FROM pix_nan WHERE x < 60 AND y < 60 GROUP BY 1, 2, 3""",
)
def a14(spark, sf):
    got = combine.block_reduce(pix_nan(spark, sf).withColumn("wht", F.col("err")), 5, 64, 64)
    return got.select("frame", "bx", "by", F.when(~F.isnan("v"), snap(F.col("v"), 4)).alias("v"), r("wht", digits=3), r("err"), "dq")


@query("a15_downsample", f"{N} SELECT frame, x // 4 AS bx, y // 4 AS by, round(avg(v) FILTER (isfinite(v)), 4) AS v FROM pix_nan GROUP BY 1, 2, 3")
def a15(spark, sf):
    return combine.downsample(pix_nan(spark, sf), 4).select("frame", "bx", "by", F.when(~F.isnan("v"), snap(F.col("v"), 4)).alias("v"))


CXY = "c AS (SELECT frame, x, y, v, err, dq, x * 0.9 + frame * 0.37 AS cx, y * 0.9 + frame * 0.21 AS cy FROM pix_nan WHERE isfinite(v))"


def _placed(spark, sf):
    p = pix_nan(spark, sf).filter(s.finite(F.col("v")))
    return p.withColumns({"cx": F.col("x") * 0.9 + F.col("frame") * 0.37, "cy": F.col("y") * 0.9 + F.col("frame") * 0.21})


SIDE = "greatest(0.0, least(o.{a} + 0.5, c.c{b} + 0.35) - greatest(o.{a} - 0.5, c.c{b} - 0.35))"
SQUARE = f"""{N}, {CXY}, o AS (SELECT c.*, unnest(range(CAST(floor(cx - 0.35 + 0.5) AS BIGINT), CAST(ceil(cx + 0.35 - 0.5) AS BIGINT) + 1)) AS ox FROM c),
o2 AS (SELECT o.*, unnest(range(CAST(floor(cy - 0.35 + 0.5) AS BIGINT), CAST(ceil(cy + 0.35 - 0.5) AS BIGINT) + 1)) AS oy FROM o),
k AS (SELECT *, greatest(0.0, least(ox + 0.5, cx + 0.35) - greatest(ox - 0.5, cx - 0.35)) * greatest(0.0, least(oy + 0.5, cy + 0.35) - greatest(oy - 0.5, cy - 0.35)) / 0.49 AS kw FROM o2),
sq AS (SELECT * FROM k WHERE kw > 1e-9)"""


def _square(spark, sf):
    return combine.scatter(_placed(spark, sf), "square", 0.7).filter("kw > 1e-9")


@query("a16_drizzle_square", f"{SQUARE} SELECT ox, oy, round(sum(v * kw) / sum(kw), 3) AS v, round(sum(kw), 4) AS weight FROM sq GROUP BY 1, 2 HAVING sum(kw) > 1e-3")
def a16(spark, sf):
    got = combine.accumulate(_square(spark, sf), F.col("v"), F.lit(1.0)).filter("weight > 1e-3")
    return got.select("ox", "oy", r("v", digits=3), r("weight"))


@query("f18_drizzle_point", f"{N}, {CXY} SELECT CAST(floor(cx + 0.5) AS BIGINT) AS ox, CAST(floor(cy + 0.5) AS BIGINT) AS oy, round(avg(v), 3) AS v, count(*) AS n FROM c GROUP BY 1, 2")
def f18_point(spark, sf):
    k = combine.scatter(_placed(spark, sf), "point", 0.7)
    return k.groupBy("ox", "oy").agg(r(F.avg("v"), "v", 3), F.count("*").alias("n"))


def _kernel_sql(low: str, high: str, kw: str) -> str:
    span = lambda c: f"unnest(range(CAST({low.format(c=c)} AS BIGINT), CAST({high.format(c=c)} AS BIGINT) + 1))"
    return f"""{N}, {CXY}, o AS (SELECT c.*, {span("cx")} AS ox FROM c), o2 AS (SELECT o.*, {span("cy")} AS oy FROM o),
k AS (SELECT *, {kw} AS kw FROM o2) SELECT ox, oy, count(*) AS n, round(sum(kw), 3) AS weight, round(sum(v * kw), 2) AS total FROM k WHERE abs(kw) > 1e-5 GROUP BY 1, 2"""


def _kernel(spark, sf, kind, drop):
    k = combine.scatter(_placed(spark, sf), kind, drop).filter("abs(kw) > 1e-5")
    return k.groupBy("ox", "oy").agg(F.count("*").alias("n"), r(F.sum("kw"), "weight", 3), r(F.sum(F.col("v") * F.col("kw")), "total", 2))


@query("f18_drizzle_tophat", _kernel_sql("floor({c} - 0.755 + 0.5)", "ceil({c} + 0.755 - 0.5)", "CASE WHEN (ox - cx) * (ox - cx) + (oy - cy) * (oy - cy) <= 0.755 * 0.755 THEN 1.0 ELSE 0.0 END"))
def f18_tophat(spark, sf):
    return _kernel(spark, sf, "tophat", 1.51)


@query(
    "f18_drizzle_gaussian",
    _kernel_sql("floor({c} - 3 * 0.9 / 2.3548 + 0.5)", "ceil({c} + 3 * 0.9 / 2.3548 - 0.5)", "exp(-((ox - cx) * (ox - cx) + (oy - cy) * (oy - cy)) / (2 * (0.9 / 2.3548) * (0.9 / 2.3548)))"),
)
def f18_gaussian(spark, sf):
    return _kernel(spark, sf, "gaussian", 0.9)


SINC = "CASE WHEN abs({d}) < 1e-12 THEN 1.0 ELSE sin(pi() * ({d})) / (pi() * ({d})) END"
LANCZOS = " * ".join(f"({SINC.format(d=d)})" for d in ("ox - cx", "(ox - cx) / 2", "oy - cy", "(oy - cy) / 2"))


@query("f18_drizzle_lanczos2", _kernel_sql("floor({c}) - 1", "floor({c}) + 2", f"CASE WHEN abs(ox - cx) >= 2 OR abs(oy - cy) >= 2 THEN 0 ELSE {LANCZOS} END"))
def f18_lanczos(spark, sf):
    return _kernel(spark, sf, "lanczos2", 1.0)


@query(
    "f18_drizzle_turbo",
    f"""{N}, {CXY}, o AS (SELECT c.*, unnest(range(CAST(floor(cx - 0.3 + 0.5) AS BIGINT), greatest(CAST(floor(cx - 0.3 + 0.5) AS BIGINT), CAST(ceil(cx + 0.3 - 0.5) AS BIGINT)) + 1)) AS ox FROM c),
o2 AS (SELECT o.*, unnest(range(CAST(floor(cy - 0.3 + 0.5) AS BIGINT), greatest(CAST(floor(cy - 0.3 + 0.5) AS BIGINT), CAST(ceil(cy + 0.3 - 0.5) AS BIGINT)) + 1)) AS oy FROM o)
SELECT ox, oy, count(*) AS n FROM o2 WHERE (abs(ox - cx) <= 0.3 AND abs(oy - cy) <= 0.3) OR ((abs(floor(cx + 0.5) - cx) > 0.3 OR abs(floor(cy + 0.5) - cy) > 0.3) AND ox = floor(cx + 0.5) AND oy = floor(cy + 0.5)) GROUP BY 1, 2""",
)
def f18_turbo(spark, sf):
    return combine.scatter(_placed(spark, sf), "turbo", 0.6).groupBy("ox", "oy").agg(F.count("*").alias("n"))


@query("a17_context_bits", f"{SQUARE} SELECT ox, oy, CAST(frame // 32 AS BIGINT) AS plane, CAST(bit_or(1 << (frame % 32)) AS BIGINT) AS bits, CAST(bit_count(CAST(bit_or(1 << (frame % 32)) AS BIGINT)) AS INTEGER) AS n FROM sq GROUP BY 1, 2, 3")
def a17(spark, sf):
    return combine.context(_square(spark, sf)).select("ox", "oy", "plane", "bits", "n")


@query("a18_mask_projection", f"{SQUARE} SELECT ox, oy, bit_or(dq) AS dq FROM sq GROUP BY 1, 2")
def a18(spark, sf):
    return combine.project_mask(_square(spark, sf))


@query(
    "a19_seam_rms",
    f"""{SQUARE}, m AS (SELECT ox, oy, sum(v * kw) / sum(kw) AS m FROM sq GROUP BY 1, 2)
SELECT ox, oy, count(DISTINCT frame) AS inputs, round(sqrt(sum(kw * (v - m) * (v - m)) / sum(kw)), 3) AS rms FROM sq JOIN m USING (ox, oy) GROUP BY 1, 2 HAVING count(DISTINCT frame) >= 2 AND sum(kw) > 1e-3""",
)
def a19(spark, sf):
    k = _square(spark, sf)
    got = combine.seam(k, combine.accumulate(k, F.col("v"), F.lit(1.0)), F.lit(1.0))
    w = k.groupBy("ox", "oy").agg(F.sum("kw").alias("w")).filter("w > 1e-3")
    return got.join(w, ["ox", "oy"]).select("ox", "oy", "inputs", r("rms", digits=3))


@query("a20_sky_plane_mean", f"{SQUARE}, d AS (SELECT DISTINCT ox, oy, frame FROM sq) SELECT ox, oy, round(avg(0.01 * frame * ox - 0.02 * oy + frame), 4) + 0.0 AS sky FROM d GROUP BY 1, 2")
def a20(spark, sf):
    planes = spark.range(8).select(F.col("id").alias("frame"), (F.col("id") * 0.01).alias("a"), F.lit(-0.02).alias("b"), F.col("id").cast("double").alias("c"))
    return combine.plane_mean(_square(spark, sf), planes).select("ox", "oy", r("sky"))


@query("a21_stack", f"{N} SELECT x, y, count(*) AS n, round(median(v), 4) AS v FROM pix_nan WHERE isfinite(v) GROUP BY 1, 2")
def a21(spark, sf):
    return combine.stack(pix_nan(spark, sf), 8).select("x", "y", "n", r("v"))


@query("a21_stack_of_three", f"{N}, t AS (SELECT frame % 3 AS frame, x, y, avg(v) AS v FROM pix_nan WHERE isfinite(v) GROUP BY 1, 2, 3) SELECT x, y, count(*) AS n, round(least(avg(v), median(v)), 4) AS v FROM t GROUP BY 1, 2")
def a21_three(spark, sf):
    t = pix_nan(spark, sf).filter(s.finite(F.col("v"))).groupBy((F.col("frame") % 3).alias("frame"), "x", "y").agg(F.avg("v").alias("v"))
    return combine.stack(t, 3).select("x", "y", "n", r("v"))


MASTER = """bias AS (SELECT x, y, median(v) AS bias FROM pix WHERE frame < 3 GROUP BY 1, 2), raw AS (SELECT x, y, median(v - bias) AS f FROM pix JOIN bias USING (x, y) WHERE frame >= 3 GROUP BY 1, 2),
flat AS (SELECT x, y, CASE WHEN f > 0 THEN f / (SELECT median(f) FROM raw WHERE f > 0) END AS flat FROM raw)"""


@query("a22_master_frames", f"{P}, {MASTER} SELECT x, y, round(bias, 4) AS bias, round(flat, 4) AS flat FROM flat JOIN bias USING (x, y)")
def a22(spark, sf):
    p = pix(spark, sf)
    bias = combine.master_bias(p.filter("frame < 3"))
    flat = combine.master_flat(p.filter("frame >= 3"), bias)
    return flat.join(bias, ["x", "y"]).select("x", "y", r("bias"), F.when(~F.isnan("flat"), snap(F.col("flat"), 4)).alias("flat"))


@query(
    "m25_calibrate",
    f"{P}, {MASTER} SELECT frame, count(*) AS pixels, count(v2) AS good, round(median(v2), 3) AS median FROM (SELECT frame, CASE WHEN flat > 0 THEN (v - coalesce(bias, 0)) / flat END AS v2 FROM pix LEFT JOIN bias USING (x, y) LEFT JOIN flat USING (x, y)) GROUP BY frame",
)
def m25(spark, sf):
    p = pix(spark, sf)
    bias = combine.master_bias(p.filter("frame < 3"))
    got = combine.calibrate(p, bias, combine.master_flat(p.filter("frame >= 3"), bias)).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return got.groupBy("frame").agg(F.count("*").alias("pixels"), F.count("v").alias("good"), r(F.median("v"), "median", 3))


CELLS = f"""{N}, rk AS (SELECT frame, x // 8 AS cx, y // 8 AS cy, v, row_number() OVER (PARTITION BY frame, x // 8, y // 8 ORDER BY y, x) AS k FROM pix_nan WHERE isfinite(v)),
cl AS (SELECT frame, cx, cy, count(*) AS n, median(v) AS value FROM rk WHERE k <= 24 GROUP BY 1, 2, 3 HAVING count(*) >= 8)"""


def _cells(spark, sf):
    return combine.cells(pix_nan(spark, sf), 8, 24, 8)


@query("a23_overlap_cells", f"{CELLS} SELECT frame, cx, cy, n, round(value, 4) AS value FROM cl")
def a23(spark, sf):
    return _cells(spark, sf).select("frame", "cx", "cy", "n", r("value"))


@query("j01_overlap_differences", f"{CELLS} SELECT a.frame AS i, b.frame AS j, a.cx, a.cy, round(b.value - a.value, 4) + 0.0 AS delta FROM cl a JOIN cl b ON a.cx = b.cx AND a.cy = b.cy AND a.frame < b.frame")
def j01(spark, sf):
    return combine.overlap_differences(_cells(spark, sf)).select("i", "j", "cx", "cy", r("delta"))


@query("a24_minimum_sky", f"{CELLS}, s AS (SELECT frame, frame // 2 AS file, median(value) AS sky FROM cl GROUP BY 1) SELECT frame, file, round(min(sky) OVER (PARTITION BY file), 4) AS local_min, round(min(sky) OVER (), 4) AS global_min FROM s")
def a24(spark, sf):
    sky = _cells(spark, sf).groupBy("frame").agg(F.median("value").alias("sky")).withColumn("file", F.floor(F.col("frame") / 2))
    return combine.local_minimum(sky, "file", "sky").select("frame", "file", r("local_min"), r("global_min"))


RGB = """rgb AS (SELECT x, y, coalesce(max(v) FILTER (frame = 0), 0) / 120 AS r, coalesce(max(v) FILTER (frame = 1), 0) / 120 AS g, coalesce(max(v) FILTER (frame = 2), 0) / 120 AS b FROM pix WHERE frame < 3 GROUP BY 1, 2)"""


def _rgb(spark, sf):
    p = pix(spark, sf).filter("frame < 3")
    one = lambda k, n: (F.coalesce(F.max(F.when(F.col("frame") == k, F.col("v"))), F.lit(0.0)) / 120).alias(n)
    return p.groupBy("x", "y").agg(one(0, "r"), one(1, "g"), one(2, "b"))


@query(
    "a29_channel_histograms",
    f"""{P}, {RGB}, l AS (SELECT unnest(['r', 'g', 'b', 'luma']) AS channel, unnest([r, g, b, 0.299 * r + 0.587 * g + 0.114 * b]) AS v FROM rgb)
SELECT channel, CAST(floor(least(1.0, greatest(0.0, v)) * 255) AS INTEGER) AS bin, count(*) AS n FROM l GROUP BY 1, 2""",
)
def a29(spark, sf):
    c = _rgb(spark, sf)
    luma = s.luma601(F.col("r"), F.col("g"), F.col("b"))
    rows = c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), v.alias("v")) for n, v in (("r", F.col("r")), ("g", F.col("g")), ("b", F.col("b")), ("luma", luma))])).alias("p"))
    return rows.groupBy("p.channel", s.to_byte(F.col("p.v")).alias("bin")).agg(F.count("*").alias("n"))


@query("a30_source_peaks", f"{N} SELECT frame, max(v) FILTER (isfinite(v)) AS peak, coalesce(max(v) FILTER (isfinite(v)) > 0, false) AS usable FROM pix_nan GROUP BY frame")
def a30(spark, sf):
    peak = F.max(F.when(s.finite(F.col("v")), F.col("v")))
    return pix_nan(spark, sf).groupBy("frame").agg(peak.alias("peak"), F.coalesce(peak > 0, F.lit(False)).alias("usable"))


@query(
    "a31_weighted_mix",
    f"""{N}, pk AS (SELECT frame, max(v) FILTER (isfinite(v)) AS peak FROM pix_nan GROUP BY frame),
w AS (SELECT x, y, sum(v / peak * (frame % 3) * 0.2) AS r, sum(v / peak * ((frame + 1) % 3) * 0.2) AS g, sum(v / peak * ((frame + 2) % 3) * 0.2) AS b FROM pix_nan JOIN pk USING (frame) WHERE isfinite(v) AND peak > 0 GROUP BY 1, 2)
SELECT x, y, round(r / greatest(1, r, g, b), 4) AS r, round(g / greatest(1, r, g, b), 4) AS g, round(b / greatest(1, r, g, b), 4) AS b FROM w""",
)
def a31(spark, sf):
    weights = spark.range(8).select(F.col("id").alias("frame"), *[((F.col("id") + k) % 3 * 0.2).alias(c) for k, c in enumerate(("wr", "wg", "wb"))])
    from lumenweave.operators.compose import weighted_mix

    return weighted_mix(pix_nan(spark, sf), weights).select("x", "y", r("r"), r("g"), r("b"))


@query("a40_footprint_bounds", f"{P} SELECT frame, round(min(x * 0.9 + y * 0.1 + frame), 4) AS x0, round(max(x * 0.9 + y * 0.1 + frame), 4) AS x1, round(min(y - x * 0.05), 4) + 0.0 AS y0, round(max(y - x * 0.05), 4) AS y1, CAST(ceil(max(x * 0.9 + y * 0.1 + frame) - min(x * 0.9 + y * 0.1 + frame) + 1 - 1e-6) AS BIGINT) AS width FROM pix GROUP BY frame")
def a40(spark, sf):
    mx, my = F.col("x") * 0.9 + F.col("y") * 0.1 + F.col("frame"), F.col("y") - F.col("x") * 0.05
    return pix(spark, sf).groupBy("frame").agg(
        r(F.min(mx), "x0"), r(F.max(mx), "x1"), r(F.min(my), "y0"), r(F.max(my), "y1"), F.ceil(F.max(mx) - F.min(mx) + 1 - 1e-6).alias("width")
    )


@query(
    "f17_bilinear",
    f"""{N}, pts AS (SELECT frame, x AS px0, y AS py0, y * 64 + x AS id, x + 0.3 AS px, y + 0.6 AS py FROM pix_nan),
k AS (SELECT p.frame, p.id, q.v, (CASE WHEN q.x = p.px0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END) * (CASE WHEN q.y = p.py0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END) AS w
FROM pts p JOIN pix_nan q ON q.frame = p.frame AND q.x BETWEEN px0 AND px0 + 1 AND q.y BETWEEN py0 AND py0 + 1 WHERE isfinite(q.v))
SELECT frame, id, round(sum(v * w) / sum(w), 4) AS v FROM pts LEFT JOIN k USING (frame, id) GROUP BY 1, 2""",
)
def f17(spark, sf):
    p = pix_nan(spark, sf)
    pts = p.select("frame", (F.col("y") * 64 + F.col("x")).alias("id"), (F.col("x") + 0.3).alias("px"), (F.col("y") + 0.6).alias("py"))
    return raster.resample(p, pts).select("frame", "id", F.when(~F.isnan("v"), snap(F.col("v"), 4)).alias("v"))


@query(
    "f19_value_weight",
    f"""{P} SELECT frame, round(sum(CASE WHEN frame % 2 = 0 THEN v / (100 + frame) ELSE v END), 3) AS total,
round(sum(CASE WHEN x % 3 = 0 THEN 2.0 WHEN CASE WHEN frame % 2 = 0 THEN err / (100 + frame) ELSE err END > 0 THEN 1 / ((CASE WHEN frame % 2 = 0 THEN err / (100 + frame) ELSE err END) * (CASE WHEN frame % 2 = 0 THEN err / (100 + frame) ELSE err END)) ELSE 1 END), 1) AS weight FROM pix GROUP BY frame""",
)
def f19(spark, sf):
    p = pix(spark, sf).withColumns(
        {"unit": F.when(F.col("frame") % 2 == 0, "counts").otherwise("rate"), "exptime": (F.col("frame") + 100).cast("double"), "wht": F.when(F.col("x") % 3 == 0, 2.0).otherwise(0.0)}
    )
    value, weight = combine.sample_weight("err")
    return p.groupBy("frame").agg(r(F.sum(value), "total", 3), r(F.sum(weight), "weight", 1))


@query(
    "w09_gaussian_blur",
    f"""{N}, k AS (SELECT i, exp(-i * i / 4.5) AS w FROM (SELECT unnest(range(-5, 6)) AS i)), fin AS (SELECT * FROM pix_nan WHERE isfinite(v)),
c AS (SELECT p.frame, p.x, p.y, sum(q.v * a.w * b.w) AS t, sum(a.w * b.w) AS w FROM pix_nan p JOIN fin q ON q.frame = p.frame AND q.x BETWEEN p.x - 5 AND p.x + 5 AND q.y BETWEEN p.y - 5 AND p.y + 5 JOIN k a ON a.i = q.x - p.x JOIN k b ON b.i = q.y - p.y GROUP BY 1, 2, 3)
SELECT frame, x, y, round(t / c.w, 4) AS blurred FROM pix_nan LEFT JOIN c USING (frame, x, y)""",
)
def w09(spark, sf):
    return raster.blur(pix_nan(spark, sf)).select("frame", "x", "y", F.when(~F.isnan("blurred"), snap(F.col("blurred"), 4)).alias("blurred"))


@query("w10_fill_holes")
def w10(spark, sf):
    got = raster.fill_holes(pix_nan(spark, sf), 64, 64)
    return got.filter(~F.isnan("filled")).select("frame", "x", "y", r("filled"))


HIGH = "mask AS (SELECT frame, x, y FROM pix WHERE v > 45)"
FLOOD = f"""WITH RECURSIVE {P[5:]}, {HIGH}, e AS (SELECT a.frame, a.y * 2147483648 + a.x AS u, b.y * 2147483648 + b.x AS v FROM mask a JOIN mask b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT frame, u, u AS l FROM e UNION SELECT r.frame, e.v, r.l FROM reach r JOIN e ON e.frame = r.frame AND e.u = r.u WHERE e.v > r.l),
lb AS (SELECT frame, u, min(l) AS label FROM reach GROUP BY 1, 2)"""


def _labels(spark, sf):
    return raster.label_components(pix(spark, sf).filter("v > 45"), 16)


@query("w11_components")
def w11(spark, sf):
    return _labels(spark, sf)


@query("w12_component_shapes")
def w12(spark, sf):
    return raster.component_shapes(_labels(spark, sf)).select("frame", "label", "area", "width", "height", r("fill"))


@query(
    "m12_cosmic_mask",
    None,
)
def m12(spark, sf):
    p = pix(spark, sf).withColumns({"model": F.lit(38.0) + F.col("x") * 0.01, "noise": F.lit(5.0)})
    return raster.cosmic_mask(p).filter("flag").select("frame", "x", "y", r("excess"))


@query("m13_cosmic_clean")
def m13(spark, sf):
    p = pix_nan(spark, sf)
    levels = stats.background(p, ["frame"]).select("frame", "bg", (F.col("sigma") / 4).alias("sigma"))
    return raster.clean(p, levels, 64, 64).filter("hit").select("frame", "x", "y", r("clean"))


STARS_SQL = """WITH src AS (SELECT user_id % 8 AS frame, event_id AS id, round((value * 13) % 256, 3) AS x, CAST((event_id * 7) % 256 AS DOUBLE) AS y, 1.5 + event_id % 3 AS radius, CAST(1 << (event_id % 5) AS BIGINT) AS bits FROM events),
g AS (SELECT src.*, unnest(range(CAST(ceil(x - radius) AS BIGINT), CAST(floor(x + radius) AS BIGINT) + 1)) AS px FROM src), g2 AS (SELECT g.*, unnest(range(CAST(ceil(y - radius) AS BIGINT), CAST(floor(y + radius) AS BIGINT) + 1)) AS py FROM g),
m AS (SELECT *, sqrt((px - x) * (px - x) + (py - y) * (py - y)) / radius AS t FROM g2), k AS (SELECT *, CASE WHEN t <= 0.65 THEN 1.0 WHEN t <= 1 THEN 0.5 + 0.5 * cos(pi() * (t - 0.65) / 0.35) ELSE 0 END AS mask FROM m)
SELECT frame, px AS x, py AS y, round(max(mask), 4) AS mask, arg_max(id, (mask, -id)) AS label, bit_or(bits) AS bits FROM k WHERE mask > 1e-6 GROUP BY 1, 2, 3"""


@query("m18_star_raster", STARS_SQL)
def m18(spark, sf):
    src = table(spark, sf, "events").select(
        (F.col("user_id") % 8).alias("frame"), F.col("event_id").alias("id"), snap((F.col("value") * 13) % 256, 3).alias("x"),
        ((F.col("event_id") * 7) % 256).cast("double").alias("y"), (F.col("event_id") % 3 + 1.5).cast("double").alias("radius"), F.expr("cast(shiftleft(1, cast(event_id % 5 as int)) as bigint)").alias("bits"),
    )
    return raster.feathered(src).filter("mask > 1e-6").select("frame", "x", "y", r("mask"), "label", "bits")


@query("u01_mask_fold", f"{P}, st AS (SELECT 0 AS frame, x, y, frame AS step, CASE WHEN frame % 3 = 2 THEN 'erase' ELSE 'add' END AS op FROM pix WHERE (x + frame) % 3 = 0), lst AS (SELECT x, y, arg_max(op, step) AS op FROM st GROUP BY 1, 2) SELECT CAST(0 AS BIGINT) AS frame, x, y FROM lst WHERE op = 'add'")
def u01(spark, sf):
    st = pix(spark, sf).filter((F.col("x") + F.col("frame")) % 3 == 0)
    st = st.select(F.lit(0).cast("long").alias("frame"), "x", "y", F.col("frame").alias("step"), F.when(F.col("frame") % 3 == 2, "erase").otherwise("add").alias("op"))
    return raster.fold_masks(st)


@query("u02_mask_or", f"{P} SELECT x, y, bool_or(v > 50) AS masked FROM pix GROUP BY 1, 2")
def u02(spark, sf):
    return pix(spark, sf).groupBy("x", "y").agg(F.bool_or(F.col("v") > 50).alias("masked"))


@query("u03_shared_seed", f"{P} SELECT x, y, count(*) AS channels FROM pix WHERE v > 42 GROUP BY 1, 2 HAVING count(*) >= 2")
def u03(spark, sf):
    return pix(spark, sf).filter("v > 42").groupBy("x", "y").agg(F.count("*").alias("channels")).filter("channels >= 2")


@query("g01_rasterise", f"{P} SELECT frame, x, y FROM pix WHERE (x BETWEEN 10 AND 20 AND y BETWEEN 5 AND 9) OR (x - 40) * (x - 40) + (y - 40) * (y - 40) <= 49 OR (x >= 30 AND y >= 10 AND x + y <= 60) OR v > 70")
def g01(spark, sf):
    x, y = F.col("x"), F.col("y")
    return pix(spark, sf).filter((x.between(10, 20) & y.between(5, 9)) | ((x - 40) * (x - 40) + (y - 40) * (y - 40) <= 49) | ((x >= 30) & (y >= 10) & (x + y <= 60)) | (F.col("v") > 70)).select("frame", "x", "y")


DISC = "d AS (SELECT i, j FROM (SELECT unnest(range(-2, 3)) AS i) CROSS JOIN (SELECT unnest(range(-2, 3)) AS j) WHERE i * i + j * j <= 4)"


@query("g02_dilate", f"{P}, {HIGH}, {DISC} SELECT DISTINCT frame, x + i AS x, y + j AS y FROM mask CROSS JOIN d WHERE x + i BETWEEN 0 AND 63 AND y + j BETWEEN 0 AND 63")
def g02_dilate(spark, sf):
    return raster.dilate(pix(spark, sf).filter("v > 45"), 2, 64, 64)


@query("g02_erode", f"{P}, m AS (SELECT frame, x, y FROM pix WHERE v > 25), {DISC} SELECT frame, x + i AS x, y + j AS y FROM m CROSS JOIN d GROUP BY 1, 2, 3 HAVING count(*) = 13")
def g02_erode(spark, sf):
    return raster.erode(pix(spark, sf).filter("v > 25"), 2)


@query(
    "t03_suppression",
    f"""{P}, c AS (SELECT frame, x, y, v FROM pix WHERE v > 42) SELECT a.frame, a.x, a.y, a.v FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.frame = a.frame AND abs(b.x - a.x) <= 3 AND abs(b.y - a.y) <= 3
AND (b.v > a.v OR (b.v = a.v AND (b.y < a.y OR (b.y = a.y AND b.x < a.x)))))""",
)
def t03(spark, sf):
    return raster.suppress(pix(spark, sf).filter("v > 42"), 3)


@query("p14_away_from_missing", """WITH s AS (SELECT user_id % 8 AS frame, event_id AS star, CAST(floor(value) AS BIGINT) % 64 AS x, event_id % 64 AS y FROM events) SELECT frame, star FROM s WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(-1, 2)) AS i) a CROSS JOIN (SELECT unnest(range(-1, 2)) AS j) b WHERE ((s.x + i) * 7 + s.y + j) % 31 = 0)""")
def p14(spark, sf):
    st = table(spark, sf, "events").select((F.col("user_id") % 8).alias("frame"), F.col("event_id").alias("star"), (F.floor("value") % 64).alias("x"), (F.col("event_id") % 64).alias("y"))
    off = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    near = st.withColumn("i", off).withColumn("j", off).filter(((F.col("x") + F.col("i")) * 7 + F.col("y") + F.col("j")) % 31 == 0)
    return st.join(near.select("star").distinct(), "star", "left_anti").select("frame", "star")


@query("p03_finite_samples", f"{N} SELECT frame, count(*) FILTER (isfinite(v)) AS finite, count(*) FILTER (isnan(v)) AS missing FROM pix_nan GROUP BY frame")
def p03(spark, sf):
    v = F.col("v")
    return pix_nan(spark, sf).groupBy("frame").agg(F.count_if(s.finite(v)).alias("finite"), F.count_if(F.isnan(v)).alias("missing"))


@query(
    "g03_mask_to_detector",
    f"""{P}, m AS (SELECT a.range AS mx, b.range AS my FROM range(30, 34) a CROSS JOIN range(20, 23) b) SELECT DISTINCT frame, x, y FROM pix JOIN m ON abs(x + 1.5 * frame - mx) < 1 AND abs(y - 0.75 * frame - my) < 1
WHERE (x + 1.5 * frame - mx) * (x + 1.5 * frame - mx) + (y - 0.75 * frame - my) * (y - 0.75 * frame - my) <= 0.36 + 1e-12""",
)
def g03(spark, sf):
    mask = spark.range(12).select((F.col("id") % 4 + 30).alias("x"), (F.floor(F.col("id") / 4) + 20).alias("y"))
    maps = {k: s.Affine(c=1.5 * k, f=-0.75 * k) for k in range(8)}
    return raster.project_mask_back(pix(spark, sf), mask, maps, 0.6 + 1e-13)


@query(
    "g04_footprints",
    f"""{P}, f AS (SELECT DISTINCT frame FROM pix), c AS (SELECT * FROM (VALUES (0, 0, 0), (1, 63, 0), (2, 63, 63), (3, 0, 63)) t(corner, cx, cy))
SELECT frame, corner, round(0.9 * cx - 0.1 * cy + 10 * frame, 4) AS x, round(0.1 * cx + 0.9 * cy - 2 * frame, 4) AS y FROM f CROSS JOIN c""",
)
def g04(spark, sf):
    maps = {k: s.Affine(0.9, -0.1, 10.0 * k, 0.1, 0.9, -2.0 * k) for k in range(8)}
    f = pix(spark, sf).select("frame").distinct().withColumns({"width": F.lit(64), "height": F.lit(64)})
    return raster.footprints(f, maps).select("frame", F.posexplode("polygon").alias("corner", "p")).select("frame", "corner", r("p.x", "x"), r("p.y", "y"))


@query("m14_channel_clean")
def m14(spark, sf):
    p = pix_nan(spark, sf).cache()  # read by the levels, the star mask and the cleaning
    levels = stats.background(p, ["frame"]).select("frame", "bg", (F.col("sigma") / 4).alias("sigma"))
    return raster.clean_channels(p, levels, 64, 64, 64, seed_sigmas=8.0, grow_sigmas=6.0).filter("hit").select("frame", "x", "y", r("clean"))


@query("u03_shared_star_mask")
def u03_mask(spark, sf):
    p = pix(spark, sf).cache()  # read by the levels and the mask
    levels = stats.background(p, ["frame"]).select("frame", "bg", (F.col("sigma") / 4).alias("sigma"))
    return raster.shared_star_mask(p, levels, 64, 64).select("x", "y")
