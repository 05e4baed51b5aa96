"""Statistics by frame: A01-A13, A37-A39, A41, P03-P08."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import scalars as s
from lumenweave.operators import stats
from lumenweave.plans.registry import query, r
from lumenweave.plans.views import pix, pix_nan, with_views

V = with_views("pix_nan")
FIN = "fin AS (SELECT * FROM pix_nan WHERE isfinite(v))"


@query(
    "a01_stats_histogram",
    f"""{V}, {FIN}, s AS (SELECT frame, count(*) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_pop(v) AS std FROM fin GROUP BY frame),
h AS (SELECT frame, CAST(floor(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END * 255) AS INTEGER) AS bin, count(*) AS bin_n FROM fin JOIN s USING (frame) GROUP BY 1, 2)
SELECT frame, bin, bin_n, n, round(lo, 4) AS lo, round(hi, 4) AS hi, round(mean, 4) AS mean, round(std, 4) AS std FROM h JOIN s USING (frame)""",
)
def a01(spark, sf):
    p = pix_nan(spark, sf)
    h = stats.histogram(p, ["frame"]).select("frame", "bin", F.col("n").alias("bin_n"))
    return h.join(stats.basic(p, ["frame"]), "frame").select("frame", "bin", "bin_n", "n", r("lo"), r("hi"), r("mean"), r("std"))


@query(
    "a02_histogram_percentile",
    f"""{V}, {FIN}, s AS (SELECT frame, count(*) AS t, min(v) AS lo, max(v) AS hi FROM fin GROUP BY frame),
h AS (SELECT frame, CAST(floor(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END * 255) AS INTEGER) AS bin, count(*) AS n FROM fin JOIN s USING (frame) GROUP BY 1, 2),
c AS (SELECT frame, bin, sum(n) OVER (PARTITION BY frame ORDER BY bin) AS run FROM h)
SELECT frame, round(lo + min(bin) FILTER (run >= ceil(t * CAST(1 AS DOUBLE) / 100)) / 255 * (hi - lo), 4) AS low, round(lo + min(bin) FILTER (run >= ceil(t * CAST(99.5 AS DOUBLE) / 100)) / 255 * (hi - lo), 4) AS high
FROM c JOIN s USING (frame) GROUP BY frame, lo, hi""",
)
def a02(spark, sf):
    got = stats.histogram_percentile(stats.histogram(pix_nan(spark, sf), ["frame"]), ["frame"], {"low": 1.0, "high": 99.5})
    return got.select("frame", r("low"), r("high"))


@query("a03_percentiles", f"{V}, {FIN} SELECT frame, round(quantile_cont(v, 0.05), 4) AS p5, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.998), 4) AS p998 FROM fin GROUP BY frame")
def a03(spark, sf):
    p = pix_nan(spark, sf).filter(s.finite(F.col("v")))
    got = stats.quantiles(p, ["frame"], F.col("v"), {n: stats.linear(q) for n, q in (("p5", 0.05), ("p50", 0.5), ("p998", 0.998))})
    return got.select("frame", r("p5"), r("p50"), r("p998"))


@query(
    "a04_medians",
    f"{V}, {FIN} SELECT frame, round(median(v), 4) AS middle, round(list_sort(list(v))[count(*) // 2 + 1], 4) AS upper FROM fin GROUP BY frame",
)
def a04(spark, sf):
    p = pix_nan(spark, sf).filter(s.finite(F.col("v")))
    got = stats.quantiles(p, ["frame"], F.col("v"), {"middle": stats.linear(0.5), "upper": stats.upper_middle()})
    return got.select("frame", r("middle"), r("upper"))


@query("a05_order_statistic", f"{V}, {FIN} SELECT frame, v AS value FROM (SELECT frame, v, row_number() OVER (PARTITION BY frame ORDER BY v) AS k FROM fin) WHERE k = 11")
def a05(spark, sf):
    return stats.order_statistic(pix_nan(spark, sf), ["frame"], 10)


def _clip_sql(low: float, high: float, rounds: int, source: str = "fin") -> str:
    out = [f"b0 AS (SELECT frame, CAST('-inf' AS DOUBLE) AS lo, CAST('inf' AS DOUBLE) AS hi FROM {source} GROUP BY frame)"]
    for k in range(1, rounds + 1):
        out.append(
            f"b{k} AS (SELECT frame, CASE WHEN s > 0 THEN greatest(lo, m - {low} * s) ELSE lo END AS lo, CASE WHEN s > 0 THEN least(hi, m + {high} * s) ELSE hi END AS hi"
            f" FROM (SELECT frame, lo, hi, avg(v) AS m, stddev_pop(v) AS s FROM {source} JOIN b{k - 1} USING (frame) WHERE v BETWEEN lo AND hi GROUP BY frame, lo, hi))"
        )
    out.append(f"kept AS (SELECT f.* FROM {source} f JOIN b{rounds} USING (frame) WHERE v BETWEEN lo AND hi)")
    return ", ".join(out)


@query("a06_sigma_clip", f"{V}, {FIN}, {_clip_sql(1.5, 1.5, 5)} SELECT frame, count(*) AS kept, round(avg(v), 4) AS mean, round(min(v), 4) AS lo, round(max(v), 4) AS hi FROM kept GROUP BY frame")
def a06(spark, sf):
    kept = stats.clipped(pix_nan(spark, sf), ["frame"], low=1.5, high=1.5).drop("lo", "hi")
    return kept.groupBy("frame").agg(F.count("*").alias("kept"), r(F.avg("v"), "mean"), r(F.min("v"), "lo"), r(F.max("v"), "hi"))


MODE = """span AS (SELECT frame, min(v) AS lo0, stddev_pop(v) * 0.1 AS w FROM kept GROUP BY frame),
bins AS (SELECT frame, lo0, w, floor((v - lo0) / w) AS b, count(*) AS n FROM kept JOIN span USING (frame) GROUP BY ALL),
mode AS (SELECT frame, lo0 + (arg_max(b, n * 1000000.0 - b) + 0.5) * w AS mode FROM bins GROUP BY frame, lo0, w)"""


@query(
    "a07_sky_statistics",
    f"{V}, {FIN}, {_clip_sql(4, 4, 5)}, {MODE} SELECT frame, count(*) AS kept, round(median(v), 4) AS median, round(avg(v), 4) AS mean, round(mode, 3) AS mode FROM kept JOIN mode USING (frame) GROUP BY frame, mode",
)
def a07(spark, sf):
    return stats.sky(pix_nan(spark, sf), ["frame"]).select("frame", "kept", r("median"), r("mean"), r("mode", digits=3))


@query("a08_mode", f"{V}, kept AS (SELECT * FROM pix_nan WHERE isfinite(v)), {MODE} SELECT frame, round(mode, 3) AS mode FROM mode")
def a08(spark, sf):
    return stats.mode(pix_nan(spark, sf).filter(s.finite(F.col("v"))), ["frame"]).select("frame", r("mode", digits=3))


@query(
    "a09_robust_sigma",
    f"{V}, {FIN}, m AS (SELECT frame, median(v) AS median FROM fin GROUP BY frame) SELECT frame, round(median, 4) AS median, round(1.4826 * median(abs(v - median)), 3) AS sigma FROM fin JOIN m USING (frame) GROUP BY frame, median",
)
def a09(spark, sf):
    return stats.robust_sigma(pix_nan(spark, sf), ["frame"]).select("frame", r("median"), r("sigma", digits=3))


BG = """m AS (SELECT frame, list_sort(list(v))[count(*) // 2 + 1] AS bg FROM kept GROUP BY frame),
background AS (SELECT frame, bg, greatest(1.0, 1.4826 * list_sort(list(abs(v - bg)))[count(*) // 2 + 1]) AS sigma FROM kept JOIN m USING (frame) GROUP BY frame, bg)"""


@query("a10_background", f"{V}, {FIN}, {_clip_sql(3, 3, 3)}, {BG} SELECT frame, round(bg, 4) AS bg, round(sigma, 3) AS sigma FROM background")
def a10(spark, sf):
    return stats.background(pix_nan(spark, sf), ["frame"]).select("frame", r("bg"), r("sigma", digits=3))


@query(
    "a11_smart_levels",
    f"""{V}, {FIN}, {_clip_sql(3, 3, 3)}, {BG}, q AS (SELECT frame, quantile_cont(v, 0.001) AS a, quantile_cont(v, 0.0001) AS b, quantile_cont(v, 0.998) AS c, quantile_cont(v, 0.999) AS d, quantile_cont(v, 0.995) AS e FROM fin GROUP BY frame),
l AS (SELECT *, CASE WHEN bg - 0.5 * sigma < a THEN a ELSE bg - 0.5 * sigma END AS low FROM background JOIN q USING (frame))
SELECT frame, round(CASE WHEN low >= bg THEN b ELSE low END, 3) AS black, round(CASE WHEN c > bg THEN c WHEN d > bg THEN d WHEN e > bg THEN e ELSE bg + 1 END, 3) AS white FROM l""",
)
def a11(spark, sf):
    return stats.smart_levels(pix_nan(spark, sf), ["frame"]).select("frame", r("black", digits=3), r("white", digits=3))


@query("a12_auto_levels", f"{V}, {FIN} SELECT frame, min(v) AS lo, CASE WHEN max(v) > min(v) THEN max(v) ELSE min(v) + 1 END AS hi FROM fin GROUP BY frame")
def a12(spark, sf):
    return stats.auto_levels(pix_nan(spark, sf), ["frame"])


@query(
    "a13_magic_levels",
    f"""{V}, fin AS (SELECT *, (x + y) % 9 = 0 AS star FROM pix_nan WHERE isfinite(v) AND v <> 0), {_clip_sql(3, 3, 3)}, {BG},
t AS (SELECT frame, count(*) AS valid, quantile_cont(v, 0.001) AS black, count(*) FILTER (NOT star AND v >= bg + 2.5 * sigma) AS nd, count(*) FILTER (NOT star) AS np,
quantile_cont(v, 0.999) FILTER (NOT star AND v >= bg + 2.5 * sigma) AS wd, quantile_cont(v, 0.999) FILTER (NOT star) AS wp, quantile_cont(v, 0.999) AS wa FROM fin JOIN background USING (frame) GROUP BY frame),
l AS (SELECT frame, valid, black, CASE WHEN nd >= 0.005 * valid THEN 'diffuse' WHEN np >= 0.005 * valid THEN 'nonstar' ELSE 'all' END AS population, wd, wp, wa FROM t),
w AS (SELECT *, black + (CASE population WHEN 'diffuse' THEN wd WHEN 'nonstar' THEN wp ELSE wa END - black) * 1.05 AS white FROM l)
SELECT frame, valid, population, round(black, 3) AS black, round(white, 3) AS white, round(count(*) FILTER (v < black) / count(*), 6) AS below, round(count(*) FILTER (v > white) / count(*), 6) AS above
FROM fin JOIN w USING (frame) GROUP BY frame, valid, population, black, white""",
)
def a13(spark, sf):
    p = pix_nan(spark, sf).withColumn("star", (F.col("x") + F.col("y")) % 9 == 0)
    got = stats.magic_levels(p, ["frame"])
    return got.select("frame", "valid", "population", r("black", digits=3), r("white", digits=3), r("below", digits=6), r("above", digits=6))


@query(
    "a37_residuals",
    """WITH d AS (SELECT event_type, (value % 7) - 3 AS dx, (value * 3 % 5) - 2 AS dy FROM events), e AS (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM d)
SELECT event_type, count(*) AS pairs, round(sqrt(avg(d * d)), 4) AS rms, round(sqrt(avg(dx * dx)), 4) AS rms_x, round(sqrt(avg(dy * dy)), 4) AS rms_y, round(median(d), 4) AS median,
round(max(d), 4) AS largest, round(count(*) FILTER (d <= 2) / count(*), 6) AS inliers FROM e GROUP BY event_type""",
)
def a37(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", ((F.col("value") % 7) - 3).alias("dx"), ((F.col("value") * 3 % 5) - 2).alias("dy"))
    got = stats.residual_summary(e, ["event_type"])
    return got.select("event_type", "pairs", r("rms"), r("rms_x"), r("rms_y"), r("median"), r("largest"), r("inliers", digits=6))


MOMENTS = f"""{V}, w AS (SELECT frame, x // 7 AS bx, y // 7 AS gy, x, y, CASE WHEN isfinite(v) AND v > 0 THEN v ELSE 0 END AS w FROM pix_nan),
s AS (SELECT frame, bx, gy, sum(w) AS flux, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy FROM w GROUP BY 1, 2, 3 HAVING sum(w) > 0),
m AS (SELECT frame, bx, gy, flux, sx / flux AS cx, sy / flux AS cy, sxx / flux - (sx / flux) * (sx / flux) AS vx, syy / flux - (sy / flux) * (sy / flux) AS vy FROM s)"""


def _boxes(spark, sf):
    p = pix_nan(spark, sf).withColumns({"bx": F.floor(F.col("x") / 7), "gy": F.floor(F.col("y") / 7)})
    return stats.moments(p, ["frame", "bx", "gy"])


@query("a38_second_moments", f"{MOMENTS} SELECT frame, bx, gy, round(2.3548 * sqrt(greatest(0.0, (vx + vy) / 2)), 3) AS fwhm FROM m")
def a38(spark, sf):
    return _boxes(spark, sf).select("frame", "bx", "gy", r("fwhm", digits=3))


@query("a39_centroid", f"{MOMENTS} SELECT frame, bx, gy, round(flux, 3) AS flux, round(cx, 4) AS cx, round(cy, 4) AS cy FROM m")
def a39(spark, sf):
    return _boxes(spark, sf).select("frame", "bx", "gy", r("flux", digits=3), r("cx"), r("cy"))


@query("a41_mask_count", f"{V} SELECT frame, count(*) AS pixels, count(*) FILTER ((dq & 6) <> 0) AS flagged, count(*) FILTER (NOT isfinite(v)) AS missing FROM pix_nan GROUP BY frame")
def a41(spark, sf):
    return pix_nan(spark, sf).groupBy("frame").agg(
        F.count("*").alias("pixels"), F.count_if(F.col("dq").bitwiseAND(6) != 0).alias("flagged"), F.count_if(~s.finite(F.col("v"))).alias("missing")
    )


@query(
    "a43_radial_profile",
    f"""{V}, {FIN} SELECT frame, CAST(floor(2 * sqrt((x - 32) * (x - 32) + (y - 32) * (y - 32))) AS BIGINT) AS ring, count(*) AS n, round(median(v), 4) AS median FROM fin GROUP BY 1, 2""",
)
def a43(spark, sf):
    d = F.sqrt((F.col("x") - 32) * (F.col("x") - 32) + (F.col("y") - 32) * (F.col("y") - 32))
    return pix_nan(spark, sf).filter(s.finite(F.col("v"))).groupBy("frame", F.floor(2 * d).alias("ring")).agg(F.count("*").alias("n"), r(F.median("v"), "median"))


@query("p04_bad_bits", f"{V} SELECT frame, x, y, dq FROM pix_nan WHERE (dq & 20) <> 0")
def p04(spark, sf):
    return pix_nan(spark, sf).filter(F.col("dq").bitwiseAND(20) != 0).select("frame", "x", "y", "dq")


@query("p05_masked_to_nan", f"{V} SELECT frame, count(*) FILTER (isnan(CASE WHEN (dq & 20) <> 0 THEN CAST('NaN' AS DOUBLE) ELSE v END)) AS missing FROM pix_nan GROUP BY frame")
def p05(spark, sf):
    masked = F.when(F.col("dq").bitwiseAND(20) != 0, F.lit(float("nan"))).otherwise(F.col("v"))
    return pix_nan(spark, sf).groupBy("frame").agg(F.count_if(F.isnan(masked)).alias("missing"))


@query(
    "p06_edge_rows",
    f"""{V} SELECT frame, 'row' AS axis, y AS k, round(avg(CASE WHEN (dq & 2) <> 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM pix_nan GROUP BY frame, y HAVING avg(CASE WHEN (dq & 2) <> 0 THEN 1.0 ELSE 0.0 END) >= 0.75
UNION ALL SELECT frame, 'column', x, round(avg(CASE WHEN (dq & 2) <> 0 THEN 1.0 ELSE 0.0 END), 6) FROM pix_nan GROUP BY frame, x HAVING avg(CASE WHEN (dq & 2) <> 0 THEN 1.0 ELSE 0.0 END) >= 0.75""",
)
def p06(spark, sf):
    p = pix_nan(spark, sf).withColumn("f", (F.col("dq").bitwiseAND(2) != 0).cast("double"))
    side = lambda name, c: p.groupBy("frame", F.lit(name).alias("axis"), F.col(c).alias("k")).agg(r(F.avg("f"), "share", 6), F.avg("f").alias("f")).filter("f >= 0.75").drop("f")
    return side("row", "y").union(side("column", "x"))


@query(
    "p07_clip_classes",
    f"{V} SELECT frame, CASE WHEN NOT isfinite(v) THEN 3 WHEN v < 20 THEN 1 WHEN v > 80 OR (v - 20) / 55 > 1 THEN 2 ELSE 0 END AS class, count(*) AS n FROM pix_nan GROUP BY 1, 2",
)
def p07(spark, sf):
    c = s.clip_class(F.col("v"), (F.col("v") - 20) / 55, 20.0, 80.0)
    return pix_nan(spark, sf).groupBy("frame", c.alias("class")).agg(F.count("*").alias("n"))


@query("p08_sky_bounds", f"{V}, {FIN} SELECT frame, round(median(v), 4) AS sky, count(*) AS n FROM fin WHERE v >= 10 AND v <= 60 GROUP BY frame")
def p08(spark, sf):
    return pix_nan(spark, sf).filter(s.finite(F.col("v")) & F.col("v").between(10, 60)).groupBy("frame").agg(r(F.median("v"), "sky"), F.count("*").alias("n"))


@query("p09_strided_sample", f"{V}, {FIN} SELECT frame, count(*) AS n, round(avg(v), 4) AS mean FROM fin WHERE (y * 64 + x) % 7 = 0 GROUP BY frame")
def p09(spark, sf):
    return pix_nan(spark, sf).filter(s.finite(F.col("v")) & ((F.col("y") * 64 + F.col("x")) % 7 == 0)).groupBy("frame").agg(F.count("*").alias("n"), r(F.avg("v"), "mean"))


@query("x02_normalise", f"{V}, {FIN}, m AS (SELECT frame, min(v) AS lo, max(v) AS hi FROM fin GROUP BY frame) SELECT frame, x, y, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS unit FROM fin JOIN m USING (frame)")
def x02(spark, sf):
    p = pix(spark, sf).filter((F.col("x") * 7 + F.col("y")) % 31 != 0)
    m = stats.basic(p, ["frame"]).select("frame", "lo", "hi")
    unit = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return p.join(m, "frame").select("frame", "x", "y", r(unit, "unit", 6))
