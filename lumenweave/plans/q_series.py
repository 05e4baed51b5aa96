"""Windows and neighbourhoods: W01-W08, A33, A34, A42, T01-T06."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenweave.operators import combine, joins, series, stats
from lumenweave.plans.registry import query, r, snap
from lumenweave.plans.views import pix, pix_nan, stars, with_views

P, N, S = with_views("pix"), with_views("pix_nan"), with_views("stars")
AMP = "least(x // 16, 3)"
ROWS = f"""rm AS (SELECT frame, CAST({AMP} AS INTEGER) AS amp, y, count(*) FILTER (isfinite(v) AND (dq & 4) = 0) AS n,
CASE WHEN count(*) FILTER (isfinite(v) AND (dq & 4) = 0) >= 4 THEN median(v) FILTER (isfinite(v) AND (dq & 4) = 0) ELSE CAST('NaN' AS DOUBLE) END AS m FROM pix_nan GROUP BY 1, 2, 3)"""
TREND = """i AS (SELECT *, row_number() OVER (PARTITION BY frame, amp ORDER BY y) - 1 AS i, count(*) OVER (PARTITION BY frame, amp) AS k FROM rm),
h AS (SELECT *, least(4, i, k - 1 - i) AS half FROM i),
tr AS (SELECT a.frame, a.amp, a.y, a.m, coalesce(avg(b.m) FILTER (isfinite(b.m)), CAST('NaN' AS DOUBLE)) AS trend FROM h a JOIN h b ON a.frame = b.frame AND a.amp = b.amp AND b.i BETWEEN a.i - a.half AND a.i + a.half GROUP BY ALL)"""


def _rows(spark, sf):
    p = pix_nan(spark, sf).withColumn("mask", F.col("dq").bitwiseAND(4) != 0)
    return p, combine.row_medians(p, 64, least=4)


@query("a34_row_medians", f"{N}, {ROWS} SELECT frame, amp, y, n, CASE WHEN isnan(m) THEN NULL ELSE round(m, 4) END AS m FROM rm")
def a34(spark, sf):
    return _rows(spark, sf)[1].select("frame", "amp", "y", "n", F.when(~F.isnan("m"), snap(F.col("m"), 4)).alias("m"))


@query("w01_symmetric_mean", f"{N}, {ROWS}, {TREND} SELECT frame, amp, y, CASE WHEN isnan(trend) THEN NULL ELSE round(trend, 4) END AS trend FROM tr")
def w01(spark, sf):
    got = series.symmetric_mean(_rows(spark, sf)[1], ["frame", "amp"], "y", "m", 9)
    return got.select("frame", "amp", "y", F.when(~F.isnan("trend"), snap(F.col("trend"), 4)).alias("trend"))


@query(
    "w02_deband",
    f"""{N}, {ROWS}, {TREND} SELECT frame, amp, round(sum(p.v - CASE WHEN isfinite(t.m) AND isfinite(t.trend) THEN t.m - t.trend ELSE 0 END), 3) AS total
FROM (SELECT frame, CAST({AMP} AS INTEGER) AS amp, y, v FROM pix_nan WHERE isfinite(v)) p JOIN tr t USING (frame, amp, y) GROUP BY 1, 2""",
)
def w02(spark, sf):
    p, m = _rows(spark, sf)
    got = series.deband(p, m, 64, window=9).filter(~F.isnan("v"))
    return got.groupBy("frame", "amp").agg(r(F.sum("v"), "total", 3))


@query(
    "a33_amplifier_steps",
    f"""{P}, rows_ AS (SELECT frame, CAST({AMP} AS INTEGER) AS amp, y // 16 AS band, v FROM pix),
b0 AS (SELECT frame, amp, band, CAST('-inf' AS DOUBLE) AS lo, CAST('inf' AS DOUBLE) AS hi FROM rows_ GROUP BY 1, 2, 3),
{", ".join(f"b{k} AS (SELECT frame, amp, band, CASE WHEN s > 0 THEN greatest(lo, m - 3 * s) ELSE lo END AS lo, CASE WHEN s > 0 THEN least(hi, m + 3 * s) ELSE hi END AS hi FROM (SELECT frame, amp, band, lo, hi, avg(v) AS m, stddev_pop(v) AS s FROM rows_ JOIN b{k - 1} USING (frame, amp, band) WHERE v BETWEEN lo AND hi GROUP BY ALL))" for k in (1, 2, 3))},
lv AS (SELECT frame, amp, band, median(v) AS m FROM rows_ JOIN b3 USING (frame, amp, band) WHERE v BETWEEN lo AND hi GROUP BY 1, 2, 3 HAVING count(*) >= 20),
st AS (SELECT a.frame, a.amp + 1 AS amp, median(b.m - a.m) AS step FROM lv a JOIN lv b ON a.frame = b.frame AND a.band = b.band AND b.amp = a.amp + 1 GROUP BY 1, 2),
ev AS (SELECT f.frame, CAST(k.range AS INTEGER) AS amp, coalesce(step, 0) AS step FROM (SELECT DISTINCT frame FROM lv) f CROSS JOIN range(4) k LEFT JOIN st ON st.frame = f.frame AND st.amp = k.range),
rn AS (SELECT frame, amp, sum(step) OVER (PARTITION BY frame ORDER BY amp) AS run FROM ev)
SELECT frame, amp, round(run - avg(run) OVER (PARTITION BY frame), 4) + 0.0 AS "offset" FROM rn""",
)
def a33(spark, sf):
    return combine.amplifier_steps(pix(spark, sf), 64, least=20).select("frame", "amp", r("offset"))


@query(
    "a42_tile_noise",
    f"""{P}, d AS (SELECT frame, x // 16 AS tx, y // 16 AS ty, CASE WHEN lead(x) OVER w = x + 1 THEN abs(v - lead(v) OVER w) END AS step FROM pix WINDOW w AS (PARTITION BY frame, y ORDER BY x))
SELECT frame, tx, ty, round(1.0484 * median(step), 4) AS noise FROM d GROUP BY 1, 2, 3""",
)
def a42(spark, sf):
    return series.tile_noise(pix(spark, sf), 16).select("frame", "tx", "ty", r("noise"))


NEAR = """nb AS (SELECT frame, x, y, v, CASE WHEN lag(x) OVER h = x - 1 THEN lag(v) OVER h END AS l, CASE WHEN lead(x) OVER h = x + 1 THEN lead(v) OVER h END AS r,
CASE WHEN lag(y) OVER g = y - 1 THEN lag(v) OVER g END AS u, CASE WHEN lead(y) OVER g = y + 1 THEN lead(v) OVER g END AS d FROM pix WINDOW h AS (PARTITION BY frame, y ORDER BY x), g AS (PARTITION BY frame, x ORDER BY y))"""


@query("w07_derivative", f"{P}, {NEAR} SELECT frame, x, y, round(greatest(abs(v - l), abs(v - r), abs(v - u), abs(v - d)), 4) + 0.0 AS steepest, round(4 * v - (l + r + u + d), 4) + 0.0 AS laplacian FROM nb")
def w07(spark, sf):
    return series.derivative(pix(spark, sf)).select("frame", "x", "y", r("steepest"), r("laplacian"))


@query("w08_local_maxima", f"{P}, {NEAR} SELECT frame, x, y, v FROM nb WHERE coalesce(v > l, true) AND coalesce(v > r, true) AND coalesce(v > u, true) AND coalesce(v > d, true)")
def w08(spark, sf):
    return series.local_maxima(pix(spark, sf))


VOTES = """s AS (SELECT * FROM stars), vt AS (SELECT a.star, a.frame, a.x, a.y, a.peak, count(DISTINCT b.exposure) AS support FROM s a JOIN s b ON floor(b.x / 4) BETWEEN floor(a.x / 4) - 1 AND floor(a.x / 4) + 1 AND floor(b.y / 4) BETWEEN floor(a.y / 4) - 1 AND floor(a.y / 4) + 1
AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 4 GROUP BY ALL)"""
SUPPORTED = """k AS (SELECT *, count(*) FILTER (support >= 2) OVER (PARTITION BY frame) AS good FROM vt),
r AS (SELECT *, good < 4 AS fallback, CASE WHEN good >= 4 THEN row_number() OVER (PARTITION BY frame ORDER BY support DESC, star) ELSE row_number() OVER (PARTITION BY frame ORDER BY star) END AS rank FROM k)
SELECT frame, star, support, fallback, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 25 AND (fallback OR support >= 2)"""


def _votes(spark, sf):
    return joins.votes(stars(spark, sf).select("star", "frame", "x", "y", "peak", "exposure"), 4.0)


@query("j02_consensus_votes", f"{S}, {VOTES} SELECT star, frame, support FROM vt")
def j02(spark, sf):
    return _votes(spark, sf).select("star", "frame", "support")


@query("w03_supported_selection", f"{S}, {VOTES}, {SUPPORTED}")
def w03(spark, sf):
    return series.supported(_votes(spark, sf), 25, ["frame"]).select("frame", "star", "support", "fallback", "rank")


@query(
    "w04_spatial_round_robin",
    f"""{S}, c AS (SELECT frame, star, x, y, peak, least(CAST(floor(y * 6 / 256) AS BIGINT), 5) * 6 + least(CAST(floor(x * 6 / 256) AS BIGINT), 5) AS cell FROM stars),
t AS (SELECT *, row_number() OVER (PARTITION BY frame, cell ORDER BY peak DESC, x, y, star) AS turn, count(*) OVER (PARTITION BY frame) AS n FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY turn, cell) AS rank FROM t) SELECT frame, star, CAST(rank AS INTEGER) AS rank FROM r WHERE n <= 40 OR rank <= 40""",
)
def w04(spark, sf):
    return series.spread(stars(spark, sf), 40, ["frame"], 256.0).select("frame", "star", "rank")


@query(
    "w05_equalise",
    f"""{N}, fin AS (SELECT * FROM pix_nan WHERE isfinite(v)), s AS (SELECT frame, min(v) AS lo, max(v) AS hi FROM fin GROUP BY frame),
h AS (SELECT frame, CAST(floor(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END * 255) AS INTEGER) AS bin, count(*) AS n FROM fin JOIN s USING (frame) GROUP BY 1, 2)
SELECT frame, bin, round(sum(n) OVER (PARTITION BY frame ORDER BY bin) / sum(n) OVER (PARTITION BY frame), 6) AS cdf FROM h""",
)
def w05(spark, sf):
    return series.equalise(stats.histogram(pix_nan(spark, sf), ["frame"]), ["frame"]).select("frame", "bin", r("cdf", digits=6))


@query(
    "w06_window_median",
    f"""{P}, o AS (SELECT p.frame, p.x, p.y, q.v FROM pix p JOIN pix q ON q.frame = p.frame AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1)
SELECT frame, x, y, count(*) AS n, round(median(v), 4) AS median FROM o GROUP BY 1, 2, 3""",
)
def w06(spark, sf):
    from lumenweave.operators.raster import window_median

    return window_median(pix(spark, sf), 1).select("frame", "x", "y", "n", r("median"))


@query("t01_brightest", f"{S} SELECT frame, star, CAST(rank AS INTEGER) AS rank FROM (SELECT frame, star, row_number() OVER (PARTITION BY frame ORDER BY peak DESC, x, y) AS rank FROM stars) WHERE rank <= 50")
def t01(spark, sf):
    return series.brightest(stars(spark, sf), 50, ["frame"]).select("frame", "star", "rank")


@query("t02_review_order", f"{S} SELECT star, CAST(row_number() OVER o AS INTEGER) AS position, lag(star) OVER o AS previous, lead(star) OVER o AS following FROM stars WINDOW o AS (PARTITION BY frame ORDER BY area DESC, peak DESC, star)")
def t02(spark, sf):
    w = Window.partitionBy("frame").orderBy(F.desc("area"), F.desc("peak"), "star")
    return stars(spark, sf).select("star", F.row_number().over(w).alias("position"), F.lag("star").over(w).alias("previous"), F.lead("star").over(w).alias("following"))


@query(
    "t04_channel_assignment",
    """WITH f AS (SELECT DISTINCT p_brand AS brand FROM part), k AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS i, count(*) OVER () AS n FROM f)
SELECT brand, CASE WHEN i = 0 THEN 'blue' WHEN i = n - 1 THEN 'red' WHEN i = n // 2 THEN 'green' ELSE 'custom' END AS channel FROM k""",
)
def t04(spark, sf):
    f = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("brand")).distinct()
    i, n = F.row_number().over(Window.orderBy("brand")) - 1, F.count("*").over(Window.partitionBy(F.lit(0)))
    k = f.withColumns({"i": i, "n": n})
    return k.select("brand", F.when(F.col("i") == 0, "blue").when(F.col("i") == F.col("n") - 1, "red").when(F.col("i") == F.floor(F.col("n") / 2), "green").otherwise("custom").alias("channel"))


@query("t05_preview_sources", f"{S} SELECT star, frame FROM stars WHERE area > 20 ORDER BY star LIMIT 12")
def t05(spark, sf):
    return stars(spark, sf).filter("area > 20").orderBy("star").limit(12).select("star", "frame")


@query("t06_stable_sum", f"{S} SELECT frame, round(list_sum(list(flux ORDER BY star)), 3) AS total FROM stars GROUP BY frame")
def t06(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("star", "flux")))
    return stars(spark, sf).groupBy("frame").agg(r(F.aggregate(ordered, F.lit(0.0), lambda a, s: a + s["flux"]), "total", 3))
