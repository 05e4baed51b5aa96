"""Sky matching and mixes: M08-M11, W13, W14, A32."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import combine, compose, graph
from lumenweave.plans.q_combine import CELLS, _cells
from lumenweave.plans.registry import query, r

EDGES = f"{CELLS}, df AS (SELECT a.frame AS i, b.frame AS j, b.value - a.value AS delta FROM cl a JOIN cl b ON a.cx = b.cx AND a.cy = b.cy AND a.frame < b.frame), ed AS (SELECT i, j, median(delta) AS delta, count(*) AS cells FROM df GROUP BY 1, 2 HAVING count(*) >= 8)"


def _edges(spark, sf):
    return graph.overlap_edges(combine.overlap_differences(_cells(spark, sf)))


@query("m08_overlap_edges", f"{EDGES} SELECT i, j, round(delta, 4) + 0.0 AS delta, cells, round(sqrt(cells), 4) AS weight FROM ed")
def m08_edges(spark, sf):
    return _edges(spark, sf).select("i", "j", r("delta"), "cells", r("weight"))


LINKS = "WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS f, (s_suppkey * 7) % 25 AS t FROM supplier), b AS (SELECT f, t FROM e UNION SELECT t, f FROM e UNION SELECT n_nationkey, n_nationkey FROM nation), reach AS (SELECT n_nationkey AS a, n_nationkey AS c FROM nation UNION SELECT r.a, b.t FROM reach r JOIN b ON b.f = r.c) SELECT CAST(a AS BIGINT) AS frame, CAST(min(c) AS BIGINT) AS component FROM reach GROUP BY 1"


@query("w13_frame_components", LINKS)
def w13(spark, sf):
    e = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").cast("long").alias("i"), ((F.col("s_suppkey") * 7) % 25).alias("j"))
    frames = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("frame"))
    return graph.frame_components(frames, e)


@query("m08_sky_offsets")
def m08(spark, sf):
    e = _edges(spark, sf)
    frames = _cells(spark, sf).select("frame").distinct()
    return graph.solve_offsets(e, graph.frame_components(frames, e)).select("frame", r("offset"))


@query("m09_sky_planes")
def m09(spark, sf):
    d = combine.overlap_differences(_cells(spark, sf))
    e = graph.overlap_edges(d)
    comps = graph.frame_components(_cells(spark, sf).select("frame").distinct(), e)
    return graph.solve_planes(d, comps, 8.0).select("frame", r("a"), r("b"), r("c"))


SKY = f"{CELLS}, sk AS (SELECT frame, frame // 2 AS file, median(value) AS sky FROM cl GROUP BY 1), of AS (SELECT frame, frame * 0.5 - 1 AS o FROM sk WHERE frame < 6)"


@query(
    "m10_sky_plan",
    f"""{SKY} SELECT frame, round(min(sky) OVER (PARTITION BY file), 4) AS localmin, round(min(sky) OVER (), 4) AS globalmin, round(coalesce(o, sky), 4) + 0.0 AS "match", round(coalesce(min(sky) OVER () + o - min(o) OVER (), sky), 4) AS both FROM sk LEFT JOIN of USING (frame)""",
)
def m10(spark, sf):
    sky = _cells(spark, sf).groupBy("frame").agg(F.median("value").alias("sky")).withColumn("file", F.floor(F.col("frame") / 2)).cache()
    offsets = sky.filter("frame < 6").select("frame", (F.col("frame") * 0.5 - 1).alias("offset"))
    out = sky.select("frame")
    for method, name in (("localmin", "localmin"), ("globalmin", "globalmin"), ("match", "match"), ("globalmin+match", "both")):
        out = out.join(graph.plan_sky(sky, offsets, method).select("frame", r("sky", name)), "frame")
    return out


@query(
    "m10_match_plane",
    f"""{SKY}, pl AS (SELECT frame, 0.5 * frame AS a, 2.0 - frame AS b, frame * 0.25 - 1 AS c FROM sk WHERE frame < 6)
SELECT cl.frame, cl.cx, cl.cy, round(value - CASE WHEN pl.frame IS NULL THEN sky ELSE a * (cx + 0.5) / 8 + b * (cy + 0.5) / 8 + c END, 4) + 0.0 AS left_over
FROM cl JOIN sk ON sk.frame = cl.frame LEFT JOIN pl ON pl.frame = cl.frame""",
)
def m10_match_plane(spark, sf):
    c = _cells(spark, sf)
    sky = c.groupBy("frame").agg(F.median("value").alias("sky"))
    f = F.col("frame")
    planes = sky.filter("frame < 6").select("frame", (f * 0.5).alias("a"), (2.0 - f).alias("b"), (f * 0.25 - 1).alias("c"))
    surface = F.col("sky") + F.col("a") * (F.col("cx") + 0.5) / 8 + F.col("b") * (F.col("cy") + 0.5) / 8 + F.col("c")
    got = c.join(F.broadcast(graph.plan_planes(sky, planes)), "frame").withColumn("left_over", F.col("value") - surface)
    return got.select("frame", "cx", "cy", r("left_over"))


@query("m11_equalise_components", f"{SKY}, m AS (SELECT file AS component, median(sky) AS m FROM sk GROUP BY 1), sh AS (SELECT component, m - min(m) OVER () AS shift FROM m) SELECT frame, component, round(shift, 4) AS shift FROM sk JOIN sh ON component = file")
def m11(spark, sf):
    sky = _cells(spark, sf).groupBy("frame").agg(F.median("value").alias("level")).withColumn("component", F.floor(F.col("frame") / 2))
    return graph.equalise_components(sky).select("frame", "component", r("shift"))


@query(
    "a32_wavelength_weights",
    """WITH s AS (SELECT n_nationkey AS id, 400.0 + n_nationkey * 17 % 300 AS nm, CASE WHEN n_nationkey % 3 = 0 THEN 'narrow' ELSE 'base' END AS kind FROM nation), t AS (SELECT *, (nm - min(nm) OVER ()) / (max(nm) OVER () - min(nm) OVER ()) AS t FROM s),
w AS (SELECT *, CASE WHEN t <= 0.5 THEN 0.25 * t * 2 ELSE 0.25 + 0.5 * (t * 2 - 1) END AS r, CASE WHEN t <= 0.5 THEN 0.25 + 0.25 * t * 2 ELSE 0.5 - 0.25 * (t * 2 - 1) END AS g, CASE WHEN t <= 0.5 THEN 0.75 - 0.5 * t * 2 ELSE 0.25 - 0.25 * (t * 2 - 1) END AS b FROM t),
k AS (SELECT *, sum(r) FILTER (kind = 'base') OVER () AS br, sum(g) FILTER (kind = 'base') OVER () AS bg, sum(b) FILTER (kind = 'base') OVER () AS bb, greatest(sum(r) FILTER (kind = 'narrow') OVER (), sum(g) FILTER (kind = 'narrow') OVER (), sum(b) FILTER (kind = 'narrow') OVER ()) AS top FROM w)
SELECT id, kind, round(CASE kind WHEN 'base' THEN r / br ELSE r * 0.6 / top END, 5) AS wr, round(CASE kind WHEN 'base' THEN g / bg ELSE g * 0.6 / top END, 5) AS wg, round(CASE kind WHEN 'base' THEN b / bb ELSE b * 0.6 / top END, 5) AS wb FROM k""",
)
def a32(spark, sf):
    n = F.col("n_nationkey")
    s = spark.read.parquet(f"{sf}/nation.parquet").select(n.alias("id"), (400.0 + n * 17 % 300).alias("nm"), F.when(n % 3 == 0, "narrow").otherwise("base").alias("kind"))
    return compose.wavelength_weights(s, 60.0).select("id", "kind", r("wr", digits=5), r("wg", digits=5), r("wb", digits=5))


@query("w14_input_order", "SELECT n_nationkey AS frame, CAST(row_number() OVER (ORDER BY n_regionkey, n_name, n_nationkey) AS INTEGER) AS position FROM nation")
def w14(spark, sf):
    from pyspark.sql import Window

    w = Window.orderBy("n_regionkey", "n_name", "n_nationkey")
    return spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("frame"), F.row_number().over(w).alias("position"))
