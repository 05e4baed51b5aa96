"""Operators whose result SQL doesn't give, against plain loops, and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.functions import scalars as s
from lumenweave.operators import combine, fit, graph, joins, raster, series, stats
from lumenweave.streaming import jobs


def frame_of(spark, g, frame=0):
    rows = [(frame, x, y, float(g[y, x])) for y in range(g.shape[0]) for x in range(g.shape[1])]
    return spark.createDataFrame(rows, "frame long, x long, y long, v double")


def grid(df, shape, name):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[name]
    return out


def test_blur_and_median_do_not_depend_on_tiles(spark):
    g = np.random.default_rng(0).normal(10, 3, (20, 30))
    g[3, 4] = np.nan
    df = frame_of(spark, g)
    for size in (7, 64):
        assert np.allclose(grid(raster.blur(df, 1.5, size), g.shape, "blurred"), raster.blur_grid(np.pad(g, 5, constant_values=np.nan), 1.5)[5:-5, 5:-5])
        assert grid(raster.window_median(df, 2, size), g.shape, "median")[10, 10] == np.median(g[8:13, 8:13])


def test_blur_keeps_a_constant(spark):
    assert np.allclose(grid(raster.blur(frame_of(spark, np.full((9, 9), 4.0))), (9, 9), "blurred"), 4)


def test_holes_of_a_plane_are_filled_exactly(spark):
    y, x = np.mgrid[0:10, 0:10]
    g = 3.0 + 2 * x - y
    h = g.copy()
    h[4, 4] = h[4, 5] = np.nan
    assert np.allclose(grid(raster.fill_holes(frame_of(spark, h), 10, 10), g.shape, "filled"), g)


@pytest.mark.parametrize("size", [4, 100])
def test_components_across_tiles(spark, size):
    g = np.random.default_rng(1).random((18, 18)) > 0.62
    df = frame_of(spark, g.astype(float)).filter("v > 0")
    got = {(r.x, r.y): r.label for r in raster.label_components(df, size).collect()}
    seen = {}
    for y, x in map(tuple, np.argwhere(g)):
        if (x, y) in seen:
            continue
        todo, seen[x, y] = [(x, y)], y * (1 << 31) + x
        while todo:
            a, b = todo.pop()
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    k = (a + i, b + j)
                    if k not in seen and 0 <= k[0] < 18 and 0 <= k[1] < 18 and g[k[1], k[0]]:
                        seen[k] = seen[x, y]
                        todo.append(k)
    assert got == seen


def test_cosmic_ray_goes_and_star_stays(spark):
    y, x = np.mgrid[0:40, 0:40]
    g = 100 + 400 * np.exp(-((x - 25) ** 2 + (y - 25) ** 2) / (2 * 3.0**2)) + np.random.default_rng(2).normal(0, 1, (40, 40))
    g[8, 8] += 500
    levels = spark.createDataFrame([(0, 100.0, 2.0)], "frame long, bg double, sigma double")
    got = raster.clean(frame_of(spark, g), levels, *g.shape[::-1]).filter("hit").collect()
    assert {(r.x, r.y) for r in got} == {(8, 8)} and abs(got[0].clean - 100) < 5


def test_cosmic_mask_seeds_and_grows(spark):
    g = np.full((9, 9), 10.0)
    g[4, 4], g[4, 5] = 60.0, 14.0
    df = frame_of(spark, g).withColumns({"model": F.lit(10.0), "noise": F.lit(1.0)})
    flagged = {(r.x, r.y) for r in raster.cosmic_mask(df).filter("flag").collect()}
    assert flagged == {(4, 4), (5, 4)}
    edge = np.full((5, 5), 10.0)
    edge[0, 0] = 99
    assert raster.cosmic_mask(frame_of(spark, edge).withColumns({"model": F.lit(10.0), "noise": F.lit(1.0)})).filter("flag").count() == 0


def test_drizzle_examples(spark):
    """Identity; the mean of 2 and 4 is 3 with weight 2; exposure weighting gives rate 1 with weight 210."""
    g = np.array([[1.0, 2.0], [3.0, 4.0]])
    one = combine.place(frame_of(spark, g), {})
    out = combine.accumulate(combine.scatter(one, "square", 1.0), F.col("v"), F.lit(1.0))
    assert {(r.ox, r.oy): (r.v, r.weight) for r in out.collect()} == {(0, 0): (1, 1), (1, 0): (2, 1), (0, 1): (3, 1), (1, 1): (4, 1)}
    two = frame_of(spark, np.full((2, 2), 2.0)).union(frame_of(spark, np.full((2, 2), 4.0), 1))
    out = combine.accumulate(combine.scatter(combine.place(two, {}), "square", 1.0), F.col("v"), F.lit(1.0)).collect()
    assert all((r.v, r.weight) == (3, 2) for r in out)
    counts = frame_of(spark, np.full((1, 1), 100.0)).withColumn("exptime", F.lit(100.0)).union(frame_of(spark, np.full((1, 1), 110.0), 1).withColumn("exptime", F.lit(110.0)))
    value, weight = combine.sample_weight("exposure")
    r = combine.accumulate(combine.scatter(combine.place(counts.withColumn("unit", F.lit("counts")), {}), "point", 1.0), value, weight).first()
    assert (round(r.v, 9), r.weight) == (1, 210)


@pytest.mark.parametrize("kernel", combine.KERNELS)
def test_kernels_are_symmetric(spark, kernel):
    px = spark.createDataFrame([(0, 0, 0, 1.0, 5.0, 5.0)], "frame long, x long, y long, v double, cx double, cy double")
    w = {(r.ox, r.oy): r.kw for r in combine.scatter(px, kernel, 1.3).collect()}
    assert w and all(abs(w.get((10 - x, y), 0) - k) < 1e-9 and abs(w.get((y, x), 0) - k) < 1e-9 for (x, y), k in w.items())


def test_square_kernel_keeps_flux(spark):
    px = spark.createDataFrame([(0, 0, 0, 1.0, 5.37, 4.81)], "frame long, x long, y long, v double, cx double, cy double")
    assert math.isclose(combine.scatter(px, "square", 1.7).agg(F.sum("kw")).first()[0], 1.0)


def test_offsets_recover_levels(spark):
    truth = {0: 0.0, 1: 3.0, 2: -2.0, 3: 7.0}
    pairs = [(i, j) for i in truth for j in truth if i < j]
    rows = [(i, j, truth[j] - truth[i], 4.0) for i, j in pairs] + [(8, 9, 5.0, 1.0)]
    edges = spark.createDataFrame(rows, "i long, j long, delta double, weight double")
    frames = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 8, 9, 11)], "frame long")
    comps = graph.frame_components(frames, edges)
    assert {r.frame: r.component for r in comps.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 8: 8, 9: 8, 11: 11}
    got = {r.frame: r.offset for r in graph.solve_offsets(edges, comps).collect()}
    assert all(abs(got[k] - v) < 1e-6 for k, v in {**truth, 8: 0, 9: 5}.items())


def test_planes_recover_gradients(spark):
    cells = [(0, 1, cx, cy, 2.0 + 0.5 * (cx + 0.5) / 8 - 0.25 * (cy + 0.5) / 8) for cx in range(8) for cy in range(8)]
    d = spark.createDataFrame(cells, "i long, j long, cx long, cy long, delta double")
    comps = spark.createDataFrame([(0, 0), (1, 0)], "frame long, component long")
    p = {r.frame: r for r in graph.solve_planes(d, comps, 8.0, ridge=1e-9).collect()}
    assert abs(p[1].a - 0.5) < 1e-4 and abs(p[1].b + 0.25) < 1e-4 and abs(p[1].c - 2) < 1e-4


def _planes_by_loop(cells, extent, ridge=0.01, passes=2):
    """One component's planes by least squares over all cells, with cells clipped in between."""
    from collections import Counter

    n = Counter((i, j) for i, j, *_ in cells)
    rows = [(i, j, (x + 0.5) / extent, (y + 0.5) / extent, d, n[i, j] ** 0.5) for i, j, x, y, d in cells if n[i, j] >= 8]
    nodes = sorted({f for r in rows for f in r[:2]})
    for k in range(passes + 1):
        a, b = [], []
        for i, j, u, v, d, w in rows:
            line = np.zeros(3 * len(nodes))
            line[3 * nodes.index(j) : 3 * nodes.index(j) + 3] += [u, v, 1]
            line[3 * nodes.index(i) : 3 * nodes.index(i) + 3] -= [u, v, 1]
            a.append(line * w**0.5)
            b.append(d * w**0.5)
        for f in range(1, len(nodes)):
            for axis in (0, 1):
                a.append(np.eye(3 * len(nodes))[3 * f + axis] * ridge**0.5)
                b.append(0.0)
        x = np.zeros(3 * len(nodes))
        x[3:] = np.linalg.lstsq(np.array(a)[:, 3:], np.array(b), rcond=None)[0]
        p = dict(zip(nodes, x.reshape(-1, 3)))
        res = np.array([d - (p[j] - p[i]) @ [u, v, 1] for i, j, u, v, d, _ in rows])
        keep = np.abs(res - res.mean()) <= 3 * res.std()
        if k == passes or keep.all():
            return p, len(rows)
        rows = [r for r, ok in zip(rows, keep) if ok]


@pytest.mark.parametrize("outliers", [0, 6])
def test_planes_without_outlier_cells(spark, outliers):
    rng = np.random.default_rng(8)
    truth = {0: (0, 0, 0), 1: (0.5, -0.25, 2), 2: (-1, 0.3, -4), 3: (0.2, 0.9, 1)}
    cells = []
    for i in truth:
        for j in truth:
            if i < j:
                for cx in range(12):
                    for cy in range(12):
                        u = np.array([(cx + 0.5) / 8, (cy + 0.5) / 8, 1])
                        cells.append((i, j, cx, cy, float((np.array(truth[j]) - truth[i]) @ u + rng.normal(0, 0.01))))
    clean = _planes_by_loop(cells, 8.0)[0]
    for k in rng.choice(len(cells), outliers, replace=False):
        i, j, cx, cy, d = cells[k]
        cells[k] = (i, j, cx, cy, d + 40.0)
    cells += [(3, 9, 0, 0, 5.0)] * 3  # a pair of too few cells
    comps = spark.createDataFrame([(f, 0) for f in truth] + [(9, 9)], "frame long, component long")
    got = {r.frame: np.array([r.a, r.b, r.c]) for r in graph.solve_planes(spark.createDataFrame(cells, "i long, j long, cx long, cy long, delta double"), comps, 8.0).collect()}
    want, _ = _planes_by_loop(cells, 8.0)
    assert got.keys() == want.keys() == truth.keys()
    assert all(np.allclose(got[f], want[f], atol=1e-6) for f in want)
    assert all(np.allclose(got[f], clean[f], atol=0.02) for f in want)
    plan = graph.plan_planes(spark.createDataFrame([(f, 10.0 + f) for f in (*truth, 9)], "frame long, sky double"), spark.createDataFrame([(f, *map(float, p)) for f, p in got.items()], "frame long, a double, b double, c double"))
    assert {r.frame: r.sky for r in plan.collect()} == {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0, 9: 19.0}


def test_similarity_despite_outliers():
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 100, (60, 2))
    q = p @ np.array([[0.98, -0.1], [0.1, 0.98]]).T + [4, -7]
    q[:15] += rng.uniform(20, 50, (15, 2))
    m, ok = fit.ransac(p, q)
    assert ok.sum() == 45 and np.allclose(m, [[0.98, -0.1, 4], [0.1, 0.98, -7]])


def test_matching_is_largest(spark):
    rng = np.random.default_rng(4)
    rows = sorted({(g, int(rng.integers(0, 7)), int(rng.integers(0, 7))) for g in range(6) for _ in range(12)})
    got = fit.match_bipartite(spark.createDataFrame(rows, "region long, truth long, detection long")).collect()

    def best(edges, used=frozenset()):
        if not edges:
            return 0
        (t, d), rest = edges[0], edges[1:]
        skip = best(rest, used)
        return skip if t in used or ("d", d) in used else max(skip, 1 + best(rest, used | {t, ("d", d)}))

    for g in range(6):
        own = [(r.truth, r.detection) for r in got if r.region == g]
        assert len({t for t, _ in own}) == len({d for _, d in own}) == len(own) == best([(t, d) for k, t, d in rows if k == g])
        assert {(g, t, d) for t, d in own} <= set(rows)


def test_symmetric_mean_leaves_lines_alone(spark):
    df = spark.createDataFrame([("a", k, 2.0 * k + 1) for k in range(30)], "g string, y long, v double")
    got = series.symmetric_mean(df, ["g"], "y", "v", 9).orderBy("y").collect()
    assert all(math.isclose(r.trend, r.v) for r in got)


def test_template_scale(spark):
    rng = np.random.default_rng(5)
    rows = [(0, float(3 * t + rng.normal(0, 0.01)), float(t)) for t in rng.uniform(0, 5, 200)] + [(0, 500.0, 1.0)] + [(1, -float(t), float(t)) for t in range(30)]
    got = {r.frame: r.scale for r in fit.template_scale(spark.createDataFrame(rows, "frame long, v double, t double")).collect()}
    assert abs(got[0] - 3) < 0.01 and got[1] is None


def test_weight_lookup_tells_zero_from_missing(spark):
    items, w = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 0.0)], "k string, weight double")
    assert {r.k: r.weight for r in joins.weights_or_default(items, w, "k", 1.0).collect()} == {"a": 0.0, "b": 1.0}


def test_facets(spark):
    f = spark.createDataFrame([("1230s", "2001-01-01"), ("500s", ""), ("1230s", "2003-01-01"), ("", "2002-01-01")], "exposure string, date_obs string")
    assert [r.label for r in joins.facet_counts(f, F.col("exposure")).orderBy("position").collect()] == ["Any (4 files)", "500s (1 files)", "1230s (2 files)", "Unknown (1 files)"]
    assert joins.facet_filter(f, {}, "2002-01-01", "2002-12-31").count() == 2  # an unknown date is in every range


@pytest.mark.parametrize("mode", ["Linear", "Log", "Sqrt", "Asinh", "MTF", "GHS"])
def test_stretches_rise_and_stay_in_bounds(spark, mode):
    p = s.Stretch(mode, 5.0, 90.0)
    v = [r.o for r in spark.range(200).select((F.col("id") / 2).alias("v")).select(s.clamp01(s.stretch(F.col("v"), p)).alias("o")).collect()]
    assert all(0 <= a <= b <= 1 for a, b in zip(v, v[1:])) and v[0] == 0 and math.isclose(v[180], 1, abs_tol=1e-9)


def test_affine_algebra():
    m = s.Affine.about(3, 4, 30, 2)
    n = m.then(m.inverse())
    assert np.allclose([n.a, n.b, n.c, n.d, n.e, n.f], [1, 0, 0, 0, 1, 0]) and np.allclose(m.summary(), (30, 2))
    with pytest.raises(ValueError):
        s.Affine(1, 1, 0, 1, 1, 0).inverse()


def test_clip_of_a_constant_keeps_all(spark):
    df = spark.createDataFrame([(0, 5.0)] * 9, "frame long, v double")
    assert stats.clipped(df, ["frame"]).count() == 9
    assert stats.auto_levels(df, ["frame"]).first().hi == 6
    assert stats.clipped(df, []).count() == 9


def test_stream_of_jobs(spark, tmp_path):
    rows = spark.sql("SELECT id AS generation, id % 3 AS job, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts, element_at(array('pending', 'failed'), cast(id % 2 + 1 as int)) AS status FROM range(120)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.status_stream(spark, str(tmp_path / "in"), rows.schema)
    for name, df, mode in (("newest_jobs", jobs.newest(stream, "job", "generation", "status"), "complete"), ("job_windows", jobs.windowed_counts(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.job, r.generation) for r in spark.table("newest_jobs").collect()) == [(0, 117), (1, 118), (2, 119)]
    assert spark.table("job_windows").agg(F.sum("jobs")).first()[0] == 120


def test_queue_goes_on_after_a_failure(spark):
    jobs_ = spark.createDataFrame([(2,), (1,), (3,)], "job_id long")

    def work(job):
        if job.job_id == 2:
            raise ValueError("bad")
        return f"done {job.job_id}"

    assert jobs.run_queue(jobs_, work) == [(1, "succeeded", "done 1"), (2, "failed", "bad"), (3, "succeeded", "done 3")]


def test_global_index_is_gapless(spark):
    from lumenweave.operators.index import global_index

    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = [(r.k, r.i) for r in global_index(df, ["k"], "i", 5).collect()]
    assert sorted(i for _, i in got) == list(range(1000)) and [k for k, _ in sorted(got, key=lambda x: x[1])] == sorted(k for k, _ in got)
    assert global_index(df.limit(0), ["k"], "i").count() == 0
