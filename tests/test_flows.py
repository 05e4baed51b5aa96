"""Alignment, detection, mosaics, editing and mappers on small made fields."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenweave.functions import scalars as s
from lumenweave.functions.wcs import Mapper, bilinear_table, compile_model, evaluate_model, map_pixels
from lumenweave.operators import align, detect, edit, mosaic, raster


def px_frame(spark, g, frame=0):
    rows = [(frame, x, y, float(g[y, x])) for y in range(g.shape[0]) for x in range(g.shape[1])]
    return spark.createDataFrame(rows, "frame long, x long, y long, v double")


def test_stars_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:90, 0:90]
    g = 100 + rng.normal(0, 1, (90, 90))
    places = [(20.3, 31.7), (47.9, 48.2), (70.0, 15.5), (64.2, 63.9)]
    for a, b in places:
        g += 300 * np.exp(-((x - a) ** 2 + (y - b) ** 2) / (2 * 2.0**2))
    g[80, 80] += 900  # a single hot pixel is no star
    df, levels = px_frame(spark, g), spark.createDataFrame([(0, 100.0, 1.0)], "frame long, bg double, sigma double")
    for size in (48, 256):
        got = detect.extract_stars(df, levels, size).collect()
        assert len(got) == 4 and all(min(math.hypot(r.x - a, r.y - b) for r in got) < 0.15 for a, b in places)


def test_moffat_fit():
    y, x = np.mgrid[-7:8, -7:8]
    alpha = 3.0 / (2 * math.sqrt(2 ** (1 / 2.5) - 1))
    amplitude, base, fwhm, residual = detect.fit_moffat(50 + 0.3 * x + 200 * (1 + (x * x + y * y) / alpha**2) ** -2.5)
    assert abs(amplitude - 200) < 2 and abs(base - 50) < 1 and abs(fwhm - 3.0) < 0.11 and residual < 0.01
    assert detect.fit_moffat(np.full((5, 5), np.nan)) is None


def test_alignment_goes_through_a_chain(spark):
    rng = np.random.default_rng(1)
    sky = pd.DataFrame({"x": rng.uniform(0, 600, 160), "y": rng.uniform(0, 200, 160), "peak": rng.uniform(10, 99, 160)})
    frames = []
    for k, (lo, hi) in enumerate(((0, 260), (180, 440), (360, 600))):  # 0 and 2 share nothing
        own = sky[(sky.x >= lo) & (sky.x < hi)].copy()
        own["x"], own["y"], own["frame"] = own.x + 4 * k, own.y - 3 * k, k
        frames.append(own)
    st = spark.createDataFrame(pd.concat(frames).assign(star=range(sum(map(len, frames)))))
    got = {r.frame: r for r in align.align_frames(st, 0, 600.0).collect()}
    assert set(got) == {0, 1, 2} and got[2].method.startswith("chain-")
    assert abs(got[1].c + 4) < 0.2 and abs(got[2].c + 8) < 0.4 and abs(got[2].f - 6) < 0.4


def test_bundle_improves_or_leaves_alone(spark):
    rng = np.random.default_rng(2)
    truth = {0: (0, 0), 1: (2, -1), 2: (-1.5, 1.2)}
    p = rng.uniform(0, 100, (30, 2))

    def pairs(shift):
        rows = [(i, j, *(p[k] - shift[i]), *(p[k] - shift[j])) for i, j in ((0, 1), (0, 2), (1, 2)) for k in range(30)]
        return pd.DataFrame(rows, columns=["i", "j", "xi", "yi", "xj", "yj"])

    def solved(df):
        comps = spark.createDataFrame([(k, 0) for k in truth], "frame long, component long")
        rows = align.bundle(spark.createDataFrame(df), comps, 0, 100.0).collect()
        return {r.frame: np.array([[r.ua, r.ub, r.uc], [r.ud, r.ue, r.uf]]) for r in rows}, rows[0].before, rows[0].after

    same = np.array([[1.0, 0, 0], [0, 1, 0]])
    maps, before, after = solved(pairs(truth))
    assert after < 1e-3 < before and np.allclose(maps[2][:, 2], truth[2], atol=1e-2) and np.array_equal(maps[0], same)
    wild = pairs(truth)
    wild.loc[[3, 40, 77], "xi"] += 9
    maps, before, after = solved(wild)
    assert np.allclose(maps[1][:, 2], truth[1], atol=1e-6) and np.allclose(maps[2][:, 2], truth[2], atol=1e-6)  # pairs that don't fit go
    far = pairs(truth | {2: (60, 0)})
    maps, _, _ = solved(far)
    assert np.array_equal(maps[2], same)  # a move that can't be believed isn't made
    maps, before, after = solved(pairs({k: (0, 0) for k in truth}))
    assert before == after == 0 and all(np.array_equal(m, same) for m in maps.values())


def test_bundle_equals_least_squares(spark):
    """The sums by pair of frames give what one system over all stars gives."""
    rng = np.random.default_rng(12)
    rows = [(i, j, *p.tolist(), *(p + rng.normal(0, 0.3, 2)).tolist()) for i, j in ((0, 1), (1, 2), (0, 3), (2, 3)) for p in rng.uniform(0, 100, (20, 2))]
    a, b = [], []
    for i, j, xi, yi, xj, yj in rows:
        for axis in (0, 1):
            line = np.zeros(16)
            line[4 * i : 4 * i + 4] += [xi, -yi, 1, 0] if axis == 0 else [yi, xi, 0, 1]
            line[4 * j : 4 * j + 4] -= [xj, -yj, 1, 0] if axis == 0 else [yj, xj, 0, 1]
            a.append(line[4:])
            b.append(xj - xi if axis == 0 else yj - yi)
    want = np.linalg.lstsq(np.array(a), np.array(b), rcond=None)[0].reshape(-1, 4)
    comps = spark.createDataFrame([(k, 0) for k in range(4)], "frame long, component long")
    got = align.bundle(spark.createDataFrame(rows, "i long, j long, xi double, yi double, xj double, yj double"), comps, 0, 100.0, passes=1).collect()
    for r in got:
        s_, r_, t, u = (0, 0, 0, 0) if r.frame == 0 else want[r.frame - 1]
        assert np.allclose([r.ua, r.ub, r.uc, r.ud, r.ue, r.uf], [1 + s_, -r_, t, r_, 1 + s_, u], atol=1e-8)


def best(p, q, extent=(900, 900)):
    return max(align.trials(p, q, extent), key=lambda t: (t[2], t[0] == "none", -t[3]), default=None)


def test_trials_find_large_shifts_and_refuse_false_ones():
    rng = np.random.default_rng(8)
    q = rng.uniform(0, 900, (60, 2))
    turn = np.array([[0.9995, -0.02], [0.02, 0.9995]])
    for shift in ((3, -2), (60, 40), (110, -90)):
        p = (q - shift) @ np.linalg.inv(turn).T
        method, m, n, rms = best(p, q)
        assert n >= 55 and rms < 0.1 and np.allclose(p @ m[:, :2].T + m[:, 2], q, atol=0.05)
    assert best(rng.uniform(0, 900, (12, 2)), q) is None
    assert best(q[:1], q) is None
    few = q[:8] + 100  # so few that no offset is common enough
    assert np.allclose(best(few, q[:8])[1], [[1, 0, -100], [0, 1, -100]], atol=0.01)
    assert best(q, q + rng.normal(0, 0.1, q.shape))[0] == "none"  # a correction must pay


def test_the_model_with_fewer_unknowns_unless_more_pay():
    rng = np.random.default_rng(4)
    p = rng.uniform(0, 500, (50, 2))
    noise = rng.normal(0, 0.2, p.shape)
    assert align.best_model(p, p @ np.array([[1.0, -0.01], [0.01, 1.0]]).T + [3, 4] + noise)[1] == 4
    m, unknowns = align.best_model(p, p @ np.array([[1.01, 0.004], [0.0, 0.99]]).T + [3, 4] + noise)
    assert unknowns == 6 and np.allclose(m, [[1.01, 0.004, 3], [0, 0.99, 4]], atol=0.2)
    assert align.best_model(p[:1], p[:1]) is None


def test_channels_through_neighbours(spark):
    """Channel 2 shares no star with the reference, 3 none with anything; 2 is placed through 1."""
    rng = np.random.default_rng(6)
    sky = rng.uniform(0, 250, (120, 2))
    own = {0: sky[:60], 1: sky[40:100] + [5, -3], 2: sky[75:] + [9, 4], 3: rng.uniform(0, 250, (2, 2))}
    rows = [(f, k, float(x), float(y), float(200 - k)) for f, p in own.items() for k, (x, y) in enumerate(p)]
    st = spark.createDataFrame(rows, "frame long, star long, x double, y double, peak double")
    got = {r.frame: r for r in align.align_channels(st, 0, 250.0).collect()}
    assert got[1].via == 0 and abs(got[1].c + 5) < 0.01 and abs(got[1].f - 3) < 0.01
    assert got[2].via == 1 and abs(got[2].c + 9) < 0.01 and abs(got[2].f + 4) < 0.01 and set(got) == {1, 2}
    none = spark.createDataFrame([(2, 3)], "frame long, via long")
    assert {r.frame for r in align.align_channels(st, 0, 250.0, eligible=none).collect()} == {1}


def test_samples_decide_the_seed():
    from lumenweave.operators import fit

    rng = np.random.default_rng(1)
    p = rng.uniform(0, 100, (40, 2))
    skew = np.array([[1.02, 0.05, 3], [-0.01, 0.97, -4]])
    q = fit.moved(p, skew)
    q[:9] += 30
    m, ok = fit.ransac(p, q, 1.0, 500, "affine")
    assert ok.sum() == 31 and np.allclose(m, skew)
    again = fit.ransac(p, q, 1.0, 500, "affine")
    assert np.array_equal(again[0], m) and fit.seed_of(p, q) == fit.seed_of(p.copy(), q.copy()) != fit.seed_of(q, p)
    line = np.column_stack([np.arange(6.0), np.arange(6.0)])
    assert not fit.ransac(line, line + 1, 1.0, 50, "affine")[1].any()  # no three of a line decide an affine


def test_mosaic_levels_frames_and_keeps_the_cache(spark, tmp_path):
    rng = np.random.default_rng(3)
    sky = rng.normal(0, 0.2, (40, 70)) + 5 * np.sin(np.arange(70) / 9)
    a, b = px_frame(spark, sky[:, :48] + 100), px_frame(spark, sky[:, 22:] + 130, 1)
    df = a.union(b).withColumns({"err": F.lit(1.0), "dq": F.lit(0).cast("long")}).cache()
    o = mosaic.Options(sky="match", cell=8, maps={1: s.Affine(c=22.0)})
    got = mosaic.cached_build(df, o, f"file://{tmp_path}", "f1")
    out = {(r.ox, r.oy): (r.v, r.inputs) for r in got.collect()}
    flat = np.array([out[x, 20][0] for x in range(70)]) - sky[20]
    assert np.ptp(flat) < 1.0 and out[30, 5][1] == 2 and out[60, 5][1] == 1 and len(out) == 2800
    empty = df.limit(0)
    assert mosaic.cached_build(empty, o, f"file://{tmp_path}", "f1").count() == 2800  # an equal fingerprint reads


@pytest.fixture(scope="module")
def struck(spark):
    """Five frames of one field under sub-pixel shifts, each with cosmic rays of its own: pixels, maps, places of rays and of stars."""
    rng = np.random.default_rng(21)
    y, x = np.mgrid[0:48, 0:48]
    stars_ = [(12.3, 15.8, 900.0), (30.6, 9.2, 600.0), (21.1, 33.7, 1200.0), (38.4, 36.6, 300.0)]
    maps = {k: s.Affine(c=0.37 * k, f=-0.53 * k) for k in range(5)}
    frames, rays = {}, set()
    for k in maps:
        g = rng.normal(0, 1, (48, 48))
        for a, b, peak in stars_:
            g += peak * np.exp(-((x + maps[k].c - a) ** 2 + (y + maps[k].f - b) ** 2) / (2 * 1.6**2))
        for _ in range(6):
            i, j = (int(n) for n in rng.integers(4, 44, 2))
            if min(math.hypot(i + maps[k].c - a, j + maps[k].f - b) for a, b, _ in stars_) > 7:
                g[j, i] += 80
                rays.add((k, i, j))
        frames[k] = g
    df = None
    for k, g in frames.items():
        own = px_frame(spark, g, k)
        df = own if df is None else df.union(own)
    return df.withColumns({"err": F.lit(1.0), "dq": F.lit(0).cast("long")}).cache(), frames, maps, rays, stars_


def test_model_and_blot_by_loops(spark, struck):
    from lumenweave.operators import combine

    df, frames, maps, _, _ = struck
    placed = combine.place(df, maps)
    own = {}
    for k, g in frames.items():
        sums = {}
        for j in range(48):
            for i in range(48):
                cx, cy = i + maps[k].c, j + maps[k].f
                for ox in range(math.floor(cx), math.floor(cx) + 2):
                    for oy in range(math.floor(cy), math.floor(cy) + 2):
                        w = max(0, 1 - abs(ox - cx)) * max(0, 1 - abs(oy - cy))
                        if w > 0:
                            v, n = sums.get((ox, oy), (0.0, 0.0))
                            sums[ox, oy] = v + w * g[j, i], n + w
        own[k] = {at: v / n for at, (v, n) in sums.items() if n > 1e-12}
    each = mosaic.separate(placed, "square", 1.0)
    assert {(r.frame, r.ox, r.oy): r.v for r in each.collect()} == pytest.approx({(k, *at): v for k, o in own.items() for at, v in o.items()})
    want = {at: float(np.median([o[at] for o in own.values() if at in o])) for at in set().union(*own.values())}
    model = mosaic.median_model(each, 5)
    assert {(r.x, r.y): r.v for r in model.collect()} == pytest.approx(want)
    back = {(r.frame, r.x, r.y): r.model for r in mosaic.blot(model, placed).collect()}
    assert len(back) == 5 * 48 * 48
    for (k, i, j), m in back.items():
        cx, cy = i + maps[k].c, j + maps[k].f
        fx, fy = math.floor(cx), math.floor(cy)
        w = {(fx + a, fy + b): (a * (cx - fx) + (1 - a) * (1 - cx + fx)) * (b * (cy - fy) + (1 - b) * (1 - cy + fy)) for a in (0, 1) for b in (0, 1)}
        here = {at: n for at, n in w.items() if n > 0 and at in want}
        assert m == pytest.approx(sum(n * want[at] for at, n in here.items()) / sum(here.values()))


def test_rays_go_and_stars_stay(spark, struck):
    df, frames, maps, rays, stars_ = struck
    o = mosaic.Options(sky="none", reject=True, maps=maps, weighting="err")
    from lumenweave.operators import combine

    bad = {(r.frame, r.x, r.y) for r in mosaic.rejected(combine.place(df, maps), o, 5).collect()}
    assert rays <= bad and len(rays) > 15
    off = [min(math.hypot(i + maps[k].c - a, j + maps[k].f - b) for a, b, _ in stars_) for k, i, j in bad - rays]
    assert all(d > 1.5 for d in off) and len(bad - rays) < 9 * len(rays)  # growth takes a ray's neighbours and no star's core
    clean = {(r.ox, r.oy): r.v for r in mosaic.build(df, o).collect()}
    for a, b, peak in stars_:
        ox, oy = round(a), round(b)
        want = peak * math.exp(-((ox - a) ** 2 + (oy - b) ** 2) / (2 * 1.6**2))
        assert abs(clean[ox, oy] - want) < 0.12 * peak
    quiet = [v for (i, j), v in clean.items() if 5 < i < 43 and 5 < j < 40 and min(math.hypot(i - a, j - b) for a, b, _ in stars_) > 9]
    assert max(quiet) < 6


def test_planes_come_off_in_a_build(spark):
    y, x = np.mgrid[0:40, 0:40]
    rng = np.random.default_rng(3)
    scene = rng.normal(0, 0.5, (40, 60))
    left, right = scene[:, :40] + 100, scene[:, 20:] + 130 + 0.4 * (x + 20) - 0.2 * y
    df = px_frame(spark, left).union(px_frame(spark, right, 1)).withColumns({"err": F.lit(1.0), "dq": F.lit(0).cast("long")})
    o = mosaic.Options(sky="match+plane", cell=4, maps={1: s.Affine(c=20.0)})
    out = {(r.ox, r.oy): r.v for r in mosaic.build(df, o).collect()}
    got = np.array([[out[i, j] for i in range(60)] for j in range(40)]) - scene
    assert np.ptp(got) < 1.5  # the gradient of 24 and the step of 30 are gone


def test_preparation_order(spark):
    df = px_frame(spark, np.full((4, 4), 20.0)).withColumns({"err": F.lit(2.0), "dq": F.when(F.col("x") == 0, F.expr("shiftleft(1L, 31)")).otherwise(0)})
    meta = spark.createDataFrame([(0, "counts", 10.0)], "frame long, unit string, exptime double")
    t = df.select("x", "y", F.lit(0.0).alias("t"))
    got = mosaic.prepare(df, mosaic.Options(), meta, t).collect()
    assert {r.v for r in got if r.x} == {2.0} and {r.err for r in got} == {0.2} and all(math.isnan(r.v) for r in got if not r.x)


def test_channels_keep_shared_stars(spark):
    y, x = np.mgrid[0:40, 0:40]
    rng = np.random.default_rng(4)
    star = 400 * np.exp(-((x - 12) ** 2 + (y - 12) ** 2) / (2 * 0.45**2))  # sharp enough to look like a cosmic ray
    frames = [100 + star + rng.normal(0, 1, (40, 40)) for _ in range(3)]
    frames[1][30, 30] += 400
    df = px_frame(spark, frames[0]).union(px_frame(spark, frames[1], 1)).union(px_frame(spark, frames[2], 2)).cache()
    levels = spark.createDataFrame([(k, 100.0, 3.0) for k in range(3)], "frame long, bg double, sigma double")
    hits = {(r.frame, r.x, r.y) for r in raster.clean_channels(df, levels, 40, 40).filter("hit").collect()}
    assert hits == {(1, 30, 30)}


def test_masks_go_back_to_detectors(spark):
    df = px_frame(spark, np.zeros((6, 6)))
    m = {0: s.Affine(c=10.0, f=-2.0)}
    got = raster.project_mask_back(df, spark.createDataFrame([(12, 1), (40, 40)], "x long, y long"), m)
    assert [(r.x, r.y) for r in got.collect()] == [(2, 3)]
    poly = raster.footprints(spark.createDataFrame([(0, 6, 5)], "frame long, width int, height int"), m).first().polygon
    assert [(p.x, p.y) for p in poly] == [(10, -2), (15, -2), (15, 2), (10, 2)]


def test_editing(spark):
    g = np.random.default_rng(5).uniform(0.2, 0.8, (12, 15))
    df = px_frame(spark, g)
    assert {(r.x, r.y): r.v for r in edit.turn(edit.turn(df, 15, 12, "clockwise"), 12, 15, "counter").collect()} == {(r.x, r.y): r.v for r in df.collect()}
    assert edit.crop(df, 2, 3, 7, 9).agg(F.max("x"), F.max("y"), F.count("*")).first()[:] == (4, 5, 30)
    flat = px_frame(spark, np.full((12, 15), 0.5))
    assert all(abs(r.v - 0.5) < 1e-9 for r in edit.sharpen(flat).collect())
    spot = np.full((20, 20), 0.4)
    spot[5, 5] = 0.9
    healed = {(r.x, r.y): r.v for r in edit.heal(px_frame(spark, spot), 5, 5, 3, 13, 13).collect()}
    assert all(abs(v - 0.4) < 1e-9 for v in healed.values())


def test_curves_rise_and_pass_their_points():
    t = edit.curve_table([(0, 0), (0.25, 0.1), (0.5, 0.6), (1, 1)])
    assert all(a <= b + 1e-12 for a, b in zip(t, t[1:])) and t[0] == 0 and t[-1] == 1 and abs(t[128] - 0.6) < 0.01


def test_mapper_round_trip_and_unknown_frames(spark):
    table = np.random.default_rng(6).normal(0, 0.05, (64, 64))
    m = Mapper((32, 32), (10.0, -20.0), (-1e-4, 1e-6, 1e-6, 1e-4), {(2, 0): 1e-5}, {(1, 1): -2e-5}, (table, -table))
    x, y = np.meshgrid(np.arange(1, 62, 6.0), np.arange(1, 62, 6.0))
    u, v = m.pixel(*m.sky(x, y))
    assert np.abs(u - x).max() < 0.02 and np.abs(v - y).max() < 0.02
    assert bilinear_table(np.array([[0.0, 1.0], [2.0, 3.0]]), np.array([0.5]), np.array([0.5]))[0] == 1.5
    df = spark.createDataFrame([(0, 5.0, 6.0), (9, 1.0, 1.0)], "frame long, x double, y double")
    got = {r.frame: r for r in map_pixels(df, {0: m}, m).collect()}
    assert abs(got[0].cx - 5) < 0.02 and got[9].cx is None


def test_models(spark):
    turn = {"model": "compose", "of": [{"model": "spherical_to_cartesian"}, {"model": "rotate3d", "axes": "zy", "angles": [30, 40]}, {"model": "rotate3d", "axes": "yz", "angles": [-40, -30]}, {"model": "cartesian_to_spherical"}]}
    ra, dec = compile_model(turn)((np.array([10.0, 200.0]), np.array([-5.0, 60.0])))
    assert np.allclose(ra, [10, 200]) and np.allclose(dec, [-5, 60])
    with pytest.raises(ValueError, match="unknown model"):
        compile_model({"model": "compose", "of": [{"model": "nothing"}]})
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert evaluate_model(df, {"model": "affine", "matrix": [[0, 1], [1, 0]], "translation": [5, 6]}, ["x", "y"], ["u", "v"]).first()[2:] == (7.0, 7.0)


def test_gentler_and_whiter_stars(spark):
    df = spark.createDataFrame([(0, 5, 5, 0.9), (0, 30, 30, 0.9)], "frame long, x long, y long, v double")
    src = spark.createDataFrame([(0, 5.0, 5.0, 4.0, 0.1)], "frame long, x double, y double, radius double, base double")
    got = {r.x: r.v for r in detect.gentler(df, src).collect()}
    assert abs(got[5] - (0.1 + 0.8 / 2.6)) < 1e-9 and got[30] == 0.9
    rgb = spark.createDataFrame([(0, 5, 5, 0.9, 0.5, 0.3)], "frame long, x long, y long, r double, g double, b double")
    base = src.withColumns({f"base_{c}": F.lit(0.1) for c in "rgb"})
    w = detect.whiten(rgb, base).first()
    assert abs(w.r - 0.9) < 1e-9 and abs(w.g - 0.9) < 1e-9 and abs(w.b - 0.9) < 1e-9


def test_others_profile_leaves_out_the_own(spark):
    rng = np.random.default_rng(1)
    for n in (6, 7, 12):
        levels = rng.normal(0.5, 0.2, (n, 3))
        levels[1] = levels[0]  # ties
        rows = [(0, i, k, 4, float(v)) for i, own in enumerate(levels) for k, v in enumerate(own)]
        got = {(r.id, r.ring): r.field for r in detect.field_profiles(spark.createDataFrame(rows, "frame long, id long, ring int, n long, level double")).collect()}
        assert got == {(i, k): pytest.approx(max(0, np.median(np.delete(levels[:, k], i)))) for i in range(n) for k in range(3)}
    few = spark.createDataFrame([(0, i, 0, 4, 0.5) for i in range(5)], "frame long, id long, ring int, n long, level double")
    assert {r.field for r in detect.field_profiles(few).collect()} == {None}


def test_holes_without_a_ring_are_no_stars(spark):
    y, x = np.mgrid[0:60, 0:60]
    g = 100 + 900 * np.exp(-((x - 20) ** 2 + (y - 20) ** 2) / 30) + 900 * np.exp(-((x - 59) ** 2 + (y - 40) ** 2) / 30)
    for a, b in ((20, 20), (45, 15), (59, 40)):  # a star's core, a hole in the sky, a star at the edge
        g[(x - a) ** 2 + (y - b) ** 2 <= 8] = np.nan
    df = px_frame(spark, g)
    levels = spark.createDataFrame([(0, 100.0, 2.0)], "frame long, bg double, sigma double")
    got = detect.missing_cores(df, levels, size=16).collect()
    assert [(r.x, r.y, r.area) for r in got] == [(20.0, 20.0, 25)]
