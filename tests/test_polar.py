"""Polar tables of made stars: wings, rings, spikes, halos and neutral colours."""

import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from lumenweave.operators import polar
from lumenweave.plans.queries import QUERIES

SIZE = 96
y, x = np.mgrid[0:SIZE, 0:SIZE]


def frame(spark, g, k=0):
    rows = [(k, i, j, float(g[j, i])) for j in range(g.shape[0]) for i in range(g.shape[1]) if np.isfinite(g[j, i])]
    return spark.createDataFrame(rows, "frame long, x long, y long, v double")


def at(a, b):
    return np.hypot(x - a, y - b)


def star(spark, a=48.0, b=48.0, outer=20.0, fwhm=4.0):
    return spark.createDataFrame([(0, 1, a, b, outer, fwhm, fwhm)], "frame long, id long, x double, y double, outer double, fwhm double, core double")


@pytest.fixture(scope="module")
def sky():
    return 100 + 0.05 * x + np.random.default_rng(7).normal(0, 1, (SIZE, SIZE))


def test_table_by_loops(spark, sky):
    g = sky + 500 * np.exp(-(at(47.6, 48.3) ** 2) / 18)
    src = star(spark, 47.6, 48.3, 10.0)
    got = {(r.ring, r.sector): r for r in polar.polar_table(frame(spark, g), src, 8).collect()}
    d, angle = at(47.6, 48.3), np.mod(np.arctan2(y - 48.3, x - 47.6) / (2 * math.pi), 1) * 8
    ok = (d >= 13.5) & (d <= 19)
    for k in range(3):
        m = np.median(g[ok])
        s = 1.4826 * np.median(np.abs(g[ok] - m))
        if k < 2:
            ok &= np.abs(g - m) <= 3 * s
    dx, dy = x - 47.6, y - 48.3
    gx, gy = (dx * (g - m))[ok].sum() / (dx[ok] ** 2).sum(), (dy * (g - m))[ok].sum() / (dy[ok] ** 2).sum()
    for (ring, sector), r in got.items():
        here = (np.floor(d) == ring) & (np.minimum(np.floor(angle), 7) == sector) & (d < 10)
        assert r.n == here.sum() and r.level == pytest.approx(np.median((g - m - gx * dx - gy * dy)[here])) and r.noise == pytest.approx(s)
    assert sum(r.n for r in got.values()) == (d < 10).sum()


def wing(spark, g, **kw):
    src = star(spark, **kw)
    return polar.saturated_wings(polar.polar_table(frame(spark, g), src), src).first()


def test_wings_of_cut_off_stars(spark, sky):
    light = 4000 * (1 + at(48, 48) ** 2 / 16) ** -2.5
    got = wing(spark, np.minimum(sky + light, 900))
    r = np.arange(6, 19) + 0.5
    assert got.status == "accepted" and 3 <= got.core <= 6 and got.residual < 0.2
    shape = polar._shape(r, got.width, float(got.model.partition("-")[2] or 0)) * got.amplitude
    assert np.allclose(shape, 4000 * (1 + r * r / 16) ** -2.5, rtol=0.25, atol=6)
    crossed = light + 120 * ((np.abs(x - 48) < 1.5) | (np.abs(y - 48) < 1.5)) * (at(48, 48) < 25)
    assert wing(spark, np.minimum(sky + crossed, 900)).status == "accepted"  # spikes are balanced


def test_no_wings_of_discs_and_of_neighbours(spark, sky):
    assert wing(spark, sky + 800 * (at(48, 48) < 9)).status == "rejected"
    light = 4000 * (1 + at(48, 48) ** 2 / 9) ** -2.5 + 3000 * np.exp(-(at(58, 48) ** 2) / 20)
    assert wing(spark, np.minimum(sky + light, 900)).status == "rejected"


def test_rings(spark, sky):
    d = at(48, 48)
    light = 900 * np.exp(-d * d / 8) + 60 * np.exp(-((d - 8.5) ** 2) / 1.5) + 40 * np.exp(-((d - 13.5) ** 2) / 1.5)
    found = lambda g: [r.ring for r in polar.diffraction_rings(polar.polar_table(frame(spark, g), star(spark))).orderBy("ring").collect()]
    assert found(sky + light) == [8, 13]
    assert found(sky + 900 * np.exp(-d * d / 8)) == []
    one_side = 900 * np.exp(-d * d / 8) + 200 * np.exp(-(at(57, 48) ** 2) / 4)
    assert found(sky + one_side) == []


def arms(g, a, b, angle, peak, length, width=1.2):
    t = math.radians(angle)
    along, off = (x - a) * math.cos(t) + (y - b) * math.sin(t), np.abs(-(x - a) * math.sin(t) + (y - b) * math.cos(t))
    return g + peak * np.exp(-(off**2) / (2 * (width / 2) ** 2)) * (np.abs(along) < length)


@pytest.mark.parametrize("angle", [0.0, 17.0, 63.0])
def test_spikes_at_any_angle(spark, sky, angle):
    g = arms(arms(sky, 48, 48, angle, 60, 20), 48, 48, angle + 90, 60, 20) + 2000 * np.exp(-(at(48, 48) ** 2) / 8)
    got = polar.spikes(polar.polar_table(frame(spark, g), star(spark, outer=22.0), 72), star(spark), 72).collect()
    want = [(angle + 90 * k) % 360 for k in range(4)]
    assert len(got) == 4
    assert all(min(abs((r.angle - w + 180) % 360 - 180) for w in want) <= 4 and r.length >= 8 for r in got)


def test_filaments_are_no_spikes(spark, sky):
    core = 2000 * np.exp(-(at(48, 48) ** 2) / 8)
    half = arms(sky, 48, 48, 40, 60, 25)
    one = np.where((x - 48) * math.cos(math.radians(40)) + (y - 48) * math.sin(math.radians(40)) > 0, half, sky)
    beside = arms(sky, 40, 58, 20, 60, 30)
    for g in (one + core, beside + core, sky + core):
        assert polar.spikes(polar.polar_table(frame(spark, g), star(spark, outer=22.0), 72), star(spark), 72).count() == 0


def test_halos(spark, sky):
    d = at(48, 48)
    g = sky + 2000 * np.exp(-d * d / 8) + 30 * np.exp(-d / 4)
    r = polar.halos(polar.polar_table(frame(spark, g), star(spark)), star(spark)).first()
    assert 12 <= r.reach <= 20 and r.light > 2000
    plain = polar.halos(polar.polar_table(frame(spark, sky + 2000 * np.exp(-d * d / 2)), star(spark)), star(spark)).first()
    assert plain.reach <= 8 or plain.light < 0.2 * r.light


def test_colours_over_measured_backgrounds(spark):
    rng = np.random.default_rng(2)
    tint, base = {"r": 1.0, "g": 0.7, "b": 0.4}, {"r": 0.20, "g": 0.10, "b": 0.30}
    light = np.exp(-(at(30, 40) ** 2) / 10) + np.exp(-(at(41, 40) ** 2) / 10)
    plane = {c: base[c] + 0.5 * tint[c] * light + rng.normal(0, 1e-4, (SIZE, SIZE)) for c in tint}
    rows = [(0, i, j, *(float(plane[c][j, i]) for c in "rgb")) for j in range(20, 60) for i in range(10, 62)]
    df = spark.createDataFrame(rows, "frame long, x long, y long, r double, g double, b double")
    src = spark.createDataFrame([(0, 1, 30.0, 40.0, 7.0), (0, 2, 41.0, 40.0, 7.0)], "frame long, id long, x double, y double, radius double")
    levels = {r.id: (r.base_r, r.base_g, r.base_b) for r in polar.annulus_levels(df, src).collect()}
    assert all(np.allclose(v, list(base.values()), atol=2e-3) for v in levels.values())
    out = {(r.x, r.y): (r.r, r.g, r.b) for r in polar.whitened(df, src).collect()}
    assert len(out) == len(rows)
    for a in (30, 41):
        ex = [out[a, 40][k] - base[c] for k, c in enumerate("rgb")]
        assert max(ex) - min(ex) < 0.02 and ex[0] == pytest.approx(0.5, abs=0.01)
    far = out[12, 22]
    assert np.allclose(far, [plane[c][22, 12] for c in "rgb"])
    assert polar.whitened(df.limit(0), src).count() == 0 and polar.whitened(df, src.limit(0)).agg(F.sum("r")).first()[0] == pytest.approx(sum(r[3] for r in rows))


# --- the registered queries, on all drawn stars ----------------------------------------------------


@pytest.fixture(scope="module")
def drawn(spark):
    from lumenweave.plans.q_polar import _drawn

    return {r.id: r for r in _drawn(spark, SF, lambda d: F.exp(-d), 8.0, 2.0)[1].collect()}


def named(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_query_wings(spark, drawn):
    got = named(spark, "m19_saturated_wings")
    assert {r.id for r in got} == set(drawn) and sum(r.status == "accepted" for r in got) > 0.9 * len(got)
    assert np.median([abs(r.width - 3**0.5) for r in got if r.model == "moffat-2.5"]) < 0.5


def test_query_rings(spark, drawn):
    got = named(spark, "m19_diffraction_rings")
    assert {r.id for r in got} == set(drawn) and all(r.ring in (4, 5, 6) for r in got) and len(got) == len(drawn)


def test_query_spikes(spark, drawn):
    got = named(spark, "m19_spikes")
    assert len({r.id for r in got}) > 0.95 * len(drawn)
    for r in got:
        assert min(abs((r.angle - 11 * r.frame - 7 - 90 * k + 180) % 360 - 180) for k in range(4)) <= 12  # a sector is ten degrees wide


def test_query_halos(spark, drawn):
    got = named(spark, "m19_halos")
    assert {r.id for r in got} == set(drawn) and all(r.reach >= 6 and r.light > 0 for r in got)


def test_query_whitening(spark, drawn):
    got = {(r.frame, r.x, r.y): (r.r - 0.1, r.g - 0.1, r.b - 0.2) for r in named(spark, "m21_annulus_whitening")}
    assert len(got) == 256 * 256 * len({r.frame for r in drawn.values()})
    for r in drawn.values():
        ex = got[r.frame, round(r.x), round(r.y)]
        assert max(ex) > 0.1 and max(ex) - min(ex) < 0.03 * max(ex) + 2e-3
