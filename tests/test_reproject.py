"""Planes between grids: control points against exact maps, resampling and composition against plain arrays."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from lumenweave.functions.wcs import Mapper
from lumenweave.operators import reproject
from lumenweave.plans.q_flow import _grids
from lumenweave.plans.queries import QUERIES
from lumenweave.plans.views import pix

BENT = Mapper((500.0, 400.0), (10.0, -40.0), (2e-4, 1e-5, -2e-5, 2e-4), {(2, 0): 3e-6, (0, 2): 1e-6}, {(1, 1): -2e-6, (3, 0): 1e-9})
FLAT = Mapper((600.0, 300.0), (10.01, -40.02), (1.9e-4, 0.0, 0.0, 1.9e-4))


@pytest.mark.parametrize("bound", [0.5, 0.02, 0.001])
def test_places_within_the_bound(spark, bound):
    width, height = 1000, 700
    cells = reproject.control_points(spark, {3: BENT}, FLAT, width, height, bound, 256)
    got = reproject.places(cells, width, height).toPandas().sort_values("id")
    y, x = np.divmod(np.arange(width * height), width)
    px, py = BENT.pixel(*FLAT.sky(x.astype(float), y.astype(float)))
    assert np.array_equal(got["id"], np.arange(width * height))
    assert np.hypot(got["px"] - px, got["py"] - py).max() <= 1.3 * bound
    assert cells.count() < width * height / 60


def test_a_map_that_cannot_be_interpolated(spark, monkeypatch):
    monkeypatch.setattr(reproject, "MOST_POINTS", 50)
    with pytest.raises(ValueError):
        reproject.control_points(spark, {0: BENT}, FLAT, 1000, 700, 1e-6, 256)


def test_a_frame_on_its_own_grid_stays(spark):
    rng = np.random.default_rng(1)
    g = rng.uniform(0, 9, (20, 30))
    df = spark.createDataFrame([(0, i, j, float(g[j, i])) for j in range(20) for i in range(30)], "frame long, x long, y long, v double")
    out = {(r.x, r.y): r.v for r in reproject.reproject(df, {0: FLAT}, FLAT, 30, 20).collect()}
    assert len(out) == 600 and all(abs(v - g[y, x]) < 1e-9 for (x, y), v in out.items())


def test_composition_by_arrays(spark):
    grids = _grids()
    have = {f: np.full((64, 64), np.nan) for f in range(8)}
    for r in pix(spark, SF).collect():
        have[r.frame][r.y, r.x] = r.v
    y, x = (c.astype(float) for c in np.mgrid[0:64, 0:64])
    even = {}
    for f, g in have.items():
        px, py = (c.reshape(64, 64).round(5) for c in grids[f].pixel(*grids[0].sky(x.ravel(), y.ravel())))
        total, weight = np.zeros((64, 64)), np.zeros((64, 64))
        for i in (0, 1):
            for j in (0, 1):
                a, b = np.floor(px).astype(int) + i, np.floor(py).astype(int) + j
                w = (1 - np.abs(px - a)) * (1 - np.abs(py - b))
                ok = (a >= 0) & (a < 64) & (b >= 0) & (b < 64) & (w > 0)
                v = np.where(ok, g[np.clip(b, 0, 63), np.clip(a, 0, 63)], np.nan)
                good = np.isfinite(v)
                total[good] += (w * v)[good]
                weight[good] += w[good]
        on = np.where(weight > 0, total / np.maximum(weight, 1e-300), np.nan)
        ok = np.isfinite(on)
        bins = np.floor((on[ok] - on[ok].min()) / (on[ok].max() - on[ok].min()) * 255).astype(int)
        share = np.cumsum(np.bincount(bins, minlength=256)) / ok.sum()
        even[f] = np.full((64, 64), np.nan)
        even[f][ok] = share[bins]
    mixed = {}
    for j in range(64):
        for i in range(64):
            here = [f for f in range(7) if np.isfinite(even[f][j, i])]
            if here:
                c = np.array([sum(even[f][j, i] / np.nanmax(even[f]) * ((f + k) % 3 * 0.3) for f in here) for k in range(3)])
                c = c / max(1, c.max())
                layer = np.nan_to_num(even[7][j, i]) * 0.4 * np.array([1.0, 0.5, 0.2])
                mixed[i, j] = np.clip(c + layer - c * layer, 0, 1) * 255
    got = {(r.x, r.y): np.array([r.r, r.g, r.b]) for r in QUERIES["m27_grids"](spark, SF).collect()}
    both = got.keys() & mixed.keys()
    assert len(both) > 0.97 * max(len(got), len(mixed)) and len(both) > 1500
    # a byte may be off by the step of a bin
    close = [np.abs(got[k] - mixed[k]).max() <= 3 for k in both]
    assert np.mean(close) > 0.95


def test_equalised_shares(spark):
    df = spark.createDataFrame([(0, k, 0, float(v)) for k, v in enumerate([0, 0, 1, 5, 10])] + [(1, 0, 0, 4.0)], "frame long, x long, y long, v double")
    got = {(r.frame, r.x): r.v for r in reproject.equalised(df).collect()}
    assert got == pytest.approx({(0, 0): 0.4, (0, 1): 0.4, (0, 2): 0.6, (0, 3): 0.8, (0, 4): 1.0, (1, 0): 1.0})
    assert reproject.equalised(df.withColumn("v", F.lit(float("nan")))).count() == 0
