"""Neighbours within a radius without their pairs, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.operators import joins, near
from lumenweave.operators.near import counts_within, nearest_two


def _places(seed, n, span, whole):
    g = np.random.default_rng(seed)
    x, y = g.integers(0, span * 1000, n) / 1000, g.integers(0, span, n).astype(float)
    return (np.round(x), y) if whole else (x, y)


@pytest.mark.parametrize("whole", [True, False])
def test_counts_are_those_of_all_pairs(whole):
    (ax, ay), (bx, by) = _places(1, 400, 30, whole), _places(2, 500, 30, whole)
    g = np.random.default_rng(3)
    reach, n = 3 + g.integers(1, 41, len(bx)) / 4, g.integers(1, 4, len(bx))
    ax, ay = np.unique(np.stack([ax, ay]), axis=1)
    dx, dy = ax[:, None] - bx, ay[:, None] - by
    assert (counts_within(ax, ay, bx, by, reach, n) == ((np.sqrt(dx * dx + dy * dy) <= reach) * n).sum(axis=1)).all()


@pytest.mark.parametrize("whole", [True, False])
def test_two_nearest_are_those_of_all_pairs(whole):
    (ax, ay), (bx, by) = _places(4, 300, 25, whole), _places(5, 300, 25, whole)
    bx, by = np.unique(np.stack([bx, by]), axis=1)
    star, n = np.random.default_rng(6).permutation(len(bx)), np.random.default_rng(7).integers(1, 3, len(bx))
    found, best, second = nearest_two(ax, ay, bx, by, star, n, 2.0)
    for k in range(len(ax)):
        d = np.sqrt((ax[k] - bx) * (ax[k] - bx) + (ay[k] - by) * (ay[k] - by))
        every = sorted((d[i], star[i]) for i in range(len(bx)) if d[i] <= 2.0 for _ in range(n[i]))
        assert (found[k], best[k]) == ((every[0][1], every[0][0]) if every else (-1, np.inf))
        assert second[k] == (every[1][0] if len(every) > 1 else np.inf)


def _crowd(spark, copies):
    """A thousand places, with as many stars each as there are copies."""
    return spark.range(1000 * copies).select((F.col("id") % 2).alias("frame"), F.col("id").alias("star"), ((F.col("id") % 1000) * 13 % 256 / 8).alias("x"), ((F.col("id") % 1000) % 32).cast("double").alias("y"), (F.col("id") % 6).alias("exposure"))


@pytest.mark.parametrize("name", ["mutual_nearest", "votes", "members"])
def test_no_step_makes_pairs(spark, name, monkeypatch):
    """Stars at one place, or near each other, don't meet one by one: a radius join would make over a hundred million pairs here."""
    monkeypatch.setattr(joins, "radius_join", None)
    st = _crowd(spark, 60)
    if name == "mutual_nearest":
        got = joins.mutual_nearest(st, st, 8.0, 1.0, ["frame"]).collect()
        assert len(got) == st.select("frame", "x", "y").distinct().count() and all(r.star == r.r_star and r.dist == 0 for r in got)
    elif name == "votes":
        assert joins.votes(st, 4.0).filter("support = 6").count() == 60000
    else:
        discs = st.groupBy("frame", "x", "y").agg(F.count("*").alias("n")).withColumn("reach", F.lit(1e-3))
        got = near.neighbours_within(st, discs, 1e-2, ["frame"], "members").agg(F.sum("members")).first()[0]
        assert got == 60000


def test_places_that_are_missing_have_no_neighbours(spark):
    st = spark.createDataFrame([(0, 1, 5.0, 5.0), (0, 2, None, 5.0), (0, 3, float("nan"), 5.0)], "frame long, star long, x double, y double")
    assert [tuple(r) for r in joins.mutual_nearest(st, st, 2.0, 1.0, ["frame"]).collect()] == [(0, 1, 1, 0.0)]


def test_ranks_stop_before_a_group_comes_together(spark):
    """Ranks are limited in each task, and no window sums a whole group; groups of a null key are kept."""
    from lumenweave.operators.series import supported

    rows = [(f, k, k % 5 if f != 1 else 1) for f in (0, 1, None) for k in range(200)]
    got = supported(spark.createDataFrame(rows, "frame long, star long, support long"), 25, ["frame"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "sum(" not in plan
    want = {(f, s) for f in (0, None) for s in sorted(range(200), key=lambda k: (-(k % 5), k))[:25]} | {(1, s) for s in range(25)}
    assert {(r.frame, r.star) for r in got.collect() if not r.fallback or r.frame == 1} == want


def test_support_by_the_map_of_all_frames_is_from_two_nearest(spark, monkeypatch):
    """j13: frames against frame 0, with no join of pairs."""
    from conftest import SF
    from lumenweave.plans.queries import QUERIES

    monkeypatch.setattr(joins, "radius_join", None)
    got = {r.frame for r in QUERIES["j13_global_support"](spark, SF).collect()}
    assert got and got <= set(range(1, 8))
    assert QUERIES["j16_star_neighbours"](spark, SF).count() == QUERIES["j02_consensus_votes"](spark, SF).count()


def test_squares_are_compared_where_the_sql_compares_squares(spark):
    """j02_radius_join: 25 and a rounding is beyond 25, though its root is 5."""
    a, b = (spark.createDataFrame([(0, *p)], "star long, x double, y double") for p in ((4.69, 26.0), (1.69, 22.0)))
    assert (4.69 - 1.69) ** 2 + 16.0 > 25
    assert joins.radius_join(a, b, 5.0, squared=True).count() == 0
    assert joins.radius_join(a, b, 5.0).count() == 1


def test_mutual_nearest_is_decided_in_one_pass(spark, monkeypatch):
    """j13, j03: the pairs of plain loops at every size of cells, over their edges too, with four shuffles by place and cell and no join; a null key meets none."""
    g = np.random.default_rng(8)
    sides = [[(f, int(k), float(g.integers(0, 480)) / 16, float(g.integers(0, 30))) for k, f in enumerate([0, 1, None] * 120)] for _ in "ab"]
    monkeypatch.setattr(near, "CROWD", 10)  # cells of four radii
    a, b = (spark.createDataFrame(rows, "frame long, star long, x double, y double") for rows in sides)
    for keys in (["frame"], []):
        want, best = set(), {}
        for mine, others, way in ((sides[0], sides[1], 0), (sides[1], sides[0], 1)):
            for f, star, x, y in mine:
                near_by = sorted((((x - u) * (x - u) + (y - v) * (y - v)) ** 0.5, k) for e, k, u, v in others if not keys or e == f is not None)
                best[way, star] = [(d, k) for d, k in near_by if d <= 2.0][:2]
        for (way, star), got in best.items():
            if way == 0 and got and best[1, got[0][1]][0][1] == star:
                other = best[1, got[0][1]]
                if all(len(x) < 2 or x[0][0] <= 0.85 * x[1][0] for x in (got, other)):
                    want.add((star, got[0][1]))
        pairs = joins.mutual_nearest(a, b, 2.0, 0.85, keys)
        assert {(r.star, r.r_star) for r in pairs.collect()} == want and len(want) > 20
    plan = joins.mutual_nearest(a, b, 2.0, 0.85, ["frame"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4 and "Join" not in plan


@pytest.mark.parametrize("squared", [True, False])
def test_all_pairs_are_those_of_plain_loops(spark, squared, monkeypatch):
    """j02_radius_join: rows of one place, places at the radius and over the edges of cells, cells of one task and of several; no place or no key, no pair."""
    g = np.random.default_rng(9)
    sides = [[(int(g.integers(0, 2)), int(k), float(g.integers(-80, 80)) / 4, float(g.integers(-3, 3))) for k in range(300)] + [(0, 300, None, 1.0), (0, 301, 1.0, float("nan")), (None, 302, 1.0, 1.0)] for _ in "ab"]
    monkeypatch.setattr(joins, "PAIRS", 40)
    monkeypatch.setattr(joins, "LIST", 2)
    a, b = (spark.createDataFrame(rows, "frame long, star long, x double, y double") for rows in sides)
    for keys in (["frame"], []):
        want = []
        for f, star, x, y in sides[0]:
            for e, other, u, v in sides[1]:
                if x is not None and u is not None and (not keys or (e == f and f is not None)):
                    square = (x - u) * (x - u) + (y - v) * (y - v)
                    want += [(star, other, square**0.5)] * (square <= 2.5 * 2.5 if squared else square**0.5 <= 2.5)
        got = joins.all_pairs(a, b, 2.5, keys, squared)
        assert got.columns == joins.radius_join(a, b, 2.5, keys).columns
        assert sorted((r.star, r.r_star, r.dist) for r in got.collect()) == sorted(want) and len(want) > 1000
