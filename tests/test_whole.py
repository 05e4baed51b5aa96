"""Queries over whole tables: no row of the input is left out."""

from conftest import SF

from lumenweave.plans.queries import QUERIES
from lumenweave.plans.views import pix, stars


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_votes_are_of_all_detections(spark):
    every = stars(spark, SF).collect()
    support = {a.star: len({b.exposure for b in every if (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 16}) for a in every}
    assert {r.star: r.support for r in rows(spark, "j02_consensus_votes")} == support
    chosen = rows(spark, "w03_supported_selection")
    for frame in {a.frame for a in every}:
        best = sorted((-support[a.star], a.star) for a in every if a.frame == frame and support[a.star] >= 2)[:25]
        assert sorted((r.rank, r.star) for r in chosen if r.frame == frame) == [(k + 1, star) for k, (_, star) in enumerate(best)]


def test_every_pixel_is_blurred_and_resampled(spark):
    every = sorted((p.frame, p.x, p.y) for p in pix(spark, SF).collect())
    assert sorted((r.frame, r.x, r.y) for r in rows(spark, "w09_gaussian_blur")) == every
    assert sorted((r.frame, r.id % 64, r.id // 64) for r in rows(spark, "f17_bilinear")) == every


def test_every_source_reaches_the_mask(spark):
    bits = {}
    for e in stars(spark, SF).collect():
        radius = 1.5 + e.star % 3
        for x in range(int(e.x - radius), int(e.x + radius) + 2):
            for y in range(int(e.y - radius) - 1, int(e.y + radius) + 2):
                if (x - e.x) ** 2 + (y - e.y) ** 2 <= (0.99 * radius) ** 2:
                    bits[e.frame, x, y] = bits.get((e.frame, x, y), 0) | 1 << e.star % 5
    got = {(r.frame, r.x, r.y): r.bits for r in rows(spark, "m18_star_raster")}
    assert all(got[k] & b == b for k, b in bits.items())


def test_matching_is_of_all_stars_of_frames_and_the_next(spark):
    near, every = {}, stars(spark, SF).collect()
    region = lambda s: s.x // 64 * 4 + s.y // 64
    for a in every:
        near[a.star] = [("next", b.star) for b in every if b.frame == (a.frame + 1) % 8 and region(a) == region(b) and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 36]
    owner = {}

    def place(t, seen):
        for d in near[t]:
            if d not in seen:
                seen.add(d)
                if d not in owner or place(owner[d], seen):
                    owner[d] = t
                    return True
        return False

    assert sum(r.matched for r in rows(spark, "j12_bipartite_matching")) == sum(place(t, set()) for t in near)


def test_triangles_are_of_forty_stars_in_all_frames(spark):
    got = rows(spark, "j05_triangle_match")
    same = [r for r in got if r.frame == 0]
    assert len(same) == 40 and all(r.ref == r.star and r.votes >= 39 * 38 / 2 for r in same)  # a frame against itself
    assert {r.frame for r in got} == set(range(8))


def test_neighbours_are_of_all_frames(spark):
    every = stars(spark, SF).collect()
    members = {a.star: sum(b.frame == a.frame and ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) ** 0.5 <= 3 + b.area / 4 for b in every) for a in every}
    assert {r.star: r.members for r in rows(spark, "j16_star_neighbours")} == members


def test_review_order_is_of_all_stars(spark):
    want, every = [], stars(spark, SF).collect()
    for frame in {s.frame for s in every}:
        own = [s.star for s in sorted((s for s in every if s.frame == frame), key=lambda s: (-s.area, -s.peak, s.star))]
        want += zip(own, range(1, len(own) + 1), [None, *own], [*own[1:], None])
    assert {(r.star, r.position, r.previous, r.following) for r in rows(spark, "t02_review_order")} == set(want)


def test_links_of_all_suppliers_join_components(spark):
    part = {r.n_nationkey: r.n_nationkey for r in spark.read.parquet(f"{SF}/nation.parquet").collect()}
    for s in spark.read.parquet(f"{SF}/supplier.parquet").collect():
        a, b = sorted((part[s.s_nationkey], part[s.s_suppkey * 7 % 25]))
        part = {k: a if v == b else v for k, v in part.items()}
    assert {r.frame: r.component for r in rows(spark, "w13_frame_components")} == part


def test_frames_without_sources_come_back(spark):
    v = {(p.frame, p.x, p.y): p.v for p in pix(spark, SF).collect()}
    for name, c, level in (("m20_gentler_stars", "v", 110), ("m21_whitened_stars", "r", 110)):
        got = {(r.frame, r.x, r.y): r[c] for r in rows(spark, name)}
        assert got.keys() == v.keys()
        assert all(abs(got[k] - v[k] / level) < 2e-5 for k in v if k[0] > 1)
