"""Aligning frames by their stars: every matcher's fit is a row of one table, from which a frame's best is taken; frames without one are placed
through those that have one; and common stars move all frames together in one linear solution.

Matches are made on catalogs capped to a stated number of stars, so a frame's group is small; which stars of the
frames placed before a frame meets is a join on cells, and never passes the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.operators.fit import fit_affine, fit_similarity, moved, ransac, shift_of_corners
from lumenweave.operators.joins import mutual_nearest
from lumenweave.operators.series import brightest
from lumenweave.session import settled

FIT = "frame long, method string, support long, rms double, a double, b double, c double, d double, e double, f double"
STARS = 500  # of a catalog that is matched, at most: a cap of the operator itself, for the brightest stars decide a frame's place
MOST_SHIFT = 150.0  # of a corner, by a fit that is believed
NEAR = 2.0  # within which a star supports a fit
TRIANGLE_STARS = 40  # whose triangles are compared
NOISE = 0.05  # of a star's place, below which residuals of two models don't differ


def _mutual(p: np.ndarray, q: np.ndarray, radius: float, ratio: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Indexes that are each other's nearest within a radius, and, below a ratio of 1, clearly nearer than the second."""
    if not len(p) or not len(q):
        return np.empty(0, int), np.empty(0, int)
    d = np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
    near, back = d.argmin(axis=1), d.argmin(axis=0)
    own = d[np.arange(len(p)), near]
    ok = (back[near] == np.arange(len(p))) & (own <= radius)
    if ratio < 1:
        for side, at in ((d, near), (d.T, back)):
            if side.shape[1] > 1:
                two = np.partition(side, 1, axis=1)[:, :2]
                clear = (two[:, 1] > radius) | (two[:, 0] <= ratio * two[:, 1])
                ok &= clear if side is d else clear[near]
    i = np.flatnonzero(ok)
    return i, near[i]


def _by_offsets(p: np.ndarray, q: np.ndarray, window: float = 150.0, size: float = 3.0, radius: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs nearest to the commonest offset: the centroid of the fullest 3 x 3 bins of all offsets in the window."""
    d = (q[None, :, :] - p[:, None, :]).reshape(-1, 2)
    d = d[(np.abs(d) <= window).all(axis=1)]
    if not len(d):
        return np.empty(0, int), np.empty(0, int)
    bins, inverse, n = np.unique(np.floor(d / size).astype(int), axis=0, return_inverse=True, return_counts=True)
    top = int(n.argmax())
    if n[top] < 4:
        return np.empty(0, int), np.empty(0, int)
    near = (np.abs(bins - bins[top]) <= 1).all(axis=1)
    return _mutual(p + d[near[inverse.ravel()]].mean(axis=0), q, radius)


def _triangles(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (by the length of the side across, ascending) and the two side ratios of all triangles."""
    i, j, k = np.meshgrid(*[np.arange(len(p))] * 3, indexing="ij")
    t = np.argwhere((i < j) & (j < k))
    side = np.stack([np.hypot(*(p[t[:, b]] - p[t[:, c]]).T) for b, c in ((1, 2), (0, 2), (0, 1))], axis=1)
    order = np.argsort(side, axis=1)
    t, side = np.take_along_axis(t, order, axis=1), np.take_along_axis(side, order, axis=1)
    ok = side[:, 2] > 1e-9
    return t[ok], side[ok, :2] / side[ok, 2:]


def _by_triangles(p: np.ndarray, q: np.ndarray, tolerance: float = 0.01, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Pairs by votes of alike triangles of the first stars of each, which shift, turn and scale leave alone."""
    (ta, ra), (tb, rb) = _triangles(p[:TRIANGLE_STARS]), _triangles(q[:TRIANGLE_STARS])
    if not len(ta) or not len(tb):
        return np.empty(0, int), np.empty(0, int)
    order = np.argsort(rb[:, 0], kind="stable")
    lo, hi = np.searchsorted(rb[order, 0], ra[:, 0] - tolerance), np.searchsorted(rb[order, 0], ra[:, 0] + tolerance, "right")
    # every triangle of p beside each of q whose first ratio is near
    left = np.repeat(np.arange(len(ta)), hi - lo)
    right = order[np.arange(len(left)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
    alike = np.abs(ra[left, 1] - rb[right, 1]) <= tolerance
    votes = np.zeros((min(TRIANGLE_STARS, len(p)), min(TRIANGLE_STARS, len(q))), dtype=np.int64)
    np.add.at(votes, (ta[left[alike]].ravel(), tb[right[alike]].ravel()), 1)
    best, back = votes.argmax(axis=1), votes.argmax(axis=0)
    i = np.flatnonzero((back[best] == np.arange(len(votes))) & (votes.max(axis=1) >= least))
    return i, best[i]


# --- trials ---------------------------------------------------------------------------------------

#: name -> pairs (i, j) of two catalogs, brightest first
MATCHERS = {
    "none": lambda p, q: _mutual(p, q, NEAR),
    "offsets": _by_offsets,
    "nearest": lambda p, q: _mutual(p, q, 15.0, 0.8),
    "wide": lambda p, q: _mutual(p, q, 30.0, 0.8),
    "triangles": _by_triangles,
}


def believable(m: np.ndarray) -> bool:
    """Nearly the identity: no mirror, a scale within 15 %, a turn below 10 degrees."""
    det = np.linalg.det(m[:, :2])
    turn = np.degrees(np.arctan2(m[1, 0] - m[0, 1], m[0, 0] + m[1, 1]))
    return bool(det > 0 and abs(np.sqrt(max(det, 0.0)) - 1) <= 0.15 and abs(turn) < 10)


def information(p: np.ndarray, q: np.ndarray, m: np.ndarray, unknowns: int) -> float:
    """Schwarz's criterion of a map: twice the pairs times the log of the mean square residual, and a price for each unknown."""
    n = 2 * len(p)
    return n * np.log(((moved(p, m) - q) ** 2).sum() / n + NOISE**2) + unknowns * np.log(n)


def best_model(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, int] | None:
    """A map of pairs by random samples, and its unknowns: a similarity, or an affine where the criterion over the pairs of either says that its two more unknowns pay."""
    tried = {4: ransac(p, q, 1.5, 300), 6: ransac(p, q, 1.5, 2000, "affine")}
    held = {k: (m, ok) for k, (m, ok) in tried.items() if ok.sum() >= k // 2}
    if len(held) < 2:
        return next(((m, k) for k, (m, _) in held.items()), None)
    either = held[4][1] | held[6][1]
    # both are fitted again to the same pairs: a criterion compares nothing else
    fits = {4: fit_similarity(p[either], q[either]), 6: fit_affine(p[either], q[either])}
    k = min(fits, key=lambda k: information(p[either], q[either], fits[k], k))
    return held[k][0], k


def trials(p: np.ndarray, q: np.ndarray, extent: tuple[float, float], most_shift: float = MOST_SHIFT) -> list[tuple[str, np.ndarray, int, float]]:
    """(matcher, 2 x 3 map, stars that support it, RMS) of p onto q, of each matcher whose fit can be believed.

    A fit must be nearly the identity, move no corner by more than ``most_shift``, and be supported by three stars, or four by an affine of larger catalogs.
    """
    out = []
    for name, match in MATCHERS.items():
        i, j = match(p, q)
        if name == "none":
            m, unknowns = np.array([[1.0, 0, 0], [0, 1, 0]]), 0
        elif len(i) < 3 or (got := best_model(p[i], q[j])) is None:
            continue
        else:
            m, unknowns = got
        a, b = _mutual(moved(p, m), q, NEAR)
        least = 4 if unknowns == 6 and min(len(p), len(q)) > 3 else 3
        if len(a) >= least and believable(m) and shift_of_corners(m, extent) <= most_shift:
            out.append((name, m, len(a), float(np.sqrt(((moved(p[a], m) - q[b]) ** 2).sum(axis=1).mean()))))
    return out


def _tried(own: DataFrame, ref: DataFrame, key: str, extent: float) -> DataFrame:
    """All trials of catalogs (key, x, y, rank) against those of the same key, a row a matcher."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        order = lambda f: f.sort_values("rank")[["x", "y"]].to_numpy(float)
        got = trials(order(left), order(right), (extent, extent)) if len(left) and len(right) else []
        return pd.DataFrame([(left[key].iloc[0], name, n, rms, *m.ravel()) for name, m, n, rms in got], columns=[key, "method", "support", "rms", *"abcdef"])

    return own.groupBy(key).cogroup(ref.groupBy(key)).applyInPandas(run, FIT.replace("frame long", f"{key} {dict(own.dtypes)[key]}"))


def best_trials(tried: DataFrame, key: str) -> DataFrame:
    """The row of each key that most stars support; of equal ones no correction, then the least RMS."""
    order = F.struct("support", F.col("method") == "none", -F.col("rms"), "method")
    return tried.groupBy(key).agg(F.max_by(F.struct(*tried.columns), order).alias("t")).select("t.*")


def _beside(stars: DataFrame, reference: DataFrame, cap: int, pad: float) -> DataFrame:
    """Per frame of ``stars`` the brightest ``cap`` reference stars within its padded box, by cells of a box's size."""
    box = stars.groupBy("frame").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    side = 1024.0
    span = lambda c: F.explode(F.sequence(F.floor((F.col(f"lo{c}") - pad) / side), F.floor((F.col(f"hi{c}") + pad) / side)))
    cells = box.withColumn("gx", span("x")).withColumn("gy", span("y"))
    ref = reference.select("x", "y", "peak").withColumns({"gx": F.floor(F.col("x") / side), "gy": F.floor(F.col("y") / side)})
    inside = F.col("x").between(F.col("lox") - pad, F.col("hix") + pad) & F.col("y").between(F.col("loy") - pad, F.col("hiy") + pad)
    j = ref.join(cells, ["gx", "gy"]).filter(inside).select("frame", "x", "y", "peak")
    rank = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("peak"), "x", "y"))
    # new names for the plan: both sides of the cogroup may stand on one catalog
    return j.withColumn("rank", rank).filter(F.col("rank") <= cap).select(*[F.col(c).alias(c) for c in ("frame", "x", "y", "rank")])


def align_to(stars: DataFrame, reference: DataFrame, extent: float, cap: int = STARS) -> DataFrame:
    """A fit (FIT) of each frame's stars (frame, x, y, peak) to the reference's (x, y, peak): the best of the trials; frames without one are left out."""
    own = brightest(stars, cap, ["frame"]).select("frame", "x", "y", "rank")
    return best_trials(_tried(own, _beside(own, reference, cap, MOST_SHIFT), "frame", extent), "frame")


def estimate(stars: DataFrame, reference: DataFrame, model: str = "translation", cap: int = STARS) -> DataFrame:
    """A fit (FIT) of each frame to the reference by one model: ``translation`` (the median displacement of matched stars), ``similarity`` or ``affine``.

    Stars match by the commonest offset, or by alike triangles where that gives fewer than three pairs; three stars must support the fit.
    """
    fits = {
        "translation": lambda p, q: np.column_stack([np.eye(2), np.median(q - p, axis=0)]),
        "similarity": lambda p, q: ransac(p, q, 1.5, 300)[0],
        "affine": lambda p, q: ransac(p, q, 1.5, 2000, "affine")[0],
    }
    if model not in fits:
        raise ValueError(f"no model {model!r}")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        order = lambda f: f.sort_values("rank")[["x", "y"]].to_numpy(float)
        rows, p, q = [], order(left), order(right)
        how, (i, j) = max(((name, MATCHERS[name](p, q)) for name in ("offsets", "triangles")), key=lambda x: (len(x[1][0]) >= 3, x[0] == "offsets"))
        if len(i) >= 3:
            m = fits[model](p[i], q[j])
            a, b = _mutual(moved(p, m), q, NEAR)
            if len(a) >= 3:
                rms = float(np.sqrt(((moved(p[a], m) - q[b]) ** 2).sum(axis=1).mean()))
                rows = [(int(left["frame"].iloc[0]), f"{model}-{how}", len(a), rms, *m.ravel())]
        return pd.DataFrame(rows, columns=["frame", "method", "support", "rms", *"abcdef"])

    own = brightest(stars, cap, ["frame"]).select("frame", "x", "y", "rank")
    ref = _beside(own, reference, cap, MOST_SHIFT)
    return own.groupBy("frame").cogroup(ref.groupBy("frame")).applyInPandas(run, FIT)


def transformed(stars: DataFrame, fits: DataFrame) -> DataFrame:
    """Stars in the reference's grid."""
    j = stars.join(F.broadcast(fits.select("frame", *"abcdef")), "frame")  # a row a frame
    x, y = F.col("x"), F.col("y")
    return j.select(
        *[c for c in stars.columns if c not in ("x", "y")], (F.col("a") * x + F.col("b") * y + F.col("c")).alias("x"), (F.col("d") * x + F.col("e") * y + F.col("f")).alias("y")
    )


def align_frames(stars: DataFrame, reference_frame: int, extent: float, adjust: bool = False) -> DataFrame:
    """Fits of all frames that can be placed: directly first, then through the stars of frames placed before, until none is added.

    A row a frame comes to the driver between rounds, stars don't. With ``adjust`` the bundle moves all but the reference
    once more, where that brings the frames' common stars closer.
    """
    spark = stars.sparkSession
    rows: list[tuple] = [(reference_frame, "reference", 0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)]
    n = 0
    while True:
        done = spark.createDataFrame(rows, FIT)
        left = stars.join(F.broadcast(done.select("frame")), "frame", "left_anti")  # a row a frame
        new = align_to(left, transformed(stars, done), extent).collect()
        if not new:
            break
        rows += [(r["frame"], ("chain-" if n else "") + r["method"], *r[2:]) for r in new]
        n += 1
    return bundled(stars, done, reference_frame, extent) if adjust else done


# --- bundle ---------------------------------------------------------------------------------------

COMMON, LEAST, STEP = 3.0, 6, 25.0  # radius of common stars, pairs that a frame needs, largest move of a corner
GAIN = 0.999  # of the RMS before, which a component's solution must fall below


def common_stars(placed: DataFrame, cap: int = STARS) -> DataFrame:
    """Pairs (i, j, xi, yi, xj, yj) of frames' stars (frame, star, x, y, peak) that are each other's nearest within COMMON, of all frames i < j."""
    top = brightest(placed, cap, ["frame"]).select("frame", "star", "x", "y")
    cell = lambda df: df.withColumns({"gx": F.floor(F.col("x") / 256), "gy": F.floor(F.col("y") / 256)})
    # frames meet where both have stars in a cell
    where = cell(top).select("frame", "gx", "gy").distinct()
    pairs = where.select(F.col("frame").alias("i"), "gx", "gy").join(where.select(F.col("frame").alias("j"), "gx", "gy"), ["gx", "gy"]).filter("i < j").select("i", "j").distinct()
    pairs = pairs.withColumn("pair", F.concat_ws(":", "i", "j"))
    a = pairs.join(top.withColumnRenamed("frame", "i"), "i").select("pair", "star", "x", "y")
    b = pairs.join(top.withColumnRenamed("frame", "j"), "j").select("pair", "star", "x", "y")
    near = mutual_nearest(a, b, COMMON, 1.0, ["pair"]).select("pair", "star", "r_star")
    at = lambda side, star: near.join(side.select("pair", F.col("star").alias(star), F.col("x").alias(f"x_{star}"), F.col("y").alias(f"y_{star}")), ["pair", star])
    both = at(a, "star").join(at(b, "r_star").select("pair", "star", "x_r_star", "y_r_star"), ["pair", "star"]).join(pairs, "pair")
    return both.select("i", "j", F.col("x_star").alias("xi"), F.col("y_star").alias("yi"), F.col("x_r_star").alias("xj"), F.col("y_r_star").alias("yj"))


def _normal_sums(pairs: DataFrame) -> DataFrame:
    """Sums by pair of frames that the normal equations of small similarities are made of; a similarity moves (x, y) by (s x - r y + t, r x + s y + u)."""
    xi, yi, xj, yj = (F.col(c) for c in ("xi", "yi", "xj", "yj"))
    dx, dy = xi - xj, yi - yj
    sums = {"n": F.lit(1.0), "sxi": xi, "syi": yi, "sxj": xj, "syj": yj, "ii": xi * xi + yi * yi, "jj": xj * xj + yj * yj}
    sums |= {"dot": xi * xj + yi * yj, "cross": xi * yj - yi * xj, "dx": dx, "dy": dy}
    sums |= {"si": xi * dx + yi * dy, "ri": xi * dy - yi * dx, "sj": xj * dx + yj * dy, "rj": xj * dy - yj * dx}
    return pairs.groupBy("component", "i", "j").agg(*[F.sum(c).alias(k) for k, c in sums.items()])


def _moves(sums: DataFrame, held: int, extent: float) -> DataFrame:
    """(component, frame, ua .. uf): the small similarity of each frame that brings common stars together, all frames of a component in one solution.

    ``held`` stays where it is, or the component's lowest frame does; so do frames of under LEAST pairs, and those whose move
    can't be believed or takes a corner further than STEP, without which the others are solved again.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(pdf[["i", "j"]].to_numpy())
        i, j = np.searchsorted(nodes, pdf["i"]), np.searchsorted(nodes, pdf["j"])
        c = {k: pdf[k].to_numpy() for k in pdf.columns}
        zero = np.zeros(len(pdf))
        block = lambda rows: np.array(rows).transpose(2, 0, 1)
        own = lambda x, y, xx: block([[xx, zero, x, y], [zero, xx, -y, x], [x, -y, c["n"], zero], [y, x, zero, c["n"]]])
        both = block([
            [c["dot"], -c["cross"], c["sxi"], c["syi"]], [c["cross"], c["dot"], -c["syi"], c["sxi"]],
            [c["sxj"], -c["syj"], c["n"], zero], [c["syj"], c["sxj"], zero, c["n"]],
        ])
        m, b = np.zeros((len(nodes), 4, len(nodes), 4)), np.zeros((len(nodes), 4))
        np.add.at(m, (i, slice(None), i), own(c["sxi"], c["syi"], c["ii"]))
        np.add.at(m, (j, slice(None), j), own(c["sxj"], c["syj"], c["jj"]))
        np.add.at(m, (i, slice(None), j), -both)
        np.add.at(m, (j, slice(None), i), -both.transpose(0, 2, 1))
        np.add.at(b, i, -np.stack([c["si"], c["ri"], c["dx"], c["dy"]], axis=1))
        np.add.at(b, j, np.stack([c["sj"], c["rj"], c["dx"], c["dy"]], axis=1))
        m, b = m.reshape(4 * len(nodes), -1), b.ravel()
        number = np.bincount(i, c["n"], len(nodes)) + np.bincount(j, c["n"], len(nodes))
        free = (number >= LEAST) & (nodes != (held if held in nodes else nodes[0]))
        x = np.zeros((len(nodes), 4))
        while True:
            at = np.repeat(free, 4)
            x[:] = 0
            if at.any():
                x[free] = np.linalg.lstsq(m[np.ix_(at, at)], b[at], rcond=None)[0].reshape(-1, 4)
            maps = [np.array([[1 + s, -r, t], [r, 1 + s, u]]) for s, r, t, u in x]
            wrong = np.array([not believable(u) or shift_of_corners(u, (extent, extent)) > STEP for u in maps])
            if not wrong.any():
                break
            free &= ~wrong
        return pd.DataFrame([(key[0], f, *u.ravel()) for f, u in zip(nodes.tolist(), maps)], columns=["component", "frame", *(f"u{k}" for k in "abcdef")])

    return sums.groupBy("component").applyInPandas(run, "component long, frame long, " + ", ".join(f"u{k} double" for k in "abcdef"))


def bundle(pairs: DataFrame, comps: DataFrame, held: int, extent: float, passes: int = 2, sigmas: float = 3.0) -> DataFrame:
    """Moves (component, frame, ua .. uf, before, after) that bring common stars (i, j, xi, yi, xj, yj) together, and the RMS of a component's pairs before and after.

    Pairs that a solution leaves beyond some deviations go, and the rest are solved again. A component whose RMS over all pairs doesn't fall below GAIN of itself stays as it was.
    Pairs meet moves of a row a frame in joins; a component's group holds a row a pair of frames.
    """
    every = settled(pairs.join(comps.select(F.col("frame").alias("i"), "component"), "i"), "common-stars")

    def left(of: DataFrame, moves: DataFrame) -> DataFrame:
        side = lambda at: moves.select(F.col("frame").alias(at), *[F.col(f"u{k}").alias(f"{k}{at}") for k in "abcdef"])
        j = of.join(side("i"), "i").join(side("j"), "j")
        to = lambda u, v, w, at: F.col(u + at) * F.col("x" + at) + F.col(v + at) * F.col("y" + at) + F.col(w + at)
        dx, dy = to("a", "b", "c", "i") - to("a", "b", "c", "j"), to("d", "e", "f", "i") - to("d", "e", "f", "j")
        return j.select(*of.columns, (dx * dx + dy * dy).alias("square"))

    kept, n = every, every.count()
    for k in range(passes):
        moves = settled(_moves(_normal_sums(kept), held, extent), "moves")
        if k == passes - 1:
            break
        rest = left(kept, moves)
        level = rest.groupBy("component").agg(F.avg("square").alias("mean"))
        kept = settled(rest.join(level, "component").filter(F.col("square") <= sigmas**2 * F.col("mean") + 1e-18).select(*every.columns), "common-stars")
        if kept.count() == n:
            break
    square = (F.col("xi") - F.col("xj")) ** 2 + (F.col("yi") - F.col("yj")) ** 2
    score = left(every, moves).groupBy("component").agg(F.sqrt(F.avg(square)).alias("before"), F.sqrt(F.avg("square")).alias("after"))
    better = F.col("after") < GAIN * F.col("before")
    same = dict(zip("abcdef", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)))
    chosen = [F.when(better, F.col(f"u{k}")).otherwise(F.lit(v)).alias(f"u{k}") for k, v in same.items()]
    return moves.join(score, "component").select("component", "frame", *chosen, "before", F.when(better, F.col("after")).otherwise(F.col("before")).alias("after"))


def composed(fits: DataFrame, after: str = "u") -> list:
    """Columns a .. f of the map ``a .. f`` followed by the map of the columns with the prefix."""
    c, u = F.col, lambda k: F.col(after + k)
    row = lambda x, y, z: [u(x) * c("a") + u(y) * c("d"), u(x) * c("b") + u(y) * c("e"), u(x) * c("c") + u(y) * c("f") + u(z)]
    return [v.alias(k) for k, v in zip("abcdef", row("a", "b", "c") + row("d", "e", "f"))]


def bundled(stars: DataFrame, fits: DataFrame, reference_frame: int, extent: float) -> DataFrame:
    """``fits`` with the bundle's moves behind them. Common stars are found by joins."""
    from lumenweave.operators.graph import frame_components

    fits = settled(fits, "fits")
    pairs = settled(common_stars(transformed(stars, fits)), "common-stars")
    comps = frame_components(fits.select("frame"), pairs.select("i", "j").distinct())
    moves = bundle(pairs, comps, reference_frame, extent)
    j = fits.join(moves, "frame", "left").fillna({"ua": 1.0, "ub": 0.0, "uc": 0.0, "ud": 0.0, "ue": 1.0, "uf": 0.0})
    return j.select("frame", "method", "support", "rms", *composed(j))


def align_frames(stars: DataFrame, reference_frame: int, extent: float, adjust: bool = False) -> DataFrame:
    """Fits of all frames that can be placed: directly first, then through the stars of frames placed before, until none is added.

    Fits, a row a frame, are written between rounds. With ``adjust`` the bundle moves all but the reference
    once more, where that brings the frames' common stars closer.
    """
    done = settled(stars.sparkSession.createDataFrame([(reference_frame, "reference", 0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], FIT), "fits")
    way = ""
    while True:
        new = align_to(stars.join(done.select("frame"), "frame", "left_anti"), transformed(stars, done), extent)
        new = settled(new.withColumn("method", F.concat(F.lit(way), "method")), "fits")
        if new.isEmpty():
            break
        done, way = settled(done.unionByName(new), "fits"), "chain-"
    return bundled(stars, done, reference_frame, extent) if adjust else done


CHANNEL = "frame long, via long, " + FIT.partition(", ")[2]


def align_channels(stars: DataFrame, reference: int, extent: float, eligible: DataFrame | None = None, least: int = 8, most_rms: float = NEAR) -> DataFrame:
    """Fits (frame, via and a fit's columns) of colour channels (``frame``) that share a grid to one of them: directly, or else through a channel that has been placed.

    Catalogs are spread over the field. What the reference can't place is tried against every channel placed in the rounds before, in pairs of ``eligible`` (frame, via;
    all if not given), until a round places none. A fit needs ``least`` stars and an RMS of ``most_rms``; of several ways the one with most stars is
    taken, and its map goes behind that of the channel it leads through. ``via`` is the reference for direct fits; channels without a way are left out.
    """
    from lumenweave.operators.series import spread

    even = settled(spread(stars, STARS, ["frame"], extent).withColumn("rank", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("peak"), "x", "y"))).select("frame", "x", "y", "rank"), "channels")
    every = even.select("frame").distinct()
    identity = [F.lit(float(v)).alias(k) for k, v in zip("abcdef", (1, 0, 0, 0, 1, 0))]
    placed = every.filter(F.col("frame") == reference).select("frame", F.col("frame").alias("via"), F.lit("reference").alias("method"), F.lit(0).cast("long").alias("support"), F.lit(0.0).alias("rms"), *identity)
    placed = settled(placed, "placed")
    newest = placed
    while True:
        pairs = every.join(placed, "frame", "left_anti").crossJoin(F.broadcast(newest.select(F.col("frame").alias("via"))))  # channels, a handful
        if eligible is not None:
            pairs = pairs.join(eligible.select("frame", "via"), ["frame", "via"], "left_semi").union(pairs.filter(F.col("via") == reference)).distinct()
        pairs = pairs.withColumn("pair", F.concat_ws(":", "frame", "via"))
        own = even.join(pairs, "frame").select("pair", "x", "y", "rank")
        ref = even.select(F.col("frame").alias("via"), "x", "y", "rank").join(pairs, "via")
        ref = ref.select(*[F.col(c).alias(c) for c in ("pair", "x", "y", "rank")])  # new names for the plan, as in _beside
        tried = _tried(own, ref, "pair", extent).filter((F.col("support") >= least) & (F.col("rms") <= most_rms))
        found = best_trials(tried, "pair").join(pairs, "pair").select("frame", "via", "method", "support", "rms", *"abcdef")
        found = found.groupBy("frame").agg(F.max_by(F.struct(*found.columns), F.struct("support", -F.col("rms"), -F.col("via"))).alias("t")).select("t.*")
        parents = placed.select(F.col("frame").alias("via"), *[F.col(k).alias(f"u{k}") for k in "abcdef"])
        j = found.join(parents, "via")
        newest = settled(j.select("frame", "via", "method", "support", "rms", *composed(j)), "placed")
        if newest.isEmpty():
            return placed.filter(F.col("frame") != reference)
        placed = settled(placed.unionByName(newest), "placed")


def warped(df: DataFrame, fits: DataFrame, width: int, height: int) -> DataFrame:
    """Frames (frame, x, y, v) resampled to the reference's grid by their fits: each output pixel takes the bilinear value at its source place."""
    from lumenweave.operators.raster import resample

    c = F.col
    det = c("a") * c("e") - c("b") * c("d")
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    out = fits.filter(F.abs(det) > 1e-12).select("frame", *"abcdef", span(width).alias("ox")).withColumn("oy", span(height))
    u, v = c("ox") - c("c"), c("oy") - c("f")
    points = out.select("frame", (c("oy") * width + c("ox")).alias("id"), ((c("e") * u - c("b") * v) / det).alias("px"), ((c("a") * v - c("d") * u) / det).alias("py"))
    got = resample(df, points)
    return got.select("frame", (c("id") % width).alias("x"), F.floor(c("id") / width).alias("y"), "v")
