"""Overlap graphs: components, and sky offsets or planes that make overlaps agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.session import settled


def connected(edges: DataFrame, every: int = 3) -> DataFrame:
    """(id, component) of the ends of ``edges`` (a, b): the least id that links reach, by joins, with labels followed as pointers.

    Plans are cut every few rounds by a reliable checkpoint where the session has a checkpoint folder.
    """
    spark = edges.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    keep = lambda df: df.checkpoint() if folder or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.cache()
    both = keep(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = keep(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("l")).withColumnRenamed("u", "id")
        low = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "l").alias("low"))
        jump = low.join(labels.select(F.col("id").alias("low"), F.col("label").alias("over")), "low", "left")
        nxt = keep(jump.select("id", F.coalesce(F.least("low", "over"), "low").alias("label"), "old"))
        labels = nxt.select("id", "label")
        if nxt.filter("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def frame_components(frames: DataFrame, edges: DataFrame) -> DataFrame:
    """Every frame with its component; one without an overlap is its own."""
    comp = connected(edges.select(F.col("i").alias("a"), F.col("j").alias("b")))
    return frames.select(F.col("frame").alias("id")).distinct().join(comp, "id", "left").select(F.col("id").alias("frame"), F.coalesce("component", "id").alias("component"))


def overlap_edges(differences: DataFrame, least: int = 8) -> DataFrame:
    """An edge a pair of frames: median difference, cells, weight (their root)."""
    e = differences.groupBy("i", "j").agg(F.median("delta").alias("delta"), F.count("*").alias("cells")).filter(F.col("cells") >= least)
    return e.withColumn("weight", F.sqrt(F.col("cells").cast("double")))


def _solve(i, j, delta, w, nodes):
    at = {n: k for k, n in enumerate(nodes)}
    a = np.eye(len(nodes)) * 1e-9
    b = np.zeros(len(nodes))
    for p, q, d, k in zip(i, j, delta, w):
        p, q = at[p], at[q]
        a[p, p] += k
        a[q, q] += k
        a[p, q] -= k
        a[q, p] -= k
        b[q] += k * d
        b[p] -= k * d
    out = np.zeros(len(nodes))
    if len(nodes) > 1:
        out[1:] = np.linalg.solve(a[1:, 1:], b[1:])
    return out


def _whole(i, j, nodes) -> bool:
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in zip(i, j):
        top[find(a)] = find(b)
    return len({find(n) for n in nodes}) <= 1


def solve_offsets(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """Offsets o that minimise the sum of w * (delta - (o_j - o_i)) ** 2 in each component, its lowest frame at 0.

    Edges beyond three robust deviations of the residuals go once, if the component still hangs together. A
    component is a set of frames: its edge list is small whatever the pixels behind it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["i"]) | set(pdf["j"]))
        i, j, d, w = (pdf[c].to_numpy() for c in ("i", "j", "delta", "weight"))
        o = _solve(i, j, d, w, nodes)
        at = {n: k for k, n in enumerate(nodes)}
        res = d - np.array([o[at[b]] - o[at[a]] for a, b in zip(i, j)])
        mad = 1.4826 * np.median(np.abs(res - np.median(res)))
        keep = np.abs(res) <= 3 * mad
        if mad > 0 and not keep.all() and _whole(i[keep], j[keep], nodes):
            o = _solve(i[keep], j[keep], d[keep], w[keep], nodes)
        return pd.DataFrame({"frame": nodes, "offset": o})

    inside = edges.join(comps.withColumnRenamed("frame", "i"), "i")
    return inside.groupBy("component").applyInPandas(run, "frame long, offset double")


def _planes(cells: DataFrame, ridge: float) -> DataFrame:
    """(component, frame, a, b, c) that fit the cells' differences (component, i, j, weight, u, v, delta) best; slopes have a ridge, and a component's lowest frame is flat.

    Products are summed by pair of frames first, so a component's group holds one row a pair.
    """
    u, v, d, w = (F.col(c) for c in ("u", "v", "delta", "weight"))
    sums = {"n": w, "su": w * u, "sv": w * v, "suu": w * u * u, "suv": w * u * v, "svv": w * v * v, "d": w * d, "du": w * d * u, "dv": w * d * v}
    pair = cells.groupBy("component", "i", "j").agg(*[F.sum(c).alias(k) for k, c in sums.items()])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(pdf[["i", "j"]].to_numpy())
        i, j = np.searchsorted(nodes, pdf["i"]), np.searchsorted(nodes, pdf["j"])
        blocks = pdf[["suu", "suv", "su", "suv", "svv", "sv", "su", "sv", "n"]].to_numpy().reshape(-1, 3, 3)
        sides = pdf[["du", "dv", "d"]].to_numpy()
        m, b = np.zeros((len(nodes), 3, len(nodes), 3)), np.zeros((len(nodes), 3))
        for one, two, sign in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1)):
            np.add.at(m, (one, slice(None), two), sign * blocks)
        np.add.at(b, j, sides)
        np.add.at(b, i, -sides)
        m, b = m.reshape(3 * len(nodes), -1), b.ravel()
        m[np.diag_indices_from(m)] += np.tile([ridge, ridge, 0.0], len(nodes)) + 1e-9
        free = np.repeat(nodes != key[0], 3)
        out = np.zeros(3 * len(nodes))
        out[free] = np.linalg.solve(m[np.ix_(free, free)], b[free])
        return pd.DataFrame({"component": key[0], "frame": nodes, "a": out[0::3], "b": out[1::3], "c": out[2::3]})

    return pair.groupBy("component").applyInPandas(run, "component long, frame long, a double, b double, c double")


def solve_planes(
    differences: DataFrame, comps: DataFrame, extent: float, ridge: float = 0.01, passes: int = 2, low: float = 3.0, high: float = 3.0, least: int = 8
) -> DataFrame:
    """Per frame a plane a u + b v + c such that differences of planes fit the cells' differences, with u = (cx + 0.5) / extent and v alike.

    A cell counts with the root of its pair's number of cells; pairs of under ``least`` don't take part. After each of up to ``passes`` solutions the
    cells whose residuals lie beyond ``low`` or ``high`` deviations of their component's mean go, and what is left is solved again. Cells meet planes of a row a frame
    in joins; only sums by pair of frames come together in a component's group. A frame that loses all cells keeps the plane it had.
    """
    numbers = differences.groupBy("i", "j").agg(F.count("*").alias("cells")).filter(F.col("cells") >= least)
    cells = differences.join(numbers, ["i", "j"]).join(comps.select(F.col("frame").alias("i"), "component"), "i").select(
        "component", "i", "j", F.sqrt("cells").alias("weight"), ((F.col("cx") + 0.5) / extent).alias("u"), ((F.col("cy") + 0.5) / extent).alias("v"), "delta"
    )
    cells = settled(cells, "plane-cells")
    planes = settled(_planes(cells, ridge), "planes")
    for _ in range(passes):
        side = lambda at: planes.select(F.col("frame").alias(at), *[F.col(c).alias(c + at) for c in "abc"])
        fit = (F.col("aj") - F.col("ai")) * F.col("u") + (F.col("bj") - F.col("bi")) * F.col("v") + F.col("cj") - F.col("ci")
        left = cells.join(side("i"), "i").join(side("j"), "j").withColumn("residual", F.col("delta") - fit)
        level = left.groupBy("component").agg(F.avg("residual").alias("mean"), F.stddev_pop("residual").alias("spread"))
        inside = (F.col("spread") <= 0) | F.col("residual").between(F.col("mean") - low * F.col("spread"), F.col("mean") + high * F.col("spread"))
        kept = settled(left.join(level, "component").filter(inside).select(*cells.columns), "plane-cells")
        if kept.count() == cells.count():
            break
        cells = kept
        new = _planes(cells, ridge)
        planes = settled(new.unionByName(planes.join(new.select("frame"), "frame", "left_anti")), "planes")
    return planes.select("frame", "a", "b", "c")


def plan_planes(sky: DataFrame, planes: DataFrame) -> DataFrame:
    """The ``match+plane`` plan: what to take off each frame (frame, sky, a, b, c) is its plane alone, whose c holds the level; a frame
    without a plane keeps its own sky and is flat."""
    p = planes.select("frame", "a", "b", "c")
    flat = {c: F.coalesce(c, F.lit(0.0)) for c in "abc"}
    return sky.join(p, "frame", "left").select("frame", F.when(F.col("c").isNull(), F.col("sky")).otherwise(0.0).alias("sky"), *[v.alias(k) for k, v in flat.items()])


def plan_sky(sky: DataFrame, offsets: DataFrame, method: str, group: str = "file") -> DataFrame:
    """Sky of each frame (columns frame, group, sky) by method: localmin, globalmin, match, globalmin+match or none of those: its own.

    A frame that the graph doesn't reach keeps its own sky.
    """
    s = sky.join(offsets, "frame", "left")
    everywhere = Window.partitionBy(F.lit(0))  # a row a frame
    low = F.min("sky").over(everywhere)
    rel = F.min("offset").over(everywhere)
    value = {
        "localmin": F.min("sky").over(Window.partitionBy(group)),
        "globalmin": low,
        "match": F.coalesce("offset", "sky"),
        "globalmin+match": F.coalesce(low + F.col("offset") - rel, "sky"),
    }.get(method, F.col("sky"))
    return s.select("frame", value.alias("sky"))


def equalise_components(levels: DataFrame) -> DataFrame:
    """Shift (to subtract) that brings each component's median level down to the darkest component's (columns frame, component, level)."""
    m = levels.groupBy("component").agg(F.median("level").alias("m"))
    shift = m.withColumn("shift", F.col("m") - F.min("m").over(Window.partitionBy(F.lit(0)))).select("component", "shift")
    return levels.join(F.broadcast(shift), "component").select("frame", "component", "shift")
