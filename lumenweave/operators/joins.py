"""Spatial, nearest, as-of and keyed joins, each rewritten to equi joins that Spark can shuffle and sort.

A radius condition alone would make Spark compare all pairs; here one side is copied to the cells around
its own, so the join is on the cell and the radius only filters.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.operators.near import celled, known, mutual_within, neighbours_within
from lumenweave.session import settled

PAIRS = 100_000_000  # pairs of rows in one cell that are a task's share, about
CROWD = 10  # shares from which on a cell is split
LIST = 64  # rows in a list: Spark keeps what one row unrolls to, and that is the product of two lists


def _near(radius: float, x: str, y: str, squared: bool) -> tuple[Column, Column]:
    """Whether a pair lies within the radius, and how far apart it is."""
    dx, dy = F.col(x) - F.col(f"r_{x}"), F.col(y) - F.col(f"r_{y}")
    square = dx * dx + dy * dy
    return square <= float(radius) * float(radius) if squared else F.sqrt(square) <= radius, F.sqrt(square)


def radius_join(left: DataFrame, right: DataFrame, radius: float, keys: list[str] = (), x: str = "x", y: str = "y", copied: str = "left", squared: bool = False) -> DataFrame:
    """Pairs within ``radius`` (inclusive) and equal ``keys``: left columns, right ones prefixed r_, and dist.

    A pair just at the radius may fall on either side of it by a rounding: with ``squared`` the squares are compared, and else the roots.
    Only one side is copied (to its 3 x 3 cells), so no pair comes twice: the one named by ``copied``, which should be the smaller.
    """
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    cell = lambda c: F.floor(F.col(c) / radius)

    def around(df: DataFrame, cx: str, cy: str, copy: bool) -> DataFrame:
        if not copy:
            return df.withColumns({"__cx": cell(cx), "__cy": cell(cy)})
        return df.withColumn("__dx", near).withColumn("__dy", near).withColumns({"__cx": cell(cx) + F.col("__dx"), "__cy": cell(cy) + F.col("__dy")}).drop("__dx", "__dy")

    a = around(left, x, y, copied == "left")
    b = around(right.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns]), f"r_{x}", f"r_{y}", copied == "right")
    near, dist = _near(radius, x, y, squared)
    return a.join(b, [*keys, "__cx", "__cy"]).filter(near).withColumn("dist", dist).drop("__cx", "__cy")


def all_pairs(left: DataFrame, right: DataFrame, radius: float, keys: list[str] = (), squared: bool = False) -> DataFrame:
    """``radius_join`` on (x, y) for where all pairs, which grow with the square of the density, are what is written.

    Rows of a place are one list, or several of LIST, so places are tested and not rows, and pairs are unrolled behind the join, the left list within the right: files keep such runs and repeats small.
    There are tasks by the pairs and not by bytes; of a cell of more than CROWD shares several get a part of the left rows each and all right ones. Each side crosses the shuffle once, the
    right one a row a cell of two radii that it reaches. Both sides need a column besides keys and place; rows without a place have no pairs.
    """
    spark, keys = left.sparkSession, list(keys)
    by, place = [*keys, "__cx", "__cy"], ["x", "y"]
    a, b = celled(known(left), 2.0 * radius), celled(known(right), 2.0 * radius, radius)
    counts = [df.groupBy(*by).agg(F.count("*").alias(n)) for df, n in ((a, "__na"), (b, "__nb"))]
    tested = F.col("__na").cast("double") * F.col("__nb")
    cells = settled(counts[0].join(counts[1], by).select(*by, tested.alias("__n"), F.ceil(tested / (CROWD * PAIRS)).alias("__of")), "cells")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((cells.agg(F.sum("__n")).first()[0] or 0) / PAIRS))
    crowded = F.broadcast(cells.filter("__of > 1").drop("__n"))  # fewer rows than there are tasks
    of = F.coalesce("__of", F.lit(1))
    a = a.join(crowded, by, "left").withColumn("__s", F.pmod(F.xxhash64(*left.columns), of))
    b = b.join(crowded, by, "left").withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), of - 1)))
    by = [*by, "__s"]

    def lists(df: DataFrame, out: str, prefix: str = "") -> DataFrame:
        rest = F.struct(*[F.col(c).alias(prefix + c) for c in df.columns if c not in (*by, *place, "__of")])
        dealt = df.repartition(tasks, *by).groupBy(*by, *place).agg(F.collect_list(rest).alias(out))
        parts = F.transform(F.sequence(F.lit(1), F.size(out), F.lit(LIST)), lambda i: F.slice(out, i, LIST))
        return dealt.withColumn(out, F.explode(parts)).withColumnsRenamed({c: prefix + c for c in place})

    near, dist = _near(radius, *place, squared)
    met = lists(a, "__a").join(lists(b, "__b", "r_"), by).filter(near).withColumn("dist", dist).drop(*by[len(keys) :])
    pairs = met.select("*", F.inline("__b")).drop("__b").select("*", F.inline("__a"))
    return pairs.select(*left.columns, *[f"r_{c}" for c in right.columns if c not in keys], "dist")


def votes(catalog: DataFrame, radius: float) -> DataFrame:
    """Each detection with the number of exposures that see it, its own included. Exposures are counted by place (``near``), with no pairs."""
    seen = catalog.filter("exposure IS NOT NULL").select("x", "y", "exposure", F.lit(float(radius)).alias("reach"), F.lit(1).cast("long").alias("n")).distinct()
    support = neighbours_within(catalog, seen, radius, [], "support", "exposure")
    return catalog.join(support, ["x", "y"]).select(*catalog.columns, "support").distinct()


def mutual_nearest(ref: DataFrame, target: DataFrame, radius: float, ratio: float = 1.0, keys: list[str] = ()) -> DataFrame:
    """One-to-one pairs that are each other's nearest within ``radius``; with a second candidate inside it, the best must be at most ``ratio`` of it.

    Ties go by distance, then the ids. Mutual bests by a total order are one-to-one already. Each side asks for its two nearest (``near``), in one pass over cells; no other pairs are made.
    """
    keys = list(keys)
    both = mutual_within(ref, target, radius, keys).withColumnRenamed("other", "r_star")
    return both.filter((F.col("dist") <= ratio * F.col("sa")) & (F.col("dist") <= ratio * F.col("sb"))).select(*keys, "star", "r_star", "dist")


def dominant_offset(ref: DataFrame, target: DataFrame, window: float = 150.0, bin_size: float = 3.0, least: int = 4) -> DataFrame:
    """Centroid of the fullest 3 x 3 bins of target - ref offsets within the window, per frame of the target.

    Candidates come from a join on cells of the window's size, so catalogs may be large; callers still cap them.
    """
    pairs = radius_join(target.select("frame", "star", "x", "y"), ref.select("star", "x", "y"), window * 2**0.5)
    dx, dy = F.col("x") - F.col("r_x"), F.col("y") - F.col("r_y")
    inside = pairs.withColumns({"dx": dx, "dy": dy}).filter((F.abs("dx") <= window) & (F.abs("dy") <= window))
    bins = inside.groupBy("frame", F.floor(F.col("dx") / bin_size).alias("bx"), F.floor(F.col("dy") / bin_size).alias("by")).agg(
        F.count("*").alias("n"), F.sum("dx").alias("sx"), F.sum("dy").alias("sy")
    )
    top = bins.withColumn("r", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("n"), "bx", "by"))).filter("r = 1")
    peak = top.filter(F.col("n") >= least).select("frame", F.col("bx").alias("px"), F.col("by").alias("py"), F.col("n").alias("votes"))
    around = bins.join(peak, "frame").filter((F.abs(F.col("bx") - F.col("px")) <= 1) & (F.abs(F.col("by") - F.col("py")) <= 1))
    return around.groupBy("frame", "votes").agg((F.sum("sx") / F.sum("n")).alias("dx"), (F.sum("sy") / F.sum("n")).alias("dy"))


def triangles(stars: DataFrame, keys: list[str], n: int = 40) -> DataFrame:
    """Triangles of the brightest ``n`` stars of a group: vertices by side order and the two ratios of shorter sides to the longest."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("peak").desc(), "x", "y"))
    top = stars.withColumn("k", rank).filter(F.col("k") <= n).select(*keys, "k", "star", "x", "y")
    v = lambda p: top.select(*keys, *[F.col(c).alias(p + c) for c in ("k", "star", "x", "y")])
    three = v("a").join(v("b"), keys) if keys else v("a").crossJoin(v("b"))
    three = three.filter("ak < bk")
    three = (three.join(v("c"), keys) if keys else three.crossJoin(v("c"))).filter("bk < ck")
    d = lambda p, q: F.sqrt((F.col(p + "x") - F.col(q + "x")) ** 2 + (F.col(p + "y") - F.col(q + "y")) ** 2)
    # each side with the vertex across from it, by length: vertices are then matched in that order
    sides = F.array_sort(F.array(F.struct(d("b", "c").alias("len"), F.col("astar").alias("star")), F.struct(d("a", "c").alias("len"), F.col("bstar").alias("star")), F.struct(d("a", "b").alias("len"), F.col("cstar").alias("star"))))
    s = three.withColumn("s", sides).filter(F.col("s")[2]["len"] > 1e-9)
    return s.select(
        *keys, *[F.col("s")[i]["star"].alias(f"v{i}") for i in range(3)],
        (F.col("s")[0]["len"] / F.col("s")[2]["len"]).alias("r1"), (F.col("s")[1]["len"] / F.col("s")[2]["len"]).alias("r2"),
    )


def triangle_match(ref: DataFrame, target: DataFrame, tolerance: float = 0.005, least: int = 2, n: int = 40) -> DataFrame:
    """Star pairs by votes of alike triangles: mutual best with ``least`` votes or more, per frame of the target."""
    a = triangles(ref, [], n).select(*[F.col(f"v{i}").alias(f"a{i}") for i in range(3)], F.col("r1").alias("x"), F.col("r2").alias("y"))
    b = triangles(target, ["frame"], n).withColumnsRenamed({"r1": "x", "r2": "y"})
    near = radius_join(b, a, tolerance * 2**0.5).filter((F.abs(F.col("x") - F.col("r_x")) <= tolerance) & (F.abs(F.col("y") - F.col("r_y")) <= tolerance))
    pairs = near.select("frame", F.explode(F.array(*[F.struct(F.col(f"r_a{i}").alias("ref"), F.col(f"v{i}").alias("star")) for i in range(3)])).alias("p"))
    n_votes = pairs.groupBy("frame", "p.ref", "p.star").agg(F.count("*").alias("votes"))
    best = lambda k, o: F.row_number().over(Window.partitionBy("frame", k).orderBy(F.desc("votes"), o))
    ranked = n_votes.withColumns({"ra": best("ref", "star"), "rb": best("star", "ref")})
    return ranked.filter((F.col("ra") == 1) & (F.col("rb") == 1) & (F.col("votes") >= least)).select("frame", "ref", "star", "votes")


def nearest_date(science: DataFrame, calibration: DataFrame, keys: list[str], date: str = "day") -> DataFrame:
    """Of each science row's calibrations of equal ``keys`` the one of least distance in days, the first by id of equals; and how many there are.

    Both sides are reduced to distinct days a key; a window forward and one backward then give each day its
    neighbours, so a key costs a sort of its days and no pairs are made.
    """
    days = calibration.groupBy(*keys, F.col(date)).agg(F.min("cal_id").alias("cal_id"), F.count("*").alias("members"))
    found = F.struct(F.col(date).alias("cal_day"), "cal_id")
    wanted = science.select(*keys, date).distinct()
    both = wanted.select(*keys, date, F.lit(True).alias("asked"), F.lit(None).cast("struct<cal_day:date,cal_id:bigint>").alias("cal"), F.lit(0).cast("long").alias("members")).union(
        days.select(*keys, date, F.lit(False), found, "members")
    )
    w = Window.partitionBy(*keys)
    near = both.withColumns(
        {
            "before": F.last("cal", ignorenulls=True).over(w.orderBy(date)), "after": F.last("cal", ignorenulls=True).over(w.orderBy(F.desc(date))),
            "ensemble": F.sum("members").over(w),
        }
    ).filter("asked")
    gap = lambda c: F.abs(F.datediff(F.col(date), F.col(f"{c}.cal_day")))
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(gap(c).alias("gap"), F.col(f"{c}.cal_id").alias("cal_id"), F.col(f"{c}.cal_day").alias("cal_day")))
    best = near.withColumn("best", F.least(side("before"), side("after"))).filter("best IS NOT NULL").select(*keys, date, "best.cal_id", "best.cal_day", "best.gap", "ensemble")
    return science.join(best, [*keys, date], "left")


def upsert(master: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """All keys of both; a loaded row replaces the master's."""
    old = master.select(F.col(key), F.struct(*[c for c in master.columns if c != key]).alias("old"))
    new = loaded.select(F.col(key), F.struct(*[c for c in loaded.columns if c != key]).alias("new"))
    both = old.join(new, key, "full")
    return both.select(key, F.coalesce("new", "old").alias("row"), F.col("new").isNotNull().alias("loaded")).select(key, "row.*", "loaded")


def identity_status(target: DataFrame, sidecar: DataFrame, path: str = "path") -> DataFrame:
    """missing, stale, mismatched, rejected or valid: whether a stored alignment is of this very file."""
    s = sidecar.select(F.col(path), *[F.col(c).alias(f"s_{c}") for c in ("sci_ext", "width", "height", "size", "mtime", "accepted")])
    j = target.join(s, path, "left")
    status = (
        F.when(F.col("s_size").isNull(), "missing")
        .when(F.col("s_sci_ext") != F.col("sci_ext"), "mismatched")
        .when((F.col("s_width") != F.col("width")) | (F.col("s_height") != F.col("height")), "mismatched")
        .when((F.col("s_size") != F.col("size")) | (F.col("s_mtime") != F.col("mtime")), "stale")
        .when(~F.col("s_accepted"), "rejected")
        .otherwise("valid")
    )
    return j.select(*target.columns, status.alias("status"))


def pair_masks(science: DataFrame, masks: DataFrame) -> DataFrame:
    """Each science plane's mask: equal version and size; without a version, the file's first mask of equal size."""
    m = masks.select("path", F.col("extver").alias("m_ver"), F.col("width").alias("m_w"), F.col("height").alias("m_h"), F.col("hdu").alias("mask_hdu"))
    same = (F.col("m_w") == F.col("width")) & (F.col("m_h") == F.col("height")) & (F.col("extver").isNull() | (F.col("m_ver") == F.col("extver")))
    first = science.join(m, "path").filter(same).groupBy("path", "hdu").agg(F.min("mask_hdu").alias("mask_hdu"))
    return science.join(first, ["path", "hdu"], "left")


def in_box(stars: DataFrame, boxes: DataFrame, pad: float, extent: float) -> DataFrame:
    """Stars inside any padded box of ``boxes`` (x0, y0, x1, y1): a semi join by cells of ``extent``."""
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - pad) / extent), F.floor((F.col(hi) + pad) / extent))
    b = boxes.withColumn("__cx", F.explode(span("x0", "x1"))).withColumn("__cy", F.explode(span("y0", "y1")))
    s = stars.withColumns({"__cx": F.floor(F.col("x") / extent), "__cy": F.floor(F.col("y") / extent)})
    inside = (s["x"] >= b["x0"] - pad) & (s["x"] <= b["x1"] + pad) & (s["y"] >= b["y0"] - pad) & (s["y"] <= b["y1"] + pad)
    return s.join(b, (s["__cx"] == b["__cx"]) & (s["__cy"] == b["__cy"]) & inside, "left_semi").drop("__cx", "__cy")


def may_overlap(frames: DataFrame) -> DataFrame:
    """Pairs i < j whose centres lie no further apart than half their diagonals together; an unknown place keeps its pairs.

    Known frames meet by cells of the largest diagonal. Frames of unknown place pair with all, which is what is asked for.
    """
    at = frames.select("frame", "cx", "cy", "diag")
    side = at.filter("cx IS NOT NULL").crossJoin(F.broadcast(at.agg(F.greatest(F.max("diag"), F.lit(1e-9)).alias("__side"))))  # one number
    known = side.withColumns({"__gx": F.floor(F.col("cx") / F.col("__side")), "__gy": F.floor(F.col("cy") / F.col("__side"))})
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    a = known.select(F.col("frame").alias("i"), F.col("cx").alias("ix"), F.col("cy").alias("iy"), F.col("diag").alias("id"), "__gx", "__gy")
    b = known.select(F.col("frame").alias("j"), F.col("cx").alias("jx"), F.col("cy").alias("jy"), F.col("diag").alias("jd"), "__gx", "__gy")
    b = b.withColumn("__dx", near).withColumn("__dy", near).withColumns({"__gx": F.col("__gx") + F.col("__dx"), "__gy": F.col("__gy") + F.col("__dy")})
    d = F.sqrt((F.col("ix") - F.col("jx")) ** 2 + (F.col("iy") - F.col("jy")) ** 2)
    close = a.join(b, ["__gx", "__gy"]).filter((F.col("i") < F.col("j")) & (d <= (F.col("id") + F.col("jd")) / 2)).select("i", "j")
    lost = at.filter("cx IS NULL").select(F.col("frame").alias("a"))
    all_of = lost.join(at.select(F.col("frame").alias("b")), F.col("a") != F.col("b"))
    return close.union(all_of.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))).distinct()


def weights_or_default(items: DataFrame, weights: DataFrame, key: str, default: float) -> DataFrame:
    """A missing weight is the default; a zero one stays zero and so disables its row."""
    return items.join(weights.select(key, "weight"), key, "left").withColumn("weight", F.coalesce("weight", F.lit(default)))


def propagate(frames: DataFrame, group: str, order: str, aligned: str, value: str) -> DataFrame:
    """A row that isn't aligned takes the value of its group's first aligned one."""
    first = frames.filter(F.col(aligned)).groupBy(group).agg(F.min_by(value, order).alias("__v"))
    j = frames.join(first, group, "left")
    return j.select(*frames.columns, F.when(F.col(aligned), F.col(value)).otherwise(F.col("__v")).alias("final"), (~F.col(aligned) & F.col("__v").isNotNull()).alias("inherited"))


def facet_filter(files: DataFrame, facets: dict[str, str], first: str = "", last: str = "") -> DataFrame:
    """Rows that equal every facet given and whose date lies in the range, inclusive; an unknown date ('') lies in every range."""
    conds: list[Column] = [F.col(k) == v for k, v in facets.items() if v]
    day = F.col("date_obs")
    if first:
        conds.append((day == "") | (day >= first))
    if last:
        conds.append((day == "") | (day <= last))
    return files.filter(reduce(and_, conds)) if conds else files


def facet_counts(files: DataFrame, facet: str) -> DataFrame:
    """Label, count and order of a facet's choices: all files first, then by number where labels are numbers, else as text."""
    name = F.when(F.trim(facet) == "", "Unknown").otherwise(F.trim(facet))
    counts = files.groupBy(name.alias("value")).agg(F.count("*").alias("files"))
    number = F.regexp_extract("value", r"^(\d+(?:\.\d+)?)s?$", 1).try_cast("double")
    each = counts.withColumn("position", F.row_number().over(Window.orderBy(number.isNull(), number, "value")).cast("long"))
    total = files.agg(F.lit("Any").alias("value"), F.count("*").alias("files"), F.lit(0).cast("long").alias("position"))
    rows = total.unionByName(each)
    return rows.select("value", "files", "position", F.format_string("%s (%d files)", "value", "files").alias("label"))


def first_of_each(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows with one key the first by ``order``."""
    return df.withColumn("__k", key).withColumn("__r", F.row_number().over(Window.partitionBy("__k").orderBy(order))).filter("__r = 1").drop("__k", "__r")
