"""Robust statistics by group: built-in aggregates, whose partial results cross the shuffle.

Exact order statistics take two of them: a sketch of fixed size brackets each wanted rank, then the samples below the
bracket are counted and only those inside it, a few thousandths of a group, are sorted. No task holds a group's
samples, however large the group. What has a row a group (brackets, levels, clip bounds) is settled in the shared folder, so
that steps that stand on each other each read the source once. ``keys`` may be empty. Samples that aren't finite never count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.scalars import finite
from lumenweave.session import settled

NAN = float("nan")


def with_group(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join a table of one row a group; a single row, where there are no keys, is crossed in."""
    return df.join(small, keys) if keys else df.crossJoin(F.broadcast(small))


def basic(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """n, lo, hi, mean and population deviation of the finite samples."""
    c = F.col(v)
    return df.filter(finite(c)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")
    )


def histogram(df: DataFrame, keys: list[str], v: str = "v", bins: int = 256) -> DataFrame:
    """Counts by bin: trunc((v - lo) / (hi - lo) * (bins - 1)), all in bin 0 when the range is empty."""
    span = basic(df, keys, v).select(*keys, "lo", "hi")
    unit = F.when(F.col("hi") > F.col("lo"), (F.col(v) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    rows = with_group(df.filter(finite(F.col(v))), span, keys)
    return rows.groupBy(*keys, "lo", "hi", F.floor(unit * (bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram_percentile(hist: DataFrame, keys: list[str], percents: dict[str, float], bins: int = 256) -> DataFrame:
    """A value a percentage: the first bin whose running count reaches ceil(n * p / 100), as lo + bin / (bins - 1) * (hi - lo)."""
    w = Window.partitionBy(*keys)
    run = hist.withColumn("run", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    out = []
    for name, p in percents.items():
        at = F.min(F.when(F.col("run") >= F.ceil(F.col("total") * p / 100), F.col("bin")))
        out.append((F.first("lo") + at / (bins - 1) * (F.first("hi") - F.first("lo"))).alias(name))
    return run.groupBy(*keys).agg(*out)


GRID = 512  # points of the sketch that brackets ranks


def linear(p: float) -> tuple[Column, Column, Column]:
    """The interpolated quantile: between the two ranks about (n - 1) * p."""
    at = (F.col("n") - 1) * p
    return F.floor(at), F.ceil(at), at - F.floor(at)


def at_rank(rank: Column) -> tuple[Column, Column, Column]:
    """The sample of a rank from 0, which may depend on ``n``, the group's size; null where the group is smaller."""
    return rank, rank, F.lit(0.0)


def upper_middle() -> tuple[Column, Column, Column]:
    """sorted[n / 2]."""
    return at_rank(F.floor(F.col("n") / 2))


def quantiles(df: DataFrame, keys: list[str], c: Column, spans: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """Exact order statistics of each group: ``keys``, ``n`` (samples that aren't null) and a column a span (``linear``, ``at_rank``).

    The sketch's ranks are off by a ten-thousandth at most, and brackets reach further by a step of the grid.
    """
    rows = df.select(*keys, c.cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    grid = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("__v", [k / GRID for k in range(1, GRID)], 10_000).alias("__g"))

    def point(k: Column, beyond: float) -> Column:
        return F.when((k < 1) | (k >= GRID), F.lit(beyond)).otherwise(F.get("__g", (k - 1).cast("int")))

    inf = float("inf")
    wanted = [
        F.struct(
            F.lit(name).alias("name"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), part.cast("double").alias("part"),
            point(F.floor(lo / F.col("n") * GRID) - 1, -inf).alias("from"), point(F.ceil((hi + 1) / F.col("n") * GRID) + 1, inf).alias("to"),
        )
        for name, (lo, hi, part) in spans.items()
    ]
    one = settled(grid.select(*keys, "n", F.array(*wanted).alias("__w")))
    near = with_group(rows, one, keys).select(*keys, "__v", F.explode(F.filter("__w", lambda w: F.col("__v") <= w["to"])).alias("w"))
    # samples below the bracket are one row a group, a null, and come first
    inside = F.when(F.col("__v") >= F.col("w.from"), F.col("__v"))
    counted = near.groupBy(*keys, "w.name", "w.lo", "w.hi", "w.part", inside.alias("__v")).agg(F.count("*").alias("__c"))
    run = F.sum("__c").over(Window.partitionBy(*keys, "name").orderBy(F.col("__v").asc_nulls_first()))
    ranked = counted.withColumn("__run", run)
    low, high = (F.min(F.when(F.col("__run") > F.col(k), F.col("__v"))) for k in ("lo", "hi"))
    found = ranked.groupBy(*keys, "name", "part").agg(low.alias("a"), high.alias("b")).withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in spans])
    return settled(with_group(one.drop("__w"), wide, keys))


def median(df: DataFrame, keys: list[str], c: Column, name: str) -> DataFrame:
    """The interpolated median as ``name``."""
    return quantiles(df, keys, c, {name: linear(0.5)}).drop("n")


def order_statistic(df: DataFrame, keys: list[str], k: int, v: str = "v") -> DataFrame:
    """The k-th smallest finite sample of each group (from 0), as ``value``."""
    got = quantiles(df.filter(finite(F.col(v))), keys, F.col(v), {"value": at_rank(F.lit(k))})
    return got.filter("value IS NOT NULL").drop("n")


def clip_bounds(df: DataFrame, keys: list[str], v: str = "v", low: float = 4.0, high: float = 4.0, rounds: int = 5) -> DataFrame:
    """Bounds of each group after at most ``rounds`` of mean - low * std <= v <= mean + high * std, on what the last round kept.

    Each round is one aggregate over the source, joined with a row a group. A round that drops nothing, or
    a deviation of 0, leaves the bounds alone, so further rounds change nothing and stopping early is not needed.
    """
    inf = float("inf")
    source = df.filter(finite(F.col(v)))
    bounds = source.groupBy(*keys).agg(F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"))
    for _ in range(rounds):
        kept = with_group(source, bounds, keys).filter(F.col(v).between(F.col("lo"), F.col("hi")))
        stat = kept.groupBy(*keys).agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        still = F.col("s") > 0
        bounds = stat.select(
            *keys,
            F.when(still, F.greatest("lo", F.col("m") - low * F.col("s"))).otherwise(F.col("lo")).alias("lo"),
            F.when(still, F.least("hi", F.col("m") + high * F.col("s"))).otherwise(F.col("hi")).alias("hi"),
        )
    return settled(bounds)


def clipped(df: DataFrame, keys: list[str], v: str = "v", low: float = 4.0, high: float = 4.0, rounds: int = 5) -> DataFrame:
    """The samples within the clip bounds (columns lo and hi stay)."""
    return with_group(df.filter(finite(F.col(v))), clip_bounds(df, keys, v, low, high, rounds), keys).filter(F.col(v).between(F.col("lo"), F.col("hi")))


def mode(df: DataFrame, keys: list[str], v: str = "v", width: float = 0.1) -> DataFrame:
    """Centre of the fullest bin of width ``width`` deviations from the least sample; the first of equals."""
    span = df.groupBy(*keys).agg(F.min(v).alias("__lo"), F.stddev_pop(v).alias("__s"))
    rows = with_group(df, span, keys).withColumn("__w", F.when(F.col("__s") > 0, F.col("__s") * width).otherwise(1.0))
    bins = rows.groupBy(*keys, "__lo", "__w", F.floor((F.col(v) - F.col("__lo")) / F.col("__w")).alias("__b")).count()
    best = bins.groupBy(*keys, "__lo", "__w").agg(F.max(F.struct("count", -F.col("__b"))).alias("m"))
    return best.select(*keys, (F.col("__lo") + (0.5 - F.col("m.col2")) * F.col("__w")).alias("mode"))


def sky(df: DataFrame, keys: list[str], v: str = "v", **clip) -> DataFrame:
    """Median, mean and mode of each group's samples after the iterative clip."""
    kept = clipped(df, keys, v, **clip).drop("lo", "hi")
    both = with_group(kept.groupBy(*keys).agg(F.count("*").alias("kept"), F.avg(v).alias("mean")), median(kept, keys, F.col(v), "median"), keys)
    return with_group(both, mode(kept, keys, v), keys)


def robust_sigma(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """1.4826 * median |v - median|; where that is 0, half of q84 - q16; where that is 0 too, 1."""
    source = df.filter(finite(F.col(v)))
    centre = quantiles(source, keys, F.col(v), {"median": linear(0.5), "__lo": linear(0.16), "__hi": linear(0.84)})
    centre = centre.select(*keys, "median", ((F.col("__hi") - F.col("__lo")) / 2).alias("__half"))
    away = with_group(source.select(*keys, v), centre, keys)
    mad = with_group(centre, median(away, keys, F.abs(F.col(v) - F.col("median")), "__mad"), keys).withColumn("s", 1.4826 * F.col("__mad"))
    return mad.select(*keys, "median", F.when(F.col("s") > 0, F.col("s")).when(F.col("__half") > 0, F.col("__half")).otherwise(1.0).alias("sigma"))


def background(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Three rounds of 3 sigma, then the upper median and its upper MAD (times 1.4826, at least 1): bg, sigma."""
    kept = clipped(df, keys, v, 3.0, 3.0, 3).drop("lo", "hi")
    middle = quantiles(kept, keys, F.col(v), {"bg": upper_middle()}).drop("n")
    away = with_group(kept.select(*keys, v), middle, keys)
    mad = with_group(middle, quantiles(away, keys, F.abs(F.col(v) - F.col("bg")), {"mad": upper_middle()}).drop("n"), keys)
    return mad.select(*keys, "bg", F.greatest(F.lit(1.0), 1.4826 * F.col("mad")).alias("sigma"))


def smart_levels(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """black = bg - sigma / 2, not below q0.1 (nor, if that is no less than bg, q0.01); white = the first of q99.8, q99.9, q99.5, bg + 1 above bg."""
    q = quantiles(df.filter(finite(F.col(v))), keys, F.col(v), {f"__q{i}": linear(p) for i, p in enumerate((0.001, 0.0001, 0.998, 0.999, 0.995))})
    rows = with_group(background(df, keys, v), q, keys)
    at = lambda i: F.col(f"__q{i}")
    bg = F.col("bg")
    raw = bg - 0.5 * F.col("sigma")
    low = F.when(raw < at(0), at(0)).otherwise(raw)
    low = F.when(low >= bg, at(1)).otherwise(low)
    high = F.when(at(2) > bg, at(2)).when(at(3) > bg, at(3)).when(at(4) > bg, at(4)).otherwise(bg + 1)
    return rows.select(*keys, "bg", "sigma", low.alias("black"), high.alias("white"))


def auto_levels(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """lo and hi; equal ones part by 1."""
    s = basic(df, keys, v)
    return s.select(*keys, "lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1).alias("hi"))


def magic_levels(df: DataFrame, keys: list[str], v: str = "v", star: str = "star", preset: str = "balanced") -> DataFrame:
    """Display levels from a percentile of the population a preset names, 0 being padding.

    Populations are diffuse (no star, at least bg + 2.5 sigma), then all without stars, then all valid: the
    first that holds at least 0.5 % of the valid samples. Shares clipped at both ends come along.
    """
    black_q, white_q, margin, diffuse = {
        "galaxy": (0.01, 0.9999, 1.05, False), "nebula": (0.001, 0.985, 1.0, True), "balanced": (0.001, 0.999, 1.05, True),
    }[preset]
    valid = df.filter(finite(F.col(v)) & (F.col(v) != 0))
    rows = with_group(valid, settled(background(valid, keys, v)), keys)
    plain = ~F.col(star)
    bright = plain & (F.col(v) >= F.col("bg") + 2.5 * F.col("sigma"))
    stat = rows.groupBy(*keys).agg(F.count("*").alias("valid"), F.count_if(bright).alias("nd"), F.count_if(plain).alias("np"))
    stat = with_group(stat, quantiles(valid, keys, F.col(v), {"black": linear(black_q), "wa": linear(white_q)}).drop("n"), keys)
    for cond, name in ((bright, "wd"), (plain, "wp")):
        # a population may be empty
        white = quantiles(rows, keys, F.when(cond, F.col(v)), {name: linear(white_q)}).drop("n")
        stat = stat.join(white, keys, "left") if keys else stat.join(white, F.lit(True), "left")
    enough = lambda n: F.col(n) >= 0.005 * F.col("valid")
    use = F.when(enough("nd"), "diffuse") if diffuse else F.when(F.lit(False), "")
    use = use.when(enough("np"), "nonstar").otherwise("all")
    white = F.when(use == "diffuse", F.col("wd")).when(use == "nonstar", F.col("wp")).otherwise(F.col("wa"))
    levels = settled(stat).select(*keys, "valid", "black", use.alias("population"), (F.col("black") + (white - F.col("black")) * margin).alias("white"))
    ends = with_group(valid, levels, keys).groupBy(*keys, "valid", "black", "population", "white")
    return ends.agg((F.count_if(F.col(v) < F.col("black")) / F.count("*")).alias("below"), (F.count_if(F.col(v) > F.col("white")) / F.count("*")).alias("above"))


def moments(df: DataFrame, keys: list[str], v: str = "v", x: str = "x", y: str = "y") -> DataFrame:
    """Flux-weighted centre, variance along each axis and FWHM = 2.3548 * sqrt(mean variance) of positive samples."""
    w = F.when(finite(F.col(v)) & (F.col(v) > 0), F.col(v)).otherwise(0.0)
    s = df.groupBy(*keys).agg(
        F.sum(w).alias("flux"), F.sum(w * F.col(x)).alias("sx"), F.sum(w * F.col(y)).alias("sy"),
        F.sum(w * F.col(x) * F.col(x)).alias("sxx"), F.sum(w * F.col(y) * F.col(y)).alias("syy"),
    ).filter("flux > 0")
    cx, cy = F.col("sx") / F.col("flux"), F.col("sy") / F.col("flux")
    vx, vy = F.col("sxx") / F.col("flux") - cx * cx, F.col("syy") / F.col("flux") - cy * cy
    fwhm = 2.3548 * F.sqrt(F.greatest(F.lit(0.0), (vx + vy) / 2))
    return s.select(*keys, "flux", cx.alias("cx"), cy.alias("cy"), vx.alias("vx"), vy.alias("vy"), fwhm.alias("fwhm"))


def residual_summary(df: DataFrame, keys: list[str], dx: str = "dx", dy: str = "dy", tolerance: float = 2.0) -> DataFrame:
    """RMS, RMS along each axis, median, largest, and the share within ``tolerance``."""
    d = F.sqrt(F.col(dx) ** 2 + F.col(dy) ** 2)
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.sqrt(F.avg(d * d)).alias("rms"), F.sqrt(F.avg(F.col(dx) ** 2)).alias("rms_x"), F.sqrt(F.avg(F.col(dy) ** 2)).alias("rms_y"),
        F.max(d).alias("largest"), (F.count_if(d <= tolerance) / F.count("*")).alias("inliers"),
    )
    return with_group(sums, median(df, keys, d, "median"), keys)
