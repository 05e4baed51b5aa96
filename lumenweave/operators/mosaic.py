"""End to end: frames prepared in a fixed order, a mosaic built from them, and colour composed from mosaics."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.functions import scalars as s
from lumenweave.functions.scalars import Affine
from lumenweave.operators import combine, compose, graph, raster, series, stats
from lumenweave.session import settled


@dataclass
class Options:
    """What a build does. Maps place frames (identity where missing); scale is output pixels per input pixel."""

    kernel: str = "square"
    pixfrac: float = 1.0
    scale: float = 1.0
    weighting: str = "uniform"
    sky: str = "match"
    destripe: bool = False
    reject: bool = False
    separate_kernel: str = "turbo"  # of the frames that the model is made of
    snr: float = 4.0  # of an excess over the model, that seeds
    derivative: float = 1.2  # of the model's steepest step, that a seed must pass besides
    cell: int = 32
    width: int = 64
    maps: dict[int, Affine] = field(default_factory=dict)
    most_pixels: int = 500_000_000


def prepare(df: DataFrame, options: Options, meta: DataFrame | None = None, template: DataFrame | None = None) -> DataFrame:
    """Frames' pixels (frame, x, y, v, err, dq) ready to combine. The order is part of the result:
    template, units, exposure, amplifier steps, row bands, and last masks. The sky comes off when frames are combined (``build``).

    ``meta``: unit and exptime a frame. ``template``: t by pixel, scaled by its own fit.
    """
    out = df
    if template is not None:
        from lumenweave.operators.fit import template_scale

        scale = template_scale(out.join(template, ["x", "y"])).select("frame", "scale")
        out = out.join(template, ["x", "y"], "left").join(F.broadcast(scale), "frame", "left")
        out = out.withColumn("v", F.col("v") - F.coalesce(F.col("scale") * F.col("t"), F.lit(0.0))).drop("t", "scale")
    if meta is not None:
        out = out.join(F.broadcast(meta), "frame", "left")
        counts = F.coalesce(F.col("unit") == "counts", F.lit(False))
        # a scale of s: values and errors by s, inverse-variance weights by 1 / s ** 2 where they are made later
        out = out.withColumns({c: F.when(counts, F.col(c) / F.col("exptime")).otherwise(F.col(c)) for c in ("v", "err")}).drop("unit", "exptime")
    if options.destripe:
        steps = combine.amplifier_steps(out, options.width)
        amp = F.least(F.floor(F.col("x") / (options.width // 4)), F.lit(3)).cast("int")
        out = out.withColumn("amp", amp).join(F.broadcast(steps), ["frame", "amp"], "left").withColumn("v", F.col("v") - F.coalesce("offset", F.lit(0.0))).drop("offset", "amp")
        rows = combine.row_medians(out.withColumn("mask", F.col("dq") != 0), options.width, least=8)
        flat = series.deband(out, rows, options.width).select("frame", "x", "y", "v")
        out = out.drop("v").join(flat, ["frame", "x", "y"])
    return out.withColumn("v", F.when(F.col("dq").bitwiseAND(1 << 31) != 0, F.lit(float("nan"))).otherwise(F.col("v")))


def sky_levels(df: DataFrame, options: Options, extent: float = 0.0) -> DataFrame:
    """What a build subtracts of each frame by the options' method: a sky and a plane (frame, sky, a, b, c), flat but for ``match+plane``, over ``extent`` cells."""
    flat = [F.lit(0.0).alias(c) for c in "abc"]
    if options.sky in ("none", ""):
        return df.select("frame").distinct().select("frame", F.lit(0.0).alias("sky"), *flat)
    own = settled(stats.sky(df, ["frame"]).select("frame", F.col("median").alias("sky"), F.col("frame").alias("file")), "sky")
    if options.sky in ("localmin", "globalmin"):
        return graph.plan_sky(own, own.select("frame", F.lit(None).cast("double").alias("offset")), options.sky).select("frame", "sky", *flat)
    placed = combine.place(df, options.maps).withColumns({"x": F.floor("cx"), "y": F.floor("cy")})
    differences = settled(combine.overlap_differences(combine.cells(placed, options.cell)), "overlaps")  # a row a pair of frames and cell
    edges = settled(graph.overlap_edges(differences), "edges")
    comps = graph.frame_components(own, edges)
    if options.sky == "match+plane":
        return graph.plan_planes(own, graph.solve_planes(differences, comps, extent or 1.0))
    return graph.plan_sky(own, graph.solve_offsets(edges, comps), options.sky).select("frame", "sky", *flat)


def _on_output(df: DataFrame, options: Options) -> DataFrame:
    return combine.place(df, options.maps).withColumns({"cx": F.col("cx") * options.scale, "cy": F.col("cy") * options.scale})


def edge_trim(width: int, height: int, scale: float = 1.0) -> int:
    """Pixels trimmed from a frame's edges before it is combined: none."""
    return 0


def canvas(placed: DataFrame) -> tuple[int, int, int, int]:
    """(left, top, width, height) of the output pixels that placed samples (cx, cy) reach: one aggregate."""
    r = placed.filter(s.finite(F.col("cx")) & s.finite(F.col("cy"))).agg(*[f(c).alias(f"{n}{c}") for c in ("cx", "cy") for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    if r["locx"] is None:
        return 0, 0, 0, 0
    left, top = math.floor(r["locx"]), math.floor(r["locy"])
    return left, top, math.ceil(r["hicx"]) - left + 1, math.ceil(r["hicy"]) - top + 1


def separate(placed: DataFrame, kernel: str, drop: float, weight=None) -> DataFrame:
    """Each frame drizzled alone (frame, ox, oy, v), of samples at (cx, cy) on the output grid."""
    k = combine.scatter(placed.filter(s.finite(F.col("v"))), kernel, drop)
    w = F.col("kw") if weight is None else weight * F.col("kw")
    sums = k.groupBy("frame", "ox", "oy").agg(F.sum(F.col("v") * w).alias("vw"), F.sum(w).alias("w")).filter(F.abs("w") > 1e-12)
    return sums.select("frame", "ox", "oy", (F.col("vw") / F.col("w")).alias("v"))


def median_model(each: DataFrame, frames: int) -> DataFrame:
    """What frames drizzled alone agree on (x, y, v): their median, or the lesser of mean and median for up to three frames."""
    return combine.stack(each.select("frame", F.col("ox").alias("x"), F.col("oy").alias("y"), "v"), frames).select("x", "y", "v")


def blot(model: DataFrame, placed: DataFrame) -> DataFrame:
    """The output model (x, y, v) seen from each detector pixel (frame, x, y at cx, cy on the output grid): bilinear between the four output pixels around its
    place, by weight of those that are there; pixels with none are left out."""
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    at = placed.select("frame", "x", "y", "cx", "cy", corner.alias("o")).filter(s.finite(F.col("cx")) & s.finite(F.col("cy")))
    side = lambda c, o: F.when(F.col(f"o.{o}") == 0, 1 - (F.col(c) - F.floor(c))).otherwise(F.col(c) - F.floor(c))
    at = at.select("frame", "x", "y", (F.floor("cx") + F.col("o.i")).alias("mx"), (F.floor("cy") + F.col("o.j")).alias("my"), (side("cx", "i") * side("cy", "j")).alias("w")).filter("w > 0")
    known = model.filter(s.finite(F.col("v"))).select(F.col("x").alias("mx"), F.col("y").alias("my"), F.col("v").alias("m"))
    got = at.join(known, ["mx", "my"]).groupBy("frame", "x", "y").agg(F.sum(F.col("m") * F.col("w")).alias("mw"), F.sum("w").alias("w"))
    return got.select("frame", "x", "y", (F.col("mw") / F.col("w")).alias("model"))


def rejected(placed: DataFrame, options: Options, frames: int) -> DataFrame:
    """Detector pixels (frame, x, y) that stand out of what the other frames show there: frames drizzled alone, their median blotted back to each, and
    a mask of the excess over noise and the blotted model's steepness. Noise is the error where there is one, else the frame's robust deviation."""
    drop = options.pixfrac * options.scale
    model = median_model(separate(placed, options.separate_kernel, drop), frames)
    noise = stats.robust_sigma(placed, ["frame"]).select("frame", F.col("sigma").alias("own"))
    seen = placed.join(blot(model, placed), ["frame", "x", "y"]).join(noise, "frame")
    seen = seen.withColumn("noise", F.when(s.finite(F.col("err")) & (F.col("err") > 0), F.col("err")).otherwise(F.col("own")))
    seen = settled(seen.filter(s.finite(F.col("v"))).select("frame", "x", "y", "v", "model", "noise"), "blotted")
    return settled(raster.cosmic_mask(seen, options.snr, options.derivative).filter("flag").select("frame", "x", "y"), "rejected")


def build(df: DataFrame, options: Options) -> DataFrame:
    """Mosaic (ox, oy, v, weight, inputs, dq) of prepared frames: sky or plane off, cosmic rays rejected if asked, scattered, summed, normalised.

    A canvas of more than ``most_pixels`` is refused: a stray map would make it.
    """
    _, _, width, height = canvas(_on_output(df, options))
    if width * height > options.most_pixels:
        raise ValueError(f"a canvas of {width} x {height} pixels: some frame's map is wrong")
    extent = max(width, height, 1) / options.scale / options.cell
    levels = settled(sky_levels(df, options, extent), "levels")  # a row a frame
    placed = _on_output(df.join(levels, "frame"), options)
    at = lambda c: (F.col(c) / options.scale + 0.5) / options.cell / extent
    off = F.coalesce("sky", F.lit(0.0)) + F.col("a") * at("cx") + F.col("b") * at("cy") + F.col("c")
    placed = placed.withColumn("v", F.col("v") - off).drop("sky", "a", "b", "c")
    if options.reject and (frames := levels.count()) > 1:
        placed = placed.join(rejected(placed, options, frames), ["frame", "x", "y"], "left_anti")
    value, weight = combine.sample_weight("uniform")
    if options.weighting == "err":
        weight = F.when(F.col("err") > 0, 1 / (F.col("err") * F.col("err"))).otherwise(1.0)
    k = combine.scatter(placed.filter(s.finite(F.col("v"))), options.kernel, options.pixfrac * options.scale)
    w = weight * F.col("kw")
    sums = k.groupBy("ox", "oy").agg(F.sum(value * w).alias("vw"), F.sum(w).alias("weight"), F.countDistinct("frame").alias("inputs"), F.bit_or("dq").alias("dq"))
    return sums.select("ox", "oy", F.when(F.abs("weight") > 1e-12, F.col("vw") / F.col("weight")).otherwise(F.lit(float("nan"))).alias("v"), "weight", "inputs", "dq")


def inputs_fingerprint(files: DataFrame, calibration: str = "", version: int = 1) -> str:
    """A name for what a build was made of: its files (path, size, modified), their calibration and this version; another file or time gives another."""
    one = F.sha2(F.concat_ws("|", "path", F.col("size").cast("string"), F.col("modified").cast("string")), 256)
    # hashes by their first four digits, then those of the at most 65,536 parts: no task holds a row a file
    part = files.select(one.alias("h")).groupBy(F.substring("h", 1, 4).alias("k")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("h"))), 256).alias("h"))
    every = part.agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: s["h"])), 256).alias("h")).first()["h"]
    return hashlib.sha256(f"{version}:{calibration}:{every}".encode()).hexdigest()


def cached_build(df: DataFrame, options: Options, folder: str, fingerprint: str) -> DataFrame:
    """``build`` kept as Parquet under a fingerprint of its inputs; another fingerprint builds again, an equal one reads."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{fingerprint}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build(df, options).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def colour(df: DataFrame, weights: DataFrame, stretch: s.Stretch, luminance: float = 0.0) -> DataFrame:
    """Bytes (x, y, r, g, b) of channels mixed by weights, stretched, and their luminance drawn to the mean of the sources."""
    mixed = compose.weighted_mix(df, weights)
    r, g, b = (s.clamp01(s.stretch(F.col(c), stretch)) for c in "rgb")
    if luminance:
        r, g, b = s.inject_luminance(r, g, b, (r + g + b) / 3, luminance)
    return mixed.select("x", "y", *[s.to_byte(c, True).alias(n) for c, n in zip((r, g, b), "rgb")])
