"""Exposures: a file to a row a science chip, with its error, weight, mask and correction planes, and their pixels."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.session import settled
from lumenweave.sources import fits

#: Planes of a chip beside its science one: role, EXTNAME.
ROLES = (("err", "ERR"), ("dq", "DQ"), ("wht", "WHT"))
#: Cards that may hold an exposure time, the first positive one counts.
EXPOSURE_CARDS = ("EXPTIME", "TEXPTIME", "EFFEXPTM", "EXPOSURE")


def _text(cards: str, key: str) -> Column:
    return F.trim(F.col(cards)[key])


def _number(cards: str, key: str) -> Column:
    return F.regexp_replace(F.split(F.col(cards)[key], "/")[0], "[dD]", "E").try_cast("double")


def input_table(spark: SparkSession, path: str) -> DataFrame:
    """A row a science chip of each file (file, chip, width, height, sci, err, dq, wht: unit numbers, null where there is none).

    Science planes are named SCI; where a file has none, the unnamed images of a GMOS file, else its primary unit, are. A
    chip's number is its EXTVER, or its place among the science planes. Errors go by the chip's number (or have none, like the science plane), masks
    by number and size, or the first of equal size where the science plane has no number. A star map is no exposure and is left out.
    Nothing but headers is read.
    """
    fits.register(spark)
    units = settled(spark.read.format("fits").option("pixels", "false").load(path).drop("data", "exact"), "units").withColumn("name", F.upper(F.trim("extname")))
    primary = units.filter("hdu = 0").select("file", F.col("cards").alias("primary"))
    units = units.join(primary, "file").filter(F.coalesce(_text("primary", "PRODUCT"), F.lit("")) != "STARMAP")
    gmos = F.coalesce(F.upper(_text("primary", "INSTRUME")).startswith("GMOS"), F.lit(False))
    named = F.max(F.when((F.col("name") == "SCI") & (F.col("width") > 0), 1).otherwise(0)).over(Window.partitionBy("file")) == 1
    unnamed = F.max(F.when((F.col("hdu") > 0) & (F.col("name") == "") & (F.col("width") > 0), 1).otherwise(0)).over(Window.partitionBy("file")) == 1
    marked = units.withColumns({"has_sci": named, "has_unnamed": unnamed & gmos})
    is_science = F.when(F.col("has_sci"), F.col("name") == "SCI").when(F.col("has_unnamed"), (F.col("hdu") > 0) & (F.col("name") == "")).otherwise(F.col("hdu") == 0)
    science = marked.filter(is_science & (F.col("width") > 0)).withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("hdu")))
    own_number = F.when(F.col("has_sci"), F.col("extver"))
    sci = science.select(
        "file", F.coalesce(own_number, F.col("place")).cast("int").alias("chip"), own_number.isNull().alias("numberless"), (~F.col("has_sci") & ~F.col("has_unnamed")).alias("single"),
        "width", "height", F.col("hdu").alias("sci"), "cards", "primary",
    )
    out = sci
    for role, name in ROLES:
        other = units.filter(F.col("name") == name).select("file", F.col("extver").alias("o_ver"), F.col("width").alias("o_w"), F.col("height").alias("o_h"), F.col("hdu").alias("o_hdu"))
        same_size = (F.col("o_w") == F.col("width")) & (F.col("o_h") == F.col("height"))
        match = F.coalesce(F.col("o_ver") == F.col("chip"), F.lit(False))
        # weights are of a combined file, whose science plane is the primary one
        may = F.col("single") if role == "wht" else match | F.col("numberless")
        found = sci.join(other, "file").filter(same_size & may).groupBy("file", "sci").agg(F.min_by("o_hdu", F.struct(~match, "o_hdu")).alias(role))
        out = out.join(found, ["file", "sci"], "left")
    exposure = F.coalesce(*[F.when(_number(h, k) > 0, _number(h, k)) for h in ("primary", "cards") for k in EXPOSURE_CARDS])
    day = F.coalesce(_text("primary", "DATE-OBS"), _text("cards", "DATE-OBS"), F.lit(""))
    unit = F.coalesce(_text("cards", "BUNIT"), _text("primary", "BUNIT"), F.lit(""))
    return settled(out, "inputs").select("file", "chip", "width", "height", "sci", "err", "dq", "wht", exposure.alias("exptime"), day.alias("date_obs"), unit.alias("bunit"), "cards", "primary")


def input_pixels(spark: SparkSession, path: str, inputs: DataFrame, chip: int | None = None, aux: bool = True, tile: int = 256) -> DataFrame:
    """Pixels (file, chip, x, y, v, err, dq, wht) of the chips in ``inputs``; of one chip alone where it is named.

    Only the planes asked for are decoded: the reader is given their unit numbers, a few a file. Planes meet
    tile by tile, so no pixel crosses a shuffle alone. Without ``aux`` errors and weights are null and not read.
    """
    fits.register(spark)
    rows = inputs if chip is None else inputs.filter(F.col("chip") == chip)
    roles = ["sci", "dq", *(("err", "wht") if aux else ())]
    units = sorted({r["u"] for r in rows.select(F.explode(F.array(*roles)).alias("u")).filter("u IS NOT NULL").distinct().collect()})  # unit numbers, as many as a file has
    reader = spark.read.format("fits").option("tileSize", str(tile)).option("hdu", ",".join(map(str, units or [-1])))
    tiles = reader.load(path)
    place = ["file", "tx", "ty"]
    out = None
    for role in roles:
        own = rows.select("file", "chip", F.col(role).alias("hdu")).filter("hdu IS NOT NULL")
        samples = "exact" if role == "dq" else "data"
        extra = ["x0", "y0", "tile_width"] if role == "sci" else []
        got = tiles.join(own, ["file", "hdu"]).select(*place, "chip", *extra, F.col(samples).alias(role))
        out = got if out is None else out.join(got, [*place, "chip"], "left")
    for role in ("err", "wht"):
        if role not in roles:
            out = out.withColumn(role, F.lit(None).cast("array<float>"))
    at = lambda role: F.get(role, F.col("k"))
    each = out.select("file", "chip", "x0", "y0", "tile_width", F.posexplode("sci").alias("k", "v"), "err", "dq", "wht")
    return each.select(
        "file", "chip", (F.col("x0") + F.col("k") % F.col("tile_width")).cast("long").alias("x"), (F.col("y0") + F.floor(F.col("k") / F.col("tile_width"))).cast("long").alias("y"),
        F.col("v").cast("double").alias("v"), at("err").cast("double").alias("err"), F.coalesce(at("dq"), F.lit(0)).cast("long").alias("dq"), at("wht").cast("double").alias("wht"),
    )


def correction_tables(spark: SparkSession, path: str) -> dict[tuple[str, int], tuple]:
    """Detector corrections by (file, chip): the x and y tables (``functions.wcs.Correction``) of D2IMARR planes 1 to 4, two a chip.

    A correction table is a few thousand numbers a chip; they come to the driver for the mappers, a file's four planes each.
    """
    from lumenweave.functions.wcs import Correction

    fits.register(spark)
    rows = spark.read.format("fits").option("tileSize", "4096").option("extname", "D2IMARR").load(path).collect()
    found: dict[tuple[str, int], Correction] = {}
    for r in rows:
        found[r["file"], r["extver"]] = Correction.of(np.array(r["data"], dtype=float).reshape(r["height"], r["width"]), r["cards"])
    chips = {(f, (v + 1) // 2) for f, v in found}
    return {(f, c): (found.get((f, 2 * c - 1)), found.get((f, 2 * c))) for f, c in chips}


def _any(table: str, keys: tuple[str, ...]) -> list[Column]:
    return [F.upper(F.coalesce(_text(table, k), F.lit(""))) for k in keys]


def calibration_kind(cards: str, name: Column) -> Column:
    """bpm, bias, flat, science or '' from a primary header's cards (a map column) and the file's name: the first rule that holds."""
    words = _any(cards, ("OBSTYPE", "IMAGETYP"))
    more = [*words, *_any(cards, ("OBJECT",))]
    has = lambda texts, *parts: reduce(or_, [t.contains(p) for t in texts for p in parts])
    file = F.upper(name)
    return (
        F.when(has(words, "BPM") | has([file], "BPM", "BADPIX"), "bpm")
        .when(has(more, "BIAS"), "bias")
        .when(has(more, "TWILIGHT", "FLAT"), "flat")
        .when(has(more, "DARK", "MASK", "MDF", "BAD PIXEL"), "")
        .otherwise("science")
    )


def calibrations(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder by kind, from headers alone: file, kind, filter, day, exptime, and whether a bias looks anomalous (5 to 5.4 s)."""
    fits.register(spark)
    head = spark.read.format("fits").option("pixels", "false").load(path).filter("hdu = 0")
    kind = calibration_kind("cards", F.substring_index("file", "/", -1))
    exposure = F.coalesce(*[F.when(_number("cards", k) > 0, _number("cards", k)) for k in EXPOSURE_CARDS], F.lit(0.0))
    day = F.coalesce(_text("cards", "DATE-OBS"), _text("cards", "DATEOBS"), F.lit(""))
    rows = head.select("file", kind.alias("kind"), F.coalesce(_text("cards", "FILTER"), F.lit("")).alias("filter"), F.when(F.length(day) >= 10, F.substring(day, 1, 10)).otherwise("").alias("day"), exposure.alias("exptime"))
    return rows.filter("kind <> ''").withColumn("anomalous", (F.col("kind") == "bias") & (F.col("exptime") > 5) & (F.col("exptime") < 5.4))
