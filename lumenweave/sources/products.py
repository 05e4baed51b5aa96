"""Products: mosaics and star maps as multi-plane files, masks, discovery, header listings, reduced copies."""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.operators.combine import block_reduce
from lumenweave.sources import fits, storage

#: Planes of a mosaic in order: column, EXTNAME, exact integers.
MOSAIC_PLANES = (("weight", "WHT", False), ("inputs", "NCONTRIB", True), ("ctx", "CTX", True), ("crmask", "CRMASK", True), ("dq", "DQ", True), ("skymodel", "SKYMODEL", False), ("seam", "SEAM", False))
#: Columns of a star map's table and their forms.
STAR_COLUMNS = (
    ("ID", "1J"), ("X", "1D"), ("Y", "1D"), ("FWHM", "1D"), ("RADIUS", "1D"), ("SNR", "1D"), ("RESIDUAL", "1D"), ("AMPLITUDE", "1D"),
    ("STATUS", "12A"), ("REASON", "80A"), ("SATURATED", "1L"), ("USABLE", "1J"), ("CONFIRMED", "1J"), ("OVERRIDE", "8A"),
)
#: Bits of a star map's flag plane.
UNCOVERED, UNCERTAIN, SATURATION, MANUAL = 1, 2, 4, 16
#: Key cards of a listing, in order.
KEY_CARDS = ("TELESCOP", "INSTRUME", "DETECTOR", "FILTER", "PUPIL", "DATE-OBS", "EXPTIME", "BUNIT", "PROPOSID")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Raster files directly in a folder (path, size, modified), by path, star maps left out; nothing is decoded."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).drop("content")
    name = F.lower(F.substring_index("path", "/", -1))
    good = name.rlike(r"\.(fits|fit|fts|asdf)$") & ~name.endswith("_starmap.fits")
    return found.filter(good).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("path")


def compose_inputs(files: DataFrame) -> DataFrame:
    """Mosaics that a name marks as one filter's (F606W_..._drz.fits): path and filter, by the filter's number, then name."""
    name = F.substring_index("path", "/", -1)
    pattern = r"(?i)^(F\d{3,4}[A-Z0-9]*)_.*(drz|driz|drizzle)\.fits$"
    got = files.withColumn("filter", F.upper(F.regexp_extract(name, pattern, 1))).filter("filter <> ''")
    return got.withColumn("number", F.regexp_extract("filter", r"(\d+)", 1).cast("int")).orderBy("number", "path").select("path", "filter", "number")


def list_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row a header unit: key cards, plate scale and, of planes, count, median and spread of the finite samples."""
    fits.register(spark)
    units = spark.read.format("fits").option("pixels", "false").load(path)
    card = lambda k: F.col("cards")[k]
    scale = F.sqrt(F.abs(card("CD1_1").try_cast("double") * card("CD2_2").try_cast("double") - F.coalesce(card("CD1_2").try_cast("double"), F.lit(0.0)) * F.coalesce(card("CD2_1").try_cast("double"), F.lit(0.0)))) * 3600
    head = units.select("file", "hdu", "extname", "extver", "width", "height", *[card(k).alias(k.lower().replace("-", "_")) for k in KEY_CARDS], scale.alias("arcsec_per_pixel"))
    from lumenweave.operators.stats import linear, quantiles

    px = fits.pixels(spark.read.format("fits").load(path)).filter(~F.isnan("v"))
    middle = quantiles(px, ["file", "hdu"], F.col("v"), {"median": linear(0.5)}).withColumnRenamed("n", "samples")
    stat = middle.join(px.groupBy("file", "hdu").agg(F.stddev_pop("v").alias("spread")), ["file", "hdu"])
    return head.join(stat, ["file", "hdu"], "left").orderBy("file", "hdu")


def save_mosaic(mosaic: DataFrame, path: str, width: int, height: int, cards: dict | None = None, input_keys: list[str] = ()) -> int:
    """A mosaic (ox, oy, v and those of MOSAIC_PLANES it has) as one file, published whole; returns its pixels.

    ``planes`` (a map of plane number to context bits) becomes CTX01, CTX02, ...: as many as ``input_keys`` need, 32 a plane.
    CTXMAP holds the inputs' names, one after the other with a zero between. A row of pixels is in memory at a time.
    """
    have = set(mosaic.columns)
    rows = mosaic.select(F.col("ox").alias("x"), F.col("oy").alias("y"), *[F.col(c) for c in mosaic.columns if c not in ("ox", "oy")])
    columns = [("v", "", False)] + [p for p in MOSAIC_PLANES if p[0] in have]
    if "planes" in have:
        for k in range(-(-len(input_keys) // 32)):
            # bit 31 is a signed integer's sign
            bits = F.coalesce(F.try_element_at("planes", F.lit(k).cast("long")), F.lit(0))
            rows = rows.withColumn(f"ctx{k}", F.when(bits >= 1 << 31, bits - (1 << 32)).otherwise(bits))
            columns.insert(1 + sum(c[1] in ("WHT", "NCONTRIB", "CTX") or c[1].startswith("CTX0") for c in columns[1:]), (f"ctx{k}", f"CTX{k + 1:02d}", True))
    extra = []
    if input_keys:
        names = np.frombuffer("\0".join(input_keys).encode(), dtype=np.uint8).astype(np.int32)[None]
        extra.append(fits.encode_plane(names, {"CTXNKEY": len(input_keys)}, False, "CTXMAP"))
    for c, _, exact in columns[1:]:
        if exact:
            rows = rows.withColumn(c, F.coalesce(F.col(c).cast("long"), F.lit(0)))
    return fits.write_sorted(rows, path, width, height, columns, cards, extra)


def context_keys(spark: SparkSession, path: str) -> list[str]:
    """The inputs' names of a saved mosaic, in bit order."""
    fits.register(spark)
    rows = spark.read.format("fits").option("tileSize", str(1 << 20)).option("extname", "CTXMAP").load(path).select("data").collect()
    return bytes(int(v) for r in rows for v in r["data"]).decode().split("\0") if rows else []


def science_hash(pixels: DataFrame, width: int, height: int) -> str:
    """SHA-256 of a plane's samples (x, y, v) as big-endian float32 in row order, a missing one as NaN: a row in memory at a time."""

    def run(batches):
        digest, at, row = hashlib.sha256(), 0, np.full(width, np.nan, dtype=">f4")
        for pdf in batches:
            for y, own in pdf.groupby("y", sort=True):
                while at < y:
                    digest.update(row.tobytes())
                    at, row = at + 1, np.full(width, np.nan, dtype=">f4")
                row[own["x"].to_numpy()] = own["v"].to_numpy()
        while at < height:
            digest.update(row.tobytes())
            at, row = at + 1, np.full(width, np.nan, dtype=">f4")
        yield pd.DataFrame({"h": [digest.hexdigest()]})

    return pixels.select("x", "y", F.col("v").cast("float").alias("v")).orderBy("y", "x").coalesce(1).mapInPandas(run, "h string").first()["h"]


def accepted(status: Column, override: Column) -> Column:
    """A decision by hand beats the automatic one."""
    return F.coalesce((override == "accept") | ((F.coalesce(override, F.lit("")) != "reject") & (status == "accepted")), F.lit(False))


def star_planes(sources: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels (x, y, v) with a star map's planes: mask 0..1 and label of the accepted sources, and flags of all."""
    from lumenweave.operators.raster import feathered

    take = accepted(F.col("status"), F.col("override"))
    flags = F.when(~take & (F.col("status") == "uncertain"), UNCERTAIN).otherwise(0) + F.when(F.col("saturated"), SATURATION).otherwise(0)
    flags = flags + F.when(F.coalesce(F.col("override"), F.lit("")) != "", MANUAL).otherwise(0)
    s = sources.select(F.lit(0).cast("long").alias("frame"), "id", "x", "y", "radius", flags.cast("long").alias("bits"), take.alias("take"))
    lit = feathered(s.filter("take")).select("x", "y", "mask", "label")
    seen = feathered(s).select("x", "y", "bits")
    j = pixels.select("x", "y", "v").join(lit, ["x", "y"], "left").join(seen, ["x", "y"], "left")
    uncovered = F.when(F.isnan("v") | F.col("v").isNull(), UNCOVERED).otherwise(0)
    return j.select(
        "x", "y", F.coalesce("mask", F.lit(0.0)).alias("mask"), F.coalesce("label", F.lit(0)).cast("long").alias("label"), F.coalesce("bits", F.lit(0)).bitwiseOR(uncovered).cast("long").alias("flags")
    )


def save_star_map(sources: DataFrame, pixels: DataFrame, path: str, width: int, height: int, provenance: dict, cards: dict | None = None) -> None:
    """A star map: mask, LABELS and FLAGS planes, the STARS table and INPUTS provenance, bound to the science pixels by their hash.

    A file that is there and is no star map is refused. The table's rows are written by tasks, range by range of their ids.
    """
    spark = pixels.sparkSession
    if storage.exists(path):
        fits.register(spark)
        old = spark.read.format("fits").option("pixels", "false").load(path).filter("hdu = 0").first()
        if old is None or old["cards"].get("PRODUCT") != "STARMAP":
            raise FileExistsError(f"{path} is no star map")
    names = [n.lower() for n, _ in STAR_COLUMNS]
    dtype = np.dtype([(n, {"1J": ">i4", "1D": ">f8", "1L": "S1"}.get(f, f"S{f[:-1]}")) for n, f in STAR_COLUMNS])

    def encoded(table: pd.DataFrame) -> np.ndarray:
        rows = np.zeros(len(table), dtype=dtype)
        for name, form in STAR_COLUMNS:
            c = table[name.lower()]
            if form.endswith("A"):
                rows[name] = [str(x or "").encode("latin-1", "replace")[: int(form[:-1])].ljust(int(form[:-1])) for x in c]
            elif form == "1L":
                rows[name] = np.where(c.fillna(False).astype(bool), b"T", b"F")
            else:
                rows[name] = c.to_numpy() + (1 if name in "XY" else 0)  # places count from 1 in a file
        return rows

    table = fits.spool_table(sources.select(*names), path, "STARS", list(STAR_COLUMNS), encoded, "id", {"COORDSYS": "FITS 1-based pixels"})
    good = int(sources.filter(accepted(F.col("status"), F.col("override"))).count())
    head = {"PRODUCT": "STARMAP", "SMAPVER": 1, "BUNIT": "1", "NSOURCE": table.rows, "NACCEPT": good, **(cards or {})}
    hashed = science_hash(pixels, width, height)
    head |= {"SCIHASH": hashed}
    text = json.dumps(provenance, sort_keys=True).encode()
    tables = [table]
    tables.append(fits.encode_table("INPUTS", [("JSON", f"{len(text)}A")], np.array([text], dtype=[("JSON", f"S{len(text)}")])))
    planes = [("mask", "", False), ("label", "LABELS", True), ("flags", "FLAGS", True)]
    try:
        fits.write_sorted(star_planes(sources, pixels), path, width, height, planes, head, tables)
    finally:
        table.remove()


def read_star_map(spark: SparkSession, path: str, pixels: DataFrame | None = None, width: int = 0, height: int = 0) -> tuple[DataFrame, DataFrame, dict]:
    """(sources, planes x, y, mask, label, flags; provenance) of a star map. With the science ``pixels`` and their size it must be of just these."""
    fits.register(spark)
    head = spark.read.format("fits").option("pixels", "false").load(path).filter("hdu = 0").first()
    if head is None or head["cards"].get("PRODUCT") != "STARMAP" or head["cards"].get("SMAPVER") != "1":
        raise ValueError(f"{path} is no star map of a known version")
    if pixels is not None:
        if (head["width"], head["height"]) != (width, height):
            raise ValueError("the star map and the science plane differ in size")
        if science_hash(pixels, width, height) != head["cards"].get("SCIHASH"):
            raise ValueError("the science pixels changed: make the star map again")
    stars = spark.read.format("fits_table").option("extname", "STARS").load(path).drop("file")
    stars = stars.withColumns({"x": F.col("x") - 1, "y": F.col("y") - 1})
    note = json.loads(spark.read.format("fits_table").option("extname", "INPUTS").load(path).first()["json"])
    px = fits.pixels(spark.read.format("fits").load(path))
    one = lambda name, c: px.filter(F.col("extname") == name).select("x", "y", c)
    grid = one("", F.col("v").cast("double").alias("mask")).join(one("LABELS", F.col("exact").alias("label")), ["x", "y"]).join(one("FLAGS", F.col("exact").alias("flags")), ["x", "y"])
    return stars, grid, note


def context_planes(contributions: DataFrame) -> DataFrame:
    """Which inputs make each output pixel: a column of bits for each plane of 32 inputs, and their number."""
    from lumenweave.operators.combine import context

    bits = context(contributions)
    wide = bits.groupBy("ox", "oy").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("plane", "bits")))).alias("planes"), F.sum("n").alias("inputs"))
    return wide.select("ox", "oy", "planes", "inputs")


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """The pixels of a mask file that are finite and not zero."""
    fits.register(spark)
    return fits.pixels(spark.read.format("fits").option("hdu", "0").load(path)).filter("v <> 0 AND NOT isnan(v)").select("file", "x", "y")


def save_mask(mask: DataFrame, path: str, width: int, height: int, overwrite: bool = False) -> None:
    """A mask of 0 and 1 of stated size; pixels outside it are an error, an existing file too unless told otherwise."""
    bad = mask.filter((F.col("x") < 0) | (F.col("x") >= width) | (F.col("y") < 0) | (F.col("y") >= height)).limit(1).count()
    if bad:
        raise ValueError("the mask leaves its raster")
    if not overwrite and storage.exists(path):
        raise FileExistsError(path)
    columns = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")))
    grid = mask.sparkSession.range(height).select(F.col("id").alias("y"), columns.alias("x"))
    on = mask.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.lit(1.0).alias("v")).distinct()
    fits.write_sorted(grid.join(on, ["x", "y"], "left").select("x", "y", F.coalesce("v", F.lit(0.0)).alias("v")), path, width, height, [("v", "", False)])


def reduced_name(path: str, factor: int) -> str:
    stem, dot, suffix = os.path.basename(path).rpartition(".")
    return f"{stem}_bin{factor}{dot}{suffix}"


def reduce_files(spark: SparkSession, path: str, out: str, factor: int) -> DataFrame:
    """Copies of files reduced by an even factor: science means, weight sums, error roots of squares, mask bits OR, chip by chip.

    An odd or too small factor, files whose chips differ in size or number, and an existing copy are refused. Returns (file, path, chips).
    A file is one group: a detector's chips.
    """
    from lumenweave.sources.inputs import input_pixels, input_table

    if factor < 2 or factor % 2:
        raise ValueError("the factor must be even")
    table = input_table(spark, path)
    layout = table.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("chip", "width", "height"))).alias("chips")).collect()  # a row a file
    if len({tuple(map(tuple, r["chips"])) for r in layout}) != 1:
        raise ValueError("the files' layouts differ")
    sizes = {c["chip"]: (c["width"] // factor, c["height"] // factor) for c in layout[0]["chips"]}
    whole = max(c["width"] for c in layout[0]["chips"]), max(c["height"] for c in layout[0]["chips"])
    target = {r["file"]: f"{out.rstrip('/')}/{reduced_name(r['file'], factor)}" for r in layout}
    for p in target.values():
        if storage.exists(p):
            raise FileExistsError(p)
    px = input_pixels(spark, path, table)
    rows = px.select(F.struct("file", "chip").alias("frame"), *("x", "y", "v"), F.coalesce("wht", F.lit(0.0)).alias("wht"), "err", "dq")
    small = block_reduce(rows, factor, *whole).select("frame.file", "frame.chip", F.col("bx").alias("x"), F.col("by").alias("y"), "v", "wht", "err", "dq")
    has = {r["file"]: (r["err"], r["dq"], r["wht"]) for r in table.groupBy("file").agg(*[F.count(c).alias(c) for c in ("err", "dq", "wht")]).collect()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["file"].iloc[0]
        err, dq, wht = has[name]
        out_planes = [("", np.zeros((1, 1), dtype=np.float32), {"NREDUCE": factor})]
        for chip, own in pdf.groupby("chip"):
            w, h = sizes[int(chip)]
            own = own[(own["x"] < w) & (own["y"] < h)]
            for c, extname, have in (("v", "SCI", 1), ("err", "ERR", err), ("dq", "DQ", dq), ("wht", "WHT", wht)):
                if have:
                    g = np.zeros((h, w), dtype=np.int32) if c == "dq" else np.full((h, w), np.nan, dtype=np.float32)
                    g[own["y"], own["x"]] = own[c]
                    out_planes.append((extname, g, {"EXTVER": int(chip)}))
        fits.write_file(target[name], out_planes, overwrite=False)
        return pd.DataFrame({"file": [name], "path": [target[name]], "chips": [pdf["chip"].nunique()]})

    return small.groupBy("file").applyInPandas(run, "file string, path string, chips int")


def relative_path(base: str, path: str) -> str:
    """A path as a project stores it: relative to its folder where it lies inside, with forward slashes."""
    rel = os.path.relpath(path, base).replace(os.sep, "/")
    return path if rel.startswith("../") else rel


def filter_of_name(name: str) -> str:
    m = re.match(r"(?i)^(F\d{3,4}[A-Z0-9]*)_", os.path.basename(name))
    return m[1].upper() if m else ""
