"""Sources and sinks by round trips: tables are written as files into the shared folder and read back. S01-S20, K01-K13, F14, M04, M05, X01-X06, R01, R04, P11."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenweave.functions import scalars as s
from lumenweave.operators import align, combine, extend, mosaic
from lumenweave.plans.registry import query, r
from lumenweave.plans.views import pix, pix_nan, stars, table, with_views
from lumenweave.session import shared_folder
from lumenweave.sources import asdf, export, fits, inputs, paged, products, records
from lumenweave.streaming import jobs

P, N, S = with_views("pix"), with_views("pix_nan"), with_views("stars")
SIDE = 64
#: A file holds two frames as its chips: frame = 2 * file + chip - 1.


def exposure():
    return F.regexp_extract("file", r"exp-(\d+)_", 1).cast("long")


PLANES = """u AS (SELECT frame // 2 AS exposure, frame % 2 + 1 AS chip, x, y, v AS sci, err, dq FROM pix)"""


def exposures(spark, sf: str) -> str:
    """The pixel view as files of two chips each: SCI, ERR and DQ planes, and a correction table a chip."""
    folder = shared_folder(spark, "exposures")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["exposure"].iloc[0])
        out = [("", np.zeros((1, 1), dtype=np.float32), {"TELESCOP": "O'Hara", "INSTRUME": "CAM", "EXPTIME": 100.0 + k, "DATE-OBS": f"2020-01-{k + 1:02d}", "FILTER": "F606W"})]
        for chip, own in pdf.groupby("chip"):
            for c, name, kind in (("v", "SCI", np.float32), ("err", "ERR", np.float32), ("dq", "DQ", np.int32)):
                g = np.zeros((SIDE, SIDE), dtype=kind) if c == "dq" else np.full((SIDE, SIDE), np.nan, dtype=kind)
                g[own["y"], own["x"]] = own[c]
                out.append((name, g, {"EXTVER": int(chip), **({"BUNIT": "ELECTRONS"} if name == "SCI" else {})}))
            for axis in (1, 2):
                t = np.add.outer(np.arange(5), 2 * np.arange(5)).astype(np.float32) * axis / 64
                place = {f"{a}{i}": v for i in (1, 2) for a, v in (("CRPIX", 1.0), ("CRVAL", 1.0), ("CDELT", 16.0))}
                out.append(("D2IMARR", t, {"EXTVER": 2 * (int(chip) - 1) + axis, **place}))
        fits.write_file(f"{folder}/exp-{k}_flc.fits", out)
        return pd.DataFrame({"exposure": [k]})

    rows = pix(spark, sf).withColumns({"exposure": F.floor(F.col("frame") / 2), "chip": F.col("frame") % 2 + 1})
    rows.groupBy("exposure").applyInPandas(run, "exposure long").count()
    fits.register(spark)
    return folder


def _tiles(spark, sf: str, **options: str):
    reader = spark.read.format("fits")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(exposures(spark, sf))


EXACT = "CASE WHEN name = 'DQ' THEN dq END"


@query(
    "s01_fits_scan",
    f"""{P}, {PLANES}, e AS (SELECT exposure, chip, x, y, unnest(['SCI', 'ERR', 'DQ']) AS name, unnest([sci, err, CAST(dq AS DOUBLE)]) AS v FROM u) SELECT exposure, name, chip, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(v, 3) AS v FROM e WHERE v <> 0""",
)
def s01(spark, sf):
    px = fits.pixels(_tiles(spark, sf, tileSize="24")).filter("extname IN ('SCI', 'ERR', 'DQ') AND NOT isnan(v) AND v <> 0")
    return px.select(exposure().alias("exposure"), F.col("extname").alias("name"), F.col("extver").cast("long").alias("chip"), "x", "y", r(F.col("v").cast("double"), "v", 3))


@query(
    "s02_fits_metadata",
    f"""{P}, f AS (SELECT DISTINCT frame // 2 AS exposure, frame % 2 + 1 AS chip FROM pix), n AS (SELECT exposure, chip, unnest(['SCI', 'ERR', 'DQ']) AS name FROM f)
SELECT exposure, name, chip, 64 AS width, 64 AS height, CAST(NULL AS DOUBLE) AS exptime FROM n UNION ALL SELECT DISTINCT exposure, '', CAST(NULL AS BIGINT), 1, 1, 100.0 + exposure FROM f""",
)
def s02(spark, sf):
    units = _tiles(spark, sf, pixels="false").filter("extname <> 'D2IMARR'")
    return units.select(exposure().alias("exposure"), F.col("extname").alias("name"), F.col("extver").cast("long").alias("chip"), "width", "height", F.col("cards")["EXPTIME"].try_cast("double").alias("exptime"))


@query("s03_selective_scan", f"{P}, {PLANES} SELECT exposure, count(*) AS n, round(sum(err), 2) AS total FROM u WHERE chip = 2 GROUP BY 1")
def s03(spark, sf):
    px = fits.pixels(_tiles(spark, sf, extname="ERR", extver="2")).filter("NOT isnan(v)")
    return px.groupBy(exposure().alias("exposure")).agg(F.count("*").alias("n"), r(F.sum(F.col("v").cast("double")), "total", 2))


@query("s04_select_planes", f"{P}, {PLANES} SELECT exposure, chip, count(*) AS n, CAST(sum(dq) AS BIGINT) AS bits, bit_or(dq) AS every FROM u GROUP BY 1, 2")
def s04(spark, sf):
    px = fits.pixels(_tiles(spark, sf, extname="DQ")).filter("exact <> 0")
    return px.groupBy(exposure().alias("exposure"), F.col("extver").cast("long").alias("chip")).agg(F.count("*").alias("n"), F.sum("exact").alias("bits"), F.bit_or("exact").alias("every"))


@query("s05_streamed_plane", f"{P}, {PLANES} SELECT exposure, CAST(y // 8 * 8 AS INTEGER) AS y0, count(*) AS n, round(sum(sci), 2) AS total FROM u WHERE chip = 1 GROUP BY 1, 2")
def s05(spark, sf):
    """One unit of each file in strips of eight rows, which several tasks of a file share."""
    t = _tiles(spark, sf, tileSize="8", splitBytes="20000", hdu="1")
    good = F.filter("data", lambda v: ~F.isnan(v))
    strips = t.groupBy(exposure().alias("exposure"), "y0").agg(F.sum(F.size(good)).alias("n"), r(F.sum(F.aggregate(good, F.lit(0.0), lambda a, v: a + v)), "total", 2))
    return strips.filter("n > 0")


def asdf_folder(spark, sf: str) -> str:
    folder = shared_folder(spark, "trees")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["frame"].iloc[0])
        v, dq = np.full((SIDE, SIDE), np.nan, dtype=np.float32), np.zeros((SIDE, SIDE), dtype=np.uint32)
        v[pdf["y"], pdf["x"]], dq[pdf["y"], pdf["x"]] = pdf["v"], pdf["dq"]
        asdf.write_asdf(f"{folder}/tree-{k}.asdf", {"data": v, "dq": dq}, {"instrument": "CAM", "exptime": 10.5 + k})
        return pd.DataFrame({"frame": [k]})

    pix(spark, sf).groupBy("frame").applyInPandas(run, "frame long").count()
    return folder


def tree():
    return F.regexp_extract("file", r"tree-(\d+)\.", 1).cast("long")


@query("s06_asdf_scan", f"{P} SELECT frame, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(v, 3) AS v FROM pix")
def s06(spark, sf):
    px = fits.pixels(asdf.open_raster(spark, asdf_folder(spark, sf), tileSize="20").filter("extname = 'data'")).filter("NOT isnan(v)")
    return px.select(tree().alias("frame"), "x", "y", r(F.col("v").cast("double"), "v", 3))


@query(
    "s07_source_registry",
    f"""{P}, f AS (SELECT DISTINCT frame FROM pix), n AS (SELECT 'asdf' AS kind, unnest(['data', 'dq']) AS name FROM f UNION ALL SELECT 'fits', unnest(['SCI', 'ERR', 'DQ']) FROM f)
SELECT kind, name, count(*) AS planes, CAST(count(*) * 4096 AS BIGINT) AS samples FROM n GROUP BY 1, 2""",
)
def s07(spark, sf):
    """Folders of either kind opened without saying which."""
    out = None
    for kind, folder in (("asdf", asdf_folder(spark, sf)), ("fits", exposures(spark, sf))):
        t = asdf.open_raster(spark, folder).filter("extname IN ('data', 'dq', 'SCI', 'ERR', 'DQ')")
        own = t.groupBy(F.lit(kind).alias("kind"), F.col("extname").alias("name")).agg(F.countDistinct("file", "hdu").alias("planes"), F.sum(F.size("data")).alias("samples"))
        out = own if out is None else out.union(own)
    return out


@query("s08_plane_decoder", f"{P}, {PLANES} SELECT exposure, chip, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, dq FROM u")
def s08(spark, sf):
    """Masks keep their exact bits."""
    px = fits.pixels(_tiles(spark, sf, exact="true", extname="DQ")).filter("exact <> 0")
    return px.select(exposure().alias("exposure"), F.col("extver").cast("long").alias("chip"), "x", "y", F.col("exact").alias("dq"))


@query("s09_tree_metadata", f"{P}, f AS (SELECT DISTINCT frame FROM pix) SELECT frame, unnest(['data', 'dq']) AS name, 64 AS width, 64 AS height, 'CAM' AS instrument, CAST(10.5 + frame AS DOUBLE) AS exptime FROM f")
def s09(spark, sf):
    t = asdf.open_raster(spark, asdf_folder(spark, sf), pixels="false")
    card = lambda k: F.col("cards")[k]
    return t.select(tree().alias("frame"), F.col("extname").alias("name"), "width", "height", card("instrument").alias("instrument"), card("exptime").cast("double").alias("exptime"))


@query(
    "s10_input_table",
    f"""{P}, f AS (SELECT DISTINCT frame // 2 AS exposure, CAST(frame % 2 + 1 AS INTEGER) AS chip FROM pix)
SELECT exposure, chip, 64 AS width, 64 AS height, (chip - 1) * 5 + 1 AS sci, (chip - 1) * 5 + 2 AS err, (chip - 1) * 5 + 3 AS dq, CAST(NULL AS INTEGER) AS wht, CAST(100.0 + exposure AS DOUBLE) AS exptime,
'2020-01-0' || (exposure + 1) AS date_obs, 'ELECTRONS' AS bunit FROM f""",
)
def s10(spark, sf):
    t = inputs.input_table(spark, exposures(spark, sf))
    return t.select(exposure().alias("exposure"), "chip", "width", "height", "sci", "err", "dq", "wht", "exptime", "date_obs", "bunit")


def _input_rows(spark, sf, **what):
    folder = exposures(spark, sf)
    px = inputs.input_pixels(spark, folder, inputs.input_table(spark, folder), **what)
    return px.filter("NOT isnan(v)").select(exposure().alias("exposure"), "chip", "x", "y", r("v", digits=3), r("err", digits=3), "dq")


@query("s10_input_pixels", f"{P}, {PLANES} SELECT exposure, CAST(chip AS INTEGER) AS chip, x, y, round(sci, 3) AS v, round(err, 3) AS err, dq FROM u")
def s10_pixels(spark, sf):
    return _input_rows(spark, sf, tile=20)


@query("s11_chip_reload", f"{P}, {PLANES} SELECT exposure, CAST(chip AS INTEGER) AS chip, x, y, round(sci, 3) AS v, CAST(NULL AS DOUBLE) AS err, dq FROM u WHERE chip = 2")
def s11(spark, sf):
    return _input_rows(spark, sf, chip=2, aux=False)


def _named_files(spark, sf: str) -> str:
    """Empty files whose names come from the part table's brands and types."""
    folder = shared_folder(spark, "names")
    brands = [x["b"] for x in table(spark, sf, "part").select(F.col("p_brand").alias("b")).distinct().orderBy("b").collect()]  # a few dozen
    for k, b in enumerate(brands):
        name = ("F{n}W_{b}_drz.fits", "f{n}n_{b}_DRIZZLE.fits", "{b}_{n}_starmap.fits", "{b}_{n}.FIT", "{b}_{n}.asdf", "{b}_{n}.txt")[k % 6].format(n=400 + k * 7, b=b.replace("#", "").replace(" ", ""))
        fits.write_bytes(f"{folder}/{name}", iter([b"x" * (k + 1)]))
    return folder


BRANDS = """WITH b AS (SELECT p_brand AS b, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS k FROM (SELECT DISTINCT p_brand FROM part)),
c AS (SELECT k, replace(replace(b, '#', ''), ' ', '') AS b, CAST(400 + k * 7 AS VARCHAR) AS n FROM b),
f AS (SELECT k, CASE k % 6 WHEN 0 THEN 'F' || n || 'W_' || b || '_drz.fits' WHEN 1 THEN 'f' || n || 'n_' || b || '_DRIZZLE.fits' WHEN 2 THEN b || '_' || n || '_starmap.fits' WHEN 3 THEN b || '_' || n || '.FIT' WHEN 4 THEN b || '_' || n || '.asdf' ELSE b || '_' || n || '.txt' END AS name FROM c)"""


@query("s12_discovery", f"{BRANDS} SELECT name, k + 1 AS size FROM f WHERE k % 6 NOT IN (2, 5)")
def s12(spark, sf):
    return products.discover(spark, _named_files(spark, sf)).select(F.substring_index("path", "/", -1).alias("name"), "size")


@query("s13_compose_discovery", f"{BRANDS} SELECT name, 'F' || (400 + k * 7) || CASE WHEN k % 6 = 0 THEN 'W' ELSE 'N' END AS filter, CAST(400 + k * 7 AS INTEGER) AS number FROM f WHERE k % 6 < 2")
def s13(spark, sf):
    got = products.compose_inputs(products.discover(spark, _named_files(spark, sf)))
    return got.select(F.substring_index("path", "/", -1).alias("name"), "filter", "number")


KINDS = ("BIAS", "Twilight sky", "OBJECT", "BPM", "lamp flat", "DARK")


@query(
    "s14_calibrations",
    """WITH k AS (SELECT n_nationkey AS k, n_name FROM nation), f AS (SELECT k, ['BIAS', 'Twilight sky', 'OBJECT', 'BPM', 'lamp flat', 'DARK'][k % 6 + 1] AS w, CASE WHEN k % 4 = 0 THEN 5.2 ELSE k END AS t FROM k)
SELECT k, CASE w WHEN 'BIAS' THEN 'bias' WHEN 'BPM' THEN 'bpm' WHEN 'OBJECT' THEN 'science' ELSE 'flat' END AS kind, CAST(CASE WHEN t > 0 THEN t ELSE 0 END AS DOUBLE) AS exptime, w = 'BIAS' AND t > 5 AND t < 5.4 AS anomalous FROM f WHERE w <> 'DARK'""",
)
def s14(spark, sf):
    folder = shared_folder(spark, "calibrations")
    for n in table(spark, sf, "nation").collect():  # 25 rows
        k = n["n_nationkey"]
        fits.write_file(f"{folder}/n{k:03d}.fits", [("", np.zeros((2, 2), np.float32), {"INSTRUME": "GMOS-N", "OBSTYPE": KINDS[k % 6], "OBJECT": n["n_name"], "EXPTIME": 5.2 if k % 4 == 0 else float(k)})])
    got = inputs.calibrations(spark, folder)
    return got.select(F.regexp_extract("file", r"n(\d+)\.fits", 1).cast("int").alias("k"), "kind", "exptime", "anomalous")


def _paged(spark, sf: str) -> tuple[str, int]:
    """The pixels of all frames as one raster, frame below frame."""
    rows = pix(spark, sf).select("x", (F.col("frame") * SIDE + F.col("y")).alias("y"), "v")
    at = rows.groupBy(F.floor(F.col("x") / 16).cast("int").alias("tx"), F.floor(F.col("y") / 16).cast("int").alias("ty")).agg(F.collect_list(F.struct((F.col("y") % 16 * 16 + F.col("x") % 16).cast("int").alias("k"), "v")).alias("p"))
    # tiles are whole: what no pixel has is NaN
    full = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.coalesce(F.map_from_entries("p")[k], F.lit(float("nan"))))
    tiles = at.select("tx", "ty", (F.col("tx") * 16).alias("x0"), (F.col("ty") * 16).alias("y0"), F.lit(16).alias("tile_width"), F.lit(16).alias("tile_height"), full.alias("data"))
    path = shared_folder(spark, "paged")
    paged.write(spark, path, tiles, SIDE, 8 * SIDE)
    return path, 8 * SIDE


@query("s15_paged_window", f"{P} SELECT CAST(x AS INTEGER) AS x, CAST(frame * 64 + y AS INTEGER) AS y, round(v, 3) AS v FROM pix WHERE x >= 5 AND x < 60 AND frame * 64 + y >= 30 AND frame * 64 + y < 500")
def s15(spark, sf):
    path, _ = _paged(spark, sf)
    return paged.window(spark, path, 5, 30, 60, 500).filter("NOT isnan(v)").select("x", "y", r(F.col("v").cast("double"), "v", 3))


@query("s15_paged_turned", f"{P} SELECT CAST(x AS INTEGER) AS y, count(*) AS n, round(sum(v * (511 - frame * 64 - y)), 0) AS moment FROM pix GROUP BY 1")
def s15_turned(spark, sf):
    """Every row of the raster turned by a quarter: the moment of its samples tells their order."""
    path, height = _paged(spark, sf)
    got = paged.rotated_rows(spark, path, 1, 0, SIDE).select("y", F.posexplode("values").alias("k", "v"))
    # a tile that has no pixel at all is missing, not NaN: places are those of the samples that are there
    px = paged.window(spark, path, 0, 0, SIDE, height).filter("NOT isnan(v)").groupBy(F.col("x").alias("y")).agg(F.count("*").alias("n"), r(F.sum(F.col("v").cast("double") * (height - 1 - F.col("y"))), "moment", 0))
    have = got.filter("NOT isnan(v)").groupBy("y").agg(F.count("*").alias("found"))
    return px.join(have, "y").filter("n = found").drop("found")


@query(
    "s16_records",
    """WITH s AS (SELECT s_suppkey AS k, s_name AS name, round(s_acctbal / 100, 3) AS dx FROM supplier) SELECT 'offsets' AS kind, name, dx, round(CASE WHEN k % 2 = 0 THEN -1.5 ELSE 0 END, 3) AS dy FROM s
UNION ALL SELECT 'project', CASE WHEN k % 3 = 0 THEN '/abs/' || name ELSE '/base/' || name END, dx, round(0, 3) FROM s""",
)
def s16(spark, sf):
    folder = shared_folder(spark, "records")
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", r(F.col("s_acctbal") / 100, "dx", 3)).collect()  # a project's inputs
    records.write_report([{"name": x["s_name"], "dx": x["dx"], **({"dy": -1.5} if x["s_suppkey"] % 2 == 0 else {})} for x in rows], f"{folder}/offsets.json")
    project = {"version": 2, "reference": rows[0]["s_name"], "inputs": [{"path": ("/abs/" if x["s_suppkey"] % 3 == 0 else "") + x["s_name"], "dx": x["dx"]} for x in rows]}
    records.write_report(project, f"{folder}/mosaic.json")
    offsets = records.read_offsets(spark, f"{folder}/offsets.json").select(F.lit("offsets").alias("kind"), "name", "dx", "dy")
    found = records.read_mosaic_project(spark, f"{folder}/mosaic.json", "/base").select(F.lit("project").alias("kind"), F.col("path").alias("name"), "dx", "dy")
    return offsets.union(found).select("kind", "name", r("dx", digits=3), r("dy", digits=3))


def _star_map(spark, sf: str):
    """A star map of frame 0's science plane with the whole catalog in it, at a quarter of its size."""
    px = pix_nan(spark, sf).filter("frame = 0").select("x", "y", "v")
    st = stars(spark, sf).select(
        F.col("star").cast("int").alias("id"), (F.col("x") / 4).alias("x"), (F.col("y") / 4).alias("y"), F.lit(2.5).alias("fwhm"), (F.col("area") % 4 + 2).cast("double").alias("radius"), F.col("peak").alias("snr"), F.lit(0.1).alias("residual"),
        F.col("flux").alias("amplitude"), F.when(F.col("star") % 3 == 0, "uncertain").otherwise("accepted").alias("status"), F.lit("").alias("reason"), (F.col("star") % 5 == 0).alias("saturated"),
        F.lit(2).alias("usable"), (F.col("star") % 4).cast("int").alias("confirmed"), F.when(F.col("star") % 7 == 0, "reject").when(F.col("star") % 11 == 0, "accept").otherwise("").alias("override"),
    )
    path = f"{shared_folder(spark, 'starmap')}/a_starmap.fit"
    products.save_star_map(st, px, path, SIDE, SIDE, {"algorithm": "local", "inputs": []}, {"FILTER": "F606W"})
    return products.read_star_map(spark, path, px, SIDE, SIDE)


MAPPED = "st AS (SELECT CAST(star AS INTEGER) AS id, x / 4 AS x, y / 4 AS y, peak AS snr, CAST(area % 4 + 2 AS DOUBLE) AS radius, CASE WHEN star % 3 = 0 THEN 'uncertain' ELSE 'accepted' END AS status, star % 5 = 0 AS saturated, CAST(star % 4 AS INTEGER) AS confirmed, CASE WHEN star % 7 = 0 THEN 'reject' WHEN star % 11 = 0 THEN 'accept' ELSE '' END AS override FROM stars)"


@query("s17_star_map_catalog", f"{S}, {MAPPED} SELECT id, round(x * 4, 3) AS x, round(y * 4, 3) AS y, round(snr, 3) AS snr, radius, status, saturated, confirmed, override FROM st")
def s17(spark, sf):
    return _star_map(spark, sf)[0].select("id", r(F.col("x") * 4, "x", 3), r(F.col("y") * 4, "y", 3), r("snr", digits=3), "radius", "status", "saturated", "confirmed", "override")


@query(
    "k03_star_map_planes",
    f"""WITH {N[5:]}, {S[5:]}, {MAPPED}, d AS (SELECT *, override = 'accept' OR (override <> 'reject' AND status = 'accepted') AS take FROM st),
g AS (SELECT d.*, unnest(range(CAST(ceil(x - radius) AS BIGINT), CAST(floor(x + radius) AS BIGINT) + 1)) AS px FROM d), g2 AS (SELECT g.*, unnest(range(CAST(ceil(y - radius) AS BIGINT), CAST(floor(y + radius) AS BIGINT) + 1)) AS py FROM g),
m AS (SELECT *, sqrt((px - x) * (px - x) + (py - y) * (py - y)) / radius AS t FROM g2),
k AS (SELECT *, CASE WHEN t <= 0.65 THEN 1.0 WHEN t <= 1 THEN 0.5 + 0.5 * cos(pi() * (t - 0.65) / 0.35) ELSE 0 END AS mask, (CASE WHEN NOT take AND status = 'uncertain' THEN 2 ELSE 0 END) + (CASE WHEN saturated THEN 4 ELSE 0 END) + (CASE WHEN override <> '' THEN 16 ELSE 0 END) AS bits FROM m),
a AS (SELECT px, py, max(mask) FILTER (take) AS mask, bit_or(bits) AS bits FROM k WHERE mask > 0 GROUP BY 1, 2)
SELECT CAST(p.x AS INTEGER) AS x, CAST(p.y AS INTEGER) AS y, round(coalesce(a.mask, 0), 3) AS mask, CAST(coalesce(a.bits, 0) | (CASE WHEN isnan(p.v) THEN 1 ELSE 0 END) AS BIGINT) AS flags FROM pix_nan p LEFT JOIN a ON a.px = p.x AND a.py = p.y WHERE p.frame = 0""",
)
def k03(spark, sf):
    have = pix_nan(spark, sf).filter("frame = 0").select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    return _star_map(spark, sf)[1].join(have, ["x", "y"]).select("x", "y", r("mask", digits=3), "flags")


@query("s18_mask_round_trip", f"{P} SELECT DISTINCT CAST(x AS INTEGER) AS x, CAST(frame * 64 + y AS INTEGER) AS y FROM pix WHERE v > 45")
def s18(spark, sf):
    """Masks of all frames, one below the other, written and read."""
    mask = pix(spark, sf).filter("v > 45").select("x", (F.col("frame") * SIDE + F.col("y")).alias("y"))
    path = f"{shared_folder(spark, 'mask')}/mask.fits"
    products.save_mask(mask, path, SIDE, 8 * SIDE)
    return products.read_mask(spark, path).select("x", "y")


@query("k12_mask_refusals", "SELECT * FROM (VALUES ('existing', 'refused'), ('outside', 'refused'), ('overwritten', 'written')) t(what, outcome)")
def k12(spark, sf):
    mask = pix(spark, sf).filter("v > 45").select("x", "y").distinct()
    path = f"{shared_folder(spark, 'mask')}/mask.fits"
    products.save_mask(mask, path, SIDE, SIDE)
    return _outcomes(spark, [("existing", lambda: products.save_mask(mask, path, SIDE, SIDE)), ("outside", lambda: products.save_mask(mask, path + "2", 8, 8)), ("overwritten", lambda: products.save_mask(mask, path, SIDE, SIDE, True))])


def _outcomes(spark, cases):
    """What became of each: written, or refused by an error that says so."""
    rows = []
    for name, action in cases:
        try:
            action()
            rows.append((name, "written"))
        except (ValueError, FileExistsError):
            rows.append((name, "refused"))
    return spark.createDataFrame(rows, "what string, outcome string")


@query("s19_card_values", """SELECT n_nationkey AS k, n_name || chr(39) || 's ' || n_regionkey AS text, CAST((n_nationkey - 12) * 15 AS DOUBLE) AS number, n_regionkey % 2 = 0 AS flag FROM nation""")
def s19(spark, sf):
    folder = shared_folder(spark, "cards")
    for n in table(spark, sf, "nation").collect():  # 25 rows
        k = n["n_nationkey"]
        raw = fits.encode_plane(np.zeros((1, 1), np.float32), {"OBJECT": f"{n['n_name']}'s {n['n_regionkey']}", "FLAG": bool(n["n_regionkey"] % 2 == 0), "NUMBER": "x"}, True)
        # a number with Fortran's exponent and a comment behind a slash
        raw = raw.replace(fits.card("NUMBER", "x"), f"NUMBER  = {(k - 12) * 1.5}D1 / note / more".ljust(80).encode())
        fits.write_bytes(f"{folder}/n{k:03d}.fits", iter([raw]))
    fits.register(spark)
    cards = lambda c: F.col("cards")[c]
    got = spark.read.format("fits").option("pixels", "false").load(folder)
    number = F.regexp_replace(F.split(cards("NUMBER"), "/")[0], "D", "E").try_cast("double")
    return got.select(F.regexp_extract("file", r"n(\d+)\.fits", 1).cast("int").alias("k"), cards("OBJECT").alias("text"), number.alias("number"), (cards("FLAG") == "T").alias("flag"))


@query(
    "s20_header_listing",
    f"""{P}, {PLANES}, e AS (SELECT exposure, chip, unnest(['SCI', 'ERR']) AS name, unnest([sci, err]) AS v FROM u)
SELECT exposure, chip, name, count(*) AS samples, round(median(v), 3) AS median, round(stddev_pop(v), 2) AS spread FROM e GROUP BY 1, 2, 3""",
)
def s20(spark, sf):
    got = products.list_headers(spark, exposures(spark, sf)).filter("extname IN ('SCI', 'ERR')")
    return got.select(exposure().alias("exposure"), F.col("extver").cast("long").alias("chip"), F.col("extname").alias("name"), "samples", r("median", digits=3), r("spread", digits=2))


@query("k01_fits_writer", f"{P}, n AS (SELECT frame, count(*) AS pixels, bit_or(dq) AS every, round(sum(v), 2) AS total FROM pix GROUP BY 1) SELECT frame, pixels, every, total FROM n")
def k01(spark, sf):
    """A file a frame, written by the task that has it, and read back."""
    folder = shared_folder(spark, "frames")
    fits.write_frames(pix(spark, sf), folder, SIDE, SIDE, ("v", "dq"), ("dq",)).count()
    fits.register(spark)
    px = fits.pixels(spark.read.format("fits").load(folder))
    frame = F.regexp_extract("file", r"frame-(\d+)\.", 1).cast("long")
    v = px.filter("hdu = 0 AND NOT isnan(v)").groupBy(frame.alias("frame")).agg(F.count("*").alias("pixels"), r(F.sum(F.col("v").cast("double")), "total", 2))
    dq = px.filter("extname = 'DQ'").groupBy(frame.alias("frame")).agg(F.bit_or("exact").alias("every"))
    return v.join(dq, "frame").select("frame", "pixels", "every", "total")


@query(
    "k02_mosaic_product",
    f"""{P}, m AS (SELECT x, y, avg(v) AS v, sum(err) AS weight, count(*) AS inputs, bit_or(dq) AS dq, bit_or(1 << frame) AS ctx FROM pix GROUP BY 1, 2), e AS (SELECT unnest(['', 'WHT', 'NCONTRIB', 'CTX01', 'DQ', 'SEAM']) AS name, unnest([v, weight, inputs, ctx, dq, v - 1]) AS p FROM m)
SELECT name, count(*) AS n, round(sum(p), 0) AS total FROM e GROUP BY 1 UNION ALL SELECT 'CTXMAP', 8, CAST(sum(frame) AS DOUBLE) FROM (SELECT DISTINCT frame FROM pix)""",
)
def k02(spark, sf):
    """A mosaic with weights, counts, context, masks and seam as one file; the names of its inputs come back from CTXMAP."""
    m = pix(spark, sf).groupBy(F.col("x").alias("ox"), F.col("y").alias("oy")).agg(
        F.avg("v").alias("v"), F.sum("err").alias("weight"), F.count("*").alias("inputs"), F.bit_or("dq").alias("dq"), F.bit_or(F.expr("shiftleft(1L, cast(frame as int))")).alias("bits")
    )
    m = m.select("ox", "oy", "v", "weight", "inputs", "dq", F.create_map(F.lit(0).cast("long"), F.col("bits")).alias("planes"), (F.col("v") - 1).alias("seam"))
    path = f"{shared_folder(spark, 'mosaic')}/F606W_x_drz.fits"
    products.save_mosaic(m, path, SIDE, SIDE, {"EXPTIME": 10.0}, [f"input {k}" for k in range(8)])
    fits.register(spark)
    px = fits.pixels(spark.read.format("fits").load(path)).filter("extname <> 'CTXMAP'")
    have = pix(spark, sf).select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()
    planes = px.join(have, ["x", "y"]).groupBy(F.col("extname").alias("name")).agg(F.count("*").alias("n"), r(F.sum(F.coalesce(F.col("exact").cast("double"), F.col("v").cast("double"))), "total", 0))
    keys = products.context_keys(spark, path)
    named = spark.createDataFrame([("CTXMAP", len(keys), float(sum(int(k.split()[1]) for k in keys)))], "name string, n long, total double")
    return planes.union(named.select("name", "n", r("total", digits=0)))


@query("k04_atomic_publish", "SELECT * FROM (VALUES ('exclusive', 'refused'), ('replaced', 'written'), ('too long a card', 'refused')) t(what, outcome)")
def k04(spark, sf):
    path = f"{shared_folder(spark, 'publish')}/a.fits"
    one, two = (lambda v, **c: [("", np.full((2, 2), v, np.float32), c)]), (lambda v: [("", np.full((2, 2), v, np.float32), {"LONG": "x" * 100})])
    fits.write_file(path, one(1))
    return _outcomes(spark, [("exclusive", lambda: fits.write_file(path, one(2), overwrite=False)), ("replaced", lambda: fits.write_file(path, one(3))), ("too long a card", lambda: fits.write_file(path, two(4)))])


@query(
    "k05_raster_transactions",
    f"{P}, n AS (SELECT count(*) AS n, round(sum(v), 0) AS total FROM pix) SELECT * FROM (VALUES ('aborted', 0), ('after failure', 0), ('committed', 1)) t(what, twice) CROSS JOIN n",
)
def k05(spark, sf):
    """An aborted version leaves the old one, a failed replacement of two planes restores both, a commit replaces."""
    path, height = _paged(spark, sf)
    other, _ = _paged(spark, sf)
    rows = []

    def state(what):
        got = paged.window(spark, path, 0, 0, SIDE, height).filter("NOT isnan(v)").agg(F.count("*").alias("n"), r(F.sum(F.col("v").cast("double")), "total", 0)).first()
        rows.append((what, int(what == "committed"), got["n"], got["total"]))

    minus = paged.tiles(spark, path).withColumn("data", F.transform("data", lambda v: -v))
    t = paged.Transaction(spark, path, SIDE, height)
    t.write(minus)
    t.abort()
    state("aborted")
    good, bad = paged.Transaction(spark, path, SIDE, height), paged.Transaction(spark, other, SIDE, height)
    good.write(minus)
    try:
        paged.replace_all([good, bad])  # the second has nothing to commit
    except ValueError:
        state("after failure")
    t = paged.Transaction(spark, path, SIDE, height)
    t.write(minus.withColumn("data", F.transform("data", lambda v: -v)))
    paged.replace_all([t])
    state("committed")
    return spark.createDataFrame(rows, "what string, twice int, n long, total double")


@query("k06_plane_copy", f"{P}, u AS (SELECT x, y, v FROM pix WHERE frame = 1), b AS (SELECT min(v) AS lo, max(v) AS hi FROM u) SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(v, 2) AS v, round((v - lo) / (hi - lo), 3) AS unit FROM u CROSS JOIN b")
def k06(spark, sf):
    folder, out = exposures(spark, sf), shared_folder(spark, "copies")
    for name, unit in (("raw", False), ("unit", True)):
        paged.copy_plane(spark, f"{folder}/exp-0_flc.fits", f"{out}-{name}", "SCI", 2, unit, 20)
    one = lambda name: paged.window(spark, f"{out}-{name}", 0, 0, SIDE, SIDE).filter("NOT isnan(v)")
    return one("raw").join(one("unit").withColumnRenamed("v", "u"), ["x", "y"]).select("x", "y", r(F.col("v").cast("double"), "v", 2), r(F.col("u").cast("double"), "unit", 3))


@query("k07_png_export", f"{P} SELECT frame, x, y, CAST(floor(least(1.0, v / 110) * 255 + 0.5) AS INTEGER) AS level, CAST(floor(least(1.0, v / 110) * 65535) AS INTEGER) // 64 AS deep FROM pix")
def k07(spark, sf):
    """Every frame as an image of 8 and of 16 bits, decoded again."""
    p = pix(spark, sf).select("frame", "x", "y", (F.col("v") / 110).alias("v"))
    files = export.png_of_frames(p, SIDE, SIDE, ("v",), 8).join(export.png_of_frames(p, SIDE, SIDE, ("v",), 16).withColumnRenamed("png", "deep"), "frame")

    def run(batches):
        def decoded(png: bytes, kind: str) -> np.ndarray:
            at, body = 8, b""
            while at < len(png):
                n = int.from_bytes(png[at : at + 4], "big")
                body += png[at + 8 : at + 8 + n] if png[at + 4 : at + 8] == b"IDAT" else b""
                at += 12 + n
            raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(SIDE, -1)[:, 1:]  # a filter byte a row, 0 here
            return np.ascontiguousarray(raw).view(kind)

        for pdf in batches:
            for f in pdf.itertuples():
                y, x = np.mgrid[0:SIDE, 0:SIDE]
                yield pd.DataFrame({"frame": f.frame, "x": x.ravel(), "y": y.ravel(), "level": decoded(f.png, "u1").ravel().astype(int), "deep": decoded(f.deep, ">u2").ravel().astype(int) // 64})

    px = files.mapInPandas(run, "frame long, x long, y long, level int, deep int")
    return px.join(p.select("frame", "x", "y"), ["frame", "x", "y"]).select("frame", "x", "y", "level", "deep")


@query("k10_residual_csv", f"{S} SELECT frame, CAST(printf('%.8g', x) AS DOUBLE) AS x, CAST(printf('%.8g', x - flux / 100) AS DOUBLE) AS target_x, CAST(printf('%.8g', sqrt(flux / 100 * flux / 100 + peak / 100 * peak / 100)) AS DOUBLE) AS radial FROM stars")
def k10(spark, sf):
    st = stars(spark, sf).select("frame", "x", "y", (F.col("flux") / 100).alias("dx"), (F.col("peak") / 100).alias("dy"))
    rows = st.withColumns({"target_x": F.col("x") - F.col("dx"), "target_y": F.col("y") - F.col("dy")})
    folder = shared_folder(spark, "csv")
    export.write_csv(export.residual_table(rows), folder)
    got = spark.read.option("header", True).csv(folder)
    return got.select(F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("double").alias(c) for c in ("x", "target_x", "radial")])


@query("k10_alignment_csv", f"{S}, d AS (SELECT frame, flux / 100 AS dx, peak / 100 AS dy FROM stars) SELECT frame, count(*) AS matched, round(sqrt(avg(dx * dx)), 3) AS x_rms, round(median(sqrt(dx * dx + dy * dy)), 3) AS median_residual, CAST(frame * 1.5 AS DOUBLE) AS shift_x FROM d GROUP BY frame")
def k10_alignment(spark, sf):
    res = stars(spark, sf).select("frame", (F.col("flux") / 100).alias("dx"), (F.col("peak") / 100).alias("dy"))
    fitted = spark.range(8).select(F.col("id").alias("frame"), F.lit(5).cast("long").alias("support"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), (F.col("id") * 1.5).alias("c"), F.lit(0.0).alias("d"), F.lit(1.0).alias("e"), F.lit(0.0).alias("f"))
    folder = shared_folder(spark, "csv")
    export.write_csv(export.alignment_table(fitted, res), folder)
    got = spark.read.option("header", True).csv(folder).filter("matched > 0")
    number = lambda c: F.col(c).cast("double")
    return got.select(F.col("frame").cast("long").alias("frame"), F.col("matched").cast("long").alias("matched"), r(number("x_rms"), "x_rms", 3), r(number("median_residual"), "median_residual", 3), number("shift_x").alias("shift_x"))


@query("k11_json_sinks", "SELECT n_name AS path, CAST(n_regionkey AS INTEGER) AS sci_ext, n_nationkey % 2 = 0 AS accepted, CASE WHEN n_nationkey % 2 = 0 THEN 2e0 ELSE 1e0 END AS a FROM nation")
def k11(spark, sf):
    """Sidecar records, half of them replaced by a later save, and read back."""
    rows = table(spark, sf, "nation").collect()  # 25 rows
    path = f"{shared_folder(spark, 'sidecar')}/sidecar.json"
    record = lambda n, ok, a: {"path": n["n_name"], "sci_ext": int(n["n_regionkey"]), "accepted": ok, "a": a}
    records.write_report(records.merge_sidecar([], [record(n, False, 1.0) for n in rows]), path)
    records.write_report(records.merge_sidecar(records.read_report(path), [record(n, True, 2.0) for n in rows if n["n_nationkey"] % 2 == 0]), path)
    return records.read_sidecar(spark, path).select("path", "sci_ext", "accepted", "a")


@query(
    "k13_reduced_copies",
    f"""{P}, b AS (SELECT frame // 2 AS exposure, CAST(frame % 2 + 1 AS INTEGER) AS chip, CAST(x // 4 AS INTEGER) AS x, CAST(y // 4 AS INTEGER) AS y, avg(v) AS v, sqrt(sum(err * err)) / count(err) AS err, bit_or(dq) AS dq FROM pix GROUP BY 1, 2, 3, 4) SELECT exposure, chip, x, y, round(v, 2) AS v, round(err, 2) AS err, dq FROM b""",
)
def k13(spark, sf):
    out = shared_folder(spark, "reduced")
    products.reduce_files(spark, exposures(spark, sf), out, 4).count()
    px = inputs.input_pixels(spark, out, inputs.input_table(spark, out)).filter("NOT isnan(v)")
    return px.select(exposure().alias("exposure"), "chip", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), r("v", digits=2), r("err", digits=2), "dq")


@query(
    "f14_correction_table",
    f"""{S}, p AS (SELECT star, x / 4 AS x, y / 4 AS y FROM stars) SELECT star, round((least(x / 16, 4) * 2 + least(y / 16, 4)) / 64, 5) AS dx, round((least(x / 16, 4) * 2 + least(y / 16, 4)) / 32, 5) AS dy FROM p""",
)
def f14(spark, sf):
    """Corrections of the first chip's tables at the catalog's places."""
    folder = exposures(spark, sf)
    tx, ty = inputs.correction_tables(spark, f"{folder}/exp-0_flc.fits")[f"{folder}/exp-0_flc.fits", 1]
    shared = spark.sparkContext.broadcast((tx, ty))  # two tables of 25 numbers

    def run(batches):
        for pdf in batches:
            x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
            yield pd.DataFrame({"star": pdf["star"], "dx": shared.value[0].at(x, y), "dy": shared.value[1].at(x, y)})

    p = stars(spark, sf).select("star", (F.col("x") / 4).alias("x"), (F.col("y") / 4).alias("y"))
    return p.mapInPandas(run, "star long, dx double, dy double").select("star", r("dx", digits=5), r("dy", digits=5))


def _overlapping(spark, sf: str):
    """Six frames along the catalog of frame 0, each a window of it that overlaps only the next, shifted by a known amount."""
    st = stars(spark, sf).filter("frame = 0").select("star", "x", "y", "peak")
    wide = st.select("star", (F.col("x") * 6 + F.col("y")).alias("x"), (F.col("y") * 2 + F.col("x") % 1 * 90).alias("y"), "peak")
    k = F.col("frame")
    each = spark.range(6).withColumnRenamed("id", "frame").join(wide, F.col("x").between(k * 260, k * 260 + 440))
    return each.select("frame", "star", (F.col("x") + 4 * k).alias("x"), (F.col("y") - 3 * k).alias("y"), "peak")


@query("m04_chained_alignment", "SELECT CAST(k AS BIGINT) AS frame, CASE WHEN k = 0 THEN 'reference' WHEN k = 1 THEN 'direct' ELSE 'chain' END AS way, CAST(-4 * k AS DOUBLE) + 0.0 AS dx, CAST(3 * k AS DOUBLE) AS dy FROM (SELECT unnest(range(6)) AS k)")
def m04(spark, sf):
    """Frames that share nothing with the reference are placed through those between."""
    got = align.align_frames(_overlapping(spark, sf), 0, 600.0)
    way = F.when(F.col("method") == "reference", "reference").when(F.col("method").startswith("chain-chain-"), "chain").when(F.col("method").startswith("chain-"), "chain").otherwise("direct")
    return got.select("frame", way.alias("way"), (F.round("c", 0) + 0.0).alias("dx"), (F.round("f", 0) + 0.0).alias("dy"))


@query("m05_bundle", "SELECT CAST(k AS BIGINT) AS frame, CAST(-4 * k AS DOUBLE) + 0.0 AS dx, CAST(3 * k AS DOUBLE) AS dy FROM (SELECT unnest(range(6)) AS k)")
def m05(spark, sf):
    """Fits that are off by up to a pixel come back to where common stars agree."""
    st = _overlapping(spark, sf)
    off = spark.range(6).select(
        F.col("id").alias("frame"), F.lit("given").alias("method"), F.lit(9).cast("long").alias("support"), F.lit(0.0).alias("rms"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"),
        (-4.0 * F.col("id") + (F.col("id") % 3 - 1) * F.when(F.col("id") > 0, 0.8).otherwise(0.0)).alias("c"), F.lit(0.0).alias("d"), F.lit(1.0).alias("e"), (3.0 * F.col("id") + (F.col("id") % 2) * 0.7).alias("f"),
    )
    got = align.bundled(st, off, 0, 600.0)
    return got.select("frame", (F.round("c", 0) + 0.0).alias("dx"), (F.round("f", 0) + 0.0).alias("dy"))


@query("m07_channel_alignment", "SELECT CAST(k AS BIGINT) AS frame, CAST(-1.5 * k AS DOUBLE) + 0.0 AS dx, CAST(2 * k AS DOUBLE) AS dy FROM (SELECT unnest(range(1, 4)) AS k)")
def m07(spark, sf):
    """Three channels of frame 0's stars, shifted by known amounts, against it."""
    st = stars(spark, sf).filter("frame = 0").select("star", "x", "y", "peak")
    k = F.col("frame")
    each = spark.range(4).withColumnRenamed("id", "frame").crossJoin(st).select("frame", "star", (F.col("x") + 1.5 * k).alias("x"), (F.col("y") - 2 * k).alias("y"), "peak")
    got = align.align_channels(each, 0, 260.0)
    half = lambda c: F.round(F.col(c) * 2, 0) / 2 + 0.0
    return got.select("frame", half("c").alias("dx"), half("f").alias("dy"))


@query("p11_edge_trim", f"{P} SELECT frame, count(*) AS pixels FROM pix GROUP BY frame")
def p11(spark, sf):
    """Nothing is trimmed."""
    n = mosaic.edge_trim(SIDE, SIDE)
    inside = F.col("x").between(n, SIDE - 1 - n) & F.col("y").between(n, SIDE - 1 - n)
    return pix(spark, sf).filter(inside).groupBy("frame").agg(F.count("*").alias("pixels"))


@query("r01_bounded_rows", f"{P}, n AS (SELECT frame, y, count(*) AS n, max(v) AS top FROM pix GROUP BY 1, 2) SELECT frame, y, n, round(top, 4) AS top FROM n")
def r01(spark, sf):
    """A frame's rows one at a time to a function that keeps their greatest sample."""
    got = extend.map_rows(pix(spark, sf), lambda frame, y, row: np.where(np.isfinite(row), np.nanmax(row), np.nan), SIDE).filter("NOT isnan(v)")
    return got.groupBy("frame", "y").agg(F.count("*").alias("n"), r(F.max("v"), "top"))


@query("r04_progress", "SELECT * FROM (VALUES (0, 'count', 0, 3), (1, 'count', 1, 3), (2, 'sum', 1, 3), (3, 'sum', 2, 3)) t(event, stage, done, total)")
def r04(spark, sf):
    """Three steps, stopped behind the second."""
    said: list[tuple] = []
    steps = [("count", lambda: pix(spark, sf).count()), ("sum", lambda: pix(spark, sf).agg(F.sum("v")).first()[0]), ("never", lambda: 1 / 0)]
    jobs.run_steps(steps, lambda stage, done, total: said.append((len(said), stage, done, total)), lambda: len(said) >= 4)
    return spark.createDataFrame(said, "event int, stage string, done int, total int")


@query("x01_frame_loader", "SELECT CAST(n_nationkey AS BIGINT) AS frame, CAST(40 * (8 + n_regionkey) AS BIGINT) AS pixels, CAST(sum(1) AS BIGINT) AS frames FROM nation GROUP BY 1, 2")
def x01(spark, sf):
    """Frames of a loader of one's own, by strips of eight rows."""
    frames = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("frame"), F.lit(40).alias("width"), (F.col("n_regionkey") + 8).cast("int").alias("height"))
    px = extend.load_frames(frames, lambda frame, y0, n: np.full((n, 40), float(frame)), 8)
    return px.filter("v = frame").groupBy("frame").agg(F.countDistinct("x", "y").alias("pixels"), F.countDistinct("frame").alias("frames"))


@query("x03_treatment", f"{P} SELECT frame, x, y, round(v * 0.5 + x * 0.01 - y * 0.02, 4) AS v FROM pix")
def x03(spark, sf):
    return extend.treat(pix(spark, sf).select("frame", "x", "y", "v"), lambda v, x, y: v * 0.5 + x * 0.01 - y * 0.02).select("frame", "x", "y", r("v"))


class _Shifted:
    """A mapper of one's own: the sky is the plane, moved."""

    def __init__(self, dx: float, dy: float):
        self.dx, self.dy = dx, dy

    def sky(self, x, y):
        return x + self.dx, y + self.dy

    def pixel(self, ra, dec):
        return ra - self.dx, dec - self.dy


@query("x04_pixel_mapper", f"{S} SELECT star, round(x + 3 * frame - 1, 4) AS cx, round(y - 2 * frame, 4) AS cy FROM stars")
def x04(spark, sf):
    from lumenweave.functions.wcs import map_pixels

    maps = {k: _Shifted(3.0 * k, -2.0 * k) for k in range(8)}
    return map_pixels(stars(spark, sf).select("star", "frame", "x", "y"), maps, _Shifted(1.0, 0.0)).select("star", r("cx"), r("cy"))


@query("x05_row_function", f"{P} SELECT frame, x, y, round(v - avg(v) OVER (PARTITION BY frame, y), 3) AS v FROM pix")
def x05(spark, sf):
    got = extend.map_rows(pix(spark, sf), lambda frame, y, row: row - np.nanmean(row), SIDE)
    return got.filter("NOT isnan(v)").select("frame", "x", "y", r("v", digits=3))


@query("x06_queue", "SELECT n_nationkey AS job_id, CASE WHEN n_regionkey = 2 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN n_regionkey = 2 THEN 'no region' ELSE n_name END AS result FROM nation")
def x06(spark, sf):
    """Jobs one after the other; those that fail don't stop the rest."""

    def execute(job):
        if job["n_regionkey"] == 2:
            raise ValueError("no region")
        return job["n_name"]

    got = jobs.run_queue(table(spark, sf, "nation").withColumnRenamed("n_nationkey", "job_id"), execute)
    return spark.createDataFrame(got, "job_id int, status string, result string")


@query(
    "x09_label_rules",
    """WITH c AS (SELECT p_partkey AS id, p_partkey * 7 % 130 AS x, p_size * 3 AS y, ['star', 'not', 'ambiguous', 'comet'][p_partkey % 4 + 1] AS kind FROM part)
SELECT id, CASE WHEN kind = 'comet' THEN 'kind' ELSE 'region' END AS reason FROM c WHERE kind = 'comet' OR x >= 120 OR y >= 90""",
)
def x09(spark, sf):
    """Labels outside a project's regions, or of no known kind."""
    regions = spark.createDataFrame(records.default_regions(120, 90))
    kinds = F.array(*[F.lit(k) for k in ("star", "not", "ambiguous", "comet")])
    labels = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7 % 130).alias("x"), (F.col("p_size") * 3).alias("y"), F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int")).alias("kind"))
    return records.invalid_labels(labels, regions).select("id", "reason")
