import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.sources import export, fits


@pytest.fixture
def folder(tmp_path):
    sci = np.arange(7 * 5, dtype=np.float32).reshape(5, 7)
    sci[2, 3] = np.nan
    dq = np.zeros((5, 7), dtype=np.int32)
    dq[1, 1], dq[4, 6] = 1 << 20, 5
    fits.write_file(str(tmp_path / "a_flc.fits"), [("", np.zeros((1, 1), np.float32), {"TELESCOP": "O'Hara", "EXPTIME": 12.5}), ("SCI", sci, {"EXTVER": 1}), ("DQ", dq, {})])
    fits.write_file(str(tmp_path / "b_starmap.fits"), [("", sci, {})])
    (tmp_path / "notes.txt").write_text("x")
    with open(tmp_path / "c.fits", "wb") as f:  # a truncated tail: the first unit stays
        whole = fits.encode_plane(sci, {}, True)
        f.write(whole + fits.encode_plane(sci, {}, False, "SCI")[:-2880])
    return tmp_path, sci, dq


def test_fits_round_trip(spark, folder):
    path, sci, dq = folder
    fits.register(spark)
    df = spark.read.format("fits").option("tileSize", "3").load(str(path))
    assert {r.file.rsplit("/", 1)[1] for r in df.select("file").distinct().collect()} == {"a_flc.fits", "c.fits"}
    got = np.full(sci.shape, -1.0)
    for r in fits.pixels(df.filter("extname = 'SCI'")).collect():
        got[r.y, r.x] = r.v
    assert np.array_equal(got, sci, equal_nan=True)
    bits = {(r.x, r.y): r.exact for r in fits.pixels(df.filter("extname = 'DQ'")).filter("exact <> 0").collect()}
    assert bits == {(1, 1): 1 << 20, (6, 4): 5}
    cards = df.filter("hdu = 0 AND file LIKE '%a_flc%'").first().cards
    assert cards["TELESCOP"] == "O'Hara" and fits.card_number(cards["EXPTIME"]) == 12.5


def test_fits_headers_only(spark, folder):
    fits.register(spark)
    df = spark.read.format("fits").option("pixels", "false").load(str(folder[0]))
    assert df.filter("data IS NOT NULL").count() == 0
    assert [(r.extname, r.width, r.height) for r in df.filter("file LIKE '%a_flc%'").orderBy("hdu").collect()] == [("", 1, 1), ("SCI", 7, 5), ("DQ", 7, 5)]


def test_scaled_integers_and_blank():
    v, exact = fits.decode(np.array([1, -5, 7], dtype=">i2").tobytes(), {"BITPIX": "16", "BSCALE": "2.0", "BZERO": "10", "BLANK": "-5"}, True)
    assert v[0] == 12 and np.isnan(v[1]) and v[2] == 24 and exact is None
    _, exact = fits.decode(np.array([-(2**31), 0], dtype=">i4").tobytes(), {"BITPIX": "32", "BZERO": "2147483648"}, True)
    assert exact.tolist() == [0, 2147483648]


@pytest.mark.parametrize("raw,value", [(" 'it''s   ' / note", "it's"), (" 1.5D2 / s", "1.5D2"), ("'' / none", ""), (" T", "T")])
def test_card_values(raw, value):
    assert fits.card_value(raw) == value


def test_numbers():
    assert fits.card_number("1.5D2 / s") == 150 and fits.card_number("x") is None and fits.card_number(None) is None


def test_exclusive_write_keeps_the_old_file(tmp_path):
    p = str(tmp_path / "x.fits")
    fits.write_file(p, [("", np.ones((2, 2), np.float32), {})])
    before = open(p, "rb").read()
    with pytest.raises(FileExistsError):
        fits.write_file(p, [("", np.zeros((2, 2), np.float32), {})], overwrite=False)
    with pytest.raises(ValueError):
        fits.write_file(p, [("", np.zeros((2, 2), np.float32), {"LONG": "x" * 100})])
    assert open(p, "rb").read() == before and len(list(tmp_path.iterdir())) == 1


def test_frames_to_files_and_back(spark, tmp_path):
    px = spark.range(60).select((F.col("id") % 3).alias("frame"), (F.col("id") % 5).alias("x"), (F.col("id") % 4).alias("y"), F.col("id").cast("float").alias("v")).dropDuplicates(["frame", "x", "y"])
    out = fits.write_frames(px, str(tmp_path / "o"), 5, 4).collect()
    assert len(out) == 3
    fits.register(spark)
    back = fits.pixels(spark.read.format("fits").load(str(tmp_path / "o"))).filter(~F.isnan("v"))
    assert sorted(r.v for r in back.collect()) == sorted(r.v for r in px.collect())


def test_png(spark):
    image = np.linspace(0, 1, 12).reshape(3, 4)
    png = export.encode_png(image)
    at = png.index(b"IDAT")
    n = struct.unpack(">I", png[at - 4 : at])[0]
    raw = zlib.decompress(png[at + 4 : at + 4 + n])
    rows = [raw[k * 5 + 1 : k * 5 + 5] for k in range(3)]
    assert b"".join(rows) == bytes((image * 255 + 0.5).astype(np.uint8).ravel())
    px = spark.createDataFrame([(0, 0, 0, 1.0, 0.5, float("nan"))], "frame long, x long, y long, r double, g double, b double")
    assert export.png_of_frames(px, 2, 2).first().png[:4] == b"\x89PNG"
