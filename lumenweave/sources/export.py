"""Image export: PNG and TIFF of 8 or 16 bits by zlib, and small tables as CSV or JSON with Spark's own committers."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(image: np.ndarray, bits: int = 8) -> bytes:
    """A PNG of a height x width (grey) or height x width x 3 or 4 array of 0..1 samples; what isn't finite is 0."""
    channels = 1 if image.ndim == 2 else image.shape[2]
    colour = {1: 0, 3: 2, 4: 6}[channels]
    unit = np.clip(np.nan_to_num(image.astype(float), nan=0.0, posinf=0.0, neginf=0.0), 0, 1)
    data = (unit * 255 + 0.5).astype(">u1") if bits == 8 else (unit * 65535).astype(">u2")
    height, width = image.shape[:2]
    rows = data.reshape(height, -1)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    head = struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def encode_tiff(image: np.ndarray, bits: int = 8, rows_a_strip: int = 64) -> bytes:
    """A little-endian TIFF of deflated strips, of the same arrays as ``encode_png``."""
    channels = 1 if image.ndim == 2 else image.shape[2]
    height, width = image.shape[:2]
    unit = np.clip(np.nan_to_num(image.astype(float), nan=0.0, posinf=0.0, neginf=0.0), 0, 1)
    data = (unit * 255 + 0.5).astype("<u1") if bits == 8 else (unit * 65535).astype("<u2")
    strips = [zlib.compress(data[k : k + rows_a_strip].tobytes(), 6) for k in range(0, height, rows_a_strip)]
    body, places = b"", []
    for x in strips:
        places.append(8 + len(body))
        body += x + b"\0" * (len(x) % 2)
    extra = b""  # values that don't fit in an entry
    at = 8 + len(body)

    def entry(tag: int, kind: int, values: list[int]) -> bytes:
        nonlocal extra
        raw = struct.pack(f"<{len(values)}{'HI'[kind == 4]}", *values)
        if len(raw) > 4:
            place = at + len(extra)
            extra += raw + b"\0" * (len(raw) % 2)
            raw = struct.pack("<I", place)
        return struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")

    # fixed values of the format: width, height, bits, deflate, grey or colour, places, samples, rows and bytes of strips, alpha
    tags = [entry(256, 4, [width]), entry(257, 4, [height]), entry(258, 3, [bits] * channels), entry(259, 3, [8]), entry(262, 3, [1 if channels == 1 else 2]), entry(273, 4, places)]
    tags += [entry(277, 3, [channels]), entry(278, 4, [rows_a_strip]), entry(279, 4, [len(x) for x in strips])] + ([entry(338, 3, [2])] if channels == 4 else [])
    directory = struct.pack("<H", len(tags)) + b"".join(tags) + b"\0\0\0\0"
    return struct.pack("<2sHI", b"II", 42, at + len(extra)) + body + extra + directory


def alignment_table(fits: DataFrame, residuals: DataFrame) -> DataFrame:
    """A row an image for CSV: what was matched, residuals (frame, dx, dy) summed up, the shift and the affine; numbers as six figures."""
    from lumenweave.operators.stats import residual_summary

    s = residual_summary(residuals, ["frame"])
    six = lambda c, name: F.format_string("%.6g", F.col(c)).alias(name)
    j = fits.join(s, "frame", "left").withColumn("aligned", F.col("support").isNotNull())
    share = F.format_string("%.4g", 100 * F.coalesce("inliers", F.lit(0.0)))
    numbers = [six(a, b) for a, b in (("rms_x", "x_rms"), ("rms_y", "y_rms"), ("rms", "radial_rms"), ("median", "median_residual"), ("largest", "max_residual"))]
    return j.select(
        "frame", "aligned", F.coalesce("pairs", F.lit(0)).alias("matched"), *numbers, share.alias("inlier_percent"), F.col("support").alias("final_support"),
        six("c", "shift_x"), six("f", "shift_y"), *[six(c, f"affine_{c}") for c in "abcdef"],
    )


def residual_table(residuals: DataFrame) -> DataFrame:
    """A row a matched star for CSV (frame, x, y, target_x, target_y, dx, dy, radial), eight figures each."""
    radial = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    rows = residuals.withColumn("radial", radial)
    return rows.select("frame", *[F.format_string("%.8g", F.col(c)).alias(c) for c in ("x", "y", "target_x", "target_y", "dx", "dy", "radial")])


def png_of_frames(df: DataFrame, width: int, height: int, channels: tuple[str, ...] = ("r", "g", "b"), bits: int = 8) -> DataFrame:
    """(frame, png) of pixel rows frame, x, y and channels of 0..1; a frame's size is stated, so a group's is bounded."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((height, width, len(channels)))
        for k, c in enumerate(channels):
            g[pdf["y"], pdf["x"], k] = pdf[c]
        return pd.DataFrame({"frame": [int(pdf["frame"].iloc[0])], "png": [encode_png(g if len(channels) > 1 else g[:, :, 0], bits)]})

    return df.select("frame", "x", "y", *channels).groupBy("frame").applyInPandas(run, "frame long, png binary")


def write_csv(df: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A table as CSV with a header; refuses an existing folder unless told otherwise."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(folder)


def write_json(df: DataFrame, folder: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(folder)
