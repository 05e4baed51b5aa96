"""Places for a user's own code: frame loaders, treatments of samples, pixel mappers and row functions, each in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIXELS = "frame long, x long, y long, v double"


class PixelMapper(Protocol):
    """What ``functions.wcs.map_pixels`` needs of a mapper: pixel to sky, and back, on arrays."""

    def sky(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...

    def pixel(self, ra: np.ndarray, dec: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


def load_frames(frames: DataFrame, loader: Callable[[int, int, int], np.ndarray], rows: int = 256) -> DataFrame:
    """Pixels (PIXELS) of ``frames`` (frame, width, height) from ``loader(frame, first row, rows)``: strips are dealt out, and a task holds one."""
    strips = frames.select("frame", "width", "height", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(rows))).alias("y0"))
    dealt = strips.repartition("frame", "y0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf.itertuples():
                n = min(rows, s.height - s.y0)
                g = np.asarray(loader(int(s.frame), int(s.y0), int(n)), dtype=float)
                if g.shape != (n, s.width):
                    raise ValueError(f"frame {s.frame}: {g.shape} samples where {(n, s.width)} were asked for")
                y, x = np.mgrid[s.y0 : s.y0 + n, 0 : s.width]
                yield pd.DataFrame({"frame": s.frame, "x": x.ravel(), "y": y.ravel(), "v": g.ravel()})

    return dealt.mapInPandas(run, PIXELS)


def treat(df: DataFrame, treatment: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], column: str = "v") -> DataFrame:
    """``column`` replaced by ``treatment(v, x, y)`` of arrays; other columns stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{column: np.asarray(treatment(pdf[column].to_numpy(float), pdf["x"].to_numpy(), pdf["y"].to_numpy()), dtype=float)})

    schema = ", ".join(f"`{n}` {'double' if n == column else t}" for n, t in df.dtypes)
    return df.mapInPandas(run, schema)


def map_rows(df: DataFrame, function: Callable[[int, int, np.ndarray], np.ndarray], width: int) -> DataFrame:
    """Rows of pixels (frame, x, y, v) through ``function(frame, y, values)``, which returns as many; missing ones are NaN. A task holds a row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = np.full(width, np.nan)
        row[pdf["x"]] = pdf["v"]
        frame, y = int(pdf["frame"].iloc[0]), int(pdf["y"].iloc[0])
        out = np.asarray(function(frame, y, row), dtype=float)
        if out.shape != (width,):
            raise ValueError(f"a row of {width} samples became {out.shape}")
        return pd.DataFrame({"frame": frame, "x": np.arange(width), "y": y, "v": out})

    got = df.select("frame", "x", "y", "v").groupBy("frame", "y").applyInPandas(run, PIXELS)
    return got.withColumn("v", F.coalesce("v", F.lit(float("nan"))))  # pandas' NaN comes back as null
