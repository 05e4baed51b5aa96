"""Pixel mappers that expressions alone don't give: detector tables, distortion and sky in one pass, and model trees."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def bilinear_table(table: np.ndarray, x: np.ndarray, y: np.ndarray, step: float = 1.0) -> np.ndarray:
    """Values of a table at (x, y) / step, by bilinear interpolation, its edge held beyond."""
    h, w = table.shape
    u, v = np.clip(x / step, 0, w - 1), np.clip(y / step, 0, h - 1)
    i, j = np.minimum(u.astype(int), max(w - 2, 0)), np.minimum(v.astype(int), max(h - 2, 0))
    a, b = u - i, v - j
    i1, j1 = np.minimum(i + 1, w - 1), np.minimum(j + 1, h - 1)
    return table[j, i] * (1 - a) * (1 - b) + table[j, i1] * a * (1 - b) + table[j1, i] * (1 - a) * b + table[j1, i1] * a * b


@dataclass
class Correction:
    """A detector's correction table: samples on a grid that CRPIX, CRVAL and CDELT place on the image."""

    table: np.ndarray
    crpix: tuple[float, float] = (1.0, 1.0)
    crval: tuple[float, float] = (1.0, 1.0)
    cdelt: tuple[float, float] = (1.0, 1.0)

    @classmethod
    def of(cls, table: np.ndarray, cards: dict[str, str]) -> Correction:
        """A table from a plane and its cards; missing or unusable placement, and samples that aren't finite, are errors."""
        from lumenweave.sources.fits import card_number

        numbers = [card_number(cards.get(f"{k}{i}")) for k in ("CRPIX", "CRVAL", "CDELT") for i in (1, 2)]
        if any(n is None or not math.isfinite(n) for n in numbers) or min(abs(numbers[4]), abs(numbers[5])) < 1e-15:
            raise ValueError("a correction table without its place")
        if table.ndim != 2 or not table.size or not np.isfinite(table).all():
            raise ValueError("a correction table with missing samples")
        return cls(np.asarray(table, dtype=float), *(tuple(numbers[k : k + 2]) for k in (0, 2, 4)))

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The correction of image pixels (from 0), by bilinear interpolation; beyond the table its edge is held."""
        u = (x + 1 - self.crval[0]) / self.cdelt[0] + self.crpix[0] - 1
        v = (y + 1 - self.crval[1]) / self.cdelt[1] + self.crpix[1] - 1
        return bilinear_table(self.table, u, v)


def correction(t, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of a placed table, a bare one (a sample a pixel), or none."""
    return np.zeros_like(x) if t is None else t.at(x, y) if isinstance(t, Correction) else bilinear_table(t, x, y)


@dataclass
class Mapper:
    """Source pixel -> detector correction -> distortion -> sky -> reference pixel; ``sky`` alone stops before the last."""

    crpix: tuple[float, float]
    crval: tuple[float, float]
    cd: tuple[float, float, float, float]
    sip_a: dict[tuple[int, int], float] = field(default_factory=dict)
    sip_b: dict[tuple[int, int], float] = field(default_factory=dict)
    d2im: tuple[Correction | np.ndarray | None, Correction | np.ndarray | None] | None = None

    def _poly(self, terms, u, v):
        return sum((c * u**p * v**q for (p, q), c in terms.items()), np.zeros_like(u))

    def sky(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.d2im is not None:
            x, y = x + correction(self.d2im[0], x, y), y + correction(self.d2im[1], x, y)
        u, v = x - self.crpix[0], y - self.crpix[1]
        u, v = u + self._poly(self.sip_a, u, v), v + self._poly(self.sip_b, u, v)
        xi, eta = np.radians(self.cd[0] * u + self.cd[1] * v), np.radians(self.cd[2] * u + self.cd[3] * v)
        a0, d0 = map(math.radians, self.crval)
        den = math.cos(d0) - eta * math.sin(d0)
        ra = np.degrees(a0 + np.arctan2(xi, den)) % 360
        return ra, np.degrees(np.arctan2(math.sin(d0) + eta * math.cos(d0), np.hypot(xi, den)))

    def pixel(self, ra: np.ndarray, dec: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """The pixel of a place in the sky: gnomonic, then the distortion undone by fixed-point steps."""
        a0, d0 = map(math.radians, self.crval)
        da, d = np.radians(ra) - a0, np.radians(dec)
        den = math.sin(d0) * np.sin(d) + math.cos(d0) * np.cos(d) * np.cos(da)
        xi, eta = np.degrees(np.cos(d) * np.sin(da) / den), np.degrees((math.cos(d0) * np.sin(d) - math.sin(d0) * np.cos(d) * np.cos(da)) / den)
        det = self.cd[0] * self.cd[3] - self.cd[1] * self.cd[2]
        fu, fv = (self.cd[3] * xi - self.cd[1] * eta) / det, (self.cd[0] * eta - self.cd[2] * xi) / det
        u, v = fu.copy(), fv.copy()
        for _ in range(rounds if self.sip_a or self.sip_b else 0):
            u, v = fu - self._poly(self.sip_a, u, v), fv - self._poly(self.sip_b, u, v)
        x, y = u + self.crpix[0], v + self.crpix[1]
        if self.d2im is not None:
            x0, y0 = x.copy(), y.copy()
            for _ in range(rounds):
                x, y = x0 - correction(self.d2im[0], x, y), y0 - correction(self.d2im[1], x, y)
        return x, y


def map_pixels(df: DataFrame, mappers: dict[int, Mapper], reference: Mapper, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with cx and cy, its pixels' places in the reference grid, null for a frame without a mapper. Mappers are a row a frame, and are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast((mappers, reference))

    def run(batches):
        own, ref = shared.value
        for pdf in batches:
            cx, cy = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            for frame, at in pdf.groupby("frame").indices.items():
                if int(frame) in own:
                    ra, dec = own[int(frame)].sky(pdf[x].to_numpy(float)[at], pdf[y].to_numpy(float)[at])
                    cx[at], cy[at] = ref.pixel(ra, dec)
            yield pdf.assign(cx=cx, cy=cy)

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("cx", T.DoubleType()), T.StructField("cy", T.DoubleType())])
    return df.mapInPandas(run, schema)


# --- model trees ----------------------------------------------------------------------------------


def compile_model(node: dict):
    """A function from a tuple of arrays to a tuple of arrays, of a tree of named models; an unknown one is an error.

    compose: right to left; concatenate: side by side; remap: choose and repeat inputs.
    """
    kind = node["model"]
    if kind == "compose":
        steps = [compile_model(n) for n in node["of"]]

        def run(v):
            for s in steps:
                v = s(v)
            return v

        return run
    if kind == "concatenate":
        parts = [(compile_model(n), n.get("inputs", 1)) for n in node["of"]]

        def side(v):
            out, at = (), 0
            for f, n in parts:
                out += f(v[at : at + n])
                at += n
            return out

        return side
    if kind == "identity":
        return lambda v: v
    if kind == "remap":
        return lambda v: tuple(v[k] for k in node["mapping"])
    if kind == "shift":
        return lambda v: (v[0] + node["offset"],)
    if kind == "scale":
        return lambda v: (v[0] * node["factor"],)
    if kind == "polynomial":
        terms = [(tuple(p), c) for p, c in node["terms"]]
        return lambda v: (sum(c * math.prod(x**n for x, n in zip(v, p)) for p, c in terms) + 0 * v[0],)
    if kind == "affine":
        m, t = np.array(node["matrix"]), node.get("translation", [0, 0])
        return lambda v: tuple(m[k, 0] * v[0] + m[k, 1] * v[1] + t[k] for k in (0, 1))
    if kind == "spherical_to_cartesian":
        return lambda v: (np.cos(np.radians(v[1])) * np.cos(np.radians(v[0])), np.cos(np.radians(v[1])) * np.sin(np.radians(v[0])), np.sin(np.radians(v[1])))
    if kind == "cartesian_to_spherical":
        return lambda v: (np.degrees(np.arctan2(v[1], v[0])) % 360, np.degrees(np.arctan2(v[2], np.hypot(v[0], v[1]))))
    if kind == "rotate3d":
        m = np.eye(3)
        for axis, degrees in zip(node["axes"], node["angles"]):
            c, s, k = math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), "xyz".index(axis)
            i, j = (k + 1) % 3, (k + 2) % 3
            r = np.eye(3)
            r[i, i] = r[j, j] = c
            r[i, j], r[j, i] = -s, s
            m = r @ m
        return lambda v: tuple(m[k, 0] * v[0] + m[k, 1] * v[1] + m[k, 2] * v[2] for k in range(3))
    raise ValueError(f"unknown model {kind!r}")


def evaluate_model(df: DataFrame, tree: dict, inputs: list[str], outputs: list[str]) -> DataFrame:
    """``df`` with a model tree's outputs as double columns."""
    from pyspark.sql import types as T

    compile_model(tree)  # an error belongs on the driver

    def run(batches):
        f = compile_model(tree)
        for pdf in batches:
            got = f(tuple(pdf[c].to_numpy(float) for c in inputs))
            yield pd.concat([pdf, pd.DataFrame(dict(zip(outputs, got)), index=pdf.index)], axis=1)

    return df.mapInPandas(run, T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in outputs)]))
