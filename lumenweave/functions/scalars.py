"""Column builders: finite tests, stretches, transfer functions, levels, colour, units, names, dates, affine maps.

All are built-in expressions, so they stay in generated code and reach the scan's column pruning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clamp01(c: Column) -> Column:
    """To 0..1; anything that isn't finite is 0."""
    return F.when(finite(c), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).otherwise(F.lit(0.0))


def to_byte(c: Column, rounded: bool = False) -> Column:
    """0..1 to 0..255, cut or rounded half up."""
    return F.floor(clamp01(c) * 255 + (0.5 if rounded else 0.0)).cast("int")


def to_uint16(c: Column) -> Column:
    return F.floor(clamp01(c) * 65535).cast("int")


# --- stretches ------------------------------------------------------------------------------------

#: The persisted names of the modes.
MODES = ("Linear", "Log", "Sqrt", "Asinh", "HistEq", "MTF", "GHS")


def mode_name(c: Column) -> Column:
    """A mode's persisted name from any case, or Linear."""
    out = F.lit(MODES[0])
    for m in MODES[1:]:
        out = F.when(F.lower(F.trim(c)) == m.lower(), m).otherwise(out)
    return out


def raw_stretch(c: Column, mode: str) -> Column:
    """The plain forms on 0..1 input; a square root of a negative value stays NaN."""
    if mode == "Log":
        return F.log1p(9 * c) / math.log1p(9)
    if mode == "Asinh":
        return F.asinh(10 * c) / math.asinh(10)
    if mode == "Sqrt":
        return F.when(c < 0, F.lit(float("nan"))).otherwise(F.sqrt(c))
    return c


@dataclass(frozen=True)
class Stretch:
    """Parameters of a levelled stretch; unset or impossible ones take their defaults."""

    mode: str = "Linear"
    background: float = 0.0
    peak: float = 1.0
    scaled: float = 100.0
    beta: float = 1.0
    midtone: float = 0.25
    d: float = 1.0
    b: float = 0.0
    symmetry: float = 0.1
    shadows: float = 0.0
    highlights: float = 1.0

    def sane(self) -> Stretch:
        from dataclasses import replace

        return replace(
            self,
            scaled=self.scaled if self.scaled > 0 else 100.0,
            peak=self.peak if self.peak > self.background else self.background + 1,
            beta=self.beta if self.beta > 0 else 1.0,
            midtone=self.midtone if 0 < self.midtone < 1 else 0.25,
        )


def midtones(x: Column, m: float) -> Column:
    """The midtones transfer, 0 and 1 fixed, m to one half."""
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x == m, 0.5).otherwise((m - 1) * x / ((2 * m - 1) * x - m))


def hyperbolic(x: Column, p: Stretch) -> Column:
    """The generalised hyperbolic transfer, scaled to 0..1: steepest at the symmetry point, straight beyond the protected ends.

    With u the distance from the symmetry point, its rise is 1 - exp(-d u) for b = 0, 1 - (1 + d b u) ** (-1 / b) for b above 0,
    and for b below 0, with B = -b, ((1 + d B u) ** ((B - 1) / B) - 1) / (B - 1); the fall on the other side is its mirror.
    """
    d, b, sp, lp, hp = p.d, p.b, p.symmetry, p.shadows, p.highlights
    if d <= 0 or hp <= lp:
        return clamp01(x)
    large = -b if abs(-b - 1) >= 1e-6 else 1 + 1e-6  # B = 1 is a removable gap

    def rise(u, exp, power):
        if b == 0:
            return 1 - exp(-d * u)
        return 1 - power(1 + d * b * u, -1 / b) if b > 0 else (power(1 + d * large * u, (large - 1) / large) - 1) / (large - 1)

    def slope(u: float) -> float:
        if b == 0:
            return d * math.exp(-d * u)
        return d * (1 + d * b * u) ** (-(1 + b) / b) if b > 0 else d * (1 + d * large * u) ** (-1 / large)

    value = lambda t: math.copysign(rise(abs(t - sp), math.exp, pow), t - sp)
    low, low_slope = value(lp), slope(abs(lp - sp))
    high, high_slope = value(hp), slope(abs(hp - sp))
    start, end = low - lp * low_slope, high + (1 - hp) * high_slope  # at 0 and at 1
    q = 1 / (end - start)
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    far = F.abs(unit - sp)
    up = rise(far, F.exp, lambda base, e: F.pow(base, F.lit(float(e))))
    out = (
        F.when(unit < lp, low_slope * unit + start)
        .when(unit < sp, -up)
        .when(unit < hp, up)
        .otherwise(high + (unit - hp) * high_slope)
    )
    return clamp01((out - start) * q)


def stretch(v: Column, params: Stretch) -> Column:
    """The levelled stretch of a sample, unclipped: x = max(0, (v - background) * scaled / (peak - background)), then the mode."""
    p = params.sane()
    x = F.greatest(F.lit(0.0), (v - p.background) * (p.scaled / (p.peak - p.background)))
    unit = x / p.scaled
    if p.mode == "Log":
        return F.log1p(x) / math.log1p(p.scaled)
    if p.mode == "Asinh":
        return F.asinh(x / p.beta) / math.asinh(p.scaled / p.beta)
    if p.mode == "Sqrt":
        return F.sqrt(x) / math.sqrt(p.scaled)
    if p.mode == "MTF":
        return midtones(unit, p.midtone)
    if p.mode == "GHS":
        return hyperbolic(unit, p)
    return unit


def clip_class(v: Column, out: Column, black: float, white: float) -> Column:
    """0 fine, 1 below black, 2 above white or overflowing, 3 not finite: the first that holds of 3, 1, 2."""
    return F.when(~finite(v), 3).when(v < black, 1).when((v > white) | (out > 1), 2).otherwise(0)


def rgb_level(v: Column, low: float, high: float) -> Column:
    """A channel between limits of 0..255, to 0..1."""
    return F.lit(0.0) if high <= low else clamp01((v * 255 - low) / (high - low))


def screen(base: Column, layer: Column, opacity: float, tint: float, k: float = 1.0) -> Column:
    """base + layer - k * base * layer, the layer being its clamped value by opacity and tint."""
    y = clamp01(layer) * opacity * tint
    return clamp01(base + y - k * base * y)


def luma709(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def luma601(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def inject_luminance(r: Column, g: Column, b: Column, lum: Column, weight: float) -> list[Column]:
    """Scale a colour so that its luma moves towards ``lum``."""
    base = F.greatest(luma709(r, g, b), F.lit(1e-6))
    factor = 1 + weight * (lum / base - 1)
    return [clamp01(c * factor) for c in (r, g, b)]


# --- units, names, dates --------------------------------------------------------------------------


def unit_class(bunit: Column) -> Column:
    """rate, calibrated, counts or unknown, from a unit's spelling."""
    u = F.upper(F.regexp_replace(F.trim(bunit), " ", ""))
    rate = u.contains("/S") | u.contains("S-1")
    calibrated = u.contains("JY") | u.contains("ERG") | u.contains("MAG")
    counts = u.isin("ELECTRONS", "ELECTRON", "COUNTS", "COUNT", "DN", "ADU", "E-")
    return F.when(u == "", "unknown").when(calibrated, "calibrated").when(rate, "rate").when(counts, "counts").otherwise("unknown")


def exposure_label(seconds: Column) -> Column:
    """1230.0 -> 1230s; none or not positive -> Unknown."""
    whole = F.when(seconds == F.floor(seconds), F.floor(seconds).cast("string")).otherwise(seconds.cast("string"))
    return F.when(seconds > 0, F.concat(whole, F.lit("s"))).otherwise("Unknown")


def exposure_seconds(label: Column) -> Column:
    """The number of a label, null where it is none."""
    return F.regexp_extract(label, r"^(\d+(?:\.\d+)?)s$", 1).try_cast("double")


def observation_date(c: Column) -> Column:
    """The date part, strictly yyyy-MM-dd, or ''."""
    day = F.substring_index(F.trim(c), "T", 1)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & day.try_cast("date").isNotNull(), day).otherwise("")


def product_type(path: Column) -> Column:
    """flc, flt, cal, gemini or '' from a file name; the first that matches."""
    name = F.lower(F.substring_index(path, "/", -1))
    return (
        F.when(name.contains("_flc"), "flc")
        .when(name.contains("_flt"), "flt")
        .when(name.contains("_cal"), "cal")
        .when(name.rlike(r"(^|[0-9])[ns]20\d\d"), "gemini")
        .otherwise("")
    )


def _usable_filter(c: Column) -> Column:
    u = F.upper(F.trim(c))
    return c.isNotNull() & (u != "") & ~u.startswith("CLEAR") & ~u.isin("OPEN", "NONE", "N/A", "UNKNOWN") & ~u.rlike(r"^\d+$")


def filter_name(pupil: Column, *names: Column) -> Column:
    """A pupil that is itself a filter wins, else the first name that isn't blank, clear, open, none or a number."""
    own = F.when(F.upper(F.trim(pupil)).rlike(r"^F\d"), F.upper(F.trim(pupil)))
    return F.coalesce(own, *[F.when(_usable_filter(c), F.upper(F.trim(c))) for c in names], F.lit("Unknown"))


def bandpass_nm(name: Column, instrument: Column, photplam: Column) -> Column:
    """Wavelength in nm: the header's pivot in Angstrom first, else the filter's number by the instrument's scale; null if long-pass."""
    number = F.regexp_extract(F.upper(name), r"^F(\d{3,4})(W2|W|M|N|LP|X)$", 1).try_cast("double")
    kind = F.regexp_extract(F.upper(name), r"^F(\d{3,4})(W2|W|M|N|LP|X)$", 2)
    infrared = F.upper(instrument).isin("NIRCAM", "NIRISS", "MIRI") | (F.upper(instrument).startswith("WFC3") & (number < 200))
    return F.when(photplam > 0, photplam / 10).when(kind == "LP", None).when(infrared, number * 10).otherwise(number)


def section(c: Column) -> list[Column]:
    """x1, x2, y1, y2 of '[x1:x2,y1:y2]', null where it isn't one."""
    pattern = r"^\[(\d+):(\d+),(\d+):(\d+)\]$"
    return [F.regexp_extract(c, pattern, k).try_cast("long") for k in (1, 2, 3, 4)]


def safe_name(c: Column) -> Column:
    """Letters, digits, dot, dash and underscore; runs of others become one underscore."""
    return F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_")


# --- affine maps and projection -------------------------------------------------------------------


@dataclass(frozen=True)
class Affine:
    """x' = a x + b y + c, y' = d x + e y + f."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 1.0
    f: float = 0.0

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.a * x + self.b * y + self.c, self.d * x + self.e * y + self.f

    def then(self, o: Affine) -> Affine:
        """This map first, ``o`` after it."""
        return Affine(
            o.a * self.a + o.b * self.d, o.a * self.b + o.b * self.e, o.a * self.c + o.b * self.f + o.c,
            o.d * self.a + o.e * self.d, o.d * self.b + o.e * self.e, o.d * self.c + o.e * self.f + o.f,
        )

    def inverse(self) -> Affine:
        det = self.a * self.e - self.b * self.d
        if abs(det) < 1e-15:
            raise ValueError("a singular map has no inverse")
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, -(a * self.c + b * self.f), d, e, -(d * self.c + e * self.f))

    def summary(self) -> tuple[float, float]:
        """Rotation in degrees and scale."""
        return math.degrees(math.atan2(self.d - self.b, self.a + self.e)), math.sqrt(abs(self.a * self.e - self.b * self.d))

    @staticmethod
    def about(x: float, y: float, degrees: float, scale: float = 1.0) -> Affine:
        """A rotation with scale that leaves (x, y) in place."""
        c, s = scale * math.cos(math.radians(degrees)), scale * math.sin(math.radians(degrees))
        return Affine(c, -s, x - c * x + s * y, s, c, y - s * x - c * y)


def plate_scale(cd11: Column, cd12: Column, cd21: Column, cd22: Column) -> Column:
    """Arc seconds a pixel from a CD matrix in degrees."""
    return F.sqrt(F.abs(cd11 * cd22 - cd12 * cd21)) * 3600


def tan_to_sky(x: Column, y: Column, crpix, crval, cd) -> tuple[Column, Column]:
    """Gnomonic: pixel to right ascension and declination in degrees."""
    u, v = x - crpix[0], y - crpix[1]
    xi, eta = F.radians(cd[0] * u + cd[1] * v), F.radians(cd[2] * u + cd[3] * v)
    a0, d0 = math.radians(crval[0]), math.radians(crval[1])
    den = math.cos(d0) - eta * math.sin(d0)
    ra = F.degrees(a0 + F.atan2(xi, den))
    dec = F.degrees(F.atan2(math.sin(d0) + eta * math.cos(d0), F.sqrt(xi * xi + den * den)))
    return F.pmod(ra, F.lit(360.0)), dec


def sky_to_tan(ra: Column, dec: Column, crpix, crval, cd) -> tuple[Column, Column]:
    """Gnomonic: right ascension and declination in degrees to pixel."""
    a0, d0 = math.radians(crval[0]), math.radians(crval[1])
    da, d = F.radians(ra) - a0, F.radians(dec)
    den = math.sin(d0) * F.sin(d) + math.cos(d0) * F.cos(d) * F.cos(da)
    xi = F.degrees(F.cos(d) * F.sin(da) / den)
    eta = F.degrees((math.cos(d0) * F.sin(d) - math.sin(d0) * F.cos(d) * F.cos(da)) / den)
    det = cd[0] * cd[3] - cd[1] * cd[2]
    return (cd[3] * xi - cd[1] * eta) / det + crpix[0], (cd[0] * eta - cd[2] * xi) / det + crpix[1]


def polynomial(u: Column, v: Column, terms: dict[tuple[int, int], float]) -> Column:
    """Sum of c * u ** p * v ** q over the terms (a SIP distortion)."""
    out = F.lit(0.0)
    for (p, q), c in sorted(terms.items()):
        term = F.lit(c)
        for factor, n in ((u, p), (v, q)):
            for _ in range(n):
                term = term * factor
        out = out + term
    return out


def sip_inverse(u: Column, v: Column, a: dict, b: dict, rounds: int = 6) -> tuple[Column, Column]:
    """The (u, v) whose distorted place is the one given, by fixed-point iteration of fixed length."""
    x, y = u, v
    for _ in range(rounds):
        x, y = u - polynomial(x, y, a), v - polynomial(x, y, b)
    return x, y
