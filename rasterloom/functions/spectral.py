"""Spectral column expressions on arrays over a wavelength grid."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import grid as G
from .arrays import NAN, bind, diff, dot, finite_values, gather, is_finite, literal_array, nan_mean, norm, total


def angle_deg(a: Column, b: Column, eps: float = G.EPS_METRIC) -> Column:
    """Angle between two spectra in degrees. Bands missing on either side count as zero on both."""
    keep = lambda x, y: F.when(is_finite(x) & is_finite(y), x).otherwise(F.lit(0.0))

    def of(x: Column, y: Column) -> Column:
        cosine = dot(x, y) / (norm(x) * norm(y) + eps)
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))

    return bind(F.zip_with(a, b, keep), lambda x: bind(F.zip_with(b, a, keep), lambda y: of(x, y)))


def gradient_angle_deg(a: Column, b: Column) -> Column:
    return angle_deg(diff(a), diff(b))


def centred(a: Column) -> Column:
    return bind(nan_mean(a), lambda m: F.transform(a, lambda x: x - m))


def correlation_angle_deg(a: Column, b: Column) -> Column:
    """Angle between spectra that are each centred on their own mean over finite bands."""
    return angle_deg(centred(a), centred(b))


def information_divergence(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Symmetric Kullback-Leibler divergence of the band distributions; values are clipped at ``eps``."""
    clip = lambda x, y: F.when(is_finite(x) & is_finite(y), F.greatest(x, F.lit(eps))).otherwise(F.lit(0.0))
    share = lambda v: bind(total(v), lambda s: F.transform(v, lambda x: x / (s + eps)))
    term = lambda p, q: F.when((p > 0) & (q > 0), p * F.log((p + eps) / (q + eps)) + q * F.log((q + eps) / (p + eps))).otherwise(F.lit(0.0))
    return total(F.zip_with(share(F.zip_with(a, b, clip)), share(F.zip_with(b, a, clip)), term))


def reflectance(y: Column, wavelength: float, grid: list[float] | None = None) -> Column:
    """Linear interpolation; both neighbours always enter, so a missing one gives NaN."""
    left, w = G.bracket(wavelength, grid)
    return F.get(y, F.lit(left)) * (1 - w) + F.get(y, F.lit(left + 1)) * w


def ols_weights(low: float, high: float, grid: list[float] | None = None) -> tuple[int, list[float]]:
    """First index and weights whose dot product with the range is the least-squares slope."""
    grid = grid or G.wavelengths()
    picked = G.band_range(low, high, grid)
    x = [grid[k] for k in picked]
    mean = math.fsum(x) / len(x)
    spread = math.fsum((v - mean) ** 2 for v in x)
    return picked[0], [(v - mean) / spread for v in x]


def slope(y: Column, low: float, high: float, grid: list[float] | None = None) -> Column:
    """Least-squares slope per nm; any missing band in the range gives NaN."""
    first, w = ols_weights(low, high, grid)
    return dot(F.slice(y, first + 1, len(w)), literal_array(w))


def _points(y: Column, picked: list[int], grid: list[float]) -> Column:
    """(x, y) structs of the finite values in a range; x is centred and scaled for conditioning."""
    mid, half = (grid[picked[0]] + grid[picked[-1]]) / 2, (grid[picked[-1]] - grid[picked[0]]) / 2
    xs = literal_array((grid[k] - mid) / half for k in picked)
    both = F.zip_with(xs, F.slice(y, picked[0] + 1, len(picked)), lambda u, v: F.struct(u.alias("x"), v.alias("y")))
    return F.filter(both, lambda p: is_finite(p["y"]))


def _moments(points: Column, order: int) -> Column:
    """n, sums of powers of x up to 2 * order, and sums of y, xy, ... x**order y."""
    zero = F.struct(*(F.lit(0.0).alias(f"x{k}") for k in range(2 * order + 1)), *(F.lit(0.0).alias(f"y{k}") for k in range(order + 1)))

    def step(s: Column, p: Column) -> Column:
        x, y = p["x"], p["y"]
        powers = [F.lit(1.0)]
        for _ in range(2 * order):
            powers.append(powers[-1] * x)
        return F.struct(*((s[f"x{k}"] + powers[k]).alias(f"x{k}") for k in range(2 * order + 1)), *((s[f"y{k}"] + powers[k] * y).alias(f"y{k}") for k in range(order + 1)))

    return F.aggregate(points, zero, step)


def quadratic_coefficient(y: Column, low: float = 300.0, high: float = 600.0, grid: list[float] | None = None, least: int = 5) -> Column:
    """Second-order coefficient of a degree-2 fit over the finite points; NaN with fewer than ``least``."""
    grid = grid or G.wavelengths()
    picked = G.band_range(low, high, grid)
    half = (grid[picked[-1]] - grid[picked[0]]) / 2

    def solve(s: Column) -> Column:
        a, b, c, d, e = (s[f"x{k}"] for k in range(5))
        u, v, w = (s[f"y{k}"] for k in range(3))
        # Cramer's rule for the leading unknown of the normal equations
        whole = a * (c * e - d * d) - b * (b * e - c * d) + c * (b * d - c * c)
        lead = a * (c * w - v * d) - b * (b * w - v * c) + u * (b * d - c * c)
        return F.when(s["x0"] >= least, F.try_divide(lead, whole) / (half * half)).otherwise(F.lit(NAN))

    return bind(_moments(_points(y, picked, grid), 2), solve)


def uv_downturn(y: Column, grid: list[float] | None = None, least: int = 5) -> Column:
    """Sum over 300, 325 and 350 nm of the depth below the line fitted over 445-750 nm. Missing bands among
    the three add nothing; fewer than ``least`` finite points of the line give NaN."""
    grid = grid or G.wavelengths()
    picked = G.band_range(445.0, 750.0, grid)
    mid, half = (grid[picked[0]] + grid[picked[-1]]) / 2, (grid[picked[-1]] - grid[picked[0]]) / 2

    def solve(s: Column) -> Column:
        rise = F.try_divide(s["x0"] * s["y1"] - s["x1"] * s["y0"], s["x0"] * s["x2"] - s["x1"] * s["x1"])
        base = (s["y0"] - rise * s["x1"]) / s["x0"]
        depth = F.lit(0.0)
        for wl in (300.0, 325.0, 350.0):
            here = F.get(y, F.lit(grid.index(wl)))
            depth = depth + F.when(is_finite(here), base + rise * ((wl - mid) / half) - here).otherwise(F.lit(0.0))
        return F.when(s["x0"] >= least, depth).otherwise(F.lit(NAN))

    return bind(_moments(_points(y, picked, grid), 1), solve)


def uv_depth(y: Column, grid: list[float] | None = None) -> Column:
    """Sum over 303, 324 and 350 nm of the visible line's value relative to the measured one."""
    rise = (reflectance(y, 550.0, grid) - reflectance(y, 750.0, grid)) / (550.0 - 750.0)
    base = reflectance(y, 401.0, grid)
    # Wavelengths of the three depths.
    return sum((F.try_divide(base - rise * (401.0 - wl), reflectance(y, wl, grid)) for wl in (303.0, 324.0, 350.0)), F.lit(0.0))


def parameters(y: Column, grid: list[float] | None = None) -> dict[str, Column]:
    """The 27-parameter panel; ratios with a zero denominator are NULL."""
    r = {name: reflectance(y, wl, grid) for name, wl in G.REFLECTANCES.items()}
    ratio = lambda a, b: F.try_divide(r[a], r[b])
    return r | {
        "ci_310_390": ratio("R310", "R390"),
        "ci_415_750": ratio("R415", "R750"),
        "ci_750_415": ratio("R750", "R415"),
        "ci_750_950": ratio("R750", "R950"),
        "ratio_430_1000": ratio("R433", "R996"),
        "vis_slope": slope(y, 415.0, 750.0, grid),
        "nir_slope": slope(y, 1050.0, 1400.0, grid),
        "vn_slope": slope(y, 415.0, 1400.0, grid),
        "uv_slope": slope(y, 300.0, 415.0, grid),
        "curvature": quadratic_coefficient(y, 300.0, 600.0, grid),
        "uv_downturn": uv_downturn(y, grid),
        "uv_depth": uv_depth(y, grid),
    }


def second_difference(y: Column) -> Column:
    return diff(diff(y))


def bandpass_weights(centre: float, width: float, grid: list[float] | None = None) -> dict[int, float]:
    """Gaussian weights of a filter, cut at three sigma; index -> weight (not normalised)."""
    sigma = width * G.FWHM_TO_SIGMA
    return {k: math.exp(-0.5 * ((x - centre) / sigma) ** 2) for k, x in enumerate(grid or G.wavelengths()) if abs(x - centre) <= 3 * sigma}


def synthesise_bands(y: Column, bands: dict | None = None, grid: list[float] | None = None) -> Column:
    """One weighted mean per filter over the finite bands in it; NaN where there is none."""

    def one(weights: dict[int, float]) -> Column:
        pairs = F.zip_with(gather(y, list(weights)), literal_array(weights.values()), lambda v, w: F.struct(v.alias("v"), w.alias("w")))
        kept = F.filter(pairs, lambda p: is_finite(p["v"]))
        top = F.aggregate(kept, F.lit(0.0), lambda s, p: s + p["v"] * p["w"])
        return F.coalesce(F.try_divide(top, F.aggregate(kept, F.lit(0.0), lambda s, p: s + p["w"])), F.lit(NAN))

    return F.array(*(one(bandpass_weights(c, w, grid)) for c, w in (bands or G.BANDS).values()))


def model_input(bands: Column, count: Column, mean: float, std: float) -> Column:
    """Eight reflectances and the standardised image count."""
    return F.concat(F.slice(bands, 1, 8), F.array((count - mean) / std))


def visible_median(bands: Column) -> Column:
    """Median of the 559, 629 and 749 nm bands, over the finite ones."""
    from .arrays import nan_median

    return nan_median(F.slice(bands, 3, 3))


def coverage(y: Column) -> Column:
    """Share of finite bands."""
    return F.size(finite_values(y)) / F.size(y)
