"""Resampling of ragged spectra and keyed noise: vectorised Python where Spark has no primitive.

Spectra that share a wavelength axis are resampled together: of each axis in an Arrow batch the places and weights of the grid's points are
worked out once, and all its rows go through them as one matrix. Arrays come and go as flat Arrow lists, so gaps stay NaN.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from .. import grid as G

GRID = np.array(G.wavelengths())


class LinearAxis:
    """Where the grid's points lie among an axis' points, in any order; NaN beyond its ends."""

    def __init__(self, waves: np.ndarray, grid: np.ndarray = GRID):
        self.order = np.argsort(waves, kind="stable")
        w = waves[self.order]
        self.outside = ~((grid >= w[0]) & (grid <= w[-1]))
        self.low = np.clip(np.searchsorted(w, grid, "right") - 1, 0, len(w) - 2)
        self.step, self.along = w[self.low + 1] - w[self.low], grid - w[self.low]
        self.exact = grid == w[-1]

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """(rows, grid) from (rows, axis)."""
        v = values[:, self.order]
        low, high = v[:, self.low], v[:, self.low + 1]
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.where(self.along == 0, low, (high - low) / self.step * self.along + low)
        out[:, self.exact] = v[:, -1:]
        out[:, self.outside] = np.nan
        return out


class GaussianAxis:
    """Weights of an axis' points under Gaussians cut at three sigma around the grid's points, and which of these are usable: within the support
    and with a native point no farther than half a grid step, so gaps are never bridged."""

    def __init__(self, waves: np.ndarray, fwhm: float, grid: np.ndarray = GRID):
        sigma, half = fwhm * G.FWHM_TO_SIGMA, (grid[1] - grid[0]) / 2
        away = np.abs(grid[:, None] - waves)
        weight = np.where(away <= 3 * sigma, np.exp(-0.5 * (away / sigma) ** 2), 0.0)
        norm = weight.sum(axis=1)
        self.usable = (norm > 0) & (grid >= waves.min()) & (grid <= waves.max()) & (away.min(axis=1) <= half)
        self.weight = weight[self.usable] / norm[self.usable, None]

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.full((len(values), len(self.usable)), np.nan)
        out[:, self.usable] = values @ self.weight.T
        return out


def linear(waves, values, grid: np.ndarray = GRID) -> np.ndarray | None:
    """Linear interpolation of one spectrum onto the grid, NaN outside the support; None with fewer than two points
    or unequal lengths. Native points may come in any order."""
    if waves is None or values is None or len(waves) != len(values) or len(waves) < 2:
        return None
    return LinearAxis(np.asarray(waves, float), grid)(np.asarray(values, float)[None, :])[0]


def gaussian(waves, values, fwhm: float, grid: np.ndarray = GRID) -> np.ndarray | None:
    """Mean of one spectrum's points under Gaussians, see ``GaussianAxis``; None like ``linear``."""
    if waves is None or values is None or len(waves) != len(values) or len(waves) < 2:
        return None
    return GaussianAxis(np.asarray(waves, float), fwhm, grid)(np.asarray(values, float)[None, :])[0]


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, row starts and row lengths of a list array; a null row has length -1, a null element is NaN."""
    size = np.diff(np.asarray(lists.offsets, np.int64))
    if lists.null_count:
        size = np.where(np.asarray(lists.is_null()), 0, size)
    start = np.cumsum(size) - size
    if lists.null_count:
        size = np.where(np.asarray(lists.is_null()), -1, size)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), start, size


def resample_batch(waves: pa.Array, values: pa.Array, axis_of, width: int) -> pa.Array:
    """Rows of two list arrays on the grid; ``axis_of(waves)`` is made once for each axis of the batch. Null for unequal or too short rows."""
    (w, w_at, w_size), (v, v_at, v_size) = _flat(waves), _flat(values)
    good = (w_size == v_size) & (w_size >= 2)
    by_axis: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(good):
        by_axis.setdefault(w[w_at[i] : w_at[i] + w_size[i]].tobytes(), []).append(i)
    out = np.full((len(good), width), np.nan)
    for key, rows in by_axis.items():
        native = np.frombuffer(key)
        out[rows] = axis_of(native)(v[v_at[rows][:, None] + np.arange(len(native))])
    offsets = np.concatenate([[0], np.cumsum(np.where(good, width, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[good].ravel()), mask=pa.array(~good))


def resample_linear(waves: Column, values: Column, grid: list[float] | None = None) -> Column:
    points = GRID if grid is None else np.array(grid)

    @arrow_udf("array<double>")
    def run(w: pa.Array, v: pa.Array) -> pa.Array:
        return resample_batch(w, v, lambda native: LinearAxis(native, points), len(points))

    return run(waves, values)


def resample_gaussian(waves: Column, values: Column, fwhm: float, grid: list[float] | None = None) -> Column:
    points = GRID if grid is None else np.array(grid)

    @arrow_udf("array<double>")
    def run(w: pa.Array, v: pa.Array) -> pa.Array:
        return resample_batch(w, v, lambda native: GaussianAxis(native, fwhm, points), len(points))

    return run(waves, values)


def noise_of(seed: int, key: int, arm: int, n_bands: int) -> np.ndarray:
    """One common draw and one draw per band, from a generator keyed on (seed, key, arm)."""
    return np.random.default_rng([seed, key, arm]).standard_normal(1 + n_bands)


def keyed_noise(key: Column, arm: Column, n_bands: int = 8, seed: int = 4242) -> Column:
    """Array of 1 + n_bands standard normal draws that depends on (seed, key, arm) only, not on partitions or order."""

    @pandas_udf("array<double>")
    def run(keys: pd.Series, arms: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(k) or pd.isna(a) else noise_of(seed, int(k), int(a), n_bands) for k, a in zip(keys, arms)], dtype=object)

    return run(key.cast("long"), arm.cast("long"))


def positional_noise(n_rows: int, n_bands: int = 8, seed: int = 4242) -> tuple[np.ndarray, np.ndarray]:
    """The older scheme: draws by row position from one stream; driver only, for small tables."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n_rows, 1)), rng.standard_normal((n_rows, n_bands))


def simulated_bands(synthetic: Column, noise: Column, slopes: list[float], offsets: list[float], spreads: list[float], correlation: float) -> Column:
    """slope * synthetic + offset + spread * (sqrt(rho) * common + sqrt(1 - rho) * own) per band."""
    if not 0.0 <= correlation <= 1.0:
        raise ValueError(f"the inter-band correlation must lie in [0, 1], got {correlation}")
    a, b = float(np.sqrt(correlation)), float(np.sqrt(1 - correlation))
    return F.array(*(F.get(synthetic, k) * slopes[k] + offsets[k] + (F.get(noise, 0) * a + F.get(noise, k + 1) * b) * spreads[k] for k in range(len(slopes))))


def interpolate_table(table, at: str, value: str, grid: list[float] | None = None):
    """(band, wavelength_nm, ``value``): a small table of points, linearly between them and constant beyond its ends, on the grid.

    The points are an array of one row, searched by an expression per band.
    """
    points = F.array_sort(F.collect_list(F.struct(F.col(at).cast("double").alias("x"), F.col(value).cast("double").alias("y"))))
    found = table.where(F.col(at).isNotNull() & F.col(value).isNotNull()).agg(points.alias("p"))
    w = F.col("wavelength_nm")
    spread = found.select("p", F.posexplode(F.array(*(F.lit(float(x)) for x in (grid or G.wavelengths())))).alias("band", "wavelength_nm"))
    high = F.get(F.filter("p", lambda q: q["x"] > w), 0)
    spread = spread.where(F.size("p") > 0).withColumn("low", F.try_element_at(F.filter("p", lambda q: q["x"] <= w), F.lit(-1))).withColumn("high", high)
    between = F.col("low.y") + (F.col("high.y") - F.col("low.y")) * F.try_divide(w - F.col("low.x"), F.col("high.x") - F.col("low.x"))
    return spread.select("band", "wavelength_nm", F.when(F.col("low").isNull(), F.col("high.y")).when(F.col("high").isNull(), F.col("low.y")).otherwise(between).alias(value))
