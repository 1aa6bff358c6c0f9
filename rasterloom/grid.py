"""Wavelength grid and the fixed values of the domain."""

from __future__ import annotations

from bisect import bisect_left

# Output grid (nm), planet radius, pixel size, missing-value thresholds.
GRID_START, GRID_STEP, GRID_SIZE = 300.0, 5.0, 231
RADIUS_M, RADIUS_KM = 2_439_400.0, 2439.4
PIXEL_M = 665.24315270546
NODATA_BELOW = -1e30
EPS_METRIC, EPS_TRAINING, EPS_ZSCORE = 1e-8, 1e-12, 1e-9
FWHM_TO_SIGMA = 1 / 2.3548200450309493

# Filter -> (centre nm, full width nm) of the eight input bands, in band order.
BANDS = {
    "F": (433.2, 18.1),
    "C": (479.9, 10.1),
    "D": (558.9, 5.8),
    "E": (628.8, 5.5),
    "G": (748.7, 5.1),
    "L": (828.4, 5.2),
    "J": (898.8, 5.1),
    "I": (996.2, 14.3),
}

# Named reflectances (nm). R559 is read at 556.9.
REFLECTANCES = {
    "R310": 310.0, "R390": 390.0, "R415": 415.0, "R433": 433.2, "R480": 479.9,
    "R559": 556.9, "R629": 628.8, "R749": 748.7, "R750": 750.0, "R828": 828.4,
    "R899": 898.8, "R950": 950.0, "R996": 996.2, "R1050": 1050.0, "R1400": 1400.0,
}

# The representative parameter of each physical family.
KEY_PARAMETERS = ("R559", "vis_slope", "ratio_430_1000", "nir_slope", "curvature", "uv_downturn")


def wavelengths(start: float = GRID_START, step: float = GRID_STEP, size: int = GRID_SIZE) -> list[float]:
    return [start + step * k for k in range(size)]


def nearest_index(wavelength: float, grid: list[float] | None = None) -> int:
    """0-based index of the nearest grid point; the lower one on ties."""
    grid = grid or wavelengths()
    return min(range(len(grid)), key=lambda k: (abs(grid[k] - wavelength), k))


def bracket(wavelength: float, grid: list[float] | None = None) -> tuple[int, float]:
    """0-based index of the left neighbour and the weight of the right one. An exact grid point
    (but the first) is the right neighbour with weight 1, so a missing left neighbour still shows."""
    grid = grid or wavelengths()
    right = min(max(bisect_left(grid, wavelength), 1), len(grid) - 1)
    return right - 1, (wavelength - grid[right - 1]) / (grid[right] - grid[right - 1])


def band_range(low: float, high: float, grid: list[float] | None = None) -> list[int]:
    """0-based indexes of grid points within [low, high]."""
    return [k for k, x in enumerate(grid or wavelengths()) if low <= x <= high]
