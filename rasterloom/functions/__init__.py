"""Column expressions and vectorised functions: arrays, spectra, geometry, strings, resampling, polygons."""

from . import arrays, geo, polygon, resample, spectral, strings

__all__ = ["arrays", "geo", "polygon", "resample", "spectral", "strings"]
