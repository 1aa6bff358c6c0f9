"""Operators on DataFrames: quality rules, joins, nearest neighbours, metrics, rasters, splits, models, layers, simulation, checks."""

from . import checks, joins, knn, layer, metrics, model, quality, raster, simulate, splits

__all__ = ["checks", "joins", "knn", "layer", "metrics", "model", "quality", "raster", "simulate", "splits"]
