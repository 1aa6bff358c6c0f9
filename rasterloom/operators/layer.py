"""Sparse correction layers over a dense grid of pixels, exactly reversible.

A layer is a table (row, col, g, c0, c1, ...). It is joined to the pixels on (row, col): Spark broadcasts it
below its checked size limit and shuffles otherwise. Pixels without data are never written.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import add, guarded_ratio, is_finite, is_valid_pixel, low_rank
from ..functions.strings import coefficient_columns
from ..grid import NODATA_BELOW, nearest_index
from .model import LowRankCorrection, Perceptron, apply_model
from .order_stats import quantiles
from .quality import zscore_gate

TILE = (256, 512)


def candidates(mask: DataFrame, pixels: DataFrame, reference: tuple[float, float, float, float], threshold: float = 0.5) -> DataFrame:
    """Pixels of the spatial selection with ``valid`` and ``chosen`` (valid, bright and blue)."""
    seen = mask.join(pixels, ["row", "col"])
    top, level = F.get("bands", 0).cast("double"), F.get("bands", 4).cast("double")
    valid = is_valid_pixel(F.slice("bands", 1, 9))
    gate = zscore_gate(level, guarded_ratio(top, level), reference, threshold)
    return seen.withColumn("valid", valid).withColumn("chosen", valid & gate)


def selection_stats(found: DataFrame, height: int, width: int) -> DataFrame:
    """One row of counts and rates of the selection; rates are rounded half to even."""
    spatial, invalid, kept = F.count(F.lit(1)), F.count_if(~F.col("valid")), F.count_if(F.col("chosen"))
    return found.agg(
        spatial.alias("n_pixels_spatial"), invalid.alias("n_pixels_invalid"),
        F.count_if(F.col("valid") & ~F.col("chosen")).alias("n_pixels_rejected"), kept.alias("n_pixels_corrected"),
        F.bround(100.0 * kept / (height * width), 5).alias("fraction_pct"),
        F.bround(kept / F.greatest(spatial - invalid, F.lit(1)), 4).alias("bright_blue_rate"),
    )


def build(found: DataFrame, correction: LowRankCorrection, scale: float, count_mean: float, count_std: float) -> DataFrame:
    """The layer of the chosen pixels, its coefficients in doubles. The scale has no default: published runs used different ones."""
    x = F.concat(F.slice(F.col("bands").cast("array<double>"), 1, 8), F.array((F.get("bands", 8).cast("double") - count_mean) / count_std))
    ready = found.where("chosen").select("row", "col", x.alias("__x"))
    return _coefficients(ready, correction.coefficients, scale)


def _coefficients(ready: DataFrame, net: Perceptron, scale: float) -> DataFrame:
    rank = net.layers[-1][1].size
    out = apply_model(ready, net, "__x", "__c", double=True)
    return out.select("row", "col", F.lit(float(scale)).cast("float").alias("g"), *(F.get("__c", k).alias(f"c{k}") for k in range(rank)))


def delta(layer: DataFrame, modes: list[list[float]]) -> Column:
    """The layer's spectrum g * (c . modes) of a row; NULL where the row has no layer."""
    return low_rank([F.col(c) for c in coefficient_columns(layer.columns)], modes, F.col("g").cast("double"))


def with_layer(pixels: DataFrame, layer: DataFrame, modes: list[list[float]], spectrum: str = "spectrum") -> DataFrame:
    """``pixels`` with __delta (NULL outside the layer or without data) from a left join."""
    joined = pixels.join(layer, ["row", "col"], "left")
    ok = F.col("g").isNotNull() & is_valid_pixel(F.col(spectrum))
    return joined.withColumn("__delta", F.when(ok, delta(layer, modes))).withColumn("__in_layer", F.col("g").isNotNull()).drop("g", *coefficient_columns(layer.columns))


def rewrite(pixels: DataFrame, layer: DataFrame, modes: list[list[float]], spectrum: str = "spectrum") -> DataFrame:
    """``pixels`` with the layer added; every other value is the input's, bit for bit."""
    kind = pixels.schema[spectrum].dataType.simpleString()
    joined = with_layer(pixels, layer, modes, spectrum)
    new = F.when(F.col("__delta").isNotNull(), add(F.col(spectrum).cast("array<double>"), F.col("__delta")).cast(kind)).otherwise(F.col(spectrum))
    return joined.withColumn(spectrum, new).select(pixels.columns)


def audit(pixels: DataFrame, layer: DataFrame, modes: list[list[float]], spectrum: str = "spectrum", wavelength: float = 996.0) -> DataFrame:
    """One row, without writing: pixels written and skipped, largest change, negative values after, and the
    median change at the grid band nearest to the wavelength."""
    at = nearest_index(wavelength)
    joined = with_layer(pixels, layer, modes, spectrum)
    after = add(F.col(spectrum).cast("array<double>"), F.col("__delta"))
    counts = joined.agg(
        F.count_if(F.col("__delta").isNotNull()).alias("n_written"), F.count_if(F.col("__in_layer") & F.col("__delta").isNull()).alias("n_nodata_skipped"),
        F.max(F.array_max(F.transform("__delta", lambda x: F.abs(x)))).alias("delta_max_abs"),
        F.coalesce(F.sum(F.size(F.filter(after, lambda x: x < 0))), F.lit(0)).cast("long").alias("n_negative_after"),
    )
    return counts.join(quantiles(joined.select(F.get("__delta", at).alias("change")), [], {"change": {"delta_median": 0.5}}), how="cross")


def patch(target: str, pixels: DataFrame, layer: DataFrame, modes: list[list[float]], spectrum: str = "spectrum") -> None:
    """Rewrite only the touched tile rows of a dataset partitioned by ``tile_row`` (dynamic partition overwrite).

    ``pixels`` must not be read from ``target`` itself.
    """
    rows = layer.select(F.floor(F.col("row") / TILE[0]).cast("int").alias("tile_row")).distinct()
    touched = pixels.withColumn("tile_row", F.floor(F.col("row") / TILE[0]).cast("int")).join(rows, "tile_row", "left_semi")
    rewrite(touched, layer, modes, spectrum).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile_row").parquet(target)


def tiles(layer: DataFrame, rows: int = TILE[0], cols: int = TILE[1]) -> DataFrame:
    """(tile_row, tile_col, n_pixels) of the tiles that the layer touches."""
    return layer.groupBy(F.floor(F.col("row") / rows).cast("int").alias("tile_row"), F.floor(F.col("col") / cols).cast("int").alias("tile_col")).agg(F.count(F.lit(1)).alias("n_pixels"))


def verify(before: DataFrame, after: DataFrame, layer: DataFrame, modes: list[list[float]], spectrum: str = "spectrum") -> DataFrame:
    """One row over all pixels: largest difference outside the layer (0 if exact) and deviation from the layer inside."""
    other = after.select("row", "col", F.col(spectrum).alias("__after"))
    joined = with_layer(before, layer, modes, spectrum).join(other, ["row", "col"])
    gap = F.zip_with(F.col("__after").cast("array<double>"), F.col(spectrum).cast("array<double>"), lambda x, y: F.when(F.isnan(x) & F.isnan(y), 0.0).otherwise(x - y))
    most = lambda a: F.array_max(F.transform(a, lambda x: F.abs(x)))
    inside = F.col("__delta").isNotNull()
    return joined.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(~inside, most(gap))).alias("outside_max"), F.max(F.when(inside, most(F.zip_with(gap, F.col("__delta"), lambda x, y: x - y)))).alias("inside_max"))


def gate_at(points: DataFrame, layer: DataFrame) -> DataFrame:
    """``points`` (with row, col) and the layer's g there, 0 outside."""
    return points.join(layer.select("row", "col", "g"), ["row", "col"], "left").withColumn("g", F.coalesce("g", F.lit(0.0).cast("float")))


def spread_audit(pixels: DataFrame, reference: tuple[float, float, float, float], threshold: float = 0.5) -> DataFrame:
    """One row: how far background pixels (a sample of whole rows, see ``raster.rows_sample``) spread beyond the footprints that the reference
    was taken from, and what share of them passes the gate."""
    top, level = F.get("bands", 0).cast("double"), F.get("bands", 4).cast("double")
    usable = is_finite(level) & (level > 0) & is_finite(top) & (top > NODATA_BELOW)
    seen = pixels.where(usable).select(level.alias("level"), (top / level).alias("ratio"))
    lit = zscore_gate(F.col("level"), F.col("ratio"), reference, threshold).cast("double")
    wide = seen.agg(F.count(F.lit(1)).alias("n_background_pixels"), F.avg("level").alias("mu_level"), F.stddev_pop("level").alias("sd_level"), F.avg("ratio").alias("mu_ratio"), F.stddev_pop("ratio").alias("sd_ratio"), F.avg(lit).alias("passing"))
    return wide.select(
        "n_background_pixels", "mu_level", "sd_level", "mu_ratio", "sd_ratio", F.bround(F.col("sd_level") / reference[1], 3).alias("sigma_level_over_footprints"),
        F.bround(F.col("sd_ratio") / reference[3], 3).alias("sigma_ratio_over_footprints"), F.bround(100 * F.col("passing"), 3).alias("background_passing_pct"),
    )


def configuration(layer: DataFrame, statistics: DataFrame, audit_row: DataFrame, reference: tuple[float, float, float, float], basis_file: str, choices: dict, files: dict) -> dict:
    """The document that belongs to a layer: how it was chosen, from what, and a fingerprint of the basis as it was written."""
    with open(basis_file, "rb") as f:
        print_ = hashlib.md5(f.read()).hexdigest()[:12]
    one = lambda frame: frame.first().asDict()
    return {
        "formula": "output = base + g * (c(x) . B)", "residual": {"rank": len(coefficient_columns(layer.columns)), "basis_md5": print_},
        "selection": choices | {"reference": dict(zip(("mu_level", "sd_level", "mu_ratio", "sd_ratio"), reference))},
        "layer": one(statistics), "spread_audit": one(audit_row), "files": files,
    }
