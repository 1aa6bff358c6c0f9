"""Input and output checks as one table of (name, ok, detail). Expected figures are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import grid as G
from ..functions.arrays import is_valid_pixel
from ..functions.geo import wkt_rings
from ..operators import layer as layers
from ..operators import metrics, quality, splits
from ..operators.checks import check, has_columns, report


def raster_checks(info: DataFrame, width: int, height: int, count: int, pixel_m: float = G.PIXEL_M) -> DataFrame:
    """The header of a raster, from ``sources.raster.raster_info``."""
    first = lambda c: F.first(F.col(c))
    return report(
        check(info, "width", first("width") == width, first("width")), check(info, "height", first("height") == height, first("height")),
        check(info, "band count", first("count") == count, first("count")), check(info, "four-byte floats", first("dtype") == "f4", first("dtype")),
        check(info, "pixel size", F.abs(F.first(F.get("transform", 0)) - pixel_m) < 1e-6, F.first(F.get("transform", 0))),
        check(info, "nodata", first("nodata") < G.NODATA_BELOW, first("nodata")),
    )


def source_checks(spark: SparkSession, files: dict[str, str], spectra: DataFrame, geometry: DataFrame, pixel_m: float = G.PIXEL_M) -> DataFrame:
    """Every file is there, spectra have their columns, footprints (width and length in km) are larger than a pixel."""
    rows = []
    for name, path in sorted(files.items()):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        rows.append((name, bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))))
    found = spark.createDataFrame(rows, "name string, here boolean")
    sizes = F.median(F.greatest(F.col("width"), F.col("length")))
    return report(
        check(found, "files are present", F.every("here"), F.count_if(~F.col("here"))), has_columns(spectra, ["ref_id", "obs_id", "waves", "photom_iof"], "columns of spectra"),
        check(geometry, "footprints are larger than a pixel", sizes * 1000 > pixel_m, sizes),
    )


def pixel_checks(pixels: DataFrame) -> DataFrame:
    """Bands 1-8 rise with wavelength, band 9 is a count, bands 10-17 are deviations that fall with its root."""
    seen = pixels.where(is_valid_pixel(F.slice("bands", 1, 9))).select(*(F.get("bands", k).cast("double").alias(f"b{k + 1}") for k in range(17)))
    medians = [F.median(f"b{k}") for k in range(1, 9)]
    rises = F.lit(True)
    for low, high in zip(medians, medians[1:]):
        rises = rises & (low < high)
    single = seen.where("abs(b9 - 1) < 1e-6")
    many = seen.where("b9 >= 2 AND b14 > 0 AND b5 > 0").select("b9", (F.col("b14") / F.col("b5")).alias("share"))
    fall = F.regr_slope(F.log("share"), F.log("b9"))
    shares = [F.try_divide(F.median(f"b{k + 9}"), m) for k, m in enumerate(medians, 1)]
    small = F.lit(True)
    for share in shares:
        small = small & (share > 0.002) & (share < 0.03)
    return report(
        check(seen, "bands 1-8 rise with wavelength", rises, medians[7]),
        check(seen, "band 9 is a count", F.avg((F.abs(F.col("b9") - F.round("b9")) < 1e-6).cast("double")) > 0.5, F.count_distinct("b9")),
        check(single, "no deviation from one image", F.avg((F.col("b14") == 0).cast("double")) > 0.999, F.count(F.lit(1))),
        check(many, "deviation falls with the root of the count", fall.between(-0.75, -0.25), fall),
        check(seen.where("b9 >= 2"), "deviations are about one per cent", small, shares[0]),
    )


def table_checks(quality_rows: DataFrame, spectra: DataFrame, shapes: DataFrame, pairs: DataFrame, split: DataFrame, expected: dict[str, tuple[float, float]]) -> DataFrame:
    """Counts against (low, high) ranges, spectra, footprints and the split's integrity.

    ``expected`` may hold ``n_rows``, ``n_good``, ``n_groups`` and ``n_pairs``.
    """
    good = quality.strict_quality(quality_rows)
    inside = lambda value, key: value.between(*expected[key]) if key in expected else F.lit(True)
    rows, groups = F.count(F.lit(1)), F.count_distinct("obs_id")
    sized = spectra.select(F.size("waves").alias("n"), F.array_min("waves").alias("low"), F.array_max("waves").alias("high"))
    rings = shapes.select(F.get(wkt_rings(F.col("foot_geom")), 0).alias("ring"))
    joined = pairs.select("ref_id", "obs_id", "photom_iof_5nm").join(split, "ref_id", "left")
    leaks = splits.split_leaks(joined, "obs_id")
    return report(
        check(quality_rows, "number of rows", inside(rows, "n_rows"), rows), check(good, "rows that pass", inside(rows, "n_good"), rows), check(good, "groups that survive", inside(groups, "n_groups"), groups),
        check(sized, "ragged spectra", F.count_distinct("n") > 1, F.max("n")), check(sized, "spectra span the grid", (F.min("low") <= G.GRID_START) & (F.max("high") >= G.GRID_START + G.GRID_STEP * (G.GRID_SIZE - 1)), F.max("high")),
        check(rings, "footprints are polygons", F.avg(F.coalesce(F.size("ring") >= 3, F.lit(False)).cast("double")) > 0.99), check(rings, "finer than four corners", F.median(F.size("ring")) > 4, F.median(F.size("ring"))),
        check(pairs, "number of pairs", inside(rows, "n_pairs"), rows), check(joined, "every pair has a split", F.count_if(F.col("split").isNull()) == 0), check(leaks, "no group on two sides", F.first("max_splits") == 1, F.first("max_splits")),
        check(joined, "targets are on the grid", F.every(F.size("photom_iof_5nm") == G.GRID_SIZE)),
    )


def mosaic_checks(before: DataFrame, after: DataFrame, layer: DataFrame, modes: list[list[float]], n_layer: int, scale: float, level: tuple[float, float], slope_pct: tuple[float, float], spectrum: str = "spectrum") -> DataFrame:
    """Whole-spectrum nodata, level and slope of the median spectrum, the layer's size and single gain, exactness in and out."""
    from .pipelines import mosaic_statistics, red_slope_percent

    stats = mosaic_statistics(before, spectrum)
    blank = F.filter(spectrum, lambda x: F.isnan(x) | (x <= G.NODATA_BELOW))
    partly = before.where(F.col(spectrum).isNotNull()).select((F.size(blank) > 0).alias("some"), (F.size(blank) == F.size(spectrum)).alias("all"))
    proof = layers.verify(before, after, layer, modes, spectrum)
    middle = stats.where(F.col("wavelength_nm") == 750.0)
    red = red_slope_percent(stats, 435.0, 750.0)
    return report(
        check(partly, "nodata is a whole spectrum", F.count_if(F.col("some") & ~F.col("all")) == 0), check(middle, "level at 750 nm", F.first("median").between(*level), F.first("median")),
        check(red, "red slope", F.first("red_slope_pct").between(*slope_pct), F.first("red_slope_pct")), check(layer, "size of the layer", F.count(F.lit(1)) == n_layer, F.count(F.lit(1))),
        check(layer, "one gain", (F.min("g") == F.max("g")) & (F.abs(F.min("g").cast("double") - scale) < 1e-6), F.max("g")),
        check(proof, "exact outside the layer", F.first("outside_max") == 0, F.first("outside_max")), check(proof, "the layer inside", F.first("inside_max") < 1e-6, F.first("inside_max")),
    )


def contrast_check(frame: DataFrame, before: str, after: str, inside: str) -> DataFrame:
    """The correction raises the contrast of the flagged rows over the others."""
    a, b = metrics.contrast(F.col(after), F.col(inside)), metrics.contrast(F.col(before), F.col(inside))
    return check(frame, "contrast rises", a > b, a - b)
