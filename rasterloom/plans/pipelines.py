"""The engine's end-to-end plans: pairs, targets, evaluation, pool, footprints and the correction layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import grid as G
from ..functions import geo, resample
from ..functions import spectral as S
from ..functions.arrays import is_valid_pixel
from ..operators import joins, knn, metrics, quality, raster
from ..operators.order_stats import quantiles
from ..operators.splits import sample_each
from ..sources.tables import only_ids, readable_spectra


def build_pairs(quality_rows: DataFrame, geometry: DataFrame, shapes: DataFrame, spectra: DataFrame, pixels: DataFrame, transform: tuple, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, rejected ids): good footprints with the mean bands under them and their spectrum on the grid.

    The semi-join with the good ids comes before spectra are parsed or polygons are cut.
    """
    good = quality.strict_quality(quality_rows).select("ref_id")
    base = only_ids(geometry, good).join(shapes, "ref_id")
    usable, broken = readable_spectra(only_ids(spectra, good))
    rings = base.select("ref_id", F.explode(raster.footprint_rings(F.col("foot_geom"))).alias("ring"))
    means = raster.zonal_mean(rings, "ref_id", "ring", pixels, "bands", transform, width, height)
    seen = means.where(F.exists(F.slice("bands", 1, 8), lambda x: ~F.isnan(x)))
    out = base.join(seen, "ref_id").join(usable.select("ref_id", resample.resample_linear(F.col("waves"), F.col("photom_iof")).alias("photom_iof_5nm")), "ref_id")
    pairs = out.select(
        "ref_id", "obs_id", "lat_center", geo.wrap_half_open(F.col("lon_center")).alias("lon_center"), "ang_in", "ang_em", "ang_ph", "foot_geom",
        F.slice("bands", 1, 8).alias("mdis_iof"), F.get("bands", 8).alias("mdis_image_count"), F.slice("bands", 10, 8).alias("mdis_sigma"), "photom_iof_5nm",
    )
    rejected = broken.select("ref_id").union(base.select("ref_id").join(seen, "ref_id", "left_anti")).distinct()
    return pairs, rejected


def build_targets(pairs: DataFrame, spectra: DataFrame, widths: tuple[float, ...] = (4.7, 5.0, 7.0)) -> DataFrame:
    """(ref_id, n_native, naive, lsf_*): the target variants; the ragged spectrum is parsed once for all."""
    usable, _ = readable_spectra(only_ids(spectra, pairs))
    w, v = F.col("waves"), F.col("photom_iof")
    variants = {f"lsf_{x:.1f}".replace(".", "p"): resample.resample_gaussian(w, v, x) for x in widths}
    return usable.select("ref_id", F.size("waves").alias("n_native"), resample.resample_linear(w, v).alias("naive"), *(e.alias(n) for n, e in variants.items()))


def floor_report(pairs: DataFrame, targets: DataFrame, variants: tuple[str, ...] = ("naive", "lsf_4p7", "lsf_5p0", "lsf_7p0"), k: int = 5) -> DataFrame:
    """Per target variant: the k-NN floor on the support common to the linear and the 5 nm variant, on its own
    support, its coverage, and the difference from the first variant."""
    nan = F.lit(float("nan"))
    both = pairs.select("ref_id", "mdis_iof").join(targets, "ref_id")
    near = knn.neighbours(both, both, "ref_id", "mdis_iof", k)
    out = None
    for v in variants:
        seen = F.zip_with("naive", "lsf_5p0", lambda a, b: ~F.isnan(a) & ~F.isnan(b))
        fair = both.withColumn("__ok", seen).withColumn("__y", F.zip_with(F.col(v), F.col("__ok"), lambda y, ok: F.when(ok, y).otherwise(nan)))
        row = knn.variance_floor(near, fair, "ref_id", "__y").select(F.lit(v).alias("variant"), F.col("floor").alias("floor_fair"))
        row = row.join(knn.variance_floor(near, both, "ref_id", v).withColumnRenamed("floor", "floor_own_support"), how="cross").join(both.agg(F.avg(S.coverage(F.col(v))).alias("coverage")), how="cross")
        out = row if out is None else out.unionByName(row)
    first = out.where(F.col("variant") == variants[0]).select(F.col("floor_fair").alias("__base"))
    return out.join(first, how="cross").select("variant", "floor_fair", "floor_own_support", "coverage", (F.col("floor_fair") - F.col("__base")).alias("d_vs_naive"), F.try_divide(F.col("floor_fair") - F.col("__base"), F.col("__base")).alias("rel_vs_naive"))


def evaluate(predicted: DataFrame, terrain: DataFrame) -> dict[str, DataFrame]:
    """The audit of a prediction table (ref_id, obs_id, split, target, predicted) as named result tables.

    Cache ``predicted``: every table reads it.
    """
    p, t = F.col("predicted"), F.col("target")
    angles = predicted.select("ref_id", "obs_id", "split", S.angle_deg(p, t).alias("sam"), metrics.row_mse(t, p).alias("mse"))
    test = predicted.where("split = 'test'")
    tested = angles.where("split = 'test'")
    side = F.when(F.col("split") == "test", "test").when(F.col("split") == "fold0", "val").otherwise("train")
    sided = angles.withColumn("split", side)
    classed = tested.join(terrain, "ref_id", "left").withColumn("terrain", quality.terrain_class(F.col("lrm"), F.col("sm_plain")))
    per_obs = metrics.group_angles(tested, "obs_id")
    params = metrics.parameters_long(test, "ref_id", "target", "predicted")
    return {
        "per_split": sided.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("mse").alias("mse"), F.avg("sam").alias("sam_mean")).join(quantiles(sided, ["split"], {"sam": {"sam_median": 0.5}}), "split").select("split", "n", "mse", "sam_median", "sam_mean"),
        "per_obs": per_obs, "per_obs_summary": metrics.median_of_medians(per_obs),
        "per_terrain": metrics.group_angles(classed, "terrain").orderBy("terrain"),
        "per_band": metrics.per_band(metrics.bands_long(test, [], "target", "predicted")).withColumn("wavelength_nm", G.GRID_START + G.GRID_STEP * F.col("band")),
        "param_fidelity": metrics.parameter_fidelity(params), "panel": metrics.metric_panel(test, "ref_id", "target", "predicted"),
        "global_mse": metrics.global_mse(metrics.bands_long(test, [], "target", "predicted")),
    }


def ceilings(test: DataFrame, inputs: str = "mdis_iof") -> DataFrame:
    """Per parameter its reliability in input space, the ceiling and the share of it that the model reaches."""
    near = knn.neighbours(test, test, "ref_id", inputs, 1)
    return knn.reliability(near, metrics.parameters_long(test, "ref_id", "target", "predicted"), "ref_id", "target", "predicted")


def candidate_pool(groups: DataFrame, geometry: DataFrame, quality_rows: DataFrame, held_out: DataFrame, radius_km: float) -> tuple[DataFrame, DataFrame]:
    """(pool candidates, stage counts): footprints near a group centre that is not held out, that pass the inverted rule.

    ``held_out`` has clon, clat and radius_km (half the diameter plus the margin).
    """
    kept = joins.outside_all(groups.withColumnsRenamed({"clon": "lon", "clat": "lat"}), held_out.withColumn("clon", geo.wrap_above_180(F.col("clon"))), "group_id").withColumnsRenamed({"lon": "clon", "lat": "clat"})
    points = geometry.select("ref_id", geo.wrap_above_180(F.col("lon_center")).alias("lon"), F.col("lat_center").alias("lat"))
    near = joins.nearest_within(points, kept, radius_km, "ref_id", "group_id")
    fine = near.join(quality.inverted_quality(quality_rows).drop("obs_id"), "ref_id")
    size = lambda f, n: f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("stage"), "n")
    return fine.join(geometry, "ref_id"), size(near, "candidates").unionByName(size(fine, "quality"))


def group_hits(candidates: DataFrame, groups: DataFrame, pixels: DataFrame, transform: tuple, radius_km: float, bright: float = 82.0, blue: float = 65.0) -> DataFrame:
    """Candidates whose pixel is bright and blue for its own group's disk (a pixel radius; disks need 5 pixels)."""
    x, y = geo.project(F.col("clon"), F.col("clat"))
    row, col = geo.cell_of(x, y, transform)
    centres = groups.select("group_id", row.alias("crow"), col.alias("ccol"), F.lit(raster.disk_pixels(radius_km)).alias("radius"))
    lit = raster.bright_blue_disk(pixels, centres, "group_id", "radius", bright, blue, whole_window=False)
    px, py = geo.project(geo.wrap_above_180(F.col("lon_center")), F.col("lat_center"))
    r, c = geo.cell_of(px, py, transform)
    return candidates.withColumn("row", r).withColumn("col", c).join(lit, ["group_id", "row", "col"], "left_semi").drop("row", "col")


def crater_footprints(craters: DataFrame, geometry: DataFrame, pixels: DataFrame, transform: tuple, bright: float = 82.0, blue: float = 65.0, context: float = 2.0) -> DataFrame:
    """(crater, ref_id, obs_id, lat, lon, on_hollow): footprints in the square window of every crater; one may be in several.

    ``craters`` has crater, clon, clat, diam_km. Craters whose disk has fewer than 25 valid pixels give none.
    """
    x, y = geo.project(geo.wrap_above_180(F.col("clon")), F.col("clat"))
    row, col = geo.cell_of(x, y, transform)
    pixel_km = G.PIXEL_M / 1000
    placed = craters.select("crater", row.alias("crow"), col.alias("ccol"), (F.col("diam_km") / 2 / pixel_km).alias("radius"), F.greatest(F.lit(20), F.floor(F.col("diam_km") * (context / 2 / pixel_km))).alias("half"))
    lit = raster.bright_blue_disk(pixels, placed, "crater", "radius", bright, blue, least=25, clip=True)
    enough = raster.bright_blue_disk(pixels, placed, "crater", "radius", 0.0, 0.0, least=25, clip=True).select("crater").distinct()
    px, py = geo.project(geo.wrap_above_180(F.col("lon_center")), F.col("lat_center"))
    r, c = geo.cell_of(px, py, transform)
    block = 512
    spread = placed.join(enough, "crater", "left_semi").withColumn("__b", F.explode(F.sequence(F.floor((F.col("crow") - F.col("half")) / block), F.floor((F.col("crow") + F.col("half")) / block))))
    points = geometry.select("ref_id", "obs_id", F.col("lat_center").alias("lat"), F.col("lon_center").alias("lon"), r.alias("row"), c.alias("col")).withColumn("__b", F.floor(F.col("row") / block))
    inside = (F.col("row") >= F.col("crow") - F.col("half")) & (F.col("row") < F.col("crow") + F.col("half")) & (F.col("col") >= F.col("ccol") - F.col("half")) & (F.col("col") < F.col("ccol") + F.col("half"))
    found = points.join(spread, "__b").where(inside)
    flagged = found.join(lit.withColumn("on_hollow", F.lit(True)), ["crater", "row", "col"], "left")
    return flagged.select("crater", "ref_id", "obs_id", "lat", "lon", F.coalesce("on_hollow", F.lit(False)).alias("on_hollow"))




def mosaic_statistics(pixels: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """Per band mean, population deviation and exact median over valid pixels, with its wavelength."""
    long = pixels.where(is_valid_pixel(F.col(spectrum))).select(F.posexplode(spectrum).alias("band", "y"))
    out = long.groupBy("band").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std")).join(quantiles(long, ["band"], {"y": {"median": 0.5}}), "band")
    return out.select("band", "mean", "median", "std").withColumn("wavelength_nm", G.GRID_START + G.GRID_STEP * F.col("band"))


def sampled_statistics(pixels: DataFrame, window: str, key: str, per_window: int, seed: int = 42, spectrum: str = "spectrum") -> DataFrame:
    """As ``mosaic_statistics``, but medians are those of a sample: at most ``per_window`` valid pixels of each window, without replacement."""
    some = sample_each(pixels.where(is_valid_pixel(F.col(spectrum))), window, key, per_window, seed).select(F.posexplode(spectrum).alias("band", "y"))
    middle = quantiles(some, ["band"], {"y": {"median": 0.5}}, count="n_sampled")
    long = pixels.where(is_valid_pixel(F.col(spectrum))).select(F.posexplode(spectrum).alias("band", "y"))
    out = long.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std")).join(middle, "band")
    return out.withColumn("wavelength_nm", G.GRID_START + G.GRID_STEP * F.col("band"))


def red_slope_percent(statistics: DataFrame, low: float = 750.0, high: float = 1450.0) -> DataFrame:
    """Relative rise of the median spectrum between two wavelengths, in per cent."""
    at = lambda w: F.max(F.when(F.col("wavelength_nm") == w, F.col("median")))
    return statistics.agg((100 * (F.try_divide(at(high), at(low)) - 1)).alias("red_slope_pct"))


