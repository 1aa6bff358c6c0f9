"""More queries over the driver's tables: predicates, projections, files, polygons, models and audits."""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import grid as G
from ..functions import geo, strings
from ..functions import spectral as S
from ..functions.arrays import all_finite, arg_nearest, clipped_ratio, guarded_ratio, nodata_to_nan
from ..functions.resample import interpolate_table
from ..operators import checks, metrics, raster, splits
from ..operators import layer as layers
from ..operators import model as M
from ..sources import raster as R
from ..sources import schemas, sinks, tables
from . import pipelines
from . import tables as T
from .lineage import shared_folder
from .queries import UNIT, rounded

#: Pixel grid over the whole sphere: 100 columns of 3.6 degrees, 100 rows of 1.6 degrees from +80 down.
DEGREE = math.pi / 180 * G.RADIUS_M
GLOBE = (3.6 * DEGREE, 0.0, -180 * DEGREE, 0.0, -1.6 * DEGREE, 80 * DEGREE)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- predicates and projections ----


def nodata_masking(spark: SparkSession, d: str) -> DataFrame:
    """Missing values of two kinds in three bands: masked cells and complete rows per type."""
    v = F.col("value")
    bands = F.array(v, F.when(F.col("user_id") % 7 == 0, F.lit(-3.4e38)).otherwise(v * 2), F.when(F.col("user_id") % 5 == 0, F.lit(float("nan"))).otherwise(v + 1))
    seen = T.read(spark, d, "events").select("event_type", nodata_to_nan(bands).alias("b"))
    return rounded(seen.groupBy("event_type").agg(F.sum(F.size(F.filter("b", lambda x: F.isnan(x)))).alias("n_masked"), F.count_if(all_finite(F.col("b"))).alias("n_complete")))


def split_selection(spark: SparkSession, d: str) -> DataFrame:
    train, held, test = splits.select_splits(splits.group_split(T.read(spark, d, "events"), "user_id"))
    size = lambda f, n: f.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(size(train, "train").unionByName(size(held, "validation")).unionByName(size(test, "test")))


def rejected_spectra(spark: SparkSession, d: str) -> DataFrame:
    """Stringified spectra of four kinds, three of them broken."""
    k = F.col("c_custkey")
    y = F.when(k % 4 == 0, F.lit("[0.1]")).when(k % 4 == 1, F.lit("[0.1, 0.2")).otherwise(F.concat(F.lit("["), k.cast("string"), F.lit(", 0.5]")))
    text = T.read(spark, d, "customer").select("c_nationkey", F.when(k % 4 == 3, F.lit("[300.0]")).otherwise(F.lit("[300.0, 305.0]")).alias("w"), y.alias("v"))
    parsed = text.select("c_nationkey", strings.parse_list(F.col("w")).alias("waves"), strings.parse_list(F.col("v")).alias("photom_iof"))
    usable, broken = tables.readable_spectra(parsed)
    a = usable.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_usable"), F.sum(F.get("photom_iof", 0)).alias("total"))
    return rounded(a.join(broken.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_rejected")), "c_nationkey", "full"))


def model_inputs(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "embeddings")
    x = S.model_input(F.col("embedding").cast("array<double>"), (F.col("vec_id") % 11).cast("double"), 3.5, 1.25)
    return rounded(e.select("vec_id", F.size(x).alias("n"), F.get(x, 7).alias("last_band"), F.get(x, 8).alias("count_z")))


def ratio_variants(spark: SparkSession, d: str) -> DataFrame:
    top, bottom = (F.get("embedding", k).cast("double") for k in (0, 1))
    guarded = guarded_ratio(top, bottom)
    out = T.read(spark, d, "embeddings").groupBy("label").agg(F.count_if(F.isnan(guarded)).alias("n_undefined"), F.sum(F.when(~F.isnan(guarded), guarded)).alias("guarded"), F.max(F.abs(clipped_ratio(top, bottom, 0.05))).alias("clipped"))
    return rounded(out)


def band_choices(spark: SparkSession, d: str) -> DataFrame:
    """Bands by position, by slice, by the nearest value."""
    e = T.read(spark, d, "embeddings").withColumn("spectrum", F.col("embedding").cast("array<double>"))
    picked = sinks.band_subset(e, [5, 0, 63], 64).select("vec_id", F.get("spectrum", 0).alias("b5"), F.get("spectrum", 1).alias("b0"), F.get("spectrum", 2).alias("b63"))
    sliced = e.select("vec_id", F.aggregate(F.slice("spectrum", 10, 8), F.lit(0.0), lambda s, x: s + x).alias("slice_sum"), arg_nearest(F.col("spectrum"), 0.1).alias("nearest"))
    return rounded(picked.join(sliced, "vec_id"))


def per_split_errors(spark: SparkSession, d: str) -> DataFrame:
    """The audit of a prediction by split; labels stand for splits."""
    side = F.when(F.col("label") == 0, "test").when(F.col("label") == 1, "fold0").otherwise("fold1")
    frame = T.pairs(spark, d, wide=True).select(F.col("vec_id").alias("ref_id"), F.col("label").cast("string").alias("obs_id"), side.alias("split"), "target", "predicted")
    terrain = frame.select("ref_id", F.lit(1).alias("lrm"), F.lit(0).alias("sm_plain"))
    return rounded(pipelines.evaluate(frame, terrain)["per_split"])


def mask_algebra(spark: SparkSession, d: str) -> DataFrame:
    p = T.pixels(spark, d)
    a, b = p.where("value > 60").select("row", "col"), p.where("col % 3 = 0").select("row", "col")
    size = lambda f, n: f.agg(F.count(F.lit(1)).alias("n"), F.sum("row").alias("rows")).select(F.lit(n).alias("op"), "n", "rows")
    return rounded(size(a.join(b, ["row", "col"], "left_semi"), "intersection").unionByName(size(a.union(b).distinct(), "union")).unionByName(size(a.join(b, ["row", "col"], "left_anti"), "difference")))


def sizes_and_documents(spark: SparkSession, d: str) -> DataFrame:
    """Human sizes, and a struct through JSON and back."""
    n = F.pow(F.lit(7.0), F.col("n_nationkey") % 13).cast("long")
    back = F.from_json(F.to_json(F.struct(n.alias("n"), F.col("n_name").alias("name"))), "n long, name string")
    return rounded(T.read(spark, d, "nation").select("n_nationkey", strings.human_size(n).alias("size"), back["n"].alias("n"), back["name"].alias("name")))


# ---- statistics ----


def standardiser(spark: SparkSession, d: str) -> DataFrame:
    mean, std = M.fit_standardiser(T.read(spark, d, "events"), "value")
    return rounded(spark.createDataFrame([(round(mean, 3), round(std, 3))], "mean double, std double"))


def sampling_mass(spark: SparkSession, d: str) -> DataFrame:
    """The weight at which purchases hold 30 per cent of the mass, and the mass that it gives them."""
    sizes = {r["k"]: r["n"] for r in T.read(spark, d, "lineitem").groupBy((F.col("l_returnflag") == "R").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    w = splits.sampling_weight(sizes.get(False, 0), sizes.get(True, 0), 0.3)
    return rounded(spark.createDataFrame([(w, w * sizes.get(True, 0) / (w * sizes.get(True, 0) + sizes.get(False, 0)))], "weight double, share double"))


def hold_out(spark: SparkSession, d: str) -> DataFrame:
    held = splits.hold_out_groups(T.read(spark, d, "events"), "user_id")
    return rounded(held.groupBy("is_validation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_groups")))


def array_comparison(spark: SparkSession, d: str) -> DataFrame:
    pairs = T.pairs(spark, d)
    near = pairs.select("vec_id", F.transform("target", lambda x: x + 1e-9).alias("target"))
    far = metrics.compare_arrays(pairs, pairs.select("vec_id", F.col("predicted").alias("target")), "vec_id", "target")
    both = metrics.compare_arrays(pairs, near, "vec_id", "target").select(F.lit("near").alias("pair"), "n", "all_close", F.lit(0.0).alias("gap")).unionByName(far.select(F.lit("far").alias("pair"), "n", "all_close", F.col("max_abs_diff").alias("gap")))
    return rounded(both)


def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.compare_models(T.pairs(spark, d), "target", "predicted", "vec_id"))


def mosaic_bands(spark: SparkSession, d: str) -> DataFrame:
    """Band statistics of a raster of 231 bands."""
    p = T.read(spark, d, "embeddings").select("vec_id", T.wide_spectrum(F.col("embedding")).alias("spectrum"))
    return rounded(pipelines.mosaic_statistics(p).select("band", "wavelength_nm", "mean", "std", "median"))


def red_slope(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "embeddings").select("vec_id", T.wide_spectrum(F.col("embedding")).alias("spectrum"))
    return rounded(pipelines.red_slope_percent(pipelines.mosaic_statistics(p)))


def gram_cells(spark: SparkSession, d: str) -> DataFrame:
    residual = T.pairs(spark, d).select(F.zip_with("target", "predicted", lambda a, b: a - b).alias("r"))
    return rounded(metrics.gram_matrix(residual, "r"))


def table_to_grid(spark: SparkSession, d: str) -> DataFrame:
    """A table of twelve points interpolated to the grid; constant beyond its ends."""
    points = T.read(spark, d, "nation").where("n_nationkey < 12").select((F.col("n_nationkey") * 97.0 + 310.0).alias("wavelength_nm"), (F.col("n_nationkey") * F.col("n_regionkey") + 1.0).alias("mean"))
    return rounded(interpolate_table(points, "wavelength_nm", "mean"))


def spread_of_pixels(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    pixels = T.pixels(spark, d).select("row", "col", F.array(v * 0.6 + F.col("col"), v, v, v, F.when(v > 5, v).otherwise(F.lit(-1.0))).alias("bands"))
    return rounded(layers.spread_audit(pixels, (50.0, 25.0, 1.2, 0.5)))


def disk_gate(spark: SparkSession, d: str) -> DataFrame:
    """Pixels in the disks around the suppliers' cells that reach the disk's percentiles of brightness and blue ratio."""
    v = F.col("value")
    pixels = T.pixels(spark, d).select("row", "col", F.array(v * (F.col("col") * 0.01 + 0.6), v, v, v, v + 1, v, v, v).alias("bands"))
    centres = T.read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 31 % 100).alias("crow"), (F.col("s_suppkey") * 17 % 100).alias("ccol"), (F.col("s_suppkey") % 5 + 2.5).alias("radius"))
    return rounded(raster.bright_blue_disk(pixels, centres, "s_suppkey", "radius", 82.0, 65.0).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("row").alias("rows"), F.sum("col").alias("cols")))


# ---- places and polygons ----


def disk_radii_and_centres(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = geo.cell_centre(k % 100, k % 77, GLOBE)
    return rounded(T.read(spark, d, "supplier").select("s_suppkey", geo.disk_radius_km((k % 50).cast("double")).alias("radius_km"), (x / DEGREE).alias("lon"), (y / DEGREE).alias("lat")))


def point_sample(spark: SparkSession, d: str) -> DataFrame:
    """The pixel under each customer, and whether its cell is in a mask."""
    pixels = T.pixels(spark, d).select("row", "col", "value")
    seen = raster.sample_points(T.places(spark, d), "lon", "lat", pixels, GLOBE)
    marked = raster.flag_points(T.places(spark, d), "lon", "lat", pixels.where("value > 60"), GLOBE, "bright")
    return rounded(seen.select("c_custkey", "row", "col", "value").join(marked.select("c_custkey", "bright"), "c_custkey"))


def window_around(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.around(T.pixels(spark, d), 40.0, 10.0, 25.0, GLOBE).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("row").alias("top"), F.max("col").alias("right")))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = (k * 37 % 80).cast("double") + 0.3, (k * 53 % 80).cast("double") + 0.2
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return T.read(spark, d, "nation").select("n_nationkey", F.array(corner(0.0, 0.0), corner(6.4, 0.0), corner(6.4, 3.1), corner(0.0, 3.1)).alias("ring"))


def zonal_mean_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Means over all touched pixels of upright boxes."""
    out = raster.zonal_mean(_boxes(spark, d), "n_nationkey", "ring", T.pixels(spark, d), "spectrum", UNIT, T.WIDTH, T.WIDTH)
    return rounded(out.select("n_nationkey", *(F.get("spectrum", k).alias(f"b{k}") for k in range(3))))


def dilated_boxes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.rasterise(_boxes(spark, d), "ring", UNIT, T.WIDTH, T.WIDTH, 1.25))


def seam_split(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of 20 degrees, some across the seam: pieces and their area."""
    k = F.col("n_nationkey")
    x, y = k * 15.0 - 190.0, k * 1.0 - 10.0
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(20.0, 0.0), corner(20.0, 5.0), corner(0.0, 5.0))
    pieces = T.read(spark, d, "nation").select("n_nationkey", F.explode(raster.seam_pieces(ring)).alias("p"))
    return rounded(pieces.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(geo.ring_area(F.col("p"))).alias("area")))


def polygon_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue counts: too large, across the seam, crossing themselves, kept."""
    k = F.col("c_custkey")
    point = lambda x, y: F.concat(x.cast("string"), F.lit(" "), y.cast("string"))
    box = lambda w: F.concat(F.lit("POLYGON (("), point(k % 90, F.lit(0)), F.lit(", "), point(k % 90 + w, F.lit(0)), F.lit(", "), point(k % 90 + w, F.lit(w)), F.lit(", "), point(k % 90, F.lit(w)), F.lit("))"))
    tie = F.concat(F.lit("POLYGON (("), point(k % 90, F.lit(0)), F.lit(", "), point(k % 90 + 1, F.lit(1)), F.lit(", "), point(k % 90 + 1, F.lit(0)), F.lit(", "), point(k % 90, F.lit(1)), F.lit("))"))
    wide = F.lit("POLYGON ((170 0, 190 0, 190 1, 170 1))")
    text = F.when(k % 5 == 0, box(3)).when(k % 5 == 1, tie).when(k % 5 == 2, wide).when(k % 5 == 3, F.lit(None)).otherwise(box(0.1))
    return rounded(raster.clean_catalogue(T.read(spark, d, "customer").select(text.alias("wkt")), "wkt")[1])


def footprint_rejection(spark: SparkSession, d: str) -> DataFrame:
    """Projected footprints: dropped where one ring spans over 180 degrees or the parts lie too far apart."""
    k = F.col("n_nationkey")
    ring = lambda a, b: F.concat(F.lit("(("), a.cast("string"), F.lit(" 0, "), b.cast("string"), F.lit(" 0, "), b.cast("string"), F.lit(" 2))"))
    text = F.when(k % 3 == 0, F.concat(F.lit("POLYGON "), ring(k, k + 4))).when(k % 3 == 1, F.concat(F.lit("POLYGON "), ring(k, k + 185))).otherwise(F.concat(F.lit("MULTIPOLYGON ("), ring(-k * 7, -k * 7 + 2), F.lit(", "), ring(k * 7, k * 7 + 2), F.lit(")")))
    rings = T.read(spark, d, "nation").select("n_nationkey", raster.footprint_rings(text).alias("r"))
    first = F.get("r", 0)
    return rounded(rings.select("n_nationkey", F.col("r").isNotNull().alias("kept"), F.when(F.col("r").isNotNull(), F.size("r")).alias("n_rings"), (F.get(first, 1)["x"] / DEGREE).alias("second_lon")))


# ---- models and layers ----

#: Fixed weights of a small network, spelled out in the SQL too.
NET = M.Perceptron([(np.array([[0.5, -1.0], [1.5, 0.25], [-0.75, 2.0]]), np.array([0.1, -0.2])), (np.array([[1.0], [-2.0]]), np.array([0.3]))], "relu")
LINEAR = M.Perceptron([(np.array([[0.1 * (k + 1), -0.05 * k] for k in range(9)]), np.array([0.01, 0.02]))])


def perceptron_rows(spark: SparkSession, d: str) -> DataFrame:
    x = T.read(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 4 > 0, F.slice("embedding", 1, 3)).alias("x"))
    out = M.apply_model(x, NET, "x", "y").select("vec_id", F.get("y", 0).cast("double").alias("y"))
    return out.select("vec_id", F.round("y", 3).alias("y"))


def correction_layer(spark: SparkSession, d: str) -> DataFrame:
    """A layer built from chosen pixels, its statistics beside it."""
    v = F.col("value")
    bands = F.array(v * 0.6 + F.col("col"), v, v, v, v, v, v, v, F.when(F.col("col") % 6 == 0, F.lit(float("nan"))).otherwise(F.lit(4.0)))
    pixels = T.pixels(spark, d).select("row", "col", bands.cast("array<double>").alias("bands"))
    found = layers.candidates(T.pixels(spark, d).where("col < 60").select("row", "col"), pixels, (50.0, 25.0, 1.2, 0.5))
    built = layers.build(found, M.LowRankCorrection(LINEAR, np.eye(2)), 0.4, 3.0, 2.0)
    return rounded(built.groupBy("row").agg(F.count(F.lit(1)).alias("n"))).join(rounded(built.groupBy("row").agg(F.round(F.sum("c0"), 1).alias("c0"), F.round(F.sum("c1"), 1).alias("c1"), F.round(F.max("g").cast("double"), 4).alias("g"))), "row")


# ---- files, written to the shared folder and read again ----


def tiles_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Tiles by row blocks; a row range prunes files."""
    path = _folder(spark, "tiles")
    R.write_tiles(T.pixels(spark, d), path, 16)
    return rounded(R.read_tiles(spark, path, 20, 70, 16).groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max(F.get("spectrum", 1)).alias("top")))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Quality rows through a CSV sidecar with a declared schema, filtered strictly."""
    path = _folder(spark, "sidecar")
    rows = T.quality_rows(spark, d).select(F.monotonically_increasing_id().alias("ref_id"), "q1", "q2", "q3", "q4", F.col("l_returnflag").alias("obs_id"))
    sinks.csv(rows, path)
    from ..operators import quality

    return rounded(quality.strict_quality(tables.sidecar(spark, path, schemas.QUALITY)).groupBy("obs_id").agg(F.count(F.lit(1)).alias("n"), F.sum("q3").alias("q3")))


def parquet_resume(spark: SparkSession, d: str) -> DataFrame:
    """Chunks replaced one by one, the ids that are left, few files, pruned columns."""
    path, one = _folder(spark, "chunks"), _folder(spark, "whole")
    orders = T.read(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 4).alias("chunk"))
    for low in (0, 1):
        sinks.parquet(orders.where(F.col("chunk").isin(low, low + 1)), path, "chunk")
    left = tables.not_yet_done(orders, tables.parquet(spark, path, "o_orderkey"), "o_orderkey")
    n = sinks.consolidate(spark, path, one, 2)
    done = tables.parquet(spark, one, "o_totalprice").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rounded(done.withColumn("n_done", F.lit(n)).withColumn("n_left", F.lit(left.count())))


def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Checks of counts against expected ranges, through a JSON document and back."""
    docs = T.read(spark, d, "documents")
    found = checks.report(checks.check(docs, "some rows", F.count(F.lit(1)) > 0, F.count(F.lit(1))), checks.unique_key(docs, "doc_id", "document ids"))
    rows = json.loads(json.dumps([[r["name"], bool(r["ok"])] for r in found.collect()]))
    return spark.createDataFrame([tuple(r) for r in rows], "name string, ok boolean")


ROW_QUERIES = [
    nodata_masking, split_selection, rejected_spectra, model_inputs, ratio_variants, band_choices, per_split_errors, mask_algebra, sizes_and_documents,
    standardiser, sampling_mass, hold_out, array_comparison, model_comparison, mosaic_bands, red_slope, gram_cells, table_to_grid, spread_of_pixels, disk_gate,
    disk_radii_and_centres, point_sample, window_around, zonal_mean_boxes, dilated_boxes, seam_split, polygon_cleaning, footprint_rejection,
    perceptron_rows, correction_layer, tiles_round_trip, csv_round_trip, parquet_resume, stage_counts,
]
