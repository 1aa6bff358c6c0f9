"""One query per operator of the engine, over the driver's tables. Values are rounded to six places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import grid as G
from ..functions import geo, resample
from ..functions import spectral as S
from ..functions import strings
from ..functions.arrays import common_support, guarded_ratio, is_valid_pixel
from ..operators import checks, joins, knn, metrics, quality, raster, simulate, splits
from ..operators import layer as layers
from ..operators.model import Perceptron, apply_model
from ..operators.order_stats import quantiles
from . import tables as T


def r6(value: Column | str, name: str | None = None) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    out = F.round(value, 6) + F.lit(0.0)
    return out.alias(name) if name else out


def rounded(frame: DataFrame) -> DataFrame:
    """Doubles to six places, integers to BIGINT."""
    cast = {c: r6(c) if k == "double" else F.col(c).cast("long") for c, k in frame.dtypes if k in ("double", "int", "bigint")}
    return frame.withColumns(cast)


# ---- spectra ----


def sam_by_group(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: pair spectra, take angles, summarise per group."""
    angles = T.pairs(spark, d).select("label", S.angle_deg(F.col("predicted"), F.col("target")).alias("sam"))
    return rounded(metrics.group_angles(angles, "label").orderBy("label"))


def sam_median_of_medians(spark: SparkSession, d: str) -> DataFrame:
    angles = T.pairs(spark, d).select("label", S.angle_deg(F.col("predicted"), F.col("target")).alias("sam"))
    return rounded(metrics.median_of_medians(metrics.group_angles(angles, "label")))


def sga_scm_sid(spark: SparkSession, d: str) -> DataFrame:
    p, t = F.col("predicted"), F.col("target")
    return rounded(T.pairs(spark, d).select("vec_id", S.gradient_angle_deg(p, t).alias("sga"), S.correlation_angle_deg(p, t).alias("scm"), S.information_divergence(p, t).alias("sid")))


def _panel(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    y = T.read(spark, d, "embeddings").select("vec_id", T.wide_spectrum(F.col("embedding")).alias("y"))
    panel = S.parameters(F.col("y"))
    return y.select("vec_id", *((F.round(panel[n] * 1e6, 3) + 0.0).alias(n) for n in names))


LINEAR = [*G.REFLECTANCES, "ci_310_390", "ci_415_750", "ci_750_415", "ci_750_950", "ratio_430_1000", "vis_slope", "nir_slope", "vn_slope", "uv_slope"]
FITTED = ["curvature", "uv_downturn", "uv_depth"]


def refl_slope_params(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d, LINEAR)


def poly2_curvature(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d, FITTED)


def bandpass_synthesis(spark: SparkSession, d: str) -> DataFrame:
    y = T.read(spark, d, "embeddings").select("vec_id", T.wide_spectrum(F.col("embedding")).alias("y"))
    return rounded(y.select("vec_id", F.posexplode(S.synthesise_bands(F.col("y"))).alias("band", "value")))


def band_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Affine fit of each synthesised band of the next spectrum on that of this one."""
    p = T.pairs(spark, d, wide=True)
    both = F.arrays_zip(S.synthesise_bands(F.col("target")).alias("x"), S.synthesise_bands(F.col("predicted")).alias("y"))
    long = p.select(F.posexplode(both).alias("band", "v")).select("band", "v.x", "v.y")
    return rounded(metrics.affine_calibration(long, "band"))


def per_band_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_band(metrics.bands_long(T.pairs(spark, d), [], "target", "predicted")))


def band_summary(spark: SparkSession, d: str) -> DataFrame:
    long = T.read(spark, d, "embeddings").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("band", "y"))
    middle = quantiles(long, ["band"], {"y": {"median": 0.5, "p95": 0.95}})
    return rounded(long.groupBy("band").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std")).join(middle, "band"))


def hf_noise(spark: SparkSession, d: str) -> DataFrame:
    y = T.read(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("y"))
    return rounded(metrics.second_difference_noise(y, "y"))


def metric_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.cell_errors(metrics.bands_long(T.pairs(spark, d), ["label"], "target", "predicted"), "label"))


def metric_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.metric_panel(T.pairs(spark, d, wide=True), "vec_id", "target", "predicted"))


def param_fidelity(spark: SparkSession, d: str) -> DataFrame:
    params = metrics.parameters_long(T.pairs(spark, d, wide=True), "vec_id", "target", "predicted")
    fidelity = metrics.parameter_fidelity(params)
    scale = F.lit(1e6)
    return fidelity.select("param", r6("pearson_r", "pearson_r"), r6("slope", "slope"), r6("ccc", "ccc"), (F.round(F.col("bias") * scale, 3) + 0.0).alias("bias"), (F.round(F.col("median_target") * scale, 3) + 0.0).alias("median_target"))


def mse_two_ways(spark: SparkSession, d: str) -> DataFrame:
    """Cells beyond 1 count as missing, so the mean over cells and the mean of row means differ."""
    nan = F.lit(float("nan"))
    gappy = T.pairs(spark, d).withColumn("target", F.transform("target", lambda x: F.when(x > 0.1, nan).otherwise(x)))
    rows = metrics.mean_row_mse(gappy, "target", "predicted")
    return rounded(metrics.global_mse(metrics.bands_long(gappy, [], "target", "predicted")).join(rows, how="cross"))


def coverage_common_support(spark: SparkSession, d: str) -> DataFrame:
    nan = F.lit(float("nan"))
    cut = lambda c: F.transform(c, lambda x: F.when(x > 0.1, nan).otherwise(x))
    a, b = common_support(cut(F.col("target")), cut(F.col("predicted")))
    return rounded(T.pairs(spark, d).select("vec_id", S.coverage(cut(F.col("target"))).alias("own"), S.coverage(a).alias("common_a"), S.coverage(b).alias("common_b")))


def ccc_per_group(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("value"), F.col("value") * 0.5 + F.col("event_id") % 7
    return rounded(T.read(spark, d, "events").groupBy("event_type").agg(metrics.pearson(x, y).alias("r"), metrics.ols_slope(x, y).alias("slope"), metrics.concordance(x, y).alias("ccc")))


def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.correlation_matrix(T.read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


def affine_by_flag(spark: SparkSession, d: str) -> DataFrame:
    long = T.read(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(metrics.affine_calibration(long, "l_returnflag"))


def log_log_slope(spark: SparkSession, d: str) -> DataFrame:
    return rounded(checks.log_log_slope(T.read(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


def scale_grid_argmin(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    frame = T.read(spark, d, "events").select("event_type", (v + 1).alias("anchor"), (v * 0.3 + 0.2).alias("residual"), F.lit(1.0).alias("gate"), (F.col("user_id") % 2 == 0).alias("inside"), (v * F.when(F.col("user_id") % 2 == 0, 1.05).otherwise(1.0) + 1).alias("measured"))
    return rounded(metrics.scale_star(frame, "event_type", "measured", "anchor", "residual", "gate", "inside", top=1.0, step=0.05))


def leave_one_out_scale(spark: SparkSession, d: str) -> DataFrame:
    stars = T.read(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("s_star"))
    return rounded(metrics.leave_one_out(stars, "event_type"))


def cumulative_variance(spark: SparkSession, d: str) -> DataFrame:
    """Running share of the bands' summed squares, largest first."""
    from pyspark.sql.window import Window

    power = T.read(spark, d, "embeddings").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("band", "y")).groupBy("band").agg(F.sum(F.col("y") * F.col("y")).alias("power"))
    order = Window.orderBy(F.desc("power"), "band")  # one row per band
    total = F.sum("power").over(Window.partitionBy())
    return rounded(power.select("band", (F.sum("power").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("cumulative")))


# ---- neighbours ----


def _near(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    vectors = T.read(spark, d, "embeddings")
    return knn.neighbours(vectors, vectors, "vec_id", "embedding", k), vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("y"))


def knn_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_near(spark, d, 5)[0])


def knn_cross(spark: SparkSession, d: str) -> DataFrame:
    """Queries of one half against the other half."""
    vectors = T.read(spark, d, "embeddings")
    return rounded(knn.neighbours(vectors.where("label < 5"), vectors.where("label >= 5"), "vec_id", "embedding", 3, drop_same=False))


def knn_floor(spark: SparkSession, d: str) -> DataFrame:
    near, vectors = _near(spark, d, 5)
    return rounded(knn.variance_floor(near, vectors, "vec_id", "y"))


def knn_angle_floor(spark: SparkSession, d: str) -> DataFrame:
    near, vectors = _near(spark, d, 5)
    return rounded(knn.angle_floor(near, vectors, "vec_id", "y"))


def nn_reliability(spark: SparkSession, d: str) -> DataFrame:
    near, _ = _near(spark, d, 1)
    first = T.pairs(spark, d).select("vec_id", F.explode(F.array(*(F.struct(F.lit(f"b{k:02d}").alias("param"), F.get("target", k).alias("target"), F.get("predicted", k).alias("predicted")) for k in (0, 15, 31, 47, 63)))).alias("r")).select("vec_id", "r.*")
    return rounded(knn.reliability(near, first, "vec_id", "target", "predicted"))


def floor_variants(spark: SparkSession, d: str) -> DataFrame:
    """Floors in four neighbourhoods: all vectors or the other labels' ones, by vector or by (lon, lat) in degrees."""
    vectors = T.read(spark, d, "embeddings").withColumn("y", F.col("embedding").cast("array<double>")).withColumn("place", F.array(F.col("vec_id") * 137.508 % 360.0 - 180.0, F.col("vec_id") * 61.803 % 160.0 - 80.0))
    out = None
    for space, column in (("input", "embedding"), ("lonlat_euclid", "place")):
        for side, reference in (("all", vectors), ("train", vectors.where("label >= 2"))):
            near = knn.neighbours(vectors.where("label < 2"), reference, "vec_id", column, 5)
            one = knn.variance_floor(near, vectors, "vec_id", "y").select(F.lit(f"{space}_{side}").alias("neighbourhood"), "floor")
            out = one if out is None else out.unionByName(one)
    return rounded(out)


# ---- filters ----


def _by_flag(frame: DataFrame) -> DataFrame:
    return rounded(frame.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")))


def strict_quality(spark: SparkSession, d: str) -> DataFrame:
    return _by_flag(quality.strict_quality(T.quality_rows(spark, d)))


def inverted_quality(spark: SparkSession, d: str) -> DataFrame:
    return _by_flag(quality.inverted_quality(T.quality_rows(spark, d)))


def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.nan_to_null(T.quality_rows(spark, d), "q1")
    return rounded(quality.pass_rates(rows, {"q1": F.col("q1").between(0.9, 1.1), "q2": F.abs("q2") < 5, "q3": F.col("q3") > 80, "q4": F.col("q4") > 95, "strict": quality.strict_rule()}))


def group_percentile_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = T.read(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    gated = quality.percentile_gate(rows, "l_suppkey", {"l_quantity": 0.82, "l_extendedprice": 0.65})
    return rounded(gated.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("price")))


def bb_zscore_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = T.read(spark, d, "lineitem").withColumn("ratio", guarded_ratio(F.col("l_discount"), F.col("l_tax")))
    m = quality.zscore_reference(rows, F.col("l_quantity"), F.col("ratio")).first()
    gated = rows.where(quality.zscore_gate(F.col("l_quantity"), F.col("ratio"), tuple(m)))
    return _by_flag(gated)


def visible_floor(spark: SparkSession, d: str) -> DataFrame:
    vectors = T.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("bands"))
    return quality.above_visible_floor(vectors, "bands").select("vec_id")


def valid_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels with a nodata value in place of small ones."""
    bands = F.array(F.when(F.col("value") < 10, F.lit(-3.4e38)).otherwise(F.col("value")), F.col("value"))
    return rounded(T.read(spark, d, "events").select("event_type", is_valid_pixel(bands).alias("valid")).groupBy("event_type").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid")))


def terrain_case(spark: SparkSession, d: str) -> DataFrame:
    rows = T.read(spark, d, "lineitem").select(quality.terrain_class(F.when(F.col("l_linenumber") != 5, F.col("l_linenumber") % 2), F.col("l_suppkey") % 2).alias("terrain"), F.col("l_extendedprice").alias("sam"))
    return rounded(metrics.group_angles(rows, "terrain").orderBy("terrain"))


def first_n_groups(spark: SparkSession, d: str) -> DataFrame:
    orders = T.read(spark, d, "orders")
    return rounded(joins.first_groups(orders, "o_custkey", "o_orderkey", 25).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")))


# ---- joins ----


def three_way_join(spark: SparkSession, d: str) -> DataFrame:
    items, orders, customers = (T.read(spark, d, n) for n in ("lineitem", "orders", "customer"))
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rounded(joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")))


def left_attr_join(spark: SparkSession, d: str) -> DataFrame:
    joined = joins.left_attributes(T.read(spark, d, "documents").select("doc_id", "lang"), T.read(spark, d, "labels"), "doc_id")
    return rounded(joined.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_labelled"), F.sum("quality").alias("n_good")))


def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return rounded(joins.semi(T.read(spark, d, "documents"), T.read(spark, d, "labels"), "doc_id").select("doc_id", "n_chars"))


def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return rounded(joins.anti(T.read(spark, d, "documents"), T.read(spark, d, "labels"), "doc_id").select("doc_id", "n_chars"))


def mark_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.mark(T.read(spark, d, "documents").select("doc_id"), T.read(spark, d, "labels"), "doc_id", "labelled")


def key_order_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = T.read(spark, d, "nation").select(((F.col("n_nationkey") * 7 + 3) % 25).cast("int").alias("n_nationkey"), F.col("n_nationkey").cast("long").alias("position"))
    return rounded(joins.in_key_order(keys, T.read(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", "position"))


def distance_join_nearest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(joins.nearest_within(T.places(spark, d), T.centres(spark, d), 300.0, "c_custkey", "s_suppkey"))


def distance_join_all(spark: SparkSession, d: str) -> DataFrame:
    found = joins.within_distance(T.places(spark, d), T.centres(spark, d), 120.0)
    return rounded(found.select("c_custkey", "s_suppkey", "distance_km"))


def held_out_anti(spark: SparkSession, d: str) -> DataFrame:
    return rounded(joins.outside_all(T.places(spark, d), T.centres(spark, d), "c_custkey").select("c_custkey"))


def nearest_background(spark: SparkSession, d: str) -> DataFrame:
    return rounded(joins.nearest(T.places(spark, d), T.centres(spark, d), "c_custkey", "s_suppkey"))


# ---- sets, splits, arms ----


def id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, difference, intersection and distinct sizes of two id sets."""
    a = T.read(spark, d, "documents").select("doc_id")
    b = T.read(spark, d, "labels").select("doc_id")
    size = lambda f, n: f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("op"), "n")
    return checks.report(size(a.union(b).distinct(), "union"), size(a.exceptAll(b).distinct(), "difference"), size(a.intersect(b), "intersection"), size(a.unionByName(b), "union_all"))


def group_split(spark: SparkSession, d: str) -> DataFrame:
    return rounded(splits.group_split(T.read(spark, d, "events").select("event_id", "user_id"), "user_id").select("event_id", "split"))


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(splits.split_counts(splits.group_split(T.read(spark, d, "events"), "user_id"), "user_id"))


def split_leak_check(spark: SparkSession, d: str) -> DataFrame:
    return rounded(splits.split_leaks(splits.group_split(T.read(spark, d, "events"), "user_id"), "user_id"))


def union_arms_mix(spark: SparkSession, d: str) -> DataFrame:
    three = simulate.arms(T.pairs(spark, d), {"y": "target"}, {"y": "predicted"})
    return rounded(three.select("vec_id", "arm", F.get("y", 0).alias("first"), F.aggregate("y", F.lit(0.0), lambda s, x: s + x).alias("total")))


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users")).orderBy("event_type"))


# ---- strings, geometry ----


def label_strings(spark: SparkSession, d: str) -> DataFrame:
    n = T.read(spark, d, "nation").select("n_nationkey", "n_name")
    label = F.when(F.col("n_nationkey") % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("band "), (F.col("n_nationkey") * 5 + 300).cast("string"), F.lit(".5 nm")))
    wl = strings.wavelength_of(label, F.col("n_nationkey") + 1)
    return rounded(n.select("n_nationkey", wl.alias("wavelength"), strings.band_label(wl).alias("shown"), strings.fingerprint(F.col("n_name").cast("binary")).alias("print")))


def list_literals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    text = F.when(k % 4 == 0, F.lit("[1.5, oops]")).otherwise(F.concat(F.lit("["), k.cast("string"), F.lit(".25, "), (k * 2).cast("string"), F.lit("]")))
    read = strings.parse_list(text)
    return rounded(T.read(spark, d, "nation").select("n_nationkey", F.get(read, 0).alias("first"), F.size(read).alias("n"))).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


def wkt_rings(spark: SparkSession, d: str) -> DataFrame:
    """Rings of generated WKT with an unclosed outline and a hole; areas in squared degrees and km2."""
    k = F.col("n_nationkey")
    at = lambda dx, dy: F.concat((k * 3 + dx).cast("string"), F.lit(" "), (k + dy).cast("string"))
    text = F.concat(F.lit("polygon (("), at(0, 0), F.lit(", "), at(4, 0), F.lit(", "), at(4, 3), F.lit(", "), at(0, 3), F.lit("), ("), at(1, 1), F.lit(", "), at(2, 1), F.lit(", "), at(2, 2), F.lit("))"))
    rings = T.read(spark, d, "nation").select("n_nationkey", F.posexplode(geo.wkt_rings(text)).alias("ring_no", "ring"))
    return rounded(rings.select("n_nationkey", "ring_no", geo.ring_area(F.col("ring")).alias("area"), geo.ring_area_km2(F.col("ring")).alias("area_km2"), geo.ring_centroid_y(F.col("ring")).alias("centroid_y"), geo.lon_span(F.col("ring")).alias("span")))


def geodesic_disks(spark: SparkSession, d: str) -> DataFrame:
    ring = geo.geodesic_disk(F.col("clon"), F.col("clat"), F.col("radius_km"), 8)
    rows = T.centres(spark, d).select("s_suppkey", F.posexplode(ring).alias("vertex", "p"))
    return rounded(rows.select("s_suppkey", "vertex", F.col("p.x").alias("x"), F.col("p.y").alias("y")))


def longitude_wraps(spark: SparkSession, d: str) -> DataFrame:
    lon = (F.col("n_nationkey") * 30).cast("double") - 190.0
    return rounded(T.read(spark, d, "nation").select("n_nationkey", geo.wrap_half_open(lon).alias("half_open"), geo.wrap_above_180(lon).alias("above_180")))


UNIT = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def cells_and_rasterise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.rasterise_windows(T.shapes(spark, d), "ring", UNIT, T.WIDTH, T.WIDTH))


def zonal_mean_centres(spark: SparkSession, d: str) -> DataFrame:
    cells = raster.rasterise_windows(T.shapes(spark, d), "ring", UNIT, T.WIDTH, T.WIDTH, "n_nationkey")
    return rounded(cells.join(T.pixels(spark, d), ["row", "col"]).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


def window_grid_sample(spark: SparkSession, d: str) -> DataFrame:
    corners = raster.window_grid(T.height(spark, d), T.WIDTH, 3, 10)
    return rounded(raster.in_windows(T.pixels(spark, d), corners, 10).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


def decimated(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.decimate(T.pixels(spark, d), 16).select("row", "col", "value"))


# ---- layers ----


def sparse_layer_apply(spark: SparkSession, d: str) -> DataFrame:
    out = layers.rewrite(T.pixels(spark, d), T.layer(spark, d), T.MODES)
    return rounded(out.select("row", "col", *(F.get("spectrum", k).alias(f"s{k}") for k in range(3))))


def layer_lookup(spark: SparkSession, d: str) -> DataFrame:
    hit = layers.gate_at(T.pixels(spark, d), T.layer(spark, d)).withColumn("g", F.col("g").cast("double"))
    return rounded(hit.groupBy("row").agg(F.sum("g").alias("g")))


def layer_audit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(layers.audit(T.pixels(spark, d), T.layer(spark, d), T.MODES, wavelength=300.0))


def layer_tiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(layers.tiles(T.layer(spark, d), 16, 32))


def layer_verify(spark: SparkSession, d: str) -> DataFrame:
    before, layer = T.pixels(spark, d), T.layer(spark, d)
    return rounded(layers.verify(before, layers.rewrite(before, layer, T.MODES), layer, T.MODES))


def selection_stats(spark: SparkSession, d: str) -> DataFrame:
    found = T.pixels(spark, d).select((F.col("value") > 10).alias("valid"), ((F.col("value") > 10) & (F.col("col") < 30)).alias("chosen"))
    return rounded(layers.selection_stats(found, T.height(spark, d), T.WIDTH))


def checks_report(spark: SparkSession, d: str) -> DataFrame:
    docs, items = T.read(spark, d, "documents"), T.read(spark, d, "lineitem")
    return checks.report(
        checks.in_range(items, "l_discount", 0.0, 0.1, "discount range"), checks.unique_key(docs, "doc_id", "document ids"),
        checks.unique_key(items, "l_orderkey", "order ids repeat"), checks.has_columns(docs, ["doc_id", "absent"], "columns"),
    ).select("name", "ok")


# ---- vectorised Python: no SQL; tests hold them against NumPy ----


def lsf_resample(spark: SparkSession, d: str) -> DataFrame:
    """Ragged spectra from vectors at irregular wavelengths, linear and Gaussian."""
    e = F.col("embedding").cast("array<double>")
    waves = F.transform(e, lambda x, k: F.lit(300.0) + k * 18.3 + x)
    y = T.read(spark, d, "embeddings").select("vec_id", waves.alias("w"), e.alias("v"))
    return y.select("vec_id", resample.resample_linear(F.col("w"), F.col("v")).alias("naive"), resample.resample_gaussian(F.col("w"), F.col("v"), 7.0).alias("lsf_7p0"))


def keyed_noise(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "embeddings").select("vec_id", resample.keyed_noise(F.col("vec_id"), F.lit(1)).alias("noise"))


def mlp_apply(spark: SparkSession, d: str) -> DataFrame:
    x = T.read(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 9).alias("x"))
    return apply_model(x, Perceptron.fresh([9, 128, 256, 256, 231]), "x", "spectrum").select("vec_id", "spectrum")


def gram_basis(spark: SparkSession, d: str) -> DataFrame:
    modes, _ = metrics.spectral_basis(T.pairs(spark, d).select(F.zip_with("target", "predicted", lambda a, b: a - b).alias("r")), "r")
    return spark.createDataFrame([(k, *(float(m[k]) for m in modes)) for k in range(len(modes[0]))], "band int, b0 double, b1 double")


def zonal_mean_touched(spark: SparkSession, d: str) -> DataFrame:
    return raster.zonal_mean(T.shapes(spark, d), "n_nationkey", "ring", T.pixels(spark, d), "spectrum", UNIT, T.WIDTH, T.WIDTH)


def simulated_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Three arms per vector with its nearest background among the vectors of other labels."""
    y = T.read(spark, d, "embeddings").select("vec_id", "label", T.wide_spectrum(F.col("embedding")).alias("y"), (F.col("vec_id") * 137.508 % 360.0 - 180.0).alias("lon"), (F.col("vec_id") * 61.803 % 160.0 - 80.0).alias("lat"))
    pool = y.where("label < 3").select(F.col("vec_id").alias("ref_id"), "lon", "lat", F.col("y").alias("naive"), F.col("y").alias("target"), F.lit(5.0).alias("mdis_image_count"))
    back = y.where("label >= 3").select(F.col("vec_id").alias("bg_id"), F.col("lon").alias("blon"), F.col("lat").alias("blat"), F.col("y").alias("bg_naive"), F.col("y").alias("bg_target"))
    calibration = [{"slope": 1.0, "offset": 0.0, "resid_std": 0.001}] * len(G.BANDS)
    return simulate.simulate_pairs(pool, back, calibration, 0.5)


QUERIES = [
    sam_by_group, sam_median_of_medians, sga_scm_sid, refl_slope_params, poly2_curvature, bandpass_synthesis, band_calibration, per_band_stats, band_summary, hf_noise,
    metric_errors, metric_panel, param_fidelity, mse_two_ways, coverage_common_support, ccc_per_group, corr_matrix, affine_by_flag, log_log_slope, scale_grid_argmin, leave_one_out_scale, cumulative_variance,
    knn_neighbours, knn_cross, knn_floor, knn_angle_floor, nn_reliability, floor_variants,
    strict_quality, inverted_quality, pass_rates, group_percentile_gate, bb_zscore_gate, visible_floor, valid_pixels, terrain_case, first_n_groups,
    three_way_join, left_attr_join, semi_join, anti_join, mark_join, key_order_lookup, distance_join_nearest, distance_join_all, held_out_anti, nearest_background,
    id_sets, group_split, split_counts, split_leak_check, union_arms_mix, value_counts,
    label_strings, list_literals, wkt_rings, geodesic_disks, longitude_wraps, cells_and_rasterise, zonal_mean_centres, window_grid_sample, decimated,
    sparse_layer_apply, layer_lookup, layer_audit, layer_tiles, layer_verify, selection_stats, checks_report,
    lsf_resample, keyed_noise, mlp_apply, gram_basis, zonal_mean_touched, simulated_pairs,
]
