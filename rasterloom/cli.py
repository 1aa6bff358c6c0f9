"""Command line: registered queries, and every plan of the engine on files.

Tables are Parquet folders, CSV sidecars with declared columns, or tile datasets; a raster may also be a GeoTIFF.
"""

from __future__ import annotations

import argparse
import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grid as G
from .functions import spectral as S
from .operators import layer as layers
from .operators import metrics, model, quality, simulate, splits
from .operators import raster as shapes_on_grid
from .plans import pipelines
from .plans.queries import QUERIES
from .plans.row_queries import ROW_QUERIES
from .plans.search_queries import QUERIES as SEARCHES
from .sources import raster, schemas, sinks, tables


def numbers(text: str) -> tuple:
    return tuple(float(v) for v in text.split(","))


def _named() -> dict:
    return {f.__name__: f for f in [*QUERIES, *ROW_QUERIES, *SEARCHES]}


def _pixels(spark: SparkSession, path: str, rows: tuple | None = None) -> DataFrame:
    if path.endswith((".tif", ".tiff")):
        return raster.read_raster(spark, path, rows=rows)
    return raster.read_tiles(spark, path, *(rows or (None, None)))


def _json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def query(spark: SparkSession, a) -> None:
    """run a registered query over a folder of tables"""
    found = _named()[a.name](spark, a.folder)
    sinks.parquet(found, a.out) if a.out else found.show(50, truncate=False)


def pairs(spark: SparkSession, a) -> None:
    """quality filter, colocation and resampling; a rerun adds only ids that are neither written nor rejected"""
    read = lambda path, schema: tables.sidecar(spark, path, schema)
    good = read(a.quality, schemas.QUALITY)
    if a.limit:
        from .operators.joins import first_groups

        good = first_groups(good.withColumn("at", F.monotonically_increasing_id()), "obs_id", "at", a.limit).drop("at")
    here = [f"{a.out}/{n}" for n in ("pairs", "rejected")]
    again = not a.force and all(os.path.isdir(p) for p in here)
    if again:
        done = spark.read.parquet(here[0]).select("ref_id").union(spark.read.parquet(here[1]).select("ref_id"))
        good = tables.only_ids(good, tables.not_yet_done(good, done))
    found, rejected = pipelines.build_pairs(good, read(a.geometry, schemas.GEOMETRY), read(a.shapes, schemas.SHAPES), tables.spectra(spark, a.spectra), _pixels(spark, a.pixels), a.transform, a.width, a.height)
    for frame, path in ((found, here[0]), (rejected, here[1])):
        sinks.parquet(frame, path, mode="append" if again else "overwrite")


def split(spark: SparkSession, a) -> None:
    """group-wise split of a pairs table"""
    rows = spark.read.parquet(a.pairs).select("ref_id", "obs_id")
    out = splits.group_split(rows, "obs_id", a.test_share, a.folds) if a.seed is None else splits.seeded_group_split(rows, "obs_id", a.seed, a.test_share, a.folds)
    sinks.parquet(out.select("ref_id", "split"), a.out)


def targets(spark: SparkSession, a) -> None:
    """target variants of the pairs; floors and band calibration as CSV"""
    rows = spark.read.parquet(a.pairs)
    if a.build:
        sinks.parquet(pipelines.build_targets(rows, tables.spectra(spark, a.spectra), a.widths), f"{a.out}/targets")
    held = spark.read.parquet(f"{a.out}/targets")
    if a.floor:
        sinks.csv(pipelines.floor_report(rows, held, k=a.k), f"{a.out}/floor")
        sinks.csv(metrics.second_difference_noise(held, "lsf_5p0"), f"{a.out}/noise")
    if a.diag_b:
        both = rows.select("ref_id", "mdis_iof").join(held.select("ref_id", S.synthesise_bands(F.col("lsf_5p0")).alias("syn")), "ref_id")
        long = both.select(F.posexplode(F.arrays_zip("syn", "mdis_iof")).alias("band", "v")).select("band", F.col("v.syn").alias("x"), F.col("v.mdis_iof").alias("y"))
        sinks.csv(metrics.affine_calibration(long, "band"), f"{a.out}/calibration")


def _inputs(frame: DataFrame, mean: float, std: float) -> DataFrame:
    return frame.withColumn("x", S.model_input(F.col("mdis_iof").cast("array<double>"), F.col("mdis_image_count").cast("double"), mean, std).cast("array<float>"))


def train(spark: SparkSession, a) -> None:
    """fit the perceptron on the training folds; weights, the standardiser and the losses"""
    rows = spark.read.parquet(a.pairs).join(spark.read.parquet(a.targets).select("ref_id", F.col(a.target).alias("y")), "ref_id").join(spark.read.parquet(a.splits), "ref_id")
    mean, std = model.fit_standardiser(splits.select_splits(rows)[0], "mdis_image_count")
    fit, held, _ = splits.select_splits(_inputs(rows, mean, std).select("x", "y", "split").where(S.coverage(F.col("y")) > 0))
    net = model.Perceptron.fresh([9, *map(int, a.hidden), G.GRID_SIZE], seed=a.seed)
    net.dropout = a.dropout
    net, losses = model.train(fit, net, validation=held, epochs=a.epochs, rate=a.rate, batch_size=a.batch_size, seed=a.seed)
    os.makedirs(a.out, exist_ok=True)
    net.save(f"{a.out}/model.npz")
    sinks.write_json(f"{a.out}/stats.json", {"image_count_mean": mean, "image_count_std": std, "losses": losses})


def predict(spark: SparkSession, a) -> None:
    """spectra of all valid pixels as tiles, or as one GeoTIFF if --out ends in .tif"""
    stats = _json(a.stats) if a.stats else {"image_count_mean": 0.0, "image_count_std": 1.0}
    roi = [int(v) for v in a.roi] if a.roi else None
    pixels = _pixels(spark, a.pixels, (roi[0], roi[0] + roi[2]) if roi else None)
    if roi:
        pixels = pixels.where(F.col("col").between(roi[1], roi[1] + roi[3] - 1))
    found = model.predict_pixels(pixels, model.Perceptron.load(a.model), stats["image_count_mean"], stats["image_count_std"], with_count=not a.no_count)
    if a.out.endswith(".tif"):
        raster.write_mosaic(found, a.out, a.width, a.height, G.GRID_SIZE, a.transform, labels=[f"{w:.0f} nm" for w in G.wavelengths()])
    else:
        raster.write_tiles(found, a.out)


def evaluate(spark: SparkSession, a) -> None:
    """the audit tables of a prediction table as CSV, and the panel merged into a report"""
    predicted = spark.read.parquet(a.predicted)
    found = pipelines.evaluate(predicted, spark.read.parquet(a.terrain))
    for name, frame in found.items():
        sinks.csv(frame, f"{a.out}/{name}")
    metrics.merge_report(f"{a.out}/report.json", found["panel"].first().asDict() | {"mse": found["global_mse"].first()[0]})


def pool(spark: SparkSession, a) -> None:
    """candidates near group centres, lit by their own disk, over the visible floor"""
    read = lambda path, schema: tables.sidecar(spark, path, schema)
    groups, held = tables.group_catalogue(spark, a.groups), spark.read.parquet(a.held_out)
    geometry = read(a.geometry, schemas.GEOMETRY)
    found, counts = pipelines.candidate_pool(groups, geometry, read(a.quality, schemas.QUALITY), held, a.radius_km)
    if a.check:
        counts.show()
        return
    lit = pipelines.group_hits(found, groups, _pixels(spark, a.pixels), a.transform, a.radius_km)
    bands = spark.read.parquet(a.pairs).select("ref_id", "mdis_iof", "mdis_image_count", "photom_iof_5nm")
    kept = lit.join(bands, "ref_id")
    floor = S.visible_median(F.col("mdis_iof").cast("array<double>"))
    sinks.parquet(kept.where(~F.coalesce((floor <= a.vis_floor) & ~F.isnan(floor), F.lit(False))), a.out)


def simulated(spark: SparkSession, a) -> None:
    """pure and mixed arms of the pool with keyed noise; --match compares with an earlier table"""
    calibration, correlation = tables.calibration(spark, a.calibration)
    out = simulate.simulate_pairs(spark.read.parquet(a.pool), spark.read.parquet(a.backgrounds), calibration, correlation if a.correlation is None else a.correlation, a.seed)
    sinks.parquet(out, a.out)
    if a.match:
        key = lambda f: f.withColumn("key", F.concat_ws("/", "ref_id", "arm"))
        metrics.compare_arrays(key(spark.read.parquet(a.out)), key(spark.read.parquet(a.match)), "key", "target").show()


def residual(spark: SparkSession, a) -> None:
    """basis and coefficient network of the correction, from residual rows (x, residual); --validate compares modes"""
    real, drawn = spark.read.parquet(a.real), spark.read.parquet(a.simulated)
    modes, report = metrics.spectral_basis(real.select("residual").unionByName(drawn.select("residual")), "residual", a.rank)
    found, losses, weight = model.train_correction(real, drawn, np.array(modes), a.group, a.hidden, a.share, a.held, a.seed, epochs=a.epochs)
    os.makedirs(a.out, exist_ok=True)
    sinks.basis_npz(f"{a.out}/basis.npz", modes, G.wavelengths()[: len(modes[0])], report)
    found.coefficients.save(f"{a.out}/coefficients.npz")
    sinks.write_json(f"{a.out}/residual.json", report | {"losses": losses, "weight": weight})
    if a.validate:
        print(json.dumps({"mode_alignment": model.mode_agreement(np.load(a.validate)["B"].T, np.array(modes))}))


def craters(spark: SparkSession, a) -> None:
    """footprints in the windows of craters, flagged where they are bright and blue"""
    geometry = tables.sidecar(spark, a.geometry, schemas.GEOMETRY)
    sinks.parquet(pipelines.crater_footprints(spark.read.parquet(a.craters), geometry, _pixels(spark, a.pixels), a.transform, a.bright, a.blue), a.out)


def calibrate(spark: SparkSession, a) -> None:
    """the scale per crater that reproduces its contrast, from the others, and the median to deploy"""
    stars = metrics.scale_star(spark.read.parquet(a.table), "crater", "measured", "anchor", "residual", "gate", "inside", a.smax, a.step)
    rows = stars.join(metrics.leave_one_out(stars, "crater"), "crater").orderBy("crater").collect()
    sinks.write_json(a.out, {"craters": {r["crater"]: r.asDict() for r in rows}, "scale": float(np.median([r["s_star"] for r in rows])) if rows else None})


def _basis(path: str) -> list[list[float]]:
    return np.load(path)["B"].T.astype(float).tolist()


def build_layer(spark: SparkSession, a) -> None:
    """spatial selection, gate and coefficients as a sparse table, with mask, statistics and configuration"""
    rings, _ = shapes_on_grid.clean_catalogue(tables.polygon_catalogue(spark, a.polygons), "wkt", a.max_area)
    mask = shapes_on_grid.spatial_selection(tables.disk_catalogue(spark, a.disks), rings, a.transform, a.width, a.height, a.margin, a.floor_km, a.buffer_km)
    pixels, reference, stats = _pixels(spark, a.pixels), a.reference, _json(a.stats)
    found = layers.candidates(mask, pixels, reference, a.z)
    net = model.Perceptron.load(a.coefficients)
    os.makedirs(a.out, exist_ok=True)
    sinks.parquet(layers.build(found, model.LowRankCorrection(net, np.array(_basis(a.basis))), a.scale, stats["image_count_mean"], stats["image_count_std"]), f"{a.out}/layer")
    built = spark.read.parquet(f"{a.out}/layer")
    raster.write_mask(built, f"{a.out}/selection.tif", a.width, a.height, a.transform, "g", f"correction strength, scale {a.scale}")
    raster.write_mask(mask, f"{a.out}/spatial.tif", a.width, a.height, a.transform)
    audit = layers.spread_audit(shapes_on_grid.rows_sample(pixels, a.height, 24), reference, a.z)
    choices = {"scale": a.scale, "z": a.z, "margin": a.margin, "floor_km": a.floor_km, "buffer_km": a.buffer_km}
    sinks.write_json(f"{a.out}/config.json", layers.configuration(built, layers.selection_stats(found, a.height, a.width), audit, reference, a.basis, choices, {"layer": "layer", "selection": "selection.tif", "spatial": "spatial.tif"}))


def apply_layer(spark: SparkSession, a) -> None:
    """rewrite or patch a tile dataset with a layer, prove it, or only audit it"""
    pixels, layer, modes = raster.read_tiles(spark, a.source), spark.read.parquet(a.layer), _basis(a.basis)
    print(json.dumps(layers.audit(pixels, layer, modes).first().asDict()))
    if a.dry_run:
        return
    if a.mode == "rewrite":
        raster.write_tiles(layers.rewrite(pixels, layer, modes), a.out)
    else:
        layers.patch(a.out, pixels, layer, modes)
    if not a.no_verify:
        proof = layers.verify(pixels, raster.read_tiles(spark, a.out), layer, modes).first().asDict()
        if proof["outside_max"]:
            raise SystemExit(f"pixels outside the layer changed: {proof}")
        print(json.dumps(proof))


def extract(spark: SparkSession, a) -> None:
    """a subset of bands, by number or wavelength, as tiles or one GeoTIFF"""
    pixels = _pixels(spark, a.pixels)
    column = "spectrum" if "spectrum" in pixels.columns else "bands"
    n = len(pixels.select(column).where(F.col(column).isNotNull()).first()[0])
    labels = [f"{w:.0f} nm" for w in G.wavelengths()[:n]]
    bands = [int(b) for b in a.bands] if a.bands else [G.nearest_index(w, G.wavelengths()[:n]) + 1 for w in a.wavelengths]
    if a.out.endswith(".tif"):
        raster.extract_bands(pixels, a.out, bands, labels, a.width, a.height, a.transform, column)
    else:
        raster.write_tiles(sinks.band_subset(pixels, [b - 1 for b in bands], n, column), a.out)


def consistency(spark: SparkSession, a) -> None:
    """band statistics of a mosaic over an even grid of windows, as CSV"""
    pixels = _pixels(spark, a.pixels)
    corners = shapes_on_grid.window_grid(a.height, a.width, a.windows, a.size)
    stats = pipelines.mosaic_statistics(shapes_on_grid.in_windows(pixels, corners, a.size), "spectrum" if "spectrum" in pixels.columns else "bands")
    sinks.csv(stats.orderBy("band").coalesce(1), a.out)


def info(spark: SparkSession, a) -> None:
    """metadata of a raster"""
    print(json.dumps(raster.raster_info(spark, a.path).first().asDict(), indent=2))


GRID = {"transform": {"type": numbers, "required": True, "help": "a,b,c,d,e,f"}, "width": {"type": int, "required": True}, "height": {"type": int, "required": True}}
LOOSE = {k: v | {"required": False} for k, v in GRID.items()}
need = lambda *names: {n: {"required": True} for n in names}
number = lambda value: {"type": type(value), "default": value}
flag = {"action": "store_true"}

#: Command -> function and its options; names without dashes in front of a positional list.
COMMANDS = {
    "query": (query, {"name": {}, "folder": {}}, {"out": {}}),
    "pairs": (pairs, {}, need("quality", "geometry", "shapes", "spectra", "pixels", "out") | GRID | {"limit": {"type": int}, "force": flag}),
    "splits": (split, {}, need("pairs", "out") | {"test-share": number(0.1), "folds": number(5), "seed": {"type": int}}),
    "targets": (targets, {}, need("pairs", "out") | {"spectra": {}, "build": flag, "floor": flag, "diag-b": flag, "k": number(5), "widths": {"type": numbers, "default": (4.7, 5.0, 7.0)}}),
    "train": (train, {}, need("pairs", "targets", "splits", "out") | {"target": number("lsf_5p0"), "hidden": {"type": numbers, "default": (128, 256, 256)}, "epochs": number(100), "rate": number(1e-3), "batch-size": number(1024), "dropout": number(0.0), "seed": number(42)}),
    "predict": (predict, {}, need("pixels", "model", "out") | LOOSE | {"stats": {}, "roi": {"type": numbers, "help": "row,col,height,width"}, "no-count": flag}),
    "eval": (evaluate, {}, need("predicted", "terrain", "out")),
    "pool": (pool, {}, need("groups", "geometry", "quality", "held-out", "pixels", "pairs", "out") | {"transform": GRID["transform"], "radius-km": number(100.0), "vis-floor": number(0.008), "check": flag}),
    "simulate": (simulated, {}, need("pool", "backgrounds", "calibration", "out") | {"correlation": {"type": float}, "seed": number(4242), "match": {}}),
    "residual": (residual, {}, need("real", "simulated", "out") | {"group": number("group"), "rank": number(2), "hidden": number(32), "share": number(0.3), "held": number(0.15), "epochs": number(100), "seed": number(42), "validate": {}}),
    "craters": (craters, {}, need("craters", "geometry", "pixels", "out") | {"transform": GRID["transform"], "bright": number(82.0), "blue": number(65.0)}),
    "calibrate": (calibrate, {}, need("table", "out") | {"smax": number(2.0), "step": number(0.005)}),
    "build-layer": (build_layer, {}, need("disks", "polygons", "pixels", "coefficients", "basis", "stats", "out") | GRID | {"reference": {"type": numbers, "required": True, "help": "mean and deviation of the level, then of the ratio"}, "scale": {"type": float, "required": True}, "z": number(0.5), "margin": number(1.5), "floor-km": number(3.0), "buffer-km": number(1.0), "max-area": number(50.0)}),
    "apply-layer": (apply_layer, {}, need("source", "layer", "basis", "out") | {"mode": {"choices": ["rewrite", "patch"], "default": "rewrite"}, "dry-run": flag, "no-verify": flag}),
    "extract": (extract, {}, need("pixels", "out") | LOOSE | {"bands": {"type": numbers, "help": "1-based"}, "wavelengths": {"type": numbers}}),
    "consistency": (consistency, {}, need("pixels", "out") | {"width": GRID["width"], "height": GRID["height"], "windows": number(6), "size": number(256)}),
    "info": (info, {"path": {}}, {}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rasterloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the registered queries")
    for name, (run, positional, options) in COMMANDS.items():
        one = sub.add_parser(name, help=run.__doc__)
        for k, v in positional.items():
            one.add_argument(k, **v)
        for k, v in options.items():
            one.add_argument(f"--{k}", **v)
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    if a.command == "list":
        print("\n".join(_named()))
        return
    COMMANDS[a.command][0](SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a)


if __name__ == "__main__":
    main()
