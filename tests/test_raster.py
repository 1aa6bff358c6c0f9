"""Rasters, polygons, layers, models, resampling and sources."""

import io
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geo, resample
from rasterloom.functions import polygon as P
from rasterloom.operators import layer, raster, simulate
from rasterloom.operators import model as M
from rasterloom.sources import raster as R
from rasterloom.sources import schemas, sinks, tables, tiff
from rasterloom.streaming.ingest import ingest_new_files

NAN = float("nan")
UNIT = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
RING = np.array([(0.3, 0.2), (7.6, 1.1), (5.2, 9.4), (1.0, 6.3)])


def ring_row(ring):
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def test_centre_rule_in_python_and_in_expressions_agree(spark):
    frame = spark.createDataFrame([(1, ring_row(RING))], "k long, ring array<struct<x:double,y:double>>")
    a = {(r.row, r.col) for r in raster.rasterise(frame, "ring", UNIT, 20, 20).collect()}
    b = {(r.row, r.col) for r in raster.rasterise_windows(frame, "ring", UNIT, 20, 20).collect()}
    yy, xx = np.mgrid[0:20, 0:20]
    hit = P.inside(RING, xx.ravel() + 0.5, yy.ravel() + 0.5)
    assert a == b == set(zip(yy.ravel()[hit].tolist(), xx.ravel()[hit].tolist()))


def test_all_touched_covers_the_centre_rule_and_edges():
    square = np.array([(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)])
    rr, cc = raster.covered(square, UNIT, 5, 5, all_touched=True)
    assert (1, 1) in set(zip(rr, cc)) and (2, 2) in set(zip(rr, cc))  # shares a corner
    sliver = np.array([(0.1, 0.45), (4.9, 0.45), (4.9, 0.46), (0.1, 0.46)])
    assert len(raster.covered(sliver, UNIT, 5, 5, all_touched=False)[0]) == 0
    assert len(raster.covered(sliver, UNIT, 5, 5, all_touched=True)[0]) == 5
    grown = raster.covered(square, UNIT, 5, 5, all_touched=False, margin=1.0)
    assert (0, 1) in set(zip(*grown)) and (0, 0) in set(zip(*grown))


def test_zonal_mean_skips_nodata(spark):
    frame = spark.createDataFrame([(1, ring_row([(0.2, 0.2), (1.8, 0.2), (1.8, 0.8), (0.2, 0.8)]))], "k long, ring array<struct<x:double,y:double>>")
    pixels = spark.createDataFrame([(0, 0, [1.0, -3.4e38]), (0, 1, [3.0, NAN])], "row int, col int, bands array<double>")
    (got,) = raster.zonal_mean(frame, "k", "ring", pixels, "bands", UNIT, 4, 4).collect()
    assert got.bands[0] == 2.0 and math.isnan(got.bands[1])


def test_wkt(spark):
    texts = ["POLYGON ((0 0, 1 0, 1 1))", "multipolygon (((0 0,1 0,1 1,0 1)),((5 5,6 5,6 6,x y)))", "POLYGON ((0 0, 9 0, 9 9, 0 9), (1 1, 2 1, 2 2))", "POINT (1 2)", "", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    sizes = {r.i: r.n for r in frame.select("i", F.size(geo.wkt_rings(F.col("t"))).alias("n")).collect()}
    assert [sizes[i] for i in range(5)] == [1, 2, 2, 0, 0]


def test_seam_and_bow_tie():
    pieces = P.split_seam(np.array([(175.0, 0.0), (185.0, 0.0), (185.0, 5.0), (175.0, 5.0)]))
    assert len(pieces) == 2 and {float(p[:, 0].min()) for p in pieces} == {175.0, -180.0}
    assert P.is_simple(RING) and not P.is_simple(np.array([(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)]))


def test_catalogue_cleaning(spark):
    rows = [("POLYGON ((0 0, 1 0, 1 1, 0 1))",), ("POLYGON ((0 0, 9 0, 9 9, 0 9))",), ("POLYGON ((0 0, 1 1, 1 0, 0 1))",), ("POLYGON ((170 0, 190 0, 190 1))",)]
    kept, counts = raster.clean_catalogue(spark.createDataFrame(rows, "wkt string"), "wkt", max_area_km2=3000.0)
    row = counts.first()
    assert (row.n_raw, row.n_seam, row.n_degenerate, row.n_oversized, row.n_kept) == (4, 1, 1, 1, 1) and kept.count() == 1


def test_layer_is_exact_outside_and_reversible(spark):
    pixels = spark.createDataFrame([(r, c, [float(r + c), NAN if (r, c) == (1, 1) else 1.0, 2.0]) for r in range(3) for c in range(3)], "row int, col int, spectrum array<double>")
    sparse = spark.createDataFrame([(0, 0, 0.5, 1.0, 2.0), (1, 1, 0.5, 1.0, 1.0)], "row int, col int, g float, c0 float, c1 float")
    modes = [[1.0, 0.0, 0.5], [0.0, 1.0, -1.0]]
    out = {(r.row, r.col): r.spectrum for r in layer.rewrite(pixels, sparse, modes).collect()}
    assert out[0, 0] == [0.5, 2.0, 1.25] and math.isnan(out[1, 1][1]) and out[2, 2] == [4.0, 1.0, 2.0]
    row = layer.verify(pixels, layer.rewrite(pixels, sparse, modes), sparse, modes).first()
    assert row.outside_max == 0 and row.inside_max == pytest.approx(0, abs=1e-12)
    audit = layer.audit(pixels, sparse, modes, wavelength=300.0).first()
    assert (audit.n_written, audit.n_nodata_skipped) == (1, 1)
    empty = layer.rewrite(pixels, sparse.limit(0), modes)
    assert empty.count() == 9


def test_tile_boundaries(spark):
    sparse = spark.createDataFrame([(255, 511, 1.0), (256, 512, 1.0)], "row int, col int, g double")
    assert {(r.tile_row, r.tile_col) for r in layer.tiles(sparse).collect()} == {(0, 0), (1, 1)}


def test_build_layer_counts(spark):
    good = [0.5, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 3.0]
    pixels = spark.createDataFrame([(0, 0, good), (0, 1, [*good[:8], -3.4e38]), (0, 2, [0.1] * 9)], "row int, col int, bands array<float>")
    mask = pixels.select("row", "col")
    found = layer.candidates(mask, pixels, (0.2, 0.1, 0.9, 0.05))
    stats = layer.selection_stats(found, 10, 10).first()
    assert (stats.n_pixels_spatial, stats.n_pixels_invalid, stats.n_pixels_rejected, stats.n_pixels_corrected) == (3, 1, 1, 1)
    net = M.LowRankCorrection(M.Perceptron.fresh([9, 32, 2]), np.zeros((2, 231)))
    assert layer.build(found, net, 0.5, 3.0, 1.0).count() == 1
    # Coefficients are added up by tile and row: single precision moved the last shown place of such sums.
    w, x = np.array([[0.1 * (k + 1), -0.05 * k] for k in range(9)]), np.array([97.63, *[66.05] * 7, 4.0])
    bright = layer.candidates(mask, spark.createDataFrame([(0, 0, x.tolist())], "row int, col int, bands array<double>"), (50.0, 25.0, 1.2, 0.5))
    built = layer.build(bright.withColumn("chosen", F.lit(True)), M.LowRankCorrection(M.Perceptron([(w, np.zeros(2))]), np.eye(2)), 0.4, 3.0, 2.0).first()
    assert (built.c0, built.c1) == tuple(pytest.approx(v, rel=1e-14) for v in np.array([*x[:8], 0.5]) @ w)


def test_perceptron_apply_matches_numpy(spark):
    net = M.Perceptron.fresh([3, 8, 4])
    frame = spark.createDataFrame([(1, [0.1, 0.2, 0.3]), (2, None), (3, [1.0, -1.0, 0.5])], "id long, x array<double>")
    got = {r.id: r.y for r in M.apply_model(frame, net, "x", "y").collect()}
    assert got[2] is None
    for i, x in ((1, [0.1, 0.2, 0.3]), (3, [1.0, -1.0, 0.5])):
        assert np.allclose(got[i], net(np.array([x], np.float32))[0], atol=1e-5)
    assert abs(M.erf(np.array([0.3, -1.2, 4.0])) - np.array([math.erf(v) for v in (0.3, -1.2, 4.0)])).max() < 2e-7


def test_training_lowers_the_loss_and_masks(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [([float(a), float(b)], [float(a + b), NAN if k % 5 == 0 else float(a * b)]) for k, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    frame = spark.createDataFrame(rows, "x array<double>, y array<double>").coalesce(2)
    net, losses = M.train(frame, M.Perceptron.fresh([2, 8, 2]), epochs=12, rate=0.03)
    assert losses[-1] < losses[0] * 0.8
    net.save(str(tmp_path / "m.npz"))
    again = M.Perceptron.load(str(tmp_path / "m.npz"))
    assert np.allclose(again(np.ones((1, 2))), net(np.ones((1, 2))))
    assert M.masked_mse(np.ones((2, 2)), np.full((2, 2), NAN))[:2] == (0.0, 0)


def test_resampling():
    w, v = np.array([310.0, 300, 305, 340, 320]), np.array([2.0, 1, 1.5, 5, 3])
    grid = np.array([300.0, 305, 310, 315, 330, 345])
    assert resample.linear(w, v, grid)[:5].tolist() == [1.0, 1.5, 2.0, 2.5, 4.0] and math.isnan(resample.linear(w, v, grid)[5])
    out = resample.gaussian(w, v, 4.7, grid)
    assert math.isnan(out[4]) and math.isnan(out[5]) and np.isfinite(out[:3]).all()
    assert resample.linear([1.0], [2.0]) is None


def test_keyed_noise_does_not_depend_on_partitions(spark):
    frame = spark.range(20).select("id", resample.keyed_noise(F.col("id"), F.lit(2), 8).alias("n"))
    a = {r.id: r.n for r in frame.collect()}
    b = {r.id: r.n for r in spark.range(20).repartition(5).select("id", resample.keyed_noise(F.col("id"), F.lit(2), 8).alias("n")).collect()}
    rng = np.random.default_rng([4242, 7, 2])
    assert a == b and a[7] == [rng.standard_normal(), *rng.standard_normal(8)]


def test_simulated_pairs(spark):
    y = [0.05 + 0.001 * k for k in range(231)]
    pool = spark.createDataFrame([(1, 0.0, 0.0, y, y, 3.0)], "ref_id long, lon double, lat double, naive array<double>, target array<double>, mdis_image_count double")
    back = spark.createDataFrame([(9, 1.0, 1.0, [0.0] * 231, [0.0] * 231)], "bg_id long, blon double, blat double, bg_naive array<double>, bg_target array<double>")
    out = {r.arm: r for r in simulate.simulate_pairs(pool, back, [{"slope": 1.0, "offset": 0.0, "resid_std": 0.0}] * 8, 0.5).collect()}
    assert sorted(out) == [0, 1, 2] and out[1].target[10] == pytest.approx(y[10] / 3) and out[0].mdis_iof[0] == pytest.approx(0.05 + 0.001 * (433.2 - 300) / 5, abs=1e-4)
    with pytest.raises(ValueError):
        resample.simulated_bands(F.lit(None), F.lit(None), [1.0], [0.0], [0.0], 1.5)


@pytest.mark.parametrize("compress", [True, False])
def test_tiff_round_trip_and_pushdown(spark, tmp_path, compress):
    data = np.random.default_rng(1).normal(size=(3, 70, 90)).astype(np.float32)
    path = str(tmp_path / "a.tif")
    tiff.write(path, data, (2.0, 0.0, -10.0, 0.0, -2.0, 50.0), nodata=-1.0, tile=(32, 48), compress=compress)
    with open(path, "rb") as f:
        info = tiff.read_info(io.BytesIO(f.read()))
    assert (info.width, info.height, info.count, info.nodata, info.transform[2], info.transform[5]) == (90, 70, 3, -1.0, -10.0, 50.0)
    frame = R.read_raster(spark, path, bands=[3, 1], row_block=16)
    got = {(r.row, r.col): r.bands for r in frame.where("row >= 30 and row < 34").collect()}
    assert frame.count() == 70 * 90  # an earlier filter on the same frame narrows nothing
    assert R.read_raster(spark, path, row_block=16, rows=(30, 34)).count() == 4 * 90
    assert len(got) == 4 * 90 and got[31, 5] == [float(data[2, 31, 5]), float(data[0, 31, 5])]
    assert R.read_window(spark, path, 60, 80, 50, 50).count() == 10 * 10
    assert R.raster_info(spark, path).first().width == 90
    back = R.write_geotiffs(frame.withColumnRenamed("bands", "spectrum"), str(tmp_path), 90, info.transform, rows=64).orderBy("row").collect()
    assert [(r["row"], r["height"]) for r in back] == [(0, 64), (64, 6)]


def test_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text('obs_id,ref_id,waves,photom_iof,id\no1,1,"[1.0, 2.0]","[0.1, 0.2]",x\no2,2,"[1.0","[0.1]",x\no3,3,"[1, 2,]","[1, 2]",x\n')
    usable, rejected = tables.readable_spectra(tables.spectra(spark, str(tmp_path / "s.csv")))
    assert {r.ref_id for r in usable.collect()} == {1, 3} and {r.ref_id for r in rejected.collect()} == {2}
    (tmp_path / "d.tsv").write_text("a\nb\nCentral.Latitude.dec.degrees\tGeodesic.area.km.2\tCentral.Longitude.dec.degrees\n1\t2\t3\n4\t\t6\n")
    assert [tuple(r) for r in tables.disk_catalogue(spark, str(tmp_path / "d.tsv")).collect()] == [(3.0, 1.0, 2.0)]
    (tmp_path / "g.tsv").write_text("Group_id\tCentral_long\tCentral_lat\n1\t2.5\t3.5\n\t1\t1\n")
    assert tables.group_catalogue(spark, str(tmp_path / "g.tsv")).count() == 1
    (tmp_path / "p.csv").write_text("id;the_geom\n1;POLYGON ((0 0, 1 0, 1 1))\n", encoding="latin-1")
    assert tables.polygon_catalogue(spark, str(tmp_path / "p.csv")).first().wkt.startswith("POLYGON")
    with pytest.raises(ValueError):
        tables.sidecar(spark, str(tmp_path / "s.csv"), schemas.QUALITY)


def test_sinks_and_incremental_ingest(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest_new_files(spark, str(tmp_path / "in"), "id long", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    assert sinks.consolidate(spark, str(tmp_path / "out"), str(tmp_path / "one"), 1) == 10
    with pytest.raises(IndexError):
        sinks.band_subset(spark.range(1), [231], 231)


def test_catalogues_and_variants(spark, tmp_path):
    rows = "".join(f"{k}\t{k + 1}\t{k + 2}\n" for k in range(500))
    (tmp_path / "d.tsv").write_text("a\nb\n\"Central.Latitude.dec.degrees\"\tGeodesic.area.km.2\tCentral.Longitude.dec.degrees\n" + rows + "1\tx\t2\n")
    assert tables.disk_catalogue(spark, str(tmp_path / "d.tsv")).count() == 500
    (tmp_path / "short.tsv").write_text("a\nb\n")
    with pytest.raises(ValueError):
        tables.disk_catalogue(spark, str(tmp_path / "short.tsv"))
    for name in ("x_hollows_08_b.csv", "x_hollows_08_a.csv", "x_hollows_07_a.csv"):
        (tmp_path / name).write_text('name,shape\nn,"MULTIPOLYGON (((0 0, 1 0, 1 1)))"\n')
    found = tables.newest_variant(spark, str(tmp_path), schemas.VARIANTS["0.8"])
    assert found.endswith("x_hollows_08_a.csv")
    assert tables.polygon_catalogue(spark, found).first().wkt.startswith("MULTI")
    with pytest.raises(FileNotFoundError):
        tables.newest_variant(spark, str(tmp_path), "*none*")


def test_one_mosaic_a_mask_and_a_band_subset(spark, tmp_path):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(5, 40, 70)).astype(np.float32)
    cells = [(r, c, None if (r, c) == (3, 4) else data[:, r, c].tolist()) for r in range(40) for c in range(70) if r >= 16 or c >= 32]
    pixels = spark.createDataFrame(cells, "row int, col int, spectrum array<float>").repartition(5)
    path, at = str(tmp_path / "m.tif"), (2.0, 0.0, -10.0, 0.0, -2.0, 50.0)
    labels = [f"{k} nm" for k in range(5)]
    assert R.write_mosaic(pixels, path, 70, 40, 5, at, nodata=-1.0, labels=labels, tile=(16, 32)) == 8  # one tile has no pixel
    with open(path, "rb") as f:
        info = tiff.read_info(f)
        back = tiff.read_window(f, info, 0, 0, 40, 70)
    want = data.copy()
    want[:, :16, :32] = -1.0
    want[:, 3, 4] = -1.0
    assert (back == want).all() and tiff.descriptions_of(info) == labels and info.transform == at
    assert R.extract_bands(pixels, str(tmp_path / "rgb.tif"), [5, 1, 3], labels, 70, 40, at) > 0
    with open(tmp_path / "rgb.tif", "rb") as f:
        info = tiff.read_info(f)
        assert info.photometric == 2 and tiff.descriptions_of(info) == ["4 nm", "0 nm", "2 nm"]
        assert (tiff.read_window(f, info, 20, 40, 3, 3) == data[[4, 0, 2], 20:23, 40:43]).all()
    mask = spark.createDataFrame([(1, 2), (1, 2), (39, 69)], "row int, col int")
    R.write_mask(mask, str(tmp_path / "mask.tif"), 70, 40, at)
    with open(tmp_path / "mask.tif", "rb") as f:
        info = tiff.read_info(f)
        ones = np.argwhere(tiff.read_window(f, info, 0, 0, 40, 70)[0] == 1).tolist()
    assert ones == [[1, 2], [39, 69]] and info.dtype == "u1"
    before, after = tiff.recompress(path, str(tmp_path / "again.tif"))
    with open(tmp_path / "again.tif", "rb") as f:
        info = tiff.read_info(f)
        assert (tiff.read_window(f, info, 0, 0, 40, 70) == want).all() and info.nodata == -1.0
    assert after <= before
    with pytest.raises(IndexError):
        R.extract_bands(pixels, path, [6], labels, 70, 40, at)


def test_small_sinks(tmp_path):
    sinks.basis_npz(str(tmp_path / "b.npz"), [[1.0, 2.0], [3.0, 4.0]], [300.0, 305.0], {"share": [0.9, 0.1]})
    held = np.load(tmp_path / "b.npz")
    assert held["B"].tolist() == [[1.0, 3.0], [2.0, 4.0]] and held["share"].tolist() == [0.9, 0.1]
    a, b = str(tmp_path / "b.npz"), str(tmp_path / "c.npz")
    assert sinks.copy_file(a, b) and not sinks.copy_file(a, b, reuse=True) and open(a, "rb").read() == open(b, "rb").read()
    with pytest.raises(OSError):
        sinks.copy_file(a, b, slack=1e18)
    sinks.line_chart(str(tmp_path / "c.png"), [300.0, 310.0, 320.0], {"a": [1.0, NAN, 2.0], "b": [1.0, 2.0, 3.0]}, (60, 90))
    raw = open(tmp_path / "c.png", "rb").read()
    pixels = np.frombuffer(zlib.decompress(raw[raw.index(b"IDAT") + 4 : -16]), np.uint8).reshape(60, 1 + 270)
    assert raw.startswith(b"\x89PNG") and (pixels[:, 0] == 0).all() and (pixels[:, 1:] == 255).any() and (pixels[1:-1, 4:-4] < 200).any()


def test_a_mosaic_is_whole_or_as_before(spark, tmp_path):
    pixels = spark.range(64 * 64).select(F.floor(F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("spectrum"))
    path, at = str(tmp_path / "m.tif"), (1.0, 0.0, 0.0, 0.0, -1.0, 64.0)
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    assert R.write_mosaic(pixels.repartition(7), path, 64, 64, 2, at, tile=(16, 16)) == 16
    with open(path, "rb") as f:
        first = f.read()
    assert R.write_mosaic(pixels.repartition(3), path, 64, 64, 2, at, tile=(16, 16)) == 16
    with open(path, "rb") as f:
        assert f.read() == first  # the same bytes whatever the partitioning
    broken = pixels.withColumn("spectrum", F.when(F.col("row") == 40, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("spectrum")))
    with pytest.raises(Exception):
        R.write_mosaic(broken, path, 64, 64, 2, at, tile=(16, 16))
    with open(path, "rb") as f:
        assert f.read() == first
    assert os.listdir(tmp_path) == ["m.tif"] and set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) == before
    assert R.write_mosaic(pixels.where("false"), str(tmp_path / "none.tif"), 64, 64, 2, at, nodata=-5.0, tile=(16, 16)) == 0
    with open(tmp_path / "none.tif", "rb") as f:
        assert (tiff.read_window(f, tiff.read_info(f), 0, 0, 64, 64) == -5.0).all()


def test_training_by_mini_batches_with_dropout_and_weights(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(256, 3))
    y = x @ np.array([[1.0, -1.0], [0.5, 2.0], [0.0, 1.0]])
    y[0, 0] = NAN
    frame = spark.createDataFrame([(a.tolist(), b.tolist(), 1.0) for a, b in zip(x, y)], "x array<double>, y array<double>, w double").repartition(3).cache()
    net = M.Perceptron.fresh([3, 16, 2], "relu", seed=1)
    found, losses = M.train(frame, net, validation=frame, epochs=25, rate=0.02, batch_size=32)
    assert losses[-1] < 0.1 * losses[0] and len(losses) == 25
    net.dropout = 0.2
    _, noisy = M.train(frame, net, weight="w", epochs=6, rate=0.02, batch_size=32)
    assert noisy[-1] < noisy[0]
    # One partition and one batch an epoch are plain Adam on the full gradient.
    one, net = frame.coalesce(1).cache(), M.Perceptron.fresh([3, 4, 2], seed=2)
    a, _ = M.train(one, net, epochs=4, rate=0.01)
    b, _ = M.train(one, net, epochs=4, rate=0.01, batch_size=10_000)
    ahead, _ = M.train(one, net, epochs=5, rate=0.01)
    assert np.allclose(M._flat(b), M._flat(ahead)) or np.allclose(M._flat(b), M._flat(a))


def _learnable(spark, n=400):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    y = x @ np.array([[1.0, -1.0], [0.5, 2.0], [0.0, 1.0]])
    return spark.createDataFrame([(a.tolist(), b.tolist(), float(i % 3)) for i, (a, b) in enumerate(zip(x, y))], "x array<double>, y array<double>, w double")


def test_synchronous_steps_do_not_depend_on_the_partitions(spark, monkeypatch):
    frame, net = _learnable(spark), M.Perceptron.fresh([3, 8, 2], seed=2)
    found = []
    for rows in (1000, 16, 32):  # one task, four and two
        monkeypatch.setattr(M, "ROWS_A_TASK", rows)
        found.append(M.train(frame.repartition(5), net, weight="w", epochs=3, rate=0.01, batch_size=64))
    for model, losses in found[1:]:
        assert np.abs(M._flat(model) - M._flat(found[0][0])).max() < 1e-9 and np.allclose(losses, found[0][1], atol=1e-12)
    assert found[0][1][-1] < found[0][1][0]
    # Six steps an epoch, as one machine takes them.
    rows = frame.withColumn("b", F.floor(F.shiftrightunsigned(F.xxhash64(F.lit(43), "x", "y"), 11).cast("double") / float(1 << 53) * 6)).toPandas()
    flat = M._flat(net)
    adam = M.Adam(flat, 0.01)
    for _, part in sorted(rows.groupby("b")):
        seen = [0.0, 0]
        _, grads = M._unflat(net, flat).gradients(np.stack(part.x), M._weighted_mse(np.stack(part.y), part.w.to_numpy(), seen))
        flat = adam.step(flat, np.concatenate([g.ravel() for pair in grads for g in pair]) / seen[1])
    one, _ = M.train(frame, net, weight="w", epochs=1, rate=0.01, batch_size=64)
    assert np.abs(M._flat(one) - flat).max() < 1e-9


@pytest.mark.parametrize("options", [{"batch_size": 64}, {}, {"batch_size": 64, "weight": "w", "drawn": True}])
def test_a_stopped_run_goes_on(spark, tmp_path, options):
    frame, net = _learnable(spark), M.Perceptron.fresh([3, 8, 2], seed=2)
    whole, losses = M.train(frame, net, epochs=6, rate=0.01, state=str(tmp_path / "whole"), **options)
    M.train(frame, net, epochs=3, rate=0.01, state=str(tmp_path / "parts"), **options)
    (tmp_path / "parts" / "run=4" / "_temporary").mkdir(parents=True)  # an epoch that was being written
    again, more = M.train(frame, net, epochs=6, rate=0.01, state=str(tmp_path / "parts"), **options)
    assert np.allclose(losses, more, atol=1e-12) and len(more) == 6 and np.allclose(M._flat(whole), M._flat(again), atol=1e-12)
    assert M.train(frame, net, epochs=6, rate=0.01, state=str(tmp_path / "parts"), **options)[1] == more


def test_drawn_epochs_see_rows_by_weight(spark):
    """Rows without weight teach nothing: a target that only they have is not learned."""
    rows = [([1.0], [1.0], 1.0)] * 40 + [([1.0], [9.0], 0.0)] * 40
    frame = spark.createDataFrame(rows, "x array<double>, y array<double>, w double")
    net, losses = M.train(frame, M.Perceptron.fresh([1, 1], seed=1), weight="w", drawn=True, epochs=60, rate=0.1)
    assert abs(net(np.array([[1.0]]))[0, 0] - 1) < 0.1 and losses[-1] < 0.05


def test_dropout_leaves_out_hidden_values_and_keeps_their_mean():
    net = M.Perceptron([(np.ones((1, 20000)), np.zeros(20000)), (np.ones((20000, 1)) / 20000, np.zeros(1))], "relu", dropout=0.25)
    seen = []
    net.gradients(np.ones((1, 1)), lambda out: (seen.append(out[0, 0]), (0.0, np.ones((1, 1))))[1], np.random.default_rng(1))
    assert seen[0] != 1.0 and seen[0] == pytest.approx(1.0, abs=0.03) and net(np.ones((1, 1)))[0, 0] == pytest.approx(1.0)


def test_checkpoints_of_three_kinds(tmp_path):
    import json

    net = M.Perceptron.fresh([4, 3, 2])
    state = {f"model.net.{2 * k}.{n}": (v.T if n == "weight" else v) for k, (w, b) in enumerate(net.layers) for n, v in (("weight", w), ("bias", b))}
    np.savez(tmp_path / "state.npz", **state)
    (tmp_path / "state.json").write_text(json.dumps({k: v.tolist() for k, v in state.items()}))
    net.save(str(tmp_path / "own.npz"))
    x = np.ones((2, 4))
    for file, prefix in (("state.npz", "model.net."), ("state.json", "model.net."), ("own.npz", "")):
        assert np.allclose(M.Perceptron.load(str(tmp_path / file), prefix)(x), net(x))
    with pytest.raises(ValueError):
        M.Perceptron.from_state(state, "other.")


def test_correction_training_and_comparison(spark):
    rng = np.random.default_rng(2)
    modes = np.linalg.qr(rng.normal(size=(6, 2)))[0].T
    rows = []
    for i in range(120):
        x = rng.normal(size=3)
        rows.append((f"g{i % 10}", x.tolist(), (np.array([x[0], -x[1]]) @ modes).tolist()))
    frame = spark.createDataFrame(rows, "g string, x array<double>, residual array<double>").cache()
    found, losses, weight = M.train_correction(frame.limit(90), frame, modes, "g", hidden=16, epochs=30, rate=0.03)
    assert losses[-1] < 0.2 * losses[0] and weight == pytest.approx(0.3 * 90 / (0.7 * 96))
    both = frame.select("g", "residual", F.transform("residual", lambda v: v * 2).alias("other"))
    row = M.compare_models(both, "residual", "other", "g").first()
    assert row.correlation == pytest.approx(1.0) and row.median_abs_b == pytest.approx(2 * row.median_abs_a)
    angle = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>").select(M.training_angle(F.col("a"), F.col("b"))).first()[0]
    assert angle == pytest.approx(45.0)
