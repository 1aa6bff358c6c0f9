"""End-to-end plans on small hand-built tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import grid as G
from rasterloom.cli import main
from rasterloom.functions.resample import gaussian, linear
from rasterloom.plans import pipelines

NAN = float("nan")
#: A grid of 40 x 40 pixels around (0, 0); row 20, column 20 begins at the origin.
TRANSFORM = (G.PIXEL_M, 0.0, -20 * G.PIXEL_M, 0.0, -G.PIXEL_M, 20 * G.PIXEL_M)
DEG = math.degrees(G.PIXEL_M / G.RADIUS_M)


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(r, c, [0.05 + 0.001 * r, 0.05, 0.05, 0.05, 0.1 + 0.001 * c, 0.1, 0.1, 0.1, 3.0, *[0.01] * 8]) for r in range(40) for c in range(40)]
    return spark.createDataFrame(rows, "row int, col int, bands array<double>")


def square(lon, lat, half):
    return "POLYGON ((" + ", ".join(f"{(lon + a * half) % 360} {lat + b * half}" for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))) + "))"


def test_build_pairs_and_targets(spark, pixels):
    quality = spark.createDataFrame([(1, 1.0, 0.0, 90.0, 99.0, "o1"), (2, 0.5, 0.0, 90.0, 99.0, "o1"), (3, 1.0, 0.0, 90.0, 99.0, "o2"), (4, 1.0, 0.0, 90.0, 99.0, "o2"), (5, 1.0, 0.0, 90.0, 99.0, "o2")], "ref_id long, q1 double, q2 double, q3 double, q4 double, obs_id string")
    lon = {1: 2.5 * DEG, 2: 2.5 * DEG, 3: 2.5 * DEG, 4: 100.0, 5: 2.5 * DEG}
    geometry = spark.createDataFrame([(k, "o", 1.0, 2.0, 3.0, 2.5 * DEG, v) for k, v in lon.items()], "ref_id long, obs_id string, ang_in double, ang_em double, ang_ph double, lat_center double, lon_center double")
    wide = "POLYGON ((1 0, 359 0, 359 1, 1 1))"
    shapes = spark.createDataFrame([(k, wide if k == 5 else square(v, 2.5 * DEG, DEG * 0.9)) for k, v in lon.items()], "ref_id long, foot_geom string")
    waves = [300.0 + 2.5 * k for k in range(400)]
    spectra = spark.createDataFrame([(k, waves, None if k == 3 else [0.1 + 0.0001 * w for w in waves]) for k in lon], "ref_id long, waves array<double>, photom_iof array<double>")
    pairs, rejected = pipelines.build_pairs(quality, geometry, shapes, spectra, pixels, TRANSFORM, 40, 40)
    (row,) = pairs.collect()
    assert row.ref_id == 1 and len(row.mdis_iof) == 8 and row.mdis_image_count == 3.0 and len(row.mdis_sigma) == 8
    assert row.mdis_iof[4] == pytest.approx(0.1 + 0.001 * 22) and row.photom_iof_5nm[2] == pytest.approx(0.1 + 0.0001 * 310)
    assert {r.ref_id for r in rejected.collect()} == {3, 4, 5}
    (t,) = pipelines.build_targets(pairs, spectra).collect()
    want = gaussian(waves, [0.1 + 0.0001 * w for w in waves], 5.0)
    assert t.n_native == 400 and np.allclose(t.lsf_5p0, want, equal_nan=True) and np.allclose(t.naive, linear(waves, [0.1 + 0.0001 * w for w in waves]), equal_nan=True)


def test_floor_report(spark):
    rng = np.random.default_rng(0)
    rows = [(i, list(map(float, rng.normal(size=3))), [float(i % 4), 1.0, float(i)], [float(i % 4), NAN, float(i)]) for i in range(30)]
    frame = spark.createDataFrame(rows, "ref_id long, mdis_iof array<double>, naive array<double>, lsf_5p0 array<double>")
    out = {r.variant: r for r in pipelines.floor_report(frame.select("ref_id", "mdis_iof"), frame.drop("mdis_iof"), ("naive", "lsf_5p0"), k=3).collect()}
    assert out["naive"].floor_fair == pytest.approx(out["lsf_5p0"].floor_fair) and out["naive"].floor_own_support < out["naive"].floor_fair
    assert out["lsf_5p0"].coverage == pytest.approx(2 / 3) and out["naive"].d_vs_naive == 0


def test_evaluate(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(24):
        t = 0.05 + 0.01 * rng.random(231)
        rows.append((i, f"o{i % 5}", ("test", "fold0", "fold1")[i % 3], list(map(float, t)), list(map(float, t + 0.001 * rng.normal(size=231)))))
    frame = spark.createDataFrame(rows, "ref_id long, obs_id string, split string, target array<double>, predicted array<double>").cache()
    terrain = spark.createDataFrame([(0, 1, 0), (3, 1, 1), (6, 0, 1)], "ref_id long, lrm int, sm_plain int")
    out = {k: v.collect() for k, v in pipelines.evaluate(frame, terrain).items()}
    assert {r["split"]: r.n for r in out["per_split"]} == {"test": 8, "val": 8, "train": 8}
    assert {r.terrain: r.n for r in out["per_terrain"]} == {"LRM": 1, "LRM+smooth": 1, "smooth_plains": 1, "other": 5}
    assert len(out["per_band"]) == 231 and len(out["param_fidelity"]) == 27 and len(out["panel"]) == 1
    test = [(np.array(r[3]), np.array(r[4])) for r in rows if r[2] == "test"]
    assert out["panel"][0].rmse == pytest.approx(math.sqrt(np.mean([(p - t) ** 2 for t, p in test])))
    assert out["global_mse"][0].global_mse == pytest.approx(out["panel"][0].rmse ** 2)
    with_inputs = frame.where("split = 'test'").withColumn("mdis_iof", F.slice("target", 1, 8))
    assert pipelines.ceilings(with_inputs).count() == 27


def test_pool_and_hits(spark, pixels):
    groups = spark.createDataFrame([(1, 0.0, 0.0), (2, 60.0, 10.0)], "group_id long, clon double, clat double")
    held = spark.createDataFrame([(60.0, 10.0, 50.0)], "clon double, clat double, radius_km double")
    geometry = spark.createDataFrame([(1, "o", 0.5 * DEG, 0.5 * DEG), (2, "o", -3.5 * DEG, 3.5 * DEG), (3, "o", 10.0, 60.0), (4, "o", 0.5 * DEG, 360 - 0.5 * DEG)], "ref_id long, obs_id string, lat_center double, lon_center double")
    quality = spark.createDataFrame([(k, q1, 0.0, 90.0, 99.0, "o") for k, q1 in ((1, 0.5), (2, None), (3, 0.5), (4, 1.0))], "ref_id long, q1 double, q2 double, q3 double, q4 double, obs_id string")
    pool, counts = pipelines.candidate_pool(groups, geometry, quality, held, 5.0)
    assert {r.ref_id for r in pool.collect()} == {1, 2} and {r.stage: r.n for r in counts.collect()} == {"candidates": 3, "quality": 2}
    hits = {r.ref_id for r in pipelines.group_hits(pool, groups, pixels, TRANSFORM, 5.0, bright=0.0, blue=0.0).collect()}
    assert hits == {1, 2}
    assert pipelines.group_hits(pool, groups, pixels, TRANSFORM, 5.0, bright=100.0, blue=0.0).count() == 0


def test_crater_footprints_may_repeat(spark, pixels):
    craters = spark.createDataFrame([("a", 0.0, 0.0, 8.0), ("b", 2 * DEG, 0.0, 8.0), ("tiny", 0.0, 0.0, 1.0)], "crater string, clon double, clat double, diam_km double")
    geometry = spark.createDataFrame([(1, "o", 0.5 * DEG, 0.5 * DEG)], "ref_id long, obs_id string, lat_center double, lon_center double")
    out = pipelines.crater_footprints(craters, geometry, pixels, TRANSFORM, 0.0, 0.0).collect()
    assert {(r.crater, r.ref_id, r.on_hollow) for r in out} == {("a", 1, True), ("b", 1, True)}


def test_mosaic_statistics(spark):
    frame = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],), ([5.0, NAN],)], "spectrum array<double>")
    rows = {r.band: r for r in pipelines.mosaic_statistics(frame).collect()}
    assert (rows[0]["mean"], rows[0]["std"], rows[1]["median"], rows[1].wavelength_nm) == (2.0, 1.0, 3.0, 305.0)


def test_cli(spark, tmp_path, capsys):
    main(["list"])
    assert "sam_by_group" in capsys.readouterr().out
    spark.createDataFrame([(i, f"o{i % 9}") for i in range(30)], "ref_id long, obs_id string").write.parquet(str(tmp_path / "pairs"))
    main(["splits", "--pairs", str(tmp_path / "pairs"), "--out", str(tmp_path / "splits"), "--seed", "42"])
    assert spark.read.parquet(str(tmp_path / "splits")).count() == 30
    with pytest.raises(SystemExit):
        main(["pairs"])


def test_commands_from_training_to_a_corrected_mosaic(spark, pixels, tmp_path, capsys):
    import json

    from rasterloom.sources import raster as R
    from rasterloom.sources import tiff

    at = lambda name: str(tmp_path / name)
    where = ["--transform=" + ",".join(map(str, TRANSFORM)), "--width", "40", "--height", "40"]
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        x = (0.05 + 0.05 * rng.random(8)).tolist()
        rows.append((i, f"o{i % 12}", x, float(i % 5 + 1), [0.02 + x[0] * 0.001 * k for k in range(231)]))
    spark.createDataFrame(rows, "ref_id long, obs_id string, mdis_iof array<double>, mdis_image_count double, lsf_5p0 array<double>").write.parquet(at("pairs"))
    main(["splits", "--pairs", at("pairs"), "--out", at("splits")])
    spark.read.parquet(at("pairs")).select("ref_id", "lsf_5p0").write.parquet(at("targets"))
    main(["train", "--pairs", at("pairs"), "--targets", at("targets"), "--splits", at("splits"), "--out", at("model"), "--hidden", "16", "--epochs", "4", "--rate", "0.01", "--batch-size", "16", "--dropout", "0.1"])
    stats = json.load(open(at("model/stats.json")))
    assert stats["losses"][-1] < stats["losses"][0] and 2 < stats["image_count_mean"] < 4
    R.write_tiles(pixels.select("row", "col", F.col("bands").cast("array<float>").alias("bands")), at("tiles"))
    common = ["--pixels", at("tiles"), "--model", at("model/model.npz"), "--stats", at("model/stats.json")]
    main(["predict", *common, "--out", at("mosaic")])
    main(["predict", *common, "--out", at("mosaic.tif"), *where, "--roi", "10,20,5,6"])
    with open(at("mosaic.tif"), "rb") as f:
        info = tiff.read_info(f)
        assert info.count == 231 and (tiff.read_window(f, info, 0, 0, 40, 40, [100])[0] > -1e30).sum() == 30 and tiff.descriptions_of(info)[1] == "305 nm"
    assert R.read_tiles(spark, at("mosaic")).count() == 1600
    frame = spark.read.parquet(at("pairs")).join(spark.read.parquet(at("splits")), "ref_id").select("ref_id", "obs_id", "split", F.col("lsf_5p0").alias("target"), F.transform("lsf_5p0", lambda v: v * 1.01).alias("predicted"))
    frame.write.parquet(at("predicted"))
    spark.createDataFrame([(1, 1, 0)], "ref_id long, lrm int, sm_plain int").write.parquet(at("terrain"))
    main(["eval", "--predicted", at("predicted"), "--terrain", at("terrain"), "--out", at("audit")])
    assert json.load(open(at("audit/report.json")))["mse"] > 0 and spark.read.csv(at("audit/per_band"), header=True).count() == 231
    for name, shift in (("real", 0.0), ("drawn", 0.5)):
        spark.createDataFrame([(f"g{i % 6}", (rng.random(9) + shift).tolist(), [0.01 * (i % 7) + shift * 0.001 * k for k in range(231)]) for i in range(40)], "group string, x array<double>, residual array<double>").write.parquet(at(name))
    main(["residual", "--real", at("real"), "--simulated", at("drawn"), "--out", at("residual"), "--epochs", "3", "--hidden", "4"])
    assert np.load(at("residual/basis.npz"))["B"].shape == (231, 2) and json.load(open(at("residual/residual.json")))["weight"] > 0
    (tmp_path / "d.tsv").write_text("a\nb\nCentral.Latitude.dec.degrees\tGeodesic.area.km.2\tCentral.Longitude.dec.degrees\n0\t50\t0\n")
    (tmp_path / "p.csv").write_text("id;geometry\n1;POLYGON ((0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.2))\n")
    build = ["build-layer", "--disks", at("d.tsv"), "--polygons", at("p.csv"), "--pixels", at("tiles"), "--coefficients", at("residual/coefficients.npz"), "--basis", at("residual/basis.npz"), "--stats", at("model/stats.json"), "--out", at("layer"), "--reference=0.1,0.01,0.2,0.1", "--scale", "0.4", "--z=-1"]
    main([*build, *where])
    config = json.load(open(at("layer/config.json")))
    assert config["layer"]["n_pixels_corrected"] == spark.read.parquet(at("layer/layer")).count() > 0 and len(config["residual"]["basis_md5"]) == 12
    common = ["apply-layer", "--source", at("mosaic"), "--layer", at("layer/layer"), "--basis", at("residual/basis.npz"), "--out", at("after")]
    main([*common, "--dry-run"])
    assert not (tmp_path / "after").exists()
    capsys.readouterr()
    main(common)
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["outside_max"] == 0
    main(["extract", "--pixels", at("after"), "--out", at("rgb.tif"), "--wavelengths", "750,550,450", *where])
    main(["consistency", "--pixels", at("after"), "--out", at("stats"), "--width", "40", "--height", "40", "--windows", "2", "--size", "10"])
    assert spark.read.csv(at("stats"), header=True).count() == 231
    craters = [("a" if i < 20 else "b", 1.0 + 0.2 * (i % 2), 1.0, 0.5, float(i % 2), i % 2 == 1) for i in range(40)]
    spark.createDataFrame(craters, "crater string, measured double, anchor double, residual double, gate double, inside boolean").write.parquet(at("table"))
    main(["calibrate", "--table", at("table"), "--out", at("scale.json")])
    assert json.load(open(at("scale.json")))["scale"] == pytest.approx(0.4)


def test_pairs_command_resumes(spark, pixels, tmp_path):
    from rasterloom.sources import raster as R

    at = lambda name: str(tmp_path / name)
    ids = (1, 2, 3)
    (tmp_path / "q.csv").write_text("ref_id,q1,q2,q3,q4,obs_id\n" + "".join(f"{k},1.0,0.0,90.0,99.0,o{k}\n" for k in ids))
    (tmp_path / "g.csv").write_text("ref_id,obs_id,ang_in,ang_em,ang_ph,lat_center,lon_center,width,length,surface\n" + "".join(f"{k},o{k},1,2,3,{2.5 * DEG},{2.5 * DEG},1,1,1\n" for k in ids))
    (tmp_path / "s.csv").write_text("ref_id,foot_geom,point_geom\n" + "".join(f'{k},"{square(2.5 * DEG, 2.5 * DEG, DEG * 0.9)}",x\n' for k in ids))
    waves = [300.0 + 2.5 * k for k in range(400)]
    (tmp_path / "w.csv").write_text("ref_id,id,obs_id,waves,photom_iof\n" + "".join(f'{k},x,o{k},"{waves}","{waves}"\n' for k in ids))
    R.write_tiles(pixels, at("tiles"))
    run = ["pairs", "--quality", at("q.csv"), "--geometry", at("g.csv"), "--shapes", at("s.csv"), "--spectra", at("w.csv"), "--pixels", at("tiles"), "--out", at("out"), "--transform=" + ",".join(map(str, TRANSFORM)), "--width", "40", "--height", "40"]
    seen = lambda: sorted(r.ref_id for r in spark.read.parquet(at("out/pairs")).collect())
    main([*run, "--limit", "1"])
    assert seen() == [1]
    main(run)
    assert seen() == [1, 2, 3]
    main(run)
    assert seen() == [1, 2, 3]
    main([*run, "--force"])
    assert seen() == [1, 2, 3]
    main(["targets", "--pairs", at("out/pairs"), "--spectra", at("w.csv"), "--out", at("t"), "--build", "--diag-b"])
    assert spark.read.parquet(at("t/targets")).count() == 3 and spark.read.csv(at("t/calibration"), header=True).count() == 8


def test_source_checks(spark, tmp_path):
    from rasterloom.plans import validation as V

    (tmp_path / "a").write_text("x")
    spectra = spark.createDataFrame([(1, "o", "[]", "[]")], "ref_id long, obs_id string, waves string, photom_iof string")
    geometry = spark.createDataFrame([(0.4, 3.0)], "width double, length double")
    assert all(r.ok for r in V.source_checks(spark, {"a": str(tmp_path / "a")}, spectra, geometry).collect())
    assert not V.source_checks(spark, {"a": str(tmp_path / "b")}, spectra, geometry).first().ok


def test_validation(spark, pixels):
    from rasterloom.operators import layer as layers
    from rasterloom.plans import validation as V

    info = spark.createDataFrame([(40, 40, 17, "f4", [G.PIXEL_M], -3.4e38)], "width int, height int, count int, dtype string, transform array<double>, nodata double")
    assert all(r.ok for r in V.raster_checks(info, 40, 40, 17).collect())
    rng = np.random.default_rng(0)
    rows = [(0, i, [0.05 + 0.01 * k for k in range(8)] + [float(n), *([0.0] * 8 if n == 1 else [float(0.003 * abs(1 + 0.05 * rng.normal()) / math.sqrt(n))] * 8)]) for i, n in enumerate([1] * 20 + [2, 4, 9, 16, 25, 36, 49, 64] * 5)]
    assert all(r.ok for r in V.pixel_checks(spark.createDataFrame(rows, "row int, col int, bands array<double>")).collect())
    y = [0.02 + 0.0001 * k for k in range(231)]
    before = spark.createDataFrame([(0, 0, y), (0, 1, y), (0, 2, None)], "row int, col int, spectrum array<double>")
    sparse = spark.createDataFrame([(0, 1, 0.5, 0.1, 0.0)], "row int, col int, g float, c0 float, c1 float")
    modes = [[1.0] * 231, [0.0] * 231]
    after = layers.rewrite(before, sparse, modes)
    out = {r.name: r.ok for r in V.mosaic_checks(before, after, sparse, modes, 1, 0.5, (0.028, 0.030), (20.0, 40.0)).collect()}
    assert all(out.values()), out
    quality = spark.createDataFrame([(1, 1.0, 0.0, 90.0, 99.0, "o1"), (2, 1.0, 0.0, 90.0, 99.0, "o2")], "ref_id long, q1 double, q2 double, q3 double, q4 double, obs_id string")
    spectra = spark.createDataFrame([([300.0, 1450.0],), ([290.0, 800.0, 1460.0],)], "waves array<double>")
    shapes = spark.createDataFrame([("POLYGON ((0 0, 1 0, 2 1, 1 2, 0 1))",)] * 2, "foot_geom string")
    pairs = spark.createDataFrame([(1, "o1", y), (2, "o2", y)], "ref_id long, obs_id string, photom_iof_5nm array<double>")
    split = spark.createDataFrame([(1, "test"), (2, "fold0")], "ref_id long, split string")
    got = {r.name: r.ok for r in V.table_checks(quality, spectra, shapes, pairs, split, {"n_good": (2, 2), "n_pairs": (3, 9)}).collect()}
    assert not got.pop("number of pairs") and all(got.values()), got
