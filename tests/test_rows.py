"""Filters, joins, splits, metrics and k-NN on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geo
from rasterloom.operators import checks, joins, knn, metrics, quality, splits

NAN = float("nan")


def test_quality_rules(spark):
    rows = [(1, 0.9, 0.0, 81.0, 96.0), (2, 1.1, 0.0, 81.0, 96.0), (3, 0.8999, 0.0, 81.0, 96.0), (4, 1.0, 5.0, 81.0, 96.0), (5, 1.0, 0.0, 80.0, 96.0), (6, 1.0, 0.0, 81.0, 95.0), (7, NAN, 0.0, 81.0, 96.0), (8, 1.0, 0.0, NAN, 96.0), (9, None, 0.0, 81.0, 96.0)]
    frame = spark.createDataFrame(rows, "ref_id long, q1 double, q2 double, q3 double, q4 double")
    ids = lambda f: {r[0] for r in f.select("ref_id").collect()}
    assert ids(quality.strict_quality(frame)) == {1, 2}
    assert ids(quality.inverted_quality(frame)) == {3, 7, 9}


def test_visible_floor_keeps_missing(spark):
    frame = spark.createDataFrame([(1, [0.0, 0.0, 0.008, 0.008, 0.008]), (2, [0.0, 0.0, 0.01, 0.02, 0.03]), (3, [0.0, 0.0, NAN, NAN, NAN])], "id long, bands array<double>")
    assert {r.id for r in quality.above_visible_floor(frame, "bands").collect()} == {2, 3}


def test_percentile_gate_needs_five(spark):
    frame = spark.createDataFrame([("a", float(k)) for k in range(4)] + [("b", float(k)) for k in range(5)], "g string, v double")
    assert {(r.g, r.v) for r in quality.percentile_gate(frame, "g", {"v": 0.82}).collect()} == {("b", 4.0)}


def test_mark_join_and_empty(spark):
    frame = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    ids = spark.createDataFrame([(2,), (2,), (None,)], "k long")
    assert {(r.k, r.seen) for r in joins.mark(frame, ids, "k", "seen").collect()} == {(1, False), (2, True), (None, False)}


@pytest.mark.parametrize("seed", [1, 2])
def test_distance_joins_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    p = np.stack([rng.uniform(-180, 180, 200), np.degrees(np.arcsin(rng.uniform(-1, 1, 200)))], axis=1)
    c = np.stack([rng.uniform(-180, 180, 40), np.degrees(np.arcsin(rng.uniform(-1, 1, 40)))], axis=1)
    p[:4] = [[180, 10], [-180, 10], [0, 90], [20, -90]]
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "pid long, lon double, lat double")
    centres = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(c)], "cid long, clon double, clat double")
    la, lo, lb, mo = (np.radians(v) for v in (p[:, 1], p[:, 0], c[:, 1], c[:, 0]))
    h = np.sin((la[:, None] - lb) / 2) ** 2 + np.cos(la)[:, None] * np.cos(lb) * np.sin((lo[:, None] - mo) / 2) ** 2
    d = 2 * 2439.4 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
    got = {(r.pid, r.cid) for r in joins.within_distance(points, centres, 400.0).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(d <= 400))}
    near = {r.pid: (r.cid, r.distance_km) for r in joins.nearest(points, centres, "pid", "cid").collect()}
    assert {k: v[0] for k, v in near.items()} == {i: int(d[i].argmin()) for i in range(200)}
    assert all(v[1] == pytest.approx(d[k].min(), abs=1e-6) for k, v in near.items())
    assert joins.nearest(points, centres.limit(0), "pid", "cid").count() == 0


def test_wraps_disagree_at_180(spark):
    row = spark.range(1).select(geo.wrap_half_open(F.lit(180.0)).alias("a"), geo.wrap_above_180(F.lit(180.0)).alias("b"), geo.wrap_half_open(F.lit(-190.0)).alias("c")).first()
    assert (row.a, row.b, row.c) == (-180.0, 180.0, 170.0)


def test_correlation_guards(spark):
    rows = [("flat", 1.0, float(k)) for k in range(4)] + [("two", 1.0, 2.0), ("two", 2.0, 4.0), ("one", 1.0, 1.0), ("gap", NAN, 1.0), ("gap", 1.0, 1.0), ("gap", 2.0, 3.0), ("gap", 4.0, 4.0)]
    out = spark.createDataFrame(rows, "g string, a double, b double").groupBy("g").agg(metrics.pearson(F.col("a"), F.col("b")).alias("r"), metrics.ols_slope(F.col("a"), F.col("b")).alias("s"), metrics.concordance(F.col("a"), F.col("b")).alias("c"))
    got = {r.g: (r.r, r.s, r.c) for r in out.collect()}
    assert got["flat"][0] is None and got["flat"][1] is None
    assert got["two"][0] == pytest.approx(1.0) and got["two"][1:] == (None, None)
    assert got["one"] == (None, None, None)
    a, b = np.array([1.0, 2, 4]), np.array([1.0, 3, 4])
    assert got["gap"][0] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert got["gap"][2] == pytest.approx(2 * np.cov(a, b, ddof=0)[0, 1] / (a.var() + b.var() + (a.mean() - b.mean()) ** 2))


def test_two_mean_squared_errors_differ(spark):
    frame = spark.createDataFrame([([1.0, NAN], [2.0, 9.0]), ([1.0, 1.0], [1.0, 4.0])], "t array<double>, p array<double>")
    assert metrics.global_mse(metrics.bands_long(frame, [], "t", "p")).first()[0] == pytest.approx(10 / 3)
    assert metrics.mean_row_mse(frame, "t", "p").first()[0] == pytest.approx((1 + 4.5) / 2)


@pytest.mark.parametrize("block", [7, 1000])
def test_knn_blocks_equal_brute_force(spark, block):
    x = np.random.default_rng(3).normal(size=(60, 5)).round(1)
    x[10] = x[11] = x[12]  # twins: self is left out by id
    frame = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in knn.neighbours(frame, frame, "id", "v", 3, block=block).collect():
        got.setdefault(r.query, {})[r.rank] = r.neighbour
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(60):
        order = sorted(range(60), key=lambda j: (d[i, j], j))[:3]
        assert [got[i][k] for k in (1, 2, 3)] == order


def test_group_split(spark):
    frame = spark.range(300).withColumn("g", F.concat(F.lit("g"), (F.col("id") % 40).cast("string")))
    out = splits.group_split(frame, "g")
    assert splits.split_leaks(out, "g").first()[0] == 1
    counts = {r["split"]: r.n_groups for r in splits.split_counts(out, "g").collect()}
    assert counts["test"] == 4 and sorted(v for k, v in counts.items() if k != "test") == [7, 7, 7, 7, 8]
    again = splits.group_split(frame.repartition(7), "g")
    assert out.join(again.withColumnRenamed("split", "other"), ["id", "g"]).where("split != other").count() == 0


def test_merge_report_refuses_drift(tmp_path):
    path = str(tmp_path / "r.json")
    metrics.merge_report(path, {"mse": 1.0})
    assert metrics.merge_report(path, {"mse": 1.0, "x": 2})["x"] == 2
    with pytest.raises(ValueError):
        metrics.merge_report(path, {"mse": 1.0 + 1e-9})


def test_basis_equals_svd(spark):
    r = np.random.default_rng(0).normal(size=(40, 6)) @ np.diag([5, 3, 1, 0.5, 0.2, 0.1])
    rows = [(list(map(float, v)),) for v in r] + [([NAN] * 6,)]
    modes, report = metrics.spectral_basis(spark.createDataFrame(rows, "v array<double>"), "v")
    vt = np.linalg.svd(r, full_matrices=False)[2][:2]
    assert report["n_rows_used"] == 40 and report["n_rows_total"] == 41
    assert np.allclose(np.abs((np.array(modes) * vt).sum(axis=1)), 1, atol=1e-8)


def test_checks(spark):
    counts = spark.createDataFrame([("a", 3)], "stage string, n long")
    assert {(r.stage, r.ok) for r in checks.against_expected(counts, {"a": 3, "b": 1}).collect()} == {("a", True), ("b", False)}
    assert math.isclose(metrics.scale_star.__defaults__[0], 2.0)


def test_copies_of_places_make_no_pairs(spark):
    """Copies of a dense place used to be rows of a join, copies times copies; now only the answers are."""
    from rasterloom.functions.geo import haversine_km

    rng = np.random.default_rng(7)
    spots = [(float(a), float(b)) for a, b in zip(rng.uniform(-180, 180, 6), rng.uniform(-80, 80, 6), strict=True)]
    points = spark.createDataFrame([(i, spots[i % 6][0] + 1e-10 * i, spots[i % 6][1] + 0.01 * (i % 4)) for i in range(3000)], "pid long, lon double, lat double").repartition(3)
    centres = spark.createDataFrame([(f"c{j:04d}", *spots[j % 5], 0.1 if j % 2 else 40.0) for j in range(1500)], "cid string, clon double, clat double, radius_km double")
    pairs = points.crossJoin(centres).withColumn("d", haversine_km(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat")))
    want = {r.pid: (r.b.cid, r.b.d) for r in pairs.groupBy("pid").agg(F.min(F.struct("d", "cid")).alias("b")).collect()}
    got = {r.pid: (r.cid, r.distance_km) for r in joins.nearest(points, centres, "pid", "cid").collect()}
    assert set(got) == set(want) and all(got[p][1] == pytest.approx(d, abs=1e-9) for p, (_, d) in want.items())
    assert {p: c for p, (c, _) in got.items() if want[p][1] > 1e-3} == {p: c for p, (c, d) in want.items() if d > 1e-3}
    near = {r.pid: r.cid for r in joins.nearest_within(points, centres, 0.7, "pid", "cid").collect()}
    assert set(near) == {p for p, (_, d) in want.items() if d <= 0.7}
    covered = {r.pid for r in pairs.where("d <= radius_km").select("pid").distinct().collect()}
    assert {r.pid for r in joins.outside_all(points, centres, "pid").collect()} == set(range(3000)) - covered
    small = joins.BLOCK
    try:
        joins.BLOCK = 100
        assert {r.pid: r.distance_km for r in joins.nearest(points, centres, "pid", "cid").collect()} == {p: d for p, (_, d) in got.items()}
    finally:
        joins.BLOCK = small
    met = joins._met(joins._placed(points, "pid", ("lon", "lat")), joins._placed(centres, "cid", ("clon", "clat")), 0.5, joins._nearest_of_block(*[t for _, t in (joins._arrow(points, "pid"), joins._arrow(centres, "cid"))], 2439.4), "k long, c string, d double")
    assert met.count() <= 3000


def test_cubes_of_centres_are_not_broadcast(spark):
    """Spark knows the size of the centres, not of their 27 cubes each; points of one small file used to be one task."""
    points = spark.createDataFrame([(i, float(i), 0.0) for i in range(50)], "pid long, lon double, lat double").coalesce(1)
    centres = spark.createDataFrame([(j, j + 0.5, 0.0) for j in range(5)], "cid long, clon double, clat double")
    found = joins.within_distance(points, centres, 30.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "REPARTITION_BY_NUM" in plan
    assert {(r.pid, r.cid) for r in found.collect()} == {(j + s, j) for j in range(5) for s in (0, 1)}
