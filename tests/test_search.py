"""The search for a scale against the whole grid; disks against their boxes; radius classes in one join."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.geo import haversine_km
from rasterloom.operators import joins, metrics, raster


def whole_grid(rows, top, step, least=5):
    """(group, s_star, contrast, target) over all steps."""
    out = {}
    for g in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == g]
        sides = [[r for r in own if r[5] == side] for side in (True, False)]
        if min(map(len, sides)) < least:
            continue
        middle = lambda side, f: np.median([x for x in map(f, side) if math.isfinite(x)])
        target = middle(sides[0], lambda r: r[1]) / middle(sides[1], lambda r: r[1])
        best = None
        for k in range(int(math.floor(top / step + 1e-9)) + 1):
            y = lambda r: r[2] + (k * step) * r[4] * r[3]  # noqa: B023, E731
            low = middle(sides[1], y)
            if low:
                c = middle(sides[0], y) / low
                best = min(best or (math.inf,), (abs(c - target), k * step, c, target))
        if best:
            out[g] = best[1:]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_scale_search_is_the_whole_grid(spark, seed):
    r = random.Random(seed)
    rows = []
    for g, (shift, slope) in enumerate([(0.3, 1.0), (0.05, -0.5), (2.0, 3.0), (0.0, 0.0), (-0.2, 0.4)]):
        for i in range(60):
            inside = i % 3 == 0
            anchor = r.uniform(0.5, 1.5) if g != 4 else r.uniform(-1, 1)
            rows.append((f"g{g}", anchor * (1 + shift * inside), anchor if i % 17 else float("nan"), r.gauss(slope, 0.5), r.random(), inside))
    rows += [("few", 1.0, 1.0, 1.0, 1.0, i < 4) for i in range(20)] + [(None, 1.0, 1.0, 1.0, 1.0, True)] * 6
    frame = spark.createDataFrame(rows, "g string, measured double, anchor double, residual double, gate double, inside boolean").repartition(3)
    for top, step in ((2.0, 0.005), (1.0, 0.1)):
        got = {x.g: (x.s_star, x.contrast, x.target) for x in metrics.scale_star(frame, "g", "measured", "anchor", "residual", "gate", "inside", top, step).collect()}
        want = whole_grid([x for x in rows if x[0] is not None], top, step)
        assert set(got) == set(want) == {f"g{k}" for k in range(5)}
        for g, w in want.items():
            assert got[g][0] == pytest.approx(w[0], abs=1e-12) and got[g][1:] == (pytest.approx(w[1]), pytest.approx(w[2])), g
    assert metrics.scale_star(frame.where("false"), "g", "measured", "anchor", "residual", "gate", "inside").count() == 0


@pytest.mark.parametrize("copies", [1, 6])
def test_scales_without_contrast_are_counted_by_few_jobs_over_few_rows(spark, copies):
    """Curves so flat that no bound on a stretch helps: the grid used to be copied into the shuffle, scale by scale."""
    r = random.Random(5)
    one = [("g", r.uniform(20, 120) * (1.15 if i % 3 == 0 else 1), r.uniform(20, 120), r.uniform(-5, 35), i % 7 / 7, i % 3 == 0) for i in range(500)]
    frame = spark.createDataFrame(one * copies, "g string, measured double, anchor double, residual double, gate double, inside boolean")
    assert metrics.SCALE_PARTS**10 > 2**64
    for block in (50, metrics.SCALE_BLOCK):
        got = metrics.scale_star(frame, "g", "measured", "anchor", "residual", "gate", "inside", 2.0, 0.005, block=block).first()
        want = whole_grid(one, 2.0, 0.005)["g"]
        assert got.s_star == pytest.approx(want[0], abs=1e-12) and (got.contrast, got.target) == (pytest.approx(want[1]), pytest.approx(want[2]))


def test_disks_meet_little_beyond_their_boxes(spark):
    side = 220
    pixels = spark.range(side * side).select(F.floor(F.col("id") / side).cast("int").alias("row"), (F.col("id") % side).cast("int").alias("col"))
    r = random.Random(3)
    disks = [(k, r.uniform(0, side), r.uniform(0, side), radius) for k, radius in enumerate([1.0, 3.0, 9.5, 16.0, 17.0, 40.0, 63.9, 0.4] * 3)]
    centres = spark.createDataFrame(disks, "k long, crow double, ccol double, radius double")
    met = raster.candidates_of_disks(pixels, centres, "radius")
    counts = {x.k: x.n for x in met.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    inside = {x.k: x.n for x in met.where("hypot(row - crow, col - ccol) <= radius").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    grid = np.stack(np.meshgrid(np.arange(side), np.arange(side), indexing="ij"), -1).reshape(-1, 2)
    for k, row, col, radius in disks:
        assert inside.get(k, 0) == int((np.hypot(grid[:, 0] - row, grid[:, 1] - col) <= radius).sum())
        if radius >= 3:
            assert counts[k] <= 2 * (2 * radius + 1) ** 2
    assert raster.candidates_of_disks(pixels, centres.limit(0), "radius").count() == 0
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()  # a few centres are many cells


def test_radius_classes_in_one_join(spark):
    r = random.Random(9)
    points = [(i, r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-1, 1)))) for i in range(400)]
    centres = [(r.uniform(-180, 180), r.uniform(-90, 90), radius) for radius in (0.0, 0.5, 30.0, 200.0, 900.0, -1.0)] + [(points[0][1], points[0][2], 0.0)]
    p, c = spark.createDataFrame(points, "k long, lon double, lat double"), spark.createDataFrame(centres, "clon double, clat double, radius_km double")
    got = {x.k for x in joins.outside_all(p, c, "k").collect()}
    near = p.crossJoin(c).where((F.col("radius_km") >= 0) & (haversine_km(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat")) <= F.col("radius_km")))
    assert got == {i for i, _, _ in points} - {x.k for x in near.collect()} and 0 not in got
    assert joins.outside_all(p, c.limit(0), "k").count() == 400


def test_leave_one_out_by_plain_medians(spark):
    for values in ([], [0.3], [0.3, 0.7], [0.5, 0.1, 0.9], [0.4, 0.4, 0.1, 0.4], [0.2, None, 0.8, 0.5], [float(k * 7 % 11) for k in range(9)]):
        frame = spark.createDataFrame([(f"g{k}", v) for k, v in enumerate(values)], "g string, s_star double")
        got = {x.g: x.s_from_others for x in metrics.leave_one_out(frame, "g").collect()}
        for k in range(len(values)):
            rest = [v for j, v in enumerate(values) if j != k and v is not None]
            assert got[f"g{k}"] == (pytest.approx(float(np.median(rest))) if rest else None)
        assert len(got) == len(values)
