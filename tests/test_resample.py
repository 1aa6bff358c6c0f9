"""Resampling by axes against NumPy row by row."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from rasterloom import grid as G
from rasterloom.functions import resample

GRID = np.array(G.wavelengths())


def plain_linear(w, v):
    order = np.argsort(w, kind="stable")
    return np.interp(GRID, np.array(w)[order], np.array(v)[order], left=np.nan, right=np.nan)


def plain_gaussian(w, v, fwhm):
    w, sigma, out = np.array(w), fwhm * G.FWHM_TO_SIGMA, []
    for x in GRID:
        away = np.abs(w - x)
        weight = np.where(away <= 3 * sigma, np.exp(-0.5 * (away / sigma) ** 2), 0.0)
        fine = weight.sum() > 0 and w.min() <= x <= w.max() and away.min() <= (GRID[1] - GRID[0]) / 2
        out.append(weight @ np.array(v) / weight.sum() if fine else math.nan)
    return np.array(out)


def test_shared_and_own_axes(spark):
    r, rows = random.Random(2), []
    shared = [[300.0 + 4.7 * k for k in range(246)], sorted(r.uniform(280, 1500) for _ in range(400)), [1450.0 - 5 * k for k in range(231)]]
    for i in range(60):
        w = shared[i % 3] if i % 4 else r.sample(shared[1], 120)
        rows.append((i, w, [r.uniform(0, 1) for _ in w]))
    rows[5] = (5, rows[5][1], [math.nan if k == 7 else x for k, x in enumerate(rows[5][2])])
    odd = [(100, None, [1.0, 2.0]), (101, [300.0, 400.0], None), (102, [300.0], [1.0]), (103, [300.0, 310.0], [1.0]), (104, [], []), (105, [300.0, 310.0, 1450.0], [1.0, 2.0, 4.0])]
    frame = spark.createDataFrame(rows + odd, "id long, w array<double>, v array<double>").repartition(3)
    got = {x.id: x for x in frame.select("id", resample.resample_linear(F.col("w"), F.col("v")).alias("a"), resample.resample_gaussian(F.col("w"), F.col("v"), 7.0).alias("b")).collect()}
    for i, w, v in [*rows, odd[-1]]:
        assert np.allclose(got[i].a, plain_linear(w, v), rtol=1e-12, atol=1e-15, equal_nan=True)
        if i != 5:
            assert np.allclose(got[i].b, plain_gaussian(w, v, 7.0), rtol=1e-10, atol=1e-14, equal_nan=True)
    assert all(got[i].a is None and got[i].b is None for i in range(100, 105))
    assert got[105].a[-1] == 4.0 and got[105].a[1] == 1.5 and not any(x is None for x in got[5].a)


def test_an_axis_is_worked_out_once():
    import pyarrow as pa

    made = []
    axis = lambda w: (made.append(len(w)), resample.LinearAxis(w))[1]
    w = [[300.0, 500.0, 1450.0]] * 500 + [[300.0, 1450.0]] * 500
    out = resample.resample_batch(pa.array(w), pa.array([[1.0] * len(x) for x in w]), axis, len(GRID))
    assert made == [3, 2] and len(out) == 1000 and set(out.flatten().to_pylist()) == {1.0}
