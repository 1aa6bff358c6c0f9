"""Array and spectral expressions against plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import grid as G
from rasterloom.functions import arrays as A
from rasterloom.functions import spectral as S

NAN = float("nan")
X = np.array(G.wavelengths())


def one(spark, expr, **arrays):
    names = list(arrays)
    frame = spark.createDataFrame([tuple(list(map(float, arrays[n])) for n in names)], ", ".join(f"{n} array<double>" for n in names))
    return frame.select(expr.alias("v")).first()["v"]


def numpy_angle(a, b):
    ok = np.isfinite(a) & np.isfinite(b)
    a, b = np.where(ok, a, 0), np.where(ok, b, 0)
    return math.degrees(math.acos(np.clip(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-8), -1, 1)))


@pytest.mark.parametrize("a,b", [([1, 2, 3], [3, 2, 1]), ([1, NAN, 3], [3, 2, 1]), ([NAN, NAN, NAN], [1, 2, 3]), ([0, 0, 0], [1, 2, 3]), ([1, 2, 3], [1, 2, 3])])
def test_angle(spark, a, b):
    assert one(spark, S.angle_deg(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(numpy_angle(np.array(a, float), np.array(b, float)), abs=1e-3)


def test_gradient_and_correlation_angle(spark):
    a, b = np.array([1.0, 4, 2, 8]), np.array([2.0, 3, 5, 7])
    assert one(spark, S.gradient_angle_deg(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(numpy_angle(np.diff(a), np.diff(b)))
    assert one(spark, S.correlation_angle_deg(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(numpy_angle(a - a.mean(), b - b.mean()))


def test_nan_mean_median(spark):
    assert one(spark, A.nan_mean(F.col("a")), a=[1, NAN, 3]) == 2
    assert one(spark, A.nan_median(F.col("a")), a=[5, NAN, 1, 2]) == 2
    assert one(spark, A.nan_median(F.col("a")), a=[4, 1]) == 2.5
    assert math.isnan(one(spark, A.nan_mean(F.col("a")), a=[NAN, NAN]))


def test_reflectance_keeps_both_neighbours(spark):
    y = np.sin(X / 200)
    assert one(spark, S.reflectance(F.col("a"), 433.2), a=y) == pytest.approx(np.interp(433.2, X, y))
    hole = y.copy()
    hole[G.nearest_index(745.0)] = NAN
    assert math.isnan(one(spark, S.reflectance(F.col("a"), 750.0), a=hole))


def test_slope_propagates_and_curvature_drops_missing(spark):
    y = 0.02 + 1e-7 * (X - 450) ** 2 + 1e-5 * X
    hole = y.copy()
    hole[[3, 30, 45]] = NAN
    picked = slice(0, 61)
    assert one(spark, S.quadratic_coefficient(F.col("a")), a=hole) == pytest.approx(1e-7, rel=1e-6)
    assert one(spark, S.slope(F.col("a"), 415.0, 750.0), a=y) == pytest.approx(np.polyfit(X[23:91], y[23:91], 1)[0])
    assert math.isnan(one(spark, S.slope(F.col("a"), 415.0, 750.0), a=hole))
    few = np.full(231, NAN)
    few[:4] = 1.0
    assert math.isnan(one(spark, S.quadratic_coefficient(F.col("a")), a=few))
    assert len(X[picked]) == 61


def test_uv_downturn(spark):
    y = 0.01 + 5e-5 * X
    y[:12] -= 0.003
    y[5] = NAN  # 325 nm adds nothing
    fit = np.polyfit(X[29:91], y[29:91], 1)
    want = sum(np.polyval(fit, w) - y[int((w - 300) / 5)] for w in (300, 350))
    assert one(spark, S.uv_downturn(F.col("a")), a=y) == pytest.approx(want, abs=1e-12)


def test_bandpass(spark):
    y = np.cos(X / 300)
    y[20:30] = NAN
    got = one(spark, S.synthesise_bands(F.col("a")), a=y)
    for (c, w), v in zip(G.BANDS.values(), got):
        s = w * G.FWHM_TO_SIGMA
        weight = np.where(np.abs(X - c) <= 3 * s, np.exp(-0.5 * ((X - c) / s) ** 2), 0) * np.isfinite(y)
        assert (math.isnan(v) and weight.sum() == 0) or v == pytest.approx((np.nan_to_num(y) * weight).sum() / weight.sum())


def test_panel_has_27_parameters(spark):
    assert len(S.parameters(F.lit(None).cast("array<double>"))) == 27


def test_valid_pixel_and_nodata(spark):
    assert one(spark, A.is_valid_pixel(F.col("a")), a=[1, 2]) is True
    assert one(spark, A.is_valid_pixel(F.col("a")), a=[1, -1e30]) is False
    assert one(spark, A.is_valid_pixel(F.col("a")), a=[1, NAN]) is False
    assert one(spark, A.is_valid_pixel(F.col("a")), a=[1, float("inf")]) is False


def test_nearest_index_of_996_is_995():
    assert G.nearest_index(996.0) == 139 and X[139] == 995.0
