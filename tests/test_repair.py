"""Repair of rings against a table made by hand, and the sweep against all pairs."""

import numpy as np
import pytest

from rasterloom.functions import polygon as P
from rasterloom.operators import raster

SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]
#: ring, area of the one polygon it stands for, or None
TABLE = {
    "square": (SQUARE, 16), "closed": ([*SQUARE, (0, 0)], 16), "repeated points": ([(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4)], 16),
    "spike outwards": ([(0, 0), (4, 0), (4, 4), (2, 4), (2, 9), (2, 4), (0, 4)], 16), "spike in an edge": ([(0, 0), (4, 0), (6, 0), (4, 0), (4, 4), (0, 4)], 16),
    "spike past a corner": ([(0, 0), (7, 0), (4, 0), (4, 4), (0, 4)], 16), "spike inwards": ([(0, 0), (4, 0), (4, 4), (2, 4), (2, 2), (2, 4), (0, 4)], 16), "spike at the end": ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (-3, 0)], 16),
    "long spike of two steps": ([(0, 0), (4, 0), (4, 4), (2, 4), (2, 6), (2, 9), (2, 5), (2, 4), (0, 4)], 16), "only a line": ([(0, 0), (3, 3), (5, 5)], None),
    "hole that touches a corner": ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 2), (2, 2), (2, 1)], 14.5), "hole that touches an edge": ([(0, 0), (2, 0), (1, 2), (3, 2), (2, 0), (4, 0), (4, 4), (0, 4)], 14),
    "covered twice": ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (2, 1), (2, 2), (1, 2)], 16), "lobes side by side": ([(0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4)], None),
    "lobes that touch an edge": ([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], None), "bow tie": ([(0, 0), (4, 4), (4, 0), (0, 4)], None), "no area": ([(0, 0), (1, 1), (0, 0)], None),
}


def even_odd_area(ring, n=160):
    """By counting points, holes left out."""
    side = np.linspace(-4, 10, 14 * n // 10, endpoint=False) + 0.0137
    x, y = np.meshgrid(side, side)
    return P.inside(ring, x.ravel(), y.ravel()).mean() * 14**2


@pytest.mark.parametrize("name", TABLE)
@pytest.mark.parametrize("turned", [False, True])
def test_repair(name, turned):
    points, area = TABLE[name]
    for shift in range(len(points) if points[0] != points[-1] else 1):
        ring = np.array([*points[shift:], *points[:shift]], float)[:: -1 if turned else 1]
        found = P.repaired(ring)
        assert (found is None) == (area is None), shift
        if found is not None:
            assert even_odd_area(found) == pytest.approx(area, abs=0.8), shift


def plain_simple(ring):
    end, n = np.roll(ring, -1, axis=0), len(ring)
    side = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    for i in range(n):
        for j in range(i + 2, n):
            if not (i == 0 and j == n - 1) and side(ring[i], end[i], ring[j]) != side(ring[i], end[i], end[j]) and side(ring[j], end[j], ring[i]) != side(ring[j], end[j], end[i]):
                return False
    return True


def test_the_sweep_is_all_pairs():
    r = np.random.default_rng(2)
    seen = set()
    for k in range(400):
        n = int(r.integers(3, 14))
        turn = np.sort(r.uniform(0, 2 * np.pi, n))
        ring = r.integers(0, 9, (n, 2)).astype(float) if k % 2 else np.stack([np.cos(turn), np.sin(turn)], 1) * r.uniform(0.5, 1, n)[:, None]
        assert P.is_simple(ring) == plain_simple(ring)
        seen.add(P.is_simple(ring))
    assert seen == {True, False}


def test_catalogue_with_spikes_and_touching_rings(spark):
    scale = lambda ring: ", ".join(f"{x / 10} {y / 10}" for x, y in ring)
    rows = [(f"POLYGON (({scale(ring)}))",) for ring, _ in TABLE.values()] + [("POLYGON ((170 0, 190 0, 190 1, 170 1))",), (None,), ("POLYGON ((0 0, 9 0, 9 9, 0 9))",)]
    kept, counts = raster.clean_catalogue(spark.createDataFrame(rows, "wkt string"), "wkt", 500.0)
    good = sum(area is not None for _, area in TABLE.values())
    assert counts.first().asDict() == {"n_raw": len(rows) - 1, "n_seam": 1, "n_degenerate": len(TABLE) - good, "n_oversized": 1, "n_kept": good}
    assert kept.count() == good and kept.columns == ["ring"]


def test_equal_rings_of_a_batch_are_repaired_once(spark, monkeypatch):
    """The rings of one small file used to be repaired one by one in its one task, for each result anew."""
    calls = []
    real = P.repaired
    rows = [("POLYGON ((0 0, 0.04 0, 0.04 0.04, 0.02 0.04, 0.02 0.09, 0.02 0.04, 0 0.04))",), ("POLYGON ((0 0, 0.04 0.04, 0.04 0, 0 0.04))",)] * 50
    frame = spark.createDataFrame(rows, "wkt string").coalesce(1)
    kept, counts = raster.clean_catalogue(frame, "wkt")
    assert kept.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert (kept.count(), counts.first().n_degenerate) == (50, 50)
    assert "ArrowEvalPython" not in counts._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(P, "repaired", lambda ring: calls.append(1) or real(ring))
    import pyarrow as pa

    points = pa.array([[{"x": float(x), "y": float(y)} for x, y in SQUARE]] * 20, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    assert len(raster.repaired_batch(points)) == 20 and len(calls) == 1
