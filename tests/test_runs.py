"""Runs of cells against the tests of single cells, on random rings and on rings along grid lines."""

import numpy as np
import pytest

from rasterloom.functions import polygon as P
from rasterloom.operators import raster

GRIDS = [((1.0, 0.0, 0.0, 0.0, -1.0, 40.0), 50, 40), ((0.7, 0.0, -3.3, 0.0, 0.9, 1.7), 60, 37), ((2.5, 0.0, 5.0, 0.0, -2.5, 60.0), 9, 13)]


def rings(seed):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(60):
        n = int(r.integers(3, 12))
        turn = np.sort(r.uniform(0, 2 * np.pi, n))
        out.append(r.uniform(-5, 45, 2) + r.uniform(0.2, 20) * r.uniform(0.3, 1, n)[:, None] * np.stack([np.cos(turn), np.sin(turn)], 1))
        out.append(r.uniform(-10, 50, (n, 2)))  # crosses itself
        out.append(r.integers(-2, 42, (n, 2)).astype(float))  # corners and edges on grid lines
        x, y, w, h = r.integers(0, 30, 4)
        out.append(np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float))  # may have no area
    return out


@pytest.mark.parametrize("all_touched", [False, True])
@pytest.mark.parametrize("grid", GRIDS)
def test_runs_hold_the_cells(grid, all_touched):
    transform, width, height = grid
    for k, ring in enumerate(rings(1)):
        rr, cc = raster.covered(ring, transform, width, height, all_touched)
        row, first, last = raster.runs_of_ring(ring, transform, width, height, all_touched)
        cells = {(r, c) for r, a, b in zip(row, first, last) for c in range(a, b + 1)}
        assert cells == set(zip(rr.tolist(), cc.tolist())), (k, ring.tolist())
        assert sum(last - first + 1) == len(cells) and (last >= first).all()  # no cell twice
        same = row[1:] == row[:-1]
        assert (first[1:][same] > last[:-1][same] + 1).all()


def test_output_follows_the_outline_not_the_area():
    turn = np.linspace(0, 2 * np.pi, 128, endpoint=False)
    ring = 5000 + 4000 * np.stack([np.cos(turn), np.sin(turn)], 1)
    row, first, last = raster.runs_of_ring(ring, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), 10_000, 10_000, True)
    assert len(row) < 8100 and (last - first + 1).sum() > 50_000_000


def test_united_runs(spark):
    r = np.random.default_rng(0)
    rows = [(int(k), int(row), int(a), int(a + n)) for k, row, a, n in zip(r.integers(0, 3, 400), r.integers(0, 6, 400), r.integers(0, 300, 400), r.integers(0, 9, 400))]
    got = raster.united_runs(spark.createDataFrame(rows, "k long, row int, first int, last int"), "k").collect()
    cells = {(k, row, c) for k, row, a, b in rows for c in range(a, b + 1)}
    assert sum(x.last - x.first + 1 for x in got) == len(cells) and {(x.k, x.row, c) for x in got for c in range(x.first, x.last + 1)} == cells
    assert P.merged_runs(*(np.zeros(0, int),) * 3, 5)[0].size == 0
