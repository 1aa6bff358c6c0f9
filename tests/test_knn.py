"""The ball index: equal to brute force, and most block pairs left out where vectors have structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import knn


def brute_force(queries, rows, k, drop_same=True):
    out = []
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if not (drop_same and i == q))
        out += [(q, i, round(d, 9), rank) for rank, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


def shown(frame):
    return sorted((r.query, r.neighbour, round(r.distance, 9), r.rank) for r in frame.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, v.tolist() if hasattr(v, "tolist") else v) for i, v in rows], "id long, v array<double>")


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 8)) * 100
    return [(i, centres[i % 40] + r.normal(size=8)) for i in range(2400)]


def test_clusters_leave_most_blocks_out(spark, clustered):
    frame = table(spark, clustered)
    asked = frame.where("id % 5 = 0")
    index = knn.build_index(frame, "id", "v")
    found, home, further = knn.search(asked, index, "id", "v", 4)
    assert shown(found) == brute_force([x for x in clustered if x[0] % 5 == 0], clustered, 4)
    met = sum(f.agg(F.sum(F.size("balls"))).first()[0] or 0 for f in (home, further))
    assert len(index.centres) == 49 and met < 0.1 * len(index.centres) * asked.count()


@pytest.mark.parametrize("block", [7, 2000])
def test_without_structure_nothing_is_lost(spark, block):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=5)) for i in range(150)] + [(1000 + i, np.ones(5)) for i in range(60)]  # a hot vector, all ties
    frame = table(spark, rows)
    assert shown(knn.neighbours(frame, frame, "id", "v", 3, block=block)) == brute_force(rows, rows, 3)
    other = [(5000 + i, r.normal(size=5)) for i in range(20)] + [(3, np.ones(5))]
    assert shown(knn.neighbours(table(spark, other), frame, "id", "v", 4, drop_same=False, block=block)) == brute_force(other, rows, 4, drop_same=False)


def test_few_rows_and_unusable_ones(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [float("nan"), 1.0]), (4, None), (None, [1.0, 1.0])]
    frame = table(spark, rows)
    assert shown(knn.neighbours(frame, frame, "id", "v", 5)) == [(1, 2, 5.0, 1), (2, 1, 5.0, 1)]
    none = frame.where("false")
    assert knn.neighbours(frame, none, "id", "v", 2).count() == 0 and knn.neighbours(none, frame, "id", "v", 2).count() == 0


def test_a_query_goes_to_blocks_not_to_balls(spark, monkeypatch):
    """Without structure no ball is left out: a query is copied once for each block of balls."""
    sent, met = [], knn._met
    monkeypatch.setattr(knn, "_met", lambda asked, *rest: sent.append(asked) or met(asked, *rest))
    frame = table(spark, list(enumerate(np.random.default_rng(2).normal(size=(400, 6)))))
    index = knn.build_index(frame, "id", "v")
    further = knn.search(frame, index, "id", "v", 3, block=200)[2]
    assert further.agg(F.avg(F.size("balls"))).first()[0] > 5
    assert sent[1].agg(F.max(F.size("blocks"))).first()[0] <= 4


@pytest.mark.parametrize("shift, kind", [(0.0, np.float32), (1e6, np.float64)])
def test_blocks_in_single_precision_lose_nothing(shift, kind):
    """Copies, near copies and vectors far from the origin, with and without a bound."""
    import pyarrow as pa

    r = np.random.default_rng(5)
    x = (r.normal(size=(700, 8)) + shift).astype(kind).astype(np.float64)
    x[300:400] = x[300]
    x[400:450] = x[400] + r.normal(size=(50, 8)) * 1e-4
    centres = x[:6].copy()
    ball = knn._distances(x, centres).argmin(axis=1)
    radius = np.array([np.sqrt(((x[ball == b] - centres[b]) ** 2).sum(axis=1)).max(initial=0) for b in range(6)]) * (1 + 1e-6)
    exact = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(exact, np.inf)
    ids = r.permutation(700)
    order = np.array([np.lexsort((ids, d))[:5] for d in exact])
    refs = pa.table({"neighbour": pa.array(ids), "rv": pa.array(x.tolist()), "ball": pa.array(ball.astype(np.int32))})
    for bound in (np.full(700, np.inf), np.take_along_axis(exact, order, axis=1)[:, -1]):
        queries = pa.table({"query": pa.array(ids), "qv": pa.array(x.tolist()), "bound": pa.array(bound), "balls": pa.array([[]] * 700, pa.list_(pa.int32()))})
        shared = type("Shared", (), {"value": (centres, radius, None)})
        out = knn._best_of_blocks(shared, 5, True, True)(queries, refs).to_pydict()
        got = dict.fromkeys(ids.tolist(), ())
        for q, n in zip(out["query"], out["neighbour"]):
            got[q] += (n,)
        assert got == {int(q): tuple(ids[o].tolist()) for q, o in zip(ids, order)}


def test_floors_move_a_row_for_each_neighbour(spark):
    """Gaps, spectra of different lengths and bands without a value; no row for each band."""
    nan = float("nan")
    spectra = table(spark, [(1, [1.0, 2.0, nan]), (2, [3.0, None, nan]), (3, [2.0, 5.0, nan, 4.0]), (4, None)])
    near = spark.createDataFrame([(10, 1), (10, 2), (11, 2), (11, 3), (12, 3), (12, 4), (13, 4)], "query long, neighbour long")
    found = knn.variance_floor(near, spectra, "id", "v")
    assert found.first()["floor"] == pytest.approx((1 + 0 + 0.25 + 0 + 0 + 0 + 0 + 0) / 8)
    assert knn.variance_floor(near.where("false"), spectra, "id", "v").first()["floor"] is None
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    even = table(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])])
    near = spark.createDataFrame([(10, 1), (10, 2), (11, 3), (12, 1), (12, 2)], "query long, neighbour long")
    assert knn.angle_floor(near, even, "id", "v").first()["angle_floor"] == pytest.approx(45.0)
