"""The same queries in SQL for DuckDB, written apart from the engine: formulas are spelled out, not shared."""

from __future__ import annotations

import math

from .. import grid as G


def _r(x: str, name: str = "", places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0" + (f" AS {name}" if name else "")


PAIRS = "pairs AS (SELECT a.vec_id, a.label, a.embedding::DOUBLE[] AS t, b.embedding::DOUBLE[] AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
WIDE = "wide AS (SELECT vec_id, label, list_transform(range(231), lambda k: 0.05::DOUBLE + 0.02::DOUBLE * abs(embedding[k % 64 + 1]::DOUBLE)) AS y FROM embeddings)"
WIDE_PAIRS = f"{WIDE}, pairs AS (SELECT a.vec_id, a.label, a.y AS t, b.y AS p FROM wide a JOIN wide b ON b.vec_id = a.vec_id + 1)"
CELLS = "cells AS (SELECT vec_id, label, i - 1 AS band, t[i] AS t, p[i] AS p FROM (SELECT *, unnest(generate_series(1, len(t))) AS i FROM pairs))"
FINITE = "isfinite({0}) AND isfinite({1})"


def _angle(a: str, b: str) -> str:
    return f"degrees(acos(greatest(-1.0, least(1.0, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-8)))))"


def _diff(a: str) -> str:
    return f"list_transform(range(1, len({a})), lambda k: {a}[k + 1] - {a}[k])"


def _centre(a: str) -> str:
    return f"list_transform({a}, lambda x: x - list_avg({a}))"


def _refl(wavelength: float, y: str = "y") -> str:
    left, w = G.bracket(wavelength)
    return f"({y}[{left + 1}] * {1 - w!r}::DOUBLE + {y}[{left + 2}] * {w!r}::DOUBLE)"


def _slope(low: int, high: int, y: str = "y") -> str:
    first, last = (low - 300) // 5, (high - 300) // 5
    x = [300.0 + 5 * k for k in range(first, last + 1)]
    mean = sum(x) / len(x)
    spread = sum((v - mean) ** 2 for v in x)
    return f"list_dot_product({y}[{first + 1}:{last + 1}], {[(v - mean) / spread for v in x]}::DOUBLE[])"


def _linear(y: str = "y") -> dict[str, str]:
    r = {n: _refl(w, y) for n, w in G.REFLECTANCES.items()}
    ratios = {"ci_310_390": ("R310", "R390"), "ci_415_750": ("R415", "R750"), "ci_750_415": ("R750", "R415"), "ci_750_950": ("R750", "R950"), "ratio_430_1000": ("R433", "R996")}
    slopes = {"vis_slope": (415, 750), "nir_slope": (1050, 1400), "vn_slope": (415, 1400), "uv_slope": (300, 415)}
    return r | {n: f"{r[a]} / {r[b]}" for n, (a, b) in ratios.items()} | {n: _slope(*s, y) for n, s in slopes.items()}


def _fitted(y: str = "y") -> dict[str, str]:
    """Least-squares weights solved here in NumPy: no value is missing in these tables."""
    import numpy as np

    x = np.array([300.0 + 5 * k for k in range(61)])
    u = (x - 450) / 150
    curve = np.linalg.pinv(np.stack([u**2, u, np.ones_like(u)], axis=1))[0] / 150**2
    v = np.array([445.0 + 5 * k for k in range(62)])
    line = np.linalg.pinv(np.stack([v, np.ones_like(v)], axis=1))
    at = lambda w: (line[0] * w + line[1]).tolist()
    down = " + ".join(f"(list_dot_product({y}[30:91], {at(w)}::DOUBLE[]) - {y}[{int((w - 300) // 5) + 1}])" for w in (300.0, 325.0, 350.0))
    vis = f"(({_refl(550.0, y)} - {_refl(750.0, y)}) / -200.0)"
    depth = " + ".join(f"(({_refl(401.0, y)} - {401.0 - w} * {vis}) / {_refl(w, y)})" for w in (303.0, 324.0, 350.0))
    return {"curvature": f"list_dot_product({y}[1:61], {curve.tolist()}::DOUBLE[])", "uv_downturn": down, "uv_depth": depth}


def _params(exprs: dict[str, str]) -> str:
    return f"WITH {WIDE} SELECT vec_id, {', '.join(_r(f'({e}) * 1e6', n, 3) for n, e in exprs.items())} FROM wide"


def _band(k: int, y: str) -> str:
    centre, width = list(G.BANDS.values())[k]
    s = width / 2.3548200450309493
    w = {i: math.exp(-0.5 * ((300 + 5 * i - centre) / s) ** 2) for i in range(231) if abs(300 + 5 * i - centre) <= 3 * s}
    return "((" + " + ".join(f"{y}[{i + 1}] * {v!r}" for i, v in w.items()) + f") / {sum(w.values())!r})"


def _bands(y: str) -> str:
    return "[" + ", ".join(_band(k, y) for k in range(8)) + "]"


def _pearson(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 2 AND stddev_pop({x}) >= 1e-8 AND stddev_pop({y}) >= 1e-8 THEN corr({y}, {x}) END"


def _olss(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 3 AND var_pop({x}) > 0 THEN covar_pop({y}, {x}) / var_pop({x}) END"


def _ccc(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 3 THEN 2 * covar_pop({y}, {x}) / (var_pop({x}) + var_pop({y}) + (avg({x}) - avg({y})) ** 2) END"


def _affine(x: str, y: str) -> str:
    slope = f"covar_pop({y}, {x}) / var_pop({x})"
    resid = f"sqrt(greatest(var_pop({y}) - ({slope}) ** 2 * var_pop({x}), 0))"
    return ", ".join(["count(*)::BIGINT AS n", _r(_pearson(x, y), "corr"), _r(slope, "slope"), _r(f"avg({x})", "mean_x"), _r(f"avg({y})", "mean_y"), _r(f"avg({y}) - ({slope}) * avg({x})", '"offset"'), _r(resid, "resid_std"), _r(f"{resid} / avg(abs({y}))", "resid_rel"), _r(f"avg({y}) / avg({x})", "mean_ratio")])


def _sid(a: str, b: str) -> str:
    clip = lambda v: f"list_transform({v}, lambda x: greatest(x, 1e-8))"
    share = lambda v: f"list_transform({clip(v)}, lambda x: x / (list_sum({clip(v)}) + 1e-8))"
    return f"list_sum(list_transform(list_zip({share(a)}, {share(b)}), lambda z: z[1] * ln((z[1] + 1e-8) / (z[2] + 1e-8)) + z[2] * ln((z[2] + 1e-8) / (z[1] + 1e-8))))"


def _knn(k: int, where: str = "a.vec_id <> b.vec_id", vec: str = "embedding::DOUBLE[]") -> str:
    dist = "sqrt(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) ** 2)))"
    return f"dist AS (SELECT q, nb, {dist} AS dist FROM (SELECT a.vec_id AS q, b.vec_id AS nb, a.{vec} AS x, b.{vec} AS y FROM embeddings a JOIN embeddings b ON {where})), near AS (SELECT q, nb, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, nb) AS rank FROM dist) WHERE rank <= {k})"


LONG_VECTORS = "vecs AS (SELECT vec_id, i - 1 AS band, embedding[i]::DOUBLE AS y FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings))"
FLOOR = "SELECT avg(v) FROM (SELECT q, band, var_pop(y) AS v FROM {near} JOIN vecs ON vecs.vec_id = nb GROUP BY q, band)"


def _floor_variants() -> str:
    place = "[(vec_id * 137.508::DOUBLE) % 360.0::DOUBLE - 180.0, (vec_id * 61.803::DOUBLE) % 160.0::DOUBLE - 80.0]"
    parts, out = [], []
    for n, (space, vec) in enumerate((("input", "embedding::DOUBLE[]"), ("lonlat_euclid", place))):
        for m, (side, ref) in enumerate((("all", "TRUE"), ("train", "b.label >= 2"))):
            t = f"{n}{m}"
            a, b = (vec.replace("vec_id", "a.vec_id").replace("embedding", "a.embedding"), vec.replace("vec_id", "b.vec_id").replace("embedding", "b.embedding"))
            parts.append(f"d{t} AS (SELECT a.vec_id AS q, b.vec_id AS nb, list_zip({a}, {b}) AS z FROM embeddings a JOIN embeddings b ON a.label < 2 AND {ref} AND a.vec_id <> b.vec_id), n{t} AS (SELECT q, nb FROM (SELECT q, nb, row_number() OVER (PARTITION BY q ORDER BY sqrt(list_sum(list_transform(z, lambda w: (w[1] - w[2]) ** 2))), nb) AS rank FROM d{t}) WHERE rank <= 5)")
            out.append(f"SELECT '{space}_{side}' AS neighbourhood, {_r('(' + FLOOR.format(near='n' + t) + ')', 'floor')}")
    return f"WITH {LONG_VECTORS}, {', '.join(parts)} " + " UNION ALL ".join(out)


QUALITY = "quality AS (SELECT l_returnflag, l_quantity, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount * 3.0::DOUBLE + 0.85::DOUBLE END AS q1, l_quantity - 25 AS q2, l_tax * 400.0::DOUBLE + 70.0::DOUBLE AS q3, (l_suppkey % 10 + 90)::DOUBLE AS q4 FROM lineitem)"
REST = "abs(q2) < 5 AND q3 > 80 AND q4 > 95"
BY_FLAG = f"l_returnflag, count(*)::BIGINT AS n, {_r('sum(l_quantity)', 'quantity')}"
PLACES = "places AS (SELECT c_custkey, (c_custkey * 137.508::DOUBLE) % 360.0::DOUBLE - 180.0::DOUBLE AS lon, (c_custkey * 61.803::DOUBLE) % 160.0::DOUBLE - 80.0::DOUBLE AS lat FROM customer)"
CENTRES = "centres AS (SELECT s_suppkey, (s_suppkey * 97.11::DOUBLE) % 360.0::DOUBLE - 180.0::DOUBLE AS clon, (s_suppkey * 31.7::DOUBLE) % 150.0::DOUBLE - 75.0::DOUBLE AS clat, 20.0::DOUBLE + s_suppkey % 7 * 40.0::DOUBLE AS radius_km FROM supplier)"
HAVERSINE = "2 * 2439.4::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians(lat - clat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(lon - clon) / 2), 2))))"
DISTANCES = f"{PLACES}, {CENTRES}, away AS (SELECT c_custkey, s_suppkey, radius_km, {HAVERSINE} AS km FROM places, centres)"
NEAREST = f"SELECT c_custkey, s_suppkey, {_r('km', 'distance_km')} FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS k FROM away{{0}}) WHERE k = 1"
SPLIT = "grp AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id::VARCHAR), user_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)), split AS (SELECT user_id, CASE WHEN pos < round_even(n * 0.1, 0) THEN 'test' ELSE 'fold' || ((pos - round_even(n * 0.1, 0)) % 5)::BIGINT END AS split FROM grp)"
PIXELS = 'pixels AS (SELECT event_id // 100 AS "row", event_id % 100 AS col, value, [value, value * 2, 0.5::DOUBLE] AS s FROM events)'
LAYER = 'layer AS (SELECT event_id // 100 AS "row", event_id % 100 AS col, 0.5::DOUBLE AS g, value / 10 AS c0, (event_id % 5) / 10.0::DOUBLE AS c1 FROM events WHERE value > 95)'
MODES = ((1.0, 0.5, 0.25), (0.1, 0.2, -0.3))
DELTA = [f"(l.g * (l.c0 * {MODES[0][k]}::DOUBLE + l.c1 * {MODES[1][k]}::DOUBLE))" for k in range(3)]
JOINED = 'FROM pixels p LEFT JOIN layer l ON p."row" = l."row" AND p.col = l.col'
CORNERS = ((0.3, 0.2), (7.6, 1.1), (5.2, 9.4), (1.0, 6.3))


def _inside() -> str:
    """Even-odd rule with the four edges unrolled, on cell centres (cx, cy) of shapes at (x0, y0)."""
    edges = []
    for (ax, ay), (bx, by) in zip(CORNERS, CORNERS[1:] + CORNERS[:1]):
        edges.append(f"((y0 + {ay} > cy) <> (y0 + {by} > cy) AND cx < ((x0 + {bx}) - (x0 + {ax})) * (cy - (y0 + {ay})) / ((y0 + {by}) - (y0 + {ay})) + (x0 + {ax}))::INT")
    return f"({' + '.join(edges)}) % 2 = 1"


CENTRE_CELLS = f'hits AS (SELECT n_nationkey, r AS "row", c AS col FROM (SELECT n_nationkey, (n_nationkey * 37 % 80)::DOUBLE AS x0, (n_nationkey * 53 % 80)::DOUBLE AS y0 FROM nation) s, (SELECT a.range AS r, b.range AS c, b.range + 0.5::DOUBLE AS cx, a.range + 0.5::DOUBLE AS cy FROM range(100) a, range(100) b) g WHERE {_inside()})'

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

SQL: dict[str, str] = {
    "sam_by_group": f"WITH {PAIRS} SELECT label::BIGINT AS label, count(*)::BIGINT AS n, {_r('median(a)', 'sam_median')}, {_r('quantile_cont(a, 0.95)', 'sam_p95')} FROM (SELECT label, {_angle('p', 't')} AS a FROM pairs) GROUP BY label",
    "sam_median_of_medians": f"WITH {PAIRS}, g AS (SELECT label, median(a) AS m FROM (SELECT label, {_angle('p', 't')} AS a FROM pairs) GROUP BY label) SELECT {_r('median(m)', 'median_of_medians')}, {_r('quantile_cont(m, 0.95)', 'p95_of_medians')} FROM g",
    "sga_scm_sid": f"WITH {PAIRS}, d AS (SELECT vec_id, t, p, {_diff('t')} AS dt, {_diff('p')} AS dp, {_centre('t')} AS ct, {_centre('p')} AS cp FROM pairs) SELECT vec_id, {_r(_angle('dp', 'dt'), 'sga')}, {_r(_angle('cp', 'ct'), 'scm')}, {_r(_sid('p', 't'), 'sid')} FROM d",
    "refl_slope_params": _params(_linear()),
    "poly2_curvature": _params(_fitted()),
    "bandpass_synthesis": f"WITH {WIDE} SELECT vec_id, (i - 1)::BIGINT AS band, {_r('b[i]', 'value')} FROM (SELECT vec_id, {_bands('y')} AS b, unnest(range(1, 9)) AS i FROM wide)",
    "band_calibration": f"WITH {WIDE_PAIRS}, long AS (SELECT i - 1 AS band, x[i] AS x, y[i] AS y FROM (SELECT {_bands('t')} AS x, {_bands('p')} AS y, unnest(range(1, 9)) AS i FROM pairs)) SELECT band::BIGINT AS band, {_affine('x', 'y')} FROM long GROUP BY band",
    "per_band_stats": f"WITH {PAIRS}, {CELLS} SELECT band::BIGINT AS band, {_r(_pearson('t', 'p'), 'pearson_r')}, {_r(_olss('t', 'p'), 'slope')}, {_r(_ccc('t', 'p'), 'ccc')}, {_r('avg(p - t)', 'bias')} FROM cells GROUP BY band",
    "band_summary": f"WITH {LONG_VECTORS} SELECT band::BIGINT AS band, {_r('avg(y)', 'mean')}, {_r('stddev_pop(y)', 'std')}, {_r('median(y)', 'median')}, {_r('quantile_cont(y, 0.95)', 'p95')} FROM vecs GROUP BY band",
    "hf_noise": f"WITH {LONG_VECTORS}, bent AS (SELECT band, lead(y) OVER w - 2 * y + lag(y) OVER w AS d FROM vecs WINDOW w AS (PARTITION BY vec_id ORDER BY band)) SELECT band::BIGINT AS band, 1.0::DOUBLE AS coverage, {_r('stddev_pop(d)', 'hf_noise')} FROM bent GROUP BY band",
    "metric_errors": f"WITH {PAIRS}, {CELLS} SELECT label::BIGINT AS label, {_r('sqrt(avg((p - t) ** 2))', 'rmse')}, {_r('avg(abs(p - t))', 'mae')}, {_r('avg(abs(p - t) / abs(t)) FILTER (abs(t) > 1e-6)', 'mrae')} FROM cells GROUP BY label",
    "mse_two_ways": f"WITH {PAIRS}, {CELLS}, ok AS (SELECT * FROM cells WHERE t <= 0.1) SELECT {_r('(SELECT avg((p - t) ** 2) FROM ok)', 'global_mse')}, {_r('(SELECT avg(m) FROM (SELECT avg((p - t) ** 2) AS m FROM ok GROUP BY vec_id))', 'mean_row_mse')}",
    "coverage_common_support": f"WITH {PAIRS}, {CELLS} SELECT vec_id, {_r('avg((t <= 0.1)::INT)', 'own')}, {_r('avg((t <= 0.1 AND p <= 0.1)::INT)', 'common_a')}, {_r('avg((t <= 0.1 AND p <= 0.1)::INT)', 'common_b')} FROM cells GROUP BY vec_id",
    "ccc_per_group": f"WITH e AS (SELECT event_type, value AS x, value * 0.5::DOUBLE + event_id % 7 AS y FROM events) SELECT event_type, {_r(_pearson('x', 'y'), 'r')}, {_r(_olss('x', 'y'), 'slope')}, {_r(_ccc('x', 'y'), 'ccc')} FROM e GROUP BY event_type",
    "corr_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_r(f'corr({b}, {a})', 'r')} FROM lineitem" for i, a in enumerate(MEASURES) for b in MEASURES[i:]),
    "affine_by_flag": f"WITH l AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem) SELECT l_returnflag, {_affine('x', 'y')} FROM l GROUP BY l_returnflag",
    "log_log_slope": f"SELECT {_r('regr_slope(ln(l_extendedprice), ln(l_quantity))', 'slope')} FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0",
    "scale_grid_argmin": "WITH e AS (SELECT event_type, user_id % 2 = 0 AS i, value + 1 AS a, value * 0.3::DOUBLE + 0.2::DOUBLE AS r, value * CASE WHEN user_id % 2 = 0 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END + 1 AS m FROM events), tgt AS (SELECT event_type, median(m) FILTER (i) / median(m) FILTER (NOT i) AS t FROM e GROUP BY event_type HAVING count(*) FILTER (i) >= 5 AND count(*) FILTER (NOT i) >= 5), curve AS (SELECT event_type, k * 0.05::DOUBLE AS s, median(a + k * 0.05::DOUBLE * r) FILTER (i) / median(a + k * 0.05::DOUBLE * r) FILTER (NOT i) AS c FROM e, (SELECT unnest(range(21)) AS k) GROUP BY event_type, k) "
    f"SELECT event_type, {_r('s', 's_star')}, {_r('c', 'contrast')}, {_r('t', 'target')} FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(c - t), s) AS n FROM curve JOIN tgt USING (event_type)) WHERE n = 1",
    "leave_one_out_scale": f"WITH g AS (SELECT event_type, avg(value) AS s FROM events GROUP BY event_type) SELECT a.event_type, {_r('median(b.s)', 's_from_others')} FROM g a LEFT JOIN g b ON a.event_type <> b.event_type GROUP BY a.event_type",
    "cumulative_variance": f"WITH {LONG_VECTORS}, g AS (SELECT band, sum(y * y) AS pw FROM vecs GROUP BY band) SELECT band::BIGINT AS band, {_r('sum(pw) OVER (ORDER BY pw DESC, band ROWS UNBOUNDED PRECEDING) / sum(pw) OVER ()', 'cumulative')} FROM g",
    "knn_neighbours": f"WITH {_knn(5)} SELECT q AS query, nb AS neighbour, {_r('dist', 'distance')}, rank::BIGINT AS rank FROM near",
    "knn_cross": f"WITH {_knn(3, 'a.label < 5 AND b.label >= 5')} SELECT q AS query, nb AS neighbour, {_r('dist', 'distance')}, rank::BIGINT AS rank FROM near",
    "knn_floor": f"WITH {_knn(5)}, {LONG_VECTORS} SELECT {_r('(' + FLOOR.format(near='near') + ')', 'floor')}",
    "knn_angle_floor": f"WITH {_knn(5)}, {LONG_VECTORS}, cen AS (SELECT q, list(m ORDER BY band) AS c FROM (SELECT q, band, avg(y) AS m FROM near JOIN vecs ON vecs.vec_id = nb GROUP BY q, band) GROUP BY q), ang AS (SELECT near.q, avg({_angle('e.embedding::DOUBLE[]', 'c')}) AS a FROM near JOIN embeddings e ON e.vec_id = nb JOIN cen ON cen.q = near.q GROUP BY near.q) SELECT {_r('median(a)', 'angle_floor')} FROM ang",
    "nn_reliability": f"WITH {_knn(1)}, {PAIRS}, long AS (SELECT vec_id, 'b' || lpad(k::VARCHAR, 2, '0') AS param, t[k + 1] AS t, p[k + 1] AS p FROM (SELECT *, unnest([0, 15, 31, 47, 63]) AS k FROM pairs)), g AS (SELECT a.param, corr(b.t, a.t) AS rel, corr(a.p, a.t) AS m FROM long a JOIN near ON near.q = a.vec_id JOIN long b ON b.vec_id = near.nb AND b.param = a.param GROUP BY a.param) SELECT param, {_r('rel', 'reliability')}, {_r('m', 'model_r')}, {_r('CASE WHEN rel > 0 THEN sqrt(rel) END', 'ceiling')}, {_r('CASE WHEN rel > 0 THEN m / sqrt(rel) END', 'frac_of_ceiling')} FROM g",
    "floor_variants": _floor_variants(),
    "strict_quality": f"WITH {QUALITY} SELECT {BY_FLAG} FROM quality WHERE q1 BETWEEN 0.9::DOUBLE AND 1.1::DOUBLE AND {REST} GROUP BY l_returnflag",
    "inverted_quality": f"WITH {QUALITY} SELECT {BY_FLAG} FROM quality WHERE NOT coalesce(q1 BETWEEN 0.9::DOUBLE AND 1.1::DOUBLE, FALSE) AND {REST} GROUP BY l_returnflag",
    "pass_rates": f"WITH {QUALITY} SELECT count(*)::BIGINT AS n, {_r('avg(coalesce(q1 BETWEEN 0.9::DOUBLE AND 1.1::DOUBLE, FALSE)::INT)', 'q1')}, {_r('avg((abs(q2) < 5)::INT)', 'q2')}, {_r('avg((q3 > 80)::INT)', 'q3')}, {_r('avg((q4 > 95)::INT)', 'q4')}, {_r(f'avg(coalesce(q1 BETWEEN 0.9::DOUBLE AND 1.1::DOUBLE AND {REST}, FALSE)::INT)', 'strict')} FROM quality",
    "group_percentile_gate": f"WITH lim AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.82) AS a, quantile_cont(l_extendedprice, 0.65) AS b FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 5) SELECT l_suppkey, count(*)::BIGINT AS n, {_r('sum(l_extendedprice)', 'price')} FROM lineitem JOIN lim USING (l_suppkey) WHERE l_quantity >= a AND l_extendedprice >= b GROUP BY l_suppkey",
    "bb_zscore_gate": f"WITH r AS (SELECT *, CASE WHEN l_tax > 0 THEN l_discount / l_tax END AS ratio FROM lineitem), m AS (SELECT avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(ratio) AS mb, stddev_pop(ratio) AS sb FROM r) SELECT {BY_FLAG} FROM r, m WHERE (l_quantity - ma) / (sa + 1e-9) > 0.5 AND (ratio - mb) / (sb + 1e-9) > 0.5 GROUP BY l_returnflag",
    "visible_floor": "SELECT vec_id FROM embeddings WHERE list_sort(embedding[3:5]::DOUBLE[])[2] > 0.008::DOUBLE",
    "valid_pixels": "SELECT event_type, count(*) FILTER (value >= 10)::BIGINT AS n_valid, count(*) FILTER (value < 10)::BIGINT AS n_invalid FROM events GROUP BY event_type",
    "terrain_case": f"WITH l AS (SELECT CASE WHEN l_linenumber <> 5 THEN l_linenumber % 2 END AS a, l_suppkey % 2 AS b, l_extendedprice AS v FROM lineitem) SELECT CASE WHEN a = 1 AND b = 1 THEN 'LRM+smooth' WHEN a = 1 THEN 'LRM' WHEN b = 1 THEN 'smooth_plains' ELSE 'other' END AS terrain, count(*)::BIGINT AS n, {_r('median(v)', 'sam_median')}, {_r('quantile_cont(v, 0.95)', 'sam_p95')} FROM l GROUP BY 1",
    "first_n_groups": f"WITH f AS (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY min(o_orderkey), o_custkey LIMIT 25) SELECT o_custkey, count(*)::BIGINT AS n, {_r('sum(o_totalprice)', 'total')} FROM orders WHERE o_custkey IN (SELECT o_custkey FROM f) GROUP BY o_custkey",
    "three_way_join": f"SELECT c_mktsegment, count(*)::BIGINT AS n, {_r('sum(l_extendedprice * (1 - l_discount))', 'revenue')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "left_attr_join": "SELECT lang, count(*)::BIGINT AS n, count(quality)::BIGINT AS n_labelled, sum(quality)::BIGINT AS n_good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "semi_join": "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "anti_join": "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "mark_join": "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents",
    "key_order_lookup": "SELECT b.n_nationkey::BIGINT AS n_nationkey, a.n_nationkey::BIGINT AS position, b.n_name FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7 + 3) % 25",
    "distance_join_nearest": f"WITH {DISTANCES} {NEAREST.format(' WHERE km <= 300')}",
    "distance_join_all": f"WITH {DISTANCES} SELECT c_custkey, s_suppkey, {_r('km', 'distance_km')} FROM away WHERE km <= 120",
    "held_out_anti": f"WITH {DISTANCES} SELECT c_custkey FROM places WHERE c_custkey NOT IN (SELECT c_custkey FROM away WHERE km <= radius_km)",
    "nearest_background": f"WITH {DISTANCES} {NEAREST.format('')}",
    "id_sets": "SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'difference', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'intersection', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'union_all', count(*) FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)",
    "group_split": f"WITH {SPLIT} SELECT event_id, split FROM events JOIN split USING (user_id)",
    "split_counts": f"WITH {SPLIT} SELECT split, count(*)::BIGINT AS n_rows, count(DISTINCT user_id)::BIGINT AS n_groups FROM events JOIN split USING (user_id) GROUP BY split",
    "split_leak_check": f"WITH {SPLIT} SELECT max(k)::BIGINT AS max_splits FROM (SELECT user_id, count(DISTINCT split) AS k FROM events JOIN split USING (user_id) GROUP BY user_id)",
    "union_arms_mix": f"WITH {PAIRS}, arms AS (SELECT vec_id, arm, list_transform(list_zip(t, p), lambda z: z[1] * f + z[2] * (1 - f)) AS y FROM pairs, (VALUES (0, 1.0::DOUBLE), (1, 1.0::DOUBLE / 3), (2, 2.0::DOUBLE / 3)) v(arm, f)) SELECT vec_id, arm::BIGINT AS arm, {_r('y[1]', 'first')}, {_r('list_sum(y)', 'total')} FROM arms",
    "value_counts": "SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_users FROM events GROUP BY event_type",
    "label_strings": f"WITH w AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN 300.0::DOUBLE + 5.0::DOUBLE * n_nationkey ELSE n_nationkey * 5 + 300.5::DOUBLE END AS wl FROM nation) SELECT n_nationkey::BIGINT AS n_nationkey, {_r('wl', 'wavelength')}, ceil(wl)::BIGINT || ' nm' AS shown, substr(md5(n_name), 1, 12) AS print FROM w",
    "list_literals": f"SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN {_r('n_nationkey + 0.25::DOUBLE')} END AS first, CASE WHEN n_nationkey % 4 <> 0 THEN 2::BIGINT END AS n FROM nation",
    "wkt_rings": f"WITH r AS (SELECT n_nationkey, 0 AS ring_no, 12.0::DOUBLE AS area, n_nationkey + 1.5::DOUBLE AS cy, 4.0::DOUBLE AS span FROM nation UNION ALL SELECT n_nationkey, 1, 0.5::DOUBLE, n_nationkey + 4.0::DOUBLE / 3, 1.0::DOUBLE FROM nation) SELECT n_nationkey::BIGINT AS n_nationkey, ring_no::BIGINT AS ring_no, {_r('area', 'area')}, {_r('area * (2439.4::DOUBLE * pi() / 180) ** 2 * cos(radians(cy))', 'area_km2')}, {_r('cy', 'centroid_y')}, {_r('span', 'span')} FROM r",
    "geodesic_disks": f"WITH {CENTRES}, v AS (SELECT s_suppkey, k, clon, radians(clat) AS la, radius_km / 2439.4::DOUBLE AS d, k * 2 * pi() / 8 AS th FROM centres, (SELECT unnest(range(8)) AS k)), w AS (SELECT *, asin(sin(la) * cos(d) + cos(la) * sin(d) * cos(th)) AS lat FROM v) SELECT s_suppkey, k::BIGINT AS vertex, {_r('degrees(radians(clon) + atan2(sin(th) * sin(d) * cos(la), cos(d) - sin(la) * sin(lat)))', 'x')}, {_r('degrees(lat)', 'y')} FROM w",
    "longitude_wraps": f"WITH l AS (SELECT n_nationkey, (n_nationkey * 30)::DOUBLE - 190 AS lon FROM nation) SELECT n_nationkey::BIGINT AS n_nationkey, {_r('((lon + 180) % 360 + 360) % 360 - 180', 'half_open')}, {_r('CASE WHEN lon > 180 THEN lon - 360 ELSE lon END', 'above_180')} FROM l",
    "cells_and_rasterise": f'WITH {CENTRE_CELLS} SELECT DISTINCT "row"::BIGINT AS "row", col::BIGINT AS col FROM hits',
    "zonal_mean_centres": f'WITH {CENTRE_CELLS}, {PIXELS} SELECT n_nationkey::BIGINT AS n_nationkey, count(*)::BIGINT AS n, {_r("avg(value)", "mean")} FROM hits JOIN pixels USING ("row", col) GROUP BY n_nationkey',
    "window_grid_sample": f'WITH {PIXELS}, h AS (SELECT greatest(max("row") + 1 - 10, 0) AS top FROM pixels), k AS (SELECT unnest(range(0, 10)) + s AS pos FROM (VALUES (0), (45), (90)) v(s)), y AS (SELECT unnest(range(0, 10)) + s AS pos FROM (SELECT unnest([0, floor(top / 2.0)::BIGINT, top]) AS s FROM h)) SELECT count(*)::BIGINT AS n, {_r("sum(value)", "total")} FROM pixels WHERE "row" IN (SELECT pos FROM y) AND col IN (SELECT pos FROM k)',
    "decimated": f'WITH {PIXELS} SELECT "row"::BIGINT AS "row", col::BIGINT AS col, {_r("value", "value")} FROM pixels WHERE "row" % 16 = 0 AND col % 16 = 0',
    "sparse_layer_apply": f'WITH {PIXELS}, {LAYER} SELECT p."row"::BIGINT AS "row", p.col::BIGINT AS col, {", ".join(_r(f"p.s[{k + 1}] + coalesce({DELTA[k]}, 0)", f"s{k}") for k in range(3))} {JOINED}',
    "layer_lookup": f'WITH {PIXELS}, {LAYER} SELECT p."row"::BIGINT AS "row", {_r("sum(coalesce(l.g, 0))", "g")} {JOINED} GROUP BY p."row"',
    "layer_audit": f"WITH {PIXELS}, {LAYER}, j AS (SELECT p.s, {', '.join(f'{DELTA[k]} AS d{k}' for k in range(3))} {JOINED} WHERE l.g IS NOT NULL) SELECT count(*)::BIGINT AS n_written, 0::BIGINT AS n_nodata_skipped, {_r('max(greatest(abs(d0), abs(d1), abs(d2)))', 'delta_max_abs')}, sum((s[1] + d0 < 0)::INT + (s[2] + d1 < 0)::INT + (s[3] + d2 < 0)::INT)::BIGINT AS n_negative_after, {_r('median(d0)', 'delta_median')} FROM j",
    "layer_tiles": f'WITH {LAYER} SELECT ("row" // 16)::BIGINT AS tile_row, (col // 32)::BIGINT AS tile_col, count(*)::BIGINT AS n_pixels FROM layer GROUP BY 1, 2',
    "layer_verify": f"WITH {PIXELS} SELECT count(*)::BIGINT AS n, 0.0::DOUBLE AS outside_max, 0.0::DOUBLE AS inside_max FROM pixels",
    "selection_stats": f'WITH {PIXELS}, f AS (SELECT value > 10 AS valid, value > 10 AND col < 30 AS chosen FROM pixels), c AS (SELECT (SELECT (max("row") + 1) * 100 FROM pixels) AS size, count(*) AS n, count(*) FILTER (NOT valid) AS bad, count(*) FILTER (valid AND NOT chosen) AS rej, count(*) FILTER (chosen) AS kept FROM f) SELECT n::BIGINT AS n_pixels_spatial, bad::BIGINT AS n_pixels_invalid, rej::BIGINT AS n_pixels_rejected, kept::BIGINT AS n_pixels_corrected, {_r("round_even(100.0::DOUBLE * kept / size, 5)", "fraction_pct")}, {_r("round_even(kept::DOUBLE / greatest(n - bad, 1), 4)", "bright_blue_rate")} FROM c',
    "checks_report": "SELECT 'discount range' AS name, (SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.1) = 0 AS ok UNION ALL SELECT 'document ids', (SELECT count(*) = count(DISTINCT doc_id) FROM documents) UNION ALL SELECT 'order ids repeat', (SELECT count(*) = count(DISTINCT l_orderkey) FROM lineitem) UNION ALL SELECT 'columns', FALSE",
}


def _fidelity() -> str:
    both = {n: (e, (_linear("p") | _fitted("p"))[n]) for n, e in (_linear("t") | _fitted("t")).items()}
    rows = ", ".join(f"struct_pack(param := '{n}', t := {a}, p := {b})" for n, (a, b) in both.items())
    return f"{WIDE_PAIRS}, long AS (SELECT vec_id, r.param AS param, r.t AS t, r.p AS p FROM (SELECT vec_id, unnest([{rows}]) AS r FROM pairs)), fid AS (SELECT param, {_pearson('t', 'p')} AS r, {_olss('t', 'p')} AS slope, {_ccc('t', 'p')} AS ccc, median(p - t) AS bias, median(t) AS mt FROM long GROUP BY param)"


SQL["param_fidelity"] = f"WITH {_fidelity()} SELECT param, {_r('r', 'pearson_r')}, {_r('slope', 'slope')}, {_r('ccc', 'ccc')}, {_r('bias * 1e6', 'bias', 3)}, {_r('mt * 1e6', 'median_target', 3)} FROM fid"
SQL["metric_panel"] = (
    f"WITH {_fidelity()}, {CELLS}, sh AS (SELECT {_angle('p', 't')} AS sam, {_angle('dp', 'dt')} AS sga, {_sid('p', 't')} AS sid FROM (SELECT t, p, {_diff('t')} AS dt, {_diff('p')} AS dp FROM pairs)) "
    f"SELECT (SELECT {_r('sqrt(avg((p - t) ** 2))')} FROM cells) AS rmse, (SELECT {_r('avg(abs(p - t))')} FROM cells) AS mae, (SELECT {_r('avg(abs(p - t) / abs(t)) FILTER (abs(t) > 1e-6)')} FROM cells) AS mrae, "
    f"{_r('median(sam)', 'sam_median')}, {_r('avg(sam)', 'sam_mean')}, {_r('median(sga)', 'sga_median')}, {_r('avg(sid)', 'sid_mean')}, "
    + ", ".join(f"(SELECT {_r(f'sum({c}) / 6')} FROM fid WHERE param IN ('R559', 'vis_slope', 'ratio_430_1000', 'nir_slope', 'curvature', 'uv_downturn')) AS {n}" for c, n in (("r", "r_key_balanced"), ("ccc", "ccc_key_balanced"), ("slope", "slope_key_balanced")))
    + " FROM sh"
)
